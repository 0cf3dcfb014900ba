"""Validation of list files and generation of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, n, examples) of a list table (line, the raw text of each row without its header).

    Rules: no_tab, duplicate_s1, duplicate_ids, s1_in_list, bad_prefix, missing_s1, unexpected_s1 and,
    with known ids, unknown_id. examples: the first five offenders in order, joined by commas. Each rule
    is one distributed aggregate; only its few offenders shown are kept.
    """
    split = rows.select(F.split("line", "\t", 2).alias("p"), "line").select("line", F.element_at("p", 1).alias("s1_id"), F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")).alias("list"))
    tabbed = split.where(F.contains("line", F.lit("\t")))
    ids = tabbed.select("s1_id", F.filter(F.transform(F.split("list", ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))
    each = ids.select("s1_id", F.explode("ids").alias("id"))
    found = {
        "no_tab": split.where(~F.contains("line", F.lit("\t"))).select(F.col("line").alias("x")),
        "duplicate_s1": ids.groupBy("s1_id").count().where("count > 1").select(F.col("s1_id").alias("x")),
        "duplicate_ids": ids.where(F.size(F.array_distinct("ids")) < F.size("ids")).select(F.col("s1_id").alias("x")),
        "s1_in_list": each.where(F.startswith("id", F.lit("S1-"))).select(F.col("id").alias("x")),
        "bad_prefix": each.where(~F.col("id").rlike("^S[123]-")).select(F.col("id").alias("x")),
        "missing_s1": entities.select("s1_id").join(ids, "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
        "unexpected_s1": ids.select("s1_id").distinct().join(entities.select("s1_id"), "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
    }
    if known is not None:
        found["unknown_id"] = each.select("id").distinct().join(known.select(F.col("s23_id").alias("id")), "id", "left_anti").select(F.col("id").alias("x"))
    out = None
    for rule, xs in found.items():
        # Five smallest by a bounded top-k, not by collecting all offenders.
        n = xs.agg(F.count("*").alias("n"))
        shown = xs.distinct().orderBy("x").limit(5).agg(F.array_join(F.sort_array(F.collect_list("x")), ",").alias("examples"))
        row = n.crossJoin(shown).select(F.lit(rule).alias("rule"), "n", "examples")
        out = row if out is None else out.unionByName(row)
    return out


def header_error(header: str | None, columns: list[str], name: str = "file") -> str | None:
    """What is wrong with a list file's first line: it must be the columns, divided by a tab, in any case."""
    if not header:
        return f"{name} is empty."
    if "\t" not in header and "," in header:
        return f"{name}: the header has commas and no tab; lists are tab-separated."
    found = [c.strip().lower() for c in header.rstrip("\r\n").split("\t")]
    return None if found == columns else f"{name}: header {found}, expected {columns}."


def check_lists(spark, matches: str, candidates: str | None, entities: DataFrame, known: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a match list and, where there is one, a candidate list. Unknown ids are looked
    for only if known ids are given; matches that are no candidates are a warning."""
    from ..sources.io import exists, list_pairs, read_header, read_lines

    errors, warnings, found = [], [], {}
    if known is None:
        warnings.append("ids are not held against the records")
    for path, column, needed in ((matches, "matched_entity_ids", True), (candidates, "candidate_entity_ids", False)):
        if path is None:
            continue
        if not exists(spark, path):
            (errors if needed else warnings).append(f"{path} is missing")
            continue
        if wrong := header_error(read_header(spark, path), ["source1_entity_id", column], path):
            errors.append(wrong)
            continue
        found[column] = read_lines(spark, path)
        errors += [f"{path}: {r['rule']} ({r['n']}): {r['examples']}" for r in violations(found[column], entities, known).where("n > 0").collect()]
    if len(found) == 2:
        outside = not_contained(*[list_pairs(rows) for rows in found.values()]).select("s1_id").distinct()
        if n := outside.count():
            warnings.append(f"{n} entities have matches that are no candidates: {[r[0] for r in outside.orderBy('s1_id').limit(5).collect()]}")
    return errors, warnings


def not_contained(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that aren't candidates (a warning, not an error)."""
    return matches.select("s1_id", "s23_id").distinct().join(candidates.select("s1_id", "s23_id"), ["s1_id", "s23_id"], "left_anti")


def list_statistics(lists: DataFrame) -> DataFrame:
    """Rows, mean and largest list, number of empty lists."""
    n = F.size("matched")
    return lists.agg(F.count("*").alias("n_rows"), F.round(F.avg(n), 6).alias("mean_links"), F.max(n).alias("max_links"), F.count_if(n == 0).alias("n_empty"))
