"""Pair features. Native where Spark has the operation; string comparators come from one Arrow pass.

Both sides' normalised columns stand in the pair row with suffixes _1 (S1) and _2 (S2/S3). Formulas
that the literature only names are our choice and documented at the function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.comparators import compare


def both_records(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the columns of both records, as <column>_1 and <column>_2."""
    side = lambda n, key: records.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{n}") for c in columns])
    return pairs.join(side(1, "s1_id"), "s1_id").join(side(2, "s23_id"), "s23_id")


def _size(c: Column) -> Column:
    return F.size(c).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    union = _size(F.array_union(a, b))
    return F.when(union > 0, _size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set."""
    least = F.least(_size(F.array_distinct(a)), _size(F.array_distinct(b)))
    return F.when(least > 0, _size(F.array_intersect(a, b)) / least).otherwise(0.0)


def digit_overlap(a: Column, b: Column) -> Column:
    """All-digit tokens: shared over the larger set; 0 if a side has none."""
    digits = lambda x: F.array_distinct(F.filter(x, lambda t: t.rlike("^[0-9]+$")))
    x, y = digits(a), digits(b)
    most = F.greatest(_size(x), _size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), _size(F.array_intersect(x, y)) / most).otherwise(0.0)


def relation(a: Column, b: Column) -> Column:
    """0 both missing, 1 one missing, 2 equal, 3 different."""
    return F.when((a == "") & (b == ""), 0).when((a == "") | (b == ""), 1).when(a == b, 2).otherwise(3)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of equal length; -1 for others."""
    places = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) != F.length(b), -1).otherwise(F.aggregate(places, F.lit(0), lambda s, x: s + x))


def first_number_relation(first_1: Column, nums_1: Column, first_2: Column, nums_2: Column) -> Column:
    """0 both missing, 1 one missing, 2 equal, 3 one is a prefix of the other, 4 a suffix, 5 S1's stands
    elsewhere in the other record, 6 the reverse, 7 one digit differs, 8 several digits, 9 unrelated."""
    distance = hamming(first_1, first_2)
    return (
        F.when((first_1 == "") & (first_2 == ""), 0).when((first_1 == "") | (first_2 == ""), 1).when(first_1 == first_2, 2)
        .when(F.startswith(first_1, first_2) | F.startswith(first_2, first_1), 3).when(F.endswith(first_1, first_2) | F.endswith(first_2, first_1), 4)
        .when(F.array_contains(nums_2, first_1), 5).when(F.array_contains(nums_1, first_2), 6).when(distance == 1, 7).when(distance > 1, 8).otherwise(9)
    )


def name_features() -> dict[str, Column]:
    a, b = F.col("name_tokens_1"), F.col("name_tokens_2")
    c1, c2 = F.col("name_core_1"), F.col("name_core_2")
    at = lambda x, i: F.coalesce(F.try_element_at(x, F.lit(i)), F.lit(""))
    return {
        "nm_jac": jaccard(a, b), "nm_contain": containment(a, b), "nm_shared": F.size(F.array_intersect(a, b)), "nm_first_eq": (at(a, 1) == at(b, 1)).cast("int"), "nm_last_eq": (at(a, -1) == at(b, -1)).cast("int"),
        "nm_len1": F.length(c1), "nm_len2": F.length(c2), "nm_prefix3": (F.substring(c1, 1, 3) == F.substring(c2, 1, 3)).cast("int"), "x_extra_cnt": F.size(F.array_except(b, a)), "x_missing_cnt": F.size(F.array_except(a, b)),
    }


def number_features() -> dict[str, Column]:
    a, b, f1, f2 = F.col("nums_1"), F.col("nums_2"), F.col("first_num_1"), F.col("first_num_2")
    inside = lambda n, r: F.exists(r, lambda x: (n.try_cast("int") >= x["lo"]) & (n.try_cast("int") <= x["hi"]))
    x, y = F.array_join(a, ""), F.array_join(b, "")
    return {
        "num_first_rel": first_number_relation(f1, a, f2, b), "num_absdiff": F.coalesce(F.abs(f1.try_cast("bigint") - f2.try_cast("bigint")), F.lit(-1)), "num_hamming": hamming(f1, f2), "num_shared": F.size(F.array_intersect(a, b)), "num_jac": jaccard(a, b),
        "num_subset": ((F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))).cast("int"), "num_extra": F.size(F.array_except(b, a)), "num_missing": F.size(F.array_except(a, b)),
        "num_in_range": F.coalesce(inside(f1, F.col("ranges_2")) | inside(f2, F.col("ranges_1")), F.lit(False)).cast("int"), "num_digits_contain": ((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))).cast("int"),
    }


def address_features() -> dict[str, Column]:
    a, b = F.col("addr_tokens_1"), F.col("addr_tokens_2")
    return {
        "ad_jac": jaccard(a, b), "ad_contain": containment(a, b), "ad_ncomp_diff": F.abs(F.col("n_components_1") - F.col("n_components_2")), "ad_len_diff": F.abs(F.length("addr_norm_1") - F.length("addr_norm_2")),
        "admin_rel": relation(F.col("admin_1"), F.col("admin_2")), "postal_rel": relation(F.col("postal_1"), F.col("postal_2")), "addr_digit_overlap": digit_overlap(F.split("addr_norm_1", " "), F.split("addr_norm_2", " ")),
    }


def flag_features() -> dict[str, Column]:
    family = lambda n: F.when(F.col(f"legal_code_{n}") == 0, F.lit("")).otherwise(F.col(f"legal_code_{n}").cast("string"))
    return {
        "f_script": F.greatest("name_script_1", "name_script_2"), "f_domain": F.greatest("is_domain_1", "is_domain_2"), "f_dba": F.greatest("has_dba_1", "has_dba_2"), "f_addr_empty_s23": F.col("addr_empty_2"),
        "f_source_s3": F.startswith("s23_id", F.lit("S3-")).cast("int"), "same_country": (F.col("country_norm_1") == F.col("country_norm_2")).cast("int"), "is_source_2": F.startswith("s23_id", F.lit("S2-")).cast("int"), "legal_rel": relation(family(1), family(2)),
    }


FUZZY = {"nm_core": "name_core", "nm_strict": "name_strict", "nm_norm": "name_norm", "nm_collapsed": "name_collapsed", "ad": "addr_norm", "st": "street"}
NEEDED = "name_norm name_core name_strict name_collapsed name_alt name_tokens is_domain has_dba name_script legal_code addr_norm street admin postal first_num nums addr_tokens ranges n_components addr_empty country_norm".split()


def pair_features(pairs: DataFrame, records: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Pairs (s1_id, s23_id, ...) with all features; records are normalised (see functions.names)."""
    from ..functions.native import name_tokens

    rows = both_records(pairs, records.withColumn("name_tokens", name_tokens(F.col("name_core"))), NEEDED)
    rows = rows.withColumns(name_features() | number_features() | address_features() | flag_features())
    if fuzzy:
        # All comparators stand in one projection, so that Spark runs them in one Arrow pass.
        plain, more = ("ratio", "tsort", "tset", "partial", "jw"), ("lcs", "postfix", "skeleton", "softcov", "acronym")
        both = lambda c: (F.col(f"{c}_1"), F.col(f"{c}_2"))
        rows = rows.withColumns({f"_{p}": compare(*both(c), plain) for p, c in FUZZY.items()} | {"_more": compare(*both("name_core"), more)})
        rows = rows.select("*", *[F.col(f"_{p}.{k}").alias(f"{p}_{k}") for p in FUZZY for k in plain], *[F.col(f"_more.{k}").alias(f"nm_{k}") for k in more]).drop("_more", *[f"_{p}" for p in FUZZY])
    return rows.drop(*[f"{c}_{n}" for c in NEEDED for n in (1, 2)])


def group_relative(pairs: DataFrame, columns: list[str], combined: str) -> DataFrame:
    """Gap of each column to the entity's best, and the rank by the combined score (ties by id)."""
    w = Window.partitionBy("s1_id")
    gaps = {f"gap_{c}": F.max(c).over(w) - F.col(c) for c in columns}
    return pairs.withColumns(gaps | {"rank_combined": F.row_number().over(w.orderBy(F.desc(combined), "s23_id"))})
