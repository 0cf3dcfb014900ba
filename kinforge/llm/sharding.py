"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a key draws -ln(u) / weight for every child, u hashed from the child's name and the key,
and goes to the child with the least draw. A child is chosen in proportion to its weight, and where
one weight changes, keys move only into or out of the subtree whose weight changed. Everything is a
native expression: no shuffle is needed to place a row. u comes from MD5, so that SQL engines agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Rows of one numbered part of a shard, and of a run of equal rows that is written out at once.
PART_ROWS = 100_000


@dataclass(frozen=True)
class Tree:
    """Weights of shards by region and rack; shards are numbered in this order. Weight 0 takes nothing."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def tree_of(n: int, base: int = 40, racks: int = 2, per_rack: int = 5) -> Tree:
    """The tree of n shards of equal weight: the first `base` stand in full regions of racks x per_rack,
    each later one is a region of its own. So one more shard changes no old subtree's weight, and rows
    move into the new shard only."""
    size, first = racks * per_rack, min(n, base)
    regions = []
    for lo in range(0, first, size):
        own = [1.0] * min(size, first - lo)
        regions.append(tuple(tuple(own[i : i + per_rack]) for i in range(0, len(own), per_rack)))
    return Tree((*regions, *[((1.0,),)] * (n - first)))


def _draw(weights: Column, name: Column, key: Column) -> Column:
    """The place of the child that wins; ties (practically none) go to the first. Children are named by
    their parent's name and their place; without weight they never win."""
    def score(weight: Column, i: Column) -> Column:
        digits = F.substring(F.md5(F.concat(name, i.cast("string"), F.lit("|"), key)), 1, 13)
        drawn = -F.log((F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)) / weight
        return F.struct(F.when(weight > 0, drawn).otherwise(F.lit(float("inf"))).alias("score"), i.alias("place"))

    return F.array_min(F.transform(weights, score))["place"]


def _table(values) -> Column:
    """Nested tuples of numbers as nested arrays."""
    return F.array(*[_table(v) for v in values]) if isinstance(values, (tuple, list)) else F.lit(values)


def with_shard(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """Adds column `out`; each level is its own projection, so that a level is computed once. A null key
    is a key like any other."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    racks = [[float(sum(rack)) for rack in region] for region in tree.regions]
    shards = [[[float(w) for w in rack] for rack in region] for region in tree.regions]
    first, n = [], 0
    for region in tree.regions:
        first.append([])
        for rack in region:
            first[-1].append(n)
            n += len(rack)
    r, j = F.col("_region"), F.col("_rack")
    df = df.withColumn("_region", _draw(_table([sum(x) for x in racks]), F.lit("r"), k))
    df = df.withColumn("_rack", _draw(F.get(_table(racks), r), F.concat(F.lit("r"), r.cast("string"), F.lit(".")), k))
    own = _draw(F.get(F.get(_table(shards), r), j), F.concat(F.lit("r"), r.cast("string"), F.lit("."), j.cast("string"), F.lit(".")), k)
    return df.withColumn(out, (F.get(F.get(_table(first), r), j) + own).cast("int")).drop("_region", "_rack")


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard.

    Null text: size 16, text_crc32 0. Repeated doc_ids share a shard and get slots of their own. An
    empty table gives no rows; other columns are ignored. The law is `key`: only doc_id and the tree
    decide, so equal texts or one hot source don't gather in a shard. Slots go by the MD5 of the doc_id.
    """
    rows = pick(docs, key, text).toDF("doc_id", "_text")
    rows = rows.select("doc_id", (F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long") + 16).alias("size"), F.coalesce(F.crc32(F.encode("_text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"))
    rows = with_shard(rows, "doc_id", tree)
    rows = with_shard(rows, "doc_id", grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    n = docs.count()
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = slotted(rows, max(n // (tree.shards * PART_ROWS), 4 * spread // tree.shards) + 1)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def slotted(rows: DataFrame, parts: int) -> DataFrame:
    """Adds slot: 0, 1, ... in each shard, by (MD5 of doc_id, doc_id, text_crc32).

    A shard is numbered in `parts` ranges of the MD5, each shifted by the counts before it. Equal rows
    are counted first and written out at the end, so that many of them are one row until then.
    """
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    part = F.floor(F.conv(F.substring("name", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("name", name).withColumn("part", part)
    sums = once.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select("shard", "part", earlier(Window.partitionBy("shard").orderBy("part")).alias("before"))
    inner = Window.partitionBy("shard", "part").orderBy("name", "doc_id", "text_crc32")
    first = once.withColumn("inside", earlier(inner)).join(before, ["shard", "part"]).withColumn("first", F.col("before") + F.col("inside"))
    runs = first.withColumn("lo", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(PART_ROWS).cast("long"))))
    return runs.withColumn("slot", F.explode(F.sequence("lo", F.least(F.col("lo") + PART_ROWS, F.col("first") + F.col("n")) - 1)))


def sql_of(tree: Tree, grown: Tree) -> str:
    """shard_documents over the table documents, as DuckDB SQL."""
    def draw(names: list[str], weights: list[float]) -> str:
        score = "-ln((('0x' || substring(md5('{}|' || k), 1, 13))::bigint + 0.5::double) * pow(2.0::double, -52)) / {}::double"
        return "list_sort([" + ", ".join(f"{{'s': {score.format(n, w)}, 'p': {i}}}" for i, (n, w) in enumerate(zip(names, weights, strict=True)) if w > 0) + "])[1].p"

    def levels(t: Tree, source: str, out: str) -> str:
        regions = draw([f"r{i}" for i in range(len(t.regions))], [sum(map(sum, r)) for r in t.regions])
        racks = " ".join(f"when {i} then {draw([f'r{i}.{j}' for j in range(len(r))], list(map(sum, r)))}" for i, r in enumerate(t.regions))
        shards, first = "", 0
        for i, r in enumerate(t.regions):
            for j, w in enumerate(r):
                shards += f" when region = {i} and rack = {j} then {first} + {draw([f'r{i}.{j}.{k}' for k in range(len(w))], list(w))}"
                first += len(w)
        return f"(select * exclude (region, rack), (case{shards} end)::int as {out} from (select *, case region {racks} end as rack from (select *, {regions} as region from {source})))"

    bits = "list_reduce([c, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))"
    crc = "case when len(h) = 0 then 0 else xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::bigint)), lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) end"
    return (
        f"with crc as (select list({bits} order by c) as t from range(0, 256) r(c)), "
        "d as (select doc_id, coalesce(doc_id::varchar, '') as k, coalesce(hex(encode(text)), '') as h from documents), "
        f"f as (select doc_id, k, len(h) // 2 + 16 as size, ({crc})::bigint as text_crc32 from d, crc), "
        f"s as (select * from {levels(grown, levels(tree, 'f', 'shard'), 'grown_shard')}) "
        "select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by md5(k), doc_id nulls first, text_crc32) - 1 as slot, grown_shard from s"
    )
