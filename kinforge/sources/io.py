"""Readers and writers: all-string TSV, raw lines, list files, key-routed split and checked merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = SOURCE, columns: list[str] | None = None) -> DataFrame:
    """Every field a string; a missing one is '', and `NA` or `null` stay text. Quotes as in CSV."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return (df.select(*columns) if columns else df).na.fill("")


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """First column of a raw text file, without header and blank lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = F.trim(F.split_part("value", F.lit("\t"), F.lit(1)))
    return lines.select(first.alias("id")).where(~F.lower("id").isin("entity_id", "source1_entity_id"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a list file as raw lines, header apart from them by its text."""
    return spark.read.text(path).where(F.trim("value") != "").where(~F.startswith(F.lower("value"), F.lit("source1_entity_id"))).select(F.col("value").alias("line"))


def subdirectory(spark: SparkSession, root: str, name: str) -> str | None:
    """The folder below root with this name in any case; through Hadoop, so any store works."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().lower() == name.lower())
    return f"{root}/{found[0]}" if found else None


def write_lists(lists: DataFrame, path: str, column: str = "matched_entity_ids", mode: str = "errorifexists") -> None:
    """List file: a header, then one row for every entity, ids joined by commas, in the order of column
    pos if there is one, else of the entity's id. Every part file has the header. An existing file is
    never overwritten unless mode says so."""
    order = "pos" if "pos" in lists.columns else "s1_id"
    rows = lists.orderBy(order).select(F.col("s1_id").alias("source1_entity_id"), F.array_join("matched", ",").alias(column))
    rows.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("escapeQuotes", False).option("emptyValue", "").option("nullValue", "").csv(path)


def read_header(spark: SparkSession, path: str) -> str | None:
    """The first line of a file or of the first part of a folder."""
    line = spark.read.text(path).limit(1).collect()
    return line[0]["value"] if line else None


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def list_pairs(lines: DataFrame) -> DataFrame:
    """(s1_id, s23_id) of the lines of a list file."""
    p = F.split("line", "\t", 2)
    ids = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select(F.element_at(p, 1).alias("s1_id"), F.explode(ids).alias("s23_id"))


def split_by_country(records: DataFrame, countries: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose country is among `countries`, and all others."""
    hit = F.coalesce(F.lower(F.trim("country")).isin([c.lower() for c in countries]), F.lit(False))
    return records.where(~hit), records.where(hit)


def merge_parts(order: DataFrame, parts: list[DataFrame], key: str = "s1_id") -> DataFrame:
    """Parts in the order of `order` (key, pos). ValueError if headers differ, a key repeats or is missing."""
    if len({tuple(p.columns) for p in parts}) != 1:
        raise ValueError("the parts have different headers")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    twice = rows.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated: {[r[key] for r in twice]}")
    gone = order.join(rows, key, "left_anti").limit(5).collect()
    if gone:
        raise ValueError(f"missing: {[r[key] for r in gone]}")
    return rows.join(order, key).orderBy("pos").drop("pos")
