"""Shared helpers of the training-data operators: shared storage, word splitting, gapless numbering.

Nothing here collects rows; what is returned to the driver is one row per file or per group of a
stated, bounded number.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a batch with more is cut between rows.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and Python; Spark's own default (64 MB) holds one on both sides
#: of every running task.
BATCH_BYTES, BATCH_KEY, BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or where that is unset and
    Spark runs in this process alone (as in tests) a folder of our own, which is then also set as the
    checkpoint folder. On a cluster the setting is required."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="kinforge-")
        spark.conf.set("spark.checkpoint.dir", conf)
        atexit.register(_remove, spark, conf)
    return conf.rstrip("/")


def _remove(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    uri = f"{shared_dir(spark)}/kinforge-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, uri)
    return uri


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it: cuts the lineage and survives lost
    executors (no localCheckpoint)."""
    spark = df.sparkSession
    uri = fresh_dir(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def discard(df: DataFrame) -> None:
    """Removes the table that materialize() wrote for df, once nothing reads it any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "kinforge-" in f:
            _remove(df.sparkSession, f)


def bounded_batches(docs: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of their session are made small, unless it has a setting of its own."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return docs


def trim() -> None:
    """Gives free memory of this process back: workers are used again and would keep what a large pass took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names never meet our own."""
    return bounded_batches(docs).select(*[F.col(f"`{c}`") for c in columns])


def gapless(df: DataFrame, groups: list[str], order: list[str], n_sub: int, out: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, never putting a group into one task.

    df must be a written table (each reading gives it the same partitions). A group is dealt into n_sub
    parts by a hash of `order` and of the partition a row stands in, so that equal rows are spread too;
    parts are numbered by themselves and then shifted by the counts of the parts before them. Only
    (groups x n_sub) counts are summed up. Null group keys form one group. Ties are numbered in any order.
    """
    sub = F.pmod(F.xxhash64(*order, F.spark_partition_id()), F.lit(max(1, n_sub))).cast("int")
    keys = [F.coalesce(F.col(g).cast("long"), F.lit(-1)).alias(f"_g{i}") for i, g in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))]
    df = df.select("*", *keys, sub.alias("_sub"))
    counts = df.groupBy(*names, "_sub").count()
    w = Window.partitionBy(*names).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*names, "_sub", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*names, "_sub").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inner).cast("long") - 1)
    return numbered.join(before, [*names, "_sub"]).withColumn(out, F.col("_rn") + F.col("_before")).drop(*names, "_sub", "_rn", "_before")


def first_of_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of each doc_id in `ids` (column id, distinct), the first by a hash of its text, and all rows
    without doc_id; all columns as they are. Rows travel as one struct, so their columns can't clash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.join(ids, F.col("row.doc_id") == F.col("id"), "left_semi")
    one = Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row.text"), "row.text")
    kept = named.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row")
    return kept.union(rows.where("row.doc_id is null")).select("row.*")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Row slices of the batch that hold about `most` bytes of text each (a longer text comes alone)."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    block = (np.cumsum(size) - 1) // most
    cuts = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True):
        yield batch.slice(lo, hi - lo)
    trim()


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of many texts. flat: all words; offsets: of each text's words in flat."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat, off = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        off = off - off[0]
        full = np.asarray(pc.binary_length(flat), dtype=np.int64) > 0
        before = np.concatenate(([0], np.cumsum(full)))
        self.flat = flat if full.all() else flat.filter(pa.array(full))
        self.offsets = before[off]

    def __len__(self) -> int:
        return len(self.flat)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def coded(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words and each word's place among them."""
        d = self.flat.dictionary_encode()
        return d.dictionary, np.asarray(d.indices, dtype=np.int64)

    def of_text(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)
