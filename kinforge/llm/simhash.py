"""SimHash fingerprints of word shingles, and near copies by multi-index hashing.

A fingerprint's 64 bits are cut into two segments. If two fingerprints differ in at most two bits, one
segment differs in at most one: every fingerprint looks for values of the small Hamming ball around each
of its segments in the tables of segments, and what it fetches is verified on all 64 bits. Of two
segments that differ in one bit, one has it unset: so each looks only for its own value and for those
with one more bit set, half of the ball, and every pair is still found from one of its sides.
Only distinct fingerprints take part, so exact copies cost one row however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, first_of_each, materialize, pick, slices
from .components import components

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP, PASS_BYTES = 1 << 16, 4 << 20
#: A segment value with more distinct fingerprints is searched by whole Hamming balls instead.
CROWDED = 2_000


def hashed_shingles(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts' numbers, XXH64 with seed 42 of their shingles), in text order, STEP shingles at a time."""
    words = Words(texts)
    n_docs = len(words.offsets) - 1
    if not len(words):
        return
    off, counts = words.offsets, words.counts
    lists = pa.LargeListArray.from_arrays(pa.array(off), words.flat.cast(pa.large_string()))
    joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    doc_at = np.frombuffer(joined.buffers()[1], np.int64)[: n_docs + 1]
    data = LOWER[np.frombuffer(joined.buffers()[2], np.uint8)].tobytes()
    size = np.asarray(pc.binary_length(words.flat), dtype=np.int64)
    doc = words.of_text()
    before = np.cumsum(size) - size
    start = doc_at[doc] + before - before[np.minimum(off[:-1], len(size) - 1)][doc] + np.arange(len(size)) - off[doc]
    end = start + size
    # Shingle i of a text covers words i to i + width - 1; a shorter text is one shingle.
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    which = np.repeat(np.arange(n_docs), shingles)
    first = off[which] + np.arange(len(which)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + width, off[which + 1]) - 1
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(which), STEP):
        a, b = start[first[lo : lo + STEP]].tolist(), end[last[lo : lo + STEP]].tolist()
        yield which[lo : lo + STEP], np.fromiter((digest(data[x:y], 42) for x, y in zip(a, b, strict=True)), np.uint64, len(a))


def fingerprints(texts: pa.Array, width: int = 3) -> np.ndarray:
    """uint64 fingerprints. A bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    return _majority(len(texts), hashed_shingles(texts, width))


def _majority(n_docs: int, hashed) -> np.ndarray:
    sums, shingles = np.zeros((n_docs, 64), np.int64), np.zeros(n_docs, np.int64)
    for own, h in hashed:
        shingles += np.bincount(own, minlength=n_docs)
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    set_ = (2 * sums > shingles[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_table(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long). Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=PASS_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text"), width).view(np.int64))], ["doc_id", "fp"])

    return pick(docs, doc_id, text).toDF("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _ball(value, bits: int):
    """The value and all values that differ from it in one of the lowest bits."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def _upper_ball(value, bits: int):
    """The value and all values that have one more of the lowest bits set."""
    return F.array_distinct(F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))


def close_pairs(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b) of distinct fingerprints in column fp that differ in one or two bits, each way round or both.

    A value of a segment that more than `crowded` fingerprints share isn't looked up in the segment
    table, where each would fetch all others; the fingerprints that hold it enumerate all 2080 values
    within two bits and fetch equals, which takes as many steps as they are.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    table = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("value")), F.struct(F.lit(1).alias("seg"), low.alias("value")))).alias("s")).select("fp", "s.seg", "s.value")
    counts = materialize(table.groupBy("seg", "value").count().where(F.col("count") > crowded).select("seg", "value"), "crowded")
    probe = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("own")), F.struct(F.lit(1).alias("seg"), low.alias("own")))).alias("s"))
    probe = probe.select(F.col("fp").alias("a"), "s.seg", F.explode(_upper_ball(F.col("s.own"), 32)).alias("value"))
    hot = not counts.isEmpty()
    index = table.join(counts, ["seg", "value"], "left_anti") if hot else table
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # The planner takes exploded rows for as few as their source has and would broadcast the balls.
    pairs = probe.join(index.withColumnRenamed("fp", "b").hint("merge"), ["seg", "value"]).where((F.col("a") != F.col("b")) & (near <= 2)).select("a", "b")
    if hot:
        held = table.join(counts, ["seg", "value"], "left_semi").select("fp").distinct()
        one = held.select("fp", F.explode(_ball64(F.col("fp"))).alias("x"))
        two = one.select(F.col("fp").alias("a"), F.explode(_ball64(F.col("x"))).alias("b")).where("a <> b").distinct()
        pairs = pairs.union(two.join(fps.select(F.col("fp").alias("b")).hint("merge"), "b").select("a", "b"))
    return pairs


def _ball64(value):
    return _ball(value, 64)


def near_copies(docs: DataFrame, width: int = 3, crowded: int = CROWDED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id reachable.
    Null, empty and blank texts have fingerprint zero and link like any other. Repeated doc_ids each
    get a row; a null doc_id is no component's name unless nothing else is there. Other columns are ignored.
    """
    table = materialize(fingerprint_table(docs, width), "fingerprints")
    groups = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    pairs = close_pairs(groups.select("fp"), crowded)
    a, b = (groups.select(F.col("fp").alias(c), F.col("least").alias(f"l{c}")) for c in "ab")
    links = pairs.where("a < b").union(pairs.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = components(links.join(a, "a").join(b, "b"), "la", "lb")
    named = groups.join(labels, groups["least"] == labels["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    named = materialize(named, "named")
    out = table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    discard(groups)
    return out


def keep_first(docs: DataFrame, width: int = 3) -> DataFrame:
    """The documents with the smallest doc_id of each group of near copies, with all their columns; of
    rows that share that doc_id one stays. Rows without doc_id all stay: no group can be named by them.
    Texts are shuffled once, by doc_id."""
    named = near_copies(docs, width)
    first = named.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    return first_of_each(docs, first)
