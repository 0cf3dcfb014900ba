"""Embedding near-dedup with a pivot-permutation index.

Pivots are vectors of a bounded sample, no two of them close to each other. A vector is described by
the ordered list of its nearest pivots and filed in the inverted list of each. Two vectors of one list
that share at least `shared` pivots are candidates; each is verified by its cosine in double precision.
With n vectors there are about 4 root(n) pivots, so that work grows with n root(n), up to MOST pivots.
A pair is looked at in the list of the first pivot it shares only. Lists are compared in blocks of
`block` vectors, so no list is ever gathered in one task; a block pair returns counts of links and a
spanning forest of them, not the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick
from .components import components

#: Pivots grow with the square root of the vectors, so that inverted lists do too and no list holds a
#: fixed share of them: ROOT x root, between LEAST and MOST. They come from SAMPLE vectors a pivot (a
#: bounded number), no two with a cosine above APART where there are others.
ROOT, LEAST, MOST, SAMPLE, APART = 4, 64, 16_384, 8, 0.7
#: Pivots that describe a vector, pivots a candidate pair must share, vectors of a block.
DEPTH, SHARED, BLOCK = 10, 2, 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; very large and very small components do no harm."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, their components as they are) of a column of lists without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = np.asarray(pc.list_value_length(column), dtype=np.int64)
    first = np.cumsum(n) - n
    for width in np.unique(n).tolist():
        rows = np.flatnonzero(n == width)
        yield width, rows, flat[first[rows][:, None] + np.arange(width)]


def numbers_of_pivots(vectors: dict[int, int]) -> dict[int, int]:
    """How many pivots each width gets, by its number of vectors; MOST in all, but one at least."""
    want = {w: max(LEAST, ROOT * math.isqrt(n)) for w, n in vectors.items()}
    total = sum(want.values())
    return {w: min(vectors[w], max(1, k * MOST // max(total, MOST))) for w, k in want.items()}


def pivots_of(found: DataFrame, vectors: dict[int, int], apart: float = APART) -> dict[int, np.ndarray]:
    """Pivots of each width from a sample by a hash of the ids."""
    want = numbers_of_pivots(vectors)
    share = [(w, min(1.0, SAMPLE * k / vectors[w])) for w, k in want.items()]
    kept = F.create_map(*[F.lit(x) for pair in share for x in pair])[F.size("embedding")]
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 20)) < kept * (1 << 20)
    rows = found.where(drawn).select(F.xxhash64("vec_id", F.lit(23)).alias("h"), "vec_id", "embedding").toArrow().combine_chunks()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("h", "ascending"), ("vec_id", "ascending")]))
    out = {}
    for width, _, raw in by_width(pa.concat_arrays(rows.column("embedding").chunks)) if rows.num_rows else ():
        x, chosen = unit(raw), []
        near = np.full(len(x), -1.0)
        for limit in (apart, 2.0):  # where too few stand apart, the others make up the number
            for i in range(len(x)):
                if len(chosen) < want[width] and near[i] < limit:
                    chosen.append(i)
                    near = np.maximum(near, x @ x[i])
                    near[i] = 3.0
        out[width] = x[sorted(chosen)]
    return out


def described(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first; ties go to the first pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.int32)


def first_shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of descriptions: how many pivots are shared, and the smallest of them."""
    same = a[:, :, None] == b[:, None, :]
    return same.any(axis=2).sum(axis=1), np.where(same.any(axis=2), a, np.iinfo(np.int32).max).min(axis=1)


class Forest:
    """Links of a block pair, reduced to a spanning forest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Places of the links that joined two trees."""
        kept = []
        # Each vector's first link first: after those, most others lie inside a tree.
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append(k)
        return kept


def block_links(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, perm: np.ndarray, cut: int, pivot: int, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between rows before and from `cut` (among all rows, if cut is 0) whose first shared pivot is
    this list's: for each row the rows linked, copies included, and links (a, b) of a spanning forest."""
    known, local = np.unique(perm, return_inverse=True)
    marks = np.zeros((len(ids), len(known)), np.float32)
    np.put_along_axis(marks, local.reshape(perm.shape), 1, axis=1)
    left, right = (slice(0, cut), slice(cut, None)) if cut else (slice(None), slice(None))
    i, j = np.nonzero(marks[left] @ marks[right].T >= shared)
    if cut:
        j = j + cut
    else:
        up = i < j
        i, j = i[up], j[up]
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 100_000):
        s = slice(lo, lo + 100_000)
        own = np.flatnonzero(np.einsum("ij,ij->i", x[i[s]], x[j[s]]) >= threshold)
        _, least = first_shared(perm[i[s][own]], perm[j[s][own]])
        keep[lo + own[least == pivot]] = True
    i, j = i[keep], j[keep]
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    kept = Forest(len(ids)).join(i, j)
    return n, ids[i[kept]], ids[j[kept]]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, depth: int = DEPTH, shared: int = SHARED, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors
    of any width are compared, with those of their own width. Vectors with equal components link (n_links
    counts each), but only one of them is indexed. Vectors that share a vec_id are told apart by their
    components; n_links and component_id are then those of all rows of that id. A null vec_id can't be
    named: such rows take no part and are kept. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id, embedding).toDF("vec_id", "embedding")
    if rows.schema["embedding"].dataType.elementType.simpleString() != "float":
        rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = (F.col("embedding").isNotNull()) & (F.size("embedding") > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    valid = rows.where(sound & F.col("vec_id").isNotNull())
    # Equal vectors are one: the class of its components, named by its smallest id.
    classes = materialize(valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")), "vectors")
    members = materialize(valid.join(classes, "embedding").select("vec_id", "least", "copies"), "members")
    found = classes.select(F.col("least").alias("vec_id"), "embedding")
    sizes = found.groupBy(F.size("embedding").alias("w")).count().where(F.col("count") > 1).collect()  # one row per width
    pivots = pivots_of(found, {r["w"]: r["count"] for r in sizes}) if sizes else {}
    if pivots:
        links, counts = _indexed(classes, pivots, depth, shared, block, threshold)
        named = components(links)
    else:
        counts, named = spark.createDataFrame([], "least long, linked long"), spark.createDataFrame([], "node long, component long")
    per_class = members.select("least", "copies").distinct().join(counts, "least", "left").join(named, F.col("least") == F.col("node"), "left")
    per_class = materialize(per_class.select("least", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id")), "classes")
    per_id = members.join(per_class, "least").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(per_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _indexed(classes: DataFrame, pivots: dict[int, np.ndarray], depth: int, shared: int, block: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of a spanning forest, and (least, linked): numbers of linked vectors, copies included.
    Widths have pivots, and so lists, of their own; fewer pivots than `depth` describe with all of them."""
    base, at = {}, 0
    for width, p in pivots.items():
        base[width], at = at, at + len(p)
    kind = np.dtype("<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, rows, raw in by_width(b.column("embedding")):
                if width not in pivots:
                    continue
                for lo in range(0, len(rows), 4096):
                    own, part = pa.array(rows[lo : lo + 4096]), raw[lo : lo + 4096].astype(kind)
                    perm = base[width] + described(unit(part), pivots[width], depth)
                    data, size = part.tobytes(), kind.itemsize * width
                    yield pa.RecordBatch.from_arrays([b.column("least").take(own), b.column("copies").take(own), pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary()), pa.array(perm.tolist(), pa.list_(pa.int32()))], ["id", "copies", "x", "perm"])

    flat = materialize(classes.mapInArrow(describe, "id long, copies long, x binary, perm array<int>"), "descriptions")
    listed = flat.select("id", "copies", "x", "perm", F.explode("perm").alias("pivot"))
    sizes = listed.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))  # one row per pivot: bounded
    dealt = listed.join(F.broadcast(sizes), "pivot").withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")).cast("int"))
    # A block meets itself and every other block of its list: pairs (lo, hi).
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("lo"), F.greatest(k, F.col("own")).alias("hi"))))
    pairs = dealt.select("id", "copies", "x", "perm", "pivot", "own", meets.alias("m")).select("id", "copies", "x", "perm", "pivot", "own", F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"))
    nothing = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}

    def verify(key: tuple, t: pa.Table) -> pa.Table:
        pivot, lo, hi = (k.as_py() for k in key)
        own = np.asarray(t.column("own"))
        cut = 0 if lo == hi else int((own == lo).sum())
        if len(own) < 2 or lo != hi and cut in (0, len(own)):
            return pa.table(nothing)
        t = t.take(pa.array(np.argsort(own != lo, kind="stable")))
        ids, copies = np.asarray(t.column("id")), np.asarray(t.column("copies"))
        x = unit(np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(len(ids), -1))
        perm = np.asarray(pc.list_flatten(t.column("perm")), dtype=np.int32).reshape(len(ids), -1)
        n, a, b = block_links(ids, copies, x, perm, cut, pivot, threshold, min(shared, perm.shape[1]))
        at = np.flatnonzero(n)
        cols = {
            "a": pa.concat_arrays([pa.array(a, pa.int64()), pa.array(ids[at], pa.int64())]),
            "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(at), pa.int64())]),
            "n": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(n[at], pa.int64())]),
        }
        return pa.table(cols)

    found = materialize(pairs.groupBy("pivot", "lo", "hi").applyInArrow(verify, "a long, b long, n long"), "found")
    links = found.where("b is not null").select("a", "b")
    counts = found.where("n is not null").groupBy(F.col("a").alias("least")).agg(F.sum("n").alias("linked"))
    return links, counts
