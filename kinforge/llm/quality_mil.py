"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage's statistics and its words, hashed into
BUCKETS signed sums, are encoded, h = tanh(E x + e);
gated attention, w . (tanh(V h) * sigmoid(U h)), gives each passage a weight by softmax over its
document; the weighted sum of encodings is scored by a logistic unit. All of it is learned together
from document labels with Adam, on the driver and from a bounded sample; executors score whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick, slices
from .stats import CLASSES, TRAIN_ROWS, TextStats, held_out, labelled, sums

PASSAGE = 48
HIDDEN, GATE, BUCKETS = 16, 8, 32
#: Passages of a labelled document that the model learns from at most, evenly spaced (scores take all).
BAG = 64
FEATURES = [*CLASSES, "chars", "repeated", "same", "distinct", "fill", "single", "empty", *[f"word{i}" for i in range(BUCKETS)]]
CUT = 0.7


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of every passage, and offsets of each text's passages. A text without words is one
    passage that says so."""
    s = TextStats(texts)
    off, n = s.words.offsets, s.words.counts
    count = np.maximum(-(-n // PASSAGE), 1)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(off[doc] + nth * PASSAGE, off[doc + 1])
    ends = np.append(start, off[-1])
    words = np.diff(ends)
    size, chars = np.maximum(words, 1), np.maximum(sums(s.chars, ends), 1)
    m = int(s.code.max()) + 1 if len(s.code) else 1
    of = np.repeat(np.arange(len(doc)), words)
    distinct = np.bincount(np.unique(of * m + s.code) // m, minlength=len(doc)) if len(of) else np.zeros(len(doc))
    cols = [s.of_class(k, ends) / (chars if k in ("symbols", "digits", "capitals", "others") else size) for k in CLASSES]
    cols += [chars / size, sums(s.repeated, ends) / size, sums(s.same, ends) / size, distinct / size, words / PASSAGE, (count == 1)[doc], words == 0]
    bucket, sign = (s.hash >> np.uint64(20)) % np.uint64(BUCKETS), np.where(s.hash & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(of * BUCKETS + bucket.astype(np.int64), sign, len(doc) * BUCKETS).reshape(-1, BUCKETS) / size[:, None]
    return np.concatenate([np.stack(cols, axis=1), hashed], axis=1), np.append(0, np.cumsum(count))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Parameters and both passes of the network."""

    def __init__(self, width: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.spread = np.zeros(width), np.ones(width)
        self.p = {
            "E": r.normal(0, width**-0.5, (width, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "w": r.normal(0, GATE**-0.5, GATE), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        p, n, head = self.p, np.diff(off), off[:-1]
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, head), n))
        a = a / np.repeat(np.add.reduceat(a, head), n)
        z = np.add.reduceat(a[:, None] * h, head, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["b"])}

    def score(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.forward(x, off)["y"] if len(off) > 1 else np.zeros(0)

    def gradients(self, f: dict[str, np.ndarray], off: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n, head = self.p, np.diff(off), off[:-1]
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, head), n))
        dt, ds = da[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), da[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ dy, "b": dy.sum(keepdims=True)}


def fit(x: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam over shuffled documents. Without both labels the score is the share of label 1, or 1."""
    m = Model(x.shape[1], seed)
    if len(y):
        m.mean, m.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    m.p["b"][:] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        m.p["c"][:] = 0
        return m
    r = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    step = 0
    n = np.diff(off)
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for lo in range(0, len(y), batch):
            own = order[lo : lo + batch]
            ends = np.append(0, np.cumsum(n[own]))
            take = np.repeat(off[own] - ends[:-1], n[own]) + np.arange(ends[-1])
            g = m.gradients(m.forward(x[take], ends), ends, y[own])
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, v in m.p.items():
                d = g[k] + decay * v
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                v -= now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model from at most `most` labelled documents and BAG passages of each; their statistics go to
    the driver, in half precision (two bytes a number: some 70 MB if every bag is full)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, off = passages(part.column("text"))
                data = [x[np.linspace(a, b - 1, min(b - a, BAG)).astype(np.int64)].astype("<f2").tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(data, pa.binary())], ["doc_id", "quality", "x"])

    got = labelled(docs, labels, most).mapInArrow(run, "doc_id long, quality int, x binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b, "<f2").reshape(-1, len(FEATURES)) for b in got.column("x").to_pylist()]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, len(FEATURES)))
    return fit(x, np.append(0, np.cumsum([len(b) for b in bags])).astype(np.int64), np.asarray(got.column("quality"), dtype=np.float64))


def score_documents(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= cut).

    Null and empty texts are one empty passage and get that passage's score. Only the text is an input;
    repeated doc_ids each get a row, a null doc_id isn't held out, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.score(*passages(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("score"), "predicted")


def filter_documents(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The documents that are predicted as label 1, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(*passages(part.column("text"))) >= cut))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
