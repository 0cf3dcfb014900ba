"""Quality rules: base rules on counts, then gradient-boosted trees over document statistics.

Trees are grown on histograms of a bounded sample of labelled documents, on the driver, and flattened
into node arrays; executors score a slice of documents with numpy, one level of all trees at a time.
Chosen features are monotonic: more symbols, bars, repeated words or repeated lines never raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, pick, slices
from .stats import CLASSES, TRAIN_ROWS, TextStats, labelled

#: Features, and the sign of their constraint (0: free).
FEATURES = {
    "log_words": 0, "mean_chars": 0, "symbols": -1, "pipes": -1, "digits": 0, "capitals": 0, "stops": 0, "marks": 0,
    "repeat_words": -1, "same_words": -1, "dup_lines": -1, "distinct": 0, "ended": 0,
}
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
KEEP_AT = 0.5


def counts(s: TextStats) -> dict[str, np.ndarray]:
    """The counts that the base rules and the result are made of."""
    return {
        "n_words": s.words.counts, "word_chars": s.per_text(s.chars), "n_symbols": s.of_class("symbols", s.words.offsets),
        "n_dup_lines": s.lines()["dup"], "n_repeat_words": s.per_text(s.repeated),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def features(s: TextStats, c: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text; rates are per word, character or line."""
    lines = s.lines()
    n, size, rows = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(lines["lines"], 1)
    of = {k: s.of_class(k, s.words.offsets) for k in CLASSES}
    cols = {
        "log_words": np.log1p(c["n_words"]), "mean_chars": size / n, "symbols": of["symbols"] / size, "pipes": of["pipes"] / n, "digits": of["digits"] / size,
        "capitals": of["capitals"] / size, "stops": of["stops"] / n, "marks": of["marks"] / n, "repeat_words": c["n_repeat_words"] / n,
        "same_words": s.per_text(s.same) / n, "dup_lines": lines["dup"] / rows, "distinct": s.distinct_words() / n, "ended": lines["ended"] / rows,
    }
    return np.stack([cols[k] for k in FEATURES], axis=1).astype(np.float64)


@dataclass
class Trees:
    """All trees in flat arrays. A leaf is its own child; value counts at leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: at most `depth` steps for all rows and trees together."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Boosts logistic loss. A split is refused where its leaves would break its feature's sign, and
    both sides keep to their side of the middle below it. Without both labels the score is constant."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    base, roots = float(np.log(share / (1 - share))), []
    if len(np.unique(y)) == 2:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        # Between a feature's constant value and the rest a quantile may not fall: cut in the middle too.
        cuts = [np.unique(np.concatenate((c, [(v.min() + v.max()) / 2]))) for c, v in zip(cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows], hess[rows]
            total_g, total_h = g.sum(), h.sum()
            value = float(np.clip(-total_g / (total_h + l2), low, high))
            me = len(nodes)
            nodes.append([0, 0.0, me, me, rate * value])
            best = (1e-6, None)
            if level < depth:
                for f, sign in enumerate(signs):
                    k = len(cuts[f]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, f], g, k))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h, k))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
                    gain[(hl * 4 < least) | (hr * 4 < least) | (sign * (wr - wl) < 0)] = 0
                    i = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[i] > best[0]:
                        best = (gain[i], f, i, wl[i], wr[i])
            if best[1] is None:
                margin[rows] += rate * value
                return me
            _, f, i, wl, wr = best
            goes = binned[rows, f] <= i
            middle, sign = (wl + wr) / 2, signs[f]
            bounds_l = (low, middle) if sign > 0 else (middle, high) if sign < 0 else (low, high)
            bounds_r = (middle, high) if sign > 0 else (low, middle) if sign < 0 else (low, high)
            left = grow(rows[goes], level + 1, *bounds_l)
            right = grow(rows[~goes], level + 1, *bounds_r)
            nodes[me] = [f, float(cuts[f][i]), left, right, 0.0]
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    a = np.array(nodes, np.float64).reshape(-1, 5)
    return Trees(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), base, depth)


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Trees from at most `most` labelled documents. Their statistics go to the driver, not their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = TextStats(part.column("text"))
                x = features(s, counts(s))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *[pa.array(c) for c in x.T]], ["doc_id", "quality", *FEATURES])

    got = labelled(docs, labels, most).mapInArrow(run, "doc_id long, quality int, " + ", ".join(f"{k} double" for k in FEATURES)).toArrow()
    order = np.argsort(np.asarray(got.column("doc_id")), kind="stable")
    x = np.stack([np.asarray(got.column(k)) for k in FEATURES], axis=1)[order] if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, np.asarray(got.column("quality"), dtype=np.float64)[order], list(FEATURES.values()))


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, model: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: counts, base_failed, kept, and the trees' score.

    Null and empty texts have no words and fail the base rules. Rows are judged one by one: repeated
    doc_ids each get a row, a null doc_id stays null, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = TextStats(part.column("text"))
                c = counts(s)
                failed, score = base_failed(c), model.score(features(s, c))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(v.astype(np.int64)) for v in c.values()], pa.array(failed), pa.array(~failed & (score >= keep_at)), pa.array(score)], ["doc_id", *c, "base_failed", "kept", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, RESULT)


def filter_documents(docs: DataFrame, model: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = TextStats(part.column("text"))
                c = counts(s)
                yield part.filter(pa.array(~base_failed(c) & (model.score(features(s, c)) >= keep_at)))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
