"""Statistics of whole texts and of their words, vectorised over a slice of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, pick
from .substring import grams, mix, window_starts

#: Words of a window that counts as repeated.
REPEAT_WINDOW = 8
#: Words whose windows are hashed at a time.
PIECE = 1 << 20


def byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars.encode())] = 1
    return out


CLASSES = {
    "symbols": byte_class("#*$%&|<>"),
    "pipes": byte_class("|"),
    "digits": byte_class("0123456789"),
    "capitals": byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "stops": byte_class(".!?"),
    "marks": byte_class(",;:()\"'-"),
    "others": (np.arange(256) >= 128).astype(np.uint8),
}


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same for small numbers, without running sums of all of them."""
    out, full = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values[: offsets[-1]], offsets[full], dtype=np.int64)
    return out


class TextStats:
    """Counts of each word of the texts, and which words lie in a window that its text repeats.

    Memory is some 40 bytes a word, so that a text of many million words can be taken whole."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        self.texts, self.words = texts, Words(texts)
        w = self.words
        flat = w.flat if len(w) == 0 else pa.concat_arrays([w.flat])
        self.chars = np.asarray(pc.utf8_length(flat))
        self.ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        self.data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) else np.zeros(0, np.uint8)
        distinct, self.code = w.coded()
        digest = xxhash.xxh64_intdigest
        self.hash = np.fromiter((digest(x) for x in distinct.to_numpy(zero_copy_only=False)), np.uint64, len(distinct))[self.code] if len(w) else np.zeros(0, np.uint64)
        self.doc = w.of_text()
        self.repeated = self._repeated()
        same = np.zeros(len(w), bool)
        same[1:] = (self.code[1:] == self.code[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.same = same

    def _repeated(self) -> np.ndarray:
        """Words in windows of REPEAT_WINDOW words that their text holds twice or more."""
        w, n = self.words, len(self.words)
        at = window_starts(w.offsets, REPEAT_WINDOW)
        out = np.zeros(n + 1, np.int32)
        if not len(at):
            return out[:-1] > 0
        key = np.zeros(n, np.uint64)
        for lo in range(0, n, PIECE):  # window hashes don't depend on where they were begun
            (g,) = grams(self.hash[lo : lo + PIECE + REPEAT_WINDOW - 1], [REPEAT_WINDOW])
            key[lo : lo + len(g)] = g
        key = key[at] if len(w.offsets) == 2 else mix(key[at] + mix(self.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        key = key[order]
        twice = np.zeros(len(key), bool)
        twice[1:] = key[1:] == key[:-1]
        del key
        twice[:-1] |= twice[1:]
        hit = at[order[twice]]
        del order
        out[:n] += np.bincount(hit, minlength=n).astype(np.int32)
        np.subtract.at(out, hit + REPEAT_WINDOW, 1)
        return np.cumsum(out[:-1]) > 0

    def of_class(self, name: str, offsets: np.ndarray) -> np.ndarray:
        """Characters of a class in the words between consecutive offsets."""
        return segment_sums(CLASSES[name][self.data], self.ends[offsets])

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return sums(values, self.words.offsets)

    def distinct_words(self) -> np.ndarray:
        """Number of distinct words of each text."""
        n = int(self.code.max()) + 1 if len(self.code) else 1
        pairs = np.unique(self.doc * n + self.code)
        return np.bincount(pairs // n, minlength=len(self.words.counts))

    def lines(self) -> dict[str, np.ndarray]:
        """Of each text: lines with a word, those equal to an earlier one, those that end a sentence."""
        lists = pc.split_pattern(self.texts, "\n")
        flat, off = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        off = off - off[0]
        trimmed = pc.ascii_trim_whitespace(flat)
        full = np.asarray(pc.binary_length(trimmed), dtype=np.int64) > 0
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[full]
        d = flat.filter(pa.array(full)).dictionary_encode()
        n = max(len(d.dictionary), 1)
        distinct = np.unique(doc * n + np.asarray(d.indices, dtype=np.int64))
        total = np.bincount(doc, minlength=len(off) - 1)
        ended = np.asarray(pc.match_substring_regex(trimmed.filter(pa.array(full)), r"[.!?]$"), dtype=bool)
        return {"lines": total, "dup": total - np.bincount(distinct // n, minlength=len(off) - 1), "ended": np.bincount(doc[ended], minlength=len(off) - 1)}


#: Labelled rows a model learns from at most, chosen by a hash of their ids; labels are read only from
#: rows whose crc32 of the doc_id's text modulo 4 isn't HELD_OUT.
TRAIN_ROWS, HELD_OUT = 12_000, 2


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, quality) of a bounded sample of labelled documents that aren't held out; of a
    doc_id with several labels the lowest counts. Rows without a label or doc_id are left out."""
    rows = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    chosen = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)
    return pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
