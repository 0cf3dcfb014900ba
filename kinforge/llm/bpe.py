"""BPE encoding and decoding of whole texts by batched numpy merge rounds (see tokens.BatchedBpe)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import pick, slices
from .tokens import BatchedBpe, encoder


def encode_texts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; null text: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, BatchedBpe)
        for batch in batches:
            for part in slices(batch):
                ids, off = bpe.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each list of ids; ids without a token are left out, null is no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, BatchedBpe)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = pick(rows, doc_id, ids).toDF("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest_roundtrip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, in one pass without a shuffle.

    Null and empty texts have no tokens; both digests are then of nothing. Rows are taken one by one,
    so repeated doc_ids, ties and other columns change nothing.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer, BatchedBpe)
        token = pa.array([bpe.tokens.get(i, "") for i in range(max(bpe.tokens) + 1)], pa.large_string())
        for batch in batches:
            for part in slices(batch):
                ids, off = bpe.encode(part.column("text"))
                lists = pa.LargeListArray.from_arrays(pa.array(off), token.take(pa.array(ids)))
                decoded = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                ends, data = np.frombuffer(decoded.buffers()[1], np.int64)[: len(decoded) + 1], memoryview(decoded.buffers()[2] or b"")
                raw = memoryview(ids.astype("<u4").tobytes())
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(off)),
                        pa.array([sha(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string()),
                        pa.array([sha(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)
