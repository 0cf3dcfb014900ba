"""Token ids as length-delimited binary records with masked checksums, and an offset index beside them.

A record: its payload's length (uint64), the length's checksum, the payload, the payload's checksum;
all little-endian. A payload: doc_id (int64), number of ids (uint32), bytes an id (uint32; plus NO_ID
where the doc_id is null, which is then written as 0), the ids.
A checksum is CRC-32, rotated right by 15 bits plus a constant, so that data which hold checksums of
their own are still told apart. The index (`.idx`) has for each record doc_id, offset and length of
its frame: a reader in shuffled order opens the index, permutes it and seeks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, pick, slices
from .tokens import encoder

MASK = 0xA282EAD8
HEAD, PAYLOAD = struct.Struct("<QI"), struct.Struct("<qII")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8")])
MAGIC, NO_ID = b"KFIDX001", 1 << 31
#: Records of a batch that is read back.
READ_ROWS = 20_000


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; ValueError if a length or checksum is wrong."""
    if len(data) < 16:
        raise ValueError("a record is cut off")
    size, check = HEAD.unpack_from(data)
    if masked(data[:8]) != check or len(data) != size + 16:
        raise ValueError("a record's length is damaged")
    payload = data[12:-4]
    if masked(payload) != int.from_bytes(data[-4:], "little"):
        raise ValueError("a record's payload is damaged")
    return payload


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return PAYLOAD.pack(doc_id or 0, len(ids), width | NO_ID * (doc_id is None)) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, width = PAYLOAD.unpack_from(payload)
    return None if width & NO_ID else doc_id, np.frombuffer(payload, "<u2" if width & 7 == 2 else "<u4", n, PAYLOAD.size).astype("<u4")


def open_store(uri: str):
    """The file system of a URI and the path in it, on driver or executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri[5:])


MANIFEST = "path string, docs long, ids long"


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text") -> list:
    """Encodes whole texts and writes record files in ascending doc_id order; returns the manifest, one
    row per file in that order (as many as shuffle partitions).

    Texts are dealt by ranges of doc_id and encoded where they are written. A file is written under
    its attempt's name and renamed when whole, so a task that runs again only overwrites its own file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx = encoder(tokenizer), TaskContext.get()
        fs, top = open_store(out)
        fs.create_dir(top, recursive=True)
        name = f"{top}/records-{ctx.partitionId():06d}"
        temp = f"{name}.{ctx.taskAttemptId()}"
        index, at, total, sink = [], 0, 0, None
        for batch in batches:
            for part in slices(batch):
                keys = part.column("doc_id").to_pylist()
                ids, off = enc.encode(part.column("text"))
                sink = sink or fs.open_output_stream(temp)
                out_bytes = []
                for i, key in enumerate(keys):
                    own = ids[off[i] : off[i + 1]]
                    own = own if end_id is None else np.append(own, np.uint32(end_id))
                    out_bytes.append(frame(pack(key, own)))
                    total += len(own)
                entry = np.zeros(len(keys), INDEX)
                entry["doc_id"], entry["length"] = [k or 0 for k in keys], list(map(len, out_bytes))
                entry["offset"] = at + np.cumsum(entry["length"]) - entry["length"]
                at += int(entry["length"].sum())
                index.append(entry)
                sink.write(b"".join(out_bytes))
        if sink:
            sink.close()
            index = np.concatenate(index)
            with fs.open_output_stream(f"{temp}.idx") as f:
                f.write(MAGIC + index.tobytes())
            fs.move(temp, f"{name}.rec")
            fs.move(f"{temp}.idx", f"{name}.idx")
            yield pa.RecordBatch.from_pydict({"path": [name], "docs": [len(index)], "ids": [total]})

    # Ranges go on below the doc_id, down to the place in the input, so that rows of one id (or without
    # any: they come first) are not all written by one task.
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.coalesce(F.octet_length("text"), F.lit(0)).asc(), F.xxhash64("text").asc(), F.col("_row").asc()]
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    return sorted(rows.mapInArrow(write, MANIFEST).collect(), key=lambda r: r["path"])


def read_index(fs, path: str) -> np.ndarray:
    with fs.open_input_stream(f"{path}.idx") as f:
        data = f.read()
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an index")
    return np.frombuffer(data, INDEX, offset=len(MAGIC))


def iterate(uri: str, path: str, order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a file's records: in file order in large reads, or in the given order by seeks."""
    fs, _ = open_store(uri)
    index = read_index(fs, path)
    if order is not None:
        with fs.open_input_file(f"{path}.rec") as f:
            for at, size in zip(index["offset"][order].tolist(), index["length"][order].tolist(), strict=True):
                yield unpack(unframe(f.read_at(size, at)))
        return
    with fs.open_input_stream(f"{path}.rec", buffer_size=4 << 20) as f:
        for size in index["length"].tolist():
            yield unpack(unframe(f.read(size)))


def read_records(spark, manifest: list, uri: str, starts: bool = True) -> DataFrame:
    """One row per record, read back from the files: doc_id, start (ids of all records before it),
    n_tokens, ids_crc32. Starts come from the manifest's sums, so files are read independently."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    before, rows = 0, []
    for m in manifest:
        rows.append((m["path"], before))
        before += m["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                got = []
                for key, ids in iterate(uri, path):
                    got.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(got) == READ_ROWS:
                        yield table(got)
                        got = []
                if got:
                    yield table(got)

    def table(got: list) -> pa.RecordBatch:
        cols = list(zip(*got, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "path string, start long").repartition(len(rows))
    return files.mapInArrow(read, schema)


def tokens_roundtrip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes all documents as records and returns what the files hold, one row per document.

    Null and empty texts are the end id alone. Repeated doc_ids follow one another, shorter texts
    first. Rows without doc_id come first, and stay without. An empty table gives no rows.
    """
    spark = docs.sparkSession
    out = fresh_dir(spark, "records")
    return read_records(spark, write_records(docs, out, tokenizer, end_id), out)
