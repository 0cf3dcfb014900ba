"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is everything that starts earlier. It is indexed in blocks: a block holds
all stretches of the corpus whose 20-word windows have one of the block's anchors (a window's anchor is
the least hash of its 5-word grams), word for word. Two equal windows have the same anchor, so a
document only meets the blocks of its own anchors and misses no match.

A stretch is parsed greedily: its first window that an earlier place of the block holds too (looked up
by hash, then held against the words) begins a factor, which is extended word by word as long as the
source goes on with the same words; the next factor is looked for behind it. So the windows that
straddle two factors are looked up themselves, and as windows that straddle two stretches belong to the
one or the other, nothing is lost at boundaries: the factors cover exactly the windows that also start
earlier. A factor of 20 words or more is a duplicate span. Equality is always that of words.

A slice of documents is a first block of its own, and sends each distinct window on once, so a passage
that a third of all documents share costs its block a row per slice and not per document. Blocks are
read one after another in the order of their keys: memory holds one, however many a task has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Words, bounded_batches, slices, trim

WINDOW, GRAM = 20, 5
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
DOC = np.dtype([("doc", "<i8"), ("tie", "<i8")])
RUN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("n", "<u4")])
FACTOR = np.dtype([("start", "<u4"), ("n", "<u4"), ("src_doc", "<i8"), ("src_start", "<u4")])
#: Input bytes for one block, and blocks that a task reads on average (their number grows with the input;
#: that of tasks only up to MOST_TASKS, then each reads more blocks).
BLOCK_BYTES, TASK_BLOCKS, MOST_TASKS = 1536 << 10, 2, 100_000
#: Bytes of text in a slice: at twice as many a worker of `emit` takes some 60 MB more, and there are as
#: many at once as an executor has cores.
SLICE_BYTES = 2 << 20
#: zstd levels of stretches and of texts that wait for their factors.
LEVEL, TEXT_LEVEL = 6, 3
#: Words compared at once when factors are extended, and pairs of words in all.
STEP, PAIRS = 16, 1 << 20
SPACE, WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")
#: Rows without doc_id come after all others, so that they shadow none that has one.
NO_ID = 2**63 - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def grams(h: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Hashes of all runs of so many words: polynomials over 64-bit word hashes, from running sums."""
    n = len(h)
    total, up = np.full(n + 1, BASE_INVERSE), np.full(n + 1, BASE)
    total[0] = up[0] = 1
    np.multiply.accumulate(total, out=total)
    total[1:] = h * total[:n]
    total[0] = 0
    np.add.accumulate(total, out=total)
    np.multiply.accumulate(up, out=up)
    return [mix((total[k:] - total[:-k]) * up[: n - k + 1]) if n >= k else np.zeros(0, np.uint64) for k in sizes]


def window_starts(offsets: np.ndarray, size: int) -> np.ndarray:
    """Places of all words that begin a window inside their document."""
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    return np.repeat(offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def anchored(distinct: pa.Array, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor and the hash of the windows that begin at the given places."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for w in distinct.to_numpy(zero_copy_only=False)), np.uint64, len(distinct))[code]
    low, whole = grams(h, [GRAM, WINDOW])
    k = WINDOW - GRAM + 1  # grams in a window
    width = 1
    while 2 * width <= k:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (k - width)], low[k - width :])
    return low[at], whole[at]


def runs_of(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """Places where a new run begins: some column isn't the one before plus its step."""
    new = np.ones(len(columns[0][0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] + c.dtype.type(step) for c, step in columns])
    return np.flatnonzero(new)


def first_places(code: np.ndarray, at: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """For each window the first one with the same words. Candidates have the same hash; their words decide."""
    by = np.argsort(hashed, kind="stable")
    heads = runs_of((hashed[by], 0))
    first = np.empty(len(by), np.int64)
    first[by] = np.repeat(by[heads], np.diff(np.append(heads, len(by))))
    later = np.flatnonzero(first != np.arange(len(first)))
    same = np.ones(len(later), bool)
    for k in range(WINDOW):
        same &= code[at[later] + k] == code[at[first[later]] + k]
    for w in np.unique(first[later[~same]]).tolist():  # different windows with one hash
        own = np.flatnonzero(first == w)
        _, least, of = np.unique(code[at[own][:, None] + np.arange(WINDOW)], axis=0, return_index=True, return_inverse=True)
        first[own] = own[least][of.ravel()]
    return first


def factorize(code: np.ndarray, at: np.ndarray, seg: np.ndarray, first: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of all segments side by side: first window, first window of the source, number of
    windows. Windows of a segment begin at consecutive words; hit marks those that occur earlier."""
    seeds = np.flatnonzero(hit)
    ends = np.append(np.flatnonzero(seg[1:] != seg[:-1]), len(seg) - 1)
    last = np.repeat(ends, np.diff(np.append(-1, ends)))  # of each window: the last one of its segment
    cur = seeds[runs_of((seg[seeds], 0))] if len(seeds) else seeds
    src, n = first[cur], np.ones(len(cur), np.int64)
    done, step = [], STEP
    while len(cur):
        room = np.minimum(last[cur] - cur, last[src] - src) - n + 1
        k = np.arange(step)
        inside = k < room[:, None]
        a, b = (np.where(inside, (at[x] + WINDOW + n - 1)[:, None] + k, 0) for x in (cur, src))
        same = inside & (code[a] == code[b])
        whole = same.all(axis=1)
        n = n + np.where(whole, step, same.argmin(axis=1))
        done.append((cur[~whole], src[~whole], n[~whole]))
        # The next factor of a segment begins at the next seed that the last one doesn't cover.
        place = np.searchsorted(seeds, cur[~whole] + n[~whole])
        new = seeds[np.minimum(place, len(seeds) - 1)]
        new = new[(place < len(seeds)) & (seg[new] == seg[cur[~whole]])]
        cur, src, n = np.append(cur[whole], new), np.append(src[whole], first[new]), np.append(n[whole], np.ones(len(new), np.int64))
        step = max(STEP, min(2 * step if whole.any() else STEP, PAIRS // max(len(cur), 1)))
    out = [np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3)]
    order = np.argsort(out[0], kind="stable")
    return out[0][order], out[1][order], out[2][order]


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, int, int | None]]:
    """Slices of documents in their order: ids, ties, texts. A text longer than a slice is cut into
    stretches that share WINDOW - 1 words: then also the words before it, and those that begin windows."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
    for part in slices(batch.filter(pa.array(size <= SLICE_BYTES)), most=SLICE_BYTES):
        ids, ties = (np.asarray(part.column(c)) for c in ("doc_id", "tie"))
        order = np.lexsort((ties, ids))
        yield ids[order], ties[order], part.column("text").take(pa.array(order)), 0, None
    for row in np.flatnonzero(size > SLICE_BYTES).tolist():
        ids, ties = (np.asarray(batch.column(c).slice(row, 1)) for c in ("doc_id", "tie"))
        data, lo, before = batch.column("text")[row].as_buffer(), 0, 0
        while lo < data.size:
            cut = SPACE.search(data, lo + SLICE_BYTES)
            hi = end = cut.start() if cut else data.size
            shared = 0
            for _, w in zip(range(WINDOW - 1), WORD.finditer(data, hi), strict=False):
                end, shared = w.end(), shared + 1
            texts = pa.array([data.slice(lo, end - lo).to_pybytes().decode()], pa.string())
            own = len(Words(texts)) - shared
            yield ids, ties, texts, before, own
            lo, before = hi, before + own
            trim()


def emit(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, blob) of a task's slices: stretches for their blocks, and the factors that a slice
    has already found in itself, to be passed on."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        for ids, ties, texts, before, most in stretches(batch):
            words = Words(texts)
            distinct, code = words.coded()
            table = np.zeros(len(ids), DOC)
            table["doc"], table["tie"] = ids, ties
            at = window_starts(words.offsets, WINDOW)
            at = at if most is None else at[at < most]
            if not len(at):
                continue
            anchor, hashed = anchored(distinct, code, at)
            doc = words.of_text()[at]
            start = at - words.offsets[doc] + before
            first = first_places(code, at, hashed)
            known = first != np.arange(len(at))
            # A repeated row (same doc_id, same text) has the windows of the same document again.
            again = known.copy()
            again[known] = (start[known] == start[first[known]]) & (table[doc[known]] == table[doc[first[known]]])
            del hashed
            out = []
            w, s, n = factorize(code, at, doc, first, known & ~again)
            if len(w):
                fac = np.zeros(len(w), FACTOR)
                fac["start"], fac["n"], fac["src_doc"], fac["src_start"] = start[w], n, table["doc"][doc[s]], start[s]
                out += factor_blobs(table, doc[w], fac, blocks)
            del first, again, w, s, n
            send = np.flatnonzero(~known)
            if len(send):
                heads = runs_of((anchor[send], 0), (doc[send], 0), (start[send], 1))
                n = np.diff(np.append(heads, len(send)))
                heads = send[heads]
                run = np.zeros(len(heads), RUN)
                run["doc"], run["start"], run["n"] = doc[heads], start[heads], n
                to = (anchor[heads] % np.uint64(blocks)).astype(np.int64)
                by, at = np.argsort(to, kind="stable"), at[heads]
                del send, anchor, doc, start, code
                size = np.asarray(pc.binary_length(words.flat), dtype=np.int64) + 1
                ends = np.cumsum(size) - 1  # where words end when one space stands between them
                data = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.flat.cast(pa.large_string())), pa.scalar(" ", pa.large_string()))[0].as_buffer().to_pybytes()
                lo, hi = (ends - size + 1)[at][by].tolist(), ends[at + n + WINDOW - 2][by].tolist()
                run, to = run[by], to[by]
                cuts = [*runs_of((to, 0)).tolist(), len(by)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append((int(to[i]), pack_runs(table, run[i:j], b"\n".join([data[x:y] for x, y in zip(lo[i:j], hi[i:j], strict=True)]), squeeze)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["block", "blob"])


def planes(x: np.ndarray) -> bytes:
    """Integers byte by byte: all lowest bytes first, so that small ones leave rows of zeros to squeeze."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes, n: int, nth: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, 8 * n, nth).reshape(8, n).T.copy().view("<i8").ravel()


def pack_runs(table: np.ndarray, run: np.ndarray, text: bytes, squeeze) -> bytes:
    """Runs come in the order of documents and places, which are written as steps."""
    docs, local = np.unique(run["doc"], return_inverse=True)
    own = table[docs]
    body = (planes(np.diff(own["doc"], prepend=0)), planes(np.diff(local, prepend=0)), planes(run["start"]), planes(run["n"]), own["tie"].tobytes(), text)
    return np.array([0, len(docs), len(run)], "<u4").tobytes() + squeeze(b"".join(body))


def unpack_runs(blob: bytes, open_) -> tuple[np.ndarray, np.ndarray, bytes]:
    _, d, r = np.frombuffer(blob, "<u4", 3).tolist()
    data = open_(blob[12:])
    docs, run = np.zeros(d, DOC), np.zeros(r, RUN)
    docs["doc"] = np.cumsum(unplanes(data, d, 0))
    for i, k in enumerate(RUN.names):
        run[k] = np.cumsum(unplanes(data, r, 8 * d)) if k == "doc" else unplanes(data, r, 8 * d + 8 * i * r)
    at = 8 * d + 24 * r
    docs["tie"] = np.frombuffer(data, "<i8", d, at)
    return docs, run, data[at + 8 * d :]


def factor_blobs(table: np.ndarray, own: np.ndarray, fac: np.ndarray, blocks: int) -> list[tuple[int, bytes]]:
    """Known factors of a slice, one blob per block (dealt by document)."""
    to = mix(table["doc"][own].astype(np.uint64)) % np.uint64(blocks)
    out = []
    by = np.argsort(to, kind="stable")
    cuts = [*runs_of((to[by], 0)).tolist(), len(by)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        k = by[lo:hi]
        docs, local = np.unique(own[k], return_inverse=True)
        out.append((int(to[k[0]]), b"".join((np.array([1, len(docs), len(k)], "<u4").tobytes(), table[docs].tobytes(), local.astype("<u4").tobytes(), fac[k].tobytes()))))
    return out


FOUND = "doc_id long, tie long, factors binary"


def rows_of(docs: np.ndarray, own: np.ndarray, fac: np.ndarray) -> pa.RecordBatch:
    """One row per document from its factors; own: the document of each factor, ascending."""
    heads = runs_of((own, 0))
    ends = np.append(heads[1:], len(own))
    data = fac.tobytes()
    size = FACTOR.itemsize
    at = own[heads]
    return pa.RecordBatch.from_arrays(
        [pa.array(docs["doc"][at]), pa.array(docs["tie"][at]), pa.array([data[a * size : b * size] for a, b in zip(heads.tolist(), ends.tolist(), strict=True)], pa.binary())],
        ["doc_id", "tie", "factors"],
    )


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses the stretches of a task's blocks, which come one after another."""
    open_ = zstandard.ZstdDecompressor().decompress
    now, got = None, []
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if block != now:
                yield from parse_block(got)
                now, got = block, []
            if blob[0]:
                _, d, n = np.frombuffer(blob, "<u4", 3).tolist()
                docs = np.frombuffer(blob, DOC, d, 12)
                own = np.frombuffer(blob, "<u4", n, 12 + docs.nbytes)
                fac = np.frombuffer(blob, FACTOR, n, 12 + docs.nbytes + own.nbytes)
                by = np.argsort(own, kind="stable")
                yield rows_of(docs, own[by], fac[by])
            else:
                got.append(unpack_runs(blob, open_))
    yield from parse_block(got)
    trim()


def parse_block(got: list[tuple[np.ndarray, np.ndarray, bytes]]) -> Iterator[pa.RecordBatch]:
    """Factors of one block's stretches against those of them that start earlier."""
    if not got:
        return
    run = np.concatenate([g[1] for g in got])
    shift = np.cumsum([0, *[len(g[0]) for g in got]])
    # One number for each document, in the order of documents.
    kinds, number = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    of = number[run["doc"].astype(np.int64) + np.repeat(shift[:-1], [len(g[1]) for g in got])]
    _, code = Words(pa.array([b"\n".join([g[2] for g in got]).decode()], pa.string())).coded()
    n = run["n"].astype(np.int64)
    place = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
    by = np.lexsort((run["start"], of))
    n, place, of, begin = n[by], place[by], of[by], run["start"].astype(np.int64)[by]
    ends = np.cumsum(n)
    inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
    at, seg = np.repeat(place, n) + inside, np.repeat(np.arange(len(n)), n)
    doc, start = np.repeat(of, n), np.repeat(begin, n) + inside
    (hashed,) = grams(mix(code.astype(np.uint64) + np.uint64(1)), [WINDOW])
    first = first_places(code, at, hashed[at])
    w, s, n = factorize(code, at, seg, first, (doc != doc[first]) | (start != start[first]))
    if len(w):
        fac = np.zeros(len(w), FACTOR)
        fac["start"], fac["n"], fac["src_doc"], fac["src_start"] = start[w], n, kinds["doc"][doc[s]], start[s]
        yield rows_of(kinds, doc[w], fac)


def covered(words: Words, found: list[bytes | None]) -> np.ndarray:
    """For each word whether a duplicate window covers it."""
    change = np.zeros(len(words) + 1, np.int32)
    for row, blob in enumerate(found):
        if blob:
            f = np.frombuffer(blob, FACTOR)
            lo = words.offsets[row] + f["start"].astype(np.int64)
            np.add.at(change, lo, 1)
            np.add.at(change, lo + f["n"] + WINDOW - 1, -1)
    return np.cumsum(change[:-1]) > 0


def spans(blob: bytes | None) -> list[dict]:
    """Factors of one document as spans of words: start, end, src_doc, src_start, in order. Factors of
    neighbouring blocks that go on in the same source are one."""
    out: list[dict] = []
    for x in np.sort(np.frombuffer(blob or b"", FACTOR), order=["start"]).tolist():
        start, n, doc, at = x
        last = out[-1] if out else None
        if last and start == last["end"] - WINDOW + 1 and doc == last["src_doc"] and at - last["src_start"] == start - last["start"]:
            last["end"] += n
        else:
            out.append({"start": start, "end": start + n + WINDOW - 1, "src_doc": doc, "src_start": at})
    return out


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with each text as a zstd frame; null stays null."""
    squeeze = zstandard.ZstdCompressor(level=TEXT_LEVEL).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = pa.array([None if t is None else squeeze(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
        yield batch.set_column(at, "text", texts)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `squeezed` with their texts again, about SLICE_BYTES of text at a time (a longer one alone)."""
    open_, size = zstandard.ZstdDecompressor().decompress, zstandard.frame_content_size
    for batch in batches:
        at, frames, lo, held, got = batch.schema.get_field_index("text"), batch.column("text"), 0, 0, []
        for row, frame in enumerate(frames):
            frame = frame.as_py()
            n = size(frame) if frame is not None else 0
            if got and held + n > SLICE_BYTES:
                yield batch.slice(lo, row - lo).set_column(at, "text", pa.array(got, pa.binary()).view(pa.string()))
                lo, held, got = row, 0, []
            got.append(open_(frame) if n else None if frame is None else b"")
            held += n
        if got:
            yield batch.slice(lo).set_column(at, "text", pa.array(got, pa.binary()).view(pa.string()))


def with_factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents with their factors: doc_id, text, factors (list of blobs of FACTOR rows; null if
    none), and a struct `carried` of the columns to carry along. Texts come `squeezed`, as they meet their
    factors by a shuffle."""
    other = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    rows = bounded_batches(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), other.alias("carried"))
    # Texts of one doc_id are told apart by a hash; where no id is repeated, none has to travel along.
    repeated = not docs.groupBy(F.col(f"`{doc_id}`")).count().where("count > 1").isEmpty()
    rows = rows.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("_tie"))
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # no estimate for rows that come from no file
        size = docs.agg(F.sum(F.octet_length(f"`{text}`")).alias("n")).first()["n"] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, size // BLOCK_BYTES)
    sent = rows.select(F.col("_doc").alias("doc_id"), F.col("_tie").alias("tie"), "text").mapInArrow(lambda it: emit(it, blocks), "block long, blob binary")
    tasks = max(least, min(blocks // TASK_BLOCKS, MOST_TASKS))
    found = sent.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(parse, FOUND)
    per_doc = found.groupBy("doc_id", "tie").agg(F.collect_list("factors").alias("_list"))
    per_doc = per_doc.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), "_list")
    small = rows.mapInArrow(squeezed, StructType([StructField(f.name, BinaryType() if f.name == "text" else f.dataType) for f in rows.schema]))
    return small.join(per_doc, ["_doc", "_tie"], "left").select("doc_id", "text", F.col("_list").alias("factors"), *(["carried"] if carry else []))


def _joined(values: list | None) -> bytes | None:
    return b"".join(values) if values else None


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each whole text.

    Null, empty and short texts have nothing removed. Of equal texts the one with the smallest doc_id
    stays. Rows with one doc_id but different texts count as documents in the order of a hash of their
    texts; rows repeated in full are one document, and each is returned. Rows without doc_id come after
    all others, in the order of that hash. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in opened(batches):
            for part in slices(batch):
                words = Words(part.column("text"))
                gone = covered(words, [_joined(x) for x in part.column("factors").to_pylist()])
                before = np.concatenate(([0], np.cumsum(~gone)))[words.offsets]
                lists = pa.LargeListArray.from_arrays(pa.array(before), words.flat.filter(pa.array(~gone)).cast(pa.large_string()))
                kept = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                ends, data = np.frombuffer(kept.buffers()[1], np.int64)[: len(kept) + 1].tolist(), memoryview(kept.buffers()[2] or b"")
                sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), pa.array(words.counts - np.diff(before)), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_factors(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept_texts(part: pa.RecordBatch) -> tuple[list[str | None], list[bytes | None]]:
    """Texts without what is covered (those that lose nothing stay as they are), and their factors."""
    blobs = [_joined(x) for x in part.column("factors").to_pylist()]
    words = Words(part.column("text"))
    gone = covered(words, blobs)
    texts = part.column("text").to_pylist()
    for row, blob in enumerate(blobs):
        if blob:
            a, b = words.offsets[row], words.offsets[row + 1]
            texts[row] = " ".join(words.flat[a:b].filter(pa.array(~gone[a:b])).to_pylist())
    return texts, blobs


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans of each document; a text that lost words is its kept words with one space
    between them, all others stay as they are (null too)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("src_doc", pa.int64()), ("src_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in opened(batches):
            for part in slices(batch):
                texts, blobs = _kept_texts(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array([spans(b) for b in blobs], kind)], ["doc_id", "text", "spans"])

    return with_factors(docs).mapInArrow(run, "doc_id long, text string, spans array<struct<start:long,end:long,src_doc:long,src_start:long>>")


def replace_texts(docs: DataFrame) -> DataFrame:
    """The same table with deduplicated texts; a column n_chars follows the text."""
    other = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in opened(batches):
            for part in slices(batch):
                texts, _ = _kept_texts(part)
                cols = {"doc_id": part.column("doc_id"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
                if other:
                    cols["carried"] = part.column("carried")
                yield pa.RecordBatch.from_pydict(cols)

    rows = with_factors(docs, carry=other)
    kinds = "doc_id long, text string, n_chars long" + (f", carried {rows.schema['carried'].dataType.simpleString()}" if other else "")
    out = rows.mapInArrow(run, kinds)
    return out.select(*[F.col("carried").getField(c).alias(c) if c in other else F.col(c) for c in docs.columns])
