"""Best-fit packing with patterns from non-negative least squares.

Documents are cut into pieces of at most `capacity` tokens; only the histogram of lengths goes to the
driver (at most `capacity` numbers, however many documents there are). There:

1. lengths are grouped into classes of equal width, and all patterns of up to `depth` classes that fill
   a sequence are enumerated; non-negative least squares finds how often to repeat each pattern so that
   the classes of the histogram are used up;
2. counts are rounded, down and then up again where pieces are left, and exact lengths are drawn for
   each pattern so that it fills its sequence but for a few tokens; then the least squares are fitted
   anew to what is left, until no pattern can be filled any more;
3. the residual pieces are packed by best fit, longest first and first of all into the room that
   patterns left open, on counts of equal lengths and equal room.

A pattern that leaves room open may cost a sequence in the end. So plans are made with several bounds
of that room, down to patterns that fill their sequence to the last token; the one with the fewest
sequences counts, of equals the one that has most pieces in patterns.

The plan says for each length which ranks of its pieces go to which sequences and where; pieces are
ranked in parallel and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless, materialize, pick, slices
from .tokens import encoder

CAPACITY, CLASSES, DEPTH = 4096, 32, 8
PART_ROWS = 100_000
#: Tokens that a pattern may leave open (a plan for each), fits to residuals, and lengths that are tried for
#: a pattern's last place but one.
SLACKS, REFITS, TRIES = (32, 8, 0), 8, 64


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with least |a x - b|: accelerated projected gradient with restarts."""
    step = 1.0 / max(np.linalg.norm(a @ a.T, 2), 1e-12)
    x = np.zeros(a.shape[1])
    y, t, best = x, 1.0, np.inf
    for _ in range(rounds):
        z = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        now = float(np.linalg.norm(a @ z - b))
        if now > best:  # overshot: begin again from the best
            y, t, best = x, 1.0, np.inf
            continue
        if best - now < tolerance * max(best, 1) and best < np.inf:
            return z
        best = now
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / s * (z - x), z, s
    return x


def patterns(classes: int, depth: int) -> list[tuple[int, ...]]:
    """All lists of 2 to depth classes, largest first, that sum to `classes`."""
    out: list[tuple[int, ...]] = []

    def grow(room: int, most: int, own: tuple[int, ...]) -> None:
        if not room:
            if len(own) > 1:
                out.append(own)
        elif len(own) < depth:
            for c in range(min(room, most), 0, -1):
                grow(room - c, c, (*own, c))

    grow(classes, classes, ())
    return out


#: Rounds of a least-squares fit.
FIT_ROUNDS = 600


@lru_cache(4)
def enumerated(classes: int, depth: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All patterns, and the matrix of how many pieces of a class (row) a pattern (column) takes."""
    found = patterns(classes, depth)
    a = np.zeros((classes, len(found)))
    for j, p in enumerate(found):
        for c in p:
            a[c - 1, j] += 1
    return found, a


class Plan:
    """Which ranks of which lengths go where. steps: (length, first rank, count, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {int(k): int(v) for k, v in histogram.items() if v}
        self.total = dict(self.left)
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
        self.rooms: list[int] = []
        self.lengths: list[int] = []  # those left, ascending, while patterns are filled
        self.patterned = 0  # pieces in patterns

    def take(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.steps.append((length, self.total[length] - self.left[length], count, sequence, offset))
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            if self.lengths:
                self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def put(self, room: int, sequence: int, count: int) -> None:
        if room > 0 and count:
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((sequence, count))

    def by_patterns(self, classes: int, depth: int, slack: int) -> None:
        """Whole pieces first; then patterns as often as least squares says, again and again."""
        if n := self.left.get(self.capacity):
            self.take(self.capacity, n, self.sequences, 0)
            self.sequences += n
        width = self.capacity / classes
        found, a = enumerated(classes, depth)
        self.lengths = sorted(self.left)
        for _ in range(REFITS):
            need = np.zeros(classes)
            for length, n in self.left.items():
                need[min(classes, max(1, int(length / width + 0.5))) - 1] += n
            if not need.any():
                return
            scale = need.sum()
            share = nnls(a, need / scale, FIT_ROUNDS) * scale
            times = np.floor(share + 1e-6)
            free = need - a @ times
            for j in np.argsort(times - share, kind="stable"):
                if share[j] - times[j] < 1e-3:
                    break
                if (a[:, j] <= free).all():
                    times[j] += 1
                    free -= a[:, j]
            filled = 0
            for j in np.argsort(-times, kind="stable"):
                want = int(times[j])
                while want > 0 and (done := self.repeat(found[j], width, want, slack)):
                    want -= done
                    filled += done
            if not filled:
                return

    def free(self, at: int, used: dict[int, int], step: int = -1) -> int:
        """The place of the next length from `at` on that isn't used up yet."""
        while 0 <= at < len(self.lengths) and self.left[self.lengths[at]] <= used.get(self.lengths[at], 0):
            at += step
        return at

    def repeat(self, pattern: tuple[int, ...], width: float, want: int, slack: int) -> int:
        """One choice of lengths for the pattern, as often as they all last. Each place takes the length
        that comes nearest to its class once the errors before it are made up for; the last one takes the
        longest that fits, and may leave `slack` tokens open."""
        own, total, meant = [], 0, 0.0
        used: dict[int, int] = defaultdict(int)

        def last(room: int) -> int:
            at = self.free(bisect.bisect_right(self.lengths, room) - 1, used)
            return self.lengths[at] if at >= 0 and room - self.lengths[at] <= slack else 0

        for place, c in enumerate(pattern[:-1]):
            meant += c * width
            at = self.free(bisect.bisect_right(self.lengths, min(meant, self.capacity) - total) - 1, used)
            final = place == len(pattern) - 2
            for _ in range(TRIES if final else 1):
                if at < 0 or self.lengths[at] < (c - 0.75) * width:
                    return 0
                length = self.lengths[at]
                used[length] += 1
                if not final or (end := last(self.capacity - total - length)):
                    own.append(length)
                    total += length
                    break
                used[length] -= 1
                at = self.free(at - 1, used)
            else:
                return 0
        own.append(end)
        used[end] += 1
        n = min(want, *(self.left[k] // v for k, v in used.items() if v))
        offset = 0
        for length in own:
            self.take(length, n, self.sequences, offset)
            offset += length
        self.put(self.capacity - offset, self.sequences, n)
        self.sequences += n
        self.patterned += n * len(own)
        return n

    def best_fit(self) -> None:
        """The rest, longest first, each into the least room that holds it."""
        self.lengths = []
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                n = self.left[length]
                at = bisect.bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    k = self.capacity // length
                    new = max(1, n // k)
                    first, self.sequences = self.sequences, self.sequences + new
                    for i in range(min(k, n)):
                        self.take(length, min(new, self.left.get(length, 0)), first, i * length)
                    self.put(self.capacity - min(k, n) * length, first, new)
                    continue
                room = self.rooms[at]
                sequence, count = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(at)
                use = min(n, count)
                self.take(length, use, sequence, self.capacity - room)
                self.put(room, sequence + use, count - use)
                self.put(room - length, sequence, use)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> Plan:
    """Patterns, and best fit for the residual pieces."""
    out = []
    for slack in SLACKS:
        p = Plan(histogram, capacity)
        p.by_patterns(min(classes, capacity), depth, slack)
        p.best_fit()
        out.append(p)
    return min(out, key=lambda p: (p.sequences, -p.patterned))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of whole documents; null and empty texts are the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids, off = enc.encode(part.column("text"))
                n = np.diff(off) + 1
                data = np.insert(ids, off[1:], np.uint32(end_id)).astype("<u4")
                first = np.cumsum(n) - n
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                raw, at = memoryview(data.tobytes()), (first[row] + start).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, doc_id, text).toDF("doc_id", "text").mapInArrow(run, PIECES)


def assign(ranked: DataFrame, p: Plan) -> DataFrame:
    """Adds sequence_id and offset to rows with columns length and rank."""
    steps = np.array(sorted(p.steps), np.int64).reshape(-1, 5)
    # (length, rank) as one ascending number; ranks stay below 2**48.
    key = (steps[:, 0] << 48) | steps[:, 1]
    first, place = steps[:, 3], steps[:, 4]
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[at] + rank - steps[at, 1]), pa.array(place[at])], [*b.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id. Only documents longer than capacity are cut. Repeated doc_ids
    are packed as documents of their own; equal lengths are ranked by (doc_id, piece, ids_crc32). An
    empty table gives no rows; other columns are ignored. Sequence numbers are gapless from 0.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    p = plan(histogram, capacity, classes, depth)
    parts = max(histogram.values(), default=0) // PART_ROWS + int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = gapless(cut, ["length"], ["doc_id", "piece", "ids_crc32"], parts, "rank")
    return assign(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), p).drop("rank")
