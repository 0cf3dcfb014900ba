"""Rank fusion by blocks of entities.

The channels' best candidates are known for classes of entities (see `similarity`). A block of entities gets
each list that it needs once, and its candidates are made, fused and ranked in the task, some at a time: no
candidate of a list is shuffled, and what a query doesn't return is never written. Reverse candidates, which
belong to entities, travel as rows. Results equal those of `retrieval.fuse` and its kin, which take candidates
as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import EngineConfig
from .similarity import KEYS, _flat, in_block

#: Candidates of a block (if all lists were full) and candidates fused in one pass.
BLOCK, PASS = 2_000_000, 200_000
LIST, REVERSE, WANTED, LISTED = range(4)
ROW = "country string, s1_id string, channel string, cls string, s23_id string, score double, rank int"


class Block:
    """The candidates of a block of entities. Entities and ids are numbers; those of ids follow their order."""

    def __init__(self, asks: pa.Table, lists: pa.Table, channels: tuple[str, ...]):
        kind = asks.column("kind").to_numpy()
        wanted, asks, kind = asks.filter(pa.array(kind == WANTED)), asks.filter(pa.array(kind != WANTED)), kind[kind != WANTED]
        own, back = asks.filter(pa.array(kind == LIST)), asks.filter(pa.array(kind == REVERSE))
        self.channels = channels
        country, s1 = (_flat(asks.column(c)).dictionary_encode() for c in ("country", "s1_id"))
        self.countries, self.names = country.dictionary, s1.dictionary
        width = max(len(self.names), 1)
        owner, entity = np.unique(np.asarray(country.indices, dtype=np.int64) * width + np.asarray(s1.indices, dtype=np.int64), return_inverse=True)
        self.country_of, self.name_of = owner // width, owner % width
        others = _flat(lists.column("others"))
        length = np.asarray(pc.list_value_length(others), dtype=np.int64)
        ids = pa.concat_arrays([others.flatten(), _flat(back.column("s23_id"))]).dictionary_encode()
        order = pc.sort_indices(ids.dictionary)
        place = np.empty(len(order), np.int64)
        place[np.asarray(order)] = np.arange(len(order))
        self.ids, self.code = ids.dictionary.take(order), place[np.asarray(ids.indices, dtype=np.int64)]
        self.size, self.listed = max(len(self.ids), 1), int(length.sum())
        self.score = np.concatenate([np.asarray(_flat(lists.column("scores")).flatten()), np.asarray(_flat(back.column("score")), dtype=np.float64)])
        self.back_rank = np.asarray(_flat(back.column("rank")), dtype=np.int64)
        s1, s23 = (pc.index_in(_flat(wanted.column(c)), value_set=v) for c, v in (("s1_id", self.names), ("s23_id", self.ids)))
        known = pc.and_(pc.is_valid(s1), pc.is_valid(s23))
        self.wanted = np.unique(np.asarray(s1.filter(known), dtype=np.int64) * self.size + np.asarray(s23.filter(known), dtype=np.int64))
        # Runs of candidates, asked lists and reverse rows alike: entity, channel, begin and number.
        named = lambda t: pc.binary_join_element_wise(*[_flat(t.column(c)) for c in (*KEYS, "cls")], "\x01")
        at = pc.index_in(named(own), value_set=named(lists))
        has = np.asarray(pc.is_valid(at))
        at = np.asarray(at.drop_null(), dtype=np.int64)
        channel = np.asarray(pc.index_in(_flat(own.column("channel")), value_set=pa.array(channels, pa.string())).filter(pa.array(has)), dtype=np.int64)
        entity = np.concatenate([entity[kind == LIST][has], entity[kind == REVERSE]])
        by = np.argsort(entity, kind="stable")
        self.entity, self.channel = entity[by], np.concatenate([channel, np.full(len(back), len(channels))])[by]
        self.begin = np.concatenate([(np.cumsum(length) - length)[at], self.listed + np.arange(len(back))])[by]
        self.n = np.concatenate([length[at], np.ones(len(back), np.int64)])[by]

    def passes(self) -> Iterator[slice]:
        """Runs of whole entities, some candidates at a time."""
        heads = np.flatnonzero(np.diff(self.entity, prepend=-1))
        upto = np.concatenate(([0], np.cumsum(self.n)))[np.append(heads, len(self.n))]
        lo, heads = 0, np.append(heads, len(self.n))
        while lo < len(heads) - 1:
            hi = max(int(np.searchsorted(upto, upto[lo] + PASS, side="right")) - 1, lo + 1)
            yield slice(int(heads[lo]), int(heads[hi]))
            lo = hi


class Fused:
    """The fused pairs of some entities, in the order of entities and ids: n_channels, min_rank, sum_score, rrf."""

    def __init__(self, block: Block, runs: slice, config: EngineConfig):
        n, reverse = block.n[runs], len(block.channels)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat, channel, rank = np.repeat(block.begin[runs], n) + inside, np.repeat(block.channel[runs], n), inside + 1
        back = np.flatnonzero(channel == reverse)
        rank[back] = 2 * block.back_rank[flat[back] - block.listed]
        key = np.repeat(block.entity[runs], n) * block.size + block.code[flat]
        by = np.argsort(key, kind="stable")
        key, self.channel, self.score, self.rank = key[by], channel[by], block.score[flat[by]], rank[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        heads, self.pair, own = np.flatnonzero(new), np.cumsum(new) - 1, self.channel < reverse
        self.block, self.entity, self.code = block, key[heads] // block.size, key[heads] % block.size
        self.n_channels = np.add.reduceat(own.astype(np.int64), heads)
        self.min_rank = np.minimum.reduceat(self.rank, heads)
        self.sum_score = np.round(np.add.reduceat(np.where(own, self.score, 0.0), heads), 6)
        self.rrf = np.round(np.add.reduceat(1.0 / (config.rrf_constant + self.rank + (config.rank_base - 1)), heads), 9)

    def ids(self, keep: np.ndarray | slice = slice(None)) -> dict[str, pa.Array]:
        b = self.block
        return {"s1_id": b.names.take(pa.array(b.name_of[self.entity[keep]])), "s23_id": b.ids.take(pa.array(self.code[keep]))}

    def country(self) -> np.ndarray:
        return self.block.country_of[self.entity]

    def wanted(self) -> np.ndarray:
        return np.flatnonzero(np.isin(self.block.name_of[self.entity] * self.block.size + self.code, self.block.wanted))

    def fused_rank(self, by_min_rank: bool = False) -> np.ndarray:
        """A pair's place among its entity's: by rrf, or by best rank and summed score; then by id."""
        by = np.lexsort((-self.sum_score, self.min_rank, self.entity) if by_min_rank else (-self.rrf, self.entity))
        out = np.empty(len(by), np.int64)
        out[by] = np.arange(len(by)) - np.searchsorted(self.entity, self.entity) + 1
        return out

    def of(self, channel: str) -> tuple[np.ndarray, np.ndarray]:
        """Score and rank of each pair in one channel (or "reverse"), 0 where it has none."""
        c = (*self.block.channels, "reverse").index(channel)
        own = np.flatnonzero(self.channel == c)
        score, rank = np.zeros(len(self.entity)), np.zeros(len(self.entity), np.int64)
        score[self.pair[own]], rank[self.pair[own]] = self.score[own], self.rank[own] // (2 if channel == "reverse" else 1)
        return score, rank


def by_blocks(lists: DataFrame, members: DataFrame, blocks: int, channels: tuple[str, ...], then: Callable[[Fused], dict], schema: str, config: EngineConfig, reverse: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The columns that `then` makes of the fused pairs of some entities at a time; an entity's pairs always
    come together.

    lists, members, blocks: of S1 entities, from `similarity.best_classes`. reverse: country, s1_id, s23_id,
    score, rank; its rank r counts as 2r. only: pairs (s1_id, s23_id) that `Fused.wanted` finds."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    row = lambda df, kind, **own: df.select(*[F.expr(f"cast({own.get(c, 'null')} as {t})").alias(c) for c, t in [x.split() for x in ROW.split(", ")]]).withColumns({"kind": F.lit(kind), "part": in_block("s1_id", blocks)})
    rows = row(members, LIST, country="country", s1_id="id", channel="channel", cls="cls")
    if reverse is not None:
        rows = rows.union(row(reverse, REVERSE, country="country", s1_id="s1_id", s23_id="s23_id", score="score", rank="rank"))
    if only is not None:
        rows = rows.union(row(only, WANTED, s1_id="s1_id", s23_id="s23_id"))
    listed = lists.select(*KEYS, "cls", "others", "scores", F.lit(LISTED).alias("kind"), F.explode("blocks").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        kind = t.column("kind").to_numpy()
        block = Block(t.filter(pa.array(kind != LISTED)), t.filter(pa.array(kind == LISTED)), channels)
        del t
        for runs in block.passes():
            yield from pa.table(then(Fused(block, runs, config)), schema=kinds).to_batches()
        pa.default_memory_pool().release_unused()

    together = rows.unionByName(listed, allowMissingColumns=True)
    return together.repartition(blocks, "part").groupBy("part").applyInArrow(run, schema)
