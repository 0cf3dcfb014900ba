"""Choice of thresholds and rules on validation pairs: grids are exploded, so each search is one plan.

Pairs have s1_id, s23_id, country, addr_empty, label, prob and weight (what a wrong selection counts);
entities have s1_id and country. Scores are means of F0.5 over entities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from . import evaluate as E

CONFIG = EngineConfig()
# The grids of the searches.
DELTAS = (-0.30, -0.20, -0.10, -0.05, 0.0, 0.05, 0.10)
MAX_LINKS = (0, 10)
RESCUE_GRID = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
RESCUE_GAIN = 0.0002


def weight() -> Column:
    """What a selected pair counts: a true one 1, a false one its weight."""
    return F.when(F.col("label") == 1, 1.0).otherwise(F.col("weight"))


def truth_counts(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with their number of true pairs."""
    true = pairs.where("label = 1").groupBy("s1_id").agg(F.count("*").cast("double").alias("n_true"))
    return entities.select("s1_id", "country").join(true, "s1_id", "left").na.fill(0.0, ["n_true"])


def swept(pairs: DataFrame, base: DataFrame, points: list[float]) -> DataFrame:
    """(country, t, macro_f): base has s1_id, country, n_true and what is selected anyway (tp0, n0). One
    pass: a pair is put into the last grid step it passes, and sums run down from the highest step."""
    step = F.size(F.filter(F.array(*[F.lit(t) for t in points]), lambda t: t <= F.col("prob")))
    at = pairs.withColumn("step", step).where("step > 0").groupBy("s1_id", "step").agg(F.sum("label").cast("double").alias("tp"), F.sum(weight()).alias("n"))
    order = Window.partitionBy("s1_id").orderBy(F.desc("step"))
    down = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = at.select("s1_id", "step", F.sum("tp").over(down).alias("tp"), F.sum("n").over(down).alias("n"), (F.coalesce(F.lead("step").over(order), F.lit(0)) + 1).alias("lo")).join(base, "s1_id")
    rest = E.f_half(F.col("tp0"), F.col("n0"), F.col("n_true"))
    gain = E.f_half(F.col("tp0") + F.col("tp"), F.col("n0") + F.col("n"), F.col("n_true")) - rest
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), gain.alias("d")), F.struct((F.col("step") + 1).alias("at"), (-gain).alias("d"))))
    change = runs.select("country", ends.alias("c")).groupBy("country", "c.at").agg(F.sum("c.d").alias("d"))
    start = base.groupBy("country").agg(F.count("*").alias("n"), F.sum(rest).alias("f"))
    grid = start.select("*", F.posexplode(F.array(*[F.lit(t) for t in points])).alias("i", "t")).withColumn("at", F.col("i") + 1).join(change, ["country", "at"], "left").na.fill(0.0, ["d"])
    run = Window.partitionBy("country").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.select("country", "t", F.round((F.col("f") + F.sum("d").over(run)) / F.col("n"), 9).alias("macro_f"))


def group_thresholds(pairs: DataFrame, entities: DataFrame, points: list[float] | None = None) -> DataFrame:
    """(grp, t): per country the threshold of pairs with address that scores best, then, with that one
    fixed, the threshold of pairs without. Of equals the lowest. Groups without pairs are left out."""
    points = points or E.grid()
    base = truth_counts(pairs, entities).withColumns({"tp0": F.lit(0.0), "n0": F.lit(0.0)})
    main, bare = pairs.where("not addr_empty"), pairs.where("addr_empty")
    first = E.best_threshold(swept(main, base, points), "country").select("country", "t")
    taken = main.join(F.broadcast(first), "country").where("prob >= t").groupBy("s1_id").agg(F.sum("label").cast("double").alias("tp0"), F.sum(weight()).alias("n0"))
    fixed = base.drop("tp0", "n0").join(taken, "s1_id", "left").na.fill(0.0, ["tp0", "n0"])
    second = E.best_threshold(swept(bare, fixed, points), "country").select("country", "t")
    second = second.join(bare.select("country").distinct(), "country", "left_semi")
    return first.select(F.col("country").alias("grp"), "t").union(second.select(F.concat("country", F.lit("|noaddr")).alias("grp"), "t"))


def scored(chosen: DataFrame, base: DataFrame, key: list[str], grid: DataFrame) -> DataFrame:
    """Macro F0.5 of every point of a grid (its key columns) from the pairs chosen at it, after each record
    went to one owner. Entities without choice score as empty, so only the chosen ones are counted."""
    owner = Window.partitionBy(*key, "s23_id").orderBy(F.desc("prob"), "s1_id")
    own = chosen.withColumn("nth", F.row_number().over(owner)).where("nth = 1")
    got = own.groupBy(*key, "s1_id").agg(F.sum("label").cast("double").alias("tp"), F.sum(weight()).alias("n")).join(base, "s1_id")
    empty = E.f_half(F.lit(0.0), F.lit(0.0), F.col("n_true"))
    gain = got.groupBy(*key).agg(F.sum(E.f_half(F.col("tp"), F.col("n"), F.col("n_true")) - empty).alias("gain"))
    total = base.agg(F.count("*").alias("entities"), F.sum(empty).alias("f0"))
    rows = grid.join(F.broadcast(gain), key, "left").crossJoin(F.broadcast(total))  # one row of totals
    return rows.select(*key, F.round((F.col("f0") + F.coalesce("gain", F.lit(0.0))) / F.col("entities"), 6).alias("macro_f"))


def ladder_grid(pairs: DataFrame, entities: DataFrame, deltas: tuple[float, ...] = DELTAS, max_links: tuple[int, ...] = MAX_LINKS, config: EngineConfig = CONFIG) -> DataFrame:
    """(d1, d2, d3, max_links, macro_f) of every ladder with non-decreasing deltas, but for the one that
    changes nothing. Pairs carry t, their group's threshold. The grid has a fixed size: a pair carries one
    bit for each of its points, so pairs are shuffled as they are and not once for each point."""
    spark = pairs.sparkSession
    points = [(a, b, c, m) for m in max_links for a in deltas for b in deltas for c in deltas if a <= b <= c and (m or (a, b, c) != (0.0, 0.0, 0.0))]
    *steps, links = (np.array(x) for x in zip(*points, strict=True))
    words = [f"m{i}" for i in range(-(-len(points) // 64))]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The points at which each pair is chosen."""
        for batch in batches:
            for part in (batch.slice(i, 8192) for i in range(0, batch.num_rows, 8192)):
                prob, t, rnk = (np.asarray(part.column(c))[:, None] for c in ("prob", "t", "rnk"))
                delta = np.where(rnk == 1, steps[0], np.where(rnk == 2, steps[1], steps[2]))
                on = np.where(rnk == 0, prob >= t, prob >= t + delta) & ((links == 0) | (rnk < links) | (prob >= config.certain))
                on = np.pad(on, ((0, 0), (0, 64 * len(words) - len(points))))
                masks = np.packbits(on, axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("s1_id", "s23_id", "prob", "label", "w")], *[pa.array(m) for m in masks.T.copy()]], ["s1_id", "s23_id", "prob", "label", "w", *words])

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the entities gain in all at each point over choosing nothing."""
        total = np.zeros(len(points))
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                own = part.column("own")
                size, rows = np.asarray(pc.list_value_length(own), dtype=np.int64), own.flatten()
                masks = np.stack([np.asarray(rows.field(m), dtype=np.int64) for m in words], axis=1)
                on = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, : len(points)].astype(np.float64)
                heads = np.cumsum(size) - size  # a group has a pair at least
                tp, n, any_ = (np.add.reduceat(on * x[:, None], heads) for x in (np.asarray(rows.field("label"), dtype=np.float64), np.asarray(rows.field("w")), np.ones(len(on))))
                true = np.asarray(part.column("n_true"))[:, None]
                bottom = (1 + E.BETA2) * tp + E.BETA2 * (true - tp) + (n - tp)
                f = np.where(true == 0, n == 0, np.where(bottom > 0, (1 + E.BETA2) * tp / np.where(bottom > 0, bottom, 1.0), 0.0))
                total += np.where(any_ > 0, f - (true == 0), 0.0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points)), pa.int32()), pa.array(total)], ["i", "gain"])

    by = Window.partitionBy("s1_id")
    rows = pairs.withColumns({"rnk": F.row_number().over(by.orderBy(F.desc("prob"), "s23_id")) - 1, "hit": F.col("prob") >= F.col("t")})
    rows = rows.withColumn("anchored", F.bool_or("hit").over(by)).where(F.col("anchored") & (F.col("prob") >= F.col("t") + min(deltas)))
    kinds = "s1_id string, s23_id string, prob double, label int, w double, " + ", ".join(f"{m} long" for m in words)
    chosen = rows.select("s1_id", "s23_id", "prob", "t", "rnk", F.col("label").cast("int").alias("label"), weight().alias("w")).mapInArrow(bits, kinds)
    # A record goes, at each point, to the first of its pairs that is chosen there.
    before = Window.partitionBy("s23_id").orderBy(F.desc("prob"), "s1_id").rowsBetween(Window.unboundedPreceding, -1)
    free = [F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(m).over(before), F.lit(0).cast("long")))).alias(m) for m in words]
    owned = chosen.select("s1_id", "label", "w", *free)
    base = truth_counts(pairs, entities)
    got = owned.groupBy("s1_id").agg(F.collect_list(F.struct("label", "w", *words)).alias("own")).join(base.select("s1_id", "n_true"), "s1_id").select("own", "n_true")
    gain = got.mapInArrow(gains, "i int, gain double").groupBy("i").agg(F.sum("gain").alias("gain"))
    empty = E.f_half(F.lit(0.0), F.lit(0.0), F.col("n_true"))
    total = base.agg(F.count("*").alias("entities"), F.sum(empty).alias("f0"))
    grid = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, d1 double, d2 double, d3 double, max_links int")
    rows = grid.join(F.broadcast(gain), "i", "left").crossJoin(F.broadcast(total))  # one row of totals
    return rows.select("d1", "d2", "d3", "max_links", F.round((F.col("f0") + F.coalesce("gain", F.lit(0.0))) / F.col("entities"), 6).alias("macro_f"))


def rescue_grid(pairs: DataFrame, entities: DataFrame, points: tuple[float, ...] = RESCUE_GRID, config: EngineConfig = CONFIG) -> DataFrame:
    """(country, t, gain): the rescue threshold of each country that raises its sum of F0.5 most, of
    equals the lowest; countries without a gain are left out. gain counts in the mean over all entities;
    together they are adopted where they reach RESCUE_GAIN. pairs carry selected, before one owner."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in (2.0, *points)], "rt double")  # 2: no rescue
    claims = Window.partitionBy("s23_id", "claim").orderBy(F.desc("prob"), "s1_id")
    rows = pairs.withColumn("claim", F.col("addr_empty") & (F.col("prob") >= config.rescue_prob))
    rows = rows.withColumns({"nth": F.row_number().over(claims), "next": F.lead("prob").over(claims), "accepted": F.count_if("selected").over(Window.partitionBy("s1_id"))})
    leads = F.col("next").isNull() | (F.round(F.col("prob") - F.col("next"), 9) >= config.rescue_lead)
    rows = rows.withColumn("able", F.col("claim") & (F.col("nth") == 1) & leads & (F.col("accepted") < config.rescue_links)).drop("nth", "next")
    chosen = rows.join(F.broadcast(grid), F.col("selected") | (F.col("able") & (F.col("prob") >= F.col("rt"))))
    owner = Window.partitionBy("rt", "s23_id").orderBy(F.desc("prob"), "s1_id")
    own = chosen.withColumn("nth", F.row_number().over(owner)).where("nth = 1")
    base = truth_counts(pairs, entities)
    got = own.groupBy("rt", "s1_id").agg(F.sum("label").cast("double").alias("tp"), F.sum(weight()).alias("n")).join(base, "s1_id")
    f = E.f_half(F.col("tp"), F.col("n"), F.col("n_true")) - E.f_half(F.lit(0.0), F.lit(0.0), F.col("n_true"))
    sums = got.groupBy("rt", "country").agg(F.sum(f).alias("f"))
    none = sums.where("rt = 2").select("country", F.col("f").alias("f0"))
    gain = sums.where("rt < 2").join(F.broadcast(none), "country", "left").crossJoin(F.broadcast(base.agg(F.count("*").alias("n"))))
    gain = gain.select("country", F.col("rt").alias("t"), F.round((F.col("f") - F.coalesce("f0", F.lit(0.0))) / F.col("n"), 9).alias("gain")).where("gain > 0")
    return gain.groupBy("country").agg(F.min_by(F.struct("t", "gain"), F.struct((-F.col("gain")).alias("g"), F.col("t"))).alias("b")).select("country", "b.t", "b.gain")


def unseen_settings(thresholds: dict[str, float], empty_rate: float) -> dict[str, float]:
    """Settings of a country that no label is known of, from those of the known ones."""
    main = [t for g, t in thresholds.items() if "|" not in g]
    bare = [t - thresholds[g.split("|")[0]] for g, t in thresholds.items() if "|" in g]
    return {
        "start": round(sum(main) / len(main) + 0.02, 9), "target": max(0.0559, empty_rate), "noaddr_delta": round(sum(bare) / len(bare), 9) if bare else 0.0,
    }


def rescue_for_unseen(thresholds: dict[str, float], countries: list[str]) -> dict[str, float]:
    """Rescue thresholds with, for countries without one, the highest of the others."""
    return {c: max(thresholds.values()) for c in countries} | thresholds if thresholds else {}


def calibrate_applied(pairs: DataFrame, entities: DataFrame, start: float, target: float, noaddr_delta: float = 0.0, seen_links: float = 3.4, step: float = 0.005, most_raise: float = 0.25, most: float = 0.97) -> DataFrame:
    """(t, reason, empty_rate, mean_links) of one country's threshold, raised step by step under the rule
    that is applied (threshold, then one owner), until the share of entities left empty reaches the target
    or the next step is forbidden: too far above start, above `most`, or too few links. Entities without
    any pair count in the target, not in the rate. All steps are answered in one plan."""
    n = round(most_raise / step)
    ts = [round(start + i * step, 4) for i in range(n + 2)]
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t double")
    need = F.when(F.col("addr_empty"), F.least(F.lit(0.99), F.col("t") + noaddr_delta)).otherwise(F.col("t"))
    chosen = pairs.where(F.col("prob") >= start + min(noaddr_delta, 0.0)).join(F.broadcast(grid), F.col("prob") >= need)
    owner = Window.partitionBy("i", "s23_id").orderBy(F.desc("prob"), "s1_id")
    kept = chosen.withColumn("nth", F.row_number().over(owner)).where("nth = 1").groupBy("i", "s1_id").agg(F.count("*").alias("n")).groupBy("i").agg(F.count("*").alias("hit"), F.sum("n").alias("links"))
    sizes = entities.agg(F.count("*").alias("all")).crossJoin(pairs.agg(F.count_distinct("s1_id").alias("able")))
    rows = grid.join(F.broadcast(kept), "i", "left").na.fill(0, ["hit", "links"]).crossJoin(F.broadcast(sizes))
    aim = F.greatest(F.lit(0.0), (F.lit(target) - (F.col("all") - F.col("able")) / F.col("all")) / (F.col("able") / F.col("all")))
    rows = rows.select("i", "t", (1 - F.col("hit") / F.col("able")).alias("rate"), (F.col("links") / F.col("all")).alias("links"), aim.alias("aim"))
    ahead = Window.orderBy("i")  # as many rows as steps
    later = rows.withColumns({"next_t": F.lead("t").over(ahead), "next_links": F.lead("links").over(ahead)})
    stop = (
        F.when(F.col("rate") >= F.col("aim"), "target").when(F.col("next_t").isNull() | (F.col("next_t") > most), "most")
        .when(F.col("next_t") > round(start + most_raise, 9), "raise").when(F.col("next_links") < seen_links - 0.2, "links")
    )
    return later.withColumn("reason", stop).where("reason is not null").orderBy("i").limit(1).select("t", "reason", F.round("rate", 6).alias("empty_rate"), F.round("links", 6).alias("mean_links"))


def prune_caps(pairs: DataFrame, entities: DataFrame, caps: tuple[int, ...] = (10, 20, 40, 80, 0), score: str = "milli") -> DataFrame:
    """(cap, candidates, macro_f) where only the `cap` best candidates of an entity by score are kept (0:
    all of them) before the threshold t is applied."""
    grid = pairs.sparkSession.createDataFrame([(c,) for c in caps], "cap int")
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "s23_id"))
    rows = pairs.withColumn("rnk", rank).join(F.broadcast(grid), (F.col("cap") == 0) | (F.col("rnk") <= F.col("cap")))
    n = rows.groupBy("cap").agg(F.count("*").alias("n"))
    f = scored(rows.where(F.col("prob") >= F.col("t")), truth_counts(pairs, entities), ["cap"], grid)
    per = n.crossJoin(F.broadcast(entities.agg(F.count("*").alias("all")))).select("cap", F.round(F.col("n") / F.col("all"), 6).alias("candidates"))
    return f.join(per, "cap").select("cap", "candidates", "macro_f")


def recommended_cap(traded: DataFrame, most: float | None = None, within: float = 5e-5) -> DataFrame:
    """The smallest cap within `within` of the best score, of those with at most `most` candidates an
    entity; no cap (0) counts as the largest."""
    able = traded.where(F.col("candidates") <= most) if most is not None else traded
    top = able.agg(F.max("macro_f").alias("top"))
    near = able.crossJoin(F.broadcast(top)).where(F.col("macro_f") >= F.col("top") - within)
    return near.orderBy(F.when(F.col("cap") == 0, 2**31 - 1).otherwise(F.col("cap"))).limit(1).select("cap", "candidates", "macro_f")


def pruned(pairs: DataFrame, thresholds: DataFrame, score: str = "prob") -> DataFrame:
    """Pairs at or above their country's threshold (thresholds: country, threshold); a country without
    one takes the lowest of all."""
    least = thresholds.agg(F.min("threshold").alias("least"))
    rows = pairs.join(F.broadcast(thresholds.select("country", "threshold")), "country", "left").crossJoin(F.broadcast(least))
    return rows.where(F.col(score) >= F.coalesce("threshold", "least")).drop("threshold", "least")


def score_sets(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, f): F0.5 of sets of ids; both have s1_id and matched. Truth decides which entities count;
    one without prediction predicts nothing."""
    both = truth.select("s1_id", F.col("matched").alias("m")).join(predicted.select("s1_id", F.col("matched").alias("p")), "s1_id", "left")
    p, m = F.array_distinct(F.coalesce("p", F.array().cast("array<string>"))), F.array_distinct("m")
    size = lambda c: F.size(c).cast("double")
    return both.select("s1_id", F.round(E.f_half(size(F.array_intersect(p, m)), size(p), size(m)), 6).alias("f"))


def sample(records: DataFrame, n: int, distractors: int, donor: str, unseen: str = "France", share: float = 0.15) -> DataFrame:
    """A small data set that is as hard as the whole: n S1 entities (first by a hash), the records they
    own, look-alikes by name tokens and some records without owner; with country_test, in which a share of
    the donor country's entities, and the records they own, belong to an unseen country."""
    from ..functions.native import plain, words
    from .learning import share as drawn
    from .retrieval import look_alikes

    s1 = F.startswith("entity_id", F.lit("S1-"))
    chosen = records.where(s1).orderBy(F.md5(F.concat(F.lit("sample"), "entity_id")), "entity_id").limit(n).select("entity_id", "country")
    tokens = records.select("entity_id", s1.alias("s1"), F.explode(F.array_distinct(words(plain(F.col("business_name"))))).alias("token")).where("length(token) >= 2")
    left = tokens.where("s1").join(chosen.select("entity_id"), "entity_id", "left_semi").select(F.col("entity_id").alias("id"), "token")
    alike = look_alikes(left, tokens.where("not s1").select(F.col("entity_id").alias("id"), "token")).select(F.col("s23_id").alias("entity_id"))
    owned = records.join(chosen.select(F.col("entity_id").alias("owner_id")), "owner_id", "left_semi").select("entity_id")
    free = records.where(~s1 & F.col("owner_id").isNull()).orderBy(F.md5(F.concat(F.lit("free"), "entity_id")), "entity_id").limit(distractors).select("entity_id")
    ids = chosen.select("entity_id").union(owned).union(alike).union(free).distinct()
    moved = chosen.where(F.col("country") == donor).withColumn("u", drawn("entity_id", "unseen")).where(F.col("u") < share).select(F.col("entity_id").alias("moved"))
    rows = records.join(ids, "entity_id", "left_semi")
    key = F.coalesce("owner_id", "entity_id")
    return rows.join(moved, key == F.col("moved"), "left").select(*records.columns, F.when(F.col("moved").isNotNull(), unseen).otherwise(F.col("country")).alias("country_test"))

