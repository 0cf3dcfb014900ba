"""The decision layer: from pair probabilities to match sets, as window plans.

Pairs have s1_id, s23_id, prob and, where named, grp (country, or country|noaddr). Orders are total:
probability descending, then id. Selections are a boolean column, so rules can follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig

CONFIG = EngineConfig()


def per_entity():
    return Window.partitionBy("s1_id")


def by_rank():
    return per_entity().orderBy(F.desc("prob"), "s23_id")


def ranked(pairs: DataFrame) -> DataFrame:
    """Adds rnk: place in the entity by probability, from 0."""
    return pairs.withColumn("rnk", F.row_number().over(by_rank()) - 1)


def groups(pairs: DataFrame, per_bin: bool = True) -> DataFrame:
    """Adds grp: the country, or country|noaddr for records without address."""
    bare = F.concat(F.col("country"), F.lit("|noaddr"))
    return pairs.withColumn("grp", F.when(F.col("addr_empty"), bare).otherwise(F.col("country")) if per_bin else F.col("country"))


def with_threshold(pairs: DataFrame, thresholds: DataFrame, default: float = CONFIG.default_threshold) -> DataFrame:
    """Adds t: the group's threshold (thresholds: grp, t; one row per group), or the default."""
    return pairs.join(F.broadcast(thresholds), "grp", "left").withColumn("t", F.coalesce("t", F.lit(default)))


def by_threshold(pairs: DataFrame, thresholds: DataFrame, default: float = CONFIG.default_threshold) -> DataFrame:
    """selected: prob >= threshold of the group, inclusive."""
    return with_threshold(pairs, thresholds, default).withColumn("selected", F.col("prob") >= F.col("t"))


def expected_f(pairs: DataFrame, min_prob: float = CONFIG.min_prob) -> DataFrame:
    """selected: the prefix that maximises expected F0.5, if it beats the empty set strictly."""
    running = by_rank().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pairs.withColumns({"j": F.row_number().over(by_rank()), "tp": F.sum("prob").over(running), "total": F.sum("prob").over(per_entity()), "none": F.sum(F.log(F.greatest(1 - F.col("prob"), F.lit(1e-12)))).over(per_entity())})
    gain = 1.25 * F.col("tp")
    rows = rows.withColumn("ef", gain / (gain + 0.25 * (F.col("total") - F.col("tp")) + (F.col("j") - F.col("tp"))))
    rows = rows.withColumn("best", F.max("ef").over(per_entity()))
    rows = rows.withColumn("stop", F.min(F.when(F.col("ef") == F.col("best"), F.col("j"))).over(per_entity()))
    chosen = (F.col("best") > F.exp("none")) & (F.col("j") <= F.col("stop")) & (F.col("prob") >= min_prob)
    return rows.withColumn("selected", chosen).drop("j", "tp", "total", "none", "ef", "best", "stop")


def one_owner(pairs: DataFrame) -> DataFrame:
    """selected stays with the most probable of an S2/S3 record's selected owners (ties: first s1_id)."""
    w = Window.partitionBy("s23_id", "selected").orderBy(F.desc("prob"), "s1_id")
    return pairs.withColumn("_nth", F.row_number().over(w)).withColumn("selected", F.col("selected") & (F.col("_nth") == 1)).drop("_nth")


def rank_ladder(pairs: DataFrame, deltas: tuple[float, float, float] = CONFIG.ladder, max_links: int = 0, certain: float = CONFIG.certain) -> DataFrame:
    """selected by a threshold that moves with the rank: the first needs t; rank r >= 1 needs an anchored
    entity (any pair at its own t) and t + delta[min(r, 3)]. With max_links, ranks from there on need `certain`."""
    rows = ranked(pairs)
    rows = rows.withColumn("_hit", F.col("prob") >= F.col("t"))
    rows = rows.withColumn("_anchored", F.bool_or("_hit").over(per_entity()))
    delta = F.when(F.col("rnk") == 1, deltas[0]).when(F.col("rnk") == 2, deltas[1]).otherwise(deltas[2])
    chosen = F.when(F.col("rnk") == 0, F.col("_hit")).otherwise(F.col("_anchored") & (F.col("prob") >= F.col("t") + delta))
    if max_links:
        chosen = chosen & ((F.col("rnk") < max_links) | (F.col("prob") >= certain))
    return rows.withColumn("selected", chosen).drop("_hit", "_anchored", "rnk")


def size_adaptive(pairs: DataFrame, floor: float, relax: bool = False) -> DataFrame:
    """Tighten: all but the first need floor. Relax: entities with a selection take all pairs at floor."""
    if relax:
        anchored = F.bool_or("selected").over(per_entity())
        return pairs.withColumn("selected", F.col("selected") | (anchored & (F.col("prob") >= floor)))
    return ranked(pairs).withColumn("selected", F.col("selected") & ((F.col("rnk") == 0) | (F.col("prob") >= floor))).drop("rnk")


def rescue(pairs: DataFrame, thresholds: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """Adds pairs of records without address: the record's top claimant, alone or leading by rescue_lead,
    at the country's rescue threshold (no threshold: none), where fewer than rescue_links are accepted."""
    claim = F.col("addr_empty") & (F.col("prob") >= config.rescue_prob)
    claims = Window.partitionBy("s23_id", "_claim").orderBy(F.desc("prob"), "s1_id")
    rows = pairs.join(F.broadcast(thresholds.select("country", F.col("t").alias("_rt"))), "country", "left").withColumn("_claim", claim)
    rows = rows.withColumns({"_nth": F.row_number().over(claims), "_next": F.lead("prob").over(claims), "_accepted": F.count_if("selected").over(per_entity())})
    leads = F.col("_next").isNull() | (F.round(F.col("prob") - F.col("_next"), 9) >= config.rescue_lead)
    saved = F.col("_claim") & (F.col("_nth") == 1) & leads & F.coalesce(F.col("prob") >= F.col("_rt"), F.lit(False)) & ~F.col("selected") & (F.col("_accepted") < config.rescue_links)
    return rows.withColumn("rescued", saved).withColumn("selected", F.col("selected") | F.col("rescued")).drop("_rt", "_claim", "_nth", "_next", "_accepted")


def street_support(pairs: DataFrame, at: int = 75, unsupported: tuple[int, ...] = (7, 8, 9)) -> DataFrame:
    """If any selected pair of an entity has street similarity and no contradicting number, selected
    pairs without both go."""
    good = (F.col("st_tset") >= at) & ~F.col("num_first_rel").isin(*unsupported)
    anyone = F.bool_or(F.col("selected") & good).over(per_entity())
    return pairs.withColumn("selected", F.col("selected") & (~anyone | good))


def decide(pairs: DataFrame, thresholds: DataFrame, mode: str = "threshold", deltas: tuple[float, float, float] | None = None, max_links: int = 0, floor: float | None = None, rescue_thresholds: DataFrame | None = None, config: EngineConfig = CONFIG) -> DataFrame:
    """Mode rule, then rescue, then one owner per record."""
    if mode == "expected_f":
        rows = with_threshold(expected_f(pairs, config.min_prob), thresholds, config.default_threshold)
        rows = size_adaptive(rows, floor) if floor is not None else rows
    elif deltas or max_links:
        rows = rank_ladder(with_threshold(pairs, thresholds, config.default_threshold), deltas or (0.0, 0.0, 0.0), max_links, config.certain)
    else:
        rows = by_threshold(pairs, thresholds, config.default_threshold)
    if rescue_thresholds is not None:
        rows = rescue(rows, rescue_thresholds, config)
    return one_owner(rows)


def calibrate_unseen(pairs: DataFrame, entities: DataFrame, target: float, start: float, step: float = 0.005, most: float = 0.25) -> DataFrame:
    """(steps, t, empty_rate): the threshold is raised by `step` while the share of entities left empty is
    below target. Each entity is reduced to its highest probability; then one aggregation answers the
    whole grid, whose size is fixed."""
    n = round(most / step)
    top = entities.select("s1_id").join(pairs.groupBy("s1_id").agg(F.max("prob").alias("top")), "s1_id", "left").select(F.coalesce("top", F.lit(0.0)).alias("top"))
    at = lambda i: round(start + i * step, 9)
    sums = top.agg(F.count("*").alias("all"), *[F.count_if(F.col("top") < at(i)).alias(f"e{i}") for i in range(n + 1)])
    grid = sums.select("all", F.explode(F.array(*[F.struct(F.lit(i).alias("steps"), F.lit(at(i)).alias("t"), F.col(f"e{i}").alias("empty")) for i in range(n + 1)])).alias("g"))
    rate = F.col("g.empty") / F.col("all")
    reached = grid.select("g.steps", "g.t", F.round(rate, 6).alias("empty_rate"), ((rate >= target) | (F.col("g.steps") == n)).alias("_done"))
    return reached.where("_done").orderBy("steps").limit(1).drop("_done")


def combine(pairs: DataFrame, models: dict[str, float], how: str = "mean") -> DataFrame:
    """Adds prob from columns of models: mean with weights renormalised over those that are there, or the least."""
    if how == "min":
        return pairs.withColumn("prob", F.least(*[F.col(m) for m in models]) if len(models) > 1 else F.col(next(iter(models))))
    total = sum((F.when(F.col(m).isNotNull(), w).otherwise(0.0) for m, w in models.items()), F.lit(0.0))
    return pairs.withColumn("prob", sum((F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in models.items()), F.lit(0.0)) / total)


def match_sets(pairs: DataFrame, entities: DataFrame, selected: Column | None = None) -> DataFrame:
    """(s1_id, matched): sorted, distinct ids, one row for every entity."""
    chosen = pairs.where(F.col("selected") if selected is None else selected).groupBy("s1_id").agg(F.sort_array(F.collect_set("s23_id")).alias("m"))
    return entities.select("s1_id").join(chosen, "s1_id", "left").select("s1_id", F.coalesce("m", F.array().cast("array<string>")).alias("matched"))
