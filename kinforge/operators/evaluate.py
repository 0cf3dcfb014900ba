"""Entity-level evaluation: F0.5 per entity, macro means, threshold sweeps, error decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETA2 = 0.25


def f_half(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 from counts; an entity without true links scores 1 if nothing is predicted, else 0."""
    bottom = (1 + BETA2) * tp + BETA2 * (n_true - tp) + (n_pred - tp)
    scored = F.when(bottom > 0, (1 + BETA2) * tp / bottom).otherwise(0.0)
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).otherwise(scored)


def entity_counts(pairs: DataFrame, entities: DataFrame, truth: DataFrame, weight: Column | None = None) -> DataFrame:
    """Per entity n_true, tp and (weighted) n_pred of selected pairs; entities without pairs are there too.
    truth: (s1_id, s23_id). pairs: s1_id, selected, label."""
    chosen = pairs.where("selected")
    weight = F.lit(1.0) if weight is None else weight
    got = chosen.groupBy("s1_id").agg(F.sum("label").cast("double").alias("tp"), F.sum(F.when(F.col("label") == 1, 1.0).otherwise(weight)).alias("n_pred"))
    true = truth.groupBy("s1_id").agg(F.count("*").cast("double").alias("n_true"))
    rows = entities.join(true, "s1_id", "left").join(got, "s1_id", "left")
    return rows.na.fill(0.0, ["tp", "n_pred", "n_true"])


def macro_f(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean F0.5 over entities, overall or by group."""
    rows = counts.withColumn("f", f_half(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("entities"), F.round(F.avg("f"), 6).alias("macro_f"))


def grid(lo: float = 0.30, hi: float = 0.95, step: float = 0.01) -> list[float]:
    return [round(lo + i * step, 6) for i in range(round((hi - lo) / step) + 1)]


def sweep(pairs: DataFrame, entities: DataFrame, truth: DataFrame, points: list[float], by: str | None = None) -> DataFrame:
    """(t, macro_f) for every threshold of a fixed grid, inclusive, in one pass over the pairs.

    A pair is put into the last grid step it still passes; sums per entity and step are run from the top
    down, so no pair is repeated for each threshold. Entities that change at no step keep their score.
    """
    step = F.size(F.filter(F.array(*[F.lit(t) for t in points]), lambda t: t <= F.col("prob")))
    cells = pairs.withColumn("step", step).where("step > 0").groupBy("s1_id", "step").agg(F.sum("label").alias("tp"), F.count("*").alias("n"))
    down = Window.partitionBy("s1_id").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = cells.select("s1_id", "step", F.sum("tp").over(down).cast("double").alias("tp"), F.sum("n").over(down).cast("double").alias("n"))
    lower = F.coalesce(F.lead("step").over(Window.partitionBy("s1_id").orderBy(F.desc("step"))), F.lit(0))
    true = truth.groupBy("s1_id").agg(F.count("*").cast("double").alias("n_true"))
    base = entities.join(true, "s1_id", "left").na.fill(0.0, ["n_true"])
    keys = [by] if by else []
    # From step `lower` + 1 to `step` an entity scores f; above its highest step it predicts nothing.
    scored = runs.withColumn("lo", lower + 1).join(base, "s1_id")
    scored = scored.withColumn("gain", f_half(F.col("tp"), F.col("n"), F.col("n_true")) - f_half(F.lit(0.0), F.lit(0.0), F.col("n_true")))
    change = scored.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.col("gain").alias("d")), F.struct((F.col("step") + 1).alias("at"), (-F.col("gain")).alias("d")))).alias("c")).groupBy(*keys, "c.at").agg(F.sum("c.d").alias("d"))
    start = base.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(f_half(F.lit(0.0), F.lit(0.0), F.col("n_true"))).alias("f0"))
    steps = start.select("*", F.posexplode(F.array(*[F.lit(t) for t in points])).alias("i", "t")).withColumn("at", F.col("i") + 1)
    rows = steps.join(change, [*keys, "at"], "left").na.fill(0.0, ["d"])
    run = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*keys, "t", F.round((F.col("f0") + F.sum("d").over(run)) / F.col("n"), 6).alias("macro_f"))


def best_threshold(swept: DataFrame, by: str | None = None) -> DataFrame:
    """The best threshold (of equals the lowest), overall or per group."""
    keys = [by] if by else []
    best = swept.groupBy(*keys).agg(F.min_by(F.struct("t", "macro_f"), F.struct((-F.col("macro_f")).alias("f"), F.col("t"))).alias("b"))
    return best.select(*keys, "b.t", "b.macro_f")


def decompose(counts: DataFrame) -> DataFrame:
    """Seven kinds of entities: counts and share of lost F."""
    tp, n, m = F.col("tp"), F.col("n_pred"), F.col("n_true")
    kind = (
        F.when((m == 0) & (n == 0), "singleton_right").when(m == 0, "singleton_wrong").when(n == 0, "missed_all")
        .when((tp == m) & (n == tp), "exact").when(tp == 0, "all_wrong").when(n == tp, "missing_some").otherwise("extra")
    )
    rows = counts.withColumn("kind", kind).withColumn("lost", 1 - f_half(tp, n, m))
    return rows.groupBy("kind").agg(F.count("*").alias("entities"), F.round(F.sum("lost"), 4).alias("lost"))


def false_positives(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Wrong selections by cause: a distractor, or a record that another entity owns."""
    wrong = pairs.where("selected and label = 0").join(owners.select("s23_id", "owner_id"), "s23_id", "left")
    return wrong.groupBy(F.when(F.col("owner_id").isNull(), "distractor").otherwise("owned_by_other").alias("cause")).agg(F.count("*").alias("n"))


def guardrails(pairs: DataFrame, entities: DataFrame, empty: tuple[float, float] = (0.040, 0.085), links: tuple[float, float] = (3.0, 3.8)) -> DataFrame:
    """Per country: share of empty entities, mean and largest number of links, and flags for both ranges."""
    n = pairs.where("selected").groupBy("s1_id").agg(F.count("*").alias("n"))
    rows = entities.join(n, "s1_id", "left").na.fill(0, ["n"])
    out = rows.groupBy("country").agg(F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("empty_rate"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 6).alias("mean_links"), F.max("n").alias("max_links"))
    return out.withColumn("empty_flag", ~F.col("empty_rate").between(*empty)).withColumn("links_flag", ~F.coalesce(F.col("mean_links"), F.lit(0.0)).between(*links))
