"""Learned tables and training operators: vocabulary, transliteration, extra-token rates, splits,
sampling, masking, boosted models, isotonic calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig

CONFIG = EngineConfig()


def share(column: str, salt: str = "") -> Column:
    """A number in [0, 1) from an id: the first 32 bits of its MD5. Stable on every engine and retry."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(column))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def vocabulary(tokens: DataFrame, least: int = 2) -> DataFrame:
    """(token, logp) of tokens of two letters or more that occur `least` times; the total counts all."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    kept = counts.where((F.length("token") >= 2) & (F.col("n") >= least))
    return kept.crossJoin(F.broadcast(total)).select("token", F.round(F.log(F.col("n") / F.col("total")), 9).alias("logp"))


def modal_partner(pairs: DataFrame, least: int = 2, purity: float = 0.5) -> DataFrame:
    """(k, y, n, share): each key's most frequent partner, if seen `least` times with that share; ties go
    to the smaller partner. What transliteration tables are learned with."""
    counts = pairs.groupBy("k", "y").agg(F.count("*").alias("n"))
    w = Window.partitionBy("k")
    best = counts.withColumns({"nth": F.row_number().over(w.orderBy(F.desc("n"), "y")), "share": F.round(F.col("n") / F.sum("n").over(w), 6)})
    return best.where((F.col("nth") == 1) & (F.col("n") >= least) & (F.col("share") >= purity)).drop("nth")


def token_rates(extra: DataFrame, alpha: float = CONFIG.smoothing, least: int = 20) -> DataFrame:
    """(token, n, rate): smoothed P(true) of extra tokens. extra: s1_id, s23_id, label, token; the prior is
    the share of true pairs among pairs that have extra tokens."""
    prior = extra.select("s1_id", "s23_id", "label").distinct().agg(F.avg("label").alias("prior"))
    counts = extra.groupBy("token").agg(F.count("*").alias("n"), F.sum("label").alias("n_true")).where(F.col("n") >= least)
    rate = (F.col("n_true") + alpha * F.col("prior")) / (F.col("n") + alpha)
    return counts.crossJoin(F.broadcast(prior)).select("token", "n", F.round(rate, 6).alias("rate"))


def entity_split(entities: DataFrame, train: float = 0.6, stats: float = 0.15, val: float = 0.25, salt: str = "split") -> DataFrame:
    """Adds split: 1 train, 2 stats, 3 val, by the id's hash; disjoint, and independent of other rows."""
    u = share("s1_id", salt)
    return entities.withColumn("split", F.when(u < train, 1).when(u < train + stats, 2).when(u < train + stats + val, 3).otherwise(0))


def leave_one_out(entities: DataFrame, country: str, holdout: float = 0.1) -> DataFrame:
    """Train on the other countries but for a holdout; validate on `country`."""
    return entities.withColumn("split", F.when(F.col("country") == country, 3).when(share("s1_id", "loco") < holdout, 2).otherwise(1))


def subsample(pairs: DataFrame, hard: int = CONFIG.hard_ranks, keep: float = CONFIG.easy_share) -> DataFrame:
    """Keeps true pairs and hard ranks; of the rest a hashed share, weighted by its inverse."""
    rows = pairs.withColumn("_key", F.concat("s1_id", F.lit("|"), "s23_id"))
    must = (F.col("label") == 1) | (F.col("fused_rank") < hard)
    return rows.withColumn("weight", F.when(must, 1.0).otherwise(1 / keep)).where(must | (share("_key", "neg") < keep)).drop("_key")


def masked(pairs: DataFrame, prior: float, fraction: float = CONFIG.mask_share) -> DataFrame:
    """A hashed fraction of pairs with extra tokens forgets what is known of them."""
    hit = (F.col("x_extra_cnt") > 0) & (share("s23_id", "mask") < fraction)
    return pairs.withColumns({c: F.when(hit, prior).otherwise(F.col(c)) for c in ("x_extra_min", "x_extra_mean")} | {"x_extra_known": F.when(hit, 0.0).otherwise(F.col("x_extra_known"))})


def macro_weights(pairs: DataFrame) -> DataFrame:
    """Adds macro_weight: true pairs weigh one over their entity's number of true pairs."""
    n = F.sum("label").over(Window.partitionBy("s1_id"))
    return pairs.withColumn("macro_weight", F.when(F.col("label") == 1, 1.0 / n).otherwise(1.0))


def positive_quantile(pairs: DataFrame, lose: float = 0.001, by: str = "country", score: str = "prob") -> DataFrame:
    """(group, threshold): the exact quantile of true pairs' scores that loses this share of them."""
    return pairs.where("label = 1").groupBy(by).agg(F.round(F.percentile(score, F.lit(lose)), 9).alias("threshold"))


def log_loss(pairs: DataFrame, by: str, score: str = "prob", clip: float = 1e-6) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    return pairs.groupBy(by).agg(F.round(-F.avg(F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))), 6).alias("log_loss"))


def auc(pairs: DataFrame, by: str, score: str = "prob") -> DataFrame:
    """Exact ROC AUC from sums per distinct score: no sort of all pairs, ties count half."""
    cells = pairs.groupBy(by, score).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cells.withColumn("won", F.col("pos") * (below + F.col("neg") / 2.0))
    return rows.groupBy(by).agg(F.round(F.sum("won") / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def train_boosted(pairs: DataFrame, features: list[str], weight: str | None = None, depth: int = 5, rounds: int = 20, seed: int = 7):
    """A gradient-boosted classifier over assembled features (Spark ML pipeline model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxDepth=depth, maxIter=rounds, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(pairs)


def train_forest(pairs: DataFrame, features: list[str], trees: int = 30, depth: int = 8, seed: int = 7):
    """The second model of the ensemble."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), forest]).fit(pairs)


def scored(model, pairs: DataFrame, out: str) -> DataFrame:
    """Adds the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(pairs).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def isotonic_knots(pairs: DataFrame, country: str, score: str = "prob"):
    """(x, y) knots of an isotonic fit of labels on scores, for one country."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=score, labelCol="label").fit(pairs.where(F.col("country") == country).select(score, F.col("label").cast("double").alias("label")))
    return list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))


def interpolate(score: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear value at a score, flat beyond the ends, clipped to [0, 1]."""
    xs = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in knots])
    low = F.try_element_at(F.filter(xs, lambda k: k["x"] <= score), F.lit(-1))
    high = F.try_element_at(F.filter(xs, lambda k: k["x"] > score), F.lit(1))
    value = F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(low["y"] + (high["y"] - low["y"]) * (score - low["x"]) / (high["x"] - low["x"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def calibrated(pairs: DataFrame, knots: dict[str, list[tuple[float, float]]], score: str = "prob", out: str = "calibrated") -> DataFrame:
    """Scores through their country's knots; a country without any gets the mean of all calibrators."""
    curves = {c: interpolate(F.col(score), k) for c, k in knots.items()}
    mean = sum(curves.values(), F.lit(0.0)) / len(curves)
    value = mean
    for c, v in curves.items():
        value = F.when(F.col("country") == c, v).otherwise(value)
    return pairs.withColumn(out, value)
