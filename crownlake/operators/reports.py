"""Tables behind the plots: statistics by class, histograms, quartiles, suspicious clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def melted(features: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """keep, feature, value."""
    return features.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("value")) for n in names))).alias("_f")).select(*keep, "_f.*")


def class_statistics(features: DataFrame, names: list[str], label: str) -> DataFrame:
    """feature, label, n, mean, std (population), min, max."""
    return melted(features, names, [label]).groupBy("feature", label).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def histograms(features: DataFrame, names: list[str], label: str, bins: int = 25) -> DataFrame:
    """feature, label, bin (from 0), n, density: equal bins over the range of all labels together."""
    rows = melted(features, names, [label]).filter(c("value").isNotNull())
    span = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    size = rows.groupBy("feature", label).agg(F.count("*").alias("total"))
    at = F.least(F.lit(bins - 1), F.floor((c("value") - c("lo")) / F.when(c("hi") > c("lo"), (c("hi") - c("lo")) / bins)))
    n = rows.join(F.broadcast(span), "feature").withColumn("bin", F.coalesce(at, F.lit(0))).groupBy("feature", label, "bin").agg(F.count("*").alias("n"), F.first((c("hi") - c("lo")) / bins).alias("_w"))
    return n.join(size, ["feature", label]).select("feature", label, "bin", "n", F.try_divide(c("n"), c("total") * c("_w")).alias("density"))


def quartiles(features: DataFrame, names: list[str], label: str) -> DataFrame:
    """feature, label, q1, median, q3."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return melted(features, names, [label]).groupBy("feature", label).agg(q.alias("_q")).select("feature", label, c("_q")[0].alias("q1"), c("_q")[1].alias("median"), c("_q")[2].alias("q3"))


def suspicious(features: DataFrame, key: str = "file", *, few: int = 20, low: float = 0.5, ratio: str = "height_to_radius", tail: float = 0.99) -> DataFrame:
    """key, reason: clusters of few points, of small height, or with a ratio over its high percentile."""
    limit = features.agg(F.percentile(ratio, F.lit(tail)).alias("_limit"))
    both = features.join(F.broadcast(limit))
    reason = F.array_compact(F.array(F.when(c("n_points") < few, "few_points"), F.when(c("height") < low, "low"), F.when(c(ratio) > c("_limit"), "ratio")))
    return both.select(key, F.explode(reason).alias("reason"))
