"""Effect sizes, composition tables, quantile summaries and resampling over probe and control rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def two_level_mean(rows: DataFrame, site: list[str], video: str, clip: str, value: str, label: str) -> DataFrame:
    """Mean of the clip means of each video, so that the number of rows in a clip has no weight."""
    clips = rows.groupBy(*site, video, clip).agg(F.avg(value).alias("m"), F.max(label).alias(label))
    return clips.groupBy(*site, video).agg(F.avg("m").alias("video_mean"), F.max(label).alias(label), F.count("*").alias("clips"))


def hedges_g(videos: DataFrame, by: list[str], value: str, label: str) -> DataFrame:
    """Standardised mean difference with the small-sample correction; null below two rows a class or without variance."""
    c = lambda f, y: f(F.when(F.col(label) == y, F.col(value)))
    s = videos.groupBy(*by).agg(
        c(F.count, 1).alias("n_pos"), c(F.count, 0).alias("n_neg"), c(F.avg, 1).alias("mean_pos"), c(F.avg, 0).alias("mean_neg"), c(F.var_samp, 1).alias("v1"), c(F.var_samp, 0).alias("v0")
    )
    n = F.col("n_pos") + F.col("n_neg")
    pooled = ((F.col("n_pos") - 1) * F.col("v1") + (F.col("n_neg") - 1) * F.col("v0")) / F.when(n > 2, n - 2)
    g = (F.col("mean_pos") - F.col("mean_neg")) / F.sqrt(pooled) * (1 - 3 / (4.0 * n - 9))
    ok = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2) & (pooled > 0)
    return s.select(*by, "n_pos", "n_neg", (F.col("mean_pos") - F.col("mean_neg")).alias("delta"), F.when(ok, g).alias("hedges_g"))


def raw_distribution(videos: DataFrame, by: list[str], value: str, label: str) -> DataFrame:
    """Mean and sample deviation of both classes and the difference of the means."""
    c = lambda f, y: f(F.when(F.col(label) == y, F.col(value)))
    out = videos.groupBy(*by).agg(c(F.avg, 1).alias("mean_pos"), c(F.avg, 0).alias("mean_neg"), c(F.stddev_samp, 1).alias("std_pos"), c(F.stddev_samp, 0).alias("std_neg"))
    return out.withColumn("delta", F.col("mean_pos") - F.col("mean_neg"))


def matched_control(videos: DataFrame, strata: list[str], value: str, label: str, by: list[str]) -> DataFrame:
    """Mean difference within strata that have both classes, weighted by the smaller class; unknown strata stay out."""
    c = lambda f, y: f(F.when(F.col(label) == y, F.col(value)))
    known = [F.col(s).isNotNull() & (F.col(s).cast("string") != "unknown") for s in strata]
    rows = videos
    for k in known:
        rows = rows.filter(k)
    s = rows.groupBy(*by, *strata).agg(c(F.count, 1).alias("p"), c(F.count, 0).alias("n"), (c(F.avg, 1) - c(F.avg, 0)).alias("d")).filter("p > 0 AND n > 0")
    w = F.least("p", "n")
    return s.groupBy(*by).agg((F.sum(w * F.col("d")) / F.sum(w)).alias("matched_delta"), F.sum(w).alias("pairs"), F.count("*").alias("strata"))


def composition(rows: DataFrame, dims: list[str], label: str) -> DataFrame:
    """Rows of each value of each dimension and label: one pass over all dimensions by grouping sets."""
    sets = [[F.col(d), F.col(label)] for d in dims]
    level = sum((F.when(F.grouping(d) == 0, F.lit(i)).otherwise(0) for i, d in enumerate(dims)), F.lit(0))
    g = rows.groupingSets(sets, *dims, label).agg(F.count("*").alias("n"), level.alias("dim"))
    names = F.element_at(F.array(*[F.lit(d) for d in dims]), F.col("dim") + 1)
    return g.select(names.alias("dimension"), F.coalesce(*[F.col(d).cast("string") for d in dims]).alias("value"), label, "n")


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, population deviation, linear percentiles, min and max."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q"))
    return out.select(*by, "n", "mean", "std", "min", "max", *[F.col("q")[i].alias(k) for i, k in enumerate(("p10", "p50", "p90", "p95"))])


def tertile_bins(videos: DataFrame, value: str, fit: Column) -> DataFrame:
    """low, mid or high by the tertiles of the rows where ``fit`` holds; unknown for a null value or fewer than 3 rows."""
    cuts = videos.filter(fit & F.col(value).isNotNull()).agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"), F.count("*").alias("n"))  # one row
    v, q = F.col(value), F.col("q")
    name = F.when(v.isNull() | (F.col("n") < 3), "unknown").when(v <= q[0], "low").when(v <= q[1], "mid").otherwise("high")
    return videos.join(F.broadcast(cuts)).withColumn("bin", name).drop("q", "n")


def time_steps(rows: DataFrame, key: str, time_us: str) -> DataFrame:
    """Seconds that a key's events cover: last minus first plus the median positive step; times in microseconds."""
    step = F.col(time_us) - F.lag(time_us).over(W.partitionBy(key).orderBy(time_us))
    s = rows.select(key, time_us, step.alias("step"))
    return s.groupBy(key).agg(((F.max(time_us) - F.min(time_us) + F.coalesce(F.percentile(F.when(F.col("step") > 0, F.col("step")), 0.5), F.lit(0.0))) / 1e6).alias("seconds"), F.count("*").alias("events"))


def seed_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("seeds"))


def gini(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Gini coefficient of the non-negative values of each key; null if they add up to 0."""
    r = F.row_number().over(W.partitionBy(key).orderBy(value))
    s = rows.select(key, F.col(value).alias("v"), r.alias("r")).groupBy(key).agg(F.sum(F.col("r") * F.col("v")).alias("rv"), F.sum("v").alias("t"), F.count("*").alias("n"))
    return s.select(key, F.when(F.col("t") != 0, 2.0 * F.col("rv") / (F.col("n") * F.col("t")) - (F.col("n") + 1.0) / F.col("n")).alias("gini"))


def decision(point: Column, lower: Column, upper: Column, valid: Column, draws: int, margin: float = -0.005) -> tuple[Column, Column]:
    """Status and non-inferiority at the margin; values within 8 units of the last place of 1 count as the margin.

    NA without a point or with fewer than 99.9 % valid draws.
    """
    snap = lambda x: F.when(F.abs(x - margin) <= 8 * 2.0**-52, F.lit(margin)).otherwise(x)
    ok = point.isNotNull() & (valid >= math.ceil(0.999 * draws))
    verdict = F.when(~ok, "NA").when(snap(lower) >= margin, "supported").when(snap(upper) < margin, "inferior").otherwise("inconclusive")
    return F.when(ok, "available").otherwise("NA"), verdict
