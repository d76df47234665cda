"""Ranking and supervised losses over bags of scores, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def regularizers(rows: DataFrame, bag: str, order: str, score: str) -> DataFrame:
    """Per bag: squared steps between neighbours, absolute scores, their numbers, and the largest score."""
    step = F.lead(score).over(W.partitionBy(bag).orderBy(order)) - F.col(score)
    return rows.select(bag, score, step.alias("step")).groupBy(bag).agg(F.coalesce(F.sum(F.col("step") * F.col("step")), F.lit(0)).alias("smooth"), F.sum(F.abs(score)).alias("sparse"), F.count("*").alias("n"), F.max(score).alias("bag_max"))


def ranking_loss_all_pairs(bags: DataFrame, label: str, bag_max: str, margin: float) -> DataFrame:
    """Mean of max(0, margin - positive + negative) over all pairs of bags of either label.

    Bags are reduced to their distinct maxima with counts, and pairs follow from running sums over the sorted maxima
    of both labels: the hinge is linear above its kink, so no pair is formed.
    """
    from chronolith.operators.metrics import running

    both = bags.select(F.when(F.col(label) > 0, F.col(bag_max) - margin).otherwise(F.col(bag_max)).alias("v"), (F.col(label) > 0).cast("long").alias("pos"), (F.col(label) == 0).cast("long").alias("neg"))
    g = both.groupBy("v").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * F.col("v")).alias("nv"))
    r = running(g, "v", {"n_above": "n", "v_above": "nv"}, descending=True)
    return r.agg((F.sum(F.col("p") * (F.col("v_above") - F.col("n_above") * F.col("v"))) / (F.sum("p").cast("double") * F.sum("n"))).alias("loss"))


def ranking_loss_cyclic(bags: DataFrame, key: str, label: str, bag_max: str, margin: float) -> DataFrame:
    """Mean hinge when the i-th positive meets the i-th negative bag, the shorter list starting over.

    Null and 0 pairs where either list is empty.
    """
    from chronolith.operators.selection import number_parts, numbered

    own = bags.filter(F.col(label) >= 0).select(key, (F.col(label) > 0).alias("positive"), F.col(bag_max).alias("m"))
    n = own.agg(F.count(F.when(F.col("positive"), 1)).alias("np"), F.count(F.when(~F.col("positive"), 1)).alias("nn"))
    r = numbered(own, "positive", number_parts(own, key), [key]).join(F.broadcast(n))
    longer = F.col("positive") == (F.col("np") >= F.col("nn"))
    a = r.filter(longer).select((F.col("i") % F.greatest(F.lit(1), F.least("np", "nn"))).alias("j"), F.col("positive"), F.col("m").alias("a"))
    b = r.filter(~longer).select(F.col("i").alias("j"), F.col("m").alias("b"))
    gap = F.when(F.col("positive"), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    return a.join(b, "j").agg(F.avg(F.greatest(F.lit(0.0), margin + gap)).alias("loss"), F.count("*").alias("pairs"))


def bce_focal(logit: Column, target: Column, positive_weight: float = 1.0, gamma: float = 0.0) -> Column:
    """Binary cross-entropy of a logit, weighted for positives and, with gamma, by how wrong it is."""
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    loss = F.when(target > 0, positive_weight * softplus(-logit)).otherwise(softplus(logit))
    if not gamma:
        return loss
    p = 1 / (1 + F.exp(-logit))
    return loss * F.pow(F.when(target > 0, 1 - p).otherwise(p), F.lit(gamma))


def accumulate_epochs(batches: DataFrame, epoch: str, loss: str, size: str) -> DataFrame:
    """Batches, samples and the mean loss of each epoch, where a batch counts by its size."""
    return batches.groupBy(epoch).agg(F.count("*").alias("batches"), F.sum(size).alias("samples"), (F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("loss"))
