"""Vectors in arrays: norms, cosines, changes along a track, merges; all in built-in array functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def rms(a: str | Column) -> Column:
    return norm(a) / F.sqrt(F.size(_c(a)).cast("double"))


def adjacent_change(rows: DataFrame, key: str, order: str, vec: str) -> DataFrame:
    """1 - cosine to the neighbours of a track: the mean of both sides, one side at an end, null for a single row."""
    w = W.partitionBy(key).orderBy(order)
    back = F.when(F.lag(vec).over(w).isNotNull(), 1 - cosine(vec, F.lag(vec).over(w)))
    d = rows.select(key, order, back.alias("back"))
    ahead = F.lead("back").over(w)
    d = d.withColumn("ahead", ahead)
    return d.select(key, order, F.when(F.col("back").isNull(), F.col("ahead")).when(F.col("ahead").isNull(), F.col("back")).otherwise((F.col("back") + F.col("ahead")) / 2).alias("change"))


def pair_redundancy(rows: DataFrame, key: str, item: str, vec: str, threshold: float) -> DataFrame:
    """Mean cosine of the pairs within each group of bounded size, and the share of pairs at or above the threshold."""
    a = rows.select(key, F.col(item).alias("a"), F.col(vec).alias("va"))
    b = rows.select(key, F.col(item).alias("b"), F.col(vec).alias("vb"))
    pairs = a.join(b, key).filter("a < b").select(key, cosine("va", "vb").alias("cos"))
    return pairs.groupBy(key).agg(F.avg("cos").alias("mean_cos"), F.avg((F.col("cos") >= threshold).cast("double")).alias("redundancy"), F.count("*").alias("pairs"))


def coordinate_redundancy(rows: DataFrame, key: str, frame: str, row: str, col: str, vec: str, threshold: float) -> DataFrame:
    """Cosines of neighbouring tokens: within a frame at distance 1 (right and below), and at the same place of the next frame.

    key, kind (spatial or temporal), pairs, mean_cos, redundancy (share at or above the threshold) and coverage (pairs over those that the key's
    largest grid would have). Neighbours are found by equality of shifted coordinates, so no group's pairs are formed.
    Rows with a null coordinate or vector take no part.
    """
    own = rows.select(*[F.col(c).alias(n) for c, n in ((key, "__k"), (frame, "__f"), (row, "__r"), (col, "__c"), (vec, "__v"))]).dropna(subset=["__f", "__r", "__c", "__v"])
    # each token is asked for by its neighbour to the left, the one above, and the one before
    shifts = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("__f") - f).alias("f"), (F.col("__r") - r).alias("r"), (F.col("__c") - c).alias("c")) for k, f, r, c in (("spatial", 0, 0, 1), ("spatial", 0, 1, 0), ("temporal", 1, 0, 0))])
    asked = own.select(F.col("__k").alias("__ak"), F.col("__v").alias("__w"), F.explode(shifts).alias("s")).select("__ak", "__w", *[F.col(f"s.{c}").alias(f"__a{c}") for c in ("kind", "f", "r", "c")])
    pairs = own.join(asked, [F.col("__k").eqNullSafe(F.col("__ak")), *[F.col(f"__{c}") == F.col(f"__a{c}") for c in "frc"]])
    found = pairs.select("__k", F.col("__akind").alias("kind"), cosine("__v", "__w").alias("cos")).groupBy("__k", "kind").agg(F.count("cos").alias("pairs"), F.avg("cos").alias("mean_cos"), F.avg((F.col("cos") >= threshold).cast("double")).alias("redundancy"))
    size = lambda c: F.max(c) - F.min(c) + 1
    grid = own.groupBy(F.col("__k").alias("__gk")).agg(size("__f").alias("fs"), size("__r").alias("rs"), size("__c").alias("cs"))
    inner = F.col("fs") * (F.col("rs") * (F.col("cs") - 1) + (F.col("rs") - 1) * F.col("cs"))
    most = F.when(F.col("kind") == "spatial", inner).otherwise((F.col("fs") - 1) * F.col("rs") * F.col("cs"))
    return found.join(grid, F.col("__k").eqNullSafe(F.col("__gk"))).select(F.col("__k").alias(key), "kind", "pairs", "mean_cos", "redundancy", (F.col("pairs") / most).alias("coverage"))


def mean_merge(rows: DataFrame, key: str, item: str, vec: str) -> DataFrame:
    """Element-wise mean of the vectors of each key; the smallest item is the anchor."""
    long = rows.select(key, item, F.posexplode(vec).alias("i", "x"))
    per = long.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.min(item).alias("anchor"), F.count("*").alias("members"))
    merged = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.min("anchor").alias("anchor"), F.max("members").alias("members"))
    return merged.select(key, "anchor", "members", F.transform("v", lambda s: s["x"]).alias("merged"))


def gated_merge(rows: DataFrame, key: str, item: str, vec: str, gate: str) -> DataFrame:
    """Weighted mean with the softmax of a gate score over the members of each key."""
    top = rows.withColumn("w", F.exp(F.col(gate) - F.max(gate).over(W.partitionBy(key))))
    long = top.select(key, item, "w", F.posexplode(vec).alias("i", "x"))
    per = long.groupBy(key, "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), F.min(item).alias("anchor"))
    merged = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.min("anchor").alias("anchor"))
    return merged.select(key, "anchor", F.transform("v", lambda s: s["x"]).alias("merged"))


def relative_error(a: str, b: str) -> Column:
    """Sum of squared differences over the sum of squares of b."""
    diff = F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(dot(b, b) > 0, dot(diff, diff) / dot(b, b))


def max_abs_error(a: str, b: str) -> Column:
    return F.array_max(F.zip_with(F.col(a), F.col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def masked_softmax(values: Column, mask: Column) -> Column:
    """Softmax over the entries whose mask is true; 0 elsewhere, all 0 without any."""
    from chronolith.operators.attention import let

    pairs = F.arrays_zip(values.alias("v"), mask.alias("m"))
    top = F.array_max(F.transform(pairs, lambda p: F.when(p["m"], p["v"])))
    e = let(top, lambda t: F.transform(pairs, lambda p: F.when(p["m"], F.exp(p["v"] - t)).otherwise(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return let(e, lambda a: let(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t).otherwise(0.0))))


def effective_rank(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """exp of the entropy of the Gram matrix's eigenvalues, and how many of them hold 90 %; groups are of bounded size."""

    def run(k, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part[vec].to_numpy()).astype(np.float64)
        x = x - x.mean(0)
        e = np.clip(np.linalg.eigvalsh(x @ x.T if len(x) < x.shape[1] else x.T @ x), 0, None)[::-1]
        if e.sum() <= 0:
            return pd.DataFrame([(k[0], 0.0, 0)], columns=[key, "effective_rank", "rank90"])
        p = e / e.sum()
        h = -(p[p > 0] * np.log(p[p > 0])).sum()
        return pd.DataFrame([(k[0], float(np.exp(h)), int(np.searchsorted(np.cumsum(p), 0.9) + 1))], columns=[key, "effective_rank", "rank90"])

    return rows.select(key, vec).groupBy(key).applyInPandas(run, f"{key} long, effective_rank double, rank90 int")


def farthest_fill(rows: DataFrame, key: str, item: str, vec: str, score: str, top: int, quota: int) -> DataFrame:
    """The ``top`` items of the largest score, then up to ``quota`` by largest least cosine distance to those chosen.

    Ties go to the smaller item; groups are of bounded size.
    """

    def run(k, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(item, kind="stable").reset_index(drop=True)
        x = np.stack(part[vec].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        first = list(np.argsort(-part[score].to_numpy(np.float64), kind="stable")[: min(top, quota)])
        away = np.full(len(x), np.inf)
        for i in first:
            away = np.minimum(away, 1 - x @ x[i])
        while len(first) < min(quota, len(x)):
            away[first] = -np.inf
            i = int(np.argmax(away))
            first.append(i)
            away = np.minimum(away, 1 - x @ x[i])
        return pd.DataFrame({key: k[0], item: part[item].iloc[first].to_numpy(), "step": np.arange(len(first))})

    return rows.select(key, item, vec, score).groupBy(key).applyInPandas(run, f"{key} long, {item} long, step long")
