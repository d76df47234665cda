"""Attention statistics and pooling over ragged rows of scores, in array functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_sum = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, f) -> Column:
    """f of a value that is worked out once; in a lambda, an outer expression would be worked out for each element."""
    return F.transform(F.array(value), f)[0]


def softmax(scores: Column) -> Column:
    shifted = let(scores, lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
    return let(shifted, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def entropy(p: Column) -> Column:
    """Entropy over its maximum; 0 for a single entry."""
    h = -_sum(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))
    return F.when(F.size(p) > 1, h / F.log(F.size(p).cast("double"))).otherwise(0.0)


def top_mass(p: Column, k: int) -> Column:
    return _sum(F.slice(F.sort_array(p, asc=False), 1, k))


def class_row(p: Column, at: int) -> Column:
    """A class token's weights over the other positions, made to add up to 1; null if they add up to 0 or there are none.

    ``at`` is the class token's position; ``p`` the row of weights of its query.
    """
    rest = F.filter(p, lambda x, i: i != at)
    return let(rest, lambda r: let(_sum(r), lambda total: F.when(total > 0, F.transform(r, lambda x: x / total))))


def incoming(rows: DataFrame, key: str, weights: str, k: int = 4) -> DataFrame:
    """What the keys of each attention matrix receive: entropy over its maximum, mass of the top ``k``, and Gini coefficient.

    A row is a query's weights, which add up to 1; all queries of a key have one length. What a key position receives is
    its mean over the queries, summed before the shuffle. One position gives entropy 0. Rows that are null, empty, or hold
    null, negative or non-finite weights, or add up to other than 1 by over 0.002, take no part; nor do keys without others.
    """
    ok = F.forall(weights, lambda x: F.coalesce((x >= 0) & ~F.isnan(x) & (x != float("inf")), F.lit(False)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x.cast("double"))
    cells = rows.filter(F.coalesce((F.size(weights) > 0) & ok & (F.abs(total - 1) <= 0.002), F.lit(False))).select(key, F.posexplode(weights).alias("pos", "x"))
    mean = cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # positions are ordered by what they receive once, which gives the top and the ranks of the Gini coefficient
    w = W.partitionBy(key)
    placed = mean.select(key, "x", F.row_number().over(w.orderBy("x", "pos")).alias("r"), F.count("*").over(w).alias("m"))
    x, r, m = F.col("x"), F.col("r"), F.col("m")
    sums = placed.groupBy(key).agg(F.max("m").alias("m"), (-F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0))).alias("h"), F.sum(F.when(r > m - k, x)).alias("top"), F.sum(r * x).alias("rx"), F.sum(x).alias("t"))
    entropy = F.when(m > 1, F.col("h") / F.log(m.cast("double"))).otherwise(0.0)
    return sums.select(key, entropy.alias("incoming_entropy"), F.col("top").alias("incoming_top"), (2.0 * F.col("rx") / (m * F.col("t")) - (m + 1.0) / m).alias("incoming_gini"))


def bag_attention(rows: DataFrame, bag: str, item: str, score: str, value: str, temperature: float = 1.0) -> DataFrame:
    """Softmax-weighted mean of a value over each bag, its largest weight, and the normalised entropy of the weights."""
    w = W.partitionBy(bag)
    s = F.col(score).cast("double") / temperature
    e = rows.select(bag, F.exp(s - F.max(s).over(w)).alias("e"), F.col(value).cast("double").alias("v"))
    e = e.withColumn("p", F.col("e") / F.sum("e").over(w))
    h = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))
    return e.groupBy(bag).agg(F.sum(F.col("p") * F.col("v")).alias("pooled"), F.max("p").alias("top"), F.when(F.count("*") > 1, h / F.log(F.count("*").cast("double"))).otherwise(0.0).alias("entropy"))


#: Positions of a block of ``distance_kernel``: a step over it weighs exp(-256 / e), 1e-41.
KERNEL_BLOCK = 256


def distance_kernel(rows: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Mean of the values weighted by exp(-|i - j| / e) over all positions j of the key.

    A scan each way: within blocks of positions by running sums, and what earlier and later blocks add from their own
    sums. Blocks further off than the next weigh less than 1e-41 of a position's own value, below any digit of a double, so a
    position needs three blocks. Null positions and values take no part.
    """
    e = math.e
    own = rows.filter(F.col(position).isNotNull() & F.col(value).isNotNull()).select(key, position, F.col(value).cast("double").alias("v"), F.floor(F.col(position) / KERNEL_BLOCK).alias("b"))
    at = F.col(position) - F.col("b") * KERNEL_BLOCK  # 0 to 255: exp(256 / e) is 1e41, well inside a double
    up, down = F.exp(at / e), F.exp(-at / e)
    w = W.partitionBy(key, "b").orderBy(position)
    before, after = w.rangeBetween(W.unboundedPreceding, 0), w.rangeBetween(1, W.unboundedFollowing)
    part = lambda x: down * F.sum(x * up).over(before) + up * F.coalesce(F.sum(x * down).over(after), F.lit(0.0))
    inner = own.select(key, position, "b", at.alias("at"), part(F.col("v")).alias("s"), part(F.lit(1.0)).alias("n"))
    # a block's sum as seen from its next block's start, and from its previous block's last position
    sums = own.groupBy(key, "b").agg(*[F.sum(x * f).alias(name) for name, x, f in (("sa", F.col("v"), F.exp((at - KERNEL_BLOCK) / e)), ("na", F.lit(1.0), F.exp((at - KERNEL_BLOCK) / e)), ("sb", F.col("v"), F.exp(-(at + 1) / e)), ("nb", F.lit(1.0), F.exp(-(at + 1) / e)))])
    left = sums.select(F.col(key).alias("lk"), (F.col("b") + 1).alias("lb"), "sa", "na")
    right = sums.select(F.col(key).alias("rk"), (F.col("b") - 1).alias("rb"), "sb", "nb")
    j = inner.join(left, F.col(key).eqNullSafe(F.col("lk")) & (F.col("b") == F.col("lb")), "left").join(right, F.col(key).eqNullSafe(F.col("rk")) & (F.col("b") == F.col("rb")), "left")
    fall, rise, none = F.exp(-F.col("at") / e), F.exp((F.col("at") - (KERNEL_BLOCK - 1)) / e), F.lit(0.0)
    add = lambda c, a, b: F.col(c) + F.coalesce(F.col(a) * fall, none) + F.coalesce(F.col(b) * rise, none)
    return j.select(key, position, (add("s", "sa", "sb") / add("n", "na", "nb")).alias("smoothed"))
