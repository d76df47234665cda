"""Top-k, quotas, pair choices and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def round_half_up(x: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(x + 0.5)).cast("long")


def topk_mean(rows: DataFrame, bag: str, item: str, score: str, k: int | None = None, ratio: float | None = None) -> DataFrame:
    """Mean of the k largest scores of each bag, or of the given share of it (rounded up, at least one)."""
    n = F.count("*").over(W.partitionBy(bag))
    want = F.lit(k) if k is not None else F.greatest(F.lit(1), F.ceil(n * F.lit(ratio)))
    ranked = rows.select(bag, score, F.row_number().over(W.partitionBy(bag).orderBy(F.col(score).desc(), item)).alias("rn"), want.alias("want")).filter("rn <= want")
    return ranked.groupBy(bag).agg(F.avg(score).alias("topk_mean"), F.count("*").alias("used"), F.max(score).alias("bag_max"))


def group_quotas(slots: DataFrame, key: str, count: str, ratio: float, size: int = 10) -> DataFrame:
    """Quota of each group of ``size`` slots, the rest forming a smaller last group."""
    g = slots.select(key, count, F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / size).cast("int") - 1)).alias("group_index"))
    own = F.least(F.lit(size), F.col(count) - F.col("group_index") * size)
    return g.select(key, F.col("group_index").cast("long").alias("group_index"), own.cast("long").alias("slots"), round_half_up(own * ratio).alias("quota"))


def snap_quotas(quotas: DataFrame, key: str, order: str, quota: str, width: int) -> DataFrame:
    """Quotas cut from the last group backwards until their sum is a multiple of the width."""
    w = W.partitionBy(key)
    extra = F.sum(quota).over(w) % width
    later = F.coalesce(F.sum(quota).over(w.orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    q = quotas.withColumns({"extra": extra, "later": later})
    cut = F.greatest(F.lit(0), F.least(F.col(quota), F.col("extra") - F.col("later")))
    return q.select(key, order, quota, (F.col(quota) - cut).cast("long").alias("snapped"))


def pair_choice(rows: DataFrame, group: str, pair: str, item: str, score: str, quota: int, rule: str) -> DataFrame:
    """``quota`` items of each group from pairs ordered by their largest score.

    The better (``high``), worse (``low``) or ``first`` member of each pair comes before the others; ties go to the
    smaller item.
    """
    inside = {"high": [F.col(score).desc(), F.col(item)], "low": [F.col(score).asc(), F.col(item)], "first": [F.col(item)]}[rule]
    r = rows.withColumns({"member": F.row_number().over(W.partitionBy(group, pair).orderBy(*inside)), "best": F.max(score).over(W.partitionBy(group, pair))})
    order = F.row_number().over(W.partitionBy(group).orderBy("member", F.col("best").desc(), pair, item))
    return r.withColumn("ordinal", order).filter(F.col("ordinal") <= quota).select(group, pair, item, F.col("ordinal").cast("long").alias("ordinal"))


def budget_choice(rows: DataFrame, group: str, item: str, score: str, budget: int, strategy: str, seed: str = "7") -> DataFrame:
    """``budget`` items of each group: score_high, score_low, seeded (by hash) or uniform (evenly by item)."""
    w = W.partitionBy(group)
    if strategy == "uniform":
        r = rows.withColumns({"i": F.row_number().over(w.orderBy(item)) - 1, "n": F.count("*").over(w)})
        # item i is taken if an even position falls on it
        steps = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda k: F.floor(k * (F.col("n") - 1) / F.lit(max(budget - 1, 1))))
        return r.filter((F.col("n") <= budget) | F.array_contains(steps, F.col("i").cast("long"))).select(group, item)
    order = {"score_high": [F.col(score).desc(), F.col(item)], "score_low": [F.col(score), F.col(item)], "seeded": [seeded(seed, item), F.col(item)]}[strategy]
    return rows.withColumn("rn", F.row_number().over(w.orderBy(*order))).filter(F.col("rn") <= budget).select(group, item)


def seeded(seed: str, item: str) -> Column:
    """A stable pseudo-random order: SHA-256 of the seed, a zero character and the item."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(item).cast("string")).cast("binary"), 256)


def numbered(rows: DataFrame, by: str, part: Column, order: list) -> DataFrame:
    """``rows`` with ``i``, their number from 0 within ``by``, and ``n``, how many there are.

    ``part`` is a whole number that doesn't fall in the given order. Rows are ordered within a part and shifted by the
    counts of the parts before, so no task orders all rows of a label.
    """
    r = rows.withColumns({"__part": part, "__by": F.struct(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("v"), F.col(by).isNull().alias("null"))})
    inside = W.partitionBy("__by", "__part")
    counts = r.groupBy("__by", "__part").agg(F.count("*").alias("__c"))
    label = W.partitionBy("__by")
    before = F.sum("__c").over(label.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    shift = counts.select("__by", "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__c").over(label).alias("n"))
    placed = r.withColumn("i", F.row_number().over(inside.orderBy(*order)) - 1).join(shift, ["__by", "__part"])
    return placed.withColumn("i", F.col("i") + F.col("__before")).drop("__by", "__part", "__before")


def number_parts(rows: DataFrame, item: str) -> Column:
    """Parts of about equal size for ``numbered`` by a numeric item."""
    n = parts_wanted(rows)
    value = F.col(item).try_cast("double")
    cuts = rows.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < value)) if cuts else F.lit(0)


def parts_wanted(rows: DataFrame) -> int:
    return max(64, min(1000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def split_by_hash(rows: DataFrame, item: str, label: str, seed: str, parts: tuple[str, str, str] = ("fit", "validation", "evaluation")) -> DataFrame:
    """Within each label, in seeded order: eight tenths, a tenth, and the rest, by integer division."""
    hashed = rows.select(item, label, seeded(seed, item).alias("__h"))
    start = F.conv(F.substring("__h", 1, 5), 16, 10).cast("long")
    r = numbered(hashed, label, F.floor(start * parts_wanted(rows) / (1 << 20)), ["__h", item])
    first, second = F.floor(F.col("n") * 8 / 10), F.floor(F.col("n") / 10)
    return r.select(item, label, F.when(F.col("i") < first, parts[0]).when(F.col("i") < first + second, parts[1]).otherwise(parts[2]).alias("part"))


def balanced_take(rows: DataFrame, item: str, label: str, most: int) -> DataFrame:
    """The first ``most // 2`` of either label in item order, then the first others until there are ``most``.

    No row beyond the first ``most // 2 + most`` of its label can be taken, so only those are ordered together.
    """
    half = most // 2
    first = rows.select(item, label, F.row_number().over(W.partitionBy(label).orderBy(item)).alias("rn")).filter(F.col("rn") <= half + most)
    return first.withColumn("late", (F.col("rn") > half).cast("int")).orderBy("late", item).limit(most).select(item, label)


def balanced_batches(rows: DataFrame, item: str, label: str, size: int) -> DataFrame:
    """Batches with ``size // 2`` of each label in item order; rows of the longer label beyond the other have none."""
    n = rows.groupBy(label).count().agg(F.min("count").alias("__least"))
    r = numbered(rows, label, number_parts(rows, item), [item]).join(F.broadcast(n)).filter(F.col("i") < F.col("__least"))
    return r.select(item, label, F.floor(F.col("i") / (size // 2)).alias("batch"))
