"""Scores of half-open intervals on any grid of times: frame numbers, seconds at a rate, or times that are given.

Bounds and times are doubles. The intervals of a key are cut at their boundaries into elementary pieces. Each interval
is said by at most two blocks of 2^k pieces for each k, and a piece takes what the blocks over it hold, so neither
frames nor all pieces of long intervals are made, and means are sums of scores and never differences of running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.operators import intervals

REDUCTIONS = ("max", "mean", "first", "last")


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def frame_times(videos: DataFrame, key: str, frames: str, fps: str | None = None) -> DataFrame:
    """key, frame and time of each frame: frame / fps, or its number where there is no rate.

    A rate that isn't finite or above 0 gives frames without a time. Null or no frames give no rows.
    """
    grid = videos.filter(F.col(frames) > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(frames).cast("long") - 1)).alias("frame"), (F.col(fps) if fps else F.lit(None)).cast("double").alias("__fps"))
    rate = F.col("__fps")
    time = F.when(rate.isNull(), F.col("frame").cast("double")).when(finite(rate) & (rate > 0), F.col("frame") / rate)
    return grid.select(key, "frame", time.alias("time"))


def interval_issues(rows: DataFrame, key: str, start: str, end: str, score: str) -> DataFrame:
    """Intervals that ``pieces`` leaves out, and why: a bound or score that is null or not finite, or no end after the start."""
    a, z, s = (F.col(c).cast("double") for c in (start, end, score))
    reason = F.when(F.col(key).isNull(), "key").when(~finite(a) | ~finite(z), "bound").when(z <= a, "order").when(~finite(s), "score")
    return rows.select(key, start, end, score, reason.alias("reason")).filter("reason IS NOT NULL")


def pieces(rows: DataFrame, key: str, start: str, end: str, score: str, order: str, reductions: tuple[str, ...] = REDUCTIONS) -> DataFrame:
    """key, lo, hi and a column for each reduction of the scores over each elementary piece that an interval covers.

    ``first`` and ``last`` go by ``order`` (nulls before all); ties take the smaller and the greater score. Rows named by
    ``interval_issues`` take no part. Boundaries of one key are ordered in one task.
    """
    a, z, s = (F.col(c).cast("double") for c in (start, end, score))
    ranked = F.struct(F.col(order).alias("o"), s.alias("s"))
    start_state = {"max": [F.max(s).alias("max")], "mean": [F.sum(s).alias("sum"), F.count("*").alias("n")], "first": [F.min(ranked).alias("first")], "last": [F.max(ranked).alias("last")]}
    merged = {"max": F.max("max"), "sum": F.sum("sum"), "n": F.sum("n"), "first": F.min("first"), "last": F.max("last")}
    state = [c for r in reductions for c in {"max": ["max"], "mean": ["sum", "n"], "first": ["first"], "last": ["last"]}[r]]
    merge = [merged[c].alias(c) for c in state]

    valid = rows.filter(F.col(key).isNotNull() & finite(a) & finite(z) & finite(s) & (z > a))
    spans = valid.groupBy(key, a.alias("lo"), z.alias("hi")).agg(*[c for r in reductions for c in start_state[r]])
    bounds = spans.select("*", F.explode(F.array("lo", "hi")).alias("pos")).withColumn("r", F.dense_rank().over(W.partitionBy(key).orderBy("pos")).cast("long") - 1)
    placed = bounds.groupBy(key, "lo", "hi").agg(F.min("r").alias("a"), F.max("r").alias("z"), *[F.first(c).alias(c) for c in state])

    down = lambda c, k: F.call_function("shiftright", c, k)
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def blocks(k: Column) -> Column:
        left, right = down(F.col("a") + size(k) - 1, k), down(F.col("z"), k)
        own = lambda odd, node: F.when((left < right) & (odd % 2 == 1), F.struct(k.alias("level"), node.alias("node")))
        return F.filter(F.array(own(left, left), own(right, right - 1)), lambda x: x.isNotNull())

    top = F.length(F.bin(F.col("z") - F.col("a"))) - 1
    nodes = placed.select(key, *state, F.explode(F.flatten(F.transform(F.sequence(F.lit(0), top), blocks))).alias("x")).groupBy(key, "x.level", "x.node").agg(*merge)
    levels = nodes.groupBy(key).agg(F.max("level").alias("top"))
    cuts = bounds.groupBy(key, "r").agg(F.first("pos").alias("lo"))
    cuts = cuts.withColumn("hi", F.lead("lo").over(W.partitionBy(key).orderBy("r"))).filter("hi IS NOT NULL")
    asked = cuts.join(levels, key).select(key, "lo", "hi", "r", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    asked = asked.withColumn("node", down(F.col("r"), F.col("level")))
    got = asked.join(nodes, [key, "level", "node"]).groupBy(key, "lo", "hi").agg(*merge)
    out = {"max": F.col("max"), "mean": F.col("sum") / F.col("n") if "mean" in reductions else None, "first": F.col("first.s"), "last": F.col("last.s")}
    return got.select(key, "lo", "hi", *[out[r].alias(f"score_{r}") for r in reductions])


def project_times(rows: DataFrame, grid: DataFrame, key: str, start: str, end: str, score: str, order: str, time: str, reductions: tuple[str, ...] = REDUCTIONS, fill: float = 0.0) -> DataFrame:
    """The rows of ``grid`` (key, time, further columns) with score_max, score_mean, score_first, score_last, as asked.

    A time that no interval covers, or that is null or not finite, has ``fill``; so have the times of a null key.
    Pieces and times meet in one order of each key; equal times stay separate rows.
    """
    names = [f"score_{r}" for r in reductions]
    own = pieces(rows, key, start, end, score, order, reductions)
    more = F.struct(*[F.col(f"`{c}`") for c in grid.columns])
    wanted = grid.select(F.col(key).alias("k"), F.col(time).cast("double").alias("pos"), F.lit(1).alias("kind"), F.lit(None).alias("piece"), more.alias("row"))
    known = own.select(F.col(key).alias("k"), F.col("lo").alias("pos"), F.lit(0).alias("kind"), F.struct("hi", *names).alias("piece"), F.lit(None).alias("row"))
    up_to = W.partitionBy("k").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0)
    seen = known.union(wanted).withColumn("piece", F.last("piece", ignorenulls=True).over(up_to)).filter("kind = 1")
    inside = F.col("pos").isNotNull() & (F.col("pos") < F.col("piece.hi"))
    return seen.select("row.*", *[F.when(inside, F.col(f"piece.{n}")).otherwise(float(fill)).alias(n) for n in names])


def project_rate(rows: DataFrame, videos: DataFrame, key: str, start: str, end: str, score: str, order: str, frames: str, fps: str, reductions: tuple[str, ...] = REDUCTIONS, fill: float = 0.0) -> DataFrame:
    """``project_times`` on all frames of ``frame_times``, for videos with one row for each key: key, frame and scores.

    The bounds of an interval become the frames whose times they reach, by the same division, so intervals meet frames in
    blocks and neither times nor frames are ordered or shuffled. Holds below 2^50 frames.
    """
    about = videos.select(F.col(key).alias("__k"), F.col(frames).cast("long").alias("__n"), F.coalesce(F.col(fps).cast("double"), F.lit(1.0)).alias("__rate"))
    about = about.filter(finite(F.col("__rate")) & (F.col("__rate") > 0) & (F.col("__n") > 0))
    a, z, s = (F.col(c).cast("double") for c in (start, end, score))
    valid = rows.filter(finite(a) & finite(z) & finite(s) & (z > a)).select(key, a.alias("__s"), z.alias("__e"), s.alias("__x"), F.col(order).alias("__o"))
    rate, n = F.col("__rate"), F.col("__n")

    def reached(at: str, name: str) -> tuple[str, Column]:  # the first frame at or after a time
        return name, F.greatest(F.lit(0), F.least(F.col(at) * rate, n.cast("double")).cast("long") - 2)

    met = valid.join(about, F.col(key) == F.col("__k")).withColumns(dict([reached("__s", "__f"), reached("__e", "__g")]))
    first = lambda c, at: F.least(n, F.coalesce(*[F.when((F.col(c) + i) / rate >= F.col(at), F.col(c) + i) for i in range(5)], n))
    met = met.select(key, first("__f", "__s").alias("__from"), first("__g", "__e").alias("__to"), "__x", "__o")
    ranked = F.struct(F.col("__o").alias("o"), F.col("__x").alias("s"))
    states = {"max": {"max": F.max("__x")}, "mean": {"sum": F.sum("__x"), "n": F.count("*")}, "first": {"first": F.min(ranked)}, "last": {"last": F.max(ranked)}}
    values = {"max": lambda: F.array_max("__cover.max"), "mean": lambda: F.try_divide(intervals.total_of("sum"), intervals.total_of("n")), "first": lambda: F.array_min("__cover.first")["s"], "last": lambda: F.array_max("__cover.last")["s"]}
    cells = intervals.cells_of(met, key, "__from", "__to", **{k: c for r in reductions for k, c in states[r].items()})
    return intervals.at_frames(cells, intervals.masks_of(videos, key, frames), key, {f"score_{r}": F.coalesce(values[r](), F.lit(float(fill))) for r in reductions})
