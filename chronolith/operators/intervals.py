"""Half-open integer intervals: projection to points, sweeps, run lengths, overlap and alignment.

Intervals meet points or each other within their key; a sweep over boundaries replaces expansion to points where the
result can be said in intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _ordered(key: str | list[str], *order: str):
    return W.partitionBy(key).orderBy(*order)


def boundaries(df: DataFrame, key: str | list[str], start: str, end: str, sums: dict[str, Column]) -> DataFrame:
    """Elementary intervals between neighbouring boundaries: lo, hi, depth and the running sums of ``sums`` inside."""
    keys = [key] if isinstance(key, str) else key
    signs = [F.struct(F.col(start).alias("pos"), F.lit(1).alias("d"), *[v.alias(k) for k, v in sums.items()]), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d"), *[(-v).alias(k) for k, v in sums.items()])]
    steps = df.select(*keys, F.explode(F.array(*signs)).alias("e")).select(*keys, "e.*").groupBy(*keys, "pos").agg(F.sum("d").alias("d"), *[F.sum(k).alias(k) for k in sums])
    up_to = _ordered(keys, "pos").rowsBetween(W.unboundedPreceding, 0)
    out = steps.select(*keys, F.col("pos").alias("lo"), F.lead("pos").over(_ordered(keys, "pos")).alias("hi"), F.sum("d").over(up_to).alias("depth"), *[F.sum(k).over(up_to).alias(k) for k in sums])
    return out.filter("hi IS NOT NULL")


def merge_equal(df: DataFrame, key: str, lo: str, hi: str, values: list[str]) -> DataFrame:
    """Run lengths: neighbouring intervals that touch and have equal values become one."""
    w = _ordered(key, lo)
    same = (F.lag(hi).over(w) == F.col(lo)) & F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values))
    runs = df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "__run", *values).agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__run")


def dense_mean_runs(clips: DataFrame, key: str, start: str, end: str, score: str) -> DataFrame:
    """Mean of overlapping windows for each frame, as maximal runs of equal sum and number of contributors."""
    parts = boundaries(clips, key, start, end, {"total": F.col(score)}).filter("depth > 0").withColumnRenamed("depth", "contributors")
    return merge_equal(parts, key, "lo", "hi", ["total", "contributors"])


def dense_max_frames(clips: DataFrame, key: str, start: str, end: str, score: str) -> DataFrame:
    """Maximum and number of the windows over each frame."""
    return clips.select(key, F.explode(F.sequence(start, F.col(end) - 1)).alias("frame"), score).groupBy(key, "frame").agg(F.max(score).alias("score"), F.count("*").alias("contributors"))


def dense_issues(clips: DataFrame, key: str, start: str, end: str, score: str, videos: DataFrame, total: str) -> DataFrame:
    """Videos whose windows can't be made into a score for each frame, and why, the first reason that holds.

    ``no intervals``; ``not finite`` scores; an ``invalid interval`` (null, negative, reversed or empty, or beyond the
    video); ``uncovered`` frames. ``videos``: key and number of frames. Read it beside ``dense_mean_runs`` and
    ``dense_max_frames``, which take what they are given.
    """
    s = F.col(score).cast("double")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    valid = F.coalesce((F.col(start) >= 0) & (F.col(end) > F.col(start)), F.lit(False))
    flags = clips.groupBy(key).agg(F.min(finite).alias("__finite"), F.min(valid).alias("__valid"), F.max(end).alias("__hi"))
    parts = boundaries(clips.filter(valid), key, start, end, {}).filter("depth > 0")
    covered = parts.groupBy(key).agg(F.sum(F.col("hi") - F.col("lo")).alias("__covered"))
    j = videos.select(key, total).join(flags, key, "left").join(covered, key, "left")
    reason = F.when(F.col("__finite").isNull(), "no intervals").when(~F.col("__finite"), "not finite").when(~F.col("__valid") | (F.col("__hi") > F.col(total)), "invalid interval").when(F.col("__covered") < F.col(total), "uncovered")
    return j.select(key, reason.alias("reason")).filter("reason IS NOT NULL")


def coverage(clips: DataFrame, key: str, start: str, end: str, frames: DataFrame, total: str) -> DataFrame:
    """covered, gap and overlap frames, ratio and completeness of each video; ``frames``: key and number of frames."""
    parts = boundaries(clips, key, start, end, {})
    width = F.least("hi", total) - F.least("lo", total)
    sums = parts.join(frames, key).groupBy(key, total).agg(
        F.coalesce(F.sum(F.when(F.col("depth") > 0, width)), F.lit(0)).alias("covered_frames"),
        F.coalesce(F.sum(F.when(F.col("depth") > 1, width)), F.lit(0)).alias("overlap_frames"),
    )
    covered = F.col("covered_frames")
    return sums.select(key, covered, "overlap_frames", (F.col(total) - covered).alias("gap_frames"), F.round(covered / F.col(total), 9).alias("ratio"), (covered == F.col(total)).alias("complete"))


def coverage_rollup(summary: DataFrame) -> DataFrame:
    """One row over all videos."""
    return summary.agg(
        F.count("*").alias("videos"), F.count(F.when(F.col("complete"), 1)).alias("complete_videos"),
        F.sum("covered_frames").alias("covered_frames"), F.sum("gap_frames").alias("gap_frames"), F.sum("overlap_frames").alias("overlap_frames"),
    )


#: Frames of a block. Intervals are cut at its multiples, so at most ``BLOCK * (BLOCK + 1) / 2`` different ones meet in a block.
BLOCK = 64


def cells_of(df: DataFrame, key: str, start: str, end: str, **states: Column) -> DataFrame:
    """key, block, lo, hi (inside the block) and ``states``, aggregated over the equal parts of intervals; empty intervals have none."""
    named = {f"__{k}": F.col(c).cast("long") for k, c in (("a", start), ("z", end))}
    rows = df.withColumns(named).filter("__z > __a").withColumn("__b", F.explode(F.sequence(F.shiftright("__a", 6), F.shiftright(F.col("__z") - 1, 6))))
    at = lambda c: (c - F.col("__b") * BLOCK).cast("int")
    rows = rows.withColumns({"__lo": F.greatest(at(F.col("__a")), F.lit(0)), "__hi": at(F.least(F.col("__z"), F.col("__b") * BLOCK + BLOCK))})
    return rows.groupBy(key, "__b", "__lo", "__hi").agg(*[c.alias(k) for k, c in states.items()])


def _states(score: str, order: str, reduction: str) -> dict[str, Column]:
    o = F.col(order)
    ranked = lambda pick, pick_by: F.when(pick(o).isNotNull(), F.struct(pick(o).alias("o"), pick_by(score, order).alias("s")))
    kinds = {"max": {"x": F.max(score)}, "mean": {"x": F.sum(score), "n": F.count(score)}, "first": {"x": ranked(F.min, F.min_by)}, "last": {"x": ranked(F.max, F.max_by)}}
    return kinds[reduction]


def total_of(state: str) -> Column:
    return F.aggregate("__cover", F.lit(0.0), lambda s, c: s + F.coalesce(c[state].cast("double"), F.lit(0.0)))


def _reduced(reduction: str) -> Column:
    """The reduction of the states in ``__cover``; null where it is empty."""
    x = F.col("__cover.x")
    if reduction == "mean":
        return F.try_divide(total_of("x"), total_of("n"))
    return {"max": F.array_max(x), "first": F.array_min(x)["s"], "last": F.array_max(x)["s"]}[reduction]


def _pieces(cells: DataFrame, key: str, more: DataFrame | None = None, merge: Column | None = None) -> DataFrame:
    """key, ``__b``, ``__lo``, ``__hi``, ``__cover`` (cells over it) of the pieces of each block between boundaries of its cells.

    ``more``: key, ``__b`` and a value ``__m`` whose aggregate ``merge`` stays beside; with it its blocks are kept, else those of
    ``cells``. Cells and values of a block meet in one aggregation.
    """
    part = F.struct("__lo", "__hi", *[c for c in cells.columns if c not in (key, "__b", "__lo", "__hi")])
    rows = cells.select(key, "__b", part.alias("__p"))
    if more is not None:
        kinds = dict(more.dtypes)
        rows = rows.withColumn("__m", F.lit(None).cast(kinds["__m"])).union(more.select(key, "__b", F.lit(None).cast(dict(rows.dtypes)["__p"]), "__m"))
    met = rows.groupBy(key, "__b").agg(F.collect_list("__p").alias("__p"), *([merge.alias("__m")] if more is not None else []))
    if more is not None:
        met = met.filter("__m IS NOT NULL")
    edges = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0), F.lit(BLOCK)), F.col("__p.__lo"), F.col("__p.__hi"))))
    cut = met.withColumn("__e", edges).select("*", F.posexplode("__e").alias("__i", "__lo")).withColumn("__hi", F.get("__e", F.col("__i") + 1)).filter("__hi IS NOT NULL")
    over = F.filter("__p", lambda p: (p["__lo"] <= F.col("__lo")) & (p["__hi"] > F.col("__lo")))
    return cut.withColumn("__cover", over).drop("__p", "__e", "__i")


def masks_of(videos: DataFrame, key: str, frames: str) -> DataFrame:
    """Key, block and bits of the frames 0 to ``frames`` - 1 of each video."""
    n = F.col(frames).cast("long")
    rows = videos.filter(n > 0).select(key, n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(n - 1, 6))).alias("__b"))
    left = (F.col("__n") - F.col("__b") * BLOCK).cast("int")
    mask = F.when(left >= BLOCK, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), left) - 1)
    return rows.select(key, "__b", mask.alias("__m"))


def at_frames(cells: DataFrame, masks: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """key, frame and ``values`` (of ``__cover``) at the frames whose bits are set in the masks (key, block, ``__m``)."""
    pieces = _pieces(cells, key, masks, F.bit_or("__m"))
    out = pieces.select(key, "__b", "__m", *[v.alias(k) for k, v in values.items()], F.explode(F.sequence("__lo", F.col("__hi") - 1)).alias("__f"))
    return out.filter(F.call_function("shiftright", "__m", "__f").bitwiseAND(F.lit(1)) == 1).select(key, (F.col("__b") * BLOCK + F.col("__f")).alias("frame"), *values)


def _on_frames(clips: DataFrame, masks: DataFrame, key: str, start: str, end: str, score: str, order: str, reduction: str, fill: float) -> DataFrame:
    return at_frames(cells_of(clips, key, start, end, **_states(score, order, reduction)), masks, key, {"score": F.coalesce(_reduced(reduction).cast("double"), F.lit(float(fill)))})


def project(clips: DataFrame, grid: DataFrame, key: str, start: str, end: str, score: str, order: str, reduction: str, fill: float = 0.0) -> DataFrame:
    """Scores of the intervals over each grid point (key, frame) by max, mean, first or last; ``fill`` where there is none.

    Grid points and the intervals meet in blocks of frames, in one aggregation: points as bits, intervals as pieces, so
    neither a join nor a row for each frame of an interval is made. ``project_all`` takes all frames of a video.
    """
    frame = F.col("frame").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(frame, F.lit(BLOCK)).cast("int"))
    masks = grid.filter(frame.isNotNull()).select(key, F.shiftright(frame, 6).alias("__b"), bit.alias("__m")).groupBy(key, "__b").agg(F.bit_or("__m").alias("__m"))
    return _on_frames(clips, masks, key, start, end, score, order, reduction, fill)


def project_all(clips: DataFrame, videos: DataFrame, key: str, frames: str, start: str, end: str, score: str, order: str, reduction: str, fill: float = 0.0) -> DataFrame:
    """``project`` on the frames 0 to ``frames`` - 1 of each video, which are made last; videos without frames give none."""
    return _on_frames(clips, masks_of(videos, key, frames), key, start, end, score, order, reduction, fill)


def dense_max_runs(clips: DataFrame, key: str, start: str, end: str, score: str) -> DataFrame:
    """Maximum and number of the windows over each frame, as maximal runs of equal ones."""
    pieces = _pieces(cells_of(clips, key, start, end, x=F.max(score), n=F.count("*")), key).filter(F.size("__cover") > 0)
    at = lambda c: F.col("__b") * BLOCK + F.col(c)
    count = F.aggregate("__cover", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return merge_equal(pieces.select(key, at("__lo").alias("lo"), at("__hi").alias("hi"), F.array_max("__cover.x").alias("score"), count.alias("contributors")), key, "lo", "hi", ["score", "contributors"])


def scored_labels(clips: DataFrame, labels: DataFrame, key: str, start: str, end: str, score: str, order: str, reduction: str, label: str, label_start: str, label_end: str, fill: float = 0.0) -> DataFrame:
    """score, p, n, c: positive, negative and all labelled frames at each distinct score; labels are intervals.

    A frame without a score has ``fill``. Frames with several labels count for each.
    """
    own = cells_of(labels, key, label_start, label_end, p=F.sum(label), n=F.sum(1 - F.col(label)), c=F.count("*"))
    own = own.select(key, "__b", F.struct("__lo", "__hi", "p", "n", "c").alias("__m"))
    pieces = _pieces(cells_of(clips, key, start, end, **_states(score, order, reduction)), key, own, F.collect_list("__m")).filter(F.size("__m") > 0)
    width = lambda m: F.greatest(F.least(F.col("__hi"), m["__hi"]) - F.greatest(F.col("__lo"), m["__lo"]), F.lit(0))
    kinds = {c: "double" if dict(labels.dtypes)[label] in ("float", "double") else "long" for c in "pn"} | {"c": "long"}
    counted = lambda c, t: F.aggregate("__m", F.lit(0).cast(t), lambda s, m: s + (F.coalesce(m[c], F.lit(0)) * width(m)).cast(t)).alias(c)
    frames = [counted(c, t) for c, t in kinds.items()]
    rows = pieces.select(F.coalesce(_reduced(reduction).cast("double"), F.lit(float(fill))).alias("score"), *frames)
    return rows.filter("c > 0").groupBy("score").agg(*[F.sum(c).alias(c) for c in kinds])


def last_writer_labels(videos: DataFrame, spans: DataFrame, key: str, frames: str, start: str, end: str, label: str, order: str) -> DataFrame:
    """Frames with a label: the latest annotation over a frame decides, also back to 0; without any it is 0."""
    out = project_all(spans, videos, key, frames, start, end, label, order, "last")
    return out.select(key, "frame", F.col("score").cast(dict(spans.dtypes)[label]).alias("label"))


def overlap_targets(tokens: DataFrame, spans: DataFrame, key: str, t0: str, t1: str, s0: str, s1: str, label: str, least: float, reference: str = "token", tasks: int | None = None) -> DataFrame:
    """Target of each interval: 1 if a positive span overlaps it by at least the fraction of the token or of the union.

    Spans and tokens meet in blocks of frames of their key, so no token meets spans far away; ``tasks``: how many share the
    blocks (the session's number of partitions by default).
    """
    step = 64
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / step), F.floor((F.col(b) - 1) / step))
    split = lambda df, *by: df if tasks is None else df.repartition(tasks, *by)
    left = split(tokens.select(key, t0, t1, F.explode_outer(cells(t0, t1)).alias("__cell")), key, "__cell")
    right = split(spans.filter(F.col(label) > 0).select(key, F.col(s0).alias("__s0"), F.col(s1).alias("__s1"), F.explode(cells(s0, s1)).alias("__cell")), key, "__cell")
    inter = F.least(t1, "__s1") - F.greatest(t0, "__s0")
    whole = F.col(t1) - F.col(t0) if reference == "token" else F.greatest(t1, "__s1") - F.least(t0, "__s0")
    hit = F.col("__s0").isNotNull() & (inter > 0) & (inter >= F.lit(least) * whole)
    met = left.join(right, [key, "__cell"], "left").select(key, t0, t1, F.when(hit, 1).otherwise(0).alias("target"))
    return split(met, key, t0, t1).groupBy(key, t0, t1).agg(F.max("target").alias("target"))


def align(tables: list[tuple[DataFrame, str, str, str]], key: str) -> DataFrame:
    """Elementary intervals of several tilings (rows, start, end, value) of the same key, with each one's value there.

    Each tiling's rows are disjoint; where one has no row its value is null. All boundaries are ordered once in each key,
    and the row of a tiling that began last is its row at a boundary.
    """
    names: list[str] = []
    for *_, v in tables:
        names.append(v if v not in names else f"{v}_{len(names)}")
    types = [dict(df.dtypes)[v] for df, _, _, v in tables]
    events = None
    for i, (df, a, b, v) in enumerate(tables):
        begins = F.when(F.col(b) > F.col(a), F.struct(F.col(v).alias("v"), F.col(b).cast("long").alias("e")))
        slots = [(begins if j == i else F.lit(None)).cast(f"struct<v:{t},e:bigint>").alias(f"s{j}") for j, t in enumerate(types)]
        empty = [F.lit(None).cast(f"struct<v:{t},e:bigint>").alias(f"s{j}") for j, t in enumerate(types)]
        at = lambda pos, cells: F.struct(F.col(pos).cast("long").alias("lo"), *cells)
        own = df.select(key, F.explode(F.array(at(a, slots), at(b, empty))).alias("x")).select(key, "x.*")
        events = own if events is None else events.union(own)
    w = _ordered(key, "lo")
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    seen = events.select(key, "lo", F.lead("lo").over(w).alias("hi"), *[F.last(f"s{i}", ignorenulls=True).over(up_to).alias(f"s{i}") for i in range(len(tables))])
    return seen.filter("hi > lo").select(key, "lo", "hi", *[F.when(F.col(f"s{i}.e") > F.col("lo"), F.col(f"s{i}.v")).alias(n) for i, n in enumerate(names)])


def longest_cover(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Union of the intervals of each key as maximal disjoint ones."""
    return merge_equal(boundaries(df, key, start, end, {}).filter("depth > 0").withColumn("one", F.lit(1)), key, "lo", "hi", ["one"]).select(key, "lo", "hi")


def stab(tiles: DataFrame, points: DataFrame, key: str, start: str, end: str, frame: str, step: int = 64) -> DataFrame:
    """The interval of the key over each point; points in none or in several are the caller's to reject.

    Points and intervals meet in blocks of ``step`` frames of their key.
    """
    cells = F.explode(F.sequence(F.floor(F.col(start) / step), F.floor((F.col(end) - 1) / step)))
    blocks = tiles.filter(F.col(start) < F.col(end)).withColumn("__cell", cells)
    met = points.withColumn("__cell", F.floor(F.col(frame) / step)).join(blocks, [key, "__cell"])
    return met.filter((F.col(start) <= F.col(frame)) & (F.col(frame) < F.col(end))).drop("__cell")


def clip_interval(seg_start: str, seg_end: str, frame_start: str, frame_end: str) -> tuple[Column, Column]:
    """Bounds of a clip: its whole segment if that is known and not empty, else its frames."""
    ok = F.coalesce((F.col(seg_start) >= 0) & (F.col(seg_start) < F.col(seg_end)), F.lit(False))
    return F.when(ok, F.col(seg_start)).otherwise(F.col(frame_start)), F.when(ok, F.col(seg_end)).otherwise(F.col(frame_end))


def truth_runs(df: DataFrame, key: str, lo: str, hi: str, label: str) -> DataFrame:
    """key, runs ('lo-hi:label' in order) and frames: a sealed record of each key's equal labels, run by run."""
    merged = merge_equal(df.select(key, lo, hi, label), key, lo, hi, [label])
    parts = F.array_sort(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(label).alias("label"))))
    text = F.concat_ws(",", F.transform("p", lambda r: F.concat(r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string"), F.lit(":"), r["label"].cast("string"))))
    return merged.groupBy(key).agg(parts.alias("p"), F.sum(F.col(hi) - F.col(lo)).alias("frames")).select(key, text.alias("runs"), "frames")
