"""Generators of segments, clips and windows over frame ranges, as array expressions; all positions are 0-based, half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_int = lambda c: c.cast("long")


def segment_bounds(frames: Column, i: Column, segments: int) -> tuple[Column, Column]:
    start = F.least(F.floor(i * frames / segments).cast("long"), frames - 1)
    return start, F.least(frames, F.greatest(start + 1, F.floor((i + 1) * frames / segments).cast("long")))


def uniform_segments(videos: DataFrame, key: str, frames: str, segments: int) -> DataFrame:
    """segment, start, end of equal parts; a video shorter than the number of segments repeats frames."""
    rows = videos.select(key, frames, F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
    start, end = segment_bounds(F.col(frames), F.col("segment").cast("long"), segments)
    return rows.select(key, F.col("segment").cast("long").alias("segment"), start.alias("start"), end.alias("end"))


def fixed_clip(region_start: Column, region_end: Column, clip_frames: int, stride: int, position: str = "center") -> tuple[Column, Column]:
    """(indices, valid): a clip at the start or centre of a region; frames beyond its end repeat the last valid one."""
    span, length = (clip_frames - 1) * stride + 1, region_end - region_start
    offset = F.when(length > span, F.floor((length - span) / 2).cast("long")).otherwise(0) if position == "center" else F.lit(0)
    raw = [region_start + offset + i * stride for i in range(clip_frames)]
    last = F.greatest(*[F.when(x < region_end, x) for x in raw]) if clip_frames > 1 else F.when(raw[0] < region_end, raw[0])
    # arrays of columns rather than lambdas, which Spark compiles
    return F.array(*[F.least(x, last) for x in raw]), F.array(*[x < region_end for x in raw])


def segment_clips(videos: DataFrame, key: str, frames: str, segments: int = 32, clip_frames: int = 16, stride: int = 2, position: str = "center") -> DataFrame:
    """One fixed clip for each uniform segment: segment, indices, valid."""
    rows = uniform_segments(videos, key, frames, segments)
    indices, valid = fixed_clip(F.col("start"), F.col("end"), clip_frames, stride, position)
    return rows.select(key, "segment", indices.alias("indices"), valid.alias("valid"))


def effective_stride(frames: Column, clip_frames: int, stride: int) -> Column:
    """The stride if the clip fits, 1 if only consecutive frames fit, else null."""
    return F.when(frames >= (clip_frames - 1) * stride + 1, stride).when(frames >= clip_frames, 1)


def dense_windows(videos: DataFrame, key: str, frames: str, clip_frames: int, stride: int, window: int, stride1_if_needed: bool = False) -> DataFrame:
    """clip_index, start, end, end_anchored of sliding windows; a last one is anchored at the end where frames remain.

    Videos shorter than a clip's span give no row; with ``stride1_if_needed`` they take consecutive frames if those fit.
    ``short_videos`` lists the others.
    """
    step = effective_stride(F.col(frames), clip_frames, stride) if stride1_if_needed else F.lit(stride)
    span = (clip_frames - 1) * step + 1
    fits = videos.select(key, (F.col(frames) - span).cast("long").alias("__last"), span.cast("long").alias("__span")).filter("__last >= 0")
    last = F.col("__last")
    regular = F.sequence(F.lit(0).cast("long"), last, F.lit(window).cast("long"))
    starts = F.when(last % window == 0, regular).otherwise(F.concat(regular, F.array(last)))
    rows = fits.select(key, "__span", F.posexplode(starts).alias("clip_index", "start"))
    return rows.select(key, F.col("clip_index").cast("long").alias("clip_index"), "start", (F.col("start") + F.col("__span")).alias("end"), ((F.col("start") % window) != 0).alias("end_anchored"))


def short_videos(videos: DataFrame, key: str, frames: str, clip_frames: int, stride: int, stride1_if_needed: bool = False) -> DataFrame:
    """Videos from which no window can be taken, with the frames that it needs."""
    need = clip_frames if stride1_if_needed else (clip_frames - 1) * stride + 1
    return videos.filter((F.col(frames) < need) | F.col(frames).isNull()).select(key, frames, F.lit(need).cast("long").alias("needed"))


def uniform_full_clips(videos: DataFrame, key: str, frames: str, segments: int, clip_frames: int, stride: int) -> DataFrame:
    """A whole clip centred on each uniform segment, kept inside the video; ``repeated`` marks a start seen before."""
    step = effective_stride(F.col(frames), clip_frames, stride)
    rows = videos.withColumn("__stride", step.cast("long")).filter("__stride IS NOT NULL")
    seg = rows.select(key, frames, "__stride", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
    a, b = segment_bounds(F.col(frames), F.col("segment").cast("long"), segments)
    span = (clip_frames - 1) * F.col("__stride") + 1
    start = F.greatest(F.lit(0), F.least(F.col(frames) - span, F.floor((a + b - span) / 2).cast("long")))
    from pyspark.sql.window import Window as W

    out = seg.select(key, F.col("segment").cast("long").alias("segment"), start.cast("long").alias("start"), (start + span).cast("long").alias("end"))
    return out.withColumn("repeated", F.row_number().over(W.partitionBy(key, "start").orderBy("segment")) > 1)


def duration_clips(videos: DataFrame, key: str, frames: str, fps: float, interval: float, clip_frames: int, max_clips: int) -> DataFrame:
    """Clips of about ``interval`` seconds: clip_index and frame indices at even distances, rounded half to even."""
    n = F.greatest(F.lit(1), F.least(F.lit(max_clips), F.ceil(F.col(frames) / fps / interval).cast("int")))
    rows = videos.filter(F.col(frames) > 0).select(key, frames, n.alias("clips")).withColumn("clip_index", F.explode(F.sequence(F.lit(0), F.col("clips") - 1)))
    a = F.floor(F.col("clip_index") * F.col(frames) / F.col("clips")).cast("long")
    b = F.greatest(a, F.floor((F.col("clip_index") + 1) * F.col(frames) / F.col("clips")).cast("long") - 1)
    indices = F.transform(F.sequence(F.lit(0), F.lit(clip_frames - 1)), lambda i: F.bround(F.col("a") + i * (F.col("b") - F.col("a")) / F.lit(clip_frames - 1), 0).cast("long"))
    return rows.withColumns({"a": a, "b": b}).select(key, F.col("clip_index").cast("long").alias("clip_index"), indices.alias("indices"))


def resample(scores: DataFrame, videos: DataFrame, key: str, index: str, score: str, frames: str) -> DataFrame:
    """Piecewise-constant scores: frame f of F takes the score floor(f * n / F) of n."""
    n = scores.groupBy(key).agg(F.count("*").alias("n"))
    grid = videos.join(n, key).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col(frames) - 1)))
    return grid.withColumn(index, F.floor(F.col("frame") * F.col("n") / F.col(frames)).cast("long")).join(scores, [key, index]).select(key, "frame", score)


def even_positions(n: Column, most: int) -> Column:
    """At most so many of the positions 0..n-1, evenly and with both ends, truncated."""
    some = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(most - 1, 1))).cast("long"))
    return F.when(n <= most, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(some)


def rounded_positions(n: Column, count: int) -> Column:
    """Evenly spaced positions rounded half to even, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(count - 1, 1)), 0).cast("long")))


def fps_indices(videos: DataFrame, num_frames: str, fps: str, sample_fps: float, count: int) -> DataFrame:
    """``stride`` (frames a second over the wanted rate, rounded half to even, 1 at least) and ``frames``: the first ``count``
    of its multiples; null for a video that is too short, as nothing is padded."""
    stride = F.greatest(F.lit(1), F.bround(F.col(fps) / sample_fps).cast("long"))
    frames = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: i * F.col("stride"))
    return videos.withColumn("stride", stride).withColumn("frames", F.when(F.col("stride") * (count - 1) < F.col(num_frames), frames))


def percentage_points(dense: Column, method: Column) -> Column:
    """The difference on the scale of 0 to 100, never a relative one."""
    return 100.0 * (method - dense)
