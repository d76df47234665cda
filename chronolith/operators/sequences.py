"""Videos as ordered sequences: joins of manifests with features and labels, evaluation, and comparison of hypotheses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.operators import intervals, metrics
from chronolith.sources.paths import kept_table


def feature_sequences(manifest: DataFrame, index: DataFrame, key: str, order: str, value: str) -> tuple[DataFrame, DataFrame]:
    """One row per video with its values in order, and the videos that break a rule, with the reason.

    The order must be 0, 1, 2, ...; every manifest row needs features. A sequence is one video, so it fits a row.
    """
    seq = index.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("items"), F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.count_distinct(order).alias("kinds"))
    broken = (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("kinds") != F.col("n"))
    joined = manifest.join(seq, key, "left")
    reason = F.when(F.col("n").isNull(), "missing features").when(broken, "indexes not contiguous")
    good = joined.filter(reason.isNull()).select(*manifest.columns, "n", F.transform("items", lambda x: x[value]).alias("sequence"))
    return good, joined.filter(reason.isNotNull()).select(key, reason.alias("reason"))


def evaluate_predictions(predictions: DataFrame, labels: DataFrame, key: str, start: str, end: str, score: str, order: str, reduction: str = "max", label_span: tuple[str, str] | None = None) -> DataFrame:
    """Frame metrics of interval predictions against labels of frames (key, frame, label); both sides must have the same keys.

    ``label_span`` names the bounds of labels that are said by intervals (key, start, end, label) instead of by frames.
    Everything follows from the labelled frames at each distinct score, which are summed once.
    """
    from chronolith.operators.audit import key_diff, require_empty

    require_empty(key_diff(predictions, labels, key), "keys of predictions and labels differ")
    a, z = label_span or ("frame", "__after")
    spans = labels if label_span else labels.withColumn(z, F.col(a) + 1)
    groups = kept_table(intervals.scored_labels(predictions, spans, key, start, end, score, order, reduction, "label", a, z), "scores")
    rows = groups.select("score", F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.col(c).alias("w")) for y, c in ((1, "p"), (0, "n"))])).alias("f")).select("score", "f.*")
    auc, pr = metrics.roc_auc(rows, "score", "y", weight=F.col("w")), metrics.precision_recall(rows, "score", "y", weight=F.col("w"))
    counts = groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("frames"), F.sum("p").alias("positive_frames"))
    return auc.select("auc").join(pr).join(counts).join(labels.agg(F.count_distinct(key).alias("videos")))


def attach_captions(videos: DataFrame, captions: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Videos with their captions as a sorted array (empty without any), and captions of unknown videos."""
    own = captions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("captions"))
    return videos.join(own, key, "left"), captions.join(videos.select(key), key, "left_anti")


def candidate_spans(spans: DataFrame, key: str, start: str, end: str, shifts: list[int], inclusive: list[bool]) -> DataFrame:
    """The spans under each coordinate hypothesis (shift and whether the end counts): candidate, shift, inclusive, lo, hi."""
    hyp = F.array(*[F.struct(F.lit(i * len(inclusive) + j).alias("candidate"), F.lit(s).alias("shift"), F.lit(inc).alias("inclusive")) for i, s in enumerate(shifts) for j, inc in enumerate(inclusive)])
    rows = spans.select(key, start, end, F.explode(hyp).alias("h")).select(key, start, end, "h.*")
    return rows.select(key, "candidate", "shift", "inclusive", F.greatest(F.lit(0), F.col(start) + F.col("shift")).alias("lo"), (F.col(end) + F.col("shift") + F.col("inclusive").cast("int")).alias("hi"))


def compare_candidates(candidates: DataFrame, truth: DataFrame, key: str, names: list[int] | None = None) -> DataFrame:
    """Frames that differ from the truth for each candidate, and the videos without any difference.

    ``truth``: key, lo, hi of positive spans. ``names``: the candidates, read from their rows by default. Both sides are unions
    of intervals, so differing frames follow from a sweep over the boundaries rather than from frames; rows that are dealt by
    key stay where they are.
    """
    if names is None:
        theirs = truth.join(F.broadcast(candidates.select("candidate").distinct()))
    else:
        theirs = truth.withColumn("candidate", F.explode(F.array(*map(F.lit, names))))
    both = candidates.select(key, "candidate", "lo", "hi", F.lit(1).alias("side")).unionByName(theirs.select(key, "candidate", "lo", "hi", F.lit(0).alias("side")))
    parts = intervals.boundaries(both, [key, "candidate"], "lo", "hi", {"mine": F.col("side"), "theirs": 1 - F.col("side")})
    differs = (F.col("mine") > 0) != (F.col("theirs") > 0)
    per = parts.groupBy(key, "candidate").agg(F.coalesce(F.sum(F.when(differs, F.col("hi") - F.col("lo"))), F.lit(0)).alias("wrong"))
    return per.groupBy("candidate").agg(F.sum("wrong").alias("wrong_frames"), F.count(F.when(F.col("wrong") == 0, 1)).alias("exact_videos"), F.count("*").alias("videos"))


def cube(facts: DataFrame, dims: list[str], value: str, pivot: str, names: list) -> tuple[DataFrame, DataFrame]:
    """The facts as a table with a column for each of ``names``, and the cells that it lacks."""
    table = facts.groupBy(*dims).pivot(pivot, names).agg(F.first(value))
    lacking = table.select(*dims, F.explode(F.array_compact(F.array(*[F.when(F.col(str(n)).isNull(), F.lit(str(n))) for n in names]))).alias("missing"))
    return table, lacking


def temporal_bins(rows: DataFrame, key: str, order: str, value: str, bins: int) -> DataFrame:
    """Means of ``bins`` equal parts of each sequence, cut at truncated even steps; an empty part takes the row at its left edge."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    parts = n.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(key, "bin", F.floor(F.col("bin") * F.col("n") / bins).alias("a"), F.floor((F.col("bin") + 1) * F.col("n") / bins).alias("b"))
    wide = parts.withColumn(order, F.explode(F.sequence(F.col("a"), F.greatest(F.col("a"), F.col("b") - 1))))
    return wide.join(rows.select(key, F.col(order).cast("long").alias(order), value), [key, order]).groupBy(key, "bin").agg(F.avg(value).alias("mean"))


def enrich(videos: DataFrame, probes: DataFrame, key: str, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Frames and rate filled from probes where absent, and the videos whose own values contradict them."""
    p = probes.select(key, F.col("num_frames").alias("__n"), F.col("fps").alias("__f"))
    j = videos.join(p, key, "left")
    wrong = F.when(F.col("num_frames") != F.col("__n"), "frames").when(F.abs(F.col("fps") - F.col("__f")) > tolerance, "fps")
    out = j.select(*[F.coalesce(c, f"__{c[0]}").alias(c) if c in ("num_frames", "fps") else F.col(c) for c in videos.columns])
    return out, j.filter(wrong.isNotNull()).select(key, wrong.alias("conflict"))


def reconcile(spans: DataFrame, frames: DataFrame, key: str, start: str, end: str, total: str) -> DataFrame:
    """Spans cut at the decoded length; empty ones go. Per video the kept spans, those cut, and those dropped."""
    j = spans.join(frames.select(key, total), key)
    cut = F.least(F.col(end), F.col(total))
    j = j.withColumns({"__cut": cut, "__keep": cut > F.col(start)})
    return j.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("__keep"), F.struct(F.col(start).alias("start"), F.col("__cut").alias("end"))))).alias("spans"),
        F.count(F.when(F.col("__keep") & (F.col("__cut") < F.col(end)), 1)).alias("clamped"), F.count(F.when(~F.col("__keep"), 1)).alias("dropped"),
    )


def seconds_to_frames(start: Column, end: Column, fps: Column, frames: Column) -> tuple[Column, Column]:
    """Frame range of a time range, truncated and inside the video; the whole video where it isn't a range; 25 fps by default."""
    rate = F.when(fps > 0, fps).otherwise(25.0)
    a, b = F.greatest(F.lit(0), F.floor(start * rate).cast("long")), F.least(frames, F.floor(end * rate).cast("long"))
    ok = F.coalesce(a < b, F.lit(False))
    return F.when(ok, a).otherwise(F.lit(0)), F.when(ok, b).otherwise(frames)


def stream_stride(fps: Column, wanted: float) -> Column:
    return F.greatest(F.lit(1), F.bround(fps / wanted, 0).cast("long"))


def tracks_within(rows: DataFrame, key: str, space: list[str], time: str, most: int) -> DataFrame:
    """Whole tracks (all times of a place), evenly among places, as many as fit ``most`` rows of each key."""
    w = W.partitionBy(key)
    r = rows.withColumn("place", F.dense_rank().over(w.orderBy(*space)) - 1)
    per = r.groupBy(key).agg((F.max("place") + 1).alias("places"), F.count_distinct(time).alias("times"))
    keep = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("times")))
    step = F.floor(F.col("place") * keep / F.col("places")) != F.floor((F.col("place") - 1) * keep / F.col("places"))
    return r.join(per, key).filter((F.col("places") <= keep) | (F.col("place") == 0) | step).select(*rows.columns)


def capped_take(rows: DataFrame, label: str, group: str, item: str, most: int) -> DataFrame:
    """For each label whole groups in order of their first item, skipping those larger than what is left of ``most``.

    Of the groups of one size n only the first ``most / n`` can fit, so a label's choice is among at most
    ``most * (1 + ln(most))`` groups however many it has.
    """
    sizes = rows.groupBy(label, group).agg(F.count("*").alias("n"), F.min(item).alias("first")).filter(F.col("n") <= most)
    nth = F.row_number().over(W.partitionBy(label, "n").orderBy("first", group))
    sizes = sizes.withColumn("__nth", nth).filter(F.col("__nth") <= most).filter(F.col("__nth") * F.col("n") <= most).drop("__nth")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, left, take = part.sort_values(["first", group]), most, []
        for n in part["n"]:
            take.append(n <= left)
            left -= n if take[-1] else 0
        return part[take][[label, group]]

    types = dict(rows.dtypes)
    chosen = sizes.groupBy(label).applyInPandas(run, f"`{label}` {types[label]}, `{group}` {types[group]}")
    return rows.join(chosen, [label, group], "left_semi")
