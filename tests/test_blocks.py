"""Intervals on frames in blocks, against frames one by one."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import intervals, sequences


def made(seed, many=60):
    r = random.Random(seed)
    rows = []
    for i in range(many):
        a = r.randint(-70, 200)
        rows.append((r.choice("ab"), a, a + r.choice([-3, 0, 1, 16, 64, 150]), r.choice([None, *range(5)]), i))
    return rows + [("c", 0, 64, 3, 1), ("c", 0, 64, 1, 2), (None, 0, 5, 2, 1), ("a", None, 5, 2, 99), ("a", 5, None, 2, 98)]


def on(rows, key, frame, reduction, fill):
    own = [(o, s) for k, a, z, s, o in rows if k == key and a is not None and z is not None and a <= frame < z]
    known = [s for _, s in own if s is not None]
    got = {"max": lambda: max(known), "mean": lambda: sum(known) / len(known), "first": lambda: min(own)[1], "last": lambda: max(own)[1]}
    need = known if reduction in ("max", "mean") else own
    value = got[reduction]() if need else None
    return fill if value is None else value


SCHEMA = "k string, a long, z long, s long, o long"


@pytest.mark.parametrize("reduction", ["max", "mean", "first", "last"])
def test_projection_against_frames(spark, reduction):
    """Empty and reversed intervals cover no frame."""
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA)
    grid = [(k, f) for k in ("a", "b", "c", "d", None) for f in range(-80, 300, 3)]
    got = {(r["k"], r["frame"]): r["score"] for r in intervals.project(df, spark.createDataFrame(grid, "k string, frame long"), "k", "a", "z", "s", "o", reduction, -1.0).collect()}
    assert got == pytest.approx({(k, f): float(on(rows, k, f, reduction, -1)) for k, f in grid})
    videos = [("a", 130), ("b", 64), ("c", 65), ("d", 1), ("e", 0), (None, 3)]
    got = {(r["k"], r["frame"]): r["score"] for r in intervals.project_all(df, spark.createDataFrame(videos, "k string, n long"), "k", "n", "a", "z", "s", "o", reduction).collect()}
    assert got == pytest.approx({(k, f): float(on(rows, k, f, reduction, 0)) for k, n in videos for f in range(n)})


def test_frames_are_made_after_the_last_shuffle(spark):
    df = spark.createDataFrame([("a", 0, 16, 1, 0)], SCHEMA)
    out = intervals.project_all(df, spark.createDataFrame([("a", 20)], "k string, n long"), "k", "n", "a", "z", "s", "o", "mean")
    shuffled = out._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)  # the plan begins with its last step
    assert "explode(sequence(__lo" in shuffled[0] and "explode(sequence(__lo" not in shuffled[1]


def test_last_writer_of_videos_without_frames(spark):
    videos, spans = spark.createDataFrame([("a", 3), ("b", 0)], "k string, n long"), spark.createDataFrame([("a", 1, 3, 1, 0), ("a", 2, 2, 0, 1)], "k string, a long, z long, y int, o long")
    got = sorted(map(tuple, intervals.last_writer_labels(videos, spans, "k", "n", "a", "z", "y", "o").collect()))
    assert got == [("a", 0, 0), ("a", 1, 1), ("a", 2, 1)]


def test_maximum_runs_against_frames(spark):
    rows = [r for r in made(2) if r[3] is not None]
    want = []
    for k in ("a", "b", "c", None):
        at = {}
        for f in range(-80, 400):
            own = [s for q, a, z, s, _ in rows if q == k and a is not None and z is not None and a <= f < z]
            if own:
                at[f] = (max(own), len(own))
        for f in sorted(at):
            if f - 1 in at and at[f - 1] == at[f]:
                want[-1][2] = f + 1
            else:
                want.append([k, f, f + 1, *at[f]])
    got = intervals.dense_max_runs(spark.createDataFrame(rows, SCHEMA), "k", "a", "z", "s").select("k", "lo", "hi", "score", "contributors").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_evaluation_by_frames_and_by_intervals(spark):
    rows = [r for r in made(3) if r[0] in ("a", "b")]
    spans = [(k, a, a + 10, (a // 10 + (k == "a")) % 2) for k in "ab" for a in range(0, 260, 10)] + [("a", 5, 5, 1)]
    labels = spark.createDataFrame(spans, "k string, x long, y long, label int")
    frames = labels.filter("y > x").select("k", F.explode(F.sequence("x", F.col("y") - 1)).alias("frame"), "label")
    df = spark.createDataFrame(rows, SCHEMA)
    one = sequences.evaluate_predictions(df, frames, "k", "a", "z", "s", "o").first()
    two = sequences.evaluate_predictions(df, labels, "k", "a", "z", "s", "o", label_span=("x", "y")).first()
    flat = [(on(rows, k, f, "max", 0), y) for k, a, z, y in spans for f in range(a, z)]
    p, n = [s for s, y in flat if y], [s for s, y in flat if not y]
    auc = sum((s > t) + (s == t) / 2 for s in p for t in n) / len(p) / len(n)
    assert one["auc"] == pytest.approx(auc) and one == two and (one["frames"], one["positive_frames"], one["videos"]) == (len(flat), len(p), 2)
    with pytest.raises(ValueError, match="differ"):
        sequences.evaluate_predictions(df.filter("k = 'a'"), labels, "k", "a", "z", "s", "o", label_span=("x", "y"))


def test_clips_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from chronolith.plans import bindings

    b = lambda: bindings.Bindings(spark, "/root/testdata/sf0.001")
    rows = b().table("lineitem").count()
    plain = sorted(map(tuple, b().clip.collect()))
    monkeypatch.setattr(bindings, "TASK_ROWS", rows // 9)
    many = b()
    assert many.clip.rdd.getNumPartitions() >= 9 and many.clip_tasks >= 9 and sorted(map(tuple, many.clip.collect())) == plain
    one = intervals.dense_mean_runs(many.clip, "video_id", "frame_start", "frame_end", "score_c")
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and one.rdd.getNumPartitions() >= 9


def test_targets_in_more_tasks(spark):
    tokens = [("a", i, i + 16) for i in range(0, 200, 8)] + [("a", 0, 16), ("b", 3, 9), ("c", None, 4)]
    spans = [("a", 5, 8, 1), ("a", 60, 130, 1), ("a", 100, 101, 0), ("b", 0, 100, 1), ("b", 0, 99, 1)]
    t, s = spark.createDataFrame(tokens, "k string, a long, z long"), spark.createDataFrame(spans, "k string, s long, e long, y int")
    meets = lambda k, a, z: any(k == q and y and min(z, e) - max(a, f) >= 0.25 * (z - a) and min(z, e) > max(a, f) for q, f, e, y in spans)
    want = {(k, a, z): int(a is not None and meets(k, a, z)) for k, a, z in tokens}
    for tasks in (None, 7):
        out = intervals.overlap_targets(t, s, "k", "a", "z", "s", "e", "y", 0.25, tasks=tasks)
        assert {(r["k"], r["a"], r["z"]): r["target"] for r in out.collect()} == want and out.count() == len(want)


def test_candidates_that_are_named(spark):
    spans = spark.createDataFrame([("a", 3, 8), ("a", 20, 30), ("b", 1, 2)], "k string, lo long, hi long")
    c = sequences.candidate_spans(spans, "k", "lo", "hi", [-1, 0, 1], [False, True])
    one, two = (sorted(map(tuple, sequences.compare_candidates(c, spans, "k", *more).collect())) for more in ((), (list(range(6)),)))
    assert one == two and one[2] == (2, 0, 2, 2)


def test_slots_of_slices_are_dealt_without_a_number_for_each():
    """Every task that follows the halves to its slice finds what the whole deal gives it."""
    import numpy as np

    from chronolith.operators import resampling

    draws = np.arange(5, 40, 3)
    whole = resampling.halves("c", np.arange(50), 10**9 + 7, 10**9 + 7, 2 * 10**8)
    assert (sum(whole.values()) == 10**9 + 7).all() and len(whole) == 6
    for i in range(6):
        assert (resampling.halves("c", draws, 10**9 + 7, 10**9 + 7, 2 * 10**8, i)[i] == whole[i][draws]).all()
    assert abs(whole[0].mean() / 2e8 - 1) < 0.001 and whole[0].std() > 1000 and abs(whole[5].mean() - 7) < 3


def test_rates_against_times(spark):
    """Frames of a rate are the same by bounds in frames as by their times, also where a time meets a bound."""
    from chronolith.operators import grids

    r = random.Random(7)
    rows = [(r.choice("abcde"), a, a + r.choice([0.0, 1 / 24, 0.1, 3.0]), float(r.randint(0, 9)), r.choice([None, 1, 2, 3])) for a in (r.choice([i / 24, i * 0.3, -0.5]) for i in range(120))]
    rows += [("a", float("nan"), 1.0, 1.0, 1), ("a", 0.0, float("inf"), 1.0, 1), ("a", 0.0, 5.0, None, 1), (None, 0.0, 5.0, 1.0, 1), ("a", -9.0, 9e9, 4.0, 2)]
    df = spark.createDataFrame(rows, "k string, a double, z double, s double, o int")
    videos = spark.createDataFrame([("a", 100, 24.0), ("b", 70, 30.0), ("c", 64, None), ("d", 5, 0.0), ("e", 129, 23.976), ("f", 2, 10.0), (None, 2, 10.0), ("g", 0, 1.0)], "k string, n long, fps double")
    want = grids.project_times(df, grids.frame_times(videos, "k", "n", "fps"), "k", "a", "z", "s", "o", "time", fill=-1.0).drop("time").collect()
    got = grids.project_rate(df, videos, "k", "a", "z", "s", "o", "n", "fps", fill=-1.0)
    assert got.columns == ["k", "frame", "score_max", "score_mean", "score_first", "score_last"]
    plain = lambda rows: sorted(((x[0] or "", x[1], x[2], round(x[3], 9), x[4], x[5]) for x in rows))
    assert plain(got.collect()) == plain(want) and len(want) == 372


def test_clips_of_short_and_of_empty_regions(spark):
    from chronolith.operators import sampling

    df = spark.createDataFrame([(0, 20), (3, 5), (4, 4), (0, 100), (7, 16)], "a long, z long")
    for clip, stride, position in ((8, 2, "center"), (4, 3, "start")):
        indices, valid = sampling.fixed_clip(F.col("a"), F.col("z"), clip, stride, position)
        out = df.select("a", "z", indices.alias("i"), valid.alias("v"))
        assert "lambda" not in out._jdf.queryExecution().analyzed().toString()
        for a, z, i, v in out.collect():
            span = (clip - 1) * stride + 1
            raw = [a + (max(0, (z - a - span) // 2) if position == "center" else 0) + k * stride for k in range(clip)]
            inside = [x for x in raw if x < z]
            assert i == [min(x, max(inside)) if inside else x for x in raw] and v == [x < z for x in raw]
