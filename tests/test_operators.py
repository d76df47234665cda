"""Known values and edge cases of the operators."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import attention, audit, intervals, losses, metrics, neardup, resampling, sampling, selection, stats, store, vectors
from chronolith.sources import records, texts
from chronolith.streaming import cache_state, counts


def scores(spark, y, s):
    return spark.createDataFrame(list(zip(map(float, s), map(int, y))), "s double, y int")


@pytest.mark.parametrize(("y", "s", "auc", "ap"), [([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75, 5 / 6), ([0, 1, 1, 0], [1, 1, 1, 1], 0.5, 0.5), ([1] * 6 + [0] * 6, [1] * 12, 0.5, 0.5)])
def test_auc_and_ap(spark, y, s, auc, ap):
    df = scores(spark, y, s)
    assert metrics.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(auc)
    assert metrics.precision_recall(df, "s", "y").first()["step_ap"] == pytest.approx(ap)


def test_one_class(spark):
    assert metrics.roc_auc(scores(spark, [1, 1], [1, 2]), "s", "y").first()["auc"] is None
    r = metrics.precision_recall(scores(spark, [0, 0], [1, 2]), "s", "y").first()
    assert r["step_ap"] is None and r["pr_trapezoid"] == 0.5


def test_auc_of_many_distinct_scores(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 3000), rng.random(3000)
    s[:500] = 0.5
    wins = (s[y == 1][:, None] > s[y == 0]).sum() + 0.5 * (s[y == 1][:, None] == s[y == 0]).sum()
    assert metrics.roc_auc(scores(spark, y, s), "s", "y").first()["auc"] == pytest.approx(wins / (y.sum() * (1 - y).sum()))


def test_dense_windows(spark):
    v = spark.createDataFrame([("a", 10), ("b", 44), ("c", 3)], "id string, n long")
    got = sampling.dense_windows(v, "id", "n", 3, 2, 3).filter("id = 'a'").orderBy("start").collect()
    assert [(r["start"], r["end"], r["end_anchored"]) for r in got] == [(0, 5, False), (3, 8, False), (5, 10, True)]
    last = sampling.dense_windows(v, "id", "n", 16, 2, 4).filter("id = 'b'").orderBy(F.desc("start")).first()
    assert (last["start"], last["end"], last["end_anchored"]) == (13, 44, True)


def test_dense_mean(spark):
    rows = spark.createDataFrame([("a", 0, 5, 1), ("a", 3, 8, 4), ("a", 5, 10, 7)], "id string, s long, e long, v long")
    runs = intervals.dense_mean_runs(rows, "id", "s", "e", "v").orderBy("lo").collect()
    frames = [r["total"] / r["contributors"] for r in runs for _ in range(r["lo"], r["hi"])]
    assert frames == [1, 1, 1, 2.5, 2.5, 5.5, 5.5, 5.5, 7, 7]


def test_two_level_mean(spark):
    rows = spark.createDataFrame([("n0", 1, 0, 0), ("n1", 1, 2, 0), ("p0", 1, 3, 1), ("p0", 2, 5, 1), ("p1", 1, 5, 1)], "v string, c int, x int, y int")
    got = {r["v"]: r["video_mean"] for r in stats.two_level_mean(rows.withColumn("s", F.lit(0)), ["s"], "v", "c", "x", "y").collect()}
    assert got == {"n0": 0, "n1": 2, "p0": 4, "p1": 5}


def test_quotas(spark):
    v = spark.createDataFrame([("a", 10)], "id string, n long")
    assert [selection.group_quotas(v, "id", "n", r).first()["quota"] for r in (0.8, 0.6, 0.4)] == [8, 6, 4]


def test_snapped_quotas(spark):
    v = spark.createDataFrame([("a", 1568)], "id string, n long")
    q = selection.snap_quotas(selection.group_quotas(v, "id", "n", 0.6), "id", "group_index", "quota", 14)
    total = q.agg(F.sum("snapped")).first()[0]
    assert total % 14 == 0 and 941 - 14 < total <= 941


def brute_metrics(scores, pos, neg):
    """ROC AUC, PR area by trapezoids from (0, 1), and step AP of weighted rows."""
    order = sorted(set(scores), reverse=True)
    p, n = ([sum(x for s, x in zip(scores, c) if s == t) for t in order] for c in (pos, neg))
    if not sum(p) or not sum(n):
        return [float("nan")] * 3
    tp = fp = auc = pr = ap = 0.0
    last = 1.0
    for a, b in zip(p, n):
        tp, fp = tp + a, fp + b
        auc += a * (sum(n) - fp + b / 2)
        prec = tp / (tp + fp) if tp + fp else 1.0
        pr, ap, last = pr + a * (last + prec) / 2, ap + a * prec, prec
    return [auc / sum(p) / sum(n), pr / sum(p), ap / sum(p)]


@pytest.mark.parametrize("each, slice_, scores", [(100_000, 16_384, 9), (20, 16_384, 9), (20, 2, 9), (100_000, 3, 10**6)])
def test_bootstrap_against_brute_force(spark, each, slice_, scores):
    import random

    r = random.Random(4)
    rows = [(v, s, r.randint(0, scores), r.randint(0, 3) * (v % 2), r.randint(0, 4)) for v in range(9) for s in (0, 1) for _ in range(4)]
    hist = spark.createDataFrame(rows, "video long, system int, score int, pos_frames long, neg_frames long")
    videos = spark.createDataFrame([(v, v % 2) for v in range(9)], "video long, label int")
    got = {x["metric"]: x for x in resampling.paired_bootstrap(hist, videos, "video", "label", draws=150, each=each, slice_=slice_).collect()}
    items = resampling.numbered(videos.select("video", F.concat(F.lit("20260918|paired|"), "label").alias("cell")), "cell", "video", slice_).collect()
    assert sorted((x["cell"][-1], x["idx"], x["n"]) for x in items) == [("0", i, 5) for i in range(5)] + [("1", i, 4) for i in range(4)]
    w = {}
    for cell, n in {(x["cell"], x["n"]) for x in items}:
        if n <= slice_:
            w[cell] = resampling.weights(cell, np.arange(150), n)
        else:
            c = resampling.dealt(cell, np.arange(150), n, np.arange(n), slice_)
            w[cell] = np.concatenate([resampling.weights(f"{cell}|{k}", np.arange(150), min(slice_, n - k * slice_), c[:, k]) for k in range(c.shape[1])], 1)
        assert (w[cell].sum(1) == n).all() and w[cell].std() > 0.5
    own = {x["video"]: (x["cell"], x["idx"]) for x in items}
    deltas = []
    for d in range(-1, 150):
        times = {v: 1 if d < 0 else w[c][d, i] for v, (c, i) in own.items()}
        each_ = [brute_metrics(*zip(*[(sc, p * times[v], n * times[v]) for v, s, sc, p, n in rows if s == system])) for system in (0, 1)]
        deltas.append([b - a for a, b in zip(*each_)])
    for i, m in enumerate(("frame_roc_auc", "frame_pr_auc", "frame_ap")):
        draws = np.array([x[i] for x in deltas[1:]])
        assert got[m]["point"] == pytest.approx(deltas[0][i]) and got[m]["valid_draws"] == 150 and got[m]["status"] == "available"
        assert [got[m]["lower"], got[m]["upper"]] == pytest.approx(np.percentile(draws, [2.5, 97.5]).tolist())


@pytest.mark.parametrize("keys_each, rows_each", [(512, 1_000_000), (3, 10), (1, 1)])
def test_pair_wins_against_brute_force(spark, keys_each, rows_each):
    import random

    r = random.Random(12)
    rows = [(r.choice([None, "a", "b", "c", "d", "e", "f", "g"]), r.choice([None, *range(9)]), r.randint(0, 2), r.randint(0, 2) * 10**r.choice([0, 9])) for _ in range(120)]
    hist = spark.createDataFrame(rows, "k string, score int, pos_frames long, neg_frames long")
    want = {}
    for k, s, p, _ in rows:
        for o, t, _, n in rows:
            wins = p * n * (2 if s > t else 1) if None not in (k, s, o, t) and s >= t else 0
            if wins:
                want[k, o] = want.get((k, o), 0) + wins
    assert {(x["k"], x["other"]): x["twice_wins"] for x in metrics.pair_wins(hist, "k", "score", keys_each, rows_each).collect()} == want
    assert metrics.pair_wins(hist.limit(0), "k", "score").count() == 0


def test_draws_are_uniform():
    w = resampling.weights("a", np.arange(20_000), 5)
    assert abs(w.mean(0) - 1).max() < 0.03 and abs(w.var(0) - 0.8).max() < 0.05  # binomial(5, 1/5)
    c = resampling.dealt("a", np.arange(5000), 10, np.arange(10), 4)
    assert abs(c.mean(0) - [4, 4, 2]).max() < 0.1 and (c.sum(1) == 10).all()
    assert len({tuple(x) for x in resampling.weights("a", np.arange(100), 50).tolist()}) == 100
    assert (resampling.weights("a", np.arange(3, 9), 7) == resampling.weights("a", np.arange(20), 7)[3:9]).all()


def test_hedges_contrast_redraws(spark):
    rows = [("a", 0, 1.0, 0), ("a", 1, 2.0, 0), ("a", 2, 4.0, 1), ("a", 3, 5.0, 1), ("b", 4, 1.0, 0), ("c", 5, 1.0, 0), ("c", 6, 1.0, 0), ("c", 7, 3.0, 1), ("c", 8, 3.0, 1), (None, 9, 1.0, 0), (None, 10, 5.0, 0), (None, 11, 9.0, 1), (None, 12, 7.0, 1),
            (None, 13, None, 1), (None, 14, 1.0, None)]
    df = spark.createDataFrame(rows, "site string, v long, x double, y int")
    got = {r["site"]: r for r in resampling.hedges_contrast(df, ["site"], "v", "x", "y", draws=300).collect()}
    a = got["a"]
    assert a["valid_draws"] == 300 and 300 < a["attempts"] < 600 and a["ci_low"] <= a["ci_high"] and a["status"] == "available"
    assert (got["b"]["reason"], got["c"]["reason"], got[None]["reason"]) == ("too_few", "no_variance", None)
    assert got["c"]["mean_difference"] == 2.0 and got["c"]["effect"] is None and got["c"]["ci_low"] is None
    # the draws by hand: the first 300 with variance
    cell = {y: f"20260918|hedges|a|{y}" for y in (0, 1)}
    items = resampling.numbered(df.filter("site = 'a'").withColumn("cell", F.concat(F.lit("20260918|hedges|a|"), "y")), "cell", "v").collect()
    values = {c: np.array([r["x"] for r in sorted((r for r in items if r["cell"] == c), key=lambda r: r["idx"])]) for c in cell.values()}
    g, attempts = [], 0
    for d in range(6000):
        p, n = (np.repeat(values[cell[y]], resampling.weights(cell[y], np.array([d]), 2)[0]) for y in (1, 0))
        spread = p.var(ddof=1) + n.var(ddof=1)
        attempts += 1
        if spread > 0:
            g.append((1 - 3 / 7) * (p.mean() - n.mean()) / np.sqrt(spread / 2))
        if len(g) == 300:
            break
    assert attempts == a["attempts"] and [a["ci_low"], a["ci_high"]] == pytest.approx(np.percentile(g, [2.5, 97.5]).tolist())
    assert resampling.hedges_contrast(df.limit(0), ["site"], "v", "x", "y", draws=50).count() == 0


MATCHED = "site string, video string, x double, y int, motion string, light string"


def matched(spark, rows, **more):
    df = spark.createDataFrame([("s", v, float(x), y, m, b) for v, x, y, m, b in rows], MATCHED)
    return resampling.matched_contrast(df, ["site"], ["motion", "light"], "video", "x", "y", **more).first()


def test_matched_contrast(spark):
    one = [("n0", 0, 0, "low", "low"), ("n1", 2, 0, "low", "low"), ("p0", 1, 1, "low", "low"), ("p1", 5, 1, "low", "low")]
    fixed = matched(spark, [("n0", 0, 0, "low", "low"), ("p0", 2, 1, "low", "low"), *[(f"n{i}", 0, 0, "high", "high") for i in (1, 2, 3)], ("p1", 10, 1, "high", "high"), ("p2", 10, 1, "high", "high")], draws=200)
    assert fixed["effect"] == pytest.approx(22 / 3) and fixed["weight_mass"] == 3 and fixed["reason"] == "degenerate"
    # all 16 equally likely draws of one stratum give -1 to 5, 1 2 3 4 3 2 1 times
    got = matched(spark, one, draws=16_000)
    assert got["effect"] == 2 and (got["ci_low"], got["ci_high"]) == (-1, 5) and got["valid_draws"] == 16_000 and got["status"] == "available"
    w = {y: resampling.weights(f"20260918|matched|s|low|low|{y}", np.arange(16_000), 2) for y in (0, 1)}
    both = (w[1] @ np.array([1, 5]) - w[0] @ np.array([0, 2])) / 2
    assert np.abs(np.bincount((both + 1).astype(int), minlength=7) / 16_000 - np.array([1, 2, 3, 4, 3, 2, 1]) / 16).max() < 0.015
    alone = matched(spark, [("n0", 0, 0, "low", "low"), ("p0", 1, 1, "low", "low"), ("n1", 2, 0, "high", "high"), ("p1", 3, 1, "high", "high")], draws=100)
    assert alone["reason"] == "degenerate" and alone["effect"] == 1 and alone["ci_low"] is None and alone["valid_draws"] == 100
    sides = matched(spark, one + [("n2", 100, 0, "high", "high"), ("p2", -100, 1, None, "high"), ("p3", 7, 1, "unknown", "low")], draws=100)
    assert (sides["effect"], sides["retained_normal"], sides["retained_positive"], sides["excluded_unknown"], sides["excluded_one_sided"], sides["weight_mass"]) == (2, 2, 2, 2, 1, 2)
    few = matched(spark, one[:3], draws=100)
    assert few["reason"] == "too_few" and few["effect"] is None and few["valid_draws"] == 0
    # strata whose mean differences are alike still have draws that differ; the order of rows and other sites change nothing
    same = [(f"{k}{g}{i}", off + v + (k == "p"), int(k == "p"), g, g) for g, off in (("low", 0), ("high", 100)) for i, v in enumerate((0, 10)) for k in "np"]
    a, b = matched(spark, same, draws=1000), matched(spark, same[::-1], draws=1000)
    assert a == b and a["effect"] == pytest.approx(1) and a["ci_high"] - a["ci_low"] > 1
    assert resampling.matched_contrast(spark.createDataFrame([], MATCHED), ["site"], ["motion"], "video", "x", "y", draws=10).count() == 0


def test_large_cells_are_drawn_in_slices(spark):
    df = spark.createDataFrame([("s", str(i), float(i % 17), i % 2, "m", "b") for i in range(600)], MATCHED)
    whole = resampling.matched_contrast(df, ["site"], ["motion"], "video", "x", "y", draws=400).first()
    parts = resampling.matched_contrast(df, ["site"], ["motion"], "video", "x", "y", draws=400, each=50).first()
    assert parts["effect"] == pytest.approx(whole["effect"]) and parts["valid_draws"] == 400
    assert parts["ci_high"] - parts["ci_low"] == pytest.approx(whole["ci_high"] - whole["ci_low"], rel=0.2)


def test_decision_keeps_the_margin(spark):
    rows = [(0.0, -0.005 - 1e-16, 0.1, 1000), (0.0, -0.004, 0.1, 1000), (-0.05, -0.1, -0.006, 1000), (0.0, -0.1, 0.1, 1000), (0.0, 0.0, 0.1, 900), (None, 0.0, 0.1, 1000)]
    status, verdict = stats.decision(F.col("p"), F.col("l"), F.col("u"), F.col("n"), 1000)
    got = [r["d"] for r in spark.createDataFrame(rows, "p double, l double, u double, n int").select(verdict.alias("d")).collect()]
    assert got == ["supported", "supported", "inferior", "inconclusive", "NA", "NA"]


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, float(i), int(i % 3 != 0), i * i) for k in (1, 2) for i in range(30)], "k long, seq long, t double, hit int, v long")
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    fires = counts.run_available(counts.debounce_stream(stream, "k", "seq", "t", "hit", 2, 5.0), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted(fires.collect()) == sorted(counts.debounce(rows, "k", "seq", "t", "hit", 2, 5.0).collect())
    stream = spark.readStream.schema(rows.schema).parquet(src)
    wins = counts.run_available(counts.sliding_stream(stream, "k", "seq", "v", 8, 4), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted(map(tuple, wins.collect())) == sorted(map(tuple, counts.sliding(rows, "k", ["seq"], "v", 8, 4).collect()))


def test_debounce_counts_anew():
    d = counts.Debounce(2, 10.0)
    assert [d.push(t, True) for t in range(14)] == [False, True, *[False] * 9, True, False, False]


def test_hamming_blocks(spark):
    df = spark.createDataFrame([("0" * 32, "0" * 31 + "7"), ("f" * 32, "f" * 32)], "a string, b string")
    assert [r[0] for r in df.select(text.hamming_hex(F.col("a"), F.col("b"))).collect()] == [3, 0]


def test_near_pairs(spark):
    rows = [(k, p, f"{p * 1000 + (k == 9) * 7:08x}" * 4) for k in (1, 2) for p in range(5)] + [(3, p, f"{p + 77777:08x}" * 4) for p in range(5)]
    got = neardup.block_pairs(spark.createDataFrame(rows, "k long, pos int, h string"), "k", "pos", "h").collect()
    assert [(r["k"], r["other"], r["matches"], r["longest"]) for r in got] == [(1, 2, 5, 5)]
    gap = [r for r in rows if r[:2] != (2, 2)]  # a position that one lacks ends the row of matches
    assert neardup.block_pairs(spark.createDataFrame(gap, "k long, pos int, h string"), "k", "pos", "h").count() == 0
    got = neardup.block_pairs(spark.createDataFrame(gap, "k long, pos int, h string"), "k", "pos", "h", run=2).collect()
    assert [(r["matches"], r["longest"]) for r in got] == [(4, 2)]


def test_upsert_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert {tuple(r) for r in store.upsert(a, a.limit(1).withColumn("v", F.lit("z")), ["k"]).collect()} in ({(1, "z"), (2, "y")}, {(1, "x"), (2, "z")})
    with pytest.raises(ValueError, match="repeat"):
        store.upsert(a, a.union(a), ["k"])


def test_annotation_lines(spark):
    rows = spark.createDataFrame([("Abuse028_x264.mp4  Abuse  165  240  -1  -1",), ("a.mp4 Normal 5 9 -1 -1",), ("b.mp4 Fight 9 5 -1 -1",), ("c.mp4 Fight 1 9 5 12",), ("bad",), ("d.mp4 300 Fight 1 9 20 30",)], "value string")
    got = {r["video_id"]: (r["issue"], [tuple(s) for s in r["spans"]]) for r in texts.temporal_annotations(rows).collect()}
    assert got["abuse028_x264"] == (None, [(164, 240)])
    assert got["d"] == (None, [(0, 9), (19, 30)])
    assert [got[k][0] for k in ("a", "b", "c", "bad")] == ["normal with span", "reversed", "overlap", "width"]


def test_labels_and_times(spark):
    df = spark.createDataFrame([("x__#1_label_B1-B2-0.mp4", "1:02:03"), ("y_label_A.mp4", "2:30"), ("z.mp4", "-1:00"), ("a/_label_A.mp4", ""), ("w_label_B1-0-G.mp4", ""), ("w_label_B3.mp4", ""), ("w_label_G.avi", "")], "n string, t string")
    got = df.select(texts.label_classes(F.col("n")), text.clock_seconds(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["B1", "B2", "0"], 3723.0), (["A"], 150.0)] + [(None, None)] * 5


def test_zip_directory(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.txt", "x" * 1000)
        z.writestr("d/two.txt", "y")
    got = texts.zip_directory(spark, str(tmp_path / "a.zip")).orderBy("name").collect()
    assert [(r["name"], r["size"]) for r in got] == [("d/two.txt", 1), ("one.txt", 1000)]


def test_truth_issues(spark):
    rows = [("ok", 1, 10, [(0, 4, 0), (4, 10, 1)]), ("gap", 1, 10, [(0, 4, 0), (5, 10, 1)]), ("weak", 0, 4, [(0, 4, 1)])]
    got = {r["video_id"]: r["reason"] for r in records.truth_issues(spark.createDataFrame(rows, records.TRUTH)).collect()}
    assert got == {"gap": "not tiled", "weak": "positive in a normal video"}


def test_hinge_over_all_pairs(spark):
    bags = [(1, 3.0), (1, 1.5), (0, 2.0), (0, 0.5), (0, 4.0)]
    want = np.mean([max(0, 1 - p + n) for y, p in bags if y for z, n in bags if not z])
    assert losses.ranking_loss_all_pairs(spark.createDataFrame(bags, "y int, m double"), "y", "m", 1.0).first()["loss"] == pytest.approx(want)


def test_issues_raise(spark):
    audit.require_empty(spark.range(0).toDF("x"), "none")
    with pytest.raises(ValueError, match="some"):
        audit.require_empty(spark.range(1).toDF("x"), "some")


def test_softmax_and_errors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [True, False, True], [1.0, 2.0, 2.0])], "v array<double>, m array<boolean>, w array<double>")
    p, e, m = df.select(vectors.masked_softmax(F.col("v"), F.col("m")), vectors.relative_error("v", "w"), vectors.max_abs_error("v", "w")).first()
    assert p[1] == 0 and sum(p) == pytest.approx(1) and p[2] / p[0] == pytest.approx(np.e**2)
    assert e == pytest.approx(1 / 9) and m == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "s double, y int")
    assert metrics.roc_auc(none, "s", "y").first()["auc"] is None
    v = spark.createDataFrame([], "id string, n long")
    assert sampling.uniform_segments(v, "id", "n", 4).count() == 0 and sampling.dense_windows(v, "id", "n", 3, 1, 1).count() == 0


def test_captions_and_spans(spark):
    rows = spark.createDataFrame([("Abuse028_x264 0:01 1:02.5 ##A man falls",), ("bad line",)], "value string")
    got = texts.captions(rows).collect()
    assert tuple(got[0]) == ("abuse028_x264", 1.0, 62.5, "A man falls") and got[1]["start"] is None
    spans = texts.variable_spans(spark.createDataFrame([("v1 3 9 12 20",), ("v2",), ("v3 1 2 3",)], "value string")).collect()
    assert [([tuple(s) for s in r["spans"]], r["even"]) for r in spans] == [([(3, 9), (12, 20)], True), ([], True), ([(1, 2)], False)]
    rows = ["# a comment", "a_label_A.mp4 -1 -1", "b_label_A.mp4 3 9", "c_label_G.mp4", "d_label_G.mp4 5 2", "e_label_G.mp4 1 x", "f_label_G.mp4 1 2 3", "g_label_G.mp4 4 4"]
    got = texts.variable_spans(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r["issue"] for r in got] == [None, "label", "label", "order", "number", "odd count", None]


def test_dense_issues_and_short_videos(spark):
    clips = [("ok", 0, 4, 1.0), ("ok", 4, 8, 1.0), ("nan", 0, 8, float("nan")), ("nan", 9, 8, 1.0), ("null", 0, 8, None), ("rev", 4, 4, 1.0), ("rev", 0, 8, 1.0), ("long", 0, 9, 1.0), ("gap", 0, 3, 1.0), ("gap", 4, 8, 1.0), ("neg", -1, 8, 1.0)]
    videos = spark.createDataFrame([(k, 8) for k in ("ok", "nan", "null", "rev", "long", "gap", "neg", "none")], "id string, n long")
    got = intervals.dense_issues(spark.createDataFrame(clips, "id string, a long, b long, s double"), "id", "a", "b", "s", videos, "n").collect()
    assert dict(map(tuple, got)) == {"nan": "not finite", "null": "not finite", "rev": "invalid interval", "long": "invalid interval", "gap": "uncovered", "neg": "invalid interval", "none": "no intervals"}
    v = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), ("d", None)], "id string, n long")
    took = sampling.dense_windows(v, "id", "n", 3, 2, 1, stride1_if_needed=True).collect()
    assert [(r["id"], r["start"], r["end"]) for r in took] == [("a", 0, 5), ("b", 0, 3)]
    assert [r["id"] for r in sampling.short_videos(v, "id", "n", 3, 2, True).collect()] == ["c", "d"]


def test_paths_and_names(spark):
    df = spark.createDataFrame([("a\\b/c.mp4",), ("/abs",), ("a/../b",), ("C:/x",), ("a//b",), ("ok",)], "p string")
    assert [r[0] for r in df.select(text.relative_path(F.col("p"))).collect()] == ["a/b/c.mp4", None, None, None, None, "ok"]
    names = spark.createDataFrame([("x/Vid_C.npy",), ("y\\Vid__12.MP4",), ("Vid.txt",)], "p string")
    assert {r[0] for r in names.select(text.canonical_id(F.col("p"))).collect()} == {"vid"}


def test_label_table_keeps_vanished_rows(spark, tmp_path):
    (tmp_path / "l.csv").write_text("video_id,video_path,label\nv1,old/v1.mp4,Fight\nv9,old/v9.mp4,Fall\n")
    old = records.read_labels_csv(spark, str(tmp_path / "l.csv"))
    listing = spark.createDataFrame([("v1", "A/cam1/v1.mp4"), ("v2", "B/cam2/v2.mp4"), ("v3", "v3.mp4")], "video_id string, video_path string")
    got = {r["video_id"]: (r["video_path"], r["label"], r["camera_id"]) for r in records.update_labels(old, listing, "none").collect()}
    assert got == {"v1": ("A/cam1/v1.mp4", "Fight", ""), "v2": ("B/cam2/v2.mp4", "B", "cam2"), "v3": ("v3.mp4", "none", ""), "v9": ("old/v9.mp4", "Fall", "")}


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"video_id": "a", "weak_label": 1, "num_frames": 4, "intervals": []}\n{"video_id": \n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        records.read_jsonl(spark, str(tmp_path / "m.jsonl"), records.TRUTH).collect()
    loose = records.read_jsonl(spark, str(tmp_path / "m.jsonl"), records.TRUTH, strict=False).collect()
    assert len(loose) == 2 and sum(r["_corrupt_record"] is not None for r in loose) == 1


def test_plans_stay_without_pairwise_joins(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, i + 4, i % 3) for i in range(20)], "id string, s long, e long, v long")
    grid = spark.range(30).select(F.lit("a").alias("id"), F.col("id").alias("frame"))
    for df in (intervals.dense_mean_runs(rows, "id", "s", "e", "v"), intervals.project(rows, grid, "id", "s", "e", "v", "s", "max"), intervals.overlap_targets(rows, rows, "id", "s", "e", "s", "e", "v", 0.5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("v", "c", "f1", 0), ("w", "d", "f2", 1)], "video_id string, clip_id string, encoder_fingerprint string, x int").write.partitionBy("encoder_fingerprint").parquet(str(tmp_path / "i"))
    found = records.find_features(spark.read.parquet(str(tmp_path / "i")), "v", None, "f1").select("clip_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(encoder_fingerprint" in plan and "EqualTo(video_id,v)" in plan and [r[0] for r in found.collect()] == ["c"]
    assert "x:int" not in plan.split("ReadSchema")[1]


def test_names_groups_categories_and_redaction(spark):
    df = spark.createDataFrame([("A/x__#01_label_B1.mp4",), ("A/x__#2__#3.mp4",), ("B/X__#9_label_A_label_C.mp4",), ("x__#",), ("Road_ Accidents/v.mp4",), ("a/Normal_Videos_01.mp4",), ("z/Arson003_x264.mp4",), ("clip.fc6-1",)], "p string")
    got = df.select("p", text.source_group(F.col("p")).alias("g"), text.inferred_category(F.col("p")).alias("c"), text.canonical_id(F.col("p")).alias("i")).collect()
    group = [r["g"] for r in got]
    assert group[0] == group[2] != "source:unknown" and group[1] == group[3] == "source:unknown"
    assert [r["c"] for r in got[4:7]] == ["RoadAccidents", "Normal", "Arson"] and got[7]["c"] is None and got[7]["i"] == "clip"
    line = '{"a": {"api_key": "x\\"y", "session-cookie": 5, "keyboard": "q"}, "token": null, "tokens": "kept"}'
    one = spark.createDataFrame([(line,)], "t string").select(text.redact_json(F.col("t")).alias("t")).first()["t"]
    assert one == '{"a": {"api_key": "<redacted>", "session-cookie": "<redacted>", "keyboard": "q"}, "token": "<redacted>", "tokens": "kept"}'


def test_numbered_within_labels(spark):
    import random

    from chronolith.operators import selection

    r = random.Random(5)
    data = [(i, r.choice(["a", "b", None])) for i in r.sample(range(10_000), 500)]
    df = spark.createDataFrame(data, "item long, label string").repartition(7)
    got = {(x.item, x.label): (x.i, x.n) for x in selection.numbered(df, "label", selection.number_parts(df, "item"), ["item"]).collect()}
    want = {}
    for label in ("a", "b", None):
        items = sorted(i for i, v in data if v == label)
        want |= {(item, label): (k, len(items)) for k, item in enumerate(items)}
    assert got == want
    empty = df.filter("item < 0")
    assert selection.numbered(empty, "label", selection.number_parts(empty, "item"), ["item"]).count() == 0


def test_capped_take_against_greedy(spark):
    import random

    from chronolith.operators import sequences

    r = random.Random(9)
    rows = [(g * 100 + k, g % 2, g) for g in range(60) for k in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "item long, label int, grp long")
    want = set()
    for label in (0, 1):
        left = 23
        for g in range(label, 60, 2):
            own = [x for x in rows if x[2] == g]
            if len(own) <= left:
                left -= len(own)
                want |= set(own)
    assert {(x.item, x.label, x.grp) for x in sequences.capped_take(df, "label", "grp", "item", 23).collect()} == want


def test_align_gaps_and_empty_rows(spark):
    from chronolith.operators import intervals

    a = spark.createDataFrame([(1, 0, 4, 10), (1, 4, 4, 99), (1, 6, 9, 11)], "k long, a long, b long, v long")
    b = spark.createDataFrame([(1, 2, 7, "x")], "k long, a long, b long, w string")
    got = sorted(map(tuple, intervals.align([(a, "a", "b", "v"), (b, "a", "b", "w")], "k").collect()))
    assert got == [(1, 0, 2, 10, None), (1, 2, 4, 10, "x"), (1, 4, 6, None, "x"), (1, 6, 7, 11, "x"), (1, 7, 9, 11, None)]


def test_stab_across_blocks(spark):
    from chronolith.operators import intervals

    tiles = spark.createDataFrame([(1, 0, 200, "long"), (1, 200, 201, "one"), (1, 300, 300, "none")], "k long, a long, b long, v string")
    points = spark.createDataFrame([(1, 0), (1, 199), (1, 200), (1, 250), (1, 300), (2, 5)], "k long, f long")
    assert sorted((x.f, x.v) for x in intervals.stab(tiles, points, "k", "a", "b", "f").collect()) == [(0, "long"), (199, "long"), (200, "one")]


def test_ranking_loss_cyclic_uneven(spark):
    from chronolith.operators import losses

    bags = spark.createDataFrame([(1, 1, 5.0), (2, 0, 1.0), (3, 0, 4.0), (4, 1, 2.0), (5, 0, 6.0)], "k long, y int, m double")
    pairs = [(5.0, 1.0), (2.0, 4.0), (5.0, 6.0)]
    got = losses.ranking_loss_cyclic(bags, "k", "y", "m", 3.0).first()
    assert abs(got.loss - sum(max(0.0, 3 - p + q) for p, q in pairs) / 3) < 1e-12 and got.pairs == 3
    none = losses.ranking_loss_cyclic(bags.filter("y = 1"), "k", "y", "m", 3.0).first()
    assert none.loss is None and none.pairs == 0


CACHE = "k string, seq long, op string, step long, mode string, kind string, names array<string>, values array<array<double>>, times array<double>"


def cache_rows(n, seed=3):
    import random

    r = random.Random(seed)

    def one(i):
        m, names = r.randint(0, 3), r.choice([["a", "b"], ["b", "a"], ["a", "b"], ["a"], [], None, ["a", "a"]])
        values = [[float(r.randint(0, 9)) for _ in range(m)] for _ in range(len(names or []) + (r.random() < 0.05))]
        op, step = r.choice(["init"] + ["step"] * 12 + ["finalise", None, "stop"]), i // 2 + r.randint(-1, 2) if r.random() < 0.97 else None
        return r.choice(["x", "y", None]), i, op, step, r.choice(["append"] * 4 + ["replace", "keep"]), r.choice(["kv", "kv", "kv", "token"]), names, values, [i + k * (1.0 if r.random() < 0.9 else -1.0) for k in range(m)]

    return [one(i) for i in range(n)]


@pytest.mark.parametrize("keep", [None, 5])
def test_cache_stream_equals_batch_over_several_batches(spark, tmp_path, keep):
    df = spark.createDataFrame(cache_rows(320), CACHE)
    batch = sorted(map(tuple, cache_state.follow(df, "k", ["seq"], keep).collect()), key=str)
    assert {r[4] for r in batch} >= {None, "active", "inactive", "unknown_op", "step_not_above", "mode", "names", "tensors", "kind"} and len(batch) == 320
    for part in range(4):
        df.filter(F.floor(F.col("seq") / 80) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in the order of their times
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, cache_state.ROCKS)
    try:
        stream = spark.readStream.schema(CACHE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = counts.run_available(cache_state.follow_stream(stream, "k", ["seq"], keep), f"{tmp_path}/out", f"{tmp_path}/state")
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got.collect()), key=str) == batch
    assert cache_state.accepted(got).count() + cache_state.refused(got).count() == 320


def test_cache_steps_by_hand(spark):
    two = lambda *v: [[float(x) for x in v], [1.0] * len(v)]
    rows = [
        ("a", 1, "step", 1, "append", "kv", ["k", "v"], two(1), [0.0]), ("a", 2, "init", 5, None, None, None, None, None), ("a", 3, "init", 6, None, None, None, None, None), ("a", 4, "step", 5, "append", "kv", ["k", "v"], two(1), [0.0]),
        ("a", 5, "step", 6, "append", "kv", ["v", "k"], [[1.0, 1.0], [3.0, 4.0]], [0.0, 1.0]), ("a", 6, "step", 7, "append", "token", ["k", "v"], two(1), [2.0]), ("a", 7, "step", 7, "append", "kv", ["k"], [[1.0]], [2.0]),
        ("a", 8, "step", 7, "append", "kv", ["k", "v"], two(1), [0.5]), ("a", 9, "step", 7, "append", "kv", ["k", "v"], two(1), [2.0, 3.0]), ("a", 10, "step", 7, "append", "kv", ["k", "v"], two(10), [1.0]),
        ("a", 11, "step", 8, "replace", "token", ["k"], [[2.0]], [0.0]), ("a", 12, "finalise", None, None, None, None, None, None), ("a", 13, "step", 9, "append", "token", ["k"], [[2.0]], [9.0]), ("a", 14, "init", 0, None, None, None, None, None),
    ]
    got = sorted(cache_state.follow(spark.createDataFrame(rows, CACHE), "k", ["seq"]).collect(), key=lambda r: r["seq"])
    assert [r["reason"] for r in got] == ["inactive", None, "active", "step_not_above", None, "kind", "tensors", "times", "lengths", None, None, None, "inactive", None]
    assert [r["length"] for r in got] == [0, 0, 0, 0, 2, 2, 2, 2, 2, 3, 1, 1, 1, 0] and got[9]["total"] == 20.0 and [r["run"] for r in got][-2:] == [1, 2]
    assert cache_state.follow(spark.createDataFrame([], CACHE), "k", ["seq"]).count() == 0


def test_redaction_of_subtrees(spark):
    cases = {
        '{"token": {"a": "x"}, "b": 1}': '{"token": "<redacted>", "b": 1}', '{"cookie": ["a", "b"], "c": [{"password" : 1.5}]}': '{"cookie": "<redacted>", "c": [{"password" : "<redacted>"}]}', '{"x": "token", "tokens": "k"}': '{"x": "token", "tokens": "k"}',
        '{"my-secret": "}{\\"", "y": ["token", ":"]}': '{"my-secret": "<redacted>", "y": ["token", ":"]}', '{"to\\u006ben": {"token": 1}}': '{"to\\u006ben": "<redacted>"}', '{"a": {"token": }}': '{"a": {"token": }}', '{"token": {"a": 1': '{"token": "<redacted>"', '{"token": "ab': '{"token": "<redacted>"',
        "": "", "no json": "no json", '["token", 1]': '["token", 1]', '{"authorization":null}': '{"authorization":"<redacted>"}',
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    assert {r["t"]: r["o"] for r in rows.select("t", text.redact_json(F.col("t")).alias("o")).collect()} == {**cases, None: None}
    deep = '{"a":' * 3000 + '{"token":' + "[" * 3000 + "]" * 3000 + "}" + "}" * 3000
    assert text.without_secrets(deep) == '{"a":' * 3000 + '{"token":"<redacted>"}' + "}" * 3000


def test_sidecar_takes_the_last_row_and_only_labels(spark):
    rows = spark.createDataFrame([("c1", "v", 1, "old", 0), ("c1", "v", 0, "new", 1), ("c2", "w", None, None, 0)], "clip_id string, video_id string, weak_label int, scene_group string, version int").withColumn("path", F.lit("p"))
    got = {r["clip_id"]: r for r in audit.label_sidecar(rows, "clip_id", "version").collect()}
    assert got["c1"].asDict() == {"clip_id": "c1", "video_id": "v", "partition": None, "weak_label": 0, "temporal_label": None, "label_source": None, "scene_group": "new", "motion_bin": None, "category_for_analysis_only": None, "pseudo_positive": None}
    assert got["c2"]["weak_label"] is None and audit.label_sidecar(rows.limit(0), "clip_id").count() == 0


def test_comparability_without_a_reference(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "run string, frame int")
    got = {r["run"]: (r["reasons"], r["comparable"]) for r in audit.sampling_comparability(rows, "run", ["frame"], "none").collect()}
    assert got == {"a": ("no reference", False), "b": ("no reference", False)}


def test_ids_without_a_name_leak_nowhere(spark):
    rows = spark.createDataFrame([("a/.mp4", "train"), ("b/.mp4", "test"), ("x/v.mp4", "train"), ("y/V_C.avi", "test")], "path string, split string")
    assert [r["key"] for r in audit.canonical_leakage(rows, "path", "split").collect()] == ["v"]


def test_distance_kernel_sums_over_all_positions(spark):
    import math
    import random

    r = random.Random(5)
    rows = [(k, p, r.uniform(-9, 9)) for k, n in (("a", 1500), (None, 3)) for p in sorted(r.sample(range(-700, 5000), n))] + [("a", 4, 1.0), ("a", 4, 2.0), ("b", 10**12, 3.0), ("b", 10**12 + 900, -3.0), ("a", None, 1.0), ("a", 3, None)]
    got = {}
    for x in attention.distance_kernel(spark.createDataFrame(rows, "k string, p long, v double"), "k", "p", "v").collect():
        got[x["k"], x["p"]] = x["smoothed"]
    for k, p in r.sample(sorted(got, key=str), 150) + [("a", 4), ("b", 10**12)]:
        w = [(math.exp(-abs(p - q) / math.e), v) for kk, q, v in rows if kk == k and q is not None and v is not None]
        assert got[k, p] == pytest.approx(sum(a * v for a, v in w) / sum(a for a, _ in w), rel=1e-9, abs=1e-12)


def test_coordinate_redundancy(spark):
    rows = [(1, 0, 0, 0, [1.0, 0.0]), (1, 0, 0, 1, [1.0, 0.0]), (1, 0, 1, 0, [0.0, 1.0]), (1, 1, 0, 0, [1.0, 1.0]), (1, 1, 5, None, [1.0, 1.0]), (2, 0, 0, 0, [1.0, 1.0])]
    got = {(r["k"], r["kind"]): tuple(r)[2:] for r in vectors.coordinate_redundancy(spark.createDataFrame(rows, "k long, f long, r long, c long, v array<double>"), "k", "f", "r", "c", "v", 1.0).collect()}
    assert got[1, "spatial"] == (2, 0.5, 0.5, 2 / 8) and got[1, "temporal"] == (1, pytest.approx(0.5**0.5), 0.0, 1 / 4) and len(got) == 2


def test_pair_wins_with_scores_that_are_no_numbers(spark):
    rows = [("a", float("nan"), 2, 1), ("a", 1.0, 1, 0), ("b", float("nan"), 0, 3), ("b", 0.5, 1, 5), ("b", float("inf"), 1, 0)]
    hist = spark.createDataFrame(rows, "k string, score double, pos_frames long, neg_frames long")
    # NaN ties with itself and lies above all, as in Spark's order
    want = {("a", "a"): 2, ("a", "b"): 2 * (3 + 2 * 5) + 2 * 5, ("b", "b"): 5 + 2 * 5}
    assert {(r["k"], r["other"]): r["twice_wins"] for r in metrics.pair_wins(hist, "k", "score").collect()} == want


def test_pair_wins_hold_few_rows_of_a_common_key(spark, monkeypatch):
    rows = [("common", s, 1, 2) for s in range(300)] + [(f"k{i}", 5 * i, i % 2, 1) for i in range(60)]
    hist = spark.createDataFrame(rows, "k string, score int, pos_frames long, neg_frames long")
    want = {}
    for k, s, p, _ in rows:
        for o, t, _, n in rows:
            if p * n and s >= t:
                want[k, o] = want.get((k, o), 0) + p * n * (2 if s > t else 1)
    met, original = [], type(hist).mapInArrow
    monkeypatch.setattr(type(hist), "mapInArrow", lambda df, *a: met.append(df) or original(df, *a))
    assert {(r["k"], r["other"]): r["twice_wins"] for r in metrics.pair_wins(hist, "k", "score", 20, 100).collect()} == want
    # a side of a task: ranges divide the common key, and rows come one by one, not as arrays that an aggregate gathers
    assert max(r["count"] for r in met[0].groupBy("at").count().collect()) <= 200
    assert "collect_list" not in met[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("weight", [1, 10**8])
def test_pair_of_blocks_in_pieces(monkeypatch, weight):
    import random

    import pyarrow as pa

    r = random.Random(5)
    made = lambda kinds: [(r.choice("abcdefg"), r.choice(kinds), r.randint(1, 3) * r.choice([1, weight])) for _ in range(80)]
    pos, neg = made(range(20)), made([None, *range(20)])
    want = {}
    for k, s, p in pos:
        for o, t, n in neg:
            if t is None or s >= t:
                want[k, o] = want.get((k, o), 0) + p * n * (1 if s == t else 2)
    arrays = [pa.array([dict(zip(("key", "score", "w"), x)) for x in side], pa.struct({"key": pa.string(), "score": pa.float64(), "w": pa.int64()})) for side in (pos, neg)]
    monkeypatch.setattr(metrics, "PAIR_PIECE", 3)
    monkeypatch.setattr(metrics, "PAIR_SCORES", 4)
    batches = list(metrics._block_wins(*arrays))
    got = {(x["key"], x["other"]): x["twice_wins"] for b in batches for x in b.to_pylist()}
    assert len(batches) == 9 and got == want


@pytest.mark.parametrize("cost, met", [(0.01, 1_000_000), (0.01, 7), (1, 7), (300, 7)])
@pytest.mark.parametrize("weight", [1, 10**7])
def test_pair_of_blocks_in_bins(monkeypatch, weight, cost, met):
    import random

    import pyarrow as pa

    r = random.Random(6)
    scores = [None, float("nan"), float("inf"), *range(60)]
    order = lambda s: (0, 0) if s is None else (2, 0) if s != s else (1, s)
    made = lambda kinds: [(r.choice("abcdefg"), r.choice(kinds), r.randint(1, 3) * r.choice([1, weight])) for _ in range(200)]
    pos, neg = made(scores[1:]), made(scores)
    want = {}
    for k, s, p in pos:
        for o, t, n in neg:
            if order(s) >= order(t):
                want[k, o] = want.get((k, o), 0) + p * n * (1 if order(s) == order(t) else 2)
    arrays = [pa.array([dict(zip(("key", "score", "w"), x)) for x in side], pa.struct({"key": pa.string(), "score": pa.float64(), "w": pa.int64()})) for side in (pos, neg)]
    for name, value in {"PAIR_PIECE": 3, "PAIR_SCORES": 4, "PAIR_COST": cost, "PAIR_MET": met}.items():
        monkeypatch.setattr(metrics, name, value)
    assert {(x["key"], x["other"]): x["twice_wins"] for b in metrics._block_wins(*arrays) for x in b.to_pylist()} == want


def test_clocks_and_captions_by_parts(spark):
    clocks = {"0:07": 7.0, " 1:02.5 ": 62.5, "2:00:01": 7201.0, "1:2:3:4": None, "5": None, "a:1": None, ":1": None, "1:": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in clocks], "t string")
    assert {r["t"]: r["s"] for r in rows.select("t", text.clock_seconds(F.col("t")).alias("s")).collect()} == clocks
    names = {r"a\b/C.MP4": "c", "x__12.npy": "x", "v_c": "v", ".mp4": None, "": None, "d/": None, None: None}
    rows = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r["n"]: r["i"] for r in rows.select("n", text.canonical_id(F.col("n")).alias("i")).collect()} == names
    # each part of a line is matched once: the plan names each part's pattern once
    plan = texts.captions(rows.select(F.col("n").alias("value")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("##\\s*(.*)$") == 4


def test_label_fields_of_names(spark):
    want = {"a_label_A.mp4": "A", "d/a_label_B1-G-0.mp4": "B1-G-0", r"d\a_label_B6-0-0.mp4": "B6-0-0", "a_label_B1-B2-B4.mp4": "B1-B2-B4"}
    names = want | dict.fromkeys(["a_label_A-0.mp4", "a_label_B1-B1.mp4", "a_label_0.mp4", "a_label_0-B1.mp4", "a_label_B1-0-0-0.mp4", "_label_A.mp4", "a_label_label_A.mp4", "a_label_x_label_A.mp4", "a_label_.mp4", "A.mp4", "a_label_A.avi", "a_label_A/b.mp4", "a\nb_label_A.mp4", "a_label_B3.mp4", "", None])
    rows = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r["n"]: r["f"] for r in rows.select("n", F.array_join(texts.label_classes(F.col("n")), "-").alias("f")).collect()} == names
    # a label is read without functions of higher order, which Spark doesn't compile
    assert "lambda" not in rows.select(texts.label_classes(F.col("n")))._jdf.queryExecution().executedPlan().toString()


def test_cache_rows_are_taken_by_columns():
    import numpy as np
    import pandas as pd

    obj = lambda *x: np.array([*x, None], object)[:-1]
    part = pd.DataFrame({"a": [2, 1, 1], "b": [0, 5, 4], "op": ["step"] * 3, "step": [1.0, float("nan"), 3.0], "mode": ["append"] * 3, "kind": ["kv"] * 3})
    part["names"], part["values"], part["times"] = [obj("k"), None, obj("k", "v")], [obj(np.array([1.0, np.nan])), None, obj(np.array([1.0]), np.array([2.0]))], [np.array([0.0, np.nan]), None, np.array([1.0])]
    placed = cache_state._in_order(part, ["a", "b"])
    assert list(placed["b"]) == [4, 5, 0] and cache_state._in_order(placed, ["a", "b"]) is placed
    assert list(cache_state._given(placed)) == [("step", 3, "append", "kv", ["k", "v"], [[1.0], [2.0]], [1.0]), ("step", None, "append", "kv", None, None, None), ("step", 1, "append", "kv", ["k"], [[1.0, None]], [0.0, None])]
