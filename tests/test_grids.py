"""Irregular grids, roles of archive members, digests, bundles and attention by columns against brute force and known values."""

import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import attention, audit, grids, neardup, roles
from chronolith.sources import records

NAN, INF = float("nan"), float("inf")


def brute(rows, times, key):
    own = [r for r in rows if r[0] == key]
    out = []
    for t in times:
        over = sorted(((o, s) for _, a, z, s, o in own if a <= t < z))
        s = [x for _, x in over]
        out.append((max(s), sum(s) / len(s), s[0], s[-1]) if s else (0.0,) * 4)
    return out


def test_irregular_grid_is_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key in ("a", "b", "c"):
        start = np.round(rng.random(150) * 40, 1)
        length = np.where(rng.random(150) < 0.2, 30.0, np.round(rng.random(150) * 3 + 0.1, 1))
        rows += [(key, float(s), float(s + n), float(np.round(v, 2)), int(o)) for s, n, v, o in zip(start, length, rng.normal(size=150), rng.permutation(150))]
    rows.append(rows[0][:3] + (9.0, 500))  # the same bounds again
    times = sorted(rng.random(200) * 80 - 2) + [r[1] for r in rows[:20]] + [r[2] for r in rows[:20]]
    grid = spark.createDataFrame([(k, float(t), i) for k in "abcd" for i, t in enumerate(times)], "k string, t double, i int")
    got = grids.project_times(spark.createDataFrame(rows, "k string, a double, z double, s double, o int"), grid, "k", "a", "z", "s", "o", "t").collect()
    assert len(got) == 4 * len(times)
    for key in "abcd":
        want = brute(rows, times, key)
        for r in (r for r in got if r["k"] == key):
            assert (r["score_max"], r["score_mean"], r["score_first"], r["score_last"]) == pytest.approx(want[r["i"]], abs=1e-12)


def test_grid_of_odd_rows(spark):
    rows = [("a", 0.0, 2.0, 1.0), ("a", 1.0, 1.0, 5.0), ("a", 3.0, 2.0, 5.0), ("a", None, 2.0, 5.0), ("a", 0.0, INF, 5.0), ("a", 0.0, 2.0, NAN), ("a", 0.0, 2.0, None), (None, 0.0, 2.0, 7.0)]
    df = spark.createDataFrame(rows, "k string, a double, z double, s double")
    times = [("a", 0.0), ("a", 0.0), ("a", 1.999), ("a", 2.0), ("a", None), ("a", NAN), ("a", INF), ("a", -0.5), (None, 1.0)]
    grid = spark.createDataFrame(times, "k string, t double")
    got = grids.project_times(df, grid, "k", "a", "z", "s", "a", "t", ("max",), fill=-1.0)
    assert got.columns == ["k", "t", "score_max"]
    assert sorted(r["score_max"] for r in got.collect()) == [-1.0] * 6 + [1.0] * 3
    assert sorted(r["reason"] for r in grids.interval_issues(df, "k", "a", "z", "s").collect()) == ["bound", "bound", "key", "order", "order", "score", "score"]
    assert grids.project_times(df.limit(0), grid, "k", "a", "z", "s", "a", "t").filter("score_max <> 0").count() == 0
    assert grids.project_times(df, grid.limit(0), "k", "a", "z", "s", "a", "t").count() == 0


def test_frame_times(spark):
    v = spark.createDataFrame([("a", 3, 2.0), ("b", 2, None), ("c", 1, 0.0), ("d", 0, 1.0), ("e", None, 1.0), ("f", 1, NAN)], "k string, n int, fps double")
    assert {(r["k"], r["frame"]): r["time"] for r in grids.frame_times(v, "k", "n", "fps").collect()} == {("a", 0): 0.0, ("a", 1): 0.5, ("a", 2): 1.0, ("b", 0): 0.0, ("b", 1): 1.0, ("c", 0): None, ("f", 0): None}


MEMBERS = "volume string, name string, size long"


def test_roles_by_source(spark):
    names = [("train_1", f"Videos/Film {i % 20}__#{i}_label_{'A' if i % 2 else 'B1-0-0'}.mp4", i) for i in range(100)]
    names += [("train_2", "alone_label_G-0-0.mp4", 5), ("test_videos", "FILM 3__#900_label_A.mp4", 5), ("train_1", "a__#b__#c_label_A.mp4", 1)]
    files = [(f"{v}/{n}", s + (i % 3 == 0)) for i, (v, n, s) in enumerate(names) if i % 4]
    got = {r["path"]: r for r in roles.prepare(spark.createDataFrame(names, MEMBERS), spark.createDataFrame(files, "path string, size long"), 7).collect()}
    order = sorted((hashlib.sha256(f"film {i}".encode()).hexdigest() for i in range(20)), key=lambda g: hashlib.sha256(f"7\0{g}".encode()).digest())
    role = {g: "fit" if i < 16 else "confirm" if i < 18 else "select" for i, g in enumerate(order)}
    for i, (v, n, s) in enumerate(names):
        r = got[f"{v}/{n}"]
        assert r["issue"] is None and r["status"] == ("missing" if i % 4 == 0 else "size mismatch" if i % 3 == 0 else "available")
        assert r["role"] == (None if v == "test_videos" else role.get(r["source"], "fit"))
        assert r["shared"] == (r["source"] == hashlib.sha256(b"film 3").hexdigest())
    assert got["train_2/alone_label_G-0-0.mp4"]["source"] is None and got["train_1/a__#b__#c_label_A.mp4"]["source"] is None
    assert got["train_1/" + names[0][1]]["video_id"] == hashlib.sha256(b"film 0__#0_label_b1-0-0").hexdigest()


def test_members_that_have_no_role(spark):
    names = [("train_1", "x_label_A.avi", 1), ("train_1", None, 1), ("train_1", "d_label_A.mp4", 1), ("train_2", "videos/D_label_A.mp4", 1), ("train_1", "t_label_A.mp4", 1), ("test_videos", "t_label_A.mp4", 1), ("train_1", "w_label_B1-B1-0.mp4", 1), ("train_1", ".mp4", 1)]
    members = spark.createDataFrame(names, MEMBERS)
    none = spark.createDataFrame([], "path string, size long")
    got = [(r["issue"], r["role"], r["status"]) for r in roles.prepare(members, none, 7).collect()]
    assert sorted(got, key=str) == sorted([(i, None, "missing") for i in ("extension", "extension", "extension", "duplicate", "duplicate", "both splits", "both splits", "labels")], key=str)
    assert roles.prepare(members.limit(0), none, 7).count() == 0


def test_incoming_is_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.random((7, 9)) ** 3
    p /= p.sum(1, keepdims=True)
    rows = [("a", r.tolist()) for r in p] + [("b", [1.0])] + [("c", None), ("c", []), ("c", [0.5, 0.4]), ("c", [1.5, -0.5]), ("c", [NAN, 1.0]), ("c", [None, 1.0])]
    got = {r["k"]: r for r in attention.incoming(spark.createDataFrame(rows, "k string, p array<double>"), "k", "p").collect()}
    m = np.sort(p.mean(0))
    gini = np.abs(m[:, None] - m).sum() / (2 * len(m) ** 2 * m.mean())
    assert set(got) == {"a", "b"}
    assert tuple(got["a"])[1:] == pytest.approx((-(m * np.log(m)).sum() / np.log(9), m[-4:].sum(), gini))
    assert tuple(got["b"])[1:] == (0.0, 1.0, 0.0)


def test_class_row(spark):
    rows = spark.createDataFrame([([0.5, 0.25, 0.25],), ([1.0, 0.0],), ([1.0],), (None,)], "p array<double>")
    assert [r[0] for r in rows.select(attention.class_row(F.col("p"), 0)).collect()] == [[0.5, 0.5], None, None, None]


def test_file_digests_by_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_BLOCK", 1000)
    (tmp_path / "below it").mkdir()
    contents = {"empty": b"", "a b#1.bin": bytes(range(256)) * 50, "below it/c%20.bin": b"x" * 5000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = sorted((len(c), hashlib.sha256(c).hexdigest()) for c in contents.values() if c)  # empty files are not listed
    for whole in (0, 6000, records.WHOLE_FILE):
        got = records.file_digests(spark, str(tmp_path), whole).collect()
        assert sorted((r["length"], r["sha256"]) for r in got) == want


def test_bundles(spark):
    def saved(**arrays):
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    good = saved(x=np.arange(6, dtype=np.float32).reshape(2, 3), y=np.arange(2))
    plain = io.BytesIO()
    np.save(plain, np.arange(3, dtype=np.float32))
    files = {"good": good, "plain": plain.getvalue(), "noise": b"PK\x03\x04 not an archive", "cut": good[: len(good) // 2]}

    def record(video, fmt, **arrays):
        return video, "0", fmt, {n: (path, key, shape, dtype, hashlib.sha256(files.get(path, b"")).hexdigest().upper() if sha is None else sha, len(files.get(path, b""))) for n, (path, key, shape, dtype, sha) in arrays.items()}

    f4 = "float32"
    index = [
        record("ok", "npz", x=("good", None, [2, 3], f4, None), z=("good", "y", [2], "int64", None)),
        record("gone", "npz", x=("nowhere", None, [2], f4, None)),
        record("two", "npz", x=("good", None, [2, 3], f4, None), y=("plain", None, [3], f4, None)),
        record("digest", "npz", x=("good", None, [2, 3], f4, "0"), y=("good", None, [2], "int64", None)),
        record("inside", "npz", w=("good", None, [1], f4, None), x=("good", None, [3, 2], f4, None), y=("good", None, [2], f4, None)),
        record("not npz", "npz", x=("plain", None, [3], f4, None)),
        record("not npy", "npy", x=("good", None, [2, 3], f4, None)),
        record("noise", "npz", x=("noise", None, [1], f4, None)),
        record("cut", "npz", x=("cut", None, [1], f4, None)),
        record("npy", "npy", x=("plain", None, [3], f4, None)),
        record("none", None),
    ]
    schema = "video_id string, clip_id string, storage_format string, arrays map<string, struct<path: string, key: string, shape: array<int>, dtype: string, sha256: string, nbytes: long>>"
    got = records.load_arrays(spark.createDataFrame(index, schema), spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")).collect()
    assert {(r["video_id"], r["name"]): r["issue"] for r in got} == {
        ("ok", "x"): None, ("ok", "z"): None, ("gone", "x"): "missing", ("two", "x"): "paths", ("two", "y"): "paths", ("digest", "x"): "sha256", ("digest", "y"): None,
        ("inside", "w"): "member", ("inside", "x"): "shape", ("inside", "y"): "dtype", ("not npz", "x"): "unreadable", ("not npy", "x"): "unreadable", ("noise", "x"): "unreadable",
        ("cut", "x"): "unreadable", ("npy", "x"): None,
    }
    assert {(r["video_id"], r["name"]): (r["shape"], r["values"]) for r in got if r["issue"] is None}["ok", "x"] == ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])


def test_crowded_slices_meet_in_chunks(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    rows = []
    for key in range(40):
        for pos in range(6):
            if rng.random() < 0.9:
                flips = rng.choice(48, rng.integers(0, 6), replace=False)  # the first 16 bits stay: one crowded slice for each position
                rows.append((key, pos, f"{int(base[pos]) ^ sum(1 << int(f) for f in flips):016x}"))
    df = spark.createDataFrame(rows, "k long, p int, d string")
    digests: dict = {}
    for key, pos, d in rows:
        digests.setdefault(key, {})[pos] = int(d, 16)
    want = {}
    for x in range(40):
        for y in range(x + 1, 40):
            hit = [p for p in range(6) if p in digests[x] and p in digests[y] and (digests[x][p] ^ digests[y][p]).bit_count() <= 6]
            runs = [sum(q in hit for q in range(p, p + n)) == n and n for p in range(6) for n in range(1, 7)]
            if len(hit) >= 4 and max(runs) >= 3:
                want[x, y] = len(hit), max(runs)
    assert 50 < len(want) < 780
    for chunk in (1, 7, 1000):
        got = neardup.block_pairs(df, "k", "p", "d", width=4, chunk=chunk).collect()
        assert {(r["k"], r["other"]): (r["matches"], r["longest"]) for r in got} == want and len(got) == len(want)


def test_row_diff(spark):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c"), (None, None)], "x int, y string")
    b = spark.createDataFrame([("a", 1, True), (None, 2, True), (None, 2, True), ("d", 3, True), (None, None, False)], "y string, x int, z boolean")
    assert {tuple(r) for r in audit.row_diff(a, b, ["x", "y"]).collect()} == {(1, "a", 2, 1, "repeated"), (3, "c", 1, 0, "missing"), (3, "d", 0, 1, "unexpected")}
    assert audit.row_diff(a, a, ["x", "y"]).count() == 0 and audit.row_diff(a.limit(0), b.limit(0), ["x", "y"]).count() == 0


def test_pair_issues(spark):
    schema = "v string, s string"
    train = spark.createDataFrame([("a.mp4", "train"), ("b", "train"), ("b", "train"), ("c", "test"), (None, "train"), ("d", None)], schema)
    test = spark.createDataFrame([("A", "test"), ("e", "test"), ("", "test")], schema)
    got = {(r["key"], r["table"], r["reason"]) for r in audit.pair_issues(train, test, "v", "s").collect()}
    a = next(k for k, t, r in got if r == "leakage")
    assert got == {(a, "train", "leakage"), (a, "test", "leakage"), ("b", "train", "repeated"), ("c", "train", "split"), ("d", "train", "split"), (None, "train", "no id"), (None, "test", "no id")}
    assert audit.pair_issues(train.filter("v = 'a.mp4'"), test.filter("v = 'e'"), "v", "s").count() == 0
    assert audit.pair_issues(train.limit(0), test.limit(0), "v", "s").count() == 0


def items(x):
    if isinstance(x, dict):
        return sum(1 + items(v) for v in x.values())
    return sum(1 + items(v) for v in x) if isinstance(x, list) else 1


def test_metadata_items_are_those_of_a_walk(spark):
    values = [{}, [], 1, "a", None, True, -1.5e-3, "", {"a": []}, [[]], [[], {}], {"a": {"b": [1, 2, {"c": None}]}}, ["x, y: [z]", 'q"uo\\te, {', "\n\t"], {"k:, [": "NaN"}, [1, -2.5, "s", False, None, {"e": 1e9}], {"é": ["ü", "日本"]}]
    values.append(list(range(3000)))
    deep: list = [1]
    for _ in range(200):
        deep = [deep]
    values.append(deep)
    texts = [json.dumps(v, indent=i) for v in values for i in (None, 2)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.metadata_items(F.col("t")).alias("n"), text.metadata_issue(F.col("t")).alias("issue")).collect()
    for r in got:
        n = items(json.loads(r["t"]))
        assert (r["n"], r["issue"]) == (n, "items" if n > 2048 else None), r["t"][:80]
    odd = {None: None, "NaN": "not finite", '{"a": [1, -Infinity]}': "not finite", '{"a": "NaN"}': None, "": "invalid", "{": "invalid", "[1,]": "invalid", "[1] 2": "invalid", "1 2": "invalid", '"a""b"': "invalid", "[1] []": "invalid", "1}, {": "invalid", '{"a": 1}}': "invalid", " [ 1 ] ": None, "nope": "invalid", '{"a": 1, "a": 2}': "invalid"}
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.metadata_issue(F.col("t")).alias("issue")).collect()
    assert {r["t"]: r["issue"] for r in got} == odd


def test_telemetry_rows(spark, tmp_path):
    good = dict(run_id="r", encoder_fingerprint="sha256:" + "0" * 64, video_id="v", clip_id="c", mode="fixed", cache_type="kv", cache_hit=True, input_tokens=4, reused_tokens=1, output_tokens=0, cache_bytes=0, encode_ms=0.0, metadata=None, created_at="")
    odd = [("ids", dict(video_id="")), ("ids", dict(clip_id=None)), ("run", dict(run_id="s")), ("fingerprint", dict(encoder_fingerprint="sha256:" + "A" * 64)), ("fingerprint", dict(encoder_fingerprint="sha256:" + "0" * 64 + "\n")), ("mode", dict(mode="x")), ("cache_type", dict(cache_type=None)), ("counts", dict(cache_bytes=-1)), ("counts", dict(output_tokens=None)), ("reused", dict(reused_tokens=5)), ("encode_ms", dict(encode_ms=NAN)), ("encode_ms", dict(encode_ms=-1.0)), ("encode_ms", dict(encode_ms=INF)), ("cache_hit", dict(cache_hit=None)), ("metadata", dict(metadata="{"))]
    cases = [(None, {}), (None, dict(input_tokens=0, reused_tokens=0)), *odd]
    schema = records.CACHE_TELEMETRY.replace("reuse_ratio double, ", "")
    order = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple((good | d)[c] for c in order) for _, d in cases], schema)
    path = str(tmp_path / "t")
    refused = records.write_telemetry(df, path, "r").collect()
    assert sorted(r["reason"] for r in refused) == sorted(r for r, _ in odd)
    records.write_telemetry(df.limit(0), path, "r")
    back = records.read_jsonl(spark, path, records.CACHE_TELEMETRY).collect()
    assert sorted(r["reuse_ratio"] for r in back) == [0.0, 0.25] and {r["metadata"] for r in back} == {None}


def test_members_are_named_once(spark):
    """The written members are read again; no later step makes a digest of a name."""
    members = spark.createDataFrame([("train_1", f"Videos/F__#{i}_label_A.mp4", 1) for i in range(4)], MEMBERS)
    got = roles.prepare(members, spark.createDataFrame([], "path string, size long"), 7)
    assert got.count() == 4 and "_label_" not in got._jdf.queryExecution().executedPlan().toString()


def test_source_prefixes(spark):
    want = {"A b__#1_label_A.mp4": "a b", "d/X__#y.z": "x", "a__#b__#c_label_A.mp4": None, "__#b": None, "a__#": None, "a__#_label_A.mp4": None, "a": None, "": None, None: None, "a_label___#b_label_A.mp4": "a_label_"}
    rows = spark.createDataFrame([(k,) for k in want], "n string")
    assert {r["n"]: r["s"] for r in rows.select("n", roles.source_prefix(F.col("n")).alias("s")).collect()} == want


def test_arrays_are_handed_on_in_pieces(monkeypatch):
    import pandas as pd

    content = io.BytesIO()
    np.save(content, np.arange(6.0, dtype=np.float32))
    about = {"name": "f", "key": "f", "shape": [6], "dtype": "float32", "sha256": "d", "nbytes": len(content.getvalue())}
    part = pd.DataFrame([("v", str(i), False, False, [about], content.getvalue() if i % 5 else None, "d") for i in range(10)], columns=["video_id", "clip_id", "npz", "several", "about", "content", "digest"])
    monkeypatch.setattr(records, "VALUES_AT_ONCE", 12)
    pieces = list(records._decoded(part))
    got = pd.concat(pieces)
    assert max(map(len, pieces)) <= 3 and list(got["clip_id"]) == [str(i) for i in range(10)]
    assert [i for i in got["issue"]] == ["missing" if i % 5 == 0 else None for i in range(10)] and all(sum(v) == 15.0 for v in got["values"] if v is not None)
