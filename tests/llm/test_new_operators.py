"""Runs of words, whitening and piece encoding against brute force and the library, with their edge cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import repeated_runs, sentence_pieces, whitening

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "a"), (4, "a"), (None, "b c"), (5, "ÄÖ ß 日本語 \U0001f600 й"), (6, "x " * 30_000), (7, "!!!"), (8, "\x00\x01 tail"), (9, "a b " * 4 + "c"), (10, "y" * 200_000), (11, "a\x0bb\x0cc\xa0d")]


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    for c in ("ids", "runs", "collapsed", "x", "n", "__best", "d"):
        df = df.withColumn(c, F.lit("extra"))
    return df


# 11 --------------------------------------------------------------------------------------------------------------


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def some_words(rng):
    letters = rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
    if rng.random() < 0.6:
        p, c = [rng.randrange(letters) for _ in range(rng.randint(1, 6))], rng.randint(0, len(w))
        w[c:c] = p * rng.randint(1, 9) + p[: rng.randint(0, len(p))]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(2000):
        w = some_words(rng)
        assert [tuple(r) for r in repeated_runs.runs(np.array(w, np.int64)).tolist()] == plain_runs(w), w


def test_common_extensions_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        w = np.array([rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(2, 80))])
        i, j = np.array([(a, b) for a in range(len(w)) for b in range(len(w)) if a != b]).T
        g = repeated_runs.Grammar(w)
        ahead = [next((k for k in range(len(w)) if max(a, b) + k >= len(w) or w[a + k] != w[b + k]), len(w)) for a, b in zip(i, j)]
        behind = [next((k for k in range(len(w)) if min(a, b) - k <= 0 or w[a - k - 1] != w[b - k - 1]), len(w)) for a, b in zip(i, j)]
        assert g.extension(i, j).tolist() == ahead
        assert g.extension(i, j, back=True).tolist() == behind


def digest_of(doc_id, text):
    """The contract's row for one document, word by word."""
    w = repeated_runs.WORD.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    out = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in out)))


def test_runs_of_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(map(str, some_words(rng)))) for i in range(300)] + [r for r in ODD if r[0] != 6]
    docs = frame(spark, rows)
    made = docs.withColumn("text", F.coalesce(repeated_runs.planted("doc_id", F.col("text")), F.col("text")))
    got = [tuple(r) for r in repeated_runs.digest(repeated_runs.find_runs(made)).collect()]
    assert sorted(got, key=str) == sorted((digest_of(*r) for r in rows), key=str)


def test_runs_of_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(50)) for _ in range(300_000))
    rows = frame(spark, [(1, "x " * 300_000), (2, long + " a b" * 1000), (3, long)])
    got = {r["doc_id"]: r for r in repeated_runs.find_runs(rows).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 300_000, 1)] and got[1]["collapsed"] == "x"
    assert (300_000, 2000, 2) in [tuple(r) for r in got[2]["runs"]]
    assert got[2]["collapsed"].endswith(" a b") and got[3]["collapsed"].split(" ")[-1] == long.split(" ")[-1]
    assert repeated_runs.digest(repeated_runs.find_runs(rows.limit(0))).count() == 0


# 12 --------------------------------------------------------------------------------------------------------------


def whitened(rows, k):
    """Brute force in exact fractions up to the eigenvectors."""
    x = [[int(np.floor(256 * c)) for c in v] for v in rows]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = [[float(sum((Fraction(v[i]) - Fraction(s[i], n)) * (Fraction(v[j]) - Fraction(s[j], n)) for v in fit) / n) for j in range(d)] for i in range(d)]
    values, axes = np.linalg.eigh(np.array(cov))
    order = np.argsort(-values)[:k]
    y = np.array([[float(Fraction(c) - Fraction(t, n)) for c, t in zip(v, s)] for v in x])
    return n, [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x], y @ axes[:, order] / np.sqrt(values[order]), values[order] / sum(values)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(300, 6)) * [1, 2, 0.5, 3, 1, 0.1] + [5, 0, 0, -70, 0, 0]).astype(np.float32)
    v = np.concatenate([v, v[:50], np.repeat(v[:1], 40, 0)])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<float>").withColumn("x", F.lit("extra")).withColumn("n", F.lit(1)).repartition(7)
    got = {(r["vec_id"], r["component"]): r for r in whitening.fit_and_whiten(df, 4).collect()}
    n, far, want, share = whitened([[float(c) for c in row] for row in v], 4)
    assert len(got) == 4 * len(v)
    for c in range(4):
        own = np.array([got[i, c + 1]["whitened"] for i in range(len(v))])
        assert min(np.abs(own - want[:, c]).max(), np.abs(own + want[:, c]).max()) < 1e-9
        assert got[0, c + 1]["explained"] == pytest.approx(share[c], rel=1e-9)
    assert [int(got[i, 1]["deviation"]) for i in range(len(v))] == far
    assert {r["n"] for r in got.values()} == {n} and max(r["identity_error"] for r in got.values()) < 1e-9


def test_squares_beyond_64_bits_are_exact():
    rng = random.Random(6)
    for top in (10, 2**20, 2**31, 2**40, 2**62):
        x = np.array([[rng.randint(-top, top) for _ in range(4)] for _ in range(50)])
        want = [sum((int(r[i]) + (int(r[j]) if j != i else 0)) ** 2 for r in x) for i in range(4) for j in range(i, 4)]
        assert [int(s) for part in whitening.square_sums(whitening.centred(x, [0] * 4)) for s in part.tolist()] == want
        assert whitening.column_sums(x) == [sum(int(r[i]) for r in x) for i in range(4)]


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [1e300, -1e300, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [1e300, 5.0, 3.0]), (3, [1e300, 5.0, 3.0]), (None, [-7e15, 1.0, 2.0]), (5, None), (6, []), (7, [1.0, None, 2.0]),
            (8, [float("nan"), 1.0, 2.0]), (9, [float("inf"), 1.0, 1.0]), (10, [1.5, 2.5]), (11, [0.1]), (12, [-0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.fit_and_whiten(df).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted([(i, c) for i in ("1", "2", "3", "3", "None") for c in (1, 2, 3)] + [("10", 1), ("10", 2), ("11", 1), ("12", 1)])
    alone = [r for r in got if r["vec_id"] == 10]  # one vector of its length: no variance
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in alone)
    assert {r["whitened"] for r in got if r["vec_id"] in (11, 12)} == {1.0, -1.0}
    assert whitening.fit_and_whiten(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(i, [float(i == k) for k in range(500)]) for i in range(3)], "vec_id long, embedding array<double>")
    assert max(r["identity_error"] for r in whitening.fit_and_whiten(wide, 2).collect()) < 1e-9


# 13 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_pieces_equal_the_library(model, library):
    pieces, rng = sentence_pieces.encoder(model), random.Random(7)
    letters, known = list("abehint ors  ▁▁\n\t.,-=<>/0x1") + list("éß日本語的\u0000\U0001f600й﻿�"), sorted(pieces.ids)
    for k in range(8000):
        text = "".join(rng.choice(letters) if k % 3 or rng.random() < 0.2 else rng.choice(known) for _ in range(rng.randint(0, 24)))
        assert pieces.encode([text])[0].tolist() == library.encode(text), text
        ids = [rng.randrange(32_000) if rng.random() < 0.3 else rng.choice([0, 1, 2, 28705, 259, *range(3, 259)]) for _ in range(rng.randint(0, 8))]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_table_equals_the_merges(model):
    """Each prefix's last piece is that of the prefix merged from its characters."""
    pieces, rng = sentence_pieces.encoder(model), random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("▁aehinotrs") for _ in range(rng.randint(1, 20)))
        table = pieces.last_pieces(text)
        assert [pieces.sizes[t] for t in table] == [len(pieces.merges(text[: i + 1])[1][-1]) for i in range(len(text))]


def test_pieces_of_texts(spark, model, library):
    rng = random.Random(9)
    rows = ODD + [(i, "".join(chr(rng.choice([32, 97, 98, 0x3042 + i % 50, rng.randrange(1, 0xD000)])) for _ in range(60))) for i in range(100, 300)]
    docs = frame(spark, rows).repartition(3)
    got = sorted(map(tuple, sentence_pieces.digest(sentence_pieces.decode(sentence_pieces.encode(docs, model), model)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, sentence_pieces.digest(sentence_pieces.round_trip(docs, model)).collect()), key=str) == got
    assert sentence_pieces.encode(docs.limit(0), model).count() == 0
    assert sentence_pieces.encode(frame(spark, [(1, "hi")]), model, end=False).first()["ids"] == library.encode("hi")


def test_decoding_of_any_ids(spark, model, library):
    rng = random.Random(10)
    rows = [(i, [rng.choice([0, 1, 2, 28705, 259, 300, *range(3, 259)]) for _ in range(rng.randint(0, 9))]) for i in range(400)] + [(500, None), (501, [None, 1000, None])]
    got = {r["doc_id"]: r["text"] for r in sentence_pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), model).collect()}
    assert got == {i: library.decode([x for x in ids or [] if x is not None]) for i, ids in rows}
    with pytest.raises(Exception, match="vocabulary|IndexError|Index"):
        sentence_pieces.decode(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>"), model).collect()


def test_full_caches_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_BYTES", 1000)
    monkeypatch.setattr(sentence_pieces, "CACHE_PAIRS", 5)
    pieces, rng = sentence_pieces.Encoder(model), random.Random(11)
    for _ in range(200):
        text = " ".join("".join(rng.choice("aehinotrs") for _ in range(rng.randint(1, 12))) for _ in range(10))
        assert pieces.encode([text])[0].tolist() == library.encode(text)


# corrections of earlier operators ----------------------------------------------------------------------------------


def test_no_language_is_lost_to_null_ids(spark):
    from chronolith.llm import language_id

    rng = random.Random(12)
    word = {"en": "the of and to in is that for with as".split(), "de": "der die und ist nicht mit ein auch für".split()}
    some = lambda n: " ".join(rng.choice(word[n]) for _ in range(8))
    rows = [(None, some("en"), "en") for _ in range(6000)] + [(None, "the of and", "en")] * 3000 + [(i, some("de"), "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = language_id.fit_language_model(df, F.lit(True))
    assert model.languages == ["de", "en"]
    got = language_id.identify(df.select("text", "lang"), model).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).collect()
    assert all(r["right"] > 0.95 for r in got)


def test_nearest_of_very_large_and_small_vectors(spark):
    from chronolith.llm import ann

    rng = np.random.default_rng(13)
    v = rng.normal(size=(300, 8))
    sizes = 10.0 ** rng.choice([-200, -100, 0, 100, 200], 300)
    df = spark.createDataFrame([(i, (a * s).tolist()) for i, (a, s) in enumerate(zip(v, sizes))], "vec_id long, embedding array<double>")
    got = {}
    index, shards = ann.build_index(df, 6, shard_rows=64)
    assert shards > 3
    for r in ann.search(index, shards, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    right = 0
    for q in range(0, 300, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        want = np.argsort(-cos)[:5].tolist()
        mine = sorted(got[q])
        assert all(np.isfinite(s) and s == pytest.approx(cos[i], abs=1e-12) for _, i, s in mine)
        right += len({i for _, i, _ in mine} & set(want))
    assert right >= 28  # of 30, over several shards
