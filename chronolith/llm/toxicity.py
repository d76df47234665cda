"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon (words and stems that mark toxic texts, learned from the labels) in
plain and in unmasked form, their nearness to words of the second person, and the rates of capitals, punctuation, masked
words and repeats. Trees and calibration are fitted on a bounded sample of at most ``MAX_LABELLED`` labelled rows (those
with the smallest id hashes), on separate parts of it; all texts are scored in one pass without a shuffle.

Defined cases: a null text counts as empty and gets a score; rows without a label or with a null one teach nothing; of
several labels of one id the largest holds; without labels of both kinds every score is the share of toxic labels (0
without any); repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import kept

MAX_LABELLED = 20_000
LEXICON = 200
NEAR = 6
FEATURES = ("words", "plain", "plain_kinds", "masked", "strong", "evidence", "near_you", "capitals", "marks", "exclaims", "symbols", "masks", "repeats", "digits")
#: Words of the second person in the corpus's languages.
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros".split())
#: Signs that stand for letters in masked words.
MASK = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_REPEAT = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    return _EDGE.sub("", word)


def unmasked(word: str) -> str:
    """The word without inner signs, stand-ins and repeats."""
    return _REPEAT.sub(r"\1", _INNER.sub("", word.translate(MASK)))


def stems(word: str) -> list[str]:
    """Beginnings of 5 to 8 letters, longest first, marked as such; compounds of one stem share them."""
    return [word[:n] + "*" for n in range(min(8, len(word) - 1), 4, -1)]


def marked(word: str, lexicon: dict[str, float]) -> str | None:
    """The entry that a word meets: itself, or its longest stem."""
    if word in lexicon:
        return word
    return next((s for s in stems(word) if s in lexicon), None)


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    raw = text.lower().split()
    n = max(len(raw), 1)
    freq = Counter(raw)
    kind: dict[str, str] = {}
    hits = strong = masked = masks = 0.0
    kinds = set()
    for w, c in freq.items():
        p = plain(w)
        if m := marked(p, lexicon):
            kind[w] = m
            hits += c
        elif p and not p.isalpha() and (u := unmasked(p)) != p:
            masks += c
            if m := marked(u, lexicon):
                kind[w] = m
                masked += c
        if w in kind:
            kinds.add(kind[w])
            strong = max(strong, lexicon[kind[w]])
    near = 0
    if kind:
        at = [i for i, w in enumerate(raw) if w in kind]
        for i in at:
            near += any(plain(x) in SECOND_PERSON for x in raw[max(0, i - NEAR) : i + NEAR + 1])
    size = max(len(text), 1)
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper = int(((b >= 65) & (b <= 90)).sum())
    punct = int(((b >= 33) & (b <= 47) | (b >= 58) & (b <= 64)).sum())
    return [
        float(np.log1p(len(raw))), hits / n, float(len(kinds)), masked / n, strong, sum(lexicon[k] for k in kinds), near / n,
        upper / size, punct / size, text.count("!") / n, sum(text.count(s) for s in "*#$%&@") / size, masks / n,
        1 - len(freq) / n, int(((b >= 48) & (b <= 57)).sum()) / size,
    ]


def add_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` with the text replaced by its features."""
    others = [c for c in rows.columns if c != "text"]
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), *(f"{f} double" for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "", lexicon) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *map(pa.array, x.T)], names=[*others, *FEATURES])

    return rows.mapInArrow(run, schema)


def learn_lexicon(labelled: DataFrame, least: float = 24.0) -> dict[str, float]:
    """Words and stems that more of the toxic texts have, with their log-odds; from (text, y).

    An entry needs a log-likelihood ratio of ``least``, more than chance gives among a hundred thousand words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = {p for w in set((t or "").lower().split()) if (p := plain(w)) and 2 < len(p) < 40}
                words |= {unmasked(p) for p in words if not p.isalpha()}
                found[int(y)].update(words)
                found[int(y)].update({s for w in words for s in stems(w)})
        words = list(found[0].keys() | found[1].keys())
        for at in range(0, len(words), 20_000):
            w = words[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(w), *(pa.array([found[y][x] for x in w], pa.int64()) for y in (0, 1))], names=["word", "clean", "toxic"])

    sums = labelled.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    rate = max(pos, 0.5) / max(pos + neg, 1)
    t, c = F.col("toxic"), F.col("clean")
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((t + c) * share))).otherwise(0.0)
    tested = sums.withColumns({"odds": F.log((t + 0.5) / (pos + 1.0)) - F.log((c + 0.5) / (neg + 1.0)), "ratio": 2 * (part(t, rate) + part(c, max(1 - rate, 1e-9)))})
    top = tested.filter((F.col("ratio") >= least) & (F.col("odds") > 1)).orderBy(F.col("ratio").desc(), "word").limit(LEXICON)
    return {r["word"]: float(r["odds"]) for r in top.collect() if r["word"]}


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    share: float
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from labelled rows whose id meets ``train`` (a condition on ``id_col``)."""
    known = labels.filter(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    known = known.withColumn("h", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)))
    n = known.count()
    sample = kept(known.filter(F.col("h") < float(1 << 30) * min(1.0, MAX_LABELLED / max(n, 1) * 1.05)).orderBy("h", "id").limit(MAX_LABELLED))  # at most MAX_LABELLED rows of three numbers
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = kept(text.join(F.broadcast(sample), "id").select("h", "y", "text").repartition(12, "h"))
    share = rows.agg(F.avg("y")).first()[0] or 0.0
    if share in (0.0, 1.0):
        return ToxicityModel({}, float(share))
    part = F.col("h") % 10
    lexicon = learn_lexicon(rows.filter(part < 7))
    table = add_features(rows, lexicon)
    table = kept(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table).select("h", F.col("y").cast("double").alias("y"), "x"))
    if min(table.filter(part < 7).agg(F.avg("y"), F.avg(1 - F.col("y"))).first()) in (None, 0.0):
        return ToxicityModel(lexicon, float(share))
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=30, maxDepth=4, stepSize=0.15, subsamplingRate=0.8, seed=3).fit(table.filter(part < 7))
    calib = trees.transform(table.filter(part >= 7)).select("y", vector_to_array("probability")[1].alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="y").fit(calib) if calib.count() else None
    return ToxicityModel(lexicon, float(share), trees, steps)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the text replaced by ``score`` and ``predicted``; only the text is read for a score."""
    others = [c for c in docs.columns if c not in (text_col, score_col, "predicted")]
    # other columns travel as one, so their names can't meet those of the features
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__kept"), F.col(text_col).alias("text"))
    if model.trees is None:
        out = rows.select("__kept", F.lit(model.share).alias("__score"))
    else:
        x = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(add_features(rows, model.lexicon))
        x = model.trees.setFeaturesCol("__x").setPredictionCol("__t").setRawPredictionCol("__r").setProbabilityCol("__p").transform(x)
        x = x.withColumn("p", vector_to_array("__p")[1])
        value = F.col("p")
        if model.steps is not None:
            x = model.steps.setPredictionCol("__s").transform(x)
            # the calibrated value, with the trees' own order among texts of one step
            value = F.col("__s") * 0.98 + F.col("p") * 0.02
        out = x.select("__kept", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("__score"))
    return out.select(*[F.col(f"__kept.`{c}`").alias(c) for c in others], F.col("__score").alias(score_col), (F.col("__score") >= threshold).cast("int").alias("predicted"))
