"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (n from 1 to 4, hashed to ``BUCKETS``) present in both, over the
root of the product of their own numbers: a blended spectrum by presence. Landmark texts give a Nyström map, on which
one ridge regression per language (against the rest) is fitted. Texts are scored in batches by matrix products, in
one pass without a shuffle; the model that the tasks receive has a fixed size.

The model is fitted on a bounded sample: at most ``per_language`` rows of each language, those with the smallest hash
of their id, and at most ``MAX_LANGUAGES`` languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null language teach nothing;
without any labelled row every text is ``und``; ties go to the language that sorts first; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
MAX_LANGUAGES = 256
LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """One row per text: 1 for each bucket to which an n-gram of the whole text falls."""
    out = np.zeros((len(texts), buckets), np.uint8)
    for row, text in zip(out, texts):
        a = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        row[a * 7 % buckets] = 1
        gram = a
        for n in (2, 3, 4):
            if len(a) < n:
                break
            gram = gram[:-1] * np.uint32(0x9E3779B1) + a[n - 1 :] * np.uint32(2 * n + 1)
            row[(gram ^ (gram >> np.uint32(15))) % np.uint32(buckets)] = 1
    return out


def kernel(p: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised numbers of common n-grams; 0 for a text without any."""
    own = np.sqrt(np.maximum(p.sum(1, dtype=np.int64), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1, dtype=np.int64), 1))[None, :]
    return (p.astype(np.float32) @ landmarks.astype(np.float32).T) / own


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x BUCKETS, presence
    weights: np.ndarray  # (landmarks + 1) x languages: the Nyström map and the ridge regressions as one matrix
    grams: np.ndarray | None = None  # languages x BUCKETS: 1 where a landmark of the language has an n-gram
    least: np.ndarray | None = None  # the share of a text's n-grams that its language must know to claim it

    def margins(self, texts: list[str]) -> np.ndarray:
        return self._margins(presence(texts))

    def _margins(self, p: np.ndarray) -> np.ndarray:
        return kernel(p, self.landmarks) @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.assess(texts)[:2]

    def assess(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether the language claims the text.

        The margins of a text sum to the same number whatever it says, so the score of the best is never low; how many
        of the text's n-grams the language knows can be.
        """
        names, scores, claimed = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        real = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        if real and self.languages:
            p = presence([texts[i] for i in real])
            m = self._margins(p)
            best = m.argmax(1)
            share = np.ones(len(real)) if self.grams is None else (p & self.grams[best]).sum(1, dtype=np.int64) / p.sum(1, dtype=np.int64)
            claimed[real] = True if self.least is None else share >= self.least[best]
            for i, b, s in zip(real, best, np.clip((m[np.arange(len(real)), best] + 1) / 2, 0, 1)):
                names[i], scores[i] = self.languages[b], float(s)
        return names, scores, claimed


def known_grams(rows: np.ndarray, each: int) -> tuple[np.ndarray, float]:
    """The n-grams of a language's landmarks (the first ``each`` rows), and the least share of them that it claims.

    That share is midway between chance (the share of buckets in use) and the lowest of the language's own training
    rows, where a landmark's own n-grams count only if another landmark has them; with one row nothing is rejected.
    """
    n = rows[:each].sum(0, dtype=np.int64)
    if len(rows) < 2:
        return (n > 0).astype(np.uint8), 0.0
    need = np.where(np.arange(len(rows)) < each, 2, 1)
    own = [float((n[r > 0] >= k).mean()) for r, k in zip(rows, need)]
    return (n > 0).astype(np.uint8), min(min(own), (min(own) + float((n > 0).mean())) / 2)


def fit_language_model(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, landmarks: int = 128, ridge: float = 1e-2) -> LanguageModel:
    """Learns from the rows where ``train`` holds, the language isn't null and the text has a letter."""
    rows = docs.filter(train).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(11)).alias("h")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # the smallest hashes of each language; the table is bounded by MAX_LANGUAGES * per_language
    sketch = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sketch) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sketch:
        return LanguageModel([], np.zeros((0, BUCKETS), np.uint8), np.zeros((1, 0)))
    # keep about twice the wanted number by hash range, then the exact smallest ones on that small remainder
    width = F.create_map(*[x for r in sketch for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * per_language / max(r["n"], 1))))])
    # rows of the same language, id and text count once, so no language takes another's place
    near = rows.filter(F.pmod("h", F.lit(1 << 30)) < width[F.col("lang")] * float(1 << 30)).dropDuplicates(["lang", "h"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                yield pd.DataFrame({"lang": part["lang"], "h": part["h"], "bits": [x.tobytes() for x in np.packbits(presence(list(part["text"])), axis=1)]})

    got = near.mapInPandas(pack, "lang string, h long, bits binary").collect()
    groups: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"] % (1 << 30), bytes(r["bits"]))):
        groups.setdefault(r["lang"], []).append(np.frombuffer(r["bits"], np.uint8))
    languages = sorted(groups)
    x = {n: np.unpackbits(np.array(groups[n][:per_language]), axis=1) for n in languages}
    each = max(1, landmarks // len(languages))
    z = np.concatenate([x[n][:each] for n in languages])
    k = kernel(z, z).astype(np.float64)
    value, vector = np.linalg.eigh(k)
    use = value > 1e-6 * value.max()
    to_features = vector[:, use] / np.sqrt(value[use])
    phi = np.concatenate([kernel(x[n], z).astype(np.float64) for n in languages]) @ to_features
    label = np.repeat(np.arange(len(languages)), [len(x[n]) for n in languages])
    # every language weighs the same, however many rows it has
    w = 1.0 / np.bincount(label)[label]
    w *= len(label) / w.sum()
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    design = np.hstack([phi, np.ones((len(phi), 1))])
    penalty = np.eye(design.shape[1]) * ridge * len(languages)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve((design * w[:, None]).T @ design + penalty, (design * w[:, None]).T @ y)
    known = [known_grams(x[n][:per_language], each) for n in languages]
    return LanguageModel(languages, z, np.vstack([to_features @ solved[:-1], solved[-1:]]).astype(np.float32), np.stack([g for g, _ in known]), np.array([t for _, t in known]))


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", claim_col: str | None = None) -> DataFrame:
    """``docs`` with the predicted language, its score and, if asked for, whether the language claims the text; only the text is read."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # landmarks x BUCKETS bytes, whatever the input

    @F.pandas_udf("lang string, score double, claimed boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            names, scores, claims, all_texts = [], [], [], s.tolist()
            for at in range(0, len(all_texts), 256):
                n, v, c = sent.value.assess([t if isinstance(t, str) else None for t in all_texts[at : at + 256]])
                names += n
                scores.append(v)
                claims += c.tolist()
            yield pd.DataFrame({"lang": names, "score": np.concatenate(scores) if scores else np.zeros(0), "claimed": np.array(claims, bool)})

    tmp = "__language_id"
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in (pred_col, score_col, claim_col)]
    out = docs.withColumn(tmp, predict(F.col(text_col)))
    claim = [F.col(f"{tmp}.claimed").alias(claim_col)] if claim_col else []
    return out.select(*cols, F.col(f"{tmp}.lang").alias(pred_col), F.col(f"{tmp}.score").alias(score_col), *claim)
