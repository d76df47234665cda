"""Benchmark decontamination by winnowing, in SQL functions only.

The k-gram hashes of a text are cut to the smallest of each window of ``window - k + 1`` neighbours. A passage of at
least ``window`` words that a document and a benchmark item share is then selected alike on both sides, so joining the
selected fingerprints finds every such passage. Each hit is extended word by word to both sides, and counts if the
equal run reaches the window; that makes the result exact, whatever the hashes do. Items shorter than the window are
one window of their own length, whose hash is looked up at every position of the documents; all lengths in one pass.

The benchmark's fingerprints are held in the tasks, with the words around each of them, only if its texts are at most
``MAX_BROADCAST`` bytes, which is checked. Beyond that the documents' fingerprints alone, without words, first meet the
set of the benchmark's in a shuffle; only texts with a common fingerprint then bring the words around theirs.

Defined cases: a null or wordless text has no words and is never contaminated; an item without words is no window; an
item with a null id marks words but isn't listed; items of the same id count once; repeated documents each get a row;
columns besides id and text are ignored; without benchmark items no word is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import kept

WINDOW = 13
K = 5
#: Bytes of benchmark text up to which its fingerprints, with the words around them, are held in the tasks.
MAX_BROADCAST = 1 << 20
#: Contaminated keys that are broadcast at most.
MAX_IDS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HIGH = -(1 << 32)


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN), ""), F.array().cast("array<string>"))


def _gram_hashes(hashes: str, n: int) -> Column:
    """A hash for each run of n words; none if there are fewer words."""
    h = F.col(hashes)
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def winnowed(df: DataFrame, window: int = WINDOW, k: int = K, known: list[int] | None = None) -> DataFrame:
    """``df`` (with ``hashes`` of its words) plus ``prints``: array of (h, pos), the fingerprints that winnowing selects.

    If ``known`` is given, only they matter: rows without any of these hashes aren't winnowed, as none could be selected.
    """
    w = window - k + 1
    none = F.array().cast("array<bigint>")
    packed = F.transform("grams", lambda h, i: h.bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long")))  # smallest hash, then leftmost
    if known is not None:
        packed = F.when(F.exists("grams", lambda h: h.isin(known)) if known else F.lit(False), packed).otherwise(none)
    least = F.transform(F.sequence(F.lit(1), F.greatest(F.size("packed") - w + 1, F.lit(1))), lambda i: F.array_min(F.slice("packed", i, w)))
    picked = F.when(F.size("packed") > 0, F.array_distinct(least)).otherwise(none)
    prints = F.transform("picked", lambda p: F.struct(F.get("grams", p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("h"), p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos")))
    return df.withColumn("grams", _gram_hashes("hashes", k)).withColumn("packed", packed).withColumn("picked", picked).withColumn("prints", prints).drop("grams", "packed", "picked")


def _around(words: Column, pos: Column, left: int | Column, right: int | Column) -> Column:
    """The words from ``left`` before the position to ``right`` after it, as far as there are any."""
    lo = F.least(pos, left if isinstance(left, Column) else F.lit(left))
    return F.slice(words, pos - lo + 1, lo + right)


def _hits(docs: DataFrame, items: DataFrame, broadcast: bool) -> DataFrame:
    """Rows of ``docs`` (rid, doc_id, n_words, prints with one null marker) that mark a row or hit an item.

    A print has h, pos, k (words in it), reach (words around it that count) and near; ``items``: h, item_id, ctx and at
    (the position of the k-gram in ctx). A hit has the interval [start, stop) of the document's words that equal the
    item's, which is at least k + reach words long.
    """
    # explode_outer: for explode() Spark infers a filter on the array, and would work out the whole array for it again
    rows = docs.select("rid", "doc_id", "n_words", F.explode_outer("prints").alias("p")).select("rid", "doc_id", "n_words", "p.*").filter("pos IS NOT NULL")
    joined = rows.join(F.broadcast(items) if broadcast else items, "h", "left").filter((F.col("pos") < 0) | F.col("ctx").isNotNull())
    own = F.least(F.col("pos"), F.col("reach"))  # words before the k-gram in near
    lo = F.least(own, F.col("at"))
    wide = F.col("lo") + F.col("k") + F.col("reach")
    equal = F.when(
        F.col("pos") >= 0,
        F.zip_with(F.slice("near", own - F.col("lo") + 1, wide), F.slice("ctx", F.col("at") - F.col("lo") + 1, wide), lambda a, b: F.coalesce(a == b, F.lit(False))),
    )
    # the run of equal words around the k-gram: after the last difference before it, up to the first one after it
    unequal = F.transform("equal", lambda e, i: F.when(~e, i))
    left = F.coalesce(F.array_max(F.filter(unequal, lambda i: i < F.col("lo"))) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter(unequal, lambda i: i >= F.col("lo"))), F.size("equal"))
    out = joined.withColumn("lo", lo).withColumn("equal", equal).withColumns({"left": left, "right": right})
    found = (F.col("pos") >= 0) & (F.col("right") - F.col("left") >= F.col("k") + F.col("reach"))
    return out.filter((F.col("pos") < 0) | found).select(
        "rid", "doc_id", "n_words", "item_id",
        F.when(found, F.struct((F.col("pos") - F.col("lo") + F.col("left")).alias("start"), (F.col("pos") - F.col("lo") + F.col("right")).alias("stop"))).alias("span"),
    )


def _short(hashes: str, lengths: list[int]) -> Column:
    """Prints (h, pos, k, reach) of all runs of so many words."""

    def of(n: int) -> Column:
        return F.transform(_gram_hashes(hashes, n), lambda h, i: F.struct(F.xxhash64(F.lit(n), h).alias("h"), i.alias("pos"), F.lit(n).alias("k"), F.lit(0).alias("reach")))

    runs = [of(n) for n in lengths]
    return F.concat(*runs) if runs else F.array().cast("array<struct<h:bigint,pos:int,k:int,reach:int>>")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, spans (merged, half-open, in words), n_hit, items (sorted) and contaminated, for each document."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
    items = items.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    facts = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text_col))), F.lit(0)).alias("bytes")).first()
    short = sorted(r["n"] for r in items.filter((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect())  # less than window values
    small = facts["bytes"] <= MAX_BROADCAST
    reach = window - k
    prints = winnowed(items.filter(F.col("n") >= window), window, k).select("item_id", "words", F.explode_outer("prints").alias("p")).filter("p.h IS NOT NULL")
    prints = prints.select(F.col("p.h").alias("h"), "item_id", _around(F.col("words"), F.col("p.pos"), reach, k + reach).alias("ctx"), F.least(F.col("p.pos"), F.lit(reach)).alias("at"))
    for n in short:
        whole = items.filter(F.col("n") == n).select(F.xxhash64(F.lit(n), F.element_at(_gram_hashes("hashes", n), 1)).alias("h"), "item_id", F.col("words").alias("ctx"), F.lit(0).alias("at"))
        prints = prints.unionByName(whole)
    prints = kept(prints.distinct())
    known = [r["h"] for r in prints.select("h").distinct().collect()] if small else None  # bounded by MAX_BROADCAST

    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    base = base.withColumn("n_words", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    both = winnowed(base, window, k, known)
    long_ = F.transform("prints", lambda p: F.struct(p["h"].alias("h"), p["pos"].alias("pos"), F.lit(k).alias("k"), F.lit(reach).alias("reach")))
    every = F.concat(long_, _short("hashes", short))
    if known is not None:
        every = F.filter(every, lambda p: p["h"].isin(known)) if known else F.slice(every, 1, 0)
    both = both.withColumn("prints", every)
    if known is None:
        alike = both.select("text_hash", F.explode_outer("prints").alias("p")).select("text_hash", "p.h").join(prints.select("h").distinct(), "h", "left_semi").select("text_hash").distinct()
        alike = kept(alike)
        few = alike.limit(MAX_IDS + 1).count() <= MAX_IDS
        alike = (F.broadcast(alike) if few else alike).withColumn("alike", F.lit(True))
        both = both.join(alike, "text_hash", "left").withColumn("prints", F.when(F.col("alike"), F.col("prints")))
    # the words go along with the prints here, as exploding rows that hold a whole text would copy it for each of them
    near = F.transform("prints", lambda p: F.struct(p["h"].alias("h"), p["pos"].alias("pos"), p["k"].alias("k"), p["reach"].alias("reach"), _around(F.col("words"), p["pos"], p["reach"], p["k"] + p["reach"]).alias("near")))
    null = lambda t: F.lit(None).cast(t)
    marker = F.array(F.struct(null("long").alias("h"), F.lit(-1).alias("pos"), null("int").alias("k"), null("int").alias("reach"), null("array<string>").alias("near")))
    hits = _hits(both.withColumn("prints", F.concat(marker, F.coalesce(near, F.slice(marker, 1, 0)))), prints, small)
    by_doc = hits.groupBy("rid", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set(F.when(F.col("span").isNotNull(), F.col("item_id")))).alias("items"))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    merged = F.aggregate(
        "spans", empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["stop"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    out = by_doc.withColumn("spans", merged).withColumn("n_hit", n_hit).withColumn("n_words", F.col("n_words").cast("long"))
    return out.select("doc_id", "n_words", "spans", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "rid")


def digest(result: DataFrame) -> DataFrame:
    """The result with the items as their number and the SHA-256 of their joined identifiers."""
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows.

    Decisions come back by id and text hash, as ids may be null or repeat with other texts; equal texts have equal
    decisions. Up to ``MAX_IDS`` contaminated keys are broadcast, so the texts stay where they are; more are joined by
    a shuffle.
    """
    text_hash = F.xxhash64("text")
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), text_hash.alias("text_hash")).alias("doc_id"), "text")
    found = contamination(keyed, benchmark).filter("contaminated")
    bad = kept(found.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.text_hash").alias("__t")).distinct())
    small = bad.limit(MAX_IDS + 1).count() <= MAX_IDS
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (text_hash == F.col("__t"))
    return docs.join(F.broadcast(bad) if small else bad, same, "left_anti")
