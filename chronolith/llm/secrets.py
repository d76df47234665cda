"""Secret scans in DataFrame operations only: candidates by form, then a random forest against false positives.

Texts are split at white space; a candidate is a long run of key characters with a digit or mixed case, the whole value
that is assigned to a name for secrets, a published form of key wherever it stands in a word, or a private key's header.
Each has features: its length, the share of character classes and the transitions between them, how much of it words of
a dictionary cover (the commonest words of all texts, and fixed ones), whether it has a published form or looks like a
path, address or number, and which words stand next to it. The forest decides on all candidates, published forms too.

It learns from labelled findings. Where the caller has none, they are planted: ``PLANTED`` texts with secrets and with
look-alikes (documentation keys, placeholders, digests, identifiers, paths, data) in the places of secrets, whose labels
say what was planted, not how it looks. At most ``MAX_LABELLED`` findings are used, those with the smallest hashes.

Defined cases: a null text has no candidates; repeated rows each give their findings; copies of a candidate in one text
are findings of their own, told apart by position; labels of one kind only give every finding that label, and without
any label nothing is a secret; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import kept

MAX_LABELLED, PLANTED = 20_000, 6_000
#: Words of the texts in the dictionary.
DICTIONARY = 400
#: Bytes of secrets up to which they are broadcast to the texts for redaction; more are joined by a shuffle.
MAX_BROADCAST = 16 << 20
MARK = "[SECRET]"

#: Published forms of keys.
FORMATS = {
    "aws_key": r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    "github_token": r"^(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}$",
    "slack_token": r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "google_key": r"^AIza[A-Za-z0-9_-]{35}$",
    "stripe_key": r"^[sr]k_(live|test)_[A-Za-z0-9]{16,}$",
    "jwt": r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$",
}
#: Names to which secrets are assigned, names of digests and identifiers, and common parts of names.
KEY_NAME = r"(?i)(token|secret|passw(or)?d|pwd|api_?-?key|access_?-?key|auth|credential|private_?-?key)"
DIGEST_NAME = r"(?i)(sha-?(1|256|512)|md5|commit|checksum|digest|etag|revision|integrity|uuid|guid)"
COMMON = r"(example|your|here|change|default|placeholder|sample|dummy|token|secret|password|passwd|index|image|page|test|data|file|config|user|mail|http|https|www|com|net|org|html|name|value|main|local|public|static|source|version|content|default|the|and|ing|ion)"
RUN = r"[A-Za-z0-9+/_=.@:-]{8,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: A published form within a word, and a name with the sign of assignment after it.
FORMAT = "(?<![A-Za-z0-9])(?:" + "|".join(p.strip("^$").replace("(", "(?:") for p in FORMATS.values()) + ")(?![A-Za-z0-9])"
NAMED = KEY_NAME + r"[\"'`]?(=>|:=|[:=])"

FEATURES = ("length", "digits", "upper", "lower", "signs", "transitions", "kinds", "hex", "covered", "format", "stars", "slashes", "dots", "address", "numeric", "uuid", "key_near", "digest_near", "assigned", "quoted", "in_word")


def _share(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")) / F.greatest(F.length(c), F.lit(1))


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position (of the word), nth (in the word), value, and the words before and after each candidate."""
    words = F.split(F.col(text_col), r"[ \t\n\x0B\f\r]+")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    # cheap tests on whole words first; only few words go on
    long_ = lambda w: (F.length(w) >= 16) & (w.rlike(r"[0-9]|[a-z][A-Z]") | w.rlike(FORMAT))
    after_name = lambda i: word(i - 1).isin("=", ":", "=>", ":=") & word(i - 2).rlike(KEY_NAME) | word(i - 1).rlike(NAMED + "$")
    named = lambda i, w: (F.length(w) >= 8) & (after_name(i) | w.rlike(NAMED))
    found = F.filter(F.transform("words", lambda w, i: F.when(long_(w) | named(i, w) | w.contains("-----BEGIN"), i)), lambda i: i.isNotNull())
    at = base.withColumn("found", found).select("doc_id", "words", F.explode_outer("found").alias("position")).filter("position IS NOT NULL")
    i = F.col("position")
    near = at.select(
        "doc_id", "position", word(i).alias("word"), word(i - 1).alias("before1"), word(i - 2).alias("before2"), word(i - 3).alias("before3"), word(i + 1).alias("after1"),
        F.concat_ws(" ", F.slice("words", i + 1, 4)).alias("ahead"), named(i, word(i)).alias("named"),
    )
    # an assigned value is taken whole: up to its closing quote, or the word without quotes and closing signs
    assigned = F.regexp_replace(F.when(F.col("word").rlike(NAMED), F.regexp_extract("word", NAMED + "(.*)$", 4)).otherwise(F.col("word")), "^[({\\[]+", "")
    quoted = F.regexp_extract(assigned, r"^([\"'`])(.*?)\1", 2)
    bare = F.regexp_replace(F.regexp_replace(assigned, "^[\"'`]+", ""), "[\"'`,;.)}>\\]]+$", "")
    bare = F.when(F.col("word").rlike("://|[?]"), F.regexp_extract(bare, "^[^&#]*", 0)).otherwise(bare)
    whole = F.when(F.length(quoted) > 0, quoted).otherwise(bare)
    runs = lambda c: F.regexp_extract_all(c, F.lit(RUN), F.lit(0))
    value = (
        F.when(F.col("ahead").rlike(r"^\S*" + PEM), F.array(F.regexp_extract("ahead", PEM, 0)))
        .when(F.col("word").rlike(FORMAT), F.concat(F.regexp_extract_all("word", F.lit(FORMAT), F.lit(0)), runs(F.regexp_replace("word", FORMAT, " "))))
        .when(F.col("named"), F.array(whole))
        .otherwise(runs(F.col("word")))
    )
    parts = near.withColumn("values", value).select("*", F.posexplode_outer("values").alias("nth", "value")).drop("values", "ahead")
    cut = F.regexp_replace("value", r"^[.:=/-]+|[.:=]+$", "")
    inner = F.when(F.col("value").rlike("(?i)^[a-z_-]+[:=]"), F.regexp_replace("value", r"^[A-Za-z_-]+[:=]+", "")).otherwise(cut)
    known = F.col("value").startswith("-----") | F.col("value").rlike("^" + FORMAT + "$")
    as_is = known | (F.col("named") & ~F.col("word").rlike(FORMAT))
    kept_ = parts.filter("value IS NOT NULL").withColumn("value", F.when(as_is, F.col("value")).otherwise(inner))
    return kept_.filter((F.length("value") >= 8) & (F.col("named") | F.col("value").rlike(r"[0-9]|[a-z][A-Z]") | known))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> str:
    """A pattern of the ``size`` commonest plain words of four letters or more in all texts, and of the fixed ones."""
    words = docs.select(F.explode_outer(F.regexp_extract_all(F.col(text_col), F.lit(r"\b[a-z]{4,12}\b"), F.lit(0))).alias("w")).filter("w IS NOT NULL")
    top = [r["w"] for r in words.groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(size).collect()]
    return "(" + "|".join([*sorted(top, key=lambda w: (-len(w), w)), COMMON.strip("()")]) + ")"


def with_features(found: DataFrame, words: str = COMMON) -> DataFrame:
    v, before = F.col("value"), F.concat_ws(" ", "before3", "before2", "before1")
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9"))
    hit = lambda cond: cond.cast("double")
    return found.withColumns({
        "length": F.length(v).cast("double"),
        "digits": _share(v, "[^0-9]"), "upper": _share(v, "[^A-Z]"), "lower": _share(v, "[^a-z]"), "signs": _share(v, "[A-Za-z0-9]"),
        "transitions": (runs - 1) / F.greatest(F.length(v) - 1, F.lit(1)),
        "kinds": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "hex": hit(v.rlike("^([0-9a-f]{16,}|[0-9A-F]{16,})$")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(v), words, "")) / F.length(v),
        "format": hit(v.startswith("-----") | v.rlike("^" + FORMAT + "$")), "stars": _share(v, "[^*xX0.<>{}$_-]"),
        "slashes": _share(v, "[^/]"), "dots": _share(v, "[^.]"),
        "address": hit(v.rlike(r"@|://|^www\.|\.(com|net|org|html?|png|jpe?g|js|css)$")),
        "numeric": hit(v.rlike(r"^[0-9.:_+-]+$")),
        "uuid": hit(v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        "key_near": hit(before.rlike(KEY_NAME) | F.col("word").rlike(KEY_NAME)), "digest_near": hit(before.rlike(DIGEST_NAME)),
        "assigned": hit(F.col("named") | F.col("before1").rlike("[=:]$") | F.col("word").rlike("^[A-Za-z_-]+[:=]")),
        "quoted": hit(F.col("word").rlike("[\"'`]")),
        "in_word": F.length(v) / F.greatest(F.length("word"), F.lit(1)),
    })


def kind_of() -> Column:
    rules = [F.when(F.col("value").startswith("-----"), "private_key"), *(F.when(F.col("value").rlike(p), k) for k, p in FORMATS.items())]
    return F.coalesce(*rules, F.when((F.col("key_near") > 0) & (F.col("assigned") > 0), "assigned"), F.lit("generic"))


def planted(spark: SparkSession, n: int = PLANTED) -> DataFrame:
    """doc_id, text, planted (a value in the text) and y: 1 if it is a secret, 0 if it only looks like one."""
    i, digest = F.col("doc_id"), lambda k: F.sha2(F.concat_ws(":", F.col("doc_id"), F.lit(k)), 256)
    mixed = lambda k, m: F.substring(F.translate(F.base64(F.unhex(digest(k))), "+/=", "kQ7"), 1, m)
    capitals = lambda k, m: F.substring(F.translate(F.upper(digest(k)), "01", "QZ"), 1, m)
    word = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(names))).cast("int") + 1)
    name = word("n", "token", "api_key", "password", "secret", "auth_token", "pwd", "access-key", "client_secret")
    sign, quote = word("s", " = ", "=", ": ", " := "), word("q", "", "", '"', "'")
    filler = word("f", "see the page", "as they said", "und dann", "pour la fin", "de los que", "in config", "commit by", "use")
    size = 10 + F.pmod(F.xxhash64(i), F.lit(30)).cast("int")
    password = F.concat(word("p", "Winter", "Hunter", "p@ss", "s3cr", "q1w2", "Gr8!", "x"), F.substring(mixed(1, 20), 1, 4 + F.pmod(F.xxhash64(i), F.lit(8)).cast("int")), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(97)).cast("string"))
    assigned = lambda v: F.concat(filler, F.lit(" "), name, sign, quote, v, quote, F.lit(" "), filler)
    bare = lambda v: F.concat(filler, F.lit(" "), v, F.lit(" "), filler)
    long_ = F.substring(digest(2), 1, 40)
    link = F.concat(F.lit("https://site.example/path?page=2&token="), mixed(3, 24))
    uuid = F.regexp_replace(F.substring(digest(4), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    false_ = word("w", "your_api_token_here", "example_password_1", "changeme_default_value", "placeholder-secret-2024", "xxxxxxxxxxxxxxxx", "****************", "<your-token-here>", "${SECRET_TOKEN}", "0000000000000000", "test_token_example")
    rows = [
        (assigned(long_), long_, 1), (assigned(F.substring(mixed(5, 40), F.lit(1), size)), F.substring(mixed(5, 40), F.lit(1), size), 1), (assigned(password), password, 1), (link, mixed(3, 24), 1),
        *((f(v), v, 1) for v in (F.concat(F.lit("AKIA"), capitals(6, 16)), F.concat(F.lit("ghp_"), mixed(7, 36)), F.concat(F.lit("xoxb-"), F.lower(mixed(8, 16))), F.concat(word("k", "AIza", "AIza"), mixed(9, 35))) for f in (bare, assigned)),
        (bare(F.lit("-----BEGIN RSA PRIVATE KEY-----")), F.lit("-----BEGIN RSA PRIVATE KEY-----"), 1),
        *((f(v), v, 0) for v in (F.concat(F.lit("AKIA"), capitals(10, 9), F.lit("EXAMPLE")), F.concat(F.lit("xoxb-your-token-"), word("e", "here", "example"))) for f in (bare, assigned)),
        (assigned(false_), false_, 0), (assigned(false_), false_, 0),
        (F.concat(word("d", "sha256: ", "md5 ", "commit ", "checksum = ", "etag: "), long_), long_, 0), (bare(long_), long_, 0), (bare(digest(11)), digest(11), 0),
        (F.concat(word("u", "uuid ", "guid: ", "id = "), uuid), uuid, 0), (bare(mixed(12, 40)), mixed(12, 40), 0),
        *((bare(v), v, 0) for v in (F.concat(F.lit("http://www.example.com/page"), i, F.lit("/index.html")), F.concat(F.lit("user."), i, F.lit("@mail3.example.com")), F.concat(F.lit("src/main/Version"), i, F.lit("/fileName.java")), F.concat(F.lit("20240101T"), F.pmod(F.xxhash64(i), F.lit(10**12))))),
    ]
    of = F.array(*[F.struct(t.alias("text"), v.alias("planted"), F.lit(y).alias("y")) for t, v, y in rows])
    # one range for all, so that the planted texts don't depend on the cluster
    return spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", F.element_at(of, F.pmod(i, F.lit(len(rows))).cast("int") + 1).alias("r")).select("doc_id", "r.*")


def fit(labelled: DataFrame, trees: int = 20, depth: int = 8) -> RandomForestClassificationModel | float | None:
    """A forest on labelled findings (features and y); the label alone if all have one, None without any."""
    h = labelled.select(*FEATURES, F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id", "position", "nth", "value"), F.lit(1 << 30)).alias("h"))
    n = {r["y"]: r["count"] for r in h.groupBy("y").count().collect()}
    if len(n) < 2:
        return next(iter(n), None)
    sample = h.filter(F.col("h") < float(1 << 30) * min(1.0, 1.05 * MAX_LABELLED / sum(n.values()))).orderBy("h", *FEATURES).limit(MAX_LABELLED)
    # both kinds weigh the same
    weight = F.when(F.col("y") > 0, sum(n.values()) / (2.0 * n[1.0])).otherwise(sum(n.values()) / (2.0 * n[0.0]))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample.withColumn("w", weight)).select("x", "y", "w")
    return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, seed=9).fit(kept(table))


def scan(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Findings: doc_id, position, nth, kind, value, score, is_secret.

    ``labels``: findings (doc_id, position, nth, y) to learn from; planted ones are used if it is None.
    """
    words = dictionary(docs, text_col)
    drop = ("word", "before1", "before2", "before3", "after1", "named")
    found = kept(with_features(candidates(docs, id_col=id_col, text_col=text_col), words).withColumn("kind", kind_of()).drop(*drop))
    if labels is None:
        given = kept(planted(docs.sparkSession))  # the plans after it are small
        own = with_features(candidates(given), words).drop(*drop)
        known = own.join(given.select("doc_id", "planted", "y"), "doc_id").filter(F.col("value") == F.col("planted"))
    else:
        known = found.join(labels.select("doc_id", "position", "nth", "y"), ["doc_id", "position", "nth"])
    model = fit(kept(known.filter("y IS NOT NULL").select("doc_id", "position", "nth", "value", "y", *FEATURES)))
    if isinstance(model, RandomForestClassificationModel):
        x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(found)
        out = model.setFeaturesCol("x").transform(x).withColumn("score", vector_to_array("probability")[1])
    else:
        out = found.withColumn("score", F.lit(float(model or 0.0)))
    return out.select("doc_id", "position", "nth", "kind", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def digest(findings: DataFrame) -> DataFrame:
    """Findings without the secrets themselves: their length and SHA-256."""
    return findings.select("doc_id", "position", "nth", "kind", F.length("value").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret found in a text replaced by ``MARK``; no row goes. ``count_col`` follows the text.

    Secrets come back by id and text hash, as ids may be null or repeat with other texts.
    """
    text_hash = F.xxhash64(F.col(text_col))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), text_hash.alias("text_hash")).alias("doc_id"), F.col(text_col).alias("text"))
    secret = scan(keyed).filter("is_secret")
    by_doc = kept(secret.groupBy(F.col("doc_id.id").alias("__id"), F.col("doc_id.text_hash").alias("__t")).agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False).alias("__secrets")))
    bytes_ = F.aggregate("__secrets", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["value"]) + 100)
    small = by_doc.agg(F.coalesce(F.sum(bytes_), F.lit(0))).first()[0] <= MAX_BROADCAST
    joined = docs.join(F.broadcast(by_doc) if small else by_doc, docs[id_col].eqNullSafe(F.col("__id")) & (text_hash == F.col("__t")), "left")
    # a PEM header stands for its whole block
    block = F.regexp_replace(F.col(text_col), r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(-----END [A-Z ]*PRIVATE KEY-----|$)", F.lit(MARK.replace("[", r"\[")))
    start = F.when(F.exists("__secrets", lambda s: s["value"].startswith("-----")), block).otherwise(F.col(text_col))
    text = F.when(F.col("__secrets").isNull(), F.col(text_col)).otherwise(F.aggregate("__secrets", start, lambda t, s: F.replace(t, s["value"], F.lit(MARK))))
    out = joined.select(*[docs[c] if c != text_col else text.alias(text_col) for c in docs.columns])
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.length(text_col).cast(dict(docs.dtypes)[count_col]))
    return out
