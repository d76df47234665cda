"""Further queries: streams, audits, stores, losses, text functions, learned heads, sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.functions import text
from chronolith.operators import audit, losses, neardup, selection, stats, store, vectors
from chronolith.plans.queries import query, r6, r9
from chronolith.sources import records, texts
from chronolith.sources.paths import fresh_path
from chronolith.streaming import cache_state, counts

# ---- streams


@query("""SELECT conv_id, turn, role, i//4 AS chunk_index, GREATEST(0, (i//4+1)*4-n) AS padding FROM (SELECT conv_id, turn, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text)-1 AS i, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def count_tumbling_chunks(b):
    return counts.tumbling(b.table("conversations"), "conv_id", ["turn", "role", "text"], 4).select("conv_id", "turn", "role", "chunk_index", "padding")


SLIDING = """SELECT stream_id, seq, total, largest FROM (SELECT stream_id, seq, CAST(SUM(value_c) OVER w AS BIGINT) AS total, MAX(value_c) OVER w AS largest FROM stream_event WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) WHERE seq>=16 AND MOD(seq-16,4)=0"""


@query(SLIDING, "stream_event")
def count_sliding_windows(b):
    return counts.sliding(b.stream_event, "stream_id", ["ts", "event_id"], "value_c", 16, 4)


@query("SELECT stream_id, event_id, value_c FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY seq DESC) AS r FROM stream_event) WHERE r<=10", "stream_event")
def keep_recent_n(b):
    return counts.keep_recent(b.stream_event, "stream_id", ["seq"], 10).select("stream_id", "event_id", "value_c")


#: One step for each event of a stream: the counter and the time of the last firing go from event to event.
FIRES = """, e AS MATERIALIZED (SELECT stream_id, seq, triggered, epoch_us(ts) AS us, epoch_us(ts)/CAST(1000000 AS DOUBLE) AS t FROM stream_event),
r AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS us, CAST(0 AS BIGINT) AS cnt, CAST(NULL AS DOUBLE) AS fired_at, FALSE AS fire FROM e
UNION ALL SELECT stream_id, seq, us, CASE WHEN fire THEN 0 ELSE c END, CASE WHEN fire THEN t ELSE fired_at END, fire FROM (SELECT *, c>=2 AND (fired_at IS NULL OR t-fired_at>=3600) AS fire FROM
(SELECT e.stream_id, e.seq, e.us, e.t, r.fired_at, CASE WHEN e.triggered=1 THEN r.cnt+1 ELSE 0 END AS c FROM r JOIN e ON e.stream_id=r.stream_id AND e.seq=r.seq+1)))
SELECT stream_id, {} AS seq, fired_at AS time FROM r WHERE fire"""


@query(FIRES.format("seq"), "stream_event", recursive=True)
def debounce_fires(b):
    rows = b.stream_event.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return counts.debounce(rows, "stream_id", "seq", "t", "triggered", 2, 3600.0)


def _event_stream(b):
    schema = b.table("events").schema
    folder, name = f"{b.sf_dir}/events.parquet", None
    events = b.spark.readStream.schema(schema)
    # a single file is read through its folder; a folder of parts as it is
    single = b.spark.read.format("binaryFile").load(folder).select("path").limit(2).collect()
    if len(single) == 1 and single[0]["path"].rstrip("/").endswith("events.parquet"):
        folder, name = b.sf_dir, "events.parquet"
    return (events.option("pathGlobFilter", name) if name else events).parquet(folder)


@query(FIRES.format("us"), "stream_event", recursive=True)
def streaming_debounce_fires(b):
    rows = _event_stream(b).select(F.col("user_id").alias("stream_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "error").alias("hit"))
    rows = rows.withColumns({"order": F.col("us"), "t": F.col("us") / 1e6})
    out = counts.debounce_stream(rows, "stream_id", "order", "t", "hit", 2, 3600.0, tie="event_id")
    return counts.run_available(out, fresh_path(b.spark, "fires"), fresh_path(b.spark, "state"))


@query(SLIDING, "stream_event")
def streaming_sliding_windows(b):
    rows = _event_stream(b).select(F.col("user_id").alias("stream_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return counts.run_available(counts.sliding_stream(rows, "stream_id", "us", "v", 16, 4, tie="event_id"), fresh_path(b.spark, "windows"), fresh_path(b.spark, "state"))


#: One step for each event of a stream, as in FIRES: the state of the cache goes from event to event.
CACHE_STEPS = """, q AS MATERIALIZED (SELECT e.user_id AS stream_id, e.event_id, ROW_NUMBER() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS seq, epoch_us(e.ts) AS us, epoch_us(e.ts)//3600000000 AS step, v.value_c AS v,
 CASE WHEN e.event_type='signup' THEN 'init' WHEN e.event_type='purchase' AND MOD(v.value_c,2)=0 THEN 'finalise' ELSE 'step' END AS op, CASE WHEN MOD(v.value_c,5)=0 THEN 'replace' ELSE 'append' END AS mode,
 CASE WHEN e.event_type='click' THEN 'token' ELSE 'kv' END AS ukind, CASE WHEN MOD(v.value_c,7)=0 THEN 'k' ELSE 'k,v' END AS unames,
 list_transform(range(1+MOD(v.value_c,3)), lambda i: CAST(v.value_c+i+CASE WHEN MOD(v.value_c,7)=0 THEN 0 ELSE 1 END AS DOUBLE)) AS news FROM events e JOIN stream_event v ON v.stream_id=e.user_id AND v.event_id=e.event_id),
r AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS us, CAST(0 AS BIGINT) AS step, '' AS op, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS run, FALSE AS active, CAST(0 AS BIGINT) AS last,
 CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS names, CAST([] AS DOUBLE[]) AS places FROM q
UNION ALL SELECT stream_id, event_id, seq, us, step, op, reason, run+CASE WHEN reason IS NULL AND op='init' THEN 1 ELSE 0 END, CASE WHEN reason IS NULL AND op<>'step' THEN op='init' ELSE active END, CASE WHEN reason IS NULL AND op<>'finalise' THEN step ELSE last END,
 CASE WHEN reason IS NOT NULL OR op='finalise' THEN kind WHEN op='init' THEN NULL ELSE ukind END, CASE WHEN reason IS NOT NULL OR op='finalise' THEN names WHEN op='init' THEN NULL ELSE unames END,
 CASE WHEN reason IS NOT NULL OR op='finalise' THEN places WHEN op='init' THEN [] WHEN mode='replace' OR names IS NULL THEN news ELSE list_concat(places, news)[-10:] END
FROM (SELECT q.*, r.run, r.active, r.last, r.kind, r.names, r.places, CASE WHEN (q.op='init')=r.active THEN CASE WHEN r.active THEN 'active' ELSE 'inactive' END WHEN q.op='finalise' THEN NULL WHEN q.op='step' AND q.step<=r.last THEN 'step_not_above' WHEN q.op='init' THEN NULL
 WHEN MOD(q.v,11)=0 THEN 'lengths' WHEN q.mode='append' AND r.names IS NOT NULL AND r.kind<>q.ukind THEN 'kind' WHEN q.mode='append' AND r.names IS NOT NULL AND r.names<>q.unames THEN 'tensors' END AS reason
 FROM r JOIN q ON q.stream_id=r.stream_id AND q.seq=r.seq+1))
SELECT stream_id, us, event_id, op, step, reason, run, CAST(len(places) AS BIGINT) AS length, COALESCE(list_sum(places), 0.0) AS total FROM r WHERE seq>0"""


def _cache_updates(events):
    """Events as steps of a cache: a sign-up opens a run, an even purchase ends it, others add to it or replace it."""
    v, us = F.round(F.col("value") * 100).cast("long"), F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("user_id").alias("stream_id"), us.alias("us"), "event_id", "event_type", v.alias("v"), F.floor(us / 3_600_000_000).alias("step"))
    kind, n = F.col("event_type"), (1 + F.col("v") % 3).cast("int")
    op = F.when(kind == "signup", "init").when((kind == "purchase") & (F.col("v") % 2 == 0), "finalise").otherwise("step")
    k = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.col("v") + i).cast("double"))
    ones = F.array_repeat(F.lit(1.0), n)
    single = F.col("v") % 7 == 0
    times = F.array_repeat(F.col("step").cast("double"), n + F.when(F.col("v") % 11 == 0, 1).otherwise(0))
    return rows.select(
        "stream_id", "us", "event_id", "step", op.alias("op"), F.when(F.col("v") % 5 == 0, "replace").otherwise("append").alias("mode"), F.when(kind == "click", "token").otherwise("kv").alias("kind"),
        F.when(single, F.array(F.lit("k"))).otherwise(F.array(F.lit("v"), F.lit("k"))).alias("names"), F.when(single, F.array(k)).otherwise(F.array(ones, k)).alias("values"), times.alias("times"),
    )


@query(CACHE_STEPS, "stream_event", recursive=True)
def cache_steps(b):
    return cache_state.follow(_cache_updates(b.table("events")), "stream_id", ["us", "event_id"], 10)


@query(CACHE_STEPS, "stream_event", recursive=True)
def streaming_cache_steps(b):
    name, before = "spark.sql.streaming.stateStore.providerClass", b.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    b.spark.conf.set(name, cache_state.ROCKS)
    try:
        out = cache_state.follow_stream(_cache_updates(_event_stream(b)), "stream_id", ["us", "event_id"], 10)
        return counts.run_available(out, fresh_path(b.spark, "steps"), fresh_path(b.spark, "state"))
    finally:
        b.spark.conf.set(name, before)


@query("SELECT CAST(time_bucket(INTERVAL '6 hours', ts) AS TIMESTAMP) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def window_counts(b):
    return counts.window_counts(b.table("events"), "ts", "event_type", "6 hours", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT event_id, '{"event": '||event_id||', "run": {"API-Key": "<redacted>", "tokens": ['||user_id||'], "steps": [{"session_cookie": "<redacted>", "type": "'||event_type||'"}, {"to\\u006ben": "<redacted>"}]}, "password": "<redacted>"}' AS metadata FROM events""")
def metadata_redaction(b):
    """Nested metadata of events; scalars, arrays and objects under secrets' names are hidden."""
    made = F.format_string(
        '{"event": %d, "run": {"API-Key": {"a": "x}", "b": [1, "]"]}, "tokens": [%d], "steps": [{"session_cookie": ["a", {"token": %d}], "type": "%s"}, {"to\\u006ben": null}]}, "password": -1.5e3}', "event_id", "user_id", "event_id", "event_type"
    )
    return b.table("events").select("event_id", text.redact_json(made).alias("metadata"))


# ---- audits

@query(""", s AS (SELECT video_id, num_frames, CASE WHEN MOD(video_id, 5)=0 THEN 'test' ELSE 'train' END AS split FROM video), k AS (SELECT CAST(video_id//3 AS VARCHAR) AS key, split FROM s)
SELECT key, COUNT(DISTINCT split) AS splits, COUNT(*) AS n FROM k GROUP BY key HAVING COUNT(DISTINCT split)>1""", "video")
def split_leakage(b):
    rows = b.video.withColumn("split", F.when(F.col("video_id") % 5 == 0, "test").otherwise("train")).withColumn("path", F.concat(F.lit("videos/"), F.floor(F.col("video_id") / 3).cast("string"), F.lit(".MP4")))
    return audit.canonical_leakage(rows, "path", "split")


@query("SELECT md5(text) AS key, COUNT(*) AS n, MIN(doc_id) AS first_item, MAX(doc_id) AS last_item FROM documents GROUP BY 1 HAVING COUNT(*)>1")
def duplicate_groups(b):
    return audit.duplicate_groups(b.table("documents"), F.md5(F.col("text").cast("binary")), "doc_id")


@query(""", t AS (SELECT * FROM tile WHERE MOD(video_id+frame_start//8, 7)<>0), s AS (SELECT *, LAG(frame_end) OVER (PARTITION BY video_id ORDER BY frame_start) AS before FROM t),
f AS (SELECT video_id, MIN(frame_start) AS lo, MAX(frame_end) AS hi, MAX(CASE WHEN before<frame_start THEN 1 ELSE 0 END) AS gap, MAX(CASE WHEN before>frame_start THEN 1 ELSE 0 END) AS ov FROM s GROUP BY 1),
r AS (SELECT f.video_id, CASE WHEN lo<>0 THEN 'starts late' WHEN gap>0 THEN 'gap' WHEN ov>0 THEN 'overlap' WHEN hi<>clips*8 THEN 'wrong end' END AS reason FROM f JOIN video v ON v.video_id=f.video_id)
SELECT video_id, reason FROM r WHERE reason IS NOT NULL""", "tile", "video")
def tiling_issues(b):
    tiles = b.tile.filter((F.col("video_id") + F.floor(F.col("frame_start") / 8)) % 7 != 0)
    return audit.tiling_issues(tiles, "video_id", "frame_start", "frame_end", b.video.select("video_id", (F.col("clips") * 8).alias("frames")), "frames")


@query("""SELECT video_id, concat_ws(',', CASE WHEN clips<2 THEN 'few_clips' END, CASE WHEN num_frames>80 THEN 'long' END, CASE WHEN weak_label=0 THEN 'normal' END) AS reasons, clips>=2 AND num_frames<=80 AND weak_label<>0 AS ready FROM video""", "video")
def readiness_reasons(b):
    return audit.readiness(b.video, "video_id", {"few_clips": F.col("clips") < 2, "long": F.col("num_frames") > 80, "normal": F.col("weak_label") == 0})


@query("""SELECT l_orderkey, array_to_string(list_filter([CASE WHEN COUNT(DISTINCT l_returnflag)>1 THEN 'l_returnflag' END, CASE WHEN COUNT(DISTINCT l_linestatus)>1 THEN 'l_linestatus' END], lambda x: x IS NOT NULL), ',') AS varying
FROM lineitem GROUP BY l_orderkey HAVING COUNT(DISTINCT l_returnflag)>1 OR COUNT(DISTINCT l_linestatus)>1""")
def constant_columns(b):
    return audit.constant_per_key(b.table("lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"]).select("l_orderkey", F.array_join("varying", ",").alias("varying"))


@query("""SELECT o_custkey AS key, 'left_only' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE MOD(c_nationkey,3)<>0) GROUP BY 1
UNION ALL SELECT c_custkey, 'right_only' FROM customer WHERE MOD(c_nationkey,3)<>0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1""")
def membership_diff(b):
    return audit.key_diff(b.table("orders").select(F.col("o_custkey").alias("key")), b.table("customer").filter("c_nationkey % 3 <> 0").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT event_type, 2000 AS expected, COUNT(*) AS observed, COUNT(*)=2000 AS ok FROM events GROUP BY 1")
def expected_counts(b):
    want = b.table("events").select("event_type").distinct().withColumn("expected", F.lit(2000))
    return audit.expected_counts(b.table("events"), "event_type", want)


@query("""SELECT CAST(SUM(CAST('0x' || SUBSTR(sha256(concat_ws(chr(31), COALESCE(CAST(doc_id AS VARCHAR), chr(0)), COALESCE(text, chr(0)), COALESCE(lang, chr(0)), COALESCE(source, chr(0)))), 1, 12) AS BIGINT)) AS VARCHAR) AS digest, COUNT(*) AS "rows" FROM documents""")
def table_digest(b):
    return audit.table_digest(b.table("documents"), ["doc_id", "text", "lang", "source"])


# ---- near-duplicates and stores

SLICES = """WITH d AS (SELECT doc_id, text, CAST(CEIL(LENGTH(text)/9.0) AS INT) AS c FROM documents WHERE LENGTH(text)>0),
h AS (SELECT doc_id, pos, md5(SUBSTR(text, pos*c+1, c)) AS h FROM d, (SELECT unnest(generate_series(0,8)) AS pos) WHERE LENGTH(text)>pos*c),
k AS (SELECT doc_id, string_agg(h, '' ORDER BY pos) AS all_h FROM h GROUP BY 1), rep AS (SELECT MIN(doc_id) AS doc_id FROM k GROUP BY all_h),
s AS (SELECT h.doc_id, pos, h FROM h JOIN rep ON rep.doc_id=h.doc_id),
c AS (SELECT a.doc_id AS doc_id, b.doc_id AS other, a.pos, 1 AS m FROM s a JOIN s b ON a.pos=b.pos AND a.h=b.h AND a.doc_id<b.doc_id),
i AS (SELECT doc_id, other, pos-ROW_NUMBER() OVER (PARTITION BY doc_id, other ORDER BY pos) AS g FROM c),
r AS (SELECT doc_id, other, g, COUNT(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT doc_id, other, CAST(SUM(n) AS BIGINT) AS matches, CAST(MAX(n) AS BIGINT) AS longest FROM r GROUP BY 1, 2 HAVING SUM(n)>=4 AND MAX(n)>=3"""


@query(SLICES)
def near_dup_block_pairs(b):
    c = F.ceil(F.length("text") / 9).cast("int")
    d = b.table("documents").filter(F.length("text") > 0).select("doc_id", "text", c.alias("c")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(8))))
    h = d.filter(F.length("text") > F.col("pos") * F.col("c")).select("doc_id", "pos", F.md5(F.substring("text", F.col("pos") * F.col("c") + 1, F.col("c")).cast("binary")).alias("h"))
    whole = h.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "").alias("all_h"))
    rep = whole.groupBy("all_h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")  # copies are compared once
    return neardup.block_pairs(h.join(rep, "doc_id"), "doc_id", "pos", "h")


@query(""", n AS (SELECT video_id, clip_index, score_c+100 AS score_c FROM clip WHERE MOD(video_id,4)=1)
SELECT video_id, clip_index, score_c FROM n UNION ALL SELECT c.video_id, c.clip_index, c.score_c FROM clip c WHERE MOD(video_id,3)=1 AND NOT EXISTS (SELECT 1 FROM n WHERE n.video_id=c.video_id AND n.clip_index=c.clip_index)""", "clip")
def upsert_index(b):
    old = b.clip.filter("video_id % 3 = 1").select("video_id", "clip_index", "score_c")
    new = b.clip.filter("video_id % 4 = 1").select("video_id", "clip_index", (F.col("score_c") + 100).alias("score_c"))
    return store.upsert(old, new, ["video_id", "clip_index"])


@query(""", u AS (SELECT video_id, clip_index, score_c AS v, 'a' AS run, 1 AS pref FROM clip WHERE MOD(video_id,2)=0 UNION ALL SELECT video_id, clip_index, alt_c, 'b', 0 FROM clip WHERE MOD(video_id,3)=0)
SELECT video_id, clip_index, v, run, owners FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id, clip_index ORDER BY pref) AS rn, COUNT(*) OVER (PARTITION BY video_id, clip_index) AS owners FROM u) WHERE rn=1""", "clip")
def merge_runs(b):
    a = b.clip.filter("video_id % 2 = 0").select("video_id", "clip_index", F.col("score_c").alias("v"))
    z = b.clip.filter("video_id % 3 = 0").select("video_id", "clip_index", F.col("alt_c").alias("v"))
    return store.merge_runs([("a", a), ("b", z)], ["video_id", "clip_index"], ["b", "a"])


@query("""SELECT o_orderkey, o_custkey, c_acctbal AS control, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'available' END AS control_status FROM orders LEFT JOIN (SELECT * FROM customer WHERE MOD(c_nationkey,3)<>0) ON c_custkey=o_custkey""")
def left_join_controls(b):
    controls = b.table("customer").filter("c_nationkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("control"))
    return store.left_join_controls(b.table("orders").select("o_orderkey", "o_custkey"), controls, ["o_custkey"], "control")


# ---- losses

REG = """, s AS (SELECT video_id, score_c, LEAD(score_c) OVER (PARTITION BY video_id ORDER BY clip_index)-score_c AS step FROM clip),
g AS (SELECT video_id, CAST(COALESCE(SUM(step*step),0) AS BIGINT) AS smooth, CAST(SUM(ABS(score_c)) AS BIGINT) AS sparse, COUNT(*) AS n, MAX(score_c) AS bag_max FROM s GROUP BY video_id)
"""


@query(REG + "SELECT video_id, smooth, sparse, n, bag_max FROM g", "clip")
def smoothness_sparsity(b):
    return losses.regularizers(b.clip, "video_id", "clip_index", "score_c")


def _bags(b):
    return losses.regularizers(b.clip, "video_id", "clip_index", "score_c").join(b.video.select("video_id", "weak_label"), "video_id")


@query(REG + """, h AS (SELECT weak_label, bag_max AS m, COUNT(*) AS c FROM g JOIN video v ON v.video_id=g.video_id GROUP BY 1, 2)
SELECT ROUND(SUM(p.c*q.c*GREATEST(0, 3-p.m+q.m))/CAST(SUM(p.c*q.c) AS DOUBLE),9) AS loss FROM h p, h q WHERE p.weak_label=1 AND q.weak_label=0""", "clip", "video")
def ranking_loss_all_pairs(b):
    return losses.ranking_loss_all_pairs(_bags(b), "weak_label", "bag_max", 3).select(r9("loss").alias("loss"))


@query(REG + """, r AS (SELECT weak_label, bag_max AS m, ROW_NUMBER() OVER (PARTITION BY weak_label ORDER BY g.video_id)-1 AS i, COUNT(*) OVER (PARTITION BY weak_label) AS c FROM g JOIN video v ON v.video_id=g.video_id),
k AS (SELECT (SELECT MAX(c) FROM r WHERE weak_label=1) AS np, (SELECT MAX(c) FROM r WHERE weak_label=0) AS nn), t AS (SELECT unnest(generate_series(0, GREATEST(np,nn)-1)) AS s, np, nn FROM k)
SELECT ROUND(AVG(GREATEST(0, 3-p.m+q.m)),9) AS loss, COUNT(*) AS pairs FROM t JOIN r p ON p.weak_label=1 AND p.i=MOD(s,np) JOIN r q ON q.weak_label=0 AND q.i=MOD(s,nn)""", "clip", "video")
def ranking_loss_cyclic(b):
    return losses.ranking_loss_cyclic(_bags(b), "video_id", "weak_label", "bag_max", 3.0).withColumn("loss", r9("loss"))


@query(""", l AS (SELECT video_id, y, (score_c-5)/2.0 AS x FROM clip), e AS (SELECT video_id, (CASE WHEN y>0 THEN 2.0*(GREATEST(-x,0)+ln(1+exp(-abs(x)))) ELSE GREATEST(x,0)+ln(1+exp(-abs(x))) END)*pow(CASE WHEN y>0 THEN 1-1/(1+exp(-x)) ELSE 1/(1+exp(-x)) END, 2) AS loss FROM l)
SELECT video_id, ROUND(AVG(loss),9) AS loss FROM e GROUP BY video_id""", "clip")
def bce_focal_loss(b):
    loss = losses.bce_focal((F.col("score_c") - 5) / 2.0, F.col("y"), 2.0, 2.0)
    return b.clip.groupBy("video_id").agg(r9(F.avg(loss)).alias("loss"))


# ---- text and nested data

@query("""SELECT event_type, MIN(k) AS lo, ROUND(quantile_cont(CAST(k AS DOUBLE),0.5),6) AS p50, ROUND(quantile_cont(CAST(k AS DOUBLE),0.9),6) AS p90, MAX(k) AS hi, COUNT(DISTINCT user_id) AS users FROM (SELECT event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def token_count_stats_json(b):
    k = F.get_json_object("props", "$.k").cast("long")
    return b.table("events").select("event_type", "user_id", k.alias("k")).groupBy("event_type").agg(F.min("k").alias("lo"), r6(F.percentile("k", 0.5)).alias("p50"), r6(F.percentile("k", 0.9)).alias("p90"), F.max("k").alias("hi"), F.count_distinct("user_id").alias("users"))


@query("""SELECT page_id, CASE WHEN LENGTH(c)>0 THEN SUBSTR(c,1,64) ELSE 'item' END || '-' || SUBSTR(sha256(url),1,10) AS slug FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS c FROM pages)""")
def slugs(b):
    return b.table("pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("""SELECT token_id, CASE WHEN m<0.25 THEN 'unknown' ELSE 'class' || (list_position(p, m)-1) END AS label, (list_position(p, m)<>1 AND m>=0.25) OR MOD(token_id,10)>=8 AS anomaly FROM (SELECT token_id, p, list_max(p) AS m FROM (SELECT token_id, [CAST(x AS DOUBLE)/4 for x in embedding] AS p FROM token))""", "token")
def fusion_label(b):
    p = F.transform("embedding", lambda x: x.cast("double") / 4)
    label, anomaly = text.fuse_labels(F.col("p"), [f"class{i}" for i in range(64)], F.col("token_id") % 10, 8, 0.25)
    return b.token.select("token_id", p.alias("p")).select("token_id", label.alias("label"), anomaly.alias("anomaly"))


@query("SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def row_fingerprints(b):
    return b.table("orders").select("o_orderkey", text.fingerprint(F.col("o_orderkey"), F.col("o_orderstatus")).alias("fingerprint"))


# ---- learned

@query()
def logistic_head(b):
    """Pooled vectors of a bag, a logistic head on eight tenths of the bags, and its probabilities for all."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    pooled = vectors.mean_merge(b.token, "pair_id", "token_id", "embedding")
    label = b.token.groupBy("pair_id").agg((F.max("label") >= 7).cast("int").alias("y"))
    rows = pooled.join(label, "pair_id").select("pair_id", "y", array_to_vector("merged").alias("features"))
    part = selection.split_by_hash(rows.select("pair_id", "y"), "pair_id", "y", "11")
    rows = rows.join(part.drop("y"), "pair_id")
    head = LogisticRegression(labelCol="y", maxIter=50, regParam=0.01).fit(rows.filter("part = 'fit'"))
    return head.transform(rows).select("pair_id", "part", "y", vector_to_array("probability")[1].alias("score"))


# ---- sources: tables as the formats of files, written and read back

@query("SELECT CAST(video_id AS VARCHAR) AS video_id, CASE WHEN weak_label=1 THEN TRUE ELSE FALSE END AS is_anomaly, num_frames, ROUND(num_frames/10.0,3) AS duration_seconds, COALESCE(n,0) AS annotations FROM video LEFT JOIN (SELECT video_id AS v, COUNT(*) AS n FROM annotation GROUP BY 1) ON v=video_id", "annotation", "video")
def manifest_jsonl_round_trip(b):
    span = F.struct(F.col("span_start").cast("double").alias("start"), F.col("span_end").cast("double").alias("end"), F.lit("frame").alias("unit"))
    ann = b.annotation.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(F.lit("segment").alias("scope"), F.lit(None).cast("string").alias("label"), (F.col("is_anomaly") == 1).alias("is_anomaly"), span.alias("span")))).alias("annotations"))
    rows = b.video.join(ann, "video_id", "left").select(
        F.lit(1).alias("schema_version"), F.col("video_id").cast("string").alias("video_id"), F.concat(F.lit("videos/"), F.col("video_id"), F.lit(".mp4")).alias("path"), F.lit("train").alias("split"),
        F.lit("any").alias("category"), (F.col("weak_label") == 1).alias("is_anomaly"), "annotations", "num_frames", F.lit(10.0).alias("fps"), F.round(F.col("num_frames") / 10, 3).alias("duration_seconds"),
    )
    path = fresh_path(b.spark, "manifest")
    records.write_jsonl(rows, path)
    return records.read_jsonl(b.spark, path, records.MANIFEST).select("video_id", "is_anomaly", "num_frames", "duration_seconds", F.coalesce(F.size("annotations"), F.lit(0)).cast("long").alias("annotations"))


@query("SELECT 'v' || video_id || 'x' || clip_index AS video_id, CASE WHEN y=1 THEN 'Fall' ELSE 'Normal' END AS category, CASE WHEN y=1 THEN CAST(frame_start AS VARCHAR) || '-' || frame_end END AS spans, CAST(NULL AS VARCHAR) AS issue FROM clip", "clip")
def temporal_annotation_text(b):
    line = F.concat_ws("  ", F.concat(F.lit("V"), F.col("video_id"), F.lit("x"), F.col("clip_index"), F.lit(".mp4")), F.when(F.col("y") == 1, "Fall").otherwise("Normal"), F.when(F.col("y") == 1, F.col("frame_start") + 1).otherwise(-1).cast("string"), F.when(F.col("y") == 1, F.col("frame_end")).otherwise(-1).cast("string"), F.lit("-1"), F.lit("-1"))
    path = fresh_path(b.spark, "annotations")
    b.clip.select(line.alias("value")).write.text(path)
    got = texts.temporal_annotations(texts.lines(b.spark, path))
    shown = F.when(F.size("spans") > 0, F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ","))
    return got.select("video_id", "category", shown.alias("spans"), "issue")


@query("SELECT CAST(video_id AS VARCHAR) AS video_id, 'set' || MOD(video_id,4) AS folder, FALSE AS conflict, COUNT(*) AS chunks, 'train' AS split FROM clip GROUP BY video_id", "clip")
def split_file_parse(b):
    path = fresh_path(b.spark, "split")
    b.clip.select(F.concat(F.lit("set"), (F.col("video_id") % 4).cast("string"), F.lit("/"), F.col("video_id"), F.lit("__"), F.col("clip_index"), F.lit(".npy")).alias("value")).write.text(path)
    return texts.split_file(texts.lines(b.spark, path), "train")


@query("""SELECT CAST(o.o_orderkey AS VARCHAR) AS video_id, 'new/cam' || MOD(o_custkey,5) || '/' || o_orderkey AS video_path, CASE WHEN MOD(o_orderkey,2)=0 THEN o_orderstatus ELSE 'new' END AS label, CASE WHEN MOD(o_orderkey,2)=0 THEN 'cam' ELSE 'cam' || MOD(o_custkey,5) END AS camera_id FROM orders o""")
def labels_csv_update(b):
    path = fresh_path(b.spark, "labels")
    o = b.table("orders")
    o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("video_id"), F.lit("old").alias("video_path"), F.col("o_orderstatus").alias("label"), F.lit("cam").alias("camera_id")).write.option("header", True).csv(path)
    listing = o.select(F.col("o_orderkey").cast("string").alias("video_id"), F.concat(F.lit("new/cam"), (F.col("o_custkey") % 5).cast("string"), F.lit("/"), F.col("o_orderkey")).alias("video_path"))
    return records.update_labels(records.read_labels_csv(b.spark, path), listing, "unlabelled")


@query("SELECT CAST(user_id AS VARCHAR) AS log, CAST(seq AS INT) AS epoch, 'loss' AS metric, ROUND(value_c/100.0,2) AS value FROM (SELECT stream_id AS user_id, seq, value_c FROM stream_event)", "stream_event")
def training_log_parse(b):
    lines = b.stream_event.select(F.col("stream_id").cast("string").alias("log"), F.explode(F.array(F.struct((F.col("seq") * 2).alias("line"), F.concat(F.lit("== Epoch "), F.col("seq"), F.lit(" ==")).alias("value")), F.struct((F.col("seq") * 2 + 1).alias("line"), F.format_string("  loss=%.2f", F.col("value_c") / 100.0).alias("value")))).alias("x")).select("log", "x.*")
    got = texts.training_log(lines).filter("metric = 'loss'")
    return got.select("log", "epoch", "metric", F.round("value", 2).alias("value"))


@query("""SELECT l_suppkey AS pid, l_returnflag AS gpu_uuid, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last, COUNT(*) AS samples, MAX(l_quantity) AS peak, ROUND(AVG(l_quantity),6) AS mean FROM lineitem GROUP BY 1, 2""")
def monitor_summary(b):
    rows = b.table("lineitem").select(F.col("l_suppkey").alias("pid"), F.col("l_returnflag").alias("gpu_uuid"), F.col("l_shipdate").alias("timestamp_utc"), F.col("l_quantity").alias("used_memory_mib"), F.col("l_linestatus").alias("command"))
    return texts.monitor_summary(rows).withColumn("mean", r6("mean")).drop("command")


@query("SELECT CAST(video_id AS VARCHAR) AS video_id, weak_label, clips*8 AS num_frames, frame_start AS start, frame_end AS \"end\", label FROM tile JOIN video USING (video_id)", "tile", "video")
def truth_rows(b):
    path = fresh_path(b.spark, "truth")
    t = b.tile.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(F.col("frame_start").alias("start"), F.col("frame_end").alias("end"), "label"))).alias("intervals"))
    rows = t.join(b.video, "video_id").select(F.col("video_id").cast("string").alias("video_id"), "weak_label", (F.col("clips") * 8).alias("num_frames"), "intervals")
    records.write_jsonl(rows, path)
    return records.truth_intervals(records.read_jsonl(b.spark, path, records.TRUTH))


@query("SELECT user_id AS video_id, CAST(SUM(h) AS BIGINT) AS hits, ROUND(AVG(CASE WHEN a>0 THEN h/CAST(a AS DOUBLE) END),9) AS reuse FROM (SELECT user_id, CAST(FLOOR(value) AS BIGINT)+1 AS a, MOD(event_id,2) AS h FROM events) GROUP BY 1")
def cache_reuse(b):
    rows = b.table("events").select(F.col("user_id").alias("video_id"), (F.floor("value") + 1).alias("input_tokens"), (F.col("event_id") % 2).alias("reused_tokens"))
    return records.reuse_ratio(rows).groupBy("video_id").agg(F.sum("reused_tokens").alias("hits"), r9(F.avg("reuse_ratio")).alias("reuse"))
