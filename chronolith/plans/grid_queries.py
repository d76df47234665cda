"""Queries of irregular grids, roles of archive members, digests of files, bundles and attention by columns."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import attention, audit, grids, neardup, roles
from chronolith.plans.queries import query, r6, r9
from chronolith.sources import records
from chronolith.sources.paths import fresh_path

# ---- grids of times

REDUCED = "ROUND(COALESCE(MAX(s),0),9) AS score_max, ROUND(COALESCE(AVG(s),0),9) AS score_mean, COALESCE(arg_min(s,o),0) AS score_first, COALESCE(arg_max(s,o),0) AS score_last"


def _rounded(df):
    return df.withColumns({c: r9(c) for c in ("score_max", "score_mean")})


@query(""", iv AS (SELECT video_id, clip_index*0.3::DOUBLE AS a, clip_index*0.3::DOUBLE+0.65::DOUBLE*(1+clip_index%3) AS z, CAST(score_c AS DOUBLE) AS s, clip_index AS o FROM clip),
gr AS (SELECT video_id, frame, frame/(CASE WHEN video_id%2=0 THEN 24 ELSE 30 END)::DOUBLE AS t FROM (SELECT video_id, unnest(generate_series(0, num_frames-1)) AS frame FROM video))
SELECT gr.video_id, frame, """ + REDUCED + " FROM gr LEFT JOIN iv ON iv.video_id=gr.video_id AND a<=t AND t<z GROUP BY gr.video_id, frame", "clip", "video")
def project_seconds_rate(b):
    """Intervals in seconds on the frames of videos of 24 or 30 frames a second."""
    at = F.col("clip_index") * F.lit(0.3)
    iv = b.clip.select("video_id", "clip_index", "score_c", at.alias("a"), (at + F.lit(0.65) * (1 + F.col("clip_index") % 3)).alias("z"))
    videos = b.video.withColumn("fps", F.when(F.col("video_id") % 2 == 0, 24.0).otherwise(30.0))
    return _rounded(grids.project_rate(iv, videos, "video_id", "a", "z", "score_c", "clip_index", "num_frames", "fps"))


@query(""", iv AS (SELECT user_id, epoch(ts) AS a, epoch(ts)+600*(1+event_id%97) AS z, CAST(ROUND(value*100) AS DOUBLE) AS s, event_id AS o FROM events),
gr AS (SELECT user_id, event_id, epoch(ts)+0.5 AS t FROM events WHERE event_type='error')
SELECT gr.user_id, event_id, """.lstrip(", ").replace("iv AS", "WITH iv AS", 1) + REDUCED + " FROM gr LEFT JOIN iv ON iv.user_id=gr.user_id AND a<=t AND t<z GROUP BY gr.user_id, event_id")
def project_explicit_times(b):
    """What each event holds for 10 minutes and up to 16 hours, at half a second after each error of its stream."""
    e = b.table("events")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / F.lit(1e6)
    iv = e.select("user_id", "event_id", F.round(F.col("value") * 100).alias("v"), at.alias("a"), (at + 600 * (1 + F.col("event_id") % 97)).alias("z"))
    grid = e.filter("event_type = 'error'").select("user_id", "event_id", (at + 0.5).alias("time"))
    return _rounded(grids.project_times(iv, grid, "user_id", "a", "z", "v", "event_id", "time").drop("time"))


# ---- roles


@query("""WITH m AS (SELECT CASE WHEN o_orderkey%6=0 THEN 'test_videos' ELSE 'train_' || o_orderkey%5 END AS volume, o_orderkey AS k,
CASE WHEN o_orderkey%11=0 THEN 'plain' || o_orderkey//40 ELSE 'Cam ' || o_custkey%401 || '__#' || o_orderkey END AS stem,
CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B1-0-0' ELSE CASE WHEN o_orderkey%3=0 THEN 'B1-B1-0' ELSE 'G-B2-0' END END AS classes, o_orderkey%17=0 AS odd FROM orders),
r AS (SELECT *, volume || '/Videos/' || stem || '_label_' || classes || CASE WHEN odd THEN '.avi' ELSE '.mp4' END AS path, CASE WHEN volume='test_videos' THEN 'test' ELSE 'train' END AS split,
CASE WHEN NOT odd THEN sha256(lower(stem || '_label_' || classes)) END AS video_id, CASE WHEN k%11<>0 THEN sha256(lower(split_part(stem,'__#',1))) END AS source FROM m),
n AS (SELECT *, COUNT(*) OVER (PARTITION BY video_id) AS c, MIN(split) OVER (PARTITION BY video_id)<>MAX(split) OVER (PARTITION BY video_id) AS mixed FROM r),
i AS (SELECT *, CASE WHEN odd THEN 'extension' WHEN mixed THEN 'both splits' WHEN c>1 THEN 'duplicate' WHEN split='train' AND classes='B1-B1-0' THEN 'labels' END AS issue FROM n),
s AS (SELECT source, bool_or(split='test') AS te, bool_or(split='train') AS tr FROM i WHERE issue IS NULL AND source IS NOT NULL GROUP BY 1),
p AS (SELECT source, ROW_NUMBER() OVER (ORDER BY sha256('202709' || chr(0) || source))-1 AS place, COUNT(*) OVER () AS n FROM s WHERE tr)
SELECT video_id, path, split, CASE WHEN split='train' AND NOT odd AND classes<>'B1-B1-0' THEN classes END AS labels, CASE WHEN split='train' AND NOT odd AND classes<>'B1-B1-0' THEN classes<>'A' END AS is_anomaly, i.source,
CASE WHEN issue IS NULL AND split='train' THEN CASE WHEN place IS NULL OR place<n*8//10 THEN 'fit' WHEN place<n*8//10+n//10 THEN 'confirm' ELSE 'select' END END AS role, COALESCE(te AND tr, FALSE) AS shared,
CASE WHEN k%5=0 THEN 'missing' WHEN k%7=0 THEN 'size mismatch' ELSE 'available' END AS status, issue FROM i LEFT JOIN s USING (source) LEFT JOIN p ON p.source=i.source""")
def prepared_roles(b):
    """Orders as members of archives: customers are sources, some names have none, some repeat, some files lack or differ."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    stem = F.when(k % 11 == 0, F.concat(F.lit("plain"), F.floor(k / 40))).otherwise(F.concat(F.lit("Cam "), F.col("o_custkey") % 401, F.lit("__#"), k))
    classes = F.when(status == "F", "A").when(status == "O", "B1-0-0").when(k % 3 == 0, "B1-B1-0").otherwise("G-B2-0")
    name = F.concat(F.lit("Videos/"), stem, F.lit("_label_"), classes, F.when(k % 17 == 0, ".avi").otherwise(".mp4"))
    volume = F.when(k % 6 == 0, "test_videos").otherwise(F.concat(F.lit("train_"), k % 5))
    # repeated names have one size, so that a path stands for one file
    m = b.table("orders").select("o_orderkey", volume.alias("volume"), name.alias("name"), F.lit(1000).cast("long").alias("size"))
    files = m.filter("o_orderkey % 5 <> 0").select(F.concat("volume", F.lit("/"), "name").alias("path"), F.when(k % 7 == 0, 999).otherwise(1000).cast("long").alias("size"))
    return roles.prepare(m.drop("o_orderkey"), files, 202709)


# ---- digests and bundles


@query("SELECT c_nationkey AS nation, CAST(SUM(octet_length(encode(line))) AS BIGINT) AS length, sha256(string_agg(line, '' ORDER BY c_custkey)) AS sha256 FROM (SELECT c_nationkey, c_custkey, c_custkey || ' ' || c_name || chr(10) AS line FROM customer) GROUP BY 1")
def file_digests(b):
    """A file of the customers of each nation, written and hashed."""
    path = fresh_path(b.spark, "digests")
    lines = b.table("customer").select("c_nationkey", "c_custkey", F.concat("c_custkey", F.lit(" "), "c_name").alias("value"))
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast(b.table("customer").schema["c_nationkey"].dataType)
    return records.file_digests(b.spark, path).select(nation.alias("nation"), "length", "sha256")


def _bundled(vec_id: pd.Series, part: pd.Series) -> pd.Series:
    def npz(i, x) -> bytes:
        out = io.BytesIO()
        x = np.asarray(x, np.float32)
        half = {"first": x[: len(x) // 2]} if i % 11 == 0 else {"first": x[: len(x) // 2], "second": x[len(x) // 2 :].reshape(2, -1)}
        np.savez(out, **half)
        return out.getvalue()

    return pd.Series([npz(i, x) for i, x in zip(vec_id, part)])


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, len(embedding)//2 AS h FROM embeddings),
n AS (SELECT *, unnest(['head', 'tail']) AS name FROM v), i AS (SELECT *, CASE WHEN vec_id%13=0 THEN 'paths' WHEN vec_id%7=0 THEN 'missing' WHEN vec_id%5=0 THEN 'sha256' WHEN name='tail' AND vec_id%11=0 THEN 'member' WHEN name='tail' AND vec_id%3=0 THEN 'shape' END AS issue FROM n)
SELECT CAST(vec_id AS VARCHAR) AS video_id, name, issue, CASE WHEN issue IS NULL THEN ROUND(list_sum(CASE WHEN name='head' THEN e[1:h] ELSE e[h+1:] END),9) END AS total FROM i""")
def feature_bundles(b):
    """Vectors as .npz bundles of two members; records that name two bundles, none that exists, or another digest, member or shape."""
    saved = F.pandas_udf(_bundled, "binary")
    k = F.col("vec_id")
    v = b.table("embeddings").select("vec_id", F.concat("vec_id", F.lit(".npz")).alias("path"), F.floor(F.size("embedding") / 2).cast("int").alias("h"), saved("vec_id", "embedding").alias("content"))
    digest = F.when(k % 5 == 0, F.sha2("content", 224)).otherwise(F.sha2("content", 256))
    shape = F.when(k % 3 == 0, F.array("h")).otherwise(F.array(F.lit(2), F.floor(F.col("h") / 2).cast("int")))
    about = lambda path, key, shape: F.struct(path.alias("path"), F.lit(key).alias("key"), shape.alias("shape"), F.lit("float32").alias("dtype"), digest.alias("sha256"), (F.col("h") * 4).cast("long").alias("nbytes"))
    other = F.when(k % 13 == 0, F.lit("other.npz")).otherwise(F.col("path"))
    index = v.select(k.cast("string").alias("video_id"), F.lit("0").alias("clip_id"), F.lit("npz").alias("storage_format"), F.create_map(F.lit("head"), about(F.col("path"), "first", F.array("h")), F.lit("tail"), about(other, "second", shape)).alias("arrays"))
    got = records.load_arrays(index, v.filter("vec_id % 7 <> 0").select("path", "content"))
    return got.select("video_id", "name", "issue", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


# ---- attention by columns

ATTENTION = """, e AS (SELECT token_id, group_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM token), f AS (SELECT token_id, group_id, list_transform(v, lambda x: exp(x-list_max(v))) AS e FROM e),
p AS (SELECT token_id, group_id, list_transform(e, lambda x: x/list_sum(e)) AS p FROM f)"""


def _attention(b):
    return b.token.select("token_id", "group_id", attention.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))


@query(ATTENTION + """, c AS (SELECT group_id, pos, AVG(x) AS x FROM (SELECT group_id, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM p) GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY group_id ORDER BY x, pos) AS r, COUNT(*) OVER (PARTITION BY group_id) AS m FROM c)
SELECT group_id, ROUND(-SUM(x*LN(x))/LN(MAX(m)),6) AS incoming_entropy, ROUND(SUM(CASE WHEN r>m-4 THEN x ELSE 0 END),6) AS incoming_top, ROUND(2*SUM(r*x)/(MAX(m)*SUM(x))-(MAX(m)+1.0)/MAX(m),6) AS incoming_gini FROM r GROUP BY group_id""", "token")
def incoming_attention(b):
    """What positions receive, by matrix column: the tokens of a group are its queries."""
    return attention.incoming(_attention(b), "group_id", "p").withColumns({c: r6(F.col(c)) for c in ("incoming_entropy", "incoming_top", "incoming_gini")})


@query(ATTENTION + """, c AS (SELECT token_id, list_transform(p[2:], lambda x: x/list_sum(p[2:])) AS q FROM p)
SELECT token_id, ROUND(-list_sum(list_transform(q, lambda x: x*ln(x)))/ln(len(q)),6) AS entropy, ROUND(list_sum(list_reverse_sort(q)[1:4]),6) AS top4 FROM c""", "token")
def class_attention(b):
    """Each token's weights without the first position, renormalised."""
    q = _attention(b).select("token_id", attention.class_row(F.col("p"), 0).alias("q"))
    return q.select("token_id", r6(attention.entropy(F.col("q"))).alias("entropy"), r6(attention.top_mass(F.col("q"), 4)).alias("top4"))


# ---- near-duplicate sequences of digests


@query(""", t AS (SELECT group_id, token_id%10 AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM token), e AS (SELECT group_id*5+k AS id, pos, v, CAST(share AS DOUBLE) AS share FROM t, (VALUES (0,0),(1,0.05),(2,-0.05),(3,0.1),(4,-0.1)) AS x(k,share)),
d AS (SELECT id, pos, array_to_string(list_transform(range(1,65), lambda j: CASE WHEN v[j]+share*v[j%64+1]>0 THEN '1' ELSE '0' END),'') AS h FROM e), s AS (SELECT id, pos, b, substr(h,CAST(b*16+1 AS INT),16) AS sl FROM d, range(4) AS r(b)),
c AS (SELECT DISTINCT a.id, b.id AS other FROM s a JOIN s b ON a.pos=b.pos AND a.b=b.b AND a.sl=b.sl AND a.id<b.id),
m AS (SELECT c.id, other, x.pos FROM c JOIN d x ON x.id=c.id JOIN d y ON y.id=c.other AND y.pos=x.pos WHERE hamming(x.h,y.h)<=6),
i AS (SELECT id, other, COUNT(*) AS len FROM (SELECT *, pos-ROW_NUMBER() OVER (PARTITION BY id,other ORDER BY pos) AS gap FROM m) GROUP BY id, other, gap)
SELECT id, other, CAST(SUM(len) AS BIGINT) AS matches, MAX(len) AS longest FROM i GROUP BY 1, 2 HAVING SUM(len)>=4 AND MAX(len)>=3""", "token")
def near_dup_vectors(b):
    """Groups of ten vectors and four versions of each, a little of the next dimension mixed in, by the signs of 64 dimensions.

    Versions differ in none to over six bits of a digest, so the radius decides about matches.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    t = b.token.filter("embedding IS NOT NULL").select("group_id", (F.col("token_id") % 10).alias("pos"), x.alias("v"))
    share = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("share")) for k, s in enumerate((0.0, 0.05, -0.05, 0.1, -0.1))]))
    e = t.withColumn("x", share).select((F.col("group_id") * 5 + F.col("x.k")).alias("id"), "pos", "v", F.col("x.share").alias("share"))
    turned = F.concat(F.slice("v", 2, 63), F.slice("v", 1, 1))
    bits = F.array_join(F.zip_with(F.slice("v", 1, 64), turned, lambda a, c: F.when(a + F.col("share") * c > 0, "1").otherwise("0")), "")
    digest = F.concat(*[F.lpad(F.lower(F.conv(F.substring("bits", 16 * i + 1, 16), 2, 16)), 4, "0") for i in range(4)])
    return neardup.block_pairs(e.select("id", "pos", bits.alias("bits")).select("id", "pos", digest.alias("h")), "id", "pos", "h", width=4)


# ---- membership


@query("""WITH e AS (SELECT o_custkey, o_orderstatus FROM orders), a AS (SELECT CASE WHEN o_orderkey%9<>0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey%101=0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey%97<>0),
n AS (SELECT o_custkey, o_orderstatus, SUM(e) AS expected, SUM(1-e) AS actual FROM (SELECT *, 1 AS e FROM e UNION ALL SELECT *, 0 FROM a) GROUP BY 1, 2)
SELECT o_custkey, o_orderstatus, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, CASE WHEN actual=0 THEN 'missing' WHEN expected=0 THEN 'unexpected' ELSE 'repeated' END AS issue FROM n WHERE expected<>actual""")
def registry_diff(b):
    """Orders against a copy of them in which some customers are null, some states are others and some rows lack."""
    o = b.table("orders")
    k = F.col("o_orderkey")
    copy = o.filter(k % 97 != 0).select(F.when(k % 9 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(k % 101 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return audit.row_diff(o, copy, ["o_custkey", "o_orderstatus"])


@query("""WITH r AS (SELECT CASE WHEN o_orderkey%50=0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS key, CASE WHEN o_custkey%3=0 OR o_orderkey%40=0 THEN 'test' ELSE 'train' END AS tab, CASE WHEN o_orderkey%30=0 THEN NULL WHEN o_custkey%3=0 THEN 'test' ELSE 'train' END AS split FROM orders WHERE o_orderkey%4=0 OR o_custkey%2=0),
g AS (SELECT key, tab, COUNT(*) AS n, bool_or(split IS DISTINCT FROM tab) AS other FROM r GROUP BY 1, 2), t AS (SELECT key, COUNT(*) AS tabs FROM g WHERE key IS NOT NULL GROUP BY 1),
j AS (SELECT g.*, COALESCE(tabs,0) AS tabs FROM g LEFT JOIN t ON t.key=g.key)
SELECT key, tab AS "table", 'no id' AS reason FROM j WHERE key IS NULL UNION ALL SELECT key, tab, 'split' FROM j WHERE other UNION ALL SELECT key, tab, 'repeated' FROM j WHERE key IS NOT NULL AND n>1 UNION ALL SELECT key, tab, 'leakage' FROM j WHERE tabs>1""")
def manifest_pair_issues(b):
    """Orders as rows of a train and a test manifest of customers, some in both, some without an id or with another split."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = F.when(c % 3 == 0, "test").otherwise("train")
    rows = b.table("orders").filter((k % 4 == 0) | (c % 2 == 0)).select(F.when(k % 50 != 0, c.cast("string")).alias("video_id"), F.when(k % 30 != 0, own).alias("split"), ((c % 3 == 0) | (k % 40 == 0)).alias("test"))
    return audit.pair_issues(rows.filter("NOT test"), rows.filter("test"), "video_id", "split")


# ---- telemetry and nested metadata


@query("""WITH e AS (SELECT event_id, user_id, CAST(FLOOR(value) AS BIGINT) AS input, event_id%30 AS reused, value FROM events),
g AS (SELECT * FROM e WHERE event_id%13<>0 AND event_id%17<>0 AND event_id%19<>0 AND reused<=input AND value-20>=0)
SELECT CAST(user_id AS VARCHAR) AS video_id, mode, COUNT(*) AS steps, CAST(SUM(reused) AS BIGINT) AS reused_tokens, ROUND(AVG(CASE WHEN input>0 THEN reused/CAST(input AS DOUBLE) ELSE 0 END),9) AS reuse_ratio FROM (SELECT *, CASE WHEN event_id%2=0 THEN 'fixed' ELSE 'streaming' END AS mode FROM g) GROUP BY 1, 2""")
def cache_telemetry(b):
    """Events as telemetry rows, some of which are refused, written and read again; sums for each video and mode."""
    k = F.col("event_id")
    rows = b.table("events").select(
        F.lit("run").alias("run_id"), F.concat(F.lit("sha256:"), F.when(k % 13 == 0, "0").otherwise(F.sha2(F.lit("encoder"), 256))).alias("encoder_fingerprint"),
        F.when(k % 17 != 0, F.col("user_id").cast("string")).alias("video_id"), k.cast("string").alias("clip_id"), F.when(k % 2 == 0, "fixed").otherwise("streaming").alias("mode"),
        F.lit("kv").alias("cache_type"), (k % 30 > 0).alias("cache_hit"), F.floor("value").alias("input_tokens"), (k % 30).cast("long").alias("reused_tokens"), F.lit(1).cast("long").alias("output_tokens"),
        F.lit(0).cast("long").alias("cache_bytes"), (F.col("value") - 20).alias("encode_ms"), F.when(k % 19 == 0, '{"a": NaN}').otherwise(F.col("props")).alias("metadata"), F.lit("").alias("created_at"),
    )
    path = fresh_path(b.spark, "telemetry")
    records.write_telemetry(rows, path, "run")
    got = records.read_jsonl(b.spark, path, records.CACHE_TELEMETRY)
    return got.groupBy("video_id", "mode").agg(F.count("*").alias("steps"), F.sum("reused_tokens").alias("reused_tokens"), r9(F.avg("reuse_ratio")).alias("reuse_ratio"))


@query("""WITH c AS (SELECT conv_id, turn, to_json(list(text ORDER BY text))::VARCHAR AS texts, json_object('n', COUNT(*), 'turn', turn, 'none', NULL, 'empty', json_array(), 'deep', json_array(json_array(json_object('role', list(role ORDER BY role), '"quoted, [', 1.5e3)), 'x')) AS about FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY 1, 2),
j AS (SELECT conv_id, turn, '{"texts": ' || texts || ', "about": ' || about || '}' AS js FROM c), t AS (SELECT j.conv_id, j.turn, COUNT(*)-1+COUNT(*) FILTER (WHERE t.type NOT IN ('OBJECT','ARRAY')) AS items FROM j, json_tree(j.js) AS t GROUP BY 1, 2)
SELECT conv_id, turn, items, CASE WHEN conv_id%11=0 THEN 'invalid' WHEN conv_id%7=0 THEN 'not finite' WHEN items>21 THEN 'items' END AS issue FROM t""")
def metadata_limits(b):
    """Nested metadata with the texts of a turn; items at any depth, and what can't be kept with at most 21 of them."""
    rows = b.table("conversations").filter("text IS NOT NULL AND role IS NOT NULL").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("text")).alias("texts"), F.array_sort(F.collect_list("role")).alias("role"), F.count("*").alias("n"))
    deep = F.to_json(F.struct("role", F.lit(1500.0).alias('"quoted, [')))
    tail = F.concat(F.lit('"none": null, "empty": [ ], "deep": [['), deep, F.lit('], "x"]}}'))
    js = F.concat(F.lit('{"texts": '), F.to_json("texts"), F.lit(', "about": {"n": '), "n", F.lit(', "turn": '), "turn", F.lit(", "), tail)
    k = F.col("conv_id")
    broken = F.when(k % 11 == 0, F.concat(js, F.lit("}"))).when(k % 7 == 0, F.concat(F.lit('{"a": [1, -Infinity], "b": '), js, F.lit("}"))).otherwise(js)
    return rows.select("conv_id", "turn", text.metadata_items(js).cast("long").alias("items"), text.metadata_issue(broken, 21).alias("issue"))
