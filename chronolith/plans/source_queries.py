"""Queries of line formats, archives, indexes, shards, names and checks of windows."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import audit, intervals, sampling, sequences, stats, store
from chronolith.plans.queries import query
from chronolith.sources import records, texts
from chronolith.sources.paths import fresh_path
from chronolith.streaming import counts

# ---- line formats: the tables as lines, written and read back


@query("SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(frame_start*7 AS DOUBLE) AS start, CAST(frame_end*7 AS DOUBLE) AS \"end\", 'clip ' || clip_index || ' of ' || video_id AS caption FROM clip", "clip")
def caption_lines(b):
    clock = lambda c: F.concat(F.floor(F.col(c) * 7 / 60).cast("string"), F.lit(":"), (F.col(c) * 7 % 60).cast("string"))
    path = fresh_path(b.spark, "captions")
    line = F.concat_ws(" ", F.concat("video_id", F.lit(".mp4")), clock("frame_start"), clock("frame_end"), F.concat(F.lit("##clip "), "clip_index", F.lit(" of "), "video_id"))
    b.clip.select(line.alias("value")).write.text(path)
    return texts.captions(texts.lines(b.spark, path))


@query(""", s AS (SELECT v.video_id, v.weak_label, string_agg(CASE WHEN is_anomaly=1 THEN span_start || '-' || span_end END, ',' ORDER BY span_start) AS spans FROM video v LEFT JOIN annotation a ON a.video_id=v.video_id GROUP BY 1, 2)
SELECT lower('v' || video_id || '_label_' || CASE WHEN weak_label=1 AND MOD(video_id,5)<>0 THEN 'B1-0-0' ELSE 'A' END) AS video_id, COALESCE(spans,'') AS spans, CASE WHEN weak_label=1 AND MOD(video_id,5)=0 THEN 'label' END AS issue FROM s""", "annotation", "video")
def variable_span_lines(b):
    """Positive videos have their spans, others the pair -1 -1; a fifth of the positive ones have a name that contradicts them."""
    a = b.annotation.filter("is_anomaly = 1").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("s"))
    told = F.array_join(F.transform("s", lambda x: F.concat_ws(" ", x["span_start"].cast("string"), x["span_end"].cast("string"))), " ")
    label = F.when((F.col("weak_label") == 1) & (F.col("video_id") % 5 != 0), "B1-0-0").otherwise("A")
    rows = b.video.join(a, "video_id", "left").select(F.concat_ws(" ", F.concat(F.lit("v"), "video_id", F.lit("_label_"), label, F.lit(".mp4")), F.coalesce(told, F.lit("-1 -1"))).alias("value"))
    path = fresh_path(b.spark, "spans")
    rows.write.text(path)
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return texts.variable_spans(texts.lines(b.spark, path)).select("video_id", shown.alias("spans"), "issue")


FIELDS = ("A", "B1-0-0", "B2-G-0", "B1-B1", "0-B1", "B4-0-G", "B3", "G-B6-B5", "A-0")
FIELD_SQL = "list_extract([" + ", ".join(f"'{f}'" for f in FIELDS) + f"], CAST(MOD(o_orderkey, {len(FIELDS)}) AS INT)+1)"


@query(f"SELECT o_orderkey, CASE WHEN f IN ('A', 'B1-0-0', 'B2-G-0', 'G-B6-B5') THEN f END AS tokens FROM (SELECT o_orderkey, {FIELD_SQL} AS f FROM orders)")
def label_tokens(b):
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("o_orderkey") % len(FIELDS)).cast("int") + 1)
    path = F.concat(F.lit("set/v"), "o_orderkey", F.lit("__#1_label_"), field, F.lit(".mp4"))
    return b.table("orders").select("o_orderkey", F.array_join(texts.label_classes(path), "-").alias("tokens"))


def _archive(own: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for page, html in own.sort_values("page_id")[["page_id", "html"]].itertuples(index=False):
            z.writestr(f"{page}.html", html or "")
    return pd.DataFrame({"path": [f"{own['page_id'].iloc[0] // 16}.zip"], "content": [out.getvalue()]})


@query("SELECT (page_id//16) || '.zip' AS path, page_id || '.html' AS name, CAST(octet_length(encode(COALESCE(html,''))) AS BIGINT) AS size, TRUE AS crc_ok FROM pages")
def zip_members(b):
    """Archives of 16 pages each; names, sizes and checksums come from their central directories alone."""
    pages = b.table("pages").select("page_id", "html")
    archives = pages.groupBy(F.floor(F.col("page_id") / 16)).applyInPandas(_archive, "path string, content binary")
    sums = pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.crc32(F.coalesce("html", F.lit("")).cast("binary")).alias("want"))
    return texts.zip_members(archives).join(sums, "name").select("path", "name", "size", (F.col("crc") == F.col("want")).alias("crc_ok"))


# ---- indexes, appended tables, subsets and shards


@query("SELECT CAST(video_id AS VARCHAR) AS video_id, clip_index, frame_start, frame_end FROM clip WHERE MOD(clip_index,2)=1", "clip")
def feature_index_find(b):
    """The index as JSON lines in a folder for each fingerprint; a search by fingerprint reads that folder alone."""
    path = fresh_path(b.spark, "index")
    rows = b.clip.select(
        F.col("video_id").cast("string").alias("video_id"), F.concat_ws("-", "video_id", "clip_index").alias("clip_id"), "clip_index", "frame_start", "frame_end",
        F.lit("npz").alias("storage_format"), F.concat(F.lit("encoder"), F.col("clip_index") % 2).alias("encoder_fingerprint"),
    )
    rows.write.partitionBy("encoder_fingerprint").json(path)
    got = records.find_features(records.read_jsonl(b.spark, path, records.FEATURE_INDEX), fingerprint="encoder1")
    return got.select("video_id", "clip_index", "frame_start", "frame_end")


@query("SELECT video_id, clip_index, 'dense' AS run_id, score_c AS score FROM clip UNION ALL SELECT video_id, clip_index, 'kept', alt_c FROM clip", "clip")
def predictions_append(b):
    path = fresh_path(b.spark, "predictions")
    for run, score in (("dense", "score_c"), ("kept", "alt_c")):
        records.append_metrics(b.clip.select("video_id", "clip_index", F.lit(run).alias("run_id"), F.col(score).alias("score")), path)
    return b.spark.read.parquet(path)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey*2 FROM customer)
UNION ALL SELECT CAST(-1 AS BIGINT), k FROM (SELECT DISTINCT c_custkey*2 AS k FROM customer) WHERE k NOT IN (SELECT o_custkey FROM orders)""")
def run_subset(b):
    """Rows of the wanted keys, and a row with order -1 for each wanted key that has none."""
    kept, missing = store.subset(b.table("orders").select("o_orderkey", "o_custkey"), b.table("customer").select((F.col("c_custkey") * 2).alias("o_custkey")), "o_custkey")
    return kept.select("o_orderkey", "o_custkey").unionByName(missing.select(F.lit(-1).cast("long").alias("o_orderkey"), "o_custkey"))


@query(""", s AS (SELECT video_id, clip_index FROM clip WHERE MOD(video_id,2)=0 UNION ALL SELECT video_id, clip_index FROM clip WHERE MOD(video_id,2)=1 OR MOD(video_id,3)=0)
SELECT video_id, COUNT(*) AS n, CAST(SUM(CASE WHEN k>1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM (SELECT video_id, COUNT(*) OVER (PARTITION BY video_id, clip_index) AS k FROM s) GROUP BY 1""", "clip")
def shards_merge(b):
    """Two shards that share the sixth videos: rows of each video, and how many of them have a key of several places."""
    keys = b.clip.select("video_id", "clip_index")
    both, repeated = store.merge_shards([keys.filter("video_id % 2 = 0"), keys.filter("video_id % 2 = 1 OR video_id % 3 = 0")], ["video_id", "clip_index"])
    again = repeated.groupBy("video_id").agg(F.sum("n").alias("repeated"))
    return both.groupBy("video_id").agg(F.count("*").alias("n")).join(again, "video_id", "left").fillna(0, ["repeated"])


# ---- names, decisions, strides and checks of windows


@query("""SELECT page_id, CASE WHEN p LIKE '%/' THEN NULL WHEN MOD(page_id,5)=0 THEN p WHEN MOD(page_id,5)=1 THEN p || '/x' END AS path FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)""")
def relative_paths(b):
    """Paths with slashes of both kinds pass; absolute ones, drives, empty parts and '..' don't."""
    p = F.regexp_replace("url", "^[a-z]+://", "")
    kinds = F.array(p, F.concat(F.lit(" "), F.regexp_replace(p, "/", r"\\"), F.lit(r"\x ")), F.concat(F.lit("/"), p), F.concat(F.lit("C:"), p), F.concat(p, F.lit("/../x")))
    return b.table("pages").select("page_id", text.relative_path(F.element_at(kinds, (F.col("page_id") % 5).cast("int") + 1)).alias("path"))


DECIDE = """, c AS (SELECT video_id, clip_index, CASE WHEN MOD(video_id,11)<>0 THEN CAST(score_c-alt_c AS DOUBLE)/1000 END AS point, 10000-MOD(video_id,13) AS valid FROM clip),
d AS (SELECT video_id, clip_index, point, valid, point-0.004::DOUBLE AS lo, point+0.004::DOUBLE AS hi, point IS NOT NULL AND valid>=9990 AS ok FROM c),
e AS (SELECT *, CASE WHEN abs(lo+0.005::DOUBLE)<=8*pow(2.0::DOUBLE,-52) THEN -0.005::DOUBLE ELSE lo END AS l, CASE WHEN abs(hi+0.005::DOUBLE)<=8*pow(2.0::DOUBLE,-52) THEN -0.005::DOUBLE ELSE hi END AS h FROM d)
SELECT video_id, clip_index, l=-0.005::DOUBLE AS at_margin, CASE WHEN ok THEN 'available' ELSE 'NA' END AS status, CASE WHEN NOT ok THEN 'NA' WHEN l>=-0.005::DOUBLE THEN 'supported' WHEN h<-0.005::DOUBLE THEN 'inferior' ELSE 'inconclusive' END AS decision FROM e"""


@query(DECIDE, "clip")
def interval_decisions(b):
    point = F.when(F.col("video_id") % 11 != 0, (F.col("score_c") - F.col("alt_c")).cast("double") / 1000)
    rows = b.clip.select("video_id", "clip_index", point.alias("point"), (10000 - F.col("video_id") % 13).alias("valid"))
    rows = rows.withColumns({"lo": F.col("point") - 0.004, "hi": F.col("point") + 0.004})
    status, verdict = stats.decision(F.col("point"), F.col("lo"), F.col("hi"), F.col("valid"), 10_000)
    return rows.select("video_id", "clip_index", (text.snap_decision(F.col("lo")) == -0.005).alias("at_margin"), status.alias("status"), verdict.alias("decision"))


@query("SELECT video_id, GREATEST(1, CAST(round_even(CAST(num_frames AS DOUBLE)/4/3, 0) AS BIGINT)) AS stride FROM video", "video")
def stream_strides(b):
    return b.video.select("video_id", sequences.stream_stride(F.col("num_frames").cast("double") / 4, 3.0).alias("stride"))


@query(""", s AS (SELECT video_id, num_frames, CASE WHEN num_frames>=31 THEN 31 ELSE 16 END AS span FROM video),
r AS (SELECT video_id, span, unnest(generate_series(0, num_frames-span, 4)) AS start FROM s UNION ALL SELECT video_id, span, num_frames-span FROM s WHERE MOD(num_frames-span,4)<>0)
SELECT video_id, CAST(ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY start)-1 AS BIGINT) AS clip_index, start, start+span AS "end", MOD(start,4)<>0 AS end_anchored FROM r""", "video")
def dense_windows_stride1(b):
    return sampling.dense_windows(b.video, "video_id", "num_frames", 16, 2, 4, stride1_if_needed=True)


@query("SELECT video_id, num_frames, CAST(31 AS BIGINT) AS needed FROM video WHERE num_frames<31", "video")
def short_videos(b):
    return sampling.short_videos(b.video, "video_id", "num_frames", 16, 2)


@query(""", k AS (SELECT video_id, clip_index, frame_start, frame_end, MOD(video_id,6)=2 AND clip_index=0 AS nan_, MOD(video_id,6)=3 AND clip_index=0 AS rev FROM clip WHERE NOT (MOD(video_id,6)=1 AND clip_index=0)),
f AS (SELECT video_id, MAX(CASE WHEN nan_ THEN 1 ELSE 0 END) AS nf, MAX(CASE WHEN rev THEN 1 ELSE 0 END) AS bad FROM k GROUP BY 1)
SELECT * FROM (SELECT v.video_id, CASE WHEN f.video_id IS NULL THEN 'no intervals' WHEN nf=1 THEN 'not finite' WHEN bad=1 THEN 'invalid interval' WHEN MOD(v.video_id,6)=5 THEN 'invalid interval' WHEN MOD(v.video_id,6) IN (1,4) THEN 'uncovered' END AS reason FROM video v LEFT JOIN f ON f.video_id=v.video_id) WHERE reason IS NOT NULL""", "clip", "video")
def dense_issues(b):
    """Of the sixths of the videos one lacks its first clip, one has a score that isn't finite, one a reversed interval, and two a wrong length."""
    sixth, first = F.col("video_id") % 6, F.col("clip_index") == 0
    clips = b.clip.filter(~((sixth == 1) & first)).select(
        "video_id", "frame_start", F.when((sixth == 3) & first, F.col("frame_start") - 1).otherwise(F.col("frame_end")).alias("frame_end"),
        F.when((sixth == 2) & first, float("nan")).otherwise(F.col("score_c").cast("double")).alias("score"),
    )
    videos = b.video.select("video_id", (F.col("num_frames") + F.when(sixth == 4, 1).when(sixth == 5, -1).otherwise(0)).alias("frames"))
    return intervals.dense_issues(clips, "video_id", "frame_start", "frame_end", "score", videos, "frames")


# ---- arrays of records, samplings and the order of steps


def _saved(part: pd.Series) -> pd.Series:
    def npy(x) -> bytes:
        out = io.BytesIO()
        np.save(out, np.asarray(x, np.float32).reshape(2, -1))
        return out.getvalue()

    return part.map(npy)


@query("""SELECT CAST(vec_id AS VARCHAR) AS video_id, CASE WHEN MOD(vec_id,7)=0 THEN 'missing' WHEN MOD(vec_id,11)=0 THEN 'sha256' WHEN MOD(vec_id,13)=0 THEN 'shape' END AS issue,
CASE WHEN MOD(vec_id,7)<>0 AND MOD(vec_id,11)<>0 AND MOD(vec_id,13)<>0 THEN ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))),9) END AS total FROM embeddings""")
def feature_arrays(b):
    """Vectors as .npy contents, and an index that names them; some files lack, some records name another digest or shape."""
    saved = F.pandas_udf(_saved, "binary")
    v = b.table("embeddings").select("vec_id", F.concat("vec_id", F.lit(".npy")).alias("path"), F.size("embedding").alias("n"), saved("embedding").alias("content"))
    rows = F.when(F.col("vec_id") % 13 == 0, 3).otherwise(2)
    about = F.struct("path", F.array(rows, (F.col("n") / 2).cast("int")).alias("shape"), F.lit("float32").alias("dtype"), F.when(F.col("vec_id") % 11 == 0, F.sha2("content", 224)).otherwise(F.sha2("content", 256)).alias("sha256"), F.octet_length("content").cast("long").alias("nbytes"))
    index = v.select(F.col("vec_id").cast("string").alias("video_id"), F.lit("0").alias("clip_id"), F.create_map(F.lit("features"), about).alias("arrays"))
    got = records.load_arrays(index, v.filter("vec_id % 7 <> 0").select("path", "content"))
    return got.select("video_id", "issue", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


@query(""", c AS (SELECT 'all' AS run, * FROM clip UNION ALL SELECT 'again', * FROM clip UNION ALL SELECT 'even', * FROM clip WHERE MOD(clip_index,2)=0), n AS (SELECT run, COUNT(*) AS frames FROM c GROUP BY 1), k AS (SELECT COUNT(*) AS frames FROM clip)
SELECT run, n.frames, CASE WHEN run='even' THEN concat_ws(',', 'coordinates', CASE WHEN n.frames<>k.frames THEN 'frames' END) WHEN run='moved' THEN 'coordinates' ELSE '' END AS reasons, run='again' AS comparable
FROM (SELECT * FROM n UNION ALL SELECT 'moved', frames FROM k) n, k WHERE run<>'all'""", "clip")
def sampling_comparability(b):
    """Samplings held against that of all clips: the same again, only every other clip, and all of them moved by a frame."""
    own = lambda name, rows, by=0: rows.select(F.lit(name).alias("run"), "video_id", "clip_index", (F.col("frame_start") + by).alias("frame"))
    rows = own("all", b.clip).unionByName(own("again", b.clip)).unionByName(own("even", b.clip.filter("clip_index % 2 = 0"))).unionByName(own("moved", b.clip, 1))
    return audit.sampling_comparability(rows, "run", ["video_id", "clip_index", "frame"], "all")


@query("SELECT l_orderkey, l_linenumber, l_shipdate, highest_before FROM (SELECT *, MAX(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM lineitem) WHERE l_shipdate<=highest_before")
def stream_order_issues(b):
    """Steps of an order, arriving by their line, whose date isn't above those before."""
    arrival = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return counts.out_of_order(b.table("lineitem").select("l_orderkey", *arrival), "l_orderkey", arrival, "l_shipdate").drop("l_partkey", "l_suppkey")
