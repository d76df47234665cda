"""Queries over videos as sequences, coordinate hypotheses and attention statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import attention, audit, intervals, losses, metrics, sampling, selection, sequences, vectors
from chronolith.plans.queries import NORMS, _norms, query, r6, r9


@query(""", i AS (SELECT * FROM clip WHERE MOD(video_id,6)<>0 AND NOT (MOD(video_id,7)=0 AND clip_index=1)), g AS (SELECT video_id, COUNT(*) AS n, MIN(clip_index) AS lo, MAX(clip_index) AS hi, string_agg(CAST(score_c AS VARCHAR), ',' ORDER BY clip_index) AS sequence FROM i GROUP BY 1)
SELECT v.video_id, weak_label, n, sequence, CASE WHEN n IS NULL THEN 'missing features' WHEN lo<>0 OR hi<>n-1 THEN 'indexes not contiguous' END AS reason FROM video v LEFT JOIN g ON g.video_id=v.video_id""".replace("n, sequence, CASE", "CASE WHEN lo=0 AND hi=n-1 THEN n END AS n, CASE WHEN lo=0 AND hi=n-1 THEN sequence END AS sequence, CASE"), "clip", "video")
def feature_sequence_dataset(b):
    index = b.clip.filter("video_id % 6 <> 0 AND NOT (video_id % 7 = 0 AND clip_index = 1)")
    manifest = b.video.select("video_id", "weak_label")
    good, bad = sequences.feature_sequences(manifest, index, "video_id", "clip_index", "score_c")
    good = good.select("video_id", "weak_label", "n", F.array_join(F.transform("sequence", lambda x: x.cast("string")), ",").alias("sequence"), F.lit(None).cast("string").alias("reason"))
    bad = bad.join(manifest, "video_id").select("video_id", "weak_label", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("sequence"), "reason")
    return good.unionByName(bad)


@query(""", lb AS (SELECT video_id, unnest(generate_series(frame_start, frame_end-1)) AS frame, label FROM tile),
pt AS (SELECT video_id, frame, MAX(score_c) AS score FROM (SELECT video_id, unnest(generate_series(frame_start, frame_end-1)) AS frame, score_c FROM clip) GROUP BY 1, 2),
g AS (SELECT score, SUM(label) p, SUM(1-label) n FROM lb JOIN pt USING (video_id, frame) GROUP BY score),
c AS (SELECT p, n, COALESCE(SUM(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) nb, SUM(p) OVER w tp, SUM(n) OVER w fp, SUM(p) OVER () total FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT ROUND(SUM(p*(2*nb+n))/(2.0*SUM(p)*SUM(n)),9) AS auc, ROUND(SUM(p/total*(tp/(tp+fp))),9) AS step_ap, CAST(SUM(p+n) AS BIGINT) AS frames, CAST(SUM(p) AS BIGINT) AS positive_frames, (SELECT COUNT(DISTINCT video_id) FROM lb) AS videos FROM c""", "clip", "tile")
def evaluate_predictions(b):
    labels = b.tile.select("video_id", "frame_start", "frame_end", "label")
    r = sequences.evaluate_predictions(b.clip, labels, "video_id", "frame_start", "frame_end", "score_c", "clip_index", label_span=("frame_start", "frame_end"))
    return r.select(r9("auc").alias("auc"), r9("step_ap").alias("step_ap"), "frames", "positive_frames", "videos")


@query("""SELECT o_orderkey, COALESCE(n,0) AS captions, first FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, MIN(l_linenumber) AS first FROM lineitem WHERE l_quantity>40 GROUP BY 1) ON l_orderkey=o_orderkey""")
def attach_captions(b):
    captions = b.table("lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    videos, _ = sequences.attach_captions(b.table("orders").select("o_orderkey"), captions, "o_orderkey", ["l_linenumber", "l_quantity"])
    return videos.select("o_orderkey", F.coalesce(F.size("captions"), F.lit(0)).cast("long").alias("captions"), F.get("captions", F.lit(0))["l_linenumber"].alias("first"))


@query(""", h AS (SELECT i*2+j AS candidate, i-1 AS shift, j AS inc FROM (SELECT unnest(generate_series(0,2)) AS i), (SELECT unnest(generate_series(0,1)) AS j)),
t AS (SELECT DISTINCT video_id, unnest(generate_series(span_start, span_end-1)) AS f FROM annotation WHERE is_anomaly=1),
m AS (SELECT DISTINCT candidate, video_id, unnest(generate_series(GREATEST(0, span_start+shift), span_end+shift+inc-1)) AS f FROM annotation, h WHERE is_anomaly=1),
d AS (SELECT COALESCE(m.candidate, x.candidate) AS candidate, COALESCE(m.video_id, x.video_id) AS video_id, CASE WHEN m.f IS NULL OR x.f IS NULL THEN 1 ELSE 0 END AS wrong FROM m FULL JOIN (SELECT t.*, candidate FROM t, h) x ON m.candidate=x.candidate AND m.video_id=x.video_id AND m.f=x.f),
v AS (SELECT candidate, video_id, SUM(wrong) AS wrong FROM d GROUP BY 1, 2)
SELECT candidate, CAST(SUM(wrong) AS BIGINT) AS wrong_frames, COUNT(*) FILTER (wrong=0) AS exact_videos, COUNT(*) AS videos FROM v GROUP BY candidate""", "annotation")
def coordinate_hypotheses(b):
    spans = b.annotation.filter("is_anomaly = 1")
    c = sequences.candidate_spans(spans, "video_id", "span_start", "span_end", [-1, 0, 1], [False, True])
    return sequences.compare_candidates(c, spans.select("video_id", F.col("span_start").alias("lo"), F.col("span_end").alias("hi")), "video_id", list(range(6)))


@query("""SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus='F') AS f, COUNT(*) FILTER (o_orderstatus='O') AS o, COUNT(*) FILTER (o_orderstatus='P') AS p FROM orders GROUP BY 1""")
def quality_cube(b):
    facts = b.table("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    table, _ = sequences.cube(facts, ["o_orderpriority"], "n", "o_orderstatus", ["F", "O", "P"])
    return table.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query(""", n AS (SELECT video_id, COUNT(*) AS n FROM clip GROUP BY 1), p AS (SELECT video_id, CAST(bin AS INT) AS bin, bin*n//5 AS a, (bin+1)*n//5 AS z FROM n, (SELECT unnest(generate_series(0,4)) AS bin))
SELECT p.video_id, bin, ROUND(AVG(score_c),9) AS mean FROM p JOIN clip c ON c.video_id=p.video_id AND c.clip_index>=a AND c.clip_index<=GREATEST(a, z-1) GROUP BY 1, 2""", "clip")
def temporal_bins(b):
    return sequences.temporal_bins(b.clip, "video_id", "clip_index", "score_c", 5).withColumn("mean", r9("mean"))


@query("""SELECT video_id, COALESCE(CASE WHEN MOD(video_id,4)<>0 THEN num_frames END, num_frames) AS num_frames, COALESCE(CASE WHEN MOD(video_id,5)=0 THEN 12.0 END, 10.0) AS fps FROM video""", "video")
def enrich_video_info(b):
    videos = b.video.select("video_id", F.when(F.col("video_id") % 4 != 0, F.col("num_frames")).alias("num_frames"), F.when(F.col("video_id") % 5 == 0, 12.0).alias("fps"))
    out, _ = sequences.enrich(videos, b.video.select("video_id", "num_frames", F.lit(10.0).alias("fps")), "video_id")
    return out


@query("""SELECT a.video_id, CAST(COALESCE(SUM(CASE WHEN LEAST(span_end, num_frames-12)>span_start THEN LEAST(span_end, num_frames-12)-span_start END),0) AS BIGINT) AS frames, COUNT(*) FILTER (LEAST(span_end, num_frames-12)>span_start AND num_frames-12<span_end) AS clamped, COUNT(*) FILTER (LEAST(span_end, num_frames-12)<=span_start) AS dropped FROM annotation a JOIN video v ON v.video_id=a.video_id GROUP BY 1""", "annotation", "video")
def reconcile_spans(b):
    r = sequences.reconcile(b.annotation, b.video.select("video_id", (F.col("num_frames") - 12).alias("decoded")), "video_id", "span_start", "span_end", "decoded")
    return r.select("video_id", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("frames"), "clamped", "dropped")


@query("""SELECT event_id, CASE WHEN ok THEN a ELSE 0 END AS frame_start, CASE WHEN ok THEN z ELSE 200 END AS frame_end FROM (SELECT *, a<z AS ok FROM (SELECT event_id, CAST(FLOOR(v*25.0) AS BIGINT) AS a, LEAST(200, CAST(FLOOR((v+2)*25.0) AS BIGINT)) AS z FROM (SELECT event_id, FLOOR(value) AS v FROM events)))""")
def time_to_frame_range(b):
    a, z = sequences.seconds_to_frames(F.floor("value").cast("double"), F.floor("value").cast("double") + 2, F.lit(0.0), F.lit(200).cast("long"))
    return b.table("events").select("event_id", a.alias("frame_start"), z.alias("frame_end"))


@query("""SELECT s.video_id, s.clip_index, s.y FROM (SELECT *, MAX(clip_index//3) OVER (PARTITION BY video_id)+1 AS places, COUNT(*) FILTER (clip_index<3) OVER (PARTITION BY video_id) AS times, clip_index//3 AS place FROM clip) s
WHERE places<=GREATEST(1, 6//times) OR place=0 OR place*GREATEST(1, 6//times)//places<>(place-1)*GREATEST(1, 6//times)//places""", "clip")
def spatiotemporal_sample(b):
    rows = b.clip.withColumns({"place": F.floor(F.col("clip_index") / 3), "time": F.col("clip_index") % 3}).withColumnRenamed("place", "track")
    return sequences.tracks_within(rows, "video_id", ["track"], "time", 6).select("video_id", "clip_index", "y")


@query("""SELECT video_id, weak_label FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY weak_label ORDER BY video_id) AS rn FROM video) WHERE rn<=20""", "video")
def balanced_fit_sources(b):
    return selection.balanced_take(b.video, "video_id", "weak_label", 40)


@query(""", g AS (SELECT weak_label, video_id//7 AS grp, COUNT(*) AS n, MIN(video_id) AS f FROM video GROUP BY 1, 2),
o AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY weak_label ORDER BY f, grp) AS i FROM g),
r AS (SELECT DISTINCT weak_label, CAST(0 AS BIGINT) AS i, CAST(200 AS BIGINT) AS room, CAST(-1 AS BIGINT) AS grp, FALSE AS took FROM o
UNION ALL SELECT o.weak_label, o.i, CASE WHEN o.n<=r.room THEN r.room-o.n ELSE r.room END, o.grp, o.n<=r.room FROM r JOIN o ON o.weak_label=r.weak_label AND o.i=r.i+1 WHERE r.room>0)
SELECT v.video_id, v.weak_label, r.grp FROM video v JOIN r ON r.took AND r.weak_label=v.weak_label AND r.grp=v.video_id//7""", "video", recursive=True)
def capped_group_take(b):
    rows = b.video.select("video_id", "weak_label", F.floor(F.col("video_id") / 7).alias("grp"))
    return sequences.capped_take(rows, "weak_label", "grp", "video_id", 200)


@query(""", e AS (SELECT video_id, clip_index, EXP((score_c-MAX(score_c) OVER (PARTITION BY video_id))/2.0) AS e, alt_c FROM clip), p AS (SELECT *, e/SUM(e) OVER (PARTITION BY video_id) AS p FROM e)
SELECT video_id, ROUND(SUM(p*alt_c),9) AS pooled, ROUND(MAX(p),9) AS top, ROUND(CASE WHEN COUNT(*)>1 THEN -SUM(p*LN(p))/LN(COUNT(*)) ELSE 0 END,9) AS entropy FROM p GROUP BY video_id""", "clip")
def attention_pooling(b):
    return attention.bag_attention(b.clip, "video_id", "clip_index", "score_c", "alt_c", 2.0).withColumns({c: r9(c) for c in ("pooled", "top", "entropy")})


@query("""SELECT a.video_id, a.clip_index, ROUND(SUM(EXP(-ABS(a.clip_index-b.clip_index)/EXP(1.0))*b.score_c)/SUM(EXP(-ABS(a.clip_index-b.clip_index)/EXP(1.0))),9) AS smoothed FROM clip a JOIN clip b ON a.video_id=b.video_id GROUP BY 1, 2""", "clip")
def temporal_prior(b):
    return attention.distance_kernel(b.clip, "video_id", "clip_index", "score_c").withColumn("smoothed", r9("smoothed"))


@query(""", e AS (SELECT token_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM token), f AS (SELECT token_id, list_transform(v, lambda x: exp(x-list_max(v))) AS e FROM e), p AS (SELECT token_id, list_transform(e, lambda x: x/list_sum(e)) AS p FROM f)
SELECT token_id, ROUND(-list_sum(list_transform(p, lambda x: x*ln(x)))/ln(64),6) AS entropy, ROUND(list_sum(list_reverse_sort(p)[1:4]),6) AS top4 FROM p""", "token")
def attention_entropy(b):
    p = b.token.select("token_id", attention.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    return p.select("token_id", r6(attention.entropy(F.col("p"))).alias("entropy"), r6(attention.top_mass(F.col("p"), 4)).alias("top4"))


@query(NORMS + "SELECT group_id, quantile_cont(CAST(score AS DOUBLE),0.5) AS median, ROUND(quantile_cont(CAST(score AS DOUBLE),0.75)-quantile_cont(CAST(score AS DOUBLE),0.25),3) AS iqr, ROUND(quantile_cont(CAST(score AS DOUBLE),0.95)/quantile_cont(CAST(score AS DOUBLE),0.5),6) AS p95_to_p50 FROM nm GROUP BY group_id", "token")
def norm_statistics(b):
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    return _norms(b).groupBy("group_id").agg(q.alias("q")).select("group_id", F.col("q")[1].alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 3).alias("iqr"), r6(F.col("q")[3] / F.col("q")[1]).alias("p95_to_p50"))


@query(""", k AS (SELECT video_id, MAX(clips*8) AS t FROM video GROUP BY 1), g AS (SELECT dense_c, SUM(label*16) p, SUM((1-label)*16) n FROM tile JOIN k USING (video_id) WHERE frame_start<t GROUP BY 1),
d AS (SELECT *, SUM(p) OVER w tp, SUM(n) OVER w fp, SUM(p) OVER () total FROM g WINDOW w AS (ORDER BY dense_c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), e AS (SELECT *, COALESCE(LAG(tp/(tp+fp)) OVER (ORDER BY dense_c DESC), 1.0) AS before FROM d)
SELECT ROUND(SUM(p/total*((tp/(tp+fp))+before)/2),9) AS pr_area FROM e""", "tile", "video")
def feature_grid_pr(b):
    return metrics.precision_recall(b.tile, "dense_c", "label", weight=F.lit(16)).select(r9("pr_trapezoid").alias("pr_area"))


@query("""SELECT url, NULLIF(lower(trim(regexp_replace(regexp_replace(list_last(string_split(url, '/')), '(?i)\\.(mp4|avi|mkv|mov|webm|npy|npz|txt|fc6-1)$', ''), '(?i)(__\\d+|_c)$', ''))), '') AS canonical, 'source:unknown' AS grp FROM pages""")
def canonical_names(b):
    return b.table("pages").select("url", text.canonical_id(F.col("url")).alias("canonical"), text.source_group(F.col("url")).alias("grp"))


@query("""SELECT video_id, MIN(lo) AS lo, MAX(hi) AS hi FROM (SELECT *, SUM(fresh) OVER (PARTITION BY video_id ORDER BY lo, hi) AS run FROM (SELECT video_id, span_start AS lo, span_end AS hi, CASE WHEN span_start<=MAX(span_end) OVER (PARTITION BY video_id ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM annotation)) GROUP BY video_id, run""", "annotation")
def merged_spans(b):
    return intervals.longest_cover(b.annotation, "video_id", "span_start", "span_end")


@query("""SELECT t.video_id, p.frame, frame_start, label FROM tile t JOIN (SELECT video_id, MOD(video_id*7, num_frames) AS frame FROM video) p ON p.video_id=t.video_id AND frame_start<=frame AND frame<frame_end""", "tile", "video")
def stab_points(b):
    points = b.video.select("video_id", (F.col("video_id") * 7 % F.col("num_frames")).alias("frame"))
    return intervals.stab(b.tile, points, "video_id", "frame_start", "frame_end", "frame").select("video_id", "frame", "frame_start", "label")


@query("""SELECT video_id, string_agg(CAST(CAST(k AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS positions FROM (SELECT DISTINCT video_id, round_even(i*(num_frames-1)/8.0, 0) AS k FROM video, (SELECT unnest(generate_series(0,8)) AS i)) GROUP BY 1""", "video")
def rounded_positions(b):
    return b.video.select("video_id", F.array_join(F.transform(sampling.rounded_positions(F.col("num_frames"), 9), lambda x: x.cast("string")), ",").alias("positions"))


@query(""", e AS (SELECT pair_id, token_id, embedding, LEAD(embedding) OVER (PARTITION BY pair_id ORDER BY token_id) AS other FROM token)
SELECT pair_id, ROUND(list_sum(list_transform(list_zip(embedding, other), lambda z: pow(CAST(z[1] AS DOUBLE)-CAST(z[2] AS DOUBLE),2)))/list_sum(list_transform(other, lambda x: CAST(x AS DOUBLE)*CAST(x AS DOUBLE))),6) AS relative, ROUND(list_max(list_transform(list_zip(embedding, other), lambda z: abs(CAST(z[1] AS DOUBLE)-CAST(z[2] AS DOUBLE)))),6) AS largest FROM e WHERE other IS NOT NULL""", "token")
def pooled_comparison(b):
    from pyspark.sql.window import Window as W

    e = b.token.withColumn("other", F.lead("embedding").over(W.partitionBy("pair_id").orderBy("token_id"))).filter("other IS NOT NULL")
    return e.select("pair_id", r6(vectors.relative_error("embedding", "other")).alias("relative"), r6(vectors.max_abs_error("embedding", "other")).alias("largest"))


CATS = "['Abuse','Arrest','Arson','Assault','Burglary','Explosion','Fighting','RoadAccidents','Robbery','Shooting','Shoplifting','Stealing','Vandalism','Normal']"


@query(f"""WITH c AS (SELECT p_partkey, list_extract({CATS}, CAST(p_partkey % 14 AS INTEGER)+1) AS cat, p_name FROM part),
v AS (SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN upper(cat)||' '||'_' WHEN p_partkey%3=1 THEN 'un'||cat ELSE cat END AS folder, cat||'0'||p_partkey||'_x264.mp4' AS base FROM c),
n AS (SELECT *, lower(replace(replace(trim(folder),' ',''),'_','')) AS bare FROM v)
SELECT p_partkey, CASE WHEN bare LIKE '%normal%' THEN 'Normal' ELSE list_extract(list_filter({CATS}, lambda x: lower(x)=bare),1) END AS category,
 CASE WHEN bare LIKE '%normal%' OR lower(base) LIKE '%normal%' THEN 'Normal' ELSE COALESCE(list_extract(list_filter({CATS}, lambda x: lower(x)=bare),1), list_extract(list_filter({CATS}, lambda x: starts_with(lower(base), lower(x))),1)) END AS inferred FROM n""")
def categories(b):
    cat = F.element_at(F.array(*map(F.lit, text.CATEGORIES)), (F.col("p_partkey") % 14 + 1).cast("int"))
    folder = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper(cat), F.lit(" _"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("un"), cat)).otherwise(cat)
    path = F.concat(folder, F.lit("/"), cat, F.lit("0"), F.col("p_partkey").cast("string"), F.lit("_x264.mp4"))
    return b.table("part").select("p_partkey", text.category(folder).alias("category"), text.inferred_category(path).alias("inferred"))


@query(""", f AS (SELECT video_id, num_frames, 24.0+MOD(video_id,7) AS fps FROM video), s AS (SELECT *, GREATEST(1, CAST(ROUND_EVEN(fps/8.0, 0) AS BIGINT)) AS stride FROM f)
SELECT video_id, stride, CASE WHEN stride*3<num_frames THEN concat_ws(',', 0, stride, stride*2, stride*3) END AS frames FROM s""", "video")
def fps_sample_indices(b):
    return sampling.fps_indices(b.video.select("video_id", "num_frames", (24.0 + F.col("video_id") % 7).alias("fps")), "num_frames", "fps", 8.0, 4).select("video_id", "stride", F.array_join("frames", ",").alias("frames"))


@query("""SELECT video_id, clip_index, CASE WHEN seg_start IS NOT NULL AND seg_end IS NOT NULL AND seg_start>=0 AND seg_start<seg_end THEN seg_start ELSE frame_start END AS lo,
 CASE WHEN seg_start IS NOT NULL AND seg_end IS NOT NULL AND seg_start>=0 AND seg_start<seg_end THEN seg_end ELSE frame_end END AS hi
 FROM (SELECT *, CASE WHEN MOD(clip_index,3)>0 THEN frame_start-4 END AS seg_start, CASE WHEN MOD(clip_index,2)=0 THEN frame_end+4 ELSE 0 END AS seg_end FROM clip)""", "clip")
def clip_frame_interval(b):
    rows = b.clip.withColumns({"seg_start": F.when(F.col("clip_index") % 3 > 0, F.col("frame_start") - 4), "seg_end": F.when(F.col("clip_index") % 2 == 0, F.col("frame_end") + 4).otherwise(0)})
    lo, hi = intervals.clip_interval("seg_start", "seg_end", "frame_start", "frame_end")
    return rows.select("video_id", "clip_index", lo.alias("lo"), hi.alias("hi"))


@query("""SELECT label, ROUND(100.0*(AVG(method_c)-AVG(dense_c)),6) AS points FROM tile GROUP BY label""", "tile")
def percentage_points(b):
    return b.tile.groupBy("label").agg(r6(sampling.percentage_points(F.avg("dense_c"), F.avg("method_c"))).alias("points"))


@query("""SELECT l_linenumber AS epoch, COUNT(*) AS batches, CAST(SUM(l_quantity) AS DOUBLE) AS samples, ROUND(SUM(l_discount*l_quantity)/SUM(l_quantity),6) AS loss FROM lineitem GROUP BY l_linenumber""")
def epoch_accumulation(b):
    return losses.accumulate_epochs(b.table("lineitem"), "l_linenumber", "l_discount", "l_quantity").select(F.col("l_linenumber").alias("epoch"), "batches", F.col("samples").cast("double").alias("samples"), r6("loss").alias("loss"))


@query("""SELECT video_id||':'||clip_index AS clip_id, CAST(video_id AS VARCHAR) AS video_id, CASE MOD(video_id,5) WHEN 0 THEN 'test' ELSE 'train' END AS partition, CAST(CASE WHEN MOD(video_id,11)>0 THEN y END AS BIGINT) AS weak_label, CAST(NULL AS VARCHAR) AS temporal_label,
 'weak' AS label_source, 'scene'||MOD(video_id,7) AS scene_group, CASE WHEN score_c<3 THEN 'low' WHEN score_c<7 THEN 'mid' ELSE 'high' END AS motion_bin, CASE WHEN y=1 THEN 'Abuse' ELSE 'Normal' END AS category_for_analysis_only, alt_c>6 AS pseudo_positive FROM clip""", "clip")
def label_sidecar(b):
    """Each clip's labels; of the two rows that some clips have, the later one counts."""
    v, y = F.col("video_id"), F.col("y")
    rows = b.clip.select(
        F.concat(v.cast("string"), F.lit(":"), F.col("clip_index").cast("string")).alias("clip_id"), v.cast("string").alias("video_id"), F.when(v % 5 == 0, "test").otherwise("train").alias("partition"), F.when(v % 11 > 0, y).cast("long").alias("weak_label"),
        F.lit("weak").alias("label_source"), F.concat(F.lit("scene"), (v % 7).cast("string")).alias("scene_group"), F.when(F.col("score_c") < 3, "low").when(F.col("score_c") < 7, "mid").otherwise("high").alias("motion_bin"),
        F.when(y == 1, "Abuse").otherwise("Normal").alias("category_for_analysis_only"), (F.col("alt_c") > 6).alias("pseudo_positive"), F.lit(1).alias("version"),
    )
    older = rows.filter("weak_label = 1").withColumns({"version": F.lit(0), "scene_group": F.lit("old")})
    return audit.label_sidecar(rows.unionByName(older), "clip_id", "version")


@query("""SELECT video_id, list(struct_pack(lo:=lo, hi:=hi, label:=label) ORDER BY lo) AS runs, CAST(SUM(hi-lo) AS BIGINT) AS frames FROM (
 SELECT video_id, MIN(frame_start) AS lo, MAX(frame_end) AS hi, MAX(label) AS label FROM (
  SELECT *, SUM(fresh) OVER (PARTITION BY video_id ORDER BY frame_start) AS run FROM (
   SELECT *, CASE WHEN label=LAG(label) OVER (PARTITION BY video_id ORDER BY frame_start) THEN 0 ELSE 1 END AS fresh FROM tile)) GROUP BY video_id, run) GROUP BY video_id""".replace("list(struct_pack(lo:=lo, hi:=hi, label:=label) ORDER BY lo)", "string_agg(lo||'-'||hi||':'||label, ',' ORDER BY lo)"), "tile")
def sealed_truth(b):
    return intervals.truth_runs(b.tile, "video_id", "frame_start", "frame_end", "label")
