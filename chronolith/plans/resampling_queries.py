"""Queries of resampled statistics; the SQL makes the same draws from the same hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import metrics, resampling
from chronolith.plans.queries import TWO_LEVEL, _videos, query, r6, r9


def mixed(x: str) -> str:
    """SQL of the 32-bit hash of ``x``, step by step, so that ``x`` is named once."""
    step = "list_transform({}, lambda x: xor(x, x >> 16) * 73244475 % 4294967296)"
    return f"list_transform({step.format(step.format(f'[{x}]'))}, lambda x: xor(x, x >> 16))[1]"


def picks(cells: str, draws: int, name: str = "picks") -> str:
    """SQL: cell, n, draw and the item that each slot of each draw takes; ``cells``: cell, n."""
    word = lambda k: f"CAST('0x' || substr(md5(cell), {k}, 8) AS BIGINT)"
    return f"""{name}_w AS (SELECT cell, n, draw, {mixed(f"({word(1)} + draw) % 4294967296")} AS one, {mixed(f"({word(9)} + draw) % 4294967296")} AS two FROM {cells}, (SELECT unnest(range({draws})) AS draw)),
{name}_0 AS (SELECT cell, n, draw, two, (one + unnest(range(n))) % 4294967296 AS x FROM {name}_w),
{name}_1 AS (SELECT cell, n, draw, two, xor(x, x >> 16) * 73244475 % 4294967296 AS x FROM {name}_0),
{name}_2 AS (SELECT cell, n, draw, two, xor(x, x >> 16) * 73244475 % 4294967296 AS x FROM {name}_1),
{name}_3 AS (SELECT cell, n, draw, (xor(x, x >> 16) + two) % 4294967296 AS x FROM {name}_2),
{name}_4 AS (SELECT cell, n, draw, xor(x, x >> 16) * 73244475 % 4294967296 AS x FROM {name}_3),
{name}_5 AS (SELECT cell, n, draw, xor(x, x >> 16) * 73244475 % 4294967296 AS x FROM {name}_4),
{name} AS (SELECT cell, n, draw, (xor(x, x >> 16) * n) >> 32 AS idx FROM {name}_5)"""


ORDER = "CAST('0x' || substr(md5(CAST(video_id AS VARCHAR)), 1, 8) AS BIGINT), video_id"
SEED = 20260918


def hedges_sql(rows: str, by: str, draws: int) -> str:
    """SQL of ``hedges_contrast`` for rows (by columns, video_id, x, weak_label) where every draw has variance; ends in ``hedges``."""
    cell = " || '|' || ".join(["'20260918|hedges'", *[f"CAST({c} AS VARCHAR)" for c in by.split(", ")], "CAST(weak_label AS VARCHAR)"])
    return f"""pt AS (SELECT {by}, COUNT(*) FILTER (weak_label=1) n_pos, COUNT(*) FILTER (weak_label=0) n_neg, AVG(x) FILTER (weak_label=1) mp, AVG(x) FILTER (weak_label=0) mn, VAR_SAMP(x) FILTER (weak_label=1) v1, VAR_SAMP(x) FILTER (weak_label=0) v0, AVG(x) centre FROM {rows} GROUP BY {by}),
gp AS (SELECT *, CASE WHEN n_pos>=2 AND n_neg>=2 AND (n_pos-1)*v1+(n_neg-1)*v0>0 THEN (1-3/(4.0*(n_pos+n_neg)-9))*(mp-mn)/SQRT(((n_pos-1)*v1+(n_neg-1)*v0)/(n_pos+n_neg-2)) END AS g FROM pt),
hi AS (SELECT {by}, weak_label, {cell} AS cell, x - centre AS x, ROW_NUMBER() OVER (PARTITION BY {by}, weak_label ORDER BY {ORDER}) - 1 AS idx FROM {rows} JOIN gp USING ({by}) WHERE g IS NOT NULL),
hc AS (SELECT {by}, weak_label, cell, COUNT(*) AS n FROM hi GROUP BY {by}, weak_label, cell),
{picks("hc", draws, "hp")},
hs AS (SELECT hi.{by.replace(", ", ", hi.")}, draw, SUM(x) FILTER (weak_label=1) a1, SUM(x*x) FILTER (weak_label=1) b1, SUM(x) FILTER (weak_label=0) a0, SUM(x*x) FILTER (weak_label=0) b0, MAX(n) FILTER (weak_label=1) n1, MAX(n) FILTER (weak_label=0) n0
 FROM hp JOIN hi USING (cell, idx) GROUP BY hi.{by.replace(", ", ", hi.")}, draw),
hd AS (SELECT {by}, draw, CASE WHEN (b1-a1*a1/n1)+(b0-a0*a0/n0) > 1e-12*(b1+b0) THEN (1-3/(4.0*(n1+n0)-9))*(a1/n1-a0/n0)/SQRT(((b1-a1*a1/n1)+(b0-a0*a0/n0))/(n1+n0-2)) END AS g FROM hs),
hq AS (SELECT {by}, quantile_cont(g, 0.025) lo, quantile_cont(g, 0.975) hi, COUNT(g) AS valid_draws, COUNT(*) AS attempts FROM hd GROUP BY {by}),
hedges AS (SELECT {by}, n_pos, n_neg, ROUND(g,6) AS effect, ROUND(mp-mn,6) AS mean_difference, ROUND(lo,6) AS ci_low, ROUND(hi,6) AS ci_high, COALESCE(valid_draws,0) AS valid_draws, COALESCE(attempts,0) AS attempts,
 CASE WHEN g IS NULL THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN n_pos<2 OR n_neg<2 THEN 'too_few' WHEN g IS NULL THEN 'no_variance' END AS reason FROM gp LEFT JOIN hq USING ({by}))"""


MATCHED = f"""ms AS (SELECT site, motion, COUNT(*) FILTER (weak_label=1) p, COUNT(*) FILTER (weak_label=0) n0, AVG(x) FILTER (weak_label=1)-AVG(x) FILTER (weak_label=0) d, AVG(x) centre FROM mv GROUP BY site, motion),
mw AS (SELECT *, p>0 AND n0>0 AND motion<>'unknown' AS whole, CASE WHEN p>0 AND n0>0 AND motion<>'unknown' THEN LEAST(p,n0) ELSE 0 END AS mass FROM ms),
mt AS (SELECT site, SUM(mass) mass, SUM(mass*d)/SUM(mass) effect, COUNT(*) FILTER (whole) matched_groups, COALESCE(SUM(p) FILTER (whole),0) rp, COALESCE(SUM(n0) FILTER (whole),0) rn,
 COALESCE(SUM(p+n0) FILTER (motion='unknown'),0) unknown, COALESCE(SUM(p+n0) FILTER (motion<>'unknown' AND NOT whole),0) one_sided FROM mw GROUP BY site),
mi AS (SELECT mv.site, weak_label, '{SEED}|matched|' || mv.site || '|' || motion || '|' || weak_label AS cell, x-centre AS x, CASE WHEN weak_label=1 THEN mass ELSE -mass END AS signed,
 ROW_NUMBER() OVER (PARTITION BY mv.site, motion, weak_label ORDER BY {ORDER}) - 1 AS idx FROM mv JOIN mw USING (site, motion) WHERE whole),
mc AS (SELECT cell, COUNT(*) AS n FROM mi GROUP BY cell),
{picks("mc", 2000, "mp")},
md AS (SELECT site, draw, SUM(signed*x/n) AS moved FROM mp JOIN mi USING (cell, idx) GROUP BY site, draw),
mq AS (SELECT site, quantile_cont(moved,0.025) lo, quantile_cont(moved,0.975) hi, COUNT(*) AS draws FROM md GROUP BY site),
matched AS (SELECT site, ROUND(effect,6) AS effect, ROUND(lo/mass,6) AS ci_low, ROUND(hi/mass,6) AS ci_high, draws AS valid_draws, CAST(mass AS BIGINT) AS weight_mass, matched_groups, CAST(rp AS BIGINT) AS retained_positive, CAST(rn AS BIGINT) AS retained_normal,
 CAST(unknown AS BIGINT) AS excluded_unknown, CAST(one_sided AS BIGINT) AS excluded_one_sided, 'available' AS status, CAST(NULL AS VARCHAR) AS reason FROM mt JOIN mq USING (site))"""
MOTION = TWO_LEVEL + ", mv AS (SELECT site, video_id, video_mean AS x, weak_label, CASE WHEN MOD(clips, 7) = 6 THEN 'unknown' ELSE CAST(MOD(clips, 7) AS VARCHAR) END AS motion FROM v),\n"


def _motion(b):
    bins = F.when(F.col("clips") % 7 == 6, "unknown").otherwise((F.col("clips") % 7).cast("string"))
    return _videos(b).select("site", "video_id", F.col("video_mean").alias("x"), "weak_label", bins.alias("motion"))


@query(MOTION + MATCHED + " SELECT * FROM matched", "probe")
def matched_contrast_ci(b):
    got = resampling.matched_contrast(_motion(b), ["site"], ["motion"], "video_id", "x", "weak_label")
    return got.withColumns({c: r6(c) for c in ("effect", "ci_low", "ci_high")})


@query(TWO_LEVEL + ", hv AS (SELECT site, video_id, video_mean AS x, weak_label FROM v),\n" + hedges_sql("hv", "site", 2000) + " SELECT * FROM hedges", "probe")
def hedges_bootstrap_ci(b):
    rows = _videos(b).select("site", "video_id", F.col("video_mean").alias("x"), "weak_label")
    return resampling.hedges_contrast(rows, ["site"], "video_id", "x", "weak_label").withColumns({c: r6(c) for c in ("effect", "mean_difference", "ci_low", "ci_high")})


@query(MOTION + f"""cp AS (SELECT site, video_id, x, weak_label, unnest(['all', 'category:' || MOD(video_id, 3)]) AS stratum FROM mv WHERE weak_label = 1),
cw AS (SELECT DISTINCT site, stratum FROM cp UNION SELECT DISTINCT site, 'all' FROM mv),
cv AS (SELECT site, video_id, x, weak_label, stratum FROM cp UNION ALL SELECT site, video_id, x, weak_label, stratum FROM mv JOIN cw USING (site) WHERE weak_label = 0),
{hedges_sql("cv", "site, stratum", 2000)},
{MATCHED},
cg AS (SELECT site, stratum, x, SUM(weak_label) p, SUM(1-weak_label) n FROM cv GROUP BY site, stratum, x),
cc AS (SELECT site, stratum, p, n, SUM(p) OVER w pb, SUM(n) OVER w nb, SUM(p) OVER (PARTITION BY site, stratum) pt, SUM(n) OVER (PARTITION BY site, stratum) nt FROM cg WINDOW w AS (PARTITION BY site, stratum ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
co AS (SELECT site, stratum, ROUND(1-MAX(ABS(pb/NULLIF(pt,0)-nb/NULLIF(nt,0))),6) AS overlap, ROUND(SUM(p*(2*nb-n))/NULLIF(2.0*MAX(pt)*MAX(nt),0),6) AS common_language FROM cc GROUP BY site, stratum)
SELECT CASE WHEN stratum='all' THEN 'weak_video' ELSE 'category_stratum' END AS contrast, site, stratum, effect, mean_difference, ci_low, ci_high, n_pos, n_neg, CASE WHEN status='available' THEN overlap END AS overlap,
 CASE WHEN status='available' THEN common_language END AS common_language, valid_draws, attempts, status, reason FROM hedges LEFT JOIN co USING (site, stratum)
UNION ALL SELECT 'matched_control', site, 'motion', effect, effect, ci_low, ci_high, retained_positive, retained_normal, NULL, NULL, valid_draws, valid_draws, status, reason FROM matched""", "probe")
def contrast_report(b):
    rows = _motion(b).withColumn("category", (F.col("video_id") % 3).cast("string"))
    got = resampling.contrast_report(rows, ["site"], "category", ["motion"], "video_id", "x", "weak_label")
    return got.withColumns({c: r6(c) for c in ("effect", "mean_difference", "ci_low", "ci_high", "overlap", "common_language")})


# scores are whole hundredths up to 10: the frames of a video at each are columns, so that each pick meets one row
AT = [(system, score, x) for system in (0, 1) for score in range(11) for x in "pn"]
PIVOT = ", ".join(f"SUM(CASE WHEN system={a} AND score={b} THEN ph.{x} ELSE 0 END) AS {x}{a}_{b}" for a, b, x in AT)
SUMS = ", ".join(f"SUM({x}{a}_{b}) AS {x}{a}_{b}" for a, b, x in AT)
TALL = " UNION ALL ".join(f"SELECT draw, {a} AS system, {b} AS score, p{a}_{b} AS p, n{a}_{b} AS n FROM pj" for a, b, x in AT if x == "p")


@query(f""", ph AS (SELECT video_id, 0 AS system, dense_c AS score, SUM((frame_end-frame_start)*label) AS p, SUM((frame_end-frame_start)*(1-label)) AS n FROM tile GROUP BY video_id, dense_c
 UNION ALL SELECT video_id, 1, method_c, SUM((frame_end-frame_start)*label), SUM((frame_end-frame_start)*(1-label)) FROM tile GROUP BY video_id, method_c),
pi AS (SELECT video_id, '{SEED}|paired|' || weak_label AS cell, ROW_NUMBER() OVER (PARTITION BY weak_label ORDER BY {ORDER}) - 1 AS idx FROM video),
pc AS (SELECT cell, COUNT(*) AS n FROM pi GROUP BY cell),
{picks("pc", 10_000, "pp")},
pk AS (SELECT pi.cell, pi.idx, {PIVOT} FROM pi JOIN ph USING (video_id) GROUP BY pi.cell, pi.idx),
pj AS (SELECT draw, {SUMS} FROM pp JOIN pk USING (cell, idx) GROUP BY draw UNION ALL SELECT -1, {SUMS} FROM pk),
ps AS ({TALL}),
pu AS (SELECT draw, system, p, SUM(p) OVER w AS tp, SUM(n) OVER w AS fp, n, SUM(p) OVER (PARTITION BY draw, system) AS pt, SUM(n) OVER (PARTITION BY draw, system) AS nt, score FROM ps
 WINDOW w AS (PARTITION BY draw, system ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pv AS (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 1 END AS pr, CASE WHEN tp-p+fp-n>0 THEN (tp-p)/(tp-p+fp-n) ELSE 1 END AS last FROM pu),
pm AS (SELECT draw, system, SUM(p*(nt-fp+n/2))/(MAX(pt)*MAX(nt)) AS roc, SUM(p*(pr+last)/2)/MAX(pt) AS area, SUM(p*pr)/MAX(pt) AS ap FROM pv GROUP BY draw, system),
pd AS (SELECT draw, SUM(CASE system WHEN 1 THEN roc ELSE -roc END) AS roc, SUM(CASE system WHEN 1 THEN area ELSE -area END) AS area, SUM(CASE system WHEN 1 THEN ap ELSE -ap END) AS ap FROM pm GROUP BY draw),
pt AS (SELECT draw, unnest(['frame_roc_auc', 'frame_pr_auc', 'frame_ap']) AS metric, unnest([roc, area, ap]) AS delta FROM pd),
pq AS (SELECT metric, MAX(delta) FILTER (draw<0) AS point, quantile_cont(delta, 0.025) FILTER (draw>=0) AS lo, quantile_cont(delta, 0.975) FILTER (draw>=0) AS hi, COUNT(delta) FILTER (draw>=0) AS v FROM pt GROUP BY metric)
SELECT metric, ROUND(point,9) AS point, ROUND(lo,9) AS lower, ROUND(hi,9) AS upper, CAST(v AS INTEGER) AS valid_draws, 'available' AS status, CASE WHEN lo>=-0.005 THEN 'supported' WHEN hi<-0.005 THEN 'inferior' ELSE 'inconclusive' END AS decision FROM pq""", "tile", "video")
def paired_bootstrap_ci(b):
    t = b.tile
    both = [metrics.histogram(t, c, "label", "frame_start", "frame_end", ("video_id",)).withColumnRenamed(c, "score").withColumn("system", F.lit(i)) for i, c in enumerate(("dense_c", "method_c"))]
    got = resampling.paired_bootstrap(both[0].unionByName(both[1]), b.video.select("video_id", "weak_label"), "video_id", "weak_label")
    return got.withColumns({c: r9(c) for c in ("point", "lower", "upper")})
