"""Resampling with replacement inside cells, by counters instead of a generator's state.

A cell of n items (say, the videos of a label in a stratum) is drawn anew by n slots; slot k of draw d takes an item by
a hash of (seed, cell, d, k). So any task, and SQL, can make any draw without the others. A cell of more than ``each`` items is cut in slices: its
slots are dealt to halves of the slices by binomials, down to a slice, which then draws as many of its own items as it got. That is the
same multinomial, each task follows its own halves, and it holds the weights of one slice (or of small cells one after the other) for ``AT_ONCE`` numbers at most.

Items are numbered within their cell in the order of a hash of their key, in hash ranges numbered apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.operators import metrics
from chronolith.operators.stats import decision
from chronolith.sources.paths import kept_table

#: Items of a slice, and weights that a task holds at a time.
SLICE, AT_ONCE = 65_536, 1 << 20
M = 1 << 32


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(73244475)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(73244475)
    return x ^ (x >> np.uint32(16))


def words(text: str) -> tuple[int, int]:
    """Two 32-bit numbers for a cell's or slice's text."""
    import hashlib

    h = hashlib.md5(text.encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16)


def numbers(cell: tuple[int, int], draws: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """32-bit random numbers of draws (rows) and slots (columns) of a cell."""
    one, two = (mix(np.uint32(w) + draws.astype(np.uint32))[:, None] for w in cell)
    return mix(mix(one + slots.astype(np.uint32)[None, :]) + two)


def weights(cell: str, draws: np.ndarray, n: int, counts: np.ndarray | None = None) -> np.ndarray:
    """How often each draw (row) has each of n items, if it takes ``counts`` of them (n by default)."""
    own = words(cell)
    if counts is None:
        picks = (numbers(own, draws, np.arange(n)).astype(np.uint64) * np.uint64(n)) >> np.uint64(32)
        at = picks.astype(np.int64) + np.arange(len(draws))[:, None] * n
        return np.bincount(at.ravel(), minlength=len(draws) * n).reshape(len(draws), n)
    return np.stack([np.bincount(((numbers(own, draws[i : i + 1], np.arange(c))[0].astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.int64), minlength=n) for i, c in enumerate(counts.tolist())])


def halves(cell: str, draws: np.ndarray, n: int, slots: int, each: int, only: int | None = None) -> dict[int, np.ndarray]:
    """Slice: how many of the slots each draw deals to it, for all slices of a cell of n items or the one asked for.

    A half of some slices gets a binomial of what they all get, from a generator of its own, so every task that follows it
    sees the same numbers. Numbers are made for all draws up to the last, in order, and don't depend on which are asked for.
    """
    out, todo = {}, [(0, -(-n // each), np.full(int(draws.max()) + 1 if len(draws) else 0, slots, np.int64))]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[lo] = counts[draws]
            continue
        mid = (lo + hi) // 2
        one, two = words(f"{cell}|split|{lo}|{hi}")
        left = np.random.Generator(np.random.Philox(key=one << 32 | two)).binomial(counts, (mid - lo) * each / (min(hi * each, n) - lo * each))
        todo += [half for half in ((lo, mid, left), (mid, hi, counts - left)) if only is None or half[0] <= only < half[1]]
    return out


def dealt(cell: str, draws: np.ndarray, n: int, slots: np.ndarray, each: int) -> np.ndarray:
    """How many of the slots each draw (row) deals to each slice of a cell of n items."""
    got = halves(cell, draws, n, len(slots), each)
    return np.stack([got[i] for i in range(-(-n // each))], 1)


def order_hash(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, cell: str, key: str, each: int = SLICE) -> DataFrame:
    """``df`` with ``idx`` (0, 1, ... within the cell, by a hash of the key, then the key) and ``n``, the size of the cell.

    Hash ranges are numbered apart, so no task orders more of a cell than about ``each`` rows (besides rows of equal keys).
    """
    ranges = max(1, -(-df.count() // each))
    rows = df.withColumn("__h", order_hash(key)).withColumn("__s", F.floor(F.col("__h") * ranges / M).cast("int"))
    of_cell = W.partitionBy(cell)  # a row for each hash range
    sizes = rows.groupBy(cell, "__s").count().select(
        cell, "__s", F.coalesce(F.sum("count").over(of_cell.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("count").over(of_cell).alias("n")
    )
    at = F.row_number().over(W.partitionBy(cell, "__s").orderBy("__h", key))
    out = rows.withColumn("__r", at).join(sizes, [cell, "__s"])
    return out.withColumn("idx", F.col("__before") + F.col("__r") - 1).drop("__h", "__s", "__r", "__before")


def draws_of(part: pd.DataFrame, draws: tuple[int, int], chunk: int, chunks: int, each: int, block: int | None = None) -> Iterator[tuple[str, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Cell, items, their places, draws, and weights (draws by places) for the cells or the slice in ``part`` (cell, idx, n), some (or ``block``) draws at a time."""
    for (cell, slice_), own in part.groupby(["cell", "slice"], sort=True):
        n = int(own["n"].iloc[0])
        size = min(n, (slice_ + 1) * each) - slice_ * each
        text, at = (cell, own["idx"].to_numpy()) if n <= each else (f"{cell}|{slice_}", own["idx"].to_numpy() - slice_ * each)
        mine = np.arange(draws[0] + chunk, draws[1], chunks)
        counts = halves(cell, mine, n, n, each, int(slice_))[int(slice_)] if n > each else None
        step = block or max(1, AT_ONCE // size)
        for k in range(0, len(mine), step):
            d = mine[k : k + step]
            yield cell, own, at, d, weights(text, d, size, None if counts is None else counts[k : k + step]).astype(np.float64)


def sliced(items: DataFrame, draws: tuple[int, int], each: int) -> tuple[DataFrame, int]:
    """Items dealt to groups (small cells together, slices of large cells apart) and chunks of draws; chunks.

    Rows are only multiplied by chunks if there are too few groups to keep a cluster busy.
    """
    total = items.count()
    buckets = max(1, min(4096, total // 4096))
    rows = items.withColumn("slice", F.floor(F.col("idx") / each).cast("long"))
    group = F.when(F.col("n") > each, F.concat_ws("|", F.col("cell"), F.col("slice"))).otherwise(F.pmod(F.xxhash64("cell"), F.lit(buckets)).cast("string"))
    rows = rows.withColumn("group", group)
    groups = max(1, rows.select("group").distinct().count())
    chunks = max(1, min(16, -(-64 // groups), total * (draws[1] - draws[0]) // 20_000_000))
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))), chunks


def resampled_sums(items: DataFrame, draws: tuple[int, int], each: int = SLICE) -> DataFrame:
    """cell, n, draw, s1, s2: sums of x and of its square over the items that each draw takes of each cell.

    ``items``: cell (string, which also seeds its draws), idx and n as ``numbered`` gives them, x (double).
    """
    rows, chunks = sliced(items.select("cell", "idx", "n", "x"), draws, each)

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"cell": [], "n": [], "draw": [], "s1": [], "s2": []})]
        for cell, own, at, d, w in draws_of(part, draws, int(key[1]), chunks, each):
            x = np.zeros(w.shape[1])
            x[at] = own["x"].to_numpy()
            out.append(pd.DataFrame({"cell": cell, "n": own["n"].iloc[0], "draw": d, "s1": w @ x, "s2": w @ (x * x)}))
        return pd.concat(out)

    sums = rows.groupBy("group", "chunk").applyInPandas(lambda k, part: add(k, part), "cell string, n long, draw long, s1 double, s2 double")
    return sums.groupBy("cell", "n", "draw").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


# ---- contrasts


def _cell(seed: int, kind: str, *columns: Column | str) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(kind), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in columns])


def _ends(value: Column) -> list[Column]:
    return [F.percentile(value, F.lit(q)) for q in (0.025, 0.975)]


def matched_contrast(videos: DataFrame, by: list[str], strata: list[str], key: str, value: str, label: str, draws: int = 2000, seed: int = 20260918, each: int = SLICE) -> DataFrame:
    """The mean difference of the labels within strata, weighted by the smaller label, with bounds of 95 % (a row for each ``by``).

    Draws are made among the videos of each stratum and label; the weights stay. Videos with an unknown (null or
    'unknown') stratum and strata with one label are left out and counted. status is 'available', or 'unavailable' with a reason: 'too_few'
    (fewer than two videos of a label stay) or 'degenerate' (no draw differs from another; the effect is given).
    """
    unknown = F.array_compact(F.array(*[F.when(F.col(s).isNull() | (F.col(s).cast("string") == "unknown"), F.lit(s)) for s in strata]))
    rows = videos.filter(F.col(value).isNotNull() & F.col(label).isin(0, 1)).withColumn("__unknown", F.size(unknown) > 0)
    c = lambda f, y: f(F.when(F.col(label) == y, F.col(value)))
    groups = rows.groupBy(*by, *strata, "__unknown").agg(c(F.count, 1).alias("p"), c(F.count, 0).alias("n0"), (c(F.avg, 1) - c(F.avg, 0)).alias("d"), F.count("*").alias("videos"), F.avg(value).alias("centre"))
    whole = ~F.col("__unknown") & (F.col("p") > 0) & (F.col("n0") > 0)
    mass = F.when(whole, F.least("p", "n0")).otherwise(0)
    count = lambda cond, x="videos": F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0)).cast("long")
    totals = groups.groupBy(*by).agg(
        F.sum(mass).alias("weight_mass"), (F.sum(mass * F.col("d")) / F.sum(mass)).alias("effect"), F.count(F.when(whole, 1)).alias("matched_groups"), count(whole, "p").alias("retained_positive"),
        count(whole, "n0").alias("retained_normal"), count(F.col("__unknown")).alias("excluded_unknown"), count(~F.col("__unknown") & ~whole).alias("excluded_one_sided"),
    )
    # each stratum's values are taken from its mean, which cancels in the difference and keeps the digits
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in [*by, *strata]]
    kept = rows.filter(~F.col("__unknown")).alias("a").join(groups.filter(whole).alias("b"), same).select(*[F.col(f"a.{x}") for x in [*by, *strata, key, label]], F.col(f"a.{value}").cast("double").alias("x"), "b.p", "b.n0", "b.centre")
    kept = kept.withColumns({"cell": _cell(seed, "matched", *by, *strata, label), "x": F.col("x") - F.col("centre")})
    cells = kept.groupBy(*by, "cell").agg((F.max(F.least("p", "n0")) * F.max(F.when(F.col(label) == 1, 1).otherwise(-1))).alias("signed"))
    sums = resampled_sums(kept_table(numbered(kept.select("cell", key, "x"), "cell", key, each)), (0, draws), each)
    per_draw = sums.join(cells, "cell").groupBy(*by, "draw").agg(F.sum(F.col("signed") * F.col("s1") / F.col("n")).alias("moved"))
    low, high = _ends(F.col("moved"))
    spread = per_draw.groupBy(*by).agg(low.alias("lo"), high.alias("hi"), (F.max("moved") - F.min("moved")).alias("range"), F.count("*").alias("draws"), F.max(F.abs("moved")).alias("top"))
    out = totals.alias("t").join(spread.alias("s"), [F.col(f"t.{x}").eqNullSafe(F.col(f"s.{x}")) for x in by], "left")
    few = (F.col("retained_positive") < 2) | (F.col("retained_normal") < 2)
    flat = F.col("range") <= 1e-12 * F.greatest(F.col("top"), F.lit(1e-300))
    reason = F.when(few, "too_few").when(flat, "degenerate")
    fine = reason.isNull()
    return out.select(
        *[F.col(f"t.{x}") for x in by], F.when(~few, F.col("effect")).alias("effect"), F.when(fine, F.col("lo") / F.col("weight_mass")).alias("ci_low"), F.when(fine, F.col("hi") / F.col("weight_mass")).alias("ci_high"),
        F.when(few, 0).otherwise(F.col("draws")).cast("long").alias("valid_draws"), F.col("weight_mass").cast("long").alias("weight_mass"), F.col("matched_groups").cast("long").alias("matched_groups"),
        "retained_positive", "retained_normal", "excluded_unknown", "excluded_one_sided", F.when(fine, "available").otherwise("unavailable").alias("status"), reason.alias("reason"),
    )


def hedges_contrast(rows: DataFrame, by: list[str], key: str, value: str, label: str, draws: int = 2000, seed: int = 20260918, most: int = 20, each: int = SLICE) -> DataFrame:
    """Hedges' g of the labels with bounds of 95 % over draws of each label's videos (a row for each ``by``).

    Draws without variance are drawn again: the first ``draws`` draws with variance count, among ``most`` times as many at
    most; ``attempts`` says how many it took. reason: 'too_few' (fewer than two videos of a label), 'no_variance', 'degenerate'.
    """
    rows = rows.filter(F.col(value).isNotNull() & F.col(label).isin(0, 1)).withColumn("__x", F.col(value).cast("double"))
    c = lambda f, y: f(F.when(F.col(label) == y, F.col("__x")))
    point = rows.groupBy(*by).agg(
        c(F.count, 1).alias("n_pos"), c(F.count, 0).alias("n_neg"), c(F.avg, 1).alias("mean_pos"), c(F.avg, 0).alias("mean_neg"), c(F.var_samp, 1).alias("v1"), c(F.var_samp, 0).alias("v0"), F.avg("__x").alias("centre")
    )
    few = (F.col("n_pos") < 2) | (F.col("n_neg") < 2)
    n = F.col("n_pos") + F.col("n_neg")
    pooled = ((F.col("n_pos") - 1) * F.col("v1") + (F.col("n_neg") - 1) * F.col("v0")) / (n - 2)
    shrink = 1 - 3 / (4.0 * n - 9)
    point = point.withColumn("g", F.when(~few & (pooled > 0), shrink * (F.col("mean_pos") - F.col("mean_neg")) / F.sqrt(pooled)))
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in by]
    kept = rows.alias("a").join(point.filter("g IS NOT NULL").alias("b"), same).select(*[F.col(f"a.{x}") for x in [*by, key, label]], (F.col("a.__x") - F.col("b.centre")).alias("x"))
    kept = kept_table(numbered(kept.withColumn("cell", _cell(seed, "hedges", *by, label)), "cell", key, each))
    cells = kept.groupBy(*by, label, "cell").agg(F.lit(1).alias("one")).drop("one")
    tried, done = 0, None
    todo = kept
    for end in (draws, 4 * draws, most * draws):
        if end <= tried:
            continue
        sums = resampled_sums(todo, (tried, end), each).join(cells, "cell")
        d = lambda y, x: F.sum(F.when(F.col(label) == y, F.col(x)))
        two = sums.groupBy(*by, "draw").agg(d(1, "s1").alias("a1"), d(1, "s2").alias("b1"), d(0, "s1").alias("a0"), d(0, "s2").alias("b0"), d(1, "n").alias("n1"), d(0, "n").alias("n0"))
        inner = (F.col("b1") - F.col("a1") ** 2 / F.col("n1")) + (F.col("b0") - F.col("a0") ** 2 / F.col("n0"))
        m = F.col("n1") + F.col("n0")
        g = F.when(inner > 1e-12 * (F.col("b1") + F.col("b0")), (1 - 3 / (4.0 * m - 9)) * (F.col("a1") / F.col("n1") - F.col("a0") / F.col("n0")) / F.sqrt(inner / (m - 2)))
        part = two.select(*by, "draw", g.alias("drawn"))
        part = kept_table(part)  # both the next round and the result read it
        done, tried = part if done is None else done.unionByName(part), end
        short = done.groupBy(*by).agg(F.count("drawn").alias("got")).filter(F.col("got") < draws)
        if short.isEmpty():
            break
        todo = kept.alias("a").join(short.alias("b"), same, "left_semi")
    order = W.partitionBy(*by).orderBy("draw").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = done.withColumn("__k", F.count("drawn").over(order)).filter((F.col("__k") < draws) | ((F.col("__k") == draws) & F.col("drawn").isNotNull()))
    low, high = _ends(F.col("drawn"))
    spread = first.groupBy(*by).agg(low.alias("lo"), high.alias("hi"), F.count("drawn").alias("valid"), F.count("*").alias("attempts"))
    out = point.alias("a").join(spread.alias("b"), same, "left")
    reason = F.when(few, "too_few").when(F.col("g").isNull(), "no_variance").when(F.coalesce("valid", F.lit(0)) == 0, "degenerate")
    fine = reason.isNull()
    return out.select(
        *[F.col(f"a.{x}") for x in by], "n_pos", "n_neg", F.when(fine, F.col("g")).alias("effect"), (F.col("mean_pos") - F.col("mean_neg")).alias("mean_difference"), F.when(fine, F.col("lo")).alias("ci_low"), F.when(fine, F.col("hi")).alias("ci_high"),
        F.coalesce("valid", F.lit(0)).cast("long").alias("valid_draws"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.when(fine, "available").otherwise("unavailable").alias("status"), reason.alias("reason"),
    )


def contrast_report(videos: DataFrame, by: list[str], category: str, strata: list[str], key: str, value: str, label: str, draws: int = 2000, seed: int = 20260918) -> DataFrame:
    """All contrasts of each ``by`` in one table: positives against normals, the positives of each category against all normals, and matched.

    contrast, ``by``, stratum, effect, mean_difference, ci_low, ci_high, n_pos, n_neg, overlap, common_language, valid_draws, attempts,
    status, reason. Each (``by``, stratum) has draws of its own, which depend on nothing else.
    """
    rows = videos.filter(F.col(value).isNotNull() & F.col(label).isin(0, 1))
    named = F.coalesce(F.col(category).cast("string"), F.lit("unknown"))
    positive = rows.filter(F.col(label) == 1).withColumn("stratum", F.explode(F.array(F.lit("all"), F.concat(F.lit("category:"), named))))
    # normals meet every stratum of their ``by``: a row for each category, not for each positive
    which = positive.groupBy(*by, "stratum").agg(F.lit(1).alias("one")).unionByName(rows.groupBy(*by).agg(F.lit("all").alias("stratum"), F.lit(1).alias("one"))).distinct().drop("one")
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in by]
    normal = rows.filter(F.col(label) == 0).alias("a").join(which.alias("b"), same).select("a.*", "b.stratum")
    both = positive.unionByName(normal)
    keys = [*by, "stratum"]
    point = hedges_contrast(both, keys, key, value, label, draws, seed)
    overlap = metrics.ks_overlap(both, value, label, tuple(keys))
    language = metrics.roc_auc(both, value, label, tuple(keys)).select(*keys, "auc")
    on = lambda a, b: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in keys]
    weak = point.alias("p").join(overlap.alias("o"), on("p", "o"), "left").join(language.alias("l"), on("p", "l"), "left")
    fine = F.col("p.status") == "available"
    weak = weak.select(
        F.when(F.col("p.stratum") == "all", "weak_video").otherwise("category_stratum").alias("contrast"), *[F.col(f"p.{x}") for x in keys], "p.effect", "p.mean_difference", "p.ci_low", "p.ci_high", "p.n_pos", "p.n_neg",
        F.when(fine, F.col("o.overlap")).alias("overlap"), F.when(fine, F.col("l.auc")).alias("common_language"), "p.valid_draws", "p.attempts", "p.status", "p.reason",
    )
    null = F.lit(None).cast("double")
    matched = matched_contrast(videos, by, strata, key, value, label, draws, seed).select(
        F.lit("matched_control").alias("contrast"), *by, F.lit(" x ".join(strata)).alias("stratum"), "effect", F.col("effect").alias("mean_difference"), "ci_low", "ci_high", F.col("retained_positive").alias("n_pos"),
        F.col("retained_normal").alias("n_neg"), null.alias("overlap"), null.alias("common_language"), "valid_draws", F.col("valid_draws").alias("attempts"), "status", "reason",
    )
    return weak.unionByName(matched)


# ---- paired quality

#: Draws that share a row of sums, and videos of a slice.
BLOCK, VIDEOS = 64, 16_384
#: Numbers that a task makes of frames at a time.
WIDE = 1 << 22


def paired_bootstrap(hist: DataFrame, videos: DataFrame, key: str, label: str, draws: int = 10_000, seed: int = 20260918, each: int = 100_000, slice_: int = VIDEOS) -> DataFrame:
    """Paired bootstrap over videos, in strata by weak label, of the differences of ROC AUC, PR area and step AP.

    ``hist``: key, system (0 or 1), score, pos_frames, neg_frames. A slice of a stratum adds up the weighted frames of its
    videos by draw and score; those sums are dealt to score ranges of about ``each`` rows. What lies above a range in each draw
    follows from the sums of the ranges, and with that the range gives its part of the three curves. A row per metric: metric,
    point, lower, upper, valid_draws, status, decision; bounds of 95 % with invalid draws at the worst end. The sums that are
    shuffled grow with the distinct scores of a slice times the draws.
    """
    cell = numbered(videos.select(key, _cell(seed, "paired", label).alias("cell")), "cell", key, slice_)
    rows = kept_table(hist.join(cell, key).select("cell", "idx", "n", "system", F.col("score").cast("double").alias("score"), "pos_frames", "neg_frames"), "frames")
    parts = max(1, -(-rows.count() // each))
    cuts = rows.agg(F.percentile_approx("score", [(i + 1) / parts for i in range(parts - 1)] or [0.5], 10_000)).first()[0] if parts > 1 else []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<double>")
    rows = rows.withColumn("part", F.size(F.filter(cuts, lambda c: c < F.col("score"))))
    rows, chunks = sliced(rows, (0, draws), slice_)

    def add(key_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["system", "part", "score"], kind="stable")
        out, at_block = [], {}
        for c, own, at, _, w in draws_of(part, (0, draws), int(key_[1]), chunks, slice_, BLOCK):
            slice_no = (c, int(own["slice"].iloc[0]))
            if slice_no not in at_block:  # the frames of each video at each score, in columns
                names = own[["system", "part", "score"]].to_numpy()
                first = np.concatenate([[True], (names[1:] != names[:-1]).any(1)])
                at_block[slice_no] = [0, names[first], np.cumsum(first) - 1, {}]
            k, names, column, made = at_block[slice_no]
            at_block[slice_no][0] += 1
            # few scores: products with the videos' frames in columns; many: each row's weight, summed by score; some at a time
            dense = len(names) * w.shape[1] <= 16 * len(own)
            wide = max(1, WIDE // (w.shape[1] if dense else BLOCK))
            edges = np.searchsorted(column, np.arange(len(names) + 1))
            lo = 0
            while lo < len(names):
                hi = min(lo + wide, len(names)) if dense else max(lo + 1, int(np.searchsorted(edges, edges[lo] + wide, "right")) - 1)
                mine = slice(edges[lo], edges[hi])
                frames = [own[x].to_numpy(np.float64)[mine] for x in ("pos_frames", "neg_frames")]
                if dense:
                    if lo not in made:  # of one product only, so that a task holds ``WIDE`` numbers
                        made.clear()
                        made[lo] = np.concatenate([np.bincount(at[mine] * (hi - lo) + column[mine] - lo, x, w.shape[1] * (hi - lo)).reshape(-1, hi - lo) for x in frames], 1)
                    p, n = np.split((w @ made[lo]).T, 2)
                else:
                    p, n = (np.add.reduceat(w[:, at[mine]] * x, edges[lo:hi] - edges[lo], 1).T for x in frames)
                out += [(int(a), int(b), float(s), int(key_[1]) + chunks * k, x.tobytes(), y.tobytes()) for (a, b, s), x, y in zip(names[lo:hi], p, n)]
                lo = hi
        return pd.DataFrame(out, columns=["system", "part", "score", "block", "p", "n"])

    sums = rows.groupBy("group", "chunk").applyInPandas(lambda k, part: add(k, part), "system int, part int, score double, block int, p binary, n binary")

    def merge(key_: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("score", ascending=False, kind="stable")
        score = own["score"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        p, n = (np.add.reduceat(np.stack([np.frombuffer(x) for x in own[c]]), first, 0) for c in ("p", "n"))
        return pd.DataFrame({"system": [key_[0]], "part": [key_[1]], "block": [key_[2]], "p": [p.tobytes()], "n": [n.tobytes()], "ps": [p.sum(0).tobytes()], "ns": [n.sum(0).tobytes()]})

    merged = kept_table(sums.groupBy("system", "part", "block").applyInPandas(lambda k, own: merge(k, own), "system int, part int, block int, p binary, n binary, ps binary, ns binary"), "curves")

    def above(key_: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part", ascending=False)
        p, n = (np.stack([np.frombuffer(x) for x in own[c]]) for c in ("ps", "ns"))
        rows_ = len(own)
        return pd.DataFrame({"system": [key_[0]] * rows_, "block": [key_[1]] * rows_, "part": own["part"].to_numpy(), "p0": [x.tobytes() for x in np.cumsum(p, 0) - p], "n0": [x.tobytes() for x in np.cumsum(n, 0) - n],
                             "pp": [p.sum(0).tobytes()] * rows_, "nn": [n.sum(0).tobytes()] * rows_})

    before = merged.select("system", "block", "part", "ps", "ns").groupBy("system", "block").applyInPandas(lambda k, own: above(k, own), "system int, block int, part int, p0 binary, n0 binary, pp binary, nn binary")

    def contribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                p0, n0, all_p, all_n = (np.frombuffer(x) for x in (r.p0, r.n0, r.pp, r.nn))
                p, n = (np.frombuffer(x).reshape(-1, len(p0)) for x in (r.p, r.n))
                tp, fp = p0 + np.cumsum(p, 0), n0 + np.cumsum(n, 0)
                precise = np.divide(tp, tp + fp, out=np.ones_like(tp), where=tp + fp > 0)
                first = np.divide(p0, p0 + n0, out=np.ones_like(p0), where=p0 + n0 > 0)
                last = np.concatenate([first[None, :], precise[:-1]], 0)
                curves = ((p * (all_n - fp + n / 2)).sum(0), (p * (last + precise) / 2).sum(0), (p * precise).sum(0))
                real = (all_p > 0) & (all_n > 0)
                out.append(pd.DataFrame({"system": r.system, "draw": np.arange(len(p0)), "block": r.block, "real": real, **{c: np.where(real, x / np.where(real, y, 1), 0.0) for c, x, y in zip(NAMES, curves, (all_p * all_n, all_p, all_p))}}))
            yield pd.concat(out)

    values = merged.join(before, ["system", "block", "part"]).mapInPandas(contribute, "system int, draw long, block int, real boolean, " + ", ".join(f"{c} double" for c in NAMES))
    per = values.groupBy("block", "draw").agg(F.min("real").alias("real"), *[F.sum(F.when(F.col("system") == 1, F.col(c)).otherwise(-F.col(c))).alias(c) for c in NAMES])
    tall = per.select("real", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.when(F.col("real"), F.col(c)).alias("delta")) for c in NAMES])).alias("m")).select("m.*")
    end = lambda worst, q: F.percentile(F.coalesce(F.col("delta"), F.lit(worst)), F.lit(q))
    bounds = tall.groupBy("metric").agg(end(-1.0, 0.025).alias("lo"), end(1.0, 0.975).alias("hi"), F.count("delta").alias("valid_draws"))
    frames = hist.select("system", "score", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("pos_frames").alias("w")), F.struct(F.lit(0).alias("y"), F.col("neg_frames").alias("w")))).alias("f")).select("system", "score", "f.*")
    roc = metrics.roc_auc(frames, "score", "y", ("system",), F.col("w")).select("system", F.col("auc").alias(NAMES[0]))
    pr = metrics.precision_recall(frames, "score", "y", ("system",), F.col("w")).select("system", F.col("pr_trapezoid").alias(NAMES[1]), F.col("step_ap").alias(NAMES[2]))
    signed = lambda c: F.sum(F.when(F.col("system") == 1, F.col(c)).otherwise(-F.col(c)))
    ok = (F.count(NAMES[0]) == 2) & (F.count("*") == 2)
    point = roc.join(pr, "system").agg(*[F.when(ok, signed(c)).alias(c) for c in NAMES])  # one row
    point = point.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("point")) for c in NAMES])).alias("m")).select("m.*")
    out = point.join(bounds, "metric", "left")
    valid = F.coalesce("valid_draws", F.lit(0))
    status, verdict = decision(F.col("point"), F.col("lo"), F.col("hi"), valid, draws)
    return out.select("metric", "point", F.when(status == "available", F.col("lo")).alias("lower"), F.when(status == "available", F.col("hi")).alias("upper"), valid.cast("int").alias("valid_draws"), status.alias("status"), verdict.alias("decision"))


NAMES = ("frame_roc_auc", "frame_pr_auc", "frame_ap")
