"""Constraints as queries: each gives the rows that break it, so an empty result means that it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.functions.text import canonical_id


def require_empty(issues: DataFrame, what: str) -> None:
    """Raises with a few of the rows, if there are any."""
    some = issues.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {some}")


def split_leakage(rows: DataFrame, key: Column, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return rows.groupBy(key.alias("key")).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).filter("splits > 1")


def duplicate_groups(rows: DataFrame, key: Column, item: str) -> DataFrame:
    """Keys with several rows: their number, the smallest and the largest item."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(item).alias("first_item"), F.max(item).alias("last_item")).filter("n > 1")


def key_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    own = lambda df, mine: df.select(key, F.lit(mine).alias("__l"), F.lit(not mine).alias("__r"))
    both = own(left, True).union(own(right, False)).groupBy(key).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    none = F.col(key).isNull()  # a null key meets none
    sides = F.array_compact(F.array(F.when(F.col("__l") & (none | ~F.col("__r")), "left_only"), F.when(F.col("__r") & (none | ~F.col("__l")), "right_only")))
    return both.select(key, F.explode(sides).alias("side"))


def row_diff(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``columns`` that the two tables don't have equally often: the columns, expected, actual and issue.

    ``missing`` and ``unexpected`` rows are in one table only, ``repeated`` in both. Nulls equal each other. Both tables are
    counted in one aggregation, before which copies are counted where they are.
    """
    side = lambda df, e, a: df.select(*columns, F.lit(e).alias("__e"), F.lit(a).alias("__a"))
    n = side(expected, 1, 0).unionByName(side(actual, 0, 1)).groupBy(*columns).agg(F.sum("__e").alias("expected"), F.sum("__a").alias("actual"))
    issue = F.when(F.col("actual") == 0, "missing").when(F.col("expected") == 0, "unexpected").otherwise("repeated")
    return n.filter("expected <> actual").withColumn("issue", issue)


def pair_issues(train: DataFrame, test: DataFrame, key: str, split: str) -> DataFrame:
    """key, table and reason of what keeps two manifests from being a train and a test one; no row if nothing does.

    ``split``: a row names another split than its table's, or none; ``repeated``: a key has several rows in its table;
    ``leakage``: a key has rows in both (as of either); ``no id``: the key is null or empty. Keys are compared as
    ``canonical_id`` has them. A key is named once for each table and reason.
    """
    side = lambda df, name: df.select(canonical_id(F.col(key).cast("string")).alias("key"), F.lit(name).alias("table"), F.col(split).alias("__split"))
    rows = side(train, "train").unionByName(side(test, "test"))
    each = rows.groupBy("key", "table").agg(F.count("*").alias("__n"), F.max((~F.col("__split").eqNullSafe(F.col("table"))).cast("int")).alias("__other"))
    tables = rows.groupBy("key").agg(F.count_distinct("table").alias("__tables"))
    j = each.join(tables.filter("key IS NOT NULL"), "key", "left")
    named = F.col("key").isNotNull()
    reasons = F.array_compact(F.array(F.when(~named, "no id"), F.when(F.col("__other") == 1, "split"), F.when(named & (F.col("__n") > 1), "repeated"), F.when(F.col("__tables") > 1, "leakage")))
    return j.select("key", "table", F.explode(reasons).alias("reason"))


def tiling_issues(tiles: DataFrame, key: str, start: str, end: str, total: DataFrame, frames: str) -> DataFrame:
    """Keys whose intervals don't tile [0, frames) exactly, with the first reason."""
    w = W.partitionBy(key).orderBy(start)
    step = tiles.select(key, start, end, F.lag(end).over(w).alias("before"))
    facts = step.groupBy(key).agg(
        F.min(start).alias("lo"), F.max(end).alias("hi"),
        F.max((F.col("before").isNotNull() & (F.col("before") < F.col(start))).cast("int")).alias("gap"),
        F.max((F.col("before").isNotNull() & (F.col("before") > F.col(start))).cast("int")).alias("overlap"),
    )
    reason = F.when(F.col("lo") != 0, "starts late").when(F.col("gap") > 0, "gap").when(F.col("overlap") > 0, "overlap").when(F.col("hi") != F.col(frames), "wrong end")
    return facts.join(total.select(key, frames), key).select(key, reason.alias("reason")).filter("reason IS NOT NULL")


def constant_per_key(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys with more than one value (nulls apart) in a column that must be constant."""
    n = [F.count_distinct(c).alias(c) for c in columns]
    g = rows.groupBy(key).agg(*n)
    return g.select(key, F.array_compact(F.array(*[F.when(F.col(c) > 1, F.lit(c)) for c in columns])).alias("varying")).filter(F.size("varying") > 0)


def readiness(videos: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """For each video the reasons why it isn't ready, sorted, and whether it is."""
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()])))
    return videos.select(key, F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("ready"))


def expected_counts(rows: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Observed against expected numbers (``by``, expected), including those missing on one side."""
    seen = rows.groupBy(by).agg(F.count("*").alias("observed"))
    j = expected.join(seen, by, "full_outer").select(by, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return j.withColumn("ok", F.col("expected") == F.col("observed"))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table: the sum of the rows' leading SHA-256 digits, and the number of rows."""
    line = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    head = F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sum(head).cast("string").alias("digest"), F.count("*").alias("rows"))


def canonical_leakage(rows: DataFrame, item: str, split: str) -> DataFrame:
    """Leakage between splits by canonical ids; rows without one belong to nothing and leak nowhere."""
    known = rows.filter(canonical_id(F.col(item).cast("string")).isNotNull())
    return split_leakage(known, canonical_id(F.col(item).cast("string")), split)


#: The labels that analyses may read beside a clip.
SIDECAR = ("video_id", "partition", "weak_label", "temporal_label", "label_source", "scene_group", "motion_bin", "category_for_analysis_only", "pseudo_positive")


def label_sidecar(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The ``SIDECAR`` columns of each clip, and nothing else of it; columns that the rows lack are null.

    A clip that several rows have takes the last by ``order`` (nulls first); without an order, clips must have one row.
    """
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in SIDECAR]
    if order is None:
        return rows.select(key, *have)
    last = rows.select(F.col(key), F.struct(F.col(order).alias("__order"), *have).alias("row")).groupBy(key).agg(F.max("row").alias("row"))
    return last.select(key, *[F.col(f"row.{c}").alias(c) for c in SIDECAR])


def sampling_comparability(rows: DataFrame, case: str, coordinates: list[str], reference: str) -> DataFrame:
    """Whether each other case sampled the same coordinates as the reference: case, frames, reasons, comparable.

    Coordinates are summed as 48-bit parts of SHA-256 digests of whole rows, place in the order included, so nothing is
    sorted or gathered. Reasons: no reference, a null among the coordinates, other coordinates, another number of frames.
    """
    lacking = F.lit(False)
    for c in coordinates:
        lacking = lacking | F.col(c).isNull()
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in coordinates]).cast("binary"), 256)
    each = rows.groupBy(case).agg(F.sum(F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")).alias("__sum"), F.count("*").alias("frames"), F.max(lacking).alias("__lacking"))
    first = each.filter(F.col(case) == reference).select(F.col("__sum").alias("__sum0"), F.col("frames").alias("__frames0"), F.col("__lacking").alias("__lacking0"))
    j = each.filter(~F.col(case).eqNullSafe(F.lit(reference))).join(F.broadcast(first), F.lit(True), "left")  # one row at most
    reasons = F.array_compact(F.array(F.when(F.col("__frames0").isNull(), "no reference"), F.when(F.col("__lacking") | F.col("__lacking0"), "null coordinate"), F.when(F.col("__sum") != F.col("__sum0"), "coordinates"), F.when(F.col("frames") != F.col("__frames0"), "frames")))
    return j.select(case, "frames", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("comparable"))
