"""Roles of a dataset that is listed by the members of its archives, before any of its files is there.

Members of the test volume keep their split. The others take a role by their source: all members of a source have one
role, so clips cut from one recording never meet across roles. Which files are there decides nothing but their status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.selection import split_by_hash
from chronolith.sources.paths import kept_table
from chronolith.sources.texts import label_classes

ROLES = ("fit", "confirm", "select")


def member_name(path: Column) -> Column:
    """The path with forward slashes, without a first folder ``videos``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?i)^videos/", "")


def source_prefix(path: Column) -> Column:
    """What stands before the one ``__#`` of a name, in lower case; null where that is missing, repeated or at an end."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    name = F.regexp_replace(stem, r"_label_(?!.*_label_).*$", "")
    prefix = F.regexp_extract(name, r"(?s)^(?!.*__#.*__#)(.+)__#.", 1)
    return F.when(prefix != "", F.lower(prefix))


def prepare(members: DataFrame, files: DataFrame, seed: int, test_volume: str = "test_videos") -> DataFrame:
    """A row for each member: video_id, path, split, labels, is_anomaly, source, role, shared, status, issue.

    ``members``: volume, name, size, such as zip directories give. ``files``: path (volume/name) and size of what is there.
    ``source``: SHA-256 of the prefix of the name, null if it has none. ``role``: of the sources of the train members in
    seeded order eight tenths fit, a tenth confirm, the rest select; members without a source are fit. ``shared``: the
    source has test and train members. ``status``: available, missing, or size mismatch.
    ``issue``: ``extension`` (not .mp4, or no name), ``duplicate`` (an identity several members have), ``both splits`` (of
    them one test and one train), ``labels`` (a train name without valid classes). Such members have no role, and their
    sources don't count. Empty tables give no rows; without files all are missing.
    """
    # the name as a column of its own, so that it isn't made again wherever it is used
    name = F.col("__name")
    named = F.coalesce(name.rlike(r"[^/]\.mp4$"), F.lit(False))
    rows = members.select("volume", "name", "size", member_name(F.col("name")).alias("__name")).select(
        F.concat_ws("/", "volume", F.regexp_replace("name", r"\\", "/")).alias("path"), F.col("size").alias("__size"),
        F.when(F.col("volume") == test_volume, "test").otherwise("train").alias("split"), named.alias("__named"),
        F.when(named, F.sha2(F.lower(F.regexp_replace(name, r"\.mp4$", "")).cast("binary"), 256)).alias("video_id"),
        F.sha2(source_prefix(name).cast("binary"), 256).alias("source"), label_classes(name).alias("__classes"),
    )
    # written, since each of the readers below would make the names, digests and classes of all members anew
    rows = kept_table(rows, "members")
    again = rows.filter("video_id IS NOT NULL").groupBy("video_id").agg(F.count("*").alias("__n"), F.min(F.col("split") == "test").alias("__a"), F.max(F.col("split") == "test").alias("__z")).filter("__n > 1")
    # null ids and sources take a place of their own in the joins, so that they don't all meet in one task
    apart = lambda c: F.coalesce(F.col(c), F.concat(F.lit("/"), "path"))
    rows = rows.withColumn("__id", apart("video_id")).join(again.withColumnRenamed("video_id", "__id"), "__id", "left")
    issue = F.when(~F.col("__named"), "extension").when(F.col("__a") != F.col("__z"), "both splits").when(F.col("__n") > 1, "duplicate").when((F.col("split") == "train") & F.col("__classes").isNull(), "labels")
    rows = rows.withColumn("issue", issue)

    sound = rows.filter("issue IS NULL AND source IS NOT NULL")
    sources = kept_table(sound.groupBy("source").agg(F.max(F.col("split") == "test").alias("__test"), F.max(F.col("split") == "train").alias("__train")), "sources")
    train = sources.filter("__train").select("source", F.lit(0).alias("all"))
    roles = split_by_hash(train, "source", "all", str(seed), ROLES).select("source", F.col("part").alias("__role"))
    about = sources.select("source", (F.col("__test") & F.col("__train")).alias("__shared")).join(roles, "source", "left")
    there = files.groupBy("path").agg(F.max("size").alias("__there"))

    j = rows.withColumn("__source", apart("source")).join(about.withColumnRenamed("source", "__source"), "__source", "left").join(there, "path", "left")
    taken = F.col("issue").isNull() & (F.col("split") == "train")
    labels = F.when(F.col("split") == "train", F.array_join("__classes", "-"))
    status = F.when(F.col("__there").isNull(), "missing").when(F.col("__there") == F.col("__size"), "available").otherwise("size mismatch")
    return j.select(
        "video_id", "path", "split", labels.alias("labels"), (labels != "A").alias("is_anomaly"), "source",
        F.when(taken, F.coalesce("__role", F.lit(ROLES[0]))).alias("role"), F.coalesce("__shared", F.lit(False)).alias("shared"), status.alias("status"), "issue",
    )
