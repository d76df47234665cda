"""Line formats: temporal annotations, split files, captions, variable-width spans, label names, logs, zip directories."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.functions.text import canonical_id, clock_seconds


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def temporal_annotations(rows: DataFrame) -> DataFrame:
    """``name [frames] category s1 e1 s2 e2`` with 1-based inclusive spans, -1 for none: video_id, category, spans, issue.

    Spans are 0-based and half-open. The issue names what is wrong with a line: its width, a reversed span, spans that
    overlap, or a normal video with spans.
    """
    t = F.split(F.trim("value"), r"\s+")
    n = F.size(t)
    r = rows.select(
        canonical_id(t[0]).alias("video_id"), F.get(t, n - 5).alias("category"), n.alias("n"),
        *[F.get(t, n - k).try_cast("long").alias(c) for k, c in ((4, "a"), (3, "b"), (2, "c"), (1, "d"))],
    )
    span = lambda s, e: F.when(F.col(s) >= 0, F.struct((F.col(s) - 1).alias("start"), F.col(e).alias("end")))
    spans = F.array_compact(F.array(span("a", "b"), span("c", "d")))
    out = r.withColumn("spans", F.array_sort(spans))
    bad_order = F.exists("spans", lambda s: s["end"] <= s["start"])
    overlap = (F.size("spans") == 2) & (F.col("spans")[0]["end"] > F.get("spans", F.lit(1))["start"])
    missing = F.col("a").isNull() | F.col("b").isNull() | F.col("c").isNull() | F.col("d").isNull()
    issue = F.when(~F.col("n").isin(6, 7), "width").when(missing, "number").when(bad_order, "reversed").when(overlap, "overlap").when((F.lower("category") == "normal") & (F.size("spans") > 0), "normal with span")
    return out.select("video_id", "category", "spans", issue.alias("issue"))


def split_file(rows: DataFrame, split: str) -> DataFrame:
    """One path per line; chunks of a video (``__3``) become the video. ``conflict`` marks a video with several folders."""
    p = F.trim("value")
    r = rows.select(canonical_id(p).alias("video_id"), F.regexp_replace(p, r"/[^/]*$", "").alias("folder"))
    return r.groupBy("video_id").agg(F.min("folder").alias("folder"), (F.count_distinct("folder") > 1).alias("conflict"), F.count("*").alias("chunks")).withColumn("split", F.lit(split))


def captions(rows: DataFrame) -> DataFrame:
    """``video start end ##caption`` with m:s times: video_id, start, end, caption; lines of another form give nulls."""
    p = r"^(\S+)\s+(\S+)\s+(\S+)\s+##\s*(.*)$"
    g = lambda i: F.regexp_extract("value", p, i)
    # columns of their own, so that a line is matched once for each part and not again wherever the part is used
    parts = rows.select(*[g(i).alias(c) for i, c in enumerate(("video_id", "start", "end", "caption"), 1)])
    return parts.select(canonical_id(F.col("video_id")).alias("video_id"), clock_seconds(F.col("start")).alias("start"), clock_seconds(F.col("end")).alias("end"), "caption")


def variable_spans(rows: DataFrame) -> DataFrame:
    """``name s e s e ...``: video_id, spans, whether the numbers come in pairs, and what is wrong with the line.

    Lines that begin with # are comments; the pair -1 -1 stands for no span. The issue names an odd count, an end that
    isn't a number, a reversed or negative span, or spans that contradict the name: ``_label_A`` has none, others some.
    """
    t = F.split(F.trim("value"), r"\s+")
    nums = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: x.try_cast("long"))
    r = rows.filter(~F.ltrim("value").startswith("#")).select(canonical_id(t[0]).alias("video_id"), t[0].contains("_label_A").alias("normal"), t[0].contains("_label_").alias("named"), nums.alias("nums"))
    pairs = F.transform(F.when(F.size("nums") >= 2, F.sequence(F.lit(0), F.floor(F.size("nums") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get("nums", 2 * i).alias("start"), F.get("nums", 2 * i + 1).alias("end")))
    even = F.size("nums") % 2 == 0
    spans = F.filter(pairs, lambda s: ~((s["start"] == -1) & (s["end"] == -1)) | s["start"].isNull() | s["end"].isNull())
    out = r.select("video_id", "normal", "named", "nums", spans.alias("spans"), even.alias("even"))
    issue = F.when(~even, "odd count").when(F.exists("nums", lambda x: x.isNull()), "number").when(F.exists("spans", lambda s: (s["start"] < 0) | (s["end"] < s["start"])), "order")
    issue = issue.when(F.col("named") & (F.col("normal") == (F.size("spans") > 0)), "label")
    return out.select("video_id", "spans", "even", issue.alias("issue"))


#: The class tokens of labels in names.
LABEL_TOKENS = ("B1", "B2", "B4", "B5", "B6", "G")
#: The fields that they make: ``A``, or one to three different tokens with zeros behind them in up to three slots.
LABEL_FIELDS = ("A", *("-".join([*some, *["0"] * zeros]) for n in (1, 2, 3) for some in permutations(LABEL_TOKENS, n) for zeros in range(4 - n)))


def label_classes(path: Column) -> Column:
    """Tokens of the one ``_label_`` field of an .mp4 name, trailing zeros kept: ``A`` alone, or one to three slots of
    different known classes followed by zeros. Null for another form."""
    base = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    head = F.substring_index(base, "_label_", 1)
    field = F.regexp_extract(F.substring_index(base, "_label_", -1), r"^([A-Z0-9-]+)\.mp4$", 1)
    once = (head != "") & (head != base) & (F.substring_index(base, "_label_", 2) == base)
    one_line = ~head.rlike(r"[\n\r\x{85}\x{2028}\x{2029}]")
    return F.when(field.isin(*LABEL_FIELDS) & once & one_line, F.split(field, "-"))


def training_log(rows: DataFrame, line: str = "line", text: str = "value") -> DataFrame:
    """Epoch metrics of log lines such as ``epoch 3 ... loss=0.5 auc: 0.9``: epoch, metric, value.

    Lines without an epoch belong to the last one named before; ``line`` orders the lines of one log.
    """
    epoch = F.nullif(F.regexp_extract(text, r"(?i)epoch\D{0,3}(\d+)", 1), F.lit("")).cast("int")
    named = rows.withColumn("epoch", F.last(epoch, ignorenulls=True).over(W.partitionBy("log").orderBy(line).rowsBetween(W.unboundedPreceding, 0)))
    pairs = F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*)\s*[:=]\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(0))
    got = named.filter("epoch IS NOT NULL").select("log", "epoch", line, F.explode(pairs).alias("pair"))
    return got.select("log", "epoch", line, F.lower(F.regexp_extract("pair", r"^\w+", 0)).alias("metric"), F.regexp_extract("pair", r"[:=]\s*(.*)$", 1).cast("double").alias("value"))


def monitor_summary(rows: DataFrame) -> DataFrame:
    """Per process and device: first and last time, samples, largest and mean memory, and the latest command."""
    return rows.groupBy("pid", "gpu_uuid").agg(
        F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"), F.count("*").alias("samples"),
        F.max("used_memory_mib").alias("peak"), F.avg("used_memory_mib").alias("mean"), F.max_by("command", "timestamp_utc").alias("command"),
    )


def zip_entries(data: bytes) -> list[tuple[str, int, int, int]]:
    """(name, crc, packed size, size) of the entries in a zip central directory; no member is read."""
    out, at = [], data.find(b"PK\x01\x02")
    while 0 <= at <= len(data) - 46 and data[at : at + 4] == b"PK\x01\x02":
        crc, packed, size, n, extra, comment = struct.unpack_from("<IIIHHH", data, at + 16)
        name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
        more, p = data[at + 46 + n : at + 46 + n + extra], 0
        while p + 4 <= len(more):
            tag, length = struct.unpack_from("<HH", more, p)
            if tag == 1:  # 64-bit sizes, each present only where the short field is full
                q = p + 4
                if size == 0xFFFFFFFF:
                    (size,) = struct.unpack_from("<Q", more, q)
                    q += 8
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack_from("<Q", more, q)
            p += 4 + length
        out.append((name, crc, packed, size))
        at += 46 + n + extra + comment
    return out


def zip_members(archives: DataFrame) -> DataFrame:
    """path, name, crc, packed, size of the members of archives (path, content); any tail that holds the central directory will do."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, *e) for p, c in zip(part["path"], part["content"]) for e in zip_entries(c)], columns=["path", "name", "crc", "packed", "size"])

    return archives.select("path", "content").mapInPandas(run, "path string, name string, crc long, packed long, size long")


def zip_directory(spark: SparkSession, path: str) -> DataFrame:
    """The members of the archives below a folder."""
    return zip_members(spark.read.format("binaryFile").load(path))
