"""Readers and writers of manifests, feature indexes, predictions, labels and truth, with fixed schemas.

JSON lines are read with their schema; ``strict`` stops at the first malformed line, else such lines come back with
their text in ``_corrupt_record``. Writers go through Spark's committer, so readers never see half a table.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.text import metadata_issue

SPAN = "struct<start: double, end: double, unit: string>"
ANNOTATION = f"struct<scope: string, label: string, is_anomaly: boolean, span: {SPAN}, text: string, source: string, metadata: map<string, string>>"
MANIFEST = f"schema_version int, video_id string, path string, split string, category string, is_anomaly boolean, annotations array<{ANNOTATION}>, num_frames long, fps double, duration_seconds double, metadata map<string, string>"
FEATURE_INDEX = "video_id string, clip_id string, clip_index long, encoder_fingerprint string, storage_format string, arrays map<string, struct<path: string, shape: array<int>, dtype: string, sha256: string, nbytes: long>>, start_s double, end_s double, frame_start long, frame_end long, metadata map<string, string>"
PREDICTION = "run_id string, video_id string, clip_id string, clip_index long, start_s double, end_s double, frame_start long, frame_end long, anomaly_score double, predicted_label string, ground_truth int, encoder_fingerprint string, metadata map<string, string>, created_at string"
CACHE_TELEMETRY = "run_id string, encoder_fingerprint string, video_id string, clip_id string, mode string, cache_type string, cache_hit boolean, input_tokens long, reused_tokens long, output_tokens long, cache_bytes long, encode_ms double, reuse_ratio double, metadata string, created_at string"
#: The modes and kinds of cache telemetry.
TELEMETRY_MODES, CACHE_TYPES = ("fixed", "streaming"), ("none", "kv", "token", "visual_memory", "state", "hybrid")
TRUTH = "video_id string, weak_label int, num_frames long, intervals array<struct<start: long, end: long, label: int>>"
LABELS_CSV = ("video_id", "video_path", "label", "camera_id", "start_time", "end_time", "note")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def truth_intervals(truth: DataFrame) -> DataFrame:
    """One row per interval: video_id, weak_label, num_frames, start, end, label."""
    return truth.select("video_id", "weak_label", "num_frames", F.inline("intervals"))


def truth_issues(truth: DataFrame) -> DataFrame:
    """Videos whose intervals don't tile their frames, or that are weakly normal and have positive intervals."""
    sorted_ = F.array_sort("intervals")
    tiled = F.aggregate(sorted_, F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok")), lambda s, i: F.struct(i["end"].alias("at"), (s["ok"] & (i["start"] == s["at"]) & (i["end"] > i["start"])).alias("ok")))
    t = truth.withColumn("t", tiled)
    reason = F.when(~F.col("t.ok") | (F.col("t.at") != F.col("num_frames")), "not tiled").when((F.col("weak_label") == 0) & F.exists("intervals", lambda i: i["label"] > 0), "positive in a normal video")
    return t.select("video_id", reason.alias("reason")).filter("reason IS NOT NULL")


def find_features(index: DataFrame, video_id: str | None = None, clip_id: str | None = None, fingerprint: str | None = None) -> DataFrame:
    """Rows that equal all given values; write the index partitioned by fingerprint to prune files."""
    for c, v in (("video_id", video_id), ("clip_id", clip_id), ("encoder_fingerprint", fingerprint)):
        if v is not None:
            index = index.filter(F.col(c) == v)
    return index


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a column that the file lacks is empty."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in LABELS_CSV])


def update_labels(old: DataFrame, listing: DataFrame, default_label: str) -> DataFrame:
    """The label table after a new listing (video_id, video_path): known rows keep their label and are kept if they
    have vanished; new ones take label and camera from the first two folders of their path."""
    parts = F.split("video_path", "/")
    new = listing.select("video_id", "video_path", F.when(F.size(parts) > 1, parts[0]).otherwise(default_label).alias("label"), F.when(F.size(parts) > 2, parts[1]).otherwise("").alias("camera_id"))
    j = old.alias("o").join(new.alias("n"), "video_id", "full_outer")
    return j.select("video_id", *[F.coalesce(f"n.{c}" if c == "video_path" else f"o.{c}", f"o.{c}" if c == "video_path" else f"n.{c}").alias(c) for c in ("video_path", "label", "camera_id")])


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def reuse_ratio(telemetry: DataFrame) -> DataFrame:
    """Telemetry with the share of its input tokens that were reused; null without input."""
    return telemetry.withColumn("reuse_ratio", F.when(F.col("input_tokens") > 0, F.col("reused_tokens") / F.col("input_tokens")))


def telemetry_issues(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    """``rows`` (the columns of ``CACHE_TELEMETRY`` but its ratio) with a reason, null for rows that can be written.

    The first of: ``ids`` (null or empty), ``run`` (another than ``run_id``), ``fingerprint`` (not sha256: and 64 lower-case
    digits), ``mode``, ``cache_type``, ``counts`` (null or negative), ``reused`` (more than the input), ``encode_ms`` (null,
    negative or not finite), ``cache_hit`` (null), ``metadata`` (as ``text.metadata_issue`` has it).
    """
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    all_of = lambda *conditions: reduce(lambda a, c: a & c, conditions)
    ms = F.col("encode_ms")
    rules = [
        ("ids", broken(all_of(*[F.col(c) != "" for c in ("run_id", "video_id", "clip_id")]))), ("run", F.lit(False) if run_id is None else F.col("run_id") != run_id),
        ("fingerprint", broken(F.col("encoder_fingerprint").rlike(r"^sha256:[0-9a-f]{64}\z"))), ("mode", broken(F.col("mode").isin(*TELEMETRY_MODES))), ("cache_type", broken(F.col("cache_type").isin(*CACHE_TYPES))),
        ("counts", broken(all_of(*[F.col(c) >= 0 for c in ("input_tokens", "reused_tokens", "output_tokens", "cache_bytes")]))), ("reused", F.col("reused_tokens") > F.col("input_tokens")),
        ("encode_ms", broken(~F.isnan(ms) & (ms >= 0) & (ms != float("inf")))), ("cache_hit", F.col("cache_hit").isNull()), ("metadata", metadata_issue(F.col("metadata")).isNotNull()),
    ]
    return rows.withColumn("reason", F.coalesce(*[F.when(bad, name) for name, bad in rules]))


def write_telemetry(rows: DataFrame, path: str, run_id: str, mode: str = "append") -> DataFrame:
    """Writes the rows without a reason as JSON lines, with their share of reused tokens (0 without input); gives the refused ones.

    Both sides see one reading of ``rows`` only if its source is stable; the refused rows are worked out when they are read.
    """
    checked = telemetry_issues(rows, run_id)
    ratio = F.when(F.col("input_tokens") > 0, F.col("reused_tokens") / F.col("input_tokens")).otherwise(0.0)
    good = checked.filter("reason IS NULL").drop("reason").withColumn("reuse_ratio", ratio)
    write_jsonl(good, path, mode)
    return checked.filter("reason IS NOT NULL")


#: Values of arrays after which ``load_arrays`` hands on what it has read, within a batch of records.
VALUES_AT_ONCE = 1 << 16


def load_arrays(index: DataFrame, files: DataFrame) -> DataFrame:
    """The arrays of the index's records: video_id, clip_id, name, shape, values as doubles in row order, and an issue.

    ``files``: path, content of .npy files or .npz bundles, such as Spark's ``binaryFile`` source gives. A record whose
    ``storage_format`` is npz has its arrays in one bundle, each under its ``key`` or, without one, its name; the bundle's
    digest is checked before any member is read, and it is read once for a record. The issue is a missing file,
    ``paths`` (an npz record that names several), another SHA-256 or size than the record says, ``unreadable`` content, a
    ``member`` that the bundle lacks, or another shape or type; such arrays have no values. Sizes of npz files aren't
    compared, since a record says those of its arrays. Records without arrays have no rows.
    """
    has = lambda c: c in index.columns
    keyed = "key" in index.schema["arrays"].dataType.valueType.names
    npz = F.coalesce(F.col("storage_format") == "npz", F.lit(False)) if has("storage_format") else F.lit(False)
    one = F.size(F.array_distinct(F.transform(F.map_values("arrays"), lambda a: a["path"]))) == 1
    key = F.coalesce(F.col("a.key"), F.col("name")) if keyed else F.col("name")
    wanted = index.select("video_id", "clip_id", npz.alias("npz"), (npz & ~one).alias("several"), F.explode("arrays").alias("name", "a"))
    about = F.struct("name", key.alias("key"), F.col("a.shape").alias("shape"), F.col("a.dtype").alias("dtype"), F.lower("a.sha256").alias("sha256"), F.col("a.nbytes").alias("nbytes"))
    # the arrays that a record has in one file come together, so that its content is moved and read once
    grouped = wanted.select("video_id", "clip_id", "npz", "several", F.col("a.path").alias("path"), about.alias("about")).groupBy("video_id", "clip_id", "npz", "several", "path").agg(F.array_sort(F.collect_list("about")).alias("about"))
    found = grouped.join(files.select("path", "content"), "path", "left")
    digest = F.when(F.col("content").isNotNull() & ~F.col("several"), F.sha2("content", 256))
    fields = "video_id string, clip_id string, name string, shape array<int>, values array<double>, issue string"

    decode = lambda parts: (piece for part in parts for piece in _decoded(part))
    return found.select("video_id", "clip_id", "npz", "several", "about", "content", digest.alias("digest")).mapInPandas(decode, fields)


def _decoded(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The arrays of a batch of records, in pieces of about ``VALUES_AT_ONCE`` values."""
    columns, out, held = ["video_id", "clip_id", "name", "shape", "values", "issue"], [], 0
    for r in part.itertuples(index=False):
        at = _arrays(r.content, r.npz) if r.content is not None and any(a["sha256"] == r.digest for a in r.about) else None
        for a in r.about:
            x, issue = None, "paths" if r.several else "missing" if r.content is None else "sha256" if a["sha256"] != r.digest else None
            if issue is None and not r.npz and len(r.content) != a["nbytes"]:
                issue = "size"
            if issue is None:
                x, issue = at(a["key"])
            if issue is None:
                issue = "shape" if list(x.shape) != list(a["shape"]) else "dtype" if str(x.dtype) != a["dtype"] else None
            fine = issue is None
            out.append((r.video_id, r.clip_id, a["name"], list(x.shape) if fine else None, x.astype(np.float64).ravel() if fine else None, issue))
            held += x.size if fine else 1
            if held >= VALUES_AT_ONCE:
                yield pd.DataFrame(out, columns=columns)
                out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)


def _arrays(content: bytes, npz: bool) -> Callable[[str], tuple[np.ndarray | None, str | None]]:
    """Gives the array of a key, or why there is none; a bundle's members are read only when asked for."""
    try:
        got = np.load(io.BytesIO(content), allow_pickle=False)
    except (ValueError, OSError, EOFError, zipfile.BadZipFile):
        return lambda key: (None, "unreadable")
    if isinstance(got, np.ndarray):
        return lambda key: (None, "unreadable") if npz else (got, None)

    def member(key: str) -> tuple[np.ndarray | None, str | None]:
        if not npz or key not in got.files:
            return None, "member" if npz else "unreadable"
        try:
            return got[key], None
        except (ValueError, OSError, EOFError, zipfile.BadZipFile, zlib.error):
            return None, "unreadable"

    return member


#: Bytes up to which a file goes through Spark's reader as one value, and the bytes of a block of a larger one.
WHOLE_FILE, FILE_BLOCK = 64 << 20, 8 << 20


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """path, length and SHA-256 (lower-case hex) of every file below a folder that isn't empty, of any size.

    Files up to ``whole`` bytes are hashed as Spark reads them. Larger ones are opened by their tasks and hashed block by
    block, so no file is ever one value; they need a file system that Arrow can open. Spark's
    reader lists no empty files, so they have no row; a folder without files gives none either.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(sha256=[_digest(p) for p in part["path"]])

    large = files.filter(F.col("length") > whole).select("path", "length").mapInPandas(run, "path string, length long, sha256 string")
    return small.union(large)


def _digest(path: str) -> str:
    digest = hashlib.sha256()
    local = re.sub(r"^file:/*", "/", path)
    if local.startswith("/"):
        fs, name = pafs.LocalFileSystem(), local
    else:
        fs, name = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    with fs.open_input_stream(name) as stream:
        while block := stream.read(FILE_BLOCK):
            digest.update(block)
    return digest.hexdigest()
