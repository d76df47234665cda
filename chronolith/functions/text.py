"""Scalar functions on names, times, hashes and nested metadata, as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(value: Column) -> Column:
    """Base name without a known suffix and without a clip suffix, trimmed, in lower case; null if nothing is left.

    Fixed values: the suffixes.
    """
    name = F.substring_index(F.translate(value, "\\", "/"), "/", -1)
    bare = F.regexp_replace(name, r"(?i)\.(mp4|avi|mkv|mov|webm|npy|npz|txt|fc6-1)$", "")
    name = F.lower(F.trim(F.regexp_replace(bare, r"(?i)(__\d+|_c)$", "")))
    return F.when(F.length(name) > 0, name)


def relative_path(value: Column) -> Column:
    """Path with forward slashes, trimmed; null for an absolute one, a drive, or empty, '.' or '..' parts."""
    p = F.regexp_replace(F.trim(value), r"\\", "/")
    bad = p.rlike(r"^/|^[A-Za-z]:|(^|/)(\.{0,2})(/|$)")
    return F.when(~bad, p)


def slug(value: Column, fallback: str = "item") -> Column:
    """Safe file name: other characters become one dash, 64 characters at most, then 10 digits of the SHA-256."""
    clean = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    head = F.substring(F.when(F.length(clean) > 0, clean).otherwise(fallback), 1, 64)
    return F.concat(head, F.lit("-"), F.substring(F.sha2(value.cast("binary"), 256), 1, 10))


def clock_seconds(value: Column) -> Column:
    """Seconds of m:s or h:m:s; null for anything else."""
    t = F.trim(value)
    part = lambda c: c.cast("double")
    hours = F.when(F.substring_index(t, ":", 2) != t, 3600 * part(F.substring_index(t, ":", 1))).otherwise(0.0)
    total = part(F.substring_index(t, ":", -1)) + 60 * part(F.substring_index(F.substring_index(t, ":", -2), ":", 1)) + hours
    return F.when(t.rlike(r"^(\d+:)?\d+:\d+(\.\d+)?$"), total)


def source_group(member: Column) -> Column:
    """Group of a member by what stands before the one '__#' of its base name, without suffix and label; else one shared group."""
    name = F.regexp_replace(F.element_at(F.split(member, "/"), -1), r"(?<=.)\.[^.]*$", "")
    parts = F.split(F.regexp_replace(name, "_label_(?!.*_label_).*$", ""), "__#")
    ok = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    return F.when(ok, F.concat(F.lit("source:"), F.sha2(F.lower(parts[0]).cast("binary"), 256))).otherwise("source:unknown")


#: The categories.
CATEGORIES = ("Abuse", "Arrest", "Arson", "Assault", "Burglary", "Explosion", "Fighting", "RoadAccidents", "Robbery", "Shooting", "Shoplifting", "Stealing", "Vandalism", "Normal")


def category(value: Column) -> Column:
    """The category that a name means, without regard to case, spaces and underscores; 'Normal' if it says so anywhere; else null."""
    bare = F.lower(F.regexp_replace(F.trim(value), "[ _]", ""))
    found = F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.lower(c) == bare)
    return F.when(bare.contains("normal"), "Normal").otherwise(F.get(found, 0))


def inferred_category(path: Column) -> Column:
    """The category of the first folder or name that means one, else the one that the base name begins with, else null."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    means = F.get(F.filter(F.transform(parts, category), lambda c: c.isNotNull()), 0)
    base = F.lower(F.element_at(parts, -1))
    prefix = F.get(F.filter(F.array(*map(F.lit, CATEGORIES[:-1])), lambda c: F.startswith(base, F.lower(c))), 0)
    return F.coalesce(means, prefix)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal strings of up to 16 digits each block; blocks are compared in turn."""
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 8).cast("int")), lambda i: F.conv(F.substring(x, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(F.zip_with(blocks(a), blocks(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: Fixed value: ends of names whose values are hidden.
SECRET_NAME = r"(?i)(?:^|[_-])(?:password|passwd|secret|token|api[_-]?key|cookie|credentials?|authorization)$"


SECRET = re.compile(SECRET_NAME)


def redact(value: Column, key: Column) -> Column:
    """The value, hidden where its key names a secret."""
    return F.when(key.rlike(SECRET_NAME), F.lit("<redacted>")).otherwise(value)


#: Parts of JSON text: strings (an open one too), brackets, colons and commas, other values.
JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}:,]|[^\s\[\]{}:,"]+', re.S)


def without_secrets(text: str) -> str:
    """JSON text with whatever stands under a secret's name hidden: scalars, arrays and objects; all else stays as written.

    Text that breaks off is hidden to its end, if it breaks off under such a name.
    """
    out, kept, parts = [], 0, list(JSON_PART.finditer(text))
    at = 0
    while at + 1 < len(parts):
        key = parts[at].group()
        at += 1
        if not key.startswith('"') or parts[at].group() != ":":
            continue
        try:
            name = json.loads(key, strict=False)
        except ValueError:
            name = key[1:-1]
        if not SECRET.search(name):
            continue
        at += 1
        first, depth = at, 0
        while at < len(parts):
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(parts[at].group(), 0)
            if depth < 0:  # the value is missing
                break
            at += 1
            if depth == 0:
                break
        if at == first:
            continue
        out += [text[kept : parts[first].start()], '"<redacted>"']
        kept = parts[at - 1].end() if depth == 0 else len(text)
    return "".join([*out, text[kept:]])


def redact_json(text: Column) -> Column:
    """``without_secrets`` of a column; null for null."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return pd.Series([without_secrets(t) if isinstance(t, str) else None for t in texts], dtype=object)

    return hide(text)


#: Items that metadata may hold beside a record.
METADATA_ITEMS = 2048


def _outline(text: Column) -> Column:
    """JSON text with ``s`` for every string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', " s ")


def _json_tokens(text: Column) -> Column:
    return F.regexp_count(_outline(text), F.lit(r"[\[\]{},:]|[^\s\[\]{},:]+"))


def metadata_items(text: Column) -> Column:
    """Items of JSON text at any depth: one for each member of an object or array and one for each scalar.

    Counted in one pass over the text, so depth costs nothing. An empty object or array that is all of it has 0, a lone
    scalar 1. Null for null; meaningless for text that isn't JSON.
    """
    plain = F.regexp_replace(_outline(text), r"\s+", "")
    members = F.regexp_count(plain, F.lit(",")) + F.regexp_count(plain, F.lit(r"[\[{](?![\]}])"))
    return members + F.regexp_count(plain, F.lit(r"(?<![\w.+-])[\w.+-]+(?![\w.+:-])"))


def metadata_issue(text: Column, most: int = METADATA_ITEMS) -> Column:
    """Why metadata can't be kept beside a record, the first that holds; null if it can, or is null.

    ``not finite``: NaN or an infinity outside strings; ``invalid``: not JSON, or a repeated name; ``items``: over ``most``.
    """
    odd = _outline(text).rlike(r"(?:^|[:,\[])\s*[+-]?(?:NaN|Infinity)\s*(?:[,\]}]|$)")
    # the parser stops after the first value, so what it read must have as many tokens as the text
    read = F.to_json(F.try_parse_json(text))
    return F.when(odd, "not finite").when(text.isNotNull() & (read.isNull() | (_json_tokens(read) != _json_tokens(text))), "invalid").when(metadata_items(text) > most, "items")


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON in the given order, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def snap_decision(x: Column) -> Column:
    """Values within 8 units of the last place of 1 around -0.005 count as -0.005."""
    return F.when(F.abs(x + 0.005) <= F.lit(8 * 2.0**-52), F.lit(-0.005)).otherwise(x)


def fuse_labels(probs: Column, names: list[str], ranking: Column, alarm: float, least: float, normal: int = 0) -> tuple[Column, Column]:
    """(label, anomaly): the likeliest name or 'unknown' below ``least``; an anomaly if that is another than the
    normal one and likely enough, or if the ranking score reaches the alarm."""
    top = F.array_max(probs)
    at = F.array_position(probs, top)
    label = F.when(top < least, "unknown").otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int")))
    return label, ((at != normal + 1) & (top >= least)) | (ranking >= alarm)
