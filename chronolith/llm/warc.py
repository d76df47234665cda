"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

A capture is a request, a response (or a revisit) and a metadata record; request and metadata name the response in
``WARC-Concurrent-To``. Of records with equal payloads of at least ``min_revisit`` bytes, that with the smallest
page_id is the response and the others are revisits that refer to it. Records are built by SQL functions and written
by Spark's text sink whose line separator is the end of a record; files hold a bounded number of captures and of bytes,
and are read with the binary source and parsed by content length, one file at a time.

Defined cases: a null payload is empty; a null url leaves out the target; a null page_id is a page of its own that
comes last and never is referred to if another has the payload; copies of one row become as many captures of the same
identifiers; without pages no archive is written and reading gives no rows; columns besides the three are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import fresh_path, kept

#: Captures in one file at most, and bytes of it before compression (unless one capture alone has more).
FILE_CAPTURES, FILE_BYTES = 1000, 128 << 20
#: Repeated payloads up to which their first pages are broadcast; more are joined by salted keys.
MAX_BROADCAST = 100_000
#: Revisits of one response are dealt out over so many keys.
SALTS = 32

END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, payload binary, page_id string"


def _urn(*parts: Column) -> Column:
    """A record identifier that follows from its parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Head and block of a record; headers whose value is null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"\r\n{k}: "), v)) for k, v in headers]
    length = F.concat(F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("", F.lit("WARC/1.1"), *lines, length), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", min_revisit: int = 100, compression: str = "gzip") -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``."""
    rows = pages.select(
        "page_id",
        F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload")})
    large = rows.filter(F.col("bytes") >= min_revisit)
    order = F.struct(F.col("page_id").isNull(), F.col("page_id").alias("id"), F.col("url").alias("url"))
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    first = kept(first)
    most = rows.agg(F.max(F.col("bytes") + F.coalesce(F.octet_length("url"), F.lit(0)) * 4)).first()[0]
    # the payloads stay where they are, or move by a digest and a salt: copies of one page don't meet in one task
    if first.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(first), "digest", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url") + F.spark_partition_id(), F.lit(SALTS)).cast("int"))
        joined = salted.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"], "left")
    joined = joined.withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    own = _urn(kind, F.col("page_id"), F.col("digest"), F.col("url"))
    http = lambda n: F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    main = _record(
        [("WARC-Type", kind), ("WARC-Record-ID", own), *common,
         ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT_PROFILE))),
         ("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.lit("response"), F.col("first_id"), F.col("digest"), F.col("first_url")))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http(F.col("bytes")), F.when(F.col("revisit"), "").otherwise(F.col("payload"))),
    )
    target = F.coalesce(F.col("url"), F.lit("/"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + END)))
    about = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("via: crawl\r\n"))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], about)
    text = joined.select(F.concat_ws(END, request, main, metadata).alias("value"))
    text.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", max(1, min(FILE_CAPTURES, FILE_BYTES // ((most or 0) + 2048)))).text(path)


def _inflate(data: bytes) -> bytes:
    """A gzip file of any number of members, or plain bytes."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        start, n = end + 4, int(fields["content-length"])
        if start + n > len(data):
            raise ValueError("a record is cut off")
        yield fields, data[start : start + n]
        at = start + n


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind, payload, page = fields.get("warc-type"), None, None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "metadata":
        page = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x).get("page-id")
    return {
        "warc_type": kind, "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "payload_digest": None if payload is None else hashlib.sha256(payload).hexdigest(), "payload_bytes": None if payload is None else len(payload),
        "payload": payload if with_payload else None, "page_id": page,
    }


def read_records(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``; digests and lengths are those of the payloads as read."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(_inflate(content.as_py())):
                    rows.append(_row(fields, block, with_payload))
                    size += len(block)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame, once: bool = False) -> DataFrame:
    """One row per capture: structs ``response``, ``request``, ``metadata``, ``refers_to`` and the payload's figures.

    The three records meet under the identifier of the response; revisits then find the payload that they refer to.
    With ``once`` the captures are checkpointed between the two steps, so the archives are parsed once; that suits
    records read without payloads.
    """
    key = F.coalesce("concurrent_to", "record_id")
    is_main = F.col("warc_type").isin("response", "revisit")
    part = lambda cond, *cols: F.first(F.when(cond, F.struct(*cols)), ignorenulls=True)
    captures = records.groupBy(key.alias("capture_id")).agg(
        F.count(F.when(is_main, 1)).alias("copies"),
        part(is_main, "warc_type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"),
        part(F.col("warc_type") == "request", "record_id", "target_uri").alias("request"),
        part(F.col("warc_type") == "metadata", "record_id", "page_id").alias("metadata"),
    ).filter("copies > 0")
    captures = kept(captures) if once else captures
    revisited = captures.filter(F.col("response.warc_type") == "revisit").select(F.col("response.refers_to").alias("to_id")).distinct()
    origin = (
        captures.join(revisited, F.col("capture_id") == F.col("to_id"), "left_semi")
        .select(F.col("capture_id").alias("to_id"), F.col("metadata.page_id").alias("to_page"), F.col("response.payload_digest").alias("to_digest"), F.col("response.payload_bytes").alias("to_bytes"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # only revisits look for another record; a response's own key never meets another one
    looked_up = captures.withColumns({"to_id": F.coalesce("response.refers_to", "capture_id"), "salt": F.when(F.col("response.refers_to").isNotNull(), F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")).otherwise(-1)})
    out = looked_up.join(origin, ["to_id", "salt"], "left")
    return out.select(
        "capture_id", "request", "response", "metadata",
        F.when(F.col("to_page").isNotNull(), F.struct(F.col("to_id").alias("record_id"), F.col("to_page").alias("page_id"))).alias("refers_to"),
        F.coalesce("response.payload_bytes", "to_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "to_digest").alias("payload_digest"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages`` in the shared folder, reads them back and assembles the captures."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    return assemble(read_records(spark, path, with_payload=False), once=True).select(
        F.col("metadata.page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("response.warc_type").alias("record_type"), F.col("refers_to.page_id").cast(kind).alias("refers_to"),
    )
