"""WARC writing and reading, and assembly of each capture's records.

Writing is native: every record is one string whose end mark is CRLF CRLF, which
Spark's text writer puts between rows as its line separator, so that each part
file is a sequence of WARC/1.1 records (gzip by the Hadoop codec). A capture has
a request record, a response or revisit record, and a metadata record. The
request and metadata records name the response by WARC-Concurrent-To.

Reading takes whole files by Spark's binary reader (any store Spark can read)
and cuts them by Content-Length. ``assemble`` joins the records of a transaction
through WARC-Concurrent-To and gives one nested row per capture.

Payload identity: of rows with equal payloads the one with the largest page_id is the response
(null ids are smallest; among equal ids the largest url hash, and the first of equal rows), the others revisit
it; payloads smaller than ``min_bytes`` are all responses.

Edge cases: a null html is an empty payload; a null url gives the target
``urn:null``; CR and LF in a url are percent-encoded. Every row is written, also those that repeat a page_id or
have none: then record names also carry the url's hash, the payload's digest and a number. An empty
table gives no records and an empty result. A record that is cut short, or whose payload does not have its
digest, is an error.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, join_hot

CRLF = "\r\n"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A file is read whole by one task, so its pages are bounded: pages of at most LONG_PAGE bytes, so many to a file,
RECORDS_PER_FILE = 3_000
LONG_PAGE = 64 << 10
#: and longer ones as many as are at most so many bytes together (one at least).
FILE_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target string, date string, "
    "payload_digest string, payload_bytes bigint, payload binary, fields map<string,string>"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits are 4 base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines: list[Column] = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:  # a null value leaves its line out
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _rows(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), base32_sha1(body).alias("payload_digest"))
    return rows.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).withColumn("tag", F.coalesce(F.sha1("url"), F.lit("null")))


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame, bool]:
    """(rows with the facts of their payload's response, narrow keys of all rows, whether page_ids repeat or lack).

    Groups of equal payloads are found on narrow (page, digest) rows, with partial aggregation and frequent
    payloads broadcast; then the html crosses the network once, by (page, digest).
    """
    scratch = Scratch(pages.sparkSession, "revisits")
    rows = _rows(pages)
    keys = scratch.save(rows.select("page_id", "page", "tag", "payload_bytes", "payload_digest"), "keys")
    repeats = bool(keys.groupBy("page_id").count().filter("count > 1 or page_id is null").limit(1).count())
    one = F.struct("page_id", "tag")
    groups = keys.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(one).alias("best"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "best")
    pairs = scratch.save(keys.select("page", "payload_digest").distinct(), "pairs") if repeats else keys.select("page", "payload_digest")
    facts = join_hot(pairs, groups, "payload_digest", scratch, "hot").filter("best is not null")
    return rows.join(facts.hint("shuffle_hash"), ["page", "payload_digest"], "left"), keys, repeats


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write the three records of every page under ``path``."""
    marked, keys, repeats = mark_revisits(pages.select("page_id", "url", "html"), min_bytes)
    name = lambda kind, page, tag, n: F.concat(F.lit(f"<urn:page:{kind}:"), page, *([F.lit(":"), tag, F.lit(":"), F.col("payload_digest"), F.lit(":"), n.cast("string")] if repeats else []), F.lit(">"))
    if repeats:  # rows that are equal in all columns are told apart by a number
        whole = ["page", "payload_digest", "page_id", "url", "html", "payload_bytes", "tag", "best"]
        marked = marked.groupBy(*whole).agg(F.count("*").alias("copies")).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    else:
        marked = marked.withColumn("n", F.lit(1))
    own = lambda kind: name(kind, F.col("page"), F.col("tag"), F.col("n"))
    best = F.col("best")
    revisit = best.isNotNull() & ~(best["page_id"].eqNullSafe(F.col("page_id")) & (best["tag"] == F.col("tag")) & (F.col("n") == 1))
    url = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("urn:null"))
    common = [("WARC-Target-URI", url), ("WARC-Date", F.lit(date))]
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", own("request")), ("WARC-Concurrent-To", own("response")), *common, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + CRLF + CRLF)),
    )
    response = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", own("response")),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, name("response", F.coalesce(best["page_id"].cast("string"), F.lit("null")), best["tag"], F.lit(1)))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        http,
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", own("metadata")), ("WARC-Concurrent-To", own("response")), *common, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.col("page"), F.lit(CRLF + "payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)),
    )
    mark = CRLF + CRLF
    largest = keys.agg(F.max("payload_bytes")).first()[0] or 0
    kinds = [(F.col("payload_bytes") <= LONG_PAGE, RECORDS_PER_FILE)]
    if largest > LONG_PAGE:
        kinds.append((F.col("payload_bytes") > LONG_PAGE, max(1, FILE_BYTES // largest)))
    for which, records in kinds:
        (
            marked.filter(which).select(F.concat(request, F.lit(mark), response, F.lit(mark), metadata).alias("value"))
            .write.mode("append").option("lineSep", mark).option("compression", compression).option("maxRecordsPerFile", records).option("zlib.compress.level", "BEST_SPEED").text(path)
        )


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of an archive's bytes, plain or gzip (also one member per record)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, n = 0, len(data)
    while at < n:
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].decode("utf-8").split(CRLF)[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        kind, payload, fields = head["warc-type"], None, {}
        if kind in ("response", "revisit"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8").split(CRLF) if ": " in x)
        yield {
            "record_id": head["warc-record-id"], "type": kind, "concurrent_to": head.get("warc-concurrent-to") or None, "refers_to": head.get("warc-refers-to") or None,
            "target": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "payload_bytes": None if payload is None else len(payload), "payload": payload, "fields": list(fields.items()),
        }
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


_ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("date", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
])


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = True) -> DataFrame:
    """One row per record. ``payload=False`` drops the bytes after measuring; ``verify`` compares each response's digest with its payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_records(content.as_py()):
                    if verify and r["type"] == "response" and r["payload_digest"] != base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode():
                        raise ValueError(f"the payload of {r['record_id']} does not have its digest")
                    if not payload:
                        r["payload"] = None
                    rows.append(r)
                    size += len(r["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.mapInArrow(parse, RECORD)


def page_facts(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures that ``write_warc`` made.

    Sizes are those measured when responses were read; a revisit's is that of the response with its digest.
    """
    scratch = Scratch(captures.sparkSession, "captures")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:\w+:(-?\d+)[:>]", 1).try_cast("long")
    r = F.col("response")
    rows = captures.select(number(F.col("capture_id")).alias("page_id"), r["payload_bytes"].alias("own"), r["payload_digest"].alias("payload_digest"), r["type"].alias("record_type"), number(r["refers_to"]).alias("refers_to"))
    rows = scratch.save(rows, "rows")
    responses = rows.filter("record_type = 'response'")
    sizes = responses.groupBy("payload_digest").agg(F.min("own").alias("payload_bytes"))
    revisits = join_hot(rows.filter("record_type <> 'response'"), sizes, "payload_digest", scratch, "hot")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("payload_bytes", F.col("own")).select(*out).unionByName(revisits.select(*out))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata.

    A record belongs to the capture of the response it is concurrent to; a
    response or revisit opens its own. A part that is missing is null. If
    a part is repeated, the one with the smallest record_id is taken. A capture has a few records, so the
    aggregation's groups stay small whatever the input.
    """
    cols = [c for c in records.columns if c != "concurrent_to"]
    owner = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    body = F.struct(*[F.col(c) for c in cols])
    part = lambda *kinds: F.min_by(body, F.when(F.col("type").isin(*kinds), F.col("record_id")))
    return records.withColumn("capture_id", owner).filter("capture_id is not null").groupBy("capture_id").agg(
        part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata")
    )
