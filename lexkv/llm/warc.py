"""WARC archives: writing, reading back, and revisit records for repeated payloads.

A record ends with two line breaks, so Spark's text writer with that separator
writes archives as they are. Repeated payloads are found from headers alone,
shuffled by payload digest; a revisit record refers to the response that keeps
the payload. Reading joins revisits to their responses again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkv.llm.common import arrow_map, batch, materialize, table_path

#: Payloads below this many bytes are always written in full.
LEAST_BYTES = 100
#: Bounds an archive, which is read by one task.
RECORDS_A_FILE = 5000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, page_id long, uri string, date string, digest string, refers_to_id string, payload_bytes long, payload_sha256 string"


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages with payload (html, null: empty), payload_digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of at least least_bytes, the first by
    (page_id, place; null ids last) is the response. Rows are written once with
    their place and digest, which any later scan then finds the same.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = materialize(rows, "warc-rows")
    me = F.struct(F.col("page_id").isNull().alias("no"), "page_id", "rid")
    first = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(me).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("first.rid") != F.col("rid"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("source_rid", F.when(again, F.col("first.rid")).otherwise(F.col("rid"))).withColumn("source_page", F.col("first.page_id"))


def _urn(rid: Column) -> Column:
    h = F.md5(F.concat(F.lit("record-"), rid.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record_text(kind: Column, rid: Column, page: Column, uri: Column, payload: Column, digest: Column, refers: Column) -> Column:
    """One record without its closing line breaks."""
    uri = F.coalesce(F.regexp_replace(uri, r"[\r\n ]", "%20"), F.lit("about:blank"))
    revisit = kind == "revisit"
    body = F.when(revisit, "").otherwise(payload)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF * 2))
    length = (F.octet_length(http) + F.octet_length(body)).cast("string")
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", _urn(rid)), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), ("X-Page-Id", page.cast("string")),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.when(revisit, _urn(refers))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", length),
    ]
    head = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in lines]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *head, F.lit(CRLF), http, body)


def write_archives(plan: DataFrame, path: str) -> None:
    """Write planned() rows as gzip WARC files under path."""
    text = record_text(F.col("record_type"), F.col("rid"), F.col("page_id"), F.col("url"), F.col("payload"), F.col("payload_digest"), F.col("source_rid"))
    plan.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = memoryview(data)
    while len(at):
        z = zlib.decompressobj(31)
        while not z.eof and len(at):
            out = z.decompress(at, 1 << 20)
            at = memoryview(z.unconsumed_tail)if not z.eof else memoryview(z.unused_data)
            if out:
                yield out
            elif not z.eof and not len(at):
                return


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    held, parts = bytearray(), _inflated(data)
    more = True

    def need(n: int) -> bool:
        nonlocal more
        while len(held) < n and more:
            part = next(parts, None)
            more = part is not None
            held.extend(part or b"")
        return len(held) >= n

    while need(1):
        if held[:1] in b"\r\n":
            del held[:1]
            continue
        end = -1
        while (end := held.find(b"\r\n\r\n")) < 0 and need(len(held) + 1):
            pass
        if end < 0:
            raise ValueError("a record's header does not end")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        if not need(end + 4 + n):
            raise ValueError("a record's block does not end")
        yield head, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n]


def _parse(batches):
    for b in batches:
        for content in b["content"]:
            rows = []
            for head, block in records(content.as_py()):
                payload = block.partition(b"\r\n\r\n")[2]
                page = head.get("x-page-id")
                rows.append((head["warc-record-id"], head["warc-type"], int(page) if page else None, head.get("warc-target-uri"), head.get("warc-date"),
                             head.get("warc-payload-digest", "").rpartition(":")[2], head.get("warc-refers-to"), len(payload), hashlib.sha256(payload).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield batch(**{k: pa.array(c, kind) for k, c, kind in zip(names, cols, kinds, strict=True)})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files (gzip or plain) under path, digests recomputed from the blocks."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return arrow_map(files, _parse, SCHEMA, 1)


def resolved(found: DataFrame) -> DataFrame:
    """Records with payload_bytes and payload_digest of the full payload: a revisit takes those of its response."""
    full = found.filter("record_type = 'response'").select(F.col("record_id").alias("original"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("n"), F.col("payload_sha256").alias("sha"))
    asked = found.filter("record_type = 'revisit'").join(full, F.col("refers_to_id") == F.col("original"), "left")
    same = found.filter("record_type <> 'revisit'").select("page_id", "payload_bytes", F.col("payload_sha256").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "record_id")
    return same.unionByName(asked.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.col("original_page").alias("refers_to"), "record_id"))


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as deduplicated archives, read them back and resolve the revisits.

    One row for each row of pages: page_id, payload_bytes, payload_digest,
    record_type, refers_to, record_id. A null html is an empty payload, a null
    url is written as about:blank, a null page_id stays null; of repeated rows
    the first is the response; extra columns are ignored; an empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    path = path or table_path(spark, "warc")
    write_archives(planned(pages), path)
    return resolved(read_archives(spark, path))
