"""WARC archives: pages written as request, response or revisit, and metadata records; captures assembled back.

Records of a capture name each other by concurrent-to identifiers only, and may lie in any
file. Reading gives one row per record; assembly joins requests and metadata to the response
or revisit that they name and emits one nested row per capture. Archives are written and read
by Spark, so they can lie in any store it reaches.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.rows import RID, identified, join_narrow, table
from verdictlake.scale import shared_folder, write_through

LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
CAPTURES_PER_FILE = 2000
RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, fields map<string,string>, payload binary"


def _urn(kind: str, rid: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), rid["f"].cast("string"), rid["i"].cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; line ends in the value are percent-encoded."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record(kind: Column | str, record_id: Column, concurrent: Column, url: Column, block: Column, more: Column, media: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Concurrent-To", concurrent),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", url), more, _line("Content-Type", F.lit(media)),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    # The writer's line end completes the two that close a record.
    return F.concat(head, block, F.lit("\r\n\r"))


def write_archive(rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  least: int = LEAST_REVISIT) -> None:
    """Three records per row of `identified` rows, in gzip files of bounded record numbers under `path`.

    Of rows with equal payloads of at least `least` bytes the one with the smallest id is the
    response (null ids last, then by row identity) and the others revisit it without a
    payload; all smaller payloads are responses. A null body is an empty payload; a null
    address leaves its header out. Repeated rows are captures of their own.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    order = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col(RID).alias("rid"))
    digested = write_through(rows.select(RID, F.col(id_col).alias("_id"), F.octet_length(body).alias("_n"), F.sha2(body, 256).alias("_digest")).filter(F.col("_n") >= least))
    groups = digested.groupBy("_digest").agg(F.count(F.lit(1)).alias("_all"), F.min(order).alias("_first")).filter("_all > 1")
    revisits = write_through(digested.join(groups, "_digest").filter(F.col("_first.rid") != F.col(RID)).select(
        RID, F.col("_first.rid").alias("_target")))
    capture, again = F.col("_capture"), F.col("_target").isNotNull()
    url = F.col(url_col).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(body, 256)))
    refers = _line("WARC-Refers-To", F.when(again, _urn("capture", F.col("_target"))))
    profile = _line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    host = F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/?#\s]*)", 1), F.lit(""))
    target = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#\s]*([^#\s]*)", 1), F.lit("")), F.lit("/"))
    request = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    about = F.concat(_line("page-id", F.col(id_col).cast("string")), F.lit("via: crawl\r\n"))
    records = F.array(
        _record("request", _urn("request", F.col(RID)), capture, url, request, F.lit(""), "application/http;msgtype=request"),
        _record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), capture, F.lit(None).cast("string"), url,
                F.concat(http, F.when(again, F.lit("")).otherwise(body)), F.concat(digest, refers, profile), "application/http;msgtype=response"),
        _record("metadata", _urn("metadata", F.col(RID)), capture, url, about, F.lit(""), "application/warc-fields"))
    joined = join_narrow(rows.select(RID, id_col, url_col, body_col), revisits, [RID], "left", 48)
    joined.withColumn("_capture", _urn("capture", F.col(RID))).select(F.explode(records).alias("value")).write.option(
        "lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """Records of one archive file by their stated lengths; HTTP records are split at their own head."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        if data[at:at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        named = (line.partition(b":") for line in data[at:end].split(b"\r\n")[1:])
        head = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in named}
        block = data[end + 4:end + 4 + int(head["content-length"])]
        at = end + 4 + len(block) + 4
        fields, payload = {}, block
        if head.get("content-type", "").startswith("application/http"):
            first, _, payload = block.partition(b"\r\n\r\n")
            lines = first.split(b"\r\n")
            fields["start"] = lines[0].decode("utf-8", "replace")
        else:
            lines, payload = [b"", *block.split(b"\r\n")], b""
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            if name:
                fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        if "warc-payload-digest" in head:
            fields["payload-digest"] = head["warc-payload-digest"]
        yield {
            "type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "fields": list(fields.items()), "payload": payload}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archive files under `path`; a file, not the archive, is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    kinds = {"fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                records = list(parse(content.as_py()))
                for begin in range(0, len(records), 500):
                    part = records[begin:begin + 500]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[n] for r in part], kinds.get(n, pa.string())) for n in part[0]], names=list(part[0]))

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """capture_id, response, request, metadata: one nested row per response or revisit record.

    Requests and metadata are found by the record that their concurrent-to identifier names;
    of several the one with the smallest record id is taken, a missing one is null. Columns
    besides type, record_id and concurrent_to are nested as they are.
    """
    rest = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    side = lambda kind: records.filter(F.col("type") == kind).filter("concurrent_to is not null").groupBy(
        F.col("concurrent_to").alias("capture_id")).agg(F.min_by(rest, "record_id").alias(kind))
    main = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), rest.alias("response"))
    return main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left").select(
        "capture_id", "response", "request", "metadata")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page, as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(identified(table(spark, folder, "pages")), path)
    narrow = read_archive(spark, path).select(
        "type", "record_id", "concurrent_to", "refers_to", F.col("fields")["page-id"].cast("bigint").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    captures = write_through(assemble(narrow).select(
        "capture_id", F.col("metadata.page_id").alias("page_id"), "response.type", "response.refers_to", "response.bytes", "response.digest"))
    original = captures.filter("type = 'response'").select(
        F.col("capture_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    again = captures.filter("type = 'revisit'").drop("bytes", "digest").join(original, "refers_to", "left")
    return captures.filter("type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to")).unionByName(again.select(
            "page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"),
            F.col("type").alias("record_type"), F.col("_page").alias("refers_to")))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
