"""WARC archives: writing captures as records, reading archives, and assembling transactions.

Each capture is written as a request, a response (or a revisit of one) and a metadata record; request and
metadata name the response by WARC-Concurrent-To.  Archives are read record by record by their content
length, and records that name the same response are joined into one nested row per capture.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Payloads shorter than this are never replaced by a revisit.
MIN_REVISIT = 100
#: Records of one archive file; with it a file's size is bounded by that many of the largest captures.
RECORDS_PER_FILE = 3000
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _uuid(*parts: Column) -> Column:
    """A record id in UUID form made from the parts alone."""
    h = F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; those with a null value are left out, and control signs in values are escaped."""
    return F.concat_ws("", *[F.concat(F.lit(f"{k}: "), F.regexp_replace(v.cast("string"), r"[\x00-\x1F\x7F]", "%20"), F.lit(END)) for k, v in pairs])


def _record(kind: str, block: Column, *pairs: tuple[str, Column]) -> Column:
    head = _lines(("WARC-Type", F.lit(kind)), *pairs, ("Content-Length", F.octet_length(block)))
    return F.concat(F.lit("WARC/1.1" + END), head, F.lit(END), block)


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a request, a response or revisit, and a metadata record for every row of pages.

    pages has page_id, url, html.  Null html is an empty payload.  Of rows with equal payloads of at least
    MIN_REVISIT bytes the one with the smallest page_id is the response and the others revisit it; a row
    with a null page_id is never the one revisited.  Rows equal in all three columns share record ids.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    kept = f"{path}-repeated"
    (
        rows.where((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
        .write.parquet(kept)
    )
    joined = rows.join(spark.read.parquet(kept), "digest", "left")
    again = F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first.page_id"), F.lit(True))
    own, when = _uuid(F.lit("response"), F.col("page_id"), F.col("url"), F.col("digest")), F.lit(date)
    common_lines = (("WARC-Date", when), ("WARC-Target-URI", F.col("url")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", F.concat(http, F.col("html")), ("WARC-Record-ID", own), *common_lines, digest, kind)
    revisit = _record(
        "revisit", http, ("WARC-Record-ID", own), *common_lines, digest, kind, ("WARC-Profile", F.lit(IDENTICAL)),
        ("WARC-Refers-To", _uuid(F.lit("response"), F.col("first.page_id"), F.col("first.url"), F.col("digest"))), ("WARC-Refers-To-Target-URI", F.col("first.url")),
    )
    about = lambda what, block, kind: _record(what, block, ("WARC-Record-ID", _uuid(F.lit(what), F.col("page_id"), F.col("url"), F.col("digest"))), ("WARC-Concurrent-To", own), *common_lines, ("Content-Type", F.lit(kind)))
    target = F.regexp_replace(F.coalesce("url", F.lit("/")), r"[\x00-\x20]", "%20")
    request = about("request", F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{END}{END}")), "application/http; msgtype=request")
    metadata = about("metadata", _lines(("pageId", F.col("page_id"))), "application/warc-fields")
    records = joined.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))
    # Every record ends with two line ends, which the writer puts behind each row.
    records.write.option("lineSep", END * 2).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _headers(data: memoryview | bytes) -> dict[str, str]:
    lines = bytes(data).decode("utf-8", "replace").split(END)
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, found by content length alone."""
    at = 0
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 2
            continue
        if content[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = content.index(b"\r\n\r\n", at)
        headers = _headers(content[at:end])
        size = int(headers["content-length"])
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size


RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, intact boolean, page_id long, payload binary"


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under path.  payload_digest is recomputed from a response's
    payload (intact says whether it is the one its header names); a revisit has those of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse(content.as_buffer().to_pybytes()):
                    kind = h.get("warc-type")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    row = {"type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date")}
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        own = hashlib.sha256(payload).hexdigest() if kind == "response" else digest
                        size = len(payload) if kind == "response" else int(_headers(head)["content-length"])
                        row |= {"payload_digest": own, "payload_bytes": size, "intact": own == digest, "payload": payload if payloads and kind == "response" else None}
                    elif kind == "metadata":
                        page = _headers(b"\r\n" + block).get("pageid")
                        row["page_id"] = int(page) if page else None
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    s, i = pa.string(), pa.int64()
    schema = pa.schema([("type", s), ("record_id", s), ("concurrent_to", s), ("refers_to", s), ("target_uri", s), ("date", s), ("payload_digest", s), ("payload_bytes", i), ("intact", pa.bool_()), ("page_id", i), ("payload", pa.binary())])
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata.

    A record belongs to the response that it is concurrent to.  Of records of one kind in a capture any
    stands for all (they are equal); a capture written several times gives as many rows.  Records whose
    response is missing give a row without it.
    """
    common_fields = ["record_id", "target_uri", "date"]
    pick = lambda kinds, *more: F.first(F.when(F.col("type").isin(*kinds), F.struct("type", *common_fields, *more)), ignorenulls=True)
    answer = F.col("type").isin("response", "revisit")
    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        pick(["request"]).alias("request"),
        pick(["response", "revisit"], "payload_digest", "payload_bytes", "intact", "refers_to", "payload").alias("response"),
        pick(["metadata"], "page_id").alias("metadata"),
        F.greatest(F.count_if(answer), F.lit(1)).cast("int").alias("times"),
    )
    return grouped.withColumn("time_", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time_")


def captures(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture in the archives."""
    nested = assemble(read(spark, path, payloads=False))
    flat = nested.select("capture_id", F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"))
    written = f"{path}-captures"
    flat.write.parquet(written)
    flat = spark.read.parquet(written)
    named = flat.where("record_type = 'revisit'").select(F.col("target").alias("capture_id")).distinct()
    targets = flat.join(named, "capture_id", "left_semi").groupBy(F.col("capture_id").alias("target")).agg(F.first("page_id").alias("refers_to"))
    plain = flat.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    again = flat.where("record_type = 'revisit'").join(targets, "target", "left")
    return plain.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    return captures(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
