"""WARC archives with revisit resolution.

1. Headers only (id, payload digest, payload length) are shuffled by digest: records of equal payload of at
   least ``min_bytes`` bytes have one response, the record with the largest id; the others revisit it.
   Equal digests are one group whatever their size; the winner is a partial aggregate (``max``), and the
   join back is a plain equi-join that adaptive execution can split for a hot digest.
2. Each task writes WARC/1.1 records, one gzip member each, with fresh headers: responses with their
   payload, revisits with headers only (profile ``identical-payload-digest`` and ``WARC-Refers-To``).
   Files roll after ``roll_bytes``.  The stored manifest of finished files decides what counts, so a task
   that runs again after the loss of an executor cannot add records twice.
3. Reading parses the files of the manifest record by record, checks digests of responses, and joins the
   revisits to their responses by record id.

The list of revisits (ids and digests) is joined to the pages; while it is small enough for adaptive
execution to broadcast, payloads are not shuffled at all, beyond that they are shuffled once, by id.

Cases: null html is the empty payload; with ``min_bytes`` 0 empty payloads are equal to each other.  Rows
that share the winning id are all written as responses (their record ids are equal too, and readers see
each).  A null id loses to any other; a group with null ids only has them as responses.  A null url is an
empty target.  An empty table writes no file and reads as an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLL_BYTES = 32_000_000  # compressed bytes per archive
MIN_BYTES = 0            # payloads below this are never revisits
GZIP_LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # capture date where the table has none
READ_BLOCK = 1 << 20

RECORD = ("page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, "
          "payload_digest string")


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def header_value(text: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool,
                 date: str = DATE) -> bytes:
    digest = digest_of(payload)
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {header_value(url)}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
            f"X-Page-Id: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}"]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_records(stream):
    """(headers, block) of each record of an archive of gzip members, one record in memory at a time."""
    pending = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not pending:
                pending = stream.read(READ_BLOCK)
                if not pending:
                    if parts:
                        raise ValueError("archive ends within a record")
                    return
            parts.append(z.decompress(pending))
            pending = z.unused_data
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield headers, rest[:int(headers["Content-Length"])]


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
                     min_bytes: int = MIN_BYTES) -> DataFrame:
    """(digest, length, winner) of the payloads that occur under more than one id."""
    payload = F.encode(common.text_or_empty(payload_col), "UTF-8")
    heads = pages.select(F.col(id_col).cast("long").alias("_page"), F.unhex(F.sha1(payload)).alias("_digest"),
                         F.length(payload).cast("long").alias("_len"))
    return (heads.filter(F.col("_len") >= min_bytes).groupBy("_digest", "_len")
            .agg(F.max("_page").alias("_winner"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as archives below ``out``; return the stored manifest (path, records, bytes)."""
    spark = pages.sparkSession
    common.small_batches(spark, 128)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        common.text_or_empty(payload_col).alias("html"))
    payload = F.encode("html", "UTF-8")
    # the winner of each repeated payload goes to the ids that hold it: headers only on both sides
    held = rows.select(F.col("page_id").alias("_page"), F.unhex(F.sha1(payload)).alias("_digest"),
                       F.length(payload).cast("long").alias("_len"))
    repeated = resolve_revisits(pages, id_col, payload_col, min_bytes)
    revisits = common.staged(held.join(repeated, ["_digest", "_len"])
                             .filter(~F.col("_page").eqNullSafe(F.col("_winner")))
                             .select("_page", "_digest", "_winner").distinct(), "warc-revisits")
    marked = rows.join(revisits, rows.page_id.eqNullSafe(revisits["_page"])
                       & (F.unhex(F.sha1(payload)) == revisits["_digest"]), "left").select(
        "page_id", "url", "html", F.col("_digest").isNotNull().alias("revisit"), F.col("_winner").alias("winner"))

    def write(batches):
        held, size, n, done = [], 0, 0, []

        def flush():
            uri = f"{out}/pages-{common.partition_id():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
            common.write_file(uri, b"".join(held))
            done.append((uri, n, size))

        for page_id, url, html, is_revisit, winner in common.arrow_rows(batches, "page_id", "url", "html", "revisit", "winner"):
            held.append(gzip_member(record_bytes(page_id, url, html.encode(), winner, is_revisit)))
            size, n = size + len(held[-1]), n + 1
            if size >= roll_bytes:
                flush()
                held, size, n = [], 0, 0
        if held:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))],
                                             names=["path", "n_records", "n_bytes"])

    return common.staged(marked.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives, revisits resolved to the id and length of their response."""
    # as many partitions as files: without a number, adaptive execution puts the few bytes of the manifest into one task
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")

    def read(batches):
        for (uri,) in common.arrow_rows(batches, "path"):
            f, path = common.open_fs(uri)
            found = []
            with f.open_input_stream(path) as src:
                for head, block in read_records(src):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        length = len(payload)
                        if digest_of(payload) != digest:
                            raise ValueError(f"payload digest differs in {uri}")
                    page = head["X-Page-Id"]
                    found.append((int(page) if page else None, head["WARC-Record-ID"], kind, head.get("WARC-Refers-To"), length, digest))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                names=["page_id", "record_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest"])

    records = common.staged(files.mapInArrow(read, RECORD), "warc-records")
    responses = (records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id"))
                 .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes")))
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes").join(responses, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns)
            .unionByName(revisits.withColumnRenamed("_bytes", "payload_bytes").select(columns)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of ``pages``, read back."""
    out = common.new_path(spark, "warc")
    return read_archives(write_archives(common.table(spark, sf_dir, "pages"), out))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages
), w AS (
  SELECT hex, payload_bytes, max(page_id) AS winner FROM p WHERE payload_bytes >= 0 GROUP BY hex, payload_bytes
), base32 AS (
  SELECT hex, payload_bytes, winner,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31)::BIGINT, 1)), '') AS digest
  FROM w
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS NOT DISTINCT FROM winner THEN NULL ELSE winner END AS refers_to
FROM p JOIN base32 b ON p.hex = b.hex AND p.payload_bytes = b.payload_bytes
"""
