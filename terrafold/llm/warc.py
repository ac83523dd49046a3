"""Content-addressed WARC archive.

Writing gives two tables in the shared folder. ``payloads`` holds each distinct payload once, under its SHA-256. ``headers`` holds
one row per record: the exact bytes of its WARC header and of the HTTP header inside its block, and the key of its payload. Of
equal payloads the record with the smallest id is the response, the others are revisits that refer to it; a revisit's block has
no payload. Reading joins the tables again, puts the exact bytes of each record together (``records``), and checks
lengths and digests.

Texts are hashed where they are read. Only (id, key) is grouped to find the responses, with a partial minimum, so a payload that a
third of all records share is one aggregated row. Only payloads that a bitmap of the shared keys lets through are shuffled on
writing (a bitmap that many shared keys have filled lets more through, and the exact join after it decides alike). Equal keys are verified: payloads of one key must be of one length and
reread payloads must hash to their key.

Null or empty html: an empty payload. Rows with equal ids and payloads are one page repeated: the first is no different, each
gets a record, all of them the response. Null ids come last and have no name of their own. An empty table makes an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_batches, folder, id_bitmap, perhaps, release, stored

#: Payloads of fewer bytes are always responses. 0: every equal payload is shared.
SMALLEST = 0
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def one_line(text: str | None) -> str:
    """A header value may not hold a line break."""
    return " ".join((text or "").split())


def header(page, url, digest: str, size: int, refers, refers_url, date: str) -> tuple[bytes, bytes]:
    """(WARC header, HTTP header) of a record, both with their closing empty line."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {one_line(url)}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers)}", f"WARC-Refers-To-Target-URI: {one_line(refers_url)}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archive(pages: DataFrame, path: str, html: str = "html", ids: str = "page_id", url: str = "url",
                  smallest: int = SMALLEST, date: str = DATE) -> None:
    """Write the records of all pages to ``path``/headers and ``path``/payloads."""
    spark = pages.sparkSession
    arrow_batches(spark)
    rows = pages.select(F.col(ids).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    small = stored(keyed.select("page_id", "url", "key", "size", F.base64(F.unhex(F.sha1("payload"))).alias("sha1")))
    by_key = small.groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("head"),
                                      F.min("size").alias("low"), F.max("size").alias("high"), F.count(F.lit(1)).alias("n"))
    by_key = stored(by_key.select("key", "n", F.when(F.col("low") == F.col("high"), F.col("head")).otherwise(
        F.raise_error(F.concat(F.lit("payloads of different length under digest "), F.col("key")))).alias("head")))
    joined = small.join(by_key, "key").select("page_id", "url", "key", "size", "sha1", F.col("head.page_id").alias("head"), F.col("head.url").alias("head_url"))

    def compose(batches):
        for batch in batches:
            out = []
            for page, address, key, size, sha1, head, head_url in zip(*(c.to_pylist() for c in batch.columns)):
                same = size < smallest or head is None or page == head
                digest = base64.b32encode(base64.b64decode(sha1)).decode()
                out.append((page, key, *header(page, address, digest, size, None if same else head, head_url, date)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.binary(), pa.binary()))],
                                                 ["page_id", "key", "warc", "http"])

    (joined.mapInArrow(compose, "page_id long, key string, warc binary, http binary")
     .write.parquet(f"{path}/headers"))
    # One copy of each payload: the bytes of the response's page. A payload of one record is written where it is read. A bitmap
    # of the shared keys, of fixed size, tells which rows need a closer look: they are dealt out by key and page, which
    # spreads the copies of a frequent payload and also brings the repeated rows of one page together.
    mark = F.xxhash64("key")
    shared = by_key.where("n > 1")
    bits = spark.sparkContext.broadcast(id_bitmap(shared.select(mark.alias("mark"))))
    marked = keyed.select("page_id", "key", "payload", mark.alias("mark")).withColumn("perhaps", perhaps("mark", bits))
    alone = marked.where("not perhaps").select("key", "payload")
    slot = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    heads = by_key.select("key", F.coalesce(F.col("head.page_id").cast("string"), F.lit("-")).alias("slot"), F.xxhash64("key").alias("mark"))
    heads = heads.withColumn("perhaps", perhaps("mark", bits)).where("perhaps").select("key", "slot")
    copies = marked.where("perhaps").select("key", slot.alias("slot"), "payload").join(heads, ["key", "slot"], "left_semi")
    first = copies.dropDuplicates(["key", "slot"]).select("key", "payload")
    alone.unionByName(first).write.parquet(f"{path}/payloads")
    release(small, by_key)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, key, payload, record): every record of an archive, byte for byte, and its full payload.

    A revisit's record ends after its HTTP header; its payload comes from the store all the same.
    """
    headers = spark.read.schema("page_id long, key string, warc binary, http binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")
    revisit = F.instr(F.col("warc").cast("string"), "WARC-Type: revisit") > 0
    body = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    return headers.join(payloads, "key", "left").select(
        "page_id", "key", "payload", F.concat("warc", body, F.lit(END)).alias("record"))


def fields(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named header fields and the block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/") or not rest.endswith(END):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]), rest[:-len(END)]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    The record is parsed from its bytes; its lengths and both digests are checked, and a mismatch fails the job.
    """
    arrow_batches(spark)

    def parse(batches):
        for batch in batches:
            out = []
            for page, key, payload, record in zip(*(c.to_pylist() for c in batch.columns)):
                if payload is None:
                    raise ValueError(f"payload {key} of page {page} is missing")
                named, block = fields(record)
                kind = named["WARC-Type"]
                digest = sha1_base32(payload)
                if (hashlib.sha256(payload).hexdigest() != key or named["WARC-Payload-Digest"] != f"sha1:{digest}"
                        or int(named["Content-Length"]) != len(block) or named["WARC-Record-ID"] != record_id(page)
                        or (kind == "response" and block.partition(b"\r\n\r\n")[2] != payload)):
                    raise ValueError(f"record of page {page} does not match its digests or lengths")
                out.append((page, named["WARC-Target-URI"], key, len(payload), digest, kind, named.get("WARC-Refers-To"), named["WARC-Record-ID"]))
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 ["page_id", "url", "key", "payload_bytes", "payload_digest", "record_type", "refers", "name"])

    parsed = records(spark, path).mapInArrow(
        parse, "page_id long, url string, key string, payload_bytes long, payload_digest string, record_type string, refers string, name string")
    return parsed


def archive(pages: DataFrame, html: str = "html", ids: str = "page_id", url: str = "url", path: str | None = None, **settings) -> DataFrame:
    """Write the pages to an archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or folder(spark)
    write_archive(pages, path, html, ids, url, **settings)
    read = stored(read_archive(spark, path))  # parsed fields only
    # WARC-Refers-To names a record: the response of that name, which must hold the same payload.
    named = (read.where("record_type = 'response'").groupBy("key", F.col("name").alias("refers"))
             .agg(F.first("page_id").alias("target"), F.lit(True).alias("found")))
    joined = read.join(named, ["key", "refers"], "left")
    refers_to = F.when(F.col("record_type") == "revisit", F.when(F.col("found"), F.col("target")).otherwise(
        F.raise_error(F.concat(F.lit("no response of the payload is named "), F.coalesce("refers", F.lit("null")))).cast("long")))
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", refers_to.alias("refers_to"))
