"""Content-addressed web archive.

``write_archive`` splits records into two tables in the shared folder: exact header
bytes of every record, and each distinct payload once, under its SHA-256 digest.
``read_archive`` verifies every stored payload against its digest and length and joins
it back to the headers; ``record_bytes`` yields the original WARC/1.1 records.

Payloads move once: only their digests are grouped, and the pages that hold the kept
copy are found by a join, so a payload shared by a third of all records makes no large
group. On reading, digests and lengths are taken from the stored payloads before the
join; the payload itself is joined only if a caller selects it.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import require, table, written

#: The digits of a number in base 32, and RFC 4648's letters for them.
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    """``headers``: header, digest, page_id, record_type, refers_to; ``payloads``: digest, payload, n_bytes."""

    headers: DataFrame
    payloads: DataFrame


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hexadecimal digits are eight groups of 20 bits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), BASE32_DIGITS, BASE32_LETTERS)


def write_archive(pages: DataFrame, min_bytes: int = 0) -> Archive:
    """Archive ``pages`` (page_id, url, html); other columns are ignored.

    Of records whose payloads are equal and of at least ``min_bytes`` bytes, that with
    the largest page_id is the response and the others revisit it. Smaller payloads are
    all responses. A null html is an empty payload, a null url leaves its header out, and
    a null page_id counts as smaller than any other. Rows that repeat both page_id and
    payload of a response are responses too. Tabs, line ends, spaces and percent
    signs of urls are percent-encoded, so that a url cannot add header lines.
    """
    require(pages, ("page_id", "url", "html"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    keyed = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    keyed = written(keyed, "warc-keys")
    kept = keyed.groupBy("digest").agg(F.max("page_id").alias("response_id"))
    holders = written(kept, "warc-responses")
    payloads = written(_holders(rows, holders), "warc-payloads")

    control = F.replace(F.col("url"), F.lit("%"), F.lit("%25"))
    for code in (9, 10, 13, 32):
        control = F.replace(control, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    big = F.col("n_bytes") >= F.lit(min_bytes)
    revisit = big & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", control),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("response_id").cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("n_bytes").cast("string")),
        F.lit("\r\n"),
    )
    headers = keyed.join(holders, "digest").select(F.encode(header, "UTF-8").alias("header"), "digest")
    return Archive(written(headers, "warc-headers"), payloads)


def _holders(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """One row for each digest, from the page that is its response.

    The join and the removal of repeated rows both go by page_id, so payloads are
    shuffled once; payloads that only records without a page_id hold go by digest.
    """
    keyed = rows.select("page_id", F.sha2("payload", 256).alias("digest"), "payload")
    named = keyed.where(F.col("page_id").isNotNull()).join(holders.withColumnRenamed("response_id", "page_id"), ["page_id", "digest"])
    named = named.dropDuplicates(["page_id", "digest"]).select("digest", "payload")
    other = keyed.where(F.col("page_id").isNull()).join(holders.where(F.col("response_id").isNull()).select("digest"), "digest")
    other = other.select("digest", "payload").dropDuplicates(["digest"])
    return named.unionByName(other).withColumn("n_bytes", F.octet_length("payload").cast("long"))


def read_archive(archive: Archive) -> DataFrame:
    """Every record: header, page_id, record_type, refers_to, payload_digest, payload_bytes, payload.

    Header fields are parsed from the stored header bytes. Each stored payload is held
    against its strong digest and against the digest and length that the header names; a
    difference or a missing payload stops the read.
    """
    text = F.decode("header", "UTF-8")
    field = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    headers = archive.headers.select(
        "header", "digest",
        field(r"WARC-Record-ID: <urn:page:(-?\d+)>").cast("long").alias("page_id"),
        field(r"WARC-Type: (\w+)").alias("record_type"),
        field(r"WARC-Refers-To: <urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        field(r"WARC-Payload-Digest: sha1:(\w+)").alias("named"),
        field(r"Content-Length: (\d+)").cast("long").alias("length"),
    )
    stored = archive.payloads.select(
        F.col("digest").alias("stored_digest"), "payload",
        F.when(F.sha2("payload", 256) == F.col("digest"), base32_sha1(F.col("payload"))).otherwise(F.raise_error(F.lit("a stored payload differs from its digest"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    joined = headers.join(stored, headers["digest"] == stored["stored_digest"], "left")
    sound = (F.col("payload_digest") == F.col("named")) & (F.col("payload_bytes") == F.col("length"))
    return joined.select(
        "header", "page_id", "record_type", "refers_to",
        F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload is missing or differs from its header"))).alias("payload_digest"),
        "payload_bytes", "payload",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """``records`` with ``warc``: the record as it stands in a WARC file; revisits carry no block."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("warc", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, plain or of gzip members."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:end].decode("utf-8").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = 0 if fields.get("WARC-Type") == "revisit" else int(fields.get("Content-Length", 0))
        yield fields, data[end : end + size]
        at = end + size + 4


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(write_archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), k AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex, n) AS response_id FROM k
), b AS (
  SELECT page_id, n, response_id,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
        (CAST('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2) AS BIGINT) >> (8 - 5 - (5 * i) % 4)) & 31
      ) AS INT), 1)), 'string_agg', '') AS digest
  FROM g
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
FROM b
"""
