"""A content-addressed web archive: payload bytes once by strong digest, exact headers beside, records by join.

The archive is a folder with two Parquet tables. blocks holds each different payload once: sha256, sha1,
length, owner (the least id of its records) and the bytes. headers holds one row a record: id, the exact
header bytes and the payload's sha256. A record is header + payload + CRLF CRLF, put together by a join; what a
record says, its type, digest, length and the record that it refers to, is read from those bytes alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged

#: Fixed values of the WARC 1.1 format and of RFC 4648 base32.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a hex digest whose bits are a multiple of 20, such as SHA-1's 160."""
    chunk = lambda g: F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
    letter = lambda n: F.substring(F.lit(BASE32), n + 1, F.lit(1))
    return F.concat(*[letter(F.shiftright(chunk(g), s).bitwiseAND(F.lit(31))) for g in range(8) for s in (15, 10, 5, 0)])


def _uuid(digest: Column) -> Column:
    """A name-based UUID (version 8, free form) from a hex digest."""
    part = lambda i, n: F.substring(digest, i, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "2020-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> None:
    """Writes one record for each row of pages to the archive in folder.

    The payload is the column's UTF-8 bytes, none for null. Of records with equal payloads of at least
    min_revisit_bytes bytes the one with the least id is the response and others revisit it; below that
    all are responses. Rows that repeat, id included, are each written; those with the least id are all
    responses. A null id comes after all others and counts as revisiting. A null address has no
    WARC-Target-URI line; control characters and blanks in addresses are percent-encoded, so a header
    can't be broken by one. Other columns of pages are not read.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    blocks = rows.groupBy("sha256").agg(F.min("id").alias("owner"), F.first("payload").alias("payload"))
    blocks = blocks.select("sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"), "owner", "payload")
    blocks.write.parquet(f"{folder}/blocks")

    known = pages.sparkSession.read.schema(blocks.schema).parquet(f"{folder}/blocks").select(F.col("sha256").alias("digest"), "sha1", "length", "owner")
    records = rows.drop("payload").join(known, F.col("sha256") == F.col("digest")).drop("digest")
    revisit = (F.col("length") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("owner"))
    name = lambda n: F.concat(F.lit("<urn:uuid:"), _uuid(F.sha2(F.concat(F.coalesce(n.cast("string"), F.lit("null")), F.lit("/"), F.col("sha256")), 256)), F.lit(">"))
    uri = F.col("uri")
    for c in (*range(33), 127):
        uri = F.replace(uri, F.lit(chr(c)), F.lit(f"%{c:02X}")) if c else uri
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    none = F.lit("")
    header = F.concat(
        F.lit(VERSION + CRLF),
        F.when(revisit, line("WARC-Type", F.lit("revisit"))).otherwise(line("WARC-Type", F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.when(uri.isNotNull(), line("WARC-Target-URI", uri)).otherwise(none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("owner"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=UTF-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.lit(CRLF),
    )
    records.select("id", F.encode(header, "UTF-8").alias("header"), "sha256").write.parquet(f"{folder}/headers")


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, record): the bytes of each record as a WARC file holds them, put together from headers and blocks.

    What type a record is says its header. Revisits hold no payload and need no block, so a payload that very
    many records share is joined with its response alone.
    """
    blocks = spark.read.parquet(f"{folder}/blocks").select(F.col("sha256").alias("digest"), "payload")
    headers = spark.read.parquet(f"{folder}/headers").select("id", "header", "sha256")
    revisit = _field(F.decode("header", "UTF-8"), "WARC-Type") == "revisit"
    end = F.lit(b"\r\n\r\n")
    whole = headers.where(~revisit).join(blocks, F.col("sha256") == F.col("digest")).select("id", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(headers.where(revisit).select("id", F.concat("header", end).alias("record")))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each record, parsed from read_records() alone.

    A response's size and digest are those of the payload that its record holds; it has to be as long as the
    header says, to match the header's digest and to end as records do, or the job stops. A revisit gets size and
    digest of the record that it refers to, which has to have the digest that the revisit's header names.
    """
    record = F.col("record")
    header = F.substring_index(record.cast("string"), "\r\n\r\n", 1)
    fields = {"type": "WARC-Type", "name": "WARC-Record-ID", "sha1": "WARC-Payload-Digest", "to": "WARC-Refers-To", "length": "Content-Length"}
    at = F.octet_length("head") + F.lit(5)
    parsed = read_records(spark, folder).select("id", "record", header.alias("head"))
    parsed = parsed.select("id", *[_field(F.col("head"), v).alias(k) for k, v in fields.items()], F.substring("record", at, F.octet_length("record") - at - F.lit(3)).alias("payload"), F.hex(F.substring("record", F.octet_length("record") - F.lit(3), F.lit(4))).alias("tail"))
    parsed = parsed.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32(F.sha1("payload"))})
    whole = (F.col("tail") == "0D0A0D0A") & (F.col("bytes") == F.col("length").cast("long"))
    whole = whole & ((F.col("type") == "revisit") | (F.concat(F.lit("sha1:"), F.col("digest")) == F.col("sha1")))
    parsed = parsed.withColumn("broken", F.assert_true(whole, "a record does not match its header")).where("broken is null").drop("payload", "tail", "broken")
    parsed = Staged(parsed, "parsed").df  # payloads are read once
    responses = parsed.where("type = 'response'")
    # records that repeat an id have one name; a revisit refers to any of them
    named = responses.groupBy(F.col("name").alias("of")).agg(F.first("id").alias("owner"), F.first("bytes").alias("own_bytes"), F.first("digest").alias("own_digest"))
    revisits = parsed.where("type = 'revisit'").join(named, F.col("to") == F.col("of"), "left")
    same = F.assert_true(F.coalesce(F.concat(F.lit("sha1:"), F.col("own_digest")) == F.col("sha1"), F.lit(False)), "a revisit does not match what it refers to")
    revisits = revisits.withColumn("broken", same).where("broken is null")
    columns = lambda size, digest, to: ["id", F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), F.col("type").alias("record_type"), to.alias("refers_to")]
    out = responses.select(*columns("bytes", "digest", F.lit(None).cast("long")))
    return out.unionByName(revisits.select(*columns("own_bytes", "own_digest", F.col("owner"))))


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The headers and blocks of concatenated records, for tests and for files from elsewhere."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        out.append((fields, data[start:stop]))
        at = stop + 4
    return out
