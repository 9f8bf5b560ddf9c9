"""Content-addressed WARC archive.

``write_archive`` keeps every payload once, compressed, under its SHA-256, and every record's exact header
bytes apart from it; ``read_archive`` joins the two back into whole records. Of records with equal payloads
the one with the largest id is the response, the others revisit it. Both tables lie in a folder all
executors share. Nothing is gathered per payload: a payload that a third of the pages share costs one
combined aggregate and one join that adaptive execution can split.

Digests are verified twice: equal SHA-256 with unequal length or SHA-1 stops the write, and reading
hashes the stored bytes anew and holds every rebuilt record against its header (SHA-1 of the payload,
length of the content); a difference stops the read.

Defined results: a null payload is the empty one; rows with equal id and payload share their type;
a row with a null id is a response only where its whole group has null ids, and refers to the
group's largest id otherwise; a null target is written as an empty URI; an empty table gives none.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import bound_batches, trimmed

ID_PREFIX = "urn:papyrine:record:"
WARC_DATE = "2024-01-01T00:00:00Z"
#: The digits that base conversion writes, and those of RFC 4648 base32 in the same order.
RADIX_32, BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest whose length is a multiple of 20 bits, such as SHA-1."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), RADIX_32, BASE_32)


def _header(kind: Column, rid: Column, uri: Column, sha1: Column, refers: Column, size: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(rid)),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(refers)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
        F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write ``path``/payloads (digest, packed) and ``path``/headers (id, digest, header)."""
    bound_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    # Every payload leaves its task compressed, at most once per digest; equal digests are checked against each other.
    packed = rows.select("digest", "sha1", "size", "payload").mapInArrow(_packed, "digest string, sha1 string, size int, packed binary")
    store = packed.groupBy("digest").agg(F.first("packed").alias("packed"), F.min("sha1").alias("a"), F.max("sha1").alias("b"), F.min("size").alias("c"), F.max("size").alias("d"))
    same = (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    checked = F.when(same, F.col("packed")).otherwise(F.raise_error(F.concat(F.lit("digest collision: "), "digest")).cast("binary"))
    store.select("digest", checked.alias("packed")).write.option("compression", "none").parquet(f"{path}/payloads")
    small = rows.select("id", "uri", "digest", "sha1", "size")
    heads = small.groupBy("digest").agg(F.max("id").alias("head"))
    kind = F.when(F.col("id").eqNullSafe(F.col("head")), "response").otherwise("revisit")
    records = small.join(heads, "digest").withColumn("kind", kind)
    header = _header(F.col("kind"), F.col("id"), F.col("uri"), base32_of_hex(F.upper("sha1")), F.col("head"), F.col("size"))
    records.select("id", "digest", header.alias("header")).write.parquet(f"{path}/headers")


def parse_headers(headers: DataFrame) -> DataFrame:
    """Append what the exact header bytes say: record_type, payload_digest and refers_to (null without the field)."""
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    refers = field("WARC-Refers-To", f"<{ID_PREFIX}(-?\\d+)>")
    return headers.withColumns(
        {
            "record_type": field("WARC-Type", "([a-z]+)"),
            "payload_digest": field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)"),
            "refers_to": F.when(refers != "", refers).cast("long"),
        }
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: id, digest, record_type, payload_digest, refers_to, header, payload (of revisits too) and the record's bytes."""
    bound_batches(spark)
    parsed = parse_headers(spark.read.parquet(f"{path}/headers"))
    both = parsed.join(spark.read.parquet(f"{path}/payloads"), "digest")
    names = [c for c in both.columns if c != "packed"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name != "packed") + ", payload binary, record binary"
    return both.select(*names, "packed").mapInArrow(_rebuilt, schema)


def write_packed(payload: bytes) -> bytes:
    """A payload as it is stored."""
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(payload)


@trimmed
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the last column; the others pass."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    for batch in batches:
        stored = pa.array([pack(p.as_buffer()) for p in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stored], names=[*batch.schema.names[:-1], "packed"])


def _record(digest: str, kind: str, sha1: str, header: bytes, packed: pa.Scalar, unpack) -> tuple[bytes, bytes]:
    """(payload, record), held against the stored digest and against what the header says."""
    payload = unpack(packed)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload: {digest}")
    body = payload if kind == "response" else b""
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha1 or b"\r\nContent-Length: %d\r\n" % len(body) not in header:
        raise ValueError(f"header and payload differ: {digest}")
    return payload, b"".join((header, body, b"\r\n\r\n"))


#: Bytes of rebuilt records that go back to the JVM at once (one record at least).
RECORD_BYTES = 4 << 20


@trimmed
def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of the header, then packed; the latter is replaced by the payload and the whole record."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        names, rest = batch.schema.names[:-1], batch.columns[:-1]
        digest, kind, sha1, header = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("digest", "record_type", "payload_digest", "header"))
        made, begin, size = [], 0, 0
        for i, packed in enumerate(batch.column(batch.num_columns - 1)):
            made.append(_record(digest[i], kind[i], sha1[i], header[i], packed.as_buffer(), unpack))
            size += len(made[-1][0]) + len(made[-1][1])
            if size >= RECORD_BYTES or i + 1 == batch.num_rows:
                new = [pa.array(c, pa.binary()) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, len(made)) for c in rest), *new], names=[*names, "payload", "record"])
                made, begin, size = [], i + 1, 0
