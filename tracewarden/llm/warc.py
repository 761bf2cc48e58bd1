"""WARC archives with revisit resolution.

Records are written as WARC/1.1 text through Spark's own writer (a record is its header block, its block and
the closing blank lines), so any store works and a lost executor's files are never committed. Archives are
gzip members named ``part-*.txt.gz``. Revisits are resolved on headers: digests that occur more than once are
aggregated to their original (one row per digest, combined before the shuffle), and only that table meets the
records again.

Edge cases: a null payload is empty; a null uri leaves its header out, and line breaks in one are percent-encoded;
of records with equal digest, length and key all are written as responses if that key is the original's; a
revisit that comes in without an original among the records keeps what it refers to; an empty table writes
archives without records; columns other than the named ones are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.common import narrow
from tracewarden.session import in_portions

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = (
    "key string, record_id string, record_type string, uri string, date string, payload_digest string, "
    "payload_bytes long, refers_to_id string, intact boolean, payload binary"
)


def from_pages(pages: DataFrame, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Response records of a page table: key, uri, payload, payload_digest (hex SHA-1), payload_bytes."""
    rows = narrow(pages, key=key_col, uri=uri_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit("")))
    return rows.select(
        "key", "uri", "payload",
        F.sha1(F.col("payload").cast("binary")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("string").alias("refers_to_id"),
    )


def record_id(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", key.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def resolve_revisits(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Records with equal payloads of ``min_bytes`` or more refer to the one of largest key, which keeps its payload.

    Adds ``original`` (the key of that record, null for responses). Revisits among the input, which have no
    payload, are joined to the response of their digest.
    """
    key = F.when(F.col("record_type") == "response", F.col("key"))
    originals = (
        records.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(key).alias("_original"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 and _original is not null")
        .drop("_n")
    )
    joined = records.join(originals, ["payload_digest", "payload_bytes"], "left")
    other = F.col("_original").isNotNull() & ~F.col("key").eqNullSafe(F.col("_original"))
    return joined.select(
        "key", "uri", "payload", "payload_digest", "payload_bytes",
        F.when(other, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        F.when(other, record_id(F.col("_original"), F.col("payload_digest"))).otherwise(F.col("refers_to_id")).alias("refers_to_id"),
        F.when(other, F.col("_original")).alias("original"),
    )


def record_text(date: str) -> Column:
    """A record with fresh headers, without the blank lines that close it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END)
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("payload").cast("string"), F.lit(""))))
    uri = F.regexp_replace(F.regexp_replace(F.col("uri"), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("key"), F.col("payload_digest")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block.cast("binary")))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">")))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        line("X-Record-Key", F.col("key").cast("string")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(END), block)


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """Write resolved records. An archive holds at most ``records_per_file`` records of one partition."""
    (
        records.select(record_text(date).alias("value"))
        .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while line := stream.readline().strip():
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        yield fields, stream.read(int(fields["content-length"]))


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    revisit = fields["warc-type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    whole = fields.get("warc-block-digest") in (None, "sha1:" + hashlib.sha1(block).hexdigest())
    if payload is not None:
        whole = whole and digest == hashlib.sha1(payload).hexdigest()
    length = fields.get("x-payload-length", None if payload is None else len(payload))
    return (
        fields.get("x-record-key"), fields["warc-record-id"].strip("<>"), fields["warc-type"], fields.get("warc-target-uri"),
        fields.get("warc-date"), digest, None if length is None else int(length),
        fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, whole, payload if with_payload else None,
    )


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record; ``intact`` says that block and payload match the digests in the headers."""
    names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, READ_SCHEMA.split(", "), strict=True)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(0):
                    with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as stream:
                        for fields, block in _records(stream):
                            yield _row(fields, block, with_payload)

        for part in in_portions(rows(), lambda r: 400 + len(r[-1] or b"")):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types.types, strict=True)], schema=types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, READ_SCHEMA)


def referred_keys(records: DataFrame, salts: int = 32) -> DataFrame:
    """Read-back records with ``refers_to``: the key of the response each revisit names.

    Only responses that are named take part, each ``salts`` times, so the revisits of one response are spread.
    """
    revisits, others = records.filter("record_type = 'revisit'"), records.filter("record_type != 'revisit'")
    named = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    originals = others.join(named, "record_id").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("key").alias("refers_to"))
    originals = originals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = revisits.withColumn("salt", F.pmod(F.xxhash64("key", "record_id"), F.lit(salts)).cast("int"))
    found = salted.join(originals, ["refers_to_id", "salt"], "left").drop("salt")
    return found.unionByName(others.withColumn("refers_to", F.lit(None).cast("string")))


def dedup_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 1000, key_type: str = "long") -> None:
    """Read archives, resolve their revisits and write deduplicated archives with fresh headers."""
    records = read_archives(spark, source).withColumn("payload", F.col("payload").cast("string")).withColumn("key", F.col("key").cast(key_type))
    write_archives(resolve_revisits(records, min_bytes), target)
