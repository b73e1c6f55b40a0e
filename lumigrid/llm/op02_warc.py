"""WARC archives: writer, monolithic gzip normaliser with sidecar index, and reader.

``write`` renders a record for each page and lets Spark write them as whole-file gzip streams, one
member for a part. ``normalise`` inflates each such file once, front to back, rewrites every record
as a gzip member of its own and writes a sidecar index (``.idx``: offset, length, record id, type,
date, digest, URI by tab). ``read`` takes the sidecar, and reads and checks each member by its offset.
Files are streamed, so memory is bounded by the largest record.

Of records with equal payloads of at least ``min_bytes`` bytes that with the largest page_id is the
response, the others revisit it and carry no payload. Defined results: a null html is an empty
payload, a null url an empty URI; line ends in a url become %0D and %0A. Rows with a null page_id
always are responses and never revisited. Rows that repeat the largest page_id with equal payloads
are all responses. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base32_sha1, fresh_dir, small_batches, table

_BREAK = "\r\n"
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
INDEX = "path string, offset long, length long, record_id string, kind string, date string, digest string, uri string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, digest_ok boolean"


def marked(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    key = ["payload_digest", "payload_bytes"]
    shared = p.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy(*key)
    shared = shared.agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(shared, key, "left")
    again = F.coalesce(F.col("latest") != F.col("page_id"), F.lit(False))
    return p.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("latest")).alias("refers_to"),
    )


def write(records: DataFrame, folder: str) -> None:
    """Write marked pages below ``folder`` as gzip files of one member each."""
    again = F.col("record_type") == "revisit"
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(f"WARC/1.1{_BREAK}WARC-Type: "), F.col("record_type"),
        F.lit(f"{_BREAK}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{_BREAK}WARC-Date: {DATE}{_BREAK}WARC-Target-URI: "), uri,
        F.lit(f"{_BREAK}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{_BREAK}X-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(again, F.concat(F.lit(f"{_BREAK}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{_BREAK}Content-Type: text/html{_BREAK}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_BREAK * 2),
    )
    whole = F.concat(head.cast("binary"), body).cast("string")
    writer = records.select(whole.alias("value")).write.option("compression", "gzip").option("lineSep", _BREAK * 2)
    writer.text(folder)


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    return system, name


def records_of(stream, size: int = 1 << 20):
    """(head fields in lower case, block) of each record of a gzip stream of one or more members."""
    inflate, buffer, at_end = zlib.decompressobj(31), bytearray(), False

    def more() -> bool:
        nonlocal inflate, at_end
        while not at_end:
            raw = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            raw = raw or stream.read(size)
            if not raw:
                at_end = True
                return False
            got = inflate.decompress(raw)
            if got:
                buffer.extend(got)
                return True
        return False

    while True:
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(buffer) - 3)
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends inside a record's head")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        need = end + 4 + int(fields["content-length"]) + 4
        while len(buffer) < need:
            if not more():
                raise ValueError("the archive ends inside a record")
        record = bytes(buffer[:need])
        del buffer[:need]
        yield fields, record[end + 4 : need - 4], record


def _normalised(path: str, to: str) -> list[tuple]:
    """Rewrite one file and its sidecar; both appear under their final names when complete."""
    system, name = _open(path)
    out_system, folder = _open(to)
    final = f"{folder}/{os.path.basename(name).removesuffix('.gz').removesuffix('.txt')}.warc.gz"
    own = f".{uuid.uuid4().hex}.tmp"
    rows, offset = [], 0
    with system.open_input_stream(name, compression=None) as source, out_system.open_output_stream(final + own, compression=None) as sink:
        for fields, _, record in records_of(source):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = packer.compress(record) + packer.flush()
            sink.write(member)
            rows.append((
                final, offset, len(member), fields.get("warc-record-id", ""), fields.get("warc-type", ""), fields.get("warc-date", ""),
                fields.get("warc-payload-digest", ""), fields.get("warc-target-uri", ""),
            ))
            offset += len(member)
    with out_system.open_output_stream(final + own + "x", compression=None) as sink:
        for r in rows:
            sink.write(("\t".join(map(str, r[1:])) + "\n").encode("utf-8", "surrogateescape"))
    out_system.move(final + own, final)
    out_system.move(final + own + "x", final.removesuffix(".warc.gz") + ".idx")
    return rows


def normalise(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """Rewrite every whole-file gzip of ``folder`` into ``to``; the index entries, one for each record."""
    small_batches(spark)
    system, name = _open(to)
    system.create_dir(name, recursive=True)
    scheme = to.partition("://")[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "length")

    def run(frames):
        for frame in frames:
            for path in frame["path"]:
                rows = _normalised(path, to)
                made = pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])
                yield made.assign(path=scheme + "://" + made["path"])

    # One task for each file: the list is dealt by path, a file's bytes never pass through Spark.
    return files.repartition(max(1, min(files.count(), 100_000)), "path").mapInPandas(run, INDEX)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the normalised archives of ``folder``, found through their sidecars."""
    small_batches(spark, 200)
    lines = spark.read.option("lineSep", "\n").text(folder, pathGlobFilter="*.idx").select(
        F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", ".warc.gz").alias("path"),
        F.split("value", "\t")[0].cast("long").alias("offset"),
        F.split("value", "\t")[1].cast("long").alias("length"),
    )

    def number(urn: str) -> int | None:
        digits = urn.removeprefix("<urn:page:").rstrip(">")
        return int(digits) if digits else None

    def run(frames):
        held, file = None, None
        for frame in frames:
            out = []
            for path, offset, length in zip(frame["path"], frame["offset"], frame["length"]):
                if path != held:
                    if file:
                        file.close()
                    system, name = _open(path)
                    file, held = system.open_input_file(name), path
                file.seek(offset)
                for fields, block, _ in records_of(_Once(file.read(length))):
                    kind = fields["warc-type"]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    ok = kind == "revisit" or base64.b32encode(hashlib.sha1(block).digest()).decode() == digest
                    refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
                    out.append((number(fields["warc-record-id"]), fields["warc-target-uri"], kind, int(fields["x-payload-length"]), digest, refers, block, ok))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if file:
            file.close()

    return lines.mapInPandas(run, RECORD)


class _Once:
    """A stream over bytes in hand."""

    def __init__(self, data: bytes):
        self.data = data

    def read(self, _: int) -> bytes:
        data, self.data = self.data, b""
        return data


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages, normalise the archives and read them back: one row for each page."""
    spark = pages.sparkSession
    whole, single = fresh_dir(spark, "warc"), fresh_dir(spark, "warc-members")
    write(marked(pages, min_bytes), whole)
    index = normalise(spark, whole, single)
    index.write.parquet(fresh_dir(spark, "warc-index"))
    return read(spark, single)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT unnest(range(8)) AS k), u AS (SELECT unnest(range(4)) AS j),
digits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 5 * k + 1, 5))::BIGINT >> (5 * (3 - j))) & 31)::INT, 1), '' ORDER BY k, j) AS payload_digest
  FROM p, t, u GROUP BY page_id),
m AS (SELECT hex, max(page_id) AS latest FROM p GROUP BY hex)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, d.payload_digest,
  CASE WHEN m.latest = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.latest <> p.page_id THEN m.latest END AS refers_to, true AS digest_ok
FROM p JOIN m USING (hex) JOIN digits d USING (page_id)
"""
