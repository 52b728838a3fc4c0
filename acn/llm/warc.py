"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writer: every page is a WARC/1.1 record in a gzip member of its own. Of pages with equal payloads of at least `min_revisit`
bytes, the one with the largest page_id is a response; the others are revisit records that carry headers only and refer to it.
Each task writes one archive under a name of its own attempt, which it renames when whole; only archives named in the
tasks' results are read, so a lost executor or a second attempt leaves nothing behind that counts.

Reader: archives are cut into byte ranges, one row each. A task scans its range for gzip's magic bytes and validates each
candidate by decoding: the member must inflate to its checksum and begin with a WARC version line. It owns the members that start
inside its range and reads on past the end of the range to finish the last one; magic bytes inside compressed data fail the
test or lie within a member already read.

Paths are opened with pyarrow's file systems (local or mounted folders, S3, GCS; HDFS where libhdfs is installed).

Defined results: null html is an empty payload; null url is left out of the record; null page_id is the smallest of all and
comes back as null; rows that repeat a page_id stay records of their own, none of which revisits its own page_id; an empty table gives no archive and
an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, new_path, open_folder, table_batch

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
READ = 1 << 20


def gzip_member(data: bytes, level: int = 3) -> bytes:
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}.part", compression=None)
                data = gzip_member(record(page_id, url, (html or "").encode(), digest, refers))
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            yield table_batch(["path", "size", "records"], [pa.string(), pa.int64(), pa.int64()], [[f"{folder}/{name}"], [size], [n]])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit: int = 1000) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; returns their list: path, size, records."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    first = (
        rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("digest").alias("_digest"), "keeper")
    )
    placed = rows.join(first, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    return materialise(placed.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(_write(folder), "path string, size long, records long"), "warc-list")


def members(stream, start: int, end: int, size: int) -> Iterator[bytes]:
    """Inflated members that begin in [start, end) of a file; those that begin before start are not this range's."""
    at, base, held = start, start, b""

    def more() -> bool:
        nonlocal held
        if base + len(held) >= size:
            return False
        stream.seek(base + len(held))
        held += stream.read(min(READ, size - base - len(held)))
        return True

    while at < end:
        if at > base + READ:
            held, base = held[at - base :], at
        found = held.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(held) - len(MAGIC) + 1)
            if not more():
                return
            continue
        at = base + found
        if at >= end:
            return
        coder, parts, used, good = zlib.decompressobj(31), [], found, True
        try:
            while not coder.eof:
                if used >= len(held) and not more():
                    raise zlib.error("cut short")
                parts.append(coder.decompress(held[used:]))
                used = len(held) - len(coder.unused_data)
                if len(parts[0]) >= len(VERSION) and not parts[0].startswith(VERSION):
                    good = False
                    break
        except zlib.error:
            good = False
        data = b"".join(parts)
        if good and data.startswith(VERSION):
            yield data
            at = base + used
        else:
            at += 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["page_id", "url", "record_type", "refers_to", "digest", "payload"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x.strip("<>").rpartition(":")[2])
    for batch in batches:
        for path, start, end, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            store, at = open_folder(path)
            rows, held = [], 0
            with store.open_input_file(at) as stream:
                for data in members(stream, start, end, size):
                    fields, payload = parse(data)
                    kind = fields["WARC-Type"]
                    rows.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].partition(":")[2], payload if kind == "response" else None))
                    held += len(payload)
                    if held > 8 << 20:
                        yield table_batch(names, types, list(zip(*rows, strict=True)))
                        rows, held = [], 0
            if rows:
                yield table_batch(names, types, list(zip(*rows, strict=True)))


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, record_type, refers_to, digest (as the record states it), payload (null for a revisit)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long")))
    ranges = archives.filter("size > 0").select("path", starts.alias("start"), "size").select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end"), "size")
    schema = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
    return ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path", "start").mapInArrow(_read, schema)


def full_payloads(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a revisit has its figures from the record that it refers to."""
    rows = materialise(read.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("own_bytes"), F.sha1("payload").alias("own_digest")), "warc-records")
    kept = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("own_digest").alias("_digest")).agg(F.first("own_bytes").alias("_bytes"))
    revisits = rows.filter("record_type = 'revisit'")
    joined = revisits.join(kept, (F.col("refers_to") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    columns = lambda size, digest: ["page_id", F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), "record_type", "refers_to"]
    return rows.filter("record_type = 'response'").select(*columns("own_bytes", "own_digest")).unionByName(joined.select(*columns("_bytes", "_digest")))


ORACLE = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) h from pages),
m as (select *, max(page_id) over (partition by h) k from p)
select page_id, cast(n as bigint) payload_bytes, h payload_digest, case when n >= 1000 and k is distinct from page_id then 'revisit' else 'response' end record_type,
       case when n >= 1000 and k is distinct from page_id then k end refers_to from m
"""
