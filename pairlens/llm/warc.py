"""WARC archives: whole-file gzip streams normalised to one member a record, with a sidecar index.

``write_monolithic`` archives a table as WARC files that are one gzip stream
each.  ``normalise`` inflates such a file once, in one pass and with one record
in memory, and writes every record as a gzip member of its own next to an
index with a line of JSON for each record: where its member starts, its length
and what it holds.  ``read_records`` goes by the index and inflates single
members.

Files are written under names that no other attempt uses, and only the names
that a finished task returns are read later, so lost or repeated tasks leave
nothing behind that counts.  They go to the session's shared folder through
pyarrow's file systems (local, HDFS, S3, GCS).

Nulls and edge cases: a null html is an empty payload; a null url is written
as an empty one; a record with a null page_id is archived and can be a
revisit, and is what others refer to only where all equal payloads have none;
of repeated rows one is the response and the others are revisits of the same
page_id; an empty table gives no archives and no rows; other columns of the
input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import Tables, delete, keyed_join, new_path

#: A new archive begins after so many payload bytes or records.
FILE_BYTES = 64 << 20
FILE_RECORDS = 100_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, record int, page_id long, payload_bytes long, payload_digest string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, member_offset long, member_bytes long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives the rows, a gzip stream a file; returns an index row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out = stream = None
        name, size, n = "", 0, 0

        def close() -> None:
            if out is not None:
                out.write(stream.flush())
                out.close()

        for b in batches:
            rows: list[tuple] = []
            for page_id, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.binary()).to_pylist(), strict=True):
                if out is None or size >= FILE_BYTES or n >= FILE_RECORDS:
                    close()
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, stream = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = html or b""
                digest = digest_of(payload)
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8")]
                out.write(stream.compress(record(headers, payload)))
                rows.append((name, n, page_id, len(payload), digest))
                size, n = size + len(payload), n + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "record", "page_id", "payload_bytes", "payload_digest"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("file", pa.string()), ("record", pa.int32()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))
        close()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, INDEX)


def records_of(read, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file of one or more members, inflated once and in order."""
    inflate, buf = zlib.decompressobj(31), bytearray()
    while data := read(chunk):
        while data:
            buf += inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof and data:
                inflate = zlib.decompressobj(31)
        while (end := buf.find(b"\r\n\r\n")) >= 0:
            length = int(re.search(rb"\r\nContent-Length: (\d+)", buf[:end])[1])
            if len(buf) < (full := end + 4 + length + 4):
                break
            yield bytes(buf[:full])
            del buf[:full]
    if buf:
        raise ValueError("the archive ends within a record")


def normalise_file(src: str, folder: str, revisits: dict[int, int | None]) -> tuple[str, str, int]:
    """Rewrites one archive; record numbers in revisits become revisits of the page given.  Returns archive, sidecar and records."""
    fs, path = open_fs(src)
    to, root = open_fs(folder)
    to.create_dir(root, recursive=True)
    name, at, n = uuid.uuid4().hex, 0, 0
    with fs.open_input_stream(path, compression=None) as f, to.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, to.open_output_stream(f"{root}/{name}.idx.jsonl", compression=None) as index:
        for n, data in enumerate(records_of(f.read), 1):
            headers, block = parse(data)
            if n - 1 in revisits:
                target = revisits[n - 1]
                headers |= {"WARC-Type": "revisit", "WARC-Refers-To": _urn(target), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Payload-Length": str(len(block))}
                headers.pop("Content-Length")
                data = record(list(headers.items()), b"")
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(data) + z.flush()
            out.write(member)
            index.write(json.dumps({"offset": at, "length": len(member), "id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "digest": headers["WARC-Payload-Digest"]}).encode() + b"\n")
            at += len(member)
    return f"{name}.warc.gz", f"{name}.idx.jsonl", n


def normalise(files: DataFrame, src: str, folder: str) -> DataFrame:
    """files: file, and revisits as a list of (record, page_id), bounded by the records of a file.  Returns the new archives and their sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                a, i, n = normalise_file(f"{src}/{row['file']}", folder, {r["record"]: r["page_id"] for r in row["revisits"]})
                yield pa.RecordBatch.from_pylist([{"archive": a, "sidecar": i, "records": n}], schema=pa.schema([("archive", pa.string()), ("sidecar", pa.string()), ("records", pa.int64())]))

    return files.mapInArrow(run, "archive string, sidecar string, records long")


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record, read member by member where the sidecar says it starts; digests of responses are taken anew."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type", "url", "archive") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs, root = open_fs(folder)
            for row in b.to_pylist():
                rows: list[dict] = []
                with fs.open_input_file(f"{root}/{row['archive']}") as f, fs.open_input_stream(f"{root}/{row['sidecar']}", compression=None) as lines:
                    for line in lines.read().splitlines():
                        x = json.loads(line)
                        f.seek(x["offset"])
                        headers, block = parse(zlib.decompress(f.read(x["length"]), 31))
                        revisit = headers["WARC-Type"] == "revisit"
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and digest_of(block) != digest or headers["WARC-Record-ID"] != x["id"]:
                            raise ValueError(f"{row['archive']} at {x['offset']}: not the record that the index says")
                        rows.append({"page_id": _page(headers["WARC-Record-ID"]), "payload_bytes": int(headers["X-Payload-Length"]) if revisit else len(block), "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": _page(headers.get("WARC-Refers-To")), "url": headers["WARC-Target-URI"], "archive": row["archive"], "member_offset": x["offset"], "member_bytes": x["length"]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.mapInArrow(run, RECORD)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives pages, normalises the archives and reads them back.

    Of records with equal payloads of at least min_bytes bytes, the one with
    the largest page_id is the response and the others revisit it.
    """
    spark = pages.sparkSession
    t = Tables(spark)
    raw, folder = new_path(spark, "warc-raw"), new_path(spark, "warc")
    index = t.write(write_monolithic(pages, raw), "index")
    groups = t.write(index.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "file", "record")).alias("target"), F.count("*").alias("n")).where("n > 1"), "groups")
    joined = keyed_join(index.select("file", "record", "page_id", "payload_digest", "payload_bytes"), groups, "payload_digest", index.count(), spread=F.xxhash64("file", "record"))
    other = (F.col("payload_bytes") >= min_bytes) & F.col("target").isNotNull() & ((F.col("file") != F.col("target.file")) | (F.col("record") != F.col("target.record")))
    files = t.write(joined.groupBy("file").agg(F.collect_list(F.when(other, F.struct("record", F.col("target.page_id").alias("page_id")))).alias("revisits")), "files")
    n = max(1, min(files.count(), 20_000))
    done = t.write(normalise(files.repartition(n), raw, folder), "archives")
    delete(spark, raw)
    t.drop(index, groups, files)
    return read_records(done.repartition(n), folder)


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: sha1 in hexadecimal is regrouped from 4 to 5 bits a character, 20 bits at a time.
OP1_SQL = """
WITH p AS (SELECT page_id, CAST(coalesce(strlen(html), 0) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) >> s) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)
"""
