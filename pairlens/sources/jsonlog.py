"""Logs of JSON lines as a data source: read by byte ranges, torn tails left out or repaired, appended to in whole commits.

A log is a folder.  Its files are those that commits name, and foreign ones,
which anything else may append to.  A writer that was interrupted leaves a last
line without an end; whatever file it is in, such a tail is no record.  Any
other line that is no JSON object is an error, which names file and offset.

    spark.dataSource.register(jsonlog.JsonLog)
    spark.read.format("jsonlog").load(folder)      # value, file, start
    rows.write.format("jsonlog").mode("append").save(folder)   # the column value
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RANGE_BYTES = 64 << 20
#: Bytes read at once while a line's end is looked for, and records of a batch.
BLOCK, BATCH = 1 << 16, 4096
COMMITS, OWN = "_commits", "commit-"
SCHEMA = "value string, file string, start long"


def _open(path: str) -> tuple[afs.FileSystem, str]:
    """File system and path of a folder, with or without a scheme."""
    if "://" not in path and not path.startswith("file:"):
        return afs.LocalFileSystem(), path.rstrip("/")
    scheme, _, rest = path.partition(":")
    return afs.FileSystem.from_uri(f"{scheme}://{rest}" if scheme == "file" and not rest.startswith("//") else path.rstrip("/"))


def log_files(path: str) -> list[tuple[str, int]]:
    """Files of the log with their sizes: what commits name, and foreign files."""
    fs, root = _open(path)
    infos = [i for i in fs.get_file_info(afs.FileSelector(root, allow_not_found=True)) if i.is_file and not i.base_name.startswith(("_", "."))]
    committed: set[str] = set()
    for i in fs.get_file_info(afs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True)):
        if i.extension == "json":
            with fs.open_input_stream(i.path) as f:
                committed |= set(json.loads(f.read())["files"])
    return sorted((i.path, i.size) for i in infos if not i.base_name.startswith(OWN) or i.base_name in committed)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    size: int


def _lines(f, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
    """Offset, content and whether it has an end, of each line that starts in [begin, end)."""
    at, rest = begin, b""
    if begin:  # the line that the byte before begin belongs to is another range's
        at -= 1
        f.seek(at)
        while True:
            block = f.read(BLOCK)
            if not block:
                return
            cut = block.find(b"\n")
            if cut >= 0:
                at += cut + 1
                rest = block[cut + 1 :]
                break
            at += len(block)
    else:
        f.seek(0)
    while at < end:
        parts = []
        while (cut := rest.find(b"\n")) < 0:
            parts.append(rest)
            rest = f.read(BLOCK)
            if not rest:
                line = b"".join(parts)
                if line:
                    yield at, line, False
                return
        line = b"".join([*parts, rest[:cut]])
        rest = rest[cut + 1 :]
        yield at, line, True
        at += len(line) + 1


def _is_object(line: bytes) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


class LogReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.step = path, int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [Range(file, a, min(a + self.step, size), size) for file, size in log_files(self.path) for a in range(0, size, self.step)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a log without files
            return
        fs, _ = _open(self.path)
        names, values, starts = ["value", "file", "start"], [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([partition.file] * len(values), pa.string()), pa.array(starts, pa.int64())], names=names)
            values.clear()
            starts.clear()
            return out

        with fs.open_input_file(partition.file) as f:
            for at, line, ended in _lines(f, partition.start, partition.end, partition.size):
                text = line.strip()
                if not text:
                    continue
                if not _is_object(text):
                    if not ended:
                        continue  # the torn tail
                    raise ValueError(f"{partition.file}: no JSON object at byte {at}")
                values.append(text.decode())
                starts.append(at)
                if len(values) == BATCH:
                    yield batch()
        if values:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LogWriter(DataSourceArrowWriter):
    """Each task writes a file that no commit names yet; the commit, one file renamed into place, makes them all appear at once."""

    def __init__(self, path: str, overwrite: bool):
        if overwrite:
            raise ValueError("a log is appended to")
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name, rows = f"{OWN}{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in batches:
                for line in b.column("value").to_pylist():
                    if line is None or "\n" in line or not _is_object(line.encode()):
                        raise ValueError(f"no JSON object on one line: {line!r:.100}")
                    out.write(line.encode() + b"\n")
                    rows += 1
        return Written(name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/{COMMITS}", recursive=True)
        name = uuid.uuid4().hex
        part = f"{root}/{COMMITS}/{name}.part"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(json.dumps({"files": [m.file for m in messages if m], "rows": sum(m.rows for m in messages if m)}).encode())
        fs.move(part, f"{root}/{COMMITS}/{name}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.file}")


class JsonLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options["path"], dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if "value" not in schema.names:
            raise ValueError("a log is written from the column value")
        return LogWriter(self.options["path"], overwrite)


def read(spark: SparkSession, path: str, schema: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, start and the fields of schema, or value, of every record."""
    from pyspark.sql import functions as F

    spark.dataSource.register(JsonLog)
    rows = spark.read.format("jsonlog").option("rangeBytes", range_bytes).load(path)
    return rows.select("file", "start", F.from_json("value", schema).alias("r")).select("file", "start", "r.*") if schema else rows


def append(rows: DataFrame, path: str) -> None:
    """rows, each as one JSON object."""
    from pyspark.sql import functions as F

    rows.sparkSession.dataSource.register(JsonLog)
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.format("jsonlog").mode("append").save(path)


def repair(spark: SparkSession, path: str) -> DataFrame:
    """Cuts torn tails off the log's files, so that what is appended next starts a line; file, bytes kept and bytes cut of each torn file.

    Only the end of a file is looked at: tails are found backwards from it.  A
    torn file is copied up to its last whole line and renamed over the old one,
    a task a file; a last line that is whole but for its end gets one.  Files of
    commits are never torn.
    """
    spark.dataSource.register(JsonLog)
    foreign = [(f, s) for f, s in log_files(path) if not f.rsplit("/", 1)[-1].startswith(OWN)]
    schema = "file string, kept long, cut long"
    if not foreign:
        return spark.createDataFrame([], schema)
    parts = min(len(foreign), spark.sparkContext.defaultParallelism * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(path)
        done = []
        for b in batches:
            for file, size in zip(b.column("file").to_pylist(), b.column("size").to_pylist()):
                kept, tail = _tail(fs, file, size)
                if not tail:
                    continue
                whole = _is_object(tail.strip())
                part = f"{file}.{uuid.uuid4().hex}.part"
                with fs.open_input_file(file) as source, fs.open_output_stream(part, compression=None) as out:
                    left = kept
                    while left:
                        block = source.read(min(left, 1 << 20))
                        out.write(block)
                        left -= len(block)
                    if whole:
                        out.write(tail + b"\n")
                fs.move(part, file)
                done.append((file, kept + (len(tail) + 1 if whole else 0), 0 if whole else len(tail)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["file", "kept", "cut"])

    rows = spark.createDataFrame(foreign, "file string, size long").repartition(parts).mapInArrow(run, schema)
    return spark.createDataFrame(rows.collect(), schema)  # a row for each torn file; computed once, as files change


def _tail(fs: afs.FileSystem, file: str, size: int) -> tuple[int, bytes]:
    """Bytes up to the last line's end, and what comes after it."""
    at, parts = size, []
    with fs.open_input_file(file) as f:
        while at:
            begin = max(0, at - BLOCK)
            f.seek(begin)
            block = f.read(at - begin)
            cut = block.rfind(b"\n")
            if cut >= 0:
                parts.append(block[cut + 1 :])
                return begin + cut + 1, b"".join(reversed(parts))
            parts.append(block)
            at = begin
    return 0, b"".join(reversed(parts))
