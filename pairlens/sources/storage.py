"""Shared storage: the folder that a session names, and files that appear whole."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, which only a local master shares with its workers."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder; driver and executors need a shared one")
        path = tempfile.mkdtemp(prefix="pairlens-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pairlens/{name}-{uuid.uuid4().hex}"


class Files:
    """Files of whatever file system a path is on, through Spark's own clients."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.spark = spark.sparkContext._jvm, spark
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def read_text(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        """Under its name only when it is whole: written beside it and renamed over it."""
        part = self.jvm.org.apache.hadoop.fs.Path(f"{self.path.toString()}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._over(part)

    def replace(self, source: str) -> None:
        """source, a file or folder, renamed to this path, over what was a file there."""
        self._over(self.jvm.org.apache.hadoop.fs.Path(source))

    def _over(self, source) -> None:
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = self.fs.makeQualified(self.path)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self.fs.makeQualified(source), qualified, options)


def publish(spark: SparkSession, folder: str, version: str, about: dict) -> None:
    """Makes version, a folder below folder, the one that current() names, in one step."""
    Files(spark, f"{folder}/CURRENT").write_text(json.dumps({"version": version} | about, sort_keys=True))


def current(spark: SparkSession, folder: str) -> dict | None:
    """What publish() was told last: the version and what is known of it."""
    at = Files(spark, f"{folder}/CURRENT")
    return json.loads(at.read_text()) if at.exists() else None
