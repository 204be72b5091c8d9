"""Scratch tables in the folder that all executors share.

Intermediates are written under the folder the session names in ``spark.checkpoint.dir`` and read again, so a lost
executor costs a recomputed task and never a lost intermediate. A path without a scheme is one of the session's
default file system. Only a session that runs on one machine may leave the setting out: it gets a temporary folder.
Workspaces are removed when the driver ends, or before that by `released` and `Workspace.close`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from quire.runtime import ship

_local: list[str] = []
_live: dict[str, None] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI: without a scheme it is one of the session's default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        _local.append(base.removeprefix("file://"))
        spark.conf.set("spark.checkpoint.dir", base)
    return qualified(spark, base)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a URI (local, hdfs, s3, gs ...)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def remove(uri: str) -> None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


class Workspace:
    """A scratch folder of one operator call in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.uri = f"{shared_root(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
        _live[self.uri] = None

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def folder(self, name: str) -> str:
        """A folder for files that tasks write themselves."""
        uri = self.path(name)
        fs, path = open_fs(uri)
        fs.create_dir(path, recursive=True)
        return uri

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again: its lineage ends here."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove what no later step reads."""
        for name in names:
            remove(self.path(name))

    def close(self) -> None:
        """Remove all of it; frames that read it are of no use from then on."""
        remove(self.uri)
        _live.pop(self.uri, None)


@contextmanager
def released(keep: Workspace | None = None) -> Iterator[None]:
    """Remove the workspaces that are opened inside, but for `keep`, at the end: for steps whose result is written by then."""
    before = set(_live)
    try:
        yield
    finally:
        for uri in [u for u in _live if u not in before and (keep is None or u != keep.uri)]:
            remove(uri)
            _live.pop(uri, None)


@atexit.register
def _remove_all() -> None:
    for uri in list(_live):
        try:
            remove(uri)
        except OSError:
            pass  # the driver ends either way
    for folder in _local:
        shutil.rmtree(folder, ignore_errors=True)
