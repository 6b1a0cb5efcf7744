"""The folder that driver and executors share, and small files in it, through the file system of the path."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Without either only a local session gets one, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = own.get()
    return path.rstrip("/")


@contextmanager
def work_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared one, which goes when the block ends, also by an exception."""
    path = f"{folder(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none of a folder that isn't there."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _path(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def move_into(spark: SparkSession, old: str, suffix: str, folder: str, name: str) -> None:
    """The one file of a folder that ends so becomes a file of this name in another folder."""
    files = [n for n in children(spark, old) if n.endswith(suffix) and not n.startswith((".", "_"))]
    if len(files) != 1:
        raise FileNotFoundError(f"{len(files)} files in {old}")
    fs, p = _path(spark, folder)
    fs.mkdirs(p)
    rename(spark, f"{old}/{files[0]}", f"{folder}/{name}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all for those who read it: written aside, then renamed. One that is there already is an error."""
    if exists(spark, path):
        raise FileExistsError(path)
    fs, aside = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename(spark, aside.toString(), path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()
