"""Tables that cut a lineage: written into the folder of spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where it is unset, on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="assetgraph-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/assetgraph/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    at, fs = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    at, fs = _at(spark, path)
    source = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file was written."""
    at, fs = _at(spark, path)
    return time.time() - fs.getFileStatus(at).getModificationTime() / 1000


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small text file, unless there is one."""
    at, fs = _at(spark, path)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)  # fails if another writer has made it meanwhile
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def complete_folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """The folders `depth` levels below path whose writing job has been committed, by name."""
    at, fs = _at(spark, path + "/*" * depth)
    return sorted(f.getPath().toString() for f in fs.globStatus(at) or [] if f.isDirectory() and fs.exists(_at(spark, f"{f.getPath().toString()}/_SUCCESS")[0]))


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
