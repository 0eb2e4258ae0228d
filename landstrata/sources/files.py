"""Small files on the shared storage, by Spark's own file systems."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str, folders: bool = True) -> list[str]:
    """Names of the folders (or files) in a folder; none if it is not there."""
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not be there yet; False if it is.

    The text is written under another name and renamed without overwriting, so of several writers one wins and nobody
    reads half a file. The file system's rename has to be atomic, as on HDFS; object stores need a committer that makes it so.
    """
    p, fs = _path(spark, path)
    half = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid4().hex}")
    stream = fs.create(half, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(half), fs.makeQualified(p), options)
        return True
    except Exception as failed:
        if not fs.exists(p):
            raise
        fs.delete(half, False)
        if "FileAlreadyExists" not in str(failed):
            raise
        return False
