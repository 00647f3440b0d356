"""Folders and small files on whatever file system the session's paths name."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def make(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    fs.mkdirs(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    fs, at, _ = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def read(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, at, _ = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    fs.delete(at, True)


def make_for_session(spark: SparkSession, path: str) -> None:
    """Make a folder that goes when the driver's JVM ends."""
    fs, at, _ = _fs(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Let a file with this text appear at ``path`` whole and at once; false if there is one already.

    The text goes to a file beside it first. On a local file system that file is then linked, which
    fails if the name is taken; elsewhere it is renamed, which a file system with a name node refuses
    in the same step if a file of that name exists.
    """
    fs, at, make_path = _fs(spark, path)
    tmp = make_path(at.getParent(), f"_{uuid.uuid4().hex}")
    stream = fs.create(tmp, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(tmp.toUri().getPath(), fs.makeQualified(at).toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not fs.exists(at) and bool(fs.rename(tmp, at))
    finally:
        fs.delete(tmp, False)
