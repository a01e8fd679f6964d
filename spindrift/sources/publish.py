"""Atomic publishing: versioned folders, and a pointer that is swapped by one rename.

A version is written beside the others, complete, before the pointer names it. A write that dies half-way leaves the
pointer, and so every reader, at the version before; what it left behind goes with the next sweep.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _named(spark: SparkSession, path: str) -> list[str]:
    """The versions that the pointer names: the current one, then those before it that are kept."""
    fs, at = _files(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return []
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str:
    """The folder to read: the version that the pointer names, or ``path`` itself where nothing was published."""
    names = _named(spark, path)
    return f"{path}/{names[0]}" if names else path


def published(spark: SparkSession, path: str) -> bool:
    return bool(_named(spark, path))


def publish(spark: SparkSession, path: str, write: Callable[[str], None], replace: bool = True, keep: int = 1) -> str:
    """Calls ``write`` with a new version's folder, then points readers there. The version's folder.

    Without ``replace`` a path where something is published, or lies, is an error. Of older versions ``keep`` are left,
    for readers that still follow the pointer of before. Of two writers at once the one that ends later fails, and takes
    back what it wrote.
    """
    fs, at = _files(spark, path)
    if not replace and fs.exists(at):
        raise FileExistsError(f"{path} exists")
    before = _named(spark, path)
    number = int(before[0].split("-")[1]) + 1 if before else 0
    name = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
    write(f"{path}/{name}")
    folder = _files(spark, f"{path}/{name}")[1]
    if not fs.exists(folder):
        raise ValueError(f"nothing was written to {path}/{name}")
    if _named(spark, path) != before:
        fs.delete(folder, True)
        raise RuntimeError(f"another writer has published at {path} meanwhile")
    _point(spark, path, [name, *before[:keep]])
    sweep(spark, path)
    return f"{path}/{name}"


def publish_table(df: DataFrame, path: str, replace: bool = True, keep: int = 1) -> str:
    return publish(df.sparkSession, path, df.write.parquet, replace, keep)


def _point(spark: SparkSession, path: str, names: list[str]) -> None:
    """The pointer is written beside its place and takes it by one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, draft = _files(spark, f"{path}/{POINTER}.{uuid.uuid4().hex[:8]}")
    stream = fs.create(draft)
    stream.write("\n".join(names).encode())
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(draft, pointer, options)


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Removes versions older than the current one that the pointer doesn't name, those never published among them."""
    names = _named(spark, path)
    if not names:
        return []
    fs, at = _files(spark, path)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v-"))
    gone = [v for v in versions if v not in names and v.split("-")[1] < names[0].split("-")[1]]
    for v in gone:
        fs.delete(_files(spark, f"{path}/{v}")[1], True)
    return gone
