"""Index snapshots: a directory of Parquet tables for each generation, made current by renaming a pointer file over the old one.

The rename replaces the pointer in one step where the file system can (HDFS, local, viewfs); a reader sees the old generation or the new
one, and a crash leaves one of them. ``vacuum`` frees generations that no reader needs any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, root: str) -> str | None:
    fs, path = _fs(spark, root)
    at = path(f"{root}/{POINTER}")
    return spark.read.text(f"{root}/{POINTER}").first()[0] if fs.exists(at) else None


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes all tables under a new generation, then swaps the pointer; readers see the old or the new one."""
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    fs, path = _fs(spark, root)
    fresh = path(f"{root}/.{POINTER}-{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    context = jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(path(f"{root}/{POINTER}")), over)
    return name


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes all generations but the current one; gives the bytes freed."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return 0
    name, freed = current(spark, root), 0
    for entry in fs.listStatus(path(root)):
        if entry.isDirectory() and entry.getPath().getName() != name:
            freed += fs.getContentSummary(entry.getPath()).getLength()
            fs.delete(entry.getPath(), True)
    return freed


def load(spark: SparkSession, root: str, table: str, columns: list[str] | None = None) -> DataFrame | None:
    """A table of the current generation, or None; only the named columns are read."""
    name = current(spark, root)
    if name is None:
        return None
    df = spark.read.parquet(f"{root}/{name}/{table}")
    return df.select(*columns) if columns else df


def reset(spark: SparkSession, root: str) -> int:
    """Removes the index with all its generations; gives the bytes freed."""
    fs, path = _fs(spark, root)
    if fs.exists(path(f"{root}/{POINTER}")):
        fs.delete(path(f"{root}/{POINTER}"), False)
    return vacuum(spark, root)
