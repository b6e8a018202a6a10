"""Scan of a folder: files with their times and sizes, nested ignore files, contents, and a reason for everything left out.

The driver lists names through the session's file system, as Spark's readers pass over names that begin with a dot or an underscore; a project
is a folder of that size. Whether a file is kept is decided by column expressions, so larger listings can come from any table. Contents are
read by tasks, for kept files only; the few that Spark passes over are read by the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.ignore import Scope, excluded

IGNORE_FILE = ".gitignore"
EXCLUDE_FILE = ".git/info/exclude"
HIDDEN = r"(^|/)[._]"
LISTING = "path string, mtime long, size long"


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _bytes(spark: SparkSession, root: str, name: str) -> bytes:
    fs, path = _fs(spark, root)
    stream = fs.open(path(f"{root}/{name}"))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of every file below ``root``; paths are relative."""
    fs, path = _fs(spark, root)
    base = fs.makeQualified(path(root)).toUri().getPath().rstrip("/")
    rows, files = [], fs.listFiles(path(root), True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toUri().getPath()[len(base) + 1 :]
        if not name.endswith(".crc"):
            rows.append((name, f.getModificationTime(), f.getLen()))
    return spark.createDataFrame(sorted(rows), LISTING)


def _lines(spark: SparkSession, root: str, name: str) -> tuple[str, ...]:
    fs, path = _fs(spark, root)
    return tuple(_bytes(spark, root, name).decode("utf-8", "replace").split("\n")) if fs.exists(path(f"{root}/{name}")) else ()


def scopes(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), files: bool = True) -> list[Scope]:
    """The patterns of the configuration, the root's ignore files, then those of inner folders; only the first without ``files``."""
    first = patterns + (_lines(spark, root, IGNORE_FILE) + _lines(spark, root, EXCLUDE_FILE) if files else ())
    if not files:
        return [Scope("", first)]
    held = [r[0] for r in listing(spark, root).filter(F.endswith("path", F.lit("/" + IGNORE_FILE))).select("path").collect()]
    folders = sorted((f[: -len(IGNORE_FILE) - 1] for f in held), key=lambda f: (f.count("/"), f))
    return [Scope("", first), *(Scope(f, _lines(spark, root, f"{f}/{IGNORE_FILE}")) for f in folders)]


def scan(found: DataFrame, rules: list[Scope]) -> tuple[DataFrame, DataFrame]:
    """(files: path, mtime, size; skipped: path, reason) of (path, mtime, size)."""
    marked = found.withColumn("__out", excluded(F.col("path"), rules))
    kept = marked.filter(~F.col("__out")).select("path", "mtime", "size")
    skipped = marked.filter("__out").select("path", F.concat(F.lit("Ignored by config pattern: "), "path").alias("reason"))
    return kept, skipped


def scan_folder(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), files: bool = True) -> tuple[DataFrame, DataFrame]:
    return scan(listing(spark, root), scopes(spark, root, patterns, files))


def extract(spark: SparkSession, root: str, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: path, text, hash; diagnostics: path, kind, message) of kept files; contents that aren't UTF-8 give a diagnostic."""
    fs, path = _fs(spark, root)
    base = fs.makeQualified(path(root)).toUri().getPath().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    raw = raw.select(F.substring_index("path", base + "/", -1).alias("path"), "content").join(kept.select("path"), "path", "left_semi")
    passed = [r[0] for r in kept.filter(F.rlike("path", F.lit(HIDDEN))).select("path").collect()]
    raw = raw.unionByName(spark.createDataFrame([(p, _bytes(spark, root, p)) for p in passed], "path string, content binary"))
    read = raw.select("path", "content", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    good = read.filter("text is not null").select("path", "text", F.sha2("content", 256).alias("hash"))
    bad = read.filter("text is null").select("path", F.lit("skipped-file").alias("kind"), F.lit("Could not read file: not UTF-8").alias("message"))
    return good, bad


def diagnostics(previous: DataFrame, fresh: DataFrame, known: DataFrame, reprocessed: DataFrame) -> DataFrame:
    """Diagnostics of files still known and not processed again, with the fresh ones; ordered by file, line (none last), kind, message.

    ``previous`` and ``fresh``: path, line, kind, message. What a pattern ignores is no diagnostic.
    """
    held = previous.join(known.select("path"), "path", "left_semi").join(reprocessed.select("path"), "path", "left_anti")
    both = held.unionByName(fresh).filter(~F.startswith("message", F.lit("Ignored by config pattern")))
    return both.orderBy("path", F.asc_nulls_last("line"), "kind", "message")
