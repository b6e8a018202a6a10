"""Incremental indexing: manifest differences, cache joins, ordinals, status."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.stored import stored


def manifest_diff(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, state) of (file, mtime, size, hash): fresh (nothing to do), touched (same content), changed, added, deleted."""
    old = manifest.select("file", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("hash").alias("h0"))
    both = scanned.join(old, "file", "full_outer")
    state = (
        F.when(F.col("m0").isNull(), "added")
        .when(F.col("mtime").isNull(), "deleted")
        .when((F.col("mtime") == F.col("m0")) & (F.col("size") == F.col("s0")), "fresh")
        .when(F.col("hash") == F.col("h0"), "touched")
        .otherwise("changed")
    )
    return both.select("file", state.alias("state"))


def is_current(diff: DataFrame) -> bool:
    return diff.filter("state <> 'fresh'").isEmpty()


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (hash, text) that the cache lacks: what an embedder has to see."""
    return chunks.select("hash", "text").join(cache.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.first("text").alias("text"))


def cache_counts(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """hits (chunks served from the cache or from an equal chunk of the batch), misses (distinct texts)."""
    marked = chunks.select("hash").join(cache.select("hash").distinct().withColumn("c", F.lit(1)), "hash", "left")
    per = marked.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c"))
    misses = F.sum(F.when(F.col("c").isNull(), 1).otherwise(0))
    return per.agg((F.sum("n") - misses).alias("hits"), misses.alias("misses"))


def cache_history(active: DataFrame, history: DataFrame, now: DataFrame) -> DataFrame:
    """Hashes kept for later: formerly active or historical ones that no current chunk has."""
    return active.select("hash").union(history.select("hash")).distinct().join(now.select("hash"), "hash", "left_anti")


def assign_ordinals(chunks: DataFrame) -> DataFrame:
    """(file, idx, ordinal): dense numbers in (file, idx) order (binary order of names, not a locale's).

    Files are dealt into ranges; running sums of their chunks within each range, and the ranges' sums (one driver row for each), give the first
    number of every file. Chunks get theirs by a join on file.
    """
    counts = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    dealt = stored(counts.repartitionByRange("file").withColumn("__range", F.spark_partition_id()), "file-ranges")
    sums = sorted((r[0], r[1]) for r in dealt.groupBy("__range").agg(F.sum("n")).collect())
    firsts = list(accumulate((n for _, n in sums), initial=0))
    bases = chunks.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sums, firsts, strict=False)], "__range int, __base long")
    before = Window.partitionBy("__range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(bases, "__range")
    base = base.select("file", (F.col("__base") + F.col("__before")).alias("base"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("idx")) - 1
    return chunks.select("file", "idx", place.alias("p")).join(base, "file").select("file", "idx", (F.col("base") + F.col("p")).alias("ordinal"))


def status(chunks: DataFrame, postings: DataFrame, idf: DataFrame) -> DataFrame:
    """chunks, files, lines and bytes of an index; a posting and an idf row count with 12 bytes each."""
    sizes = postings.agg(F.count(F.lit(1)).alias("p")).crossJoin(idf.agg(F.count(F.lit(1)).alias("i")))  # two single rows
    own = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.countDistinct("file").alias("files"),
        F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"),
    )
    return own.crossJoin(sizes).select("chunks", "files", "lines", (F.col("b") + 12 * F.col("p") + 12 * F.col("i")).alias("bytes"))
