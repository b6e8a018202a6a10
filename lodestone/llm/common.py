"""Shared helpers of the training-data operators: shared folder, durable intermediate tables, connected components."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1000, "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master (unit tests) gets a temporary folder; a cluster is refused, for its executors would not
    share that folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-ck-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a materialised table that nothing reads any more."""
    session = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = session._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(session._jsc.sc().hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema, encodes: bool = False) -> DataFrame:
    """``df.mapInArrow`` in batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``, after which a worker gives its free memory back.

    Texts can be long, so Spark's usual 10,000 rows would hold hundreds of megabytes on either side. Workers serve one stage after the other:
    unless ``encodes``, a task first drops the encoders that its worker holds from an earlier one.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def lean(batches: Iterator) -> Iterator:
        if not encodes:
            drop_encoders()
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def drop_encoders() -> None:
    """Frees the tokenizers and cached ids that a worker holds, over 100 MB."""
    tokens = sys.modules.get("lodestone.llm.tokens")
    if tokens is not None and tokens.encoder.cache_info().currsize:
        tokens.encoder.cache_clear()
        give_back()


def give_back() -> None:
    """Returns what allocators hold but don't use, so that idle workers are small."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph as (node, root), root being the component's smallest node.

    ``edges`` has columns (u, v) of longs; nodes without an edge do not appear. Alternates large-star and
    small-star steps, each a partial-aggregated min and a join that adaptive execution can split, so no
    component is gathered in one task. Each round is a written table, which replaces the one before; it ends when a round changes
    nothing, after a number of rounds in the order of the square of the logarithm of the number of nodes.
    """
    current = materialise(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(min_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lows = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(lows, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lows.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        last, current = current, materialise(small, "cc")
        discard(last)
        now = _mark(current)
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))
    ).first()
    return tuple(row)
