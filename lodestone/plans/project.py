"""Incremental index of a project: changed files are chunked and embedded, everything else is reused, and the result is a new snapshot.

Tables of a snapshot: manifest (file, mtime, size, hash), chunks (file, idx, start, end, start_line, end_line, text, hash, ordinal),
active and history (hash, v: vectors of current and of former chunks), contract (one row of JSON).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash
from lodestone.operators import incremental
from lodestone.operators.chunking import chunk_files
from lodestone.operators.stored import stored
from lodestone.sources import snapshot

MANIFEST = "file string, mtime long, size long, hash string"
CHUNKS = "file string, idx int, start int, end int, start_line int, end_line int, text string, hash string, ordinal long"
VECTORS = "hash string, v array<double>"


@dataclass(frozen=True)
class Contract:
    """What an index is made with; a snapshot made with another one is processed anew, though its vectors may serve."""

    model: str = "hashed-words"
    dtype: str = "double"
    dims: int = 64
    chunk_tokens: int | None = None
    sparse: str = "counts"

    def key(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class Result:
    refresh: str  # none, incremental or full
    files: int
    processed: int
    reused: int
    chunks: int
    cache_hits: int
    cache_misses: int


def hashed_words(text: str, dims: int) -> list[float]:
    """A stand-in for a model, the same everywhere: words hashed to signed coordinates, the mean over words, not normalised."""
    out = np.zeros(dims)
    words = text.lower().split()
    for w in words:
        h = crc32(w.encode())
        out[h % dims] += 1.0 if h >> 16 & 1 else -1.0
    return (out / max(1, len(words))).tolist()


def embedded(texts: DataFrame, dims: int, embed: Callable[[str, int], list[float]] = hashed_words, most_tokens: int | None = None) -> DataFrame:
    """(hash, v) of (hash, text), in Arrow batches of the session's size; a text of more words than the model takes is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                if most_tokens is not None and len(text.split()) > most_tokens:
                    raise ValueError(f"a text of {len(text.split())} tokens exceeds the model's limit of {most_tokens}")
                found.append(embed(text, dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["hash", "v"])

    return texts.select("hash", "text").mapInArrow(run, VECTORS)


def usable(cache: DataFrame, dims: int) -> DataFrame:
    """Cached vectors of the right length."""
    return cache.filter(F.size("v") == dims)


def upsert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """``cache`` with ``rows``; those replace what has their hash."""
    return cache.join(rows.select("hash"), "hash", "left_anti").unionByName(rows.dropDuplicates(["hash"]))


def _previous(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    found = snapshot.load(spark, root, table)
    return spark.createDataFrame([], schema) if found is None else found


def update(spark: SparkSession, root: str, files: DataFrame, contract: Contract | None = None, embed: Callable[[str, int], list[float]] = hashed_words) -> Result:
    """Brings the index at ``root`` up to date with ``files`` (file, mtime, size, text).

    A file of the same time and size isn't hashed; one of the same hash keeps its chunks. A new snapshot is committed unless nothing changed.
    """
    contract = contract or Contract()
    old = _previous(spark, root, "manifest", MANIFEST)
    made = snapshot.load(spark, root, "contract")
    same = made is not None and made.first()[0] == contract.key()
    known = old if same else old.limit(0)
    was = known.select("file", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("hash").alias("h0"))
    fresh = F.coalesce((F.col("mtime") == F.col("m0")) & (F.col("size") == F.col("s0")), F.lit(False))
    now = files.join(was, "file", "left").withColumn("fresh", fresh)
    now = now.withColumn("hash", F.when(F.col("fresh"), F.col("h0")).otherwise(content_hash(F.coalesce("text", F.lit("")))))
    now = now.withColumn("state", F.when(F.col("fresh"), "fresh").when(F.col("hash") == F.col("h0"), "touched").otherwise("processed"))
    states = stored(now.select("file", "mtime", "size", "hash", "state"), "states")
    count = {r[0]: r[1] for r in states.groupBy("state").count().collect()}
    total, processed = sum(count.values()), count.get("processed", 0)
    reused = total - processed
    if same and processed == 0 and not count.get("touched") and total == old.count():
        return Result("none", total, 0, reused, snapshot.load(spark, root, "chunks").count(), 0, 0)
    before = _previous(spark, root, "chunks", CHUNKS)
    kept = before.join(states.filter("state <> 'processed'").select("file"), "file", "left_semi").drop("ordinal")
    todo = files.join(states.filter("state = 'processed'").select("file"), "file", "left_semi")
    made_now = chunk_files(todo.select("file", "text"), contract.chunk_tokens).withColumn("hash", content_hash(F.col("text")))
    made_now = stored(made_now, "new-chunks")
    every = stored(kept.select(*made_now.columns).unionByName(made_now), "all-chunks")
    numbered = every.join(incremental.assign_ordinals(every.select("file", "idx")), ["file", "idx"])
    active, history = _previous(spark, root, "active", VECTORS), _previous(spark, root, "history", VECTORS)
    cache = stored(usable(active.unionByName(history), contract.dims).dropDuplicates(["hash"]), "cache")
    counted = incremental.cache_counts(made_now, cache).first()
    vectors = stored(upsert(cache, embedded(incremental.cache_misses(made_now, cache), contract.dims, embed)), "vectors")
    current = every.select("hash").distinct()
    snapshot.commit(
        spark,
        root,
        {
            "manifest": states.select("file", "mtime", "size", "hash"),
            "chunks": numbered,
            "active": vectors.join(current, "hash", "left_semi"),
            "history": vectors.join(current, "hash", "left_anti"),
            "contract": spark.createDataFrame([(contract.key(),)], "contract string"),
        },
    )
    return Result("incremental" if same else "full", total, processed, reused, every.count(), counted["hits"] or 0, counted["misses"] or 0)


def cache_sizes(spark: SparkSession, root: str) -> dict[str, int]:
    return {t: _previous(spark, root, t, VECTORS).count() for t in ("active", "history")}


def clear_cache(spark: SparkSession, root: str) -> bool:
    """Forgets all vectors; true if there were any."""
    had = any(cache_sizes(spark, root).values())
    tables = {t: snapshot.load(spark, root, t) for t in ("manifest", "chunks", "contract")}
    if had and all(t is not None for t in tables.values()):
        none = spark.createDataFrame([], VECTORS)
        snapshot.commit(spark, root, {**tables, "active": none, "history": none})
    return had
