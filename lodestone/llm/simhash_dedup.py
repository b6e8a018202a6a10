"""SimHash near-duplicate classes by pigeonhole blocks.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased; shingles of ``width`` words, joined by one
space, repeats included (a shorter text is one shingle, a text without words has fingerprint zero). A fingerprint bit
is set if it is set in over half of the shingles' XXH64 (seed 42).

Fingerprints at most two bits apart agree in at least two of four 16-bit blocks, so every such pair shares one of
six 32-bit block pairs; pairs are joined on those keys and verified by Hamming distance. Exact copies fall into one
fingerprint before any join. A key that more than ``bucket`` fingerprints share (a group of near copies) is not
joined with itself: each of its fingerprints is sent to itself and to its 32 one-bit neighbours outside the key.
Members that meet at one value are within two bits of each other, and any two members within two bits meet somewhere,
so linking each to the smallest there gives the same components with rows in proportion to the group.

Null texts count as empty; null ids take part but cannot name a component (all ids null: component null). Repeated
rows stay. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.common import connected_components, map_arrow, materialise

BITS = 64
RADIUS = 2
BLOCK_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    return np.fromiter(
        (xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)),
        np.uint64,
        len(starts),
    )


def fingerprint(text: bytes, width: int = 3) -> int:
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if n == 0:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 200:
        set_bits = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        set_bits = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): each row's 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(
                [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in batch.column(1)], np.uint64
            ).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return map_arrow(rows, run, "id long, fp long")


def block_keys() -> list:
    """For each block pair: (its number, the fingerprint's bits in it)."""
    out = []
    for k, (i, j) in enumerate(BLOCK_PAIRS):
        mask = (0xFFFF << 16 * i) | (0xFFFF << 16 * j)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return out


def links(distinct_fp: DataFrame, bucket: int = 64) -> DataFrame:
    """(u, v): verified links that give the components of all fingerprints within the radius."""
    keyed = materialise(
        distinct_fp.select("fp", F.explode(F.array(*block_keys())).alias("b")).select("b.k", "b.key", "fp"), "blocks"
    )
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(keyed.join(sizes, ["k", "key"]), "shared-blocks")
    few = shared.filter(F.col("n") <= bucket).drop("n")
    other = few.withColumnRenamed("fp", "other")
    near = (
        few.join(other, ["k", "key"])
        .filter(F.col("fp") < F.col("other"))
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
        .distinct()
    )
    flips = F.array(
        *[
            F.array(F.lit(0).cast("long"), *[F.lit(_bit(16 * b + x)) for b in range(4) if b not in pair for x in range(16)])
            for pair in BLOCK_PAIRS
        ]
    )
    many = shared.filter(F.col("n") > bucket)
    spread = many.select(
        "k",
        "fp",
        F.explode(F.transform(F.element_at(flips, F.col("k") + 1), lambda x: F.col("fp").bitwiseXOR(x))).alias("at"),
    )
    lows = spread.groupBy("k", "at").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    starred = (
        spread.join(lows, ["k", "at"])
        .filter(F.col("fp") != F.col("low"))
        .select(F.col("low").alias("u"), F.col("fp").alias("v"))
        .distinct()
    )
    return near.unionByName(starred)


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64) if i == 63 else 1 << i


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bucket: int = 64) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links, the row's own included."""
    rows = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return components(rows, bucket)


def components(rows: DataFrame, bucket: int = 64) -> DataFrame:
    own = materialise(rows.groupBy("fp").agg(F.min("id").alias("low")), "fp-classes")
    roots = connected_components(links(own.select("fp"), bucket)).withColumnRenamed("node", "fp")
    placed = own.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    named = placed.join(lowest, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")
