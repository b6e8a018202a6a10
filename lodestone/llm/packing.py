"""Sum-of-squares packing of token sequences.

A document's ids end with ``end_id``; only documents of more than ``capacity`` ids are cut, into pieces of that size.
Each piece is placed where the sum over residual gaps of the squared number of open bins becomes smallest: into an open
bin with some gap, or into a new one. Equal sums go to the smallest gap. Longer pieces come first, and at the end
open bins whose contents fit into another's gap are joined.

Pieces are dealt by a hash of id, piece and a running number into shards of about ``shard`` pieces, which are
packed side by side, so a task holds a bounded number of small rows whatever ids repeat. Texts are read and encoded once;
what is packed holds lengths and checksums only.

Null texts count as empty (one end id). Repeated rows are packed as often as they stand. Null ids are allowed, extra
columns ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, materialise
from lodestone.llm.tokens import LIMIT, encoder

CAPACITY = 4096


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, cached: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): ``row`` numbers the documents of an input partition; ``cached`` bounds an encoder's cache."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = encoder(tokenizer, True, limit=cached), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, crc32(part), row))
                row += 1
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long", encodes=True)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length, in 1..capacity; bins are numbered from 0."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_count = np.zeros(capacity + 1, np.int64)  # bins by gap; full and empty ones don't count
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    members: list[list[int]] = []
    never = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if size == capacity:
            members.append([i])
            continue
        gaps = open_count[size:capacity]
        change = 2 * (open_count[: capacity - size] - gaps) + 2
        change[:1] = 1 - 2 * gaps[:1]  # the gap closes
        change = np.where(gaps > 0, change, never)
        at = int(np.argmin(change)) if len(change) else 0
        if not len(change) or change[at] > 2 * open_count[capacity - size] + 1:
            gap, b = capacity, len(members)
            members.append([])
        else:
            gap = at + size
            b = waiting[gap].pop()
            open_count[gap] -= 1
        members[b].append(i)
        left = gap - size
        if left:
            open_count[left] += 1
            waiting[left].append(b)
    _join_open(members, waiting, capacity)
    number = 0
    for held in members:
        if held:
            own = lengths[held]
            bins[held] = number
            offsets[held] = np.cumsum(own) - own
            number += 1
    return bins, offsets


def _join_open(members: list[list[int]], waiting: list[list[int]], capacity: int) -> None:
    """Moves whole contents of open bins, fullest first, into the smallest gap that takes them (ties: the first bin)."""
    rest = sorted((gap, b) for gap, held in enumerate(waiting) for b in held)
    at_gap: dict[int, list[int]] = {}
    gaps: list[int] = []  # those with bins, ascending; at most ``capacity`` of them

    def keep(gap: int, b: int) -> None:
        if gap not in at_gap:
            at_gap[gap] = []
            insort(gaps, gap)
        heapq.heappush(at_gap[gap], b)

    for gap, b in rest:
        place = bisect_left(gaps, capacity - gap)
        if place == len(gaps):
            keep(gap, b)
            continue
        found = gaps[place]
        into = heapq.heappop(at_gap[found])
        if not at_gap[found]:
            del at_gap[found], gaps[place]
        members[into] += members[b]
        members[b] = []
        keep(found - (capacity - gap), into)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, shard: int = 50_000, cached: int = LIMIT
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    cut = materialise(pieces(docs, tokenizer, end_id, capacity, cached), "pieces")
    shards = max(1, -(-cut.count() // shard))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "row"], kind="stable")
        number, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = number + rows["shard"].astype("int64") * (1 << 32)
        rows["offset"] = offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, piece, row), {shards}) as int)"))
    return dealt.groupBy("shard").applyInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
