"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Equal vectors form one class, which keeps its smallest ``k + 1`` ids: more of them can never be among a query's ``k``
nearest. Classes are dealt by a hash of the vector into shards of about ``shard_rows``; each shard's graph is built by one
task and stored as one row of flat arrays (vectors, ids, and for each layer its nodes and a padded neighbour matrix), so the
index is an ordinary table that lost executors rebuild or reread. Blocks of queries meet every shard; each search
gives its nearest classes, whose ids are expanded and ranked by the exact Euclidean distance in double precision on the
original vectors, ties to the smaller id. Each shard's ``k`` nearest are merged.

Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null id, take no part. Only vectors
of equal dimension are compared. A row that repeats with the same id and vector counts once; an id with several vectors is found once,
with the nearest of them, and as a query is asked with each. Large components are scaled, so squares stay finite. Extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import materialise

LINKS, BASE_LINKS, SLACK = 16, 32, 16
EF_BUILD, EF_SEARCH = 80, 160


def scale_of(vectors: np.ndarray) -> float:
    """A power of two that keeps squares of the largest components finite."""
    return float(2.0 ** np.floor(np.log2(np.abs(vectors).max()))) if len(vectors) else 1.0


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.asarray(vectors, np.float64) / scale_of(vectors)


class Graph:
    """Neighbour arrays by layer; rows are padded, ``degree`` says how far they are filled."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = scaled(vectors)
        self.scale = scale_of(vectors)
        self.norms = (self.vectors**2).sum(axis=1)
        n = len(vectors)
        self.levels = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)), 12).astype(np.int64)
        top = int(self.levels.max(initial=0))
        self.rows = [np.where(self.levels >= k, np.cumsum(self.levels >= k) - 1, -1) for k in range(top + 1)]
        self.links = [np.full((int((self.levels >= k).sum()), (BASE_LINKS if k == 0 else LINKS) + SLACK), -1, np.int32) for k in range(top + 1)]
        self.degree = [np.zeros(len(x), np.int32) for x in self.links]
        self.entry = -1
        self.stamp = np.zeros(n, np.int32)
        self.clock = 0

    def build(self) -> Graph:
        for i in range(len(self.vectors)):
            self._insert(i)
        return self

    def _distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.norms[at] - 2.0 * (self.vectors[at] @ q)

    def search_layer(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        self.clock += 1
        stamp, clock, links, degree, rows = self.stamp, self.clock, self.links[layer], self.degree[layer], self.rows[layer]
        for _, e in entries:
            stamp[e] = clock
        ahead = list(entries)
        heapq.heapify(ahead)
        best = [(-d, e) for d, e in entries]
        heapq.heapify(best)
        while ahead:
            d, c = heapq.heappop(ahead)
            if len(best) >= ef and d > -best[0][0]:
                break
            r = rows[c]
            near = links[r, : degree[r]]
            near = near[stamp[near] != clock]
            if not len(near):
                continue
            stamp[near] = clock
            ds = self._distances(q, near)
            if len(best) >= ef:
                keep = ds < -best[0][0]
                near, ds = near[keep], ds[keep]
            for d, e in zip(ds.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-d, e))
                    heapq.heappush(ahead, (d, e))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, e))
                    heapq.heappush(ahead, (d, e))
        return sorted((-d, e) for d, e in best)

    def _diverse(self, found: list[tuple[float, int]], most: int, norm: float) -> list[int]:
        """Neighbours closer to the node than to each other; nearest others fill up."""
        if len(found) <= most:
            return [e for _, e in found]
        at = np.array([e for _, e in found])
        v = self.vectors[at]
        across = self.norms[at][:, None] + self.norms[at] - 2.0 * (v @ v.T)
        own = np.array([d for d, _ in found]) + norm
        nearest = np.full(len(at), np.inf)
        chosen: list[int] = []
        for k in range(len(at)):
            if own[k] < nearest[k]:
                chosen.append(k)
                np.minimum(nearest, across[k], out=nearest)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [k for k in range(len(at)) if k not in taken][: most - len(chosen)]
        return at[chosen].tolist()

    def _insert(self, i: int) -> None:
        q, level = self.vectors[i], int(self.levels[i])
        if self.entry < 0:
            self.entry = i
            return
        top = int(self.levels[self.entry])
        entries = [(float(self._distances(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(top, level, -1):
            entries = self.search_layer(q, entries[:1], 1, layer)
        for layer in range(min(level, top), -1, -1):
            entries = self.search_layer(q, entries, EF_BUILD, layer)
            chosen = self._diverse(entries, LINKS, float(self.norms[i]))
            r = self.rows[layer][i]
            self.links[layer][r, : len(chosen)] = chosen
            self.degree[layer][r] = len(chosen)
            for e in chosen:
                self._link(layer, e, i)
        if level > top:
            self.entry = i

    def _link(self, layer: int, e: int, i: int) -> None:
        r, links, degree = self.rows[layer][e], self.links[layer], self.degree[layer]
        if degree[r] == links.shape[1]:
            near = links[r].copy()
            ds = self._distances(self.vectors[e], near)
            found = sorted(zip(ds.tolist(), near.tolist(), strict=True))
            kept = self._diverse(found, links.shape[1] - SLACK, float(self.norms[e]))
            links[r, : len(kept)] = kept
            degree[r] = len(kept)
        links[r, degree[r]] = i
        degree[r] += 1

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        if self.entry < 0:
            return []
        q = q / self.scale
        entries = [(float(self._distances(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            entries = self.search_layer(q, entries[:1], 1, layer)
        return [e for _, e in self.search_layer(q, entries, ef, 0)]

    def flat(self) -> dict[str, bytes | list[bytes]]:
        return {
            "levels": self.levels.astype(np.int8).tobytes(),
            "links": [x.tobytes() for x in self.links],
            "degrees": [x.tobytes() for x in self.degree],
            "entry": int(self.entry),
        }

    @classmethod
    def from_flat(cls, vectors: np.ndarray, row: dict) -> Graph:
        g = cls.__new__(cls)
        g.vectors = scaled(vectors)
        g.scale = scale_of(vectors)
        g.norms = (g.vectors**2).sum(axis=1)
        g.levels = np.frombuffer(row["levels"], np.int8).astype(np.int64)
        g.rows = [np.where(g.levels >= k, np.cumsum(g.levels >= k) - 1, -1) for k in range(len(row["links"]))]
        g.links = [
            np.frombuffer(x, np.int32).reshape(-1, (BASE_LINKS if k == 0 else LINKS) + SLACK) for k, x in enumerate(row["links"])
        ]
        g.degree = [np.frombuffer(x, np.int32) for x in row["degrees"]]
        g.entry = row["entry"]
        g.stamp, g.clock = np.zeros(len(vectors), np.int32), 0
        return g


def euclidean(vectors: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances in double precision; differences whose squares would overflow or vanish are scaled first."""
    off = vectors - v
    with np.errstate(over="ignore"):
        plain = np.sqrt(np.cumsum(off**2, axis=1)[:, -1])  # added up in the order of components
    odd = ~np.isfinite(plain) | (plain < 1e-140)
    if odd.any():
        most = np.abs(off[odd]).max(axis=1)
        plain[odd] = np.where(most > 0, most * np.sqrt(((off[odd] / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(axis=1)), 0.0)
    return plain


INDEX = (
    "dim int, shard int, vectors binary, ids binary, id_ends binary, levels binary, links array<binary>, degrees array<binary>, entry int"
)
INDEX_ARROW = pa.schema(
    [
        ("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("id_ends", pa.binary()),
        ("levels", pa.binary()), ("links", pa.list_(pa.binary())), ("degrees", pa.list_(pa.binary())), ("entry", pa.int32()),
    ]
)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    v = F.col("v")
    return (
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .filter(F.exists(v, lambda x: x != 0))
        .select("id", "v", F.size("v").alias("dim"))
    )


def build(rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192) -> DataFrame:
    """The index: one row for each shard."""
    single = usable(rows, id_col, vector_col).distinct()  # repeated rows go before a key gathers
    lowest = Window.partitionBy("v").orderBy("id")
    first = single.withColumn("r", F.row_number().over(lowest)).filter(F.col("r") <= k + 1)
    classes = materialise(
        first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("dim").alias("dim")), "vector-classes"
    )
    shards = max(1, -(-classes.count() // shard_rows))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("low", "ascending"), ("spread", "ascending")])
        dim, ids = t["dim"][0].as_py(), t["ids"].combine_chunks()
        vectors = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        graph = Graph(vectors, t["shard"][0].as_py()).build()
        row = {
            "dim": dim,
            "shard": t["shard"][0].as_py(),
            "vectors": vectors.tobytes(),
            "ids": ids.flatten().to_numpy().tobytes(),
            "id_ends": np.cumsum([len(x) for x in ids]).tobytes(),
            **graph.flat(),
        }
        return pa.Table.from_pylist([row], INDEX_ARROW)

    spread = F.xxhash64("v")
    dealt = classes.select(
        "v", "ids", "dim", F.element_at("ids", 1).alias("low"), spread.alias("spread"), F.pmod(spread, F.lit(shards)).cast("int").alias("shard")
    )
    return materialise(dealt.groupBy("dim", "shard").applyInArrow(run, INDEX), "hnsw-index")


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2000) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest, the query's own id excluded."""
    asked = materialise(usable(queries, id_col, vector_col).distinct().withColumn("q", F.xxhash64("id", "v")), "queries")
    blocks = max(1, -(-asked.count() // block))
    places = index.select(F.col("dim").alias("of"), F.col("shard").alias("place"))
    left = asked.withColumn("block", F.pmod("q", F.lit(blocks)).cast("int")).join(places, F.col("dim") == F.col("of")).drop("of")
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, float]] = []
        if asked.num_rows and held.num_rows:
            row = held.to_pylist()[0]
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            graph = Graph.from_flat(vectors, row)
            for q, own, v in zip(*(asked[c].to_pylist() for c in ("q", "id", "v")), strict=True):
                v = np.array(v)
                near = np.array(graph.nearest(v, max(EF_SEARCH, 2 * k)))
                exact = euclidean(vectors[near], v)
                best: dict[int, float] = {}
                for d, c in zip(exact.tolist(), near.tolist(), strict=True):
                    for i in ids[starts[c] : ends[c]].tolist():
                        if i != own and d < best.get(i, np.inf):
                            best[i] = d
                out += [(q, own, i, d) for d, i in heapq.nsmallest(k, ((d, i) for i, d in best.items()))]
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["q", "query_id", "vec_id", "score"])

    left, right = left.groupBy("dim", "place", "block"), right.groupBy("dim", "shard", "block")
    found = left.cogroup(right).applyInArrow(run, "q long, query_id long, vec_id long, score double")
    found = found.groupBy("q", "query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Index all rows, search with those whose vec_id is divisible by ``every``."""
    return search(build(rows, k), rows.filter(F.col("vec_id") % every == 0), k)
