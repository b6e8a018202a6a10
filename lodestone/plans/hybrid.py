"""The hybrid query: five rankings of a batch of queries, evidence, routed weights, fusion, filters, top results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import evidence as ev
from lodestone.operators import rankers as rk
from lodestone.operators.fusion import DEPTH, fused, normalized
from lodestone.operators.index import LexicalIndex, listed_names, name_lists
from lodestone.operators.stored import stored


@dataclass(frozen=True)
class Corpus:
    """chunks (ordinal, file, text), vectors (ordinal, v), written name lists (ordinal, names, words) and the lexical index."""

    chunks: DataFrame
    names: DataFrame
    vectors: DataFrame
    index: LexicalIndex

    @classmethod
    def build(cls, chunks: DataFrame, identifiers: DataFrame, vectors: DataFrame) -> Corpus:
        """``identifiers`` are rows (name, ordinal), or lists (ordinal, names) with one row a chunk."""
        names = name_lists(identifiers) if "name" in identifiers.columns else listed_names(identifiers)
        return cls(chunks, stored(names, "names"), vectors, LexicalIndex.build(chunks))

    def scores(self, queries: DataFrame, depth: int | None = None) -> dict[str, DataFrame]:
        """Scores of (query_id, text, v) by channel; with a ``depth``, of the rows that may be among the first."""
        return {
            "identity": rk.rank_identity(queries, self.names),
            "camelcase": rk.rank_camelcase(queries, self.names, depth),
            "bm25": rk.rank_bm25(queries, self.index, depth),
            "dense": rk.rank_dense(queries.filter("v is not null"), self.vectors, depth),
            "sparse": rk.rank_sparse(queries, self.index, depth),
        }

    def rankings(self, queries: DataFrame, depth: int | None = None) -> DataFrame:
        """All five rankings of (query_id, text, v), whole or their first ``depth`` rows."""
        return reduce(DataFrame.unionByName, [rk.ranked(channel, scores, depth) for channel, scores in self.scores(queries, depth).items()])

    def counts(self, queries: DataFrame) -> DataFrame:
        """(query_id, channel, n): how long the whole rankings are."""
        each = [scores.groupBy("query_id").count().select("query_id", F.lit(channel).alias("channel"), F.col("count").alias("n")) for channel, scores in self.scores(queries).items()]
        return reduce(DataFrame.unionByName, each)

    def evidence(self, queries: DataFrame, rankings: DataFrame) -> DataFrame:
        """``rankings`` need their first rows only; the spread of dense scores is that of all vectors."""
        dense = rk.rank_dense(queries.filter("v is not null"), self.vectors).select("query_id", "score")
        return ev.evidence(queries, rankings, ev.coverage(queries, self.index, self.names), stored(dense, "dense"))


def hybrid(corpus: Corpus, queries: DataFrame, k: int = 5, keep: Column | None = None, method: str = "dbsf") -> DataFrame:
    """(query_id, rank, ordinal, file, score, rel): evidence and fusion from the first 200 of each list, the spread of dense scores from all, filter before top-K."""
    queries = stored(queries, "queries")
    rankings = stored(corpus.rankings(queries, DEPTH), "rankings")
    weights = stored(ev.routed(corpus.evidence(queries, rankings)), "weights")
    got = fused(normalized(rankings, method, DEPTH).join(rk.bounded(weights), ["query_id", "channel"]))
    total = weights.groupBy("query_id").agg(F.sum("weight").alias("w"))
    scale = 60.0 if method == "rrf" else 1.0
    named = got.drop("rank").join(corpus.chunks.select("ordinal", "file"), "ordinal")
    if keep is not None:
        named = named.filter(keep)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ordinal")
    top = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    rel = F.when(F.col("w") > 0, F.col("score") * scale / F.col("w")).otherwise(0.0)
    return top.join(total, "query_id").select("query_id", "rank", "ordinal", "file", "score", rel.alias("rel"))


def hydrate(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with text, joined after the cut, where the texts are read; ``ok`` says whether the text still has its recorded hash."""
    found = rk.bounded(stored(results, "results"))
    return chunks.select("ordinal", "text", "hash").join(found, "ordinal").withColumn("ok", F.sha2("text", 256) == F.col("hash"))
