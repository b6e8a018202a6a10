"""Normalisation, static and routed fusion of rankings (query_id, channel, ordinal, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scores import distribution, reciprocal_rank, relative
from lodestone.operators.rankers import CHANNELS

DEPTH = 200
METHODS = ("rrf", "relative", "dbsf")


def normalized(rankings: DataFrame, method: str, depth: int = DEPTH) -> DataFrame:
    """Rankings cut to ``depth`` with ``norm``."""
    cut = rankings.filter(F.col("rank") <= depth)
    if method == "rrf":
        return cut.withColumn("norm", reciprocal_rank(F.col("rank")))
    w = Window.partitionBy("query_id", "channel")
    low, high = F.min("score").over(w), F.max("score").over(w)
    if method == "relative":
        return cut.withColumn("norm", relative(F.col("score"), low, high))
    if method == "dbsf":
        norm = distribution(F.col("score"), F.avg("score").over(w), F.stddev_samp("score").over(w), low, high)
        return cut.withColumn("norm", norm)
    raise ValueError(f"unknown fusion method {method!r}; one of {METHODS}")


def static_weights(weights: dict[str, float]) -> Column:
    """A channel's weight; channels that aren't named weigh nothing."""
    out = F.lit(0.0)
    for channel in CHANNELS:
        if weights.get(channel, 0) > 0:
            out = F.when(F.col("channel") == channel, float(weights[channel])).otherwise(out)
    return out


def fused(weighted: DataFrame) -> DataFrame:
    """(query_id, ordinal, score, rank) of rows with ``norm`` and ``weight``; channels of no weight are left out."""
    sums = weighted.filter("weight > 0").groupBy("query_id", "ordinal").agg(F.sum(F.col("weight") * F.col("norm")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ordinal")
    return sums.withColumn("rank", F.row_number().over(order))


def fuse(rankings: DataFrame, method: str, weights: dict[str, float], depth: int = DEPTH) -> DataFrame:
    return fused(normalized(rankings, method, depth).withColumn("weight", static_weights(weights)))
