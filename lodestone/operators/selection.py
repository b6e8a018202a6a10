"""Choosing weights: candidate evaluation, best weights of each channel subset, proxy samples, guardrails, stability, scouts; sparse encoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.rankers import CHANNELS

PROXY_SHARE, PROXY_LEAST = 0.25, 32
TOLERANCE = 0.01
#: Candidates are sent to every task; a grid of four levels for five channels has 1,023.
MOST_CANDIDATES = 4**5


def sparse_documents(logits: DataFrame, special: list[int]) -> DataFrame:
    """(doc, token_id, weight) of (doc, position, token_id, logit) rows that the attention mask keeps: largest logit, damped twice."""
    most = logits.groupBy("doc", "token_id").agg(F.max("logit").cast("double").alias("m"))
    kept = most.filter((F.col("m") > 0) & ~F.col("token_id").isin(special))
    return kept.select("doc", "token_id", F.log1p(F.log1p("m")).alias("weight"))


def sparse_query_ids(ids: Column, special: list[int]) -> Column:
    """Distinct ids of a query without special ones, ascending."""
    return F.array_sort(F.array_except(ids, F.array(*[F.lit(s) for s in special])))


def candidate_ranks(norms: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(candidate, query_id, ordinal, rank): the first ``k`` of every candidate (candidate, one weight a channel)."""
    if candidates.count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates at once; evaluate them in parts")
    long = candidates.unpivot("candidate", list(CHANNELS), "channel", "weight").filter("weight > 0")
    sums = norms.join(F.broadcast(long), "channel").groupBy("candidate", "query_id", "ordinal")
    scored = sums.agg(F.sum(F.col("weight") * F.col("norm")).alias("score"))
    order = Window.partitionBy("candidate", "query_id").orderBy(F.desc(F.round("score", 9)), "ordinal")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("score")


def candidate_quality(ranks: DataFrame, candidates: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(candidate, recall_k): mean over queries with targets of the share of targets (query_id, target, ordinal) found in time."""
    sizes = gold.groupBy("query_id").agg(F.countDistinct("target").alias("n"))
    hits = ranks.join(gold.select("query_id", "target", "ordinal"), ["query_id", "ordinal"]).groupBy("candidate", "query_id", "target").agg(F.min("rank").alias("rank"))
    share = lambda k: F.sum(F.when(F.col("rank") <= k, 1.0).otherwise(0.0) / F.col("n"))
    sums = hits.join(sizes, "query_id").groupBy("candidate").agg(*[share(k).alias(f"recall_{k}") for k in ks])
    asked = max(1, sizes.count())
    whole = candidates.select("candidate").join(sums, "candidate", "left")
    return whole.select("candidate", *[(F.coalesce(f"recall_{k}", F.lit(0.0)) / asked).alias(f"recall_{k}") for k in ks])


def best_of_subsets(candidates: DataFrame, quality: DataFrame, order: tuple[str, ...] = ("recall_20", "recall_10", "recall_5")) -> DataFrame:
    """The best candidate of each set of channels with weight; ties to the smaller candidate."""
    active = F.concat_ws("+", *[F.when(F.col(c) > 0, F.lit(c)) for c in CHANNELS])
    w = Window.partitionBy("active").orderBy(*[F.desc(F.round(c, 9)) for c in order], "candidate")
    return candidates.withColumn("active", active).join(quality, "candidate").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def proxy_samples(samples: DataFrame, groups: list[str], order: str) -> DataFrame:
    """A quarter of the samples, 32 at least, taken in turn from each group; groups and samples in ascending ``order``."""
    n = samples.count()
    target = max(PROXY_LEAST, -int(-n * PROXY_SHARE // 1))
    if target >= n:
        return samples
    firsts = samples.groupBy(*groups).agg(F.min(order).alias("__first"))
    placed = firsts.withColumn("__at", F.row_number().over(Window.orderBy("__first")))  # one row a group
    turn = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    taken = samples.withColumn("__turn", turn).join(F.broadcast(placed) if placed.count() <= 10_000 else placed, groups)
    return taken.orderBy("__turn", "__at").limit(target).select(*samples.columns)


def guardrail_blockers(candidate: DataFrame, baseline: DataFrame, key: list[str], metrics: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(key, metric, candidate_value, baseline_value, delta) of each metric that falls below the baseline by more than the tolerance."""
    a = candidate.unpivot(key, metrics, "metric", "candidate_value")
    b = baseline.unpivot(key, metrics, "metric", "baseline_value")
    delta = F.round(F.col("candidate_value") - F.col("baseline_value"), 12)
    return a.join(b, [*key, "metric"]).withColumn("delta", delta).filter(F.col("delta") < -tolerance)


def stability(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, folds, distinct_selections, selection_frequency, median_drop, worst_drop) of holdout rows (key, config, drop)."""
    chosen = rows.groupBy(*key, "config").agg(F.count(F.lit(1)).alias("n")).groupBy(*key)
    chosen = chosen.agg(F.sum("n").alias("folds"), F.count(F.lit(1)).alias("distinct_selections"), (F.max("n") / F.sum("n")).alias("selection_frequency"))
    placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy("drop"))).join(chosen, key)
    middle = F.max(F.when(F.col("__at") == F.floor(F.col("folds") / 2) + 1, F.col("drop")))
    drops = placed.groupBy(*key).agg(F.round(middle, 12).alias("median_drop"), F.round(F.greatest(F.lit(0.0), F.max("drop")), 12).alias("worst_drop"))
    return chosen.join(drops, key)


def halton_points(count: int, dimensions: int) -> np.ndarray:
    """Points 1 to ``count`` of the Halton sequence, one prime base a dimension."""
    primes: list[int] = []
    n = 2
    while len(primes) < dimensions:
        if all(n % p for p in primes):
            primes.append(n)
        n += 1
    left = np.repeat(np.arange(1, count + 1)[:, None], dimensions, axis=1)
    base, out, scale = np.array(primes), np.zeros(left.shape), 1.0 / np.array(primes)
    while left.any():
        left, digit = np.divmod(left, base)
        out += digit * scale
        scale = scale / base
    return out


def random_points(count: int, dimensions: int, seed: int = 1) -> np.ndarray:
    """Points of the 32-bit xorshift generator with shifts 13, 17 and 5."""
    state, out = seed, []
    for _ in range(count * dimensions):
        state = (state ^ state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state = (state ^ state << 5) & 0xFFFFFFFF
        out.append(state / 2**32)
    return np.array(out).reshape(count, dimensions)


def levels(points: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(n - 1, (points * n).astype(int))
