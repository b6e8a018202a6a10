"""Evidence of each query and channel, and the weights that it routes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scores import EPSILON, clamp, gap
from lodestone.functions.text import split_identifier, tokenize
from lodestone.operators.index import LexicalIndex
from lodestone.operators.rankers import CHANNELS, bounded, query_terms

TOP = 20
DEPTHS = (5, 10, 20)
#: The promoted production parameters (fixed values), by channel in the order of CHANNELS.
PROMOTED = {
    "base": (0.6, 0.5, 0.9, 1.0, 0.1),
    "score": (0.0, 0.5, 0.8, 0.6, 0.0),
    "geometry": (0.0, 0.6, 0.1, 0.0, 0.0),
    "coverage": (0.0, 0.1, 0.2, 0.0, 0.0),
    "agreement": (0.0, 0.9, 0.8, 0.8, 0.7),
    "dense": (0.0, 0.0, 0.0, 0.6, 0.0),
    "identifier": (0.0, 0.4, -0.1, -0.1, -0.7),
    "length": (0.0, -0.3, -0.4, -0.3, -0.4),
}


def separation(rankings: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, channel, n, separation) over whole lists, or over their first rows, at least ten, with the ``counts`` of the whole."""
    deep = F.max(F.when(F.col("rank") <= 10, F.struct("rank", "score")))  # the tenth, or the last of a shorter list
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    got = rankings.groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("n"), top.alias("a"), deep["score"].alias("b"))
    if counts is not None:
        got = got.drop("n").join(counts, ["query_id", "channel"])
    value = F.when(F.col("n") == 1, 1.0).otherwise(gap(F.col("a"), F.col("b")))
    return got.select("query_id", "channel", "n", value.alias("separation"))


def geometry(rankings: DataFrame) -> DataFrame:
    """(query_id, channel, gap_2, gap_3, gap_10, gap_20, auc, plateau, entropy, effective, geometry) of the first 20."""
    w = Window.partitionBy("query_id", "channel")
    top = rankings.filter(F.col("rank") <= TOP).select(
        "query_id", "channel", "rank", "score", F.max("score").over(w).alias("hi"), F.min("score").over(w).alias("lo"), F.count(F.lit(1)).over(w).alias("n")
    )
    u = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(clamp((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    top = top.withColumn("u", u).withColumn("p", F.col("u") / F.sum("u").over(w))
    at = lambda r: F.max(F.when(F.col("rank") == F.least(F.lit(r), F.col("n")), F.col("score")))
    got = top.groupBy("query_id", "channel").agg(
        F.max("n").alias("n"),
        *[at(r).alias(f"s{r}") for r in (1, 2, 3, 10, 20)],
        F.avg("u").alias("auc"),
        F.avg(F.when(F.col("u") >= 0.9, 1.0).otherwise(0.0)).alias("plateau"),
        F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).alias("h"),
        F.sum(F.col("p") * F.col("p")).alias("p2"),
    )
    one = F.col("n") == 1
    got = got.select(
        "query_id",
        "channel",
        *[F.when(one, 1.0).otherwise(gap(F.col(a), F.col(b))).alias(c) for a, b, c in (("s1", "s2", "gap_2"), ("s1", "s3", "gap_3"), ("s1", "s10", "gap_10"), ("s3", "s20", "gap_20"))],
        F.when(one, 1.0).otherwise(F.col("auc")).alias("auc"),
        F.when(one, 0.0).otherwise(F.col("plateau")).alias("plateau"),
        F.when(one, 0.0).otherwise(F.col("h") / F.log(F.col("n").cast("double"))).alias("entropy"),
        F.when(one, 0.0).otherwise((1 / F.col("p2") - 1) / F.greatest(F.lit(1), F.col("n") - 1)).alias("effective"),
        one.alias("one"),
    )
    gaps = (F.col("gap_2") + F.col("gap_3") + F.col("gap_10") + F.col("gap_20")) / 4
    shape = ((1 - F.col("auc")) + (1 - F.col("plateau")) + (1 - F.col("entropy")) + (1 - F.col("effective"))) / 4
    return got.withColumn("geometry", F.when(F.col("one"), 1.0).otherwise(clamp((gaps + shape) / 2))).drop("one")


def agreement_pairs(rankings: DataFrame) -> DataFrame:
    """(query_id, a, b, agreement) of channels with common rows among their first 20."""
    top = rankings.filter(F.col("rank") <= TOP).select("query_id", "channel", "ordinal", "rank")
    n = top.groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    left = top.select("query_id", "ordinal", F.col("channel").alias("a"), F.col("rank").alias("ra"))
    right = top.select("query_id", "ordinal", F.col("channel").alias("b"), F.col("rank").alias("rb"))
    both = left.join(right, ["query_id", "ordinal"]).filter("a < b").groupBy("query_id", "a", "b")
    shared = both.agg(
        *[F.sum(F.when((F.col("ra") <= d) & (F.col("rb") <= d), 1.0 / (F.col("ra") * F.col("rb"))).otherwise(0.0)).alias(f"x{d}") for d in DEPTHS]
    )
    harmonic = F.array(*[F.lit(sum(1 / i for i in range(1, k + 1))) for k in range(1, TOP + 1)])
    h = lambda n, d: F.element_at(harmonic, F.least(F.col(n), F.lit(d)).cast("int"))
    sized = shared.join(n.select("query_id", F.col("channel").alias("a"), F.col("n").alias("na")), ["query_id", "a"]).join(
        n.select("query_id", F.col("channel").alias("b"), F.col("n").alias("nb")), ["query_id", "b"]
    )
    value = sum((F.col(f"x{d}") / h("na", d) + F.col(f"x{d}") / h("nb", d)) / 2 for d in DEPTHS) / len(DEPTHS)
    return sized.select("query_id", "a", "b", value.alias("agreement"))


def agreement(rankings: DataFrame) -> DataFrame:
    """(query_id, channel, agreement): mean over the four other channels, absent ones counting as zero."""
    pairs = agreement_pairs(rankings)
    ends = pairs.select("query_id", F.explode(F.array("a", "b")).alias("channel"), "agreement")
    return ends.groupBy("query_id", "channel").agg((F.sum("agreement") / (len(CHANNELS) - 1)).alias("agreement"))


def dense_confidence(rankings: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(query_id, median, mad, dense_confidence) over the whole dense list; medians are exact.

    ``whole`` has all its scores (query_id, score), where ``rankings`` have the first rows only, at least ``TOP``.
    """
    dense = rankings.filter(F.col("channel") == "dense")
    whole = dense if whole is None else whole
    mid = whole.groupBy("query_id").agg(F.median("score").alias("median"), F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    spread = whole.join(mid, "query_id").groupBy("query_id").agg(F.median(F.abs(F.col("score") - F.col("median"))).alias("mad"))
    tail = F.max(F.when(F.col("rank") == F.least(F.lit(TOP), F.col("n")), F.col("score"))).alias("tail")
    got = mid.join(spread, "query_id").join(dense.join(mid, "query_id").groupBy("query_id").agg(tail), "query_id")
    g = F.col("top") - F.col("median")
    value = (
        clamp(g / (F.abs("top") + F.abs("median") + EPSILON))
        + clamp(g / (1.4826 * F.col("mad") + EPSILON) / 6)
        + F.when(g == 0, 0.0).otherwise(clamp((F.col("tail") - F.col("median")) / g))
    ) / 3
    return got.select("query_id", "median", "mad", F.when(F.col("n") == 1, 1.0).otherwise(value).alias("dense_confidence"))


def coverage(queries: DataFrame, index: LexicalIndex, names: DataFrame) -> DataFrame:
    """(query_id, identity, camelcase, bm25): shares of the query that the lexical indexes know; ``names`` are name lists.

    What the queries ask for goes to the lists, so only their own words are ever dealt out.
    """
    terms = query_terms(queries).select("query_id", "term")
    unknown = F.log(F.lit(1 + (index.n + 0.5) / 0.5))
    idf = F.coalesce("idf", unknown)
    bm25 = terms.join(index.idf(terms), "term", "left").groupBy("query_id").agg(
        (F.sum(F.when(F.col("idf").isNotNull(), idf).otherwise(0.0)) / F.sum(idf)).alias("bm25")
    )
    asked = queries.select("query_id", F.explode(F.array_distinct(split_identifier(F.col("text")))).alias("word"))
    known = names.select(F.explode("words").alias("word")).join(bounded(asked.select("word").distinct()), "word", "left_semi").distinct()
    camel = asked.join(known.withColumn("hit", F.lit(1.0)), "word", "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("camelcase"))
    lower = queries.select("query_id", F.lower("text").alias("name_lc"))
    found = names.select(F.explode("names").alias("name_lc")).join(bounded(lower.select("name_lc").distinct()), "name_lc", "left_semi").distinct()
    ident = lower.join(found.withColumn("identity", F.lit(1.0)), "name_lc", "left").select("query_id", "identity")
    every = queries.select("query_id").join(ident, "query_id", "left").join(camel, "query_id", "left").join(bm25, "query_id", "left")
    return every.select("query_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("identity", "camelcase", "bm25")])


def _of(values: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for channel, value in zip(CHANNELS, values, strict=True):
        out = F.when(F.col("channel") == channel, float(value)).otherwise(out)
    return out


def evidence(queries: DataFrame, rankings: DataFrame, cover: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """One row for each query and channel that has a list, with all signals; ``whole`` as in ``dense_confidence``."""
    flat = cover.selectExpr("query_id", "stack(3, 'identity', identity, 'camelcase', camelcase, 'bm25', bm25) as (channel, coverage)")
    size = F.size(tokenize(F.col("text")))
    signal = queries.select(
        "query_id",
        F.when((F.length("text") > 0) & ~F.col("text").rlike("\\s"), 1.0).otherwise(0.0).alias("identifier"),
        F.when(size <= 2, 0.0).when(size >= 8, 1.0).otherwise(0.5).alias("length"),
    )
    dense = dense_confidence(rankings, whole).select("query_id", F.lit("dense").alias("channel"), "dense_confidence")
    key = ["query_id", "channel"]
    return (
        separation(rankings)
        .join(geometry(rankings).select(*key, "geometry"), key)
        .join(agreement(rankings), key, "left")
        .join(flat, key, "left")
        .join(dense, key, "left")
        .join(signal, "query_id")
        .select(
            *key,
            "separation",
            "geometry",
            F.coalesce("agreement", F.lit(0.0)).alias("agreement"),
            F.coalesce("coverage", F.lit(0.5)).alias("coverage"),
            F.coalesce("dense_confidence", F.lit(0.5)).alias("dense_confidence"),
            "identifier",
            "length",
        )
    )


def routed(found: DataFrame, parameters: dict[str, tuple[float, ...]] = PROMOTED) -> DataFrame:
    """(query_id, channel, weight)."""
    c = {k: _of(v) for k, v in parameters.items()}
    around = lambda name, key: 1 + c[key] * (2 * F.col(name) - 1) * 0.5
    weight = (
        c["base"]
        * (1 - c["score"] * (1 - F.col("separation")) * 0.75)
        * around("geometry", "geometry")
        * around("coverage", "coverage")
        * around("dense_confidence", "dense")
        * (1 - c["agreement"] * (1 - F.col("agreement")) * 0.5)
        * around("identifier", "identifier")
        * around("length", "length")
    )
    return found.select("query_id", "channel", F.greatest(F.lit(0.0), weight).alias("weight"))
