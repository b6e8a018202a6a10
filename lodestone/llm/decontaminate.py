"""Benchmark decontamination: item-sized windows, candidates by rare shingles, exact weighted-shingle similarity.

DataFrame functions only. Words are runs of letters and digits of the lower-cased text; shingles are five words (all words
of an item with fewer), hashed to 64 bits. A window of a document is as long as an item, at any place of the document (a shorter
document is one window). Compared is the weighted similarity: the sum of the smaller shingle counts over the sum of the larger; a
document holds an item if one of its windows reaches ``SIMILARITY``.

SimHash fingerprints of the windows cannot give this: at that similarity two fingerprints differ by up to 15 bits and more, blocks
that guarantee such a radius are 4 bits wide and prune nothing, and a radius loses windows (README). So candidates come from the
prefix filter instead, which loses none: a window that reaches the similarity holds at least ceil(SIMILARITY * m) of the item's m
shingles, so it holds one of any m - ceil(SIMILARITY * m) + 1 of them. Those that the fewest items have are joined with all
shingles of all texts. For each candidate pair of text and item, every window is then compared exactly at once: an occurrence of
an item's shingle counts in the windows that begin after the occurrence which would be one too many, so it adds one to a range of
window starts, and a running sum over the ends of these ranges is the number of common shingles of each window.

Equal texts and equal items are worked on once. Work is one row for each occurrence of an item's shingle in a candidate text,
dealt by text and item. Keys are broadcast only if their counted number is below ``BROADCAST_ROWS``, else they are joined by shuffle.

Null or empty texts and items have no windows. Very long texts are windowed whole. Of windows of equal similarity the first is
reported. Repeated rows, null ids and extra columns are allowed; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import materialise

WIDTH = 5
SIMILARITY = 0.8
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if the counted rows are few; otherwise the planner shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def shingles(w: Column, width: int) -> Column:
    return F.when(
        F.size(w) >= width,
        F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<long>"))


def items(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(item, width, h): distinct items by content with their shingles."""
    listed = benchmark.select(words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    own = listed.select(F.md5(F.array_join("w", " ")).alias("item"), "w").groupBy("item").agg(F.first("w").alias("w"))
    every = F.when(F.size("w") >= WIDTH, shingles(F.col("w"), WIDTH))
    for width in range(1, WIDTH):
        every = every.when(F.size("w") == width, shingles(F.col("w"), width))
    return own.select("item", F.least(F.size("w"), F.lit(WIDTH)).alias("width"), every.alias("h"))


def rarest(own: DataFrame) -> DataFrame:
    """(width, item, x): of each item's m shingles the m - ceil(SIMILARITY * m) + 1 that the fewest items have."""
    each = own.select("width", F.size("h").alias("m"), "item", F.explode("h").alias("x"))
    spread = each.groupBy("width", "x").agg(F.count_distinct("item").alias("n"))
    least = each.join(spread, ["width", "x"]).groupBy("width", "m", "item").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("of"))
    most = F.col("m") - F.ceil(F.col("m") * SIMILARITY - 1e-9).cast("int") + 1
    return least.select("width", "item", F.explode(F.array_distinct(F.slice(F.col("of.x"), F.lit(1), most))).alias("x"))


def item_of(text: Column) -> Column:
    return F.md5(F.array_join(words(F.coalesce(text.cast("string"), F.lit(""))), " "))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def candidates(docs: DataFrame, own: DataFrame, widths: list[int], text_col: str) -> DataFrame:
    """(k, width, items): texts (by md5) that hold a rare shingle of an item, with those items."""
    rare = materialise(rarest(own), "rare-shingles")
    n = rare.count()
    text = F.col(text_col).cast("string")
    cut = docs.filter(text.isNotNull()).select(text_key(text).alias("k"), words(text).alias("w"))
    found = None
    for width in widths:
        each = cut.filter(F.size("w") >= width).select("k", F.explode(shingles(F.col("w"), width)).alias("x"))
        hits = each.join(small(rare.filter(F.col("width") == width).drop("width"), n), "x").select("k", F.lit(width).alias("width"), "item")
        found = hits if found is None else found.unionByName(hits)
    return materialise(found.groupBy("k", "width").agg(F.collect_set("item").alias("items")), "candidates")


def best_windows(hits: DataFrame) -> DataFrame:
    """(k, item, similarity, start, m) of each pair's best window. ``hits``: k, width, item, m, n (shingles of the text), x, c (x's count in the item), p."""
    pair = ["k", "width", "item", "m", "n"]
    at = hits.repartition("k", "width", "item").groupBy(*pair, "x", "c").agg(F.sort_array(F.collect_list("p")).alias("p"))
    last = F.greatest(F.lit(0), F.col("n") - F.col("m"))

    def ends(p: Column, i: Column) -> Column:
        over = F.when(i >= F.col("c"), F.element_at("p", (i - F.col("c") + 1).cast("int")) + 1).otherwise(0)
        low, high = F.greatest(F.lit(0), p - F.col("m") + 1, over), F.least(p, last)
        return F.when(
            low <= high, F.array(F.struct(low.alias("s"), F.lit(1).alias("d")), F.struct((high + 1).alias("s"), F.lit(-1).alias("d")))
        ).otherwise(F.array().cast("array<struct<s:int,d:int>>"))

    changes = at.select(*pair, F.explode(F.flatten(F.transform("p", ends))).alias("e")).select(*pair, "e.s", "e.d")
    running = Window.partitionBy("k", "width", "item").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = changes.groupBy(*pair, "s").agg(F.sum("d").alias("d")).withColumn("common", F.sum("d").over(running))
    told = common.withColumn("similarity", F.col("common") / (F.col("m") + F.least("m", "n") - F.col("common")))
    return (
        told.filter(F.col("similarity") >= SIMILARITY)
        .groupBy("k", "width", "item")
        .agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"), "m")).alias("best"))
        .select("k", "item", "best.similarity", (-F.col("best.s")).alias("start"), F.col("best.m").alias("n_shingles"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """(k, item, similarity, start, n_shingles): pairs of a text (by its md5) and an item (by its words' md5)."""
    own = materialise(items(benchmark, item_text_col), "items")
    widths = sorted(r[0] for r in own.select("width").distinct().collect())  # at most five
    if not widths:
        return own.select(
            F.lit("").alias("k"), "item", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_shingles")
        )
    of = candidates(docs, own, widths, text_col)
    keys = of.select("k").distinct()
    text = F.col(text_col).cast("string")
    touched = materialise(
        docs.select(text.alias("t"), text_key(text).alias("k"))
        .join(small(keys, keys.count()), "k", "left_semi")
        .groupBy("k")
        .agg(F.first("t").alias("t")),
        "touched-texts",
    )
    counted = own.select("width", "item", F.size("h").alias("m"), F.explode("h").alias("x")).groupBy("width", "item", "m", "x")
    counted = materialise(counted.agg(F.count(F.lit(1)).cast("int").alias("c")), "item-shingles")
    n, hits = counted.count(), None
    for width in widths:
        cut = touched.join(of.filter(F.col("width") == width).drop("width"), "k").select("k", "items", words(F.col("t")).alias("w"))
        n_of = (F.size("w") - width + 1).alias("n")
        each = cut.select("k", "items", n_of, F.posexplode(shingles(F.col("w"), width)).alias("p", "x"))
        met = each.join(small(counted.filter(F.col("width") == width), n), "x").filter(F.array_contains("items", F.col("item"))).drop("items")
        hits = met if hits is None else hits.unionByName(met)
    return best_windows(hits)


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start (in words), n_shingles: every document row with every item row it holds."""
    found = materialise(contaminated(docs, benchmark), "contaminated")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("k")).join(small(found, found.count()), "k")
    named = benchmark.select("item_id", item_of(F.col("text")).alias("item"))
    return rows.join(named, "item").select("doc_id", "item_id", "similarity", "start", "n_shingles")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; columns as given."""
    held = materialise(contaminated(docs, benchmark).select(F.col("k").alias("__k")).distinct(), "contaminated")
    marked = docs.withColumn("__k", text_key(F.col("text")))
    return marked.join(small(held, held.count()), "__k", "left_anti").select(*docs.columns)
