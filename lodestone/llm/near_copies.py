"""Near-duplicate stage: SimHash classes, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The stage begins with the classes of ``simhash_dedup`` as they are: fingerprints of three-word shingles, repeats included, at most two
bits apart, directly or through others. They enter the components as links that hold already (``known``), so a copy may be
linked by fingerprint at one end and by shingle sets at the other. Fingerprints weigh shingles by their repeats: texts that are mostly the
same repeated line are copies by them, whatever else they hold.

Fingerprints alone would leave most near copies: at similarity 0.8 two 64-bit fingerprints differ by about 10 bits, and
blocks that a pair at 15 bits must share are 4 bits wide, so nearly all pairs would be candidates (README, "Near
duplicates"). So a second step finds those: its blocks are cut from min-wise samples of the shingles, ``BANDS`` blocks of
``ROWS`` minima each, of which a pair at 0.8 shares at least one with a probability of 0.9997. The rest is as in
``simhash_dedup``: equal texts fall together first, the texts of a block are verified, and components are formed.

Blocks of equal members are worked on once. Only links leave a block, not its pairs. Verification: 256 one-byte minima estimate the similarity (standard deviation 0.025 at 0.8); pairs estimated within
``UNSURE`` of the threshold are compared exactly by their shingle sets, the others are decided by the estimate. Sets are gathered by
block as well, so that a block of many such pairs makes no more rows than it has texts.

A block shared by more than ``bucket`` texts is cut by a hash of text and block into parts of half that size on average, other parts in each
of the bands, and its smallest text joins each part. That joins most of its near copies; the rest is compared in a second pass: the block's texts are cut anew, by numbers of shingles (``size_class``) and the groups found so
far, and all parts are compared with each other, except where all texts of two parts are in one group or too unlike in size. So
every two texts of a block are compared or in one group, whatever its size.

Very long texts cost their signature and, where the estimate is open, their shingle set; ties in similarity do not matter to classes.
The estimate decides pairs outside 0.7 to 0.9, wrongly for about 3 in 100,000 of those at a true 0.8.

Texts without words equal only themselves. Null text counts as empty. Of each group the row with the smallest id stays
(null ids last, then the smaller text hash); repeated rows count as copies. Columns are kept as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm import simhash_dedup
from lodestone.llm.common import connected_components, map_arrow, materialise
from lodestone.llm.simhash_dedup import shingle_hashes

WIDTH, SIMILARITY, UNSURE = 5, 0.8, 0.1
HASHES, BANDS, ROWS = 256, 20, 5
BROADCAST_ROWS = 1_000_000
MOST_SHINGLES = 2_000_000
SURE, PAIR, MEMBER = 0, 1, 2
_RNG = np.random.default_rng(7)
FACTORS = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
ADDED = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def minima(hashes: np.ndarray) -> np.ndarray:
    """256 32-bit minima of the shingle set, by multiply-add permutations of its folded hashes."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 512):
        np.minimum(least, (low[a : a + 512, None] * FACTORS + ADDED).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, keys, sig, size): node is XXH64 of the text; block keys, signature and number of distinct shingles stand once for each text of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, keys, sigs, sizes = [], [], [], []
            for value in batch.column(1):
                raw = value.as_buffer().to_pybytes()
                node = xxh64_intdigest(raw, 42)
                key = sig = size = None
                if node not in seen:
                    seen.add(node)
                    hashes = shingle_hashes(raw, WIDTH)
                    if len(hashes):
                        size = len(np.unique(hashes))
                        least = minima(hashes)
                        parts = least[: BANDS * ROWS].reshape(BANDS, ROWS)
                        key = [xxh64_intdigest(p.tobytes(), k) - (1 << 63) for k, p in enumerate(parts)]
                        sig = (least * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8).tobytes()
                nodes.append(node)
                keys.append(key)
                sigs.append(sig)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sigs, pa.binary()),
                    pa.array(sizes, pa.int64()),
                ],
                names=["id", "node", "keys", "sig", "size"],
            )

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    return map_arrow(rows, run, "id long, node long, keys array<long>, sig binary, size long")


def fingerprint_links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(u, v): each text with words that shares its SimHash class with a smaller one, and the smallest of the class."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    worded = docs.select(text.alias("text")).filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    marks = simhash_dedup.fingerprints(worded.select(F.xxhash64("text").alias("node"), "text"), "node")
    found = simhash_dedup.components(materialise(marks.distinct(), "fingerprints"))  # equal texts once
    return found.filter("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))


def _blocks(keyed: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: texts to compare with each other, at most about ``bucket``; the rows of keys shared by more texts)."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).filter("n > 1")
    shared = materialise(keyed.join(sizes, "key"), "shared-blocks")
    few = shared.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_set("node").alias("nodes"))
    many = shared.filter(F.col("n") > bucket)
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / (bucket / 2)))
    parts = many.groupBy("key", "low", part.alias("part")).agg(F.collect_set("node").alias("nodes"))
    starred = parts.select(F.array_union("nodes", F.array("low")).alias("nodes"))
    return few.select("nodes").unionByName(starred).select(F.sort_array("nodes").alias("nodes")), many


def candidates(texts: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: the distinct blocks of texts to compare with each other; the rows of keys shared by more than ``bucket`` texts)."""
    keyed = texts.select("node", F.posexplode("keys").alias("band", "key"))
    near, many = _blocks(keyed, bucket)
    return near.distinct(), many


def size_class(size: Column) -> Column:
    """Texts that reach the similarity differ in it by one at most: the larger set has at most 1 / SIMILARITY times the shingles."""
    return F.floor(F.log(size) / -np.log(SIMILARITY)).cast("int")


def remaining(many: DataFrame, roots: DataFrame, texts: DataFrame, bucket: int) -> DataFrame | None:
    """(block, node, root): part pairs of the large blocks that hold texts of several groups; None if there are none.

    A group with more than half of ``bucket`` texts of one size class in a block has parts of its own, which are not compared with
    each other; the texts of smaller groups share parts.
    """
    rows = many.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mark = [F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")]
    several = rows.groupBy("key").agg(*mark, F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    keys = materialise(several.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "open-blocks")  # equal blocks once
    if keys.isEmpty():
        return None
    sized = texts.select("node", size_class(F.col("size")).alias("class"))
    rows = materialise(rows.join(keys, "key").join(sized, "node"), "open-members")
    groups = rows.groupBy("key", "class", "root").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("own", F.when(F.col("n") > bucket / 2, F.col("root")))
    cells = groups.groupBy("key", "class", "own").agg(F.sum("n").alias("n")).withColumn("cuts", F.ceil(F.col("n") / (bucket / 2)))
    cells = materialise(cells, "open-cells")
    part = F.col("key"), F.col("class"), F.coalesce(F.col("own"), F.lit(0)), F.col("own").isNull(), F.col("cut")
    each = cells.withColumn("cut", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cuts"))))
    each = each.select("key", "class", "own", F.xxhash64(*part).alias("part"))
    other = each.select("key", F.col("class").alias("class2"), F.col("own").alias("own2"), F.col("part").alias("part2"))
    near = (F.col("part") <= F.col("part2")) & (F.abs(F.col("class") - F.col("class2")) <= 1) & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False))
    pairs = each.join(other, "key").filter(near).select("part", "part2", F.xxhash64("key", "part", "part2").alias("block"))
    sides = pairs.select("block", F.explode(F.array_distinct(F.array("part", "part2"))).alias("part"))
    large = groups.filter("own is not null").select("key", "class", "root", "own")
    cut = rows.join(large, ["key", "class", "root"], "left").join(
        cells.select("key", F.col("class").alias("c"), F.col("own").alias("o"), "cuts").withColumnRenamed("key", "k"),
        (F.col("key") == F.col("k")) & (F.col("class") == F.col("c")) & F.col("own").eqNullSafe(F.col("o")),
    )
    cut = cut.withColumn("cut", F.pmod(F.xxhash64("node", F.lit(2)), F.col("cuts")) + 1)
    return cut.select("node", "root", F.xxhash64(*part).alias("part")).join(sides, "part").select("block", "node", "root")


def block_links(nodes: np.ndarray, sigs: np.ndarray, label: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """(links, unsure, parts): pairs estimated surely similar that join two parts, positions of pairs to compare exactly, parts by position.

    ``label`` has the position of a text of the same part, if parts are known before.
    """
    label, found, unsure = np.arange(len(nodes)) if label is None else label.copy(), [], []
    for i in range(len(nodes) - 1):
        at = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(at):
            continue
        j = ((sigs[at] == sigs[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        for k in at[j >= SIMILARITY + UNSURE]:
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                found.append((int(nodes[i]), int(nodes[k])))
        unsure += [(i, int(k)) for k in at[(j >= SIMILARITY - UNSURE) & (j < SIMILARITY + UNSURE)]]
    return found, [(i, k) for i, k in unsure if label[i] != label[k]], label


def set_links(nodes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of different parts whose shingle sets reach the similarity, as many as join the parts."""
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    label, found = parts.copy(), []
    held = np.zeros(len(values), np.int64)
    for i in range(len(nodes) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = at[starts[i] : starts[i] + size[i]]
        held[own] = 1
        common = np.add.reduceat(held[at], starts)
        held[own] = 0
        for k in np.flatnonzero(common[i + 1 :] >= SIMILARITY * (size[i] + size[i + 1 :] - common[i + 1 :])) + i + 1:
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                found.append((int(nodes[i]), int(nodes[k])))
    return found


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def verified(members: DataFrame, texts: DataFrame, docs: DataFrame, text_col: str, most: int = MOST_SHINGLES) -> DataFrame:
    """(u, v): pairs that reach the similarity and connect all that do so within a block; ``members`` has (block, node, root), and texts of one root are connected already.

    What the estimate leaves open is compared by shingle sets, block by block; pairs of a block whose open texts hold more than
    ``most`` shingles are compared pair by pair instead, so that no task holds more.
    """

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for block, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes = members.values.field("node").to_numpy()
                sizes = members.values.field("size").to_numpy()
                sigs = np.frombuffer(b"".join(members.values.field("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
                order = np.argsort(nodes)
                nodes, sizes = nodes[order], sizes[order]
                _, first, group = np.unique(members.values.field("root").to_numpy()[order], return_index=True, return_inverse=True)
                links, unsure, label = block_links(nodes, sigs[order], first[group])
                out += [(SURE, 0, u, v) for u, v in links]
                unsure = [(i, k) for i, k in unsure if min(sizes[i], sizes[k]) >= SIMILARITY * max(sizes[i], sizes[k])]
                open_ = sorted({i for pair in unsure for i in pair})
                if sizes[open_].sum() > most:
                    out += [(PAIR, 0, int(nodes[i]), int(nodes[k])) for i, k in unsure]
                else:
                    out += [(MEMBER, block, int(nodes[i]), int(nodes[label[i]])) for i in open_]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kind", "block", "u", "v"])

    filled = members.join(texts.select("node", "sig", "size"), "node")
    filled = filled.groupBy("block").agg(F.collect_list(F.struct("node", "root", "sig", "size")).alias("members"))
    told = materialise(map_arrow(filled, estimate, "kind long, block long, u long, v long").distinct(), "estimates")
    sure = told.filter(F.col("kind") == SURE).select("u", "v")
    pairs = told.filter(F.col("kind") == PAIR).select("u", "v").distinct()
    inside = told.filter(F.col("kind") == MEMBER).select("block", F.col("u").alias("node"), F.col("v").alias("part"))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(inside.select("node"))
    nodes = materialise(ends.distinct(), "unsure")
    n = nodes.count()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, found = [], []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    found.append(np.unique(shingle_hashes(raw.as_buffer().to_pybytes(), WIDTH)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "s"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wanted = docs.select(F.xxhash64(text).alias("node"), text.cast("binary").alias("t")).join(
        F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes, "node", "left_semi"
    )
    held = map_arrow(wanted, sets, "node long, s binary").groupBy("node").agg(F.first("s").alias("s"))
    held = materialise(held, "shingle-sets")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column(0):
                rows = members.values
                have = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.field("s")]
                found += set_links(rows.field("node").to_numpy(), rows.field("part").to_numpy(), have)
            yield _pairs(found)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= SIMILARITY * (len(a) + len(b) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    gathered = inside.join(held, "node").groupBy("block").agg(F.collect_list(F.struct("node", "part", "s")).alias("members"))
    linked = map_arrow(gathered.select("members"), within, "u long, v long")
    exact = pairs.join(held.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(
        held.select(F.col("node").alias("v"), F.col("s").alias("b")), "v"
    )
    return sure.unionByName(linked).unionByName(map_arrow(exact.select("u", "v", "a", "b"), compare, "u long, v long"))


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket: int = 512,
    most: int = MOST_SHINGLES,
    known: DataFrame | None = None,
) -> DataFrame:
    """(id, node, root): rows with the same root are exact or near copies, directly or through others; ``known`` has (u, v), nodes that are linked beforehand."""
    rows = materialise(signatures(docs, id_col, text_col), "signatures")
    texts = materialise(
        rows.filter(F.col("sig").isNotNull()).groupBy("node").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("size").alias("size")), "texts"
    )
    blocks, many = candidates(texts, bucket)
    members = blocks.select(F.xxhash64("nodes").alias("block"), F.explode("nodes").alias("node")).withColumn("root", F.col("node"))
    links = verified(members, texts, docs, text_col, most)
    if known is not None:
        links = known.unionByName(links)
    roots = materialise(connected_components(links), "first-roots")
    rest = remaining(many, roots, texts, bucket)
    if rest is not None:
        links = verified(rest, texts, docs, text_col, most)
        named = roots.withColumnRenamed("root", "r")
        for end in ("u", "v"):
            links = links.join(named.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
        joined = materialise(connected_components(links).select(F.col("node").alias("r"), F.col("root").alias("last")), "joined-roots")
        roots = roots.join(joined.withColumnRenamed("r", "root"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        # Texts without a link before are their own root there.
        fresh = joined.join(named.select(F.col("node").alias("r")), "r", "left_anti")
        roots = roots.unionByName(fresh.select(F.col("r").alias("node"), F.col("last").alias("root")))
    return rows.select("id", "node").join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))


def stage(docs: DataFrame) -> DataFrame:
    """One row of each group; columns as given."""
    known = materialise(fingerprint_links(docs), "fingerprint-links")
    found = materialise(classes(docs, known=known), "near-copies")
    single = materialise(found.groupBy("root", "node", "id").agg(F.count(F.lit(1)).alias("n")), "counted-rows")
    order = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("node").alias("node"))
    best = materialise(single.groupBy("root").agg(F.min(order).alias("best")).select("best.id", "best.node"), "kept-texts")
    # Both sides have few rows of one (id, node), however large a group is.
    is_best = F.col("s.node").eqNullSafe(F.col("b.node")) & F.col("s.id").eqNullSafe(F.col("b.id"))
    drop = materialise(
        single.alias("s").join(best.alias("b"), is_best, "left_anti").select(F.col("id").alias("__id"), F.col("node").alias("__node")), "dropped"
    )
    n = drop.count()
    node = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.withColumn("__key", node).join(
        F.broadcast(drop) if n <= BROADCAST_ROWS else drop,
        (F.col("__key") == F.col("__node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")),
        "left_anti",
    )
    repeated = single.filter("n > 1").alias("s").join(best.alias("b"), is_best, "left_semi")
    if not repeated.isEmpty():  # whole rows that repeat
        twice = repeated.select(F.col("id").alias("__id"), F.col("node").alias("__node"))
        same = (F.col("__key") == F.col("__node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
        once = kept.join(twice, same, "left_semi").dropDuplicates(["__key", "doc_id"])
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)
