import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunking, fusion, incremental, metrics, selection
from lodestone.operators import evidence as ev
from lodestone.operators import index as ix
from lodestone.operators import rankers as rk
from lodestone.sources import aliases, snapshot
from lodestone.sources.ignore import path_filter
from lodestone.streaming.incremental import index_stream


def chunks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "ordinal long, text string")


@pytest.mark.parametrize(
    ("name", "words"),
    [("JSONStreamReader", ["json", "stream", "reader"]), ("parseCSV", ["parse", "csv"]), ("row7Total", ["row7", "total"]), ("two_words", ["two", "words"]), ("", [])],
)
def test_split_identifier(spark, name, words):
    assert spark.createDataFrame([(name,)], "n string").select(tx.split_identifier(F.col("n"))).first()[0] == words


@pytest.mark.parametrize(("path", "ext"), [("a/b.TS", ".ts"), ("x\\Makefile", "makefile"), ("a.tar.gz", ".gz"), ("d.x/lock", "lock")])
def test_extension(spark, path, ext):
    assert spark.createDataFrame([(path,)], "p string").select(tx.extension(F.col("p"))).first()[0] == ext


def test_lexical_index(spark):
    c = chunks(spark, "function openWindow win", "function closeWindow win2", "const y = 2", "")
    index = ix.LexicalIndex.build(c)
    assert [r["len"] for r in index.lengths.orderBy("ordinal").collect()] == [4, 4, 3, 0]
    assert (index.n, index.mean_length) == (4, 11 / 4)
    assert {r["term"]: r["df"] for r in ix.document_frequency(index.postings).collect()}["function"] == 2
    q = spark.createDataFrame([(1, "function function"), (2, ""), (3, "nothing")], "query_id long, text string")
    got = rk.ranked("bm25", rk.rank_bm25(q, index)).collect()
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert {(r["query_id"], r["ordinal"]) for r in got} == {(1, 0), (1, 1)}
    assert got[0]["score"] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / 2.75)))


def test_incremental_index_equals_full(spark):
    index = ix.LexicalIndex.build(chunks(spark, "a b", "c d", "e f"))
    kept = spark.createDataFrame([(0, 0), (2, 1)], "old long, new long")
    added = spark.createDataFrame([(2, "g a")], "ordinal long, text string")
    full = ix.LexicalIndex.build(chunks(spark, "a b", "e f", "g a"))
    again = index.rebuilt(kept, added)
    assert sorted(map(tuple, again.postings.select("ordinal", "term", "tf").collect())) == sorted(map(tuple, full.postings.collect()))
    assert (again.n, again.mean_length) == (full.n, full.mean_length)


def rankings(spark, **lists):
    rows = [(1, c, o, float(s), r) for c, pairs in lists.items() for r, (o, s) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "query_id long, channel string, ordinal long, score double, rank int")


def test_fusion_facts(spark):
    got = fusion.fuse(rankings(spark, bm25=[(0, 100), (1, 50)], dense=[(1, 10), (0, 5)]), "rrf", {"bm25": 1, "dense": 1}).orderBy("rank").collect()
    assert [r["ordinal"] for r in got] == [0, 1]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)
    got = fusion.fuse(rankings(spark, bm25=[(0, 10), (1, 0)], dense=[(1, 10), (2, 0)]), "relative", {"bm25": 1, "dense": 1})
    assert {r["ordinal"]: r["score"] for r in got.collect()} == {0: 1.0, 1: 1.0, 2: 0.0}
    got = fusion.normalized(rankings(spark, sparse=[(3, 7), (4, 7)]), "dbsf").collect()
    assert [r["norm"] for r in got] == [0.5, 0.5]
    assert fusion.normalized(rankings(spark, bm25=[(2, 1), (0, 1), (1, 0)]), "rrf", 2).count() == 2
    with pytest.raises(ValueError):
        fusion.normalized(rankings(spark, bm25=[(2, 1)]), "other")


def test_dense_ignores_zero_and_opposite_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "ordinal long, v array<double>")
    q = spark.createDataFrame([(5, [2.0, 0.0])], "query_id long, v array<double>")
    got = rk.ranked("dense", rk.rank_dense(q, vectors)).orderBy("rank").collect()
    assert [(r["ordinal"], r["score"]) for r in got] == [(0, 1.0), (1, 1.0)]


def test_single_entry_evidence(spark):
    r = rankings(spark, bm25=[(0, 3)])
    assert ev.separation(r).first()["separation"] == 1.0
    g = ev.geometry(r).first()
    assert (g["geometry"], g["auc"], g["entropy"]) == (1.0, 1.0, 0.0)


def test_path_filter(spark):
    paths = spark.createDataFrame([("src/a.ts",), ("src/deep/ignored.ts",), ("docs/a.md",), ("src/ignored.d/x",)], "p string")
    keep = paths.filter(path_filter(F.col("p"), ignore=["**/ignore*", "!src/ignored.d/x"], only=["src/**"])).collect()
    assert {r[0] for r in keep} == {"src/a.ts"}  # nothing below an ignored folder is taken back
    keep = paths.filter(path_filter(F.col("p"), ignore=["**/ignore*", "!src/ignored.d"])).collect()
    assert {r[0] for r in keep} == {"src/a.ts", "docs/a.md", "src/ignored.d/x"}


def test_manifest_and_ordinals(spark):
    now = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "y"), ("c", 2, 1, "z"), ("d", 1, 1, "w")], "file string, mtime long, size long, hash string")
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "q"), ("e", 1, 1, "v")], "file string, mtime long, size long, hash string")
    got = {r["file"]: r["state"] for r in incremental.manifest_diff(now, old).collect()}
    assert got == {"a": "fresh", "b": "touched", "c": "changed", "d": "added", "e": "deleted"}
    rows = spark.createDataFrame([("b", 0), ("a", 1), ("a", 0), ("c", 0)], "file string, idx int")
    assert {(r[0], r[1]): r[2] for r in incremental.assign_ordinals(rows).collect()} == {("a", 0): 0, ("a", 1): 1, ("b", 0): 2, ("c", 0): 3}


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    ranking = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, ordinal long, rank int")
    gold = spark.createDataFrame([(1, 0, 8), (1, 1, 9)], "query_id long, target long, ordinal long")
    got = {r["query_id"]: r for r in metrics.recall(q, metrics.target_ranks(ranking, gold), (5,)).collect()}
    assert (got[1]["recall_5"], got[1]["reciprocal_rank"], got[2]["recall_5"], got[2]["reciprocal_rank"]) == (0.5, 0.5, 1.0, 0.0)
    n = {r["query_id"]: r["ndcg_5"] for r in metrics.ndcg(q, ranking, gold, 5).collect()}
    assert n[1] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert n[2] == 0.0
    assert metrics.fnv1a("a") == 0xE40C292C


@pytest.mark.parametrize("text", ["", "one line", "a\nb\nc\n" * 50, "x y " * 500 + "\n" + "word " * 400 + "\nend\n", "x\u2028y z\x0cw\n" * 9])
def test_line_chunks_cover_all(text):
    got, lost = chunking.chunks(text, "", 16, 0)
    assert "".join(text[a:b] for a, b, _, _ in got) == text
    assert lost == []
    assert all(chunking.byte_tokens(text[a:b]) <= 16 for a, b, _, _ in got)
    for a, b, first, last in got:
        assert first == text.count("\n", 0, a) + 1
        assert last == text.count("\n", 0, max(a, b - text[a:b].endswith("\n"))) + 1


def test_long_lines_share_no_chunk_and_lose_what_cannot_be_cut():
    text = "short\n" + "word " * 30 + "\nend\n" + "x" * 200 + "\nlast\n"
    got, lost = chunking.chunks(text, "", 16, 0)
    parts = [text[a:b] for a, b, _, _ in got]
    assert parts[0] == "short\n"
    assert parts[-1] == "last\n"
    assert "end\n" in parts
    assert lost == [(4, 4, 51)]
    again, _ = chunking.chunks("a\n" * 20, "", 8, 2)
    assert [(a, b) for a, b, _, _ in again] == [(0, 32), (28, 40)]  # 32 bytes fill a chunk; the last has room for two lines more


PROGRAM = """# lead
# two
import os

# lone


@wrap
def f(a):
    # inner
    x, (y, *z) = 1, (2, 3)
    return x

class K:
    v: int = 3
    def m(self):
        return self.v
    def n(self):
        self.q = 1
        return 2
"""


def test_program_chunks_and_names():
    whole = [PROGRAM[a:b] for a, b, _, _ in chunking.chunks(PROGRAM, ".py")[0]]
    assert [w.split("\n")[0] for w in whole] == ["# lead", "# lone", "@wrap", "class K:"]
    parts = [PROGRAM[a:b] for a, b, _, _ in chunking.chunks(PROGRAM, ".py", 14)[0]]
    assert all(chunking.byte_tokens(p) <= 14 for p in parts)
    assert any(p.strip().startswith("def m") and "return self.v" in p for p in parts)
    assert chunking.identifiers(PROGRAM, ".py") == [("K", "type"), ("f", "function"), ("m", "function"), ("n", "function"), ("v", "value"), ("x", "value"), ("y", "value"), ("z", "value")]
    assert chunking.chunks("def broken(:\n  x", ".py")[0] == [(0, 16, 1, 2)]
    rust = "pub struct Point { x: i32 }\n\nimpl Point {\n    fn new() -> Point {\n        todo!()\n    }\n}\nconst LIMIT: u8 = 3;\n"
    assert len(chunking.chunks(rust, ".rs")[0]) == 3
    assert chunking.identifiers(rust, ".rs") == [("LIMIT", "value"), ("Point", "type"), ("new", "function")]
    assert ("sum", "function") in chunking.identifiers("fun sum(a: Int) = a\nval z = 1", ".kt")
    assert ("run", "function") in chunking.identifiers("class A {\n  public void run() {\n  }\n}", ".java")
    assert chunking.token_cap(None, 512, 256) == 256
    assert chunking.combined(len, lambda t: 3)("ab") == 3


def test_snapshot_swap(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert snapshot.load(spark, root, "chunks") is None
    snapshot.commit(spark, root, {"chunks": spark.range(3)})
    snapshot.commit(spark, root, {"chunks": spark.range(5)})
    assert snapshot.load(spark, root, "chunks", ["id"]).count() == 5
    assert len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 2
    assert snapshot.vacuum(spark, root) > 0
    assert snapshot.load(spark, root, "chunks").count() == 5
    assert snapshot.reset(spark, root) > 0
    assert snapshot.load(spark, root, "chunks") is None


def test_stream(spark, tmp_path):
    chunks(spark, "a b a", "c").write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema("ordinal long, text string").parquet(f"{tmp_path}/in")
    index_stream(docs, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/postings").count() == 3


def test_sparse_encoding(spark):
    values = [0.0, 1.0, -1.0, 2.0, 0.0, 3.0, 4.0, 1.0]
    logits = spark.createDataFrame([(0, i // 4, i % 4, v) for i, v in enumerate(values)], "doc long, position int, token_id int, logit double")
    got = {r["token_id"]: r["weight"] for r in selection.sparse_documents(logits, [3]).collect()}
    assert got == pytest.approx({1: math.log1p(math.log1p(3)), 2: math.log1p(math.log1p(4))})
    ids = spark.createDataFrame([([5, 2, 5, 3],), ([],)], "ids array<int>").select(selection.sparse_query_ids(F.col("ids"), [3])).collect()
    assert [r[0] for r in ids] == [[2, 5], []]


def test_proxy_samples(spark):
    few = spark.range(10).selectExpr("id", "id % 2 AS g")
    assert selection.proxy_samples(few, ["g"], "id").count() == 10
    # Group 0 has 190 samples, group 1 has 10: they take turns until the smaller is used up.
    many = spark.range(200).selectExpr("id", "if(id < 190, 0, 1) AS g")
    got = selection.proxy_samples(many, ["g"], "id").collect()
    assert len(got) == 50
    assert sorted(r["id"] for r in got) == [*range(40), *range(190, 200)]


def test_guardrails_and_stability(spark):
    a = spark.createDataFrame([("x", 0.5, 0.80)], "name string, r double, n double")
    b = spark.createDataFrame([("x", 0.6, 0.81)], "name string, r double, n double")
    got = selection.guardrail_blockers(a, b, ["name"], ["r", "n"]).collect()
    assert [(r["metric"], r["delta"]) for r in got] == [("r", -0.1)]
    rows = spark.createDataFrame([("o", "a", -0.1), ("o", "a", 0.2), ("o", "b", 0.1)], "objective string, config string, drop double")
    r = selection.stability(rows, ["objective"]).first()
    assert (r["folds"], r["distinct_selections"], r["median_drop"], r["worst_drop"]) == (3, 2, 0.1, 0.2)
    assert r["selection_frequency"] == pytest.approx(2 / 3)


def test_candidates(spark):
    norms = spark.createDataFrame([(1, "bm25", 0, 1.0), (1, "dense", 1, 1.0), (1, "bm25", 1, 0.1)], "query_id long, channel string, ordinal long, norm double")
    rows = [(0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0, 0.5, 0.0), (3, 1.0, 0.0, 0.0, 0.0, 0.0)]
    candidates = spark.createDataFrame(rows, "candidate int, identity double, camelcase double, bm25 double, dense double, sparse double")
    gold = spark.createDataFrame([(1, 0, 1)], "query_id long, target long, ordinal long")
    found = selection.candidate_quality(selection.candidate_ranks(norms, candidates), candidates, gold, (1, 2))
    assert {r["candidate"]: (r["recall_1"], r["recall_2"]) for r in found.collect()} == {0: (0.0, 1.0), 1: (1.0, 1.0), 2: (1.0, 1.0), 3: (0.0, 0.0)}
    best = selection.best_of_subsets(candidates, found, ("recall_1",)).collect()
    assert {r["active"]: r["candidate"] for r in best} == {"bm25": 0, "dense": 1, "identity": 3}


def test_scouts():
    assert selection.halton_points(3, 2).ravel().tolist() == pytest.approx([1 / 2, 1 / 3, 1 / 4, 2 / 3, 3 / 4, 1 / 9])
    assert selection.random_points(1, 1)[0, 0] == 270369 / 2**32
    assert selection.levels(selection.halton_points(3, 1), 4).ravel().tolist() == [2, 1, 3]


def test_aliases(spark, tmp_path):
    root = f"file://{tmp_path}/aliases"
    assert aliases.listed(spark, root) == []
    aliases.add(spark, root, "b", "find b", top=5, ignore_path=[])
    aliases.add(spark, root, "a", "find a")
    aliases.add(spark, root, "b", "find b again", top=7)
    assert [(x["name"], x["text"]) for x in aliases.listed(spark, root)] == [("a", "find a"), ("b", "find b again")]
    assert aliases.request(spark, root, "b", top=1, no_content=True) == {"text": "find b again", "top": 1, "no_content": True}
    aliases.remove(spark, root, "b")
    aliases.remove(spark, root, "a")
    assert aliases.listed(spark, root) == []
    with pytest.raises(KeyError):
        aliases.request(spark, root, "b")
    with pytest.raises(ValueError):
        aliases.add(spark, root, "c", "x", other=1)
    with pytest.raises(ValueError):
        aliases.add(spark, root, "-c", "x")
