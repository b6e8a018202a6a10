"""Scans, the incremental index, requests, the command line, corpora and the router search, end to end on small projects."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import metrics
from lodestone.operators import rankers as rk
from lodestone.operators import router_search as rs
from lodestone.plans import project, request
from lodestone.sources import corpora, snapshot
from lodestone.sources.ignore import Scope, excluded
from lodestone.sources.scan import diagnostics, extract, scan_folder


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan_with_nested_ignore_files(spark, tmp_path):
    tree(tmp_path, {
        "a.py": "x = 1\n", "build/out.py": "no", "logs/one.log": "no", "logs/keep.log": "yes", ".gitignore": "build/\n*.log\n# note\n", "logs/.gitignore": "!keep.log\n",
        "sub/b.txt": "text", "sub/.gitignore": "b.*\n", "sub/c.txt": "text", "sub/__init__.py": "", "bad.txt": b"\xff\xfe\x00x",
    })
    kept, skipped = scan_folder(spark, f"file://{tmp_path}", (".gitignore",))
    assert {r["path"] for r in kept.collect()} == {"a.py", "logs/keep.log", "sub/c.txt", "sub/__init__.py", "bad.txt"}
    assert "build/out.py" in {r["path"] for r in skipped.collect()}
    texts, bad = extract(spark, f"file://{tmp_path}", kept)
    assert {r["path"]: r["text"] for r in texts.collect()} == {"a.py": "x = 1\n", "logs/keep.log": "yes", "sub/c.txt": "text", "sub/__init__.py": ""}
    assert [(r["path"], r["kind"]) for r in bad.collect()] == [("bad.txt", "skipped-file")]
    everything, _ = scan_folder(spark, f"file://{tmp_path}", files=False)
    assert everything.count() == 11


def test_excluded_follows_folders(spark):
    rules = [Scope("", ("tmp/", "*.o", "!tmp/x")), Scope("src", ("!keep.o", "gen"))]
    paths = spark.createDataFrame([(p,) for p in ("tmp/x", "a.o", "src/keep.o", "src/gen/y", "src/a.c", "other/keep.o", "gen/z")], "p string")
    out = {r["p"] for r in paths.filter(excluded(F.col("p"), rules)).collect()}
    assert out == {"tmp/x", "a.o", "src/gen/y", "other/keep.o"}


def test_diagnostics(spark):
    schema = "path string, line int, kind string, message string"
    old = spark.createDataFrame([("a", 3, "k", "m"), ("b", 1, "k", "m"), ("gone", 1, "k", "m"), ("a", None, "k", "Ignored by config pattern: a")], schema)
    fresh = spark.createDataFrame([("b", None, "k", "n"), ("a", 1, "k", "z")], schema)
    known, again = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("b",)], "path string")
    assert [tuple(r) for r in diagnostics(old, fresh, known, again).collect()] == [("a", 1, "k", "z"), ("a", 3, "k", "m"), ("b", None, "k", "n")]


def test_incremental_index(spark, tmp_path):
    root, schema = f"file://{tmp_path}/index", "file string, mtime long, size long, text string"
    one = [("a", 1, 1, "alpha text"), ("b", 1, 1, "beta text"), ("c", 1, 1, "alpha text")]
    r = project.update(spark, root, spark.createDataFrame(one, schema))
    assert (r.refresh, r.processed, r.reused, r.cache_hits, r.cache_misses) == ("full", 3, 0, 1, 2)
    r = project.update(spark, root, spark.createDataFrame(one, schema))
    assert (r.refresh, r.processed, r.reused) == ("none", 0, 3)
    two = [("a", 2, 1, "alpha text"), ("b2", 1, 1, "beta text"), ("c", 1, 1, "alpha text"), ("d", 1, 1, "delta")]  # touched, renamed, same, added
    r = project.update(spark, root, spark.createDataFrame(two, schema))
    assert (r.refresh, r.processed, r.reused, r.cache_hits, r.cache_misses) == ("incremental", 2, 2, 1, 1)
    assert [(x["file"], x["ordinal"]) for x in snapshot.load(spark, root, "chunks").orderBy("ordinal").collect()] == [("a", 0), ("b2", 1), ("c", 2), ("d", 3)]
    r = project.update(spark, root, spark.createDataFrame(two[:1], schema))
    assert (r.files, r.processed, r.chunks) == (1, 0, 1)
    assert project.cache_sizes(spark, root) == {"active": 1, "history": 2}
    r = project.update(spark, root, spark.createDataFrame(two, schema), project.Contract(model="other"))
    assert (r.refresh, r.processed, r.cache_misses) == ("full", 4, 0)
    r = project.update(spark, root, spark.createDataFrame(two, schema), project.Contract(model="other", dims=8))
    assert r.cache_misses == 3  # vectors of another length don't serve
    assert project.clear_cache(spark, root)
    assert not project.clear_cache(spark, root)
    with pytest.raises(Exception, match="limit"):
        project.embedded(spark.createDataFrame([("h", "a b c")], "hash string, text string"), 4, most_tokens=2).collect()


def test_requests(spark):
    assert [request.clamp_top(x) for x in (0, 5.7, 1000, math.nan, math.inf)] == [(1, True), (5, False), (100, True), (1, True), (1, True)]
    assert request.Request.of({"text": "x", "only_path": ["a"], "top": None}).only_path == ("a",)
    for bad in ({"text": "x", "other": 1}, {"text": "x", "profile": "none"}, {"text": "x", "context_lines": -1}):
        with pytest.raises(request.InvalidRequest):
            request.Request.of(bad)
    assert request.merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}, "__x": 1}) == {"a": {"b": 1, "c": [2]}}
    assert request.healed({"query": {"top": "many", "profile": "balanced"}, "more": 1})["query"]["top"] == 5
    assert (request.size_text(10), request.size_text(2048), request.size_text(3 << 20)) == ("10 B", "2.0 KB", "3.0 MB")


def test_context_and_changed_files(spark):
    text = "one\r\ntwo\nthree\nfour\nfive"
    files = spark.createDataFrame([("f", text)], "file string, text string")
    start, end = text.index("three"), text.index("five")
    hashed = spark.range(1).select(F.sha2(F.lit(text[start:end]), 256)).first()[0]
    chunks = spark.createDataFrame([(0, "f", start, end, 3, 4, hashed)], "ordinal long, file string, start int, end int, start_line int, end_line int, hash string")
    found = spark.createDataFrame([(0, 1, 0, "f")], "query_id long, rank int, ordinal long, file string")
    r = request.hydrated(found, chunks, files, 5).first()
    assert (r["text"], r["before"], r["after"], r["ok"]) == ("three\nfour\n", "one\ntwo", "five", True)
    r = request.hydrated(found, chunks, files.withColumn("text", F.upper("text")), 0).first()
    assert (r["before"], r["after"], r["ok"]) == (None, None, False)


def test_command_line(spark, tmp_path, capsys):
    tree(tmp_path / "p", {"a.py": "def find_me(x):\n    return x\n", "b.md": "words about gardens and rivers\n", "c.bin": "skip"})
    root = ["--root", f"file://{tmp_path}/p", "--index", f"file://{tmp_path}/i", "--json"]

    def call(*args):
        assert cli.main([*root, *args]) == 0
        return json.loads(capsys.readouterr().out)

    assert call("index")["files"] == 2
    got = call("query", "find_me", "--top", "900", "--context-lines", "1")
    assert got["results"][0]["file"] == "a.py"
    assert got["warnings"][0]["applied"] == 100
    assert got["refresh"]["refresh"] == "none"
    assert call("status")["files"] == 2
    call("alias", "add", "g", "gardens")
    assert call("run", "g", "--no-content")["results"][0]["file"] == "b.md"
    assert call("cache", "clear") == {"cleared": True}
    call("config", "heal")
    assert os.path.exists(f"{tmp_path}/i-config.json")
    assert call("reset")["freed"] > 0
    assert cli.main([*root, "run", "unknown"]) == 1
    assert cli.recommend([{"device": "a", "batch_size": 1, "status": "ok", "warm": 9.0, "cold": 5.0}, {"device": "b", "batch_size": 1, "status": "ok", "warm": 1.0, "cold": 1.0}])["device"] == "b"
    assert cli.recommend([{"device": "a", "batch_size": 1, "status": "failed", "warm": 0, "cold": 0}]) is None


def test_corpora(spark, tmp_path):
    question = {"id": "q1", "queries": {f: f"text {f}" for f in corpora.FORMS}, "category": "c", "difficulty": "d", "groundTruth": [{"file": "a.py", "symbol": "f"}]}
    manifest = {"schemaVersion": 1, "id": "r", "repository": "r", "revision": "1", "language": "py", "size": "s", "includeRoots": ["src/"], "excludePaths": ["src/x"], "extensions": [".py"], "questions": [question]}
    tree(tmp_path, {"m/b.json": json.dumps(manifest)})
    queries, gold = corpora.asked(corpora.manifests(spark, f"file://{tmp_path}/m"))
    assert queries.count() == 4
    assert corpora.unresolved(gold, gold.limit(0), ["repository", "question", "target"]).count() == 1
    tree(tmp_path, {"bad/b.json": json.dumps({**manifest, "questions": [{**question, "groundTruth": []}]})})
    with pytest.raises(ValueError, match="b.json"):
        corpora.manifests(spark, f"file://{tmp_path}/bad")
    rows = spark.createDataFrame([(1, 2)], "query_id long, ordinal long")
    assert corpora.load_rankings(spark, f"file://{tmp_path}/r", {"m": 1}) is None
    corpora.save_rankings(rows, f"file://{tmp_path}/r", {"m": 1})
    assert corpora.load_rankings(spark, f"file://{tmp_path}/r", {"m": 1}).count() == 1
    tree(tmp_path, {"idf.json": '{"a": 1.5, "b": -1, "s": 2}'})
    import hashlib

    vocabulary = spark.createDataFrame([("a", 4), ("b", 5), ("s", 0)], "token string, token_id int")
    digest = hashlib.sha256(b'{"a": 1.5, "b": -1, "s": 2}').hexdigest()
    assert [tuple(r) for r in corpora.term_weights(spark, f"file://{tmp_path}/idf.json", digest, vocabulary, [0]).collect()] == [(4, 1.5)]
    with pytest.raises(ValueError, match="pinned"):
        corpora.term_weights(spark, f"file://{tmp_path}/idf.json", "0", vocabulary, [])


def test_quantised_dense_recall(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(800, 96))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "ordinal long, v array<double>").repartition(4)
    asked = spark.createDataFrame([(i, data[i].tolist()) for i in range(20)], "query_id long, v array<double>")
    got: dict[int, set[int]] = {}
    for r in rk.rank_dense_by("quantised", asked, vectors, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["ordinal"])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = sum(len(got[i] & set(np.argsort(-(unit @ unit[i]))[:10].tolist())) for i in range(20))
    assert hits >= 0.9 * 200
    assert rk.rank_dense_by("auto", asked, vectors).count() > 200 * 10
    with pytest.raises(ValueError):
        rk.rank_dense_by("other", asked, vectors)


def test_bootstrap_draws_one_sequence():
    values, state, means = np.array([0.5, -1.0, 2.0, 0.25, 3.5]), 1, []
    for _ in range(50):
        total = 0.0
        for _ in range(5):
            state = (state * 1664525 + 1013904223) % (1 << 32)
            total += values[state % 5]
        means.append(total / 5)
    assert metrics.resampled_means(values, 50).tolist() == pytest.approx(means)


def test_search_space():
    points = rs.sobol_points(8, 3, 0)
    assert sorted(points[:, 0].tolist()) == [k / 8 for k in range(8)]
    for d in range(3):
        assert sorted(np.floor(points[:, d] * 8).tolist()) == list(range(8))  # one point in each eighth
    assert points[1].tolist() == [0.5, 0.5, 0.5]
    assert len(rs.LEVELS) == 40
    assert len(rs.hypotheses()) == 42
    seeds = rs.global_seeds([rs.promoted()], "sobol", 4)
    assert all((s[:5] == rs.promoted()[:5]).all() for s in seeds)
    cloud = rs.local_cloud([rs.promoted()], 6, 1)
    assert all(np.abs(c - np.clip(rs.promoted(), None, 1)).max() <= 0.2 + 1e-9 for c in cloud)
    assert len(rs.static_grid()) == len({rs.weights_key(w) for w in rs.static_grid()})
    assert rs.router_key(rs.promoted()).startswith("0.6000:0.5000:0.9000:1.0000:0.1000|0.00:0.50")


def quality(**given):
    return {**dict.fromkeys(rs.METRICS, 0.5), **given}


def test_comparators():
    a, b, c = rs.authored((1, 0, 0, 0, 0)), rs.authored((0, 1, 0, 0, 0), bm25=0.5), rs.authored((0, 0, 1, 0, 0))
    entries = rs.unique([a, b, c])
    ka, kb, kc = entries
    told = {ka: quality(recall_20=0.9, recall_5=0.1), kb: quality(recall_20=0.8), kc: quality(recall_20=0.8)}
    assert rs.ordered(entries, told, "reranker-top20") == [ka, kc, kb]  # the simpler one leads among equals
    assert rs.ordered(entries, told, "reranker-top20", quality()) == [kc, kb, ka]  # a falls below the guardrail of recall_5
    assert rs.halving_order(entries, told)[0] == ka
    assert rs.diverse(entries, told, 2, quality()) == [kc, kb]
    assert rs.eligible_or_first([ka, kb], lambda k: k == kb) == (kb, True)
    assert rs.eligible_or_first([ka], lambda k: False) == (ka, False)
    near = {**entries, **rs.unique([rs.authored((0, 0, 0.9, 0, 0))])}
    kd = list(near)[3]
    told[kd] = quality(recall_20=0.8)
    assert rs.steadied(near, told, [kb, kc, kd, ka], "recall_20", 0.005)[:3] in ([kc, kd, kb], [kd, kc, kb])


def test_router_search_finds_the_better_channel(spark):
    """Dense ranks the target first, BM25 last: a search over base weights prefers dense."""
    rows = [(q, c, o, 1.0 - 0.1 * k) for q in range(4) for c, order in (("bm25", (1, 2, 3, 0)), ("dense", (0, 3, 2, 1))) for k, o in enumerate(order)]
    norms = spark.createDataFrame(rows, "query_id long, channel string, ordinal long, norm double")
    signals = "separation double, geometry double, agreement double, coverage double, dense_confidence double, identifier double, length double"
    found = spark.createDataFrame([(q, c, *[0.5] * 7) for q in range(4) for c in ("bm25", "dense")], "query_id long, channel string, " + signals)
    samples = spark.createDataFrame([(q, "agentTask") for q in range(4)], "query_id long, form string")
    gold = spark.createDataFrame([(q, 0, 0) for q in range(4)], "query_id long, target long, ordinal long")
    tokens = spark.createDataFrame([(o, 100) for o in range(4)], "ordinal long, tokens long")
    evaluate = rs.Evaluator(norms, found, samples, gold, tokens, {"agentTask": 2.0})
    lexical, dense = rs.authored((0, 0, 1, 0, 0)), rs.authored((0, 0, 0, 1, 0))
    told = evaluate([lexical, dense])
    assert [told[rs.router_key(c)]["reciprocal_rank"] for c in (lexical, dense)] == [0.25, 1.0]
    assert told[rs.router_key(dense)]["ndcg_5"] == 1.0
    best, q = rs.static_search(evaluate, width=2, passes=1, seeds=[np.array([0, 0, 1.0, 0.1, 0]), np.array([0, 0, 1.0, 1.0, 0])])
    assert q["reciprocal_rank"] == 1.0
    search = rs.Search(evaluate, evaluate)
    search.beam([lexical], [2, 3], width=2, passes=1)
    config, q, met = search.best("direct", evaluate([lexical])[rs.router_key(lexical)])
    assert met
    assert q["reciprocal_rank"] == 1.0
    assert config[3] > config[2] * 0.5
    assert len(search.halving([lexical, dense, best_config(best)])) >= 2
    assert search.promotion([lexical, dense], 2)


def best_config(weights):
    return rs.authored(weights)


def test_partitions_splits_and_promotion(spark):
    columns = "form string, repository string, " + ", ".join(f"{m} double" for m in rs.METRICS)
    base = spark.createDataFrame([("f", "r", *[0.5] * 10), ("g", "s", *[0.7] * 10)], columns)
    worse = base.withColumn("recall_20", F.when(F.col("repository") == "s", 0.5).otherwise(F.col("recall_20")))
    w = F.lit(1.0)
    assert rs.partitions(base, w).count() == 5
    assert rs.partitions_met(rs.partitions(base, w), rs.partitions(base, w), "direct")
    assert not rs.partitions_met(rs.partitions(worse, w), rs.partitions(base, w), "direct")
    rows = spark.createDataFrame([(q, q % 2, q % 2) for q in range(4)], "query_id long, fold int, repository int")
    found = rs.splits(rows, 2)
    assert found.count() == 16
    todo, final = rs.jobs(["m"], ["dbsf"], found)
    assert (len(todo), final) == (5, {"strategy": "grouped", "fold": "2"})
    schema = "model string, fusion string, objective string, strategy string, fold string, guards_met boolean, blockers int"
    got = rs.promotion(spark.createDataFrame([("m", "f", "o", "grouped", "2", True, 0), ("m", "f", "p", "grouped", "1", True, 1)], schema), ("grouped",), ("grouped", "2"))
    assert {r["objective"]: r["status"] for r in got.collect()} == {"o": "eligible", "p": "no-eligible-candidate"}
    assert rs.report(rs.averages(spark.createDataFrame([("r", "m", "v", "f", 0.5)], "repository string, model string, variant string, form string, x double"), ["x"]), "T").count("|") > 10
