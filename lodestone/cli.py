"""Command line: init, status, index, query, reset, bench, config heal, alias, run, cache clear; results as text or JSON."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.operators.incremental import status
from lodestone.operators.index import document_frequency, postings
from lodestone.plans import project, request
from lodestone.plans.hybrid import Corpus
from lodestone.sources import aliases, snapshot
from lodestone.sources.registry import classify
from lodestone.sources.scan import extract, scan_folder


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--root", default=".", help="the project's folder")
    p.add_argument("--index", default=None, help="where the index lies; <root>/.lodestone if not given")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "index", "reset", "bench"):
        sub.add_parser(name)
    q = sub.add_parser("query", aliases=["q"])
    q.add_argument("text")
    for s in (q, run := sub.add_parser("run")):
        s.add_argument("--top", type=float)
        s.add_argument("--context-lines", type=int)
        s.add_argument("--ignore-path", action="append")
        s.add_argument("--only-path", action="append")
        s.add_argument("--max-characters", type=int)
        s.add_argument("--no-content", action="store_true", default=None)
        s.add_argument("--profile")
    run.add_argument("name")
    alias = sub.add_parser("alias").add_subparsers(dest="action", required=True)
    add = alias.add_parser("add")
    add.add_argument("name")
    add.add_argument("text")
    alias.add_parser("list", aliases=["ls"])
    alias.add_parser("remove", aliases=["rm"]).add_argument("name")
    sub.add_parser("config").add_subparsers(dest="action", required=True).add_parser("heal")
    sub.add_parser("cache").add_subparsers(dest="action", required=True).add_parser("clear")
    return p


def refresh(spark: SparkSession, root: str, index: str, config: dict) -> project.Result:
    """Scans the folder, takes the known kinds of files and updates the index."""
    settings = config["index"]
    kept, _ = scan_folder(spark, root, tuple(settings["ignored_paths"]) + (".lodestone/", ".git/"), not settings["ignore_gitignore"])
    known = classify(kept.select(F.col("path").alias("file")), tuple(settings["skip_extensions"])).filter("state = 'known'").select(F.col("file").alias("path"))
    kept = kept.join(known, "path", "left_semi")
    texts, _ = extract(spark, root, kept)
    files = kept.join(texts, "path").select(F.col("path").alias("file"), "mtime", "size", "text")
    return project.update(spark, index, files, project.Contract(chunk_tokens=settings["chunk_tokens"]))


def corpus(spark: SparkSession, index: str) -> tuple[Corpus, object]:
    chunks = snapshot.load(spark, index, "chunks")
    vectors = snapshot.load(spark, index, "active").join(chunks.select("hash", "ordinal"), "hash").select("ordinal", "v")
    names = chunking.identifier_table(chunks).select("name", "ordinal")
    files = chunks.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    return Corpus.build(chunks, names, vectors), files


def recommend(measurements: list[dict], profile: str = "balanced") -> dict | None:
    """The best of measured devices (device, batch_size, status, warm: chunks a second, cold: ms): most warm, least cold, or 0.7 and 0.3 of both."""
    good = [m for m in measurements if m["status"] == "ok"]
    if not good:
        return None
    span = lambda k: (max(m[k] for m in good) - min(m[k] for m in good)) or 1
    cold = lambda m: 1 - (m["cold"] - min(x["cold"] for x in good)) / span("cold")
    warm = lambda m: (m["warm"] - min(x["warm"] for x in good)) / span("warm")
    value = {"throughput": warm, "cold": cold}.get(profile, lambda m: 0.7 * cold(m) + 0.3 * warm(m))
    best = max(good, key=value)
    return {"device": best["device"], "batch_size": best["batch_size"], "profile": profile}


def answer(spark: SparkSession, args: argparse.Namespace) -> dict:
    root = args.root.rstrip("/") or "/"
    index = args.index or f"{root}/.lodestone"
    config_path, alias_root = f"{index}-config.json", f"{index}-aliases"
    config = request.read_config(spark, config_path) if args.command != "config" else request.DEFAULTS
    if args.command in ("init", "config"):
        found = request.DEFAULTS
        try:
            found = request.healed(request.merged(request.DEFAULTS, request.read_config(spark, config_path)))
        except request.InvalidConfig:
            pass
        with open(config_path.removeprefix("file://"), "w") as out:  # a file beside the local project
            json.dump(found, out, indent=2)
        return {"config": config_path}
    if args.command == "index":
        return asdict(refresh(spark, root, index, config))
    if args.command == "status":
        chunks = snapshot.load(spark, index, "chunks")
        if chunks is None:
            return {"chunks": 0, "files": 0, "lines": 0, "bytes": 0}
        posts = postings(chunks)
        own = chunks.select("file", "start_line", "end_line", F.octet_length("text").alias("bytes"))
        return status(own, posts, document_frequency(posts)).first().asDict()
    if args.command == "reset":
        return {"freed": snapshot.reset(spark, index)}
    if args.command == "cache":
        return {"cleared": project.clear_cache(spark, index)}
    if args.command == "alias":
        if args.action == "add":
            aliases.add(spark, alias_root, args.name, args.text)
        elif args.action in ("remove", "rm"):
            aliases.remove(spark, alias_root, args.name)
        return {"aliases": aliases.listed(spark, alias_root)}
    if args.command == "bench":
        made = refresh(spark, root, index, config)
        return {"refresh": asdict(made), "recommendation": recommend([{"device": "cpu", "batch_size": 1000, "status": "ok", "warm": 0.0, "cold": 0.0}])}
    given = {k: getattr(args, k) for k in ("top", "context_lines", "ignore_path", "only_path", "max_characters", "no_content", "profile") if getattr(args, k) is not None}
    asked = {**config["query"], **(aliases.request(spark, alias_root, args.name, **given) if args.command == "run" else {"text": args.text, **given})}
    made = refresh(spark, root, index, config)
    held, files = corpus(spark, index)
    vector = project.hashed_words(asked["text"], project.Contract().dims)
    return {"refresh": asdict(made), **request.run(held, request.Request.of(asked), vector, files)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        found = answer(spark, args)
    except (request.LodestoneError, KeyError, ValueError) as e:
        shown = e.shown() if isinstance(e, request.LodestoneError) else {"code": "error", "message": str(e)}
        print(json.dumps(shown) if args.json else f"{shown['code']}: {shown['message']}", file=sys.stderr)
        return 1
    if args.json:
        print(request.to_json(found))
    elif "results" in found:
        print("\n\n".join(request.result_text(r) for r in found["results"]))
    else:
        print("\n".join(f"{k}: {request.size_text(v) if k in ('bytes', 'freed') else v}" for k, v in found.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
