"""Named queries with saved options, kept as a snapshot table; every change swaps the pointer."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from lodestone.sources import snapshot

SCHEMA = "name string, text string, options string"
#: Names (fixed rule): a letter or digit, then letters, digits, underscores, hyphens.
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*\Z")
OPTIONS = ("top", "context_lines", "ignore_path", "only_path", "max_characters", "no_content", "profile")


def _given(options: dict) -> dict:
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}; known are {OPTIONS}")
    return {k: v for k, v in options.items() if v is not None and v != []}


def listed(spark: SparkSession, root: str) -> list[dict]:
    """All aliases by name; users type them, so they are few."""
    found = snapshot.load(spark, root, "aliases")
    rows = [] if found is None else found.collect()
    return sorted(({"name": r["name"], "text": r["text"], "options": json.loads(r["options"])} for r in rows), key=lambda a: a["name"])


def _save(spark: SparkSession, root: str, aliases: list[dict]) -> None:
    rows = [(a["name"], a["text"], json.dumps(a["options"])) for a in aliases]
    snapshot.commit(spark, root, {"aliases": spark.createDataFrame(rows, SCHEMA)})


def add(spark: SparkSession, root: str, name: str, text: str, **options) -> None:
    """Creates or replaces an alias."""
    if not NAME.match(name):
        raise ValueError(f"not a name for an alias: {name!r}")
    others = [a for a in listed(spark, root) if a["name"] != name]
    _save(spark, root, [*others, {"name": name, "text": text, "options": _given(options)}])


def remove(spark: SparkSession, root: str, name: str) -> None:
    every = listed(spark, root)
    if all(a["name"] != name for a in every):
        raise KeyError(name)
    _save(spark, root, [a for a in every if a["name"] != name])


def request(spark: SparkSession, root: str, name: str, **options) -> dict:
    """The alias's query with its options; those given here win."""
    for a in listed(spark, root):
        if a["name"] == name:
            return {"text": a["text"], **a["options"], **_given(options)}
    raise KeyError(name)
