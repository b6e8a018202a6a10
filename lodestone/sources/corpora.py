"""Evaluation corpora: manifests, their file lists, questions in all their forms, sparse term weights, and rankings kept by configuration."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS = ("identifier", "searchPhrase", "naturalQuestion", "agentTask")
MANIFEST = (
    "schemaVersion int, id string, repository string, revision string, language string, size string, includeRoots array<string>, "
    "excludePaths array<string>, extensions array<string>, questions array<struct<id: string, "
    "queries: struct<identifier: string, searchPhrase: string, naturalQuestion: string, agentTask: string>, category: string, "
    "difficulty: string, groundTruth: array<struct<file: string, symbol: string>>>>"
)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON manifest below ``path``, by file name; a file that isn't one, or a question without targets, is an error."""
    found = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
    found = found.withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    bad = found.filter(F.col("id").isNull() | F.exists("questions", lambda q: F.coalesce(F.size(q["groundTruth"]), F.lit(0)) <= 0))
    names = [r["name"] for r in bad.select("name").limit(10).collect()]
    if names:
        raise ValueError(f"invalid corpus manifests: {names}")
    return found.orderBy("name")


def in_corpus(file: Column, roots: list[str], excluded: list[str], extensions: list[str]) -> Column:
    """Whether a file belongs to a corpus: under a root, under no excluded path, with one of the extensions."""

    def any_of(test, values: list[str]) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | test(file, F.lit(v))
        return out

    return any_of(F.startswith, roots) & ~any_of(F.startswith, excluded) & any_of(F.endswith, extensions)


def asked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries: repository, question, form, text, category, difficulty; gold: repository, question, target, file, symbol)."""
    each = found.select(F.col("id").alias("repository"), F.explode("questions").alias("q"))
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"q.queries.{f}").alias("text")) for f in FORMS])
    queries = each.select("repository", F.col("q.id").alias("question"), F.explode(forms).alias("f"), "q.category", "q.difficulty")
    gold = each.select("repository", F.col("q.id").alias("question"), F.posexplode("q.groundTruth").alias("target", "g"))
    return (
        queries.select("repository", "question", "f.form", "f.text", "category", "difficulty"),
        gold.select("repository", "question", "target", "g.file", "g.symbol"),
    )


def unresolved(gold: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Targets that no chunk holds; an evaluation must not run while there are any."""
    return gold.join(found.select(*key).distinct(), key, "left_anti")


def term_weights(spark: SparkSession, path: str, sha256: str, vocabulary: DataFrame, special: list[int]) -> DataFrame:
    """(token_id, weight) of a JSON object of token weights, whose bytes must have the given hash; vocabulary: token, token_id."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    if hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError(f"{path} isn't the file that was pinned")
    weights = spark.createDataFrame([(k, float(v)) for k, v in json.loads(raw).items() if isinstance(v, int | float)], "token string, weight double")
    kept = vocabulary.join(weights, "token").filter((F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")) & ~F.col("token_id").isin(special))
    return kept.select("token_id", "weight").orderBy("token_id")


def cache_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def save_rankings(rankings: DataFrame, root: str, config: dict) -> None:
    """Keeps rankings under their configuration, with their number of rows, which is written last."""
    at = f"{root}/{cache_key(config)}"
    rankings.write.mode("overwrite").parquet(f"{at}/rows")
    kept = rankings.sparkSession.read.parquet(f"{at}/rows")
    kept.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{at}/count")


def load_rankings(spark: SparkSession, root: str, config: dict) -> DataFrame | None:
    """All kept rankings of a configuration, or None if they are not there whole."""
    at = f"{root}/{cache_key(config)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/count/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(f"{at}/rows")
    return rows if rows.count() == spark.read.parquet(f"{at}/count").first()["n"] else None
