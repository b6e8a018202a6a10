"""Extension registry (fixed values) and classification of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import extension

PARSED = (".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".java", ".kt", ".kts")
TEXT = (
    ".go", ".c", ".cpp", ".h", ".hpp", ".json", ".yaml", ".yml", ".toml", ".xml", ".csv", ".md", ".mdx", ".txt", ".rst", ".html", ".css",
    ".scss", ".less", ".sql", ".graphql", ".sh", ".bash", ".ps1", ".bat", ".cmake", ".dockerfile", "dockerfile", "makefile", "gemfile",
    ".lock", "lock",
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, True) for x in PARSED] + [(x, False) for x in TEXT], "ext string, has_parser boolean")


def classify(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(file, ext, state, has_parser): skipped by the user, known or unknown."""
    known = F.broadcast(registry(files.sparkSession))  # 41 rows
    got = files.select("file", extension(F.col("file")).alias("ext")).join(known, "ext", "left")
    skipped = F.col("ext").isin(*skip) if skip else F.lit(False)
    state = F.when(skipped, "skipped").when(F.col("has_parser").isNotNull(), "known").otherwise("unknown")
    return got.select("file", "ext", state.alias("state"), F.coalesce("has_parser", F.lit(False)).alias("has_parser"))
