"""A query's request and response: options with defaults, limits with warnings, context lines, budgets, rendering."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.metrics import char_budget
from lodestone.plans.hybrid import Corpus, hybrid
from lodestone.sources.ignore import path_filter

LEAST_TOP, MOST_TOP = 1, 100
#: Profiles of production: all rank by the promoted parameters (fixed values).
PROFILES = ("compatibility", "balanced", "code-navigation", "basic-exploration")


class LodestoneError(Exception):
    """Errors with a code that callers can tell apart."""

    code = "error"

    def shown(self) -> dict[str, str]:
        return {"code": self.code, "message": str(self)}


class InvalidRequest(LodestoneError):
    code = "invalid-request"


class InvalidConfig(LodestoneError):
    code = "invalid-config"


class ContentChanged(LodestoneError):
    code = "content-changed"


@dataclass(frozen=True)
class Request:
    text: str
    top: float = 5
    context_lines: int = 0
    ignore_path: tuple[str, ...] = ()
    only_path: tuple[str, ...] = ()
    max_characters: int | None = None
    no_content: bool = False
    profile: str = "compatibility"

    @classmethod
    def of(cls, given: dict) -> Request:
        """A request of named values; unknown names, wrong profiles and negative context are errors."""
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise InvalidRequest(f"unknown options {sorted(unknown)}")
        request = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if v is not None})
        if request.profile not in PROFILES:
            raise InvalidRequest(f"unknown profile {request.profile!r}; one of {PROFILES}")
        if request.context_lines < 0:
            raise InvalidRequest("context_lines is negative")
        return request


def clamp_top(value: float) -> tuple[int, bool]:
    """The number of results within its limits, and whether it had to be changed."""
    if not math.isfinite(value) or value < LEAST_TOP:
        return LEAST_TOP, True
    return (MOST_TOP, True) if value > MOST_TOP else (int(value), False)


def clamped(value: Column) -> Column:
    """``clamp_top`` as a column: struct<value, clamped>."""
    low = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < LEAST_TOP)
    kept = F.when(low, LEAST_TOP).when(value > MOST_TOP, MOST_TOP).otherwise(F.floor(value)).cast("int")
    return F.struct(kept.alias("value"), (low | (value > MOST_TOP)).alias("clamped"))


def around(text: Column, start_line: Column, end_line: Column, n: int) -> tuple[Column, Column]:
    """Up to ``n`` whole lines of a file before and after a range of lines, carriage returns at their ends removed; null if there are none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    first = F.greatest(F.lit(1), start_line - n)
    before = F.array_join(F.slice(lines, first, start_line - first), "\n")
    after = F.array_join(F.slice(lines, end_line + 1, F.lit(n)), "\n")
    return F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))


def hydrated(results: DataFrame, chunks: DataFrame, files: DataFrame, context_lines: int = 0) -> DataFrame:
    """Results with the chunk's text, its lines, context and ``ok``: whether the file still has what was indexed.

    ``chunks``: ordinal, file, start, end, start_line, end_line, hash; ``files``: file, text.
    """
    held = results.join(chunks.drop("file"), "ordinal").join(files.withColumnRenamed("text", "__whole"), "file")
    cut = F.substring("__whole", F.col("start") + 1, F.col("end") - F.col("start"))
    before, after = around(F.col("__whole"), F.col("start_line"), F.col("end_line"), context_lines)
    got = held.withColumns({"text": cut, "before": before, "after": after}).withColumn("ok", F.sha2("text", 256) == F.col("hash"))
    return got.drop("__whole")


def run(corpus: Corpus, request: Request, vector: list[float] | None = None, files: DataFrame | None = None) -> dict:
    """The response to one request: results (a list of at most 100) and warnings."""
    spark: SparkSession = corpus.chunks.sparkSession
    top, changed = clamp_top(request.top)
    asked = spark.createDataFrame([(0, request.text, vector)], "query_id long, text string, v array<double>")
    keep = path_filter(F.col("file"), list(request.ignore_path), list(request.only_path)) if request.ignore_path or request.only_path else None
    got = hybrid(corpus, asked, top, keep)
    if not request.no_content and files is not None:
        got = hydrated(got, corpus.chunks.drop("text"), files, request.context_lines)
        if not got.filter("not ok").isEmpty():
            raise ContentChanged("a file changed since it was indexed")
        if request.max_characters and request.max_characters > 0:
            got = char_budget(got.withColumn("meta", F.length("file")), request.max_characters).drop("meta")
    rows = [r.asDict() for r in got.orderBy("rank").collect()]
    warnings = [{"code": "top-clamped", "requested": request.top, "applied": top}] if changed else []
    return {"results": rows, "warnings": warnings}


def to_json(response: dict) -> str:
    return json.dumps(response, ensure_ascii=False, sort_keys=True)


def size_text(n: int) -> str:
    """Bytes for readers: B, KB or MB."""
    if n < 1024:
        return f"{n} B"
    return f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB"


def result_text(row: dict) -> str:
    head = f"{row['file']}:{row['start_line']}-{row['end_line']}" if row.get("start_line") is not None else row["file"]
    return f"{head} ({row['rel']:.2f})" + (f"\n{row['text']}" if row.get("text") else "")


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over``: mappings are merged, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        if k.startswith("__"):
            continue
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


DEFAULTS = {"index": {"chunk_tokens": None, "overlap_lines": 10, "ignored_paths": [], "skip_extensions": [], "ignore_gitignore": False}, "query": {k: v for k, v in asdict(Request("")).items() if k != "text"}}


def read_config(spark: SparkSession, path: str) -> dict:
    """The configuration file over the defaults; no file means the defaults."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return DEFAULTS
    try:
        given = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    except json.JSONDecodeError as e:
        raise InvalidConfig(f"{path} is no JSON: {e}") from e
    if not isinstance(given, dict):
        raise InvalidConfig(f"{path} holds no object")
    found = merged(DEFAULTS, given)
    tokens = found["index"]["chunk_tokens"]
    if tokens is not None and (not isinstance(tokens, int) or tokens < 1):
        raise InvalidConfig("index.chunk_tokens must be a positive whole number")
    Request.of({"text": "", **found["query"]})
    return found


def healed(config: dict) -> dict:
    """Only the known settings of a configuration, defaults where one is missing or of another kind."""
    out: dict = {}
    for group, known in DEFAULTS.items():
        given = config.get(group) if isinstance(config.get(group), dict) else {}
        out[group] = {k: given[k] if k in given and (v is None or given[k] is None or isinstance(given[k], type(v))) else v for k, v in known.items()}
    return out


def with_options(request: Request, **options) -> Request:
    return replace(request, **options)
