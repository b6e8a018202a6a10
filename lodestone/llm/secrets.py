"""Secret scans with an incremental blob ledger.

Every text version is content-addressed by SHA-256. The ledger, a Parquet table, holds for each blob and rule version
the spans that were found; a scan reads from it which pairs are done, scans only unseen blobs, appends them, and joins
the findings back to all rows (paths) that hold a blob. Copies are scanned once: tasks first drop copies among their own
rows, blobs travel compressed, and after one shuffle by address each is scanned by one task.

Kinds in order: assign, access, hex (the base: matched leftmost and non-overlapping by themselves, failing matches
dropped), then pem, github, slack, jwt, google. Offsets are code points, end exclusive.

Two scans at one time may both append a blob; its spans are the same and count once. Very long texts are scanned whole.

Null texts count as empty: no spans. Repeated rows and null ids come back as they are; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestone.llm.common import map_arrow, scratch_path

RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0),
)
BASE = 3
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
COMPILED = [(kind, re.compile(pattern, re.ASCII), least) for kind, pattern, least in RULES]
#: Texts without any of a rule's words (in lower case) have no match of it.
WORDS = {0: ("password", "passwd", "secret", "token", "api"), 1: ("akia",), 3: ("private key",), 4: ("gh",), 5: ("xox",), 6: ("eyj",), 7: ("aiza",)}
SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"
EMPTY = hashlib.sha256(b"").hexdigest()


def scan(text: str) -> list[tuple[int, int, str, int]]:
    """(start, number of the kind, kind, end) of all spans by start, then kind."""
    low, found = text.lower(), []
    for k, (kind, pattern, least) in enumerate(COMPILED):
        if k in WORDS and not any(w in low for w in WORDS[k]):
            continue
        for m in pattern.finditer(text):
            if not least or len(m[1]) >= least:
                found.append((m.start(), k, kind, m.end()))
    return sorted(found)


def _addressed(docs: DataFrame, text_col: str) -> DataFrame:
    """(blob, z): content address and compressed text, copies among a task's rows dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            blobs, packed = [], []
            for value in batch.column(0):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                address = hashlib.sha256(raw).digest()
                if address not in seen:
                    seen.add(address)
                    blobs.append(address)
                    packed.append(pack.compress(raw))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(packed, pa.binary())], names=["blob", "z"])

    return map_arrow(docs.select(F.col(text_col).cast("string").cast("binary")), run, "blob binary, z binary")


def _scanned(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of blobs that stand together by address; the first of equal ones is scanned."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, seen = zstandard.ZstdDecompressor(), set()
        for batch in batches:
            done, spans = [], []
            for address, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if address not in seen:
                    seen.add(address)
                    text = unpack.decompress(z.as_buffer()).decode("utf-8", "replace")
                    done.append(address)
                    spans.append([dict(zip(("start", "kind_no", "kind", "end"), s, strict=True)) for s in scan(text)])
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.array(spans, kind)], names=["blob", "spans"])

    return map_arrow(blobs.repartition("blob"), run, f"blob binary, spans {SPANS}")


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """(rule_version, blob, spans) of all pairs scanned so far; None before the first scan."""
    try:
        return spark.read.schema(f"rule_version string, blob binary, spans {SPANS}").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def update(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """Scans the blobs of ``docs`` that the ledger at ``path`` hasn't under the current rules, and appends them."""
    blobs, known = _addressed(docs, text_col), ledger(docs.sparkSession, path)
    if known is not None:
        done = known.filter(F.col("rule_version") == RULE_VERSION).select("blob")
        blobs = blobs.join(done, "blob", "left_anti")
    _scanned(blobs).select(F.lit(RULE_VERSION).alias("rule_version"), "blob", "spans").write.mode("append").parquet(path)


def findings(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, blob, spans): every row of ``docs`` with its blob's spans, an empty list if it has none."""
    known = ledger(docs.sparkSession, path).filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
    known = known.groupBy("blob").agg(F.first("spans").alias("spans"))  # concurrent or repeated scans may append a blob twice
    paths = docs.select(id_col, F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("blob"))
    return paths.join(known.select("blob", "spans"), "blob", "left").select(
        id_col, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(k: int):
    return F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""
    path = path or scratch_path(docs.sparkSession, "ledger")
    update(docs, path)
    return findings(docs, path).select(
        "doc_id",
        *[_count(k).alias(f"n_{RULES[k][0]}") for k in range(BASE)],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind_no"] < BASE)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
