"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every code point is lower-cased one to one, every non-letter becomes a gap and runs of gaps count once; n-grams of one
to three such characters are hashed into ``buckets``. Training counts come from all labelled rows given to ``fit``;
each partition adds up its own counts, so what is shuffled has a bounded size for each partition. The log-probability
matrix (languages x buckets doubles) is broadcast; it stays below ``MATRIX_BYTES``, for which tables of more than 1,024 languages
halve ``buckets`` as often as needed (a bucket's counts are those of its two halves). Scoring is a sparse product: the n-grams of
a batch of texts are cut into blocks of ``BLOCK``, whose rows of the matrix are gathered and added up by text in numpy, so that a very
long text costs no more memory than a short one beyond its own n-grams.

A text's language is predicted from the text alone. A text that is null, empty or without a letter gets ``und`` with score 0, and so does
every text if nothing was learned. The score is the posterior probability of the language; equal ones go to the first
by name. Rows with a null label or text teach nothing. Repeated rows, null ids and extra columns are allowed; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_of_id, map_arrow, materialise

UNKNOWN = "und"
MATRIX_BYTES = 256 << 20
BUCKETS = 1 << 15
BLOCK = 1 << 17
_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to 32 if it isn't a letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def ngram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of the text; none if it has no letter."""
    points = _fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    gap = points == 32
    if gap.all():
        return np.zeros(0, np.int64)
    points = np.concatenate(([32], points[~(gap & np.concatenate(([True], gap[:-1])))], [32])).astype(np.uint32)
    one = points * np.uint32(2654435761)
    two = (one[:-1] ^ (points[1:] + np.uint32(0x9E3779B9))) * np.uint32(2246822519)
    three = (two[:-1] ^ (points[2:] + np.uint32(0x85EBCA6B))) * np.uint32(3266489917)
    hashed = np.concatenate((one[points != 32], two, three))
    return ((hashed ^ (hashed >> np.uint32(15))) % np.uint32(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_prob: np.ndarray  # buckets x languages
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text of a batch."""
        said, grams, of, waiting = [(UNKNOWN, 0.0)] * len(texts), [], [], 0
        total = np.zeros((len(texts), len(self.langs)))
        for k, text in enumerate(texts):
            own = ngram_buckets(text, len(self.log_prob)) if text and self.langs else ()
            if len(own):
                grams.append(own)
                of.append(k)
                waiting += len(own)
                if waiting >= BLOCK:
                    self._add(total, grams, of)
                    waiting, grams, of = 0, [], []
                said[k] = None
        if grams:
            self._add(total, grams, of)
        total += self.prior
        for k in (k for k, x in enumerate(said) if x is None):
            best = int(np.argmax(total[k]))
            said[k] = self.langs[best], float(1.0 / np.exp(total[k] - total[k, best]).sum())
        return said

    def _add(self, total: np.ndarray, grams: list[np.ndarray], of: list[int]) -> None:
        """Adds each text's rows of the matrix to its line of ``total``, block by block."""
        joined, owner = np.concatenate(grams), np.repeat(of, [len(g) for g in grams])
        for a in range(0, len(joined), BLOCK):
            at = owner[a : a + BLOCK]
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            total[at[starts]] += np.add.reduceat(self.log_prob[joined[a : a + BLOCK]], starts, axis=0)


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", buckets: int = BUCKETS, alpha: float = 0.05) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = counts.get(lang)
                if own is None:
                    own = counts[lang] = np.zeros(buckets + 1, np.int64)
                grams = ngram_buckets(text.as_py(), buckets)
                if len(grams):
                    own[:buckets] += np.bincount(grams, minlength=buckets)
                    own[buckets] += 1
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "b", "n"]
            )

    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("l")).filter(
        "t is not null and l is not null"
    )
    sums = map_arrow(rows, run, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "language-counts")  # read twice
    langs = [r[0] for r in sums.filter(F.col("b") == buckets).select("lang").orderBy("lang").collect()]
    full, fold = buckets, 1
    while len(langs) * buckets * 8 > MATRIX_BYTES and buckets > 1:
        buckets, fold = buckets // 2, fold * 2
    held = F.when(F.col("b") == full, buckets).otherwise(F.col("b") % buckets)
    got = (sums if fold == 1 else sums.groupBy("lang", held.alias("b")).agg(F.sum("n").alias("n"))).toPandas()
    counts = np.zeros((buckets + 1, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    known = got[got["lang"].isin(place)]
    counts[known["b"].to_numpy(), known["lang"].map(place).to_numpy(dtype=np.int64)] = known["n"].to_numpy()
    grams, docs_of = counts[:buckets], counts[buckets]
    log_prob = np.log((grams + alpha) / (grams.sum(axis=0) + alpha * buckets)) if langs else np.zeros((buckets, 0))
    prior = np.log(docs_of / docs_of.sum()) if langs else np.zeros(0)
    return Model(langs, log_prob, prior)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())],
                names=[*[f.name for f in batch.schema][:-1], "lang_pred", "score"],
            )

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, f"{schema}, lang_pred string, score double")


def is_held_out(id_col: str = "doc_id"):
    return crc_of_id(id_col) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, predict all rows: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(~is_held_out()))
    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])


def stage(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose language is recognised with a posterior of at least ``least``; columns as given."""
    model = fit(docs.filter(~is_held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[1] >= least for x in said], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
