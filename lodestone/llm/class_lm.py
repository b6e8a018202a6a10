"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Tokens of a text: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token. The model is

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

with a text starting after an end token. Emissions are discounted counts (count - D) / N(class), D = n1 / (n1 + 2 n2);
what the discount frees in a class goes to the one event "word never seen in training", so the probabilities of all V
known tokens and of that event add up to one. Transitions are class bigram counts with a Dirichlet prior of strength
``BETA`` towards the class frequencies.

Classes: the ``head`` most frequent words (a parameter, the size of the model: the driver holds a table of its square)
are clustered by exchange: each word in turn moves to the class that raises the likelihood of all their bigrams in
the corpus most, until a sweep moves none (every move raises it, so this ends). All other words are placed by the same criterion, one exchange step
from the counts of their neighbours' classes, in a distributed pass; a word without such a neighbour goes to a class of its
kind. Counts cover every training text and every word.

How it runs: each task rewrites its texts as chunks of local word numbers, a written table. Words of a chunk (with the
chunk's count and neighbour classes) are sorted by word, totalled and classed as a stream, and sent back to their chunk;
so no dictionary of the corpus is held anywhere. A frequent word costs one row for each chunk, of which its task holds the chunk's number and
the place there (12 bytes) and adds the rest up as it passes. Transitions come from the
class sequences, a table of at most 66 x 66 cells.

Null and empty texts are an end token alone. Very long texts make chunks of their own size. Ties: equally frequent words count in the order of
their bytes, equal gains keep a word's class or go to the first class. Null ids count as id text "". Repeated rows are scored as often as they
stand; extra columns are ignored; without training rows every token is unseen and all scores are zero.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_of_id, discard, map_arrow, materialise

HEAD = 2048
CLASSES = 62
BETA = 20.0
CHUNK_TOKENS = 2_000_000
CHUNK_WORDS = 400_000
END = b""  # the end token, as a word
END_CLASS, LAST = 0, CLASSES + 1  # LAST: words without evidence
UNSEEN = CLASSES + 2
KINDS = CLASSES + 2  # classes of known tokens
SIDE = CLASSES + 1  # neighbour classes that are evidence: the end and the exchange classes


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


CHUNK_SCHEMA = "chunk long, words binary, counts binary, seq binary, ends binary, ids array<long>, train binary"


def encode(docs: DataFrame, train: Column) -> DataFrame:
    """Chunks: local word numbers of all tokens (0: end), the words in their order, their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        state = _Chunk()
        for batch in batches:
            for doc_id, used, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                state.add(doc_id, used, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if state.size >= CHUNK_TOKENS or len(state.numbers) >= CHUNK_WORDS:
                    yield state.row(base + made)
                    made, state = made + 1, _Chunk()
        if state.ids:
            yield state.row(base + made)

    rows = docs.select(F.col("doc_id").cast("long"), train.alias("train"), F.col("text").cast("string").cast("binary"))
    return map_arrow(rows, run, CHUNK_SCHEMA)


class _Chunk:
    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.ids: list[int | None] = []
        self.train: list[bool] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, used: bool, text: bytes) -> None:
        words = text.lower().split()
        own = np.zeros(len(words) + 1, np.int32)
        own[:-1] = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.ids.append(doc_id)
        self.train.append(used)
        self.parts.append(own)
        self.size += len(own)

    def row(self, chunk: int) -> pa.RecordBatch:
        seq = np.concatenate(self.parts)
        lengths = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        train = np.array(self.train, bool)
        counts = np.bincount(seq[np.repeat(train, lengths)], minlength=len(self.numbers) + 1).astype(np.int64)
        words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(self.numbers))
        binary = [words, _pack(counts), _pack(seq), _pack(np.cumsum(lengths))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()),
                *[pa.array([b], pa.binary()) for b in binary],
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([train.tobytes()], pa.binary()),
            ],
            names=["chunk", "words", "counts", "seq", "ends", "ids", "train"],
        )


def _words(row: dict) -> list[bytes]:
    joined = zstandard.ZstdDecompressor().decompress(row["words"])
    return [END, *joined.split(b"\n")] if joined else [END]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {f.name: batch.column(i)[k].as_py() for i, f in enumerate(batch.schema)}


def _training_tokens(row: dict) -> np.ndarray:
    """Local numbers of the training texts' tokens, after one end token."""
    seq, ends = _unpack(row["seq"], np.int32), _unpack(row["ends"], np.int64)
    lengths = np.diff(ends, prepend=0)
    return np.concatenate(([0], seq[np.repeat(np.frombuffer(row["train"], bool), lengths)]))


def most_frequent(chunks: DataFrame, head: int = HEAD) -> list[tuple[bytes, int]]:
    """The end token, then the ``head`` most frequent words, with their counts in all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            counts = _unpack(row["counts"], np.int64)
            kept = np.flatnonzero(counts)
            words = pa.array(_words(row), pa.binary()).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([words, pa.array(counts[kept])], names=["word", "n"])

    sums = map_arrow(chunks.select("words", "counts"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.length("word") > 0, F.desc("n"), "word").limit(head + 1).collect()
    return [(bytes(r[0]), r[1]) for r in top]


def head_bigrams(chunks: DataFrame, head: list[bytes]) -> np.ndarray:
    """Counts of (left, right) among the head's words, all others together being the last number."""
    size = len(head) + 1
    shared = chunks.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(head)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for row in _rows(batches):
            number = np.array([shared.value.get(w, size - 1) for w in _words(row)], np.int64)
            seq = number[_training_tokens(row)]
            total += np.bincount(seq[:-1] * size + seq[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    pairs = map_arrow(chunks.select("words", "seq", "ends", "train"), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    got = pairs.toArrow()
    bigrams = np.zeros(size * size)
    bigrams[got["pair"].to_numpy()] = got["n"].to_numpy()
    return bigrams.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each head word, class bigram counts). Word 0 is the end, the last number all other words (class LAST)."""
    size = len(bigrams)
    cls = 1 + (np.arange(size) - 1) % CLASSES
    cls[0], cls[size - 1] = END_CLASS, LAST
    one_hot = np.zeros((size, KINDS))
    one_hot[np.arange(size), cls] = 1
    left, right = bigrams.T @ one_hot, bigrams @ one_hot  # by word: counts of the class before, after
    pair = one_hot.T @ bigrams @ one_hot
    least = 1e-6 + 1e-12 * bigrams.sum()  # above what rounding may feign
    moved = 1
    while moved:
        moved = 0
        for w in range(1, size - 1):
            own, before, after = bigrams[w, w], left[w].copy(), right[w].copy()
            old = cls[w]
            before[old] -= own
            after[old] -= own
            pair[:, old] -= before
            pair[old] -= after
            pair[old, old] -= own
            rows, cols = pair.sum(axis=1) + before, pair.sum(axis=0) + after  # the word's neighbours have it beside them in any class
            n_after, n_before = after.sum() + own, before.sum() + own
            body = slice(1, LAST)
            gain = (_xlogx(pair[body] + after) - _xlogx(pair[body])).sum(axis=1)
            gain += (_xlogx(pair[:, body] + before[:, None]) - _xlogx(pair[:, body])).sum(axis=0)
            d = np.arange(1, LAST)
            cell = pair[d, d]
            gain += _xlogx(cell + after[d] + before[d] + own) - _xlogx(cell + after[d]) - _xlogx(cell + before[d]) + _xlogx(cell)
            gain -= _xlogx(rows[body] + n_after) - _xlogx(rows[body]) + _xlogx(cols[body] + n_before) - _xlogx(cols[body])
            new = 1 + int(np.argmax(gain))
            if gain[new - 1] <= gain[old - 1] + least:
                new = old
            pair[:, new] += before
            pair[new] += after
            pair[new, new] += own
            if new != old:
                moved += 1
                cls[w] = new
                left[:, old] -= bigrams[w]
                left[:, new] += bigrams[w]
                right[:, old] -= bigrams[:, w]
                right[:, new] += bigrams[:, w]
    return cls, pair


def evidence(pair: np.ndarray) -> np.ndarray:
    """What a neighbour's class says for each exchange class: rows are classes before, then classes after."""
    body = pair[:LAST, 1:LAST] + 0.1
    before = np.log(body / body.sum(axis=0) / body.sum(axis=1, keepdims=True))
    body = pair[1:LAST, :LAST].T + 0.1
    after = np.log(body / body.sum(axis=0) / body.sum(axis=1, keepdims=True))
    return np.concatenate((before, after))


def tail_words(chunks: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """(word, chunk, at, n, near): each other word of a chunk with its count and a byte for each neighbour of known class."""
    shared = chunks.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = _words(row), _unpack(row["counts"], np.int64)
            cls = np.array([shared.value.get(w, LAST) for w in words], np.uint8)
            seq = _training_tokens(row)
            code = cls[seq]
            here = np.flatnonzero(code == LAST)
            word = np.concatenate((seq[here], seq[here[here + 1 < len(seq)]]))
            near = np.concatenate((code[here - 1], code[here[here + 1 < len(seq)] + 1] + np.uint8(SIDE)))
            told = np.concatenate((code[here - 1], code[here[here + 1 < len(seq)] + 1])) < LAST
            word, near = word[told], near[told].astype(np.uint8)
            near = near[np.argsort(word, kind="stable")]
            kept = np.flatnonzero(cls == LAST)
            sizes = np.bincount(word, minlength=len(words))[kept]
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            context = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets), pa.py_buffer(near)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()).take(pa.array(kept)),
                    pa.array(np.full(len(kept), row["chunk"])),
                    pa.array(kept.astype(np.int32)),
                    pa.array(counts[kept]),
                    context,
                ],
                names=["word", "chunk", "at", "n", "near"],
            )

    return map_arrow(chunks, run, "word binary, chunk long, at int, n long, near binary")


class _Running:
    """A word whose rows are added up as they pass; of each only its place is held."""

    def __init__(self, word: pa.Scalar) -> None:
        self.word, self.total, self.seen = word, 0, np.zeros(2 * SIDE, np.int64)
        self.chunks: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def take_from(self, t: pa.Table) -> pa.Table:
        """Takes the word's rows at the front of ``t``; gives the others."""
        other = pa.compute.not_equal(t["word"], self.word).to_numpy(zero_copy_only=False)
        n = int(np.argmax(other)) if other.any() else t.num_rows
        own = t.slice(0, n)
        self.total += int(own["n"].to_numpy().sum())
        for near in own["near"]:
            self.seen += np.bincount(np.frombuffer(near.as_buffer() or b"", np.uint8), minlength=2 * SIDE)
        self.chunks.append(own["chunk"].to_numpy())
        self.places.append(own["at"].to_numpy())
        return t.slice(n)

    def row(self, told: np.ndarray) -> pa.RecordBatch:
        chunks = np.concatenate(self.chunks)
        n = len(chunks)
        best = UNSEEN if not self.total else 1 + int(np.argmax(self.seen @ told)) if self.seen.any() else LAST
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks), pa.array(np.concatenate(self.places)), pa.array(np.full(n, self.total)),
             pa.array(np.full(n, best, np.int16)), pa.array(np.arange(n) == 0)],
            names=["chunk", "at", "total", "cls", "first"],
        )


def totalled(tail: DataFrame, told: np.ndarray) -> DataFrame:
    """(chunk, at, total, cls, first): rows of a word stand together; it is totalled and classed as they pass."""

    def done(t: pa.Table) -> pa.RecordBatch:
        word = t["word"].combine_chunks()
        n = len(word)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pa.compute.not_equal(word.slice(1), word.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.add.reduceat(t["n"].to_numpy(), starts)
        near = t["near"].combine_chunks()
        sizes = pa.compute.binary_length(near).to_numpy()
        data = np.frombuffer(near.buffers()[2] or b"", np.uint8)
        first = np.frombuffer(near.buffers()[1], np.int32)[near.offset]
        data = data[first : first + int(sizes.sum())]
        best = np.full(len(starts), LAST, np.int64)
        owner = np.repeat(group, sizes)
        for a in range(0, len(starts), 20_000):
            b = min(a + 20_000, len(starts))
            lo, hi = np.searchsorted(owner, (a, b))
            seen = np.bincount((owner[lo:hi] - a) * 2 * SIDE + data[lo:hi], minlength=(b - a) * 2 * SIDE).reshape(b - a, 2 * SIDE)
            some = seen.any(axis=1)
            best[a:b][some] = 1 + np.argmax(seen[some] @ told, axis=1)
        best[total == 0] = UNSEEN
        return pa.RecordBatch.from_arrays(
            [t["chunk"].combine_chunks(), t["at"].combine_chunks(), pa.array(total[group]), pa.array(best[group].astype(np.int16)), pa.array(new)],
            names=["chunk", "at", "total", "cls", "first"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                t = pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
                if last is not None:
                    t = last.take_from(t)
                    if not t.num_rows:
                        continue
                    yield last.row(told)
                word = t["word"][t.num_rows - 1]  # may go on
                cut = int(np.argmax(pa.compute.equal(t["word"], word).to_numpy(zero_copy_only=False)))
                if cut:
                    yield done(t.slice(0, cut))
                last = _Running(word)
                last.take_from(t.slice(cut))
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        if last is not None:
            t = last.take_from(t) if t is not None else None
            yield last.row(told)
        if t is not None and t.num_rows:
            yield done(t)

    ordered = tail.repartition("word").sortWithinPartitions("word")
    return map_arrow(ordered, run, "chunk long, at int, total long, cls short, first boolean")


DOC_SCHEMA = (
    "doc_id long, train boolean, n_tokens long, n_known long, log_count double, log_emission double, unseen long, classes binary"
)


def attach(chunks: DataFrame, placed: DataFrame, head: dict[bytes, tuple[int, int]], mass: np.ndarray, discount: float) -> DataFrame:
    """Each text's sums over tokens and its class sequence, from its chunk and the chunk's words' totals and classes."""
    shared = chunks.sparkSession.sparkContext.broadcast((head, mass))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, mass = shared.value
        at, sums, classes = (right[c].to_numpy() for c in ("at", "total", "cls"))
        out = []
        for row in left.to_pylist():
            words = _words(row)
            total, cls = np.zeros(len(words), np.int64), np.full(len(words), UNSEEN, np.uint8)
            for k, w in enumerate(words):
                if w in known:
                    total[k], cls[k] = known[w]
            total[at], cls[at] = sums, classes
            log_count = np.log10(total + 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                emission = np.where(total > 0, np.log10((total - discount) / mass[np.minimum(cls, KINDS - 1)]), 0.0)
            seq, ends = _unpack(row["seq"], np.int32), _unpack(row["ends"], np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            code = cls[seq]
            flat, offsets = pa.py_buffer(code), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32))
            n_known = np.add.reduceat((total > 0).astype(np.int64)[seq], starts)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["ids"], pa.int64()),
                        "train": pa.array(np.frombuffer(row["train"], bool)),
                        "n_tokens": pa.array(ends - starts),
                        "n_known": pa.array(n_known),
                        "log_count": pa.array(np.add.reduceat(log_count[seq], starts)),
                        "log_emission": pa.array(np.add.reduceat(emission[seq], starts)),
                        "unseen": pa.array(ends - starts - n_known),
                        "classes": pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, flat]),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.schema(EMPTY_DOCS).empty_table()

    return chunks.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(run, DOC_SCHEMA)


EMPTY_DOCS = [
    ("doc_id", pa.int64()),
    ("train", pa.bool_()),
    *[(c, pa.int64()) for c in ("n_tokens", "n_known")],
    *[(c, pa.float64()) for c in ("log_count", "log_emission")],
    ("unseen", pa.int64()),
    ("classes", pa.binary()),
]


def transitions(texts: DataFrame) -> np.ndarray:
    """Class bigram counts of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS * KINDS, np.int64)
        for batch in batches:
            seq = np.frombuffer(b"\x00" + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(seq[:-1] * KINDS + seq[1:], minlength=KINDS * KINDS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    cells = map_arrow(texts.filter("train").select("classes"), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(KINDS * KINDS)
    for r in cells.collect():
        counts[r["pair"]] = r["n"]
    return counts.reshape(KINDS, KINDS)


def log_transitions(counts: np.ndarray, mass: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
    """log10 P(class or unseen | class before or unseen), (KINDS + 1) squared."""
    prior = mass / mass.sum()
    p = (counts + BETA * prior) / (counts.sum(axis=1, keepdims=True) + BETA)
    freed = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 0.0)
    full = np.column_stack((p, p @ freed))
    full = np.vstack((full, full[int(np.argmax(kinds))]))  # an unseen word acts like the class with most kinds of words
    with np.errstate(divide="ignore"):
        return np.log10(full)


def score(docs: DataFrame, train: Column, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_unseen."""
    chunks = materialise(encode(docs, train), "lm-chunks")
    top = most_frequent(chunks, head)
    if not top:
        return _untrained(docs, train)
    names = [w for w, _ in top]
    cls, pair = exchange(head_bigrams(chunks, names))
    of_head = {w: int(c) for w, c in zip(names, cls, strict=False)}
    placed = materialise(totalled(tail_words(chunks, of_head), evidence(pair)), "lm-words")
    mass, kinds, once, twice = (np.zeros(KINDS) for _ in range(4))
    for (w, n), c in zip(top, cls, strict=False):
        mass[c] += n
        kinds[c] += 1
        once[c] += n == 1
        twice[c] += n == 2
    sums = placed.filter("first and total > 0").groupBy("cls").agg(
        F.sum("total").alias("n"),
        F.count(F.lit(1)).alias("v"),
        F.sum((F.col("total") == 1).cast("long")).alias("once"),
        F.sum((F.col("total") == 2).cast("long")).alias("twice"),
    )
    for r in sums.collect():
        mass[r["cls"]] += r["n"]
        kinds[r["cls"]] += r["v"]
        once[r["cls"]] += r["once"]
        twice[r["cls"]] += r["twice"]
    n1, n2 = once.sum(), twice.sum()
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    tokens, types = int(mass.sum()), int(kinds.sum())
    known = {w: (n, of_head[w]) for w, n in top}
    texts = materialise(attach(chunks, placed, known, mass, discount), "lm-texts")
    discard(chunks)
    discard(placed)
    shared = docs.sparkSession.sparkContext.broadcast(log_transitions(transitions(texts), mass, kinds, discount))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column(5).to_numpy().copy()
            for k, seq in enumerate(batch.column(7)):
                code = np.frombuffer(b"\x00" + seq.as_py(), np.uint8)
                sums[k] += shared.value[code[:-1], code[1:]].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums), batch.column(6)], names=batch.schema.names[:7])

    rows = texts.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        (F.col("log_count") - F.col("n_tokens") * F.log10(F.lit(float(tokens + types + 1)))).alias("base_score"),
        F.col("log_emission").alias("score"),
        F.col("unseen").alias("n_unseen"),
        "classes",
    )
    out = map_arrow(rows, run, rows.drop("classes").schema)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_unseen"
    )


def _untrained(docs: DataFrame, train: Column) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (~train).alias("held_out"),
        (words + 1).cast("long").alias("n_tokens"),
        F.lit(0).cast("long").alias("n_known"),
        F.lit(0).cast("long").alias("train_tokens"),
        F.lit(0.0).alias("base_score"),
        F.lit(0.0).alias("score"),
        (words + 1).cast("long").alias("n_unseen"),
    )


def in_training() -> Column:
    return crc_of_id("doc_id") % 7 != 2
