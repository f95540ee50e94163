"""Language-model scoring by cross-entropy difference.

Two bigram models, matched in vocabulary and smoothing, are counted over whole
corpora: a target and a background. A document's score is the mean over its
words of background loss less target loss, in nats: the higher, the more it is
like the target.

Smoothing is Bayesian: a history's words have the unigram probabilities as a
prior that weighs PRIOR words, and every word of the vocabulary, and one unknown word
besides, is counted once more than it occurs. A document that is in a corpus
itself is scored by what remains of the model without it, so that no text is
judged by its own counts.

All words and bigrams of the corpora count; words are told apart by 64-bit
hashes, n-grams by KEY_BITS bits of one. Documents are taken in chunks. Each
chunk asks for its n-grams' counts in all chunks: it sends its own counts, by
ranges of keys, to the task that adds up a range, and gets the totals back.
Neither the models nor any part of them that grows with the corpus is held in one place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize
from .packed import from_planes, mixed, packed_ranges, planes, range_bits_for, unpacked_range
from .simhash import word_blocks

#: Words that the unigrams weigh in a history.
PRIOR = 300.0
#: Bytes of text in a chunk, unless one document has more.
CHUNK = 12 << 20
KEY_BITS = 50
#: N-grams of all chunks that one task adds up.
RANGE_ROWS = 1 << 21
_MOST_RANGE_BITS = 20
_U64 = np.uint64
_STEP = _U64(0xD6E8FEB86659FD93)
_WORDS, _PAIRS = 0, 1
#: Values of a word: as a word of the target and the background, as a history of them; of a bigram: of both.
_COLUMNS = {_WORDS: 4, _PAIRS: 2}


def _chunk(ids: list, flags: list, texts: list[bytes]) -> dict:
    """A row for some documents: words as numbers in the order of first use, 0 for the start of a text."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    known[b""]
    parts, n = [], []
    for data in texts:
        size = 0
        for words in word_blocks(data.lower()):
            parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            size += len(words)
        n.append(size)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    words = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    return {"ids": ids, "n": n, "in_target": [f[0] for f in flags], "in_background": [f[1] for f in flags], "words": words.tobytes(), "tokens": planes(tokens)}


def _chunk_type(id_type: T.DataType) -> T.StructType:
    fields = [("chunk", T.LongType()), ("ids", T.ArrayType(id_type)), ("n", T.ArrayType(T.LongType()))]
    fields += [(k, T.ArrayType(T.BooleanType())) for k in ("in_target", "in_background")] + [("words", T.BinaryType()), ("tokens", T.BinaryType())]
    return T.StructType([T.StructField(k, t) for k, t in fields])


def chunks(docs: DataFrame, id_col: str, text_col: str, target: Column, background: Column) -> DataFrame:
    """Documents by chunks: one row for about CHUNK bytes of text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _chunk_type(docs.schema[id_col].dataType)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, size = TaskContext.get().partitionId() << 32, 0, 0
        ids, flags, texts = [], [], []

        def row():
            return pa.RecordBatch.from_pylist([{"chunk": first + done} | _chunk(ids, flags, texts)], schema=schema)

        for batch in batches:
            for i, t, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or b""
                if texts and size + len(text) > CHUNK:
                    yield row()
                    ids, flags, texts, size, done = [], [], [], 0, done + 1
                ids.append(i)
                flags.append((t, b))
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    flags = (F.coalesce(c, F.lit(False)) for c in (target, background))
    return docs.select(F.col(id_col), *(f.alias(f"__{k}") for k, f in enumerate(flags)), F.col(text_col).cast("binary")).mapInArrow(run, kind)


class _Chunk:
    """What a chunk's row says: tokens, their histories, and the n-grams' sorted keys with each token's place among them."""

    def __init__(self, row: dict):
        n = np.array(row["n"], np.int64)
        words, self.tokens = np.frombuffer(row["words"], "<u8"), from_planes(row["tokens"], int(n.sum()), 1)[0].astype(np.int64)
        self.n, self.doc = n, np.repeat(np.arange(len(n)), n)
        self.flags = [np.array(row[k], bool)[self.doc] for k in ("in_target", "in_background")]
        history = np.empty_like(self.tokens)
        history[1:] = self.tokens[:-1]
        history[(np.cumsum(n) - n)[n > 0]] = 0
        shift = _U64(64 - KEY_BITS)
        self.word_keys, self.place = np.unique(mixed(words) >> shift, return_inverse=True)
        self.word, self.history = self.place[self.tokens], self.place[history]
        self.pair_keys, self.pair = np.unique(mixed(words[history] * _STEP + words[self.tokens]) >> shift, return_inverse=True)

    def counts(self) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
        """Keys and values of both kinds of n-grams."""

        def of(at: np.ndarray, size: int) -> list[np.ndarray]:
            return [np.bincount(at[f], minlength=size) for f in self.flags]

        size = len(self.word_keys)
        return {_WORDS: (self.word_keys, of(self.word, size) + of(self.history, size)), _PAIRS: (self.pair_keys, of(self.pair, len(self.pair_keys)))}

    def own(self, at: np.ndarray) -> np.ndarray:
        """How often each token's n-gram is in its own document."""
        _, where, n = np.unique(self.doc * (int(at.max()) + 1) + at, return_inverse=True, return_counts=True)
        return n[where]


_ASKED = "chunk long, kind int, part int, n int, data binary"


def _ask(bits: int):
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (keys, values) in _Chunk(row).counts().items():
                    found = [(row["chunk"], kind, *x) for x in packed_ranges(keys, values, KEY_BITS, bits)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _add_up(bits: int):
    """Totals of a range, packed for each chunk in the order of its keys; and, of words, their number, as of chunk -1."""

    def run(key, table):
        kind, part = (k.as_py() for k in key)
        sizes, chunk = table["n"].to_pylist(), table["chunk"].to_pylist()
        parts = [unpacked_range(part, n, data, _COLUMNS[kind], KEY_BITS, bits) for n, data in zip(sizes, table["data"].to_pylist())]
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        totals = [np.bincount(where, weights=np.concatenate([p[k + 1] for p in parts]), minlength=len(keys)).astype(np.int64) for k in range(_COLUMNS[kind])]
        ends = np.cumsum(sizes)
        data = [b"".join(planes(t[where[e - n : e]]) for t in totals) for n, e in zip(sizes, ends.tolist())]
        return pa.table({"chunk": pa.array([*chunk, -1], pa.int64()), "kind": pa.array([kind] * (len(chunk) + 1), pa.int32()), "part": pa.array([part] * (len(chunk) + 1), pa.int32()), "n": pa.array([*sizes, len(keys)], pa.int32()), "data": pa.array([*data, b""], pa.binary())})

    return run


def _losses(c: _Chunk, answers: dict[int, list[np.ndarray]], totals: list[int], n_words: int, k: int, member: np.ndarray) -> np.ndarray:
    """Loss of each token under the target (``k`` 0) or the background (1), without its own document if that is a ``member``."""
    own = {name: np.where(member, c.own(at), 0) for name, at in (("pair", c.pair), ("word", c.word), ("history", c.history))}
    rest = totals[k] - np.where(member, c.n[c.doc], 0)
    single = (answers[_WORDS][k][c.word] - own["word"] + 1.0) / (rest + n_words + 1.0)
    seen = answers[_WORDS][k + 2][c.history] - own["history"]
    return -np.log((answers[_PAIRS][k][c.pair] - own["pair"] + PRIOR * single) / (seen + PRIOR))


def _answer(totals: list[int], n_words: int, id_col: str):
    names = ("n_words", "target_loss", "background_loss", "score")

    def run(left, right):
        (row,) = left.to_pylist()
        c, answers = _Chunk(row), {}
        parts = sorted(right.to_pylist(), key=lambda r: (r["kind"], r["part"]))
        for kind, columns in _COLUMNS.items():
            found = [from_planes(r["data"], r["n"], columns) for r in parts if r["kind"] == kind]
            answers[kind] = [np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in range(columns)]
        means = []
        for k, member in enumerate(c.flags):
            lost = _losses(c, answers, totals, n_words, k, member) if len(c.tokens) else np.zeros(0)
            means.append(np.bincount(c.doc, weights=lost, minlength=len(c.n)) / np.maximum(c.n, 1))
        return pa.table([left["ids"].combine_chunks().flatten(), c.n, *means, means[1] - means[0]], names=[id_col, *names])

    return run


def score(docs: DataFrame, target: Column, background: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, target_loss, background_loss and score (their difference) for every input row.

    ``target`` and ``background`` (all rows, unless given) say which rows the
    two models are counted over; a null counts as false. Rows of neither are
    scored too. Texts that are null or have no words have losses and score 0,
    and so have all rows of corpora without words. Repeated rows and rows with
    equal or null ids are documents of their own. Other columns are not read. What comes to the driver are four numbers.
    """
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), target.alias("__target"), (F.lit(True) if background is None else background).alias("__background"))
    rows = materialize(chunks(docs, "__id", "__text", F.col("__target"), F.col("__background")))
    sums = [F.coalesce(F.sum(F.aggregate(F.zip_with("n", k, lambda n, f: F.when(f, n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)) for k in ("in_target", "in_background")]
    *totals, entries = rows.agg(*sums, F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    bits = range_bits_for(entries, RANGE_ROWS, _MOST_RANGE_BITS)
    asked = rows.mapInArrow(_ask(bits), _ASKED)
    answers = materialize(asked.groupBy("kind", "part").applyInArrow(_add_up(bits), _ASKED))
    n_words = answers.where((F.col("chunk") == -1) & (F.col("kind") == _WORDS)).agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0] - 1  # without the start
    out = T.StructType([T.StructField("__id", id_type), T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score"))])
    found = rows.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(_answer(totals, n_words, "__id"), out)
    found = materialize(found)
    discard(rows)
    discard(answers)
    return found.withColumnRenamed("__id", id_col)
