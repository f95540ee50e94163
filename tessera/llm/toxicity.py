"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of itself and its character
n-grams (hashed to buckets), each shrunk by how few fitted rows have it; a text's vector is the mean over its words; a
linear softmax over it gives the probability. Misspellings that were never seen
share n-grams with words that were.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, picked, struct_of

_WORD = re.compile(r"[^\W_]+")
#: Subwords: n-grams of these lengths of the word between < and >, and the whole.
LENGTHS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 8
#: At most so many labelled rows of either class are fitted, and so many bytes of their texts: those whose ids and
#: texts hash lowest.
MAX_FIT_ROWS, MAX_FIT_BYTES = 3000, 64 << 20
#: A subword that r fitted rows have counts r / (r + FEW_ROWS) times, or rare ones would learn rows by heart.
FEW_ROWS = 10
#: Words whose scores a task remembers, besides what the model knows.
_MEMORY = 300_000


def words_of(text: str | None) -> Iterator[list[str]]:
    """The lower-case words, in one list for each million characters or so."""
    text, at = text or "", 0
    while at < len(text):
        end = text.find(" ", at + (1 << 20))
        end = len(text) if end < 0 else end
        yield _WORD.findall(text[at:end].lower())
        at = end


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all ``words``, and the word that each belongs to (ascending)."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in marked])
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the word's end
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in marked], np.uint64)
    buckets, owners = [whole], [np.arange(len(words))]
    for n in LENGTHS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x100000001B3)
        buckets.append(h ^ (h >> np.uint64(29)))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(buckets)[order] % np.uint64(BUCKETS)).astype(np.int32), owners[order]


@dataclass
class Model:
    """``weights``: what each bucket adds to the log-odds of toxic; ``used``: buckets that were fitted; ``bias``: the log-odds of a text without words."""

    weights: np.ndarray
    used: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds to the mean: the mean of its fitted subwords' weights."""
        buckets, owner = subwords(words)
        total = np.bincount(owner, weights=self.weights[buckets], minlength=len(words))
        return total / np.maximum(1, np.bincount(owner, weights=self.used[buckets], minlength=len(words)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over runs, none of them empty."""
    return np.add.reduceat(values, offsets[:-1], axis=0)


def fit(texts: list[str], labels: np.ndarray, row_weights: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.08, decay: float = 0.05, seed: int = 7) -> Model:
    """Joint fit of embeddings and softmax by Adam on mini-batches of the weighted log loss."""
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    docs, kept = [], []
    for k, text in enumerate(texts):
        ids = [known.setdefault(w, len(known)) for words in words_of(text) for w in words]
        if ids:
            docs.append(np.unique(np.array(ids), return_counts=True))
            kept.append(k)
    prior = float(row_weights @ labels + 0.5) / float(row_weights.sum() + 1)
    start = float(np.log(prior / (1 - prior)))
    if not docs or len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool), start)
    y, weight = labels[kept].astype(np.float64), row_weights[kept] / row_weights[kept].mean()
    flat, owner = subwords(list(known))
    start_of = np.searchsorted(owner, np.arange(len(known) + 1))
    rows_with = np.zeros(BUCKETS, np.int32)
    for ids, _ in docs:
        rows_with[np.unique(np.concatenate([flat[start_of[i] : start_of[i + 1]] for i in ids.tolist()]))] += 1
    used = rows_with > 0
    shrunk = np.append(rows_with / (rows_with + FEW_ROWS), 0).astype(np.float32)
    order = np.argsort(owner, kind="stable")
    flat, lengths = flat[order], np.bincount(owner, minlength=len(known))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    emb[:-1][~used] = emb[-1] = 0
    out = np.zeros((DIM, 2), np.float32)
    out[:, 1], out[:, 0] = 0.5, -0.5
    bias = np.array([-start / 2, start / 2], np.float32)
    params = [emb, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ids = np.concatenate([docs[r][0] for r in rows])
            share = np.concatenate([docs[r][1] / docs[r][1].sum() for r in rows]).astype(np.float32)
            per_doc = np.concatenate([[0], np.cumsum([len(docs[r][0]) for r in rows])])
            vocab, local = np.unique(ids, return_inverse=True)
            per_word = np.concatenate([[0], np.cumsum(lengths[vocab])])
            which = np.repeat(begin[vocab] - per_word[:-1], lengths[vocab]) + np.arange(per_word[-1])
            buckets = flat[which]
            size = lengths[vocab][:, None].astype(np.float32)
            vectors = _sums(emb[buckets] * shrunk[buckets, None], per_word) / size
            means = _sums(vectors[local] * share[:, None], per_doc)
            logits = means @ out + bias
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=1, keepdims=True)
            wrong = chance.copy()
            wrong[np.arange(len(rows)), y[rows].astype(int)] -= 1
            wrong *= (weight[rows] / len(rows))[:, None].astype(np.float32)
            d_means = wrong @ out.T
            d_words = np.stack([np.bincount(local, weights=share * np.repeat(d_means[:, d], np.diff(per_doc)), minlength=len(vocab)) for d in range(DIM)], axis=1) / size
            spread = np.repeat(d_words, lengths[vocab], axis=0) * shrunk[buckets, None]
            d_emb = np.stack([np.bincount(buckets, weights=spread[:, d], minlength=BUCKETS + 1) for d in range(DIM)], axis=1).astype(np.float32)
            d_emb[-1] = 0
            step += 1
            for p, g, m, v in zip(params, (d_emb, means.T @ wrong, wrong.sum(axis=0)), first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            emb *= 1 - lr * decay
            out *= 1 - lr * decay
    return Model((emb[:-1] @ (out[:, 1] - out[:, 0]) * shrunk[:-1]).astype(np.float32), used, float(bias[1] - bias[0]))


class Scorer:
    """Scores texts, and remembers up to _MEMORY words or those of one part of a text."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def learn(self, lists: list[list[str]]) -> None:
        words = set().union(*lists)
        fresh = words - self.known.keys()
        if len(self.known) + len(fresh) > _MEMORY:
            self.known, fresh = {}, words
        fresh = list(fresh)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            self.known.update(zip(part, self.model.words(part).tolist()))

    def texts(self, texts: list[str | None]) -> Iterator[float]:
        """The probability of label 1 of each; a text without words has that of the bias alone."""
        sums, held, size = [[0.0, 0] for _ in texts], [], 0

        def add():
            self.learn([words for _, words in held])
            for k, words in held:
                sums[k][0] += sum(map(self.known.__getitem__, words))
                sums[k][1] += len(words)

        for k, text in enumerate(texts):
            for words in words_of(text):
                held.append((k, words))
                size += len(words)
                if size > 200_000:
                    add()
                    held, size = [], 0
        add()
        for total, n in sums:
            yield float(1 / (1 + np.exp(-np.clip(self.model.bias + (total / n if n else 0.0), -500, 500))))


def sample(labels: DataFrame, docs: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of up to ``most`` rows of either label, those whose ids hash lowest.

    The ids are chosen from ``labels`` before any text is read, and of the
    documents that have them again at most ``most``, as ids may repeat. Weights
    restore the labels' shares. Labels whose documents are missing don't come back.
    """
    marked = picked(labels, __id=id_col, y=label_col).where(F.col("y").isin(0, 1)).withColumn("y", F.col("y").cast("int"))
    ids = bounded_sample(marked, "y", ["__id"], most, 2).select("__id", "y", F.col("__n").alias("__all"))
    rows = picked(docs, __id=id_col, text=text_col).join(F.broadcast(ids), "__id").withColumn("__size", F.octet_length("text"))  # at most 2 * most ids
    chosen = bounded_sample(rows, "y", ["__id", "text"], most, 2, "__size", MAX_FIT_BYTES)
    got = sorted(chosen.select("__h", "y", "text", "__all").collect(), key=lambda r: (r["__h"], r["y"], r["text"] or ""))
    y = np.array([r["y"] for r in got], np.int64)
    sizes = np.bincount(y, minlength=2)
    return [r["text"] or "" for r in got], y, np.array([r["__all"] / sizes[r["y"]] for r in got], float)


def train(labels: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_FIT_ROWS) -> Model:
    """Fit on a bounded sample of the documents that ``labels`` has; labels other than 0 and 1 are left out.

    Without rows of both classes the model knows only the classes' shares.
    """
    return fit(*sample(labels, docs, id_col, text_col, label_col, most))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score and predicted for every input row; other columns are not read.

    Texts that are null or have no words get the share of toxic rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.used, model.bias))  # BUCKETS floats and flags
    scorers: list[Scorer] = []
    rows = picked(docs, __id=id_col, text=text_col)

    def run(batch):
        if not scorers:
            scorers.append(Scorer(Model(*shared.value)))
        p = list(scorers[0].texts(batch.column(1).to_pylist()))
        return {"__id": batch.column(0), "score": p, "predicted": [int(x >= 0.5) for x in p]}

    return map_batches(rows, struct_of(__id=rows.schema["__id"].dataType, score="double", predicted="int"), run).withColumnRenamed("__id", id_col)
