"""Language identification by words first, then by shorter and shorter character n-grams.

A word that the model knows scores by its log frequency in each language. Any
other word is scored by its longest n-grams of which the model knows one at
least: the mean of their log frequencies. A text's scores are the sums over its
words, and the largest names the language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, by_position, discard, map_batches, materialize, picked, struct_of

#: Runs of letters (and of the few numeric characters that are no decimal digits).
_WORD = re.compile(r"[^\W\d_]+")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
#: n-gram lengths, of words between < and >.
LENGTHS = (5, 4, 3, 2, 1)
#: The model is fitted on at most so many rows, and bytes of text, of each language: those whose ids and texts hash lowest.
MAX_FIT_ROWS, MAX_FIT_BYTES = 1500, 32 << 20
MAX_LANGUAGES = 1000
#: Words and n-grams that the fitted rows have less often are not in the model; there is no bound on how many are.
LEAST_COUNT = 2
#: The score is the softmax of the mean score of a word times at most so many words.
EVIDENCE = 30
#: Words whose scores a task remembers; words that are summed at once; characters of a text that are split into words at once.
_MEMORY, _GROUP, _PIECE = 200_000, 200_000, 1 << 20


def words_of(text: str | None) -> Iterator[list[str]]:
    """The lower-case words in lists, one for each million characters or so; without words that have no letter."""
    text, at = text or "", 0
    while at < len(text):
        end = text.find(" ", at + _PIECE)
        end = len(text) if end < 0 else end
        piece = text if end - at == len(text) else text[at:end]
        if piece.isascii():
            yield piece.encode().translate(_ASCII).decode().split()
        else:
            yield [w for w in _WORD.findall(piece.lower()) if w.isalpha() or any(map(str.isalpha, w))]
        at = end


def grams_of(word: str, n: int) -> list[str]:
    data = f"<{word}>" if n > 1 else word
    return [data[i : i + n] for i in range(len(data) - n + 1)]


def gram_counts(words: dict[str, int], n: int) -> Counter:
    """How often each n-gram occurs in words that occur so often."""
    found: Counter = Counter()
    for w, k in words.items():
        for g in grams_of(w, n):
            found[g] += k
    return found


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_FIT_ROWS) -> tuple[list[str], dict[str, int], dict[int, dict[str, int]], np.ndarray]:
    """Languages, known words and n-grams (by length) with their rows in a table of log frequencies.

    Fitted on at most ``most`` rows and MAX_FIT_BYTES bytes of each language,
    which bounds what the driver gets; rows whose language is null aren't
    fitted. More than MAX_LANGUAGES languages are refused. An empty table gives a model that knows no language.
    """
    rows = picked(labelled, __id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string")).withColumn("__size", F.octet_length("text"))
    chosen = bounded_sample(rows, "lang", ["__id", "text"], most, MAX_LANGUAGES, "__size", MAX_FIT_BYTES)

    def count(batch):
        by_lang: defaultdict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for words in words_of(text):
                by_lang[lang].update(words)
        found = [(n, g, lang, c) for lang, words in by_lang.items() for n in (0, *LENGTHS) for g, c in (gram_counts(words, n) if n else words).items()]
        return dict(zip(("n", "gram", "lang", "c"), zip(*found))) if found else {k: [] for k in ("n", "gram", "lang", "c")}

    counts = map_batches(chosen.select("lang", "text"), struct_of(n="int", gram="string", lang="string", c="long"), count)
    counts = materialize(counts.groupBy("n", "gram", "lang").agg(F.sum("c").alias("c")))
    sums = {(r["n"], r["lang"]): (r["c"], r["k"]) for r in counts.groupBy("n", "lang").agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect()}
    langs = sorted({lang for _, lang in sums})
    column = {lang: i for i, lang in enumerate(langs)}
    by_gram = counts.groupBy("n", "gram").agg(F.sum("c").alias("total"), F.collect_list(F.struct("lang", "c")).alias("by_lang"))  # one entry a language
    table = by_gram.where(F.col("total") >= LEAST_COUNT).select("n", "gram", "by_lang").orderBy("n", "gram").toArrow()
    discard(counts)
    words: dict[str, int] = {}
    grams: dict[int, dict[str, int]] = {n: {} for n in LENGTHS}
    kinds = {n: sum(k for (m, _), (_, k) in sums.items() if m == n) for n in (0, *LENGTHS)}
    totals = np.array([[sums.get((n, lang), (0, 0))[0] + 0.1 * kinds[n] for lang in langs] for n in range(max(LENGTHS) + 1)])
    scores = np.full((table.num_rows, len(langs)), 0.1)
    of_row = table["n"].to_numpy()
    for at, (n, gram) in enumerate(zip(of_row.tolist(), table["gram"].to_pylist())):
        (grams[n] if n else words)[gram] = at
    lists = table["by_lang"].combine_chunks()
    if table.num_rows:
        row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
        items = lists.flatten()
        scores[row, [column[x] for x in items.field("lang").to_pylist()]] += items.field("c").to_numpy()
        scores = np.log(scores / totals[of_row])
    return langs, words, grams, scores.astype(np.float32)


class Identifier:
    """Names the languages of texts; remembers the scores of up to _MEMORY words."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: dict[int, dict[str, int]], scores: np.ndarray):
        self.langs, self.words, self.grams, self.scores = langs, words, grams, scores
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.rows = np.zeros((0, len(self.langs)))

    def word(self, word: str) -> np.ndarray:
        """The scores of a word in all languages."""
        at = self.words.get(word)
        return self.unseen(word) if at is None else self.scores[at]

    def unseen(self, word: str) -> np.ndarray:
        for n in LENGTHS:
            at = [i for g in grams_of(word, n) if (i := self.grams[n].get(g)) is not None]
            if at:
                return self.scores[at].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def sums(self, lists: list[list[str]]) -> np.ndarray:
        """The scores of the words of each list, none of them empty."""
        if len(self.number) > _MEMORY:
            self.forget()
        sizes = [len(x) for x in lists]
        at = np.concatenate([np.fromiter(map(self.number.__getitem__, x), np.int64, n) for x, n in zip(lists, sizes)])
        fresh = list(self.number)[len(self.rows) :]
        if fresh:
            self.rows = np.concatenate([self.rows, np.array([self.word(w) for w in fresh], np.float64)])
        return np.add.reduceat(self.rows[at], np.cumsum([0, *sizes[:-1]]), axis=0)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; ``und`` and 0 if it has no letter, or the model knows no language."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def add():
            for (k, words), x in zip(held, self.sums([words for _, words in held])):
                total[k] += x
                n[k] += len(words)

        for k, text in enumerate(texts if self.langs else []):
            for words in words_of(text):
                if words:
                    held.append((k, words))
                    size += len(words)
                if size > _GROUP:
                    add()
                    held, size = [], 0
        if held:
            add()
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        best = total.argmax(axis=1)
        x = (total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
        score = 1 / np.exp(x).sum(axis=1)
        return [(self.langs[b], s) if m else ("und", 0.0) for b, s, m in zip(best.tolist(), score.tolist(), n.tolist())]


def with_language(docs: DataFrame, model: tuple, text_col: str = "text") -> tuple[DataFrame, list[str], Column, Column]:
    """``docs`` with columns c0, c1 ..., their names, and the columns of the language and of the score of ``text_col``.

    ``und`` with score 0 for texts that are null or have no letter; so are all
    texts if the model knows no language. The columns that go with the text may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the bytes that are fitted
    known: list[Identifier] = []
    moved, names = by_position(docs)
    columns, at = moved.columns, names.index(text_col)

    def run(batch):
        if not known:
            known.append(Identifier(*shared.value))
        rows = known[0](batch.column(at).to_pylist())
        return dict(zip(columns, batch.columns)) | {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows]}

    kinds = {f.name: f.dataType for f in moved.schema}
    return map_batches(moved, struct_of(**kinds, lang_pred="string", score="double"), run), names, F.col("lang_pred"), F.col("score")


def identify(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score (see ``with_language``) of every input row; other columns are not read."""
    found, _, lang, score = with_language(picked(docs, __id=id_col, text=text_col), model)
    return found.select(F.col("c0").alias(id_col), lang, score)
