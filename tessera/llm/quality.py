"""Quality rules by weak supervision.

Rules vote good, bad or abstain on every document. Expectation-maximisation
over the counts of vote patterns of the whole corpus estimates how accurate
each rule is and the share of good documents; a document is kept if its posterior
probability of being good is at least one half and no base rule fails it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, materialize, picked, struct_of

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGITS = b"0123456789"
#: Words of one character that is neither letter nor digit.
_BARE = frozenset(bytes([c]) for c in range(0x21, 0x7F) if not chr(c).isalnum())
_STOPS = (b".", b"!", b"?", b":", b'"', b"'", b")")

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_digits", "n_stopped", "n_distinct", "n_bare")


def _without(data: bytes, drop: bytes) -> int:
    return len(data.translate(None, drop))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first finds included."""
    if len(words) < 4:
        return 0
    keys = np.fromiter(map(hash, zip(words, words[1:], words[2:])), np.int64, len(words) - 2)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    found = Counter(tuple(words[i : i + 3]) for i in at)  # equal hashes may still differ
    starts = np.array([i for i in at if found[tuple(words[i : i + 3])] > 1], np.int64)
    return len(np.unique(np.concatenate([starts, starts + 1, starts + 2])))


def text_features(data: bytes) -> tuple:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        _without(data, _CONTINUATION) - (len(data) - _without(data, _SPACE)),
        len(data) - _without(data, _SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(data) - _without(data, _UPPER),
        len(data) - _without(data, _LOWER),
        len(data) - _without(data, _DIGITS),
        sum(x.rstrip().endswith(_STOPS) for x in lines),
        len(set(words)),
        sum(map(_BARE.__contains__, words)),
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and FEATURES of the whole text; null counts as no words."""

    rows = picked(docs, __id=id_col, __text=text_col).withColumn("__text", F.col("__text").cast("binary"))

    def run(batch):
        found = [text_features(x or b"") for x in batch.column(1).to_pylist()]
        return {"__id": batch.column(0)} | dict(zip(FEATURES, zip(*found)))

    kinds = struct_of(__id=kind_of(rows, "__id"), **dict.fromkeys(FEATURES, "long"))
    return map_batches(rows, kinds, run).withColumnRenamed("__id", id_col)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def votes() -> list[Column]:
    """The rules as columns over FEATURES: 1 good, -1 bad, 0 abstains. None depends on the language."""
    f = {x: F.col(x).cast("double") for x in FEATURES}
    words, lines = F.greatest(f["n_words"], F.lit(1.0)), F.greatest(f["n_lines"], F.lit(1.0))
    letters, chars = F.greatest(f["n_upper"] + f["n_lower"], F.lit(1.0)), F.greatest(f["word_chars"], F.lit(1.0))
    mean, long_enough = f["word_chars"] / words, f["n_words"] >= 50
    return [
        _vote(mean.between(4, 6.5), (mean < 3) | (mean > 7.5)),
        _vote(f["n_symbols"] / words <= 0.01, f["n_symbols"] / words > 0.05),
        _vote(f["n_bare"] / words <= 0.01, f["n_bare"] / words > 0.1),
        _vote((f["n_lines"] > 2) & (f["n_dup_lines"] / lines <= 0.1), f["n_dup_lines"] / lines > 0.25),
        _vote(long_enough & (f["n_repeat_words"] / words <= 0.1), f["n_repeat_words"] / words > 0.25),
        _vote(f["n_words"] >= 100, f["n_words"] < 30),
        _vote(f["n_upper"] / letters <= 0.06, f["n_upper"] / letters > 0.3),
        _vote(f["n_digits"] / chars <= 0.01, f["n_digits"] / chars > 0.15),
        _vote(f["n_stopped"] / lines >= 0.9, f["n_stopped"] / lines < 0.5),
        _vote(long_enough & (f["n_distinct"] / words > 0.45), long_enough & (f["n_distinct"] / words < 0.25)),
    ]


#: The driver gets the counts of vote patterns: at most 3 to the power of the number of rules.
MAX_PATTERNS = 3**10


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) and the number of documents with each.

    Each rule has, for either class, the probabilities of its three votes, so a
    rule may be better at finding bad documents than good ones. The first guess
    holds documents without a bad vote for good. Returns those probabilities
    (class, rule, vote), the share of good documents and each pattern's
    posterior probability of being good.
    """
    seen = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    posterior = np.where((patterns == -1).any(axis=1), 0.1, 0.95)
    chances, share = np.empty((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        share = float(np.clip((counts @ posterior + 8) / (counts.sum() + 10), 0.05, 0.95))
        for k, weight in enumerate((1 - posterior, posterior)):
            mass = np.einsum("p,pjv->jv", counts * weight, seen) + 1
            chances[k] = mass / mass.sum(axis=1, keepdims=True)
        logit = np.log(share / (1 - share)) + np.einsum("pjv,jv->p", seen, np.log(chances[1] / chances[0]))
        new = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        moved, posterior = np.abs(new - posterior).max(), new
        if moved < 1e-9:
            break
    return chances, share, posterior


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FEATURES, base_failed, posterior and kept for every input row.

    Null texts have no words and fail the base rules. The only thing that
    comes to the driver is the table of vote patterns, at most MAX_PATTERNS rows.
    An empty input gives an empty result.
    """
    rules = votes()
    found = materialize(features(docs, id_col, text_col).withColumn("pattern", F.concat_ws(",", *rules)))
    counted = found.groupBy("pattern").count().collect()
    counted.sort(key=lambda r: r["pattern"])
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    if not counted:
        return found.drop("pattern").withColumns({"base_failed": failed, "posterior": F.lit(0.0), "kept": F.lit(False)})
    patterns = np.array([[int(v) for v in r["pattern"].split(",")] for r in counted])
    _, _, posterior = fit_accuracies(patterns, np.array([r["count"] for r in counted], float))
    table = found.sparkSession.createDataFrame([(r["pattern"], float(p)) for r, p in zip(counted, posterior)], "pattern string, posterior double")
    scored = found.join(F.broadcast(table), "pattern")  # at most MAX_PATTERNS rows
    return scored.drop("pattern").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
