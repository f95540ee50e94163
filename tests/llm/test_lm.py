import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm, packed
from tessera.llm.queries import op8_lm


def direct(rows, prior):
    """rows: (text, in target, in background); losses of each, without its own counts, in plain Python."""
    texts = [(t or "").encode().lower().split() for t, _, _ in rows]
    pairs = [list(zip([b"", *t], t)) for t in texts]
    size = len({w for t, (_, x, y) in zip(texts, rows) if x or y for w in t})
    out = []
    for k, own in enumerate(texts):
        losses = []
        for m in (1, 2):
            members = [j for j, r in enumerate(rows) if r[m] and j != k]
            ones, twos, seen = Counter(), Counter(), Counter()
            for j in members:
                ones.update(texts[j])
                twos.update(pairs[j])
                seen.update(h for h, _ in pairs[j])
            single = lambda w: (ones[w] + 1) / (sum(ones.values()) + size + 1)  # noqa: B023, E731
            losses.append(-np.mean([np.log((twos[h, w] + prior * single(w)) / (seen[h] + prior)) for h, w in pairs[k]]) if own else 0.0)
        out.append((len(own), *losses, losses[1] - losses[0]))
    return out


@pytest.mark.parametrize("chunk, entries", [(1 << 20, 1 << 20), (60, 7)])
def test_losses_match_direct_computation(spark, monkeypatch, chunk, entries):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "RANGE_ROWS", entries)
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("a b c dd E e F \u00e9\u00e9".split(), k=rng.randrange(14))), k % 3 == 0, True) for k in range(40)]
    rows += [(None, True, True), (" \n", False, True), ("a b unseen a", True, True), ("a b unseen a", True, True)]
    docs = spark.createDataFrame([(k % 30, *r) for k, r in enumerate(rows)], "doc_id long, text string, t boolean, b boolean")
    got = lm.score(docs, F.col("t"), F.col("b")).collect()
    want = [(k % 30, *r) for k, r in enumerate(direct(rows, lm.PRIOR))]
    as_list = lambda found: sorted((r[0], r[1], *(round(x, 6) for x in r[2:])) for r in found)
    assert np.allclose(as_list(got), as_list(want), atol=1e-5)


def test_nothing_is_left_out(spark, monkeypatch):
    """70,000 words that occur equally often all count: each text is scored by the other that has its words."""
    words = [f"w{k}" for k in range(70_000)]
    docs = spark.createDataFrame([(d, " ".join(words[d // 2 :: 7])) for d in range(14)] + [(99, "x0 x1 x2")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") < 2).collect()}
    assert all(got[d]["background_loss"] < got[99]["background_loss"] - 0.2 for d in range(14))
    assert got[0]["target_loss"] < got[2]["target_loss"]


def test_rows_of_no_corpus_are_scored_too(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "a b"), (None, "z")], "doc_id long, text string")
    got = lm.score(docs, F.lit(False), F.col("doc_id") == 2).orderBy("doc_id").collect()
    assert len(got) == 4 and got[1]["background_loss"] == pytest.approx(got[3]["background_loss"]) and got[1]["target_loss"] > 0


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, " ", 1.0), (2, "x " * 200_000, 1.0), (2, "x", 1.0)], "doc_id long, text string, `score` double")
    got = lm.score(docs.withColumnRenamed("score", "a b"), F.lit(True)).collect()
    assert sorted(r["n_words"] for r in got) == [0, 0, 1, 200_000] and all(r["score"] == 0 for r in got)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    assert [r["score"] for r in lm.score(docs.where("doc_id = 1"), F.lit(True)).collect()] == [0.0]


def test_query(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_lm(spark, sf).collect()
    by = {q: [r["score"] for r in rows if labels.get(r["doc_id"]) == q and r["n_words"] > 20] for q in (0, 1)}
    assert len(rows) == 200 and np.mean(by[1]) > np.mean(by[0])


def test_packed_integers():
    rng = np.random.default_rng(1)
    for bits in (0, 1, 9, 40, 64):
        x = rng.integers(0, 1 << bits, 50, dtype=np.uint64, endpoint=bits == 0) if bits < 64 else rng.integers(0, (1 << 64) - 1, 50, dtype=np.uint64)
        assert np.array_equal(packed.from_planes(packed.planes(x) + packed.planes(x // np.uint64(3)), 50, 2)[1], x // np.uint64(3))
    keys = np.unique(rng.integers(0, 1 << 50, 1000, dtype=np.uint64))
    for bits in (0, 3):
        back = [packed.unpacked_range(p, n, data, 1, 50, bits) for p, n, data in packed.packed_ranges(keys, [keys % np.uint64(5)], 50, bits)]
        assert np.array_equal(np.concatenate([b[0] for b in back]), keys) and np.array_equal(np.concatenate([b[1] for b in back]), keys % np.uint64(5))
    assert [packed.range_bits_for(n, 10, 4) for n in (0, 10, 11, 20, 21, 10**9)] == [0, 0, 1, 1, 2, 4]
