import random

import numpy as np
import pytest
from brute import simhash, smallest_reachable

from tessera.llm import hamming
from tessera.llm.components import components
from tessera.llm.queries import op6_simhash
from tessera.llm.simhash import fingerprint, near_duplicates, word_blocks


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = ["", " \n", "One", "One TWO", "a b c", "Äb É b\x0bc d", *(" ".join(rng.choices("ab cde FG hij".split(), k=k)) for k in (3, 50, 700))]
    assert [fingerprint(t.encode()) for t in texts] == [simhash(t) for t in texts]


def test_word_blocks_cut_between_words():
    data = " ".join(f"w{i}" for i in range(1000)).encode()
    assert [w for block in word_blocks(data, 64) for w in block] == data.split()


def test_query_matches_brute_force(spark, sf):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op6_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [simhash(r["text"]) for r in docs]
    least = smallest_reachable(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert got == {r["doc_id"]: (f"{fp:016x}", docs[k]["doc_id"]) for r, fp, k in zip(docs, fps, least)}


@pytest.mark.parametrize("ring", [True, False])
@pytest.mark.parametrize("block", [hamming.BLOCK, 8])
def test_links_connect_exactly_the_near(spark, ring, block, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", block)
    rng = random.Random(5)
    bases = [rng.getrandbits(64) for _ in range(60)]
    fps = {b for b in bases}
    for b in bases[:30]:
        for _ in range(3):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    for _ in range(120):  # one dense group
        fps.add(bases[0] ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(signed(f) for f in fps)
    units = spark.createDataFrame([(f,) for f in [*fps, fps[0], None]], "fp long")
    links = hamming.hamming_links(units, ring=ring)
    assert all((a ^ b).bit_count() <= 3 if (a ^ b) >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links.collect())
    roots = {r["id"]: r["root"] for r in components(links).collect()}
    least = smallest_reachable(len(fps), lambda i, j: ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3)
    assert {f: roots.get(f, f) for f in fps} == {f: fps[k] for f, k in zip(fps, least)}


def test_spanning_links_are_fewer_than_members():
    fps = np.arange(8, dtype=np.uint64)
    links = hamming.spanning_links(fps, lambda i, js: np.bitwise_count(fps[js] ^ fps[i]) <= 3)
    assert len(links) == 7


def test_components_of_chain_star_and_none(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 200), (None, 3), (41, 40)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(42)} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(spark):
    rows = [(5, None, "x"), (6, "", "x"), (None, "   ", "x"), (3, "same words here", "x"), (3, "same words here", "x"), (9, "w " * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(near_duplicates(docs).collect(), key=str)
    assert len(got) == 6
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (6, 5), (None, 5), (3, 3), (9, 9)}
    assert near_duplicates(docs.limit(0)).count() == 0
