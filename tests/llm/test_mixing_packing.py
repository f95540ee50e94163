import hashlib
import random
from collections import defaultdict

import pytest
from brute import WORD
from pyspark.sql import functions as F

from tessera.llm import packing, ranks
from tessera.llm.mixing import first_words, mix, mixed_documents
from tessera.llm.queries import op1_mixing, op7_packing


def targets(sizes):
    """Iterated sharing; sizes: by source, in order."""
    weights = dict(zip(sizes, [5.0, 2.0, 1.0] * len(sizes)))
    done, share = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in done]
        left = share - sum(done.values())
        parts = {s: weights[s] * left / sum(weights[x] for x in rest) for s in rest}
        over = {s: 2.0 * sizes[s] for s in rest if parts[s] >= 2 * sizes[s]}
        if not over:
            return done | parts
        done |= over


def brute_mix(rows):
    """rows: (id, text, source) -> {(id, text, source): taken}"""
    by = defaultdict(list)
    for i, t, s in rows:
        size = len(WORD.findall(t or ""))
        null = "\x00"
        key = int(hashlib.md5(f"{null if i is None else i}\x01{null if t is None else t}".encode()).hexdigest()[:15], 16)
        by[s].append((key, size, (i, t, s)))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(x[1] for x in by[s]) for s in order}
    goal = targets(sizes) if sum(sizes.values()) else dict.fromkeys(order, 0.0)
    taken = {}
    for s in order:
        budget = int(goal[s])
        whole, left = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for _, size, row in sorted(by[s], key=lambda x: x[:2]):
            part = max(0, min(size, left))
            taken[row] = whole * size + part
            left -= part
    return taken, sizes, goal


@pytest.mark.parametrize("span_rows", [20_000, 3])
def test_mix_matches_brute_force(spark, monkeypatch, span_rows):
    monkeypatch.setattr(ranks, "SPAN_ROWS", span_rows)
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randrange(40))), rng.choice(["a", "a", "a", "b", "c", "É", None])) for i in range(120)]
    rows += [(200, None, "a"), (201, "", "z"), (None, "no id here", "b")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    want, sizes, goal = brute_mix(rows)
    got = mix(docs).collect()
    assert {(r["doc_id"], r["text"], r["source"]): r["__taken"] for r in got} == want
    assert all(r["__target"] == pytest.approx(goal[r["source"]]) and r["__source_size"] == sizes[r["source"]] for r in got)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"] or ""))
    assert {k: v for k, v in words.items() if v} == {(i, s): v for (i, t, s), v in want.items() if v}


def test_mix_edge_cases(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert mixed_documents(spark.createDataFrame([], schema)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], schema)
    assert [r["__taken"] for r in mix(empty).collect()] == [0, 0]
    same = spark.createDataFrame([(1, "a b", "s")] * 4, schema)
    assert sum(r["__taken"] for r in mix(same).collect()) == 12
    texts = [(" a  b\tc ", 2, " a  b"), ("a b", 2, "a b"), ("a b ", 1, "a"), ("\n\na", 1, "\n\na"), ("a\u00a0b c", 1, "a\u00a0b"), ("x " * 60_000, 50_000, "x " * 49_999 + "x")]
    got = spark.createDataFrame(texts, "t string, n int, want string").select(first_words(F.col("t"), F.col("n")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_any_column_names(spark):
    names = ["doc_id", "text", "source", "a b", "x.y", "__row", "__doc", "__size", "__taken", "__target", "__key", "size"]
    docs = spark.createDataFrame([(k, "a b c", "s", *range(9)) for k in range(6)], names)
    assert mixed_documents(docs).columns == names and mixed_documents(docs).count() == 9
    assert set(mix(docs).columns) == {*names, "__source_size"} and sum(r["__taken"] for r in mix(docs).collect()) == 27


def test_mix_query_keeps_every_row(spark, sf):
    rows = op1_mixing(spark, sf).collect()
    assert len({r["doc_id"] for r in rows}) == 200 and all(r["taken"] <= 2 * r["size"] for r in rows)


def one_by_one(lengths, capacities, bin_cost):
    """Bins as lists of lengths, pieces placed singly by the same rules."""
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    supply, bins = packing._Supply(counts), []
    for length in sorted(counts, reverse=True):
        todo, opened = counts[length], 0
        while todo:
            fits = [(cap - sum(b), k) for k, (cap, b) in enumerate(bins) if cap - sum(b) >= length]
            if fits:
                bins[min(fits)[1]][1].append(length)
                todo -= 1
                continue
            best = None
            for cap in sorted(c for c in capacities if c >= length):
                words, used = supply.fill(length, cap)
                cost = (cap + bin_cost) / max(words, length)
                if best is None or cost < best[0]:
                    best = (cost, cap, used)
            per = max(1, best[2].get(length, 1))
            times = max(1, min([-(-todo // per), *(supply.left[x] // m for x, m in best[2].items())]))
            supply.take(best[2], times)
            bins += [(best[1], []) for _ in range(times)]
        supply.drop(length)
    return bins


def contents(counts, capacities, bin_cost=16):
    plan, runs = packing.make_plan(counts, capacities, bin_cost)
    bins = defaultdict(list)
    for p in plan:
        for k in range(p.n):
            bins[p.bin + k // p.per_bin].append((p.offset + k % p.per_bin * p.length, p.length))
    return plan, runs, bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_valid_and_as_tight_as_one_by_one(seed):
    rng = random.Random(seed)
    capacities = sorted(rng.sample(range(8, 64), rng.randint(1, 4)))
    lengths = [min(capacities[-1], int(rng.paretovariate(1))) for _ in range(rng.randrange(1, 300))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan, runs, bins = contents(counts, capacities)
    ranks_of = defaultdict(list)
    for p in plan:
        ranks_of[p.length] += range(p.rank, p.rank + p.n)
    assert {x: sorted(r) for x, r in ranks_of.items()} == {x: list(range(n)) for x, n in counts.items()}
    sums = {}
    for b, items in bins.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacities[-1]
        sums[b] = at
    assert {b: w for first, n, w in runs for b in range(first, first + n) if w} == sums
    size = lambda w: next(c for c in capacities if c >= w)
    single = [sum(b) for _, b in one_by_one(lengths, capacities, 16) if b]
    assert sum(map(size, sums.values())) <= 1.05 * sum(map(size, single)) + capacities[-1]
    for length, rank, n, per, first, offset, cap in packing.sized(plan, runs, capacities):
        assert all(size(sums[first + k // per]) == cap for k in range(n))


def test_pack_places_every_word(spark, sf, monkeypatch):
    monkeypatch.setattr(ranks, "SPAN_ROWS", 7)
    docs = {r["doc_id"]: len(WORD.findall(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_packing(spark, sf).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_bin[r["bin_id"], r["capacity"]].append((r["offset"], r["length"]))
    for i, pieces in by_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == docs[i]
    assert len({b for b, _ in by_bin}) == len(by_bin) and by_doc.keys() == docs.keys()
    filled = 0
    for (_, capacity), items in by_bin.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert capacity == next(c for c in packing.CAPACITIES if c >= at)
        filled += capacity
    assert sum(docs.values()) / filled > 0.98


def test_pack_edge_cases(spark):
    schema = "doc_id long, text string, length int, piece string"
    rows = [(1, None, 0, "a"), (2, " ", 0, "b"), (None, "a b c", 0, "c"), (3, "w " * 10_000, 0, "d"), (4, "a b c", 0, "e"), (4, "a b c", 0, "e")]
    got = packing.pack(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == sorted([("1", 0), ("2", 0), ("None", 3), ("3", 4096), ("3", 4096), ("3", 1808), ("4", 3), ("4", 3)])
    assert all((r["bin_id"] is None) == (r["length"] == 0) for r in got)
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], schema), capacities=(0,))
