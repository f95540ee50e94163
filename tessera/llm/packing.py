"""Variable-capacity best-fit packing of documents into training sequences.

Where a piece goes depends on its length alone, so the plan is made from the
counts of lengths (at most as many as the largest capacity) and says which
ranks of each length go to which bins. Ranks come from distributed running
counts. Pieces are taken from the longest to the shortest: each goes to the
open bin with the least sufficient room; if none has room, bins of the
permitted size are opened that costs least per word they are expected to hold,
given the pieces that are left. In the end every bin gets the smallest
permitted size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, picked
from .mixing import word_count
from .ranks import hash_key, running_total, span_of, spans_for

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its words.
BIN_COST = 16
#: Lengths are at most this, which bounds the plan: a run of bins takes a length only if it has room for it, and
#: keeps less than half of that room, so it is met at most log2(capacity) times, and a length makes three runs at most.
MAX_CAPACITY = 1 << 16


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` with ranks from ``rank`` on, ``n`` of them: ``per_bin`` to each bin from ``bin`` on, the first at ``offset``."""

    length: int
    rank: int
    n: int
    per_bin: int
    bin: int
    offset: int


class _Supply:
    """Counts of lengths that bins may still hope for."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.lengths = sorted(x for x, n in counts.items() if n > 0)

    def fill(self, length: int, capacity: int) -> tuple[int, dict[int, int]]:
        """What a bin of ``capacity`` would hold that starts with ``length``: words, and how often each length."""
        used, room = {}, capacity
        at = bisect_left(self.lengths, length + 1) - 1
        while at >= 0 and room > 0:
            x = self.lengths[at]
            if x > room:
                at = bisect_left(self.lengths, room + 1) - 1
                continue
            m = min(self.left[x], room // x)
            if m:
                used[x] = m
                room -= m * x
            at -= 1
        return capacity - room, used

    def take(self, used: dict[int, int], times: int) -> None:
        for x, m in used.items():
            self.left[x] -= m * times
            if self.left[x] <= 0:
                self.drop(x)

    def drop(self, length: int) -> None:
        at = bisect_left(self.lengths, length)
        if at < len(self.lengths) and self.lengths[at] == length:
            del self.lengths[at]


def make_plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, bin_cost: float = BIN_COST) -> tuple[list[Placement], list[tuple[int, int, int]]]:
    """Placements, and runs of equal bins as (first bin, number, words in each)."""
    sizes = sorted(capacities)
    supply = _Supply(counts)
    room: dict[int, list[tuple[int, int, int]]] = {}  # by room left: runs (first bin, number, words in each)
    rooms: list[int] = []
    closed: list[tuple[int, int, int]] = []
    out: list[Placement] = []
    bins = 0

    def put(left: int, run: tuple[int, int, int]) -> None:
        if not run[1]:
            return
        if not left:
            closed.append(run)
            return
        if left not in room:
            insort(rooms, left)
            room[left] = []
        room[left].append(run)

    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                best = None
                for size in sizes:
                    if size >= length:
                        words, used = supply.fill(length, size)
                        words = max(words, length)
                        cost = (size + bin_cost) / words
                        if best is None or cost < best[0]:
                            best = (cost, size, used)
                _, size, used = best
                per_bin = max(1, used.get(length, 1))
                times = max(1, min([-(-todo // per_bin), *(supply.left[x] // m for x, m in used.items())]))
                supply.take(used, times)
                put(size, (bins, times, 0))
                bins += times
                continue
            left = rooms[at]
            first, n, words = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
            per_bin = left // length
            full = min(n, todo // per_bin)
            if full:
                out.append(Placement(length, rank, full * per_bin, per_bin, first, words))
                put(left - per_bin * length, (first, full, words + per_bin * length))
                rank, todo = rank + full * per_bin, todo - full * per_bin
            if full < n and todo:  # fewer pieces are left than the next bin has room for
                out.append(Placement(length, rank, todo, per_bin, first + full, words))
                put(left - todo * length, (first + full, 1, words + todo * length))
                put(left, (first + full + 1, n - full - 1, words))
                todo = 0
            else:
                put(left, (first + full, n - full, words))
        supply.drop(length)
    for runs in room.values():
        closed.extend(runs)
    return out, sorted(closed)


def sized(placements: list[Placement], runs: list[tuple[int, int, int]], capacities: Sequence[int]) -> list[tuple]:
    """Placements cut where the bins' final sizes change: (length, rank, n, per_bin, bin, offset, capacity)."""
    sizes = sorted(capacities)
    starts, caps = [], []
    for first, _, words in runs:
        cap = sizes[bisect_left(sizes, words)] if words else 0
        if not caps or caps[-1] != cap:
            starts.append(first)
            caps.append(cap)
    out = []
    for p in placements:
        done, n_bins = 0, -(-p.n // p.per_bin)
        while done < n_bins:
            k = bisect_left(starts, p.bin + done + 1) - 1
            until = starts[k + 1] - p.bin if k + 1 < len(starts) else n_bins
            until = min(until, n_bins)
            lo, hi = done * p.per_bin, min(p.n, until * p.per_bin)
            out.append((p.length, p.rank + lo, hi - lo, p.per_bin, p.bin + done, p.offset, caps[k]))
            done = until
    return out


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, bin_cost: float = BIN_COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``id_col``, piece, start, length, bin_id, capacity, offset (all in words).

    A document longer than the largest capacity is cut into pieces of that
    capacity and a rest; other documents are one piece. Null texts and texts
    without words have one piece of length 0 without a bin. Repeated rows are
    packed each. Only counts of lengths come to the driver, and only the plan,
    which the largest capacity bounds, is broadcast. Other columns aren't read.
    """
    most = max(capacities)
    if min(capacities) < 1 or most > MAX_CAPACITY:
        raise ValueError(f"capacities must be from 1 to {MAX_CAPACITY}")
    rows = materialize(picked(docs, __id=id_col, __text=text_col).select("__id", word_count(F.col("__text")).alias("__size"), hash_key(F.col("__id"), F.col("__text")).alias("__key")))
    last = F.greatest(F.floor((F.col("__size") - 1) / most), F.lit(0)).cast("int")
    pieces = rows.select("__id", "__key", "__size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.withColumn("length", F.least(F.col("__size") - F.col("piece") * most, F.lit(most)).cast("int"))
    lengths = pieces.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = {r["length"]: r["n"] for r in lengths}
    spark = docs.sparkSession
    plan = spark.createDataFrame(sized(*make_plan(counts, capacities, bin_cost), capacities), "length int, __first long, __n long, __per long, __bin long, offset int, capacity int")
    spans = spark.createDataFrame([(x, spans_for(n)) for x, n in counts.items()], "length int, __spans int")
    placed = pieces.where("length > 0").join(F.broadcast(spans), "length")  # at most MAX_CAPACITY rows
    placed = placed.select("__id", "__key", "piece", "length", span_of(F.col("__key"), F.col("__spans")).alias("__span"), F.lit(1).cast("long").alias("__one"))
    ranked = running_total(placed, placed, ["length"], "__span", ["__key", "piece"], "__one", "__rank")
    nth = F.col("__rank") - F.col("__first")
    here = (ranked["length"] == plan["length"]) & nth.between(0, F.col("__n") - 1)
    found = ranked.join(F.broadcast(plan), here).select(
        "__id", "piece", (F.col("piece").cast("long") * most).alias("start"), ranked["length"],
        (F.col("__bin") + F.floor(nth / F.col("__per"))).cast("long").alias("bin_id"), "capacity",
        (F.col("offset") + nth % F.col("__per") * ranked["length"]).cast("int").alias("offset"),
    )
    nothing = F.lit(None).cast("int")
    empty = pieces.where("length = 0").select("__id", "piece", F.lit(0).cast("long").alias("start"), "length", nothing.cast("long").alias("bin_id"), nothing.alias("capacity"), nothing.alias("offset"))
    return found.union(empty).withColumnRenamed("__id", id_col)
