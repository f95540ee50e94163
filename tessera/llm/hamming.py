"""Links between 64-bit fingerprints that differ in at most three bits.

Blocks. Both schemes turn a fingerprint into keys such that two fingerprints
within the radius share one at least:

* ``ring_keys`` follows the pigeonring principle. The 64 bits form a ring of 7
  segments. If at most 3 bits differ, then from some segment on, every chain
  of l consecutive segments has at most floor(3 l / 7) differences: 0 for one
  or two segments, 1 for three or four, 2 for five or six. So the chain's first
  two segments are equal, and its third or its fourth, which makes keys of
  27 or 28 bits from 14 places.
* ``pair_keys`` is plain pigeonholing: of 5 segments two at least are equal.

Within a block candidates must pass the chain's other budgets before the whole
distance is counted (``ring_masks``).

Large blocks. What leaves a block are links that connect its linked members,
fewer than it has members, not all pairs. Members near the block's centre are
linked to it at once, and only the others are compared with all. A block of
more than BLOCK members is cut into parts, and every two parts meet in a task
of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RADIUS = 3
BLOCK = 4096
RING = 7
PIGEON = 5


def segments(n: int) -> list[tuple[int, int]]:
    """Offset and width of ``n`` near-equal segments of 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _segment(fp: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def _key(tag: int, parts: list[Column]) -> Column:
    """The parts side by side (each has 13 bits at most) under the tag in the highest bits."""
    out = F.lit(tag << 52)
    for k, p in enumerate(parts):
        out = out.bitwiseOR(F.shiftleft(p, 13 * k))
    return out


def ring_keys(fp: Column) -> list[Column]:
    """14 keys; the tag is twice the chain's first segment, plus 1 if the fourth is the equal one."""
    seg = [_segment(fp, x) for x in segments(RING)]
    return [_key(2 * i + late, [seg[i], seg[(i + 1) % RING], seg[(i + 2 + late) % RING]]) for i in range(RING) for late in (0, 1)]


def pair_keys(fp: Column) -> list[Column]:
    seg = [_segment(fp, x) for x in segments(PIGEON)]
    return [_key(PIGEON * i + j, [seg[i], seg[j]]) for i in range(PIGEON) for j in range(i + 1, PIGEON)]


def ring_masks(tag: int) -> list[tuple[np.uint64, int]]:
    """The bits of the chains of 3, 4 ... 6 segments that start where ``tag`` says, each with its budget."""
    at, out, mask = segments(RING), [], 0
    for n in range(1, RING):
        lo, width = at[(tag // 2 + n - 1) % RING]
        mask |= ((1 << width) - 1) << lo
        if n * RADIUS // RING:
            out.append((np.uint64(mask), n * RADIUS // RING))
    return out


_RING_MASKS = [ring_masks(t) for t in range(2 * RING)]
_MASKS = np.array([[mask for mask, _ in m] for m in _RING_MASKS])
_BUDGETS = [budget for _, budget in _RING_MASKS[0]]


def near_pairs(keys: np.ndarray, x: np.ndarray, ring: bool) -> np.ndarray:
    """Which pairs with the differing bits ``x``, met under ``keys``, are linked; as ``near``, for many blocks at once."""
    if not ring:
        return np.bitwise_count(x) <= RADIUS
    ok = np.ones(len(x), bool)
    tags = (keys >> 52) & 63
    for m, budget in enumerate(_BUDGETS):
        ok &= np.bitwise_count(x & _MASKS[tags, m]) <= budget
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(x[at]) <= RADIUS
    return ok


def near(key: int, fp: np.uint64, others: np.ndarray, ring: bool) -> np.ndarray:
    """Which of ``others`` are linked to ``fp``; on a ring those that fail a chain's budget aren't counted in full."""
    x = others ^ fp
    if not ring:
        return np.bitwise_count(x) <= RADIUS
    ok = np.ones(len(x), bool)
    for mask, budget in _RING_MASKS[(key >> 52) & 63]:
        ok &= np.bitwise_count(x & mask) <= budget
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(x[at]) <= RADIUS
    return ok


def spanning_links(fps: np.ndarray, near_to: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join members to the groups in which all links would join them; fewer than members.

    ``near_to(i, js)`` says which of the members ``js`` are linked to member ``i``.
    """
    n = len(fps)
    if n < 2:
        return []
    everyone = np.arange(n)
    centre = 0
    if n > 2:
        bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1)
        middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n).view(fps.dtype)[0]
        centre = int(np.argmin(np.bitwise_count(fps ^ middle)))
    group = everyone.copy()
    first = near_to(centre, everyone)
    first[centre] = True
    group[first] = centre
    links = [(centre, int(j)) for j in np.flatnonzero(first) if j != centre]
    for r in np.flatnonzero(~first).tolist():
        js = np.flatnonzero(near_to(r, everyone) & (group != group[r]))
        _, at = np.unique(group[js], return_index=True)
        for j in js[at].tolist():
            links.append((r, j))
            group[group == group[j]] = group[r]
    return links


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(c) if pa.types.is_integer(c.type) else np.array(c.to_pylist(), object) for c in batch.columns]


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of equal values of the first column in sorted batches: the offset in the run, and the columns of up to ``most`` rows.

    A run of more rows comes in several pieces, of which all but the last have
    ``most`` rows; after the last of them comes a piece without rows.
    """
    held: list[np.ndarray] | None = None
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _columns(batch)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        starts, ends = _runs(cols[0])
        for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist())):
            last = k == len(starts) - 1
            while hi - lo > most:
                yield done, [c[lo : lo + most] for c in cols]
                lo, done = lo + most, done + most
            if last:
                held = [c[lo:hi] for c in cols]
            else:
                yield done, [c[lo:hi] for c in cols]
                done = 0
    if held is not None:
        yield done, held


_OUT = "a long, b long, part int"
_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32())])


def _batches(rows: Iterator[list[np.ndarray]], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    n = 0
    for r in rows:
        held.append(r)
        n += len(r[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=_ARROW)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=_ARROW)


def _links_of(key: int, fps: np.ndarray, ring: bool) -> list[np.ndarray] | None:
    bits = fps.view(np.uint64)
    links = spanning_links(bits, lambda i, js: near(key, bits[i], bits[js], ring))
    if not links:
        return None
    at = np.array(links)
    return [fps[at[:, 0]], fps[at[:, 1]], np.full(len(at), -1, np.int32)]


#: Blocks of so few members are compared all at once, pair by pair.
_FEW = 4


def _few(keys: np.ndarray, fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ring: bool) -> Iterator[list[np.ndarray]]:
    """Links of the blocks that start at ``starts`` and have at most _FEW members."""
    bits = fps.view(np.uint64)
    for i in range(_FEW):
        for j in range(i + 1, _FEW):
            at = starts[sizes > j]
            hit = at[near_pairs(keys[at], bits[at + i] ^ bits[at + j], ring)]
            if len(hit):
                yield [fps[hit + i], fps[hit + j], np.full(len(hit), -1, np.int32)]


def _small_blocks(ring: bool):
    """Links of blocks of at most BLOCK members; the members of larger ones as (key, fingerprint, part)."""

    def one(offset: int, keys: np.ndarray, fps: np.ndarray) -> list[np.ndarray] | None:
        if offset or len(keys) == BLOCK:
            return [keys, fps, np.full(len(keys), offset // BLOCK, np.int32)]
        return _links_of(int(keys[0]), fps, ring) if len(keys) > 1 else None

    def rows(batches):
        held, done = [np.zeros(0, np.int64)] * 2, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = (np.concatenate(x) for x in zip(held, _columns(batch)))
            starts, ends = _runs(keys)
            sizes = ends - starts
            few = sizes <= _FEW
            few[-1] = False  # may go on in the next batch
            few[0] &= not done
            yield from _few(keys, fps, starts[few], sizes[few], ring)
            for k in np.flatnonzero(~few).tolist():
                lo, hi = int(starts[k]), int(ends[k])
                while hi - lo > BLOCK:
                    yield one(done, keys[lo : lo + BLOCK], fps[lo : lo + BLOCK])
                    lo, done = lo + BLOCK, done + BLOCK
                if k == len(starts) - 1:
                    held = [keys[lo:hi], fps[lo:hi]]
                else:
                    if found := one(done, keys[lo:hi], fps[lo:hi]):
                        yield found
                    done = 0
        if len(held[0]) and (found := one(done, *held)):
            yield found

    return lambda batches: _batches(rows(batches))


def _part_pairs(ring: bool):
    def rows(batches):
        for _, (_, keys, fps) in grouped(batches, 4 * BLOCK):
            if len(keys) > 1 and (found := _links_of(int(keys[0]), fps, ring)):
                yield found

    return lambda batches: _batches(rows(batches))


def keyed_blocks(units: DataFrame, fp: str, ring: bool) -> DataFrame:
    """(key, fp) for the distinct fingerprints of ``units``, dealt and sorted by key.

    Only the fingerprint and the number of the key are shuffled.
    """
    col = F.col("fp")
    keys = ring_keys(col) if ring else pair_keys(col)
    key = F.get(F.array(*keys), F.col("k").cast("int"))
    distinct = units.where(F.col(fp).isNotNull()).select(F.col(fp).cast("long").alias("fp")).distinct()
    each = distinct.select("fp", F.explode(F.array(*(F.lit(k).cast("byte") for k in range(len(keys))))).alias("k"))
    return each.repartition(key).select(key.alias("key"), "fp").sortWithinPartitions("key", "fp")


def hamming_links(units: DataFrame, fp: str = "fp", ring: bool = True) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``units`` that connect all within RADIUS of each other.

    Two fingerprints end up in one connected component of the result exactly if
    a chain of links of at most RADIUS differing bits connects them. Nulls are
    not compared.
    """
    found = materialize(keyed_blocks(units, fp, ring).mapInArrow(_small_blocks(ring), _OUT))
    large = found.where("part >= 0").select(F.col("a").alias("key"), F.col("b").alias("fp"), "part")
    parts = large.groupBy("key").agg((F.max("part") + 1).alias("n"))
    # a block of exactly BLOCK members is a single part, which meets itself
    other = F.explode(F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda x: x != F.col("part"))))
    spread = large.join(parts, "key").select("key", "fp", "part", other.alias("other"))
    spread = spread.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("task"), "key", "fp")
    more = spread.repartition("task").sortWithinPartitions("task", "key", "fp").mapInArrow(_part_pairs(ring), _OUT)
    return found.where("part < 0").select("a", "b").union(more.select("a", "b"))
