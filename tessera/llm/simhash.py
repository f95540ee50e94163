"""SimHash near-duplicates of whole documents over word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, join_with_hot, kind_of, map_batches, materialize, picked, struct_of
from .components import components
from .hamming import hamming_links

#: A component or fingerprint is hot if it has more than this share of the rows; so there are 1 / HOT of them at most.
HOT = 1 / 1000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists, so that a very long text isn't held as words at once."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = _SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def _tally(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    h = np.array(hashes, dtype="<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text, A-Z lower-cased; no words: 0.

    Fewer words than ``shingle`` make one shingle. A bit is 1 if it is set in
    more than half the shingles' XXH64.
    """
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data.lower()):
        words = tail + words
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
            hashes = list(map(xxhash.xxh64_intdigest, grams, repeat(seed)))
            counts += _tally(hashes)
            n += len(hashes)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not n:
        if not tail:
            return 0
        counts, n = _tally([xxhash.xxh64_intdigest(b" ".join(tail), seed)]), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """__id, __hash (of the text) and the fingerprint ``fp`` (as signed long) of every input row; null counts as empty."""
    rows = picked(docs, __id=id_col, __text=text_col).select("__id", F.xxhash64("__text").alias("__hash"), F.col("__text").cast("binary"))

    def run(batch):
        fps = np.array([fingerprint(x or b"", shingle) for x in batch.column(2).to_pylist()], np.uint64)
        return {"__id": batch.column(0), "__hash": batch.column(1), "fp": fps.view(np.int64)}

    return map_batches(rows, struct_of(__id=kind_of(rows, "__id"), __hash="long", fp="long"), run)


def _grouped(fps: DataFrame, least: Column) -> tuple[DataFrame, int]:
    """Every distinct fingerprint with n, its number of rows, and ``first``: the smallest ``least`` of its component; and the number of rows.

    Components of many fingerprints are broadcast, as they are few.
    """
    units = materialize(fps.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")))
    roots = components(hamming_links(units))
    joined = materialize(units.join(roots, units["fp"] == roots["id"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    sums = materialize(joined.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members")))
    rows, kinds = joined.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return join_with_hot(joined.select("fp", "n", "root"), sums, "root", "members", kinds * HOT).select("fp", "n", "first"), rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col``, fp and component_id: the smallest id that links of at most three differing bits reach.

    One row per input row. Ids may be null or repeat: rows are grouped by
    fingerprint, and a component's id is its smallest that isn't null. An empty
    table gives an empty result. Texts without words share fingerprint 0. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle).select("__id", "fp"))
    groups, rows = _grouped(fps, F.col("__id"))
    found = join_with_hot(fps, materialize(groups), "fp", "n", rows * HOT)
    return found.select("__id", "fp", F.col("first").alias("component_id")).withColumnRenamed("__id", id_col)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the smallest by id (null last), then by a hash of the text.

    Of rows with equal id and text any one stays. What goes is settled on rows
    without texts; columns may have any names.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    place = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")
    groups, _ = _grouped(fps, place)
    kept = groups.select("first.*").select(F.col("__id").alias("kept_id"), F.col("__hash").alias("kept_hash")).distinct()
    each = materialize(fps.groupBy("__id", "__hash").agg(F.count("*").alias("n")))
    same = F.col("__id").eqNullSafe(F.col("kept_id")) & (F.col("__hash") == F.col("kept_hash"))
    gone = materialize(each.join(kept, same, "left_anti").select("__id", "__hash"))
    repeated = materialize(each.join(kept, same, "left_semi").where("n > 1").select("__id", "__hash"))
    moved, names = by_position(docs)
    at, key = F.col(f"c{names.index(id_col)}"), F.xxhash64(F.col(f"c{names.index(text_col)}"))

    def has(rows: DataFrame) -> tuple[DataFrame, Column]:
        return rows, at.eqNullSafe(F.col("__id")) & (key == F.col("__hash"))

    left = moved.join(*has(gone), "left_anti")
    if not repeated.isEmpty():
        some = left.join(*has(repeated), "left_semi").withColumn("__hash", key).dropDuplicates([f"c{names.index(id_col)}", "__hash"]).drop("__hash")
        left = left.join(*has(repeated), "left_anti").union(some)
    return left.toDF(*names)
