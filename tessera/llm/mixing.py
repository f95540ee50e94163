"""Mixing sources to target weights.

Every document gets a hash-random key; within its source documents are taken
in the order of the keys until the source's word budget is used up, in several
epochs if the budget exceeds the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, by_position, materialize
from .ranks import hash_key, span_of, spans_for

WEIGHTS = (5, 2, 1)
#: The mix has this share of all words, and of no source more than CAP times its words.
SHARE = 1.5
CAP = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``target`` to a table of sources (__source, __no_source, source_size).

    Sources by code point, null last, have the ``weights`` in turn. A source
    whose part exceeds ``cap`` times its size gets that, and the excess goes to
    the others by weight until none is above: with the sources sorted by
    cap / weight, those at their cap are the first ones, and the rest share
    what these leave.
    """
    n = len(weights)
    by_name = Window.orderBy("__no_source", "__source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(n))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)
    out = sizes.withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("__cap") / F.col("__weight"), "__no_source", "__source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    out = out.withColumn("__left", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    out = out.withColumn("__level", F.col("__left") / F.sum("__weight").over(rest))
    out = out.withColumn("__open", F.col("__level") * F.col("__weight") < F.col("__cap"))
    level = F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("__weight"), "__no_source", "__source", F.col("__level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("source_size") > 0, F.coalesce(F.least(level * F.col("__weight"), F.col("__cap")), F.col("__cap"))).otherwise(0.0)
    return out.withColumn("target", target).select("__source", "__no_source", "source_size", "target")


def _cuts(narrow: DataFrame, targets: DataFrame, spans: int) -> DataFrame:
    """Of each source: source_size, target, epochs, and the key that the last epoch ends in.

    Of the rows with the key ``cut`` (``copies`` rows), that epoch takes the
    first ``cut_words`` words, of rows with lower keys all. Totals of spans of
    keys say in which span that is; only its rows are put in order.
    """
    groups = ["__source", "__no_source"]
    span = span_of(F.col("__key"), spans).alias("__span")
    totals = narrow.groupBy(*groups, span).agg(F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy(*groups).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long"))
    plan = targets.withColumn("epochs", epochs).withColumn("__rest", budget - F.col("epochs") * F.col("source_size"))
    here = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).join(plan.select(*groups, "__rest"), groups)
    here = here.where((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__sum")))
    rows = narrow.select("*", span).join(here, [*groups, "__span"]).groupBy(*groups, "__rest", "__before", "__key").agg(F.sum("__size").alias("__sum"), F.count("*").alias("copies"))
    inside = Window.partitionBy(*groups).orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.col("__before") + F.sum("__sum").over(inside)).where((F.col("__upto") > F.col("__rest")) & (F.col("__upto") - F.col("__sum") <= F.col("__rest")) & (F.col("__sum") > 0))
    cut = rows.select(*groups, F.col("__key").alias("cut"), "copies", (F.col("__rest") - F.col("__upto") + F.col("__sum")).alias("cut_words"))
    return plan.join(cut, groups, "left").select(*groups, "source_size", "target", "epochs", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("cut_words", F.lit(0)).alias("cut_words"))


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, cap: float, id_col: str, text_col: str, source_col: str, carry: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Columns c0, c1 ... that stand for ``carry``, with __size, __source_size, __target and __taken; and those columns' names.

    The order of the documents is settled on rows without texts. What a source
    takes is one row, which goes to the documents; texts are not shuffled.
    """
    moved, names = by_position(docs)
    at = {c: F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col, *carry)}
    own = [f"c{names.index(c)}" for c in carry]
    rows = moved.select(
        *own,
        F.coalesce(at[source_col].cast("string"), F.lit("")).alias("__source"),
        at[source_col].isNull().alias("__no_source"),
        word_count(at[text_col]).alias("__size"),
        hash_key(at[id_col], at[text_col]).alias("__key"),
    )
    if text_col not in carry:  # nothing long is carried, so that texts are read once
        rows = materialize(rows)
    narrow = materialize(rows.select("__source", "__no_source", "__size", "__key")) if text_col in carry else rows
    sources = narrow.groupBy("__source", "__no_source").agg(F.sum("__size").alias("source_size"))
    targets = materialize(source_targets(sources, weights, share, cap))
    plan = materialize(_cuts(narrow, targets, spans_for(narrow.count())))
    joined = rows.join(plan, ["__source", "__no_source"])
    if plan.where("copies > 1").isEmpty():
        last = F.when(F.col("__key") < F.col("cut"), F.col("__size")).when(F.col("__key") == F.col("cut"), F.least("cut_words", "__size")).otherwise(0)
        placed = joined.withColumn("__last", last)
    else:  # equal rows share what is left for their key, one after the other
        one_by_one = F.row_number().over(Window.partitionBy("__source", "__no_source", "__key").orderBy("__size")) - 1
        tied = joined.where((F.col("__key") == F.col("cut"))).withColumn("__last", F.least(F.greatest(F.col("cut_words") - one_by_one * F.col("__size"), F.lit(0)), F.col("__size")))
        placed = joined.where(F.col("__key") != F.col("cut")).withColumn("__last", F.when(F.col("__key") < F.col("cut"), F.col("__size")).otherwise(0)).unionByName(tied)
    taken = (F.col("epochs") * F.col("__size") + F.col("__last")).cast("long")
    out = placed.select(*own, "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), taken.alias("__taken"))
    return out, list(carry)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all of them, unless given) with __size, __source_size, __target and __taken, which replace columns of these names.

    ``__taken`` counts the words that the mix takes of the row, repeats
    included: whole epochs, and in the last one all rows before the budget's
    end; of the row that the end falls into, the words before it. A source's
    taken words add up to its target without the fraction. Rows with equal id,
    text and source are ordered at will among themselves. Null sources are a
    source of their own; null texts have no words. Columns may have any names.
    An empty table gives an empty result.
    """
    added = ["__size", "__source_size", "__target", "__taken"]
    found, names = _mixed(docs, weights, share, cap, id_col, text_col, source_col, [c for c in (docs.columns if carry is None else carry) if c not in added])
    return found.toDF(*names, *added)


_GAP = r"[\x20\x09-\x0D]+"


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word; all of it if it has no more words."""
    bare = F.regexp_replace(text, f"^{_GAP}", "")
    parts = F.split(bare, _GAP, n + 1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(F.element_at(parts, -1)))
    return F.when(F.size(parts) <= n, text).otherwise(F.regexp_replace(head, f"{_GAP}$", ""))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with the columns of ``docs``: a row for each time a document is taken.

    A document that a budget's end falls into comes with the words before it.
    Documents without words take nothing from a budget; they come once, unless
    their source has no target.
    """
    found, names = _mixed(docs, weights, share, cap, id_col, text_col, source_col, list(docs.columns))
    size, taken = F.col("__size"), F.col("__taken")
    whole = F.when(size > 0, F.floor(taken / F.greatest(size, F.lit(1)))).otherwise((F.col("__target") > 0).cast("long")).cast("int")
    part = F.when(size > 0, taken % F.greatest(size, F.lit(1))).otherwise(F.lit(0)).cast("int")
    pieces = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = found.select(*found.columns[: len(names)], F.explode(pieces).alias("__cut"))
    text = f"c{names.index(text_col)}"
    cut = F.when(F.col("__cut") > 0, first_words(F.col(text), F.col("__cut"))).otherwise(F.col(text))
    return rows.select(*(cut.alias(c) if c == text else F.col(c) for c in rows.columns[:-1])).toDF(*names)
