"""Running totals over a hash-random order, without a task that holds a whole group.

Within a group rows are ordered by a 60-bit hash key. The key's range is cut
into equal spans; since keys are random, spans are of like size however large
the group is. A span's rows are summed in one task, and totals of the spans
before it come from a table with one row per group and span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a span has on average if there is one group only.
SPAN_ROWS = 20_000
_KEY_BITS = 60
_SPAN_BITS = 24


def hash_key(*cols: Column) -> Column:
    """The first 60 bits of the MD5 of the columns as text; a null counts as U+0000."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols)).cast("binary")), 1, 15), 16, 10).cast("long")


def span_of(key: Column, spans: Column | int) -> Column:
    """``spans`` is at most 2^24."""
    top = F.shiftrightunsigned(key, _KEY_BITS - _SPAN_BITS)
    spans = spans if isinstance(spans, Column) else F.lit(spans)
    return F.shiftrightunsigned(top * spans.cast("long"), _SPAN_BITS)


def spans_for(n_rows: int) -> int:
    return max(1, min(1 << _SPAN_BITS, -(-n_rows // SPAN_ROWS)))


def running_total(rows: DataFrame, totals: DataFrame, groups: list[str], span: str, order: list[str], value: str, name: str, per_group: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group before this row.

    ``rows`` and ``totals`` (which needs only ``groups``, ``span`` and
    ``value``, and may be a narrower reading of the same rows) must have no
    nulls in ``groups``. Columns of ``per_group`` (one row per group) are added
    through the table of spans, so no large group meets its one row in a join.
    Rows that are equal in ``order`` must be equal in ``value``.
    """
    spans = totals.groupBy(*groups, span).agg(F.sum(value).alias("__span_sum"))
    before = Window.partitionBy(*groups).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.coalesce(F.sum("__span_sum").over(before), F.lit(0))).drop("__span_sum")
    if per_group is not None:
        spans = spans.join(per_group, groups)
    within = Window.partitionBy(*groups, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(spans, [*groups, span])
    return joined.withColumn(name, F.col("__before") + F.sum(value).over(within) - F.col(value)).drop("__before")
