"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and everything runs in one process (tests, local
    runs) is a temporary folder set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes, in the end, the tables that ``materialize`` wrote meanwhile, but for those in the list that it gives."""
    kept: list[DataFrame] = list(keep)
    _scopes.append([])
    try:
        yield kept
    finally:
        for df in _scopes.pop():
            if not any(df is k for k in kept):
                discard(df)
            elif _scopes:
                _scopes[-1].append(df)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; no later plan may read ``df``."""
    path = getattr(df, "_tessera_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def struct_of(**kinds: str | T.DataType) -> T.StructType:
    """A schema from column names and types; names may be of any kind, unlike in a schema's text."""
    return T.StructType([T.StructField(name, _KINDS[k] if isinstance(k, str) else k) for name, k in kinds.items()])


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def by_position(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns as c0, c1 ..., so that no name can clash or needs quotes, and their names for ``toDF``."""
    names = list(df.columns)
    return df.toDF(*(f"c{k}" for k in range(len(names)))), names


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """New names for some columns, which are found by their exact names."""
    moved, names = by_position(df)
    return moved.select(*(F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run meanwhile gets Arrow batches of so many rows at most, for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_batch(schema: pa.Schema, rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def map_batches(df: DataFrame, schema: str | T.StructType, fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; it returns the output columns by name."""
    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=False) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, kind)


def join_with_hot(big: DataFrame, small: DataFrame, key: str, n: str, limit: float) -> DataFrame:
    """``big`` with the columns of ``small``, which has one row a ``key`` and says in ``n`` how many rows of ``big`` have it.

    Keys of more than ``limit`` rows are broadcast, the others joined by a
    shuffle; ``big`` has a bounded number of such keys if ``limit`` is a share of its rows.
    """
    hot = small.where(F.col(n) > limit)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col(n) <= limit), key)
    return big.join(F.broadcast(hot), key).unionByName(cold)


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_sample(rows: DataFrame, by: str, key: list[str], most: int, most_groups: int, size: str | None = None, most_bytes: int = 0) -> DataFrame:
    """Up to ``most`` rows of each value of ``by`` (not null): those whose ``key`` hashes lowest, of rows with one key one.

    With ``size``, a column of bytes, the rows of a value have ``most_bytes``
    at most, and rows of more than a 64th of that aren't taken. Counts of
    different keys say below which hash about 1.5 times as many are as are
    wanted, so that only these are ranked. Adds __h, the hash as a number from
    0 to 1, and __n, the value's count of rows. More than ``most_groups`` values are refused.
    """
    rows = rows.where(F.col(by).isNotNull()).withColumn("__h", F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53)))
    counts = rows.groupBy(by).agg(F.count("*").alias("__n"), F.approx_count_distinct("__h", 0.03).alias("__keys")).limit(most_groups + 1).collect()
    if len(counts) > most_groups:
        raise ValueError(f"more than {most_groups} values to fit rows of")
    table = rows.sparkSession.createDataFrame(counts, T.StructType([rows.schema[by], *(T.StructField(c, T.LongType()) for c in ("__n", "__keys"))]))
    near = rows.join(F.broadcast(table), by).where(F.col("__h") * F.col("__keys") <= 1.5 * most + 50)  # at most ``most_groups`` rows
    if size is not None:
        near = near.where(F.coalesce(F.col(size), F.lit(0)) <= most_bytes // 64)
    near = near.drop("__keys").dropDuplicates([by, "__h"])
    order = Window.partitionBy(by).orderBy("__h")
    ranked = near.withColumn("__rank", F.row_number().over(order))
    if size is not None:
        ranked = ranked.withColumn("__bytes", F.sum(F.coalesce(F.col(size), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        ranked = ranked.where(F.col("__bytes") <= most_bytes).drop("__bytes")
    return ranked.where(F.col("__rank") <= most).drop("__rank")
