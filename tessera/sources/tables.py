"""Tensors from Parquet tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tensor import Tensor, column

#: Columns that number their table's rows from 0 without gaps; other tables have no positions.
POSITIONS = {"events": "event_id", "embeddings": "vec_id", "part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str, name: str, *columns: str) -> tuple[Tensor, ...]:
    """Columns of one table as tensors over one frame, so that combining them needs no join."""
    position = POSITIONS.get(name)
    frame = table(spark, folder, name).select(*([position] if position and position not in columns else []), *columns)
    return tuple(column(frame, c, position) for c in columns)


def write(x: Tensor, path: str) -> None:
    """Columns i0, i1 ... and v as Parquet."""
    x.df().write.parquet(path)


def read(spark: SparkSession, path: str) -> Tensor:
    frame = spark.read.parquet(path)
    return column(frame, "v", [c for c in frame.columns if c != "v"])
