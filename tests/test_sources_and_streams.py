import operator

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators.tensor import from_numpy
from tessera.plans import queries
from tessera.sources import tables
from tessera.streaming.incremental import running_reduce

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, sf, oracle, name):
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = oracle.execute(queries.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == cols
    want = [dict(zip(names, r)) for r in rows.fetchall()]
    ours = sorted(tuple(map(str, (r[c] for c in cols))) for r in got.collect())
    assert ours == sorted(tuple(map(str, (r[c] for c in cols))) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_write_and_read(spark, tmp_path):
    x = np.arange(6.0).reshape(2, 3)
    tables.write(from_numpy(spark, x), str(tmp_path / "x"))
    assert tables.read(spark, str(tmp_path / "x")).numpy().tolist() == x.tolist()
    with pytest.raises(TypeError):
        from_numpy(spark, np.array(["a"]))


def test_running_reduce(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 0{i % 4}:10:00", float(i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "k int, t string, x double").select("k", F.to_timestamp("t").alias("t"), "x")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for time, by in ((None, ("k",)), ("t", ())):
        out = running_reduce(stream, operator.add, F.col("x"), by, time)
        name = f"sums_{time}"
        run = out.writeStream.format("memory").queryName(name).outputMode("complete").start()
        run.processAllAvailable()
        run.stop()
        assert sorted(r["v"] for r in spark.table(name).collect()) == sorted(sum(x for k, t, x in rows if (k if by else t) == key) for key in {(k if by else t) for k, t, x in rows})
    with pytest.raises(ValueError):
        running_reduce(stream, lambda a, b: a - b, F.col("x"))
