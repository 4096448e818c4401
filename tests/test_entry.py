import duckdb
import pytest

import __spark_entry__ as entry
from latticeframe import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, db, name):
    got = q.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in q.ORACLE_SQL:
        want = db.execute(q.ORACLE_SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert a.equals(b.astype(a.dtypes.to_dict())), name


def test_entry(spark):
    assert entry.entry(spark).count() == 64 * 64 and set(entry.oracle_sql()) <= set(entry.queries())


def test_running_sum(spark, tmp_path):
    from latticeframe.streaming.running import running_sum

    spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 0, 1.0)], "a long, b long, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long, x double").parquet(str(tmp_path / "in"))
    run = running_sum(stream, ["a", "b"], "x").writeStream.format("memory").queryName("cells").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM cells").collect())) == [(0, 1, 5.0), (1, 0, 1.0)]
