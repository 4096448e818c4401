import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from latticeframe.llm import queries
from latticeframe.llm.shared import stored

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, seen = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, DATA), "stage")
        assert kept.columns == docs.columns and 0 < kept.count() < seen
        seen = kept.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert len(set(texts.values())) == len(texts)
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(b in t for b in bench for t in texts.values())
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)


def test_stages_on_odd_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", None, None, None), (3, None, None, None, None), (4, "", None, None, 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "stage")
    assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect()) == [(False, 2), (False, 4), (True, None)]
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        none = stored(stage(spark, none, DATA), "stage")
    assert none.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b.astype({c: t for c, t in a.dtypes.items()}))


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
