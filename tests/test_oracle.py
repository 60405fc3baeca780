"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from orbweave.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    out = df[sorted(df.columns)].copy()
    for c in out:
        out[c] = out[c].astype("datetime64[us]").astype(str) if out[c].dtype.kind == "M" else out[c].map(lambda x: round(x, 5) if isinstance(x, float) else x)
    return sorted(map(repr, out.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    got, wanted = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", [n for n in sorted(SQL) if "from documents" in SQL[n]])
def test_same_rows_on_odd_texts(spark, tmp_path, name):
    """Documents without a text or a token give the rows that SQL gives."""
    texts = [None, "", " \n\t", "?! ...", "one", "The data, the DATA!", "é - data of it's", "don't stop of information", "x" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, wanted = QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(SQL[name]).df()
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
