"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lattica.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert rows
    if name in SQL:
        want = con.sql(SQL[name])
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        assert plain(rows) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_entry_points_without_the_subpackage(monkeypatch):
    """The other queries are there when lattica.llm and corpus_pipeline are not."""
    import builtins
    import sys

    import __spark_entry__

    real = builtins.__import__

    def gone(name, *a, **k):
        if name.startswith("lattica.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("lattica.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", gone)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(SQL)
