"""Every registered query of the core against its SQL in DuckDB."""

import duckdb
import pytest

from quern.plans.registry import ORACLE_SQL, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def show(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    rows = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(show(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_flagship(spark, tiny):
    assert flagship(spark, tiny).count() == 5


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
