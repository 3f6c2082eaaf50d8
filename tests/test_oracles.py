"""Every query with a DuckDB statement gives the same rows; every other one runs and keeps its schema."""

import duckdb
import pytest

from fathomline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(rows, names):
    """Rows as sorted texts, columns by name, floats to nine digits."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted("|".join(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_duckdb(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    found = duck.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert shown(df.collect(), df.columns) == shown(found.fetchall(), found.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
