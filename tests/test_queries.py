"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from textloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that rightly find nothing in the smallest tables.
EMPTY: set[str] = set()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == cols
    want = sorted(repr(tuple(plain(r[order.index(c)]) for c in cols)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect()) == want
    assert want or name in EMPTY, "no rows prove nothing"


#: Their rows come of steps that SQL cannot express; ``test_sources``, ``test_cells`` and ``test_records`` hold their operators against hand-computed cases.
WITHOUT_SQL = {"layout_order", "punct_normalize", "merged_cells", "note_blocks", "nested_blocks"}


def test_queries_without_sql_are_known():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_keeps_rows(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0
