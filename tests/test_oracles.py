"""Every query against its SQL in DuckDB, on the smallest tables; and the comparison against itself."""

import math

import duckdb
import pytest
from orrery import catalog

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = f"{DATA}/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows([tuple(r) for r in df.collect()], df.columns) == sorted_rows(wanted.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_the_comparison_sees_a_changed_row():
    rows = [(1, 2.0), (2, None)]
    assert sorted_rows(rows, ["a", "b"]) == sorted_rows([(None, 2), (2.0, 1)], ["b", "a"])
    assert sorted_rows(rows, ["a", "b"]) != sorted_rows([(1, 2.00001), (2, None)], ["a", "b"])


def test_an_oracle_belongs_to_each_name():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
