"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rasterlake import queries

CORE = [n for n in queries.QUERIES]


@pytest.fixture
def oracle(tiny):
    """A connection of its own for each query: an internal error of one would end all that share it. One
    thread, as some plans of joins on computed keys fail now and then with more."""
    con = duckdb.connect(config={"threads": 1})
    for name in os.listdir(tiny):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{tiny}/{name}'")
    yield con
    con.close()


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: "nan" if v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return [names[k] for k in at], sorted((tuple(plain(row[k]) for k in at) for row in rows), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, tiny, oracle, name):
    made = entry.queries()[name](spark, tiny)
    want = oracle.sql(entry.oracle_sql()[name])
    assert ordered(made.columns, [tuple(r) for r in made.collect()]) == ordered(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
