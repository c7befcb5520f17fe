"""Every query with SQL gives the same rows there; the others run."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill import queries as core

from .conftest import SF

TABLES = "documents embeddings chunks extracted_docs paragraphs manifest result split_rules mix_targets".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def plain(row):
    return tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (plain(tuple(r[c] for c in columns)) for r in df.collect())))
    if name not in core.SQL:
        assert got
        return
    result = con.execute(core.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(map(repr, (plain(tuple(r[k] for k in order)) for r in result.fetchall())))
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
