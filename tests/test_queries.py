"""Every registered keyspace query against its SQL twin."""

import duckdb
import pytest

from keyloom.queries import ORACLE_SQL, QUERIES

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[columns.index(c)] for c in order)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        ran = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in ran.description]
        assert sorted(names) == sorted(df.columns)
        assert got == _rows(names, ran.fetchall())
