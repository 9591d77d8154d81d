"""Every registered query against DuckDB over the same tables."""

import os

import duckdb
import pytest

from litmill import document_queries, more_queries  # noqa: F401  they register their queries
from litmill.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: float(x) if isinstance(x, (int, float)) else str(x) if x is not None else None
    return [sorted(columns), *sorted(([clean(v[i]) for i in order] for v in values), key=str)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    expected = duck.sql(SQL[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(expected.columns, expected.fetchall())
    strip = lambda t: [[x.replace("+00:00", "") if isinstance(x, str) else x for x in r] for r in t]
    assert strip(got) == strip(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_boxes_of_all_embeddings(spark):
    from litmill.queries import _rects

    assert _rects(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count() > 400
