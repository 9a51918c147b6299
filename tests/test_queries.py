"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans.catalogue import ORACLE_SQL, QUERIES

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    kinds = dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    assert {c: KINDS[k] for c, k in ours.dtypes} == kinds or all(KINDS[k][:3] == kinds[c][:3] for c, k in ours.dtypes if k == "string")
    order = [theirs.columns.index(c) for c in columns]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    rows = text(tuple(r[c] for c in columns) for r in ours.collect())
    assert rows == text(tuple(r[i] for i in order) for r in theirs.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_validate_pass_where_pages_share_urls(spark, tmp_path):
    """Each page has a status and an answer of its own, whatever other pages of its url have; a page without url too."""
    urls = ["http://s.net/a", "http://s.net/b", None]
    # 42 ids in a row hold each status with each content type.
    rows = [(n, urls[k], "") for k in range(3) for n in range(42 * k, 42 * k + 42)] + [(4, "http://s.net/b", ""), (4, "http://s.net/b", ""), (200, "http://s.net/c", ""), (None, "http://s.net/a", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = con.execute(ORACLE_SQL["validate_pass"]).fetchall()
    ours = map(tuple, QUERIES["validate_pass"](spark, str(tmp_path)).collect())
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs)) and len(theirs) == len(rows)
