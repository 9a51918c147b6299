"""Operators against their SQL, over a driver's table and over our odd documents."""

from collections import Counter

import brute
import duckdb
import pytest

from quarry.llm import oracles, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracles.ORACLE_SQL)
def test_sql_gives_the_same_rows(spark, name):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = db.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(expected.columns)
    assert Counter(map(tuple, got.select(*expected.columns).collect())) == Counter(expected.fetchall())


@pytest.mark.parametrize("name", oracles.ORACLE_SQL)
def test_sql_bears_odd_documents(spark, tables, rows, tmp_path, name):
    """Documents of different ids, as in the driver's tables."""
    once = spark.createDataFrame(list({i: (i, t, [None, "", "a"][i % 3]) for i, t in rows if i is not None}.values()), "doc_id long, text string, source string")
    once.write.parquet(str(tmp_path / "documents.parquet"))
    once.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "cast(doc_id % 3 = 0 as int) AS toxic").filter("doc_id % 5 > 0").write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    expected = db.sql(registry.ORACLE_SQL[name])
    assert Counter(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).select(*expected.columns).collect())) == Counter(expected.fetchall())


@pytest.mark.parametrize(("name", "made", "kinds"), [("op2_personal_data", brute.disclosing_texts, ["term"]), ("op10_secret_scan", brute.credential_texts, ["weak_access", "weak_secret", "endpoint"])])
def test_sql_has_the_spans_that_the_methods_add(spark, tmp_path, name, made, kinds):
    spark.createDataFrame(list(enumerate(made())), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = db.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*expected.columns).collect()
    assert Counter(map(tuple, got)) == Counter(expected.fetchall())
    assert all(sum(f"{k}:" in r["spans"] for r in got) > 20 for k in kinds)
