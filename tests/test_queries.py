"""Every registered query of the engine against its SQL in DuckDB, over a small scale of the given tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from pactum.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    fix = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.select(*columns).collect()) == canonical(want.fetchall())


def test_flagship_has_rows(spark):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, SF).count() > 0


def test_best_engine_rounds_halves_as_sql(spark, tmp_path):
    # the fifth digit of the score is a 5 in every other row, but for the last bit of the double in seven of them
    texts = [("é" * (200 - k) + "a" * k,) for k in range(201)]
    docs = spark.createDataFrame(texts, "text string").selectExpr("monotonically_increasing_id() AS doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["best_engine"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.ORACLE_SQL["best_engine"]).fetchall())
