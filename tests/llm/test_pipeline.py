from __future__ import annotations

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from pactum.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        tables.append((name, docs))
    by = dict(tables)
    assert [n for n, _ in tables] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert all(d.columns == COLUMNS for n, d in tables[:-1])
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in tables}
    assert ids["quality"] == ids["line_dedup"] >= ids["near_dedup"] >= ids["mixing"] == ids["bpe"]
    assert by["bpe"].count() == by["mixing"].count()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in by["mixing"].collect()}
    assert all(r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids for r in by["bpe"].collect())
    assert corpus_pipeline.run(spark, SF).count() == by["bpe"].count()


def test_entry_lists_all():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
