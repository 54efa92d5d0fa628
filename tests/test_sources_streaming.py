from __future__ import annotations

import json

from pyspark.sql import functions as F

from pactum.sources import readers
from pactum.streaming import contracts as stream


def test_laws(spark, tmp_path):
    rows = [{"id": "L-1", "law": "L", "article": "제1조", "title": "t", "text": "본문이다.", "verified": True}, {"id": "L-2", "law": "L", "article": "제2조", "title": "u", "text": "x", "verified": False}]
    (tmp_path / "laws.json").write_text(json.dumps(rows, ensure_ascii=False))
    got = readers.laws(spark, str(tmp_path / "laws.json"))
    assert [(r.id, r.pos) for r in got.orderBy("pos").collect()] == [("L-1", 0), ("L-2", 1)]
    assert [r.id for r in readers.unverified(got).collect()] == ["L-2"]


def test_service_replies(spark):
    body = json.dumps({"no": "7", "title": "t", "paragraphs": ["<b>제7조(t)</b> 본문 ", "둘"]}, ensure_ascii=False)
    raw = spark.createDataFrame([("L", body), ("L", f"[{body.replace('7', '8')}]")], "law string, body string")
    got = readers.statutes_from_service(raw, spark.createDataFrame([("L", "제7조")], "law string, article string")).collect()
    assert [(r.id, r.text) for r in got] == [("L-제7조", "본문 둘")]


def test_files_and_engines(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    files = readers.pdf_files(spark, str(tmp_path))
    tried = readers.attempts(files, {"read": lambda b: b.decode() * 20, "fails": lambda b: b.decode("ascii") + None}).collect()
    assert [(r.engine, r.text is None, r.error is None) for r in tried] == [("read", False, True), ("fails", True, False)]
    t = spark.createDataFrame([("p", None, "needs password", 0), ("e", "", None, 0), ("s", "x", None, 2), ("o", "x" * 50, None, 0)], "doc_id string, text string, error string, images int")
    assert {r.doc_id: r.reason for r in readers.diagnosis(t).collect()} == {"p": "encrypted", "e": "empty", "s": "scanned", "o": "ok"}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  글  ")
    (tmp_path / "b.txt").write_text(" \n ")
    assert [r.text for r in readers.documents(spark, str(tmp_path)).collect()] == ["글"]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "제1조(임금) 시급 9,000원을 지급한다.\n제2조(휴일) 휴일은 일요일로 한다."), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream.run(stream.incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "score").collect()
    assert sorted(map(tuple, got)) == [(1, 25), (2, 0)]
    assert stream.findings(docs).where(F.col("rule") == "min_wage").count() == 1
