from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactum.functions import text as T


def one(spark, column, **values):
    kinds = {bool: "boolean", int: "bigint", str: "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_found_gives_code_points(spark):
    t = "😀 a@b.co 그리고 x.y@z.kr"
    got = one(spark, T.found(F.col("t"), r"[\w.]+@[\w.]+"), t=t)
    assert [(m.start, m.end, m.value) for m in got] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"[\w.]+@[\w.]+", t)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \n😀가", max_size=30), min_size=1, max_size=20))
def test_found_is_finditer(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.found(F.col("t"), r"a+b?|\d가").alias("m")).collect()
    for r in rows:
        assert [(m.start, m.end) for m in r.m] == [m.span() for m in re.finditer(r"a+b?|\d가", texts[r.i])]


def test_numbers(spark):
    assert one(spark, T.number(F.col("t")), t="10,320,") == 10320
    assert one(spark, T.number(F.col("t")), t="9" * 20) is None
    assert one(spark, T.number(F.col("t")), t="") is None


def test_cleaning(spark):
    assert one(spark, T.clean_contract(F.col("t")), t=" a　\tb\r\n\r\n\r\nc ") == "a b\n\nc"
    assert one(spark, T.tidy_layout(F.col("t")), t="임금    100  원 |\n | x") == "임금 | 100 원\nx"
    assert one(spark, T.strip_tags(F.col("t")), t="<p>a<br/>b</p>\n c") == "ab c"


def test_ratios_and_order(spark):
    assert one(spark, T.letter_ratio(F.col("t")), t="가나ab") == 0.5
    assert one(spark, T.letter_ratio(F.col("t")), t="123") == 0.0
    assert one(spark, T.order_score(F.col("t")), t="제1조 제2조") == 1.0
    assert one(spark, T.order_score(F.col("t")), t="제1조 제3조 제2조 제4조") == 2 / 3


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="임금은 A b12!") == ["임금은", "A", "b12", "임금", "금은", "b1", "12"]
    assert one(spark, T.tokens(F.col("t")), t="") == []


def test_sentences(spark):
    assert one(spark, T.law_sentences(F.col("t")), t="사용자는 임금을 지급하여야 한다. 짧다. 근로자는 청구할 수 있는 권리가 있다.") == ["사용자는 임금을 지급하여야 한다.", "근로자는 청구할 수 있는 권리가 있다."]
    assert one(spark, T.document_sentences(F.col("t")), t="위와 같이 정한다. 이를 확인함. 끝\n서명한 날") == ["위와 같이 정한다.", "이를 확인함."]


def test_sentence_around(spark):
    t = "첫 문장이다. 위약금을 물지 아니한다. 끝"
    assert one(spark, T.sentence_around_first(F.col("t"), "위약금"), t=t) == " 위약금을 물지 아니한다."
    assert one(spark, T.sentence_around_first(F.col("t"), "없는 말"), t=t) is None


def test_expansion(spark):
    assert one(spark, T.expanded(F.col("t")), t="야근 수당").startswith("야근 수당 연장근로")
