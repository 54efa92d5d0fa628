"""Block decisions, previews, system information, and counts that are gathered while a report is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.operators import checks, screens, tiers
from pactum.operators.segmentation import segment


def test_blocked_documents(spark):
    texts = [
        "근로계약서\n사용자와 근로자는 임금, 근로시간, 휴일, 연차, 퇴직, 해고, 휴가를 다음과 같이 정하고 서로 성실히 지키기로 하며 체결한다. 서명",
        "용역계약서\n수급인은 산출물을 납품하고 검수 후 대금을 지급받으며, 계약 기간과 업무, 보험과 시간을 회사와 협의하여 체결한다. 도급인 서명",
        "짧다",
        None,
        "this is a contract in plain english words with many letters and no others at all so that nothing can be read of it here today",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = d.select("doc_id", screens.blocked(checks.input_check(F.col("text")), checks.verdict(checks.structure(F.col("text"))), F.lit(True)).alias("b")).collect()
    said = {r.doc_id: r.b and tuple(r.b) for r in got}
    assert said == {0: None, 1: ("contractor", screens.NOT_EMPLOYMENT["contractor"], True), 2: ("too_short", None, False), 3: ("too_short", None, False), 4: ("not_korean", None, False)}


def test_previews(spark):
    word = lambda d, p, r, i, t: (d, p, t, i * 50.0, i * 50.0 + 40, r * 12.0, r * 12.0 + 9)
    rows = [word(1, 1, 0, 0, "전화"), word(1, 1, 0, 1, "010-1234-5678"), word(1, 1, 1, 0, "성명"), word(1, 1, 1, 1, ":"), word(1, 1, 1, 2, "김하나"), word(1, 3, 0, 0, "평범"), word(1, 4, 0, 0, "010-1234-5678"), word(2, 5, 0, 0, "글"), word(3, 1, 0, 0, "글"), word(1, 2, 0, 0, None)]
    words = spark.createDataFrame(rows, "doc_id int, page int, text string, x0 double, x1 double, top double, bottom double").withColumn("extra", F.lit(1))
    files = spark.createDataFrame([(1, 4, None), (2, 5, None), (3, 1, "ValueError"), (4, None, None)], "doc_id int, total_pages int, error string")
    got = {r.doc_id: r for r in screens.page_previews(files, words).collect()}
    assert [tuple(p) for p in got[1].pages] == [(1, 2), (3, 0)] and got[1].counts == {"연락처": 1, "성명": 1} and got[1].truncated and got[1].ok
    assert [(got[k].ok, got[k].reason, got[k].pages, got[k].counts) for k in (2, 3, 4)] == [(False, "scanned", [], {}), (False, "error", [], {}), (False, "scanned", [], {})]
    assert screens.page_previews(files.limit(0), words.limit(0)).count() == 0


def test_system_info(spark):
    laws = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, verified boolean")
    assert tuple(screens.system_info(laws, ["x", "y"]).first()) == (3, 2, 26, True, 2, 10320, 2026)
    assert tuple(screens.system_info(laws.limit(0)).first())[:5] == (0, 0, 26, False, 0)


def test_counts_of_a_run_equal_an_aggregate(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"제1조(임금) 시급 {9 + i % 3},000원을 지급하며 위약금을 물린다.\n제2조(휴일) 휴일은 일요일로 정하여 지킨다.") for i in range(40)] + [(99, None)], "doc_id int, text string")
    rows = tiers.annotated(segment(docs, outer=True))
    kept, seen = screens.observed(rows, "run")
    kept.write.parquet(str(tmp_path / "report"))
    want = tiers.meta_of(rows.where("clause_seq is not null")).agg(*(F.sum(c).alias(c) for c in ("clauses", "flagged", "violations", "unfavorable", "by_rule", "by_model", "by_judge"))).first().asDict()
    assert seen.get == want and want["violations"] > 40 and want["clauses"] == 80
    empty, none = screens.observed(rows.limit(0), "none")
    empty.write.parquet(str(tmp_path / "empty"))
    assert set(none.get.values()) == {0}
