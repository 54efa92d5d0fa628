"""Messages of findings: templates, number formats, what tiers word themselves, and the whole review."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pactum.functions import messages as M
from pactum.functions import patterns as P
from pactum.operators import classifier, report, rules, tiers
from pactum.operators.segmentation import segment

SAID = [
    ("시급 9,860원을 준다.", "min_wage", "명시된 시급 9,860원은 10,320원 미만입니다. 미달 부분은 무효이며 최저임금액으로 지급한 것으로 봅니다.", "시급을 10,320원 이상으로 정정하십시오."),
    ("월급 1,900,000원을 지급한다.", "min_wage_monthly", "월 급여 1,900,000원은 월 소정근로시간 209시간 기준 시급 약 9,091원으로, 최저임금 10,320원에 미달합니다.", "월 급여를 2,156,880원 이상으로 정정하십시오."),
    ("수습 기간은 6개월로 한다.", "probation", "수습기간을 6개월로 정하고 있습니다. 최저임금 감액이 허용되는 범위는 3개월 이내이므로 그 이후 감액 지급은 최저임금 위반이 됩니다.", None),
    ("연차 휴가는 10일로 한다.", "annual_leave", "연차를 10일로 정하고 있습니다. 1년간 80% 이상 출근 시 15일이 법정 기준입니다.", "연차 유급휴가를 15일 이상으로 수정하십시오."),
    ("연차는 부여하지 않는다. 연차 10일", "annual_leave", "연차 유급휴가를 주지 않는다는 취지의 조항입니다.", None),
    ("1일 12시간 일한다.", "daily_hours", "1일 소정근로시간을 12시간으로 정하고 있습니다. 휴게시간을 제외한 1일 근로시간은 8시간을 넘길 수 없습니다.", None),
    ("1주 52시간 일한다.", "weekly_hours", "1주 소정근로시간을 52시간으로 정하고 있습니다. 법정 한도는 40시간입니다.", "1주 40시간으로 정정하십시오."),
    ("해고는 7일 전 예고한다.", "dismissal_notice", "해고 예고기간을 7일로 정하고 있습니다. 법정 기준은 30일 전 예고 또는 그에 상당하는 통상임금 지급입니다.", "30일 전 예고 또는 30일분 통상임금 지급으로 수정하십시오."),
    ("퇴직 후 임금은 60일 이내 준다.", "settlement", "퇴직 후 금품 청산 기한을 60일로 정하고 있습니다. 법정 기한은 14일 이내입니다.", None),
    ("감봉은 30%로 한다.", "pay_cut", "감급 제재를 임금의 30퍼센트로 정하고 있습니다. 감급 총액은 1임금지급기 임금 총액의 10분의 1을 넘을 수 없습니다.", None),
    ("감봉은 5%로 하되 감봉 한도 없이 한다.", "pay_cut", "감급 제재의 한도를 두지 않은 조항입니다. 법정 한도를 넘는 감급은 무효입니다.", None),
    ("계약 기간은 3년으로 한다.", "fixed_term", "기간제 계약기간을 3년으로 정하고 있습니다. 총 2년을 초과해 사용하면 기간의 정함이 없는 근로계약으로 전환된 것으로 봅니다.", None),
    ("해고는 문자로 통보한다.", "dismissal_written", M.RULE_MESSAGES["dismissal_written"][0], M.RULE_MESSAGES["dismissal_written"][1]),
]


def test_reasons_state_the_numbers(spark):
    clauses = spark.createDataFrame([(i, 1, t) for i, (t, *_) in enumerate(SAID)] + [(99, 1, None)], "doc_id int, clause_seq int, text string")
    got = {(r.doc_id, r.rule): (r.reason, r.suggestion) for r in rules.worded(rules.run_rules(clauses)).collect()}
    same = {(r.doc_id, r.rule): (r.reason, r.suggestion) for r in rules.worded(tiers.hit_rows(tiers.annotated(clauses))).collect()}
    assert got == same and all(None not in v and "{" not in "".join(v) for v in got.values())
    for i, (_, rule, reason, suggestion) in enumerate(SAID):
        assert got[i, rule][0] == reason
        assert suggestion is None or got[i, rule][1] == suggestion


def test_every_rule_has_words_and_they_fill(spark):
    assert list(M.RULE_MESSAGES) == [r.name for r in rules.RULES]
    assert {r.name for r in rules.RULES if r.value} == {n for n, t in M.RULE_MESSAGES.items() if "{value" in t[0]}
    d = spark.createDataFrame([(1234567,), (None,)], "n long").select(M.fill("a {n:,} b {n} {LEAVE_DAYS}", {"n": F.col("n")}).alias("x"))
    assert [r.x for r in d.collect()] == ["a 1,234,567 b 1234567 15", None]


@pytest.mark.parametrize("confidence, severity, reason", [(0.55, "unfavorable", M.UNSURE + "이유 (분류기 확신도 55%)"), (0.875, "violation", "이유 (분류기 확신도 88%)")])
def test_model_reasons(spark, confidence, severity, reason):
    rows = spark.createDataFrame([(1, 1, "가" * 30, "L", confidence)], "doc_id int, clause_seq int, text string, predicted string, confidence double")
    laws = spark.createDataFrame([("L",)], "id string")
    info = spark.createDataFrame([("L", "violation", "이유", "제안")], "law_id string, severity string, reason string, suggestion string")
    got = rules.worded(classifier.model_findings(rows, laws, info, [])).first()
    assert (got.severity, got.reason, got.suggestion) == (severity, reason, "제안")
    plain = rules.worded(classifier.model_findings(rows, laws, info.drop("reason", "suggestion"), [])).first()
    assert plain.reason.endswith(f"({reason.split('(')[1]}") and plain.suggestion == ""


def test_whole_review(spark):
    docs = spark.createDataFrame([(1, "제1조(임금) 시급 9,000원을\n지급한다.\n제2조(휴일) 휴일은 일요일로 정하여 지킨다."), (2, None), (3, "제1조(휴일) 휴일은 일요일로 한다.\n제2조(장소) 장소는 서울로 한다.")], "doc_id int, text string")
    laws = spark.createDataFrame([("최저임금법-제6조", "사용자는 최저임금액 이상의 임금을 지급하여야 한다.")], "id string, text string")
    parts = segment(docs)
    found = rules.with_quotes(rules.worded(rules.run_rules(parts)), laws)
    got = {r.doc_id: r.markdown for r in report.opinion(parts, found).collect()}
    assert set(got) == {1, 3}
    assert got[3] == M.REVIEW_HEAD + "##  제1조 휴일\n\n> 휴일은 일요일로 한다.\n\n\n##  제2조 장소\n\n> 장소는 서울로 한다.\n\n\n" + M.REVIEW_FOOT
    said = "**문제** — 명시된 시급 9,000원은 10,320원 미만입니다. 미달 부분은 무효이며 최저임금액으로 지급한 것으로 봅니다.\n\n**근거** — 최저임금법-제6조\n> 사용자는 최저임금액 이상의 임금을 지급하여야 한다.\n\n**수정 제안** — 시급을 10,320원 이상으로 정정하십시오.\n\n"
    assert got[1] == M.REVIEW_HEAD + "## 🔴 제1조 임금\n\n> 시급 9,000원을\n> 지급한다.\n\n" + said + "\n##  제2조 휴일\n\n> 휴일은 일요일로 정하여 지킨다.\n\n\n" + M.REVIEW_FOOT
    assert report.opinion(parts.limit(0), found.limit(0)).count() == 0


def test_missing_terms_are_named(spark):
    structure = F.struct(F.array(*map(F.lit, P.MANDATORY[1:3])).alias("required_found"))
    hit = spark.range(1).select(tiers.whole_hit(F.lit("employment"), structure).alias("h")).first().h
    assert hit.reason == f"근로기준법 제17조가 서면 명시를 요구하는 항목 중 {P.MANDATORY[0]}, {P.MANDATORY[3]}에 관한 내용을 찾지 못했습니다." and hit.suggestion == M.MISSING_MESSAGE[1]
