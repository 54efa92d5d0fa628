"""Deterministic clause rules, compiled to expressions.

A rule is a predicate on a clause's text with a law, a severity and the law's sentence to quote. Patterns are written
in a small notation: ``near("A", 20, "B")`` is A, then at most 20 characters of the same sentence, then B.
All rules stand in one projection, so a clause is read once and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions import patterns as P
from pactum.functions.messages import rule_message
from pactum.functions.text import first_group, law_sentences, matches, number, sentence_around_first

NUM = r"([0-9][0-9,]*)"


def near(*parts: str | int) -> str:
    """Patterns with gaps between: a number n stands for up to n characters other than period and line end, as few as possible."""
    return "".join(rf"[^.\n]{{0,{p}}}?" if isinstance(p, int) else f"(?:{p})" for p in parts)


def any_of(*patterns: str) -> str:
    return "|".join(patterns)


@dataclass(frozen=True)
class Rule:
    name: str
    law_id: str
    severity: str
    sentence: int
    holds: Callable[[Column], Column]
    #: Whether a negation in the sentence of the first match takes the finding back (pattern of that match).
    guard: str | None = None
    #: The number that the finding's message states.
    value: Callable[[Column], Column] | None = None

    def column(self, text: Column) -> Column:
        """A finding, or null; an expression that is null counts as a miss."""
        hit = self.holds(text)
        if self.guard:
            hit = hit & ~F.coalesce(matches(sentence_around_first(text, self.guard), P.NEGATION), F.lit(False))
        return F.when(hit, F.struct(F.lit(self.name).alias("rule"), F.lit(self.law_id).alias("law_id"), F.lit(self.severity).alias("severity"), F.lit(self.sentence).alias("sentence"), (self.value(text) if self.value else F.lit(None).cast("bigint")).alias("value")))


def says(pattern: str) -> Callable[[Column], Column]:
    return lambda t: matches(t, pattern)


def compares(pattern: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A test of the number that the first match holds."""
    return lambda t: F.coalesce(test(states(pattern)(t)), F.lit(False))


def states(pattern: str) -> Callable[[Column], Column]:
    """The number that the first match holds."""
    return lambda t: number(first_group(t, pattern))


def unless(veto: str, then: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: ~matches(t, veto) & then(t)


V, U = "violation", "unfavorable"
LSA, MWA, ERBSA, EEOA, FTA = "근로기준법", "최저임금법", "근로자퇴직급여보장법", "남녀고용평등법", "기간제법"

# What the rules look for. The words, gaps and limits must be these for right results.
PENALTY = any_of(r"위약금|손해배상액을?\s*(?:미리|예정)|배상액을\s*예정|위약벌", near("교육비|연수비|훈련비|지원금", 25, "반환|상환"))
HOURLY = r"시급\s*(?:금)?\s*" + NUM
MONTHLY = r"(?:월|월급|월\s*급여|임금)\s*(?:금)?\s*" + NUM + r"\s*원"
QUIT = "퇴사|사직|퇴직"
LEAVE_DAYS_FIRST = near(NUM + r"\s*일", 10, "유급|연차")
LEAVE_DAYS_LAST = near("연차", 15, NUM + r"\s*일")
NOTICE = near("해고", 30, NUM + r"\s*일\s*전")
PAY_CUT = near("감봉|감급", 30, NUM + r"\s*(?:퍼센트|%)")
TERM = r"(?:계약|근로)\s*기간[^.\n]{0,25}?(?<![0-9])([1-9])\s*년(?!\s*\d)"
NO_TERM = r"기간의?\s*정함이?\s*없"
MATERNITY_DAYS = near("출산", 20, "휴가", 20, NUM + r"\s*일")


def _leave_days(t: Column) -> Column:
    """The first form if it is there, else the second."""
    return F.coalesce(number(first_group(t, LEAVE_DAYS_FIRST)), number(first_group(t, LEAVE_DAYS_LAST)))


def _no_leave(t: Column) -> Column:
    return matches(t, near("연차", 20, "없|미지급|부여하지"))


def _speaks_of_leave(t: Column) -> Column:
    return F.contains(t, F.lit("연차")) | F.contains(t, F.lit("유급휴가"))


DAILY = r"1\s*일\s*" + NUM + r"\s*시간"
WEEKLY = near(r"1\s*주|주\s*간", 10, NUM + r"\s*시간")
PROBATION = near("수습", 20, NUM + r"\s*개월")
SETTLEMENT = near("퇴직", 25, "임금|급여|금품", 25, NUM + r"\s*일\s*이내")
over_day = compares(DAILY, lambda n: n > P.DAILY_HOURS)
short_notice = compares(NOTICE, lambda n: n < P.NOTICE_DAYS)
long_term = unless(NO_TERM, compares(TERM, lambda n: n > 2))

# Laws, sentences and severities of the rules, in the order in which findings are listed. A rule with two
# outcomes stands twice, the later one for clauses that the earlier one leaves.
RULES: list[Rule] = [
    Rule("penalty", f"{LSA}-제20조", V, 0, says(PENALTY), guard=PENALTY),
    Rule("min_wage", f"{MWA}-제6조", V, 0, compares(HOURLY, lambda n: n < P.MIN_WAGE_HOURLY), value=states(HOURLY)),
    Rule("min_wage_monthly", f"{MWA}-제6조", V, 0, compares(MONTHLY, lambda n: (n >= P.LEAST_MONTHLY) & (n < P.MIN_WAGE_MONTHLY)), value=states(MONTHLY)),
    Rule("forced_labor", f"{LSA}-제7조", V, 0, unless(rf"(?:{QUIT})\s*(?:한\s*)?후", says(any_of(near(QUIT, 40, r"할\s*수\s*없|하지\s*못한다|금지|불가"), near(r"(?:동의|승인|허가)\s*(?:없이|없으면)", 20, QUIT))))),
    Rule("leave_timing", f"{LSA}-제60조", U, 0, says(any_of(near("연차|유급휴가", 50, "회사|사용자", 20, "지정|정하는", 15, "날|시기|기간"), near("연차|유급휴가", 40, r"(?:회사|사용자)가\s*일방")))),
    Rule("probation", f"{MWA}-제5조", U, 2, compares(PROBATION, lambda n: n > P.PROBATION_MONTHS), value=states(PROBATION)),
    Rule("annual_leave", f"{LSA}-제60조", V, 0, lambda t: _speaks_of_leave(t) & (_no_leave(t) | F.coalesce(_leave_days(t) < P.LEAVE_DAYS, F.lit(False))), value=lambda t: F.when(~_no_leave(t), _leave_days(t))),
    Rule("daily_hours", f"{LSA}-제50조", V, 1, over_day, value=states(DAILY)),
    Rule("weekly_hours", f"{LSA}-제50조", V, 0, lambda t: ~over_day(t) & compares(WEEKLY, lambda n: n > P.WEEKLY_HOURS)(t), value=states(WEEKLY)),
    Rule("unpaid_overtime", f"{LSA}-제56조", V, 0, lambda t: matches(t, near(r"(?:연장|야간|휴일|초과)\s*근로", 30, "수당|가산", 20, "없|미지급|포함된 것으로|지급하지")) | matches(t, r"(?:포괄|고정)\s*연장") & matches(t, r"추가\s*지급하지")),
    Rule("dismissal_notice", f"{LSA}-제26조", V, 0, short_notice, value=states(NOTICE)),
    Rule("dismissal_at_will", f"{LSA}-제23조", V, 0, lambda t: ~short_notice(t) & matches(t, r"(?:즉시|언제든지)\s*해고|사유\s*없이[^.\n]{0,10}해고")),
    Rule("settlement", f"{LSA}-제36조", V, 0, compares(SETTLEMENT, lambda n: n > P.SETTLEMENT_DAYS), value=states(SETTLEMENT)),
    Rule("severance_waiver", f"{ERBSA}-제8조", V, 0, says(near("퇴직금", 40, r"포기|청구하지|(?:임금|급여|월급)에\s*포함|분할\s*(?:하여\s*)?지급|매월\s*지급|중간\s*정산"))),
    Rule("marriage_pregnancy", f"{EEOA}-제11조", V, 1, says(near("혼인|결혼|임신|출산", 25, QUIT))),
    Rule("wage_offset", f"{LSA}-제43조", U, 0, says(near("임금|급여", 30, "상계|공제", 20, "대여금|가불|전차금"))),
    Rule("break_time", f"{LSA}-제54조", V, 0, says(near("휴게", 20, "없|부여하지|미부여"))),
    Rule("dismissal_written", f"{LSA}-제27조", V, 0, says(any_of(near("해고", 40, r"(?:구두|유선|전화|문자)(?:로만|로|만)?\s*(?:통보|통지|고지)"), near("해고", 30, "서면", 20, r"하지\s*아니|않는다|생략|없이")))),
    Rule("pay_cut", f"{LSA}-제95조", V, 0, lambda t: compares(PAY_CUT, lambda n: n > 10)(t) | matches(t, near("감봉|감급", 30, r"제한\s*없|한도\s*없|회사가\s*정하는")), value=lambda t: F.when(states(PAY_CUT)(t) > 10, states(PAY_CUT)(t))),
    Rule("fixed_term", f"{FTA}-제4조", U, 0, long_term, value=states(TERM)),
    Rule("fixed_term_renewal", f"{FTA}-제4조", V, 1, lambda t: ~long_term(t) & unless(NO_TERM, says(near("갱신|연장", 30, rf"2년\s*초과|{near('무기계약', 15, '아니|않')}|전환되지")))(t)),
    Rule("retaliation", f"{LSA}-제104조", V, 1, says(near("노동청|노동위원회|고용노동부|근로감독관|진정|신고|고발", 40, r"해고|징계|불이익|계약\s*해지|퇴사"))),
    Rule("parental_leave", f"{EEOA}-제19조", V, 2, says(any_of(near("육아휴직", 40, "허용하지|불가|제외|거부|인정하지|해고|불이익"), near("육아휴직", 30, "복직|복귀", 20, "보장하지|아니")))),
    Rule("rules_change", f"{LSA}-제94조", V, 0, says(near("취업규칙", 40, rf"동의\s*없이|일방적|회사가\s*단독|{near(r'의견\s*청취', 10, '없|생략')}"))),
    Rule("discrimination", f"{LSA}-제6조", V, 0, says(near(r"국적|출신|신앙|종교|혼인\s*여부|학벌|출신지", 30, "따라|이유로", 25, "차등|차별|달리|제한"))),
    Rule("harassment", f"{LSA}-제76조의2", V, 0, says(any_of(near("괴롭힘|폭언|따돌림|갑질", 40, r"문제\s*삼지|이의|책임지지|해당하지"), near("괴롭힘|고충", 30, "신고|제기", 25, r"금지|할\s*수\s*없|불이익")))),
    Rule("maternity_leave", f"{LSA}-제74조", V, 0, lambda t: matches(t, any_of(near(r"출산(?:전후)?\s*휴가", 35, "부여하지|없|무급|제외|허용하지"), MATERNITY_DAYS)) & F.coalesce(number(first_group(t, MATERNITY_DAYS)) < 90, F.lit(True))),
    Rule("spouse_leave", f"{EEOA}-제18조의2", V, 0, says(near("배우자", 20, "출산", 25, rf"{near('휴가', 15, '없|부여하지|무급')}|불이익|해고"))),
    Rule("job_interference", f"{LSA}-제40조", V, 0, says(any_of(near("재취업|이직|취업", 30, "방해|명단|블랙리스트|통보하여"), near("퇴사자|퇴직자", 25, "명단", 25, "공유|통보|제공")))),
]

#: Rules that stand for the second outcome of the one before.
SECOND_OUTCOMES = ("weekly_hours", "dismissal_at_will", "fixed_term_renewal")

#: A finding beside its clause. value: the number that its message states; reason and suggestion: those that a tier words itself.
HIT = "struct<rule_ord:int,rule:string,law_id:string,severity:string,sentence:int,source:string,value:bigint,reason:string,suggestion:string>"


def rule_hits(text: Column, rules: list[Rule] | None = None) -> Column:
    """The hits of all rules on a text in the order of the rules, as array<HIT>. A null text has none."""
    found = [F.struct(F.lit(n).alias("rule_ord"), r.column(text).alias("hit")) for n, r in enumerate(RULES if rules is None else rules)]
    if not found:
        return F.array().cast(f"array<{HIT}>")
    kept = F.filter(F.array(*found), lambda x: x["hit"].isNotNull())
    own = lambda x: [x["hit"][c].alias(c) for c in ("rule", "law_id", "severity", "sentence")]
    named = F.transform(kept, lambda x: F.struct(x["rule_ord"], *own(x), F.lit("rule").alias("source"), x["hit"]["value"].alias("value"), F.lit(None).alias("reason"), F.lit(None).alias("suggestion")))
    return named.cast(f"array<{HIT}>")


def run_rules(clauses: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, clause_seq, rule_ord, rule, law_id, severity, sentence, source, value) of every hit of (doc_id, clause_seq, text).

    A null text hits nothing. Numbers that don't fit 64 bits count as misses. Repeated rows give repeated findings.
    """
    hits = F.array(*[r.column(F.col("text")) for r in rules or RULES])
    return (
        clauses.select("doc_id", "clause_seq", F.posexplode(hits).alias("rule_ord", "hit"))
        .where("hit is not null")
        .select("doc_id", "clause_seq", "rule_ord", "hit.rule", "hit.law_id", "hit.severity", "hit.sentence", F.lit("rule").alias("source"), "hit.value")
    )


def worded(findings: DataFrame) -> DataFrame:
    """Findings (rule, value, ...) with reason and suggestion: those that a tier gave, else the rule's messages with the number
    in them; empty where there is neither. Columns of these names are replaced, others stay; no shuffle."""
    given = lambda c: F.col(c) if c in findings.columns else F.lit(None)
    said = {c: F.coalesce(given(c), rule_message(F.col("rule"), F.col("value"), k), F.lit("")) for k, c in enumerate(("reason", "suggestion"))}
    return findings.withColumns(said)


def with_quotes(findings: DataFrame, laws: DataFrame) -> DataFrame:
    """Findings with the quoted sentence of their law (id, text, ...), the last one if there are fewer, the whole text if
    there is none; findings of unknown laws have no quote. The law table has a row for each article of the statutes in use."""
    parts = law_sentences(F.col("law_text"))
    quoted = laws.select(F.col("id").alias("law_id"), F.col("text").alias("law_text")).withColumn("parts", parts)
    pick = F.least(F.col("sentence"), F.size("parts") - 1)
    return findings.join(quoted, "law_id", "left").withColumn("quote", F.when(F.size("parts") == 0, F.col("law_text")).otherwise(F.get("parts", pick))).drop("parts")
