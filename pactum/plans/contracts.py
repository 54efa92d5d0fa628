"""Contracts from text to report, and the queries over the contracts that derive from the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import messages as M
from pactum.functions import patterns as P
from pactum.functions.text import clean_contract, order_score
from pactum.operators import checks, evaluation, masking, report, rules, tiers
from pactum.operators.segmentation import segment
from pactum.sources.derived import CONTRACTS_SQL, contracts, labels


def analysed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, clauses, findings) of docs (doc_id, text): masked, checked, classified by structure, cut and tested."""
    clean = docs.withColumn("text", clean_contract(F.col("text")))
    hidden = masking.find_spans(clean).withColumn("text", masking.masked(F.col("text"), F.col("spans"))).drop("spans")
    seen = hidden.withColumn("check", checks.input_check(F.col("text"))).withColumn("structure", checks.structure(F.col("text"))).withColumn("verdict", checks.verdict(F.col("structure")))
    clauses = segment(hidden)
    return seen, clauses, rules.run_rules(clauses)


# --- SQL of the same, for contracts of one clause a line ------------------------------------------------------------------

LINES = f"""c AS ({CONTRACTS_SQL}),
    l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c),
    p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM l),
    sig AS (SELECT doc_id, min(begins) AS sig FROM p WHERE line LIKE '(사업주)%' GROUP BY doc_id),
    heads AS (SELECT p.*, sig FROM p LEFT JOIN sig USING (doc_id) WHERE regexp_matches(line, '^제[0-9]+조[(]')),
    parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY begins) AS clause_seq,
                     CAST(regexp_extract(line, '^제([0-9]+)조', 1) AS INT) AS article_no, regexp_extract(line, '[(]([^)]*)[)]', 1) AS title,
                     regexp_extract(line, '[)] (.*)$', 1) AS text, begins AS start_at,
                     coalesce(lead(begins) OVER (PARTITION BY doc_id ORDER BY begins), sig, length(text)) AS end_at FROM heads),
    clauses AS (SELECT doc_id, CAST(clause_seq AS INT) AS clause_seq, article_no, title, text, CAST(start_at AS INT) AS start_at, CAST(end_at AS INT) AS end_at FROM parts
                UNION ALL SELECT doc_id, CAST(m + 1 AS INT), NULL, '서명란', substring(text, CAST(sig AS INT) + 1), CAST(sig AS INT), CAST(length(text) AS INT)
                FROM c JOIN sig USING (doc_id) JOIN (SELECT doc_id, max(clause_seq) AS m FROM parts GROUP BY doc_id) USING (doc_id))"""


def _says(pattern: str) -> str:
    return f"regexp_matches(text, '{pattern}')"


def _n(pattern: str) -> str:
    return f"TRY_CAST(replace(regexp_extract(text, '{pattern}', 1), ',', '') AS BIGINT)"


GAP = r"[^.\n]"
NUM = "([0-9][0-9,]*)"
LEAVE_1 = rf"{NUM}\s*일{GAP}{{0,10}}?(?:유급|연차)"
LEAVE_2 = rf"연차{GAP}{{0,15}}?{NUM}\s*일"
LONG_TERM = _n(r"(?:계약|근로)\s*기간(?:[^.\n]{0,24}?[^0-9.\n])?([1-9])\s*년") + " > 2"
DAY = _n(rf"1\s*일\s*{NUM}\s*시간") + " > 8"
SOON = _n(rf"해고{GAP}{{0,30}}?{NUM}\s*일\s*전") + " < 30"
BORN = rf"출산{GAP}{{0,20}}?휴가{GAP}{{0,20}}?{NUM}\s*일"
#: The rules once more as SQL: name -> (law, severity, condition).
RULE_SQL = {
    "penalty": ("근로기준법-제20조", "violation", _says(rf"위약금|손해배상액을?\s*(?:미리|예정)|배상액을\s*예정|위약벌|(?:교육비|연수비|훈련비|지원금){GAP}{{0,25}}?(?:반환|상환)") + f" AND NOT {_says(P.NEGATION)}"),
    "min_wage": ("최저임금법-제6조", "violation", _n(rf"시급\s*(?:금)?\s*{NUM}") + " < 10320"),
    "min_wage_monthly": ("최저임금법-제6조", "violation", _n(rf"(?:월|월급|월\s*급여|임금)\s*(?:금)?\s*{NUM}\s*원") + " BETWEEN 500000 AND 2156879"),
    "forced_labor": ("근로기준법-제7조", "violation", "NOT " + _says(r"(?:퇴사|사직|퇴직)\s*(?:한\s*)?후") + " AND " + _says(rf"(?:퇴사|사직|퇴직){GAP}{{0,40}}?(?:할\s*수\s*없|하지\s*못한다|금지|불가)|(?:동의|승인|허가)\s*(?:없이|없으면){GAP}{{0,20}}?(?:퇴사|사직|퇴직)")),
    "leave_timing": ("근로기준법-제60조", "unfavorable", _says(rf"(?:연차|유급휴가){GAP}{{0,50}}?(?:회사|사용자){GAP}{{0,20}}?(?:지정|정하는){GAP}{{0,15}}?(?:날|시기|기간)|(?:연차|유급휴가){GAP}{{0,40}}?(?:회사|사용자)가\s*일방")),
    "probation": ("최저임금법-제5조", "unfavorable", _n(rf"수습{GAP}{{0,20}}?{NUM}\s*개월") + " > 3"),
    "annual_leave": ("근로기준법-제60조", "violation", f"(contains(text, '연차') OR contains(text, '유급휴가')) AND ({_says(rf'연차{GAP}{{0,20}}?(?:없|미지급|부여하지)')} OR coalesce({_n(LEAVE_1)}, {_n(LEAVE_2)}) < 15)"),
    "daily_hours": ("근로기준법-제50조", "violation", DAY),
    "weekly_hours": ("근로기준법-제50조", "violation", f"NOT coalesce({DAY}, false) AND " + _n(rf"(?:1\s*주|주\s*간){GAP}{{0,10}}?{NUM}\s*시간") + " > 40"),
    "unpaid_overtime": ("근로기준법-제56조", "violation", _says(rf"(?:연장|야간|휴일|초과)\s*근로{GAP}{{0,30}}?(?:수당|가산){GAP}{{0,20}}?(?:없|미지급|포함된 것으로|지급하지)") + " OR " + _says(r"(?:포괄|고정)\s*연장") + " AND " + _says(r"추가\s*지급하지")),
    "dismissal_notice": ("근로기준법-제26조", "violation", SOON),
    "dismissal_at_will": ("근로기준법-제23조", "violation", f"NOT coalesce({SOON}, false) AND " + _says(rf"(?:즉시|언제든지)\s*해고|사유\s*없이{GAP}{{0,10}}해고")),
    "settlement": ("근로기준법-제36조", "violation", _n(rf"퇴직{GAP}{{0,25}}?(?:임금|급여|금품){GAP}{{0,25}}?{NUM}\s*일\s*이내") + " > 14"),
    "severance_waiver": ("근로자퇴직급여보장법-제8조", "violation", _says(rf"퇴직금{GAP}{{0,40}}?(?:포기|청구하지|(?:임금|급여|월급)에\s*포함|분할\s*(?:하여\s*)?지급|매월\s*지급|중간\s*정산)")),
    "marriage_pregnancy": ("남녀고용평등법-제11조", "violation", _says(rf"(?:혼인|결혼|임신|출산){GAP}{{0,25}}?(?:퇴직|사직|퇴사)")),
    "wage_offset": ("근로기준법-제43조", "unfavorable", _says(rf"(?:임금|급여){GAP}{{0,30}}?(?:상계|공제){GAP}{{0,20}}?(?:대여금|가불|전차금)")),
    "break_time": ("근로기준법-제54조", "violation", _says(rf"휴게{GAP}{{0,20}}?(?:없|부여하지|미부여)")),
    "dismissal_written": ("근로기준법-제27조", "violation", _says(rf"해고{GAP}{{0,40}}?(?:구두|유선|전화|문자)(?:로만|로|만)?\s*(?:통보|통지|고지)|해고{GAP}{{0,30}}?서면{GAP}{{0,20}}?(?:하지\s*아니|않는다|생략|없이)")),
    "pay_cut": ("근로기준법-제95조", "violation", f"coalesce({_n(rf'(?:감봉|감급){GAP}{{0,30}}?{NUM}\s*(?:퍼센트|%)')} > 10, false) OR " + _says(rf"(?:감봉|감급){GAP}{{0,30}}?(?:제한\s*없|한도\s*없|회사가\s*정하는)")),
    "fixed_term": ("기간제법-제4조", "unfavorable", LONG_TERM),
    "fixed_term_renewal": ("기간제법-제4조", "violation", f"NOT coalesce({LONG_TERM}, false) AND " + _says(rf"(?:갱신|연장){GAP}{{0,30}}?(?:2년\s*초과|무기계약{GAP}{{0,15}}?(?:아니|않)|전환되지)")),
    "retaliation": ("근로기준법-제104조", "violation", _says(rf"(?:노동청|노동위원회|고용노동부|근로감독관|진정|신고|고발){GAP}{{0,40}}?(?:해고|징계|불이익|계약\s*해지|퇴사)")),
    "parental_leave": ("남녀고용평등법-제19조", "violation", _says(rf"육아휴직{GAP}{{0,40}}?(?:허용하지|불가|제외|거부|인정하지|해고|불이익)|육아휴직{GAP}{{0,30}}?(?:복직|복귀){GAP}{{0,20}}?(?:보장하지|아니)")),
    "rules_change": ("근로기준법-제94조", "violation", _says(rf"취업규칙{GAP}{{0,40}}?(?:동의\s*없이|일방적|회사가\s*단독|의견\s*청취{GAP}{{0,10}}?(?:없|생략))")),
    "discrimination": ("근로기준법-제6조", "violation", _says(rf"(?:국적|출신|신앙|종교|혼인\s*여부|학벌|출신지){GAP}{{0,30}}?(?:따라|이유로){GAP}{{0,25}}?(?:차등|차별|달리|제한)")),
    "harassment": ("근로기준법-제76조의2", "violation", _says(rf"(?:괴롭힘|폭언|따돌림|갑질){GAP}{{0,40}}?(?:문제\s*삼지|이의|책임지지|해당하지)|(?:괴롭힘|고충){GAP}{{0,30}}?(?:신고|제기){GAP}{{0,25}}?(?:금지|할\s*수\s*없|불이익)")),
    "maternity_leave": ("근로기준법-제74조", "violation", _says(rf"출산(?:전후)?\s*휴가{GAP}{{0,35}}?(?:부여하지|없|무급|제외|허용하지)|{BORN}") + f" AND coalesce({_n(BORN)} < 90, true)"),
    "spouse_leave": ("남녀고용평등법-제18조의2", "violation", _says(rf"배우자{GAP}{{0,20}}?출산{GAP}{{0,25}}?(?:휴가{GAP}{{0,15}}?(?:없|부여하지|무급)|불이익|해고)")),
    "job_interference": ("근로기준법-제40조", "violation", _says(rf"(?:재취업|이직|취업){GAP}{{0,30}}?(?:방해|명단|블랙리스트|통보하여)|(?:퇴사자|퇴직자){GAP}{{0,25}}?명단{GAP}{{0,25}}?(?:공유|통보|제공)")),
}
FINDINGS = LINES + ",\n    findings AS (" + " UNION ALL ".join(f"SELECT doc_id, clause_seq, {i} AS rule_ord, '{name}' AS rule, '{law}' AS law_id, '{sev}' AS severity FROM clauses WHERE {cond}" for i, (name, (law, sev, cond)) in enumerate(RULE_SQL.items())) + ")"


def _filled(text: str, value: str) -> str:
    """A message template as SQL."""
    fields = {"value": value, "hourly": f"CAST(round({value} / {P.MONTHLY_HOURS}.0) AS BIGINT)"}
    parts = [f"'{before}'" + (f" || format('{{:{form}}}', {fields[field]})" if field else "") for before, field, form in M.pieces(text)]
    return " || ".join(parts)


#: The numbers that messages state, as SQL over a clause's text.
VALUE_SQL = {
    "min_wage": _n(rf"시급\s*(?:금)?\s*{NUM}"),
    "min_wage_monthly": _n(rf"(?:월|월급|월\s*급여|임금)\s*(?:금)?\s*{NUM}\s*원"),
    "probation": _n(rf"수습{GAP}{{0,20}}?{NUM}\s*개월"),
    "annual_leave": f"coalesce({_n(LEAVE_1)}, {_n(LEAVE_2)})",
    "daily_hours": _n(rf"1\s*일\s*{NUM}\s*시간"),
    "weekly_hours": _n(rf"(?:1\s*주|주\s*간){GAP}{{0,10}}?{NUM}\s*시간"),
    "dismissal_notice": _n(rf"해고{GAP}{{0,30}}?{NUM}\s*일\s*전"),
    "settlement": _n(rf"퇴직{GAP}{{0,25}}?(?:임금|급여|금품){GAP}{{0,25}}?{NUM}\s*일\s*이내"),
    "pay_cut": _n(rf"(?:감봉|감급){GAP}{{0,30}}?{NUM}\s*(?:퍼센트|%)"),
    "fixed_term": _n(r"(?:계약|근로)\s*기간(?:[^.\n]{0,24}?[^0-9.\n])?([1-9])\s*년"),
}
#: When the message without a number is the one.
PLAIN_SQL = {"annual_leave": _says(rf"연차{GAP}{{0,20}}?(?:없|미지급|부여하지)"), "pay_cut": f"coalesce({VALUE_SQL['pay_cut']}, 0) <= 10"}


def _message(which: int) -> str:
    def one(name: str) -> str:
        full = _filled(M.RULE_MESSAGES[name][which], VALUE_SQL.get(name, "NULL"))
        return f"CASE WHEN {PLAIN_SQL[name]} THEN {_filled(M.PLAIN_MESSAGES[name][which], 'NULL')} ELSE {full} END" if name in PLAIN_SQL else full

    return "CASE rule " + " ".join(f"WHEN '{name}' THEN {one(name)}" for name in M.RULE_MESSAGES) + " END"


#: After FINDINGS: findings with what they say.
WORDED = f"worded AS (SELECT f.*, {_message(0)} AS reason, {_message(1)} AS suggestion FROM findings f JOIN clauses USING (doc_id, clause_seq))"
RISK = """
    n AS (SELECT c.doc_id, count(*) FILTER (severity = 'violation') AS violations, count(*) FILTER (severity = 'unfavorable') AS unfavorable FROM c LEFT JOIN findings USING (doc_id) GROUP BY c.doc_id)
    SELECT doc_id, violations, unfavorable, CAST(least(100, 25 * violations + 10 * unfavorable) AS INT) AS score,
           CASE WHEN 25 * violations + 10 * unfavorable = 0 THEN 'safe' WHEN 25 * violations + 10 * unfavorable <= 25 THEN 'caution'
                WHEN 25 * violations + 10 * unfavorable <= 60 THEN 'warning' ELSE 'danger' END AS grade FROM n"""


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(contracts(spark, sf_dir))


def clause_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article segmentation with titles, offsets and the signature block."""
    return _clauses(spark, sf_dir).select("doc_id", "clause_seq", "article_no", "title", "text", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on all clauses."""
    return rules.run_rules(_clauses(spark, sf_dir)).select("doc_id", "clause_seq", "rule_ord", "rule", "law_id", "severity")


def law_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, contracts and rules by law and severity."""
    return rules.run_rules(_clauses(spark, sf_dir)).groupBy("law_id", "severity").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("contracts"), F.count_distinct("rule").alias("rules"))


def contract_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and grade of every contract."""
    return report.risk_of(tiers.annotated(segment(contracts(spark, sf_dir), outer=True)))


def clause_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst finding of each clause with its place."""
    return report.highlights_of(tiers.annotated(_clauses(spark, sf_dir))).select("doc_id", "clause_seq", "severity", "law_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def report_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each contract's report."""
    return tiers.meta_of(tiers.annotated(_clauses(spark, sf_dir))).drop("by_model", "by_judge")


def unflagged_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that no rule catches, which go to the next tier."""
    return tiers.annotated(_clauses(spark, sf_dir)).where(F.size("hits") == 0).select("doc_id", "clause_seq", F.length("text").alias("n_chars"))


def review_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated review of each contract, as length and hash."""
    clauses = _clauses(spark, sf_dir)
    return report.review(clauses, rules.run_rules(clauses)).select("doc_id", F.length("markdown").alias("n_chars"), F.sha2("markdown", 256).alias("sha256"))


def numbered_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in the place of statutes: (id, law, article, title, text), by their number."""
    no = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("사용자는 "), "n_name", F.lit("의 기준을 지켜야 한다. 이를 어긴 약정은 그 부분에 한하여 무효로 한다."))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("근로기준법-제"), no, F.lit("조")).alias("id"), F.lit("근로기준법").alias("law"), F.concat(F.lit("제"), no, F.lit("조")).alias("article"), F.col("n_name").alias("title"), text.alias("text"))


def review_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole review of each contract with reasons, laws, quotes and suggestions, as length and hash; nations stand in for statutes."""
    found = rules.with_quotes(rules.worded(tiers.clause_hits(tiers.annotated(_clauses(spark, sf_dir)))), numbered_laws(spark, sf_dir))
    return report.opinion_of(found).select("doc_id", F.length("markdown").alias("n_chars"), F.sha2("markdown", 256).alias("sha256"))


def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and confidence by structure, and the features that decide."""
    seen = contracts(spark, sf_dir).withColumn("s", checks.structure(F.col("text"))).withColumn("v", checks.verdict(F.col("s")))
    sizes = [F.size(f"s.{c}").alias(f"n_{c}") for c in ("required_found", "parties", "contractor_signals", "title_markers", "execution_signals", "subordination_signals")]
    return seen.select("doc_id", "v.kind", "v.confidence", "s.titled_employment", "s.articles", *sizes)


def missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mandatory terms that employment contracts leave out."""
    kinds = contracts(spark, sf_dir).select("doc_id", checks.judged_structure(F.col("text")).alias("s")).select("doc_id", "s.kind", "s.structure")
    return checks.missing_terms(kinds).select("doc_id", F.array_join("missing", ",").alias("missing"))


def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability check of every contract."""
    c = contracts(spark, sf_dir).select("doc_id", checks.input_check(F.col("text")).alias("c"), order_score(F.col("text")).alias("order_score"))
    return c.select("doc_id", "c.reason", "c.weak", F.col("c.n_chars").alias("length"), F.col("c.n_terms").alias("terms"), "order_score")


def masked_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with names, companies and numbers masked, as hash, and the number of spans."""
    spans = masking.find_spans(contracts(spark, sf_dir))
    return spans.select("doc_id", F.size("spans").alias("n_spans"), F.sha2(masking.masked(F.col("text"), F.col("spans")), 256).alias("sha256"))


def pii_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each kind in each region of the contracts."""
    spans = masking.find_spans(contracts(spark, sf_dir))
    return spans.select("c_nationkey", F.explode(F.transform("spans", lambda s: s["kind"])).alias("kind")).groupBy("c_nationkey", "kind").agg(F.count("*").alias("n"))


def expected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one law (제27조) against the clauses that say its phrase; ``rule_scores`` has all rules and laws."""
    clauses = _clauses(spark, sf_dir)
    found = rules.run_rules(clauses).where("law_id = '근로기준법-제27조'").select("doc_id", "clause_seq", "law_id")
    expected = clauses.where(F.contains("text", F.lit("문자로 통보"))).select("doc_id", "clause_seq", F.lit("근로기준법-제27조").alias("law_id"))
    return evaluation.scores(evaluation.matched(found, expected, ["doc_id", "clause_seq", "law_id"]))


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings against labels that follow from the clause bank and its figures: scores by law, and in total with a null law."""
    keys = ["doc_id", "clause_seq", "law_id", "severity"]
    found = rules.run_rules(_clauses(spark, sf_dir))
    return evaluation.scores_by(evaluation.matched(found, labels(spark, sf_dir), keys), "law_id")


def _count_terms(terms: list[str], where: str = "text") -> str:
    return " + ".join(f"CAST(contains({where}, '{t}') AS INT)" for t in terms)


_REQUIRED = {k: "(" + " OR ".join(f"contains(text, '{w}')" for w in v) + ")" for k, v in P.REQUIRED_TERMS.items()}
_FEATURES = f"""f AS (SELECT doc_id, text, {" + ".join(f"CAST({e} AS INT)" for e in _REQUIRED.values())} AS n_required_found, {_count_terms(P.PARTIES)} AS n_parties,
      {_count_terms(P.CONTRACTOR)} AS n_contractor_signals, {_count_terms(P.EXECUTION)} AS n_execution_signals, {_count_terms(P.SUBORDINATION)} AS n_subordination_signals,
      contains(left(text, 200), '계약서') OR contains(left(text, 200), '계약을 체결') AS says,
      CASE WHEN contains(left(text, 200), '계약서') OR contains(left(text, 200), '계약을 체결') THEN 0 ELSE {_count_terms(P.TITLE_MARKERS, 'left(text, 200)')} END AS n_title_markers,
      {_count_terms(P.OTHER_DOCUMENT)} AS n_other, {_count_terms(P.STATUTE)} AS n_statute,
      len(list_filter(string_split(left(text, 200), chr(10)), lambda x: regexp_matches(x, '^[가-힣 ]*근로계약서$'))) > 0 AS titled_employment,
      CAST(len(regexp_extract_all(text, '제\\s*[0-9]+\\s*조')) AS INT) AS articles FROM c),
    v AS (SELECT *, CASE WHEN n_title_markers > 0 THEN 'other .9' WHEN n_statute >= 2 THEN 'other .85'
      WHEN n_execution_signals = 0 AND NOT (articles >= 2 AND n_required_found >= 2) AND NOT titled_employment THEN 'other .75'
      WHEN n_contractor_signals >= 3 AND n_subordination_signals >= 4 THEN 'employment .6'
      WHEN n_other >= 2 AND NOT says AND n_parties = 0 THEN 'other .7'
      WHEN n_parties > 0 AND n_contractor_signals >= 3 THEN 'contractor .55'
      WHEN n_parties > 0 THEN CASE WHEN n_other >= 2 AND NOT says THEN 'employment .7' ELSE 'employment .85' END
      WHEN n_contractor_signals >= 3 THEN 'contractor .7' WHEN n_required_found >= 3 THEN 'employment .45'
      WHEN says AND n_execution_signals > 0 THEN 'contractor .65' ELSE 'other .6' END AS v FROM f)"""
_MASKED = "replace(replace(regexp_replace(regexp_replace(text, '한빛[0-9]+상사', '[사업체명]', 'g'), '02-123-[0-9]{4}', '[연락처]', 'g'), '성명 : ' || '김' || doc_id || ' (서명)', '성명 : [성명] (서명)'), '', '')"

QUERIES = {f.__name__: f for f in (clause_segmentation, rule_findings, law_summary, contract_risk, clause_highlights, report_meta, unflagged_clauses, review_digest, review_opinions, document_types, missing_terms, contract_checks, masked_contracts, pii_by_kind, expected_findings, rule_scores)}
ORACLE_SQL = {
    "clause_segmentation": f"WITH {LINES} SELECT * FROM clauses",
    "rule_findings": f"WITH {FINDINGS} SELECT * FROM findings",
    "law_summary": f"WITH {FINDINGS} SELECT law_id, severity, count(*) AS findings, count(DISTINCT doc_id) AS contracts, count(DISTINCT rule) AS rules FROM findings GROUP BY law_id, severity",
    "contract_risk": f"WITH {FINDINGS}, {RISK}",
    "clause_highlights": f"""WITH {FINDINGS}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_seq ORDER BY CASE severity WHEN 'violation' THEN 0 ELSE 1 END, rule_ord) AS k FROM findings)
        SELECT doc_id, clause_seq, severity, law_id, start_at, end_at FROM w JOIN clauses USING (doc_id, clause_seq) WHERE k = 1""",
    "report_meta": f"""WITH {FINDINGS}, n AS (SELECT doc_id, count(DISTINCT clause_seq) AS flagged, count(*) FILTER (severity = 'violation') AS violations, count(*) FILTER (severity = 'unfavorable') AS unfavorable, count(*) AS by_rule FROM findings GROUP BY doc_id)
        SELECT doc_id, count(*) AS clauses, coalesce(any_value(flagged), 0) AS flagged, coalesce(any_value(violations), 0) AS violations, coalesce(any_value(unfavorable), 0) AS unfavorable, coalesce(any_value(by_rule), 0) AS by_rule
        FROM clauses LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "unflagged_clauses": f"WITH {FINDINGS} SELECT doc_id, clause_seq, CAST(length(text) AS INT) AS n_chars FROM clauses WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.doc_id = clauses.doc_id AND f.clause_seq = clauses.clause_seq)",
    "review_digest": f"""WITH {FINDINGS}, f AS (SELECT doc_id, clause_seq, min(CASE severity WHEN 'violation' THEN 0 ELSE 1 END) AS worst,
            string_agg(chr(10) || '- ' || rule || ': ' || law_id || ' (' || severity || ')', '' ORDER BY CASE severity WHEN 'violation' THEN 0 ELSE 1 END, rule_ord) AS lines FROM findings GROUP BY ALL),
        m AS (SELECT doc_id, string_agg('### ' || CASE WHEN worst = 0 THEN '🔴 ' WHEN worst = 1 THEN '🟡 ' ELSE '' END || CASE WHEN article_no IS NULL THEN title ELSE '제' || article_no || '조 ' || title END || chr(10) || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || coalesce(lines, ''), chr(10) || chr(10) ORDER BY clause_seq) AS m
              FROM clauses LEFT JOIN f USING (doc_id, clause_seq) GROUP BY doc_id)
        SELECT doc_id, CAST(length(m) AS INT) AS n_chars, sha256(m) AS sha256 FROM m""",
    "review_opinions": f"""WITH {FINDINGS}, {WORDED}, quoted AS (SELECT worded.*, coalesce(CASE WHEN n_name IS NOT NULL THEN CASE WHEN rule IN ('daily_hours', 'retaliation', 'fixed_term_renewal', 'marriage_pregnancy', 'probation', 'parental_leave')
                THEN '이를 어긴 약정은 그 부분에 한하여 무효로 한다.' ELSE '사용자는 ' || n_name || '의 기준을 지켜야 한다.' END END, '') AS quote
            FROM worded LEFT JOIN nation ON law_id = '근로기준법-제' || n_nationkey || '조'),
        below AS (SELECT doc_id, clause_seq, min(CASE severity WHEN 'violation' THEN 0 ELSE 1 END) AS worst,
            string_agg('**문제** — ' || reason || chr(10) || chr(10) || '**근거** — ' || law_id || chr(10) || '> ' || quote || chr(10) || chr(10) || '**수정 제안** — ' || suggestion || chr(10) || chr(10), '' ORDER BY CASE severity WHEN 'violation' THEN 0 ELSE 1 END, rule_ord) AS said FROM quoted GROUP BY ALL),
        pieces AS (SELECT doc_id, clause_seq, '## ' || CASE WHEN worst = 0 THEN '🔴' WHEN worst = 1 THEN '🟡' ELSE '' END || ' ' || CASE WHEN article_no > 0 THEN '제' || article_no || '조 ' || title ELSE title END
            || chr(10) || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(said, '') || chr(10) AS part FROM clauses LEFT JOIN below USING (doc_id, clause_seq)),
        whole AS (SELECT doc_id, '{M.REVIEW_HEAD}' || string_agg(part, '' ORDER BY clause_seq) || '{M.REVIEW_FOOT}' AS m FROM pieces GROUP BY doc_id)
        SELECT doc_id, CAST(length(m) AS INT) AS n_chars, sha256(m) AS sha256 FROM whole""",
    "document_types": f"WITH c AS ({CONTRACTS_SQL}), {_FEATURES} SELECT doc_id, split_part(v, ' ', 1) AS kind, CAST('0' || split_part(v, ' ', 2) AS DOUBLE) AS confidence, titled_employment, articles, n_required_found, n_parties, n_contractor_signals, n_title_markers, n_execution_signals, n_subordination_signals FROM v",
    "missing_terms": f"""WITH c AS ({CONTRACTS_SQL}), {_FEATURES}, m AS (SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN NOT {_REQUIRED[k]} THEN '{k}' END" for k in P.MANDATORY)}) AS missing FROM v WHERE v LIKE 'employment%')
        SELECT doc_id, missing FROM m WHERE missing <> ''""",
    "contract_checks": f"""WITH c AS ({CONTRACTS_SQL}), n AS (SELECT doc_id, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS INT) AS length, CAST({_count_terms(P.CONTRACT_TERMS)} AS INT) AS terms FROM c)
        SELECT doc_id, CASE WHEN length < 50 THEN 'too_short' WHEN terms < 3 THEN 'not_contract' ELSE 'ok' END AS reason, CASE WHEN length >= 50 AND terms >= 3 THEN terms < 6 OR length < 200 END AS weak, length, terms, CAST(1.0 AS DOUBLE) AS order_score FROM n""",
    "masked_contracts": f"WITH c AS ({CONTRACTS_SQL}) SELECT doc_id, CASE WHEN contains(text, '(사업주)') THEN 3 ELSE 0 END AS n_spans, sha256({_MASKED}) AS sha256 FROM c",
    "pii_by_kind": f"WITH c AS ({CONTRACTS_SQL}) SELECT c_nationkey, kind, count(*) AS n FROM c, (VALUES ('성명'), ('사업체명'), ('연락처')) AS k(kind) WHERE contains(text, '(사업주)') GROUP BY ALL",
    "expected_findings": f"""WITH {FINDINGS}, q AS (SELECT DISTINCT doc_id, clause_seq FROM findings WHERE law_id = '근로기준법-제27조'), e AS (SELECT DISTINCT doc_id, clause_seq FROM clauses WHERE contains(text, '문자로 통보')),
        n AS (SELECT (SELECT count(*) FROM q JOIN e USING (doc_id, clause_seq)) AS tp, (SELECT count(*) FROM q ANTI JOIN e USING (doc_id, clause_seq)) AS fp, (SELECT count(*) FROM e ANTI JOIN q USING (doc_id, clause_seq)) AS fn)
        SELECT tp, fp, fn, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1 FROM n""",
}
