"""Queries over the joined tiers, votes, replies and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import messages as M
from pactum.functions import patterns as P
from pactum.functions import text as T
from pactum.operators import checks, classifier, evaluation, masking, report, retrieval, rules, screens, tiers
from pactum.operators.judging import quarantined
from pactum.operators.segmentation import segment
from pactum.plans.contracts import _FEATURES, CONTRACTS_SQL, FINDINGS, LINES, WORDED, numbered_laws
from pactum.plans.texts import MAIL
from pactum.sources.derived import TITLES, contracts

#: A stand-in for a fitted model, so that SQL can say the same: words of a clause, the label and its confidence.
SPOKEN = [("같은 업종", "근로기준법-제40조", 0.55), ("출퇴근", "근로기준법-제6조", 0.9), ("수급인", "NORMAL", 0.9), ("담당업무", "근로기준법-제17조", 0.3)]
ASKED = "일요일"
MISSING = f"'{P.MISSING_LAW}'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _model(clauses: DataFrame) -> DataFrame:
    spark = clauses.sparkSession
    label, confidence = F.lit("NORMAL"), F.lit(1.0)
    for words, name, p in SPOKEN:
        label, confidence = F.when(F.contains("text", F.lit(words)), name).otherwise(label), F.when(F.contains("text", F.lit(words)), p).otherwise(confidence)
    laws = sorted({r.law_id for r in rules.RULES})
    known, info = spark.createDataFrame([(x,) for x in laws], "id string"), spark.createDataFrame([(x, "violation", f"{x} 참고.", "수정") for x in laws], "law_id string, severity string, reason string, suggestion string")
    return classifier.with_model_hit(clauses.withColumn("predicted", label).withColumn("confidence", confidence), known, info, [])


def _judge(clauses: DataFrame) -> DataFrame:
    found = F.struct(F.lit(2000).alias("rule_ord"), F.lit("judge").alias("rule"), F.lit("근로기준법-제55조").alias("law_id"), F.lit("unfavorable").alias("severity"), F.lit(0).alias("sentence"), F.lit("llm").alias("source"), F.lit("휴일 확인").alias("reason"))
    return clauses.withColumn("hit", F.when(F.contains("text", F.lit(ASKED)), found))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.annotated(segment(contracts(spark, sf_dir)), model=_model, judge=_judge)


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all tiers and of whole documents, in their order: one scan of the contracts."""
    docs = contracts(spark, sf_dir).withColumn("whole", T.bound(checks.judged_structure(F.col("text")), lambda s: tiers.whole_hit(s["kind"], s["structure"])))
    rows = tiers.annotated(segment(docs, carry=("whole",), outer=True), model=_model, judge=_judge)
    return rules.worded(tiers.placed(tiers.hit_rows(rows, "whole"))).select("doc_id", "position", "clause_seq", "rule", "law_id", "severity", "source", "reason", "suggestion")


def tier_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each report by severity and tier."""
    return tiers.meta_of(_annotated(spark, sf_dir))


def screen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses flagged and clean, and claims that the gate dropped: here those of a judge that quotes a neighbouring clause."""
    clauses = segment(contracts(spark, sf_dir))
    said = clauses.select("doc_id", "clause_seq", F.concat_ws("/", "doc_id", "clause_seq").alias("query_id"), "text", F.lit("violation").alias("severity"), F.concat_ws("/", "doc_id", F.col("clause_seq") + F.col("doc_id") % 2).alias("law_id"), F.substring("text", 1, 20).alias("quote"), F.lit("").alias("reason"))
    passed = retrieval.judged(said, said.select("query_id", "law_id"), said.select(F.col("query_id").alias("id"), "text"))
    return tiers.screen(tier_meta(spark, sf_dir), quarantined(passed))


def card_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that speak of leave or quitting, by what was found in them."""
    found = _annotated(spark, sf_dir)
    rows = tiers.cards_of(found, search="휴가").withColumn("search", F.lit("휴가")).unionByName(tiers.cards_of(found, "violation", "퇴사 ").withColumn("search", F.lit("퇴사")))
    return rows.groupBy("search", "status").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("contracts"))


def finding_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with labels and titles. Nations stand in for statutes, by their number; laws of other numbers have no label."""
    rows = _annotated(spark, sf_dir)
    laws = _table(spark, sf_dir, "nation").select(F.concat(F.lit("근로기준법-제"), F.col("n_nationkey"), F.lit("조")).alias("id"), F.lit("근로기준법").alias("law"), F.concat(F.lit("제"), F.col("n_nationkey"), F.lit("조")).alias("article"), F.col("n_name").alias("title"), F.col("n_name").alias("text"))
    return tiers.enriched(tiers.hit_rows(rows), rows, laws).select("doc_id", "clause_seq", "rule", "source_label", "clause_title", F.length("clause_text").alias("n_chars"), "law_label", F.length("law_text").alias("n_law"))


def vote_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each contract by structure and by the vote of its sentences."""
    docs = contracts(spark, sf_dir).select("doc_id", "text", checks.structure(F.col("text")).alias("structure"))
    docs = docs.withColumn("verdict", checks.verdict(F.col("structure")))
    sentences = docs.select("doc_id", F.posexplode(T.document_sentences(F.col("text"))).alias("pos", "s"))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains("s", w))
    label = F.when(has("수급인", "대금"), "contractor").when(has("근로", "해고"), "employment").otherwise("other")
    votes = checks.sentence_vote(sentences.select("doc_id", "pos", label.alias("label"), F.when(has("회사"), 0.3).otherwise(0.8).alias("confidence")))
    out = checks.combined(docs, votes)
    return out.select("doc_id", "kind", "confidence", "disguise_warning", "votes", F.round("top_share", 6).alias("top_share"), "top")


def type_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by structure against what the titles say, by kind and in all."""
    kind = checks.verdict(checks.structure(F.col("text")))["kind"]
    said = F.element_at(F.array(*(F.lit("employment" if "근로" in t else "contractor" if "용역" in t else "other") for t in TITLES)), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    rows = contracts(spark, sf_dir).select(kind.alias("predicted"), said.alias("expected"))
    return evaluation.accuracy_by(rows, "predicted", "expected")


def probe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts as probes: those with a penalty should be caught, by rules alone."""
    docs = contracts(spark, sf_dir)
    return evaluation.probe_outcomes(docs.select("doc_id", F.contains("text", F.lit("위약금")).alias("should_catch")), tiers.tiered(segment(docs)))


def judge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw replies of a judge, in fences and between stray braces, parsed and passed through the citation gate."""
    b = _table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    says = F.element_at(F.array(*map(F.lit, ("violation", "unfavorable", "ok", "strange"))), (i % 4 + 1).cast("int"))
    quote = F.substring("text", 6, F.lit(4) + (i % 3 * 10).cast("int"))
    reply = F.to_json(F.struct(says.alias("severity"), i.cast("string").alias("law_id"), F.when(i % 7 == 0, F.reverse(quote)).otherwise(quote).alias("quote"), F.lit("a {brace} in it").alias("reason")))
    raw = F.when(i % 4 == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).when(i % 4 == 2, F.concat(F.lit("so {not json} } then "), reply, F.lit(' and {"severity": "ok"}'))).when(i % 11 == 0, F.lit("nothing {")).otherwise(reply)
    replies = b.select(i.alias("query_id"), retrieval.parsed_reply(raw).alias("r")).select("query_id", "r.*")
    offered = b.where(i % 5 > 0).select(i.alias("query_id"), i.cast("string").alias("law_id"))
    return retrieval.judged(replies, offered, b.select(i.cast("string").alias("id"), "text")).select("query_id", "severity", "claimed", "gate_passed")


def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from benchmark passages with themselves and the next ones as statutes, as length and hash."""
    b = _table(spark, sf_dir, "benchmark")
    laws = b.select(F.col("item_id").alias("id"), F.lit("law").alias("law"), F.col("item_id").cast("string").alias("article"), F.lit("t").alias("title"), "text")
    offered = b.select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("query_id", (F.col("query_id") + F.col("k")).alias("law_id"), (F.col("k") + 1).alias("rank"))
    out = retrieval.prompts(b.select(F.col("item_id").alias("query_id"), "text"), offered, laws, "Clause:\n{clause}\n\nLaws:\n{laws}\n")
    return out.select("query_id", F.length("prompt").alias("n_chars"), F.sha2("prompt", 256).alias("sha256"))


def sentence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of contracts as documents and as laws, the plain ones among these, and the text with its synonyms."""
    t = F.col("text")
    joined = lambda parts: F.sha2(F.array_join(parts, "|"), 256)
    return contracts(spark, sf_dir).select("doc_id", joined(T.document_sentences(t)).alias("sentences"), joined(T.law_sentences(t)).alias("law_sentences"), joined(T.plain_law_sentences(t)).alias("plain_sentences"), F.sha2(T.expanded(t), 256).alias("expanded"))


def normal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of training rows: kinds of contracts by title, and plain sentences of the others as NORMAL."""
    docs = contracts(spark, sf_dir)
    labelled = docs.where("doc_id % 5 < 2").select("text", F.lit("employment").alias("label"))
    return tiers.label_histogram(tiers.training_rows(labelled, docs.where("doc_id % 5 >= 2")))


def fallback_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of texts without articles: paragraphs, else list items, else lines, with titles and exact places."""
    d = _table(spark, sf_dir, "documents").select("doc_id", T.clean_contract(F.col("text")).alias("t"))
    found = segment(d, text_col="t").join(d, "doc_id")
    there = F.substring("t", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return found.select("doc_id", "clause_seq", F.length("text").alias("n_chars"), "title", there.alias("in_place"))


def tidy_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text tidied, as length and hash."""
    t = T.tidy_ocr(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n_chars"), F.sha2(t, 256).alias("sha256"))


def masking_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that says what was hidden in each contract."""
    return masking.find_spans(contracts(spark, sf_dir)).select("doc_id", masking.summary(F.col("spans")).alias("summary"))


def block_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts whose score isn't shown, by why, and the title that is shown for it."""
    docs = contracts(spark, sf_dir).select("doc_id", checks.input_check(F.col("text")).alias("c"), checks.verdict(checks.structure(F.col("text"))).alias("v"))
    return docs.select("doc_id", screens.blocked(F.col("c"), F.col("v")).alias("b")).select("doc_id", F.col("b").isNotNull().alias("blocked"), "b.why", "b.title")


def page_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files with a page for each turn: what of the first three pages would be hidden (mail addresses)."""
    turns = _table(spark, sf_dir, "conversations")
    files = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("total_pages")).select(F.col("conv_id").alias("doc_id"), "total_pages", F.when(F.col("conv_id") % 10 == 3, "unreadable").alias("error"))
    words = turns.where("conv_id % 10 <> 4").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.posexplode(F.split("text", " ")).alias("i", "text"))
    x0, top = (F.col("i") % 10) * 50.0, F.floor(F.col("i") / 10) * 12.0
    placed = words.withColumns({"x0": x0, "x1": x0 + 40.0, "top": top, "bottom": top + 10.0})
    out = screens.page_previews(files, placed, [("이메일", MAIL)], None)
    boxes = F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + p["boxes"])
    return out.select("doc_id", "ok", "reason", F.size("pages").alias("n_pages"), boxes.alias("n_boxes"), F.coalesce(F.try_element_at("counts", F.lit("이메일")), F.lit(0)).cast("long").alias("n_mails"), "total_pages", "truncated")


def system_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the statutes in use (nations stand in, those of one region verified), the rules and the labels of the language model."""
    laws = numbered_laws(spark, sf_dir).join(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), (F.col("n_regionkey") == 1).alias("verified")), "title")
    return screens.system_info(laws)


QUERIES = {f.__name__: f for f in (block_decisions, page_previews, system_state, full_report, tier_meta, screen_counts, card_counts, finding_cards, vote_combined, type_accuracy, probe_counts, judge_gate, judge_prompts, sentence_texts, normal_rows, fallback_clauses, tidy_readings, masking_summaries)}

_RULE_LAWS = ", ".join(f"'{x}'" for x in sorted({r.law_id for r in rules.RULES}))
_SPOKEN = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN {{}}" for w, _, _ in SPOKEN[::-1]) + " END"
_LABEL, _SURE = (_SPOKEN.format(*(f"'{row[k]}'" if k == 1 else row[k] for row in SPOKEN[::-1])) for k in (1, 2))
_TIERS = f"""{FINDINGS},
    left1 AS (SELECT * FROM clauses c WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.doc_id = c.doc_id AND f.clause_seq = c.clause_seq)),
    model AS (SELECT doc_id, clause_seq, 1000 AS rule_ord, 'model' AS rule, {_LABEL} AS law_id, CASE WHEN {_SURE} < 0.6 THEN 'unfavorable' ELSE 'violation' END AS severity, 'model' AS source
              FROM left1 WHERE length(text) >= 25 AND {_SURE} >= 0.5 AND {_LABEL} IN ({_RULE_LAWS})),
    judge AS (SELECT doc_id, clause_seq, 2000 AS rule_ord, 'judge' AS rule, '근로기준법-제55조' AS law_id, 'unfavorable' AS severity, 'llm' AS source
              FROM left1 c WHERE contains(text, '{ASKED}') AND NOT EXISTS (SELECT 1 FROM model f WHERE f.doc_id = c.doc_id AND f.clause_seq = c.clause_seq)),
    found AS (SELECT *, 'rule' AS source FROM findings UNION ALL SELECT * FROM model UNION ALL SELECT * FROM judge)"""
_META = f"""n AS (SELECT doc_id, count(DISTINCT clause_seq) AS flagged, count(*) FILTER (severity = 'violation') AS violations, count(*) FILTER (severity = 'unfavorable') AS unfavorable,
        count(*) FILTER (source = 'rule') AS by_rule, count(*) FILTER (source = 'model') AS by_model, count(*) FILTER (source = 'llm') AS by_judge FROM found GROUP BY doc_id),
    meta AS (SELECT doc_id, count(*) AS clauses, {", ".join(f"coalesce(any_value({x}), 0) AS {x}" for x in ("flagged", "violations", "unfavorable", "by_rule", "by_model", "by_judge"))} FROM clauses LEFT JOIN n USING (doc_id) GROUP BY doc_id)"""
_REQUIRED = {k: "(" + " OR ".join(f"contains(text, '{w}')" for w in v) + ")" for k, v in P.REQUIRED_TERMS.items()}
_SP = "[ \\t\\n\\r\\f\\v]"
_STRIP = f"regexp_replace({{}}, '^{_SP}+|{_SP}+$', '', 'g')"
_CLEAN = _STRIP.format("regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '　', ' '), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_LAW = f"list_filter(list_transform(string_split(regexp_replace(text, '(다[.])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 11)"
_DOC = f"list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda y: string_split(regexp_replace(y, '([다함][.])\\s+', '\\1' || chr(1), 'g'), chr(1)))), lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 6)"
_EXPANDED = "concat_ws(' ', text, " + ", ".join(f"CASE WHEN contains(text, '{k}') THEN '{v}' END" for k, v in P.SYNONYMS.items()) + ")"
_Q = """regexp_replace({}, '[\\s·ㆍ,."''“”‘’「」()\\[\\]]', '', 'g')"""


def _parts(pattern: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(t, '{pattern}', chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 8)"


ORACLE_SQL = {
    "block_decisions": f"""WITH c AS ({CONTRACTS_SQL}), {_FEATURES}, n AS (SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, {" + ".join(f"CAST(contains(text, '{t}') AS INT)" for t in P.CONTRACT_TERMS)} AS terms, split_part(v, ' ', 1) AS kind FROM v),
        w AS (SELECT doc_id, CASE WHEN n < 50 THEN 'too_short' WHEN terms < 3 THEN 'not_contract' WHEN kind = 'employment' THEN NULL ELSE kind END AS why FROM n)
        SELECT doc_id, why IS NOT NULL AS blocked, why, CASE why WHEN 'contractor' THEN '{screens.NOT_EMPLOYMENT["contractor"]}' WHEN 'other' THEN '{screens.NOT_EMPLOYMENT["other"]}' END AS title FROM w""",
    "page_previews": """WITH t AS (SELECT conv_id AS doc_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]+')) AS m, conv_id % 10 <> 4 AND turn < 3 AND text IS NOT NULL AS seen FROM conversations),
        d AS (SELECT doc_id, max(turn) + 1 AS total_pages, count(*) FILTER (seen) AS pages, coalesce(sum(m) FILTER (seen), 0) AS mails, CASE WHEN doc_id % 10 = 3 THEN 'error' WHEN count(*) FILTER (seen) = 0 THEN 'scanned' ELSE 'ok' END AS reason FROM t GROUP BY doc_id)
        SELECT doc_id, reason = 'ok' AS ok, reason, CAST(CASE WHEN reason = 'ok' THEN pages ELSE 0 END AS INT) AS n_pages, CAST(CASE WHEN reason = 'ok' THEN mails ELSE 0 END AS BIGINT) AS n_boxes, CAST(CASE WHEN reason = 'ok' THEN mails ELSE 0 END AS BIGINT) AS n_mails,
            total_pages, reason = 'ok' AND total_pages > 3 AS truncated FROM d""",
    "system_state": "SELECT count(*) AS law_count, count(*) FILTER (n_regionkey <> 1) AS unverified, 26 AS rule_count, false AS classifier_loaded, 0 AS classifier_classes, 10320 AS min_wage, 2026 AS min_wage_year FROM nation",
    "full_report": f"""WITH {_TIERS}, {WORDED}, {_FEATURES}, gone AS (SELECT doc_id, concat_ws(', ', {", ".join(f"CASE WHEN NOT {_REQUIRED[k]} THEN '{k}' END" for k in P.MANDATORY)}) AS missing FROM v WHERE v LIKE 'employment%'),
        whole AS (SELECT doc_id, CAST(NULL AS INT) AS clause_seq, 0 AS rule_ord, 'missing_terms' AS rule, {MISSING} AS law_id, 'violation' AS severity, 'rule' AS source,
            {M.MISSING_MESSAGE[0].replace("{missing}", "' || missing || '").join("''")} AS reason, '{M.MISSING_MESSAGE[1]}' AS suggestion FROM gone WHERE missing <> ''),
        u AS (SELECT *, 'rule' AS source FROM worded UNION ALL BY NAME SELECT * FROM whole
            UNION ALL BY NAME SELECT model.*, CASE WHEN severity = 'unfavorable' THEN '{M.UNSURE}' ELSE '' END || law_id || ' 참고. (분류기 확신도 ' || CAST(round({_SURE} * 100) AS INT) || '%)' AS reason, '수정' AS suggestion FROM model JOIN clauses USING (doc_id, clause_seq)
            UNION ALL BY NAME SELECT *, '휴일 확인' AS reason, '' AS suggestion FROM judge)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY clause_seq IS NULL, severity <> 'violation', CASE source WHEN 'rule' THEN 0 WHEN 'model' THEN 1 ELSE 2 END, clause_seq, rule_ord) AS INT) AS position, clause_seq, rule, law_id, severity, source, reason, suggestion FROM u""",
    "tier_meta": f"WITH {_TIERS}, {_META} SELECT * FROM meta",
    "screen_counts": f"""WITH {_TIERS}, {_META}, said AS (SELECT doc_id, clause_seq, {_Q.format("substring(text, 1, 20)")} AS q, clause_seq + doc_id % 2 AS other FROM clauses),
        gate AS (SELECT said.doc_id, length(q) >= 12 AND coalesce(contains({_Q.format("o.text")}, q), false) AS passed FROM said LEFT JOIN clauses o ON o.doc_id = said.doc_id AND o.clause_seq = other),
        gone AS (SELECT doc_id, count(*) AS dropped FROM gate WHERE NOT passed GROUP BY doc_id)
        SELECT doc_id, clauses AS total, flagged, greatest(clauses - flagged, 0) AS clean, coalesce(dropped, 0) AS dropped FROM meta LEFT JOIN gone USING (doc_id)""",
    "card_counts": f"""WITH {_TIERS}, s AS (SELECT doc_id, clause_seq, title || ' ' || text AS t, CASE min(CASE severity WHEN 'violation' THEN 0 WHEN 'unfavorable' THEN 1 END) WHEN 0 THEN 'violation' WHEN 1 THEN 'unfavorable' ELSE 'ok' END AS status
            FROM clauses LEFT JOIN found USING (doc_id, clause_seq) GROUP BY ALL)
        SELECT search, status, count(*) AS n, count(DISTINCT doc_id) AS contracts FROM s, (VALUES ('휴가'), ('퇴사')) AS w(search) WHERE contains(t, search) AND (search = '휴가' OR status = 'violation') GROUP BY ALL""",
    "finding_cards": f"""WITH {_TIERS} SELECT doc_id, clause_seq, rule, CASE source WHEN 'rule' THEN '룰 검사' WHEN 'model' THEN '학습 모델' ELSE 'LLM 판정' END AS source_label,
            CASE WHEN article_no > 0 THEN '제' || article_no || '조 ' || title ELSE title END AS clause_title, CAST(length(text) AS INT) AS n_chars,
            coalesce('근로기준법 제' || n_nationkey || '조(' || n_name || ')', '') AS law_label, CAST(coalesce(length(n_name), 0) AS INT) AS n_law
        FROM found JOIN clauses USING (doc_id, clause_seq) LEFT JOIN nation ON law_id = '근로기준법-제' || n_nationkey || '조'""",
    "vote_combined": f"""WITH c AS ({CONTRACTS_SQL}), {_FEATURES}, s AS (SELECT doc_id, unnest({_DOC}) AS s, generate_subscripts({_DOC}, 1) AS pos FROM c),
        l AS (SELECT doc_id, pos, CASE WHEN regexp_matches(s, '수급인|대금') THEN 'contractor' WHEN regexp_matches(s, '근로|해고') THEN 'employment' ELSE 'other' END AS label FROM s WHERE NOT contains(s, '회사')),
        b AS (SELECT doc_id, label, count(*) AS n, min(pos) AS first FROM l GROUP BY ALL),
        t AS (SELECT doc_id, sum(n)::BIGINT AS votes, max(n) / sum(n) AS top_share, coalesce(sum(n) FILTER (label = 'contractor'), 0) / sum(n) AS share, first(label ORDER BY n DESC, first) AS top FROM b GROUP BY doc_id),
        k AS (SELECT v.*, t.* EXCLUDE (doc_id), split_part(v, ' ', 1) AS kind0, CAST('0' || split_part(v, ' ', 2) AS DOUBLE) AS c0 FROM v LEFT JOIN t USING (doc_id)),
        z AS (SELECT *, top IS NOT NULL AND top_share >= 0.55 AND c0 <= 0.5 AS turns FROM k),
        y AS (SELECT *, CASE WHEN turns THEN top ELSE kind0 END AS kind FROM z)
        SELECT doc_id, kind, round(CASE WHEN top IS NULL THEN c0 WHEN top = kind0 THEN least(c0 + 0.1, 0.95) WHEN turns THEN least(top_share, 0.55) ELSE greatest(c0 - 0.1, 0.4) END, 2) AS confidence,
            n_contractor_signals >= 3 AND n_subordination_signals >= 4 OR n_parties > 0 AND coalesce(share, 0) >= 0.3 AND kind <> 'other' AS disguise_warning, votes, round(top_share, 6) AS top_share, top FROM y""",
    "type_accuracy": f"""WITH c AS ({CONTRACTS_SQL}), {_FEATURES}, r AS (SELECT split_part(v, ' ', 1) AS predicted, CASE WHEN starts_with(text, '표준근로') OR starts_with(text, '근로') THEN 'employment' WHEN starts_with(text, '용역') THEN 'contractor' ELSE 'other' END AS expected FROM v)
        SELECT expected, count(*) FILTER (predicted = expected) AS right, count(*) AS n, count(*) FILTER (predicted = expected) / count(*) AS accuracy FROM r GROUP BY ROLLUP (expected)""",
    "probe_counts": f"""WITH {FINDINGS}, tried AS (SELECT contains(text, '위약금') AS should, doc_id IN (SELECT doc_id FROM findings) AS caught FROM c)
        SELECT count(*) FILTER (should = caught) AS passed, count(*) FILTER (should AND NOT caught) AS missed, count(*) FILTER (caught AND NOT should) AS false_alarms FROM tried""",
    "judge_gate": f"""WITH a AS (SELECT item_id AS i, text, substring(text, 6, 4 + item_id % 3 * 10) AS q FROM benchmark),
        b AS (SELECT *, CASE WHEN i % 4 IN (1, 2) OR i % 11 > 0 THEN CASE i % 4 WHEN 0 THEN 'violation' WHEN 1 THEN 'unfavorable' ELSE 'ok' END ELSE 'ok' END AS claimed, CASE WHEN i % 7 = 0 THEN reverse(q) ELSE q END AS quote FROM a),
        g AS (SELECT i, claimed, claimed = 'ok' OR i % 5 > 0 AND length({_Q.format("quote")}) >= 12 AND contains({_Q.format("text")}, {_Q.format("quote")}) AS passed FROM b)
        SELECT i AS query_id, CASE WHEN passed THEN claimed ELSE 'ok' END AS severity, claimed, passed AS gate_passed FROM g""",
    "judge_prompts": """WITH b AS (SELECT item_id, 'id: ' || item_id || chr(10) || 'law ' || item_id || '(t)' || chr(10) || text AS block FROM benchmark),
        p AS (SELECT a.item_id, 'Clause:' || chr(10) || any_value(a.text) || chr(10) || chr(10) || 'Laws:' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY b.item_id) || chr(10) AS p FROM benchmark a JOIN b ON b.item_id BETWEEN a.item_id AND a.item_id + 2 GROUP BY a.item_id)
        SELECT item_id AS query_id, CAST(length(p) AS INT) AS n_chars, sha256(p) AS sha256 FROM p""",
    "sentence_texts": f"""WITH c AS ({CONTRACTS_SQL}) SELECT doc_id, sha256(array_to_string({_DOC}, '|')) AS sentences, sha256(array_to_string({_LAW}, '|')) AS law_sentences,
        sha256(array_to_string(list_filter({_LAW}, lambda s: length(s) BETWEEN 15 AND 120 AND NOT starts_with(s, '다만')), '|')) AS plain_sentences, sha256({_EXPANDED}) AS expanded FROM c""",
    "normal_rows": f"""WITH c AS ({CONTRACTS_SQL}), s AS (SELECT unnest({_LAW}) AS s FROM c WHERE doc_id % 5 >= 2), r AS (SELECT 'employment' AS label FROM c WHERE doc_id % 5 < 2 UNION ALL SELECT 'NORMAL' FROM s WHERE length(s) BETWEEN 15 AND 120 AND NOT starts_with(s, '다만'))
        SELECT label, count(*) AS n FROM r GROUP BY label""",
    "fallback_clauses": f"""WITH d AS (SELECT doc_id, {_CLEAN} AS t FROM documents), w AS (SELECT doc_id, {_parts('\\n\\s*\\n')} AS a, {_parts('(?m)' + P.ITEM)} AS b, {_parts('\\n')} AS l FROM d),
        p AS (SELECT doc_id, CASE WHEN len(a) >= 2 THEN a WHEN len(b) >= 2 THEN b ELSE l END AS p FROM w), q AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p)
        SELECT doc_id, CAST(i AS INT) AS clause_seq, CAST(length(x) AS INT) AS n_chars, left(split_part(x, chr(10), 1), 30) AS title, true AS in_place FROM q""",
    "tidy_readings": f"""WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(replace(text, chr(13), ''), '[ \\t]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), chr(10)) AS t FROM documents),
        r AS (SELECT doc_id, {_STRIP.format("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM l) SELECT doc_id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS sha256 FROM r""",
    "masking_summaries": f"WITH c AS ({CONTRACTS_SQL}) SELECT doc_id, CASE WHEN contains(text, '(사업주)') THEN '민감정보 3건을 가렸습니다 (사업체명 1건, 연락처 1건, 성명 1건).' ELSE '' END AS summary FROM c",
}
