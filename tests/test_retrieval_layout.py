from __future__ import annotations

import math

from pyspark.sql import functions as F

from pactum.operators import classifier, evaluation, layout, retrieval


def test_bm25_against_plain_python(spark):
    corpus = {"a": "임금 지급 임금", "b": "휴일 휴가", "c": "임금 휴일 해고", "d": "", "e": "해고 예고"}
    frame = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(corpus.items())], "law_id string, pos int, body string")
    grams = lambda t: [w for w in t.split()] + [w[i : i + 2] for w in t.split() for i in range(len(w) - 1)]
    docs = {k: grams(v) for k, v in corpus.items()}
    n, av = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    q = "임금 해고 임금"
    want = {k: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / av)) for t in grams(q)) for k, d in docs.items()}
    got = retrieval.bm25_search(retrieval.bm25_index(frame), spark.createDataFrame([(1, q)], "query_id int, text string")).collect()
    ranked = sorted(((-round(s, 9), list(corpus).index(k), k) for k, s in want.items() if s > 0))[:4]
    assert [(r.law_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(k, i + 1) for i, (_, _, k) in enumerate(ranked)]
    assert all(abs(r.score - want[r.law_id]) < 1e-6 for r in got)


def test_gate(spark):
    laws = spark.createDataFrame([("L1", "사용자는 임금을 매월 1회 이상 지급하여야 한다.")], "id string, text string")
    offered = spark.createDataFrame([(1, "L1"), (2, "L1"), (3, "L1"), (4, "L1")], "query_id int, law_id string")
    replies = spark.createDataFrame(
        [(1, "violation", "L1", "임금을 매월 1회 이상 지급하여야", "r"), (2, "violation", "L1", "임금을 지급하지 아니하여도 되는 것", "r"), (3, "violation", "L1", "임금을", "r"), (4, "nonsense", "L1", None, "r"), (5, "violation", "L1", "임금을 매월 1회 이상 지급하여야", "r")],
        "query_id int, severity string, law_id string, quote string, reason string",
    )
    got = {r.query_id: (r.severity, r.gate_passed) for r in retrieval.judged(replies, offered, laws).collect()}
    assert got == {1: ("violation", True), 2: ("ok", False), 3: ("ok", False), 4: ("ok", True), 5: ("ok", False)}


def test_quote_length(spark):
    d = spark.createDataFrame([("가" * 11,), ("가" * 12,)], "q string").select(retrieval.citation_holds(F.col("q"), F.lit("가" * 20)).alias("x"))
    assert [r.x for r in d.collect()] == [False, True]


def test_replies_in_fences(spark):
    raw = ['```json\n{"severity": "ok", "law_id": "L"}\n```', "no json", None]
    d = spark.createDataFrame([(r,) for r in raw], "r string").select(retrieval.parsed_reply(F.col("r")).alias("x"))
    assert [None if r.x is None else r.x.severity for r in d.collect()] == ["ok", None, None]


def test_columns_and_boxes(spark):
    rows = []
    for i in range(12):
        rows += [(1, f"제{i + 1}조", 10.0, 60.0, i * 12.0, i * 12.0 + 9), (1, f"제{i + 13}조", 330.0, 380.0, i * 12.0, i * 12.0 + 9)]
    words = spark.createDataFrame(rows, "page int, text string, x0 double, x1 double, top double, bottom double")
    text = layout.column_text(words, ["page"], 600.0).first().text
    assert text.split("\n") == [f"제{i + 1}조" for i in range(24)]
    assert layout.page_text(words, ["page"]).first().text.startswith("제1조 | 제13조\n")
    placed = layout.with_offsets(words, ["page"])
    spans = spark.createDataFrame([(1, 1, 0, 3)], "page int, span int, start int, end int")
    hidden = layout.covered(placed, layout.boxes(placed, spans, ["page"]), ["page"]).collect()
    assert [r.text for r in hidden] == ["제1조"]


def test_best_extraction_keeps_the_first_of_equals(spark):
    t = spark.createDataFrame([(1, "b", 1, "근로 임금"), (1, "a", 0, "근로 임금"), (1, "c", 2, None)], "doc_id int, engine string, engine_ord int, text string")
    r = layout.best_extraction(t, ["근로", "임금"]).first()
    assert (r.engine, r.tried) == ("a", 3)


def test_null_safe_matching(spark):
    p = spark.createDataFrame([(None, "L1"), (1, "L1"), (1, "L1")], "article_no int, law_id string")
    e = spark.createDataFrame([(None, "L1"), (2, "L1")], "article_no int, law_id string")
    r = evaluation.scores(evaluation.matched(p, e, ["article_no", "law_id"])).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 1, 0.5, 0.5)
    none = evaluation.scores(evaluation.matched(p.limit(0), e.limit(0), ["law_id"])).first()
    assert (none.tp, none.f1) == (0, 0.0)


def test_classifier_learns(spark):
    rows = [(i, f"임금은 매월 {i}일에 지급한다", "wage") for i in range(12)] + [(100 + i, f"휴일은 매주 {i}번 쉬는 날로 한다", "holiday") for i in range(12)]
    d = spark.createDataFrame(rows, "key int, text string, label string")
    out = classifier.cross_validated(d, 3, 1 << 10, 10).collect()
    assert len(out) == 24 and sum(r.predicted == r.label for r in out) >= 22


def test_judge_with_scripted_replies(spark):
    laws = spark.createDataFrame([("L1", "사용자는 임금을 매월 1회 이상 지급하여야 한다.", 0), ("L2", "해고는 서면으로 통지하여야 한다.", 1), ("L3", "휴일은 매주 하루 이상 준다.", 2)], "id string, text string, pos int")
    index = retrieval.bm25_index(laws.select(F.col("id").alias("law_id"), "pos", F.col("text").alias("body")))
    clauses = spark.createDataFrame([(1, 1, "임금을 매월 지급하지 않는다"), (1, 2, "해고를 전화로 통지한다"), (1, 3, "휴일은 매주 없다"), (2, 1, "zzz")], "doc_id int, clause_seq int, text string")

    def judge(text, some):
        if "해고" in text:
            raise TimeoutError("no answer")
        if "휴일" in text:
            return '{"severity": "violation", "law_id": "L3", "quote": "휴일은 매주 사흘 이상 주어야 한다", "reason": "r"}'
        return '{"severity": "violation", "law_id": "L1", "quote": "임금을 매월 1회 이상 지급하여야", "reason": "r"}'

    from pactum.operators import judging

    got = judging.ask(clauses, index, laws, judge)
    assert {(r.doc_id, r.clause_seq, r.severity, r.gate_passed, r.error is None) for r in got.collect()} == {(1, 1, "violation", True, True), (1, 2, "ok", True, False), (1, 3, "ok", False, True)}
    assert [r.claimed_law_id for r in judging.quarantined(got).collect()] == ["L3"]
    assert {r.severity for r in judging.ask(clauses, index, laws).collect()} == {"ok"}


def test_language_by_whole_text(spark, tmp_path):
    """Documents whose first line says nothing, or is in the other language."""
    from pactum.plans import texts

    words = {"en": "the house and garden are green", "de": "das haus und der garten sind schön"}
    rows = [(i, ("\n" if i % 4 < 2 else words["de" if i % 2 else "en"] + "\n") + "\n".join([words["en" if i % 2 else "de"]] * 6), "en" if i % 2 else "de") for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.language_classifier(spark, str(tmp_path)).collect()
    assert len(got) == 24 and all(r.predicted == r.label for r in got)


def test_quotes_from_the_whole_document(spark, tmp_path):
    """A passage late in an odd document counts, though it isn't the item that the id points to; even ids quote themselves."""
    from pactum.plans import texts

    passages = ["Wages are paid on the last day of each month.", "Leave of fifteen days is due after one year.", "A notice of thirty days comes before dismissal."]
    filler = "Nothing of interest stands in this sentence here. " * 5
    docs = [(3, filler + "\n" + filler + passages[2] + " And more."), (4, filler)]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.quoted_items(spark, str(tmp_path)).where("passes").collect()
    assert [(r.doc_id, r.item_id, r["rank"]) for r in got] == [(3, 2, 1)]


def test_reply_is_the_first_balanced_object(spark):
    good = '{"severity": "ok", "reason": "a {b} c"}'
    raw = [f"{good} and {{\"severity\": \"violation\"}}", f"text }} before {good}", f"{{not json}} then {good}", '```json\n{"severity": "ok", "reason": "a } b"}\n```', "[1, 2]", "no object {", "", None]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, r string").select("k", retrieval.parsed_reply(F.col("r")).alias("x")).orderBy("k").collect()
    assert [(r.x.severity, r.x.reason) if r.x else None for r in rows] == [("ok", "a {b} c")] * 3 + [("ok", "a } b")] + [None] * 4
    parts = spark.createDataFrame([("a{b{c}d}e}{f}{g",)], "t string").select(retrieval.balanced_objects(F.col("t")).alias("p")).first().p
    assert parts == ["{b{c}d}", "{f}"]


def test_prompts(spark):
    laws = spark.createDataFrame([("A-1", "Act", "Article 1", "Pay", "Pay is due."), ("B-2", "Code", "Article 2", "Rest", "Rest is due.")], "id string, law string, article string, title string, text string")
    offered = spark.createDataFrame([("q", "B-2", 1), ("q", "A-1", 2), ("r", "Z", 1)], "query_id string, law_id string, rank int")
    clauses = spark.createDataFrame([("q", "No pay."), ("r", "No rest."), ("s", None)], "query_id string, text string")
    got = retrieval.prompts(clauses, offered, laws, "Clause: {clause}\nLaws:\n{laws}\n.").collect()
    assert [tuple(r) for r in got] == [("q", "Clause: No pay.\nLaws:\nid: B-2\nCode Article 2(Rest)\nRest is due.\n\nid: A-1\nAct Article 1(Pay)\nPay is due.\n.")]


def test_saved_model(spark, tmp_path):
    rows = spark.createDataFrame([("pay is late", "A"), ("pay is due late", "A"), ("rest is short", "B"), ("short rest again", "B")], "text string, label string")
    model = classifier.train(rows, 500, 5)
    assert classifier.load(spark, str(tmp_path / "none")) is None
    classifier.save(model, str(tmp_path / "model"))
    again = classifier.load(spark, str(tmp_path / "model"))
    assert [tuple(r) for r in classifier.predict(again, rows).collect()] == [tuple(r) for r in classifier.predict(model, rows).collect()]


def test_tiers_and_toggles(spark):
    from pactum.operators import tiers

    rows = [(1, 1, "근로자는 위약금 100원을 배상한다.", 1, "t"), (1, 2, "둘째 조항은 평범하다.", 2, None), (2, 1, None, None, "x"), (None, 1, "해고는 문자로 통보한다.", None, None)]
    clauses = spark.createDataFrame(rows, "doc_id int, clause_seq int, text string, article_no int, title string")
    tier = lambda name: lambda c: c.where("doc_id = 1").select("doc_id", "clause_seq", F.lit(9).alias("rule_ord"), F.lit(name).alias("rule"), F.lit("L").alias("law_id"), F.lit("unfavorable").alias("severity"), F.lit(0).alias("sentence"), F.lit(name).alias("source"))
    names = lambda **k: sorted((r.doc_id or 0, r.clause_seq, r.rule) for r in tiers.tiered(clauses, **k).collect())
    assert names() == [(0, 1, "dismissal_written"), (1, 1, "penalty")]
    assert names(model=tier("model"), judge=tier("llm")) == [(0, 1, "dismissal_written"), (1, 1, "penalty"), (1, 2, "model")]
    assert names(rules=None, judge=tier("llm")) == [(1, 1, "llm"), (1, 2, "llm")]
    assert names(rules=None) == []
    laws = spark.createDataFrame([("근로기준법-제20조", "근로기준법", "제20조", "위약 예정의 금지", "본문")], "id string, law string, article string, title string, text string")
    found = tiers.tiered(clauses, model=tier("model"))
    got = {(r.doc_id, r.clause_seq): (r.source_label, r.clause_title, r.law_label, r.law_text) for r in tiers.enriched(found, clauses, laws).collect()}
    assert got == {(1, 1): ("룰 검사", "제1조 t", "근로기준법 제20조(위약 예정의 금지)", "본문"), (1, 2): ("학습 모델", "", "", ""), (None, 1): ("룰 검사", "", "", "")}
    assert [(r.clause_seq, r.position) for r in tiers.placed(found).where("doc_id = 1").orderBy("position").collect()] == [(1, 1), (2, 2)]
    keys = spark.createDataFrame([("근로기준법-제20조",), ("none",)], "id string")
    assert {r.id: r.law for r in tiers.lookup(laws, keys, "id").collect()} == {"근로기준법-제20조": "근로기준법", "none": None}
    assert "text" not in tiers.listing(laws).columns
    assert tiers.tiered(clauses.limit(0), model=tier("model")).count() == 0


def test_one_pass_equals_joined_tiers(spark):
    """Hits beside their clauses: the findings, counts and cards of tiers that are joined, from one scan."""
    from pactum.operators import report, segmentation, tiers

    texts = [(1, "제1조(위약) 근로자는 위약금 100원을 배상하며 해고는 문자로 통보한다.\n제2조(휴일) 휴일은 일요일로 하고 평범하게 정한다.\n제3조(업종) 같은 업종에 취업하지 아니한다는 조항을 둔다."), (2, None), (3, "제1조(갑) 평범한 조항입니다 그렇습니다.\n제2조(을) 일요일에는 근무하지 않습니다 그렇습니다."), (4, "짧다")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    said = lambda word, source, severity: lambda c: c.withColumn("hit", F.when(F.contains("text", F.lit(word)), F.struct(F.lit(9).alias("rule_ord"), F.lit(source).alias("rule"), F.lit("L").alias("law_id"), F.lit(severity).alias("severity"), F.lit(0).alias("sentence"), F.lit(source).alias("source"))))
    as_rows = lambda tier: lambda c: tier(c).where("hit is not null").select("doc_id", "clause_seq", "hit.*")
    model, judge = said("업종", "model", "violation"), said("조항", "llm", "unfavorable")
    clauses = segmentation.segment(docs)
    joined, rows = tiers.tiered(clauses, model=as_rows(model), judge=as_rows(judge)), tiers.annotated(clauses, model=model, judge=judge)
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert joined.count() == 4 and same(tiers.hit_rows(rows), joined)
    assert same(tiers.meta_of(rows), report.meta(clauses, joined))
    for status in (None, "violation", "unfavorable", "ok"):
        assert same(tiers.cards_of(rows, status), tiers.cards(clauses, joined, status))
    assert tiers.annotated(clauses, []).where(F.size("hits") > 0).count() == 0
    outer = segmentation.segment(docs.withColumn("whole", F.struct(F.lit(0), F.lit("w"), F.lit("L"), F.lit("violation"), F.lit(0), F.lit("rule")).cast("struct<rule_ord:int,rule:string,law_id:string,severity:string,sentence:int,source:string>")), carry=("whole",), outer=True)
    found = tiers.hit_rows(tiers.annotated(outer, model=model, judge=judge), "whole").collect()
    assert sorted((r.doc_id, r.clause_seq) for r in found if r.rule == "w") == [(1, None), (2, None), (3, None), (4, None)] and len(found) == 8
    plan = tiers.hit_rows(tiers.annotated(outer, model=model, judge=judge), "whole")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_law_files_and_rows(spark, tmp_path):
    from pactum.operators import tiers
    from pactum.sources import readers

    laws = spark.createDataFrame([("L-1", "L", "제1조", "t", "사용자는 근로자에게 임금을 지급하여야 한다. 다만, 그러하지 아니하는 경우도 있다. 짧다.")], "id string, law string, article string, title string, text string")
    path = str(tmp_path / "laws")
    for _ in range(2):
        tiers.write_laws(laws, path)
    assert [r.id for r in readers.laws(spark, path).collect()] == ["L-1"]
    labelled = spark.createDataFrame([("x", "A"), ("y", "A")], "text string, label string")
    rows = tiers.training_rows(labelled, laws)
    assert [(r.label, r.n) for r in tiers.label_histogram(rows).collect()] == [("A", 2), ("NORMAL", 1)]


def test_folds_over_ranges(spark):
    from pactum.operators import evaluation

    rows = [(k, "a" if k % 10 else None) for k in range(500)] + [(None, "a"), (7, "a")]
    d = spark.createDataFrame(rows, "key long, label string")
    got = evaluation.folds(d, "label", "key", 3, ranges=8).collect()
    assert len(got) == len(rows)
    want = {}
    for label in ("a", None):
        for i, k in enumerate(sorted((k for k, x in rows if x == label), key=lambda k: -1 if k is None else k)):
            want.setdefault((k, label), []).append(i % 3)
    have = {}
    for r in got:
        have.setdefault((r.key, r.label), []).append(r.fold)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert evaluation.folds(d.limit(0), "label", "key").count() == 0
