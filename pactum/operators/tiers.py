"""The tiers of an analysis joined into one list of findings, and what readers see of it.

A tier is a function from clauses (doc_id, clause_seq, text, ...) to findings. Each sees only the clauses that no tier
before it caught; a tier that isn't given is left out of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions import patterns as P
from pactum.functions.messages import MISSING_MESSAGE, fill
from pactum.functions.text import plain_law_sentences
from pactum.operators.checks import missing_terms
from pactum.operators.report import finding_order, left_over
from pactum.operators.rules import HIT, Rule, rule_hits, run_rules

Tier = Callable[[DataFrame], DataFrame]
FINDING = ["doc_id", "clause_seq", "rule_ord", "rule", "law_id", "severity", "sentence", "source", "value", "reason", "suggestion"]
WORDS = {"value": "bigint", "reason": "string", "suggestion": "string"}


def _with_words(findings: DataFrame) -> DataFrame:
    """FINDING of a tier, which may leave out what it doesn't word."""
    return findings.select(*(F.col(c) if c in findings.columns else F.lit(None).cast(WORDS[c]).alias(c) for c in FINDING))


def _as_hit(rows: DataFrame, column: str) -> Column:
    """A column with a tier's hit as a HIT; what it doesn't word is null."""
    has = rows.schema[column].dataType.fieldNames()
    hit = F.col(column)
    fields = [hit[c].alias(c) if c in has else F.lit(None).alias(c) for c in FINDING[2:]]
    return F.when(hit.isNotNull(), F.struct(*fields).cast(HIT))


def tiered(clauses: DataFrame, rules: Tier | None = run_rules, model: Tier | None = None, judge: Tier | None = None) -> DataFrame:
    """FINDING of all tiers given, the cheapest first. With no tier there are no findings.

    A clause that a tier caught joins no later one; the anti joins carry keys of findings, not texts.
    """
    found, rest = None, clauses
    for tier in (rules, model, judge):
        if tier is not None:
            got = _with_words(tier(rest))
            found, rest = got if found is None else found.unionByName(got), left_over(rest, got)
    return _with_words(run_rules(clauses, [])).limit(0) if found is None else found


def annotated(clauses: DataFrame, rules: list[Rule] | None = None, model: Tier | None = None, judge: Tier | None = None) -> DataFrame:
    """``clauses`` with hits, array<HIT>, in one pass: of the rules, else of the model, else of the judge.

    model and judge take rows (clauses with hits) and give the same rows with hit, a HIT or null; it counts only where no
    tier before had a hit. Nothing is joined back and no clause is read twice; a tier that isn't given isn't in the plan.
    rules: None for all, [] for none. Other columns stay.
    """
    out = clauses.withColumn("hits", rule_hits(F.col("text"), rules))
    for tier in (model, judge):
        if tier is not None:
            said = tier(out)
            out = said.withColumn("hits", F.when((F.size("hits") == 0) & F.col("hit").isNotNull(), F.array(_as_hit(said, "hit"))).otherwise(F.col("hits"))).select(*out.columns)
    return out


def whole_hit(kind: Column, structure: Column) -> Column:
    """The finding of an employment contract that leaves out mandatory terms, as a HIT; null where there is none."""
    gone = F.size(F.array_except(F.array(*map(F.lit, P.MANDATORY)), structure["required_found"])) > 0
    missing = F.array_join(F.array_except(F.array(*map(F.lit, P.MANDATORY)), structure["required_found"]), ", ")
    said = [fill(text, {"missing": missing}) for text in MISSING_MESSAGE]
    hit = F.struct(F.lit(0), F.lit("missing_terms"), F.lit(P.MISSING_LAW), F.lit("violation"), F.lit(0), F.lit("rule"), F.lit(None), *said).cast(HIT)
    return F.when((kind == "employment") & gone, hit)


def hit_rows(rows: DataFrame, whole: str | None = None) -> DataFrame:
    """FINDING of annotated clauses. ``whole``: a column with a HIT of the whole document, which its first row gives."""
    # an outer explode, since the filter that Spark puts before an inner one would work out the hits once more
    out = rows.select("doc_id", "clause_seq", F.explode_outer("hits").alias("h")).where("h is not null").select("doc_id", "clause_seq", "h.*")
    if whole is not None:
        every = F.transform("hits", lambda h: F.struct(F.col("clause_seq").alias("clause_seq"), h.alias("hit")))
        own = F.when(F.coalesce(F.col("clause_seq"), F.lit(1)) == 1, F.filter(F.array(F.struct(F.lit(None).cast("int").alias("clause_seq"), _as_hit(rows, whole).alias("hit"))), lambda x: x["hit"].isNotNull()))
        both = F.concat(F.when(F.col("clause_seq").isNotNull(), every).otherwise(F.slice(every, 1, 0)), F.coalesce(own, F.slice(every, 1, 0)))
        out = rows.select("doc_id", F.explode_outer(both).alias("h")).where("h is not null").select("doc_id", "h.clause_seq", "h.hit.*")
    return out.select(*FINDING)


def clause_hits(rows: DataFrame) -> DataFrame:
    """Annotated clauses with a row for each of their hits, its fields beside the clause; a clause without any is one row with a null rule."""
    return rows.select(*(c for c in rows.columns if c != "hits"), F.explode_outer("hits").alias("h")).select("*", "h.*").drop("h")


def meta_of(rows: DataFrame) -> DataFrame:
    """``report.meta`` of annotated clauses, by one aggregate."""
    count = lambda field, value: F.sum(F.size(F.filter("hits", lambda h: h[field] == value)))
    sums = {"flagged": F.count_if(F.size("hits") > 0), "violations": count("severity", "violation"), "unfavorable": count("severity", "unfavorable")}
    sums |= {"by_rule": count("source", "rule"), "by_model": count("source", "model"), "by_judge": count("source", "llm")}
    return rows.groupBy("doc_id").agg(F.count("*").alias("clauses"), *(c.cast("long").alias(a) for a, c in sums.items()))


def document_findings(docs: DataFrame) -> DataFrame:
    """FINDING and missing of employment contracts (doc_id, kind, structure) that leave out mandatory terms; clause_seq is null."""
    whole = {"clause_seq": F.lit(None).cast("int"), "rule_ord": F.lit(0), "rule": F.lit("missing_terms"), "law_id": F.lit(P.MISSING_LAW), "severity": F.lit("violation"), "sentence": F.lit(0), "source": F.lit("rule")}
    return missing_terms(docs).select("doc_id", *(v.alias(k) for k, v in whole.items()), "missing")


def placed(findings: DataFrame) -> DataFrame:
    """FINDING with position, from 1 in each document: by severity, tier, clause and rule; findings of the whole document are last."""
    order = Window.partitionBy("doc_id").orderBy(F.col("clause_seq").isNull(), *finding_order())
    return findings.withColumn("position", F.row_number().over(order))


def enriched(findings: DataFrame, clauses: DataFrame, laws: DataFrame) -> DataFrame:
    """Findings with source_label, clause_title, clause_text, law_label and law_text; what isn't known is empty."""
    label = F.col("source")
    for source, name in P.SOURCE_LABELS.items():
        label = F.when(F.col("source") == source, name).otherwise(label)
    titled = F.when(F.col("article_no") > 0, F.concat(F.lit("제"), F.col("article_no").cast("string"), F.lit("조 "), "title")).otherwise(F.coalesce("title", F.lit("")))
    of_clause = clauses.select("doc_id", "clause_seq", titled.alias("clause_title"), F.col("text").alias("clause_text"))
    of_law = laws.select(F.col("id").alias("law_id"), F.concat("law", F.lit(" "), "article", F.lit("("), "title", F.lit(")")).alias("law_label"), F.col("text").alias("law_text"))
    joined = findings.join(of_clause, ["doc_id", "clause_seq"], "left").join(of_law, "law_id", "left")
    whole = F.col("clause_seq").isNull()
    return joined.withColumn("source_label", F.when(whole, P.WHOLE_LABEL).otherwise(label)).withColumn("clause_title", F.when(whole, P.WHOLE_TITLE).otherwise(F.col("clause_title"))).na.fill("", ["clause_title", "clause_text", "law_label", "law_text"])


def screen(meta: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(doc_id, total, flagged, clean, dropped): clauses of each document by what became of them, and claims dropped by the gate."""
    gone = quarantine.groupBy("doc_id").agg(F.count("*").alias("dropped"))
    clean = F.greatest(F.col("clauses") - F.col("flagged"), F.lit(0))
    return meta.join(gone, "doc_id", "left").select("doc_id", F.col("clauses").alias("total"), "flagged", clean.alias("clean"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


def cards(clauses: DataFrame, findings: DataFrame, status: str | None = None, search: str = "") -> DataFrame:
    """(doc_id, clause_seq, status) of the clauses of a status whose title or text has the search words, in any case.

    status: violation or unfavorable, as the clause's worst finding is, or ok; None is any.
    """
    worst = findings.groupBy("doc_id", "clause_seq").agg(F.min(F.when(F.col("severity") == "violation", 0).otherwise(1)).alias("worst"))
    return _shown(clauses.join(worst, ["doc_id", "clause_seq"], "left"), status, search)


def cards_of(rows: DataFrame, status: str | None = None, search: str = "") -> DataFrame:
    """``cards`` of annotated clauses, row by row."""
    return _shown(rows.withColumn("worst", F.array_min(F.transform("hits", lambda h: F.when(h["severity"] == "violation", 0).otherwise(1)))), status, search)


def _shown(rows: DataFrame, status: str | None, search: str) -> DataFrame:
    shown = F.when(F.col("worst") == 0, "violation").when(F.col("worst") == 1, "unfavorable").otherwise("ok")
    words = F.lower(F.concat_ws(" ", "title", "text"))
    found = rows.where(F.contains(words, F.lower(F.lit(search.strip())))).select("doc_id", "clause_seq", shown.alias("status"))
    return found if status is None else found.where(F.col("status") == status)


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each of the keys with its row; the other columns are null where there is none."""
    return keys.join(rows, key, "left")


def listing(samples: DataFrame) -> DataFrame:
    """The sample table without its texts."""
    return samples.drop("text")


def write_laws(laws: DataFrame, path: str) -> None:
    """The statutes as JSON lines, which ``readers.laws`` reads; an earlier table there is replaced."""
    laws.write.mode("overwrite").json(path)


def training_rows(labelled: DataFrame, laws: DataFrame, normal: str = "NORMAL") -> DataFrame:
    """(text, label) of the labelled rows, and the plain sentences of the statutes as examples of nothing wrong."""
    plain = laws.select(F.explode(plain_law_sentences(F.col("text"))).alias("text"), F.lit(normal).alias("label"))
    return labelled.select("text", "label").unionByName(plain)


def label_histogram(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n), the most frequent first."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)
