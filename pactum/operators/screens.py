"""What a reader is shown before and beside a report: the block decision, previews of masked pages, the state of the system, counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pactum.functions import patterns as P
from pactum.operators import layout, masking
from pactum.operators.rules import RULES, SECOND_OUTCOMES

# How many pages a preview shows, the year of the minimum wage, and titles of documents that get no score.
PREVIEW_PAGES, MIN_WAGE_YEAR = 3, 2026
NOT_EMPLOYMENT = {"contractor": "근로계약서가 아닌 계약서로 보입니다", "other": "근로계약서로 보이지 않습니다"}


def blocked(check: Column, verdict: Column, disguise: Column | None = None) -> Column:
    """(why, title, disguise), or null for a document whose score may be shown.

    check: ``checks.input_check``; the first failure is why, and its title is the screen's own. Else a document that isn't
    an employment contract is blocked as contractor or other, with its title, and whether it may be one in disguise.
    """
    kind = F.when(verdict["kind"] == "contractor", "contractor").otherwise("other")
    title = F.when(kind == "contractor", NOT_EMPLOYMENT["contractor"]).otherwise(NOT_EMPLOYMENT["other"])
    warned = F.lit(False) if disguise is None else F.coalesce(disguise, F.lit(False))
    failed = F.struct(check["reason"].alias("why"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("disguise"))
    foreign = F.struct(kind.alias("why"), title.alias("title"), warned.alias("disguise"))
    return F.when(~check["ok"], failed).when(verdict["kind"] != "employment", foreign)


def page_previews(files: DataFrame, words: DataFrame, patterns: list[tuple[str, str]] = P.PII_PATTERNS, labels: dict[str, list[str]] | None = P.MASK_LABELS, most: int = PREVIEW_PAGES) -> DataFrame:
    """(doc_id, ok, reason, pages, counts, total_pages, truncated) of each file (doc_id, total_pages, error).

    Of the first ``most`` pages those with words (doc_id, page from 1, text, x0, x1, top, bottom) are shown: pages is an array of
    (page, boxes), boxes being how many of them hide something, counts a map of spans by kind. reason: error for a file that
    couldn't be read, scanned for one without words there, else ok; pages and counts are empty unless it is ok.
    A page's words share a task; files and pages don't.
    """
    page = ["doc_id", "page"]
    first = words.where(F.col("page").between(1, most) & F.col("text").isNotNull()).select(*page, "text", "x0", "x1", "top", "bottom")
    placed = layout.with_offsets(first, page)
    ordered = F.array_sort(F.collect_list(F.struct("start", "row", "text")))
    texts = placed.groupBy(*page).agg(ordered.alias("w"))
    glue = lambda i: F.when(i == 0, "").when(F.get("w", i)["row"] == F.get("w", i - 1)["row"], " ").otherwise("\n")
    texts = texts.select(*page, F.array_join(F.transform("w", lambda x, i: F.concat(glue(i), x["text"])), "").alias("text"))
    spans = masking.find_spans(texts, patterns, labels).select(*page, "spans")
    each = spans.select(*page, F.posexplode("spans").alias("span", "s")).select(*page, "span", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    drawn = layout.boxes(placed, each, page).groupBy(*page).agg(F.count("*").alias("boxes"))
    shown = spans.join(drawn, page, "left").select(*page, F.coalesce("boxes", F.lit(0)).alias("boxes"), F.transform("spans", lambda s: s["kind"]).alias("kinds"))
    per = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "boxes"))).alias("pages"), F.flatten(F.collect_list("kinds")).alias("kinds"))
    reason = F.when(F.col("error").isNotNull(), "error").when(F.col("pages").isNull(), "scanned").otherwise("ok")
    joined = files.select("doc_id", "total_pages", "error").join(per, "doc_id", "left").withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    kinds = F.when(ok, F.col("kinds")).otherwise(F.array().cast("array<string>"))
    counts = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    pages = F.when(ok, F.col("pages")).otherwise(F.array().cast("array<struct<page:int,boxes:bigint>>"))
    return joined.select("doc_id", ok.alias("ok"), "reason", pages.alias("pages"), counts.alias("counts"), "total_pages", (ok & (F.col("total_pages") > most)).alias("truncated"))


def system_info(laws: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """One row (law_count, unverified, rule_count, classifier_loaded, classifier_classes, min_wage, min_wage_year).

    laws: (id, verified, ...); classes: the labels of the loaded model, None without one. A rule with two outcomes counts once.
    """
    known = [F.lit(len(RULES) - len(SECOND_OUTCOMES)).alias("rule_count"), F.lit(classes is not None).alias("classifier_loaded"), F.lit(len(classes or [])).alias("classifier_classes")]
    wage = [F.lit(P.MIN_WAGE_HOURLY).alias("min_wage"), F.lit(MIN_WAGE_YEAR).alias("min_wage_year")]
    return laws.agg(F.count("*").alias("law_count"), F.count_if(~F.coalesce("verified", F.lit(False))).alias("unverified")).select("*", *known, *wage)


def observed(rows: DataFrame, name: str = "report") -> tuple[DataFrame, Observation]:
    """Annotated clauses (doc_id, text, hits, ...) as they are, and an observation that holds the run's counts once they have been
    written: clauses, flagged, violations, unfavorable, by_rule, by_model, by_judge. No second job reads the clauses.

    A row without a clause (clause_seq is null) counts as none. Where a task is run again, Spark counts its rows once.
    """
    seen = Observation(name)
    there = F.col("clause_seq").isNotNull()
    count = lambda field, value: F.coalesce(F.sum(F.when(there, F.size(F.filter("hits", lambda h: h[field] == value))).otherwise(0)), F.lit(0))
    sums = {"clauses": F.count_if(there), "flagged": F.count_if(there & (F.size("hits") > 0)), "violations": count("severity", "violation"), "unfavorable": count("severity", "unfavorable")}
    sums |= {"by_rule": count("source", "rule"), "by_model": count("source", "model"), "by_judge": count("source", "llm")}
    return rows.observe(seen, *(c.cast("long").alias(a) for a, c in sums.items())), seen
