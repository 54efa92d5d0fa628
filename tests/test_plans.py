"""What is worked out once: plans of the queries over contracts, whose texts and rules are dear."""

from __future__ import annotations

import pytest

from pactum.plans import catalog
from pactum.sources.derived import contracts

SF = "/root/testdata/sf0.001"
#: Words of one rule, of one clause of the bank, and of one required term.
RULE, CLAUSE, TERM = "블랙리스트", "수급인은 용역", "보수액"


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_customers_are_dealt_before_their_texts_are_made(spark):
    assert contracts(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_highlights_work_out_the_rules_once(plan):
    assert plan("clause_highlights").count(RULE) == 1


def test_review_makes_and_tests_clauses_once(plan):
    assert plan("review_opinions").count(RULE) == 1
    assert plan("review_opinions").count(CLAUSE) == plan("clause_segmentation").count(CLAUSE)


def test_missing_terms_make_texts_and_structures_once(plan):
    assert plan("missing_terms").count(CLAUSE) == plan("clause_segmentation").count(CLAUSE)
    assert plan("missing_terms").count(TERM) == 1


def test_report_does_not_deal_clauses_by_their_label(spark, plan):
    assert plan("full_report").count(TERM) == 1
    assert "hashpartitioning(predicted" not in catalog.QUERIES["full_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
