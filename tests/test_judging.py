from __future__ import annotations

import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pactum.operators import judging, retrieval

HOW = {"tries": 3, "pause": 0.01, "limit": 1.0}


def counted(folder, answer):
    """A provider that leaves a file for each call, in whatever process it runs."""

    def call(prompt):
        mark = folder / f"{hashlib.md5(prompt.encode()).hexdigest()}-{time.time_ns()}"
        mark.write_text(prompt)
        return answer(prompt, len(list(folder.glob(f"{hashlib.md5(prompt.encode()).hexdigest()}-*"))))

    return call


def calls(folder):
    return Counter(f.read_text() for f in folder.iterdir())


def frame(spark, prompts):
    return spark.createDataFrame([(p,) for p in prompts], "prompt string").repartition(3)


def test_each_prompt_is_asked_once(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    judging.register_provider("echo", counted(folder, lambda p, n: p.upper()))
    asked = frame(spark, ["a", "b", "a", "c", None, "b", "a"])
    table = str(tmp_path / "replies")
    got = judging.replies(asked, "echo", table, waves=2, **HOW).collect()
    assert sorted((r.raw, r.error) for r in got) == [("A", None), ("B", None), ("C", None)] and calls(folder) == {"a": 1, "b": 1, "c": 1}
    again = judging.replies(asked.union(frame(spark, ["d"])), "echo", table, **HOW)
    assert sorted(r.raw for r in again.collect()) == ["A", "B", "C", "D"] and calls(folder) == {"a": 1, "b": 1, "c": 1, "d": 1}
    # another provider has replies of its own
    judging.register_provider("other", counted(folder, lambda p, n: "x"))
    assert [r.raw for r in judging.replies(frame(spark, ["a"]), "other", table, **HOW).collect()] == ["x"] and calls(folder)["a"] == 2
    with pytest.raises(KeyError):
        judging.replies(asked, "nobody", table)


def test_failures_and_stalls(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def answer(prompt, n):
        if prompt == "stalls":
            time.sleep(30)
        if prompt == "never" or prompt == "second" and n < 2:
            raise ConnectionError("busy")
        return "fine"

    judging.register_provider("shaky", counted(folder, answer))
    table, began = str(tmp_path / "replies"), time.time()
    got = {r.error and r.error.split(":")[0]: r.raw for r in judging.replies(frame(spark, ["never", "second", "stalls", "good"]), "shaky", table, **HOW).collect()}
    assert got == {None: "fine", "ConnectionError": None, "TimeoutError": None} and time.time() - began < 25
    assert calls(folder) == {"never": 3, "second": 2, "stalls": 3, "good": 1}
    # errors are asked again, replies aren't; one that comes now counts
    judging.register_provider("shaky", counted(folder, lambda p, n: "late"))
    got = judging.replies(frame(spark, ["never", "good"]), "shaky", table, **HOW).collect()
    assert sorted((r.raw, r.error) for r in got) == [("fine", None), ("late", None)] and calls(folder)["good"] == 1


def test_calls_run_side_by_side():
    began = time.time()
    with judging.ThreadPoolExecutor(6) as pool:
        assert len(list(pool.map(lambda p: judging.insisted(lambda _: time.sleep(0.2) or "x", p, 1, 0, 5), range(12)))) == 12
    assert time.time() - began < 1.5


def test_judge_by_name(spark, tmp_path):
    laws = spark.createDataFrame([("L1", "L", "제1조", "t", "사용자는 임금을 매월 1회 이상 지급하여야 한다.", 0), ("L2", "L", "제2조", "t", "해고는 서면으로 통지하여야 한다.", 1), ("L3", "L", "제3조", "t", "휴일은 매주 하루 이상 준다.", 2)], "id string, law string, article string, title string, text string, pos int")
    index = retrieval.bm25_index(laws.select(F.col("id").alias("law_id"), "pos", F.col("text").alias("body")))
    clauses = spark.createDataFrame([(1, 1, "임금을 매월 지급하지 않는다"), (1, 2, "해고를 전화로 통지한다"), (2, 1, "zzz")], "doc_id int, clause_seq int, text string")
    judging.register_provider("scripted", lambda p: '{"severity": "violation", "law_id": "L1", "quote": "임금을 매월 1회 이상 지급하여야", "reason": "r"}' if "임금을 매월 지급하지" in p else '{"severity": "violation", "law_id": "L2", "quote": "해고는 구두로도 통지할 수 있다고", "reason": "r"}')
    got = judging.ask_provider(clauses, index, laws, "scripted", str(tmp_path / "replies"), "{clause}\n{laws}", **HOW).collect()
    assert {(r.doc_id, r.clause_seq, r.severity, r.gate_passed) for r in got} == {(1, 1, "violation", True), (1, 2, "ok", False)}
