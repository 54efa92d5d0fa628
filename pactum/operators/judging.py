"""The optional last tier: clauses that neither a rule nor the model caught go to a judge with the statutes retrieved for them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions import patterns as P
from pactum.functions.text import expanded
from pactum.operators.retrieval import bm25_search, judged, parsed_reply, prompts


def silent(_: str, __: list[str]) -> str:
    """The judge that is used without a provider: it finds nothing."""
    return '{"severity": "ok"}'


def ask(clauses: DataFrame, index: DataFrame, laws: DataFrame, judge: Callable[[str, list[str]], str] = silent, k: int = P.TOP_K) -> DataFrame:
    """(doc_id, clause_seq, severity, law_id, quote, reason, gate_passed, claimed, error) of each clause (doc_id, clause_seq, text).

    The judge has a clause's text and the texts of its k best laws, and answers with a JSON object. One that fails or
    answers with something else counts as ok, with its error; clauses without a law offered aren't asked about.
    """
    keyed = clauses.withColumn("query_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("clause_seq").cast("string")))
    offered = bm25_search(index, keyed.select("query_id", expanded(F.col("text")).alias("text")), k)
    texts = laws.select(F.col("id").alias("law_id"), F.col("text").alias("law_text"))
    given = offered.join(texts, "law_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "law_text")))["law_text"].alias("laws"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, errors = [], []
            for text, some in zip(batch["text"], batch["laws"]):
                try:
                    raw.append(judge(text, list(some)))
                    errors.append(None)
                except Exception as e:  # a provider may fail in any way; the clause then has no finding
                    raw.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch[["query_id"]].assign(raw=raw, error=errors)

    asked = keyed.join(given, "query_id").select("query_id", "text", "laws").mapInPandas(run, "query_id string, raw string, error string")
    return _gated(keyed, offered, asked, laws)


def _gated(keyed: DataFrame, offered: DataFrame, asked: DataFrame, laws: DataFrame) -> DataFrame:
    replies = asked.select("query_id", "error", parsed_reply(F.col("raw")).alias("r")).select("query_id", "error", "r.severity", "r.law_id", "r.quote", "r.reason")
    passed = judged(replies, offered.select("query_id", "law_id"), laws)
    return keyed.select("query_id", "doc_id", "clause_seq").join(passed, "query_id").drop("query_id")


#: Providers by name: a prompt to a raw reply.
PROVIDERS: dict[str, Callable[[str], str]] = {"silent": lambda _: '{"severity": "ok"}'}


def register_provider(name: str, call: Callable[[str], str]) -> None:
    """``call`` goes to the executors with the tasks that use it; a later one of that name takes its place."""
    PROVIDERS[name] = call


def within(call: Callable[[str], str], prompt: str, limit: float) -> str:
    """The reply, or TimeoutError after ``limit`` seconds; a call that stalls goes on in a thread that nobody waits for."""
    out: list = []

    def work() -> None:
        try:
            out.append((call(prompt), None))
        except Exception as e:
            out.append((None, e))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(limit)
    if not out:
        raise TimeoutError(f"no reply in {limit:g} s")
    if out[0][1] is not None:
        raise out[0][1]
    return out[0][0]


def insisted(call: Callable[[str], str], prompt: str, tries: int, pause: float, limit: float) -> tuple[str | None, str | None]:
    """(reply, None), or (None, the last error) after ``tries`` calls; the pause between them doubles."""
    error = None
    for n in range(tries):
        try:
            return within(call, prompt, limit), None
        except Exception as e:  # a provider may fail in any way
            error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                time.sleep(pause * 2**n)
    return None, error


def replies(asked: DataFrame, provider: str, table: str, workers: int = 6, tries: int = 3, pause: float = 0.5, limit: float = 60.0, waves: int = 1) -> DataFrame:
    """(key, raw, error) for the prompts (prompt) of a provider, from a table of replies in a folder that all runs share.

    key is a hash of the provider's name and the prompt. Equal prompts are asked once, and those that the table has a reply to
    not at all; an error is kept too, but asked again by the next run. A task asks ``workers`` prompts at a time. The prompts
    are dealt to ``waves``, each of which is in the table when it has ended, so what breaks off later asks only those of its
    wave again. Null prompts are left out. An unknown provider is a KeyError.
    """
    call, spark = PROVIDERS[provider], asked.sparkSession
    keyed = asked.where("prompt is not null").select(reply_key(provider).alias("key"), "prompt").distinct()
    schema = "key string, raw string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                got = list(pool.map(lambda p: insisted(call, p, tries, pause, limit), batch["prompt"]))
                yield pd.DataFrame({"key": batch["key"], "raw": [g[0] for g in got], "error": [g[1] for g in got]})

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    there = lambda: at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    for wave in range(waves):
        todo = keyed.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
        if there():
            todo = todo.join(spark.read.schema(schema).parquet(table).where("error is null").select("key"), "key", "left_anti")
        todo.mapInPandas(run, schema).write.mode("append").parquet(table)
    # a reply is better than an error
    best = F.max_by(F.struct("raw", "error"), F.col("error").isNull())
    known = spark.read.schema(schema).parquet(table).groupBy("key").agg(best.alias("r"))
    return keyed.select("key").join(known, "key").select("key", "r.raw", "r.error")


def reply_key(provider: str) -> Column:
    return F.sha2(F.concat(F.lit(provider + "\n"), F.col("prompt")), 256)


def ask_provider(clauses: DataFrame, index: DataFrame, laws: DataFrame, provider: str, table: str, template: str, k: int = P.TOP_K, **how) -> DataFrame:
    """``ask`` by a provider's name: prompts from a template ({clause}, {laws}), replies through the table (see ``replies``)."""
    keyed = clauses.withColumn("query_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("clause_seq").cast("string")))
    offered = bm25_search(index, keyed.select("query_id", expanded(F.col("text")).alias("text")), k)
    built = prompts(keyed.select("query_id", "text"), offered, laws, template).withColumn("key", reply_key(provider))
    got = replies(built, provider, table, **how)
    return _gated(keyed, offered, built.join(got, "key").select("query_id", "raw", "error"), laws)


def quarantined(replies: DataFrame) -> DataFrame:
    """Claims whose citation failed, as they were made."""
    return replies.where(~F.col("gate_passed")).select("doc_id", "clause_seq", F.col("law_id").alias("claimed_law_id"), F.col("quote").alias("claimed_quote"))
