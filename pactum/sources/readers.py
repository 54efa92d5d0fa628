"""Readers: statutes, documents, PDF files, words of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.text import strip_tags, stripped

LAW = "id string, law string, article string, title string, text string, verified boolean"


def laws(spark: SparkSession, path: str) -> DataFrame:
    """(id, law, article, title, text, verified, pos) of a JSON array of articles, pos being its place in the file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{LAW.replace(' ', ':').replace(',:', ',')}>>").alias("a"))
    return whole.select(F.posexplode("a").alias("pos", "a")).select("a.*", "pos")


def unverified(table: DataFrame) -> DataFrame:
    return table.where(~F.coalesce("verified", F.lit(False)))


def statutes_from_service(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, law, article, title, text) of service replies (law, body: JSON with one article or a list of them), of the wanted (law, article)."""
    unit = "struct<no:string,title:string,paragraphs:array<string>>"
    many = F.from_json("body", f"array<{unit}>")
    one = F.array(F.from_json("body", unit))
    units = raw.select("law", F.explode(F.when(F.col("body").startswith("["), many).otherwise(one)).alias("u"))
    text = F.array_join(F.transform("u.paragraphs", strip_tags), " ")
    got = units.select("law", F.concat(F.lit("제"), "u.no", F.lit("조")).alias("article"), F.col("u.title").alias("title"), F.regexp_replace(text, r"^제\d+조(?:의\d+)?\([^)]*\)\s*", "").alias("text"))
    return got.join(wanted, ["law", "article"]).withColumn("id", F.concat("law", F.lit("-"), "article"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of text files: trimmed, empty ones left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), stripped(F.coalesce("value", F.lit(""))).alias("text"))
    return rows.where(F.length("text") > 0)


def pdf_files(spark: SparkSession, path: str, most_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, content) of the .pdf files (in either case) up to a size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.where((F.col("length") > 0) & (F.col("length") <= most_bytes)).select(F.col("path").alias("doc_id"), "content")


#: Engines by name, in the order in which equal scores are settled: bytes to text.
ENGINES: dict[str, Callable[[bytes], str]] = {}


def register_engine(name: str, engine: Callable[[bytes], str]) -> None:
    ENGINES[name] = engine


def attempts(files: DataFrame, engines: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(doc_id, engine, engine_ord, text, error) of each engine on each file (doc_id, content); one that fails has its error."""
    tools = list((engines or ENGINES).items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                for k, (name, tool) in enumerate(tools):
                    try:
                        out.append((doc_id, name, k, tool(bytes(content)), None))
                    except Exception as e:  # an engine may fail in any way; the others still count
                        out.append((doc_id, name, k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "engine", "engine_ord", "text", "error"])

    return files.mapInPandas(run, "doc_id string, engine string, engine_ord int, text string, error string")


def diagnosis(tried: DataFrame) -> DataFrame:
    """(doc_id, reason) of attempts (doc_id, text, error, images): encrypted, unreadable, ok, scanned or empty."""
    per = tried.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"), F.max("error").alias("error"), F.max("images").alias("images"), F.count("text").alias("read"))
    locked = F.lower("error").rlike("password|encrypt")
    reason = F.when((F.col("read") == 0) & locked, "encrypted").when(F.col("read") == 0, "unreadable").when(F.col("n") >= 50, "ok").when(F.col("images") > 0, "scanned").otherwise("empty")
    return per.select("doc_id", reason.alias("reason"))
