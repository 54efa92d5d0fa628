"""Documents into clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions import patterns as P
from pactum.functions.text import MARK, clean_contract, found, java, stripped


def _signature_start(text: Column) -> Column:
    """Where the signature block begins: the first such line from 45 % of the text on; null if there is none."""
    late = F.filter(found(text, P.SIGNATURE, multiline=True), lambda m: m["start"] >= F.floor(F.length(text) * P.SIGNATURE_RATIO))
    return F.get(late, F.lit(0))["start"]


def _articles(body: Column, heads: Column) -> Column:
    """(article_no, title, text, start, end) of each article of a text, which runs up to the next one; what comes before is left out."""
    ends = F.concat(F.slice(F.transform(heads, lambda h: h["start"]), 2, F.size(heads)), F.array(F.length(body)))

    def clause(h: Column, end: Column) -> Column:
        no = F.regexp_extract(h["value"], java(P.ARTICLE), 1)
        title = F.regexp_extract(h["value"], java(P.ARTICLE), 2)
        text = stripped(F.substring(body, h["end"] + 1, end - h["end"]))
        return F.struct(no.try_cast("int").alias("article_no"), F.when(title == "", F.concat(F.lit("제"), no.try_cast("int").cast("string"), F.lit("조"))).otherwise(stripped(title)).alias("title"), text.alias("text"), h["start"].alias("start"), end.alias("end"))

    return F.zip_with(heads, ends, clause)


def _cut(body: Column) -> list[Column]:
    """Paragraphs, list items and lines."""
    long = lambda parts: F.filter(F.transform(parts, stripped), lambda p: F.length(p) >= P.MIN_CLAUSE)
    paragraphs = long(F.split(body, r"\n\s*\n"))
    items = long(F.split(F.regexp_replace(body, java(P.ITEM, True), MARK), MARK))
    lines = long(F.split(body, "\n"))
    return [paragraphs, items, lines]


def _placed(body: Column, parts: Column) -> Column:
    """The parts with their offsets: each is looked for after the one before; one that isn't found starts at 0."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<article_no:int,title:string,text:string,start:int,end:int>>").alias("got"))

    def place(acc: Column, p: Column) -> Column:
        at = F.call_function("locate", p, body, acc["at"] + 1)
        begin = F.when(at > 0, at - 1).otherwise(0)
        title = F.substring(F.substring_index(p, "\n", 1), 1, 30)
        one = F.struct(F.lit(None).cast("int").alias("article_no"), title.alias("title"), p.alias("text"), begin.alias("start"), (begin + F.length(p)).alias("end"))
        return F.struct(F.when(at > 0, begin + F.length(p)).otherwise(acc["at"]).alias("at"), F.concat(acc["got"], F.array(one)).alias("got"))

    return F.aggregate(parts, start, place)["got"]


def segment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """(doc_id, clause_seq, clause_id, article_no, title, text, start, end), one row a clause.

    Articles if there are two or more, else parts by a cascade. A signature block in the later part becomes a last
    clause without a number. Clauses under eight characters are skipped, and numbers have no gaps. Offsets are those of
    the cleaned text. Null and empty texts have no clause. All in one projection and one explode: no shuffle.

    ``carry``: columns of docs that each clause keeps. With ``outer``, a document without a clause is a row whose
    clause_seq and all that follows are null.
    """
    cleaned = docs.select(F.col(id_col).alias("doc_id"), clean_contract(F.col(text_col)).alias("t"), *carry)
    cut = cleaned.withColumn("sig", _signature_start(F.col("t")))
    body = cut.withColumn("body", F.when(F.col("sig").isNull(), F.col("t")).otherwise(F.substring(F.col("t"), F.lit(1), F.col("sig"))))
    none = F.array().cast("array<string>")
    headed = body.withColumn("heads", found(F.col("body"), P.ARTICLE)).withColumn("by_article", F.size("heads") >= P.MIN_ARTICLES)
    # the first way that gives two parts or more
    ways = headed.withColumns({f"way{k}": F.when(F.col("by_article"), none).otherwise(w) for k, w in enumerate(_cut(F.col("body")))})
    parts = F.when(F.size("way0") >= 2, F.col("way0")).when(F.size("way1") >= 2, F.col("way1")).otherwise(F.col("way2"))
    body = ways.withColumn("parts", parts)
    clauses = F.when(F.col("by_article"), F.filter(_articles(F.col("body"), F.col("heads")), lambda c: F.length(c["text"]) >= P.MIN_CLAUSE)).otherwise(_placed(F.col("body"), F.col("parts")))
    tail = stripped(F.substring(F.col("t"), F.col("sig") + 1, F.length("t")))
    signature = F.when(
        F.length(tail) >= P.MIN_CLAUSE,
        F.array(F.struct(F.lit(None).cast("int").alias("article_no"), F.lit("서명란").alias("title"), tail.alias("text"), F.col("sig").alias("start"), F.length("t").alias("end"))),
    ).otherwise(F.array().cast("array<struct<article_no:int,title:string,text:string,start:int,end:int>>"))
    explode = F.posexplode_outer if outer else F.posexplode
    rows = body.select("doc_id", *carry, explode(F.concat(clauses, signature)).alias("pos", "c"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("clause_seq"), F.concat(F.lit("c"), F.col("pos") + 1).alias("clause_id"), "c.article_no", "c.title", "c.text", "c.start", "c.end", *carry)
