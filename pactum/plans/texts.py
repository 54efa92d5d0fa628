"""Queries over the text tables, in forms that don't depend on the language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.functions import text as T
from pactum.operators import checks, evaluation, intervals, layout, masking, retrieval

MAIL = r"(?<![\w.])[\w.+-]+@[\w-]+\.[\w.]+"
#: Frequent word parts of the documents, as a vocabulary.
TERMS = ["the", "and", "that", "tion", "with", "for", "ing", "ent"]
LATIN, LETTERS = "a-zA-Z", "a-zA-ZÀ-ɏ"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts, as length and hash."""
    t = T.clean_contract(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n_chars"), F.sha2(t, 256).alias("sha256"))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags, as length and number of words."""
    t = T.strip_tags(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.length(t).alias("n_chars"), F.size(F.split(t, " ")).alias("n_words"), F.sha2(t, 256).alias("sha256"))


def tidy_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blanks and bars tidied."""
    t = T.tidy_layout(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n_chars"), F.sha2(t, 256).alias("sha256"))


def quote_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in the form that quotes are compared by."""
    q = T.quote_form(F.col("text"))
    return _table(spark, sf_dir, "benchmark").select("item_id", F.length(q).alias("n_chars"), F.sha2(q, 256).alias("sha256"))


def paragraph_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of eight characters or more as clauses, numbered without gaps."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.stripped), lambda x: F.length(x) >= 8)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("clause_seq"), F.length("line").alias("n_chars"), F.substring("line", 1, 30).alias("title"))


def input_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability check with a vocabulary of the documents' own."""
    c = _table(spark, sf_dir, "documents").select("doc_id", checks.input_check(F.col("text"), TERMS, LATIN, LETTERS).alias("c"))
    return c.select("doc_id", "c.ok", "c.reason", "c.weak", "c.length", "c.terms")


def letter_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of Latin letters, and broken texts, by language and source."""
    d = _table(spark, sf_dir, "documents").select("lang", "source", T.letter_ratio(F.col("text"), LATIN, LETTERS).alias("r"), T.looks_broken(F.col("text"), TERMS, LATIN, LETTERS).alias("b"))
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_ratio"), F.count_if("b").alias("n_broken"))


def best_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of three readings of each document: as it is, its first half, and with every letter e lost."""
    d = _table(spark, sf_dir, "documents")
    ways = [("whole", F.col("text")), ("half", F.expr("left(text, length(text) div 2)")), ("lossy", F.replace("text", F.lit("e"), F.lit("")))]
    tries = None
    for k, (name, t) in enumerate(ways):
        one = d.select("doc_id", F.lit(name).alias("engine"), F.lit(k).alias("engine_ord"), t.alias("text"))
        tries = one if tries is None else tries.union(one)
    return layout.best_extraction(tries, TERMS, LATIN, LETTERS)


def mail_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses by document with their places."""
    m = _table(spark, sf_dir, "documents").select("doc_id", F.explode(T.found(F.col("text"), MAIL)).alias("m"))
    return m.select("doc_id", F.col("m.start").alias("start_at"), F.col("m.value").alias("value"))


def mail_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with mail addresses masked, as hash."""
    s = masking.find_spans(_table(spark, sf_dir, "conversations"), [("mail", MAIL)], None)
    return s.select("conv_id", "turn", F.size("spans").alias("n_spans"), F.sha2(masking.masked(F.coalesce("text", F.lit("")), F.col("spans")), 256).alias("sha256"))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best benchmark passages for each document, whose whole text is the query."""
    corpus = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("law_id"), F.col("item_id").alias("pos"), F.col("text").alias("body"))
    queries = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return retrieval.bm25_search(retrieval.bm25_index(corpus), queries, spread=_tasks(spark)).select("query_id", "law_id", F.round("score", 4).alias("score"), "rank")


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and character pairs of the benchmark with their document frequency."""
    t = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("df"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citation gate on one quote a document and one item: of odd ids the first 40 characters, of even ids part of the item itself. ``quoted_items`` has whole documents."""
    items = _table(spark, sf_dir, "benchmark")
    n = items.agg(F.count("*").alias("n_items"))
    asked = _table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).select("doc_id", F.substring("text", 1, 40).alias("quote"), F.pmod("doc_id", "n_items").alias("item_id"))
    own = items.select("item_id", F.col("text").alias("source"))
    joined = asked.join(own, "item_id").withColumn("quote", F.when(F.col("doc_id") % 2 == 0, F.substring("source", 11, 30)).otherwise(F.col("quote")))
    return joined.select("doc_id", "item_id", retrieval.citation_holds(F.col("quote"), F.col("source")).alias("passes"))


def quoted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citation gate on every sentence of each document as a quote, against each of the items that retrieval offers for it."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"))
    index = retrieval.bm25_index(items.select(F.col("item_id").alias("law_id"), F.col("item_id").alias("pos"), F.col("source").alias("body")))
    sentences = F.split("text", r"\n|(?<=[.!?])\s+")
    quotes = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences).alias("quote_no", "quote")).withColumn("query_id", F.struct("doc_id", "quote_no"))
    offered = retrieval.bm25_search(index, quotes.select("query_id", F.col("quote").alias("text"))).select("query_id", F.col("law_id").alias("item_id"), "rank")
    gated = quotes.join(offered, "query_id").join(items, "item_id")
    return gated.select("doc_id", "quote_no", "item_id", "rank", retrieval.citation_holds(F.col("quote"), F.col("source")).alias("passes"))


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for bad quality (signs and capitals) against the labels: precision, recall, F1."""
    d = _table(spark, sf_dir, "documents")
    rule = d.where((F.regexp_count("text", F.lit("[#$%&*|!]")) * 50 > F.length("text"))).select("doc_id")
    labels = _table(spark, sf_dir, "labels")
    return evaluation.scores(evaluation.matched(rule.join(labels, "doc_id"), labels.where("quality = 0"), ["doc_id"]))


def label_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified folds of the labels."""
    return evaluation.folds(_table(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "fold")


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents that a first rule takes, those that only a second takes, and the rest."""
    d = _table(spark, sf_dir, "documents")
    first = d.where(F.col("text").rlike("idiot|moron|scum|worthless|pathetic")).select("doc_id", "source", F.lit("rule").alias("tier"))
    left = d.join(first.select("doc_id"), "doc_id", "left_anti")
    second = left.join(_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source", F.lit("label").alias("tier"))
    rest = left.join(second.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", F.lit("none").alias("tier"))
    return first.union(second).union(rest).groupBy("source").agg(*(F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("rule", "label", "none")))


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within ten minutes of each other, merged."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = _table(spark, sf_dir, "events").select("user_id", at.alias("begins"), (at + 600_000_000).alias("ends"))
    return intervals.merge_intervals(e, ["user_id"], "begins", "ends").select("user_id", F.col("start").alias("starts_at"), F.col("end").alias("ends_at"), "n")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark set in rows of ten on a page of 600 points, in two columns of five with a gutter."""
    w = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "text"))
    x0 = (F.col("i") % 10) * 50.0 + F.when(F.col("i") % 10 >= 5, 60.0).otherwise(0.0)
    return w.select("item_id", "text", x0.alias("x0"), (x0 + 40.0).alias("x1"), (F.floor(F.col("i") / 10) * 12.0).alias("top"), (F.floor(F.col("i") / 10) * 12.0 + 10.0).alias("bottom"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of words read row by row, with bars at wide gaps."""
    return layout.page_text(_words(spark, sf_dir), ["item_id"]).select("item_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def column_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of words read column by column."""
    return layout.column_text(_words(spark, sf_dir), ["item_id"], 600.0).select("item_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def hidden_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over characters 100 to 160 of each page, and the words that they cover."""
    words = layout.with_offsets(_words(spark, sf_dir), ["item_id"])
    spans = words.select("item_id").distinct().select("item_id", F.lit(1).alias("span"), F.lit(100).alias("start"), F.lit(160).alias("end"))
    drawn = layout.boxes(words, spans, ["item_id"])
    return layout.covered(words, drawn, ["item_id"]).select("item_id", "start", F.col("end").alias("stop"), "text")


def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of suppliers: weights for orders returned and late, capped and banded."""
    li = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("v"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.095)).alias("u"))
    score = F.least(F.lit(100), 25 * F.col("v") + 10 * F.col("u")).cast("int")
    return li.select("l_suppkey", score.alias("score"), F.when(score == 0, "safe").when(score <= 25, "caution").when(score <= 60, "warning").otherwise("danger").alias("grade"))


def worst_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each user's events by kind, then time."""
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "purchase", 0).otherwise(1), "ts", "event_id")
    return _table(spark, sf_dir, "events").withColumn("k", F.row_number().over(order)).where("k = 1").select("user_id", "event_id", "event_type")


def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each document reads, by letters, terms and length."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(T.reading_score(F.col("text"), TERMS, LATIN, LETTERS), 6).alias("score"))


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that follow a capitalised one in their row."""
    words = layout.with_offsets(_words(spark, sf_dir), ["item_id"])
    return layout.after_label(words, ["item_id"], "^[A-Z]").groupBy("item_id").agg(F.count("*").alias("n"), F.count_if("hidden").alias("n_hidden"))


def partly_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the lighter mask, as hash."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(masking.partly_masked(F.coalesce("text", F.lit(""))), 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (reading_scores, flagged_rows, partly_masked, cleaned_texts, page_words, tidy_tables, quote_forms, paragraph_clauses, input_reasons, letter_shares, best_engine, mail_spans, mail_masked, bm25_top, term_frequencies, citations, quoted_items, label_scores, label_folds, tiers, event_islands, page_texts, column_texts, hidden_words, risk_bands, worst_by_key)}

_SP = "[ \\t\\n\\r\\f\\v]"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '　', ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SP}+|{_SP}+$', '', 'g')"
_TIDY = f"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \\t]{{3,}}', ' | ', 'g'), '[ \\t]{{2}}', ' ', 'g'), chr(10)), lambda x: trim(x, ' |')), chr(10)), '^{_SP}+|{_SP}+$', '', 'g')"
_TAGS = "trim(regexp_replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '　', ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_QUOTE = """regexp_replace(text, '[\\s·ㆍ,."''“”‘’「」()\\[\\]]', '', 'g')"""
_WORDS = """words AS (SELECT item_id, w AS text, i, (i % 10) * 50.0 + CASE WHEN i % 10 >= 5 THEN 60.0 ELSE 0.0 END AS x0, i // 10 AS r FROM
    (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM benchmark))"""
_GRAMS = """list_concat(w, flatten(list_transform(list_filter(w, lambda x: length(x) >= 2), lambda x: list_transform(range(1, length(x)), lambda j: substring(x, j, 2)))))"""
_TOK = "(list_filter(string_split(regexp_replace(coalesce(text, ''), '[^가-힣a-zA-Z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))"
_HITS = " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in TERMS)


def _count(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_WEIGHTS = f"""WITH b AS (SELECT item_id, {_TOK} AS w FROM benchmark), bt AS (SELECT item_id, unnest({_GRAMS}) AS term FROM b), tf AS (SELECT item_id, term, count(*) AS tf FROM bt GROUP BY ALL),
        dl AS (SELECT item_id, sum(tf) AS dl FROM tf GROUP BY ALL), st AS (SELECT (SELECT count(*) FROM benchmark) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM benchmark) AS av),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), f AS (SELECT 0.25 * avg(idf) AS floor FROM i),
        w AS (SELECT tf.term, item_id, CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)) AS weight FROM tf JOIN i USING (term) JOIN dl USING (item_id), f, st),"""
ORACLE_SQL = {
    "reading_scores": f"""WITH a AS (SELECT doc_id, {_count('[a-zA-ZÀ-ɏ]')} AS l, coalesce({_count('[a-zA-Z]')} / nullif({_count('[a-zA-ZÀ-ɏ]')}, 0), 0) AS r, {_HITS.replace("contains(t,", "contains(text,")} AS h FROM documents)
        SELECT doc_id, round(0.5 * r + 0.35 * least(h / 6.0::DOUBLE, 1) + 0.15 * least(l / 300.0::DOUBLE, 1), 6) AS score FROM a""",
    "flagged_rows": f"""WITH {_WORDS}, h AS (SELECT item_id, coalesce(max(CAST(regexp_matches(text, '^[A-Z]') AS INT)) OVER (PARTITION BY item_id, r ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM words)
        SELECT item_id, count(*) AS n, count(*) FILTER (h = 1) AS n_hidden FROM h GROUP BY item_id""",
    "partly_masked": """SELECT conv_id, turn, sha256(regexp_replace(coalesce(text, ''), '([A-Za-z0-9_.+-]{1,3})[A-Za-z0-9_.+-]*@([A-Za-z0-9_-]+[.][A-Za-z0-9_.]+)', '\\1***@\\2', 'g')) AS sha256 FROM conversations""",
    "cleaned_texts": f"SELECT doc_id, CAST(length({_CLEAN}) AS INT) AS n_chars, sha256({_CLEAN}) AS sha256 FROM documents",
    "page_words": f"SELECT page_id, CAST(length({_TAGS}) AS INT) AS n_chars, CAST(len(string_split({_TAGS}, ' ')) AS INT) AS n_words, sha256({_TAGS}) AS sha256 FROM pages",
    "tidy_tables": f"SELECT doc_id, CAST(length({_TIDY}) AS INT) AS n_chars, sha256({_TIDY}) AS sha256 FROM documents",
    "quote_forms": f"SELECT item_id, CAST(length({_QUOTE}) AS INT) AS n_chars, sha256({_QUOTE}) AS sha256 FROM benchmark",
    "paragraph_clauses": f"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')), lambda x: length(x) >= 8)) AS line,
            generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')), lambda x: length(x) >= 8), 1) AS i FROM documents)
        SELECT doc_id, CAST(i AS INT) AS clause_seq, CAST(length(line) AS INT) AS n_chars, left(line, 30) AS title FROM l""",
    "input_reasons": f"""WITH a AS (SELECT doc_id, regexp_replace(text, '^{_SP}+|{_SP}+$', '', 'g') AS t FROM documents),
        b AS (SELECT *, CAST(length(regexp_replace(t, '\\s+', '', 'g')) AS INT) AS n, {_count('[a-zA-Z]', 't')} / nullif({_count('[a-zA-ZÀ-ɏ]', 't')}, 0) AS r, CAST({_HITS} AS INT) AS h, {_count('[a-zA-Z]{3,}', 't')} AS w FROM a),
        c AS (SELECT *, CASE WHEN n < 50 THEN 'too_short' WHEN coalesce(r, 0) < 0.3 THEN CASE WHEN w >= 15 THEN 'not_korean' ELSE 'garbled' END WHEN h < 3 THEN 'not_contract' ELSE 'ok' END AS reason FROM b)
        SELECT doc_id, reason = 'ok' AS ok, reason, CASE WHEN reason = 'ok' THEN h < 6 OR n < 200 END AS weak, CASE WHEN reason IN ('ok', 'too_short') THEN n END AS length, CASE WHEN reason <> 'too_short' THEN h END AS terms FROM c""",
    "letter_shares": f"""WITH a AS (SELECT lang, source, {_count('[a-zA-ZÀ-ɏ]')} AS l, coalesce({_count('[a-zA-Z]')} / nullif({_count('[a-zA-ZÀ-ɏ]')}, 0), 0) AS r, {_HITS.replace("contains(t,", "contains(text,")} AS h FROM documents)
        SELECT lang, source, count(*) AS n, round(avg(r), 6) AS mean_ratio, count(*) FILTER (l < 30 OR r < 0.4 OR h < 2) AS n_broken FROM a GROUP BY ALL""",
    "best_engine": f"""WITH t AS (SELECT doc_id, 'whole' AS engine, 0 AS o, text AS t FROM documents UNION ALL SELECT doc_id, 'half', 1, left(text, length(text) // 2) FROM documents UNION ALL SELECT doc_id, 'lossy', 2, replace(text, 'e', '') FROM documents),
        s AS (SELECT *, round_even((0.45 * coalesce({_count('[a-zA-Z]', 't')} / nullif({_count('[a-zA-ZÀ-ɏ]', 't')}, 0), 0) + 0.25 * least(({_HITS}) / 8.0::DOUBLE, 1) + 0.3) * CASE WHEN {_count('[a-zA-ZÀ-ɏ]', 't')} < 50 THEN 0.3 ELSE 1 END, 4) AS score FROM t)
        SELECT doc_id, engine, score, tried FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS k, count(*) OVER (PARTITION BY doc_id) AS tried FROM s) WHERE k = 1""",
    "mail_spans": """WITH m AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]+'))) AS value FROM documents),
        p AS (SELECT doc_id, value, string_split(text, value) AS parts FROM m),
        q AS (SELECT doc_id, value, unnest(range(1, len(parts))) AS k, parts FROM p)
        SELECT doc_id, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(value) AS INT) AS start_at, value FROM q""",
    "mail_masked": """WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
        SELECT conv_id, turn, CAST(len(regexp_extract_all(t, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]+')) AS INT) AS n_spans, sha256(regexp_replace(t, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]+', '[mail]', 'g')) AS sha256 FROM m""",
    "bm25_top": f"""{_WEIGHTS}
        d AS (SELECT doc_id, {_TOK} AS w FROM documents), q AS (SELECT doc_id, term, count(*) AS qtf FROM (SELECT doc_id, unnest({_GRAMS}) AS term FROM d) GROUP BY ALL),
        s AS (SELECT doc_id AS query_id, item_id AS law_id, round(sum(qtf * weight), 9) AS score FROM q JOIN w USING (term) GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, law_id) AS INT) AS rank FROM s WHERE score > 0)
        SELECT query_id, law_id, round(score, 4) AS score, rank FROM r WHERE rank <= 4""",
    "quoted_items": f"""{_WEIGHTS}
        d AS (SELECT doc_id, unnest(p) AS quote, CAST(generate_subscripts(p, 1) - 1 AS INT) AS quote_no FROM (SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?])[ \\t\\r\\f\\v][ \\t\\n\\r\\f\\v]*', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) AS p FROM documents)),
        q AS (SELECT doc_id, quote_no, term, count(*) AS qtf FROM (SELECT doc_id, quote_no, unnest({_GRAMS}) AS term FROM (SELECT doc_id, quote_no, {_TOK.replace("text", "quote")} AS w FROM d)) GROUP BY ALL),
        s AS (SELECT doc_id, quote_no, item_id, round(sum(qtf * weight), 9) AS score FROM q JOIN w USING (term) GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, quote_no ORDER BY score DESC, item_id) AS INT) AS rank FROM s WHERE score > 0),
        g AS (SELECT doc_id, quote_no, {_QUOTE.replace("regexp_replace(text", "regexp_replace(quote")} AS x FROM d), n AS (SELECT item_id, {_QUOTE} AS y FROM benchmark)
        SELECT doc_id, quote_no, item_id, rank, coalesce(length(x) >= 12 AND contains(y, x), false) AS passes FROM r JOIN g USING (doc_id, quote_no) JOIN n USING (item_id) WHERE rank <= 4""",
    "term_frequencies": f"WITH b AS (SELECT item_id, {_TOK} AS w FROM benchmark), t AS (SELECT item_id, unnest({_GRAMS}) AS term FROM b) SELECT term, count(*) AS n, count(DISTINCT item_id) AS df FROM t GROUP BY term",
    "citations": f"""WITH a AS (SELECT doc_id, left(d.text, 40) AS quote, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents d),
        j AS (SELECT doc_id, item_id, CASE WHEN doc_id % 2 = 0 THEN substring(b.text, 11, 30) ELSE quote END AS q, b.text AS s FROM a JOIN benchmark b USING (item_id)),
        k AS (SELECT doc_id, item_id, {_QUOTE.replace("regexp_replace(text", "regexp_replace(q")} AS q, {_QUOTE.replace("regexp_replace(text", "regexp_replace(s")} AS s FROM j)
        SELECT doc_id, item_id, length(q) >= 12 AND contains(s, q) AS passes FROM k""",
    "label_scores": f"""WITH p AS (SELECT DISTINCT doc_id FROM documents JOIN labels USING (doc_id) WHERE {_count('[#$%&*|!]')} * 50 > length(text)), e AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
        n AS (SELECT (SELECT count(*) FROM p JOIN e USING (doc_id)) AS tp, (SELECT count(*) FROM p ANTI JOIN e USING (doc_id)) AS fp, (SELECT count(*) FROM e ANTI JOIN p USING (doc_id)) AS fn),
        r AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM n)
        SELECT tp, fp, fn, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r""",
    "label_folds": "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 3 AS INT) AS fold FROM labels",
    "tiers": """WITH t AS (SELECT source, CASE WHEN regexp_matches(text, 'idiot|moron|scum|worthless|pathetic') THEN 'rule' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'label' ELSE 'none' END AS tier FROM documents)
        SELECT source, count(*) FILTER (tier = 'rule') AS n_rule, count(*) FILTER (tier = 'label') AS n_label, count(*) FILTER (tier = 'none') AS n_none FROM t GROUP BY source""",
    "event_islands": """WITH e AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 600000000 AS b FROM events),
        o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM e),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY a, b DESC ROWS UNBOUNDED PRECEDING) AS island FROM o)
        SELECT user_id, min(a) AS starts_at, max(b) AS ends_at, count(*) AS n FROM i GROUP BY user_id, island""",
    "page_texts": f"""WITH {_WORDS}, l AS (SELECT item_id, r, string_agg(CASE WHEN i % 10 = 0 THEN '' WHEN i % 10 = 5 THEN ' | ' ELSE ' ' END || text, '' ORDER BY i) AS line FROM words GROUP BY ALL),
        t AS (SELECT item_id, string_agg(line, chr(10) ORDER BY r) AS t FROM l GROUP BY ALL) SELECT item_id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS sha256 FROM t""",
    "column_texts": f"""WITH {_WORDS}, l AS (SELECT item_id, r, i % 10 >= 5 AS side, string_agg(text, ' ' ORDER BY i) AS line FROM words GROUP BY ALL), n AS (SELECT item_id, count(*) AS n FROM words GROUP BY ALL),
        t AS (SELECT item_id, string_agg(line, chr(10) ORDER BY side, r) AS t FROM l JOIN n USING (item_id) WHERE n >= 20 GROUP BY item_id) SELECT item_id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS sha256 FROM t""",
    "hidden_words": f"""WITH {_WORDS}, o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM words)
        SELECT item_id, CAST(s AS INT) AS start, CAST(s + length(text) AS INT) AS stop, text FROM o WHERE s < 160 AND s + length(text) > 100""",
    "risk_bands": """WITH n AS (SELECT l_suppkey, CAST(least(100, 25 * count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) + 10 * count(*) FILTER (l_linestatus = 'O' AND l_discount > 0.095)) AS INT) AS score FROM lineitem GROUP BY ALL)
        SELECT l_suppkey, score, CASE WHEN score = 0 THEN 'safe' WHEN score <= 25 THEN 'caution' WHEN score <= 60 THEN 'warning' ELSE 'danger' END AS grade FROM n""",
    "worst_by_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts, event_id) AS k FROM events) WHERE k = 1",
}


def language_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated language of each document, by its whole text: no SQL, the model is fitted."""
    from pactum.operators import classifier

    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))
    return classifier.cross_validated(d, parts=2).select(F.col("key").alias("doc_id"), "label", "fold", "predicted", F.round("confidence", 3).alias("confidence"))


def language_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the languages said by models of the other half, by tenths of confidence: how many, how sure on the whole, how many right. No SQL."""
    from pactum.operators import classifier

    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))
    said = classifier.cross_validated(d, k=2, parts=2)
    return classifier.reliability(said).select("bin", "n", F.round("confidence", 3).alias("confidence"), F.round("accuracy", 3).alias("accuracy"))


QUERIES["language_classifier"] = language_classifier
QUERIES["language_reliability"] = language_reliability
