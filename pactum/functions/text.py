"""Text expressions. Columns in, columns out; offsets are 0-based code points.

Patterns run with Unicode classes, and only LF ends a line: Java's defaults differ in both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.functions.patterns import SYNONYMS

MARK = "\x01"


def java(pattern: str, multiline: bool = False) -> str:
    return ("(?Umd)" if multiline else "(?Ud)") + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none."""
    return F.when(matches(text, pattern), F.regexp_extract(text, java(pattern), group))


def replace_all(text: Column, pattern: str, by: str, multiline: bool = False) -> Column:
    return F.regexp_replace(text, java(pattern, multiline), by)


def stripped(text: Column) -> Column:
    return replace_all(text, r"^\s+|\s+$", "")


def number(text: Column) -> Column:
    """Digits with commas as a whole number; null for what is none or doesn't fit 64 bits."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def clean_contract(text: Column) -> Column:
    """One kind of line end and space, no runs of blanks, two line ends at most, no blanks around."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("　"), F.lit(" "))
    return stripped(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))


def tidy_layout(text: Column) -> Column:
    """Runs of three blanks or more mark columns ( | ), shorter ones are one blank; no blanks or bars around lines."""
    t = F.regexp_replace(F.regexp_replace(text, "[ \t]{3,}", " | "), "[ \t]{2}", " ")
    return stripped(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" |"))), "\n"))


def tidy_ocr(text: Column) -> Column:
    t = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), "[ \t]+", " ")
    return stripped(F.regexp_replace(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "\n"), "\n{3,}", "\n\n"))


def strip_tags(html: Column) -> Column:
    """Text of a fragment of HTML: no tags, ideographic spaces as blanks, runs of white space as one."""
    t = F.replace(F.regexp_replace(html, "<[^>]*>", ""), F.lit("　"), F.lit(" "))
    return F.trim(F.regexp_replace(t, "[ \t\n\r\f\x0b]+", " "))


def quote_form(text: Column) -> Column:
    """What quotes are compared by: no white space, middle dots, commas, periods, quotation marks or brackets."""
    return replace_all(text, r"[\s·ㆍ,.\"'“”‘’「」()\[\]]", "")


def bound(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, letters: str) -> Column:
    """How many characters of the text are of the class: its length without what is left when they go."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]+", ""))


def letter_ratio(text: Column, wanted: str = "가-힣", all_letters: str = "가-힣a-zA-Z一-鿿") -> Column:
    """Share of letters that are wanted; 0 without letters."""
    return F.coalesce(F.try_divide(count_of(text, wanted).cast("double"), count_of(text, all_letters)), F.lit(0.0))


def term_hits(text: Column, terms: list[str]) -> Column:
    """The terms that the text contains, in their order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def order_score(text: Column, pattern: str = r"제\s*(\d+)\s*조") -> Column:
    """1 with fewer than three numbers, else the share of neighbours that don't fall."""
    n = F.transform(F.regexp_extract_all(text, F.lit(java(pattern)), 1), lambda x: x.try_cast("bigint"))
    pairs = F.zip_with(F.slice(n, 1, F.size(n) - 1), F.slice(n, 2, F.size(n) - 1), lambda a, b: a <= b)
    rising = F.size(F.filter(pairs, lambda x: x)).cast("double")
    return F.when(F.size(n) < 3, F.lit(1.0)).otherwise(rising / (F.size(n) - 1))


def extraction_score(text: Column, terms: list[str], wanted: str = "가-힣", all_letters: str = "가-힣a-zA-Z一-鿿") -> Column:
    """How well a text was extracted, 0 to 1: wanted letters, known terms and numbers in order, less for font codes and few letters."""
    letters = count_of(text, all_letters)
    codes = F.regexp_count(text, F.lit(r"\(cid:\d+\)"))
    known = F.least(F.size(term_hits(text, terms)) / F.lit(8.0), F.lit(1.0))
    base = 0.45 * letter_ratio(text, wanted, all_letters) + 0.25 * known + 0.30 * order_score(text)
    penalty = F.greatest(F.lit(0.0), 1 - 20 * codes / F.greatest(F.length(text), F.lit(1)))
    # halves are told in doubles, as SQL's round_even does; bround goes by the shortest decimal that spells the double
    return F.rint(base * penalty * F.when(letters < 50, 0.3).otherwise(1.0) * 10_000.0) / 10_000.0


def looks_broken(text: Column, terms: list[str], wanted: str = "가-힣", all_letters: str = "가-힣a-zA-Z一-鿿") -> Column:
    return (count_of(text, all_letters) < 30) | (letter_ratio(text, wanted, all_letters) < 0.4) | (F.size(term_hits(text, terms)) < 2)


def tokens(text: Column) -> Column:
    """Words of Hangul, Latin letters and digits, then all pairs of neighbouring characters within words."""
    words = F.filter(F.split(F.regexp_replace(text, "[^가-힣a-zA-Z0-9]+", " "), " "), lambda w: w != "")
    pairs = F.transform(
        F.filter(words, lambda w: F.length(w) >= 2),
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))),
    )
    return F.concat(words, F.flatten(pairs))


def expanded(text: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The text with the terms of each key that it contains."""
    return F.concat_ws(" ", text, *[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in synonyms.items()])


def law_sentences(text: Column, least: int = 11) -> Column:
    """Sentences ending in 다., of ``least`` characters or more."""
    return F.filter(F.transform(F.split(text, r"(?<=다\.)[\s]*"), stripped), lambda s: F.length(s) >= least)


def document_sentences(text: Column, end: str = r"(?<=[다함]\.)\s+", least: int = 6) -> Column:
    parts = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(line, end)))
    return F.filter(F.transform(parts, stripped), lambda s: F.length(s) >= least)


def found(text: Column, pattern: str, multiline: bool = False, group: int | None = None) -> Column:
    """All matches as an array of (start, end, value[, group]); code-point offsets, exact also beyond the BMP.

    The text is cut at marks put around each match, and the lengths of the pieces add up to the offsets.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), java(pattern, multiline), f"{MARK}$0{MARK}")
    pieces = F.split(marked, MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("got"))
    # pieces alternate: what is between, then a match
    walked = F.aggregate(
        pieces,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x)).alias("at"),
            (acc["k"] + 1).alias("k"),
            F.when(acc["k"] % 2 == 1, F.concat(acc["got"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"), x.alias("value"))))).otherwise(acc["got"]).alias("got"),
        ),
    )
    return walked["got"]


def sentence_around_first(text: Column, pattern: str) -> Column:
    """The sentence that the first match begins in, between periods or line ends; null without a match."""
    before = F.regexp_extract(text, java(rf"(?s)^(.*?)(?:{pattern})"), 1)
    after = F.substring(text, F.length(before) + 1, F.length(text))
    return F.when(matches(text, pattern), F.concat(F.regexp_extract(before, r"[^.\n]*$", 0), F.regexp_extract(after, r"^[^.\n]*[.\n]?", 0)))


def reading_score(text: Column, terms: list[str], wanted: str = "가-힣", all_letters: str = "가-힣a-zA-Z一-鿿") -> Column:
    """How well a text was recognised: half for wanted letters, the rest for known terms and for length."""
    letters = count_of(text, all_letters)
    known = F.least(F.size(term_hits(text, terms)) / F.lit(6.0), F.lit(1.0))
    return 0.5 * letter_ratio(text, wanted, all_letters) + 0.35 * known + 0.15 * F.least(letters / F.lit(300.0), F.lit(1.0))


def plain_law_sentences(text: Column) -> Column:
    """Sentences of a law that serve as examples of nothing wrong: 15 to 120 characters, and no exceptions."""
    return F.filter(law_sentences(text), lambda s: F.length(s).between(15, 120) & ~s.startswith("다만"))
