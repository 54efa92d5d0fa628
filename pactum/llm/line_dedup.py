"""Fuzzy line deduplication with DataFrame functions alone.

Lines are normalised (lower case, runs of anything but letters and numbers become one space) and identified by
the 64-bit hash of that form. Two lines are links if their edit similarity is SIMILAR or more. Which are compared:

* Under SHORT characters all that can be links: if at most t letters differ, one of t + 1 pieces of the shorter line
  stands in the longer one, near its place. Lines with the same piece at such a place meet.
* Longer lines by the blocks of their SimHash. Its projections are sparse: a line's words fall into as many classes as
  it has blocks, by their hash, and the words of a class vote on the 64 bits of one block only. A word that differs
  then changes one block and leaves the others as they are, so of m blocks one is equal if fewer than m words differ
  (a replaced word counts twice), and by the luck of the classes often with more. Lines with an equal block meet.

Pairs that meet are compared if their lengths, their SimHashes and the counts of their letters allow a link: of the 60 bits kept,
ten or five of a block, unrelated lines differ in about 30, and letters whose counts differ are edits (see ``bags``). Of each connected group of lines one occurrence stays, the first by document and line.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.text import bound
from pactum.llm.components import components
from pactum.llm.shared import partitions, release, stored

DISTANCE, SIMILAR, HOT = 28, 0.9, 8
#: Rows of 8 bytes that are broadcast at most.
BROADCAST = 1_000_000
#: Documents with lists of line numbers that are broadcast at most.
FEWER = 250_000
#: Lines under SHORT characters meet by pieces. Those of over LONG are compared word by word.
SHORT, LONG = 60, 2_000
#: Words of over WORD letters count by their pairs of letters, so writing without blanks has features too.
WORD = 20
#: Words of up to SMALL letters, the most frequent ones, count together with the word after them.
SMALL = 3
#: Blocks of a line of under and from EDGE characters on; a line that may have a partner on the other side has both.
FEW, MORE, EDGE = 6, 12, 200
#: Lines of under THIN characters also have AGAIN blocks, other classes of their few words.
AGAIN, THIN = 5, 200
#: Lines of MANY characters have HUGE blocks: no count of a block outgrows its lane.
MANY, HUGE = 131_072, 4096
#: Lines of a family are compared in squares of SIDE by SIDE; distances that spare comparisons are taken where GAIN times as many may go.
SIDE, GAIN = 64, 8
#: Features that a block must have to be a key.
LEAST = 2
#: Letters that are counted in both halves of a line; any would do.
LETTERS = " etaonirhsdulc"
#: Longs that hold a line's counts, four in each.
BAGS = len(LETTERS) // 2
#: Four lanes of 16 bits; counts are compared in 15 of each.
ONES, TOPS = 0x0001000100010001, 0x4000400040004000


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, line_no, norm) of every line that has a letter or number."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return lines.select("doc_id", "tie", "line_no", normal(F.col("raw")).alias("norm")).where("norm <> ''")


def features(norm: Column) -> Column:
    """Hashes of the different words of a line, a word of up to SMALL letters with the one after it.

    A word of over WORD letters counts by its pairs of letters.
    """

    def pairs(word: Column) -> Column:
        return F.flatten(F.transform(F.array(F.split(word, "")), lambda cs: F.transform(cs, lambda c, i: F.xxhash64(c, F.get(cs, i + 1)))))

    def hashed(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.when(F.length(w) > SMALL, F.xxhash64(w)).otherwise(F.xxhash64(w, F.get(words, i + 1))))

    def cut(words: Column) -> Column:
        return F.flatten(F.transform(words, lambda w, i: F.when(F.length(w) > WORD, pairs(w)).when(F.length(w) > SMALL, F.array(F.xxhash64(w))).otherwise(F.array(F.xxhash64(w, F.get(words, i + 1))))))

    # a variable of transform, so the words are split once
    once = F.array(F.split(norm, " "))
    return F.array_distinct(F.when(norm.rlike(f"[^ ]{{{WORD + 1}}}"), F.flatten(F.transform(once, cut))).otherwise(F.flatten(F.transform(once, hashed))))


def _bits(count: Column) -> Column:
    """The 64 bits that more than half of a block's features have; s0 to s15 count them, s<k> bits k, 16 + k, 32 + k, 48 + k."""
    short = (F.lit(0x3FFF) - F.floor(count / 2)).cast("long") * F.lit(ONES)
    out = F.lit(0).cast("long")
    for k in range(16):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned((F.col(f"s{k}") + short).bitwiseAND(F.lit(TOPS)), 14), k))
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """(line, m, class, count, bits): the m blocks of the rows (line, m, norm).

    Rows that lie by line stay where they are: one aggregation and no shuffle.
    """
    votes = rows.select("line", "m", F.explode_outer(features(F.col("norm"))).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(ONES))).alias(f"s{k}") for k in range(16)]
    counted = votes.groupBy("line", "m", F.pmod("h", "m").alias("class")).agg(F.count("*").alias("count"), *sums)
    return counted.select("line", "m", "class", "count", _bits(F.col("count")).alias("bits"))


def sim_hashes(lines: DataFrame) -> DataFrame:
    """(line, key, m, class, kept) of the rows (line, norm): lines that may be links have a key in common.

    Rows of FEW or MORE blocks have the bits that are kept of the block.
    """
    one, n = lines.groupBy("line").agg(F.first("norm").alias("norm")), F.length("norm")
    m = [F.when((n >= low) & (n <= high), F.lit(k).cast("long")) for k, low, high in ((AGAIN, SHORT * SIMILAR - 1, THIN / SIMILAR + 1), (FEW, SHORT * SIMILAR - 1, EDGE / SIMILAR + 1), (MORE, EDGE * SIMILAR - 1, MANY / SIMILAR + 1), (HUGE, MANY * SIMILAR - 1, 1 << 31))]
    cut = blocks(one.where(n >= SHORT * SIMILAR - 1).select("line", F.explode(F.array_compact(F.array(*m))).alias("m"), "norm")).where(F.col("count") >= LEAST)
    width = F.when(F.col("m") == FEW, F.lit(60 // FEW)).otherwise(F.lit(60 // MORE)).cast("int")
    kept = F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), width) - F.lit(1)).cast("int")
    long = cut.select("line", F.xxhash64("m", "class", "bits").alias("key"), F.col("m").cast("int").alias("m"), F.col("class").cast("int").alias("class"), F.when(F.col("m").isin(FEW, MORE), kept).alias("kept"))
    plan = lines.sparkSession.createDataFrame(pieces(), "n int, shorter int, most int, piece int, first int, size int")
    short = one.where(n < SHORT).withColumn("n", n).join(F.broadcast(plan), "n")
    none = F.lit(None).cast("int")
    return long.union(short.select("line", F.xxhash64("shorter", "most", "piece", F.expr("substring(norm, first, size)")), none, none, none))


def _most(length: int) -> int:
    """The edits that lines with the longer one of this length may be apart."""
    return int((1 - SIMILAR) * length + 1e-9)


def pieces() -> list[tuple[int, int, int, int, int, int]]:
    """(length, shorter, most, piece, first, size): where a line of some length may hold a piece of a shorter line.

    A line also has its own pieces, at their own places, for longer partners with as many edits at most.
    """
    rows = set()
    for longer in range(SHORT):
        most = _most(longer)
        for shorter in range(longer - most, longer + 1) if most else ():
            small, larger = divmod(shorter, most + 1)
            more, first = longer - shorter, 0
            for i in range(most + 1):
                size = small + (i > most - larger)
                rows.add((shorter, shorter, most, i, first + 1, size))
                for at in range(max(0, first - i, first + more - (most - i)), min(longer - size, first + i, first + more + most - i) + 1):
                    rows.add((longer, shorter, most, i, at + 1, size))
                first += size
    return sorted(rows)


def bags(rows: DataFrame) -> DataFrame:
    """The rows with bag0, bag1, ...: how often the line norm has each of LETTERS in its first and its second half.

    A count, by its rest of 32, is a ring code of 16 bits: codes differ in as many bits as the rests lie apart on the ring, so
    in no more than the counts do. Where e edits turn one line into another, the counts of both halves together differ by
    2 e + 1 at most: an edit changes two counts by one; letters that edits shift over the middle count twice, but the edits that
    shift them are insertions or deletions, which change one count, and the middle moves with half the difference in length.
    """
    n = F.length("norm")
    middle = F.floor(n / 2).cast("int")
    halves = F.array(F.substring("norm", F.lit(1), middle), F.substring("norm", middle + 1, n))
    letters = F.array(*map(F.lit, LETTERS))
    rests = F.flatten(F.transform(halves, lambda p: F.transform(letters, lambda c: (F.octet_length(p) - F.octet_length(F.replace(p, c, F.lit("")))) % 32)))
    ones = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1
    ring = F.transform(rests, lambda r: F.when(r <= 16, ones(r)).otherwise(F.lit(0xFFFF) - ones(r - 16)))
    longs = [F.shiftleft(F.get("ring", F.lit(i)), 16 * (i % 4)) for i in range(2 * len(LETTERS))]
    packed = [functools.reduce(Column.bitwiseOR, longs[4 * k : 4 * k + 4]).alias(f"bag{k}") for k in range(BAGS)]
    return rows.withColumn("ring", ring).select(*rows.columns, *packed)


def _near(x: str, y: str) -> Column:
    """Lengths, SimHashes and letters allow a link; short lines, and those without a SimHash in common, may be one with any by SimHash.

    Lines of over LONG letters, which are compared by words, may be one whatever their letters.
    """
    longer, shorter = F.greatest(f"{x}.n", f"{y}.n"), F.least(f"{x}.n", f"{y}.n")
    apart = F.least(*[F.bit_count(F.col(f"{x}.sim{m}").bitwiseXOR(F.col(f"{y}.sim{m}"))) for m in (FEW, MORE)])
    most = F.floor((1 - SIMILAR) * longer + 1e-9)
    edits = sum((F.bit_count(F.col(f"{x}.bag{k}").bitwiseXOR(F.col(f"{y}.bag{k}"))) for k in range(1, BAGS)), F.bit_count(F.col(f"{x}.bag0").bitwiseXOR(F.col(f"{y}.bag0"))))
    return (longer - shorter <= most) & ((longer < SHORT) | F.coalesce(apart <= DISTANCE, F.lit(True))) & ((longer > LONG) | (edits <= 2 * most + 1))


def _letters(norm: str) -> Column:
    """The line with one of 4,096 letters for each word, by its hash."""
    coded = F.transform(F.split(norm, " "), lambda w: F.concat(F.lit("1"), F.substring(F.lpad(F.hex(F.xxhash64(w)), 16, "0"), 1, 3)))
    return F.decode(F.unhex(F.array_join(coded, "")), "UTF-16BE")


def _common(a: Column, b: Column) -> Column:
    """The letters that a and b begin with alike, or fewer if over 2 ** 17 are."""
    most = F.least(F.length(a), F.length(b))
    same = lambda p, k: (p + k <= most) & (F.substring(a, p + 1, k) == F.substring(b, p + 1, k))
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(16, -1, -1)]), F.lit(0), lambda p, k: F.when(same(p, k), p + k).otherwise(p))


def _middles(a: Column, b: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then`` of what is left of a and b without what both begin and end with, reversed. It is as many edits apart."""
    rest = lambda p: F.struct(F.reverse(F.substring(p["a"], p["n"] + 1, p["a_n"])).alias("a"), F.reverse(F.substring(p["b"], p["n"] + 1, p["b_n"])).alias("b"))
    cut = lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.length(p["a"]).alias("a_n"), F.length(p["b"]).alias("b_n"), _common(p["a"], p["b"]).alias("n"))
    tail = lambda p: then(F.substring(p["a"], p["n"] + 1, p["a_n"]), F.substring(p["b"], p["n"] + 1, p["b_n"]))
    return bound(bound(bound(bound(F.struct(a.alias("a"), b.alias("b")), cut), rest), cut), tail)


def _by_parts(a: Column, b: Column, most: Column) -> Column:
    """True only where a and b are ``most`` edits apart or fewer: their eighths, one by one, take no more together.

    The parts of the first half are counted from the start, those of the second from the end, and the last is what is left between.
    """
    size = F.floor(F.least(F.length(a), F.length(b)) / 8).cast("int")
    head = lambda c, i: F.substring(c, i * size + 1, size)
    tail = lambda c, i: F.substring(c, F.length(c) - (i - 3) * size + 1, size)
    middle = lambda c, _: F.substring(c, 4 * size + 1, F.length(c) - 7 * size)
    part = lambda c, i: F.when(i < 4, head(c, i)).when(i < 7, tail(c, i)).otherwise(middle(c, i))

    def left(edits: Column, i: Column) -> Column:
        return F.when(edits < 0, edits).otherwise(bound(F.call_function("levenshtein", part(a, i), part(b, i), edits), lambda k: F.when(k < 0, -1).otherwise(edits - k)))

    return F.aggregate(F.array(*map(F.lit, range(8))), most, left) >= 0


def similar(x: str, y: str) -> Column:
    """The edits turning line x into y are at most 1 - SIMILAR of the longer one's letters; over LONG letters, words count as letters."""

    def within(a: Column, b: Column) -> Column:
        most = F.floor((1 - SIMILAR) * F.greatest(F.length(a), F.length(b)) + 1e-9).cast("int")

        def judged(p: Column) -> Column:
            a, b, most = p["a"], p["b"], p["most"]
            # the work grows with the square of the length: what many pairs don't need comes last
            return (F.greatest(F.length(a), F.length(b)) <= most) | _by_parts(a, b, most) | (F.call_function("levenshtein", a, b, most) >= 0)

        return _middles(a, b, lambda a, b: bound(F.struct(a.alias("a"), b.alias("b"), most.alias("most")), judged))

    return F.when(F.greatest(F.length(x), F.length(y)) <= LONG, within(F.col(x), F.col(y))).otherwise(bound(F.struct(_letters(x).alias("a"), _letters(y).alias("b")), lambda p: within(p["a"], p["b"])))


def crossed(family: DataFrame) -> DataFrame:
    """Links (a, b) from the lines outside a family's largest component to all others of (family, line, look, component, norm, times).

    Lines whose lengths allow a link are of one band or of neighbours. Those of a family are dealt over squares of about SIDE by
    SIDE pairs, and pairs are compared where they meet, so only links are rows. Of large families the distance from the main
    component's most frequent line is known for all lines: where two such distances differ by more than the edits allowed, so do the
    lines. Words that stand for letters, over LONG, have no such distance.
    """
    inner = F.col("component") == F.col("family")
    head = F.max(F.when(inner, F.struct("times", -F.col("line"), "norm")))["norm"].alias("middle")
    sizes = family.groupBy("family").agg(F.count("*").alias("n"), F.count_if(~inner).alias("outer"), head)
    large = (F.col("outer") * (F.col("n") - F.col("outer")) > GAIN * F.col("n")) & (F.greatest(F.length("norm"), F.length("middle")) <= LONG)
    far = F.when(large, _middles(F.col("norm"), F.col("middle"), lambda a, b: F.levenshtein(a, b)))
    band = F.floor(F.log(F.col("look.n")) / -math.log(SIMILAR))
    sides = [F.ceil(F.col(c) / SIDE) for c in ("outer", "n")]
    rows = family.join(sizes, "family").select("family", "line", "component", "look", "norm", band.alias("band"), far.alias("far"), *[F.greatest(k, F.lit(1)).alias(c) for k, c in zip(sides, ("us", "vs"), strict=True)])
    own = lambda k: F.pmod(F.xxhash64("line"), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    given = lambda c, text: [F.col(k).alias(f"{k}_{c}") for k in ("line", "component", "look", "far")] + [F.col("norm").alias(text)]
    keys = ["family", "band", "i", "j"]
    rest = rows.where(~inner).select("family", "band", own("us").alias("i"), every("vs").alias("j"), *given("u", "x"))
    whole = rows.withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).select("family", "band", every("us").alias("i"), own("vs").alias("j"), *given("v", "y"))
    # few bytes but much work: more tasks than the bytes alone would get
    rest, whole = (side.repartition(partitions(family.sparkSession), *keys) for side in (rest, whole))
    once = (F.col("component_v") == F.col("family")) | (F.col("line_u") < F.col("line_v"))
    most = F.floor((1 - SIMILAR) * F.greatest("look_u.n", "look_v.n") + 1e-9)
    may = once & (F.col("component_u") != F.col("component_v")) & _near("look_u", "look_v") & F.coalesce(F.abs(F.col("far_u") - F.col("far_v")) <= most, F.lit(True))
    met = rest.hint("merge").join(whole, keys).where(may & similar("x", "y"))
    return met.select(F.least("line_u", "line_v").alias("a"), F.greatest("line_u", "line_v").alias("b"))


def line_links(lines: DataFrame) -> DataFrame:
    """Links (a, b) between the lines of (line, norm), enough of them to connect what all connect.

    Lines with a common key are a bucket. Buckets of up to HOT lines are compared pair by pair. Fuller ones are split by
    length, which separates no lines that can be links; in cells that are still full all lines are compared with the one
    that occurs most, and what stays outside the cell's largest component with all of the cell. Cells with one main
    component are one family, so a pair is compared once (see ``crossed``).
    """
    hashed = stored(sim_hashes(lines))
    keys = hashed.select("line", "key")
    met = stored(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b"))
    members = stored(_few(keys, met.where("size > 2").select("key", "size"), "key").distinct())
    few, full = members.where(F.col("size") <= HOT), members.where(F.col("size") > HOT)
    within = few.select("key", F.col("line").alias("a")).join(few.select("key", F.col("line").alias("b")), "key").where("a < b").select("a", "b")
    pairs = stored(met.where("size = 2").select("a", "b").union(within).distinct())
    wanted = stored(pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(full.select("line")).distinct())
    seen = stored(_few(lines, wanted, "line").groupBy("line").agg(F.first("norm").alias("norm"), F.count("*").alias("times")))
    places = F.call_function("shiftleft", F.col("kept").cast("long"), F.col("class") * F.floor(60 / F.col("m")).cast("int"))
    sims = _few(hashed.where("kept is not null"), wanted, "line").groupBy("line").agg(*[F.bit_or(F.when(F.col("m") == k, places)).alias(f"sim{k}") for k in (FEW, MORE)])
    counted = [f"bag{k}" for k in range(BAGS)]
    looks = stored(bags(seen).select("line", F.length("norm").alias("n"), "times", *counted).join(sims, "line", "left").select("line", "times", F.struct("n", f"sim{FEW}", f"sim{MORE}", *counted).alias("look")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = (seen.select(F.col("line").alias(c), F.col("norm").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        # few bytes but much work: more tasks than the bytes alone would get; the aggregation keeps the comparison behind them
        both = pairs.join(x, "a").join(y, "b").repartition(partitions(lines.sparkSession), "a", "b")
        both = both.groupBy("a", "b").agg(F.first("x").alias("x"), F.first("y").alias("y"))
        return stored(both.where(similar("x", "y")).select("a", "b"))

    def looked(pairs: DataFrame) -> DataFrame:
        x, y = (looks.select(F.col("line").alias(c), F.col("look").alias(f"s{c}")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").where(_near("sa", "sb")).select("a", "b")

    if full.isEmpty():
        links = confirmed(looked(pairs))
        release(hashed, met, members, pairs, wanted, looks, seen)
        return links

    band = F.floor(F.log(F.col("look.n")) / -math.log(SIMILAR))
    cells = full.join(looks, "line").select(F.explode(F.array(F.xxhash64("key", band), F.xxhash64("key", band + 1))).alias("cell"), "line", "look", "times").dropDuplicates(["cell", "line"])
    cells = stored(cells)
    heads = cells.groupBy("cell").agg(F.count("*").alias("size"), F.max(F.struct("times", -F.col("line"), "look")).alias("head")).where("size > 1")
    cells = stored(cells.join(heads, "cell").select("cell", "line", "look", "size", (-F.col("head.col2")).alias("head"), F.col("head.look").alias("head_look")))
    small, large = cells.where(F.col("size") <= HOT), cells.where(F.col("size") > HOT)
    x, y = (small.select("cell", F.col("line").alias(c), F.col("look").alias(f"s{c}")) for c in "ab")
    inside = x.join(y, "cell").where((F.col("a") < F.col("b")) & _near("sa", "sb")).select("a", "b")
    stars = large.where((F.col("line") != F.col("head")) & _near("look", "head_look")).select(F.least("line", "head").alias("a"), F.greatest("line", "head").alias("b"))
    links = confirmed(looked(pairs).union(inside).union(stars).distinct())
    if large.isEmpty():
        return links
    found = components(links)
    placed = large.join(found, F.col("line") == F.col("node"), "left").select("cell", "line", "look", F.coalesce("component", "line").alias("component"))
    parts = placed.groupBy("cell", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("cell").agg(F.max(F.struct("size", "component"))["component"].alias("family"), F.count("*").alias("parts")).where("parts > 1").select("cell", "family")
    family = stored(placed.join(main, "cell").select("family", "line", "look", "component").distinct().join(seen, "line"))
    links = links.union(stored(crossed(family)))
    release(hashed, met, members, pairs, wanted, looks, seen)
    return links


def _few(rows: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """The rows joined with wanted (all different in ``by``): a broadcast if those are few, else a join that shuffles."""
    wanted = wanted if wanted.limit(BROADCAST + 1).count() > BROADCAST else F.broadcast(wanted)
    return rows.join(wanted, by)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, gone): for each document that loses lines, their numbers from 0. tie is the hash of its text."""
    lines = stored(_rows(docs).select(F.xxhash64("norm").alias("line"), F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "line_no", "norm"))
    group = components(line_links(lines.select("line", "norm")))
    places = lines.drop("norm")
    here = F.struct("last", "doc_id", "tie", "line_no")
    first = places.groupBy("line").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    grouped = stored(first.join(group, F.col("line") == F.col("node"), "left").select("line", "first", "n", F.coalesce("component", "line").alias("component")))
    kept = grouped.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1").select("component", "kept")
    known = grouped.select("line", "component").join(kept, "component").select("line", "kept")
    gone = stored(places.join(known, "line").where(here != F.col("kept")).groupBy("doc_id", "tie").agg(F.collect_set("line_no").alias("gone")))
    release(lines, grouped)
    return gone


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns), text without the lines that repeat another's.

    n_chars, if there is such a column, becomes that of the new text. Lines without letters or numbers stay. No row goes:
    a document may end with an empty text. Null texts stay null. Rows that are the same in doc_id and text are one
    document and keep the same lines. Documents come by doc_id, nulls last; of one document's lines the first stays. Lines
    of over LONG characters are compared word by word. Other columns may have any names. An empty table gives no rows.
    """
    gone = repeated_lines(docs)
    # few rows: a broadcast, and no text is shuffled
    gone = gone if gone.limit(FEWER + 1).count() > FEWER else F.broadcast(gone)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("at"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("tie")), "left")
    text = F.col("row.text")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.when(F.col("gone").isNull(), text).otherwise(left)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(v.alias(k) for k, v in out.items()))
