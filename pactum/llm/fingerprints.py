"""Document fingerprints by winnowing.

The hashes of all k-grams of characters roll over the text; of every W neighbouring ones the smallest is chosen, the
rightmost of equal ones. Two texts that share W + K - 1 characters share a chosen hash. Positions are kept.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.buffers import GOLDEN, U64, mix, ranges
from pactum.llm.shared import partitions

K, W = 10, 30


def winnow(codes: np.ndarray, offsets: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, 32-bit hash) of each chosen k-gram of texts given as code points end to end.

    A text with fewer than k characters has one gram, all of it; one with fewer than w grams has one choice; an empty
    one has none.
    """
    sizes = np.diff(offsets)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    # the rolling hash h(i + 1) = (h(i) - c(i) B^(k-1)) B + c(i + k), by Horner's rule for all places at once
    padded = np.zeros(n + k, U64)
    padded[:n] = codes
    padded[:n] += U64(1)
    h = np.zeros(n, U64)
    for j in range(k):
        h *= GOLDEN
        h += padded[j : j + n]
    for size in range(1, k):  # texts of fewer characters: what lies beyond their end counts as 0
        short = offsets[:-1][sizes == size]
        if len(short):
            g = np.zeros(len(short), U64)
            for j in range(k):
                g = g * GOLDEN + (padded[short + j] if j < size else U64(0))
            h[short] = g
    grams = np.maximum(sizes - k + 1, (sizes > 0).astype(np.int64))
    rows = ranges(offsets[:-1], grams)
    own = np.repeat(np.arange(len(sizes)), grams)
    place = rows - offsets[own]
    # smallest hash first, then the rightmost place
    keys = (mix(h[rows]) >> U64(32) << U64(32)) | (U64(0xFFFFFFFF) - place.astype(U64))
    first = np.cumsum(grams) - grams
    # minimum over the w keys from each start on, by doubling; windows that leave the text are dropped below
    low, width = keys, 1
    while width < w:
        step = min(width, w - width)
        longer = low.copy()
        longer[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        low, width = longer, width + step
    count = np.maximum(grams - w + 1, 0)
    chosen = low[ranges(first, count)]
    text = np.repeat(np.arange(len(sizes)), count)
    few = np.flatnonzero((grams > 0) & (count == 0))
    if len(few):
        at = ranges(first[few], grams[few])
        chosen = np.r_[chosen, np.minimum.reduceat(keys[at], np.cumsum(grams[few]) - grams[few])]
        text = np.r_[text, few]
        order = np.argsort(text, kind="stable")
        chosen, text = chosen[order], text[order]
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    chosen, text = chosen[fresh], text[fresh]
    return text, (U64(0xFFFFFFFF) - (chosen & U64(0xFFFFFFFF))).astype(np.int64), (chosen >> U64(32)).astype(np.uint32)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    return np.concatenate(raw) if raw else np.zeros(0, np.uint32), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, hashes array<long>, places array<int>) of every whole text; null and empty texts have empty arrays. Rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text, place, h = winnow(*_codes([t or "" for t in part.column(1).to_pylist()]))
                ptr = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ptr, pa.array(h.astype(np.int64))), pa.ListArray.from_arrays(ptr, pa.array(place.astype(np.int32)))], names=[id_col, "hashes", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, hashes array<long>, places array<int>")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def range_of(ids: DataFrame, n: int) -> Column:
    """The range of a row (doc_id, tie), about n in all, ascending by (doc_id, tie) with null ids first; tie is a 64-bit hash.

    Bounds are quantiles of the ids, and the share of null ids is counted. An id that several bounds fall on, and the
    null ids, are cut into as many ranges by tie, so that neither is one task; rows with one id and one tie share a range.
    """
    shares = [k / n for k in range(1, n)]
    bounds = [int(b) for b in sorted(ids.where("doc_id is not null").approxQuantile("doc_id", shares, 0.2 / n))] if shares else []
    count = ids.agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("rows")).first()
    empty = -(-n * count["nulls"] // max(1, count["rows"]))
    values = sorted(set(bounds))
    upto = [0, *(bisect_right(bounds, v) for v in values)]

    # the number of distinct bounds up to the id, by a binary search
    longs = lambda items: F.array(*[F.lit(x).cast("long") for x in items]).cast("array<long>")
    cuts, sums = longs(values), longs(upto)

    def halve(at, _):
        mid = F.floor((at["low"] + at["high"]) / 2).cast("int")
        below = F.col("doc_id") < F.get(cuts, mid)
        return F.when(at["low"] >= at["high"], at).otherwise(F.struct(F.when(below, at["low"]).otherwise(mid + 1).alias("low"), F.when(below, mid).otherwise(at["high"]).alias("high")))

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(values)).alias("high"))
    step = F.aggregate(F.sequence(F.lit(0), F.lit(len(values).bit_length())), whole, halve, lambda at: at["low"])

    def split(parts: Column) -> Column:
        return F.least(F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * parts), parts - 1).cast("int")

    def placed(j: Column) -> Column:
        last, parts = F.get(sums, j), F.get(sums, j) - F.get(sums, j - 1)
        on = (j > 0) & (F.get(cuts, j - 1) == F.col("doc_id"))
        return (last + F.when(on, split(parts) - parts + 1).otherwise(0)).cast("int")

    known = F.get(F.transform(F.array(step), placed), 0)
    return F.when(F.col("doc_id").isNull(), split(F.lit(empty))).otherwise(known + empty)


def edit_test(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text's last floor(n_chars / 4) characters are the first as many (or all) of the next document's, by
    ascending doc_id, after the last the first. Null texts count as empty. Null ids come first; rows with one id are
    ordered by their text's hash; of equal rows each is the next of another. A fingerprint is the choices in order of their places,
    hashes as eight hexadecimal digits; likeness is that of the sets of hashes.

    One shuffle: rows go to ranges (``range_of``); the first row of a range goes to the range before it as well, so every
    row meets its successor in its own task. Bounds and first rows of the ranges are a few numbers for each range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id", F.xxhash64("text").alias("tie"))
    part = range_of(ids, n)
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")
    heads = sorted((r.part, r.head) for r in ids.groupBy(part.alias("part")).agg(F.min(order).alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    # the head of each range, and the range whose last row it follows
    known = spark.createDataFrame([(heads[k - 1][0], h[1], h[2]) for k, (_, h) in enumerate(heads)], "before int, head_id long, head_tie long")
    tied = rows.withColumn("tie", F.xxhash64("text"))
    copies = tied.join(F.broadcast(known), F.col("tie").eqNullSafe(F.col("head_tie")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    copies = copies.select(F.col("before").alias("part"), F.lit(1).alias("head"), "doc_id", "tie", "text").dropDuplicates(["part"])
    dealt = tied.select(part.alias("part"), F.lit(0).alias("head"), "doc_id", "tie", "text").union(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its successor
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                chunk = batch.slice(i, 64)
                p, head, doc, text = (chunk.column(k).to_pylist() for k in (0, 1, 2, 4))
                todo = [*([held] if held else []), *zip(p, head, doc, text)]
                held = todo.pop() if todo else None
                pairs = [(a, b) for a, b in zip(todo, [*todo[1:], held]) if not a[1] and a[0] == b[0]]
                if pairs:
                    yield _compare(pairs)

    sorted_rows = dealt.repartition(n, "part").sortWithinPartitions("part", "head", F.asc_nulls_first("doc_id"), "tie", "text")
    return sorted_rows.select("part", "head", "doc_id", "tie", "text").mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(pairs: list[tuple]) -> pa.RecordBatch:
    texts = [a[3] for a, _ in pairs]
    after = [b[3] for _, b in pairs]
    cut = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - c] + x[:c] for t, x, c in zip(texts, after, cut)]
    m = len(pairs)
    # the next text is mostly that of the next pair, whose fingerprint is there already
    chained = [i + 1 < m and after[i] is texts[i + 1] for i in range(m)]
    loose = [i for i in range(m) if not chained[i]]
    next_of = {i: 2 * m + k for k, i in enumerate(loose)}
    whole = [*texts, *edited, *(after[i] for i in loose)]
    text, _, h = winnow(*_codes(whole))
    ptr = np.searchsorted(text, np.arange(len(whole) + 1))
    marks = [h[a:b] for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
    sets = [np.unique(x) for x in marks]
    spelled = [x.astype(">u4").tobytes().hex() for x in marks[: 2 * m]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(spelled[:m], pa.string()),
            pa.array(spelled[m:], pa.string()),
            pa.array([likeness(sets[i], sets[m + i]) for i in range(m)], pa.float64()),
            pa.array([likeness(sets[i], sets[i + 1 if chained[i] else next_of[i]]) for i in range(m)], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
