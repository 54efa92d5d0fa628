"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its K smallest hashes. Inverted lists of the
retained values give candidates, the sketch of the union filters them, the full sets confirm them.

With a similarity of 0.75, each of the K smallest hashes of the union of two documents is in both with probability
0.75, so at least NEED of K = 40 are, but for a chance of 1e-7. Hence a sketch's NEED - 1 most frequent
values need no list: two similar documents still share one of the others. That keeps passages shared by many
documents out of the lists. Documents with equal sets are one class throughout. In a list of over HOT classes all
are compared with one of them at first; what that leaves outside the list's main component is compared with the rest
in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.buffers import GOLDEN, MIX2, U64, gram_rows, grams, lower_ascii, mix, owners, pieces, ranges, span_hashes, words
from pactum.llm.components import components
from pactum.llm.shared import stored

SHINGLE, PERCENT, K, NEED, HOT, BLOCK = 5, 75, 40, 15, 8, 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's different shingles, ordered by both."""
    data = lower_ascii(data)
    starts, lens, ptr = words(data, offsets)
    hashes, own = span_hashes(data, starts, lens), owners(ptr)
    rows = gram_rows(ptr, k)
    owner, value = own[rows], grams(hashes, k)[rows]
    for n in range(1, k):  # texts of fewer words: all of them are one shingle
        short = np.flatnonzero(np.diff(ptr) == n)
        if len(short):
            owner = np.r_[owner, short]
            value = np.r_[value, grams(hashes, n)[ptr[short]]]
    value = value >> U64(1)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[first], value[first]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sketch): the set's size, 128 bits that stand for it, and its K smallest hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                own, value = shingle_sets(data, offsets)
                size = np.bincount(own, minlength=j - i)
                first = np.r_[0, np.cumsum(size)]
                sums = [np.r_[U64(0), np.cumsum(mix(value * m))] for m in (GOLDEN, MIX2)]
                h1, h2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                kept = np.arange(len(value)) - first[own] < K
                ptr = np.r_[0, np.cumsum(np.minimum(size, K))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(size.astype(np.int32)), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(ptr, pa.array(value[kept].view(np.int64)))], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles int, h1 long, h2 long, sketch array<long>")


def _sizes_fit(a: str, b: str):
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def _likely(pairs: DataFrame) -> DataFrame:
    """Pairs (with na, nb, sa, sb) whose union's sketch holds enough values of both: NEED of K, or of a small union that share of all."""
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return pairs.where(_sizes_fit("na", "nb") & (common * K >= NEED * F.size(union)))


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: 100 * intersection >= PERCENT * union."""
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    full = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n = part.num_rows
                column = pa.concat_arrays([part.column(2).cast(pa.large_string()), part.column(3).cast(pa.large_string())])
                own, value = [], []
                for at, _, data, offsets in pieces(column):
                    o, v = shingle_sets(data, offsets)
                    own.append(o + at)
                    value.append(v)
                own, value = np.concatenate(own), np.concatenate(value)
                size = np.bincount(own, minlength=2 * n)
                order = np.lexsort((value, own % n))
                o, v = own[order] % n, value[order]
                both = np.bincount(o[1:][(o[1:] == o[:-1]) & (v[1:] == v[:-1])], minlength=n)
                yield part.filter(pa.array(100 * both >= PERCENT * (size[:n] + size[n:] - both))).select(["a", "b"])

    return full.mapInArrow(run, "a long, b long").distinct()


def _across(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) in families (family, class, component) between the classes outside the family's main component (its id)
    and all classes of other components.

    Both sides are cut into blocks of BLOCK; a task has one block of each and returns the links that full sets confirm.
    """
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("wide"), F.ceil(F.count_if(F.col("component") != F.col("family")) / BLOCK).cast("int").alias("high"))
    texts = docs.select(F.col("doc_id").alias("class"), "text")
    rows = stored(members.join(sizes, "family").join(texts, "class"))
    at = F.xxhash64("class")
    left = rows.where(F.col("component") != F.col("family")).withColumn("row", F.pmod(at, "high")).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    right = rows.withColumn("column", F.pmod(at, "wide")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("high") - 1)))
    columns = ["family", F.col("row").cast("int").alias("row"), F.col("column").cast("int").alias("column"), "class", "component", "text"]
    both = left.select(F.lit(True).alias("asks"), *columns).union(right.select(F.lit(False), *columns))

    def compare(group: pa.Table) -> pa.Table:
        asks, node, part = (group[c].to_numpy() for c in ("asks", "class", "component"))
        values, first = [], np.zeros(len(node) + 1, np.int64)
        for i, j, data, offsets in pieces(pa.concat_arrays([c.cast(pa.large_string()) for c in group["text"].chunks])):
            own, value = shingle_sets(data, offsets)
            first[i + 1 : j + 1] = np.bincount(own, minlength=j - i)
            values.append(value)
        size = first[1:].copy()
        first, values = np.cumsum(first), np.concatenate(values)
        held = np.flatnonzero(~asks)
        body = values[ranges(first[held], size[held])]
        owner = np.repeat(np.arange(len(held)), size[held])
        low = np.minimum(size[held], K)
        sketch, sketch_owner = values[ranges(first[held], low)], np.repeat(np.arange(len(held)), low)
        a, b = [], []
        for x in np.flatnonzero(asks):
            mine = values[first[x] : first[x + 1]]
            n = len(mine)
            fits = (part[held] != part[x]) & (100 * size[held] >= PERCENT * n) & (100 * n >= PERCENT * size[held])
            top = mine[:K]
            near = np.bincount(sketch_owner, top[np.minimum(np.searchsorted(top, sketch), len(top) - 1)] == sketch, minlength=len(held))
            fits &= near * K >= NEED * np.minimum(low, len(top))
            if fits.any():
                some = fits[owner]
                v = body[some]
                common = np.bincount(owner[some], mine[np.minimum(np.searchsorted(mine, v), n - 1)] == v, minlength=len(held))
                linked = node[held[fits & (100 * common >= PERCENT * (n + size[held] - common))]]
                a.append(np.full(len(linked), node[x]))
                b.append(linked)
        return pa.table([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in (a, b)], names=["a", "b"])

    return stored(both.groupBy("family", "row", "column").applyInArrow(compare, "a long, b long").distinct())


def near_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to connect what all of them connect.

    classes: (class, n, sketch), class being the id of a document that has the class's set.
    """
    rows = classes.select("class", "n", F.explode("sketch").alias("value"))
    frequent = rows.groupBy("value").count().where("count > 1")
    shared = rows.join(frequent, "value")
    # The most frequent values need no list, as many as a similar document's sketch is sure to share but one. A smaller set is
    # its own sketch; a similar one has 3/4 of it, of which at most K / 3 lie beyond a sketch.
    order = Window.partitionBy("class").orderBy(F.desc("count"), F.desc("value"))
    spare = F.when(F.col("n") >= K, NEED - 1).otherwise(F.least(F.ceil(F.col("n") * 0.75), F.lit(2 * K // 3)) - 1)
    ranked = shared.withColumn("place", F.row_number().over(order)).withColumn("known", F.sum("count").over(Window.partitionBy("class")))
    listed = stored(ranked.where(F.col("place") > spare).select("value", "class", "n", "known"))
    size = listed.groupBy("value").agg(F.count("*").alias("size"), F.max(F.struct("known", -F.col("class")))["col2"].alias("centre"))
    listed = stored(listed.join(size.where("size > 1"), "value").select("value", "class", "n", "size", (-F.col("centre")).alias("centre")))
    sketches = classes.select("class", "n", "sketch")
    one, two = (sketches.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    cold = listed.where(F.col("size") <= HOT)
    left, right = (cold.select("value", F.col("class").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    within = left.join(right, "value").where((F.col("a") < F.col("b")) & _sizes_fit("na", "nb")).select("a", "b")
    # in a hot list: those compared with the one whose values are the most frequent, likely the original of copies
    hot = listed.where(F.col("size") > HOT)
    stars = hot.where("class <> centre").select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b"))
    likely = _likely(within.union(stars).distinct().join(one, "a").join(two, "b"))
    links = stored(_confirmed(stored(likely.select("a", "b")), docs))
    if hot.isEmpty():
        return links
    found = components(links)
    placed = hot.select("value", "class").join(found, F.col("class") == F.col("node"), "left").select("value", "class", F.coalesce("component", "class").alias("component"))
    parts = placed.groupBy("value", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("value").agg(F.max(F.struct("size", "component"))["component"].alias("family"), F.count("*").alias("parts")).where("parts > 1").select("value", "family")
    # lists of one main component are one family, so a pair is compared once
    members = placed.join(main, "value").select("family", "class", "component").distinct()
    return links.union(_across(members, docs))


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by a similarity of PERCENT or more.

    Null and empty texts, or those without words, have no shingle and are linked with nothing. Rows with one doc_id are
    one document: they share a component, even with different texts. A null doc_id is linked with nothing, has a null
    component and is kept. Extra columns aren't carried. An empty table gives no rows.
    """
    sets = stored(signatures(docs))
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("class"), F.first("sketch").alias("sketch"))
    classes = stored(classes)
    links = near_links(docs, classes)
    # copies belong to their class
    keys = classes.select("h1", "h2", F.col("n").alias("n_shingles"), "class")
    member = full.select("doc_id", "h1", "h2", "n_shingles").join(keys, ["h1", "h2", "n_shingles"])
    twice = full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    # a document with several rows ties their classes together
    tied = member.join(twice, "doc_id").select(F.col("class").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.union(tied))
    of_class = classes.select("h1", "h2", F.col("n").alias("n_shingles"), "class").join(found, F.col("class") == F.col("node"), "left").select("h1", "h2", "n_shingles", F.coalesce("component", "class").alias("component_id"))
    narrow = sets.select("doc_id", "n_shingles", "h1", "h2")
    joined = narrow.join(of_class, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
