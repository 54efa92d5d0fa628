"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times, and once more with probability
r - floor(r). Which ones is drawn by the cube method: the vector of probabilities moves at random through the null space of
the constraints (the sum of tokens and the count of documents), so both sums stay as they are, until all but
a few entries are 0 or 1. The flight runs block by block: each block of BLOCK documents leaves at most two entries
undecided, those make up the blocks of the next round, and when a source has one block left, its few undecided
documents land on the choice that is closest to the wanted sum of tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.shared import partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK = 2000
#: Documents of a source that are left to the landing.
RESERVE = 12
EPS = 1e-9
#: Sources whose counts are broadcast at most.
SOURCES = 100_000


def _small(by_source: DataFrame) -> DataFrame:
    """Marked for a broadcast if there are no more than SOURCES rows."""
    return by_source if by_source.limit(SOURCES + 1).count() > SOURCES else F.broadcast(by_source)


def sized(docs: DataFrame) -> DataFrame:
    """The documents with size, their number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of the rows (source, source_size): SHARE of all sizes by weight, but no more than MOST of a source.

    Where a target stops, the excess goes to the others by weight. That is a common level L with targets min(w L, cap);
    sources in the order of cap / weight stop one after another, so sums over that order give L. Sources are numbered by
    code point, null last; their number isn't that of the documents. Sizes that are all 0 give targets of 0.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    numbered = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    rated = numbered.withColumn("w", F.get(weights, F.col("k") % len(WEIGHTS))).withColumn("cap", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    so_far, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # what is left for this source and those after it, if all before it stop
    level = (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = rated.withColumn("level", level)
    # the first that doesn't stop sets the level for itself and all after it
    common = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "k", "level"))).over(everything)["level"]
    return leveled.withColumn("common", common).select("source", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("w"), "cap")).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight over one block: three undecided entries at a time move along the null vector of (count, tokens)."""
    p = p.tolist()
    x = size.astype(float).tolist()
    draws = rng.random(len(p) * 2 + 16)
    free, at, k = [], 0, 0
    while True:
        while len(free) < 3 and at < len(p):
            if EPS < p[at] < 1 - EPS:
                free.append(at)
            at += 1
        if len(free) < 3:
            return np.array(p)
        i, j, m = free
        # (1, 1, 1) x (x_i, x_j, x_m)
        u = (x[m] - x[j], x[i] - x[m], x[j] - x[i])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for f, d in zip(free, u):
            if d > 0:
                up, down = min(up, (1 - p[f]) / d), min(down, p[f] / d)
            elif d < 0:
                up, down = min(up, -p[f] / d), min(down, (p[f] - 1) / d)
        go = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        for f, d in zip(free, u):
            p[f] = min(1.0, max(0.0, p[f] + go * d))
            if p[f] < EPS or p[f] > 1 - EPS:
                p[f] = round(p[f])
        free = [f for f in free if 0 < p[f] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few undecided entries (RESERVE + 2 at most), to the choice nearest in tokens, then in count; of equal ones the first."""
    free = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(free))[:, None] >> np.arange(len(free))) & 1
    tokens = np.abs(choices @ size[free] - (p[free] * size[free]).sum()).round(6)
    count = np.abs(choices.sum(axis=1) - p[free].sum()).round(6)
    p[free] = choices[np.lexsort((count, tokens))[0]]
    return p


def fly_and_land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A source's last block: a few entries of all sizes are kept out of the flight, so that the landing can come close."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    by_size = open_[np.argsort(size[open_], kind="stable")]
    kept = np.unique(by_size[np.linspace(0, len(by_size) - 1, RESERVE).astype(int)]) if len(by_size) else by_size
    rest = p.copy()
    rest[kept] = 0
    rest = fly(rest, size, rng)
    rest[kept] = p[kept]
    return land(rest, size)


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, row, times) of every document, row telling apart rows that are the same.

    taken is the words that the mix takes of it: times (0, 1 or 2) times its size. Null and empty texts have size 0
    and are taken floor(r) times at least like others, which takes no words. Null sources are a source of their own.
    Rows that are the same count each. Draws depend on the documents' hashes alone, so reruns agree. An empty table
    gives no rows. ``docs`` needs doc_id, source and text.
    """
    rows = sized(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", F.xxhash64("doc_id", "source", "text").alias("key"))
    # rows with one key are numbered by groups of hashes, so that each is a unit of its own
    rows = stored(rows)
    again = rows.groupBy("key").agg(F.count("*").alias("rows"), F.first("doc_id", True).alias("doc_id"), F.first("source", True).alias("source"), F.first("size").alias("size"))
    units = again.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row"), "key")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # one row a source; its size is that of the sources
    placed = units.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    goal = goals.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("s"), "source_size", "target", ratio.alias("ratio"))
    full = placed.join(_small(goal), "s").withColumn("hash", F.xxhash64("key", "row"))
    start = full.select("s", "doc_id", "size", "row", "key", "hash", "source_size", "target", F.floor("ratio").cast("int").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"))
    start = stored(start)

    def flight(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["hash", "key", "row"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(abs(int(block["hash"].iloc[0])))
        p = (fly_and_land if block["last"].iloc[0] else fly)(block["p"].to_numpy(), block["size"].to_numpy(), rng)
        return block.assign(p=p)[["s", "key", "row", "size", "hash", "p"]]

    kind = "s string, key long, row int, size long, hash long, p double"
    todo = start.select("s", "key", "row", "size", "hash", "p")
    decided = None
    while True:
        counts = todo.groupBy("s").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        # one row of 16 bytes a source; a join by shuffle would leave all blocks of a source in one task
        dealt = todo.join(_small(counts), "s").select("s", "key", "row", "size", "hash", "p", F.pmod("hash", "blocks").alias("block"), (F.col("blocks") == 1).alias("last"))
        dealt = dealt.repartition(partitions(docs.sparkSession), "s", "block")
        flown = stored(dealt.groupBy("s", "block").applyInPandas(flight, kind))
        done = flown.where("p <= 0 or p >= 1").select("key", "row", F.col("p").cast("int").alias("extra"))
        decided = done if decided is None else decided.union(done)
        todo = flown.where("p > 0 and p < 1").withColumn("hash", F.xxhash64("hash"))
        if todo.isEmpty():
            break
    times = F.col("base") + F.col("extra")
    return start.join(decided, ["key", "row"]).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "row", times.alias("times"), "key")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, with all its columns.

    Rows that are the same in doc_id, source and text share their times, dealt to them in turn, each with its own other
    columns, which may have any names.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), "source", "text")
    plan = stored(mix_sources(docs).groupBy("key").agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("rows")).where("times > 0"))
    rows = docs.select(F.struct("*").alias("doc"), key.alias("key"))
    # rows of one key are the same in what the mix looks at; the times of a key are dealt to its rows in turn
    taken = rows.join(plan.where("rows = 1").select("key", "times"), "key").select("doc", "times")
    if not plan.where("rows > 1").isEmpty():
        shared = rows.join(plan.where("rows > 1").select("key", "times", "rows"), "key")
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("doc"))) - 1
        several = shared.withColumn("turn", turn).select("doc", (F.floor(F.col("times") / F.col("rows")) + (F.col("turn") < F.col("times") % F.col("rows")).cast("int")).cast("int").alias("times")).where("times > 0")
        taken = taken.union(several)
    return taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
