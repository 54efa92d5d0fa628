"""Hard negatives by shared candidate lists for clusters of anchors, with certified ends.

Anchors are clustered by direction. For a cluster with centre c whose members lie within the angle t of it, the inner
product of a member u with a candidate v is at most |u| * |v| * cos(max(0, angle(v, c) - t)). So v has one bound for the
whole cluster, |v| * cos(...), and a cluster's list is all candidates by falling bound. Every member walks that list; once
what it still needs is more than |u| times the bound, nothing further down can matter and its walk ends.

A list is walked in stretches, STRETCHES of its length each, which are Spark jobs: candidates in partitions of their own are
sorted by their bounds and packed, for each cluster, with what lies below the bound that all members have done with left out.
Packs meet groups of GROUP members, and a pair of them is one product of matrices, in steps of the list with those members
that still walk. Anchors are walked twice: for their positives, then for the negatives, whose scores depend on these.

No join is left to the size that Spark takes its sides for: packs hold a candidate up to once for each cluster, and groups their
anchors once for each deal, both of which it takes for the few MB of compressed files that they come from. All are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.shared import release, stored

POSITIVES, NEGATIVES = 5, 3
#: Rows with the smallest hashes (at most so many numbers in them), to which the clusters are fitted, and by which lists are cut in stretches: neither changes results.
SAMPLE, NUMBERS = 4_096, 1 << 20
CLUSTERS, ROUNDS = 64, 10
#: Anchors in a group, numbers in a pack of candidates, candidates in a step, and shares of the packs for a cluster.
GROUP, PACK, STEP, DEALS = 1_024, 1 << 18, 512, 16
#: Shares of a list that the jobs walk, one after the other.
STRETCHES = (1 / 16, 1.0)
#: A score fits a long if no component is larger.
LARGEST = 1 << 24
NONE = -(1 << 62)


def items(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, q array<int>, item): rows that take part, as a stored table; item tells rows with one id apart.

    Rows with a null label, a null vector or one with a null or non-finite component, and rows with a null id, take no part;
    nor do vectors with a component over LARGEST / 256, whose scores a long might not hold. Rows that are the same in id,
    label and vector count once.
    """
    x = F.col(vector_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST / 256.0))
    q = F.transform(x, lambda c: F.floor(c.cast("double") * 256.0).cast("int"))
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    moved = F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.where(i.isNotNull() & label.isNotNull() & x.isNotNull() & whole).select(i.alias("id"), moved.alias("label"), q.alias("q")).distinct()
    return stored(rows.select("id", "label", "q", F.xxhash64("id", "label", "q").alias("item")))


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Rows of numbers as a matrix of d columns; shorter ones end in zeros."""
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), flat.dtype)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


class Clusters:
    """Centres of unit length, the widest angle to a member of each, and what a list is cut by. The last has the anchors of length zero."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.n = centres, len(centres) + 1
        self.widest = np.zeros(self.n)

    def angles(self, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(q @ self.centres.T / np.maximum(norms, 1e-300)[:, None], -1, 1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each row and cluster: what a score is at most for a member of length 1. Angles come with 1e-7 to spare, for rounding."""
        norms = np.sqrt((q * q).sum(1))
        apart = np.maximum(0, self.angles(q, norms) - self.widest[:-1] - 1e-7)
        return np.c_[norms[:, None] * np.where(apart < np.pi, np.cos(apart), -1), norms]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, angle to its centre) of anchors."""
        norms = np.sqrt((q * q).sum(1))
        if self.n == 1:
            return np.zeros(len(q), np.int32), np.zeros(len(q))
        far = self.angles(q, norms)
        best = far.argmin(1)
        return np.where(norms > 0, best, self.n - 1).astype(np.int32), np.where(norms > 0, far[np.arange(len(q)), best], 0)


def fit_clusters(sample: np.ndarray, n_anchors: int) -> Clusters:
    """Spherical k-means of a sample of anchors, from starts that are far from each other."""
    norms = np.sqrt((sample * sample).sum(1))
    unit = (sample / np.maximum(norms, 1e-300)[:, None])[norms > 0]
    k = min(len(unit), CLUSTERS, max(1, round(np.sqrt(n_anchors) / 2)))
    if not k:
        return Clusters(np.zeros((0, sample.shape[1])))
    centres, near = unit[:1], unit @ unit[0]
    while len(centres) < k:
        centres = np.vstack([centres, unit[near.argmin()]])
        near = np.maximum(near, unit @ centres[-1])
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-300)[:, None], centres)
    return Clusters(centres)


def packs(rows: DataFrame, clusters: Clusters, d: int, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """Packs (cluster, deal, n, ids, labels, vectors, bounds) of the candidates with low <= bound < high in a cluster's list, by falling bound."""
    most = max(64, PACK // max(d, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                q = matrix(batch.column(2), d).astype(np.float64)
                bounds, out = clusters.bounds(q), []
                for c in range(clusters.n):
                    rows = np.flatnonzero((bounds[:, c] >= low[c]) & (bounds[:, c] < high[c]))
                    if len(rows):
                        rows = rows[np.argsort(-bounds[rows, c], kind="stable")]
                        deal += 1
                        out.append((c, deal % DEALS, len(rows), ids[rows].tobytes(), labels[rows].tobytes(), q[rows].astype(np.int32).tobytes(), bounds[rows, c].tobytes()))
                if out:
                    types = [pa.int32()] * 3 + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["cluster", "deal", "n", "ids", "labels", "vectors", "bounds"])

    return rows.select("id", "label", "q").mapInArrow(run, "cluster int, deal int, n int, ids binary, labels binary, vectors binary, bounds binary")


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2^53, else in longs."""
    reach = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    return np.rint(x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if reach < 2**53 else x.astype(np.int64) @ y.T.astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place) of the k highest scores of each row, ties by smaller id; NONE is no score."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    else:
        row, col = np.nonzero(scores > NONE)
    order = np.lexsort((ids[row, col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], place[place < k]


class Walk:
    """A group of anchors on a pack of their list: the first k of each open search, among rows of the same label or of others."""

    def __init__(self, k: int, same: bool):
        self.k, self.same = k, same

    def __call__(self, anchors: dict, cand: dict) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor's number, search, id, score) of what may be among the first k of a search."""
        m, s = anchors["low"].shape
        top = np.full((m, s, self.k), NONE, np.int64)
        top_ids = np.zeros((m, s, self.k), np.int64)
        need = np.maximum(anchors["low"], anchors["least"])
        walking = np.arange(m)
        for at in range(0, len(cand["ids"]), STEP):
            # the best that is left, for each member; a bound of zero or less times a length stays an upper bound
            best = cand["bounds"][at] * anchors["norms"]
            best = best + np.abs(best) * 1e-9 + 1e-6
            walking = np.flatnonzero((best[:, None] >= np.maximum(need, top[:, :, -1])).any(1))
            if not len(walking):
                break
            part = slice(at, at + STEP)
            scores = product(anchors["q"][walking], cand["vectors"][part])
            fit = (anchors["labels"][walking][:, None] == cand["labels"][part]) == self.same
            fit &= anchors["ids"][walking][:, None] != cand["ids"][part]
            scores = np.where(fit, scores, NONE)
            for j in range(s):
                low, high = need[walking, j][:, None], anchors["high"][walking, j][:, None]
                own = np.where((scores >= low) & (scores <= high), scores, NONE)
                both = np.c_[top[walking, j], own]
                ids = np.c_[top_ids[walking, j], np.broadcast_to(cand["ids"][part], own.shape)]
                row, col, place = first(both, ids, self.k)
                new, new_ids = np.full((len(walking), self.k), NONE, np.int64), np.zeros((len(walking), self.k), np.int64)
                new[row, place], new_ids[row, place] = both[row, col], ids[row, col]
                top[walking, j], top_ids[walking, j] = new, new_ids
        anchor, search, place = np.nonzero(top > NONE)
        return anchor, search, top_ids[anchor, search, place], top[anchor, search, place]


def walk(rows: DataFrame, clusters: Clusters, d: int, anchors: DataFrame, searches: DataFrame, k: int, same: bool) -> DataFrame:
    """(item, search, id, score, rank): the first k of each search, as a stored table.

    searches: (item, norm, cluster, search, low, high) with the smallest and largest score that counts, of ``anchors``. One
    job for each stretch of the lists; between them, what an anchor has found raises what it needs.
    """
    cuts = list_cuts(rows, clusters, d)
    high, found = np.full(clusters.n, np.inf), None
    over = Window.partitionBy("item", "search").orderBy(F.desc("score"), "id")
    for n in range(len(STRETCHES)):
        state = searches.where("low <= high").withColumn("least", F.lit(NONE))
        if found is not None:
            kth = found.where(F.col("rank") == k).select("item", "search", F.col("score").alias("kth"))
            state = state.join(kth.hint("merge"), ["item", "search"], "left").withColumn("least", F.coalesce("kth", "least")).drop("kth")
        needs, top = F.greatest("low", "least"), F.get(F.array(*map(F.lit, high.tolist())), F.col("cluster")) * F.col("norm")
        state = state.where(needs <= top + F.abs(top) * 1e-9 + 1e-6)  # certified: the others have done
        # of each cluster, its anchors and the bound that all of them have done with
        floor = F.min(F.when(F.col("norm") > 0, needs / F.col("norm")).otherwise(F.lit(-np.inf)))
        left = {r.cluster: r for r in state.groupBy("cluster").agg(floor.alias("floor"), F.count_distinct("item").alias("n")).collect()}
        low = np.array([left[c].floor - abs(left[c].floor) * 1e-9 - 1e-6 if c in left else np.inf for c in range(clusters.n)])
        end = cuts[n] if n < len(cuts) else np.full(clusters.n, -np.inf)
        groups = _groups(anchors, state, [left[c].n if c in left else 0 for c in range(clusters.n)])
        hits = _meet(packs(rows, clusters, d, np.maximum(low, end), high), groups, d, k, same)
        hits = hits if found is None else hits.union(found.drop("rank"))
        now = stored(hits.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k))
        if found is not None:
            release(found)
        found, high = now, np.minimum(high, end)
    return found


def list_cuts(rows: DataFrame, clusters: Clusters, d: int) -> list[np.ndarray]:
    """The bounds at which the stretches of each list end, from a sample: wherever they lie, results are the same."""
    some = sampled(rows, d)
    bounds = clusters.bounds(some)
    return [np.quantile(bounds, 1 - share, axis=0) if len(some) else np.zeros(clusters.n) for share in STRETCHES[:-1]]


def sampled(rows: DataFrame, d: int) -> np.ndarray:
    """The vectors of the rows with the smallest hashes: SAMPLE, or as many as have NUMBERS components."""
    got = rows.orderBy(F.xxhash64("item"), "item").limit(min(SAMPLE, max(64, NUMBERS // d))).select("q").toArrow()["q"].combine_chunks()
    return matrix(got, d).astype(np.float64)


def _groups(anchors: DataFrame, state: DataFrame, sizes: list[int]) -> DataFrame:
    """(cluster, deal, members): groups of about GROUP anchors of a cluster with their searches, once for each deal."""
    parts = F.get(F.array(*[F.lit(max(1, -(-n // GROUP))) for n in sizes]), F.col("cluster"))
    open_searches = state.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("search", "low", "high", "least"))).alias("searches"))
    one = anchors.join(open_searches.hint("merge"), "item")
    members = F.collect_list(F.struct("item", "id", "label", "norm", "q", "searches"))
    grouped = one.groupBy("cluster", F.pmod(F.col("item"), parts).alias("part")).agg(members.alias("members"))
    return grouped.select("cluster", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"), "members")


def _meet(packed: DataFrame, groups: DataFrame, d: int, k: int, same: bool) -> DataFrame:
    """(item, search, id, score) of all walks of groups on packs."""
    step = Walk(k, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                member = batch.column("members")[r].values
                field = lambda name, member=member: member.field(name)
                lists = field("searches")
                counts = lists.value_lengths().to_numpy(zero_copy_only=False)
                width = int(counts.max(initial=0))
                anchors = {"items": field("item").to_numpy(), "ids": field("id").to_numpy(), "labels": field("label").to_numpy(), "norms": field("norm").to_numpy(), "q": matrix(field("q"), d)}
                flat, at = lists.flatten(), np.arange(width) < counts[:, None]
                for name, other in (("low", 1), ("high", 0), ("least", NONE), ("search", 0)):  # searches that an anchor doesn't have are empty ranges
                    anchors[name] = np.full((len(counts), width), other, np.int64)
                    anchors[name][at] = flat.field(name).to_numpy()
                anchors["low"][~at] = 1 << 62
                read = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)  # noqa: B023, E731
                cand = {"ids": read("ids", np.int64), "labels": read("labels", np.int64), "bounds": read("bounds", np.float64), "vectors": read("vectors", np.int32).reshape(-1, d)}
                a, s, ids, scores = step(anchors, cand)
                yield pa.RecordBatch.from_arrays([pa.array(anchors["items"][a]), pa.array(anchors["search"][a, s].astype(np.int32)), pa.array(ids), pa.array(scores)], names=["item", "search", "id", "score"])

    return packed.hint("merge").join(groups, ["cluster", "deal"]).drop("cluster", "deal", "n").mapInArrow(run, "item long, search int, id long, score long")


def _assigned(anchors: DataFrame, clusters: Clusters, d: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(2), d).astype(np.float64)
            cluster, angle = clusters.nearest(q)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt((q * q).sum(1))), pa.array(cluster), pa.array(angle)], names=["id", "label", "q", "item", "norm", "cluster", "angle"])

    return stored(anchors.select("id", "label", "q", "item").mapInArrow(run, "id long, label long, q array<int>, item long, norm double, cluster int, angle double"))


def mine(vectors: DataFrame, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id ``every`` divides. Of each, the first POSITIVES other rows of the same label by score, then
    smaller id; for each of these the first NEGATIVES rows of other labels with half of the positive's score to 95 % of it.
    Which rows take part: see ``items``. Rows that share an anchor's id are not its candidates; where one id has several
    rows, each is a row, and each an anchor. Vectors of different lengths are compared as if the shorter ended in zeros.
    Extra columns are not carried. No anchors or no rows: an empty result.
    """
    rows = items(vectors, id_col, vector_col, label_col)
    chosen = rows.where(F.col("id") % every == 0)
    size = rows.agg(F.max(F.size("q")).alias("d"), F.count_if(F.col("id") % every == 0).alias("n")).first()
    d = max(1, size.d or 0)
    clusters = fit_clusters(sampled(chosen, d), size.n)
    anchors = _assigned(chosen, clusters, d)
    for r in anchors.groupBy("cluster").agg(F.max("angle").alias("widest")).collect():
        clusters.widest[r.cluster] = r.widest
    own = anchors.select("item", "norm", "cluster")
    positives = walk(rows, clusters, d, anchors, own.select("*", F.lit(0).alias("search"), F.lit(NONE + 1).alias("low"), F.lit(-NONE).alias("high")), POSITIVES, same=True)
    # 50 p <= 100 n <= 95 p in whole numbers: p / 2 rounded up, 19 / 20 p rounded down
    half, most = F.expr("(score + pmod(score, 2)) div 2"), F.expr("19 * ((score - pmod(score, 20)) div 20) + (19 * pmod(score, 20)) div 20")
    searches = own.join(positives.hint("merge"), "item").select("item", "norm", "cluster", F.col("rank").alias("search"), half.alias("low"), most.alias("high"))
    negatives = walk(rows, clusters, d, anchors, searches, NEGATIVES, same=False)
    named = positives.hint("merge").join(anchors.select("item", F.col("id").alias("anchor_id")), "item").select("item", "anchor_id", F.col("id").alias("positive_id"), F.col("rank").alias("search"), F.col("score").alias("positive_score"))
    found = negatives.select("item", "search", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.hint("merge").join(found, ["item", "search"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
