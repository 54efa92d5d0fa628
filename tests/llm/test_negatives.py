from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pactum.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, item string, q string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "a", "b", "c") for i, v, l in rows], SCHEMA).repartition(3)


def brute(rows, every=50):
    items = {}
    for i, v, l in rows:
        if i is None or v is None or l is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        items[(i, (l + 1) % 10 if i % 7 == 0 else l, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = True
    items, out = list(items), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, l, q in items:
        if i % every:
            continue
        scored = sorted((-dot(q, p), j, m) for j, m, p in items if j != i)
        for s, j, m in [x for x in scored if x[2] == l][:5]:
            fit = [(n, k) for n, k, m in scored if m != l and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every=50):
    return sorted(map(tuple, hard_negatives.mine(frame(spark, rows), every).collect()))


def clustered(seed, n, d=24, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, d))
    labels = rng.integers(0, 10, n)
    x = centres[rng.integers(0, 10, n)] * (rng.random((n, 1)) < 0.8) + spread * rng.normal(size=(n, d))
    return [(i, v, int(l)) for i, (v, l) in enumerate(zip((x / np.sqrt(d)).astype(np.float32).tolist(), labels))]


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.5), (2, 0.1)])
def test_equals_brute_force(spark, seed, spread):
    rows = clustered(seed, 700, spread=spread)
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_ties_and_one_very_common_vector(spark):
    """A third of all rows share one vector: equal scores go by the smaller id."""
    rng, rows = random.Random(3), clustered(3, 400, d=8)
    rows += [(1000 + i, rows[0][1], rng.randrange(10)) for i in range(200)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(4, 160, d=5)
    rows += [(200, None, 1), (250, [1.0, None, 0.0, 0.0, 0.0], 1), (300, [float("nan")] * 5, 1), (350, [float("inf")] * 5, 2), (400, [0.5] * 5, None), (None, [0.5] * 5, 1)]
    rows += [(450, [0.0] * 5, 3), (451, [0.0] * 5, 3), (500, [], 4), (501, [3.0], 4), (550, [0.25] * 9, 5), (552, [100.0] * 9, 6), (600, [-1.0, 2.0], 5)]
    rows += [rows[0], rows[0], rows[7], (50, [0.3] * 5, 1), (50, [0.3] * 5, 2)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1)]) == [] and mined(spark, [(50, [0.5], 1)]) == []


def test_walks_end_early():
    """On clustered vectors a member's walk stops long before the end of its list, with the full result."""
    rows = clustered(5, 4000, d=16, spread=0.05)
    q = np.floor(256 * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64)
    ids, labels = np.arange(len(q)), np.array([l for *_, l in rows])
    clusters = hard_negatives.fit_clusters(q[:400].astype(np.float64), 400)
    own, angle = clusters.nearest(q.astype(np.float64))
    np.maximum.at(clusters.widest, own[:400], angle[:400])
    bounds = clusters.bounds(q.astype(np.float64))
    norms = np.sqrt((q * q).sum(1))
    scores = q @ q.T
    assert (scores[:400] <= bounds[:, own[:400]].T * norms[:400, None] * (1 + 1e-9) + 1e-6).all()
    c = int(np.bincount(own[:400]).argmax())
    order, members = np.argsort(-bounds[:, c], kind="stable"), np.flatnonzero(own[:400] == c)
    anchors = {"ids": ids[members], "labels": labels[members], "norms": norms[members], "q": q[members], **{k: np.full((len(members), 1), v, np.int64) for k, v in (("low", hard_negatives.NONE + 1), ("high", 1 << 62), ("least", hard_negatives.NONE))}}
    steps = []

    class Counted(dict):
        def __getitem__(self, key):
            steps.append(key)
            return super().__getitem__(key)

    a, _, found, score = hard_negatives.Walk(5, True)(anchors, Counted(ids=ids[order], labels=labels[order], vectors=q[order], bounds=bounds[order, c]))
    assert steps.count("vectors") < len(order) / hard_negatives.STEP
    for m, anchor in enumerate(members):
        want = sorted((-int(s), i) for i, s in enumerate(scores[anchor]) if i != anchor and labels[i] == labels[anchor])[:5]
        assert sorted((-s, i) for s, i in zip(score[a == m].tolist(), found[a == m].tolist())) == want


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-60000, 60000) for _ in range(4)], rng.randrange(3)) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_packs_and_groups_are_not_broadcast(spark):
    rows = hard_negatives.items(spark.range(400).selectExpr("id AS vec_id", "id % 3 AS label", "transform(sequence(1, 8), x -> sin(id * x)) AS embedding"))
    d, chosen = 8, rows.where("id % 50 = 0")
    clusters = hard_negatives.fit_clusters(hard_negatives.sampled(chosen, d), 8)
    anchors = hard_negatives._assigned(chosen, clusters, d)
    state = anchors.selectExpr("item", "norm", "cluster", "0 AS search", "-1000000L AS low", "1000000L AS high", "-1000000L AS least")
    groups = hard_negatives._groups(anchors, state, [8] * clusters.n)
    far = np.full(clusters.n, np.inf)
    met = hard_negatives._meet(hard_negatives.packs(rows, clusters, d, -far, far), groups, d, 5, True)
    assert met.count() > 0
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
