from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactum.llm import components, fingerprints, line_dedup, mixing, near_dedup, quality, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, family int"


def frame(spark, rows):
    """rows of (doc_id, text[, source]), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "c", 1) for r in rows], SCHEMA).repartition(3)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, families=6, copies=14):
    """Random texts, exact copies, near copies by degrees, and a passage that many share."""
    rng = random.Random(seed)
    passage = prose(rng, 40, 5000)
    texts = [None, "", " \t\n", "one", "one two three", "one two three", "ONE two\tthree", "a b c d e"]
    for _ in range(families):
        base = prose(rng, rng.choice([8, 30, 60, 150, 400]), 5000).split(" ")
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
        texts += [" ".join(base)] * 3
    texts += [prose(rng, rng.randrange(5, 60), 5000) + " " + passage + " " + prose(rng, rng.randrange(5, 200), 5000) for _ in range(30)]
    rng.shuffle(texts)
    return texts


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "families", "copies"), [(1, 6, 14), (2, 2, 90)])
def test_near_duplicates(spark, seed, families, copies):
    texts = corpus(seed, families, copies)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, enumerate(texts))).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in enumerate(brute_components(texts))}


def test_near_duplicates_odd_rows(spark):
    t = "a b c d e f g"
    got = near_dedup.near_dedup(frame(spark, [(None, t), (3, t), (3, "other words here"), (9, "other words here"), (4, None)])).collect()
    assert sorted(((r.doc_id or -1), r.component_id, r.kept) for r in got) == [(-1, None, True), (3, 3, True), (3, 3, True), (4, 4, True), (9, 3, False)]
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0


def test_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    texts = corpus(3, 2, 60)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, enumerate(texts))).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_components(texts))}


def test_components(spark):
    links = [(5, 6), (6, 7), (7, 8), (2, 1), (9, 9), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 5, 1: 1, 2: 1, 9: 9} | {100 + i: 100 for i in range(41)}


def brute_substrings(rows):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            if d is not None:
                first[g] = min(d, first.get(g, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("bound", [substring_dedup.BOUND, 40])
def test_substrings(spark, bound):
    rng = random.Random(4)
    shared = [prose(rng, n, 900) for n in (12, 13, 14, 60)]
    rows = [(i, prose(rng, rng.randrange(0, 30), 900) + " " + rng.choice(shared) + "\t" + prose(rng, rng.randrange(0, 30), 900) + rng.choice(["", " " + shared[3]])) for i in range(80)]
    rows += [(100, None), (101, ""), (None, shared[3]), (None, shared[3]), (102, shared[3]), (102, shared[3]), (103, prose(rng, 40, 2)), (104, "é " * 30), (105, "é " * 14)]
    got = substring_dedup.substring_dedup(frame(spark, rows), bound, with_text=True).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got))) == sorted(map(repr, brute_substrings(rows)))
    assert all(sum(s.end - s.first for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_base_counts():
    def brute(t):
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if n[g] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    rng = random.Random(7)
    texts = ["", " \n", "a a a a a a a", "x\n\nx\n x\nx", "é# é#\né# é#"] + ["".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\t"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    data, offsets = quality.pieces(pa.array(texts), 1 << 30).__next__()[2:]
    got = quality.base_counts(data, offsets)
    assert list(zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [brute(t) for t in texts]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = quality.rate(docs, quality.train(docs, fitted)).join(held, "doc_id").select("kept", "quality", "base_failed", "probability").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.15
    # calibration: classes weigh alike, so weighted rows of a bin are good about as often as the bin's probabilities say
    p, y = np.array([r.probability for r in got]), np.array([r.quality for r in got], float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    assert abs((weight * p).sum() - 0.5) <= 0.05
    bins = np.minimum((p * 5).astype(int), 4)
    error = sum(abs((weight * (p - y))[bins == b].sum()) for b in range(5))
    assert error <= 0.08


def test_quality_characters_and_sample(spark):
    texts = ["", "abc", "aé漢😀b", "漢字かな", "é"]
    data, offsets = quality.pieces(pa.array(texts), 1 << 30).__next__()[2:]
    code, first = quality.characters(data, offsets)
    assert np.diff(first).tolist() == [len(t) for t in texts]
    same = {}
    for c, x in zip("".join(texts), code.tolist()):
        assert same.setdefault(c, x) == x
    assert len(set(same.values())) == len(same)
    # repeated ids and long texts change nothing, whatever their number
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} w{i} " * 12) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, quality int")
    long = [(40, "good " * 300_000)]
    want, got = (quality.train(frame(spark, r), labels) for r in (rows, rows * 3 + long))
    assert np.array_equal(want[0], got[0]) and want[1:] == got[1:]


def test_quality_odd_rows(spark):
    d = frame(spark, [(1, None), (2, ""), (2, ""), (None, "word " * 30), (3, " ".join(f"w{i}" for i in range(30)))])
    labels = spark.createDataFrame([(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(d, labels) is None
    got = sorted((r.doc_id or -1, r.base_failed, r.kept) for r in quality.rate(d, None).collect())
    assert got == [(-1, True, False), (1, True, False), (2, True, False), (2, True, False), (3, False, True)]
    assert sorted(r.doc_id for r in quality.kept(d, None).collect()) == [3] and quality.kept(d, None).columns == d.columns
    assert quality.rate(frame(spark, []), None).count() == 0


def brute_lines(rows):
    """Exact repeats of normalised lines, in order of documents."""
    seen, out = set(), {}
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        kept = []
        for line in t.split("\n"):
            n = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if not n or n not in seen:
                kept.append(line)
            seen.add(n)
        out[d] = "\n".join(kept)
    return out


def test_exact_lines(spark):
    rows = [(2, "Same line here\n\nother"), (1, "same LINE, here!\n--\nown words of one"), (3, "x\nSAME line here\nx"), (4, None), (5, "")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == brute_lines(rows) | {4: None}


def all_near(spark, norm, pairs):
    """Those of the pairs of line numbers whose lines have an edit similarity of 0.9."""
    rows = [(i, j, norm[i], norm[j]) for i, j in pairs if abs(len(norm[i]) - len(norm[j])) <= 0.1 * max(len(norm[i]), len(norm[j]))]
    d = spark.createDataFrame(rows, "i int, j int, x string, y string").repartition(16)
    return [tuple(r) for r in d.where("levenshtein(x, y, cast(floor(0.1 * greatest(length(x), length(y)) + 1e-9) as int)) >= 0").select("i", "j").collect()]


def test_fuzzy_lines(spark, monkeypatch):
    rng = random.Random(8)
    base = [prose(rng, 60, 9000).replace("w", "word") for _ in range(6)]
    rows, k = [], 0
    for b in base:
        for _ in range(8):
            w = b.split(" ")
            if rng.random() < 0.8:
                w[rng.randrange(len(w))] = f"yyyy{rng.randrange(10**6)}"
            rows.append((k, " ".join(w) + "\n" + prose(rng, 12, 9000)))
            k += 1
    norm = [line for _, t in rows for line in t.split("\n")]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(norm)], "line long, norm string")

    near = all_near(spark, norm, [(i, j) for i in range(len(norm)) for j in range(i)])
    assert len(near) > 20
    want = components.components(spark.createDataFrame(near, "a long, b long"))
    for hot in (32, 2):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = components.components(line_dedup.line_links(lines))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = line_dedup.line_dedup(frame(spark, rows))
    groups = {r.node: r.component for r in want.collect()}
    expected = len({groups.get(norm.index(x), norm.index(x)) for x in norm})
    assert kept.select(F.explode(F.split("text", "\n")).alias("x")).where("x <> ''").count() == expected
    assert line_dedup.line_dedup(frame(spark, [])).columns == kept.columns


def test_blocks_by_hand(spark):
    text = "gamma delta the house stood here of delta " + "x" * 25
    words = ["gamma", "delta", "house", "stood"]
    seeds = [("gamma", None), ("delta", None), ("the", "house"), ("house", None), ("stood", None), ("here", None), ("of", "delta"), *[("x", "x"), ("x", None)]]
    hashed = spark.createDataFrame(seeds, "a string, b string").select(F.when(F.col("a").isin("the", "of", "x"), F.xxhash64("a", "b")).otherwise(F.xxhash64("a")).alias("h")).collect()
    hashes = {r.h for r in hashed}
    assert words and len(hashes) == 9
    want = {}
    for h in hashes:
        want.setdefault(h % 6, []).append(h & (2**64 - 1))
    majority = lambda hs: sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))
    rows = spark.createDataFrame([(1, 6, text)], "line long, m long, norm string")
    got = {r["class"]: (r["count"], r.bits & (2**64 - 1)) for r in line_dedup.blocks(rows).collect()}
    assert got == {c: (len(hs), majority(hs)) for c, hs in want.items()}


def with_edits(rng, line, edits):
    x = list(line)
    for _ in range(edits):
        at, letter = rng.randrange(len(x)), rng.choice("etaonirs hdulczß")
        kind = rng.randrange(3)
        x[at : at + (kind > 0)] = [letter] if kind < 2 else []
    return "".join(x)


def test_letters_keep_all_links_and_few_other_pairs(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choices("etaonirshdulßy", k=rng.randint(2, 8))) for _ in range(40))
    apart = lambda x, y: sum(((x[f"bag{k}"] ^ y[f"bag{k}"]) & (2**64 - 1)).bit_count() for k in range(line_dedup.BAGS))
    base = [line() for _ in range(60)]
    norm = base + [with_edits(rng, x, i % 20) for i, x in enumerate(base)] + ["", "a", "e", "ee" * 40, "ee" * 43]
    got = {r.i: r for r in line_dedup.bags(spark.createDataFrame(list(enumerate(norm)), "i int, norm string")).collect()}
    assert all(apart(got[i], got[60 + i]) <= 2 * (i % 20) + 1 for i in range(60))
    assert apart(got[123], got[124]) <= 13
    # lines of one length that share no SimHash: all pairs were compared by edit distance before
    rows = spark.createDataFrame([(i, 240, None, None, *[got[i][f"bag{k}"] for k in range(line_dedup.BAGS)]) for i in range(60)], f"i int, n int, sim{line_dedup.FEW} long, sim{line_dedup.MORE} long, " + ", ".join(f"bag{k} long" for k in range(line_dedup.BAGS)))
    x, y = (rows.select(F.col("i").alias(c), F.struct(*rows.columns[1:]).alias(f"s{c}")) for c in "ab")
    assert x.join(y, F.col("a") < F.col("b")).where(line_dedup._near("sa", "sb")).count() < 60 * 59 / 2 / 10


def test_similar_is_the_edit_distance(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcd ", k=rng.randint(20, 120))) for _ in range(300)]
    rows = spark.createDataFrame([(x, with_edits(rng, x, rng.randrange(1 + len(x) // 8))) for x in base], "x string, y string")
    most = F.expr("cast(floor(0.1 * greatest(length(x), length(y)) + 1e-9) as int)")
    got = rows.select(line_dedup.similar("x", "y").alias("got"), (F.levenshtein("x", "y") <= most).alias("want")).collect()
    assert all(r.got == r.want for r in got) and 30 < sum(r.want for r in got) < 300


def test_similar_of_texts_that_begin_and_end_alike(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("ab", k=rng.randint(1, 60))) for _ in range(150)] + ["".join(rng.choices("abcdefg ß€😀", k=rng.randint(300, 900))) for _ in range(60)] + ["a" * 40, "ab" * 30, "a" * 39 + "b"]
    pairs = [(x, with_edits(rng, x, rng.randrange(2 + len(x) // 8))) for x in base] + [(x, x[: len(x) // 2] + x[len(x) // 2 + 1 :]) for x in base] + [(x, x) for x in base] + [("", "a"), ("", "")]
    most = F.expr("cast(floor(0.1 * greatest(length(x), length(y)) + 1e-9) as int)")
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup.similar("x", "y").alias("got"), (F.levenshtein("x", "y") <= most).alias("want")).collect()
    assert [r for r in got if r.got != r.want] == [] and 100 < sum(r.want for r in got) < len(got) - 50


@pytest.mark.parametrize("gain", [0, 1000])
def test_a_family_makes_rows_of_links_alone(spark, monkeypatch, gain):
    """Lines outside the largest component are compared with all others where they meet; before, every pair that letters allow became a row."""
    monkeypatch.setattr(line_dedup, "SIDE", 5)
    monkeypatch.setattr(line_dedup, "GAIN", gain)
    rng = random.Random(12)
    base = " ".join("".join(rng.choices("etaonirshdul", k=rng.randint(2, 8))) for _ in range(50))
    norm = [base] + [with_edits(rng, base, rng.choice([3, 10, 14, 22, 40])) for _ in range(59)]
    part = [1 if i < 40 else 1 + i // 2 for i in range(60)]
    rows = spark.createDataFrame([(1, i + 1, part[i], x, 1) for i, x in enumerate(norm)], "family long, line long, component long, norm string, times long")
    none = [F.lit(None).cast("long").alias(f"sim{m}") for m in (line_dedup.FEW, line_dedup.MORE)]
    look = F.struct(F.length("norm").alias("n"), *none, *[f"bag{k}" for k in range(line_dedup.BAGS)]).alias("look")
    got = [tuple(r) for r in line_dedup.crossed(line_dedup.bags(rows).select("family", "line", look, "component", "norm", "times")).collect()]
    apart = [(i + 1, j + 1) for j in range(60) for i in range(j) if part[i] != part[j]]
    want = [p for p in apart if edits(norm[p[0] - 1], norm[p[1] - 1]) <= int(0.1 * max(len(norm[i - 1]) for i in p) + 1e-9)]
    assert sorted(got) == sorted(want) and 20 < len(want) < len(apart) * 2 / 3


def test_lines_go_alike_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = frame(spark, [(i, f"line number {i % 7} that others have too\nown {i}") for i in range(40)] + [(None, "line number 3 that others have too")])
    few = sorted(map(repr, line_dedup.line_dedup(docs).collect()))
    monkeypatch.setattr(line_dedup, "FEWER", 0)
    assert sorted(map(repr, line_dedup.line_dedup(docs).collect())) == few


def test_recall_on_all_pairs(spark):
    """All pairs of lines of edit similarity 0.9 in a table, found by brute force; pairs are passed over only where counts of letter pairs prove them apart."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    norm = sorted({r.norm for r in line_dedup._rows(docs).select("norm").collect()}, key=lambda x: (len(x), x))
    counts = np.zeros((len(norm), 256), np.int32)
    for i, x in enumerate(norm):
        for a, b in zip(x, x[1:]):
            counts[i, hash((ord(a), ord(b))) % 256] += 1
    size, may = np.array([len(x) for x in norm]), []
    for j in range(len(norm)):
        most = int(0.1 * size[j] + 1e-9)
        low = int(np.searchsorted(size, size[j] - most))
        for i in low + np.flatnonzero(np.abs(counts[low:j] - counts[j]).sum(axis=1) <= 4 * most):
            may.append((int(i), j))
    near = all_near(spark, norm, may)
    got = components.components(line_dedup.line_links(spark.createDataFrame(list(enumerate(norm)), "line long, norm string")))
    group = {r.node: r.component for r in got.collect()}
    found = sum(group.get(i, i) == group.get(j, j) for i, j in near)
    print(f"recall {found} of {len(near)}")
    assert len(near) > 10 and found >= 0.9 * len(near)


def test_lines_of_odd_rows(spark):
    rng = random.Random(2)
    long = prose(rng, 3000, 9000)
    other = long.replace(" w1", " v1", 3)
    one = "a line that several of the documents have, whatever their ids may be"
    rows = [(None, one), (5, one), (5, one), (4, None), (3, ""), (2, "\n \n--"), (None, "alone here"), (8, long), (9, other), (7, f"{one}\n{one}")]
    d = frame(spark, rows).select("*", *[F.lit(k).alias(c) for k, c in enumerate(["gone", "tie", "row", "id", "at", "a.b", "line", "__gone"])])
    got = line_dedup.line_dedup(d)
    assert got.columns == d.columns
    out = sorted((r.doc_id or -1, r.text or "", r.n_chars or 0, r["a.b"], r.gone) for r in got.collect())
    texts = [(-1, ""), (-1, "alone here"), (2, "\n \n--"), (3, ""), (4, ""), (5, one), (5, one), (7, ""), (8, long), (9, "")]
    assert out == sorted((i, t, len(t), 5, 0) for i, t in texts)


def by_hand_targets(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        left, w = total - sum(out.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > 2 * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / w for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, rng.randrange(60), rng.randrange(300)])), rng.choice(["a", "b", "B", "é", "z", "z", "z", None])) for i in range(3000)]
    rows += [(1, None, "a"), (7, "same words", "b"), (7, "same words", "b"), (None, "x y", None)]
    d = frame(spark, rows)
    got = mixing.mix_sources(d).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = by_hand_targets(sizes)
    taken = defaultdict(int)  # by target and size, which tell the sources apart
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[round(r.target, 6), r.source_size] += r.taken
    assert sorted(taken) == sorted((round(t, 6), sizes[s]) for s, t in want.items())
    assert all(abs(n - t) <= 5 for (t, _), n in taken.items())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(d.repartition(5)).collect()))
    assert mixing.mixed(d).count() == sum(r.times for r in got) and mixing.mixed(d).columns == d.columns
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    zeros = mixing.mix_sources(frame(spark, [(1, "", "a"), (2, None, "b")])).collect()
    assert [(r.target, r.taken) for r in zeros] == [(0.0, 0), (0.0, 0)]


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(1)
    p, x = rng.random(500), rng.integers(1, 900, 500)
    q = mixing.fly(p.copy(), x, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-5 and abs((q * x).sum() - (p * x).sum()) < 1e-3
    mean = np.mean([mixing.fly(np.full(40, 0.3), np.arange(1, 41), np.random.default_rng(s)) for s in range(600)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.09


def brute_winnow(t, k=fingerprints.K, w=fingerprints.W):
    codes = np.array([ord(c) for c in t], np.uint32)
    n = len(codes)
    if not n:
        return []
    one = lambda s: fingerprints.winnow(np.array([ord(c) for c in s], np.uint32), np.array([0, len(s)]), k, 1)[2][0]
    hashes = [int(one(t[i : i + k])) for i in range(max(1, n - k + 1))]
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if not out or out[-1][0] != at:
            out.append((at, hashes[at]))
    return out


def test_winnowing(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("abé😀") for _ in range(rng.choice([0, 1, 9, 10, 11, 38, 39, 40, 200]))) for _ in range(120)]
    got = {r.doc_id: list(zip(r.places, r.hashes)) for r in fingerprints.fingerprint(frame(spark, [*enumerate(texts), (999, None)])).collect()}
    assert got.pop(999) == [] and got == {i: brute_winnow(t) for i, t in enumerate(texts)}
    shared = prose(rng, 30)
    a, b = (set(h for _, h in brute_winnow(prose(rng, 20) + shared + prose(rng, 20))) for _ in range(2))
    assert a & b


def test_edited_texts(spark):
    rng = random.Random(11)
    rows = [(i * 3, prose(rng, rng.choice([0, 1, 3, 50, 300]))) for i in range(150)] + [(5, None), (None, "no id at all"), (7, "twice the same"), (7, "twice the same")]
    rows += [(1000, "é" * 37)]
    got = fingerprints.edit_test(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    hexed = lambda t: "".join(f"{h:08x}" for _, h in brute_winnow(t))
    sets = lambda t: {h for _, h in brute_winnow(t)}
    want = []
    for (d, t), (_, x) in zip(order, [*order[1:], order[0]]):
        c = len(t) // 4
        e = t[: len(t) - c] + x[:c]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(t), hexed(e), like(sets(t), sets(e)), like(sets(t), sets(x))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fingerprints.edit_test(frame(spark, [])).count() == 0
    single = fingerprints.edit_test(frame(spark, [(1, "only one text here")])).collect()
    assert [(r.near_next,) for r in single] == [(1.0,)]


def test_null_and_repeated_ids_are_dealt_over_ranges(spark):
    """Rows of one id, and those without an id, follow each other by their texts' hashes, in ranges of about one size."""
    rng = random.Random(12)
    rows = [(9, f"{i} {prose(rng, 6)}") for i in range(250)] + [(None, f"{i} {prose(rng, 6)}") for i in range(200)] + [(i, f"{i} {prose(rng, 6)}") for i in range(-60, 90)]
    docs = frame(spark, rows)
    ties = {(r.doc_id, r.text): r.tie for r in docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r]))
    want = []
    for (d, t), (_, x) in zip(order, [*order[1:], order[0]]):
        e = t[: len(t) - len(t) // 4] + x[: len(t) // 4]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    got = [tuple(r) for r in fingerprints.edit_test(docs).select("doc_id", "n_chars", "edited_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ids = docs.select("doc_id", F.xxhash64("text").alias("tie"))
    for n in (1, 2, 20):
        dealt = sorted(ids.withColumn("part", fingerprints.range_of(ids, n)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
        parts = [r.part for r in dealt]
        assert parts == sorted(parts) and min(parts) >= 0
    assert max(parts.count(p) for p in set(parts)) < 3 * len(rows) / 20
    for one in ([(9, t) for _, t in rows], [(None, t) for _, t in rows]):
        ids = frame(spark, one).select("doc_id", F.xxhash64("text").alias("tie"))
        sizes = [r["count"] for r in ids.groupBy(fingerprints.range_of(ids, 20).alias("p")).count().collect()]
        assert len(sizes) >= 19 and max(sizes) < 3 * len(one) / 20


def edits(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in b]))
        row = np.minimum.accumulate(np.concatenate([[i], step]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return row[-1]


def edited(rng, line, n):
    """The line with n letters changed, lost or added, each in a word of its own where there are enough."""
    words = line.split(" ")
    for k in rng.sample(range(len(words)), min(n, len(words))):
        w, at = words[k], rng.randrange(len(words[k]))
        words[k] = rng.choice([w[:at] + "q" + w[at + 1 :], w[:at] + "q" + w[at:], (w[:at] + w[at + 1 :]) or "q"])
    return " ".join(words)


def test_fuzzy_recall_by_length(spark):
    """Links against edit similarity alone: all under 60 characters, and nearly all of up to three edits above."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([1, 2, 3, 3, 4, 5, 6, 8, 11]))) for _ in range(4000)]
    norm, pairs = [], []
    for words in (1, 3, 6, 11, 20, 35, 70):
        for _ in range(150):
            a = " ".join(rng.choice(vocabulary) for _ in range(words))
            b = edited(rng, a, rng.choice([1, 1, 2, 3]))
            pairs.append((len(norm), len(norm) + 1))
            norm += [a, b]
    norm += ["of the in", "of thr in", "of the in an at by", "of the in an at bx", "".join(chr(0x4E00 + i * 7) for i in range(90)), "".join(chr(0x4E00 + i * (7 if i != 50 else 8)) for i in range(90))]
    pairs += [(len(norm) - k, len(norm) - k + 1) for k in (6, 4, 2)]
    got = {tuple(sorted(r)) for r in line_dedup.line_links(spark.createDataFrame(list(enumerate(norm)), "line long, norm string")).collect()}
    near = [p for p in pairs if norm[p[0]] != norm[p[1]] and edits(norm[p[0]], norm[p[1]]) <= int(0.1 * max(len(norm[i]) for i in p) + 1e-9)]
    for low, high, least in ((0, 60, 1.0), (60, 100, 0.9), (100, 200, 0.97), (200, 10**6, 0.99)):
        some = [p for p in near if low <= max(len(norm[i]) for i in p) < high]
        print(low, len(some), sum(p in got for p in some) / len(some))
        assert len(some) > 50 and sum(p in got for p in some) >= least * len(some)
    assert (len(norm) - 2, len(norm) - 1) in got
