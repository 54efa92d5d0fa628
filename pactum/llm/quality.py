"""Quality rules: counts by rule, and a calibrated logistic regression on hashed word and character n-grams.

The model is fitted in one task on a bounded sample of labelled rows (``SAMPLE`` a class, those with the smallest
hash of their id), calibrated on the part of the sample that it wasn't fitted on (Platt), and scored in Arrow
batches against a fixed probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.buffers import MIX1, U64, gram_rows, grams, mix, owners, pieces, span_hashes, words

#: Labelled rows of each class that the model is fitted on at most, and bytes of their texts in all and of one; bits of the feature hash; probability from which a text is good.
SAMPLE, BYTES, LONGEST, BITS, GOOD = 1500, 128 << 20, 1 << 20, 18, 0.3
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 10, 5, 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Weight of the words' and of the characters' part of a text's mean feature value.
SCALE = 30.0


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[ptr])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, lens, ptr = words(data, offsets)
    n = len(offsets) - 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[starts + lens] -= 1
    chars = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
    out = {"n_words": np.diff(ptr), "word_chars": _sums(chars, offsets), "n_symbols": _sums(SYMBOLS[data], offsets)}
    # lines with a word, and how many different ones
    heads = np.union1d(offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1)
    heads = heads[heads < len(data)]
    sizes = np.diff(np.r_[heads, len(data)])
    sizes = sizes - (data[heads + sizes - 1] == 10) if len(heads) else sizes
    held = np.diff(np.searchsorted(starts, np.r_[heads, len(data)])) > 0
    heads, sizes = heads[held], sizes[held]
    line_own = np.searchsorted(offsets, heads, side="right") - 1
    keys = np.unique(mix(span_hashes(data, heads, sizes) ^ mix(line_own.astype(U64) + U64(1))), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_own, minlength=n) - np.bincount(line_own[keys], minlength=n)
    # words in windows that occur twice
    rows = gram_rows(ptr, WINDOW)
    hashes, own = span_hashes(data, starts, lens), owners(ptr)
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(rows):
        keys = mix(grams(hashes, WINDOW)[rows] ^ mix(own[rows].astype(U64) + U64(1)))
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = rows[count[back] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(repeated[:-1]) > 0, ptr)
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts in UTF-8, those beyond ASCII hashed, and where each text begins in them."""
    begins = (data & 0xC0) != 0x80
    at = np.flatnonzero(begins)
    code = data[at].astype(np.uint32)
    more = np.flatnonzero(code > 127)
    sizes = np.diff(np.r_[at, len(data)])[more]
    for k in range(1, 4):
        longer = more[sizes > k]
        code[longer] = code[longer] * np.uint32(64) + data[at[longer] + k]
    code[more] = mix(code[more].astype(U64)).astype(np.uint32)
    return code, np.r_[0, np.cumsum(begins)][offsets]


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of every word, pair of words and three characters."""
    starts, lens, ptr = words(data, offsets)
    hashes, own = span_hashes(data, starts, lens), owners(ptr)
    shift = U64(64 - BITS)
    pairs = gram_rows(ptr, 2)
    out = [((hashes * MIX1) >> shift, own), (mix(grams(hashes, 2)[pairs] + U64(7)) >> shift, own[pairs])]
    code, first = characters(data, offsets)
    if len(code) > 2:
        three = code[:-2] + code[1:-1] * np.uint32(1 << 8) + code[2:] * np.uint32(1 << 16)
        code_own = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
        whole = np.flatnonzero(code_own[:-2] == code_own[2:])
        out.append((((three * np.uint32(2654435761)) >> np.uint32(32 - BITS))[whole], code_own[whole]))
    return out


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scaled mean weight of each kind of feature, added up."""
    n, out = len(offsets) - 1, np.zeros(len(offsets) - 1)
    for feature, own in features(data, offsets):
        size = np.bincount(own, minlength=n)
        out += SCALE * np.bincount(own, weights[feature], minlength=n) / np.maximum(size, 1)
    return out


def fit(texts: pa.Array, good: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """(weights, slope, offset): the probability of a good text is sigmoid(slope * score + offset)."""
    rows, cols, values = [], [], []
    n = len(texts)
    for i, j, data, offsets in pieces(texts, 1 << 20):
        for feature, own in features(data, offsets):
            keys, count = np.unique(own.astype(np.int64) << BITS | feature.astype(np.int64), return_counts=True)
            row = keys >> BITS
            rows.append((i + row).astype(np.int32))
            cols.append((keys & ((1 << BITS) - 1)).astype(np.int32))
            values.append((SCALE * count / np.bincount(own, minlength=j - i)[row]).astype(np.float32))
    row, col, value = map(np.concatenate, (rows, cols, values))
    held = np.arange(n) % 4 == 0  # for the calibration
    y = good.astype(float)
    balance = np.where(y > 0, 0.5 / max(1, (y * ~held).sum()), 0.5 / max(1, ((1 - y) * ~held).sum())) * ~held
    w, bias, m, v = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), np.zeros(1 << BITS)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[col], minlength=n) + bias, -30, 30)))
        r = (p - y) * balance
        g = np.bincount(col, value * r[row], minlength=1 << BITS) + decay * w
        bias -= rate * r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    z = np.bincount(row, value * w[col], minlength=n)[held]
    # Platt's targets keep the slope finite where the classes are far apart
    up, down = y[held].sum(), (1 - y[held]).sum()
    target = np.where(y[held] > 0, (up + 1) / (up + 2), 1 / (down + 2))
    weight = np.where(y[held] > 0, 0.5 / max(1, up), 0.5 / max(1, down))
    a, b = 1.0, bias
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, s = (p - target) * weight, p * (1 - p) * weight
        h = np.array([[(s * z * z).sum() + 1e-9, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        da, db = np.linalg.solve(h, np.array([(r * z).sum(), r.sum()]))
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -5, 5)
    return w.astype(np.float32), float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float] | None:
    """Fits the model on at most ``sample`` labelled rows a class; None if one of the classes has no row.

    Rows without an id, a label or a text don't count. A repeated id counts once, with the first of its texts and its worst
    label. Texts of over LONGEST bytes take no part in the fit, nor what comes after BYTES in order of the ids' hashes.
    """
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = [labels.where((F.col("quality") == c) & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    # at most 2 * sample rows of 12 bytes
    chosen = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    rows = chosen.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [*batches]
        if not got:
            return
        got = pa.Table.from_batches(got).sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()
        good = got["quality"].to_numpy() > 0
        if 0 < good.sum() < len(good):
            w, a, b = fit(pa.concat_arrays([c.cast(pa.large_string()) for c in got["text"].chunks]), good)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([a]), pa.array([b])], names=["w", "a", "b"])

    keyed = rows.select(F.xxhash64("doc_id").alias("key"), F.col("quality").cast("int"), "text")
    # the bounded sample alone lies in one task
    within = keyed.withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("key", "text"))).where(F.col("bytes") <= BYTES).drop("bytes")
    got = within.mapInArrow(one, "w binary, a double, b double").collect()
    return (np.frombuffer(got[0].w, np.float32), got[0].a, got[0].b) if got else None


def rate(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, good: float = GOOD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) of every whole text.

    Null and empty texts have no words and fail the base rules. Without a model (no labels) the base rules decide and
    the probability is null. Repeated rows and null ids stay as they are; other columns aren't carried. No shuffle.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                counts = base_counts(data, offsets)
                failed = base_failed(counts)
                if model is None:
                    p, kept = pa.nulls(j - i, pa.float64()), ~failed
                else:
                    p = 1 / (1 + np.exp(-np.clip(model[1] * scores(data, offsets, model[0]) + model[2], -30, 30)))
                    p, kept = pa.array(p), ~failed & (p >= good)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(counts[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(kept), p], names=[id_col, *names, "base_failed", "kept", "probability"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean, probability double")


def kept(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, good: float = GOOD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules and the model keep. No join and no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(at)):
                good_rows = ~base_failed(base_counts(data, offsets))
                if model is not None:
                    good_rows &= 1 / (1 + np.exp(-np.clip(model[1] * scores(data, offsets, model[0]) + model[2], -30, 30))) >= good
                yield batch.slice(i, j - i).filter(pa.array(good_rows))

    return docs.mapInArrow(run, docs.schema)
