"""Passages that repeat across documents, by prefix-partitioned suffix trees.

Every place of a text with WINDOW words to come is a suffix. Suffixes are dealt to groups by a prefix whose length is
chosen by count: a bin of first words holding at most ``bound`` suffixes is a group, a fuller one is split by the first
two words, then four, then the whole window. Within a group, suffixes sorted by their first WINDOW words are the leaves
of its subtree in order; equal neighbours are the leaves under one node of that depth, whose smallest document keeps
the passage. Marked windows that touch join up to maximal repeats in the document. Groups travel as packed blobs of
about ten bytes a suffix. A bin that is too full even by whole windows (one passage in very many documents) is
worked on as rows: smallest document by window, pre-aggregated, then a join that can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.buffers import U64, gram_rows, grams, mix, owners, pieces, ranges, span_hashes, words
from pactum.llm.shared import partitions

WINDOW = 13
LENGTHS = (1, 2, 4, WINDOW)
#: Suffixes of a group at most, but for the last length; bytes of text that are packed at once.
BOUND, PIECE = 4_000_000, 6 << 20
#: Counts of bins that travel in one row; marks that a task holds before it hands them on.
CHUNK, MARKS = 1024, 2_000_000
#: Bytes of text in a bucket, which one task cuts at once, and in a bin of prefixes, if they were spread evenly.
BUCKET, BIN = 6 << 20, 2 << 20


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers, as differences of as few bytes as they need."""
    steps = np.diff(a, prepend=a[:1])
    kind = next(k for k in ("i1", "i2", "i4", "i8") if k == "i8" or len(a) == 0 or max(-int(steps.min()), int(steps.max())) < 1 << (8 * int(k[1]) - 1))
    first = np.int64(a[0] if len(a) else 0)
    return kind.encode() + first.tobytes() + zstandard.compress(steps.astype(kind).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(b[10:]), b[:2].decode()).astype(np.int64)
    return np.frombuffer(b[2:10], np.int64)[0] + np.cumsum(steps)


class Suffixes:
    """The suffixes of some texts: document, place (word number) and hash of the window of each."""

    def __init__(self, ids: np.ndarray, valid: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        starts, lens, ptr = words(data, offsets)
        self.hashes, own = span_hashes(data, starts, lens), owners(ptr)
        self.rows = gram_rows(ptr, WINDOW)
        self.rows = self.rows[valid[own[self.rows]]] if len(self.rows) else self.rows
        self.doc = ids[own[self.rows]]
        self.place = self.rows - ptr[own[self.rows]]
        self.window = grams(self.hashes, WINDOW)[self.rows]

    def bin(self, length: int, bins: int) -> np.ndarray:
        prefix = self.window if length == WINDOW else grams(self.hashes, length)[self.rows]
        return (mix(prefix + U64(length)) % U64(bins)).astype(np.int64)

    def groups(self, split: np.ndarray, bins: int) -> np.ndarray:
        """The group of each suffix, level * bins + bin; split says which bins of a level go to the next. -1: too full at all levels."""
        group = np.full(len(self.rows), -1)
        todo = np.arange(len(self.rows))
        for level, length in enumerate(LENGTHS):
            at = self.bin(length, bins)[todo]
            done = ~split[level][at]
            group[todo[done]] = level * bins + at[done]
            todo = todo[~done]
        return group


def _suffixes(batches: Iterator[pa.RecordBatch], limit: int = PIECE) -> Iterator[Suffixes]:
    for batch in batches:
        ids, valid = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for i, j, data, offsets in pieces(batch.column(1), limit):
            yield Suffixes(ids[i:j], valid[i:j], data, offsets)


def crowded_bins(docs: DataFrame, bins: int, bound: int) -> np.ndarray:
    """Which bins of each prefix length hold over ``bound`` suffixes, counted over all documents: len(LENGTHS) * bins booleans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LENGTHS), bins), np.int64)
        for s in _suffixes(batches, 4 << 20):
            for level, length in enumerate(LENGTHS):
                total[level] += np.bincount(s.bin(length, bins), minlength=bins)
        flat = np.zeros(-(-total.size // CHUNK) * CHUNK, np.int64)
        flat[: total.size] = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) // CHUNK)), pa.array([x.tobytes() for x in flat.reshape(-1, CHUNK)], pa.binary())], names=["chunk", "counts"])

    def add(chunk: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x, np.int64) for x in chunk["counts"].to_pylist())
        return pa.table([pa.array(chunk["chunk"][0].as_py() * CHUNK + np.flatnonzero(counts > bound))], names=["bin"])

    full = np.zeros(len(LENGTHS) * bins, bool)
    for row in docs.mapInArrow(run, "chunk long, counts binary").groupBy("chunk").applyInArrow(add, "bin long").collect():
        full[row.bin] = True
    return full.reshape(len(LENGTHS), bins)


def repeats(docs: DataFrame, bins: int, buckets: int, bound: int) -> DataFrame:
    """Blobs (bucket, doc, place, check) of the windows that also start in a document with a smaller id, by the bucket of their document."""
    split = crowded_bins(docs, bins, bound)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _suffixes(batches):
            group = s.groups(split, bins)
            kept = np.flatnonzero(group >= 0)
            order = kept[np.lexsort((s.place[kept], s.doc[kept], group[kept]))]
            g, first = np.unique(group[order], return_index=True)
            cut = [*first.tolist(), len(order)]
            raw = s.window[order].astype("<u8")
            raw = raw.view(np.uint8).reshape(-1, 8)[:, :7]
            doc, place = s.doc[order], s.place[order]
            blobs = [(raw[a:b].tobytes(), _packed(doc[a:b]), _packed(place[a:b])) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), *(pa.array([x[k] for x in blobs], pa.binary()) for k in range(3))], names=["grp", "window", "doc", "place"])

    def answer(doc: np.ndarray, place: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
        bucket = (mix(doc.astype(U64)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((place, doc, bucket))
        b, first = np.unique(bucket[order], return_index=True)
        cut = [*first.tolist(), len(order)]
        parts = [order[x:y] for x, y in zip(cut, cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array([_packed(doc[p]) for p in parts], pa.binary()), pa.array([_packed(place[p]) for p in parts], pa.binary()), pa.array([check[p].tobytes() for p in parts], pa.binary())], names=["bucket", "doc", "place", "check"])

    def subtree(blobs: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(x[0] for x in blobs), np.uint8).reshape(-1, 7)
        window = np.zeros((len(raw), 8), np.uint8)
        window[:, :7] = raw
        window = window.view("<u8").ravel()
        doc = np.concatenate([_unpacked(x[1]) for x in blobs])
        place = np.concatenate([_unpacked(x[2]) for x in blobs])
        order = np.argsort(window, kind="stable")
        leaves = window[order]
        heads = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1]])
        smallest = np.minimum.reduceat(doc[order], heads)
        late = order[doc[order] > np.repeat(smallest, np.diff(np.r_[heads, len(order)]))]
        return doc[late], place[late], window[late].astype("<u2")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after another; marks are gathered over many of them, so rows follow the marks and not the groups."""
        now, blobs, marks, held = None, [], [], 0
        for batch in batches:
            for group, *blob in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now and blobs:
                    marks.append(subtree(blobs))
                    held, blobs = held + len(marks[-1][0]), []
                now = group
                blobs.append(tuple(blob))
                if held >= MARKS:
                    yield answer(*(np.concatenate(x) for x in zip(*marks)))
                    marks, held = [], 0
        if blobs:
            marks.append(subtree(blobs))
        if sum(len(m[0]) for m in marks):
            yield answer(*(np.concatenate(x) for x in zip(*marks)))

    kind = "bucket long, doc binary, place binary, check binary"
    packed = docs.mapInArrow(pack, "grp long, window binary, doc binary, place binary")
    found = packed.repartition(partitions(docs.sparkSession), "grp").sortWithinPartitions("grp").mapInArrow(subtrees, kind)
    if not split[-1].any():
        return found

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _suffixes(batches):
            at = np.flatnonzero(s.groups(split, bins) < 0)
            yield pa.RecordBatch.from_arrays([pa.array(s.window[at].view(np.int64)), pa.array(s.doc[at]), pa.array(s.place[at])], names=["window", "doc", "place"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, doc, place = (c.to_numpy() for c in batch.columns)
            yield answer(doc, place, window.view(U64).astype("<u2"))

    rows = docs.mapInArrow(loose, "window long, doc long, place long")
    smallest = rows.groupBy("window").agg(F.min("doc").alias("smallest"))
    late = rows.join(smallest, "window").where("doc > smallest").select("window", "doc", "place")
    return found.union(late.mapInArrow(answers, kind))


def substring_dedup(docs: DataFrame, bound: int = BOUND, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text, spans]): words in windows that also start in a document with a smaller id go.

    text is the kept words joined by one space, spans the removed runs as (first word, end word), which are maximal.
    Null and empty texts have no words. A row with a null doc_id is left whole and takes nothing from others. Rows with
    one doc_id are one document: they don't take from each other. Extra columns aren't carried; an empty table gives
    no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins, buckets = max(64, -(-size // BIN)), max(8, -(-size // BUCKET))
    marks = repeats(docs, bins, buckets, bound)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1), PIECE):
                ids = batch.column(0)[i:j]
                valid = ids.is_valid().to_numpy(zero_copy_only=False)
                key = ids.fill_null(0).to_numpy(zero_copy_only=False)
                salt = np.where(valid, key.astype(U64), mix(offsets[:-1].astype(U64) + U64(len(data))))
                bucket = (mix(salt) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                b, first = np.unique(bucket[order], return_index=True)
                cut = [*first.tolist(), len(order)]
                out = []
                for x, y in zip(cut, cut[1:]):
                    rows = order[x:y]
                    sizes = offsets[rows + 1] - offsets[rows]
                    out.append((key[rows].tobytes(), valid[rows].tobytes(), sizes.tobytes(), zstandard.compress(data[ranges(offsets[rows], sizes)].tobytes(), 3)))
                yield pa.RecordBatch.from_arrays([pa.array(b), *(pa.array([o[k] for o in out], pa.binary()) for k in range(4))], names=["bucket", "ids", "valid", "sizes", "texts"])

    def cut_out(texts: pa.Table, marks: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return empty
        ids = np.frombuffer(b"".join(texts["ids"].to_pylist()), np.int64)
        valid = np.frombuffer(b"".join(texts["valid"].to_pylist()), bool)
        offsets = np.r_[0, np.cumsum(np.frombuffer(b"".join(texts["sizes"].to_pylist()), np.int64))]
        data = np.frombuffer(b"".join(zstandard.decompress(x) for x in texts["texts"].to_pylist()), np.uint8)
        starts, lens, ptr = words(data, offsets)
        gone = np.zeros(len(starts) + 1, np.int64)
        if marks.num_rows and len(starts):
            doc = np.concatenate([_unpacked(x) for x in marks["doc"].to_pylist()])
            place = np.concatenate([_unpacked(x) for x in marks["place"].to_pylist()])
            check = np.frombuffer(b"".join(marks["check"].to_pylist()), "<u2")
            window = grams(span_hashes(data, starts, lens), WINDOW)
            order = np.argsort(ids, kind="stable")
            order = order[valid[order]]
            low, high = (np.searchsorted(ids[order], doc, side=s) for s in ("left", "right"))
            mark = np.repeat(np.arange(len(doc)), high - low)
            row = order[ranges(low, high - low)]
            at = ptr[row] + place[mark]
            fits = at + WINDOW <= ptr[row + 1]
            at, mark = at[fits], mark[fits]
            at = at[window[at].astype("<u2") == check[mark]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + WINDOW, -1)
        removed = np.cumsum(gone[:-1]) > 0
        kept = np.flatnonzero(~removed)
        sizes = lens[kept] + 1
        spaced = np.r_[data, np.uint8(32)]
        body = spaced[ranges(starts[kept], sizes)]
        ends = np.cumsum(sizes)
        body[ends - 1] = 32
        body = body.tobytes()
        ends = np.r_[0, ends][np.r_[0, np.cumsum(~removed)][ptr]].tolist()
        out = [body[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]
        n_words, n_removed = np.diff(ptr), np.diff(np.r_[0, np.cumsum(removed)][ptr])
        columns = [pa.array(ids, mask=~valid), pa.array(n_words), pa.array(n_removed), pa.array([hashlib.sha256(x).hexdigest() for x in out])]
        if with_text:
            own = owners(ptr)
            same = np.r_[False, (own[1:] == own[:-1]) & removed[:-1]] if len(own) else np.zeros(0, bool)
            heads = np.flatnonzero(removed & ~same)
            tails = np.flatnonzero(removed & ~np.r_[same[1:] & removed[1:], False]) + 1 if len(own) else heads
            spans = [[] for _ in out]
            for a, b in zip(heads.tolist(), tails.tolist()):
                spans[own[a]].append({"first": a - int(ptr[own[a]]), "end": b - int(ptr[own[a]])})
            columns += [pa.array([x.decode() for x in out]), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))]
        return pa.table(columns, names=names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text", "spans"] if with_text else [])]
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string, spans array<struct<first int, end int>>" if with_text else "")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        fields += [("text", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))]
    empty = pa.schema(fields).empty_table()
    packed = docs.mapInArrow(pack, "bucket long, ids binary, valid binary, sizes binary, texts binary")
    return packed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(cut_out, kind)
