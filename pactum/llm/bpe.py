"""Byte-level BPE encoding and decoding.

Encoding: the symbols of a pretoken form a doubly linked list; a priority queue holds the merges that are possible
by rank, then place. The first is taken from the queue and carried out, unless one of its symbols has gone or
changed since it was queued (a stale entry, skipped). Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.buffers import pieces
from pactum.llm.pretokens import Encoder, Vocabulary, vocabulary


def merge_word(word: bytes, vocab: Vocabulary) -> list[int]:
    """The ids of one pretoken."""
    ids = [vocab.byte_ids[b] for b in word]
    n = len(ids)
    if n < 2:
        return ids
    merges = vocab.merges
    queue = []
    for i in range(n - 1):
        if got := merges.get((ids[i], ids[i + 1])):
            queue.append((got[0], i, got[1], ids[i], ids[i + 1]))
    if not queue:
        return ids
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        _, i, both, left, right = heappop(queue)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue  # stale
        ids[i], ids[j] = both, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if got := merges.get((both, ids[k])):
                heappush(queue, (got[0], i, got[1], both, ids[k]))
        if (h := before[i]) >= 0 and (got := merges.get((ids[h], both))):
            heappush(queue, (got[0], h, got[1], ids[h], both))
    return [x for x in ids if x >= 0]


def heap_encoder(path: str) -> Encoder:
    vocab = vocabulary(path)
    return Encoder({s.encode(): i for s, i in vocab.special.items()}, lambda words: [merge_word(w, vocab) for w in words])


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every whole text.

    Null and empty texts give an empty array. Rows are independent: repeated rows and null ids stay as they are. Other
    columns are not carried, so no name can clash. No shuffle; each task keeps a bounded memo of pretokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = heap_encoder(vocabulary_path)
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                ids, ptr = encoder.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(ptr.astype(np.int32), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of every id sequence; bytes that are no UTF-8 become U+FFFD. A null sequence gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(vocabulary_path).strings
        for batch in batches:
            texts = [b"".join([strings[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded again, as digests.

    The same work as ``decode(encode(docs))``, without the ids crossing between Python and the JVM. Empty and null
    texts have no token and the digests of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = heap_encoder(vocabulary_path)
        strings = vocabulary(vocabulary_path).strings
        numbers = [str(i) for i in range(len(strings))]
        sha = hashlib.sha256
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                ids, ptr = encoder.encode(data, offsets)
                whole, ends = ids.tolist(), ptr.tolist()
                lists = [whole[a:b] for a, b in zip(ends, ends[1:])]
                spelled = [sha(",".join([numbers[k] for k in x]).encode()).hexdigest() for x in lists]
                decoded = [b"".join([strings[k] for k in x]) for x in lists]
                back = [sha(x.decode("utf-8", "replace").encode()).hexdigest() for x in decoded]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(ptr), pa.int64()), pa.array(spelled), pa.array(back)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
