from __future__ import annotations

import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pactum.llm import bpe, token_counts, token_files
from pactum.llm.pretokens import vocabulary
from pactum.llm.shared import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "'", " ", "\n", "\t", "1", "!", "é", "　", "s", "t", "re", "'s", "'ll", "½", "漢", "😀", "\x1c", "  ", "<|endoftext|>", "the", "er", "ing", " and", "\r\n", "Ⅷ", "़"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return [None, "", *made, "a" * 20_001, "ab" * 7000, "".join(rng.choice("abehrt") for _ in range(20_000)), "<|endoftext|>", "<|endoftext|", "the the"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 5 else i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def ids_of(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


def test_encoding_and_back(spark, docs, texts, library):
    got = {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()}
    want = {None if i == 5 else i: ids_of(library, t) for i, t in enumerate(texts)}
    assert got == want
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {k: library.decode(v, skip_special_tokens=False) for k, v in want.items()}


def test_digests(docs, texts, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()}
    for i, t in enumerate(texts):
        ids = ids_of(library, t)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[None if i == 5 else i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_broken_bytes_decode_like_the_library(spark, library):
    rng = random.Random(6)
    rows = [(i, [rng.randrange(50257) if rng.random() < 0.7 else rng.randrange(128, 256) for _ in range(rng.randint(0, 12))]) for i in range(300)]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame([*rows, (999, None)], "doc_id int, ids array<int>"), PATH).collect()}
    assert got.pop(999) == "" and got == {i: library.decode(x, skip_special_tokens=False) for i, x in rows}


def test_counts(docs, texts, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH).collect()}
    for i, t in enumerate(texts):
        n = len(ids_of(library, t))
        assert got[None if i == 5 else i] == (len((t or "").encode()), n, n > 1024)


def test_state_maps_compose():
    machine = token_counts.Transducer(vocabulary(PATH))
    body = b"therestingandthenagain" * 30
    maps = [token_counts.state_map(machine, body[i : i + 50], {token_counts.START}, 0, None) for i in range(0, len(body), 50)]
    left, right = functools.reduce(token_counts.compose, maps), functools.reduce(lambda x, y: token_counts.compose(y, x), maps[::-1])
    assert left[token_counts.START] == right[token_counts.START] == machine.run(body)


@pytest.mark.parametrize("chunk", [7, 64, token_counts.CHUNK])
def test_counts_come_from_composed_maps(monkeypatch, library, texts, chunk):
    """Of n chunks n - 1 pairs are composed, in real texts and in made ones with long pretokens and special strings."""
    real = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pylist()]
    some = [t or "" for t in real + texts] if chunk > 7 else [t or "" for t in texts if len(t or "") < 1000]
    pairs = []
    monkeypatch.setattr(token_counts, "compose", lambda x, y, compose=token_counts.compose: pairs.append(1) or compose(x, y))
    machine = token_counts.Transducer(vocabulary(PATH))
    encoder = token_counts.Encoder({s.encode(): 1 for s in vocabulary(PATH).special}, machine.counts)
    bodies = [t.encode() for t in some]
    offsets = np.r_[0, np.cumsum([len(b) for b in bodies])]
    got = token_counts.text_counts(machine, encoder, np.frombuffer(b"".join(bodies), np.uint8), offsets, chunk)
    assert got.tolist() == [len(ids_of(library, t)) for t in some]
    assert len(pairs) == sum(max(0, -(-len(b) // chunk) - 1) for b in bodies) > 0


def test_token_files(spark, docs, texts, library):
    path = shared_dir(spark)
    token_files.write_token_files(docs, path, PATH)
    rows = token_files.read_token_files(spark, path)
    got = {r.doc_id: r for r in token_files.checksums(rows).collect()}
    order = [5, *(i for i in range(len(texts)) if i != 5)]
    at = 0
    for i in order:
        ids = [*ids_of(library, texts[i]), 2]
        r = got[None if i == 5 else i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = spark.read.schema(token_files.FILE_SCHEMA).orc(path).where(F.col("doc_id") == 7)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString() and one.count() == 1


def test_ties_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    path = shared_dir(spark)
    token_files.write_token_files(d, path, PATH)
    rows = token_files.checksums(token_files.read_token_files(spark, path)).collect()
    assert sorted(r.start for r in rows) == [0, 2, 4, 6] and max(r.start for r in rows if r.doc_id == 2) == 6
    none = d.limit(0)
    path = shared_dir(spark)
    token_files.write_token_files(none, path, PATH)
    assert token_files.read_token_files(spark, path).count() == 0
    assert bpe.round_trip(none, PATH).count() == token_counts.count_tokens(none, PATH).count() == 0
