from __future__ import annotations

import functools
import glob
import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from tokenizers import Tokenizer

from pactum.llm import queries, token_alignment
from pactum.llm.pretokens import vocabulary

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(strings):
    at = 0
    for s in strings:
        yield at, at + len(s)
        at += len(s)


def tokens(text):
    """(ids and byte ranges of A, of B), both empty if either doesn't give the bytes back."""
    if not text:
        return [], []
    a, b = libraries()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [vocabulary(A).strings[i] for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], []
    return list(zip(ids_a, spans(bytes_a))), list(zip(ids_b, spans(bytes_b)))


def brute(texts):
    """The whole contract by sweeps over token lists."""
    found, counts = [], Counter()
    for t in texts:
        a, b = tokens(t)
        pairs, j = [], 0
        for i, (s, e) in a:
            while j and b[j - 1][1][1] > s:
                j -= 1
            while b[j][1][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1][0] < e:
                pairs.append((i, b[k][0]))
                k += 1
        borders = sorted({e for _, (_, e) in a} & {e for _, (_, e) in b})
        groups, p, q = [], 0, 0
        for border in borders:
            left, right = [], []
            while p < len(a) and a[p][1][1] <= border:
                left.append(str(a[p][0]))
                p += 1
            while q < len(b) and b[q][1][1] <= border:
                right.append(str(b[q][0]))
                q += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        counts.update(pairs)
        found.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(a, b, g, len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), sha) for a, b, g, p, sha in found]


def frame(spark, rows):
    schema = "doc_id long, text string, block int, n_a string, place string, docs string"
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], schema).repartition(3)


def result(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df]


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "  ", "a", "hello world", "hello world", " leading", "trailing ", "two  spaces\n\nlines\t", "▁ mark", "ﬁ ligature", "é é", "<|endoftext|> inside", "<s> </s> <unk> <0x41>",
             "😀😀 emoji \U0001f468‍\U0001f469", "中文字符 日本語 한국어", "　wide", " hard", "x" * 3000, "\x00\x01", "12345678901234567890", "don't we'll I've", "\r\n"]
    letters = "abcdefghij éüñ中😀  \n.,'0123456789<|>"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    return texts


def test_equals_brute_force(spark):
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = {r.doc_id: r for r in token_alignment.align(frame(spark, enumerate(texts)), A, B).collect()}
    assert result(got[i] for i in range(len(texts))) == brute(texts)


def test_long_text_is_a_block_of_its_own(spark):
    rng = random.Random(4)
    words = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]
    long = " ".join(rng.choice(words) for _ in range(2600))
    assert len(long) > token_alignment.BLOCK
    texts = ["short one", long, "another short one"]
    got = {r.doc_id: r for r in token_alignment.align(frame(spark, enumerate(texts)).coalesce(1), A, B).collect()}
    assert result(got[i] for i in range(3)) == brute(texts)


def test_odd_rows(spark):
    got = token_alignment.align(frame(spark, [(None, "a text"), (3, "a text"), (3, "a text"), (4, None)]), A, B).collect()
    want = brute(["a text"] * 3)
    assert sorted((r.doc_id or -1, *result([r])[0]) for r in got) == [(-1, *want[0]), (3, *want[0]), (3, *want[0]), (4, 0, 0, 0, 0, 0, 0, "")]
    assert token_alignment.align(frame(spark, []), A, B).count() == 0


def test_pointer_jumping():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 50, 1000):
        size = 3 * n
        a = np.union1d(rng.choice(np.arange(1, size), min(n, size - 1), replace=False), [size])
        b = np.union1d(rng.choice(np.arange(1, size), min(n, size - 1), replace=False), [size])
        label = token_alignment.terminals(token_alignment.successors(a, b))
        borders = np.intersect1d(a, b)
        want = np.searchsorted(b, borders)[np.searchsorted(borders, np.r_[a, b])] + len(a)
        assert np.array_equal(label, want)


def test_query_over_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, SF).collect()}
    assert result(got[i] for i in ids) == brute([texts[i] for i in ids])


def test_a_block_takes_memory_by_its_slices(monkeypatch):
    rng = random.Random(5)
    texts = pa.array([" ".join("".join(rng.choices("etaonrisé ", k=rng.randint(2, 9))) for _ in range(300)) for _ in range(1200)] + [None, "", "a"])
    aligner = token_alignment.Aligner(A, B)
    aligner.block(texts[:1])
    tracemalloc.start()
    cut = aligner.block(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = len("".join(t or "" for t in texts.to_pylist()).encode())
    assert size > 3 * token_alignment.SLICE and peak < 60 * size
    monkeypatch.setattr(token_alignment, "SLICE", size + 1)
    whole = aligner.block(texts)
    assert cut.keys() == whole.keys() and all(np.array_equal(cut[k], whole[k]) for k in whole)


def test_wide_rows_end_row_groups_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK", 4 << 10)
    monkeypatch.setitem(token_alignment.WIDE, "parquet.block.size", 32 << 10)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}x" for j in range(700))) for i in range(60)], "doc_id long, text string").coalesce(1)
    blocks = token_alignment.aligned_blocks(docs, A, B)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{blocks._stored_at.removeprefix('file:')}/*.parquet")]
    assert blocks.count() > 20 and max(groups) > 5
