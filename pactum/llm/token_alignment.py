"""Alignment of two tokenizers over the same bytes, and how often their tokens stand for each other.

A byte-level BPE (A) and a piece BPE with byte fallback (B) cut the same bytes, a space and the text. Tokens of the two
overlap if their byte ranges do; connected tokens are a group. Groups come from pointer jumping: every token points to the
token of the other side that reaches farthest to the right over it, a token that nothing outreaches to itself, and
successors are doubled over whole batches until nothing changes. Then each token holds the last one of its group.

Over the corpus, pairs of ids are counted by their links. Documents travel in blocks of about 4 MB of text: a block holds its
distinct pairs once and links as numbers of pairs, so a corpus-wide count is looked up once for each block, not for each link.
Texts are aligned in slices of half a megabyte, which bounds a task's memory.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.buffers import pieces, ranges, utf8
from pactum.llm.pretokens import Encoder, vocabulary
from pactum.llm.shared import stored
from pactum.llm.token_files import library_solver

BLOCK = 4 << 20
#: Bytes of text that are aligned at once: what tokens, links and their sorting take in memory goes by it, not by the block.
SLICE = 512 << 10
#: Rows of the pair counts that a task hands on at once.
ROWS = 200_000
#: A block's row takes about 10 MB. Parquet looks at what it holds every 100 rows only, and Spark reads a row group at once: a task
#: with 100 blocks would hold a GB, writing as well as reading. Row groups end at 16 MB, looked at after each row.
WIDE = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


@functools.cache
def side_a(path: str) -> tuple[Encoder, np.ndarray]:
    """An encoder that takes special strings for plain text, and the bytes of each id."""
    return Encoder({}, library_solver(path, plain=True), 400_000), np.array([len(s) for s in vocabulary(path).strings], np.int64)


@functools.cache
def side_b(path: str):
    """The library's processor, and the bytes that each id stands for: pieces with U+2581 as a space, <0xHH> as that byte."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    spell = lambda i: bytes([int(library.id_to_piece(i)[1:-1], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
    strings = [spell(i) for i in range(library.get_piece_size())]
    return library, strings


def laid_out(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings end to end, where each begins, and its length."""
    lens = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lens) - lens, lens


def successors(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For tokens of A, then of B: the number of the farthest-right overlapping token, itself where none reaches farther.

    The ends of either side grow, and both sides end at the same byte. A token's last byte lies in one token of the other
    side, which is the farthest. Where two end together, A's points to B's and B's to itself.
    """
    na = len(ends_a)
    to_b = na + np.searchsorted(ends_b, ends_a)
    over = np.searchsorted(ends_a, ends_b)
    own = na + np.arange(len(ends_b))
    return np.r_[to_b, np.where(ends_a[np.minimum(over, na - 1)] > ends_b, over, own)] if na else np.zeros(0, np.int64)


def terminals(pointers: np.ndarray) -> np.ndarray:
    """Where each pointer ends, by doubling."""
    while True:
        further = pointers[pointers]
        if np.array_equal(further, pointers):
            return pointers
        pointers = further


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs (token of A, token of B), by A's token, then B's."""
    starts_a = np.r_[0, ends_a[:-1]]
    first = np.searchsorted(ends_b, starts_a, side="right")
    count = np.searchsorted(ends_b, ends_a) - first + 1
    return np.repeat(np.arange(len(ends_a)), count), ranges(first, count)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.len_a = side_a(path_a)
        self.b, strings = side_b(path_b)
        self.flat_b, self.at_b, self.len_b = laid_out(strings)
        self.flat_a, self.at_a, _ = laid_out(vocabulary(path_a).strings)
        # each id as text with what may follow it: the next of its side, the other side, the next group, the end
        self.n = max(len(self.len_a), len(strings))
        self.spelled = [f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(self.n)]

    def spans(self, data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B over all texts, and where each text begins in them. Texts with other bytes than those of their tokens have none."""
        ids_a, ptr_a = self.a.encode(data, offsets)
        lists = self.b.encode(texts, num_threads=1) if texts else []
        ptr_b = np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)].astype(np.int64)
        ids_b = np.fromiter((i for x in lists for i in x), np.int64, int(ptr_b[-1]))
        body_a = self.flat_a[ranges(self.at_a[ids_a], self.len_a[ids_a])]
        body_b = self.flat_b[ranges(self.at_b[ids_b], self.len_b[ids_b])]
        ok = np.diff(offsets) > 1
        for body, ids, ptr, lens in ((body_a, ids_a, ptr_a, self.len_a), (body_b, ids_b, ptr_b, self.len_b)):
            upto = np.r_[0, np.cumsum(lens[ids])][ptr]
            if not np.array_equal(upto, offsets) or not np.array_equal(body, data):
                for t in range(len(texts)):
                    ok[t] &= np.array_equal(body[upto[t] : upto[t + 1]], data[offsets[t] : offsets[t + 1]])
        keep_a, keep_b = np.repeat(ok, np.diff(ptr_a)), np.repeat(ok, np.diff(ptr_b))
        na, nb = np.where(ok, np.diff(ptr_a), 0), np.where(ok, np.diff(ptr_b), 0)
        return ids_a[keep_a].astype(np.int64), np.r_[0, np.cumsum(na)], ids_b[keep_b], np.r_[0, np.cumsum(nb)]

    def digests(self, ids_a, ptr_a, last_a, ids_b, ptr_b, last_b) -> list[str]:
        """sha256 of each text's groups as a1,a2|b1;a3|b2,b3. last: whether a token is the last of its group on its side."""
        # tokens of A come before those of B in a group: order by the number of groups before, then side
        group_a, group_b = np.cumsum(np.r_[False, last_a[:-1]])[: len(ids_a)], np.cumsum(np.r_[False, last_b[:-1]])[: len(ids_b)]
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
        final = last_b.copy()
        ends = ptr_b[1:][np.diff(ptr_b) > 0] - 1
        code = np.zeros(len(ids_a) + len(ids_b), np.int64)
        code[place_a] = ids_a + self.n * last_a
        kind_b = 2 * final
        kind_b[ends] = 3
        code[place_b] = ids_b + self.n * kind_b
        words, cuts, spelled = code.tolist(), (ptr_a + ptr_b).tolist(), self.spelled
        return [hashlib.sha256("".join([spelled[c] for c in words[i:j]]).encode()).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:])]

    def block(self, texts: pa.Array) -> dict:
        """One block: for each text its counts and digest; the distinct pairs, their counts, and each link's pair."""
        got = [self.slice(texts[i:j].to_pylist()) for i, j, _, _ in pieces(texts, SLICE)]
        out = {k: np.concatenate([g[k] for g in got]) for k in DOC[1:5]} | {"groups_sha256": [x for g in got for x in g["groups_sha256"]]}
        # the slices' pairs as one list without repeats, and their links by its numbers
        out["pairs"], to = np.unique(np.concatenate([g["pairs"] for g in got]), return_inverse=True)
        out["counts"], first = np.zeros(len(out["pairs"]), np.int64), 0
        for g in got:
            own = to[first : first + len(g["pairs"])]
            out["counts"][own] += g["counts"]
            g["links"] = own[g["links"]].astype(np.uint32)
            first += len(own)
        return out | {"links": np.concatenate([g["links"] for g in got])}

    def slice(self, texts: list[str | None]) -> dict:
        """What ``block`` gives, of texts that are aligned at once."""
        spaced = pa.array([" " + (t or "") for t in texts], pa.large_string())
        data, offsets = utf8(spaced)
        ids_a, ptr_a, ids_b, ptr_b = self.spans(data, offsets, [t or "" for t in texts])
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        pointers = terminals(successors(ends_a, ends_b))
        na = len(ids_a)
        own = np.flatnonzero(pointers == np.arange(len(pointers))) - na  # the terminals, tokens of B
        last_b = np.zeros(len(ids_b), bool)
        last_b[own] = True
        last_a = np.r_[pointers[1:na] != pointers[: na - 1], True] if na else np.zeros(0, bool)
        one, two = links(ends_a, ends_b) if na else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pairs, back, counts = np.unique(ids_a[one] << 32 | ids_b[two], return_inverse=True, return_counts=True)
        n_links = np.diff(np.searchsorted(one, ptr_a))
        n_groups = np.diff(np.searchsorted(own, ptr_b))
        return {"n_a": np.diff(ptr_a), "n_b": np.diff(ptr_b), "n_groups": n_groups, "n_links": n_links, "groups_sha256": self.digests(ids_a, ptr_a, last_a, ids_b, ptr_b, last_b),
                "pairs": pairs, "counts": counts, "links": back.astype(np.uint32)}


DOC = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
BLOCK_SCHEMA = "block long, docs array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs binary, counts binary, links binary"


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with their groups and links, as a stored table (see ``Aligner.block``)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, seq = Aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.diff(utf8(batch.column(1))[1])
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
                if i == j:
                    continue
                got = aligner.block(batch.column(1)[i:j])
                columns = [pa.array([part << 33 | seq], pa.int64()), pa.array([batch.column(0)[i:j].to_pylist()], pa.list_(batch.schema.field(0).type))]
                columns += [pa.array([got[k].tolist()], pa.list_(pa.int64())) for k in DOC[1:5]] + [pa.array([got["groups_sha256"]], pa.list_(pa.string()))]
                columns += [pa.array([got[k].tobytes()], pa.binary()) for k in ("pairs", "counts", "links")]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "docs", *DOC[1:], "pairs", "counts", "links"])
                seq += 1

    return stored(docs.select(id_col, text_col).mapInArrow(run, BLOCK_SCHEMA.format(id=kind.simpleString())), **WIDE)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            block, pairs, counts = batch.column(0)[r].as_py(), *(np.frombuffer(batch.column(k)[r].as_buffer(), np.int64) for k in (1, 2))
            for i in range(0, len(pairs), ROWS):
                some = pairs[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.array((some >> 32).astype(np.int32)),
                                                  pa.array((some & 0xFFFFFFFF).astype(np.int32)), pa.array(counts[i : i + ROWS])], names=["block", "place", "a", "b", "n"])


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, place, a, b, n): the distinct pairs of each block and their links in it."""
    return blocks.select("block", "pairs", "counts").mapInArrow(_unpacked, "block long, place int, a int, b int, n long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): each linked pair of ids, its links in the corpus, and whether no pair of the same b has more."""
    counts = stored(block_pairs(blocks).groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    Null and empty texts, and those that one of the tokenizers doesn't give back byte for byte (a normalised character, for
    example), have no tokens: zeros, and '' for the digest. Rows are independent: repeated rows and null ids stay, and
    count as often as they come. Other columns are not carried. A text of over BLOCK bytes is a block of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = aligned_blocks(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(blocks)
    looked_up = block_pairs(blocks).drop("n").join(counts, ["a", "b"]).select("block", "place", "n", "best")

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {name: [] for name in (id_col, *DOC[1:5], "n_best", "count_sum", "groups_sha256")}
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right["place"].to_numpy()
        n[place], best[place] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        for row in left.select(["docs", *DOC[1:], "links"]).to_pylist():
            link = np.frombuffer(row["links"], np.uint32)
            cuts = np.r_[0, np.cumsum(row["n_links"])]
            for name, values in (("n_best", best[link]), ("count_sum", n[link])):
                upto = np.r_[0, np.cumsum(values)]
                columns[name] += np.diff(upto[cuts]).tolist()
            columns[id_col] += row["docs"]
            for name in DOC[1:]:
                columns[name] += row[name]
        types = {id_col: left.schema.field("docs").type.value_type, "groups_sha256": pa.string()}
        return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in columns.items()})

    out = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    left = blocks.drop("pairs", "counts")
    return left.groupBy("block").cogroup(looked_up.groupBy("block")).applyInArrow(finish, out)
