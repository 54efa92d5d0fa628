"""Token ids as ORC files.

Rows lie in ascending document order over the files: (part, doc_id, part_start, n_tokens, ids). The ids are integer
run-length encoded; row indexes hold the smallest and largest doc_id of each stride and Bloom filters its ids, so a
reader looking for some documents skips stripes and strides, and readers of everything split files by stripes.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.buffers import pieces
from pactum.llm.pretokens import Encoder, vocabulary
from pactum.llm.shared import partitions

FILE_SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"


def library_solver(path: str, plain: bool = False):
    """The tokenizers library on lists of pretokens, which are encoded independently of each other. plain: special strings are text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain

    def solve(words: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(words), 4096):
            out += [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words[i : i + 4096]], add_special_tokens=False)]
        return out

    return solve


@functools.cache
def library_encoder(path: str) -> Encoder:
    """The library on each distinct pretoken.

    One for each worker process: later tasks find what earlier ones worked out.
    """
    return Encoder({s.encode(): i for s, i in vocabulary(path).special.items()}, library_solver(path), 1_000_000)


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 2) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the ids to ORC files at ``path``.

    Null and empty texts have the end id alone. Null doc_ids come first; rows with one doc_id are ordered by their
    text, and rows that are the same in both are kept, so the order is defined. Other columns aren't carried.
    One range shuffle on (doc_id, hash of the text): no key, however frequent, must share a task.
    """
    n = partitions(docs.sparkSession)
    tie = F.xxhash64("text")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(n, F.asc_nulls_first("doc_id"), tie)
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), tie, "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = library_encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                ids, ptr = encoder.encode(data, offsets)
                ids = np.insert(ids, ptr[1:], end_id)
                ptr = ptr + np.arange(len(ptr))
                columns = [np.full(j - i, part, np.int32), batch.column(0)[i:j], at + ptr[:-1], np.diff(ptr)]
                at += int(ptr[-1])
                yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x) for x in columns), pa.ListArray.from_arrays(ptr.astype(np.int32), pa.array(ids, pa.int32()))], names=["part", "doc_id", "part_start", "n_tokens", "ids"])

    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20), "orc.encoding.strategy": "COMPRESSION"}
    ordered.mapInArrow(run, FILE_SCHEMA).write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start is the number of ids before the document in all files.

    A file's place follows from the sums of the parts before it: one row a part, so the broadcast side has as many rows
    as there are files (16 bytes each).
    """
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_token_files gives; ids count as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ptr = np.asarray(ids.offsets)
            body = np.asarray(ids.values).astype("<u4").tobytes()
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(ptr.tolist(), ptr[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
