"""Packing by power-of-two decomposition: no sequence holds more than one document, and none is padded."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.chunk_cache import PIECE_CHARS, id_type, library_cache
from tarmac.llm.word_arrays import slices
from tarmac.llm.workspace import Workspace

LONGEST, END = 2048, 1


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, largest first, that make up n: `longest` as often as it fits, then the bits of the rest."""
    out = [longest] * (n // longest)
    return out + [1 << k for k in reversed(range(longest.bit_length() - 1)) if (n % longest) >> k & 1]


def _cut(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of these lengths, one after another: each piece's document, length, and place among all ids."""
    sizes = np.array([longest, *(1 << k for k in reversed(range(longest.bit_length() - 1)))])
    counts = np.concatenate([(lengths // longest)[:, None], (lengths % longest)[:, None] // sizes[1:] & 1], axis=1)
    doc = np.repeat(np.arange(len(lengths)), counts.sum(axis=1))
    own = np.repeat(np.tile(sizes, len(lengths)), counts.ravel())
    return doc, own, np.concatenate([[0], np.cumsum(own)[:-1]]) if len(own) else own


def pieces(docs: DataFrame, tokenizer: str, ws: Workspace) -> DataFrame:
    """The table of pieces, with their ids, as the tasks cut them: task and rank number the pieces of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, kind = library_cache(tokenizer), id_type(tokenizer)
        task, ranks, end = TaskContext.get().partitionId(), Counter(), np.array([END], kind).tobytes()
        width = np.dtype(kind).itemsize
        for batch in batches:
            for part in slices(batch, "text", PIECE_CHARS):
                ids = [x + end for x in cache.encode_all(part.column("text").to_pylist())]
                lengths = np.array([len(x) // width for x in ids])
                doc, own, at = _cut(lengths)
                flat = np.frombuffer(b"".join(ids), kind)
                wide = memoryview(flat.astype("<u4")).cast("B")
                ends = at + own
                crc = [zlib.crc32(wide[a:b]) for a, b in zip((4 * at).tolist(), (4 * ends).tolist())]
                rank = np.zeros(len(own), np.int64)
                for n in np.unique(own).tolist():
                    same = np.flatnonzero(own == n)
                    rank[same] = ranks[n] + np.arange(len(same))
                    ranks[n] += len(same)
                buffers = [None, pa.py_buffer((width * np.concatenate([[0], ends])).astype(np.int64)), pa.py_buffer(flat)]
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(doc)),
                    "start": pa.array(at - (np.cumsum(lengths) - lengths)[doc]),
                    "length": pa.array(own),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(lengths[doc]),
                    "task": pa.array(np.full(len(own), task)),
                    "rank": pa.array(rank),
                    "ids": pa.Array.from_buffers(pa.large_binary(), len(own), buffers).cast(pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)
        pa.default_memory_pool().release_unused()  # the worker lives on beside later stages

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, rank bigint, ids binary"
    return ws.table(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces")


def pack(docs: DataFrame, tokenizer: str, ws: Workspace) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) per piece of docs(doc_id, text).

    A document is its ids by the tokenizers library and an end id; null text is empty. Its
    pieces are powers of two up to LONGEST, each a sequence of its own, so offset is 0.
    Sequences of one length have consecutive numbers: buckets follow each other by
    length, and a trainer takes batches of equal lengths by ranges of sequence_id. Rows
    that repeat are packed each; rows without an id, too. Other columns are not read. An
    empty table gives no pieces. A text of b bytes needs about 20 b of memory in its task.
    """
    cut = pieces(docs, tokenizer, ws)
    # At most one row per task and length: 12 rows a task, so one task may sum them.
    sizes = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("length", "task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("length", "task", F.coalesce(before, F.lit(0)).alias("first"))
    out = cut.join(F.broadcast(firsts), ["length", "task"])
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
