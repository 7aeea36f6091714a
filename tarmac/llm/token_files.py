"""Token-ID output: Arrow files of fixed-size-list batches, one file per range of doc_id, and their reader.

A file is the Arrow IPC stream with its footer. Each row is one sequence of equal length:
ids (padded with 0), mask (true for ids of documents), and the documents that begin in
it. The ids of a file's documents follow each other through its rows, in ascending
doc_id, so a batch's values are one run of ids that readers map without copying.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.chunk_cache import PIECE_CHARS, id_type, library_cache
from tarmac.llm.word_arrays import slices
from tarmac.llm.workspace import Workspace

SEQUENCE, BATCH = 2048, 256
END = 1
#: Bytes of text for a file, about.
FILE_BYTES = 32 << 20
_BEGINS = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int32()), ("n_tokens", pa.int64())]))


def _schema(kind: str, length: int) -> pa.Schema:
    value = pa.uint16() if kind == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length)), ("begins", _BEGINS)])


class SequenceFile:
    """Writes documents' ids as sequences; holds one batch of them."""

    def __init__(self, out, kind: str, length: int = SEQUENCE, batch: int = BATCH):
        self.kind, self.length, self.size = kind, length, length * batch
        self.schema = _schema(kind, length)
        self.writer = pa.ipc.new_file(out, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.tokens = self.docs = 0
        self.begins: list[tuple[int, dict]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.begins.append((self.held, {"doc_id": doc_id, "n_tokens": len(ids)}))
        self.parts.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        self.docs += 1
        while self.held >= self.size:
            self._write(self.size)

    def _write(self, n: int) -> None:
        flat = np.concatenate([*self.parts, np.zeros(0, self.kind)])
        own, rest = flat[:n], flat[n:]
        rows = -(-len(own) // self.length)
        ids = np.zeros(rows * self.length, self.kind)
        ids[: len(own)] = own
        begins: list[list[dict]] = [[] for _ in range(rows)]
        for at, doc in self.begins:
            if at < n:
                begins[at // self.length].append(doc | {"offset": at % self.length})
        mask = pa.array(np.arange(rows * self.length) < len(own))
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(mask, self.length),
            pa.array(begins, _BEGINS),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.parts, self.held = [rest], len(rest)
        self.begins = [(at - n, doc) for at, doc in self.begins if at >= n]

    def close(self) -> None:
        if self.held:
            self._write(self.held)
        self.writer.close()


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """pyarrow's file system for a folder of the cluster, and the path in it."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, ws: Workspace, length: int = SEQUENCE) -> DataFrame:
    """Writes docs(doc_id, text) to folder; returns the manifest (part, path, n_docs, n_tokens, first).

    Texts are shuffled once, by ranges of doc_id; each range is one task and one file, and
    is written in ascending doc_id (nulls first, rows that repeat an id in order of their
    text's hash and text). first is the number of ids in all files before. A file gets a new name in each
    attempt of its task and counts once its row is in the manifest, so a lost executor or
    a second attempt does no harm. Null texts are empty: just the end id. Other columns are
    not read; an empty table writes no file. A text of b bytes needs about 20 b of memory.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    parts = max(2, -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, kind = library_cache(tokenizer), id_type(tokenizer)
        out, path, end = None, None, np.array([END], kind)
        for batch in batches:
            for part in slices(batch, "text", PIECE_CHARS):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), cache.encode_all(part.column("text").to_pylist())):
                    if out is None:
                        fs, base = file_system(folder)
                        fs.create_dir(base, recursive=True)
                        number = TaskContext.get().partitionId()
                        path = f"{base}/part-{number:05d}-{uuid.uuid4().hex}.arrow"
                        stream = fs.open_output_stream(path)
                        out = SequenceFile(stream, kind, length)
                    out.add(doc_id, np.concatenate([np.frombuffer(ids, kind), end]))
        if out is not None:
            out.close()
            stream.close()
            pa.default_memory_pool().release_unused()  # the worker lives on beside later stages
            yield pa.RecordBatch.from_pydict({"part": [number], "path": [path], "n_docs": [out.docs], "n_tokens": [out.tokens]}, pa.schema([("part", pa.int32()), ("path", pa.utf8()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # The hash parts rows that share an id, or have none, where they are too many for one file.
    keys = ["doc_id", F.xxhash64("text"), "text"]
    ranged = docs.select("doc_id", "text").repartitionByRange(int(parts), *keys[:2]).sortWithinPartitions(*keys)
    manifest = ws.table(ranged.mapInArrow(run, "part int, path string, n_docs bigint, n_tokens bigint"), "manifest")
    # One row per file, so the running sum in one task is over few rows.
    before = F.sum("n_tokens").over(_by_part())
    return manifest.withColumn("first", F.coalesce(before, F.lit(0)))


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of the manifest alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                with fs.open_input_file(path) as f:
                    reader = pa.ipc.open_file(f)
                    doc, left, crc, start, done = None, 0, 0, first, []
                    for i in range(reader.num_record_batches):
                        rows = reader.get_batch(i)
                        flat = np.asarray(rows.column("ids").flatten()).astype("<u4")
                        length = rows.schema.field("ids").type.list_size
                        begins = [(r * length + x["offset"], x) for r, many in enumerate(rows.column("begins").to_pylist()) for x in many]
                        if left:
                            n = min(left, len(flat))
                            crc, left = zlib.crc32(flat[:n], crc), left - n
                            if not left:
                                done.append((doc["doc_id"], start, doc["n_tokens"], crc))
                                start += doc["n_tokens"]
                        for at, doc in begins:
                            n = min(doc["n_tokens"], len(flat) - at)
                            crc, left = zlib.crc32(flat[at : at + n]), doc["n_tokens"] - n
                            if not left:
                                done.append((doc["doc_id"], start, doc["n_tokens"], crc))
                                start += doc["n_tokens"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done) if done else ((), (), (), ()))], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        done = []

    files = manifest.select("path", "first")
    spread = files.repartition(max(2, files.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def sequence(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a file, without reading the rest: ids are a view of the mapped file."""
    reader = pa.ipc.open_file(pa.memory_map(path))
    rows = reader.get_batch(number // BATCH)
    k = number % BATCH
    return np.asarray(rows.column("ids")[k].values), np.asarray(rows.column("mask")[k].values)
