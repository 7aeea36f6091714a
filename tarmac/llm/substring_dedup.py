"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.word_arrays import Block, block, sliding, slices, windows
from tarmac.llm.workspace import Workspace

#: Words of a passage that may not occur twice.
WINDOW = 35
#: What names a row: its id, which may be null or repeated, and a hash of its text. Rows equal in both have equal windows.
_KEY = ["doc_id", "text_key"]
_TOP = np.uint64(2**64 - 1)


def levels(window: int) -> list[int]:
    """Lengths from the first level to the window, each at most twice the one before: 9, 18, 35."""
    out = [window]
    while out[0] > 9:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _lowest(b: Block, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the seeds, the lowest in each window, and which windows lie in one document."""
    seeds = windows(b.hashes, seed)
    inside = b.left_in_doc()[: max(len(b.hashes) - window + 1, 0)] >= window
    return seeds, sliding(seeds, window - seed + 1, np.minimum) if len(inside) else np.zeros(0, np.uint64), inside


def _anchors(b: Block, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the seeds that are lowest in a window around them. Equal windows have equal anchors."""
    seeds, low, inside = _lowest(b, window, seed)
    if not len(low):
        return np.zeros(0, np.int64), seeds
    reach = window - seed
    around = np.concatenate([np.zeros(reach, np.uint64), np.where(inside, low, 0), np.zeros(reach, np.uint64)])
    return np.flatnonzero(sliding(around, reach + 1, np.maximum)[: len(seeds)] == seeds), seeds


def _rows(part: pa.RecordBatch, b: Block, at: np.ndarray, hashes: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    doc = b.doc_of_word()[at]
    place = (at - b.words[doc]).astype(np.int32)
    return pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(doc)) for c in _KEY), pa.array(place), *(pa.array(h.view(np.int64)) for h in hashes)], [*_KEY, *names])


def _level_hashes(window: int):
    lengths = levels(window)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b = block(part.column("text"))
                at, seeds = _anchors(b, window, lengths[-1])
                each = [windows(b.hashes, n)[at] for n in lengths[:-1]] + [seeds[at]]
                yield _rows(part, b, at, each, ["place", *(f"h{n}" for n in lengths)])

    return run


def _window_hashes(window: int):
    seed = levels(window)[-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b = block(part.column("text"))
                seeds, low, inside = _lowest(b, window, seed)
                marked = _marked(part.column("places"), b, len(b.hashes))[: len(seeds)]
                if len(low):
                    alive = sliding(np.where(marked, seeds, _TOP), window - seed + 1, np.minimum) == low
                    at = np.flatnonzero(alive & inside)
                    yield _rows(part, b, at, [windows(b.hashes, window)[at]], ["place", "h"])

    return run


def _marked(places: pa.Array, b: Block, n: int) -> np.ndarray:
    """Which words of the block are named by the lists of places in their documents."""
    out = np.zeros(n + 1, bool)
    flat = np.asarray(places.flatten()).astype(np.int64)
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(places), 0)).astype(np.int64)
    out[flat + np.repeat(b.words[:-1], counts)] = True
    return out[:n]


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                b = block(part.column("text"))
                n = len(b.hashes)
                first = np.flatnonzero(_marked(part.column("places"), b, n))
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, first, 1)
                np.subtract.at(change, np.minimum(first + window, n), 1)
                keep = np.cumsum(change)[:n] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[b.words]
                texts = _texts(b, np.flatnonzero(keep))
                total = np.diff(b.words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array(total),
                        pa.array(total - np.diff(kept)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_utf8()).cast(pa.utf8()),
                    ],
                    ["row", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def _texts(b: Block, keep: np.ndarray) -> list[bytes]:
    """Per document its words `keep`, joined by single spaces."""
    doc = b.doc_of_word()[keep]
    more = np.flatnonzero(doc[:-1] == doc[1:]) if len(keep) else keep
    change = np.zeros(len(b.data) + 1, np.int8)
    change[b.starts[keep]] += 1
    np.subtract.at(change, b.ends[keep], 1)
    taken = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    gaps = b.ends[keep[more]]
    taken[gaps] = True
    data = b.data.copy()
    data[gaps] = 0x20
    cuts = np.concatenate([[0], np.cumsum(taken)])[b.offsets]
    flat = data[taken].tobytes()
    return [flat[x:y] for x, y in zip(cuts, cuts[1:])]


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another row has, too. Keys are counted before the shuffle; hot ones are split by the skew join."""
    counts = rows.groupBy(key).count().where("count > 1").select(key)
    return rows.join(counts.hint("shuffle_merge"), key, "left_semi")


def repeated_windows(docs: DataFrame, ws: Workspace, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, places): where repeated windows of `window` words begin, for documents that have any.

    Level by level: windows of 9 words, at places chosen by content so that equal long
    windows choose alike, then of 18 where those of 9 are repeated, then each window of
    35 whose 18 are repeated. Only hashes and places move; texts do once, to meet the
    places where candidates survive.
    """
    lengths = levels(window)
    schema = ", ".join(["doc_id bigint", "text_key bigint", "place int", *(f"h{n} bigint" for n in lengths[:-1])])
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    alive = ws.table(docs.mapInArrow(_level_hashes(window), schema), "anchors")
    for n in lengths[:-1]:
        alive = ws.table(_repeated(alive, f"h{n}"), f"alive_{n}")
        ws.drop("anchors", *(f"alive_{m}" for m in lengths if m < n))
    spots = alive.groupBy(*_KEY).agg(F.sort_array(F.collect_set("place")).alias("places"))
    met = _meet(docs, spots, "inner").select(*_KEY, "text", "places")
    each = ws.table(met.mapInArrow(_window_hashes(window), "doc_id bigint, text_key bigint, place int, h bigint"), "windows")
    found = _repeated(each, "h").groupBy(*_KEY).agg(F.sort_array(F.collect_set("place")).alias("places"))
    out = ws.table(found, "repeated")
    ws.drop("windows", *(f"alive_{m}" for m in lengths))
    return out


def _meet(docs: DataFrame, spots: DataFrame, how: str) -> DataFrame:
    spots = spots.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    same = docs["doc_id"].eqNullSafe(spots["_id"]) & (docs["text_key"] == spots["_key"])
    return docs.join(spots.hint("shuffle_merge"), same, how).drop("_id", "_key")


def substring_dedup(docs: DataFrame, ws: Workspace, window: int = WINDOW) -> DataFrame:
    """(row, n_words, n_removed, kept_sha256, kept_text): row holds all columns of docs.

    Each word under a window of `window` words that begins anywhere else, too, goes; all
    windows are judged on the input. Null texts have no words; kept_text is then empty. A
    text with fewer words than the window stays whole. Rows repeated in full repeat each
    window. Rows that share an id, or have none, are judged each
    by its own text. An empty table gives no rows. Windows are compared by 64-bit hashes. A
    document of b bytes needs about 40 b of memory in its task.
    """
    spots = repeated_windows(docs, ws, window)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    met = _meet(rows, spots, "left").select("row", "text", F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    kind = met.schema["row"].dataType.simpleString()
    return met.mapInArrow(_kept(window), f"row {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
