"""Benchmark decontamination: a generalised suffix automaton of the items' words, and training text streamed through it."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.exact_dedup import LOWER, UPPER
from tarmac.llm.word_arrays import Block, block, slices, sliding, windows
from tarmac.llm.workspace import Workspace

#: Consecutive words of an item that may not occur in training text.
WINDOW = 10
#: What is no part of a word: ASCII other than digits and letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Bytes of item words in one automaton, the most that is broadcast at once; more items are streamed against in further passes.
SHARD_BYTES = 2 << 20
#: Words of an item that one piece begins; a piece also has the words that a window from its last one needs.
PIECE = 4096
_SPANS = "array<struct<start: int, stop: int>>"


@dataclass
class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty sequence."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: dict[tuple[int, int], int] = field(default_factory=dict)
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Items with the window that a state stands for.
    items: dict[int, set[str | None]] = field(default_factory=lambda: defaultdict(set))
    #: Whole items shorter than the window, by the state of their words: length and items.
    short: dict[int, dict[int, set[str | None]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(set)))

    def _extend(self, last: int, word: int, out: dict[int, dict[int, int]]) -> int:
        """The state of the sequence of `last` and one more word."""
        known = out[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is None:
            new = self._state(self.length[last] + 1)
            at = last
            while at >= 0 and word not in out[at]:
                out[at][word] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
                return new
            known = out[at][word]
            if self.length[known] == self.length[at] + 1:
                self.link[new] = known
                return new
        else:
            new, at = None, last
        twin = self._state(self.length[at] + 1)
        out[twin], self.link[twin] = dict(out[known]), self.link[known]
        while at >= 0 and out[at].get(word) == known:
            out[at][word] = twin
            at = self.link[at]
        self.link[known] = twin
        if new is None:
            return twin
        self.link[new] = twin
        return new

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def ancestor(self, state: int, length: int) -> int:
        """The state of the last `length` words of a state's longest sequence."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def follow(self, state: int, matched: int, word: int | None) -> tuple[int, int]:
        """After one more word: the state, and how many words up to here an item has in a row."""
        if word is None:
            return 0, 0
        while (found := self.step.get((state, word))) is None:
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
        return found, matched + 1

    @classmethod
    def build(cls, pieces: list[tuple[str | None, list[bytes], bool]], window: int) -> Automaton:
        """pieces: item, words, and whether they are a whole item that has fewer words than the window."""
        auto, out = cls(window), defaultdict(dict)
        for _, words, _ in pieces:
            last = 0
            for word in words:
                last = auto._extend(last, auto.vocabulary.setdefault(word, len(auto.vocabulary)), out)
        auto.step = {(state, word): to for state, steps in out.items() for word, to in steps.items()}
        for item, words, whole in pieces:
            state, matched = 0, 0
            for word in words:
                state, matched = auto.follow(state, matched, auto.vocabulary[word])
                if matched >= window:
                    auto.items[auto.ancestor(state, window)].add(item)
            if whole:
                auto.short[auto.ancestor(state, len(words))][len(words)].add(item)
        auto.items, auto.short = dict(auto.items), {k: dict(v) for k, v in auto.short.items()}
        return auto

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str | None]]]:
        """Begin and end of each occurrence of a window, with the items that have it."""
        state, matched, shortest = 0, 0, min((m for by in self.short.values() for m in by), default=self.window)
        for i, word in enumerate(words):
            state, matched = self.follow(state, matched, self.vocabulary.get(word))
            if matched >= self.window:
                yield i + 1 - self.window, i + 1, self.items[self.ancestor(state, self.window)]
            at = state
            while matched >= shortest and at:
                for m, items in self.short.get(at, {}).items():
                    if m <= matched:
                        yield i + 1 - m, i + 1, items
                at = self.link[at]


class _Filter:
    """Which words of a block may lie in an occurrence: those in long enough runs of word pairs that the automaton knows."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes], bool]], window: int):
        self.run = min((len(words) for _, words, whole in pieces if whole), default=window)
        self.size = min(self.run, 2)
        b = block(pa.array([b" ".join(words).decode("utf-8", "replace") for _, words, _ in pieces], pa.large_utf8()), gap=_GAP)
        known = self._grams(b)[0]
        self.bits = max(16, int(64 * len(known)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[known >> np.uint64(64 - self.bits)] = True

    def _grams(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        grams = windows(b.hashes, self.size)
        inside = b.left_in_doc()[: len(grams)] >= self.size
        return grams[inside], np.flatnonzero(inside)

    def runs(self, b: Block) -> list[tuple[int, int]]:
        grams, at = self._grams(b)
        known = np.zeros(len(b.hashes), bool)
        known[at] = self.table[grams >> np.uint64(64 - self.bits)]
        need = self.run - self.size + 1
        change = np.zeros(len(known) + 1, np.int64)
        if len(known) >= need:
            first = np.flatnonzero(sliding(known, need, np.minimum))
            np.add.at(change, first, 1)
            np.subtract.at(change, np.minimum(first + self.run, len(known)), 1)
        inside = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _search(shared):
    """Adds to each row's spans and items what the texts share with one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, candidates = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                b = block(part.column("text"), lower=True, gap=_GAP)
                spans = [[(s["start"], s["stop"]) for s in row] for row in part.column("spans").to_pylist()]
                items = [set(row) for row in part.column("items").to_pylist()]
                for first, end in candidates.runs(b):
                    # A run of candidates may pass from one document to the next.
                    doc = int(np.searchsorted(b.words, first, "right")) - 1
                    while first < end:
                        stop = min(end, int(b.words[doc + 1]))
                        words = [b.data[x:y].tobytes().lower() for x, y in zip(b.starts[first:stop], b.ends[first:stop])]
                        base = first - int(b.words[doc])
                        found = [(x + base, y + base, hit) for x, y, hit in auto.hits(words)]
                        if found:
                            spans[doc] = _merged([*spans[doc], *((x, y) for x, y, _ in found)])
                            items[doc].update(item for hit in {id(hit): hit for _, _, hit in found}.values() for item in hit if item is not None)
                        first, doc = stop, doc + 1
                new = {
                    "n_words": pa.array(np.diff(b.words)),
                    "spans": pa.array([[{"start": x, "stop": y} for x, y in row] for row in spans], part.schema.field("spans").type),
                    "items": pa.array([sorted(row) for row in items], part.schema.field("items").type),
                }
                yield pa.RecordBatch.from_arrays([new.get(f.name, part.column(i)) for i, f in enumerate(part.schema)], part.schema.names)

    return run


def item_pieces(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words, whole): the items' words in pieces that overlap so that each window lies in one."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    each = items.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE))
    cut = each.select("item", (F.size("w") < window).alias("whole"), F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, PIECE + window - 1))).alias("words"))
    return cut.select("item", "words", "whole").distinct()


def _shards(items: DataFrame, window: int, most: int, ws: Workspace) -> tuple[DataFrame, int]:
    """The pieces, dealt by a hash to shards none of which has more than `most` bytes, unless it is one piece."""
    sized = F.octet_length(F.concat_ws(" ", "words"))
    pieces = ws.table(item_pieces(items, window).withColumn("bytes", sized), "pieces")
    total, rows = pieces.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    shards = 1 + 2 * total // most if total > most else 1
    while True:
        dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)))
        over = dealt.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).where((F.col("b") > most) & (F.col("n") > 1))
        if shards == 1 and total <= most or shards >= rows * rows or not over.limit(1).count():
            return dealt, shards
        shards *= 2


def contamination(docs: DataFrame, items: DataFrame, ws: Workspace, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row, text, n_words, spans, items): row holds the columns of docs(text, ...) but its text.

    spans are the runs of words, numbered from 0, that lie in an occurrence of `window`
    consecutive words of an item(item_id, text), or of a whole item that has fewer words;
    items are the ids (as strings, ascending) of the items concerned. Words are runs of
    letters, digits and non-ASCII characters after lower-casing A-Z.

    The items' automaton goes to all tasks in shards of a bounded size, one after the
    other, each a pass over the documents whose rows are written between passes; up to
    shard_bytes of item words there is one pass, without a shuffle. Null and empty texts
    have no words and no spans; items without words match nothing. An item without an id
    marks words but is not listed. Repeated rows are rows of their own, repeated items one
    item. An empty table gives no rows, and no items give no spans. Clashing names do not
    matter: columns stay within row. A text of b bytes needs about 30 b of memory.
    """
    dealt, shards = _shards(items.select("item_id", "text"), window, shard_bytes, ws)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    out = docs.select(F.struct(*others).alias("row"), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    kind = T.StructType(out.schema.fields)
    for shard in range(shards):
        pieces = [(r["item"], [w.encode() for w in r["words"]], r["whole"]) for r in dealt.where(F.col("shard") == shard).collect()]
        if not pieces and shard:
            continue
        shared = docs.sparkSession.sparkContext.broadcast((Automaton.build(pieces, window), _Filter(pieces, window)))
        out = out.mapInArrow(_search(shared), kind)
        if shard + 1 < shards:
            out = ws.table(out, f"pass_{shard}")
            ws.drop(f"pass_{shard - 1}")
    return out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            if spans:
                data = text.encode()
                b = block(pa.array([text], pa.large_utf8()), gap=_GAP)
                at = [0, *(x for s in spans for x in (int(b.starts[s["start"]]), int(b.ends[s["stop"] - 1]))), len(data)]
                text = b"".join(data[x:y] for x, y in zip(at[::2], at[1::2])).decode("utf-8", "replace")
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, batch.schema.field("text").type)], ["row", "text"])


def remove_contaminated(docs: DataFrame, items: DataFrame, ws: Workspace, window: int = WINDOW, longest: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """docs without what they share with items, same columns.

    Spans of at least `longest` words are cut from the text; a document of which spans
    cover more than the share `coverage` goes. Other texts stay as they are, null ones too.
    """
    found = contamination(docs, items, ws, window)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    kept = found.where(covered <= coverage * F.col("n_words"))
    gone = F.filter("spans", lambda s: s["stop"] - s["start"] >= longest)
    cut = kept.select("row", "text", gone.alias("gone"))
    out = cut.mapInArrow(_without, T.StructType([cut.schema["row"], cut.schema["text"]]))
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
