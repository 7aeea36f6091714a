"""Token counts under a piece BPE: many pre-tokens merged at once, each by its lowest-rank pair."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from tarmac.llm.word_arrays import slices

MARK = "▁"
LIMIT = 4096
#: Pre-tokens whose counts a worker remembers; further ones are counted anew in each batch.
REMEMBERED = 300_000
_NONE = np.iinfo(np.int32).max
_UNITS = re.compile(r" *[^ ]+| +")


class RankMerger:
    """Merge tables of a sentencepiece BPE model with byte fallback, as arrays.

    Symbols are the pieces and the characters in them. A pair's rank is the place of the
    merged piece's score; equal scores share a rank, and the pair further left goes first.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        score = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        symbols = sorted(set(score) | {c for p in score for c in p})
        number = {s: i for i, s in enumerate(symbols)}
        place = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        found = {}
        for piece, value in score.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    found[a << 20 | b] = place[value], number[piece]
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[k][0] for k in self.keys.tolist()] + [_NONE], np.int32)
        self.merged = np.array([found[k][1] for k in self.keys.tolist()] + [0], np.int32)
        #: Tokens that a symbol is in the end: itself, or its bytes where it isn't a piece.
        self.cost = np.array([1 if s in score else len(s.encode()) for s in symbols], np.int64)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s in symbols:
            if len(s) == 1:
                self.of_char[ord(s)] = number[s]
        inside = {p[i : i + 2] for p in score for i in range(len(p) - 1)}
        self.joined = np.array(sorted(ord(x[0]) << 21 | ord(x[1]) for x in inside), np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != key)] = -1
        return self.rank[at], self.merged[at]

    def count(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit; characters that no piece holds count their bytes."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), lengths)
        symbol = self.of_char[points]
        known = symbol >= 0
        extra = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        total = np.bincount(unit[~known], extra[~known], len(units)).astype(np.int64)
        # No merge crosses two characters that stand side by side in no piece: runs between such places are merged apart.
        side = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.joined, side), len(self.joined) - 1)
        cut = np.ones(len(points), bool)
        cut[1:] = (self.joined[at] != side) | (unit[1:] != unit[:-1]) | ~known[1:] | ~known[:-1]
        run = np.cumsum(cut)[known]
        symbol, unit = symbol[known], unit[known]
        symbol, unit = self._merge(symbol, run, unit)
        return total + np.bincount(unit, self.cost[symbol], len(units)).astype(np.int64)

    def _merge(self, symbol: np.ndarray, run: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged runs of symbols after all merges: each round, every run applies its lowest-rank pair."""
        done = []
        rank = np.full(len(symbol), _NONE, np.int32)
        merged = np.zeros(len(symbol), np.int32)
        if len(symbol) > 1:
            rank[:-1], merged[:-1] = self._pairs(symbol[:-1], symbol[1:])
            rank[:-1][run[1:] != run[:-1]] = _NONE
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            sizes = np.diff(first, append=len(run))
            lowest = np.minimum.reduceat(rank, first)
            alive = np.repeat(lowest < _NONE, sizes)
            if not alive.all():
                done.append((symbol[~alive], unit[~alive]))
                lowest, sizes = lowest[lowest < _NONE], sizes[lowest < _NONE]
                symbol, run, unit, rank, merged = (x[alive] for x in (symbol, run, unit, rank, merged))
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            hit = hit[np.concatenate([[True], run[hit[1:]] != run[hit[:-1]]])]
            symbol[hit] = merged[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, run, unit, rank, merged = (x[keep] for x in (symbol, run, unit, rank, merged))
            hit = hit - np.arange(len(hit))
            for at in (hit, hit[hit > 0] - 1):
                inside = at[at + 1 < len(run)]
                inside = inside[run[inside] == run[inside + 1]]
                rank[at] = _NONE
                rank[inside], merged[inside] = self._pairs(symbol[inside], symbol[inside + 1])
        return np.concatenate([np.zeros(0, np.int32), *(d[0] for d in done)]), np.concatenate([np.zeros(0, np.int64), *(d[1] for d in done)])


class Counter:
    """Counts of whole texts; pre-tokens are a run of blanks and what follows up to the next blank."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        split = []
        for text in texts:
            if text:
                text = text.replace(MARK, " ")
                split.append(text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [u[1:] for u in _UNITS.findall(" " + text)])
            else:
                split.append([])
        known = self.known
        new = list({u for units in split for u in units if u not in known})
        if len(known) + len(new) > REMEMBERED:
            self.known = known = {u: known[u] for units in split for u in units if u in known} if len(known) > REMEMBERED // 2 else known
        known.update(zip(new, self.merger.count([MARK + u.replace(" ", MARK) for u in new]).tolist()))
        return [sum(map(known.__getitem__, units)) for units in split]


@functools.lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text).

    Counts are those of the sentencepiece library for the model at path `model` (BPE with
    byte fallback, a blank put before, no other normalisation), without begin or end
    tokens. Null and empty texts have none. Other columns are not read; rows are
    independent, so repeated rows, null ids and empty tables need no care. A text of b
    bytes needs about 40 b of memory in its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
                tokens = pa.array(_counter(model).count(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), size, tokens, pa.compute.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
