"""Words of Arrow string batches as numpy arrays: spans, 64-bit hashes, and hashes of word windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are held as arrays at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = x.astype(_U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U))


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:
    have = known.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1024), base, dtype=_U)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if len(have) <= 1 << 22:
            known[base] = have
    return have[:n]


@dataclass
class Block:
    """Some documents: data bytes, their offsets, spans of words, offsets of words, word hashes."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    hashes: np.ndarray

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.words) - 1), np.diff(self.words))

    def left_in_doc(self) -> np.ndarray:
        """Words from each word to the end of its document."""
        return np.repeat(self.words[1:], np.diff(self.words)) - np.arange(len(self.hashes))


def block(texts: pa.Array, lower: bool = False, gap: np.ndarray = _SPACE) -> Block:
    """Words are the longest runs of bytes that are not in `gap`."""
    texts = texts.cast(pa.large_utf8()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    space = gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.concatenate([[0], np.cumsum(first)])[offsets].astype(np.int64) if n else np.zeros(len(offsets), np.int64)
    if len(starts):
        spans = np.diff(starts, append=n)
        at = np.arange(starts[0], n) - np.repeat(starts, spans)
        value = _BYTE[_LOWER[data[starts[0] :]] if lower else data[starts[0] :]] * _powers(_BASE, int(at.max()) + 1)[at]
        value[space[starts[0] :]] = 0
        hashes = mix(np.add.reduceat(value, starts - starts[0]) + (ends - starts).astype(_U))
    else:
        hashes = np.zeros(0, _U)
    return Block(data, offsets, starts, ends, words, hashes)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of `length` words; runs at the end of the array that are too short get none."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=total[1:])
    return mix((total[length:] - total[:n]) * _powers(_INVERSE, n) + _U(length))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over values[i : i + width] for each i that has them all."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text each."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
