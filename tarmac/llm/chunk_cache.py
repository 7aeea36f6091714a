"""Ids of texts from ids of their chunks between blanks, remembered per worker."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Chunks, or pre-tokens besides those of one block, that a worker remembers at most.
REMEMBERED = 400_000


#: A longer text is encoded piece by piece, cut at blanks.
PIECE_CHARS = 1 << 22
_CHUNK, _BLANK = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]")
#: ASCII and accented Latin letters as one character each: their lower case is another one of them, and normal forms change nothing.
_PLAIN_CHARS = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x130), *range(0x131, 0x149), *range(0x14A, 0x17F))]
#: Those that are their own lower case.
_PLAIN = re.compile("[" + "".join(re.escape(c) for c in _PLAIN_CHARS if c == c.lower()) + "]*")
_PLAIN_LINES = re.compile(_PLAIN.pattern.replace("[", "[\\n", 1))
#: The letters among them, as part of a character class; the only other numbers are the digits.
_LETTERS = "".join(c for c in _PLAIN_CHARS if c == c.lower() and c.isalpha())
_PLAIN_TEXT = re.compile(r"[\x20-\x7e\x09-\x0d\xc0-\u012f\u0131-\u0148\u014a-\u017e]*")


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE_CHARS and (m := _BLANK.search(text, start + PIECE_CHARS)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:] if start else text


class ChunkCache:
    """For tokenizers whose tokens never cross blanks and that lower-case their input.

    encode_chunks(chunks) gives each chunk's ids as bytes. Texts with a special token's
    first characters keep their case, as special tokens are matched before lower-casing.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], special: list[str]):
        self.encode_chunks, self.special = encode_chunks, sorted({s[:2] for s in special})
        self.known: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        if _PLAIN_TEXT.fullmatch(text) and not any(s in text for s in self.special):
            return text.lower().split()
        return _CHUNK.findall(text)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; chunks that none had before are encoded together. Null texts have none."""
        if sum(map(len, filter(None, texts))) > 2 * PIECE_CHARS:
            return [b"".join(self._encode([self._chunks(p)])[0] for p in _pieces(t or "")) for t in texts]
        return self._encode([self._chunks(t) if t else [] for t in texts])

    def _encode(self, texts: list[list[str]]) -> list[bytes]:
        needed = set().union(*texts)
        new = list(needed.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(needed)
        self.known.update(zip(new, self.encode_chunks(new)))
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in texts]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text.decode()])[0]


class BlockEncoder:
    """Ids of texts a block at a time: Arrow finds the block's distinct chunks, encode_chunks gives the ids of each of them, joined by line feeds, and Arrow puts these in the chunks' places.

    Same tokenizers, and same rule for special tokens, as ChunkCache; nothing is kept between blocks.
    """

    def __init__(self, encode_chunks: Callable[[str], pa.LargeBinaryArray], special: list[str]):
        self.encode_chunks, self.special = encode_chunks, sorted({s[:2] for s in special})

    def _cased(self, text: str) -> str:
        return text.lower() if _PLAIN_TEXT.fullmatch(text) and not any(s in text for s in self.special) else text

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Null texts have none."""
        if sum(map(len, filter(None, texts))) > 2 * PIECE_CHARS:
            return [b"".join(self._block([p])[0] for p in _pieces(t or "")) for t in texts]
        return self._block(texts)

    def _block(self, texts: list[str | None]) -> list[bytes]:
        split = pa.compute.ascii_split_whitespace(pa.array([self._cased(t or "") for t in texts], pa.large_utf8()))
        chunks = split.values.dictionary_encode()
        if not len(chunks):
            return [b""] * len(texts)
        # No chunk has a line feed; a text that begins or ends with a blank has an empty one there.
        distinct = pa.compute.binary_join(pa.ListArray.from_arrays([0, len(chunks.dictionary)], chunks.dictionary), pa.scalar("\n", pa.large_utf8()))[0].as_py()
        ids = self.encode_chunks(distinct).take(chunks.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[np.asarray(split.offsets)].tolist()
        flat = ids.buffers()[2]
        return [flat[a:b].to_pybytes() if b > a else b"" for a, b in zip(at, at[1:])]


@functools.lru_cache(2)
def library_cache(path: str) -> BlockEncoder:
    """Ids by the tokenizers library for the file at path, little-endian 16 bits where all ids fit, else 32."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    split, kind = _of_split_text(path), id_type(path)
    width = np.dtype(kind).itemsize
    pattern, last = _split_pattern(path), _last_tokens(path, split)
    marked = _or_line_feed(pattern)
    #: Ids of pre-tokens: of those met lately, and of those met before these.
    recent: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def library(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in _whole(path).encode_batch_fast(texts, add_special_tokens=False)]

    def together(parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, from one text of them all where as many ids end a pre-token."""
        out: list[bytes] = []
        for i in range(0, len(parts), 20_000):
            part = parts[i : i + 20_000]
            ids = np.array(split.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, kind)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                flat, cuts = ids.tobytes(), [0, *(width * ends).tolist()]
                out += [flat[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += library(part)
        return out

    def parts_of(text: str) -> list[str]:
        """The pre-tokens of the chunks, a line feed behind those of each; one search for all, where the pattern leaves line feeds alone."""
        flat = marked.findall(text + "\n")
        return flat if flat.count("\n") == text.count("\n") + 1 else [x for t in text.split("\n") for x in (*pattern.findall(t), "\n")]

    def look_up(needed: list[str]) -> list[bytes]:
        """Ids of these pre-tokens, all different; those that have not been met for long are forgotten."""
        nonlocal recent, older
        new = [x for x in needed if x not in recent]
        if len(recent) + len(new) > REMEMBERED // 2:
            recent, older, new = {}, recent, needed
        unknown = [x for x in new if x not in older]
        recent.update((x, older[x]) for x in new if x in older)
        recent.update(zip(unknown, together(unknown)))
        return list(map(recent.__getitem__, needed))

    def by_parts(text: str) -> pa.LargeBinaryArray:
        """Ids of the chunks."""
        parts = pa.array(parts_of(text), pa.large_utf8()).dictionary_encode()
        needed = parts.dictionary.to_pylist()
        feed = needed.index("\n")
        found = look_up(needed[:feed] + needed[feed + 1 :])
        ids = pa.array([*found[:feed], b"", *found[feed:]], pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[1:][np.asarray(parts.indices) == feed]
        return pa.Array.from_buffers(ids.type, len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), ids.buffers()[2]])

    def encode(text: str) -> pa.LargeBinaryArray:
        # The pre-tokens of plain lower-case chunks are the pattern's matches, each encoded alone: words recur with other punctuation around.
        if pattern is not None and "<|" not in text and _PLAIN_LINES.fullmatch(text):
            return by_parts(text)
        chunks = text.split("\n")
        plain = [pattern is not None and _PLAIN.fullmatch(t) is not None and "<|" not in t for t in chunks]
        own = iter(by_parts("\n".join(compress(chunks, plain))).to_pylist() if any(plain) else [])
        rest = iter(library([t for t, p in zip(chunks, plain) if not p]))
        return pa.array([next(own if p else rest) for p in plain], pa.large_binary())

    return BlockEncoder(encode, [t.content for t in split.get_added_tokens_decoder().values()])


@functools.lru_cache(2)
def _whole(path: str):
    """The file's tokenizer with all its steps; loaded where a text needs them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _last_tokens(path: str, tokenizer) -> np.ndarray:
    """Which ids end a pre-token; none where the file marks no ends, so that nothing is encoded together."""
    import json

    with open(path, encoding="utf-8") as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix")
    out = np.zeros(tokenizer.get_vocab_size(), bool)
    if suffix:
        out[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    return out


def _split_pattern(path: str):
    """The pattern whose matches are the pre-tokens, where the file has such a step; the library then splits nothing further."""
    import json

    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    found = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and s.get("invert") and s["behavior"] == "Removed"]
    return regex.compile(found[0]) if len(found) == 1 else None


def _of_split_text(path: str):
    """The tokenizer for lower-case pre-tokens with blanks between them: without the steps that change and split texts, which would find nothing to do."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if any(s["type"] == "Split" for s in steps):
        spec |= {"normalizer": None, "truncation": None, "padding": None}
        spec["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"} if s["type"] == "Split" else s for s in steps]
    return Tokenizer.from_str(json.dumps(spec))


def _or_line_feed(pattern):
    """The pattern over plain lower-case text, matching a line feed where nothing else does; by the faster standard search where it names no other classes than letters and digits."""
    import regex

    if pattern is None:
        return None
    either = f"(?:{pattern.pattern})|\\n"
    standard = either.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", "0-9")
    return re.compile(standard) if r"\p" not in standard.lower() else regex.compile(either, pattern.flags)


@functools.lru_cache(8)
def id_type(path: str) -> str:
    """The smallest unsigned type that holds every id of the tokenizer file."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
