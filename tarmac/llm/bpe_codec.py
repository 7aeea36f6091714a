"""BPE encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import functools
import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarmac.llm.chunk_cache import ChunkCache
from tarmac.llm.word_arrays import slices

#: Pre-tokens, and token pairs, that a worker remembers at most.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 250_000, 400_000
_END, _SUFFIX = "\n", "</w>"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it has a visible Latin-1 form, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in visible}
    for i, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + i)
    return [shown[b] for b in range(256)]


def _packed(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Backtracker:
    """Exact BPE of a tokenizer file with byte letters and word ends, without replaying merges per word.

    An Aho-Corasick automaton lists the tokens at each place of a word. The encoder takes
    the longest that fits the token before it, and steps back where none does. Two tokens
    fit when merging their symbols gives just these two; fits are kept in a table. A place
    that no token leads on from is never entered twice, so the time is linear.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        own = {t: (t[: -len(_SUFFIX)] + _END if t.endswith(_SUFFIX) and t != _SUFFIX else t) for t in vocab}
        self.tokens: dict[int, str] = {i: own[t] for t, i in vocab.items()}
        self.number = {s: i for i, s in self.tokens.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.automaton = ahocorasick.Automaton()
        for i, s in self.tokens.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.rules = Tokenizer.from_file(path)
        self.fits: dict[int, bool] = {}
        self.spines: dict[int, tuple | None] = {}
        self.prefixes: dict[int, tuple[int, int] | None] = {}
        self.words: dict[str, bytes] = {}
        self.letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = {t[0] for t in special}
        self.cache = ChunkCache(lambda chunks: list(map(self.chunk, chunks)), list(special))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretokens = regex.compile(pattern)
        # The offset table: all tokens' texts in one run of bytes, each with the blank that decoding puts between.
        texts = [t for t, _ in sorted((vocab | special).items(), key=lambda x: x[1])]
        parts = [(t + " ").encode() for t in texts]
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _symbols(self, token: int) -> list[int]:
        s = self.tokens[token]
        last = s[-2:] if s.endswith(_END) else s[-1:]
        return [self.number[c] for c in s[: len(s) - len(last)]] + [self.number[last]]

    def _spines(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """What a token's left and right edge are while its symbols are merged, each with the rank that ends it.

        None where merging its symbols gives something else, so that it never comes up.
        """
        if token not in self.spines:
            symbols = self._symbols(token)
            left, right = [], []
            while len(symbols) > 1:
                options = [(self.merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.merges]
                if not options:
                    break
                rank, i = min(options)
                if i == 0:
                    left.append((symbols[0], rank))
                if i == len(symbols) - 2:
                    right.append((symbols[-1], rank))
                symbols = symbols[:i] + [self.merges[symbols[i], symbols[i + 1]][1]] + symbols[i + 2 :]
            never = len(self.merges)
            ok = symbols == [token]
            self.spines[token] = (left + [(token, never)], right + [(token, never)]) if ok else None
        return self.spines[token]

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the symbols of both gives just these two: no merge joins a's right edge to b's left edge."""
        key = a << 32 | b
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits.clear()
            fit = self.fits[key] = self._apart(a, b)
        return fit

    def _apart(self, a: int, b: int) -> bool:
        one, two = self._spines(a), self._spines(b)
        if one is None or two is None:
            return False
        right, left, i, j = one[1], two[0], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            joined = self.merges.get((x, y))
            # Of equal ranks, the place further left goes first.
            if joined is not None and joined[0] < x_ends and joined[0] <= y_ends:
                return False
            if i == len(right) - 1 and j == len(left) - 1:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _shorter(self, token: int) -> tuple[int, int] | None:
        """The longest token that a token begins with, besides itself, as (length, token)."""
        if token not in self.prefixes:
            text = self.tokens[token]
            ends = (k for k in range(len(text) - 1, 0, -1) if text[:k] in self.number)
            k = next(ends, 0)
            self.prefixes[token] = (k, self.number[text[:k]]) if k else None
        return self.prefixes[token]

    def word(self, s: str) -> tuple[int, ...]:
        """Tokens of a word in byte letters, with its end mark.

        Matches come in order of their ends, so the last one of a place is its longest;
        the shorter ones are the tokens that it begins with.
        """
        whole = self.number.get(s)
        if whole is not None and self._spines(whole) is not None:
            return (whole,)
        n = len(s)
        longest: list[tuple[int, int] | None] = [None] * n
        for end, match in self.automaton.iter(s):
            longest[end + 1 - match[0]] = match
        dead = bytearray(n + 1)
        path: list[tuple[int, int]] = []
        place, match, fits = 0, longest[0], self.fits
        while True:
            while match is not None:
                length, token = match
                if not dead[place + length]:
                    if not path:
                        fit = self._spines(token) is not None
                    else:
                        before = path[-1][1]
                        fit = fits.get(before << 32 | token)
                        if fit is None:
                            fit = self._fit(before, token)
                    if fit:
                        break
                match = self._shorter(token)
            if match is None:
                dead[place] = 1
                length, token = path.pop()
                place -= length
                match = self._shorter(token)
            else:
                path.append(match)
                place += length
                if place == n:
                    return tuple(t for _, t in path)
                match = longest[place]

    def _plain(self, piece: str) -> bytes:
        out: list[bytes] = []
        for word in self._letters(piece):
            got = self.words.get(word)
            if got is None:
                if len(self.words) >= REMEMBERED_WORDS:
                    self.words.clear()
                got = self.words[word] = _packed(self.word(word + _END))
            out.append(got)
        return b"".join(out)

    def _letters(self, piece: str) -> list[str]:
        """Pre-tokens in byte letters. ASCII letters stand for themselves; other text goes through the library's own rules, whose Unicode version counts."""
        if piece.isascii():
            words = self.pretokens.findall(piece.lower())
            return words if piece.isprintable() else ["".join(map(self.letters.__getitem__, w.encode())) for w in words]
        return [w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(piece))]

    def chunk(self, text: str) -> bytes:
        """Ids, little-endian 32 bits each, of a chunk without blanks."""
        out = []
        for piece in self.special_split.split(text) if self.special_split and not self.marks.isdisjoint(text) else [text]:
            out.append(_packed((self.special[piece],)) if piece in self.special else self._plain(piece))
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts. No token crosses a blank, so chunks between blanks are independent."""
        return self.cache.encode_all(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with single blanks between, in UTF-8."""
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        place = np.cumsum(size) - size
        return self.text[np.repeat(start - place, size) + np.arange(int(size.sum()))].tobytes()[:-1]


@functools.lru_cache(2)
def backtracker(path: str) -> Backtracker:
    return Backtracker(path)


def encode_decode(docs: DataFrame, tokenizer: str, texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for each row of docs(doc_id, text).

    ids are those of the tokenizers library for the file at path `tokenizer`, without
    added special tokens; special strings inside a text become their tokens, as there.
    With texts=True the ids (array of int) and the decoded text come, too. Null is an
    empty text, which has no ids and decodes to an empty text. Rows are independent, also
    those that repeat; other columns are not read, and an empty table gives no rows. A text
    of b bytes needs about 30 b of memory in its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = backtracker(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = codec.encode_all(part.column("text").to_pylist())
                arrays = [np.frombuffer(i, "<u4").astype(np.int64) for i in ids]
                decoded = [codec.decode(a) for a in arrays]
                columns = [part.column("doc_id"), pa.array([len(a) for a in arrays], pa.int64())]
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in many], pa.utf8()) for many in (ids, decoded)]
                if texts:
                    columns += [pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.utf8())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)
