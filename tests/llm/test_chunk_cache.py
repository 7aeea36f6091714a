"""Chunks of words that recur with other punctuation: ids by the library, found with one search for all of them."""

from __future__ import annotations

import random

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from tarmac.llm import chunk_cache
from tarmac.llm.queries import WORDS, vocabulary


class Counted:
    def __init__(self, pattern):
        self.inner, self.pattern, self.flags, self.calls = pattern, pattern.pattern, pattern.flags, 0

    def findall(self, text):
        self.calls += 1
        return self.inner.findall(text)


def texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéßøœž") for _ in range(rng.randint(1, 9)))
    marks = ["", "", ".", ",", "!?", "'s", "'re", "%%%", "12", "²", "…", "漢字", "İ", "é", "🙂", "\u200b"]
    own = [" ".join(word() + rng.choice(marks) for _ in range(80)) for _ in range(60)]
    plain = [" ".join(word().title() + rng.choice(marks[:8]) for _ in range(80)) for _ in range(60)]
    return [*own, *plain, "", None, "\n", "a\nb \t c\x0b\x0cd", "<|endoftext|> Ab <|startoftext|>x", "<| ab", "''s 'S ''", "×÷ªº"]


def ids_of(cache, kind, given):
    return [np.frombuffer(x, kind).tolist() for x in cache.encode_all(given)]


@pytest.fixture
def library():
    t = Tokenizer.from_file(vocabulary(WORDS))
    t.no_truncation()
    t.no_padding()
    return lambda given: [t.encode(x or "", add_special_tokens=False).ids for x in given]


@pytest.fixture(autouse=True)
def fresh():
    chunk_cache.library_cache.cache_clear()
    yield
    chunk_cache.library_cache.cache_clear()


def test_one_search_for_all_chunks(monkeypatch, library):
    counted = Counted(chunk_cache._split_pattern(vocabulary(WORDS)))
    monkeypatch.setattr(chunk_cache, "_split_pattern", lambda path: counted)
    cache, kind = chunk_cache.library_cache(vocabulary(WORDS)), chunk_cache.id_type(vocabulary(WORDS))
    assert ids_of(cache, kind, texts()) == library(texts())
    assert counted.calls < 10, counted.calls


@pytest.mark.parametrize("remembered", [1, 50, 400_000])
def test_forgotten_words(monkeypatch, library, remembered):
    monkeypatch.setattr(chunk_cache, "REMEMBERED", remembered)
    cache, kind = chunk_cache.library_cache(vocabulary(WORDS)), chunk_cache.id_type(vocabulary(WORDS))
    for _ in range(2):
        assert [ids_of(cache, kind, [t])[0] for t in texts()] == library(texts())


def test_a_pattern_that_takes_line_feeds_along(monkeypatch, library):
    own = chunk_cache._split_pattern(vocabulary(WORDS))
    monkeypatch.setattr(chunk_cache, "_split_pattern", lambda path: regex.compile(own.pattern.replace(r"[^\s\p{L}\p{N}]+", r"[^\s\p{L}\p{N}]+[\n]*"), own.flags))
    cache, kind = chunk_cache.library_cache(vocabulary(WORDS)), chunk_cache.id_type(vocabulary(WORDS))
    assert ids_of(cache, kind, texts()) == library(texts())


def test_words_that_recur_are_encoded_once(monkeypatch, library):
    """Rare words push others of their kind out, not those that every text has."""
    import tokenizers

    asked = []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        from_file = classmethod(lambda cls, path: cls(Tokenizer.from_file(path)))
        from_str = classmethod(lambda cls, spec: cls(Tokenizer.from_str(spec)))

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, given, **options):
            asked.extend(w for t in given for w in t.split())
            return self.inner.encode_batch_fast(given, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", Watched)
    monkeypatch.setattr(chunk_cache, "REMEMBERED", 300)
    rng = random.Random(22)
    words = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(700)})[:650]
    given = [" ".join(words[:50] + words[a : a + 60]) + " " for a in range(50, 650, 60)]
    cache, kind = chunk_cache.library_cache(vocabulary(WORDS)), chunk_cache.id_type(vocabulary(WORDS))
    assert [ids_of(cache, kind, [t])[0] for t in given] == library(given)
    assert len(asked) == len(set(asked)) == 650
