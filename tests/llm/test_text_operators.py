"""Decontamination, spelling variants and collocations against brute force: odd rows, small limits, shards, ties, hot groups."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarmac.llm import collocations as C
from tarmac.llm import decontaminate as D
from tarmac.llm import spelling as S
from tarmac.llm.workspace import Workspace

from .test_llm import ROWS

lower = lambda t: (t or "").encode().lower().decode()


def table(spark, rows):
    """Rows with clashing names beside doc_id, text and lang."""
    kind = "doc_id bigint, text string, lang string, spans string, items int, word string, n bigint, `row` string, shard int, f int"
    return spark.createDataFrame([(i, t, lang, "s", 1, "w", 2, "r", 3, 4) for i, t, lang in rows], kind).repartition(3)


# Decontamination


def test_automaton_finds_what_brute_force_finds():
    rng = random.Random(1)
    for _ in range(200):
        letters, window = [b"a", b"b", b"c", b"d"][: rng.randint(2, 4)], rng.randint(2, 5)
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(1, 12))]) for i in range(rng.randint(1, 5))]
        auto = D.Automaton.build([(i, w, len(w) < window) for i, w in items], window)
        doc = [rng.choice([*letters, b"z"]) for _ in range(40)]
        found, named = set(), set()
        for start, stop, which in auto.hits(doc):
            found.update(range(start, stop))
            named |= which
        assert (found, named) == brute_hits(doc, items, window)


def brute_hits(doc, items, window):
    hit, named = set(), set()
    for item, words in items:
        m = min(window, len(words))
        for s in range(len(words) - m + 1 if m else 0):
            for p in range(len(doc) - m + 1):
                if doc[p : p + m] == words[s : s + m]:
                    hit.update(range(p, p + m))
                    named.add(item)
    return hit, named


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it sleeps until noon on a warm stone."), (2, "only four words here"), (3, None), (4, ""), (5, "... --- !!!"),
    (2, "only four words here"), (None, "an item that has no id but more than ten words in it all the same"), (7, "Öl und Äpfel 12"), (8, "x"), (9, "quick brown fox jumps over the lazy dog and then it runs"),
]


@pytest.mark.parametrize("shard_bytes", [D.SHARD_BYTES, 60])
def test_contamination(spark, shard_bytes, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 3)
    text = ITEMS[0][1]
    rows = [(i, t, "en") for i, t in ROWS]
    rows += [
        (500, text, None), (501, "pre " + text.upper().replace(" ", "\n\n") + " post", "en"), (502, text[:45], "en"), (503, "so only FOUR words-here x x", "en"), (504, "Öl und äpfel 12, öl und Äpfel 12", "de"),
        (505, "there is an item that has no id but more than ten words in it", "en"), (None, text, "en"), (500, text, None), (506, "over the lazy dog and then it " * 500, "en"),
    ]
    docs, items = table(spark, rows), spark.createDataFrame(ITEMS, "item_id int, text string")
    got = D.contamination(docs, items, Workspace(spark, "t"), shard_bytes=shard_bytes).select("row", "n_words", "spans", "items").collect()
    rx = re.compile(D.WORD)
    sets = [(str(i) if i is not None else None, rx.findall(lower(t))) for i, t in ITEMS]
    want = Counter()
    for i, t, lang in rows:
        words = rx.findall(lower(t))
        hit, named = brute_hits(words, sets, D.WINDOW)
        want[(i, lang, "w", len(words), tuple(sorted(hit)), tuple(sorted(x for x in named if x is not None)))] += 1
    have = Counter((r["row"]["doc_id"], r["row"]["lang"], r["row"]["word"], r["n_words"], tuple(p for s in r["spans"] for p in range(s["start"], s["stop"])), tuple(r["items"])) for r in got)
    assert have == want
    assert all(a["stop"] < b["start"] for r in got for a, b in zip(r["spans"], r["spans"][1:]))


def test_spans_go_and_covered_documents_too(spark):
    text = ITEMS[0][1]
    free = "words of its own which no item has at all, said at some length so that little is covered, " * 2
    docs = table(spark, [(1, free + text + " The end.", "en"), (2, text, "en"), (3, "clean  text\n stays", "en"), (4, None, "en"), (5, free + "x", "en")])
    out = {r["doc_id"]: r["text"] for r in D.remove_contaminated(docs, spark.createDataFrame(ITEMS, "item_id int, text string"), Workspace(spark, "t")).collect()}
    assert out == {1: free + ". The end.", 3: "clean  text\n stays", 4: None, 5: free + "x"}
    assert D.remove_contaminated(docs, spark.createDataFrame([], "item_id int, text string"), Workspace(spark, "t")).count() == 5


# Spelling


def test_pivots_are_disjoint_and_cheapest():
    rng = np.random.default_rng(0)
    places = np.array([np.sort(rng.choice(7, 3, replace=False)) for _ in range(500)])
    costs = rng.integers(0, 5, (500, 3))
    chosen = S.pivots(places, costs)
    for p, c, on in zip(places, costs, chosen):
        a, b = np.flatnonzero(on)
        assert p[b] - p[a] >= 2
        assert c[a] + c[b] == min(c[i] + c[j] for i, j in ((0, 1), (0, 2), (1, 2)) if p[j] - p[i] >= 2)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_spelling(rows, noise):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) if (vs := near[w]) and max(n[v] for v in vs) >= 2 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("noise", [97, 5])
def test_spelling_groups(spark, noise):
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcéÿ") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["banana", "ananas", "aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "a" * 3000, "a" * 3001]
    rows = [(i, t, "en") for i, t in ROWS]
    for i in range(300, 420):
        words = []
        for _ in range(120):
            w = stems[min(int(rng.expovariate(0.1)), len(stems) - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcéÿ") + w[at:], w[:at] + rng.choice("abcéÿ") + w[at + 1 :]])
            words.append(rng.choice([w, w.upper(), w + "1", "(" + w + ")"]))
        rows.append((None if i == 301 else i, rng.choice([" ", "-", "Ö"]).join(words), None))
    rows += [rows[-1], (9, "Straße STRASSE straße strasse straße strasse " * 3, "de")]
    got = S.spelling_groups(table(spark, rows), Workspace(spark, "t"), noise=noise).collect()
    want = brute_spelling(rows, noise)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(w[2] != (w[1] or w[0]) for w in want) and max(w[4] for w in want) > 5


def test_one_edit_neighbours_are_complete(spark):
    """Every word of five letters from a small alphabet: all edits, all ties of bigrams."""
    import itertools

    words = ["".join(w) for k in (5, 6) for w in itertools.product("abc" if k == 5 else "ab", repeat=k)]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    got = {(r["word"], r["near"]) for r in S.near_words(df, Workspace(spark, "t")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


# Collocations


def brute_collocations(rows, support, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, count in f.items():
        frequent = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        inner = defaultdict(int)
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(inner[p[i : i + m]], a)
        scored = []
        for p, a in frequent.items():
            if inner[p] < a:
                s, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return out


def phrases(seed=4, docs=200):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 3 else f"W{i}" for i in range(60)]
    rows = [(i, t, "en") for i, t in ROWS]
    for i in range(400, 400 + docs):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(["New York City", "new  york\tcity hall at night", "ab ab ab ab ab", words[min(int(rng.expovariate(0.15)), 59)]]))
            out.append(rng.choice([" ", " ", " ", ", ", ".", "\n", "\x0b", " \t "]))
        rows.append((rng.choice([i, 400, None]), "".join(out), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + rows[-3:]


@pytest.mark.parametrize(("support", "longest", "top", "shards", "bits"), [(100, 5, 2000, 20, 28), (7, 5, 2000, 3, 16), (20, 4, 9, 1, 28), (10, 2, 5, 31, 28)])
def test_collocations(spark, monkeypatch, support, longest, top, shards, bits):
    monkeypatch.setattr(C, "MOST_BITS", bits)
    monkeypatch.setattr(C, "HELD", 500)
    rows = phrases()
    # Several files, so that there are several shards.
    path = f"{Workspace(spark, 't').root}/docs"
    table(spark, rows).repartition(7).write.parquet(path)
    got = C.collocations(spark.read.parquet(path), Workspace(spark, "t"), support, longest, top, shards=shards).collect()
    want = brute_collocations(rows, support, longest, top)
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_scores_past_64_bits_are_exact(spark):
    big = 9_000_000_000_000_000
    phrases_of = spark.createDataFrame([("en", "a b", big - 1), ("en", "a b c", big - 2)], "lang string, phrase string, f bigint")
    words = spark.createDataFrame([("en", "a", big + 5), ("en", "b", big + 3), ("en", "c", big + 1)], "lang string, word string, f bigint")
    # The pair "b c" is a part of the frequent phrase.
    phrases_of = phrases_of.union(spark.createDataFrame([("en", "b c", big)], "lang string, phrase string, f bigint"))
    got = {r["phrase"]: r["score"] for r in C._least_cut(phrases_of, words, spark.createDataFrame([("en", 3 * big + 9)], "lang string, n bigint")).collect()}
    n = 3 * big + 9
    cut = lambda a, *sides: min(1000 * a * n // (x * y) for x, y in sides)
    assert got == {"a b": cut(big - 1, (big + 5, big + 3)), "b c": cut(big, (big + 3, big + 1)), "a b c": cut(big - 2, (big + 5, big), (big - 1, big + 1))}
