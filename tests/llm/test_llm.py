"""Operators against brute-force versions on a small table with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarmac.llm import bpe_codec, exact_dedup, jaccard_join, line_dedup, packing, quality_rules, rule_ensemble, substring_dedup, token_counts, token_files
from tarmac.llm.components import connected_components
from tarmac.llm.queries import PIECES, WORDS, vocabulary
from tarmac.llm.workspace import Workspace

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def make_rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghimnorstuäé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(300), say(60)
    rows = [(i, say(rng.randint(5, 200)) + "\n" + say(30)) for i in range(40)]
    for i in range(40, 60):  # near copies
        words = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(i, say(50) + "\n" + passage + "\n" + say(40)) for i in range(60, 75)]
    rows += [(75, None), (76, ""), (77, " \n\t "), (78, "A b C"), (79, "a B c"), (80, "one two three four"), (81, "x " * 3000), (82, "ÄÖ ä"), (83, "äö ä")]
    rows += [rows[3], (None, say(40)), (85, "### $$$ | " * 30), (86, say(100).upper()), (87, "tab\there  two\x1c spaces <|endoftext|> <s>"), (88, base), (89, base.upper())]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    # Clashing names must pass through or be left alone.
    rows = [(i, t, "en", "s", len(t or ""), "keep", 1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (6, 5)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    df = connected_components(spark.createDataFrame(links, "a bigint, b bigint"), Workspace(spark, "t"))
    want = {n: 1 for n in (1, 2, 3, 9)} | {5: 5, 6: 5} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 261)}
    assert {r["node"]: r["component"] for r in df.collect()} == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Workspace(spark, "t")).count() == 0


def quality_base(text):
    words = SPLIT.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(i, int(not (t or "").startswith("#"))) for i, t in ROWS if i is not None] + [(None, 1)], "doc_id bigint, quality int")
    out = quality_rules.judge(docs, [])
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got(out, *names) == sorted(((i, *quality_base(t)) for i, t in ROWS), key=str)
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.learn_rules(quality_rules.labelled_sample(none, labels), Workspace(spark, "t")) == []
    assert quality_rules.keep_good(docs, []).columns == docs.columns
    assert quality_rules.keep_good(docs, []).count() == out.where("kept").count()


def test_quality_rules_learn(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["###", "word", "some"]) if i % 4 == 0 else rng.choice(["word", "some", "texts"]) + str(rng.random())[2:6] for _ in range(80)), int(i % 4 != 0)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    rules = quality_rules.learn_rules(quality_rules.labelled_sample(table, table), Workspace(spark, "t"))
    kept = {r["doc_id"]: r["rule"] == 0 for r in quality_rules.judge(table, rules).collect()}
    assert rules and sum(kept[i] == bool(q) for i, _, q in rows) >= 198
    ensemble = rule_ensemble.learn(rule_ensemble.training_rows(table, table), Workspace(spark, "t"))
    out = rule_ensemble.classify(table, ensemble).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in out)


def test_rule_ensemble_edges(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    ensemble = rule_ensemble.learn(rule_ensemble.training_rows(docs, labels), Workspace(spark, "t"))
    assert all(r["score"] == 0.5 for r in rule_ensemble.classify(docs, ensemble).collect())
    assert rule_ensemble.classify(none, ensemble).count() == 0


def test_substring_dedup(spark, docs, none):
    seen = Counter(tuple(w[i : i + 35]) for _, t in ROWS for w in [SPLIT.findall(t or "")] for i in range(len(w) - 34))
    want = []
    for i, t in ROWS:
        w = SPLIT.findall(t or "")
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    out = substring_dedup.substring_dedup(docs, Workspace(spark, "t")).select("row.doc_id", "row.row", "n_words", "n_removed", "kept_sha256")
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    assert substring_dedup.levels(35) == [9, 18, 35]
    assert substring_dedup.substring_dedup(none, Workspace(spark, "t")).count() == 0


def test_jaccard_join(spark, docs, none):
    def shingles(t):
        w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in ROWS]
    label = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    out = jaccard_join.jaccard_components(docs, Workspace(spark, "t"))
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(((i, len(s), label[i]) for i, s in sets), key=str)
    assert jaccard_join.jaccard_components(none, Workspace(spark, "t")).count() == 0
    kept = jaccard_join.keep_one(docs, Workspace(spark, "t"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in label if label[i] == i}


def test_pigeonhole_keys():
    rng = np.random.default_rng(1)

    def first_keys(s, salt):
        out = set()
        for up in (0, 1):
            key, _, wanted, total = jaccard_join._keys(np.unique(s), np.array([0, len(s)]), up)
            assert total[0] >= wanted[0]
            out |= {(int(k)) for k in sorted(key.tolist(), key=lambda k: hash((salt, k)))[: wanted[0]]}
        return out

    for n in (1, 2, 3, 5, 7, 20, 47, 63, 64, 130, 700):
        for turn in range(30):
            a = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
            # The most of other elements, of one more set, or of fewer elements, that a link allows.
            most = jaccard_join.most_different(n, n) // 2
            others = [np.concatenate([a[most:], rng.integers(0, 2**63, most).astype(np.uint64)]), a[: -(-n * 75 // 100)]]
            for b in others:
                # Whatever the order of all keys is.
                assert first_keys(a, turn) & first_keys(b, turn)


def test_jaccard_rows_that_share_passages(spark):
    """Many texts are mostly one passage; some have a near copy. Against brute force, and no pair is made for the passage alone."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghimnorstu") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, rows = say(60), []
    for i in range(0, 500, 2):
        words = passage + say(rng.choice((15, 40, 120, 700)))
        near = list(words)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows += [(i, " ".join(words)), (i + 1, " ".join(near))]
    cut = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    sets = [cut(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), Workspace(spark, "t"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == {i: (len(sets[i]), label[i]) for i, _ in rows}


def test_keep_one_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "A b c", 4, 5, 6), (3, None, 7, 8, 9)], "doc_id bigint, text string, _gone int, node int, row int")
    assert sorted(tuple(r) for r in jaccard_join.keep_one(docs, Workspace(spark, "t")).collect()) == [(1, "a b c", 1, 2, 3), (3, None, 7, 8, 9)]


def test_token_counts(spark, docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    want = [(i, len((t or "").encode()), n, n > 4096) for i, t in ROWS for n in [len(model.encode(t or ""))]]
    assert got(token_counts.token_counts(docs, vocabulary(PIECES)), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts.token_counts(none, vocabulary(PIECES)).count() == 0
    odd = ["", " ", "▁▁a", "a" * 300, "\n\n", "日本 😀", " x  y "]
    assert token_counts.Counter(vocabulary(PIECES)).count(odd) == [len(model.encode(x)) for x in odd]


def library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(WORDS))
    return t, [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in ROWS]


def test_bpe_codec(spark, docs, none):
    t, ids = library_ids()
    want = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids]
    out = bpe_codec.encode_decode(docs, vocabulary(WORDS), texts=True)
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe_codec.encode_decode(none, vocabulary(WORDS)).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    _, ids = library_ids()
    ordered = sorted(((i, x + [1], t or "") for (i, x), (_, t) in zip(ids, ROWS)), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for i, x, _ in ordered:
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    ws = Workspace(spark, "t")
    manifest = token_files.write_token_files(docs, vocabulary(WORDS), str(tmp_path), ws, length=128)
    assert got(token_files.read_token_files(manifest, str(tmp_path)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    first = min(manifest.collect(), key=lambda r: r["part"])
    one, mask = token_files.sequence(first["path"], 1)
    flat = [v for _, x, _ in ordered for v in x]
    assert one.tolist() == flat[128:256] and mask.all()
    assert token_files.read_token_files(token_files.write_token_files(none, vocabulary(WORDS), str(tmp_path), Workspace(spark, "t")), str(tmp_path)).count() == 0


def test_packing(spark, docs, none):
    _, ids = library_ids()
    rows = packing.pack(docs, vocabulary(WORDS), Workspace(spark, "t")).collect()
    want = Counter((i, len(x) + 1, start) for i, x in ids for start in np.cumsum([0, *packing.piece_lengths(len(x) + 1)])[:-1].tolist())
    assert Counter((r["doc_id"], r["doc_tokens"], r["start"]) for r in rows) == want
    by_id = {i: x + [1] for i, x in ids}
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
        own = np.array(by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and np.frombuffer(r["ids"], "<u2").tolist() == own.tolist()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == sorted(r["length"] for r in rows)
    assert packing.pack(none, vocabulary(WORDS), Workspace(spark, "t")).count() == 0


def test_exact_dedup(spark, docs, none):
    norm = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in ROWS]
    size, keep = Counter(t for _, t in norm), {}
    for i, t in norm:
        keep[t] = max(keep.get(t, -1), -1 if i is None else i)
    want = [(i, None if keep[t] == -1 else keep[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]
    out = exact_dedup.exact_dedup(docs, Workspace(spark, "t"))
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=str)
    assert out.where("kept").count() == len(size)
    # A weak digest whose chunks differ gives way to the next one.
    same = spark.createDataFrame([(1, "plumless"), (2, "buckeroo"), (3, "PLUMLESS")], "doc_id bigint, text string")
    assert exact_dedup.same_digest_chunks(same, "crc32").count() == 1
    assert got(exact_dedup.exact_dedup(same, Workspace(spark, "t"), ("crc32", "sha256")), "doc_id", "keep_id") == [(1, 3), (2, 2), (3, 3)]
    assert exact_dedup.exact_dedup(none, Workspace(spark, "t")).count() == 0


def test_line_dedup(spark, docs, none):
    def sets(line):
        return {line[i : i + 5] for i in range(len(line) - 4)} if len(line) >= 5 else {line}

    lines = [(i, k, x.strip(" \t\n\x0b\x0c\r")) for i, t in ROWS for k, x in enumerate((t or "").split("\n"))]
    lines = sorted({x for x in lines if x[2]}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    label = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            x, y = sets(lines[a][2]), sets(lines[b][2])
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
    gone = {(i, k) for n, (i, k, _) in enumerate(lines) if label[n] != n}
    out = line_dedup.line_dedup(docs, Workspace(spark, "t"))
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"]
    want = sorted(((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if i is None or (i, k) not in gone)) for i, t in ROWS), key=str)
    assert got(out, "doc_id", "text") == want
    assert line_dedup.line_dedup(none, Workspace(spark, "t")).count() == 0
