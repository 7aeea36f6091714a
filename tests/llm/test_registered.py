"""Registered queries without SQL: their rows over a whole table against the tokenizers' own libraries, plain Python, and the labels."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tarmac.llm.queries import PIECES, QUERIES, WORDS, vocabulary

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(sf, name, *columns):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()


def by_doc(spark, name, sf=SMALL):
    rows = QUERIES[name](spark, sf).collect()
    found = {r["doc_id"]: r.asDict() for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def texts():
    return {d["doc_id"]: d["text"] or "" for d in table(SMALL, "documents", "doc_id", "text")}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(WORDS))
    library.no_truncation()
    library.no_padding()
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def packed(tokens):
    return np.asarray(tokens, dtype="<u4").tobytes()


def test_op1_base(spark, texts):
    found = by_doc(spark, "op1_quality_rules")
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(triples)
        covered = {k + j for k, t in enumerate(triples) if seen[t] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = {
            "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
        }
        assert {k: found[i][k] for k in want} == want
        assert not (found[i]["base_failed"] and found[i]["kept"])


def test_op1_labels(spark):
    found = by_doc(spark, "op1_quality_rules", LARGER)
    judged = defaultdict(list)
    for r in table(LARGER, "labels", "doc_id", "quality"):
        if r["doc_id"] in found and not found[r["doc_id"]]["base_failed"]:
            judged[r["quality"]].append(found[r["doc_id"]]["kept"])
    assert judged[0] and sum(judged[0]) <= 0.1 * len(judged[0])
    assert judged[1] and sum(judged[1]) >= 0.95 * len(judged[1])


def test_op3_held_out(spark):
    found = by_doc(spark, "op3_quality_classifier", LARGER)
    right = total = 0
    for r in table(LARGER, "labels", "doc_id", "quality"):
        out = found.get(r["doc_id"])
        assert out is None or out["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if out and out["held_out"] and r["quality"] is not None:
            right, total = right + (out["predicted"] == r["quality"]), total + 1
    assert total and right >= 0.9 * total
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())


def test_op4_counts(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    want = {i: (len(t.encode()), len(library.encode(t))) for i, t in texts.items()}
    found = by_doc(spark, "op4_token_counts")
    assert {i: (r["n_bytes"], r["n_tokens"]) for i, r in found.items()} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in found.values())


def test_op6_round_trip(spark, ids):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(WORDS))
    found = by_doc(spark, "op6_bpe_codec")
    assert found.keys() == ids.keys()
    for i, want in ids.items():
        decoded = library.decode(want, skip_special_tokens=False)
        assert found[i]["n_tokens"] == len(want)
        assert found[i]["ids_sha256"] == hashlib.sha256(packed(want)).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_op7_files(spark, ids):
    found, start = by_doc(spark, "op7_token_files"), 0
    assert found.keys() == ids.keys()
    for i in sorted(ids):
        want = [*ids[i], 1]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(want), zlib.crc32(packed(want)))
        start += len(want)


def test_op8_exact_lines(spark, texts):
    """Each line equal to an earlier one is among those removed, and no text loses more lines than it has."""
    found, seen = by_doc(spark, "op8_line_dedup"), set()
    for i in sorted(texts):
        lines = [x.strip(" \t\n\x0b\x0c\r") for x in texts[i].split("\n")]
        again = 0
        for line in filter(None, lines):
            again += line in seen
            seen.add(line)
        assert found[i]["n_lines"] == len(lines)
        assert again <= found[i]["n_removed"] <= sum(map(bool, lines))


def test_op9_pieces(spark, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op9_packing"](spark, SMALL).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, got in pieces.items():
        want, at = [*ids[i], 1], 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(packed(want[at : at + r["length"]]))
            at += r["length"]
        assert at == len(want)
    assert sorted(sequences) == list(range(min(sequences), min(sequences) + len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
