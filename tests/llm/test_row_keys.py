"""Rows that share an id or have none: substring dedup, one row of each group, and the stages after one another."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from tarmac.llm import jaccard_join, substring_dedup
from tarmac.llm.workspace import Workspace

rng = random.Random(8)
VOCAB = ["".join(rng.choice("abcdefghimnorstu") for _ in range(rng.randint(3, 8))) for _ in range(900)]


def say(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def brute(rows):
    words = [(i, (t or "").split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    out = []
    for i, w in words:
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        out.append((i, len(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_substring_rows_without_an_own_id(spark):
    p, q = say(40), say(50)
    rows = [(None, f"{say(200)} {p} {say(20)}"), (None, f"{say(60)} {p}"), (None, say(70)), (None, None), (1, f"{say(300)} {q}"), (1, f"{q} {say(30)}"), (1, say(45)), (2, say(90)), (3, say(20))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    out = substring_dedup.substring_dedup(docs, Workspace(spark, "t")).collect()
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["kept_text"]) for r in out), key=str) == brute(rows)


def test_repeated_rows_keep_one_through_the_stages(spark):
    twice, unnamed, near = say(120), say(110), say(130)
    rows = [(1, twice), (1, twice), (None, unnamed), (None, unnamed), (2, near), (None, near + " end"), (3, say(100)), (3, say(90)), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    want = sorted([rows[0], rows[2], rows[4], *rows[6:]], key=str)
    one = jaccard_join.keep_one(docs, Workspace(spark, "t"))
    assert sorted(map(tuple, one.collect()), key=str) == want
    # After the line stage, which removes the longer line of `near`, the same rows stay.
    ws = Workspace(spark, "t")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = ws.table(stage(spark, docs, ""), name)
    texts = Counter(t for _, t in map(tuple, docs.collect()))
    assert set(texts) >= {twice, unnamed} and texts[twice] == texts[unnamed] == 1 and sum(near in (t or "") for t in texts) == 1
