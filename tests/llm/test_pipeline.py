"""Stages of the pipeline on a small table: columns, what stays, and what goes."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from tarmac.llm.workspace import Workspace

from .test_llm import ROWS


def test_stages(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, ws = spark.read.parquet(f"{path}/documents.parquet"), Workspace(spark, "t")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = ws.table(stage(spark, docs, path), name)
        assert docs.columns == columns
        left, before = docs.count(), left
        assert left <= before
        assert not docs.where("n_chars <> length(text)").count()
    text = " ".join(r["text"] for r in docs.collect())
    words = text.split()
    runs = [tuple(words[i : i + 35]) for i in range(len(words) - 34)]
    assert len(set(runs)) == len(runs)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert packed.groupBy("doc_id").count().count() == docs.count()


def _components(n, alike):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if alike(i, j) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return label


def _brute(docs):
    """Line dedup, one of each near-duplicate group, and repeated passages, on (id, text) with ids in order."""
    cut = lambda x: {x[i : i + 5] for i in range(max(len(x) - 4, 1))}
    lines = [(i, k, x.strip(" \t\x0b\x0c\r")) for i, t in docs for k, x in enumerate(t.split("\n"))]
    lines = [(i, k, cut(x)) for i, k, x in lines if x]
    label = _components(len(lines), lambda a, b: len(lines[a][2] & lines[b][2]) >= 0.8 * len(lines[a][2] | lines[b][2]))
    gone = {lines[n][:2] for n in range(len(lines)) if label[n] != n}
    docs = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t.split()]
    words = [t.lower().split() for _, t in docs]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in words]
    label = _components(len(docs), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    docs = [d for n, d in enumerate(docs) if label[n] == n]
    seen = Counter(tuple(w[k : k + 35]) for _, t in docs for w in [t.split()] for k in range(len(w) - 34))
    out = {}
    for i, t in docs:
        w = t.split()
        drop = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        if len(drop) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in drop) if drop else t
    return out


def test_stages_against_brute_force(spark):
    rng = random.Random(14)
    vocab = ["".join(rng.choice("abcdefghimnorstu") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage, line = say(120), say(45), say(14)
    rows = [(i, say(40) + "\n" + say(12)) for i in range(8)]
    rows += [(i, f"{say(30)}\n{line if i % 2 else line[:-1] + '#'}\n{say(20)}") for i in range(8, 12)]
    for i in range(12, 18):
        words = base.split()
        words[rng.randrange(120)] = rng.choice(vocab)
        rows.append((i, "\n".join(" ".join(words[k : k + 60]) + f" {say(20)}" for k in (0, 60))))
    rows += [(i, f"{say(25)} {passage} {say(60)}") for i in range(18, 22)] + [(22, base), (23, base + " end"), (24, passage)]
    docs, ws = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), Workspace(spark, "t")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = ws.table(stage(spark, docs, ""), name)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == _brute(rows)
