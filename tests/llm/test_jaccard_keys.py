"""Texts a little below the similarity share most of their keys: each pair is met few times, and all links are found."""

from __future__ import annotations

import random

from tarmac.llm import jaccard_join
from tarmac.llm.workspace import Workspace


def joined_rows(spark):
    """Rows that each join has made since the session began, by execution and node."""
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    runs = store.executionsList()
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            for k in range(node.metrics().size() if "Join" in node.name() else 0):
                metric = node.metrics().apply(k)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    out[run, node.id()] = int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out


def components(texts):
    """By all pairs."""
    cut = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(cut[i] & cut[j])
            if 100 * both >= 75 * (len(cut[i]) + len(cut[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_pairs_of_a_band_of_near_copies_are_made_few_times(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))

    def changed(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = word()
        return out

    base = [word() for _ in range(400)]
    # Each pair of the thirty is at about 0.72; ten of them have near copies, five a copy.
    texts = [" ".join(changed(base, 7)) for _ in range(30)]
    texts += [" ".join(changed(t.split(), 3)) for t in texts[5:15]] + texts[20:25]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    before = joined_rows(spark)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, Workspace(spark, "t")).collect()}
    want = components(texts)
    assert [got[i] for i in range(len(texts))] == want and 5 < len(set(want)) < 40
    made = max(n for k, n in joined_rows(spark).items() if k not in before)
    assert made < 8000, made


def test_partners_without_a_place_meet_again(spark, monkeypatch):
    """With one place for met sets and no key that comes first, all links are found as well."""
    rng = random.Random(13)
    base = [f"{rng.getrandbits(40):x}" for _ in range(200)]
    texts = []
    for _ in range(16):
        words = list(base)
        for i in rng.sample(range(200), 4):
            words[i] = f"{rng.getrandbits(40):x}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    for places, sooner in ((1, 2), (1024, 1 << 40)):
        monkeypatch.setattr(jaccard_join, "PARTNERS", places)
        monkeypatch.setattr(jaccard_join, "SOONER", sooner)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, Workspace(spark, "t")).collect()}
        assert [got[i] for i in range(len(texts))] == components(texts)
