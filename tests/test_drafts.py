"""Whole drafts of small pages: columns side by side, stretches between anchors, the span behind each field."""

from __future__ import annotations

import datetime

from tarmac.operators import drafts

KIND = "page_id int, span_id string, span_type string, text string, left double, top double, width double, height double, reading_order int, confidence double, corrected boolean"


def page(spark, spans, page_id=1):
    rows = [(page_id, i, kind, text, left, top, 0.2, 0.02, n, conf, fixed) for n, (i, kind, text, left, top, conf, fixed) in enumerate(spans)]
    return spark.createDataFrame(rows, KIND)


def line(i, text, left, top, conf=90.0, fixed=False, kind="LINE"):
    return (i, kind, text, left, top, conf, fixed)


SIDES = [
    line("h", "Tach", 0.05, 0.01), line("a", "1/2/2003 Tach 100.5", 0.05, 0.1), line("b", "replaced oil filter", 0.05, 0.2, 70.0), line("c", "2/3/2004 annual inspection", 0.6, 0.1), line("d", "Total 55\nJane Doe A&P 7", 0.6, 0.3, None, True),
]


def test_side_by_side_columns(spark):
    table = line("t", "x", 0.1, 0.1, kind="CELL")
    got = {r["cluster"]: r for r in drafts.draft_entries(page(spark, [*SIDES, table])).collect()}
    left, right = got[0], got[1]
    assert (left["entry_date"], left["description"], left["tach_time"], left["confidence"], left["lines"]) == (datetime.date(2003, 1, 2), "replaced oil filter", 100.5, 70.0, ["1/2/2003 Tach 100.5", "replaced oil filter"])
    assert (right["entry_date"], right["description"], right["total_time"], tuple(right["performer"])) == (datetime.date(2004, 2, 3), "annual inspection\nJane Doe A&P 7", 55.0, ("Jane Doe", "A&P#7"))
    assert left["requires_review"] and right["requires_review"]
    assert [(e["field"], e["span_id"], e["evidence_type"]) for e in right["evidence"]] == [
        ("entry_date", "c", "ocr_span"), ("description", "c", "ocr_span"), ("performer_name", "d", "correction"), ("performer_credential", "d", "correction"), ("total_time", "d", "correction"),
    ]


def test_without_a_structure_anchors_decide(spark):
    # Both anchors stand at the same height: the first one's stretch ends above them, and the second one's begins there.
    got = {(r["cluster"], r["span_id"]) for r in drafts.span_clusters(page(spark, SIDES)).collect()}
    assert got == {(0, "a"), (1, "a"), (1, "b"), (1, "c"), (1, "d")}


def test_stretches(spark):
    spans = [
        line("a", "1/2/2003 oil changed", 0.05, 0.10), line("x", "by hand", 0.05, 0.20), line("n", "note", 0.5, 0.25), line("b", "2/3/2004 tach 5", 0.05, 0.50), line("y", "tire replaced", 0.05, 0.9),
        line("u", "above", 0.05, 0.40), line("v", "between", 0.05, 0.485), line("z", "entries must be endorsed here", 0.05, 0.52), line("w", "a word", 0.05, 0.6, kind="WORD"),
    ]
    got = {(r["cluster"], r["span_id"]) for r in drafts.span_clusters(page(spark, spans)).collect()}
    # The second stretch begins 0.14 above its anchor, the first ends 0.02 above it, so "above" falls in both.
    assert got == {(0, "a"), (0, "x"), (0, "n"), (0, "u"), (1, "u"), (1, "v"), (1, "b"), (1, "y")}
    d = {r["cluster"]: r for r in drafts.draft_entries(page(spark, spans)).collect()}
    assert d[1]["evidence"][0]["span_id"] == "b" and d[1]["evidence"][1]["span_id"] == "u" and d[1]["tach_time"] == 5.0


def test_page_without_date_or_signal(spark):
    got = drafts.draft_entries(page(spark, [line("a", "oil changed and filter replaced", 0.1, 0.1)])).collect()
    assert [(r["entry_date"], r["date_extracted"], r["requires_review"], r["evidence"][0]["evidence_type"]) for r in got] == [(None, False, False, "fallback")]
    assert drafts.draft_entries(page(spark, [line("a", "nice weather", 0.1, 0.1), line("b", None, 0.1, 0.2), line("c", "", None, None)])).count() == 0
    assert drafts.draft_entries(page(spark, [line("a", "3/4/1999 washed", 0.1, 0.1)])).count() == 1
    assert drafts.draft_entries(page(spark, SIDES).where("1 = 0")).count() == 0


def test_a_page_is_gathered_once(spark):
    """Spans move once and meet no other table, so that none of their rules is tried again for a join."""
    for make in (drafts.span_clusters, drafts.draft_entries):
        plan = make(page(spark, SIDES))._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "Window" not in plan and plan.count("Scan") == 1, plan


def test_what_spares_a_rule_changes_nothing(spark):
    from pyspark.sql import functions as F

    from tarmac.functions import entries as en

    texts = ["Tach", " total \n", "\n\n", "", None, "date 1/2/2003", "Date", "Entries must be endorsed\nfoo", "foo\nTotal", "YEAR: 1", "-", "--", "time in", "time into", "1/2/2003 see AD 80-13-10", "flown on 1/2/2003 ok", "a long way to go 1/2/2003", "Aircraft since 13/45/2003"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(drafts.ignorable(F.col("t")), en.is_anchor(F.col("t"))).collect()]
    blank = [True, True, True, True, True, False, True, False, False, True, True, False, True, False, False, False, False, False]
    begins = [i in (5, 15) for i in range(len(texts))]
    assert got == list(zip(blank, begins))
