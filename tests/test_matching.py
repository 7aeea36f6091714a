"""Digests of inputs, states of matching, newest extractions, partitions, issues, product wording, and the recogniser plug-in."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tarmac.operators import applicability, jobs, matching, reconcile
from tarmac.operators.recognise import Recogniser, recognise

DAY = datetime.date(2020, 1, 1)


def inputs(spark, **change):
    rows = {
        "matches": [(1, 10, "c1", "t1"), (2, 10, None, None), (3, 11, None, None)], "aircraft": [(i, "Acme", "M", "S", None, None, None, None) for i in (1, 2, 3)],
        "components": [(1, "c1", "airframe", "x", "Acme", "M", "S", None), (1, "c2", "engine", "x", "Acme", "E", None, None), (2, "c3", "engine", "x", "Acme", "E", None, DAY)],
        "entries": [(1, i, DAY, f"did {i}", "raw", "verified") for i in range(6)] + [(1, 5, DAY, "did 5", "raw", "verified")], "extractions": [(10, "e", "h", '{"a": 1}')],
    } | change
    kinds = {
        "matches": "aircraft_id int, directive_id int, component_id string, target_id string", "aircraft": "aircraft_id int, make string, model string, serial string, engine_make string, engine_model string, propeller_make string, propeller_model string",
        "components": "aircraft_id int, component_id string, role string, type string, make string, model string, serial string, removed_at date", "entries": "aircraft_id int, entry_id int, entry_date date, description string, raw_text string, review_status string",
        "extractions": "directive_id int, extraction_id string, content_hash string, output string",
    }
    return rows, {(r["aircraft_id"], r["directive_id"]): r["input_hash"] for r in matching.input_hashes(*(spark.createDataFrame(rows[k], kinds[k]).repartition(3) for k in kinds)).collect()}


def test_input_hash_ignores_order_and_sees_every_field(spark):
    rows, base = inputs(spark)
    assert len(base) == 3 and len(set(base.values())) == 3
    assert inputs(spark, entries=rows["entries"][::-1], components=rows["components"][::-1])[1] == base
    assert inputs(spark, entries=rows["entries"][:-1])[1][1, 10] != base[1, 10], "a repeated entry counts"
    for table in ("aircraft", "components", "entries", "extractions"):
        for i, value in enumerate(rows[table][0]):
            if i == 0 or isinstance(value, datetime.date) and table == "components":
                continue
            other = value + datetime.timedelta(1) if isinstance(value, datetime.date) else DAY if table == "components" and i == 7 else 99 if isinstance(value, int) else "other"
            first = tuple(other if j == i else v for j, v in enumerate(rows[table][0]))
            assert inputs(spark, **{table: [first, *rows[table][1:]]})[1][1, 10] != base[1, 10], (table, i)
    # A removed component counts for nothing.
    assert inputs(spark, components=rows["components"][:-1])[1] == base


def test_matcher_states(spark):
    at = lambda k: datetime.datetime(2020, 1, k)
    matches = [(1, "us", "2", True), (2, "us", "1", True), (3, "us", "2", False), (4, "them", "2", True), (9, "us", "2", True), (9, "us", "1", False)]
    events = [(2, "other", at(9), 1, "us", "2"), (5, "completed", at(1), 2, "us", "2"), (6, "completed", at(1), 3, "us", "1"), (7, "completed", at(1), 4, "us", "2"), (7, "invalidated", at(2), 5, "us", "2"), (3, "completed", at(2), 6, "us", "2"), (9, "invalidated", at(3), 7, "us", "2")]
    got = matching.matcher_states(
        spark.createDataFrame([(i,) for i in range(1, 10)], "aircraft_id int"), spark.createDataFrame(matches, "aircraft_id int, algorithm_name string, algorithm_version string, is_current boolean"),
        spark.createDataFrame(events, "aircraft_id int, kind string, event_time timestamp, event_id int, algorithm_name string, algorithm_version string"), "us", "2",
    )
    assert {r["aircraft_id"]: r["status"] for r in got.collect()} == {1: "current", 2: "pending_recomputation", 3: "current", 4: "not_run", 5: "current", 6: "not_run", 7: "pending_recomputation", 8: "not_run", 9: "current"}


def test_newest_approved(spark):
    rows = [(1, "a", 5, "approved"), (1, "b", 5, "approved"), (1, "c", 9, "needs_review"), (2, "d", 1, "needs_review")]
    got = matching.newest_approved(spark.createDataFrame(rows, "directive_id int, extraction_id string, created_at int, status string")).collect()
    assert [r["extraction_id"] for r in got] == ["b"]


def test_partitions_are_disjoint_complete_and_sized(spark):
    pages = spark.createDataFrame([(d, p) for d, n in (("aircraft", 15), ("engine", 29), ("one", 1)) for p in range(n)] * 2, "document string, page int")
    shares = {"refine": 25, "ingest": 50, "hold": 25}
    out = matching.partitions(pages, shares, ["document", "page"], ["document"])
    again = matching.partitions(pages.orderBy(F.desc("page")).repartition(5), shares, ["document", "page"], ["document"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect())) and out.count() == 90
    sizes = {(r["document"], r["partition"]): r["n"] for r in out.distinct().groupBy("document", "partition").agg(F.count("*").alias("n")).collect()}
    assert [sizes["aircraft", p] for p in shares] == [4, 7, 4] and [sizes["engine", p] for p in shares] == [7, 15, 7] and sum(v for k, v in sizes.items() if k[0] == "one") == 1
    assert matching.partition_faults(out, pages, ["document", "page"]).count() == 0
    bad = out.where("page <> 3").union(spark.createDataFrame([("engine", 0, "x"), ("new", 0, "hold")], "document string, page int, `partition` string"))
    faults = {(r["document"], r["page"]): r["fault"] for r in matching.partition_faults(bad, pages, ["document", "page"]).collect()}
    assert faults == {("aircraft", 3): "missing", ("engine", 3): "missing", ("engine", 0): "twice", ("new", 0): "unknown"}
    with pytest.raises(ValueError):
        matching.partitions(pages, {"a": 50}, ["page"], ["document"])


def issues(spark, rows):
    kind = "issue_type string, directive_id long, publication_id long, target_id long, aircraft_id long, source_snapshot_id long, severity string, payload string"
    return spark.createDataFrame(rows, kind)


def test_issues_of_two_aircraft_are_two(spark):
    new = issues(spark, [("applicability_missing", 1, None, None, 7, None, "high", "{}"), ("applicability_missing", 1, None, None, 8, None, "high", "{}")])
    assert sorted((r["aircraft_id"], r["action"]) for r in jobs.issue_diff(new.where("1 = 0"), new).collect()) == [(7, "opened"), (8, "opened")]
    assert sorted((r["aircraft_id"], r["action"]) for r in jobs.issue_diff(new, new.where("aircraft_id = 8")).collect()) == [(7, "resolved"), (8, "unchanged")]


def test_a_changed_file_name_updates_the_issue(spark):
    """A failed snapshot and a bare directive give four issues; they stay, change with what they tell, and go once repaired."""
    snapshots = lambda status, name: spark.createDataFrame([(5, "drs", "bulk_rows", status, name, "hash", "p", "1")], "snapshot_id long, source_system string, source_type string, status string, filename string, content_hash string, parser_name string, parser_version string")
    d = spark.createDataFrame([(1, "1993-01-01", "current", "not_started", "not_started")], "directive_id long, ad_number string, status string, extraction_status string, review_status string")
    pub = "publication_id long, directive_id long, source_system string, source_type string, source_identifier string, status string, title string, metadata map<string,string>"
    ext, app = "directive_id long, status string", "directive_id long, publication_id long, target_id long, status string, basis string, product_type string, product_subtype string, make string, model string"
    none = lambda kind: spark.createDataFrame([], kind)
    edges = none("ad_number string, supersedes string")
    found = lambda status, name: reconcile.issue_specs(snapshots(status, name), d, none(pub), none(ext), none(app), edges)
    first = found("failed", "a.zip")
    assert {r["issue_type"] for r in first.collect()} == {"ad_extraction_missing", "applicability_missing", "drs_source_degraded", "missing_federal_register_match"}
    act = lambda old, new: sorted((r["issue_type"], r["action"]) for r in jobs.issue_diff(old, new).collect() if r["action"] != "unchanged")
    assert act(first, first) == [] and act(first, found("failed", "b.zip")) == [("drs_source_degraded", "updated")]
    repaired = reconcile.issue_specs(
        snapshots("complete", "a.zip"), d, spark.createDataFrame([(3, 1, "federal_register", "rule", "x", "current", "t", {"document_number": "Correction"})], pub), spark.createDataFrame([(1, "approved")], ext),
        spark.createDataFrame([(1, 3, 4, "current", "b", "Aircraft", None, "Cessna", "172R")], app), edges,
    )
    assert repaired.count() == 0 and [a for _, a in act(first, repaired)] == ["resolved"] * 4
    told = reconcile.issue_specs(snapshots("complete", "a"), d, spark.createDataFrame([(3, 1, "federal_register", "rule", "x", "current", "t", {"type": "Correction; withdrawn"})], pub), spark.createDataFrame([(1, "approved")], ext), spark.createDataFrame([(1, 3, 4, "stale", "b", "Aircraft", None, "", None)], app), edges)
    assert {r["issue_type"]: r["payload"] for r in told.collect()} == {
        "supersession_correction_conflict": '{"adNumber":"1993-01-01","sourceSystem":"federal_register","sourceType":"rule","sourceIdentifier":"x","signals":["correction","withdrawal"]}',
        "target_applicability_stale": '{"adNumber":"1993-01-01","applicabilityStatus":"stale","basis":"b"}', "applicability_target_incomplete": '{"adNumber":"1993-01-01","productType":"Aircraft","productSubtype":null,"missing":["make","model"]}',
    }


def test_products_by_wording(spark):
    aircraft = spark.createDataFrame([(1, "Cessna", "172N", "Lycoming", " "), (2, "Piper", None, None, None), (3, None, None, None, None)], "aircraft_id int, make string, model string, engine_make string, propeller_make string")
    directives = spark.createDataFrame([(1, ["CESSNA 172N airplanes"]), (2, ["lycoming pip"]), (3, ["172n cessna"]), (4, []), (5, None), (6, ["", None]), (7, ["Pip"]), (8, ["xyz", "72N"]), (9, ["172n cessna lyc"])], "directive_id int, products array<string>")
    pairs = aircraft.select("aircraft_id").crossJoin(directives.select("directive_id"))
    got = sorted(map(tuple, applicability.product_matches(pairs, aircraft, directives).collect()))
    want = []
    for a, facts in ((1, ["cessna", "172n", "lycoming"]), (2, ["piper"]), (3, [])):
        for d, products in ((1, ["cessna 172n airplanes"]), (2, ["lycoming pip"]), (3, ["172n cessna"]), (4, []), (5, []), (6, []), (7, ["pip"]), (8, ["xyz", "72n"]), (9, ["172n cessna lyc"])):
            if not products or any(p in " ".join(sorted(facts)) or any(t in p for t in facts) for p in products):
                want.append((a, d))
    assert got == sorted(want)


def _upper(page):
    if page["content"] == "bad":
        raise RuntimeError("no " + "x" * 900)
    return {"spans": "wrong"} if page["content"] == "shape" else {"width_px": 5, "spans": [{"text": page["content"].upper(), "confidence": 1.0}]}


def test_recogniser(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "shape"), (5, "b")], "page_id int, content string").repartition(2)
    out = recognise(pages, Recogniser(_upper, "p", "1"), ["page_id"])
    rows = {r["page_id"]: r for r in out.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {1: "recognised", 2: "failed", 3: "failed", 4: "failed", 5: "recognised"}
    assert rows[1]["spans"][0]["text"] == "A" and rows[1]["width_px"] == 5 and rows[1]["height_px"] is None and len(rows[2]["error"]) == 500
    cache = spark.createDataFrame(out.drop("cached").collect(), out.drop("cached").schema)
    more = pages.union(spark.createDataFrame([(6, "c")], "page_id int, content string")).withColumn("content", F.when(F.col("page_id") == 5, "changed").otherwise(F.col("content")))
    again = {r["page_id"]: (r["cached"], r["status"]) for r in recognise(more, Recogniser(_upper, "p", "1"), ["page_id"], cache).collect()}
    assert again == {1: (True, "recognised"), 2: (False, "failed"), 3: (False, "failed"), 4: (False, "failed"), 5: (False, "recognised"), 6: (False, "recognised")}
    assert not any(r["cached"] for r in recognise(pages, Recogniser(_upper, "p", "2"), ["page_id"], cache).collect())
