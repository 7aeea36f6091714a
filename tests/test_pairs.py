"""Pairs of aircraft and directives made from blocks of classes: each once, whatever the classes, and never shuffled."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import applicability, extraction, fleet, jobs, worklists
from tarmac.operators.applicability import Applicability


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(applicability, "AIRCRAFT_BLOCK", 5)
    monkeypatch.setattr(applicability, "DIRECTIVE_BLOCK", 3)


def tables(spark):
    """Ids that come twice with other makes, null ids, and directives whose targets are of several roles."""
    rng = random.Random(5)
    some = lambda *of: rng.choice(of)
    parts = [(some(*range(30), None), some("airframe", "engine", "propeller"), some("A", "B", None), some("x", "y", None), some("s", None)) for _ in range(150)]
    targets = [(some(*range(25), None), some("Aircraft", "Engine", "Propeller", "odd"), some("A", "B", "C", None), some("x", "y", None), some("current", "current", "closed")) for _ in range(120)]
    c = spark.createDataFrame(parts, "aircraft_id bigint, role string, make string, model string, serial string")
    return c, spark.createDataFrame(targets, "directive_id bigint, product_type string, make string, model string, source_status string")


def listed(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def brute(a):
    """Pairs with roles by plain joins and a distinct, as they were made before."""
    return a.links.join(a.of_aircraft, "component_class").join(a.of_directives.select("directive_id", "target_class"), "target_class").select("aircraft_id", "directive_id", "role").distinct()


@pytest.mark.parametrize("how", [applicability.class_links, applicability.close_class_links])
def test_pairs_come_once(spark, small_blocks, tmp_path, how):
    c, t = tables(spark)
    a = Applicability.of(c, t, how).written(f"{tmp_path}/classes")
    want = brute(a)
    assert want.count() > 100 or how is applicability.close_class_links
    assert listed(a.pairs()) == listed(want)
    first = want.groupBy("aircraft_id", "directive_id").agg(F.min("role").alias("role"))
    assert listed(a.pairs(first=True)) == listed(first)
    assert listed(a.first_roles(want.where("directive_id % 2 = 0"))) == listed(first.where("directive_id % 2 = 0"))
    out = first.where("aircraft_id % 3 = 0").select("aircraft_id", "directive_id")
    assert listed(a.pairs(first=True, without=out)) == listed(first.join(out, ["aircraft_id", "directive_id"], "left_anti"))


def test_consumers_give_the_same_from_classes_as_from_pairs(spark, small_blocks, tmp_path):
    c, t = tables(spark)
    a = Applicability.of(c, t).written(f"{tmp_path}/classes")
    hits = applicability.kept(brute(a), f"{tmp_path}/hits")
    one = hits.select("aircraft_id", "directive_id").distinct()
    assert listed(fleet.best_component(a, c)) == listed(fleet.best_component(hits, c))
    best = hits.groupBy("aircraft_id", "directive_id").agg(F.min("role").alias("role"))
    parts = c.select("aircraft_id", "role", F.col("make").alias("c_make"), F.col("model").alias("c_model"), "serial")
    of = t.select("directive_id", "product_type", F.col("make").alias("t_make"), F.col("model").alias("t_model"))
    assert listed(worklists.applicability_snapshot(a, parts, of)) == listed(worklists.applicability_snapshot(best, parts, of))
    subs = spark.createDataFrame([(i % 33, i % 27) for i in range(90)] + [(None, 3), (4, None), (None, None), (None, 3)], "aircraft_id bigint, directive_id bigint")
    wanted = spark.createDataFrame([(i,) for i in range(0, 30, 3)], "directive_id bigint")
    assert listed(jobs.affected_aircraft(a, subs, wanted)) == listed(jobs.affected_aircraft(hits, subs, wanted))
    shown = one.where("(aircraft_id + directive_id) % 4 = 0").unionByName(subs).distinct()
    shown = shown.withColumns({"place": F.lit(1), "entry_id": F.col("aircraft_id") + 100, "confidence": F.when(F.col("aircraft_id") % 2 == 0, 0.9).otherwise(0.5), "disposition": F.when(F.col("directive_id") % 3 > 0, "complied")})
    pubs = spark.createDataFrame([(i % 20, i, "drs" if i % 2 else "other") for i in range(40)], "directive_id bigint, publication_id bigint, source_system string")
    pick = lambda df: listed(df.select("aircraft_id", "directive_id", "publications", "entries"))
    assert pick(worklists.match_detail(a, pubs, shown)) == pick(worklists.match_detail(one, pubs, shown))
    none = F.array().cast("array<string>")
    facts = t.select("directive_id", F.col("make").alias("ad_number"), F.when(F.col("model") == "x", F.array("model")).otherwise(none).alias("products"), F.array(F.lit("do")).alias("actions"), F.when(F.col("make") == "A", F.array(F.lit("1"))).alias("intervals"), F.lit(True).alias("structured_intervals"))
    edges = spark.createDataFrame([("B",)], "supersedes string")
    assert listed(extraction.match_results(a, shown, facts, edges, c)) == listed(extraction.match_results(fleet.best_component(hits, c), shown, facts, edges))


def test_pairs_are_not_shuffled(spark):
    """300 aircraft and 300 directives of one class: what is shuffled are members, not their 90,000 pairs."""
    c = spark.range(300).select(F.col("id").alias("aircraft_id"), F.lit("airframe").alias("role"), F.lit("A").alias("make"), F.lit("x").alias("model"), F.lit(None).cast("string").alias("serial"))
    t = spark.range(300).select(F.col("id").alias("directive_id"), F.lit("Aircraft").alias("product_type"), F.lit("A").alias("make"), F.lit("x").alias("model"), F.lit("current").alias("source_status"))
    for df in (Applicability.of(c, t).pairs(), fleet.component_targets(c, t), fleet.best_component(Applicability.of(c, t), c)):
        assert df.count() == 90_000
        plan = df._jdf.queryExecution().executedPlan().toString()
        top = plan[: plan.index("SortMergeJoin")]
        assert "Exchange" not in top and "Aggregate" not in top


def test_maintenance_scope_is_not_shuffled_as_pairs(spark, small_blocks):
    rng = random.Random(7)
    some = lambda *of: rng.choice(of)
    rows = [(some(*range(40), None), some(*range(6), None), some("active", "active", "invited")) for _ in range(120)]
    served = [(some(*range(6), None), some(*range(50), None), some("active", "active", "ended")) for _ in range(120)]
    m, s = spark.createDataFrame(rows, "user_id bigint, organization_id int, status string"), spark.createDataFrame(served, "organization_id int, aircraft_id bigint, status string")
    o = spark.createDataFrame([(i, "maintenance" if i % 2 else "owner") for i in range(6)], "organization_id int, organization_type string")
    out = worklists.maintenance_scope(m, o, s)
    want = {(u, a) for u, i, x in rows for j, a, y in served if i is not None and i == j and i % 2 and x == y == "active"}
    assert len(want) > 100 and listed(out) == sorted(map(str, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("SortMergeJoin")]


def test_cost_detail_makes_a_shared_list_once(spark):
    from tarmac.operators import coverage

    sets = [(1, 7), (2, 7), (3, 8), (4, 7), (4, 8), (5, 9), (6, 7), (6, 7), (7, None), (None, 7)]
    of = {7: [("b", "2", 2, "active"), ("a", "9", 9, "active"), ("a", "1", 1, "ended")], 8: [("c", "3", 3, "active")], 9: [("d", "4", 4, "ended")]}
    kind = "bigint, organization_name string, number string, aircraft_id bigint, status string"
    ledger = spark.createDataFrame([(1, 2.5, 0.5), (1, 1.0, None), (None, 9.0, 9.0)], "coverage_id bigint, actual_cost double, allocated_cost double")
    groups = spark.createDataFrame(sets, "coverage_id bigint, group_id bigint")
    ids = groups.select("coverage_id")
    pairs = spark.createDataFrame([(c, *x) for c, g in sets for x in of.get(g, [])], f"coverage_id {kind}")
    grouped = spark.createDataFrame([(g, *x) for g in of for x in of[g]], f"group_id {kind}")
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["number"]))
    want = listed(coverage.cost_detail(ids, ledger, pairs))
    assert listed(coverage.cost_detail(ids, ledger, grouped, groups)) == want
    got = {r["coverage_id"]: (str(r["actual_cost"]), str(r["allocated_cost"]), r["clients"]) for r in coverage.cost_detail(ids, ledger, grouped, groups, said).collect()}
    assert got[1] == ("3.500000", "0.500000", "9,2") and got[4][2] == "9,2,3" and got[5][2] == "" and got[6][2] == "9,9,2,2" and got[7][2] == got[None][2] == ""
    # 200 coverages share 200 clients: no join makes their 40,000 pairs before the list.
    many = spark.range(200).select(F.col("id").alias("coverage_id"), F.lit(1).cast("bigint").alias("group_id"))
    subs = spark.range(200).select(F.lit(1).cast("bigint").alias("group_id"), F.lit("o").alias("organization_name"), F.col("id").cast("string").alias("number"), F.col("id").alias("aircraft_id"), F.lit("active").alias("status"))
    out = coverage.cost_detail(many.select("coverage_id"), ledger, subs, many, lambda c: F.size(c))
    assert {r["clients"] for r in out.collect()} == {200}
