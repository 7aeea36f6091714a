"""Entries that name several directives, and components that lack a make or model."""

from __future__ import annotations

import datetime

import pytest

from tarmac.plans import queries
from tarmac.plans.bindings import TABLES


def test_entries_with_several_numbers(spark):
    from tarmac.operators import fleet

    day = datetime.date(2020, 1, 1)
    bodies = {
        1: "Complied with AD 2011-10-09, AD 80-13-10 not complied with; C/W AD 2012-01-02R1 and 2013-03-04R2",
        2: "reviewed AD 2011-10-09; see 2014-05-06\nINSPECTED per AD 2015-07-08", 3: "no number", 4: None, 5: "inspect replaced modify comply Widget-9 pump",
    }
    entries = spark.createDataFrame([(1, i, 1, day, b, "verified", 1.0) for i, b in bodies.items()], "aircraft_id int, entry_id int, line_no int, entry_date date, body string, review_status string, quantity double")
    numbers = ["2011-10-09", "1980-13-10", "2012-01-02", "2013-03-04", "2014-05-06", "2015-07-08", "1999-01-01"]
    rows = [(k, n, "Widget-9 model" if k == 6 else "zz", ["Pump"] if k == 6 else None, None) for k, n in enumerate(numbers)]
    directives = spark.createDataFrame(rows, "directive_id int, ad_number string, title string, products array<string>, actions array<string>")
    pairs = spark.createDataFrame([(1, k) for k in range(7)] + [(2, 0)], "aircraft_id int, directive_id int")
    got = {(r["directive_id"], r["entry_id"]): (float(r["confidence"]), r["disposition"]) for r in fleet.candidate_evidence(entries, directives, pairs).collect()}
    # "complied" is an action word, worth 0.04. A chained number has the whole line as its context, which also says "not complied"; a short number is no bare one.
    want = {(0, 1): (0.86, "complied"), (0, 2): (0.45, "mentioned"), (1, 1): (0.49, "not_complied"), (2, 1): (0.86, "complied"), (3, 1): (0.49, "not_complied"), (4, 2): (0.45, None), (5, 2): (0.82, "inspected")}
    # Words alone: one of the product, four actions (0.16), one of the title.
    assert got == want | {(6, 5): (0.225, None)}


def test_references_of_lines(spark):
    from pyspark.sql import functions as F

    from tarmac.functions.maintenance import directive_references

    def references_of(t):
        return spark.createDataFrame([(t,)], "t string").select(directive_references(F.col("t")).alias("r")).first()["r"]

    said = lambda t: [(r["ad_number"], r["disposition"], r["method"], r["recurring"], r["due_text"]) for r in references_of(t)]
    assert said("C/W AD 2011-10-09R1 by inspection of hub, due each 100 hours") == [("2011-10-09", "complied", "inspection of hub", True, "due each 100 hours")]
    assert said("AD 76-07-12 n/a by serial number. Complied with AD 80-13-10") == [("1976-07-12", "not_applicable", "serial number", False, None), ("1980-13-10", "complied", None, False, None)]
    for text in ("AD 2011-10-09 not complied with", "AD 2011-10-09: cannot comply", "no compliance AD 2011-10-09", "never complied AD 2011-10-09", "AD 2011-10-09 compliance was not performed"):
        assert [x[1] for x in said(text)] == ["not_complied"], text
    for text in ("AD 2011-10-09 not inspected", "AD 2011-10-09 inspection not completed", "can't inspect AD 2011-10-09"):
        assert [x[1] for x in said(text)] == ["not_inspected"], text
    assert said("AD 2011-10-09, complied with oil change") == [("2011-10-09", "mentioned", None, False, None)]
    assert said("reviewed 2011-10-09") == [] and references_of(None) == []


def test_words_alone_meet_at_rare_words(spark):
    """The join on rare words finds what scoring every pair finds, with classes as with pairs."""
    import random

    from tarmac.operators import fleet
    from tarmac.operators.applicability import Applicability

    rng, day = random.Random(3), datetime.date(2020, 1, 1)
    words = ["brand", "wing", "spar", "pump", "seat", "rail", "valve", "hub", "inspect", "replace", "modify", "complied", "zeta", "eta9"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(rng.randint(1, 6), i, 1, day, pick(rng.randint(0, 9)), "verified", 1.0) for i in range(200)]
    entries = spark.createDataFrame(rows, "aircraft_id int, entry_id int, line_no int, entry_date date, body string, review_status string, quantity double")
    facts = [(k, f"20{k:02d}-01-01", pick(6), [pick(2)], [pick(2)] if k % 2 else None) for k in range(30)]
    directives = spark.createDataFrame(facts, "directive_id int, ad_number string, title string, products array<string>, actions array<string>")
    members = [(a, f"c{a % 3}") for a in range(1, 7)] + [(1, "c1")]
    of = [(k, f"t{k % 4}") for k in range(30)]
    links = [("c0", "t0"), ("c1", "t1"), ("c1", "t2"), ("c2", "t3"), ("c2", "t0")]
    pairs = {(a, d) for a, c in members for d, t in of if (c, t) in links}
    keys = lambda t: {w for w in (t or "").split() if len(w) > 2}
    want = {}
    for a, i, _, _, body, *_ in rows:
        for k, number, title, products, actions in facts:
            w = keys(body)
            points = min(160, 40 * len(w & keys(" ".join(products)))) + min(180, 40 * len(w & (keys(" ".join(actions or [])) | set(fleet.ACTION_WORDS)))) + min(100, 25 * len(w & keys(title)))
            if (a, k) in pairs and points >= 200:
                want[(a, k, i)] = min(950, points) / 1000
    classes = Applicability(spark.createDataFrame(links, "component_class string, target_class string"), spark.createDataFrame(members, "aircraft_id int, component_class string"), spark.createDataFrame(of, "directive_id int, target_class string"))
    for applicable in (classes, spark.createDataFrame(sorted(pairs), "aircraft_id int, directive_id int")):
        got = {(r["aircraft_id"], r["directive_id"], r["entry_id"]): float(r["confidence"]) for r in fleet.candidate_evidence(entries, directives, applicable, top=1000).collect()}
        assert got == want and len(want) > 50


def test_components_that_lack_a_make_or_model(spark):
    from tarmac.operators import fleet

    components = spark.createDataFrame(
        [(1, "propeller", "Hartzell", None), (2, "engine", None, "O-320"), (3, "airframe", "Cessna", "172N"), (4, "rotor_system", "Bell", None), (5, "engine", "Lycoming Inc", "O320A")],
        "aircraft_id int, role string, make string, model string",
    )
    targets = spark.createDataFrame(
        [(1, "Propeller", "hartzell", "HC-1", "current"), (2, "Propeller", "Other", "X", "current"), (3, "Engine", "Lycoming", "O-320", "active"), (4, "Propeller", None, "Y", "unknown"), (5, "Propeller", None, "Z", "rescinded"), (6, "Aircraft", "Cessna", "172", "current")],
        "directive_id int, product_type string, make string, model string, source_status string",
    )
    got = {tuple(r) for r in fleet.uncertain_components(components, targets).collect()}
    assert got == {(1, 1), (1, 2), (1, 4), (2, 3), (4, 1), (4, 2), (4, 4), (5, 3)}


@pytest.mark.parametrize("name, source", [("uncertain_components", "components"), ("uncertain_identity", queries._LONGER)])
def test_links_and_members_give_all_pairs(spark, name, source):
    """From the rows of the query every pair of an aircraft and a directive that its first SQL listed, and no other."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES[name](spark, sf).collect()
    aircraft, directives, links = {}, {}, set()
    for r in rows:
        if r["kind"] == "aircraft":
            aircraft.setdefault(r["component_class"], set()).add(r["aircraft_id"])
        elif r["kind"] == "directive":
            directives.setdefault(r["target_class"], set()).add(r["directive_id"])
        else:
            links.add((r["component_class"], r["target_class"], r["aircraft"], r["directives"]))
    assert all((len(aircraft[c]), len(directives[t])) == (a, d) for c, t, a, d in links)
    got = {(a, d) for c, t, *_ in links for a in aircraft[c] for d in directives[t]}
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    pairs = f"WITH {queries._MATCH}, {queries._CLASSES.format(source=source)} SELECT DISTINCT aircraft_id, directive_id FROM c JOIN n USING (role) WHERE {queries._CLOSE}"
    assert got == set(con.sql(queries.with_bindings(pairs)).fetchall()) and len(got) > len(rows)


def test_words_of_directives_are_not_broadcast(spark, tmp_path):
    """Their file is small, but the words that it is exploded to are not: the driver must not take them."""
    from pyspark.sql import functions as F

    from tarmac.operators import fleet

    words = F.array(F.lit("brand"), F.lit("wing"))
    spark.range(20).select(F.col("id").alias("directive_id"), words.alias("product_words"), words.alias("title_words"), words.alias("action_words")).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([("brand", 3), ("wing", 5)], "word string, entries bigint").write.parquet(f"{tmp_path}/seen")
    out = fleet._prefix_words(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/seen"))
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {(r["word"], r["potential"]) for r in out.collect()} == {("wing", 105), ("brand", 210)}


def test_references_with_some_fields(spark):
    from pyspark.sql import functions as F

    from tarmac.functions.maintenance import directive_references

    df = spark.createDataFrame([("C/W AD 2011-10-09R1 by inspection of hub, due each 100 hours\nsee AD 80-13-10",), (None,)], "t string")
    some, all_ = (df.select(directive_references(F.col("t"), *f).alias("r")).collect() for f in (("ad_number", "recurring"), ()))
    assert [[tuple(x) for x in r["r"]] for r in some] == [[(x["ad_number"], x["recurring"]) for x in r["r"]] for r in all_] == [[("2011-10-09", True), ("1980-13-10", False)], []]
