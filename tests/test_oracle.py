"""Each query of the reference's operators against its SQL in DuckDB, on the small tables."""

from __future__ import annotations

import os

import pytest

import tarmac.plans.detail_queries  # noqa: F401
import tarmac.plans.domain_queries  # noqa: F401
import tarmac.plans.match_queries  # noqa: F401
import tarmac.plans.page_queries  # noqa: F401
import tarmac.plans.review_queries  # noqa: F401
import tarmac.plans.work_queries  # noqa: F401
from tarmac.plans.bindings import TABLES
from tarmac.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got[1]
    if name not in ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    out = con.sql(ORACLE_SQL[name])
    want = rows(out.columns, out.fetchall())
    assert got == want


def test_directive_number(spark):
    from pyspark.sql import functions as F

    from tarmac.functions.text import directive_number

    rows = [("see AD 2011-10-09R1 now", "2011-10-09"), ("80-13-10", "1980-13-10"), ("ad 39-01-02", "2039-01-02"), ("none", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, w string").select(directive_number(F.col("t")).alias("g"), "w")
    assert all(r["g"] == r["w"] for r in df.collect())


def test_extract_with(spark):
    from tarmac.operators.review import extract_with

    todo, cache = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string"), spark.createDataFrame([(1, "A"), (9, "Z")], "id int, out string")
    out = extract_with(todo, cache, lambda b: b.assign(out=b["t"].str.upper() + "!")[["id", "out"]], "id int, out string", ["id"])
    assert sorted(map(tuple, out.collect())) == [(1, "A"), (2, "B!")]
