"""Domain tables made from the driver's tables by portable SQL projections.

The same text runs in Spark, over DataFrames, and as a CTE of an oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: One number for each key, up to 80 million keys: the year takes what the other parts leave.
NUMBER = (
    "(1941 + {k} % 85 + 85 * CAST(floor({k} / 850000) AS BIGINT)) || '-' || lpad(CAST(CAST(floor({k} / 85) AS BIGINT) % 100 AS STRING), 2, '0')"
    " || '-' || lpad(CAST(CAST(floor({k} / 8500) AS BIGINT) % 100 AS STRING), 2, '0')"
)

BINDINGS: dict[str, str] = {
    "aircraft": """
        SELECT c_custkey AS aircraft_id, ' n-' || c_custkey AS number_raw, c_nationkey AS owner_id,
               'Brand#' || (c_custkey % 25 + 1) AS make,
               CASE c_custkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'PROMO' WHEN 3 THEN 'SMALL' WHEN 4 THEN 'MEDIUM' ELSE 'LARGE' END AS model,
               'S' || c_custkey AS serial,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'Brand#' || (c_custkey % 11 + 1) END AS engine_make,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'STANDARD' END AS engine_model,
               CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'Brand#' || (c_custkey % 9 + 1) END AS propeller_make,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'inactive' ELSE 'active' END AS status
        FROM {customer}""",
    "directives": f"""
        SELECT p_partkey AS directive_id, {NUMBER.format(k='p_partkey')} AS ad_number, p_name AS title,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS make,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS model,
               CASE p_partkey % 3 WHEN 0 THEN 'Aircraft' WHEN 1 THEN 'Engine' ELSE 'Propeller' END AS product_type,
               CASE p_partkey % 10 WHEN 0 THEN 'Superseded' WHEN 1 THEN 'RESCINDED ' WHEN 2 THEN 'In Review' ELSE 'Current' END AS source_status,
               p_size AS size
        FROM {{part}}""",
    "entries": f"""
        SELECT l.l_orderkey AS entry_id, l.l_linenumber AS line_no, o.o_custkey AS aircraft_id, CAST(l.l_shipdate AS DATE) AS entry_date,
               CASE l.l_linenumber % 4 WHEN 0 THEN 'complied with AD ' WHEN 1 THEN 'inspected per AD ' WHEN 2 THEN 'reviewed ' ELSE 'not applicable AD ' END
                   || {NUMBER.format(k='l.l_partkey')} || ' ' || p.p_name || CASE WHEN l.l_linenumber % 3 = 0 THEN ' ' || p.p_type ELSE '' END AS body,
               CASE WHEN l.l_returnflag = 'R' THEN 'needs_review' ELSE 'verified' END AS review_status, l.l_partkey AS part_id, l.l_quantity AS quantity
        FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey JOIN {{part}} p ON p.p_partkey = l.l_partkey""",
    "ocr_runs": """
        SELECT l_orderkey AS upload_id, CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE 'acct-' || (o_custkey % 50) END AS account,
               'N' || (o_custkey % 100) AS aircraft, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'complete' END AS status,
               CASE l_returnflag WHEN 'A' THEN 'chargeable' WHEN 'N' THEN 'not_billable' ELSE 'credited' END AS billing_status,
               CAST(l_quantity AS INT) AS pages, CASE WHEN l_linestatus = 'O' THEN 'page' ELSE 'second' END AS unit,
               CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(0.004 AS DECIMAL(18,8)) END AS rate,
               CASE WHEN l_linenumber % 3 = 0 THEN CAST(0.015 AS DECIMAL(18,8)) ELSE NULL END AS estimate,
               'provider-' || (l_linenumber % 3) AS provider, 'v' || (l_linenumber % 2) AS version, CASE WHEN l_linenumber % 4 = 0 THEN 'aws' WHEN l_linenumber % 4 = 1 THEN ' ' END AS channel,
               CASE WHEN l_suppkey % 2 = 0 THEN 'sync' END AS mode, CAST(NULL AS STRING) AS routing,
               CASE l_suppkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '-2' WHEN 2 THEN 'many' END AS bypass, CASE WHEN l_suppkey % 7 = 0 THEN '4' END AS counted, CAST(l_shipdate AS DATE) AS created
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey""",
    "events_state": """
        SELECT event_id, user_id AS aircraft_id, ts AS event_time,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'invalidated' ELSE 'other' END AS kind
        FROM {events}""",
    "edges": f"""
        SELECT {NUMBER.format(k='p_partkey')} AS ad_number, {NUMBER.format(k='(p_partkey - 85)')} AS supersedes
        FROM {{part}} WHERE p_partkey >= 85 AND p_partkey % 85 < 10""",
}
TABLES = "region nation customer supplier part orders lineitem events documents conversations labels pages benchmark embeddings".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in BINDINGS[name]]
    return spark.sql(BINDINGS[name], **{t: table(spark, sf_dir, t) for t in used})


def with_bindings(sql: str) -> str:
    """sql with a CTE for each binding that it names."""
    names = [n for n in BINDINGS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({BINDINGS[n].format(**{t: t for t in TABLES})})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(ctes) + (", " if ctes else "") + body[len("WITH") :]
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
