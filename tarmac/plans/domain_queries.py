"""Registered queries of imports, reconciliation, coverage and recognised payloads, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import coverage, fleet, payloads, reconcile
from tarmac.plans.bindings import NUMBER, bind, table
from tarmac.plans.queries import _COMPONENTS, query
from tarmac.sources import directives as src
from tarmac.streaming.folders import shared_folder

_PART = NUMBER.format(k="p_partkey")


def _rows(spark, sf_dir):
    """Rows of a bulk file: headers in mixed case, some rows without a number or a target, dates in three forms, some numbers twice."""
    part = table(spark, sf_dir, "part")
    return spark.sql(
        f"""SELECT p_partkey AS row_no, CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE 'AD ' || {NUMBER.format(k="(p_partkey - p_partkey % 2)")} END AS `AD No.`, p_name AS Subject,
            CASE WHEN p_partkey % 5 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN p_brand || ' | Brand#99;' ELSE p_brand END AS MANUFACTURER, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'M1, M2' ELSE 'M3' END AS Models,
            CASE p_partkey % 4 WHEN 0 THEN 'Cancelled' WHEN 1 THEN ' FINAL' WHEN 2 THEN NULL ELSE 'In Review' END AS ADStatus,
            CASE p_partkey % 4 WHEN 0 THEN '2020-01-31' WHEN 1 THEN '01/31/2020' WHEN 2 THEN '2020/1/31' ELSE '31.1.2020' END AS PostedDate FROM {{part}}""",
        part=part,
    )


_BULK = f"""b AS (SELECT p_partkey AS k, {NUMBER.format(k="(p_partkey - p_partkey % 2)")} AS ad_number, p_name AS title, p_brand,
        CASE p_partkey % 4 WHEN 0 THEN 'rescinded' WHEN 1 THEN 'current' WHEN 2 THEN 'current' ELSE 'in_review' END AS status FROM part),
    g AS (SELECT * FROM b WHERE k % 9 <> 0)"""


@query(f"WITH {_BULK} SELECT CASE WHEN k % 2 = 0 THEN 'aircraft' ELSE 'engines' END AS source, k AS row_no, ad_number, title FROM g")
def directive_rows(spark, sf_dir):
    """Rows written as CSV files of two tables, and read back as text."""
    root, rows = shared_folder(spark, "bulk"), _rows(spark, sf_dir)
    for name, rest in (("aircraft", 0), ("engines", 1)):
        rows.where(f"row_no % 2 = {rest}").write.csv(f"{root}/{name}", header=True)
    got = src.read_directive_rows(spark, f"{root}/*")
    number = src.tx.directive_number(src.first_value(got, *src.ALIASES["number"]))
    return got.select("source", F.col("row_no").cast("long").alias("row_no"), number.alias("ad_number"), src.first_value(got, *src.ALIASES["title"]).alias("title"))


def _import(spark, sf_dir):
    return src.import_rows(_rows(spark, sf_dir), "hash", "row_no")


@query(f"WITH {_BULK} SELECT ad_number, arg_max(title, k) AS title, arg_max(status, k) AS status, 'hash' AS content_hash FROM g GROUP BY ad_number")
def bulk_directives(spark, sf_dir):
    return _import(spark, sf_dir)["directives"]


@query(f"""WITH {_BULK} SELECT ad_number, ad_number AS identifier, arg_max(title, k) AS title, arg_max(status, k) AS status, CASE WHEN max(k) % 4 < 3 THEN DATE '2020-01-31' END AS publication_date FROM g GROUP BY ad_number""")
def bulk_publications(spark, sf_dir):
    return _import(spark, sf_dir)["publications"]


@query(f"""WITH {_BULK}, t AS (SELECT k, ad_number, status, title, unnest(CASE WHEN k % 5 = 0 THEN [''] WHEN k % 3 = 0 THEN [lower(p_brand), 'brand#99'] ELSE [lower(p_brand)] END) AS make, m FROM (
        SELECT *, unnest(CASE WHEN k % 10 = 0 THEN [''] WHEN k % 4 = 0 THEN ['m1', 'm2'] ELSE ['m3'] END) AS m FROM g))
    SELECT ad_number, 'aircraft||' || make || '|' || m AS target_key, arg_max(status, k) AS status, arg_max(title, k) AS action, CAST(0.84 AS DECIMAL(4,2)) AS confidence FROM t WHERE make || m <> '' GROUP BY ALL""")
def bulk_applicability(spark, sf_dir):
    return _import(spark, sf_dir)["applicability"].select("ad_number", "target_key", "status", F.array_join("actions", ",").alias("action"), "confidence")


@query(f"""WITH {_BULK} SELECT k AS "row", NULL AS ad_number, 'drs_row_missing_ad_number' AS issue_type, 'high' AS severity FROM b WHERE k % 9 = 0
    UNION ALL SELECT k, ad_number, 'drs_row_missing_applicability', 'medium' FROM g WHERE k % 10 = 0""")
def bulk_issues(spark, sf_dir):
    return _import(spark, sf_dir)["issues"]


_DOCS = f"""SELECT p_partkey AS document_number, CASE WHEN p_partkey % 3 = 0 THEN 'About AD ' || {_PART} ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 1 THEN 'see ' || {_PART} || '.' END AS abstract,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE array(p_type, '', p_brand) END AS excerpts FROM {{part}}"""


def _register(spark, sf_dir):
    """Documents of the register, written as paged JSON of fifty each and read back."""
    root = shared_folder(spark, "register")
    docs = spark.sql(_DOCS, part=table(spark, sf_dir, "part")).withColumn("page", F.floor(F.col("document_number") / 50))
    pages = docs.groupBy("page").agg(F.collect_list(F.struct("document_number", "title", "abstract", "excerpts")).alias("results"), F.count("*").alias("count"))
    body = F.struct("count", F.when(F.col("page") % 2 == 0, F.concat(F.lit("next/"), "page")).alias("next_page_url"), "results")
    pages.select(F.to_json(body).alias("value")).write.text(root)
    return src.read_register_documents(spark, root, "document_number: bigint, title: string, abstract: string, excerpts: array<string>")


_DUCK_DOCS = f"""docs AS (SELECT p_partkey AS document_number, CASE WHEN p_partkey % 3 = 0 THEN 'About AD ' || {_PART} ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 1 THEN 'see ' || {_PART} || '.' END AS abstract,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type || chr(10) || p_brand END AS excerpts FROM part)"""


@query(f"WITH {_DUCK_DOCS} SELECT *, count(*) OVER (PARTITION BY document_number // 50) AS search_count, (document_number // 50) % 2 = 0 AS more FROM docs")
def register_documents(spark, sf_dir):
    return _register(spark, sf_dir).withColumn("excerpts", src.excerpts_text(F.col("excerpts")))


@query(f"""SELECT directive_id, ad_number, CASE WHEN directive_id % 3 < 2 THEN directive_id END AS document_number, CASE WHEN directive_id % 3 < 2 THEN 1 ELSE 0 END AS documents, FALSE AS duplicate,
    CASE WHEN directive_id % 3 = 2 THEN 'missing_federal_register_match' END AS issue, CASE WHEN directive_id % 3 = 2 THEN 'medium' END AS severity FROM directives WHERE directive_id % 8 <> 7
    UNION ALL SELECT directive_id, NULL, NULL, 0, FALSE, 'fr_match_missing_ad_number', 'high' FROM directives WHERE directive_id % 8 = 7""")
def register_match(spark, sf_dir):
    d = bind(spark, sf_dir, "directives").withColumn("ad_number", F.when(F.col("directive_id") % 8 != 7, F.col("ad_number")))
    return reconcile.register_match(d, _register(spark, sf_dir).withColumn("excerpts", src.excerpts_text(F.col("excerpts"))))


@query("""SELECT directive_id, concat_ws(',', CASE WHEN directive_id % 7 = 2 THEN 'ad_number_disagreement' END, CASE WHEN directive_id % 4 = 3 AND directive_id % 5 <> 0 THEN 'applicability_disagreement' END, CASE WHEN size < 10 THEN 'low_confidence' END,
        CASE WHEN directive_id % 4 = 3 THEN 'missing_affected_products' END, CASE WHEN directive_id % 6 = 0 THEN 'missing_compliance_actions' END, CASE WHEN directive_id % 11 = 0 THEN 'provider_uncertainty' END, CASE WHEN directive_id % 9 = 1 THEN 'supersession_disagreement' END) AS reasons FROM directives""")
def review_reasons(spark, sf_dir):
    d, k = bind(spark, sf_dir, "directives"), F.col("directive_id")
    none = F.array().cast("array<string>")
    one = lambda x: F.array(F.lit(x))
    model = d.select(
        k, F.when(k % 7 == 2, F.lit("x")).otherwise(F.concat(F.lit(" "), "ad_number")).alias("ad_number"), F.when(k % 4 != 3, F.array(F.lit("B  two"), F.lit("A one"))).alias("products"),
        F.when(k % 6 != 0, one("inspect")).alias("actions"), F.when(k % 9 != 1, F.array(F.lit("2"), F.lit("1"))).otherwise(one("1")).alias("supersedes"),
        F.when(k % 11 == 0, one("unsure")).otherwise(none).alias("uncertainty"), (F.col("size") / 100 + 0.7).cast("decimal(5,3)").alias("confidence"),
    )
    rules = d.select(k, "ad_number", F.when(k % 5 != 0, F.array(F.lit("a ONE"), F.lit("b two "))).alias("products"), F.array(F.lit("1"), F.lit("2")).alias("supersedes"))
    return reconcile.review_reasons(model, rules).select("directive_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT directive_id AS id, concat_ws(',', CASE WHEN directive_id % 3 = 0 THEN 'missing:title' END, CASE WHEN directive_id % 5 = 0 THEN 'no_product' END, CASE WHEN directive_id % 4 = 0 THEN 'not_a_list:complianceActions' END, CASE WHEN directive_id % 7 = 0 THEN 'not_an_object:sourceUrls' END) AS issues FROM directives""")
def missing_fields(spark, sf_dir):
    k = F.col("directive_id")
    when = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    text = F.concat(
        F.lit('{"adNumber":"x","effectiveDate":null,"publicationDate":null,"complianceIntervals":[],"supersedesAdNumbers":["1"]'), when(k % 3 == 0, "", ',"title":"t"'), when(k % 5 == 0, ',"affectedProducts":[" "]', ',"affectedProducts":["p",""]'),
        when(k % 4 == 0, ',"complianceActions":"none"', ',"complianceActions":[]'), when(k % 7 == 0, ',"sourceUrls":[]}', ',"sourceUrls":{"html":"u"}}'),
    )
    return reconcile.missing_fields(bind(spark, sf_dir, "directives").select(k.alias("id"), text.alias("output"))).select("id", F.array_join("issues", ",").alias("issues"))


def _issue_tables(spark, sf_dir):
    d, k, n = bind(spark, sf_dir, "directives"), F.col("directive_id"), F.col("s_suppkey")
    pick = lambda n, *of: F.get(F.array(*map(F.lit, of)), n.cast("int"))
    snapshots = table(spark, sf_dir, "supplier").select(
        n.alias("snapshot_id"), pick(n % 5, "complete", "partial", "failed", "stale", "unavailable").alias("status"), F.lit("drs").alias("source_system"), pick(n % 2, "bulk_zip", "bulk_csv").alias("source_type"),
        F.concat("s_name", F.lit(".zip")).alias("filename"), F.md5("s_name").alias("content_hash"), F.when(n % 3 != 0, "rows").alias("parser_name"), F.lit("2").alias("parser_version"),
    )
    publications = d.where(k % 6 != 0).select(
        k.alias("publication_id"), k, F.when(k % 2 == 0, "federal_register").otherwise("drs").alias("source_system"), F.when(k % 2 == 0, "rule").alias("source_type"), F.concat(F.lit("doc-"), k).alias("source_identifier"),
        F.when(k % 10 == 1, "Superseded").otherwise("current").alias("status"), "title", F.when(k % 9 == 0, F.create_map(pick(k % 4, "action", "correction", "document_type", "type"), F.lit("Correcting amendment"))).when(k % 9 == 1, F.create_map(F.lit("note"), F.lit("withdrawn"))).alias("metadata"),
    )
    extractions = d.where(k % 5 != 0).select(k, F.when(k % 5 == 1, "needs_review").otherwise("approved").alias("status"))
    applicability = d.where(k % 8 != 0).select(k, k.alias("publication_id"), (k + 1).alias("target_id"), F.when(k % 7 == 3, "stale").otherwise("current").alias("status"), F.lit("bulk").alias("basis"), "product_type", F.lit(None).cast("string").alias("product_subtype"), "make", "model")
    d = d.withColumns({"status": F.lower(F.trim("source_status")), "extraction_status": F.when(k % 5 == 0, "missing").otherwise("done"), "review_status": F.when(k % 3 == 0, "pending").otherwise("reviewed")})
    return snapshots, d, publications, extractions, applicability, bind(spark, sf_dir, "edges")


_NULLS = "CAST(NULL AS BIGINT)"


@query(f"""WITH d AS (SELECT *, directive_id AS k, lower(trim(source_status)) AS st, CASE WHEN directive_id % 3 = 0 THEN 'pending' ELSE 'reviewed' END AS rs, ad_number IN (SELECT ad_number FROM edges UNION ALL SELECT supersedes FROM edges) AS linked,
        [x FOR x IN [CASE WHEN directive_id % 9 = 0 THEN 'correction' END, CASE WHEN directive_id % 10 = 1 THEN 'supersession' END] IF x IS NOT NULL] AS signals,
        CASE WHEN directive_id % 6 = 0 THEN CAST([] AS VARCHAR[]) WHEN directive_id % 2 = 0 THEN ['federal_register'] ELSE ['drs'] END AS known, [x FOR x IN [CASE WHEN make IS NULL THEN 'make' END, CASE WHEN model IS NULL THEN 'model' END] IF x IS NOT NULL] AS missing FROM directives),
    s AS (SELECT *, ['complete', 'partial', 'failed', 'stale', 'unavailable'][1 + s_suppkey % 5] AS status FROM supplier),
    x AS (SELECT 'drs_source_degraded' AS issue_type, {_NULLS} AS directive_id, {_NULLS} AS publication_id, {_NULLS} AS target_id, s_suppkey AS source_snapshot_id, CASE WHEN status IN ('failed', 'unavailable') THEN 'high' ELSE 'medium' END AS severity,
            json_object('sourceSystem', 'drs', 'sourceType', CASE WHEN s_suppkey % 2 = 0 THEN 'bulk_zip' ELSE 'bulk_csv' END, 'status', status, 'filename', s_name || '.zip', 'contentHash', md5(s_name), 'parserName', CASE WHEN s_suppkey % 3 <> 0 THEN 'rows' END, 'parserVersion', '2') AS payload FROM s WHERE status <> 'complete'
        UNION ALL SELECT 'missing_federal_register_match', k, NULL, NULL, NULL, 'medium', json_object('adNumber', ad_number, 'directiveStatus', st, 'knownSourceSystems', known) FROM d WHERE NOT list_contains(known, 'federal_register')
        UNION ALL SELECT 'ad_extraction_missing', k, NULL, NULL, NULL, 'medium', json_object('adNumber', ad_number, 'extractionStatus', 'missing', 'reviewStatus', rs) FROM d WHERE k % 5 = 0
        UNION ALL SELECT 'ad_extraction_incomplete', k, NULL, NULL, NULL, 'medium', json_object('adNumber', ad_number, 'extractionStatuses', ['needs_review'], 'reviewStatus', rs) FROM d WHERE k % 5 = 1
        UNION ALL SELECT 'applicability_missing', k, NULL, NULL, NULL, 'high', json_object('adNumber', ad_number, 'sourceSystems', known) FROM d WHERE k % 8 = 0
        UNION ALL SELECT 'target_applicability_stale', k, k, k + 1, NULL, 'medium', json_object('adNumber', ad_number, 'applicabilityStatus', 'stale', 'basis', 'bulk') FROM d WHERE k % 8 <> 0 AND k % 7 = 3
        UNION ALL SELECT 'applicability_target_incomplete', k, k, k + 1, NULL, 'medium', json_object('adNumber', ad_number, 'productType', product_type, 'productSubtype', NULL, 'missing', missing) FROM d WHERE k % 8 <> 0 AND len(missing) > 0
        UNION ALL SELECT 'supersession_correction_conflict', k, k, NULL, NULL, 'low', json_object('adNumber', ad_number, 'sourceSystem', known[1], 'sourceType', CASE WHEN k % 2 = 0 THEN 'rule' END, 'sourceIdentifier', 'doc-' || k, 'signals', signals) FROM d WHERE k % 6 <> 0 AND len(signals) > 0 AND NOT (linked AND k % 10 = 1))
    SELECT issue_type, directive_id, publication_id, target_id, {_NULLS} AS aircraft_id, source_snapshot_id, severity, CAST(payload AS VARCHAR) AS payload FROM x""")
def issue_specs(spark, sf_dir):
    return reconcile.issue_specs(*_issue_tables(spark, sf_dir))


def _extracted(spark, sf_dir):
    d, k = bind(spark, sf_dir, "directives"), F.col("directive_id")
    e = d.select(k, k.alias("extraction_id"), F.when(k % 4 != 0, F.array(F.concat(F.lit("Acme "), F.col("size"), F.lit(" airplanes;")), F.lit("Turbo X 9 Engines"))).alias("products"), (F.col("size") / 50).alias("confidence"))
    old = d.select(k, F.lit("aircraft||old|").alias("target_key"), F.when(k % 3 == 0, "drs_bulk_row").otherwise("extraction").alias("basis"), F.lit("current").alias("status"), F.lit(0.6).cast("decimal(4,2)").alias("confidence"))
    return reconcile.applicability_from_extraction(e, old)


@query("""SELECT directive_id, 'aircraft||old|' AS target_key, CASE WHEN directive_id % 3 = 0 THEN 'drs_bulk_row' ELSE 'extraction' END AS basis, CASE WHEN directive_id % 3 <> 0 AND directive_id % 4 <> 0 THEN 'superseded' ELSE 'current' END AS status, CAST(0.6 AS DECIMAL(4,2)) AS confidence FROM directives
    UNION ALL SELECT directive_id, unnest(['aircraft||acme|' || size, 'engine||turbo|x 9']), 'extraction', 'current', CAST(least(greatest(CAST(size / 50 AS DECIMAL(4,2)), 0.55), 0.86) AS DECIMAL(4,2)) FROM directives WHERE directive_id % 4 <> 0""")
def extraction_applicability(spark, sf_dir):
    return _extracted(spark, sf_dir)[0]


@query("SELECT directive_id, directive_id AS extraction_id, 'missing_extracted_applicability' AS issue_type, 'medium' AS severity FROM directives WHERE directive_id % 4 = 0")
def extraction_issues(spark, sf_dir):
    return _extracted(spark, sf_dir)[1]


_TASKS = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' END"


@query(f"""SELECT o_orderkey AS match_id, CASE WHEN o_custkey % 3 = 0 THEN 'pending' WHEN o_custkey % 3 = 1 AND o_orderstatus = 'O' THEN 'not_required' ELSE {_TASKS} END AS status,
    CASE WHEN NOT (o_custkey % 3 = 0) OR o_orderstatus = 'O' THEN CASE WHEN o_orderstatus = 'F' THEN 'yes' END END AS decision FROM orders WHERE o_custkey % 3 = 0 OR o_orderstatus <> 'P'""")
def adjudication_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    results = o.where("o_custkey % 3 < 2").select(F.col("o_orderkey").alias("match_id"), F.when(F.col("o_custkey") % 3 == 0, "needs_adjudication").otherwise("candidate_satisfied").alias("status"))
    old = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("match_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"), F.when(F.col("o_orderstatus") == "F", "yes").alias("decision"))
    return reconcile.adjudication_tasks(results, old)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
    SELECT o_custkey AS directive_id, o_orderkey AS extraction_id, CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'needs_review' END AS extraction_status, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending' END AS review_status,
           o_orderstatus <> 'F' AND o_orderkey % 3 <> 0 AS new_review FROM r WHERE k = 1""")
def extraction_reviews(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("directive_id"), F.col("o_orderkey").alias("extraction_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("needs_review").alias("status"), F.col("o_orderdate").alias("created_at"))
    return reconcile.extraction_reviews(e, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("extraction_id")))


def _decided(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("match_id"), F.when(F.col("c_nationkey") % 4 == 0, "reviewed").otherwise("pending").alias("status"), (F.col("c_custkey") % 6 != 0).alias("is_current"))
    decisions = e.select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("match_id"), F.col("event_type").alias("decision"), (F.col("event_id") % 9).alias("reviewer"), F.col("ts").alias("decided_at"))
    return reconcile.apply_decisions(tasks, decisions, ("purchase", "signup"))


_DECIDED = """e AS (SELECT event_id, user_id, event_type, event_id % 9 AS reviewer, ts, c_custkey, c_nationkey, CASE WHEN event_type NOT IN ('purchase', 'signup') THEN 'unknown_decision' WHEN c_custkey IS NULL THEN 'unknown_match'
    WHEN c_custkey % 6 = 0 THEN 'stale_match' WHEN c_nationkey % 4 = 0 THEN 'not_pending' END AS reason FROM events LEFT JOIN customer ON c_custkey = user_id)"""


@query(f"""WITH {_DECIDED}, l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS d, arg_max(reviewer, (ts, event_id)) AS reviewer, max(ts) AS decided_at FROM e WHERE reason IS NULL GROUP BY user_id)
    SELECT c.c_custkey AS match_id, CASE WHEN d IS NOT NULL THEN 'adjudicated_' || d WHEN c.c_nationkey % 4 = 0 THEN 'reviewed' ELSE 'pending' END AS status, c.c_custkey % 6 <> 0 AS is_current, reviewer, decided_at FROM customer c LEFT JOIN l ON l.user_id = c.c_custkey""")
def decisions_applied(spark, sf_dir):
    return _decided(spark, sf_dir)[0]


@query(f"WITH {_DECIDED} SELECT event_id AS decision_id, user_id AS match_id, reason FROM e WHERE reason IS NOT NULL")
def decisions_refused(spark, sf_dir):
    return _decided(spark, sf_dir)[1]


@query("""WITH a AS (SELECT o_custkey AS aircraft_id, o_orderkey AS directive_id, o_orderstatus AS input_hash FROM orders),
    n AS (SELECT aircraft_id, directive_id, 'F' AS input_hash FROM a WHERE aircraft_id % 3 = 0), r AS (SELECT * FROM a UNION SELECT * FROM n)
    SELECT aircraft_id, directive_id, input_hash, CASE WHEN n.input_hash IS NOT NULL THEN 2 ELSE 1 END AS run, CASE WHEN aircraft_id % 3 = 0 THEN n.input_hash IS NOT NULL ELSE directive_id % 2 = 0 END AS is_current FROM r LEFT JOIN n USING (aircraft_id, directive_id, input_hash)""")
def current_matches(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("aircraft_id"), F.col("o_orderkey").alias("directive_id"), F.col("o_orderstatus").alias("input_hash"), F.lit(1).alias("run"), (F.col("o_orderkey") % 2 == 0).alias("is_current"))
    new = a.where("aircraft_id % 3 = 0").select("aircraft_id", "directive_id", F.lit("F").alias("input_hash"), F.lit(2).alias("run"))
    return reconcile.current_matches(a, new, ["aircraft_id", "directive_id", "input_hash"])


def _snapshots(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("snapshot_id"), F.concat(F.lit("source-"), F.col("s_nationkey") % 5).alias("source_system"), F.get(F.array(*map(F.lit, ("partial", "complete", "failed"))), (k % 3).cast("int")).alias("status"),
        F.expr("timestamp '2024-01-20 00:00:00' - make_interval(0, 0, 0, cast(s_suppkey % 20 as int))").alias("captured_at"), F.lit(1).alias("created_at"), F.concat(F.lit("h"), k).alias("content_hash"), (k * 10).alias("storage_bytes"),
    )


_SNAPSHOTS = """snapshots AS (SELECT s_suppkey AS snapshot_id, 'source-' || (s_nationkey % 5) AS source_system, ['partial', 'complete', 'failed'][1 + s_suppkey % 3] AS status, TIMESTAMP '2024-01-20' - to_days(CAST(s_suppkey % 20 AS INT)) AS captured_at,
        'h' || s_suppkey AS content_hash, s_suppkey * 10 AS storage_bytes FROM supplier),
    usable AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY source_system ORDER BY CASE WHEN status = 'complete' THEN 0 ELSE 1 END, captured_at DESC, snapshot_id DESC) AS place FROM snapshots WHERE status <> 'failed') WHERE place = 1)"""


@query(f"WITH {_SNAPSHOTS} SELECT source_system, snapshot_id, status, content_hash FROM usable")
def usable_snapshot(spark, sf_dir):
    return coverage.usable_snapshot(_snapshots(spark, sf_dir)).select("source_system", "snapshot_id", "status", "content_hash")


def _owned(spark, sf_dir):
    a = bind(spark, sf_dir, "aircraft")
    return fleet.components_long(a).join(a.select("aircraft_id", F.col("owner_id").alias("organization_id")), "aircraft_id")


def _links(spark, sf_dir):
    c = _owned(spark, sf_dir)
    key = coverage.target_key(coverage.product_type(F.col("role")), F.lit(None).cast("string"), F.col("make"), F.col("model"))
    known = c.where("role = 'airframe' and aircraft_id % 4 = 0").select(key.alias("target_key")).distinct()
    subs = c.where("role = 'airframe' and aircraft_id % 4 = 0").select(key.alias("target_key"), "aircraft_id", "organization_id", F.lit("active").alias("status"), F.lit(False).alias("triggered_creation"))
    gone = c.where("role = 'airframe' and aircraft_id % 5 = 0").select(F.lit("aircraft||gone|").alias("target_key"), "aircraft_id", "organization_id", F.when(F.col("aircraft_id") % 2 == 0, "active").otherwise("inactive_identity_changed").alias("status"), F.lit(True).alias("triggered_creation"))
    return coverage.link_coverage(c, known, subs.unionByName(gone))


_LINKS = f"""{_COMPONENTS}, w AS (SELECT DISTINCT CASE role WHEN 'airframe' THEN 'aircraft' ELSE role END || '||' || coalesce(lower(components.make), '') || '|' || coalesce(lower(components.model), '') AS target_key, aircraft_id, owner_id AS organization_id, role FROM components JOIN aircraft USING (aircraft_id)),
    known AS (SELECT DISTINCT target_key FROM w WHERE role = 'airframe' AND aircraft_id % 4 = 0),
    needed AS (SELECT w.target_key, k.target_key IS NULL AS created, CASE WHEN k.target_key IS NULL THEN min(aircraft_id) END AS triggered_by FROM w LEFT JOIN known k ON k.target_key = w.target_key GROUP BY w.target_key, k.target_key),
    subscriptions AS (SELECT target_key, aircraft_id, organization_id, 'active' AS status, coalesce(NOT (role = 'airframe' AND aircraft_id % 4 = 0) AND created AND triggered_by = aircraft_id, FALSE) AS triggered_creation,
            CASE WHEN role = 'airframe' AND aircraft_id % 4 = 0 THEN 'reused' ELSE 'created' END AS change FROM w JOIN needed USING (target_key)
        UNION ALL SELECT 'aircraft||gone|', aircraft_id, owner_id, 'inactive_identity_changed', TRUE, CASE WHEN aircraft_id % 2 = 0 THEN 'deactivated' ELSE 'kept' END FROM aircraft WHERE aircraft_id % 5 = 0)"""


@query(f"WITH {_LINKS} SELECT * FROM needed")
def coverage_needed(spark, sf_dir):
    return _links(spark, sf_dir)[0]


@query(f"WITH {_LINKS} SELECT * FROM subscriptions")
def coverage_links(spark, sf_dir):
    return _links(spark, sf_dir)[1]


def _state(spark, sf_dir):
    sets = _links(spark, sf_dir)[0].select("target_key", F.concat(F.lit("source-"), F.length("target_key") % 6).alias("source_system"))
    d, k = bind(spark, sf_dir, "directives"), F.col("directive_id")
    kind = F.when(F.col("product_type") == "Aircraft", "Aircraft").otherwise(F.col("product_type"))
    a = d.select(coverage.target_key(kind, F.lit(None).cast("string"), F.when(k % 2 == 0, F.col("make")), F.when(k % 2 == 0, F.regexp_extract("model", "^[A-Z]+", 0))).alias("target_key"), k, F.when(k % 4 == 2, "stale").otherwise("current").alias("status"))
    p = d.select(k.alias("publication_id"), k, F.col("title").alias("record"))
    return coverage.coverage_state(sets, a, p, _snapshots(spark, sf_dir), "2024-01-25 12:00:00")


_STATE_SQL = f"""{_LINKS}, {_SNAPSHOTS}, ap AS (SELECT lower(product_type) || '||' || CASE WHEN directive_id % 2 = 0 THEN coalesce(lower(make), '') ELSE '' END || '|' || CASE WHEN directive_id % 2 = 0 THEN coalesce(lower(regexp_extract(model, '^[A-Z]+')), '') ELSE '' END AS target_key,
        directive_id, CASE WHEN directive_id % 4 = 2 THEN 'stale' ELSE 'current' END AS status, title FROM directives),
    n AS (SELECT target_key, count(DISTINCT CASE WHEN status = 'current' THEN directive_id END) AS directives, count(*) AS publications, CAST(sum(strlen(title)) AS BIGINT) AS source_bytes FROM ap GROUP BY target_key),
    state AS (SELECT d.target_key, coalesce(directives, 0) AS directives, coalesce(publications, 0) AS publications, coalesce(source_bytes, 0) AS source_bytes,
        CASE WHEN u.status IS NULL THEN 'awaiting_source_snapshot' WHEN u.status <> 'complete' THEN 'degraded_source' WHEN TIMESTAMP '2024-01-25 12:00:00' - captured_at > INTERVAL 7 DAYS THEN 'stale_source' WHEN coalesce(directives, 0) = 0 THEN 'pending_applicability' ELSE 'current' END AS status,
        CASE WHEN u.status IS NULL THEN 'unversioned' ELSE substr(sha256(content_hash || '|' || d.target_key), 1, 24) END AS version
        FROM needed d LEFT JOIN usable u ON u.source_system = 'source-' || (length(d.target_key) % 6) LEFT JOIN n ON n.target_key = d.target_key)"""


@query(f"WITH {_STATE_SQL} SELECT * FROM state")
def coverage_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query(f"""WITH {_STATE_SQL}, act AS (SELECT DISTINCT aircraft_id, target_key FROM subscriptions WHERE status = 'active' AND aircraft_id % 7 <> 0),
    c AS (SELECT aircraft_id, role, CASE role WHEN 'airframe' THEN 'aircraft' ELSE role END || '||' || coalesce(lower(make), '') || '|' || coalesce(lower(model), '') AS target_key, make IS NULL OR model IS NULL AS part FROM components),
    t AS (SELECT aircraft_id, role || ': identity incomplete' AS w FROM c WHERE part UNION SELECT aircraft_id, role || ': not covered' FROM c ANTI JOIN act USING (aircraft_id, target_key) WHERE NOT part
        UNION SELECT aircraft_id, target_key || ': ' || status FROM act JOIN state USING (target_key) WHERE status <> 'current'),
    g AS (SELECT aircraft_id, string_agg(w, ';' ORDER BY w) AS warnings FROM t GROUP BY aircraft_id), s AS (SELECT aircraft_id, count(*) AS n FROM act GROUP BY aircraft_id)
    SELECT aircraft_id, coalesce(n, 0) AS subscriptions, CASE WHEN n IS NULL THEN 'not_resolved' WHEN warnings IS NOT NULL THEN 'degraded' ELSE 'current' END AS status, coalesce(warnings, '') AS warnings FROM aircraft LEFT JOIN s USING (aircraft_id) LEFT JOIN g USING (aircraft_id)""")
def aircraft_coverage(spark, sf_dir):
    subs = _links(spark, sf_dir)[1].where("aircraft_id % 7 <> 0")
    return coverage.aircraft_coverage(fleet.components_long(bind(spark, sf_dir, "aircraft")), subs, _state(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", ";"))


@query(f"""WITH {_STATE_SQL}, r AS (SELECT estimate, rate FROM ocr_runs), u AS (SELECT * FROM subscriptions WHERE status = 'active')
    SELECT (SELECT CAST(sum(storage_bytes) AS BIGINT) FROM snapshots) AS source_bytes, (SELECT CAST(sum(source_bytes) AS BIGINT) FROM state) AS derived_bytes, (SELECT CAST(sum(estimate) AS DECIMAL(18,6)) FROM r) AS actual_cost, (SELECT CAST(sum(rate) AS DECIMAL(18,6)) FROM r) AS allocated_cost,
           (SELECT count(*) FROM state) AS coverage_sets, (SELECT count(DISTINCT organization_id) FROM u) AS clients, (SELECT count(DISTINCT aircraft_id) FROM u) AS aircraft""")
def coverage_cost_totals(spark, sf_dir):
    ledger = bind(spark, sf_dir, "ocr_runs").select(F.col("estimate").alias("actual_cost"), F.col("rate").alias("allocated_cost"))
    return coverage.cost_totals(ledger, _snapshots(spark, sf_dir), _state(spark, sf_dir), _links(spark, sf_dir)[1])


@query(f"""WITH {_STATE_SQL}, x AS (SELECT 'coverage-link:' || target_key || ':' || aircraft_id AS idempotency_key, 'aircraft' AS scope_type, 'coverage_association' AS cost_category, 1 AS q, 'coverage_link' AS usage_unit FROM subscriptions WHERE status = 'active'
        UNION ALL SELECT 'coverage-materialization:' || target_key || ':' || version, 'coverage_set', 'derived_index_storage', source_bytes, 'estimated_logical_byte' FROM state UNION ALL SELECT 'source-storage:' || content_hash, 'shared_source', 'source_storage', storage_bytes, 'byte' FROM snapshots)
    SELECT DISTINCT idempotency_key, scope_type, cost_category, CAST(q AS DECIMAL(18,6)) AS usage_quantity, usage_unit FROM x""")
def ledger_entries(spark, sf_dir):
    return coverage.ledger_entries(_links(spark, sf_dir)[1].where("status = 'active'"), _state(spark, sf_dir), _snapshots(spark, sf_dir))


_CUSTOMER_BLOCKS = """SELECT conv_id AS job_id, CAST(max(turn) + 2 AS INT) AS pages, collect_list(named_struct('id', CASE WHEN turn % 5 <> 4 THEN 'b' || turn END, 'type', element_at(array('LINE', 'WORD', 'CELL', 'SIGNATURE', 'KEY_VALUE_SET', 'LAYOUT_TABLE'), CAST(turn % 6 + 1 AS INT)),
    'page', CAST(turn + 1 AS INT), 'text', CASE WHEN turn % 6 < 2 THEN text END, 'confidence', CAST(turn AS DOUBLE), 'left', CAST(turn % 3 AS DOUBLE) / 4, 'top', CAST(0.5 AS DOUBLE), 'width', CAST(0.25 AS DOUBLE), 'height', CAST(NULL AS DOUBLE), 'row', CAST(turn AS INT), 'column', CAST(0 AS INT))) AS blocks
    FROM {conversations} GROUP BY conv_id"""


@query("""WITH b AS (SELECT conv_id, turn, text, CASE turn % 6 WHEN 0 THEN 'LINE' WHEN 1 THEN 'WORD' WHEN 2 THEN 'CELL' WHEN 3 THEN 'SIGNATURE' WHEN 5 THEN 'LAYOUT_TABLE' END AS t FROM conversations),
    p AS (SELECT conv_id, CAST(unnest(generate_series(1, max(turn) + 2)) AS BIGINT) AS page FROM conversations GROUP BY conv_id)
    SELECT p.conv_id AS job_id, p.page, CASE WHEN t IS NOT NULL THEN CASE WHEN turn % 5 <> 4 THEN 'b' || turn ELSE 'textract-1' END END AS block_id, t AS span_type,
           CASE WHEN turn % 6 < 2 AND coalesce(text, '') <> '' THEN text WHEN t IN ('LINE', 'WORD') THEN '[' || lower(t) || ']' WHEN t = 'CELL' THEN '[cell r' || CASE WHEN turn = 0 THEN '?' ELSE '' || turn END || ' c?]' WHEN t = 'SIGNATURE' THEN '[signature]' WHEN t = 'LAYOUT_TABLE' THEN '[table]' END AS text,
           CASE WHEN t IS NOT NULL THEN 1 END AS reading_order FROM p LEFT JOIN b ON b.conv_id = p.conv_id AND b.turn + 1 = p.page AND b.t IS NOT NULL""")
def analysis_spans(spark, sf_dir):
    """One block of each conversation's turn on a page of its own, and an empty page at the end."""
    r = spark.sql(_CUSTOMER_BLOCKS, conversations=table(spark, sf_dir, "conversations"))
    return payloads.blocks_to_spans(r).select("job_id", F.col("page").cast("long").alias("page"), "block_id", "span_type", "text", "reading_order")


@query("""WITH l AS (SELECT doc_id, [x for x in [trim(y) for y in string_split(coalesce(text, ''), chr(10))] if x <> ''] AS ls FROM documents), t AS (SELECT doc_id, ls, unnest(ls) AS text, unnest(generate_series(1, len(ls))) AS i FROM l)
    SELECT doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 END AS page, 'line-' || (doc_id % 3) || '-' || i AS block_id, 'LINE' AS span_type, text, CAST((i - 1) * 1000 // len(ls) AS BIGINT) AS top, i + 1 AS reading_order, CASE WHEN doc_id % 2 = 0 THEN 50.0 ELSE 75.0 END AS confidence FROM t
    UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 END, 'block-' || (doc_id % 3) || '-2', 'TITLE', 'head', 250, 2, CASE WHEN doc_id % 2 = 0 THEN 50.0 ELSE 75.0 END FROM documents""")
def markdown_spans(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    block = lambda kind, text: F.struct(F.lit(None).cast("string").alias("id"), F.lit(kind).alias("type"), F.lit(text).alias("content"), F.lit(10.0).alias("left"), F.lit(50.0).alias("top"), F.lit(60.0).alias("right"), F.lit(40.0).alias("bottom"))
    page = F.struct(
        (k % 3).cast("int").alias("index"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"), F.when(k % 2 == 0, F.lit(0.5)).alias("average"), F.lit(75.0).alias("minimum"), F.regexp_replace("text", "\t", "\t").alias("markdown"),
        F.array(block("text", " "), block("title", " head ")).alias("blocks"),
    )
    out = payloads.markdown_to_spans(d.select(k.alias("job_id"), F.array(page).alias("pages")))
    return out.select("job_id", F.col("page").cast("long").alias("page"), "block_id", "span_type", "text", F.floor(F.bround(F.col("top") * 1000, 6)).alias("top"), F.col("reading_order").cast("long").alias("reading_order"), "confidence")


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), i AS (SELECT doc_id, 'LINE' AS span_type, trim(substr(text, 1, 20)) AS text, 1 AS number, 0 AS rank FROM t UNION ALL SELECT doc_id, 'WORD', trim(substr(text, 1, 4)), 1, 1 FROM t UNION ALL SELECT doc_id, 'WORD', trim(substr(text, 5, 3) || substr(text, 11, 2)), 2, 2 FROM t)
    SELECT doc_id AS page_id, lower(span_type) || '-' || number AS block_id, span_type, text, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS reading_order, CASE rank WHEN 0 THEN 100 ELSE 250 END AS "left", CASE rank WHEN 0 THEN 800 ELSE 0 END AS width FROM i WHERE text <> ''""")
def token_spans(spark, sf_dir):
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    seg = lambda a, b: F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end"))
    item = lambda kind, segments, points: F.struct(F.lit(kind).alias("kind"), F.array(*segments).alias("segments"), F.array(*points).alias("points"), F.lit(0.5).alias("confidence"))
    items = F.array(item("WORD", [seg(None, 4)], [point(0.25, 0.5)]), item("LINE", [seg(0, 20)], [point(0.9, 0.1), point(0.1, 0.2)]), item("WORD", [seg(4, 7), seg(10, 12)], [point(0.25, 0.5), point(0.25, 0.6)]))
    out = payloads.tokens_to_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.coalesce("text", F.lit("")).alias("text"), items.alias("items")))
    return out.select("page_id", "block_id", "span_type", "text", F.col("reading_order").cast("long").alias("reading_order"), F.bround(F.col("left") * 1000).cast("int").alias("left"), F.bround(F.col("width") * 1000).cast("int").alias("width"))


def _regions(spark, sf_dir):
    k = F.col("page_id")
    region = lambda index, label, task, score, box: F.struct(index.cast("int").alias("index"), F.lit(label).alias("label"), F.lit(task).cast("string").alias("task"), score.cast("double").alias("score"), box.alias("box"), F.lit("t").alias("text"))
    box = lambda *x: F.array(*(v if not isinstance(v, int) else F.lit(v) for v in x)).cast("array<double>")
    regions = F.array(
        region(F.lit(2), "table", None, F.lit(0.5), box(0, 0, 500, 250)), region(F.lit(None), "inline_formula", None, F.when(k % 5 == 0, 1.5).otherwise(1.0), box(100, k % 7, 200, 900)),
        region(F.lit(0), "text", "code", F.lit(None), F.when(k % 3 == 0, box(0, 0, 10)).otherwise(box(0, 0, 10, 10))), region(F.lit(3), "text", None, F.lit(0.0), box(10, 10, 5, 20)),
    )
    return payloads.regions_to_spans(table(spark, sf_dir, "pages").select("page_id", regions.alias("regions")))


@query("""SELECT page_id, 'region-2' AS block_id, 'REGION_TABLE' AS span_type, 50.0 AS confidence, 0.25 AS height, 1 + CASE WHEN page_id % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 3 <> 0 THEN 1 ELSE 0 END AS reading_order FROM pages
    UNION ALL SELECT page_id, 'region-1', 'REGION_FORMULA', 100.0, 0.9 - (page_id % 7) / 1000, 1 + CASE WHEN page_id % 3 <> 0 THEN 1 ELSE 0 END FROM pages WHERE page_id % 5 <> 0
    UNION ALL SELECT page_id, 'region-0', 'REGION_CODE', NULL, 0.01, 1 FROM pages WHERE page_id % 3 <> 0""")
def region_spans(spark, sf_dir):
    out = _regions(spark, sf_dir)[0]
    return out.select("page_id", "block_id", "span_type", "confidence", F.bround("height", 6).alias("height"), F.col("reading_order").cast("long").alias("reading_order"))


@query("""SELECT page_id, 3 AS "index", 'box_out_of_range' AS issue FROM pages UNION ALL SELECT page_id, 1, 'score_out_of_range' FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 0, 'box_missing' FROM pages WHERE page_id % 3 = 0""")
def region_issues(spark, sf_dir):
    return _regions(spark, sf_dir)[1]


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_log(spark, sf_dir):
    """Events appended in two lots to a table with a folder a day, and counted there."""
    path, e = shared_folder(spark, "events"), table(spark, sf_dir, "events")
    for rest in (0, 1):
        src.append_events(e.where(F.col("event_id") % 2 == rest), path, "ts")
    return spark.read.parquet(path).groupBy("day", "event_type").agg(F.count("*").alias("events"))


@query("SELECT DISTINCT ad_number AS id FROM directives")
def id_set(spark, sf_dir):
    """Distinct numbers written as JSON in order, and read back."""
    path = shared_folder(spark, "ids")
    src.write_id_set(bind(spark, sf_dir, "directives").select(F.col("ad_number").alias("id")), path)
    return spark.read.schema("id string").json(path)


@query("""SELECT min('doc-' || lpad('' || doc_id, 9, '0')) AS path, sha256(coalesce(text, '')) AS content_hash, max(CAST(strlen(coalesce(text, '')) AS BIGINT)) AS storage_bytes, CAST(max(n_chars) % 3 AS BIGINT) AS row_count,
    CASE WHEN max(strlen(coalesce(text, ''))) = 0 THEN 'failed' WHEN max(n_chars) % 3 = 0 THEN 'partial' ELSE 'complete' END AS status, 10 AS age_days FROM documents GROUP BY coalesce(text, '')""")
def source_snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.to_timestamp(F.lit("2024-01-10")).alias("modified"), (F.col("n_chars") % 3).alias("n"))
    return src.register_snapshots(d.drop("n"), d.select("path", "n"), "2024-01-20")
