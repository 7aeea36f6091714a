"""Registered queries of fields, tags, samples, overrides and costs of single runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import text as tx
from tarmac.operators import fleet, jobs, review, worklists
from tarmac.plans.bindings import bind, table
from tarmac.plans.queries import _SPANS, query


def _outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    k = F.col("entry_id")
    after = o.select(k, F.when(k % 3 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(k % 4 > 0, F.col("priority")).alias("priority"), F.col("customer"))
    return worklists.review_outcome(o, after, ["entry_id"], ["status", "priority", "customer"])


@query("""SELECT o_orderkey AS entry_id, CAST(o_orderkey % 3 = 0 AS INT) + CAST(o_orderkey % 4 = 0 AND o_orderpriority IS NOT NULL AS INT) AS edited,
    'customer=accepted,priority=' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE 'accepted' END || ',status=' || CASE WHEN o_orderkey % 3 = 0 THEN 'corrected' ELSE 'accepted' END AS decisions FROM orders""")
def edited_fields(spark, sf_dir):
    out = worklists.edited_fields(_outcomes(spark, sf_dir), ["entry_id"])
    return out.select("entry_id", F.col("edited").cast("int").alias("edited"), F.array_join(F.transform(F.map_entries("decisions"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("decisions"))


@query("""WITH ev AS (SELECT l_orderkey AS entry_id, min(l_linenumber) AS upload_id FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderkey AS entry_id, 'status' AS field_name, o_orderstatus AS previous_value, 'X' AS new_value FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, NULL FROM orders WHERE o_orderkey % 4 = 0)
    SELECT entry_id, upload_id, 'human_override' AS evidence_type, field_name, previous_value, new_value FROM c JOIN ev USING (entry_id) WHERE entry_id % 5 > 0""")
def field_overrides(spark, sf_dir):
    """What people changed, an evidence row for each field."""
    k = F.col("l_orderkey").alias("entry_id")
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.when(F.col("o_orderkey") % 5 > 0, "ocr_ingestion").otherwise("manual").alias("source_type"))
    line = F.col("l_linenumber")
    evidence = table(spark, sf_dir, "lineitem").select(k, line.alias("evidence_id"), line.alias("created_at"), line.alias("upload_id"), F.lit(1).alias("page_id"))
    return worklists.field_overrides(_outcomes(spark, sf_dir), entries, evidence, ["entry_id"]).drop("page_id")


@query("""SELECT c_custkey, concat_ws(',', 'Aircraft=aircraft-' || c_custkey, 'Application=logs', 'BillableAccount=' || a, 'BillingStage=initial-ocr', 'CustomerAccount=' || a, 'Environment=pilot', 'Project=logs', 'Upload=upload-' || c_custkey) AS tags
    FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'acct-' || c_nationkey ELSE c_mktsegment END AS a FROM customer)""")
def upload_tags(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    given = F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).otherwise("")
    tags = tx.upload_tags(given, F.col("c_nationkey"), F.lit(None).cast("string"), F.col("c_custkey"), F.col("c_custkey"), "logs")
    return c.select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("tags"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE trim(s_name) || ';' || CASE WHEN s_suppkey % 2 = 0 THEN 'slug-' || s_suppkey ELSE '' END END AS agencies FROM supplier")
def agency_names(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    none = F.lit(None).cast("string")
    two = F.array(F.struct(F.concat(F.lit(" "), "s_name").alias("name"), F.lit("x").alias("slug")), F.struct(F.when(k % 3 == 0, "").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("slug-"), k)).otherwise(none).alias("slug")))
    return s.select("s_suppkey", F.array_join(tx.agency_names(F.when(k % 4 > 0, two)), ";").alias("agencies"))


_SAMPLES = "SELECT directive_id, CASE directive_id % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'snapshot_unparseable' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'matched' END AS status FROM directives"


def _samples(spark, sf_dir):
    k = F.col("directive_id")
    status = F.when(k % 5 == 0, "matched").when(k % 5 == 1, "snapshot_unparseable").when(k % 5 == 2, "ambiguous").when(k % 5 == 3, "matched")
    d = bind(spark, sf_dir, "directives")
    return d.select(k.alias("id"), status.alias("status")), d.where("size > 10").select(k.alias("id"))


@query(f"""WITH s AS ({_SAMPLES}), h AS (SELECT directive_id FROM directives WHERE size > 10)
    SELECT s.directive_id AS id, CASE WHEN h.directive_id IS NULL THEN 'missing' ELSE coalesce(status, 'ambiguous') END AS status, coalesce(status, 'ambiguous') AS original_status, h.directive_id IS NOT NULL AS bulk_present, FALSE AS unchecked FROM s LEFT JOIN h USING (directive_id)
    UNION ALL SELECT directive_id, coalesce(status, 'ambiguous'), coalesce(status, 'ambiguous'), NULL, TRUE FROM s""")
def sample_crosscheck(spark, sf_dir):
    """Samples against a set of ids, and without one."""
    samples, ids = _samples(spark, sf_dir)
    with_set, without = (review.sample_crosscheck(samples, s).withColumn("unchecked", F.lit(s is None)) for s in (ids, None))
    return with_set.unionByName(without)


@query(f"""WITH s AS ({_SAMPLES}), x AS (SELECT count(*) AS samples, count(*) FILTER (directive_id IN (SELECT directive_id FROM directives WHERE size <= 10)) AS missing,
        count(*) FILTER (coalesce(status, 'ambiguous') <> 'matched' AND directive_id NOT IN (SELECT directive_id FROM directives WHERE size <= 10)) AS ambiguous FROM s)
    SELECT *, CASE WHEN missing > 0 THEN 'low' WHEN ambiguous = 0 AND samples > 0 THEN 'high' ELSE 'conditional' END AS confidence FROM x""")
def sample_confidence(spark, sf_dir):
    return review.sample_confidence(review.sample_crosscheck(*_samples(spark, sf_dir)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 > 0 THEN CAST(round_even(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS DECIMAL(18,8)) * CAST(1.5 AS DECIMAL(4,2)) / 3600 ELSE CAST(l_suppkey AS DECIMAL(18,8)) * CAST(0.004 AS DECIMAL(4,3)) END, 6) AS DECIMAL(18,6)) END AS cost FROM lineitem""")
def run_costs(spark, sf_dir):
    i = F.col("l_linenumber")
    unit = F.when(i % 2 == 0, "compute_hour").otherwise("page")
    rate = F.when(i % 4 > 0, F.when(i % 2 == 0, F.lit("1.5")).otherwise(F.lit("0.004")).cast("decimal(18,8)"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", jobs.run_cost(unit, F.col("l_suppkey"), F.col("l_partkey"), rate).alias("cost"))


@query(f"WITH {_SPANS}, n AS (SELECT page_id, span_type, count(*) AS n FROM spans GROUP BY ALL) SELECT page_id, string_agg(span_type || '=' || n, ',' ORDER BY span_type) AS types FROM n GROUP BY page_id")
def span_type_counts(spark, sf_dir):
    out = jobs.span_type_counts(jobs.page_spans(table(spark, sf_dir, "documents")))
    return out.select("page_id", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("types"))


@query("SELECT directive_id, CASE WHEN directive_id % 4 = 1 THEN 'not_started' ELSE 'needs_review' END AS extraction_status FROM directives WHERE directive_id % 4 IN (1, 3) ORDER BY directive_id LIMIT 20")
def pending_directives(spark, sf_dir):
    """The first 20 directives to extract: a work list's limit."""
    k = F.col("directive_id")
    d = bind(spark, sf_dir, "directives").select(k, F.when(k % 4 == 1, "not_started").when(k % 4 == 3, "needs_review").otherwise("complete").alias("extraction_status"))
    return worklists.pending_directives(d, 20)


@query("""SELECT entry_id, line_no, part_id, quantity, entry_date, array_to_string(list_sort(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(body), '[a-z0-9][a-z0-9-][a-z0-9-]+')), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'all', 'model')),
        list_filter(list_distinct(regexp_extract_all(lower(title || ' complied inspected reviewed'), '[a-z0-9][a-z0-9-][a-z0-9-]+')), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'all', 'model'))))[1:4], ', ') AS words
    FROM entries JOIN directives ON directive_id = part_id""")
def keyword_overlaps(spark, sf_dir):
    both = bind(spark, sf_dir, "entries").join(bind(spark, sf_dir, "directives").select("directive_id", "title"), F.col("directive_id") == F.col("part_id"))
    words = tx.keyword_overlap(tx.keywords(F.col("body")), tx.keywords(F.concat("title", F.lit(" complied inspected reviewed"))))
    return both.select("entry_id", "line_no", "part_id", "quantity", "entry_date", words.alias("words"))


@query("""SELECT c_custkey AS aircraft_id, role, make, model, serial FROM (SELECT c_custkey, unnest(['airframe', 'engine', 'propeller']) AS role, unnest([c_mktsegment, NULL, CASE WHEN c_custkey % 3 = 0 THEN 'P' END]) AS make,
        unnest([NULL, NULL, CASE WHEN c_custkey % 3 = 1 THEN 'HC' END]) AS model, unnest([c_name, CASE WHEN c_custkey % 2 = 0 THEN 'E' || c_custkey END, CASE WHEN c_custkey % 5 = 0 THEN 'P9' END]) AS serial FROM customer) WHERE role = 'airframe' OR make IS NOT NULL OR model IS NOT NULL OR serial IS NOT NULL""")
def component_serials(spark, sf_dir):
    """Engines and propellers that only a serial or a model tells of."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    planes = table(spark, sf_dir, "customer").select(
        k.alias("aircraft_id"), F.col("c_mktsegment").alias("make"), none.alias("model"), F.col("c_name").alias("serial"), F.lit(" ").alias("engine_make"), none.alias("engine_model"), F.when(k % 2 == 0, F.concat(F.lit("E"), k)).alias("engine_serial"),
        F.when(k % 3 == 0, "P").alias("propeller_make"), F.when(k % 3 == 1, "HC").alias("propeller_model"), F.when(k % 5 == 0, "P9").alias("propeller_serial"),
    )
    return fleet.components_long(planes).drop("display_name")


@query("""SELECT doc_id, 'entry_date' AS field, CASE WHEN doc_id % 5 > 0 THEN CASE WHEN doc_id % 7 = 0 THEN '1850-01-01' WHEN doc_id % 7 = 1 THEN '2030-01-01' ELSE '2001-02-03' END END AS value, doc_id % 5 > 0 AND doc_id % 7 > 1 AS source_supported, CASE WHEN doc_id % 5 = 0 THEN 'unsupported' WHEN doc_id % 7 < 2 THEN 'rejected' ELSE 'candidate' END AS disposition FROM documents
    UNION ALL SELECT doc_id, 'description', lang, doc_id % 3 > 0, CASE WHEN doc_id % 3 > 0 THEN 'candidate' ELSE 'unsupported' END FROM documents
    UNION ALL SELECT doc_id, unnest(['tach_time', 'hobbs_time', 'total_time']), CASE WHEN doc_id % 4 > 0 THEN '7' END, doc_id % 4 = 0 OR doc_id % 2 = 0, CASE WHEN doc_id % 4 = 0 THEN 'null' WHEN doc_id % 2 = 0 THEN 'candidate' ELSE 'unsupported' END FROM documents
    UNION ALL SELECT doc_id, 'performer_name', 'Ann Lee', FALSE, 'unsupported' FROM documents UNION ALL SELECT doc_id, 'performer_credential', NULL, TRUE, 'null' FROM documents""")
def candidate_fields(spark, sf_dir):
    """The result of each field of each draft."""
    k = F.col("doc_id")
    day = F.when(k % 7 == 0, "1850-01-01").when(k % 7 == 1, "2030-01-01").otherwise("2001-02-03").cast("date")
    time = lambda c: F.when(k % 4 > 0, F.lit(7)).alias(c)
    spans = F.map_concat(F.create_map(F.lit("x"), F.lit("y")), F.when(k % 3 > 0, F.create_map(F.lit("description"), F.lit("d"))).otherwise(F.create_map(F.lit("z"), F.lit("y"))))
    timed = F.map_concat(spans, F.when(k % 2 == 0, F.create_map(*(F.lit(x) for c in ("tach_time", "hobbs_time", "total_time") for x in (c, "t")))).otherwise(F.create_map(F.lit("w"), F.lit("y"))))
    drafts = table(spark, sf_dir, "documents").select(
        k, (k % 5 > 0).alias("date_was_extracted"), day.alias("entry_date"), F.col("lang").alias("description"), time("tach_time"), time("hobbs_time"), time("total_time"), F.lit("Ann Lee").alias("performer_name"),
        F.lit(None).cast("string").alias("performer_credential"), timed.alias("spans"), F.array(F.lit("a")).alias("lines"), F.lit(False).alias("requires_review"),
    )
    return review.validate_candidates(drafts, "2020-01-01").select("doc_id", F.explode("field_results").alias("r")).select("doc_id", "r.*")
