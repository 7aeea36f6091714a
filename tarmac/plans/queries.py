"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import text as tx
from tarmac.operators import fleet, jobs
from tarmac.operators.applicability import Applicability, close_class_links, installed
from tarmac.plans.bindings import bind, table, with_bindings
from tarmac.streaming import status
from tarmac.streaming.folders import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_bindings(sql)
        return f

    return add


_BILLING = """
    SELECT account, aircraft, provider, version, channel, mode, routing, CAST(grouping_id(account, aircraft, provider, version, channel, mode, routing) AS INT) AS level,
           count(*) FILTER (done) AS runs, count(DISTINCT CASE WHEN done THEN upload_id END) AS uploads, count(*) FILTER (done AND (acc IS NULL OR air IS NULL)) AS unattributed,
           count(*) FILTER (done AND c IS NULL) AS unpriced, {per_kind}, count(*) FILTER (done AND unit <> 'page') AS not_by_page,
           CAST(coalesce(sum(CASE WHEN done THEN CASE WHEN regexp_full_match(bypass, '[0-9]+') THEN CAST(bypass AS BIGINT) ELSE 0 END END), 0) AS BIGINT) AS bypass_pages,
           CAST(coalesce(sum(CASE WHEN done THEN CASE WHEN counted IS NOT NULL THEN CAST(counted AS BIGINT) WHEN channel_tag = 'aws' THEN p ELSE 0 END END), 0) AS BIGINT) AS counted_pages,
           CAST(coalesce(sum(c), 0) AS DECIMAL(18,6)) AS cost,
           CASE WHEN grouping_id(account, aircraft, provider, version, channel, mode, routing) = 127 THEN count(DISTINCT CASE WHEN done THEN coalesce(acc, '?') || '/' || coalesce(air, '?') END) END AS groups,
           CASE WHEN grouping_id(account, aircraft, provider, version, channel, mode, routing) = 127 THEN count(*) FILTER (NOT done) END AS excluded
    FROM (SELECT * EXCLUDE (channel), nullif(trim(channel), '') AS channel, channel AS channel_tag, account AS acc, aircraft AS air, status = 'complete' AS done, CASE WHEN status = 'complete' THEN CASE WHEN unit = 'page' THEN pages ELSE 0 END END AS p,
                 CASE WHEN billing_status IN ('chargeable', 'not_billable') THEN billing_status ELSE 'other' END AS kind,
                 CASE WHEN status = 'complete' THEN CAST(coalesce(estimate, CASE WHEN unit = 'page' THEN rate * pages END) AS DECIMAL(18,6)) END AS c FROM ocr_runs {{where}})
    GROUP BY GROUPING SETS ((), (account, aircraft), (account, aircraft, provider, version, channel, mode, routing))
    HAVING grouping_id(account, aircraft, provider, version, channel, mode, routing) = 127 OR count(*) FILTER (done) > 0""".format(per_kind=", ".join(
    f"""count(*) FILTER (done AND c IS NULL AND kind = '{k}') AS {k}_unpriced, CAST(coalesce(sum(CASE WHEN kind = '{k}' THEN p END), 0) AS BIGINT) AS {k}_pages,
        CAST(coalesce(sum(CASE WHEN kind = '{k}' THEN c END), 0) AS DECIMAL(18,6)) AS {k}_cost""" for k in ("chargeable", "not_billable", "other")))


def _runs(spark, sf_dir):
    """The bound runs with their tags as a map, as the source has them."""
    named = {"provider_channel": "channel", "provider_mode": "mode", "routing_mode": "routing", "native_bypass_page_count": "bypass", "textract_page_count": "counted"}
    tags = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in named.items())), lambda x: x["value"].isNotNull()))
    return bind(spark, sf_dir, "ocr_runs").withColumn("tags", tags).drop(*named.values())


@query(_BILLING.format(where=""))
def billing_summary(spark, sf_dir):
    return jobs.billing_summary(_runs(spark, sf_dir))


@query(_BILLING.format(where="WHERE created >= DATE '1998-01-01' AND created < DATE '1998-07-01' AND billing_status = 'chargeable'"))
def billing_period_filtered(spark, sf_dir):
    return jobs.billing_summary(_runs(spark, sf_dir), "1998-01-01", "1998-07-01", account=" ", billing="chargeable")


_COMPONENTS = """
    components AS (
        SELECT aircraft_id, 'airframe' AS role, make, model, serial FROM aircraft
        UNION ALL SELECT aircraft_id, 'engine', engine_make, engine_model, NULL FROM aircraft WHERE engine_make IS NOT NULL
        UNION ALL SELECT aircraft_id, 'propeller', trim(propeller_make), NULL, NULL FROM aircraft WHERE trim(propeller_make) <> '')"""


@query(f"WITH {_COMPONENTS} SELECT *, concat_ws(' ', make, model, serial) AS display_name FROM components")
def components_long(spark, sf_dir):
    return fleet.components_long(bind(spark, sf_dir, "aircraft"))


@query("""
    SELECT DISTINCT aircraft_id, upper(replace(replace(trim(number_raw), '-', ''), ' ', '')) AS number FROM aircraft
    WHERE status = 'active' AND (owner_id IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)
        OR aircraft_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))""")
def visible_aircraft(spark, sf_dir):
    """Aircraft of an owner with an active membership, or with an active assignment: an OR of keys as a union of semi joins."""
    fleet_rows = bind(spark, sf_dir, "aircraft").where("status = 'active'")
    owners = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("owner_id"))
    assigned = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("aircraft_id"))
    both = fleet_rows.join(owners, "owner_id", "left_semi").unionByName(fleet_rows.join(assigned, "aircraft_id", "left_semi").select("owner_id", *[c for c in fleet_rows.columns if c != "owner_id"]))
    return both.select("aircraft_id", tx.registration(F.col("number_raw")).alias("number")).distinct()


_STATUS = """CASE WHEN lower(trim(source_status)) IN ('active', 'current', 'final', 'published') THEN 'current'
             WHEN lower(trim(source_status)) LIKE '%supersed%' THEN 'superseded' WHEN lower(trim(source_status)) LIKE '%cancel%' OR lower(trim(source_status)) LIKE '%rescinded%' THEN 'rescinded'
             ELSE substr(replace(lower(trim(source_status)), ' ', '_'), 1, 64) END"""
_KEY = "lower(trim(product_type)) || '|' || coalesce(lower(trim(make)), '') || '|' || coalesce(lower(trim(model)), '')"


def _directives(spark, sf_dir):
    d = bind(spark, sf_dir, "directives")
    return d.withColumn("source_status", tx.source_status(F.col("source_status"))).withColumn("target_key", tx.target_key(F.col("product_type"), F.col("make"), F.col("model")))


@query(f"SELECT directive_id, ad_number, {_STATUS} AS source_status, {_KEY} AS target_key FROM directives")
def target_keys(spark, sf_dir):
    return _directives(spark, sf_dir).select("directive_id", "ad_number", "source_status", "target_key")


@query("""
    SELECT ad_number, max(directive_id) AS directive_id, arg_max(title, directive_id) AS title, arg_max(source_status, directive_id) AS source_status, max(directive_id) >= 1000 AND min(directive_id) >= 1000 AS created
    FROM directives GROUP BY ad_number""")
def directive_import(spark, sf_dir):
    """Get-or-create by directive number: rows from id 1000 on update those before; the last one wins."""
    rows = bind(spark, sf_dir, "directives").select("ad_number", "directive_id", "title", "source_status")
    old = jobs.latest(rows.where("directive_id < 1000"), ["ad_number"], ["directive_id"])
    return jobs.upsert(old, rows.where("directive_id >= 1000"), ["ad_number"], ["directive_id"])


_MATCH = """
    {components}, t AS (
        SELECT directive_id, CASE product_type WHEN 'Aircraft' THEN 'airframe' ELSE lower(product_type) END AS role, make, model
        FROM (SELECT *, {status} AS st FROM directives) WHERE st IN ('current', 'active', 'unknown')),
    hits AS (SELECT DISTINCT c.aircraft_id, t.directive_id, t.role FROM components c JOIN t ON c.role = t.role
        AND (t.make IS NULL OR regexp_replace(lower(t.make), '[^a-z0-9]', '', 'g') = regexp_replace(lower(coalesce(c.make, '')), '[^a-z0-9]', '', 'g'))
        AND (t.model IS NULL OR regexp_replace(lower(t.model), '[^a-z0-9]', '', 'g') = regexp_replace(lower(coalesce(c.model, '')), '[^a-z0-9]', '', 'g')))""".format(components=_COMPONENTS, status=_STATUS)


def _applicability(spark, sf_dir, directives=None):
    return Applicability.of(fleet.components_long(bind(spark, sf_dir, "aircraft")), _directives(spark, sf_dir) if directives is None else directives)


def _hits(spark, sf_dir):
    return _applicability(spark, sf_dir).pairs()


@query(f"WITH {_MATCH} SELECT * FROM hits")
def component_targets(spark, sf_dir):
    return _hits(spark, sf_dir)


_CLEAN = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g')"
_CLASSES = """c AS (SELECT aircraft_id, role, {cm} AS cm, {cd} AS cd FROM {{source}}), n AS (SELECT directive_id, role, {tm} AS tm, {td} AS td FROM t),
    cc AS (SELECT role, cm, cd, count(DISTINCT aircraft_id) AS aircraft FROM c GROUP BY ALL), nn AS (SELECT role, tm, td, count(DISTINCT directive_id) AS directives FROM n GROUP BY ALL)""".format(
    cm=_CLEAN.format("make"), cd=_CLEAN.format("model"), tm=_CLEAN.format("make"), td=_CLEAN.format("model"))
_CLOSE = """(cm = '' AND tm <> '') OR (cd = '' AND td <> '')
       OR (cm <> tm AND cd <> td AND (starts_with(cm, tm) OR starts_with(tm, cm)) AND (starts_with(cd, td) OR starts_with(td, cd))
           AND least(length(cm), length(tm)) >= 4 AND least(length(cd), length(td)) >= 4)"""
_LINK_ROWS = "SELECT role || '|' || cm || '|' || cd AS component_class, role || '|' || tm || '|' || td AS target_class, aircraft, directives FROM cc JOIN nn USING (role) WHERE "
_CLOSE_ROWS = f""", l AS (SELECT * FROM cc JOIN nn USING (role) WHERE {_CLOSE})
    SELECT 'link' AS kind, role || '|' || cm || '|' || cd AS component_class, role || '|' || tm || '|' || td AS target_class, NULL AS aircraft_id, NULL AS directive_id, aircraft, directives FROM l
    UNION ALL SELECT DISTINCT 'aircraft', role || '|' || cm || '|' || cd, NULL, aircraft_id, NULL, NULL, NULL FROM c SEMI JOIN l USING (role, cm, cd)
    UNION ALL SELECT DISTINCT 'directive', NULL, role || '|' || tm || '|' || td, NULL, directive_id, NULL, NULL FROM n SEMI JOIN l USING (role, tm, td)"""


@query(f"WITH {_MATCH}, {_CLASSES.format(source='components')} {_CLOSE_ROWS}")
def uncertain_components(spark, sf_dir):
    """Both branches and all roles, as links between classes and the aircraft and directives that are in these."""
    return Applicability.of(fleet.components_long(bind(spark, sf_dir, "aircraft")), _directives(spark, sf_dir), close_class_links).rows()


_LONGER = "(SELECT aircraft_id, role, make, CASE WHEN role = 'airframe' THEN model || 'X' ELSE model END AS model FROM components)"


@query(f"WITH {_MATCH}, {_CLASSES.format(source=_LONGER)} {_CLOSE_ROWS}")
def uncertain_identity(spark, sf_dir):
    """The same where each airframe's model has one letter more than a target's."""
    planes = bind(spark, sf_dir, "aircraft").withColumn("model", F.concat("model", F.lit("X")))
    return Applicability.of(fleet.components_long(planes), _directives(spark, sf_dir), close_class_links).rows()


@query(f"WITH {_MATCH}, {_CLASSES.format(source=_LONGER)} SELECT DISTINCT aircraft_id, directive_id FROM c JOIN n USING (role) WHERE aircraft_id % 100 = 0 AND ({_CLOSE})")
def uncertain_for_searched(spark, sf_dir):
    """As pairs, for the query set of aircraft whose id is divisible by 100, against all directives."""
    searched = bind(spark, sf_dir, "aircraft").where("aircraft_id % 100 = 0").withColumn("model", F.concat("model", F.lit("X")))
    return fleet.uncertain_components(fleet.components_long(searched), _directives(spark, sf_dir))


_REMOVED = "CASE WHEN role = 'engine' AND aircraft_id % 4 = 1 OR role = 'airframe' AND make = 'Brand#3' THEN DATE '2020-01-31' END"


@query(f"""WITH {_MATCH}, {_CLASSES.format(source=f"(SELECT *, {_REMOVED} AS removed_at FROM components) WHERE removed_at IS NULL")}
    {_LINK_ROWS} (tm = '' OR tm = cm) AND (td = '' OR td = cd)""")
def applicability_classes(spark, sf_dir):
    """Classes of installed components and the classes of targets that fit them; removed components fit nothing."""
    parts = fleet.components_long(bind(spark, sf_dir, "aircraft")).withColumn("removed_at", F.expr(_REMOVED))
    return Applicability.of(installed(parts), _directives(spark, sf_dir)).counts()


@query(f"""
    WITH d AS (SELECT *, {_STATUS} AS st, {_KEY} AS target_key FROM directives),
         g AS (SELECT target_key, count(DISTINCT CASE WHEN st = 'current' THEN directive_id END) AS directives, count(DISTINCT ad_number) AS publications,
                      CAST(sum(strlen(directive_id || '|' || ad_number || '|' || title)) AS BIGINT) AS source_bytes, count(*) FILTER (st = 'in_review') AS o FROM d GROUP BY target_key)
    SELECT target_key, directives, publications, source_bytes, CASE WHEN o > 0 THEN 'degraded' WHEN directives = 0 THEN 'pending' ELSE 'current' END AS status FROM g""")
def coverage_sets(spark, sf_dir):
    return fleet.coverage_sets(_directives(spark, sf_dir))


@query(f"""
    WITH {_COMPONENTS}, v AS (SELECT DISTINCT CASE product_type WHEN 'Aircraft' THEN 'airframe' ELSE lower(product_type) END AS role, make FROM directives WHERE make IS NOT NULL AND size > 48),
    g AS (SELECT aircraft_id, count(*) AS components, count(*) FILTER (v.role IS NULL) AS n, string_agg(c.role, ',' ORDER BY c.role) FILTER (v.role IS NULL) AS gaps
          FROM components c LEFT JOIN v ON v.role = c.role AND v.make = c.make GROUP BY aircraft_id)
    SELECT aircraft_id, components, coalesce(gaps, '') AS gaps, CASE WHEN n = 0 THEN 'current' WHEN n < components THEN 'degraded' ELSE 'not_resolved' END AS status FROM g""")
def coverage_status(spark, sf_dir):
    role = F.when(F.col("product_type") == "Aircraft", "airframe").otherwise(F.lower("product_type"))
    covered = bind(spark, sf_dir, "directives").where("make is not null and size > 48").select(role.alias("role"), "make").distinct()
    return fleet.coverage_status(fleet.components_long(bind(spark, sf_dir, "aircraft")), covered)


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9-][a-z0-9-]+')), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'all', 'model'))"
_EVIDENCE = f"""{_MATCH}, pairs AS (SELECT DISTINCT aircraft_id, directive_id FROM hits),
    e AS (SELECT DISTINCT aircraft_id, entry_id, line_no, entry_date, quantity, body, {_WORDS.format('body')} AS w FROM entries WHERE review_status = 'verified'),
    k AS (SELECT directive_id, ad_number, {_WORDS.format('title')} AS tw, {_WORDS.format("concat_ws(' ', make, model)")} AS pw,
                 ['comply', 'complied', 'compliance', 'inspect', 'inspection', 'replace', 'replaced', 'modify', 'modified', 'polish', 'tighten'] AS aw FROM directives),
    s AS (SELECT aircraft_id, directive_id, entry_id, line_no, entry_date, quantity,
                 CASE WHEN contains(body, ' AD ' || ad_number) THEN CASE line_no % 4 WHEN 0 THEN 'complied' WHEN 1 THEN 'inspected' ELSE 'not_applicable' END END AS disposition,
                 least(950, CASE WHEN NOT contains(body, ad_number) THEN 0 WHEN line_no % 4 < 2 THEN 820 ELSE 450 END + least(160, 40 * len(list_intersect(w, pw)))
                     + least(180, 40 * len(list_intersect(w, aw))) + least(100, 25 * len(list_intersect(w, tw)))) AS points
          FROM pairs JOIN e USING (aircraft_id) JOIN k USING (directive_id)),
    evidence AS (SELECT * EXCLUDE (points), CAST(points / 1000 AS DECIMAL(4,3)) AS confidence,
                        row_number() OVER (PARTITION BY aircraft_id, directive_id ORDER BY points DESC, entry_date DESC, entry_id DESC, line_no DESC, quantity DESC) AS place FROM s WHERE points >= 200)"""


def _facts(spark, sf_dir):
    """Directives with what their extraction says of products, actions and intervals."""
    d = bind(spark, sf_dir, "directives")
    return d.withColumns({
        "products": F.array_compact(F.array("make", "model")), "actions": F.when(F.col("directive_id") % 7 != 0, F.array(F.lit("Polish and tighten"))),
        "intervals": F.when(F.col("size") > 40, F.array(F.lit("100 hours"))), "structured_intervals": F.col("size") > 45,
    })


@query(f"WITH {_EVIDENCE} SELECT * FROM evidence WHERE place <= 5".replace("'polish', 'tighten'] AS aw", "'polish', 'tighten'][:CASE WHEN directive_id % 7 = 0 THEN 9 ELSE 11 END] AS aw"))
def evidence_rank(spark, sf_dir):
    return fleet.candidate_evidence(bind(spark, sf_dir, "entries"), _facts(spark, sf_dir), _applicability(spark, sf_dir))


_STATE = """
    SELECT aircraft_id, arg_max(kind, (event_time, event_id)) AS last_kind, max(event_time) AS last_time,
           CASE WHEN arg_max(kind, (event_time, event_id)) = 'completed' THEN 'current' ELSE 'pending_recomputation' END AS status
    FROM events_state WHERE kind <> 'other' GROUP BY aircraft_id"""


@query(_STATE)
def matcher_status(spark, sf_dir):
    return jobs.matcher_status(bind(spark, sf_dir, "events_state"))


@query(_STATE)
def stream_status(spark, sf_dir):
    """The same by Structured Streaming over the event files, into the cluster's shared folder."""
    root = shared_folder(spark, "stream")
    from tarmac.plans.bindings import BINDINGS

    stream = status.event_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events"))
    bound = spark.sql(BINDINGS["events_state"], events=stream)
    status.run_available(status.stream_matcher_status(bound), f"{root}/checkpoint", f"{root}/out")
    last = status.latest_of(spark.read.parquet(f"{root}/out"), "aircraft_id").select("aircraft_id", F.col("last.kind").alias("last_kind"), F.col("last.event_time").alias("last_time"))
    return last.withColumn("status", F.when(F.col("last_kind") == "completed", "current").otherwise("pending_recomputation"))


_IDS = "a AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)"


def _ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("year(o_orderdate) = 1997").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))


@query(f"""WITH {_IDS} SELECT wanted, found, CASE WHEN found >= 0.98 * wanted THEN 'PASS' WHEN found >= 0.85 * wanted THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict
    FROM (SELECT count(*) AS wanted, count(b.id) AS found FROM a LEFT JOIN b ON a.id = b.id)""")
def source_coverage(spark, sf_dir):
    return jobs.id_coverage(*_ids(spark, sf_dir))


@query(f"WITH {_IDS} SELECT id FROM a WHERE id NOT IN (SELECT id FROM b) ORDER BY id LIMIT 20")
def source_gap_sample(spark, sf_dir):
    """The report's first 20 missing ids."""
    return jobs.gap_sample(*_ids(spark, sf_dir))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT supersedes AS old, ad_number AS new FROM edges WHERE ad_number <> supersedes),
    chain AS (SELECT old, new, CAST(1 AS BIGINT) AS steps FROM e UNION ALL SELECT c.old, e.new, c.steps + 1 FROM chain c JOIN e ON e.old = c.new)
    SELECT old AS ad_number, new AS effective, max(steps) AS steps FROM chain WHERE new NOT IN (SELECT old FROM e) GROUP BY old, new""")
def effective_directives(spark, sf_dir):
    return jobs.effective_directives(bind(spark, sf_dir, "edges"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_violations(spark, sf_dir):
    return jobs.key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT conv_id AS span_id, turn AS correction_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS correction_order,
    turn = max(turn) OVER (PARTITION BY conv_id) AS in_effect FROM conversations""")
def correction_order(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("span_id"), F.col("turn").alias("correction_id"), F.col("turn").alias("created"))
    return jobs.correction_order(rows).drop("created")


_SPANS = """
    l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, len(string_split(text, chr(10))) AS n FROM documents),
    spans AS (SELECT doc_id AS page_id, line_no, CASE WHEN line_no % 5 = 4 THEN 'TABLE' ELSE 'LINE' END AS span_type, line_no * 1000 // n AS center, (doc_id + line_no) % 100 AS confidence FROM l)"""


@query(f"""WITH {_SPANS} SELECT page_id, count(*) FILTER (span_type = 'LINE') AS lines, count(*) FILTER (span_type <> 'LINE') AS tables,
    count(*) FILTER (span_type = 'LINE' AND confidence < 80) AS to_correct, CAST(sum(CASE WHEN span_type = 'LINE' THEN confidence END) AS BIGINT) AS confidence_sum,
    CAST(round_even(CAST(avg(CASE WHEN span_type = 'LINE' THEN confidence END) AS DECIMAL(18,9)), 3) AS DECIMAL(9,3)) AS confidence,
    string_agg(DISTINCT span_type, ',' ORDER BY span_type) AS types FROM spans GROUP BY page_id""")
def span_stats(spark, sf_dir):
    return jobs.span_stats(jobs.page_spans(table(spark, sf_dir, "documents")))


@query(f"""WITH {_SPANS}, w AS (SELECT page_id, line_no, center, lag(center) OVER p AS before, lead(center) OVER p AS after FROM spans WHERE line_no % 3 = 0 WINDOW p AS (PARTITION BY page_id ORDER BY center, line_no)),
    x AS (SELECT page_id, line_no AS anchor, greatest(0, center - 140, coalesce((before + center) // 2, 0)) AS lo, coalesce(after - 20, 1000) AS h FROM w)
    SELECT x.page_id, anchor, count(*) AS spans, min(line_no) AS first_line, max(line_no) AS last_line FROM x JOIN spans s ON s.page_id = x.page_id AND center >= lo AND center < greatest(lo, h) GROUP BY x.page_id, anchor""")
def anchor_clusters(spark, sf_dir):
    spans = jobs.page_spans(table(spark, sf_dir, "documents"))
    return jobs.anchor_clusters(spans, spans.where("line_no % 3 = 0"))


_ISSUES = """SELECT {columns}, max(payload) AS payload FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'applicability_missing' WHEN 1 THEN 'target_applicability_stale' WHEN 2 THEN 'ad_extraction_missing' ELSE 'other' END AS issue_type,
    p_size AS directive_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey % 50 END AS publication_id, CASE WHEN p_size % 2 = 0 THEN p_size END AS target_id, CAST(NULL AS BIGINT) AS source_snapshot_id,
    CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 7 END AS aircraft_id, {payload} AS payload FROM part WHERE {where}) GROUP BY ALL"""
_SIGNATURE = ", ".join(jobs.SIGNATURE)


@query(f"""WITH o AS ({_ISSUES.format(columns=_SIGNATURE, payload="p_name", where="p_partkey % 4 <> 3 AND p_brand <> 'Brand#11'")}),
    f AS ({_ISSUES.format(columns=_SIGNATURE, payload="CASE WHEN p_type LIKE 'PROMO%' THEN p_type ELSE p_name END", where="p_brand <> 'Brand#22'")})
    SELECT {", ".join(f"CASE WHEN f.issue_type IS NULL THEN o.{k} ELSE f.{k} END AS {k}" for k in jobs.SIGNATURE)},
           CASE WHEN o.issue_type IS NULL THEN 'opened' WHEN f.issue_type IS NULL THEN 'resolved' WHEN o.payload = f.payload THEN 'unchanged' ELSE 'updated' END AS action
    FROM o FULL JOIN f ON {" AND ".join(f"o.{k} IS NOT DISTINCT FROM f.{k}" for k in jobs.SIGNATURE)}""")
def reconciliation_diff(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    kind = F.get(F.array(*map(F.lit, ("applicability_missing", "target_applicability_stale", "ad_extraction_missing", "other"))), (F.col("p_partkey") % 4).cast("int"))
    none = F.lit(None).cast("long")
    p = p.withColumns({"issue_type": kind, "directive_id": size, "publication_id": F.when(size % 3 != 0, F.col("p_partkey") % 50), "target_id": F.when(size % 2 == 0, size), "source_snapshot_id": none, "aircraft_id": F.when(F.col("p_partkey") % 9 == 0, F.col("p_partkey") % 7), "severity": F.lit("medium")})
    found = p.withColumn("payload", F.when(F.col("p_type").startswith("PROMO"), F.col("p_type")).otherwise(F.col("p_name")))
    return jobs.issue_diff(p.withColumn("payload", F.col("p_name")).where("p_brand <> 'Brand#11'"), found.where("p_brand <> 'Brand#22'"))


@query("""SELECT entry_id, count(*) AS entries, count(*) FILTER (review_status = 'verified') AS verified, max(entry_date) AS last_date,
    CASE WHEN count(*) = count(*) FILTER (review_status = 'verified') THEN 'complete' ELSE 'awaiting_review' END AS status FROM entries GROUP BY entry_id""")
def job_completion(spark, sf_dir):
    return jobs.job_completion(bind(spark, sf_dir, "entries"))


@query(f"""WITH {_MATCH}, d AS (SELECT directive_id FROM directives WHERE size > 45)
    SELECT DISTINCT aircraft_id, directive_id FROM (SELECT aircraft_id, directive_id FROM hits UNION ALL SELECT aircraft_id, part_id FROM entries) JOIN d USING (directive_id)""")
def affected_aircraft(spark, sf_dir):
    subs = bind(spark, sf_dir, "entries").select("aircraft_id", F.col("part_id").alias("directive_id"))
    changed = _directives(spark, sf_dir).where("size > 45")
    # Only the changed directives are paired with aircraft.
    return jobs.affected_aircraft(_applicability(spark, sf_dir, changed), subs, changed.select("directive_id"))


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_feed(spark, sf_dir):
    """The 100 newest events of one kind: a top-k report."""
    return jobs.recent_feed(table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "event_type", "ts"), 100, "ts", "event_id")


@query("SELECT o_orderstatus AS status, count(*) AS reviews, count(*) FILTER (o_orderpriority = '1-URGENT') AS pending, min(o_orderkey) AS oldest FROM orders GROUP BY o_orderstatus")
def review_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"))
    return o.agg(F.count("*").alias("reviews"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("pending"), F.min("o_orderkey").alias("oldest"))


@query("""SELECT c_custkey, CASE WHEN x = '' THEN 'unknown' ELSE substr(x, 1, 128) END AS tag FROM (
    SELECT c_custkey, regexp_replace(regexp_replace(trim(c_name || ' / ' || c_mktsegment || '!'), '[^A-Za-z0-9_.:/=+@-]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM customer)""")
def tags(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.tag_value(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!")), "unknown").alias("tag"))


@query("SELECT aircraft_id, max(entry_date) AS last_entry, count(*) AS entries, min(coalesce(line_no, 999999)) AS first_line FROM entries GROUP BY aircraft_id")
def logbook_last_entries(spark, sf_dir):
    return bind(spark, sf_dir, "entries").groupBy("aircraft_id").agg(F.max("entry_date").alias("last_entry"), F.count("*").alias("entries"), F.min(F.coalesce("line_no", F.lit(999999))).alias("first_line"))
