"""Registered queries of binary files, match inputs and states, partitions, recognised pages, whole drafts, lists and coverage costs, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tarmac.operators import coverage, drafts, fleet, matching, worklists
from tarmac.operators.recognise import Recogniser, recognise
from tarmac.plans.bindings import bind, table
from tarmac.plans.queries import _COMPONENTS, _REMOVED, query
from tarmac.sources.binary import scan_ranges
from tarmac.streaming.folders import shared_folder


@query("SELECT ad_number AS id, count(*) AS found FROM directives GROUP BY ad_number")
def id_scan_ranges(spark, sf_dir):
    """Identifiers in UTF-16 files, read in ranges of 8 KiB; each is found as often as it was written."""
    path = shared_folder(spark, "binary")
    text = bind(spark, sf_dir, "directives").select(F.concat_ws(" ", "title", F.lit("AD"), "ad_number", F.lit("end")))
    text.write.option("encoding", "UTF-16LE").csv(path)
    return scan_ranges(spark, path, range_bytes=8 << 10).groupBy("id").agg(F.count("*").alias("found"))


@query("SELECT o_custkey AS directive_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS extraction_id, max(o_orderdate) AS created_at FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def newest_extractions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return matching.newest_approved(o.select(F.col("o_custkey").alias("directive_id"), F.col("o_orderkey").alias("extraction_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("needs_review").alias("status"))).drop("status")


_SUMS = " || '-' || ".join(f"CAST(sum(CAST(concat('0x', substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4))
_TEXT = "CAST({} AS VARCHAR)"


@query(f"""WITH {_COMPONENTS}, p AS (SELECT aircraft_id, sha256(CAST(json_object('id', aircraft_id || '-' || role, 'make', make, 'model', model, 'role', role, 'serial', serial, 'type', 'installed') AS VARCHAR)) AS h FROM components WHERE ({_REMOVED}) IS NULL),
    e AS (SELECT aircraft_id, sha256(CAST(json_object('date', CAST(entry_date AS VARCHAR), 'description', body, 'id', CAST(entry_id AS VARCHAR), 'rawText', CAST(line_no AS VARCHAR), 'reviewStatus', review_status) AS VARCHAR)) AS h FROM entries),
    ps AS (SELECT aircraft_id, count(*) || '-' || {_SUMS} AS parts FROM p GROUP BY 1), es AS (SELECT aircraft_id, count(*) || '-' || {_SUMS} AS said FROM e GROUP BY 1),
    m AS (SELECT DISTINCT aircraft_id, part_id AS directive_id FROM entries)
    SELECT m.aircraft_id, m.directive_id, sha256(CAST(json_object(
        'aircraft', CAST(json_object('engineMake', engine_make, 'engineModel', engine_model, 'id', CAST(m.aircraft_id AS VARCHAR), 'make', a.make, 'model', a.model, 'propellerMake', propeller_make, 'propellerModel', NULL, 'serial', serial) AS VARCHAR),
        'components', parts, 'entries', said, 'extraction', CAST(json_object('id', CAST(m.directive_id AS VARCHAR), 'inputContentHash', md5(title), 'output', title) AS VARCHAR),
        'selected', CAST(json_object('componentId', m.aircraft_id || '-airframe', 'targetApplicabilityId', CASE WHEN m.directive_id % 2 = 0 THEN CAST(m.directive_id AS VARCHAR) END) AS VARCHAR)) AS VARCHAR)) AS input_hash
    FROM m JOIN aircraft a USING (aircraft_id) JOIN directives d USING (directive_id) LEFT JOIN ps USING (aircraft_id) LEFT JOIN es USING (aircraft_id)""")
def input_hashes(spark, sf_dir):
    """The digest of what each match is made from, whatever the order of components and entries."""
    planes, e, d = bind(spark, sf_dir, "aircraft"), bind(spark, sf_dir, "entries"), bind(spark, sf_dir, "directives")
    parts = fleet.components_long(planes).withColumns({"component_id": F.concat_ws("-", "aircraft_id", "role"), "type": F.lit("installed"), "removed_at": F.expr(_REMOVED)})
    k = F.col("directive_id")
    m = e.select("aircraft_id", F.col("part_id").alias("directive_id")).distinct().withColumns({"component_id": F.concat("aircraft_id", F.lit("-airframe")), "target_id": F.when(k % 2 == 0, k)})
    said = e.select("aircraft_id", "entry_id", "entry_date", F.col("body").alias("description"), F.col("line_no").alias("raw_text"), "review_status")
    return matching.input_hashes(m, planes.withColumn("propeller_model", F.lit(None).cast("string")), parts, said, d.select(k, k.alias("extraction_id"), F.md5("title").alias("content_hash"), F.col("title").alias("output")))


_ALGORITHM = "CASE WHEN part_id % 5 = 0 THEN 'other' ELSE 'rules' END"
_VERSION = "CASE WHEN aircraft_id % 3 = 0 THEN '1' ELSE '2' END"
_CURRENT = "review_status = 'verified' AND aircraft_id % 4 <> 1"


@query(f"""WITH m AS (SELECT aircraft_id, count(*) FILTER ({_VERSION} = '2' AND {_CURRENT}) AS matches, bool_or({_VERSION} <> '2' OR NOT ({_CURRENT})) AS stale FROM entries WHERE {_ALGORITHM} = 'rules' AND aircraft_id % 7 <> 0 GROUP BY aircraft_id),
    l AS (SELECT aircraft_id, arg_max(kind, (event_time, event_id)) AS kind, arg_max(event_id % 2 = 0, (event_time, event_id)) AS ours FROM events_state WHERE kind <> 'other' GROUP BY aircraft_id)
    SELECT aircraft_id, coalesce(matches, 0) AS matches, CASE WHEN matches > 0 OR (kind = 'completed' AND ours) THEN 'current' WHEN kind = 'invalidated' OR stale THEN 'pending_recomputation' ELSE 'not_run' END AS status
    FROM aircraft LEFT JOIN m USING (aircraft_id) LEFT JOIN l USING (aircraft_id)""")
def matcher_states(spark, sf_dir):
    """Each aircraft's state from its matches, their algorithm and version, and its last event."""
    m = bind(spark, sf_dir, "entries").where("aircraft_id % 7 <> 0").select("aircraft_id", F.expr(_ALGORITHM).alias("algorithm_name"), F.expr(_VERSION).alias("algorithm_version"), F.expr(_CURRENT).alias("is_current"))
    e = bind(spark, sf_dir, "events_state").withColumns({"algorithm_name": F.lit("rules"), "algorithm_version": F.when(F.col("event_id") % 2 == 0, "2").otherwise("1")})
    return matching.matcher_states(bind(spark, sf_dir, "aircraft"), m, e, "rules", "2")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(chr(31) || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, doc_id FROM documents))
    SELECT lang, doc_id, CASE WHEN place <= round(n * 25 / 100) THEN 'refinement' WHEN place <= round(n * 75 / 100) THEN 'ingestion' ELSE 'holdout' END AS partition FROM r""")
def partition_pages(spark, sf_dir):
    """Documents of each language dealt to parts of 25, 50 and 25 per cent."""
    pages = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return matching.partitions(pages, {"refinement": 25, "ingestion": 50, "holdout": 25}, ["doc_id"], ["lang"])


@query("""WITH a AS (SELECT o_custkey AS item, count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1)
    SELECT coalesce(item, c_custkey) AS item, CASE WHEN item IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unknown' ELSE 'twice' END AS fault FROM a FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0) ON item = c_custkey WHERE item IS NULL OR c_custkey IS NULL OR n > 1""")
def partition_faults(spark, sf_dir):
    assigned = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("partition"))
    return matching.partition_faults(assigned, table(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("item")), ["item"])


def _title_lines(page: dict) -> dict:
    """A recogniser for the query: the page's headings as lines; it can't read every eleventh page."""
    if page["page_id"] % 11 == 0:
        raise ValueError("unreadable")
    heads = re.findall(r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", page["content"] or "")
    spans = [{"text": h, "span_type": "LINE", "top": i / 100, "confidence": 90.0, "reading_order": i} for i, h in enumerate(heads)]
    return {"width_px": 100, "height_px": 200, "confidence": 90.0 if spans else None, "spans": spans}


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<h[1-6][^>]*>(.*?)</h[1-6]>', 1, 's') AS heads FROM pages)
    SELECT page_id, CASE WHEN page_id % 11 = 0 AND page_id % 3 <> 0 THEN 'failed' ELSE 'recognised' END AS status, page_id % 3 = 0 AS cached, CASE WHEN page_id % 3 = 0 THEN 'kept' WHEN page_id % 11 <> 0 THEN array_to_string(heads, '|') END AS text,
           CASE WHEN page_id % 11 = 0 AND page_id % 3 <> 0 THEN 'ValueError: unreadable' END AS error FROM h""")
def recognised_pages(spark, sf_dir):
    """Pages through a plug-in: every third comes from the cache, some fail with a row of their own."""
    pages, tool = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")), Recogniser(_title_lines, "headings", "1")
    span = F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in (("text", "kept", "string"), ("span_type", "LINE", "string"), ("left", 0, "double"), ("top", 0, "double"), ("width", 1, "double"), ("height", 1, "double"), ("confidence", 90, "double"), ("reading_order", 0, "int"))))
    done = pages.where("page_id % 3 = 0").select(
        "page_id", F.lit("headings").alias("provider"), F.lit("1").alias("version"), F.lit("").alias("configuration"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), F.lit("recognised").alias("status"),
        F.lit(100).alias("width_px"), F.lit(200).alias("height_px"), F.lit(0.0).alias("rotation_degrees"), F.lit(90.0).alias("confidence"), F.array(span).alias("spans"), F.lit(None).cast("string").alias("error"),
    )
    out = recognise(pages, tool, ["page_id"], done)
    return out.select("page_id", "status", "cached", F.when(F.col("status") == "recognised", F.array_join(F.transform("spans", lambda s: s["text"]), "|")).alias("text"), "error")


# Pages of a logbook: for each bound line a dated line with a meter, below it what was done (on even lines in the right column), and on every third a mechanic's stamp; a heading, and on every fifth page a table.
_SLOTS = "SELECT entry_id AS page_id, line_no AS k, CAST(max(quantity) AS INT) AS q, max(part_id) AS part_id, max(entry_date) AS day FROM {entries} WHERE line_no > 0 GROUP BY entry_id, line_no"


def _page_spans(spark, sf_dir):
    # Dealt out by pages once, so that neither lines nor spans of a page move again.
    lines = bind(spark, sf_dir, "entries").select("entry_id", "line_no", "quantity", "part_id", "entry_date").repartition("entry_id")
    slots = spark.sql(_SLOTS, entries=lines)
    k, none = F.col("k"), F.lit(None).cast("double")
    at = lambda more: (k * 12 + more).cast("double") / 100

    def span(i, kind, text, left, top, confidence=none, corrected=F.lit(False)):
        columns = {"span_id": i, "span_type": F.lit(kind), "text": text, "left": left, "top": top, "width": F.lit(0.2), "height": F.lit(0.02), "reading_order": i, "confidence": confidence, "corrected": corrected}
        return F.struct(*((c if not isinstance(c, float) else F.lit(c)).alias(n) for n, c in columns.items()))

    low, sure = F.lit(0.05), (F.col("part_id") % 100).cast("double")
    rows = F.array_compact(F.array(
        span(10 * k + 1, "LINE", F.concat(F.date_format("day", "M/d/yyyy"), F.lit(" Tach "), F.col("q") + 1000), low, at(0), sure),
        span(10 * k + 2, "LINE", F.concat(F.lit("inspected filter "), "part_id"), F.when(k % 2 == 0, 0.5).otherwise(low), at(3), none, F.col("part_id") % 4 == 0),
        F.when(k % 3 == 0, span(10 * k + 3, "REGION_TEXT", F.lit("Jane Doe A&P 77"), low, at(5))),
        span(10 * k + 4, "LINE", F.lit(" Tach "), low, at(6)), F.when(F.col("page_id") % 5 == 0, span(10 * k + 5, "TABLE", F.lit("a table"), low, at(0))),
    ))
    return slots.select("page_id", F.explode_outer(rows).alias("s")).select("page_id", "s.*")


_PAGE_SPANS = f"""s AS ({_SLOTS.format(entries='entries')}), sp AS (
        SELECT page_id, k, 10 * k + 1 AS span_id, TRUE AS anchor, CAST(0.05 AS DOUBLE) AS l, CAST(12 * k AS DOUBLE) / 100 AS t, CAST(part_id % 100 AS DOUBLE) AS c FROM s
        UNION ALL SELECT page_id, k, 10 * k + 2, FALSE, CAST(CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.05 END AS DOUBLE), CAST(12 * k + 3 AS DOUBLE) / 100, NULL FROM s
        UNION ALL SELECT page_id, k, 10 * k + 3, FALSE, CAST(0.05 AS DOUBLE), CAST(12 * k + 5 AS DOUBLE) / 100, NULL FROM s WHERE k % 3 = 0),
    pg AS (SELECT page_id, count(*) AS anchors, (page_id % 5 = 0 OR bool_or(k % 3 = 0)) AND bool_or(k % 2 = 0) AS split FROM s GROUP BY page_id),
    y AS (SELECT *, t + CAST(0.02 AS DOUBLE) / 2 AS cy FROM sp JOIN pg USING (page_id)),
    b AS (SELECT page_id, k AS ak, span_id AS aid, cy AS acy, row_number() OVER w - 1 AS cluster, greatest(CAST(0 AS DOUBLE), t - CAST(0.14 AS DOUBLE), coalesce(lag(cy) OVER w + (cy - lag(cy) OVER w) / 2, 0)) AS lo, lead(cy) OVER w AS after
          FROM y WHERE anchor AND NOT split AND anchors > 1 WINDOW w AS (PARTITION BY page_id ORDER BY cy)),
    cl AS (SELECT page_id, CAST(k % 2 = 0 AND span_id % 10 = 2 AS INT) AS cluster, span_id, k, c FROM y WHERE split UNION ALL SELECT page_id, 0, span_id, k, c FROM y WHERE NOT split AND anchors <= 1
        UNION ALL SELECT page_id, cluster, span_id, k, c FROM y JOIN b USING (page_id) WHERE span_id = aid OR (cy >= lo AND cy < CASE WHEN after IS NULL THEN 1 ELSE greatest(lo, after - CAST(0.02 AS DOUBLE)) END))"""


@query(f"WITH {_PAGE_SPANS} SELECT page_id, CAST(cluster AS INT) AS cluster, span_id FROM cl")
def draft_clusters(spark, sf_dir):
    """Spans of each draft: two columns of a page with a table, stretches between dated lines elsewhere."""
    return drafts.span_clusters(_page_spans(spark, sf_dir)).select("page_id", "cluster", "span_id")


_DRAFT_LINES = """, ln AS (SELECT cl.page_id, cluster, span_id, cl.c, span_id % 10 AS what, day, q, part_id, CASE span_id % 10 WHEN 2 THEN 'inspected filter ' || part_id WHEN 3 THEN 'Jane Doe A&P 77' END AS text FROM cl JOIN s ON s.page_id = cl.page_id AND s.k = cl.k),
    fst AS (SELECT page_id, cluster, min(span_id) FILTER (what = 1) AS a, min(span_id) AS h, min(span_id) FILTER (what = 3) AS stamp, min(c) AS confidence, arg_min(day, span_id) FILTER (what = 1) AS day, arg_min(q, span_id) FILTER (what = 1) AS q FROM ln GROUP BY ALL),
    dl AS (SELECT ln.page_id, ln.cluster, span_id, CASE WHEN what > 1 THEN text WHEN span_id <> a THEN strftime(ln.day, '%-m/%-d/%Y') END AS text FROM ln JOIN fst ON fst.page_id = ln.page_id AND fst.cluster = ln.cluster),
    de AS (SELECT page_id, cluster, string_agg(text, chr(10) ORDER BY i) AS description FROM (SELECT page_id, cluster, text, min(span_id) AS i FROM dl WHERE text IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {_PAGE_SPANS}{_DRAFT_LINES} SELECT page_id, CAST(cluster AS INT) AS cluster, day AS entry_date, day IS NOT NULL AS date_extracted, coalesce(description, '') AS description, CASE WHEN stamp IS NOT NULL THEN 'Jane Doe' END AS name, CASE WHEN stamp IS NOT NULL THEN 'A&P#77' END AS credential,
    CAST(1000 + q AS DOUBLE) AS tach_time, confidence, count(*) OVER (PARTITION BY page_id) > 1 AS requires_review FROM fst LEFT JOIN de USING (page_id, cluster)""")
def page_drafts(spark, sf_dir):
    """One row for each draft entry of a page, with all its fields."""
    d = drafts.draft_entries(_page_spans(spark, sf_dir))
    return d.select("page_id", "cluster", "entry_date", "date_extracted", "description", "performer.name", "performer.credential", "tach_time", "confidence", "requires_review")


@query(f"""WITH {_PAGE_SPANS}{_DRAFT_LINES}, ev AS (SELECT page_id, cluster, 'entry_date' AS field, coalesce(a, h) AS span_id, a IS NULL AS lacks FROM fst UNION ALL SELECT page_id, cluster, 'description', h, FALSE FROM fst
        UNION ALL SELECT page_id, cluster, unnest(['performer_name', 'performer_credential']), stamp, FALSE FROM fst WHERE stamp IS NOT NULL UNION ALL SELECT page_id, cluster, 'tach_time', a, FALSE FROM fst WHERE a IS NOT NULL)
    SELECT ev.page_id, CAST(ev.cluster AS INT) AS cluster, field, ev.span_id, CASE WHEN lacks THEN 'fallback' WHEN what = 2 AND part_id % 4 = 0 THEN 'correction' ELSE 'ocr_span' END AS evidence_type, c AS confidence
    FROM ev JOIN ln ON ln.page_id = ev.page_id AND ln.cluster = ev.cluster AND ln.span_id = ev.span_id""")
def draft_evidence(spark, sf_dir):
    """The span behind each field of each draft, by the field's own rule."""
    d = drafts.draft_entries(_page_spans(spark, sf_dir))
    return d.select("page_id", "cluster", F.explode("evidence").alias("e")).select("page_id", "cluster", "e.*")


@query("SELECT o_orderkey AS review_id, o_custkey AS extraction_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC")
def review_list(spark, sf_dir):
    """Open reviews, the newest first."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return worklists.listed(o.select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("extraction_id"), F.col("o_orderdate").alias("created_at")), "created_at", "review_id")


@query("SELECT directive_id, CASE WHEN size % 7 > 0 THEN CAST(DATE '2000-01-01' + CAST(size AS INT) AS DATE) END AS publication_date FROM directives ORDER BY publication_date DESC NULLS LAST, directive_id DESC")
def discovery_list(spark, sf_dir):
    """Discovered documents, the newest publication first, those without a date last."""
    size = F.col("size")
    return worklists.listed(bind(spark, sf_dir, "directives").select("directive_id", F.when(size % 7 > 0, F.date_add(F.lit("2000-01-01").cast("date"), size.cast("int"))).alias("publication_date")), "publication_date", "directive_id")


@query("""SELECT directive_id, concat_ws(chr(10), 'Title: ' || title, 'Abstract: ' || make, 'Excerpts: ' || model, 'Federal Register document number: ' || ad_number, CASE WHEN size % 2 = 0 THEN 'Publication date: 2001-02-03' END) AS source_text,
    concat_ws(chr(10) || chr(10), title, make, model) AS review_text FROM directives""")
def source_texts(spark, sf_dir):
    d = bind(spark, sf_dir, "directives").withColumn("day", F.when(F.col("size") % 2 == 0, F.lit("2001-02-03")))
    fields = {"Title": "title", "Abstract": "make", "Excerpts": "model", "Federal Register document number": "ad_number", "Publication date": "day"}
    return d.select("directive_id", worklists.labelled_text(fields).alias("source_text"), worklists.joined_text("title", "make", "model").alias("review_text"))


@query("""WITH l AS (SELECT l_suppkey AS coverage_id, sum(l_extendedprice) AS actual, sum(l_tax) AS allocated FROM lineitem GROUP BY 1),
    c AS (SELECT s_nationkey AS n, s_suppkey AS coverage_id FROM supplier), k AS (SELECT coverage_id, string_agg(n_name || '/' || c_custkey, ',' ORDER BY n_name, c_custkey) AS clients FROM c JOIN customer ON c_nationkey = n AND c_custkey % 3 = 0 JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
    SELECT coverage_id, CAST(coalesce(actual, 0) AS DECIMAL(18,6)) AS actual_cost, CAST(coalesce(allocated, 0) AS DECIMAL(18,6)) AS allocated_cost, coalesce(clients, '') AS clients FROM c LEFT JOIN l USING (coverage_id) LEFT JOIN k USING (coverage_id)""")
def coverage_cost_details(spark, sf_dir):
    """Per coverage its costs and its active clients by organisation and aircraft."""
    sets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("coverage_id"), "s_nationkey")
    ledger = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("coverage_id"), F.col("l_extendedprice").alias("actual_cost"), F.col("l_tax").alias("allocated_cost"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # Coverages of a nation share its clients.
    subs = c.select(F.col("c_nationkey").alias("group_id"), F.col("n_name").alias("organization_name"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("number"), F.col("c_custkey").alias("aircraft_id"), F.when(F.col("c_custkey") % 3 == 0, "active").otherwise("ended").alias("status"))
    named = lambda clients: F.array_join(F.transform(clients, lambda x: F.concat_ws("/", x["organization_name"], x["aircraft_id"].cast("string"))), ",")
    return coverage.cost_detail(sets.select("coverage_id"), ledger, subs, sets.select("coverage_id", F.col("s_nationkey").alias("group_id")), named)


@query("SELECT entry_id, line_no, part_id, entry_date, quantity, CASE WHEN part_id % 6 > 0 THEN CAST(round_even(part_id / 8, 2) AS DOUBLE) END AS tach_time FROM entries")
def rounded_times(spark, sf_dir):
    t = F.when(F.col("part_id") % 6 > 0, F.col("part_id") / 8)
    return bind(spark, sf_dir, "entries").select("entry_id", "line_no", "part_id", "entry_date", "quantity", worklists.round2(t).alias("tach_time"))
