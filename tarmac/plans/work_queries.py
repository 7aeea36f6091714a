"""Registered queries of lists, previews, page states, draft entries and small rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import entries as en
from tarmac.functions import text as tx
from tarmac.operators import applicability, fleet, jobs, worklists
from tarmac.operators.applicability import Applicability
from tarmac.operators.review import extract_with
from tarmac.plans.bindings import bind, table
from tarmac.plans.queries import _CLASSES, _CLOSE, _EVIDENCE, _MATCH, _applicability, _directives, _facts, evidence_rank, query


def _people(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("user_id"), F.col("c_nationkey").alias("organization_id"), F.when(k % 3 == 0, "owner_admin").when(k % 3 == 1, "owner").otherwise("mechanic").alias("role"), F.when(k % 4 == 0, "invited").otherwise("active").alias("status"))


@query("SELECT DISTINCT c_custkey AS user_id, c_nationkey AS organization_id FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 4 <> 0")
def owner_scope(spark, sf_dir):
    return worklists.owner_scope(_people(spark, sf_dir))


@query("SELECT DISTINCT c_custkey AS user_id, s_suppkey AS aircraft_id FROM customer JOIN nation ON n_nationkey = c_nationkey AND n_regionkey % 2 = 0 JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 5 <> 0 WHERE c_custkey % 4 <> 0")
def maintenance_scope(spark, sf_dir):
    orgs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("organization_id"), F.when(F.col("n_regionkey") % 2 == 0, "maintenance").otherwise("owner").alias("organization_type"))
    jobs_ = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("organization_id"), F.col("s_suppkey").alias("aircraft_id"), F.when(F.col("s_suppkey") % 5 == 0, "ended").otherwise("active").alias("status"))
    return worklists.maintenance_scope(_people(spark, sf_dir), orgs, jobs_)


@query("SELECT aircraft_id, make, model FROM aircraft WHERE contains(lower(number_raw || ' ' || make || ' ' || model), '12 brand')")
def aircraft_search(spark, sf_dir):
    return worklists.search(bind(spark, sf_dir, "aircraft"), " 12 BRAND ", "number_raw", "make", "model").select("aircraft_id", "make", "model")


@query("SELECT directive_id, title FROM directives WHERE starts_with(title, 'b')")
def title_prefix(spark, sf_dir):
    """Documents whose title begins with the wanted prefix; the filter reaches the scan."""
    return bind(spark, sf_dir, "directives").where(F.col("title").startswith("b")).select("directive_id", "title")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def order_page(spark, sf_dir):
    """The third page of 25, newest first: a top-k report."""
    return worklists.page_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), 3, 25, "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey AS job_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus IN ('O', 'F') ORDER BY o_orderdate, o_orderkey LIMIT 50")
def pending_work(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "failed").otherwise("complete")
    return worklists.pending_work(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), status.alias("status")), 50).select("job_id", "created_at")


@query("""WITH a AS (SELECT ad_number AS id FROM directives WHERE directive_id % 3 < 2), b AS (SELECT ad_number AS id FROM directives WHERE directive_id % 3 > 0),
    w AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS x, b.id IS NOT NULL AS y FROM a FULL JOIN b ON a.id = b.id), s AS (SELECT 'all' AS scope, * FROM w UNION ALL SELECT 'window', * FROM w WHERE CAST(substr(id, 1, 4) AS INT) BETWEEN 1950 AND 1970)
    SELECT scope, count(*) FILTER (x AND y) AS "both", count(*) FILTER (NOT y) AS only_a, count(*) FILTER (NOT x) AS only_b FROM s GROUP BY scope""")
def id_set_compare(spark, sf_dir):
    d = bind(spark, sf_dir, "directives").withColumnRenamed("ad_number", "id")
    return worklists.id_set_compare(d.where("directive_id % 3 < 2"), d.where("directive_id % 3 > 0"), 1950, 1970)


@query("""SELECT l_orderkey AS upload_id, l_linenumber AS page, CASE WHEN bool_or(l_suppkey % 3 > 0) THEN 'delegated' ELSE 'native' END AS provider FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def merged_pages(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("page"), "l_suppkey")
    side = lambda cond, name: p.where(cond).select("upload_id", "page", F.lit(name).alias("provider"))
    return worklists.merge_pages(side("l_suppkey % 3 < 2", "native"), side("l_suppkey % 3 > 0", "delegated"))


@query("""WITH l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i FROM documents), s AS (SELECT *, i % 5 = 4 AS t FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, t ORDER BY i) AS k FROM s)
    SELECT page_id, coalesce(string_agg(text, '|' ORDER BY i) FILTER (NOT t AND k <= 8), '') AS lines, count(*) FILTER (t AND k <= 20) AS structures FROM r GROUP BY page_id""")
def page_preview(spark, sf_dir):
    out = worklists.page_preview(jobs.page_spans(table(spark, sf_dir, "documents")).withColumn("reading_order", F.col("line_no")))
    return out.select("page_id", F.array_join("lines", "|").alias("lines"), F.size("structures").cast("long").alias("structures"))


@query("""WITH b AS (SELECT l_orderkey AS entry_id, l_suppkey % 4 AS page_id, count(*) AS spans, min(l_linenumber) AS "left", min(l_suppkey) AS top, max(l_linenumber + 2) AS "right", max(l_suppkey + 1) AS bottom FROM lineitem GROUP BY ALL)
    SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY spans DESC, page_id) AS k FROM b) WHERE k = 1""")
def candidate_region(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), (F.col("l_suppkey") % 4).alias("page_id"), F.col("l_linenumber").alias("left"), F.col("l_suppkey").alias("top"), (F.col("l_linenumber") + 2).alias("right"), (F.col("l_suppkey") + 1).alias("bottom"))
    return worklists.candidate_region(s)


def _spoken(spark, sf_dir):
    """Turns of conversations as spans, with corrections of every third one, twice."""
    c = table(spark, sf_dir, "conversations")
    span = F.concat_ws("-", "conv_id", "turn")
    spans = c.select(span.alias("span_id"), F.col("conv_id").alias("page_id"), F.concat(F.lit("said "), "role", F.lit(" "), "turn", F.lit(".")).alias("text"), F.col("turn").alias("reading_order"), (F.col("turn") * 10).alias("confidence"))
    fixed = c.where("turn % 3 = 0").select(span.alias("span_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("correction_order"), F.concat(F.lit("fixed "), "turn", F.lit(".")).alias("t"))
    return c, spans, fixed.select("span_id", "correction_order", F.concat("t", F.col("correction_order").cast("string")).alias("corrected_text"))


@query("""SELECT conv_id AS entry_id, string_agg('f' || (turn % 2) || ':' || CASE WHEN turn % 3 = 0 THEN 'fixed ' || turn || '.2' ELSE 'said ' || role || ' ' || turn || '.' END, '|' ORDER BY turn % 2, turn) AS chain, count(*) FILTER (turn % 3 = 0) AS corrected FROM conversations GROUP BY conv_id""")
def entry_lineage(spark, sf_dir):
    c, spans, fixed = _spoken(spark, sf_dir)
    evidence = c.select(F.col("conv_id").alias("entry_id"), F.concat_ws("-", "conv_id", "turn").alias("span_id"), F.col("turn").alias("evidence_id"), F.concat(F.lit("f"), F.col("turn") % 2).alias("field_name"), F.lit("ocr").alias("evidence_type"))
    out = worklists.entry_lineage(evidence, spans, fixed)
    return out.select("entry_id", F.array_join(F.transform("chain", lambda x: F.concat(x["field_name"], F.lit(":"), x["text"])), "|").alias("chain"), F.size(F.filter("chain", lambda x: x["corrected"])).cast("long").alias("corrected"))


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'fixed ' || turn || '.2' ELSE 'said ' || role || ' ' || turn || '.' END AS said FROM conversations), d AS (SELECT DISTINCT conv_id, unnest(['who', 'number', 'other']) AS field, unnest(['user', ' 0.', 'nowhere']) AS value FROM conversations),
    m AS (SELECT d.conv_id, field, value, min(turn) AS turn FROM d LEFT JOIN s ON s.conv_id = d.conv_id AND contains(said, value) GROUP BY ALL)
    SELECT conv_id AS draft_id, field, value, CASE WHEN turn IS NOT NULL THEN conv_id || '-' || turn END AS span_id, CASE WHEN turn IS NULL THEN 'fallback' WHEN turn % 3 = 0 THEN 'correction' ELSE 'ocr_span' END AS evidence_type, turn * 10 AS confidence FROM m""")
def field_evidence(spark, sf_dir):
    c, spans, fixed = _spoken(spark, sf_dir)
    fields = F.array(*(F.struct(F.lit(a).alias("field"), F.lit(b).alias("value")) for a, b in (("who", "user"), ("number", " 0."), ("other", "nowhere"))))
    drafts = c.select("conv_id").distinct().select(F.col("conv_id").alias("draft_id"), F.col("conv_id").alias("page_id"), F.explode(fields).alias("f")).select("draft_id", "page_id", "f.*")
    return worklists.field_evidence(drafts, spans, fixed)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i FROM documents), d AS (SELECT doc_id AS page_id, i // 4 AS cluster, coalesce(min(CASE WHEN i % 4 = 2 THEN i END), min(i)) AS anchor,
        CAST(sum(length(text) + 1) - 1 AS BIGINT) AS characters, count(*) AS lines, min((doc_id + i) % 100) AS confidence, bool_or(i % 4 = 2) AS has_anchor FROM l GROUP BY ALL)
    SELECT *, count(*) OVER (PARTITION BY page_id) > 1 AS requires_review FROM d""")
def draft_entries(spark, sf_dir):
    s = jobs.page_spans(table(spark, sf_dir, "documents")).select("page_id", F.floor(F.col("line_no") / 4).alias("cluster"), "line_no", "text", "confidence", (F.col("line_no") % 4 == 2).alias("is_anchor"))
    return worklists.draft_entries(s).withColumn("text", F.length("text").cast("long")).withColumnRenamed("text", "characters")


@query("SELECT l_orderkey AS page_id, count(*) FILTER (l_returnflag <> 'R') AS candidates, count(*) FILTER (l_returnflag = 'R') AS rejected FROM lineitem GROUP BY l_orderkey")
def candidate_counts(spark, sf_dir):
    return worklists.candidate_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("passed").alias("status")))


@query("SELECT provider, count(*) FILTER (pages > 10) AS passed, count(*) FILTER (pages <= 10) AS failed, CAST(sum(estimate) AS DECIMAL(18,6)) AS cost, CAST(sum(pages) AS BIGINT) AS seconds, string_agg(DISTINCT unit, ',' ORDER BY unit) AS routes FROM ocr_runs GROUP BY provider")
def evaluation_summary(spark, sf_dir):
    return worklists.evaluation_summary(bind(spark, sf_dir, "ocr_runs").select("provider", (F.col("pages") > 10).alias("passed"), F.col("estimate").alias("cost"), F.col("pages").alias("seconds"), F.col("unit").alias("route")))


@query("SELECT count(*) AS seen, count(*) FILTER (source_status = 'Current') AS Current, count(*) FILTER (source_status = 'Superseded') AS Superseded FROM directives")
def run_stats(spark, sf_dir):
    return worklists.run_stats(bind(spark, sf_dir, "directives"), "source_status", "Current", "Superseded")


@query("""SELECT o_custkey AS directive_id, arg_min(CAST(o_orderdate AS DATE), o_orderkey) FILTER (o_orderkey % 3 <> 0) AS publication_date, 'u' || min(o_orderkey) FILTER (o_orderkey % 4 = 1) AS url FROM orders GROUP BY o_custkey""")
def first_publication(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("directive_id"), k.alias("publication_id"), F.when(k % 3 != 0, F.col("o_orderdate").cast("date")).alias("publication_date"), F.when(k % 4 == 1, F.concat(F.lit(" u"), k)).when(k % 4 == 2, " ").alias("url"))
    return worklists.first_publication(p)


@query("""SELECT target_key, count(DISTINCT directive_id) AS publications, min(directive_id) AS first FROM (SELECT *, lower(trim(product_type)) || '|' || coalesce(lower(trim(make)), '') || '|' || coalesce(lower(trim(model)), '') AS target_key FROM directives) WHERE directive_id % 4 <> 0 GROUP BY target_key""")
def applicable_publications(spark, sf_dir):
    """Publications that a target reaches through its directives, each once."""
    d = _directives(spark, sf_dir)
    reached = d.select("target_key", "directive_id").join(d.where("directive_id % 4 <> 0").select("directive_id", F.col("directive_id").alias("publication_id")), "directive_id").select("target_key", "publication_id").distinct()
    return reached.groupBy("target_key").agg(F.count("*").alias("publications"), F.min("publication_id").alias("first"))


@query("WITH " + _EVIDENCE.strip().removeprefix("WITH") + """, m AS (SELECT DISTINCT aircraft_id, directive_id FROM hits), g AS (SELECT aircraft_id, directive_id, string_agg(entry_id, ',' ORDER BY place, entry_id) AS entries FROM evidence WHERE place <= 5 GROUP BY ALL)
    SELECT m.aircraft_id, m.directive_id, CASE WHEN directive_id % 2 = 0 THEN (directive_id + 1) || ',' || directive_id ELSE directive_id || ',' || (directive_id + 1) END AS publications, coalesce(entries, '') AS entries FROM m LEFT JOIN g USING (aircraft_id, directive_id)""")
def match_detail(spark, sf_dir):
    d, k = bind(spark, sf_dir, "directives"), F.col("directive_id")
    pubs = d.select(k, F.explode(F.array(F.struct(k.alias("publication_id"), F.when(k % 2 == 0, "federal_register").otherwise("drs").alias("source_system")), F.struct((k + 1).alias("publication_id"), F.when(k % 2 == 0, "drs").otherwise("federal_register").alias("source_system")))).alias("p")).select("directive_id", "p.*")
    out = worklists.match_detail(_applicability(spark, sf_dir), pubs, evidence_rank(spark, sf_dir))
    return out.select("aircraft_id", "directive_id", F.array_join("publications", ",").alias("publications"), F.coalesce(F.array_join("entries", ","), F.lit("")).alias("entries"))


@query(f"""WITH {_MATCH.strip()}, h AS (SELECT DISTINCT aircraft_id, directive_id FROM hits), p AS (SELECT DISTINCT aircraft_id, part_id AS directive_id FROM entries)
    SELECT aircraft_id, directive_id, CASE WHEN directive_id % 5 <> 0 THEN CASE WHEN h.aircraft_id IS NOT NULL THEN 'applicable' WHEN (aircraft_id + directive_id) % 3 = 0 THEN 'uncertain' ELSE 'skipped' END WHEN (aircraft_id + directive_id) % 2 = 0 THEN 'applicable' ELSE 'skipped' END AS decision
    FROM p LEFT JOIN h USING (aircraft_id, directive_id)""")
def applicability_decision(spark, sf_dir):
    p = bind(spark, sf_dir, "entries").select("aircraft_id", F.col("part_id").alias("directive_id")).distinct()
    both = F.col("aircraft_id") + F.col("directive_id")
    return fleet.applicability_decision(p, bind(spark, sf_dir, "directives").where("directive_id % 5 <> 0"), _applicability(spark, sf_dir).among(p), p.where(both % 3 == 0), p.where(both % 2 == 0))


_DECIDED = f"""WITH {_MATCH.strip()}, {_CLASSES.format(source='components')},
    p AS (SELECT DISTINCT aircraft_id, part_id AS directive_id FROM entries), s AS (SELECT directive_id FROM directives WHERE directive_id % 2 = 0),
    x AS (SELECT p.*, list_sort(list_distinct([y FOR y IN [lower(a.make), lower(a.model), lower(trim(a.engine_make)), lower(trim(a.engine_model)), lower(nullif(trim(a.propeller_make), ''))] IF y IS NOT NULL])) AS terms, [y FOR y IN [lower(d.make), lower(d.model)] IF y IS NOT NULL] AS products
          FROM p JOIN aircraft a USING (aircraft_id) JOIN directives d USING (directive_id)),
    w AS (SELECT aircraft_id, directive_id, len(products) = 0 OR len([1 FOR y IN products IF contains(array_to_string(terms, ' '), y) OR len([1 FOR z IN terms IF contains(y, z)]) > 0]) > 0 AS fits FROM x),
    u AS (SELECT DISTINCT aircraft_id, directive_id FROM p JOIN c USING (aircraft_id) JOIN n USING (directive_id) WHERE c.role = n.role AND ({_CLOSE})),
    h AS (SELECT DISTINCT aircraft_id, directive_id FROM hits)"""


@query(_DECIDED + " SELECT aircraft_id, directive_id FROM w WHERE fits")
def product_text_pairs(spark, sf_dir):
    """Of the pairs that an entry names, those whose products fit by their wording; a directive without products fits all."""
    p = bind(spark, sf_dir, "entries").select("aircraft_id", F.col("part_id").alias("directive_id"))
    return applicability.product_matches(p, bind(spark, sf_dir, "aircraft"), _facts(spark, sf_dir))


@query(_DECIDED + """ SELECT aircraft_id, directive_id, CASE WHEN directive_id IN (FROM s) THEN CASE WHEN h.aircraft_id IS NOT NULL THEN 'applicable' WHEN u.aircraft_id IS NOT NULL THEN 'uncertain' ELSE 'skipped' END WHEN fits THEN 'applicable' ELSE 'skipped' END AS decision
    FROM w LEFT JOIN h USING (aircraft_id, directive_id) LEFT JOIN u USING (aircraft_id, directive_id)""")
def applicability_decided(spark, sf_dir):
    """The decision for each pair that an entry names: by structured targets where the directive has any, else by its products' wording."""
    p = bind(spark, sf_dir, "entries").select("aircraft_id", F.col("part_id").alias("directive_id")).distinct()
    planes, d = bind(spark, sf_dir, "aircraft"), _directives(spark, sf_dir)
    targets, parts = d.where("directive_id % 2 = 0"), fleet.components_long(planes)
    hits, unsure = Applicability.of(parts, targets).among(p), Applicability.of(parts, targets, applicability.close_class_links).among(p)
    return fleet.applicability_decision(p, targets, hits, unsure, applicability.product_matches(p, planes, _facts(spark, sf_dir)))


@query(f"WITH {_MATCH.strip()} SELECT aircraft_id, directive_id, min(role) AS role, min(role) = 'airframe' AS serial_known FROM hits GROUP BY ALL")
def best_component(spark, sf_dir):
    return fleet.best_component(_applicability(spark, sf_dir), fleet.components_long(bind(spark, sf_dir, "aircraft")))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'content_type' WHEN doc_id % 5 = 0 THEN 'extension' WHEN source IS NULL OR doc_id % 7 = 0 THEN 'section' WHEN doc_id % 3 = 0 THEN 'consent_required' END AS issue FROM documents""")
def upload_issues(spark, sf_dir):
    k = F.col("doc_id")
    name = F.concat(F.lit("log.v2/scan"), k, F.when(k % 5 == 0, ".exe").when(k % 2 == 0, ".PDF").otherwise(".png"))
    section = F.when(F.col("source").isNotNull() & (k % 7 != 0), "airframe")
    issue = worklists.upload_issue(F.when(k % 4 == 0, "text/plain").otherwise("application/pdf"), name, section, k % 3 != 0, ("application/pdf", "image/png"), (".pdf", ".png"), ("airframe", "engine"))
    return table(spark, sf_dir, "documents").select("doc_id", issue.alias("issue"))


@query("""WITH v AS (SELECT o_custkey, arg_max(o_orderstatus <> 'P' AND o_orderkey % 5 <> 0, (o_orderdate, o_orderkey)) AS ok FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS job_id, coalesce(ok, FALSE) AS verified, CASE WHEN ok AND c_custkey % 100 < 80 THEN 'awaiting_corrections' WHEN ok THEN 'ready_for_extraction' ELSE 'uploaded' END AS status FROM customer LEFT JOIN v ON o_custkey = c_custkey""")
def job_states(spark, sf_dir):
    k = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), k.alias("verification_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "P").alias("order_ok"), (k % 5 != 0).alias("complete"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    return worklists.job_state(c.withColumn("status", F.lit("uploaded")), v, c.select("job_id", (F.col("job_id") % 100).alias("least")))


@query("""SELECT p_partkey, 'name' AS field, p_name AS old, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_name ELSE p_brand END AS new, CASE p_partkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'accepted' ELSE 'corrected' END AS decision FROM part
    UNION ALL SELECT p_partkey, 'size', CASE WHEN p_size % 2 = 0 THEN '' || p_size END, '' || p_size, CASE WHEN p_size % 2 = 0 THEN 'accepted' ELSE 'corrected' END FROM part""")
def review_outcome(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    after = p.select(k, F.when(k % 3 == 1, F.col("p_name")).when(k % 3 == 2, F.col("p_brand")).alias("name"), F.col("p_size").alias("size"))
    return worklists.review_outcome(p.select(k, F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size")), after, ["p_partkey"], ["name", "size"])


@query("""SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 2 = 0)""")
def supported_dates(spark, sf_dir):
    """Entries with evidence of an allowed type for their date."""
    field, kind = F.when(F.col("l_linenumber") == 2, "entry_date").otherwise("description"), F.when(F.col("l_suppkey") % 2 == 0, "ocr_span").otherwise("fallback")
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), field.alias("field"), kind.alias("type"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id")).join(evidence.where("field = 'entry_date' and type in ('ocr_span', 'correction')"), "entry_id", "left_semi")


@query("""SELECT l_orderkey AS entry_id, min(l_partkey) AS first_part, arg_min(l_linenumber, (l_partkey, l_linenumber)) AS line_no FROM lineitem GROUP BY l_orderkey""")
def source_evidence(spark, sf_dir):
    """The earliest evidence of each entry."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("first_part"), F.col("l_linenumber").alias("line_no"))  # noqa: E741
    return worklists.first_of(l, ["entry_id"], "first_part", "line_no")


_PAGE_CLASS = r"""c AS (SELECT doc_id AS page_id, doc_id % 4 AS shape, doc_id % 3 = 0 AS native, doc_id % 2 = 0 AS first, lower(coalesce(text, '')) AS low, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n FROM documents),
    f AS (SELECT *, regexp_matches(low, '\b(?:19|20)\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b') AS dated, regexp_matches(low, 'inspection|aircraft|engine|tach|hobbs|maintenance|repaired') AS work, CASE WHEN n = 0 THEN 'scanned' WHEN native THEN 'native_text' ELSE 'mixed' END AS routing_class FROM c),
    k AS (SELECT page_id, routing_class, CASE WHEN first AND n < 200 AND NOT dated THEN 'cover' WHEN dated OR work THEN 'logbook_entry' WHEN NOT first AND n > 0 THEN 'continuation' WHEN n = 0 THEN 'unknown' ELSE 'attachment' END AS role,
        concat_ws(',', CASE WHEN native THEN 'typed' ELSE 'text_mode_uncertain' END, 'continuation_sensitive', CASE shape WHEN 0 THEN 'side_by_side,landscape' WHEN 1 THEN 'portrait' || CASE WHEN routing_class = 'native_text' THEN '' ELSE ',orientation_unverified' END WHEN 2 THEN 'wide_layout,orientation_unverified' ELSE 'layout_uncertain' END,
            CASE WHEN page_id % 5 = 0 THEN 'rotated' END, CASE WHEN routing_class <> 'native_text' AND page_id % 50 < 25 THEN 'faint' END) AS attributes, CAST(CASE WHEN native THEN 0.80 ELSE 0.45 END AS DECIMAL(3,2)) AS confidence FROM f)"""


def _classes(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    aspect = F.when(k % 4 == 0, 2.2).when(k % 4 == 1, 0.8).when(k % 4 == 2, 1.5)
    return worklists.page_class(d.select(k.alias("page_id"), F.when(k % 2 == 0, 1).otherwise(2).alias("page_number"), F.lit(9).alias("page_count"), "text", (k % 3 == 0).alias("reliable"), aspect.alias("aspect"), (k % 50).alias("contrast"), F.when(k % 5 == 0, 90.0).alias("rotation")))


@query(f"WITH {_PAGE_CLASS} SELECT * FROM k")
def page_class(spark, sf_dir):
    return _classes(spark, sf_dir).withColumn("attributes", F.array_join("attributes", ","))


@query(f"""WITH {_PAGE_CLASS}, r AS (SELECT page_id, CASE WHEN contains(attributes, 'side_by_side') THEN 2 ELSE 1 END AS regions, concat_ws(',', CASE WHEN contains(attributes, 'orientation_unverified') THEN 'orientation_unverified' END, CASE WHEN routing_class = 'mixed' THEN 'routing_class_uncertain' END, CASE WHEN page_id % 6 = 0 THEN 'native_textract_disagreement' END) AS reasons FROM k)
    SELECT page_id, regions, reasons <> '' AS review, reasons FROM r""")
def extraction_plan(spark, sf_dir):
    out = worklists.extraction_plan(_classes(spark, sf_dir), F.when(F.col("page_id") % 6 == 0, 0.5).otherwise(0.9))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT directive_id, CASE directive_id % 3 WHEN 0 THEN ad_number WHEN 1 THEN ad_number ELSE array_to_string(list_sort(['1999-01-02', ad_number]), ',') END AS numbers FROM directives""")
def rule_numbers(spark, sf_dir):
    n, k = F.col("ad_number"), F.col("directive_id")
    docket = F.concat(F.lit("<RULE> 1999-01-02 <DEPDOC a='1'>[Docket; AD "), n, F.lit("; Amendment]\n</DEPDOC> 2000-01-01"))
    amended = F.concat(F.lit("1999-01-02 <AMDPAR>2. The FAA amends by adding the following airworthiness directive:</AMDPAR>\n<E T='04'> "), n, F.lit(" Maker</E> and 2000-01-01"))
    return bind(spark, sf_dir, "directives").select(k, F.array_join(worklists.rule_numbers(F.when(k % 3 == 0, docket).when(k % 3 == 1, amended).otherwise(F.concat(F.lit("AD 1999-01-02 and "), n))), ",").alias("numbers"))


@query("""SELECT entry_id, line_no, part_id, entry_date, quantity, CASE WHEN quantity >= 10 AND part_id % 2 = 0 THEN NULL ELSE quantity + 1000.5 END AS tach, CASE WHEN line_no % 3 = 0 THEN 'Jane O''Neil' WHEN line_no % 3 = 1 THEN 'Blue Sky Aviation Inc' END AS name,
    CASE line_no % 3 WHEN 0 THEN 'A&P#12345 I.A.' WHEN 1 THEN 'FAA CRS#X1Y; W.O. #77' ELSE 'A&P#9' END AS credential, body AS description, TRUE AS signal FROM entries""")
def entry_drafts(spark, sf_dir):
    """Meters, performers and descriptions of entries with forms, dates and stamps around the bound body."""
    e = bind(spark, sf_dir, "entries")
    c = F.col
    whole = (c("quantity") + 1000).cast("int").cast("string")
    # A number as long that differs in its first digit only makes the reading doubtful.
    other = F.concat(F.lit("2"), F.substring(whole, 2, 9), F.lit(" hrs"))
    shop = F.array(F.lit("Blue Sky Aviation Inc FAA CRS# X1Y"), F.lit("W.O. Ref. #77"))
    stamp = F.when(c("line_no") % 3 == 0, F.array(F.lit("Jane O'Neil"), F.lit("A & P # 12345 I.A."))).when(c("line_no") % 3 == 1, shop).otherwise(F.array(F.lit("42 A&P 9")))
    lines = F.concat(
        F.array(F.concat(F.lit("Date: "), F.date_format("entry_date", "M/d/yyyy")), F.lit("TOTAL"), F.concat(F.lit("Tach "), whole, F.lit(".5")), F.lit("Recording Tach"), c("body"), c("body")),
        F.when((c("quantity") >= 10) & (c("part_id") % 2 == 0), F.array(other)).otherwise(F.array(F.lit("99 hrs"))),
    )
    made = e.withColumns({"lines": lines, "stamp": stamp})
    made = made.withColumns({"who": en.performer(c("stamp")), "tach": en.meter_reading(c("lines"), "Tach"), "description": en.entry_description(F.slice("lines", 1, 6), c("entry_date"))})
    return made.select("entry_id", "line_no", "part_id", "entry_date", "quantity", "tach", "who.name", "who.credential", "description", en.has_signal(F.array_join("lines", "\n")).alias("signal"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 12.5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 0 END AS rate, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'mode' END AS mode, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
    CASE c_custkey % 4 WHEN 0 THEN 'no_metadata' WHEN 1 THEN 'correction' WHEN 2 THEN 'emergency' ELSE 'gap_or_mismatch' END AS gap, CAST(round_even(c_acctbal, 2) AS DECIMAL(12,2)) AS hours, 'up_file_' || c_custkey || '.pdf' AS filename, c_name || chr(10) || 'Segment: ' || c_mktsegment AS source_text FROM customer""")
def small_rules(spark, sf_dir):
    """Numbers and words out of tags, severities, reasons, rounding, names and labelled texts, over all customers."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    tags = F.create_map(F.lit("rate"), F.when(k % 4 == 0, "12.5").when(k % 4 == 1, "many").when(k % 4 == 2, "-1").otherwise("0"), F.lit("mode"), F.when(k % 3 == 0, " ").otherwise(" mode "))
    status, title = F.when(k % 3 == 0, "missing").when(k % 3 == 1, "snapshot_unparseable").otherwise("matched"), F.when(k % 4 == 1, "A Correction").when(k % 4 == 2, "EMERGENCY rule").when(k % 4 == 3, "Rule")
    return c.select(
        k, tx.tag_number(tags, "rate").alias("rate"), F.substring(jobs.tag_text(tags, "mode"), 1, 64).alias("mode"), tx.issue_severity(status).alias("severity"), tx.gap_reason(title, F.lit(1)).alias("gap"),
        F.bround(F.col("c_acctbal").cast("decimal(14,4)"), 2).cast("decimal(12,2)").alias("hours"), tx.safe_filename(F.concat(F.lit("a/b c/up file?"), k, F.lit(".pdf"))).alias("filename"),
        F.concat_ws("\n", "c_name", F.concat(F.lit("Segment: "), "c_mktsegment"), F.concat(F.lit("None: "), F.lit(None).cast("string"))).alias("source_text"),
    )


@query("""SELECT directive_id, CASE WHEN directive_id % 3 = 0 THEN 'cached' ELSE upper(title) END AS out FROM directives""")
def plugin_extraction(spark, sf_dir):
    """A user's extractor for the directives that the cache lacks: batches of pandas frames, keyed by id and a hash of the input."""
    d = bind(spark, sf_dir, "directives").select("directive_id", F.xxhash64("title").alias("input_hash"), "title")
    cache = d.where("directive_id % 3 = 0").select("directive_id", "input_hash", F.lit("cached").alias("out"))
    out = extract_with(d, cache, lambda b: b.assign(out=b["title"].str.upper())[["directive_id", "input_hash", "out"]], "directive_id bigint, input_hash bigint, out string", ["directive_id", "input_hash"])
    return out.select("directive_id", "out")


@query("SELECT o_orderkey AS match_id, o_custkey AS aircraft_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_custkey % 3 <> 0")
def current_results(spark, sf_dir):
    k = F.col("o_orderkey")
    m = table(spark, sf_dir, "orders").select(k.alias("match_id"), F.col("o_custkey").alias("aircraft_id"), F.col("o_orderstatus").alias("algorithm"), F.when(k % 2 == 0, "2").otherwise("1").alias("version"), (F.col("o_custkey") % 3 != 0).alias("is_current"))
    return worklists.current_results(m, "F", "2").select("match_id", "aircraft_id")


@query("""SELECT o_custkey AS job_id, o_orderkey AS draft_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END NULLS LAST, o_orderkey % 7, o_orderkey) AS place FROM orders""")
def entry_order(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), k.alias("draft_id"), F.when(k % 5 != 0, F.col("o_orderdate").cast("date")).alias("entry_date"), (k % 7).alias("page"))
    return worklists.entry_order(d).select("job_id", "draft_id", "place")


@query("""SELECT o_orderkey AS upload_id, CASE WHEN o_orderkey % 3 = 0 THEN 'chargeable' ELSE 'not_billable' END AS billing_status, 'acct-' || o_custkey AS account, CASE WHEN o_orderkey % 2 = 0 THEN 'aws' END AS channel, CASE WHEN o_orderkey % 4 = 1 THEN 'second' ELSE 'page' END AS unit,
    CASE o_orderkey % 3 WHEN 0 THEN CAST(0.004 AS DECIMAL(18,8)) END AS rate, CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 3 END AS pages FROM orders""")
def run_attributes(spark, sf_dir):
    k = F.col("upload_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), F.concat(F.lit("acct-"), "o_custkey").alias("account"))
    uploads = o.select(k, "account", F.lit("N1").alias("aircraft"), F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)).alias("consent"))
    said = F.create_map(
        F.lit("provider_channel"), F.when(k % 2 == 0, " aws").otherwise(" "), F.lit("pricing_unit"), F.when(k % 4 == 1, "second"), F.lit("pricing_rate_usd"), F.when(k % 3 == 0, "0.004").when(k % 3 == 1, "-1").otherwise("free"),
        F.lit("billable_page_count"), F.when(k % 5 == 0, "7").otherwise("x"),
    )
    return worklists.run_attributes(uploads, o.select(k, F.lit(3).alias("page_count"), said.alias("metadata"))).select("upload_id", "billing_status", "account", "channel", "unit", "rate", "pages")


@query("SELECT doc_id AS page_id, sha256('0,0,612,792||' || (doc_id % 4 * 90) || '|' || sha256(coalesce(text, ''))) AS fingerprint FROM documents")
def page_fingerprints(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("0,0,612,792").alias("media_box"), F.lit(None).cast("string").alias("crop_box"), (F.col("doc_id") % 4 * 90).alias("rotation"), F.col("text").alias("content"))
    return worklists.page_fingerprint(p)


def _payloads(spark, sf_dir):
    k = F.col("id")
    d = bind(spark, sf_dir, "directives").select(F.col("directive_id").alias("id"))
    sure = F.when(k % 5 == 0, '"high"').when(k % 5 == 1, "1").otherwise("0.75")
    text = F.concat(F.lit('{"adNumber":"x","confidence":'), sure, F.when(k % 3 == 0, ',"citations":[{"a":1},2]').when(k % 3 == 1, ',"citations":"none"').otherwise(""), F.lit(',"uncertaintyReasons":["a"]}'))
    return worklists.model_payloads(d.withColumn("payload", F.when(k % 11 == 0, "not json").otherwise(text)))


@query("SELECT directive_id AS id, CAST(CASE WHEN directive_id % 5 = 1 THEN 1.0 ELSE 0.75 END AS DOUBLE) AS confidence, CASE WHEN directive_id % 3 = 0 THEN 2 ELSE 0 END AS citations, 1 AS uncertainty FROM directives WHERE directive_id % 11 <> 0 AND directive_id % 5 <> 0 AND directive_id % 3 <> 1")
def model_payloads(spark, sf_dir):
    return _payloads(spark, sf_dir)[0]


@query("""SELECT directive_id AS id, CASE WHEN directive_id % 11 = 0 THEN 'not_json' WHEN directive_id % 5 = 0 THEN 'confidence_not_numeric' ELSE 'citations_not_a_list' END AS reason FROM directives WHERE directive_id % 11 = 0 OR directive_id % 5 = 0 OR directive_id % 3 = 1""")
def refused_payloads(spark, sf_dir):
    return _payloads(spark, sf_dir)[1]


@query("""SELECT directive_id, CASE WHEN directive_id % 3 = 0 THEN 'Needs adjudication: no logbook entry cites or strongly matches ' || ad_number || '.' WHEN directive_id % 3 = 1 THEN 'Candidate satisfied: found logbook evidence for ' || ad_number || ' with ' || title || '.'
    ELSE 'Needs adjudication: found possible evidence for ' || ad_number || ', but unresolved reasons remain: a, b.' END AS rationale FROM directives""")
def match_rationale(spark, sf_dir):
    k = F.col("directive_id")
    reasons = F.when(k % 3 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return bind(spark, sf_dir, "directives").select(k, worklists.rationale(F.col("ad_number"), k % 3 != 0, F.col("title"), reasons).alias("rationale"))


@query(f"""WITH {_MATCH.strip()}, b AS (SELECT aircraft_id, directive_id, min(role) AS role FROM hits GROUP BY ALL), q AS (SELECT b.aircraft_id, b.directive_id, b.role, c.make AS cm, c.model AS cd, c.serial, d.product_type, d.make AS tm, d.model AS td
        FROM b JOIN components c ON c.aircraft_id = b.aircraft_id AND c.role = b.role JOIN directives d ON d.directive_id = b.directive_id)
    SELECT aircraft_id, directive_id, '{{{{"component":{{{{"role":"' || role || '","make":' || coalesce('"' || cm || '"', 'null') || ',"model":' || coalesce('"' || cd || '"', 'null') || ',"serialNumber":' || coalesce('"' || serial || '"', 'null') || '}}}},"target":{{{{"productType":"' || product_type
        || '","make":' || coalesce('"' || tm || '"', 'null') || ',"model":' || coalesce('"' || td || '"', 'null') || '}}}},"serialStatus":"' || CASE WHEN serial IS NULL THEN 'unknown' ELSE 'known' END || '"}}}}' AS snapshot FROM q""".replace("{{", "{").replace("}}", "}"))
def applicability_snapshots(spark, sf_dir):
    parts = fleet.components_long(bind(spark, sf_dir, "aircraft")).select("aircraft_id", "role", F.col("make").alias("c_make"), F.col("model").alias("c_model"), "serial")
    targets = bind(spark, sf_dir, "directives").select("directive_id", "product_type", F.col("make").alias("t_make"), F.col("model").alias("t_model"))
    return worklists.applicability_snapshot(_applicability(spark, sf_dir), parts, targets)
