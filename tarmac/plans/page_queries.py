"""Registered queries for directive texts, match results, pages and further streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import entries as en
from tarmac.operators import extraction, fleet, jobs, layout
from tarmac.plans.bindings import NUMBER, TABLES, bind, table
from tarmac.plans.queries import _EVIDENCE, _MATCH, _applicability, _facts, evidence_rank, query
from tarmac.streaming.folders import shared_folder
from tarmac.streaming import status

_RECORDS = f"""SELECT p_partkey AS directive_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE {NUMBER.format(k='p_partkey')} END AS ad_number,
    CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Airworthiness Directives; ' || p_name END AS title,
    'AD ' || {NUMBER.format(k='p_partkey')} || CASE WHEN p_partkey % 5 = 0 THEN ' supersedes AD ' || {NUMBER.format(k='(p_partkey + 85)')} WHEN p_partkey % 5 = 1 THEN ' correcting 2011-01-05' ELSE '' END AS abstract
    FROM {{part}}"""
_RECORDS_SQL = _RECORDS.format(part="part")
_NO = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"


def _records(spark, sf_dir):
    return spark.sql(_RECORDS, part=table(spark, sf_dir, "part"))


@query(f"""WITH r AS ({_RECORDS_SQL}), i AS (SELECT DISTINCT unnest(regexp_extract_all(abstract, '{_NO}', 1)) AS id FROM r)
    SELECT id FROM i WHERE CAST(substr(id, 1, 4) AS INT) BETWEEN 1950 AND 2015""")
def id_scan(spark, sf_dir):
    return extraction.scan_ids(_records(spark, sf_dir), "abstract", 1950, 2015)


@query(f"""WITH r AS ({_RECORDS_SQL}), i AS (SELECT DISTINCT unnest(regexp_extract_all(abstract, '{_NO}', 1)) AS id FROM r)
    SELECT id, 'text' AS method FROM i""")
def id_scan_fallback(spark, sf_dir):
    """Titles name no directive, so the scan of texts gives the ids."""
    r = _records(spark, sf_dir)
    return extraction.ids_with_fallback([("names", extraction.scan_ids(r, "title", 1, 9999), 1), ("text", extraction.scan_ids(r, "abstract", 1, 9999), 100)])


@query(f"""WITH r AS ({_RECORDS_SQL}), t AS (SELECT *, title || chr(10) || abstract AS t FROM r), n AS (SELECT *, coalesce(ad_number, regexp_extract(t, '{_NO}', 1)) AS number FROM t),
    s AS (SELECT directive_id, number, CASE WHEN title LIKE '%;%' THEN trim(split_part(title, ';', 2)) END AS subject,
          array_to_string(list_sort(list_distinct([x for x in regexp_extract_all(t, '{_NO}', 1) if x <> number])), ',') AS superseded,
          800 + CASE WHEN title LIKE '%;%' THEN 40 ELSE 0 END + CASE WHEN t LIKE '%supersed%' THEN 30 ELSE 0 END AS score FROM n)
    SELECT directive_id, number, subject, superseded, CAST(score / 1000 AS DECIMAL(4,3)) AS confidence, CASE WHEN score >= 860 THEN 'approved' ELSE 'needs_review' END AS status FROM s""")
def directive_extraction(spark, sf_dir):
    return extraction.extract_directives(_records(spark, sf_dir)).select("directive_id", "number", "subject", "superseded", "confidence", "status")


@query(f"""WITH r AS ({_RECORDS_SQL}), l AS (SELECT ad_number AS n FROM edges UNION SELECT supersedes FROM edges),
    s AS (SELECT directive_id AS publication_id, ad_number, concat_ws(',', CASE WHEN abstract LIKE '%correcting%' THEN 'correction' END, CASE WHEN abstract LIKE '%supersed%' THEN 'supersession' END) AS signals FROM r)
    SELECT * FROM s WHERE signals <> '' AND NOT (signals LIKE '%supersession%' AND ad_number IS NOT NULL AND ad_number IN (SELECT n FROM l))""")
def reconciliation_specs(spark, sf_dir):
    r = _records(spark, sf_dir).select(F.col("directive_id").alias("publication_id"), "ad_number", F.concat_ws(" ", "title", "abstract").alias("text"))
    return extraction.signal_conflicts(r, bind(spark, sf_dir, "edges"))


@query("""WITH t AS (SELECT lower(make) AS term, count(*) AS aircraft FROM aircraft GROUP BY 1 UNION ALL SELECT lower(model), count(*) FROM aircraft GROUP BY 1),
    p AS (SELECT lower(make) AS product, count(*) AS directives FROM directives WHERE make IS NOT NULL GROUP BY 1 UNION ALL SELECT lower(model), count(*) FROM directives WHERE model IS NOT NULL GROUP BY 1)
    SELECT term, product, aircraft, directives FROM t JOIN p ON contains(term, product) OR contains(product, term)""")
def product_text_match(spark, sf_dir):
    """Distinct terms and products of which one holds the other, with the aircraft and directives behind them."""
    count = lambda d, c, to, n: d.where(F.col(c).isNotNull()).groupBy(F.lower(c).alias(to)).agg(F.count("*").alias(n))
    a, d = bind(spark, sf_dir, "aircraft"), bind(spark, sf_dir, "directives")
    terms = count(a, "make", "term", "aircraft").unionByName(count(a, "model", "term", "aircraft"))
    products = count(d, "make", "product", "directives").unionByName(count(d, "model", "product", "directives"))
    return extraction.contained(terms, products).join(terms, "term").join(products, "product").select("term", "product", "aircraft", "directives")


@query("WITH " + _EVIDENCE.strip() + """, top AS (SELECT * FROM evidence WHERE place = 1), b AS (SELECT aircraft_id, directive_id, min(role) AS role FROM hits GROUP BY ALL),
    f AS (SELECT directive_id, CASE WHEN size > 40 THEN 'simple_recurring' ELSE 'one_time' END AS match_type,
          [CASE WHEN make IS NULL AND model IS NULL THEN 'applicability_unknown' END, CASE WHEN size > 40 THEN 'recurring_due_status_unknown' END, CASE WHEN size > 40 AND size <= 45 THEN 'recurring_interval_unstructured' END,
           CASE WHEN directive_id % 7 = 0 THEN 'compliance_action_unknown' END, CASE WHEN ad_number IN (SELECT supersedes FROM edges) THEN 'directive_superseded' END] AS open FROM directives),
    r AS (SELECT aircraft_id, directive_id, role, match_type, confidence AS best, role <> 'airframe' AS ns,
          list_filter(list_concat(open, [CASE WHEN confidence IS NOT NULL AND disposition IS NULL THEN 'explicit_ad_reference_missing' END, CASE WHEN confidence IS NOT NULL AND coalesce(disposition, '') NOT IN ('complied', 'inspected') THEN 'explicit_compliance_claim_missing' END]), lambda x: x IS NOT NULL) AS why
          FROM b LEFT JOIN top USING (aircraft_id, directive_id) JOIN f USING (directive_id))
    SELECT aircraft_id, directive_id, role, match_type, CAST(least(CASE WHEN len(why) > 0 THEN 0.68 ELSE 1 END, CASE WHEN ns THEN 0.72 ELSE 1 END, coalesce(best, 0.42)) AS DECIMAL(4,3)) AS confidence,
           array_to_string(list_sort(list_concat(why, CASE WHEN ns THEN ['component_serial_unknown'] ELSE [] END)), ',') AS reasons,
           CASE WHEN best IS NOT NULL AND len(why) = 0 AND NOT ns THEN 'candidate_satisfied' ELSE 'needs_adjudication' END AS status FROM r""".replace("WITH WITH", "WITH"))
def match_results(spark, sf_dir):
    parts = fleet.components_long(bind(spark, sf_dir, "aircraft"))
    return extraction.match_results(_applicability(spark, sf_dir), evidence_rank(spark, sf_dir), _facts(spark, sf_dir), bind(spark, sf_dir, "edges"), parts)


@query("SELECT entry_id, line_no, part_id, quantity, entry_date FROM entries")
def entry_dates(spark, sf_dir):
    """Dates written in two ways after one that isn't valid; the entry's own date must come back."""
    e = bind(spark, sf_dir, "entries")
    short = F.concat_ws(" / ", F.month("entry_date"), F.day("entry_date"), F.date_format("entry_date", "yy"))
    said = F.when(F.col("line_no") % 2 == 0, F.date_format("entry_date", "yyyy-MM-dd")).otherwise(short)
    text = F.concat(F.lit("no 2/30/1999 or 1234-56-789, on "), said, F.lit(" and 1/2/2003"))
    return e.withColumn("entry_date", en.entry_date(text)).select("entry_id", "line_no", "part_id", "quantity", "entry_date")


_SAMPLES = """l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents),
    b AS (SELECT page_id, line_no, least(1000, (36 + line_no % 2 * 288) * 1000 // 612) AS l, least(1000, (40 + 14 * line_no) * 1000 // 792) AS t, length(text) AS n, 10 + page_id % 3 AS s FROM l),
    boxes AS (SELECT page_id, line_no, l AS "left", t AS top, least(1000 - l, n * s * 1000 // 1224) AS width, least(1000 - t, s * 1200 // 792) AS height FROM b)"""


def _boxes(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return layout.native_text_boxes(lines.withColumns({"x": 36 + F.col("line_no") % 2 * 288, "y": 40 + 14 * F.col("line_no"), "size": 10 + F.col("page_id") % 3}))


@query(f"WITH {_SAMPLES} SELECT * FROM boxes")
def native_text_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir)


@query(f"WITH {_SAMPLES} SELECT page_id, line_no, 'empty' AS issues FROM boxes WHERE width <= 0 OR height <= 0")
def region_checks(spark, sf_dir):
    return layout.region_violations(_boxes(spark, sf_dir))


@query("""SELECT doc_id AS page_id, 'full' AS region, 0 AS "left", 1000 AS "right" FROM documents WHERE n_chars % 3 <> 0
    UNION ALL SELECT doc_id, 'left', 0, 500 FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT doc_id, 'right', 500, 1000 FROM documents WHERE n_chars % 3 = 0""")
def region_specs(spark, sf_dir):
    tags = F.when(F.col("n_chars") % 3 == 0, F.array(F.lit("side_by_side"))).otherwise(F.array(F.lit("skewed")))
    return layout.region_specs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), tags.alias("attributes")))


_METRICS = r"""g AS (SELECT doc_id AS page_id, text, CAST(len(regexp_extract_all(text, '[^ \t\r\n]+')) AS BIGINT) AS words, [x for x in string_split(text, chr(10)) if trim(x) <> ''] AS ls,
        length(regexp_replace(text, '[^\x{FFFD}\x00-\x08]', '', 'g')) AS invalid FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    m AS (SELECT page_id, words, len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS repeated, invalid, length(text) AS characters FROM g)"""


def _page_metrics(spark, sf_dir):
    return layout.native_text_metrics(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@query(f"WITH {_METRICS} SELECT * FROM m")
def native_text_metrics(spark, sf_dir):
    return _page_metrics(spark, sf_dir).select("page_id", "words", "lines", "repeated", "invalid", "characters")


@query(f"""WITH {_METRICS}, f AS (SELECT page_id, concat_ws(',', CASE WHEN words < 20 THEN 'reliable' END, CASE WHEN page_id % 13 = 0 THEN 'routing_class' END, CASE WHEN page_id % 4 = 0 THEN 'attributes' END,
        CASE WHEN characters = 0 OR (characters - invalid) < 0.995 * characters THEN 'valid_glyph_ratio' END, CASE WHEN page_id % 6 = 0 THEN 'positioned_ratio' END, CASE WHEN page_id % 9 = 0 THEN 'extractor_agreement' END,
        CASE WHEN repeated > 0.05 * lines THEN 'duplicate_line_ratio' END, CASE WHEN page_id % 5 = 4 THEN 'image_coverage' END) AS failed FROM m)
    SELECT page_id, failed = '' AS eligible, failed = '' AS bypass, CASE WHEN failed = '' THEN 'native_text_gate_passed' ELSE 'page_does_not_meet_native_text_gate' END AS reason, failed FROM f""")
def native_text_gate(spark, sf_dir):
    m, k = _page_metrics(spark, sf_dir), F.col("page_id")
    pages = m.withColumns({
        "reliable": F.col("words") >= 20, "routing_class": F.when(k % 13 != 0, "native_text"), "attributes": F.when(k % 4 == 0, F.array(F.lit("skewed"), F.lit("faint"))).when(k % 4 == 1, F.array(F.lit("skewed"))),
        "positioned_ratio": F.when(k % 6 != 0, F.lit(0.98)), "plausible_font_ratio": F.lit(1.0), "extractor_agreement": F.when(k % 9 == 0, F.lit(0.97)).otherwise(0.99), "image_coverage": F.when(k % 5 == 4, F.lit(0.3)).when(k % 5 == 3, F.lit(0.25)),
    })
    return layout.native_text_gate(pages)


@query("""WITH r AS (SELECT doc_id // 50 AS upload_id, doc_id AS page_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS subset_page FROM documents WHERE n_chars % 3 = 0),
    d AS (SELECT DISTINCT doc_id // 50 AS upload_id, doc_id % 50 + 1 AS subset_page FROM labels)
    SELECT upload_id, subset_page, page_id, CASE WHEN page_id IS NULL THEN 'out_of_range' ELSE '' END AS issue FROM d LEFT JOIN r USING (upload_id, subset_page)""")
def page_remap(spark, sf_dir):
    upload = F.expr("doc_id div 50").alias("upload_id")
    routed = table(spark, sf_dir, "documents").where("n_chars % 3 = 0").select(upload, F.col("doc_id").alias("page_id"))
    delegated = table(spark, sf_dir, "labels").select(upload, (F.col("doc_id") % 50 + 1).alias("subset_page")).distinct()
    return layout.remap_pages(delegated, routed)


@query("""WITH g AS (SELECT entry_id, min(entry_date) AS d FROM entries GROUP BY 1), p AS (SELECT doc_id AS entry_id, min(n_chars % 100) AS page FROM documents GROUP BY 1)
    SELECT entry_id, coalesce(d, DATE '9999-12-31') AS entry_date, CAST(coalesce(page, 999999) AS BIGINT) AS page FROM g LEFT JOIN p USING (entry_id)""")
def logbook_chronology(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), (F.col("n_chars") % 100).alias("page"))
    return layout.chronology(bind(spark, sf_dir, "entries"), pages)


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events")
def stage_attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return layout.stage_attempts(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, (SELECT count(*) FROM {t}) AS rows, (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {t})) AS columns" for t in TABLES))
def source_inventory(spark, sf_dir):
    return layout.inventory({t: table(spark, sf_dir, t) for t in TABLES})


@query("SELECT event_type AS workflow_type, user_id AS workflow_id, arg_max(event_id, (ts, event_id)) AS state FROM events GROUP BY ALL")
def stream_workflow_state(spark, sf_dir):
    """The last transition of each workflow, by a streaming aggregate."""
    root = shared_folder(spark, "stream")
    stream = status.event_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events"))
    rows = stream.select(F.col("event_type").alias("workflow_type"), F.col("user_id").alias("workflow_id"), "ts", F.col("event_id").alias("state"))
    status.run_available(status.stream_latest(rows, ["workflow_type", "workflow_id"], ["ts"], "state"), f"{root}/checkpoint", f"{root}/out")
    return status.latest_of(spark.read.parquet(f"{root}/out"), "workflow_type", "workflow_id").select("workflow_type", "workflow_id", "last.state")


_PUBLISHED = f"""SELECT {NUMBER.format(k='CAST(floor(p_partkey / 3) AS BIGINT)')} AS document_number, CAST(date_add(DATE '1990-01-01', CAST(40 * (p_partkey % 3) + p_size AS INT)) AS DATE) AS publication_date,
    CASE WHEN p_size % 4 = 0 THEN 'same' ELSE p_name END AS content, p_partkey AS received FROM {{part}}"""


@query(f"""WITH d AS (SELECT {NUMBER.format(k='CAST(floor(p_partkey / 3) AS BIGINT)')} AS document_number, p_partkey % 3 AS poll, CAST(DATE '1990-01-01' + CAST(40 * (p_partkey % 3) + p_size AS INT) AS DATE) AS publication_date, CASE WHEN p_size % 4 = 0 THEN 'same' ELSE p_name END AS content, p_partkey AS received FROM part),
    a AS (SELECT * FROM d WHERE poll = 0), b AS (SELECT * FROM d WHERE poll = 1 AND publication_date >= (SELECT max(publication_date) FROM a)),
    c AS (SELECT * FROM d WHERE poll = 2 AND publication_date >= (SELECT max(publication_date) FROM (FROM a UNION ALL FROM b))),
    u AS (FROM a UNION ALL FROM b UNION ALL FROM c), l AS (SELECT *, row_number() OVER (PARTITION BY document_number ORDER BY poll DESC, received DESC) AS place, count(DISTINCT poll) OVER (PARTITION BY document_number) AS polls FROM u)
    SELECT document_number, publication_date, content, received, sha256(content) AS content_hash, polls FROM l WHERE place = 1""")
def stream_discovery(spark, sf_dir):
    """Three polls of a folder to which documents come between polls; each takes those from the high-water mark on, and updates the table in place."""
    root = shared_folder(spark, "discovery")
    rows = spark.sql(_PUBLISHED, part=table(spark, sf_dir, "part"))
    held = status.UpsertTable(spark, f"{root}/table", "document_number string, publication_date date, content string, received bigint, content_hash string", ["document_number"], ["received"], buckets=8)
    for poll in range(3):
        rows.where(F.col("received") % 3 == poll).write.mode("append").parquet(f"{root}/feed")
        status.poll_discovery(spark.readStream.schema(rows.schema).parquet(f"{root}/feed"), held, f"{root}/checkpoint", f"{root}/log")
    # A number is in the log once for each batch that took it.
    log = spark.read.schema("document_number string, action string").parquet(f"{root}/log").groupBy("document_number").agg(F.count("*").alias("polls"))
    return held.read().join(log, "document_number")


_CHANGED = """changes AS (SELECT 'entry' AS change_type, event_id AS id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'aircraft', user_id FROM events WHERE event_type = 'signup' UNION ALL SELECT 'extraction', user_id FROM events WHERE event_type = 'error')"""


@query(f"""WITH {_MATCH.strip().removeprefix('WITH')}, {_CHANGED}
    SELECT DISTINCT aircraft_id, change_type FROM (SELECT aircraft_id, change_type FROM changes JOIN entries ON change_type = 'entry' AND entry_id = id UNION ALL SELECT id, change_type FROM changes WHERE change_type = 'aircraft'
        UNION ALL SELECT aircraft_id, change_type FROM changes JOIN hits ON change_type = 'extraction' AND directive_id = id UNION ALL SELECT aircraft_id, change_type FROM changes JOIN entries ON change_type = 'extraction' AND part_id = id)""")
def stream_invalidation(spark, sf_dir):
    """Aircraft to be matched anew after changes of entries, aircraft and extractions: three streams, one checkpoint."""
    root = shared_folder(spark, "stream")
    # The static sides are made once, not in each micro-batch.
    whole = _applicability(spark, sf_dir).written(root)
    entries = bind(spark, sf_dir, "entries").select("entry_id", "aircraft_id", "part_id")
    entries.write.parquet(f"{root}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{root}/entries")
    changes = None
    for change, event, of in (("entry", "purchase", "event_id"), ("aircraft", "signup", "user_id"), ("extraction", "error", "user_id")):
        stream = status.event_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events"))
        one = stream.where(F.col("event_type") == event).select(F.lit(change).alias("change_type"), F.col(of).alias("id"))
        changes = one if changes is None else changes.unionByName(one)
    subscribers = entries.select("aircraft_id", F.col("part_id").alias("directive_id")).distinct()
    status.log_available(changes, f"{root}/checkpoint", f"{root}/log", lambda b: status.invalidated(b, entries, whole, subscribers))
    return spark.read.schema("aircraft_id long, change_type string").parquet(f"{root}/log").select("aircraft_id", "change_type").distinct()
