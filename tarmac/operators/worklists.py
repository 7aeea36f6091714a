"""Lists, previews, details and page states that people work from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.applicability import Applicability, kept
from tarmac.streaming.folders import shared_folder


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def owner_scope(memberships: DataFrame) -> DataFrame:
    """(user_id, organization_id) of active memberships whose role is an owner's."""
    return memberships.where((F.col("status") == "active") & F.col("role").startswith("owner")).select("user_id", "organization_id").distinct()


def maintenance_scope(memberships: DataFrame, organizations: DataFrame, assignments: DataFrame) -> DataFrame:
    """(user_id, aircraft_id) that an active member of a maintenance organization may work on by an active assignment.

    Pairs come from blocks of an organization's members and aircraft, each pair once, and are not shuffled.
    """
    shops = organizations.where("organization_type = 'maintenance'").select("organization_id")
    shop = F.col("organization_id").cast("string")
    members = memberships.where("status = 'active' and organization_id is not null").join(shops, "organization_id", "left_semi").select(F.col("user_id").alias("aircraft_id"), F.lit("member").alias("role"), shop.alias("component_class")).distinct()
    served = assignments.where("status = 'active' and organization_id is not null").select(F.col("aircraft_id").alias("directive_id"), shop.alias("target_class")).distinct()
    same = lambda a, d: a.select("component_class").distinct().join(d.select("target_class").distinct(), F.col("component_class") == F.col("target_class"))
    scope = Applicability(same(members, served), members, served, same).pairs(first=True)
    return scope.select(F.col("aircraft_id").alias("user_id"), F.col("directive_id").alias("aircraft_id"))


def search(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows whose columns, side by side, hold the term in any case; a blank term finds all."""
    return df if not term.strip() else df.where(F.lower(F.concat_ws(" ", *columns)).contains(term.strip().lower()))


def page_of(df: DataFrame, number: int, size: int, *newest_first: str) -> DataFrame:
    """Page `number`, from 1, of rows in order: a top-k report."""
    if number < 1 or size < 1:
        raise ValueError("pages count from 1 and hold a row at least")
    return df.orderBy(*(F.desc_nulls_last(c) for c in newest_first)).offset((number - 1) * size).limit(size)


def pending_work(jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest jobs that are queued or failed: a top-k report."""
    return jobs.where("status in ('queued', 'failed')").orderBy("created_at", "job_id").limit(n)


def id_set_compare(a: DataFrame, b: DataFrame, year_from: int, year_to: int) -> DataFrame:
    """(scope, both, only_a, only_b) of two sets of numbers id, overall and of the years."""
    w = a.select("id").distinct().withColumn("_a", F.lit(True)).join(b.select("id").distinct().withColumn("_b", F.lit(True)), "id", "full_outer")
    w = w.withColumn("scope", F.explode(F.when(F.substring("id", 1, 4).cast("int").between(year_from, year_to), F.array(F.lit("all"), F.lit("window"))).otherwise(F.array(F.lit("all")))))
    return w.groupBy("scope").agg(F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def merge_pages(native: DataFrame, delegated: DataFrame) -> DataFrame:
    """Pages of both routes with their provider; a page that both have keeps the delegated one."""
    both = native.withColumn("_r", F.lit(1)).unionByName(delegated.withColumn("_r", F.lit(0)))
    return first_of(both, ["upload_id", "page"], "_r").drop("_r")


def page_preview(spans: DataFrame, lines: int = 8, structures: int = 20) -> DataFrame:
    """Per page the first lines' texts and the first structures' kinds, in reading order: a top-k report of each page."""
    kind = F.when(F.col("span_type") == "LINE", "lines").otherwise("structures")
    k = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("reading_order"))
    top = spans.withColumn("kind", kind).withColumn("k", k).where(F.col("k") <= F.when(F.col("kind") == "lines", lines).otherwise(structures))
    listed = lambda name, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("k", F.col(c).alias("v"))))), lambda x: x["v"]).alias(name)
    return top.groupBy("page_id").agg(listed("lines", "text"), listed("structures", "span_type"))


def candidate_region(spans: DataFrame) -> DataFrame:
    """Of spans(entry_id, page_id, left, top, right, bottom) per entry the page with most of them, the first of equal ones, and the box around them."""
    box = spans.groupBy("entry_id", "page_id").agg(F.count("*").alias("spans"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    return first_of(box, ["entry_id"], F.desc("spans"), "page_id")


def entry_lineage(evidence: DataFrame, spans: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per entry its evidence in order of field and reading order: field, type, the span's text, and the correction in effect in its place."""
    latest = corrections.groupBy("span_id").agg(F.max_by("corrected_text", "correction_order").alias("corrected"))
    rows = evidence.join(spans.select("span_id", "text", "reading_order"), "span_id", "left").join(latest, "span_id", "left")
    item = F.struct("field_name", F.coalesce("reading_order", F.lit(2**31 - 1)).alias("reading_order"), "evidence_id", "evidence_type", F.coalesce("corrected", "text").alias("text"), F.col("corrected").isNotNull().alias("corrected"))
    return rows.groupBy("entry_id").agg(F.array_sort(F.collect_list(item)).alias("chain"))


def field_evidence(drafts: DataFrame, spans: DataFrame, corrections: DataFrame) -> DataFrame:
    """For each field of each draft the first span that holds its value, and the kind of evidence: correction, ocr_span, or fallback without a span.

    drafts: draft_id, page_id, field, value. spans: span_id, page_id, text, reading_order, confidence.
    """
    latest = corrections.groupBy("span_id").agg(F.max_by("corrected_text", "correction_order").alias("corrected"))
    s = spans.join(latest, "span_id", "left").withColumn("_said", F.coalesce("corrected", "text"))
    met = drafts.where("value is not null").join(s, "page_id").where(F.col("_said").contains(F.col("value")))
    first = first_of(met, ["draft_id", "field"], "reading_order", "span_id").select("draft_id", "field", "span_id", "confidence", F.col("corrected").isNotNull().alias("_c"))
    out = drafts.where("value is not null").join(first, ["draft_id", "field"], "left")
    kind = F.when(F.col("span_id").isNull(), "fallback").when(F.col("_c"), "correction").otherwise("ocr_span")
    return out.select("draft_id", "field", "value", "span_id", kind.alias("evidence_type"), "confidence")


def draft_entries(lines: DataFrame) -> DataFrame:
    """One draft for each cluster of lines(page_id, cluster, line_no, text, confidence, is_anchor): its anchor (the first anchor line, else the first), text, least confidence, and whether its page has several."""
    item = F.struct("line_no", "text")
    out = lines.groupBy("page_id", "cluster").agg(
        F.coalesce(F.min(F.when(F.col("is_anchor"), F.col("line_no"))), F.min("line_no")).alias("anchor"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n").alias("text"),
        F.count("*").alias("lines"), F.min("confidence").alias("confidence"), F.bool_or("is_anchor").alias("has_anchor"),
    )
    return out.withColumn("requires_review", F.count("*").over(Window.partitionBy("page_id")) > 1)


def candidate_counts(drafts: DataFrame) -> DataFrame:
    """Per page how many drafts are candidates and how many are rejected."""
    return drafts.groupBy("page_id").agg(F.count_if(F.col("status") != "rejected").alias("candidates"), F.count_if(F.col("status") == "rejected").alias("rejected"))


def evaluation_summary(pages: DataFrame) -> DataFrame:
    """Per provider: passed and failed pages, cost, seconds, and the routes that were taken."""
    return pages.groupBy("provider").agg(
        F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.sum("cost").cast("decimal(18,6)").alias("cost"),
        F.sum("seconds").cast("long").alias("seconds"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"),
    )


def run_stats(results: DataFrame, status: str, *kinds: str) -> DataFrame:
    """One row: rows seen, and those of each kind."""
    return results.agg(F.count("*").alias("seen"), *(F.count_if(F.col(status) == k).alias(k) for k in kinds))


def first_publication(publications: DataFrame) -> DataFrame:
    """Per directive the first publication's date, and the first url that is not blank, by publication id."""
    url = F.nullif(F.trim("url"), F.lit(""))
    return publications.groupBy("directive_id").agg(
        F.min_by("publication_date", F.when(F.col("publication_date").isNotNull(), F.col("publication_id"))).alias("publication_date"), F.min_by(url, F.when(url.isNotNull(), F.col("publication_id"))).alias("url")
    )


def match_detail(matches: Applicability | DataFrame, publications: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each match with its directive's publications, the source's own first, and its evidence in order.

    matches: pairs, or the classes that they are made from: those without evidence are then
    made from these with their publications, and are not shuffled.
    """
    rank = F.when(F.col("source_system") == "drs", 0).otherwise(1)
    pubs = publications.groupBy("directive_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "publication_id"))), lambda x: x["publication_id"]).alias("publications"))
    shown = evidence.groupBy("aircraft_id", "directive_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry_id"))), lambda x: x["entry_id"]).alias("entries"))
    pair = ["aircraft_id", "directive_id"]
    if not isinstance(matches, Applicability):
        return matches.join(pubs, "directive_id", "left").join(shown, pair, "left")
    root = shared_folder(shown.sparkSession, "detail")
    matches, shown = matches.written(f"{root}/classes"), kept(shown.where("aircraft_id is not null and directive_id is not null"), f"{root}/shown")
    found = matches.first_roles(shown).select(*pair).join(pubs, "directive_id", "left").join(shown, pair)
    told = matches.of_directives.select("directive_id").distinct().join(pubs, "directive_id", "left")
    rest = matches.pairs(first=True, directives=told, without=shown)
    out = [*pair, "publications", "entries"]
    return found.select(*out).unionByName(rest.withColumn("entries", F.lit(None).cast(shown.schema["entries"].dataType)).select(*out))


def upload_issue(kind: Column, name: Column, section: Column, consent: Column, kinds: tuple[str, ...], extensions: tuple[str, ...], sections: tuple[str, ...]) -> Column:
    """Why an upload is refused, or null: its content type, extension, section or a missing consent."""
    ending = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    return (
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "content_type").when(~ending.isin(*extensions), "extension")
        .when(~F.coalesce(section.isin(*sections), F.lit(False)), "section").when(~F.coalesce(consent, F.lit(False)), "consent_required")
    )


def job_state(jobs: DataFrame, verifications: DataFrame, pages: DataFrame, low: int = 80) -> DataFrame:
    """Jobs with the state that their latest verification leads to: awaiting corrections where a line is below `low`, else ready; others keep theirs.

    jobs: job_id, status. verifications: job_id, verification_id, created_at, order_ok, complete. pages: job_id, least confidence of a line.
    """
    last = first_of(verifications, ["job_id"], F.desc("created_at"), F.desc("verification_id"))
    out = jobs.join(last.select("job_id", (F.col("order_ok") & F.col("complete")).alias("_ok")), "job_id", "left").join(pages, "job_id", "left")
    status = F.when(F.col("_ok") & (F.col("least") < low), "awaiting_corrections").when(F.col("_ok"), "ready_for_extraction").otherwise(F.col("status"))
    return out.select("job_id", F.coalesce("_ok", F.lit(False)).alias("verified"), status.alias("status"))


def review_outcome(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per row and field the decision (null, accepted, corrected) and both values; one row for each field."""
    b, a = before.alias("b"), after.alias("a")
    text = lambda t, c: F.col(f"{t}.{c}").cast("string")
    items = F.array(*(F.struct(F.lit(c).alias("field"), text("b", c).alias("old"), text("a", c).alias("new")) for c in fields))
    out = b.join(a, keys).select(*keys, F.explode(items).alias("x")).select(*keys, "x.*")
    return out.withColumn("decision", F.when(F.col("new").isNull(), "null").when(F.col("new").eqNullSafe(F.col("old")), "accepted").otherwise("corrected"))


def page_class(pages: DataFrame) -> DataFrame:
    """pages(page_id, page_number, page_count, text, reliable, aspect, contrast, rotation) with routing class, role, attributes and confidence.

    Characters other than blanks count. The picture's proportions and contrast add
    attributes in the place of a first guess; each stands once, in order.
    """
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    low = F.lower(F.coalesce("text", F.lit("")))
    date = low.rlike(r"\b(?:19|20)\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
    work = low.rlike("inspection|aircraft|engine|tach|hobbs|maintenance|repaired")
    routing = F.when(n == 0, "scanned").when(F.col("reliable"), "native_text").otherwise("mixed")
    first = F.col("page_number") == 1
    role = F.when(first & (n < 200) & ~date, "cover").when(date | work, "logbook_entry").when(~first & (n > 0), "continuation").when(n == 0, "unknown").otherwise("attachment")
    native = routing == "native_text"
    words = lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<string>")
    aspect = F.col("aspect")
    shape = (
        F.when(aspect >= 2.2, words("side_by_side", "landscape")).when(aspect <= 0.8, F.concat(words("portrait"), F.when(native, none).otherwise(words("orientation_unverified"))))
        .when(aspect >= 1.5, words("wide_layout", "orientation_unverified")).otherwise(words("layout_uncertain"))
    )
    own = F.array(F.when(F.col("reliable"), "typed").otherwise("text_mode_uncertain"), F.when(F.col("page_count") > 1, "continuation_sensitive").otherwise("single_page"))
    turned = F.when(F.coalesce("rotation", F.lit(0.0)) != 0, words("rotated")).otherwise(none)
    faint = F.when(~native & (F.col("contrast") < 25), words("faint")).otherwise(none)
    return pages.select("page_id", routing.alias("routing_class"), role.alias("role"), F.array_distinct(F.concat(own, shape, turned, faint)).alias("attributes"), F.when(F.col("reliable"), 0.80).otherwise(0.45).cast("decimal(3,2)").alias("confidence"))


def extraction_plan(classes: DataFrame, agreement: Column | None = None) -> DataFrame:
    """Per page of page_class the regions and why a person must look: its orientation, its routing class, or texts that disagree."""
    split = F.array_contains("attributes", "side_by_side")
    agree = F.lit(None).cast("double") if agreement is None else agreement
    reasons = F.array_compact(F.array(
        F.when(F.array_contains("attributes", "orientation_unverified"), "orientation_unverified"), F.when(F.col("routing_class").isin("mixed", "uncertain"), "routing_class_uncertain"),
        F.when(agree < 0.90, "native_textract_disagreement"),
    ))
    return classes.select("page_id", F.when(split, F.lit(2)).otherwise(1).alias("regions"), (F.size(reasons) > 0).alias("review"), reasons.alias("reasons"))


def rule_numbers(xml: Column) -> Column:
    """Numbers that a rule's text names, distinct and in order: in its docket blocks, else at the head of amending paragraphs about directives, else anywhere."""
    text = F.coalesce(xml, F.lit(""))
    every = lambda s, pattern, k=1: F.regexp_extract_all(s, F.lit(pattern), F.lit(k))
    number = r"(?i)\b(\d{4}-\d{2}-\d{2})\b"
    docket = F.flatten(F.transform(every(text, r"(?is)<DEPDOC\b[^>]*>(.*?)</DEPDOC>"), lambda b: every(b, r"(?i)\bAD\s+(\d{4}-\d{2}-\d{2})\b")))
    heads = F.transform(every(text, r"(?is)(<AMDPAR\b[^>]*>.*?(?:airworthiness directive|AD).*?</AMDPAR>.{0,1500})"), lambda b: F.struct(every(b, r"(?i)<E\b[^>]*>\s*(\d{4}-\d{2}-\d{2})\b").alias("h"), every(b, number).alias("a")))
    amended = F.flatten(F.transform(heads, lambda x: F.when(F.size(x["h"]) > 0, F.slice(x["h"], 1, 1)).otherwise(x["a"])))
    return F.array_sort(F.array_distinct(F.when(F.size(docket) > 0, docket).when(F.size(amended) > 0, amended).otherwise(every(text, number))))


def current_results(matches: DataFrame, algorithm: str, version: str) -> DataFrame:
    """Matches of this algorithm and version that are current."""
    return matches.where((F.col("algorithm") == algorithm) & (F.col("version") == version) & F.col("is_current"))


def entry_order(drafts: DataFrame) -> DataFrame:
    """Drafts numbered within their job by date, those without one last, then by page and id."""
    return drafts.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(F.asc_nulls_last("entry_date"), "page", "draft_id")))


def run_attributes(uploads: DataFrame, results: DataFrame) -> DataFrame:
    """Billing of each result: chargeable only with consent, tags of the upload, price and pages of the result's metadata, else its page count.

    uploads: upload_id, account, aircraft, consent. results: upload_id, page_count, metadata (a map).
    """
    value = lambda k: F.nullif(F.trim(F.try_element_at("metadata", F.lit(k))), F.lit(""))
    number = lambda k, kind: F.when(value(k).try_cast(kind) >= 0, value(k).try_cast(kind))
    status = F.when(F.coalesce("consent", F.lit(False)), "chargeable").otherwise("not_billable")
    return results.join(uploads, "upload_id").select(
        "upload_id", status.alias("billing_status"), "account", "aircraft", F.substring(value("provider_channel"), 1, 64).alias("channel"), F.coalesce(F.substring(value("pricing_unit"), 1, 64), F.lit("page")).alias("unit"),
        number("pricing_rate_usd", "decimal(18,8)").alias("rate"), number("estimated_cost_usd", "decimal(18,8)").alias("estimate"), F.coalesce(number("billable_page_count", "int"), F.col("page_count")).alias("pages"),
    )


def page_fingerprint(pages: DataFrame) -> DataFrame:
    """(page_id, fingerprint): a hash of the page's boxes, its rotation and its content's hash."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("media_box", "crop_box", "rotation")]
    return pages.select("page_id", F.sha2(F.concat_ws("|", *parts, F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)), 256).alias("fingerprint"))


def model_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of JSON payloads(id, payload) those with a numeric confidence and lists of citations and uncertainty, taken apart, and the others with a reason."""
    v = F.try_parse_json("payload")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    listed = lambda k: kind(k).isNull() | kind(k).startswith("ARRAY")
    number = F.coalesce(kind("confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    reason = F.when(v.isNull(), "not_json").when(~number, "confidence_not_numeric").when(~listed("citations"), "citations_not_a_list").when(~listed("uncertaintyReasons"), "uncertainty_not_a_list")
    judged = payloads.withColumn("reason", reason)
    good = judged.where("reason is null")
    size = lambda k: F.coalesce(F.size(F.try_variant_get(v, f"$.{k}", "array<variant>")), F.lit(0))
    return good.select("id", F.try_variant_get(v, "$.confidence", "double").alias("confidence"), size("citations").alias("citations"), size("uncertaintyReasons").alias("uncertainty")), judged.where("reason is not null").select("id", "reason")


def rationale(number: Column, found: Column, why: Column, reasons: Column) -> Column:
    """What a match says for itself: satisfied by evidence, open for reasons, or without evidence."""
    number = F.coalesce(number, F.lit("unknown AD"))
    return (
        F.when(found & (F.size(reasons) == 0), F.concat(F.lit("Candidate satisfied: found logbook evidence for "), number, F.lit(" with "), why, F.lit(".")))
        .when(found, F.concat(F.lit("Needs adjudication: found possible evidence for "), number, F.lit(", but unresolved reasons remain: "), F.array_join(reasons, ", "), F.lit(".")))
        .otherwise(F.concat(F.lit("Needs adjudication: no logbook entry cites or strongly matches "), number, F.lit(".")))
    )


def applicability_snapshot(best: Applicability | DataFrame, components: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each (aircraft_id, directive_id, role) the component, the target and whether the serial is known, as one JSON record.

    best: these rows, or the classes that they are made from, of which the first role of
    each pair counts. Each side's part of the record is made once, not for each pair.
    """
    text = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    component = text("role", F.col("c_make").alias("make"), F.col("c_model").alias("model"), F.col("serial").alias("serialNumber"))
    target = text(F.col("product_type").alias("productType"), F.col("t_make").alias("make"), F.col("t_model").alias("model"))
    status = F.when(F.col("serial").isNull(), "unknown").otherwise("known")
    parts = components.where("aircraft_id is not null and role is not null").select("aircraft_id", "role", F.concat(F.lit('{"component":'), component, F.lit(',"target":')).alias("_c"), F.concat(F.lit(',"serialStatus":"'), status, F.lit('"}')).alias("_s"))
    wanted = targets.where("directive_id is not null").select("directive_id", target.alias("_t"))
    if isinstance(best, Applicability):
        out = best.pairs(first=True, aircraft=parts, directives=wanted)
    else:
        out = best.join(parts, ["aircraft_id", "role"]).join(wanted, "directive_id")
    return out.select("aircraft_id", "directive_id", F.concat("_c", "_t", "_s").alias("snapshot"))


def listed(rows: DataFrame, by: str, then: str) -> DataFrame:
    """rows in a list's order, sorted by ranges over many tasks: the largest `by` first and nulls last, of equal ones the largest `then`."""
    return rows.orderBy(F.desc_nulls_last(by), F.desc(then))


def labelled_text(fields: dict[str, str]) -> Column:
    """Lines `label: value` of the columns that are not null."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in fields.items()))


def joined_text(*columns: str) -> Column:
    """The columns' texts, null and empty ones left out, with a blank line between."""
    return F.concat_ws("\n\n", *(F.nullif(F.col(c), F.lit("")) for c in columns))


def round2(value: Column) -> Column:
    """A time to two decimals, halves to even."""
    return F.bround(value, 2)


def pending_directives(directives: DataFrame, n: int) -> DataFrame:
    """The first n directives by id that have no extraction or one to review: a top-k report."""
    return directives.where("extraction_status in ('not_started', 'needs_review')").orderBy("directive_id").limit(n)


def edited_fields(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of review_outcome's fields: how many were edited, and a map of the decisions."""
    item = F.struct("field", "decision")
    edited = F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("edited")
    return outcomes.groupBy(*keys).agg(edited, F.map_from_entries(F.array_sort(F.collect_list(item))).alias("decisions"))


def field_overrides(outcomes: DataFrame, entries: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """An evidence row for each field that a person changed in an entry made from recognised text that has evidence: old and new value, and where its first evidence stands.

    outcomes: review_outcome's rows. entries: keys, source_type. evidence: keys,
    evidence_id, created_at, upload_id, page_id.
    """
    changed = outcomes.where(~F.col("old").eqNullSafe(F.col("new"))).join(entries.where("source_type = 'ocr_ingestion'").select(*keys), keys, "left_semi")
    source = first_of(evidence, keys, "created_at", "evidence_id").select(*keys, "upload_id", "page_id")
    return changed.join(source, keys).select(*keys, "upload_id", "page_id", F.lit("human_override").alias("evidence_type"), F.col("field").alias("field_name"), F.col("old").alias("previous_value"), F.col("new").alias("new_value"))
