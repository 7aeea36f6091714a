"""Issues between sources: missing parts, stale ones, disagreements, reviews and their decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import text as tx
from tarmac.operators.jobs import SIGNATURE

# Degraded states of snapshots and of applicability, and fields of an extraction.
DEGRADED_SOURCES = ("partial", "failed", "stale", "unavailable")
DEGRADED_TARGETS = ("failed", "stale", "unavailable")
REQUIRED = (
    "adNumber", "title", "effectiveDate", "publicationDate", "affectedProducts", "complianceActions", "complianceIntervals", "supersedesAdNumbers", "sourceUrls",
)
LISTS = ("affectedProducts", "complianceActions", "complianceIntervals", "supersedesAdNumbers")


#: Keys of a publication's metadata that may tell of a change.
SIGNAL_KEYS = ("action", "correction", "document_type", "type")


def publication_signals(*texts: Column, metadata: Column | None = None) -> Column:
    """Words of supersession, correction and withdrawal in a publication's texts and in what its metadata (a map) says of changes, sorted."""
    told = [] if metadata is None else [F.try_element_at(metadata, F.lit(k)) for k in SIGNAL_KEYS]
    text = F.lower(F.concat_ws(" ", *texts, *told))
    has = lambda *words: F.greatest(*(text.contains(w) for w in words), F.lit(False))
    return F.array_compact(F.array(F.when(has("correction", "correcting"), "correction"), F.when(has("supersed"), "supersession"), F.when(has("withdraw", "rescinded"), "withdrawal")))


def _spec(df: DataFrame, kind: str, severity: Column | str, payload: dict[str, Column | str], **ids: str) -> DataFrame:
    """Rows of the signature, the severity, and the payload as JSON with its keys in the order given, nulls included."""
    columns = [F.lit(kind).alias("issue_type")] + [F.col(ids[k]).cast("long").alias(k) if k in ids else F.lit(None).cast("long").alias(k) for k in SIGNATURE[1:]]
    said = F.to_json(F.struct(*((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in payload.items())), {"ignoreNullFields": "false"})
    return df.select(*columns, (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), said.alias("payload"))


def issue_specs(snapshots: DataFrame, directives: DataFrame, publications: DataFrame, extractions: DataFrame, applicability: DataFrame, edges: DataFrame) -> DataFrame:
    """What is wrong now, as rows of the signature, a severity and a payload: the rules of all eight managed types.

    The payload holds all that may change while the issue stays the same one, so that a
    later run tells updated from unchanged.
    snapshots: snapshot_id, source_system, source_type, status, filename, content_hash,
    parser_name, parser_version. directives: directive_id, ad_number, status,
    extraction_status, review_status. publications: publication_id, directive_id,
    source_system, source_type, source_identifier, status, title, metadata (a map).
    extractions: directive_id, status. applicability: directive_id, publication_id,
    target_id, status, basis, product_type, product_subtype, make, model. edges:
    ad_number, supersedes.
    """
    d = directives.select("directive_id", "ad_number", F.col("status").alias("directive_status"), "extraction_status", "review_status")
    without = lambda child: d.join(child.select("directive_id").distinct(), "directive_id", "left_anti")
    sorted_set = lambda df, column, name: df.groupBy("directive_id").agg(F.array_sort(F.collect_set(column)).alias(name))
    known = sorted_set(publications, "source_system", "known")
    listed = lambda df: df.join(known, "directive_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    said = sorted_set(extractions, "status", "statuses").where(~F.array_contains("statuses", "approved"))
    targets = applicability.join(d, "directive_id")
    linked = edges.select(F.explode(F.array("ad_number", "supersedes")).alias("ad_number")).distinct().withColumn("_linked", F.lit(True))
    signals = publication_signals(F.col("status"), F.col("title"), metadata=F.col("metadata"))
    told = publications.withColumn("signals", signals).where(F.size("signals") > 0).join(d, "directive_id").join(linked, "ad_number", "left")
    told = told.where(F.col("_linked").isNull() | ~F.array_contains("signals", "supersession"))
    missing = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit("")) == "", c) for c in ("make", "model"))))
    of_target, number = {"directive_id": "directive_id", "publication_id": "publication_id", "target_id": "target_id"}, {"adNumber": "ad_number"}
    source = {"sourceSystem": "source_system", "sourceType": "source_type"}
    parts = [
        _spec(
            snapshots.where(F.col("status").isin(*DEGRADED_SOURCES)), "drs_source_degraded", F.when(F.col("status").isin("failed", "unavailable"), "high").otherwise("medium"),
            source | {"status": "status", "filename": "filename", "contentHash": "content_hash", "parserName": "parser_name", "parserVersion": "parser_version"}, source_snapshot_id="snapshot_id",
        ),
        _spec(listed(without(publications.where("source_system = 'federal_register'"))), "missing_federal_register_match", "medium", number | {"directiveStatus": "directive_status", "knownSourceSystems": "known"}, directive_id="directive_id"),
        _spec(without(extractions), "ad_extraction_missing", "medium", number | {"extractionStatus": "extraction_status", "reviewStatus": "review_status"}, directive_id="directive_id"),
        _spec(d.join(said, "directive_id"), "ad_extraction_incomplete", "medium", number | {"extractionStatuses": "statuses", "reviewStatus": "review_status"}, directive_id="directive_id"),
        _spec(listed(without(applicability)), "applicability_missing", "high", number | {"sourceSystems": "known"}, directive_id="directive_id"),
        _spec(targets.where(F.col("status").isin(*DEGRADED_TARGETS)), "target_applicability_stale", "medium", number | {"applicabilityStatus": "status", "basis": "basis"}, **of_target),
        _spec(targets.where(F.size(missing) > 0), "applicability_target_incomplete", "medium", number | {"productType": "product_type", "productSubtype": "product_subtype", "missing": missing}, **of_target),
        _spec(told, "supersession_correction_conflict", "low", number | source | {"sourceIdentifier": "source_identifier", "signals": "signals"}, directive_id="directive_id", publication_id="publication_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def register_match(directives: DataFrame, documents: DataFrame) -> DataFrame:
    """Per directive the register document that names its number, how many do, and an issue where none does or it has no number.

    directives: directive_id, ad_number. documents: document_number, title, abstract, excerpts.
    The number is the first in title, abstract and excerpts; the smallest document counts.
    """
    named = documents.select("document_number", tx.directive_number(F.concat_ws(" ", "title", "abstract", "excerpts")).alias("ad_number")).where("ad_number is not null")
    found = named.groupBy("ad_number").agg(F.min("document_number").alias("document_number"), F.countDistinct("document_number").alias("documents"))
    out = directives.select("directive_id", "ad_number").withColumn("_n", tx.directive_number(F.col("ad_number"))).join(found.withColumnRenamed("ad_number", "_n"), "_n", "left")
    issue = F.when(F.coalesce("ad_number", F.lit("")) == "", "fr_match_missing_ad_number").when(F.col("document_number").isNull(), "missing_federal_register_match")
    severity = F.when(issue == "fr_match_missing_ad_number", "high").when(issue.isNotNull(), "medium")
    same = F.count("*").over(Window.partitionBy("ad_number"))
    out = out.withColumn("duplicate", F.col("ad_number").isNotNull() & F.col("document_number").isNotNull() & (same > 1))
    return out.select("directive_id", "ad_number", "document_number", F.coalesce("documents", F.lit(0)).alias("documents"), "duplicate", issue.alias("issue"), severity.alias("severity"))


def _scalar(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")


def _list(c: Column) -> Column:
    return F.array_sort(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: _scalar(x)), lambda x: x != ""))


def review_reasons(model: DataFrame, rules: DataFrame, least: float = 0.80) -> DataFrame:
    """(directive_id, reasons): why a model's extraction goes to a person, from itself and from the rules' extraction of the same directive."""
    m, r = model.alias("m"), rules.alias("r")
    both = m.join(r, "directive_id")
    empty = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    differ = lambda c: _list(F.col(f"m.{c}")) != _list(F.col(f"r.{c}"))
    reasons = F.array(
        F.when(F.col("m.confidence") < least, "low_confidence"), F.when(empty("m.products"), "missing_affected_products"), F.when(empty("m.actions"), "missing_compliance_actions"),
        F.when(~empty("m.uncertainty"), "provider_uncertainty"), F.when(_scalar(F.col("m.ad_number")) != _scalar(F.col("r.ad_number")), "ad_number_disagreement"),
        F.when(differ("supersedes"), "supersession_disagreement"), F.when(~empty("r.products") & differ("products"), "applicability_disagreement"),
    )
    return both.select("directive_id", F.array_sort(F.array_compact(reasons)).alias("reasons"))


def missing_fields(outputs: DataFrame) -> DataFrame:
    """(id, issues) of JSON outputs(id, output): required keys that are missing, lists that are none, no product; sorted."""
    fields = F.from_json("output", "map<string,variant>")
    has = lambda k: F.coalesce(F.map_contains_key("_f", k), F.lit(False))
    kind = lambda k: F.schema_of_variant(F.try_element_at("_f", F.lit(k)))
    products = F.from_json(F.get_json_object("output", "$.affectedProducts"), "array<string>")
    some = F.exists(F.coalesce(products, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    issues = [F.when(~has(k), F.lit(f"missing:{k}")) for k in REQUIRED] + [F.when(has(k) & ~kind(k).startswith("ARRAY"), F.lit(f"not_a_list:{k}")) for k in LISTS]
    issues += [F.when(has("affectedProducts") & kind("affectedProducts").startswith("ARRAY") & ~some, "no_product"), F.when(has("sourceUrls") & ~kind("sourceUrls").startswith("OBJECT"), "not_an_object:sourceUrls")]
    return outputs.withColumn("_f", fields).select("id", F.array_sort(F.array_compact(F.array(*issues))).alias("issues"))


def applicability_from_extraction(extractions: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets that extractions list, with older rows of theirs superseded, and issues of those without a product.

    extractions: directive_id, extraction_id, products, confidence. existing: directive_id,
    target_key, basis, status, confidence. Confidence is put into 0.55..0.86.
    """
    products = F.filter(F.coalesce("products", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    e = extractions.withColumn("_p", products)
    found = e.select("directive_id", "confidence", F.explode("_p").alias("p")).withColumn("t", tx.product_of(F.col("p")))
    key = tx.target_key(F.col("t.product_type"), F.lit(None).cast("string"), F.col("t.make"), F.col("t.model"))
    put = F.least(F.greatest(F.col("confidence").cast("decimal(4,2)"), F.lit(0.55).cast("decimal(4,2)")), F.lit(0.86).cast("decimal(4,2)"))
    new = found.select("directive_id", key.alias("target_key"), F.lit("extraction").alias("basis"), F.lit("current").alias("status"), put.alias("confidence"))
    new = new.groupBy("directive_id", "target_key", "basis", "status").agg(F.max("confidence").alias("confidence"))
    again = e.where(F.size("_p") > 0).select("directive_id").distinct().withColumn("_again", F.lit(True))
    old = existing.join(again, "directive_id", "left").withColumn("status", F.when(F.col("_again") & (F.col("basis") == "extraction") & (F.col("status") == "current"), "superseded").otherwise(F.col("status"))).drop("_again")
    # A target that is found again takes the place of its older row.
    old = old.join(new.select("directive_id", "target_key", "basis"), ["directive_id", "target_key", "basis"], "left_anti")
    issues = e.where(F.size("_p") == 0).select("directive_id", "extraction_id", F.lit("missing_extracted_applicability").alias("issue_type"), F.lit("medium").alias("severity"))
    return old.unionByName(new.select(old.columns)), issues


def adjudication_tasks(results: DataFrame, existing: DataFrame) -> DataFrame:
    """(match_id, status, decision) of tasks after a run: open matches are pending, decided anew where they had been; others need none."""
    both = results.select("match_id", F.col("status").alias("_result")).join(existing, "match_id", "full_outer")
    open_, none = F.coalesce(F.col("_result") == "needs_adjudication", F.lit(False)), F.col("status").isNull()
    status = F.when(open_, "pending").when(F.col("_result").isNotNull() & (F.col("status") == "pending"), "not_required").otherwise(F.col("status"))
    return both.where(open_ | ~none).select("match_id", status.alias("status"), F.when(~open_ | (F.col("status") == "pending"), F.col("decision")).alias("decision"))


def extraction_reviews(extractions: DataFrame, reviews: DataFrame) -> DataFrame:
    """(directive_id, extraction_status, review_status, new_review) by each directive's latest extraction; a review is opened once."""
    seen = reviews.select("extraction_id").distinct().withColumn("_seen", F.lit(True))
    last = extractions.withColumn("_k", F.row_number().over(Window.partitionBy("directive_id").orderBy(F.desc("created_at"), F.desc("extraction_id")))).where("_k = 1").drop("_k")
    done = F.col("status") == "approved"
    return last.join(seen, "extraction_id", "left").select(
        "directive_id", "extraction_id", F.when(done, "complete").otherwise("needs_review").alias("extraction_status"), F.when(done, "approved").otherwise("pending").alias("review_status"), (~done & F.col("_seen").isNull()).alias("new_review")
    )


def apply_decisions(tasks: DataFrame, decisions: DataFrame, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Tasks with the latest allowed decision of each pending one, and the decisions that are refused, with a reason.

    tasks: match_id, status, is_current. decisions: decision_id, match_id, decision, reviewer, decided_at.
    """
    known = decisions.join(tasks.select("match_id", F.col("status").alias("_status"), "is_current"), "match_id", "left")
    reason = (
        F.when(~F.coalesce(F.col("decision").isin(*allowed), F.lit(False)), "unknown_decision").when(F.col("_status").isNull(), "unknown_match")
        .when(~F.col("is_current"), "stale_match").when(F.col("_status") != "pending", "not_pending")
    )
    judged = known.withColumn("reason", reason)
    last = judged.where("reason is null").groupBy("match_id").agg(F.max_by(F.struct("decision", "reviewer", "decided_at"), F.struct("decided_at", "decision_id")).alias("_d"))
    out = tasks.join(last, "match_id", "left")
    status = F.when(F.col("_d").isNotNull(), F.concat(F.lit("adjudicated_"), F.col("_d.decision"))).otherwise(F.col("status"))
    return out.select("match_id", status.alias("status"), "is_current", F.col("_d.reviewer").alias("reviewer"), F.col("_d.decided_at").alias("decided_at")), judged.where("reason is not null").select("decision_id", "match_id", "reason")


def current_matches(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both runs, one for each replay key, where only the new run's are current; a key found again is current again.

    old and new: the keys, aircraft_id, run. Aircraft that the new run did not look at keep theirs.
    """
    looked = new.select("aircraft_id").distinct().withColumn("_looked", F.lit(True))
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumns({"is_current": F.lit(True), "_new": F.lit(True)}), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("run"))
    rows = both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k").join(looked, "aircraft_id", "left")
    return rows.withColumn("is_current", F.when(F.col("_looked"), F.col("_new")).otherwise(F.col("is_current"))).drop("_new", "_looked")
