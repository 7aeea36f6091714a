"""Entry facts, validation, review measures, sample reports and text payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_document(kind: Column, *texts: Column) -> Column:
    """(class, confidence) of a register document by its type, title, abstract and excerpts: directive wording, a rule with a number, any other rule, anything else."""
    said = lambda c, x: F.struct(F.lit(c).alias("class"), F.lit(x).cast("decimal(3,2)").alias("confidence"))
    text = F.lower(F.concat_ws(" ", *texts))
    rule = F.upper(F.coalesce(kind, F.lit(""))) == "RULE"
    number = text.rlike(r"\b\d{4}-\d{2}-\d{2}\b")
    return F.when(text.contains("airworthiness directive"), said("ad_candidate", 0.96)).when(rule & number, said("ad_candidate", 0.78)).when(rule, said("non_ad_rule", 0.82)).otherwise(said("rejected", 0.90))


#: How a credential is written, and a citation in a draft.
CREDENTIAL = r"(?i)\b(?:A\s*&\s*P|IA|FAA\s+CRS|CRS|repair\s+station|certificate)\b|\b[A-Z0-9]{5,12}\b"
CITATION = r"(?i)\bAD(?:s|'s)?\s*[:#]?\s*(\d{2,4})[-/](\d{1,2})[-/](\d{1,2})\b"
_TIMES = ("tach_time", "hobbs_time", "total_time")


def validate_candidates(drafts: DataFrame, today: str) -> DataFrame:
    """drafts with issues (field, code, severity), a status, whether they could be accepted unseen, results of their fields, and the citations printed in their lines.

    drafts: date_was_extracted, entry_date, description, tach_time, hobbs_time, total_time,
    performer_name, performer_credential, spans (a map from field to its source text),
    lines, requires_review. A zero counts only where its source says so. Any blocking
    issue rejects; others leave the draft to a person. A field's result is its value as
    text, whether a source supports it, and its disposition: null, candidate, unsupported,
    or rejected for a date that can't be.
    """
    c, spans = F.col, F.col("spans")
    has = lambda f: F.coalesce(F.map_contains_key(spans, f), F.lit(False))
    text = lambda f: F.coalesce(F.try_element_at(spans, F.lit(f)), F.lit(""))

    def issue(holds: Column, field: str | None, code: str, severity: str = "blocking") -> Column:
        return F.when(holds, F.struct(F.lit(field).cast("string").alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    missing = ~F.coalesce(c("date_was_extracted"), F.lit(False)) | c("entry_date").isNull()
    found = [
        issue(missing, "entry_date", "source_supported_date_missing"),
        issue(~missing & (c("entry_date") > F.to_date(F.lit(today))), "entry_date", "future_date"),
        issue(~missing & (F.year("entry_date") < 1900), "entry_date", "implausible_historical_date"),
        issue((F.trim(F.coalesce("description", F.lit(""))) == "") | ~has("description"), "description", "source_supported_description_missing"),
    ]
    for f in _TIMES:
        zero = text(f).rlike(rf"(?i)\b{f.removesuffix('_time')}\b\s*[:=]?\s*0(?:\.0+)?\b")
        found += [issue(c(f) < 0, f, "negative_time_value"), issue((c(f) == 0) & ~zero, f, "zero_not_explicit_in_source")]
    found += [issue(c(f) > c("total_time"), f, f"{f}_exceeds_total_time") for f in _TIMES[:2]]
    name, credential = F.coalesce("performer_name", F.lit("")), F.coalesce("performer_credential", F.lit(""))
    found += [
        issue((name != "") & ((F.length(F.trim(name)) < 3) | ~name.rlike("[A-Za-z]")), "performer_name", "performer_name_not_credible"),
        issue((credential != "") & ~credential.rlike(CREDENTIAL), "performer_credential", "performer_credential_pattern_uncertain", "review"),
        issue(F.coalesce(c("requires_review"), F.lit(False)), None, "multiple_entry_segmentation_requires_review", "review"),
    ]
    source = F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")
    cited = F.transform(F.regexp_extract_all(source, F.lit(CITATION), F.lit(0)), lambda x: F.concat_ws("-", *(F.regexp_extract(x, CITATION, k) for k in (1, 2, 3))))
    out = drafts.withColumn("issues", F.array_compact(F.array(*found)))
    status = F.when(F.exists("issues", lambda x: x["severity"] == "blocking"), "rejected").when(F.size("issues") > 0, "passed_with_review").otherwise("passed")
    late = (c("entry_date") > F.to_date(F.lit(today))) | (F.year("entry_date") < 1900)

    def result(f: str, supported: Column, disposition: Column, value: Column | None = None) -> Column:
        return F.struct(F.lit(f).alias("field"), (c(f).cast("string") if value is None else value).alias("value"), supported.alias("source_supported"), disposition.alias("disposition"))

    described = (F.trim(F.coalesce("description", F.lit(""))) != "") & has("description")
    results = [
        result("entry_date", ~missing & ~late, F.when(missing, "unsupported").when(late, "rejected").otherwise("candidate"), F.when(~missing, c("entry_date").cast("string"))),
        result("description", described, F.when(described, "candidate").otherwise("unsupported"), F.nullif(c("description"), F.lit(""))),
    ]
    for f in (*_TIMES, "performer_name", "performer_credential"):
        results.append(result(f, c(f).isNull() | has(f), F.when(c(f).isNull(), "null").when(has(f), "candidate").otherwise("unsupported")))
    return out.withColumns({"status": status, "accepted": F.size("issues") == 0, "field_results": F.array(*results), "cited": F.array_sort(F.array_distinct(cited))})


def _ratio(a: Column, b: Column) -> Column:
    """a / b to 6 places, half to even; null where b is 0."""
    return F.bround(F.try_divide(a.cast("decimal(20,0)"), F.nullif(b, F.lit(0)).cast("decimal(18,0)")), 6).cast("decimal(18,6)")


def review_metrics(entries: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: entries extracted, reviewed and verified, the rate, median seconds, mean edits, and the decisions on fields.

    entries: keys, entry_id, review_status. outcomes: keys, seconds, edits, decisions (a map
    from field to accepted, corrected, null or unresolved), one row for each reviewed entry.
    The accepted share is that of accepted and corrected fields; null without any.
    """
    e = entries.groupBy(*keys).agg(F.countDistinct("entry_id").alias("extracted"), F.countDistinct(F.when(F.col("review_status") == "verified", F.col("entry_id"))).alias("verified"))
    said = F.map_values(F.coalesce("decisions", F.create_map().cast("map<string,string>")))
    n = lambda kind: F.coalesce(F.sum(F.size(F.filter(said, lambda x: x == kind))), F.lit(0)).alias(kind)
    third = lambda c: F.bround(c.cast("decimal(28,9)"), 3).cast("decimal(18,3)")
    o = outcomes.groupBy(*keys).agg(
        F.count("*").alias("reviewed"), third(F.percentile("seconds", 0.5)).alias("median_seconds"), third(F.avg("edits")).alias("mean_edits"),
        *(n(k) for k in ("accepted", "corrected", "null", "unresolved")), F.sum(F.size(said)).alias("decided"),
    )
    out = e.join(o, keys, "left")
    count = lambda k: F.coalesce(k, F.lit(0)).cast("long")
    return out.select(
        *keys, "extracted", count("reviewed").alias("reviewed"), "verified", F.coalesce(_ratio(F.col("verified"), F.col("extracted")), F.lit(0).cast("decimal(18,6)")).alias("verification_rate"),
        "median_seconds", "mean_edits", _ratio(F.col("accepted"), F.col("accepted") + F.col("corrected")).alias("accepted_share"),
        *(count(k).alias(f"{k}_fields") for k in ("accepted", "decided", "unresolved", "null")),
    )


def sample_report(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts by original status, and how many of each are missing from ids."""
    have = ids.select("doc_id").distinct().withColumn("_here", F.lit(True))
    return samples.join(have, "doc_id", "left").groupBy("status").agg(F.count("*").alias("samples"), F.count_if(F.col("_here").isNull()).alias("missing"))


def sample_crosscheck(samples: DataFrame, ids: DataFrame | None) -> DataFrame:
    """samples(id, status) with bulk_present and the status that counts: missing where ids lacks the sample; without a set of ids presence is null and the status stays (ambiguous where there is none)."""
    given = samples.withColumn("original_status", F.coalesce("status", F.lit("ambiguous")))
    if ids is None:
        return given.withColumn("bulk_present", F.lit(None).cast("boolean")).withColumn("status", F.col("original_status"))
    have = ids.select("id").distinct().withColumn("_here", F.lit(True))
    checked = given.join(have, "id", "left").withColumn("bulk_present", F.coalesce("_here", F.lit(False))).drop("_here")
    return checked.withColumn("status", F.when(F.col("bulk_present"), F.col("original_status")).otherwise("missing"))


#: States of a sample that leave it open.
AMBIGUOUS = ("ambiguous", "snapshot_unparseable", "historical_source_unavailable")


def sample_confidence(checked: DataFrame) -> DataFrame:
    """One row: samples, missing, ambiguous, and low where any is missing, high where none is open, else conditional; no samples are conditional."""
    out = checked.agg(F.count("*").alias("samples"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status").isin(*AMBIGUOUS)).alias("ambiguous"))
    level = F.when(F.col("missing") > 0, "low").when((F.col("ambiguous") == 0) & (F.col("samples") > 0), "high").otherwise("conditional")
    return out.withColumn("confidence", level)


def partition_check(assigned: DataFrame, item: str, part: str) -> DataFrame:
    """Items in more than one partition."""
    return assigned.groupBy(item).agg(F.countDistinct(part).alias("parts")).where("parts > 1")


#: Property names that are never stored, and parts of names.
BLOCKED = ("password", "token", "secret", "raw_text", "ocr_text", "file_content", "file_bytes", "corrected_text", "original_text", "message_body")
BLOCKED_PARTS = ("password", "secret", "token")


def _clean(value):
    """Nested properties without blocked names; texts up to 256 characters, lists up to 20 items."""
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items() if k.lower() not in BLOCKED and not any(x in k.lower() for x in BLOCKED_PARTS)}
    if isinstance(value, list):
        return [_clean(v) for v in value[:20]]
    return value[:256] if isinstance(value, str) else value


def _sanitized(props: pd.Series) -> pd.Series:
    def one(text):
        try:
            found = json.loads(text or "{}")
        except ValueError:
            return "{}"
        return json.dumps(_clean(found) if isinstance(found, dict) else {}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return props.map(one)


def sanitized(props: Column) -> Column:
    """A JSON object's properties that may be stored, with keys in order; what is no object becomes an empty one. JSON nests to any depth, so Arrow batches in Python."""
    return F.pandas_udf(_sanitized, "string")(props)


def extract_with(directives: DataFrame, cache: DataFrame, user_fn, schema: str, keys: list[str]) -> DataFrame:
    """Plug-in extractor: rows whose keys aren't in the cache go through user_fn (pandas batches), the others come from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield user_fn(batch)

    fresh = directives.join(cache.select(*keys), keys, "left_anti").mapInPandas(run, schema)
    return cache.join(directives.select(*keys), keys, "left_semi").unionByName(fresh)
