"""Billing, feeds, queues, review, reconciliation and page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.applicability import Applicability
from tarmac.streaming.folders import shared_folder

MONEY = "decimal(18,6)"


def tag_text(tags: Column, key: str) -> Column:
    """A tag's text without blanks at its ends; null where it is missing or blank."""
    return F.nullif(F.trim(F.try_element_at(tags, F.lit(key))), F.lit(""))


def tag_count(tags: Column, key: str) -> Column:
    """A tag's whole number; 0 where it is missing, none, or negative."""
    return F.coalesce(F.greatest(F.trim(F.try_element_at(tags, F.lit(key))).try_cast("long"), F.lit(0)), F.lit(0)).cast("long")


def billing_summary(
    runs: DataFrame, since: str | None = None, until: str | None = None, account: str | None = None, aircraft: str | None = None, billing: str | None = None
) -> DataFrame:
    """Totals, per account and aircraft, and per provider, in one pass over the runs of [since, until).

    Only complete runs are summed; the total counts the others, and its groups. level is 127
    for the total, 31 for account and aircraft, 0 with the five provider keys: null tags
    are groups of their own. A run costs its estimate, else its rate for each page; one with
    neither is unpriced, which differs from a price of 0. Blank filters select nothing out.
    runs: upload_id, account, aircraft, provider, version, tags (a map), status,
    billing_status, pages, unit, rate, estimate, created.
    """
    if since and until and since > until:
        raise ValueError("the period ends before it begins")
    for name, value in (("account", account), ("aircraft", aircraft), ("billing_status", billing)):
        if value and value.strip():
            runs = runs.where(F.col(name) == value.strip())
    if since:
        runs = runs.where(F.col("created") >= F.to_date(F.lit(since)))
    if until:
        runs = runs.where(F.col("created") < F.to_date(F.lit(until)))
    done, tags = F.col("status") == "complete", F.col("tags")
    pages = F.when(F.col("unit") == "page", F.greatest(F.coalesce("pages", F.lit(0)), F.lit(0))).otherwise(0).cast("long")
    cost = F.coalesce("estimate", F.when((F.col("unit") == "page") & F.col("pages").isNotNull(), F.col("rate") * F.greatest("pages", F.lit(0))))
    keys = ["account", "aircraft", "provider", "version", "channel", "mode", "routing"]
    rows = runs.withColumns({
        "channel": tag_text(tags, "provider_channel"), "mode": tag_text(tags, "provider_mode"), "routing": tag_text(tags, "routing_mode"), "_done": done,
        "_pages": F.when(done, pages), "_cost": F.when(done, cost).cast(MONEY), "_bypass": F.when(done, tag_count(tags, "native_bypass_page_count")),
        "_counted": F.when(done, F.when(F.coalesce(F.map_contains_key(tags, "textract_page_count"), F.lit(False)), tag_count(tags, "textract_page_count")).when(tag_text(tags, "provider_channel") == "aws", pages).otherwise(0)),
        "_group": F.when(done, F.struct("account", "aircraft")), "_kind": F.when(F.col("billing_status").isin("chargeable", "not_billable"), F.col("billing_status")).otherwise("other"),
    })
    kinds = ("chargeable", "not_billable", "other")
    unpriced = F.col("_done") & F.col("_cost").isNull()
    of = lambda kind, c: F.when(F.col("_kind") == kind, c)
    out = rows.groupingSets([[], keys[:2], keys], *keys).agg(
        F.grouping_id().cast("int").alias("level"), F.count_if(F.col("_done")).alias("runs"), F.countDistinct(F.when(F.col("_done"), F.col("upload_id"))).alias("uploads"),
        F.count_if(F.col("_done") & (F.col("account").isNull() | F.col("aircraft").isNull())).alias("unattributed"), F.count_if(unpriced).alias("unpriced"),
        *(F.count_if(unpriced & (F.col("_kind") == k)).alias(f"{k}_unpriced") for k in kinds), F.count_if(F.col("_done") & ~F.col("unit").eqNullSafe("page")).alias("not_by_page"),
        *(F.coalesce(F.sum(of(k, F.col("_pages"))), F.lit(0)).alias(f"{k}_pages") for k in kinds), F.coalesce(F.sum("_bypass"), F.lit(0)).alias("bypass_pages"), F.coalesce(F.sum("_counted"), F.lit(0)).alias("counted_pages"),
        F.coalesce(F.sum("_cost"), F.lit(0)).cast(MONEY).alias("cost"), *(F.coalesce(F.sum(of(k, F.col("_cost"))), F.lit(0)).cast(MONEY).alias(f"{k}_cost") for k in kinds),
        F.countDistinct("_group").alias("groups"), F.count_if(~F.col("_done")).alias("excluded"),
    )
    total = F.col("level") == 127
    return out.where(total | (F.col("runs") > 0)).withColumns({"groups": F.when(total, F.col("groups")), "excluded": F.when(total, F.col("excluded"))})


def matcher_status(events: DataFrame) -> DataFrame:
    """Per aircraft the last completed or invalidated event decides; others don't count."""
    last = F.max_by("kind", F.struct("event_time", "event_id"))
    out = events.where("kind <> 'other'").groupBy("aircraft_id").agg(last.alias("last_kind"), F.max("event_time").alias("last_time"))
    return out.withColumn("status", F.when(F.col("last_kind") == "completed", "current").otherwise("pending_recomputation"))


def id_coverage(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Share of wanted ids that are there, and a verdict; ids in column id, compared as sets."""
    w, h = wanted.select("id").distinct(), have.select("id").distinct().withColumn("found", F.lit(1))
    out = w.join(h, "id", "left").agg(F.count("*").alias("wanted"), F.count("found").alias("found"))
    share = F.col("found") / F.nullif(F.col("wanted"), F.lit(0))
    return out.withColumn("verdict", F.when(share >= 0.98, "PASS").when(share >= 0.85, "CONDITIONAL").otherwise("FAIL"))


def gap_sample(wanted: DataFrame, have: DataFrame, n: int = 20) -> DataFrame:
    return wanted.select("id").distinct().join(have.select("id"), "id", "left_anti").orderBy("id").limit(n)


def effective_directives(edges: DataFrame) -> DataFrame:
    """(ad_number, effective, steps) of each superseded directive: every end of its chains and the longest way there; null where it only leads into a cycle.

    Each round joins the ways with themselves, so that they grow twofold; a way to an end
    stays as it is. Ways that have not ended after twice the logarithm of the number of
    edges lie in a cycle.
    """
    spark = edges.sparkSession
    root, turn = shared_folder(spark, "chains"), 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        df.write.parquet(f"{root}/{turn}")
        return spark.read.schema(df.schema).parquet(f"{root}/{turn}")

    e = edges.select(F.col("supersedes").alias("old"), F.col("ad_number").alias("new")).where("old <> new").distinct()
    more = e.select(F.col("old").alias("new"), F.lit(True).alias("_more")).distinct()
    ways = kept(e.join(more, "new", "left").select("old", "new", F.lit(1).cast("long").alias("steps"), F.col("_more").isNull().alias("ended")))
    for _ in range(2 * max(ways.count(), 1).bit_length()):
        going = ways.where("not ended and old <> new")
        if going.isEmpty():
            break
        on = ways.toDF("new", "_to", "_steps", "_ended")
        longer = going.join(on, "new").select("old", F.col("_to").alias("new"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended"))
        both = ways.where("ended or old = new").unionByName(longer)
        ways = kept(both.groupBy("old", "new").agg(F.max("steps").alias("steps"), F.bool_or("ended").alias("ended")))
    ends = ways.groupBy("old").agg(F.bool_or("ended").alias("_any"))
    out = ways.where("ended").unionByName(ends.where("not _any").select("old", F.lit(None).cast("string").alias("new"), F.lit(None).cast("long").alias("steps"), F.lit(False).alias("ended")))
    return out.select(F.col("old").alias("ad_number"), F.col("new").alias("effective"), "steps")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "n")


def correction_order(corrections: DataFrame) -> DataFrame:
    """Corrections numbered per span, and whether each is the one in effect."""
    order = Window.partitionBy("span_id").orderBy("created", "correction_id")
    last = F.max_by("correction_id", F.struct("created", "correction_id")).over(Window.partitionBy("span_id"))
    return corrections.withColumn("correction_order", F.row_number().over(order)).withColumn("in_effect", F.col("correction_id") == last)


def page_spans(documents: DataFrame) -> DataFrame:
    """One span per line of a page: place and confidence."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"), F.size(F.split("text", "\n")).alias("n"))
    kind = F.when(F.col("line_no") % 5 == 4, "TABLE").otherwise("LINE")
    return lines.select(F.col("doc_id").alias("page_id"), "line_no", kind.alias("span_type"), "text", (F.col("line_no") * 1000 / F.col("n")).cast("int").alias("center"), ((F.col("doc_id") + F.col("line_no")) % 100).cast("int").alias("confidence"))


def span_stats(spans: DataFrame, low: int = 80) -> DataFrame:
    """Per page: spans by type, the sum and mean of lines' confidence (null without any), lines to correct, and a sorted map of types."""
    line = F.col("span_type") == "LINE"
    return spans.groupBy("page_id").agg(
        F.count_if(line).alias("lines"), F.count_if(~line).alias("tables"), F.count_if(line & (F.col("confidence") < low)).alias("to_correct"),
        F.sum(F.when(line, F.col("confidence"))).cast("long").alias("confidence_sum"), F.array_join(F.array_sort(F.collect_set("span_type")), ",").alias("types"),
        F.bround(F.avg(F.when(line, F.col("confidence"))).cast("decimal(18,9)"), 3).cast("decimal(9,3)").alias("confidence"),
    )


def anchor_clusters(spans: DataFrame, anchors: DataFrame, lookback: int = 140, gap: int = 20) -> DataFrame:
    """Spans of each anchor's stretch of the page, in thousandths of its height; a span may fall in two.

    A stretch begins at the later of `lookback` above the anchor and the middle to the one before, and ends `gap` above the next.
    """
    w = Window.partitionBy("page_id").orderBy("center", "line_no")
    before, after = F.lag("center").over(w), F.lead("center").over(w)
    begin = F.greatest(F.lit(0), F.col("center") - lookback, F.coalesce(((before + F.col("center")) / 2).cast("int"), F.lit(0)))
    end = F.greatest(begin, F.coalesce(after - gap, F.lit(1000)))
    bounds = anchors.select("page_id", F.col("line_no").alias("anchor"), begin.alias("lo"), end.alias("hi"))
    met = bounds.join(spans.select("page_id", "line_no", "center"), "page_id").where("center >= lo and center < hi")
    return met.groupBy("page_id", "anchor").agg(F.count("*").alias("spans"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


#: The columns that make an issue the same one, and the types that a run may resolve.
SIGNATURE = ("issue_type", "directive_id", "publication_id", "target_id", "aircraft_id", "source_snapshot_id")
MANAGED = (
    "drs_source_degraded", "missing_federal_register_match", "ad_extraction_missing", "ad_extraction_incomplete",
    "applicability_missing", "target_applicability_stale", "applicability_target_incomplete", "supersession_correction_conflict",
)


def issue_diff(open_issues: DataFrame, found: DataFrame, keys: tuple[str, ...] = SIGNATURE, managed: tuple[str, ...] = MANAGED) -> DataFrame:
    """Each signature once: opened, updated, unchanged or resolved.

    Signatures are compared null-safe. Of those found twice the one with the largest
    payload counts. Open issues of other than the managed types are left alone.
    """
    o = open_issues.where(F.col("issue_type").isin(*managed))
    o, f = (d.groupBy(*keys).agg(F.max(F.struct("payload", "severity")).alias("x")).withColumn("here", F.lit(True)) for d in (o, found))
    o, f = o.alias("o"), f.alias("f")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}"))
    both = o.join(f, same, "full_outer")
    action = F.when(F.col("o.here").isNull(), "opened").when(F.col("f.here").isNull(), "resolved").when(F.col("o.x").eqNullSafe(F.col("f.x")), "unchanged").otherwise("updated")
    return both.select(*(F.coalesce(f"f.{k}", f"o.{k}").alias(k) for k in keys), action.alias("action"))


def job_completion(entries: DataFrame) -> DataFrame:
    """Per job: entries, verified ones, and complete once all are verified."""
    out = entries.groupBy("entry_id").agg(F.count("*").alias("entries"), F.count_if(F.col("review_status") == "verified").alias("verified"), F.max("entry_date").alias("last_date"))
    return out.withColumn("status", F.when(F.col("entries") == F.col("verified"), "complete").otherwise("awaiting_review"))


def affected_aircraft(matches: Applicability | DataFrame, subscribers: DataFrame, directives: DataFrame) -> DataFrame:
    """Aircraft with a match on, or a subscription to, one of the directives.

    matches: pairs, or the classes that they are made from, which spares a shuffle of the pairs.
    """
    subs = subscribers.join(directives, "directive_id", "left_semi").select("aircraft_id", "directive_id")
    if not isinstance(matches, Applicability):
        return matches.join(directives, "directive_id", "left_semi").select("aircraft_id", "directive_id").unionByName(subs).distinct()
    matches = matches.of_only(directives).written(shared_folder(subs.sparkSession, "affected"))
    linked = matches.first_roles(subs)
    same = F.col("s.aircraft_id").eqNullSafe(F.col("l.aircraft_id")) & (F.col("s.directive_id") == F.col("l.directive_id"))
    others = subs.distinct().alias("s").join(linked.alias("l"), same, "left_anti").select("aircraft_id", "directive_id")
    return matches.pairs(first=True).select("aircraft_id", "directive_id").unionByName(others)


def recent_feed(df: DataFrame, n: int, *newest_first: str) -> DataFrame:
    """The n newest rows: a top-k report."""
    return df.orderBy(*(F.desc(c) for c in newest_first)).limit(n)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """target with the latest update of each key in place of its row, and rows of new keys; created tells which."""
    new = latest(updates, keys, order).select(target.columns)
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    new = new.join(known, keys, "left").withColumn("created", F.col("_known").isNull()).drop("_known")
    return target.join(new.select(*keys), keys, "left_anti").withColumn("created", F.lit(False)).unionByName(new)


def run_cost(unit: Column, pages: Column, seconds: Column, rate: Column) -> Column:
    """A run's cost to 6 places, halves to even: pages at the rate, or hours of processing at it where the unit is compute_hour; null without a rate."""
    exact = lambda c: c.cast("decimal(18,8)")
    hours = F.when(unit == "compute_hour", exact(seconds) * exact(rate) / F.lit(3600))
    return F.bround(F.coalesce(hours, exact(pages) * exact(rate)), 6).cast(MONEY)


def span_type_counts(spans: DataFrame) -> DataFrame:
    """(page_id, types): per page a map from each type of span to how many there are."""
    n = spans.groupBy("page_id", "span_type").agg(F.count("*").alias("n"))
    return n.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("span_type", "n")))).alias("types"))
