"""Draft entries from the text spans of pages: columns, stretches between anchor lines, fields, and the span behind each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import entries as en

# Where the right column begins, how far a stretch reaches above its anchor and stays clear of the next, and how near a line of another column has to be, as shares of the page.
RIGHT = 0.45
LOOKBACK, GAP, NEAR = 0.14, 0.02, 0.12
STRUCTURES = ("TABLE", "CELL", "MERGED_CELL", "LAYOUT_TABLE", "SIGNATURE")
METERS = {"tach_time": ("Tach",), "hobbs_time": ("Hobbs",), "total_time": ("Total", "Total Time")}


def text_bearing(span_type: Column) -> Column:
    """Whether a span carries text: a line, or a region of a page analysis."""
    kind = F.upper(span_type)
    return (kind == "LINE") | kind.startswith("REGION_")


def _lines(text: Column) -> Column:
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != "")


def ignorable(text: Column) -> Column:
    """Whether all lines of a span are blank or a form's. Its first one is looked at before the text is split, as most spans are neither."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(en.FORM_FIRST) & F.forall(_lines(text), en.is_boilerplate)


def _pages(spans: DataFrame, **flags: Column) -> DataFrame:
    """(page_id, clusters): each page's clusters as an array of (cluster, spans), the spans in reading order with their flags.

    A page's spans are what one page holds, so they are gathered once, and all that depends
    on other spans of the page is read from the array. Readers take inline_outer: for inline
    Spark would make the whole array once more to see whether it is empty.
    """
    kind, zero = F.upper("span_type"), lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    counts = F.coalesce(text_bearing(F.col("span_type")) & ~ignorable(F.col("text")), F.lit(False))
    structure = F.coalesce(kind.isin(*STRUCTURES) | kind.startswith("REGION_"), F.lit(False))
    s = spans.withColumns({"_counts": counts, "_structure": structure, "_cx": zero("left") + zero("width") / 2, "_cy": zero("top") + zero("height") / 2, "_left": zero("left"), "_top": zero("top")})
    place = F.struct(F.col("_cy").alias("cy"), F.col("_left").alias("left"), "reading_order", "span_id")
    item = F.struct(
        place.alias("place"), "span_id", "text", "confidence", "corrected", en.is_anchor(F.col("text")).alias("anchor"), en.is_column_heading(F.col("text")).alias("heading"),
        F.col("_cx").alias("cx"), F.col("_top").alias("top"), *(flag.alias(name) for name, flag in flags.items()),
    )
    pages = s.groupBy("page_id").agg(F.bool_or("_structure").alias("structured"), F.sort_array(F.collect_list(F.when(F.col("_counts"), item))).alias("spans")).where("size(spans) > 0")
    side = lambda right: F.filter("spans", lambda x: ~x["heading"] & ((x["cx"] >= RIGHT) == right))
    pages = pages.withColumn("anchors", F.filter("spans", lambda x: x["anchor"]))
    both = F.when(F.col("structured") & F.col("page_id").isNotNull(), F.array(side(False), side(True)))
    pages = pages.withColumn("sides", F.filter(both, _signal))
    cluster = lambda i, some: F.struct(i.cast("int").alias("cluster"), some.alias("spans"))

    def stretch(a: Column, i: Column) -> Column:
        """The spans from an anchor's lookback, or the middle to the anchor before, to shortly above the next one."""
        before, after, cy = F.when(i > 0, F.get("anchors", i - 1)["place"]["cy"]), F.get("anchors", i + 1)["place"]["cy"], a["place"]["cy"]
        start = F.greatest(F.lit(0.0), a["top"] - LOOKBACK, F.coalesce(before + (cy - before) / 2, F.lit(0.0)))
        bound = F.struct(a.alias("a"), start.alias("start"), F.when(after.isNull(), F.lit(1.0)).otherwise(F.greatest(start, after - GAP)).alias("stop"))
        return F.get(F.transform(F.array(bound), lambda b: cluster(i, F.filter("spans", lambda x: _inside(x, b)))), F.lit(0))

    columns = F.transform("sides", lambda some, i: cluster(i, some))
    several = F.when(F.col("page_id").isNotNull(), F.filter(F.transform("anchors", stretch), lambda c: F.size(c["spans"]) > 0))
    clusters = F.when(F.size("sides") == 2, columns).when(F.size("anchors") <= 1, F.array(cluster(F.lit(0), F.col("spans")))).otherwise(several)
    return pages.select("page_id", clusters.alias("clusters"))


def _inside(x: Column, b: Column) -> Column:
    """Whether span x is the anchor of stretch b, or stands in the stretch and near its anchor or in its column."""
    a, cy = b["a"], x["place"]["cy"]
    near = (x["place"]["left"] >= RIGHT) | (F.abs(cy - a["place"]["cy"]) <= NEAR) | ((a["place"]["left"] < RIGHT) & (x["place"]["left"] < RIGHT))
    return ((cy >= b["start"]) & (cy < b["stop"]) & near) | (x["span_id"] == a["span_id"])


def _signal(some: Column) -> Column:
    """Whether spans in order have the signal of an entry."""
    return en.has_signal(F.array_join(F.transform(some, lambda x: x["text"]), "\n"), F.exists(some, lambda x: x["anchor"]))


def span_clusters(spans: DataFrame) -> DataFrame:
    """Each cluster's spans: page_id, cluster (from 0), and the columns of spans; a span may fall in two clusters.

    spans: page_id, span_id, span_type, text, left, top, width, height (shares of the
    page), reading_order, confidence, corrected. A page that has a structure and two columns
    of entries has a cluster for each; else each of several anchor lines has the stretch
    from its lookback, or the middle to the anchor before, to shortly above the next one;
    else all lines are one cluster.
    """
    rows = _pages(spans).select("page_id", F.inline_outer("clusters")).where("cluster is not null").select("page_id", "cluster", F.explode("spans").alias("s"))
    return rows.select("page_id", "cluster", *(f"s.{c}" for c in ("span_id", "text", "place", "confidence", "corrected", "anchor")))


def draft_entries(spans: DataFrame) -> DataFrame:
    """One draft for each cluster with the signal of an entry: its fields and the span behind each.

    Columns: page_id, cluster, lines, entry_date, date_extracted, description, performer
    (name, credential), tach_time, hobbs_time, total_time, confidence (the least known),
    requires_review (several drafts on the page), evidence (field, span_id, evidence_type,
    confidence): the date's span is the anchor line (the first line where there is none),
    the description's is the first, a performer's or meter's the first from which that
    field's own rule reads one. The type is correction or ocr_span, and fallback for a date
    that no line has.
    """
    text = F.col("text")
    # What a rule looks for is looked for in the whole text first, as most spans lack it.
    some = lambda pattern, flag: F.when(text.rlike(pattern), flag).otherwise(False)
    flags = {"_names": some(en.NAMES, F.exists(_lines(text), en.names_performer))}
    flags |= {f"_{field}": some(en.meter_pattern(*labels), en.meter_reading(F.array(text), *labels).isNotNull()) for field, labels in METERS.items()}
    c = _pages(spans, **flags).withColumn("clusters", F.filter("clusters", lambda c: _signal(c["spans"])))
    c = c.select("page_id", (F.size("clusters") > 1).alias("requires_review"), F.inline_outer("clusters")).where("cluster is not null")
    first = lambda name: F.get(F.filter("spans", lambda x: x[name]), F.lit(0))
    head = F.get("spans", F.lit(0))
    c = c.withColumns({"lines": F.flatten(F.transform("spans", lambda x: _lines(x["text"]))), "_anchor": F.coalesce(first("anchor"), head), "confidence": F.array_min(F.transform("spans", lambda x: x["confidence"]))})
    c = c.withColumn("entry_date", en.entry_date(F.col("_anchor.text")))
    none = F.lit(None).cast("string")

    def evidence(field: str, span: Column, kind: Column = none) -> Column:
        found = F.coalesce(kind, F.when(span["corrected"], "correction").otherwise("ocr_span"))
        return F.when(span.isNotNull(), F.struct(F.lit(field).alias("field"), span["span_id"].alias("span_id"), found.alias("evidence_type"), span["confidence"].alias("confidence")))

    each = [
        evidence("entry_date", F.col("_anchor"), F.when(F.col("entry_date").isNull(), "fallback")), evidence("description", head),
        evidence("performer_name", first("_names")), evidence("performer_credential", first("_names")), *(evidence(field, first(f"_{field}")) for field in METERS),
    ]
    return c.select(
        "page_id", "cluster", "lines", "entry_date", F.col("entry_date").isNotNull().alias("date_extracted"), en.entry_description(F.col("lines"), F.col("entry_date")).alias("description"),
        en.performer(F.col("lines")).alias("performer"), *(en.meter_reading(F.col("lines"), *labels).alias(field) for field, labels in METERS.items()), "confidence",
        "requires_review", F.array_compact(F.array(*each)).alias("evidence"),
    )
