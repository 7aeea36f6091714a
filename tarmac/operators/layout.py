"""Pages: boxes of native text, regions, routing, page numbers, chronology and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def native_text_boxes(samples: DataFrame, width: int = 612, height: int = 792) -> DataFrame:
    """Samples (page_id, line_no, text, x, y, size in points) as boxes in thousandths of the page, cut at its edges.

    A line is as wide as half its size per character and 1.2 sizes high.
    """
    div = lambda a, b: F.floor(a / b).cast("long")
    left = F.least(F.lit(1000), div(F.col("x") * 1000, width))
    top = F.least(F.lit(1000), div(F.col("y") * 1000, height))
    wide = F.least(1000 - left, div(F.length("text") * F.col("size") * 1000, 2 * width))
    high = F.least(1000 - top, div(F.col("size") * 1200, height))
    return samples.select("page_id", "line_no", *(c.cast("long").alias(n) for n, c in (("left", left), ("top", top), ("width", wide), ("height", high))))


def region_violations(boxes: DataFrame) -> DataFrame:
    """Boxes that break a rule, with the rules' names: inside the page, not empty, in thousandths."""
    outside = (F.least("left", "top") < 0) | (F.col("left") + F.col("width") > 1000) | (F.col("top") + F.col("height") > 1000)
    issues = F.concat_ws(",", F.when((F.col("width") <= 0) | (F.col("height") <= 0), "empty"), F.when(outside, "outside"))
    return boxes.select("page_id", "line_no", issues.alias("issues")).where("issues <> ''")


def region_specs(pages: DataFrame) -> DataFrame:
    """One region per page, or its halves when its attributes hold side_by_side (thousandths of the width)."""
    one = lambda n, a, b: F.struct(F.lit(n).alias("region"), F.lit(a).alias("left"), F.lit(b).alias("right"))
    split = F.coalesce(F.array_contains("attributes", "side_by_side"), F.lit(False))
    parts = F.when(split, F.array(one("left", 0, 500), one("right", 500, 1000))).otherwise(F.array(one("full", 0, 1000)))
    return pages.select("page_id", F.explode(parts).alias("r")).select("page_id", "r.*")


#: Attributes of a page that keep its own text from being used, and the least (or most) of each measure.
DISQUALIFYING = ("handwritten", "side_by_side", "faint", "degraded", "orientation_unverified", "layout_uncertain", "text_mode_uncertain")
AT_LEAST = {"valid_glyph_ratio": 0.995, "positioned_ratio": 0.98, "plausible_font_ratio": 0.98, "extractor_agreement": 0.98}
AT_MOST = {"duplicate_line_ratio": (0.05, 1.0), "image_coverage": (0.25, 0.0)}


def native_text_metrics(pages: DataFrame) -> DataFrame:
    """Per page of pages(page_id, text): words, lines, and the shares of valid characters and of repeated lines.

    All counts are taken inside the row: no shuffle. Null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    out = pages.select(
        *(c for c in pages.columns if c != "text"), F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0))).cast("long").alias("words"), F.size(lines).cast("long").alias("lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("repeated"), F.length(F.regexp_replace(text, r"[^\x{FFFD}\x00-\x08]", "")).cast("long").alias("invalid"),
        F.length(text).cast("long").alias("characters"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.withColumns({"valid_glyph_ratio": share("characters", "characters") - share("invalid", "characters"), "duplicate_line_ratio": share("repeated", "lines")})


def native_text_gate(pages: DataFrame, activated: bool = True) -> DataFrame:
    """(page_id, eligible, bypass, reason, failed): nine criteria, all of which must hold for a page's own text to be used.

    pages: page_id, reliable, routing_class, attributes and the measures of AT_LEAST and
    AT_MOST. A null measure counts as none, a null share of repeated lines as all.
    """
    false = F.lit(False)
    holds = {
        "reliable": F.coalesce(F.col("reliable"), false), "routing_class": F.coalesce(F.col("routing_class") == "native_text", false),
        "attributes": ~F.coalesce(F.arrays_overlap("attributes", F.array(*map(F.lit, DISQUALIFYING))), false),
        **{c: F.coalesce(F.col(c), F.lit(0.0)) >= least for c, least in AT_LEAST.items()}, **{c: F.coalesce(F.col(c), F.lit(none)) <= most for c, (most, none) in AT_MOST.items()},
    }
    out = pages.select("page_id", F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in holds.items()))).alias("_failed"))
    eligible = F.size("_failed") == 0
    reason = F.when(eligible & activated, "native_text_gate_passed").when(eligible, "activation_not_enabled").otherwise("page_does_not_meet_native_text_gate")
    return out.select("page_id", eligible.alias("eligible"), (eligible & activated).alias("bypass"), reason.alias("reason"), F.array_join("_failed", ",").alias("failed"))


def remap_pages(delegated: DataFrame, routed: DataFrame) -> DataFrame:
    """Page i of an upload's delegated subset as its i-th routed page; an i beyond them has no page and an issue."""
    place = F.row_number().over(Window.partitionBy("upload_id").orderBy("page_id"))
    numbered = routed.select("upload_id", "page_id", place.cast("long").alias("subset_page"))
    out = delegated.join(numbered, ["upload_id", "subset_page"], "left")
    return out.withColumn("issue", F.when(F.col("page_id").isNull(), "out_of_range").otherwise(""))


def chronology(entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per entry the date and page that order a logbook: no date goes last (9999-12-31), no page too (999999)."""
    pages = evidence.groupBy("entry_id").agg(F.min("page").alias("page"))
    dates = entries.groupBy("entry_id").agg(F.min("entry_date").alias("entry_date"))
    rows = dates.join(pages, "entry_id", "left")
    return rows.select("entry_id", F.coalesce("entry_date", F.to_date(F.lit("9999-12-31"))).alias("entry_date"), F.coalesce("page", F.lit(999999)).cast("long").alias("page"))


def stage_attempts(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Attempts numbered from 1 within each key."""
    return events.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and sorted column names of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), "rows", F.lit(",".join(sorted(df.columns))).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out
