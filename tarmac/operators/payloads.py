"""Answers of text recognisers as spans: one row for each block, line, token or region, with its box in ratios of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Block types that become spans, those that order a row of blocks, and labels of formulas.
BLOCK_TYPES = (
    "LINE", "WORD", "TABLE", "CELL", "MERGED_CELL", "TABLE_TITLE", "TABLE_FOOTER", "SIGNATURE", "LAYOUT_TEXT", "LAYOUT_TITLE", "LAYOUT_HEADER", "LAYOUT_FOOTER",
    "LAYOUT_SECTION_HEADER", "LAYOUT_PAGE_NUMBER", "LAYOUT_LIST", "LAYOUT_FIGURE", "LAYOUT_TABLE", "LAYOUT_KEY_VALUE",
)
BLOCK_ORDER = ("LAYOUT_HEADER", "LAYOUT_TITLE", "LAYOUT_SECTION_HEADER", "TABLE", "LAYOUT_TABLE", "CELL", "MERGED_CELL", "LINE", "WORD", "SIGNATURE")
FORMULAS = ("display_formula", "inline_formula")


def pixel_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box of pixels as ratios of the page; all 0 where the page has no size."""
    sized = (width > 0) & (height > 0)
    part = lambda a, b: F.when(sized, F.greatest(a, F.lit(0.0)) / b).otherwise(0.0)
    edge = lambda a, b: F.when(sized, a / b).otherwise(0.0)
    return F.struct(edge(left, width).alias("left"), edge(top, height).alias("top"), part(right - left, width).alias("width"), part(bottom - top, height).alias("height"))


def points_box(points: Column) -> Column:
    """The box around points (x, y); all 0 without any."""
    xs, ys = F.transform(points, lambda p: F.coalesce(p["x"], F.lit(0.0))), F.transform(points, lambda p: F.coalesce(p["y"], F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(
        zero(F.array_min(xs)).alias("left"), zero(F.array_min(ys)).alias("top"), zero(F.array_max(xs) - F.array_min(xs)).alias("width"), zero(F.array_max(ys) - F.array_min(ys)).alias("height")
    )


def blocks_to_spans(responses: DataFrame) -> DataFrame:
    """responses(job_id, pages, blocks): blocks of supported types in order of page, top, kind and left, and a row without a span for each empty page.

    A block has id, type, page, text, confidence, left, top, width, height, row, column. One
    without text has a placeholder of its kind.
    """
    b = responses.select("job_id", F.explode("blocks").alias("b")).select("job_id", "b.*").where(F.col("type").isin(*BLOCK_TYPES))
    page = F.coalesce(F.nullif("page", F.lit(0)), F.lit(1))
    weight = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, BLOCK_ORDER)), F.col("type")), F.lit(0)) - 1, F.lit(20))
    number = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit("?"))
    text = (
        F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).when(F.col("type") == "SIGNATURE", "[signature]").when(F.col("type").isin("TABLE", "LAYOUT_TABLE"), "[table]")
        .when(F.col("type").isin("CELL", "MERGED_CELL"), F.concat(F.lit("[cell r"), number("row"), F.lit(" c"), number("column"), F.lit("]"))).otherwise(F.concat(F.lit("["), F.lower("type"), F.lit("]")))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    order = F.row_number().over(Window.partitionBy("job_id", "page").orderBy("top", "weight", "left", "at"))
    spans = b.withColumns({"page": page, "weight": weight, "at": F.coalesce("id", F.lit("")), **{c: zero(c) for c in ("left", "top", "width", "height", "confidence")}}).withColumn("reading_order", order)
    spans = spans.select("job_id", "page", F.coalesce("id", F.concat(F.lit("textract-"), "reading_order")).alias("block_id"), F.col("type").alias("span_type"), text.alias("text"), "confidence", "left", "top", "width", "height", "reading_order")
    pages = responses.select("job_id", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)))).alias("page"))
    return pages.join(spans, ["job_id", "page"], "full_outer")


def page_number(index: Column, place: Column) -> Column:
    """An index above 0 as it is, 0 as 1, and the page's place where there is none."""
    return F.when(index > 0, index).otherwise(F.coalesce(index, place) + 1)


def markdown_to_spans(responses: DataFrame) -> DataFrame:
    """responses(job_id, pages): blocks with text, then the lines of the page's markdown in equal parts of its height.

    A page has index, width, height, average, minimum, markdown and blocks (id, type, content,
    left, top, right, bottom in pixels). Confidence is the average, else the minimum, else 0, of 0..100.
    """
    p = responses.select("job_id", F.posexplode("pages").alias("place", "p")).select("job_id", "place", "p.*")
    sure = F.coalesce("average", "minimum", F.lit(0.0))
    p = p.withColumns({"page": page_number(F.col("index"), F.col("place")), "confidence": F.when(sure <= 1, sure * 100).otherwise(sure)})
    keys = ["job_id", "page", "confidence"]
    box = pixel_box(*(F.col(f"b.{c}") for c in ("left", "top", "right", "bottom")), F.col("width"), F.col("height"))
    blocks = p.select(*keys, "index", "width", "height", F.posexplode("blocks").alias("i", "b")).where(F.trim(F.coalesce("b.content", F.lit(""))) != "")
    blocks = blocks.select(*keys, F.coalesce("b.id", F.concat_ws("-", F.lit("block"), F.coalesce("index", F.lit(0)), F.col("i") + 1)).alias("block_id"), F.upper(F.coalesce("b.type", F.lit("BLOCK"))).alias("span_type"), F.trim("b.content").alias("text"), box.alias("x"), (F.col("i") + 1).alias("reading_order"))
    texts = F.filter(F.transform(F.split(F.coalesce("markdown", F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    told = F.size(F.filter(F.coalesce("blocks", F.expr("array()")), lambda b: F.trim(F.coalesce(b["content"], F.lit(""))) != ""))
    lines = p.withColumns({"_lines": texts, "_told": told}).select(*keys, "index", "_told", F.size("_lines").alias("n"), F.posexplode("_lines").alias("i", "text"))
    line = F.struct(F.lit(0.0).alias("left"), (F.col("i") / F.col("n")).alias("top"), F.lit(1.0).alias("width"), (1 / F.col("n")).alias("height"))
    lines = lines.select(*keys, F.concat_ws("-", F.lit("line"), F.coalesce("index", F.lit(0)), F.col("i") + 1).alias("block_id"), F.lit("LINE").alias("span_type"), "text", line.alias("x"), (F.col("_told") + F.col("i") + 1).alias("reading_order"))
    return blocks.unionByName(lines).select(*keys, "block_id", "span_type", "text", "x.*", "reading_order")


def tokens_to_spans(documents: DataFrame) -> DataFrame:
    """documents(page_id, text, items): lines, then words, whose text is cut out of the whole by their segments; those without text are left out.

    An item has kind (LINE or WORD), segments (start, end), points (x, y in ratios) and a confidence of 0..1.
    """
    i = documents.select("page_id", "text", F.posexplode("items").alias("place", "i")).select("page_id", F.col("text").alias("_all"), "place", "i.*")
    own = F.array_join(F.transform("segments", lambda s: F.substring(F.col("_all"), F.coalesce(s["start"], F.lit(0)) + 1, F.greatest(F.coalesce(s["end"], F.lit(0)) - F.coalesce(s["start"], F.lit(0)), F.lit(0)))), "")
    rank = F.when(F.col("kind") == "LINE", 0).otherwise(1)
    i = i.withColumns({"text": F.trim(own), "_number": F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("place")), "_rank": rank}).where("text <> ''")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("_rank", "place"))
    sure = F.round(F.col("confidence") * 100, 6)
    return i.select("page_id", F.concat_ws("-", F.lower("kind"), "_number").alias("block_id"), F.col("kind").alias("span_type"), "text", sure.alias("confidence"), points_box(F.col("points")).alias("x"), order.alias("reading_order")).select("*", "x.*").drop("x")


def regions_to_spans(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(page_id, regions): spans in reading order, and the regions that break a rule, with the rule.

    A region has index, label, task, score (0..1), box (four numbers of 0..1000) and text.
    """
    r = pages.select("page_id", F.posexplode("regions").alias("place", "r")).select("page_id", "place", "r.*")
    issue = F.when(F.coalesce(F.size("box"), F.lit(0)) != 4, "box_missing").when((F.col("score") < 0) | (F.col("score") > 1), "score_out_of_range")
    issue = issue.when((F.array_min("box") < 0) | (F.array_max("box") > 1000) | (F.get("box", F.lit(2)) <= F.get("box", F.lit(0))) | (F.get("box", F.lit(3)) <= F.get("box", F.lit(1))), "box_out_of_range")
    r = r.withColumns({"index": F.coalesce("index", "place"), "issue": issue})
    at = lambda k: F.get("box", F.lit(k)) / 1000
    task = F.coalesce("task", F.when(F.col("label") == "table", "table").when(F.col("label").isin(*FORMULAS), "formula").otherwise("text"))
    good = r.where("issue is null").withColumns({"block_id": F.concat(F.lit("region-"), "index"), "top": at(1), "left": at(0)})
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("index", "top", "left", "block_id", "place"))
    spans = good.select("page_id", "block_id", F.concat(F.lit("REGION_"), F.upper(task)).alias("span_type"), "text", (F.col("score") * 100).alias("confidence"), "left", "top", (at(2) - at(0)).alias("width"), (at(3) - at(1)).alias("height"), order.alias("reading_order"))
    return spans, r.where("issue is not null").select("page_id", "index", "issue")
