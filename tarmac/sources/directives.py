"""Readers of directive sources, and the import of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import text as tx
from tarmac.operators.jobs import latest

# Headers under which a field may stand, first choice first.
ALIASES = {
    "number": ("adNumber", "ADNumber", "ad_number", "AD No.", "AD"),
    "title": ("title", "Title", "subject", "Subject", "ADSubject"),
    "status": ("status", "Status", "ADStatus"),
    "identifier": ("identifier", "Identifier", "Guid", "GUID", "documentId", "DocumentId"),
    "publication_date": ("publicationDate", "PublicationDate", "PostedDate", "IssueDate"),
    "product_type": ("productType", "ProductType", "Product Type", "Category"),
    "product_subtype": ("productSubtype", "ProductSubtype", "Product Subtype", "Subcategory"),
    "make": ("make", "Make", "Manufacturer", "Mfr"),
    "model": ("model", "Model", "Models"),
    "actions": ("complianceActions", "Compliance", "Action", "Subject"),
    "intervals": ("complianceIntervals", "Interval"),
}


def first_value(df: DataFrame, *aliases: str) -> Column:
    """The first value that is not blank under one of the headers: each as written, or in any case where that is missing."""
    lowered = {c.lower(): c for c in df.columns}
    found = [a if a in df.columns else lowered.get(a.lower()) for a in aliases]
    values = [F.nullif(F.trim(df[f"`{c}`"].cast("string")), F.lit("")) for c in found if c]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def read_directive_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of exported tables (CSV with headers, all text) that name a directive, with their file's name as source."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    rows = rows.withColumn("source", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return rows.where(tx.directive_number(first_value(rows, *ALIASES["number"])).isNotNull())


def read_register_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of paged responses (count, next_page_url, results): one row each, with the page's count."""
    pages = spark.read.schema(f"count bigint, next_page_url string, results array<struct<{schema}>>").json(path, multiLine=False)
    return pages.select("count", "next_page_url", F.explode("results").alias("d")).select("d.*", F.col("count").alias("search_count"), F.col("next_page_url").isNotNull().alias("more"))


def excerpts_text(excerpts: Column) -> Column:
    """A list of excerpts, without empty ones, as lines."""
    return F.array_join(F.filter(F.coalesce(excerpts, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def import_rows(rows: DataFrame, content_hash: str, order: str) -> dict[str, DataFrame]:
    """Directives, publications, applicability and issues of bulk rows; of rows with one key the last by `order` counts.

    A row without a number, or without a make and model, gives an issue. Makes and models
    of one row, split at pipes, semicolons and commas, are combined.
    """
    v = lambda field: first_value(rows, *ALIASES[field])
    none = F.array(F.lit(None).cast("string"))
    split = lambda field: tx.split_values(v(field))
    number = tx.directive_number(v("number"))
    read = rows.select(
        F.col(order).alias("_order"), number.alias("ad_number"), F.coalesce(v("title"), F.concat(F.lit("Airworthiness Directive "), number)).alias("title"), tx.source_status(v("status")).alias("status"),
        F.coalesce(v("identifier"), number).alias("identifier"), tx.date_of(v("publication_date")).alias("publication_date"), F.coalesce(v("product_type"), F.lit("Aircraft")).alias("product_type"),
        v("product_subtype").alias("product_subtype"), split("make").alias("makes"), split("model").alias("models"), tx.list_values(v("actions")).alias("actions"), tx.list_values(v("intervals")).alias("intervals"),
    )
    good = read.where("ad_number is not null")
    some = (F.size("makes") > 0) | (F.size("models") > 0)
    issue = lambda df, kind, severity: df.select(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), "ad_number", F.col("_order").alias("row"))
    directives = latest(good.select("ad_number", "title", "status", "_order"), ["ad_number"], ["_order"]).drop("_order").withColumn("content_hash", F.lit(content_hash))
    publications = latest(good.select("ad_number", "identifier", "title", "status", "publication_date", "_order"), ["ad_number", "identifier"], ["_order"]).drop("_order")
    either = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(none)
    targets = good.where(some).withColumn("make", F.explode(either("makes"))).withColumn("model", F.explode(either("models")))
    key = tx.target_key(F.col("product_type"), F.col("product_subtype"), F.col("make"), F.col("model"))
    applies = targets.select("ad_number", key.alias("target_key"), "product_type", "product_subtype", "make", "model", "status", "actions", "intervals", F.lit(0.84).cast("decimal(4,2)").alias("confidence"), F.lit("drs_bulk_row").alias("basis"), "_order")
    return {
        "directives": directives, "publications": publications, "applicability": latest(applies, ["ad_number", "target_key"], ["_order"]).drop("_order"),
        "issues": issue(read.where("ad_number is null"), "drs_row_missing_ad_number", "high").unionByName(issue(good.where(~some), "drs_row_missing_applicability", "medium")),
    }


def register_snapshots(files: DataFrame, rows: DataFrame, today: str) -> DataFrame:
    """Of each file (path, content): hash, bytes, rows read from it, age in days, and a status: complete, partial (no row), failed (empty file).

    rows(path, n) are counts of what was read. Files with one hash are one snapshot: the first path names it.
    """
    out = files.select("path", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("storage_bytes"), "modified")
    out = out.groupBy("content_hash").agg(F.min("path").alias("path"), F.max("storage_bytes").alias("storage_bytes"), F.max("modified").alias("captured_at"))
    out = out.join(rows.select("path", F.col("n").alias("row_count")), "path", "left")
    status = F.when(F.col("storage_bytes") == 0, "failed").when(F.coalesce("row_count", F.lit(0)) == 0, "partial").otherwise("complete")
    return out.select("path", "content_hash", "storage_bytes", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), status.alias("status"), F.datediff(F.to_date(F.lit(today)), F.to_date("captured_at")).alias("age_days"))


def append_events(events: DataFrame, path: str, time: str) -> None:
    """Adds events to the append-only table at path, a folder a day."""
    events.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def write_id_set(ids: DataFrame, path: str) -> None:
    """The distinct ids in order, as JSON lines over sorted ranges of them."""
    ids.select("id").where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)
