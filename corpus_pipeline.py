"""A corpus pipeline of five stages; each reads the table that the one before wrote.

In every stage rows that share an id, or have none, are rows of their own, columns other
than text and n_chars pass through whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import jaccard_join, line_dedup, packing, quality_rules, substring_dedup
from tarmac.llm.queries import WORDS, vocabulary
from tarmac.llm.workspace import Workspace, read_table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a learned rule rejects go: those of null, blank or fewer than 50 words, too. Repeated rows are judged each."""
    sample = quality_rules.labelled_sample(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, quality_rules.learn_rules(sample, Workspace(spark, "stage1")))


def _renewed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly, one line elsewhere go; documents with no word left, too.

    Of alike lines the one with the smallest doc_id and position stays. Null texts stay.
    """
    out = line_dedup.line_dedup(docs, Workspace(spark, "stage2"))
    return _renewed(out.where(r"_n_removed = 0 or text rlike '[^\x20\x09-\x0D]'").select(docs.columns))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id, of equal ids the first row. Texts without words stay."""
    return jaccard_join.keep_one(docs, Workspace(spark, "stage3"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; documents with no word left, too. A text that loses none stays as it is, any other has single blanks.

    All copies of a passage go, so there are no ties. Null texts stay null. A text of b bytes needs about 40 b of memory, however long.
    """
    out = substring_dedup.substring_dedup(docs, Workspace(spark, "stage4"))
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept_text"))
    kept = out.where("n_removed = 0 or n_removed < n_words")
    return _renewed(kept.select(*(text.alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence, with their ids; a null text is just the end id.

    Rows that repeat are packed each; nothing ties, as no row's pieces depend on another's. Long texts are cut into as many pieces as they need.
    """
    return packing.pack(docs, vocabulary(WORDS), Workspace(spark, "stage5"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Learned rules, MinHash bands and tokenizers have no SQL; tests/llm/test_pipeline.py compares the stages after the rules, run after one another, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = read_table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return docs
