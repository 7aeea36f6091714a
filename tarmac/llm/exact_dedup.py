"""Exact dedup over content-defined chunks: documents are compared by ordered lists of chunk identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.workspace import Workspace

#: A chunk ends after a line or after certain letters before a space, 512 characters on at the earliest.
CHUNK = r"(?s).{512,8192}?(?:\n|[aeo][nrst] )|.{1,8192}"
#: Digests for identifiers; a later one is used where chunks of one earlier digest differ.
DIGESTS = ("md5", "sha256")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower case for A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _digest(kind: str, chunk: Column) -> Column:
    return {"md5": lambda c: F.unhex(F.md5(c)), "sha256": lambda c: F.unhex(F.sha2(c, 256)), "crc32": lambda c: F.unhex(F.hex(F.crc32(c)))}[kind](chunk)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def same_digest_chunks(docs: DataFrame, kind: str) -> DataFrame:
    """Digests that two different chunks of the texts share.

    This is the one time that text is shuffled: equal chunks are combined before it.
    """
    each = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    different = each.groupBy(_digest(kind, F.col("chunk")).alias("digest"), "chunk").agg(F.lit(1).alias("one"))
    return different.groupBy("digest").count().where("count > 1")


def exact_dedup(docs: DataFrame, ws: Workspace, digests: tuple[str, ...] = DIGESTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs(doc_id, text).

    Equal texts are those identical after lower-casing A-Z; the row with the largest
    doc_id stays. Null is an empty text, and all empty texts are one group. Where rows
    repeat both the text and the largest doc_id, one of them stays. A null doc_id is
    smaller than any other. Other columns are not read; an empty table gives no rows. A
    text of b bytes needs about 3 b of memory in its task, for its chunks.
    """
    for kind in digests:
        if not same_digest_chunks(docs, kind).limit(1).count():
            break
    else:
        raise ValueError(f"different chunks share a digest under each of {digests}")
    text = normalised(F.col("text"))
    recipes = ws.table(
        docs.select("doc_id", "text").select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.sha2(text, 256).alias("text_sha256"),
            F.transform(chunks(text), lambda c: _digest(kind, c)).alias("recipe"),
        ),
        "recipes",
    )
    groups = recipes.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
    # Aggregated before the shuffle, then joined: a group with a third of all rows is split by the skew join.
    return recipes.join(groups.hint("shuffle_merge"), "recipe").select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        "text_sha256",
    )
