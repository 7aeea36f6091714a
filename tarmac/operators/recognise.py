"""Text recognition as a plug-in: a user's function over pages, with typed results, rows for failures, and a cache of finished pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an error that are kept.
ERROR = 500
SPANS = "array<struct<text:string,span_type:string,left:double,top:double,width:double,height:double,confidence:double,reading_order:int>>"
#: What comes back for a page, whatever the recogniser.
RESULT = f"status string, width_px int, height_px int, rotation_degrees double, confidence double, spans {SPANS}, error string"
_SPAN = pa.struct([("text", pa.string()), ("span_type", pa.string()), *((c, pa.float64()) for c in ("left", "top", "width", "height", "confidence")), ("reading_order", pa.int32())])
_TYPES = {
    "status": pa.string(), "width_px": pa.int32(), "height_px": pa.int32(), "rotation_degrees": pa.float64(), "confidence": pa.float64(), "spans": pa.list_(_SPAN), "error": pa.string(),
}


@dataclass(frozen=True)
class Recogniser:
    """page(row) -> {width_px, height_px, rotation_degrees, confidence, spans}; what it leaves out is null. The rest tells results of one make from another's."""

    page: Callable[[dict[str, Any]], dict[str, Any]]
    provider: str
    version: str
    configuration: str = ""


def _recognised(keys: list[str], page: Callable[[dict[str, Any]], dict[str, Any]]):
    def one(row: dict[str, Any]) -> dict[str, Any]:
        try:
            found = dict(page(row))
            spans = pa.array([found.get("spans") or []], _TYPES["spans"])
            return {**{k: found.get(k) for k in _TYPES}, "status": "recognised", "spans": spans[0].as_py(), "error": None}
        except Exception as e:  # the page's fault, not the job's
            return {**dict.fromkeys(_TYPES), "status": "failed", "error": f"{type(e).__name__}: {e}"[:ERROR]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [one(row) for row in batch.to_pylist()]
            columns = [batch.column(k) for k in keys] + [pa.array([r[k] for r in results], kind) for k, kind in _TYPES.items()]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *_TYPES])

    return run


def recognise(pages: DataFrame, recogniser: Recogniser, keys: list[str], cache: DataFrame | None = None) -> DataFrame:
    """(keys, provider, version, configuration, content_hash, RESULT, cached): one row for each of pages(keys, content, ...).

    The function gets a page as a dictionary of all its columns and runs once for each page
    that the cache lacks; pages are independent, a lost executor repeats its own. What it
    raises, or a result of another shape, makes a row of status failed with the error;
    failed pages are tried again on the next run. A cached result counts where its keys,
    content and the recogniser's three names are the same. cache has the columns of the
    result, but for `cached`.
    """
    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    marked = pages.withColumns({"provider": F.lit(recogniser.provider), "version": F.lit(recogniser.version), "configuration": F.lit(recogniser.configuration), "content_hash": F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256)})
    names = [*keys, "provider", "version", "configuration", "content_hash"]
    schema = f"{kinds}, provider string, version string, configuration string, content_hash string, {RESULT}"
    todo = marked
    if cache is not None:
        done = cache.where("status = 'recognised'").dropDuplicates(names)
        todo = marked.join(done.select(*names), names, "left_anti")
    fresh = todo.mapInArrow(_recognised(names, recogniser.page), schema).withColumn("cached", F.lit(False))
    if cache is None:
        return fresh
    return fresh.unionByName(done.join(marked.select(*names), names, "left_semi").withColumn("cached", F.lit(True)).select(fresh.columns))
