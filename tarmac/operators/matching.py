"""Match results over time: newest extractions, a digest of a match's inputs, and whether an aircraft's matches are current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.jobs import latest

#: Hexadecimal digits of a row's SHA-256 in each of the four sums that stand for a set of rows.
_PART = 15


def newest_approved(extractions: DataFrame) -> DataFrame:
    """Of each directive the approved extraction created last; of equal times that with the largest id."""
    return latest(extractions.where("status = 'approved'"), ["directive_id"], ["created_at", "extraction_id"])


def canonical(**values: Column | str) -> Column:
    """JSON of the values as text, keys in alphabetical order, nulls kept."""
    each = (F.col(c) if isinstance(c, str) else c for _, c in sorted(values.items()))
    return F.to_json(F.struct(*(c.alias(k) for k, c in zip(sorted(values), each))), {"ignoreNullFields": "false"})


def rows_digest(text: Column) -> Column:
    """An aggregate: a digest of a set of rows that does not depend on their order, with their number.

    Four sums of parts of the rows' SHA-256. Sums are partial before the shuffle, so the
    rows of one key are never gathered, however many they are.
    """
    digest = F.sha2(text, 256)
    part = lambda i: F.conv(F.substring(digest, 1 + _PART * i, _PART), 16, 10).cast("decimal(20,0)")
    return F.concat_ws("-", F.count(text).cast("string"), *(F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)))


def input_hashes(matches: DataFrame, aircraft: DataFrame, components: DataFrame, entries: DataFrame, extractions: DataFrame) -> DataFrame:
    """(aircraft_id, directive_id, input_hash): SHA-256 over all that a match is made from.

    That is the aircraft's facts, its installed components, its entries, the extraction
    and the chosen component and target. Equal inputs give equal hashes in whatever order
    rows come; a change of any of these columns gives another one.
    matches: aircraft_id, directive_id, component_id, target_id. aircraft: aircraft_id,
    make, model, serial, engine_make, engine_model, propeller_make, propeller_model.
    components: aircraft_id, component_id, role, type, make, model, serial, removed_at.
    entries: aircraft_id, entry_id, entry_date, description, raw_text, review_status.
    extractions: directive_id, extraction_id, content_hash, output.
    """
    text = lambda c: F.col(c).cast("string")
    part = canonical(id=text("component_id"), role=text("role"), type=text("type"), make=text("make"), model=text("model"), serial=text("serial"))
    parts = components.where("removed_at is null").groupBy("aircraft_id").agg(rows_digest(part).alias("_parts"))
    entry = canonical(id=text("entry_id"), date=text("entry_date"), description=text("description"), rawText=text("raw_text"), reviewStatus=text("review_status"))
    said = entries.groupBy("aircraft_id").agg(rows_digest(entry).alias("_entries"))
    facts = {"make": "make", "model": "model", "serial": "serial", "engineMake": "engine_make", "engineModel": "engine_model", "propellerMake": "propeller_make", "propellerModel": "propeller_model"}
    planes = aircraft.select("aircraft_id", canonical(id=text("aircraft_id"), **{k: text(c) for k, c in facts.items()}).alias("_facts")).join(parts, "aircraft_id", "left").join(said, "aircraft_id", "left")
    extracted = extractions.select("directive_id", canonical(id=text("extraction_id"), inputContentHash=text("content_hash"), output=text("output")).alias("_extraction"))
    rows = matches.join(planes, "aircraft_id").join(extracted, "directive_id", "left")
    whole = canonical(aircraft="_facts", components="_parts", entries="_entries", extraction="_extraction", selected=canonical(componentId=text("component_id"), targetApplicabilityId=text("target_id")))
    return rows.select("aircraft_id", "directive_id", F.sha2(whole, 256).alias("input_hash"))


def matcher_states(aircraft: DataFrame, matches: DataFrame, events: DataFrame, algorithm: str, version: str) -> DataFrame:
    """(aircraft_id, matches, status) of each aircraft: current, pending_recomputation or not_run.

    Current: it has a current match of this algorithm and version, or its last event is
    their completion. Pending: its last event is an invalidation, or it has matches of the
    algorithm of another version or not current. matches: aircraft_id, algorithm_name,
    algorithm_version, is_current. events: aircraft_id, kind (completed, invalidated, or
    others, which do not count), event_time, event_id, algorithm_name, algorithm_version.
    """
    ours, this = F.col("algorithm_name") == algorithm, F.col("algorithm_version") == version
    found = matches.where(ours).groupBy("aircraft_id").agg(F.count_if(this & F.col("is_current")).alias("matches"), F.bool_or(~this | ~F.col("is_current")).alias("_stale"))
    last = F.max_by(F.struct("kind", (ours & this).alias("ours")), F.struct("event_time", "event_id"))
    told = events.where("kind in ('completed', 'invalidated')").groupBy("aircraft_id").agg(last.alias("_last"))
    both = found.join(told, "aircraft_id", "full_outer")
    out = aircraft.select("aircraft_id").distinct().join(both, "aircraft_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    done = (F.col("_last.kind") == "completed") & F.col("_last.ours")
    status = F.when((F.col("matches") > 0) | F.coalesce(done, F.lit(False)), "current").when((F.col("_last.kind") == "invalidated") | F.col("_stale"), "pending_recomputation")
    return out.select("aircraft_id", "matches", status.otherwise("not_run").alias("status"))


def partitions(pages: DataFrame, shares: dict[str, int], keys: list[str], within: list[str], seed: str = "") -> DataFrame:
    """pages with column `partition`: each group of `within` is dealt to the named parts, whose shares are per cent that sum to 100.

    A page's place is its rank in the group by a hash of its keys, so the deal stays the
    same whatever the order of rows. Of n pages a part ends at n times the sum of shares up
    to it, rounded, so that sizes are as declared up to one page. Duplicate keys go together.
    """
    if sum(shares.values()) != 100:
        raise ValueError("shares must sum to 100")
    mark = F.sha2(F.concat_ws("\x1f", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)
    ids = pages.select(*within, *(k for k in keys if k not in within)).distinct().withColumn("_mark", mark)
    # A group's ranks come from the sizes of its 4,096 hash ranges, so that no task sorts a whole group.
    cell = ids.withColumn("_cell", F.substring("_mark", 1, 3))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cell.groupBy(*within, "_cell").agg(F.count("*").alias("_n"))
    cells = cells.select(*within, "_cell", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*within)).alias("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*within, "_cell").orderBy("_mark", *keys))
    ranked = cell.join(cells, [*within, "_cell"]).withColumn("_place", place)
    name, upto = None, 0
    for part, share in shares.items():
        upto += share
        here = F.col("_place") <= F.round(F.col("_all") * upto / 100)
        name = F.when(here, part) if name is None else name.when(here, part)
    return pages.join(ranked.select(*dict.fromkeys([*within, *keys]), name.alias("partition")), list(dict.fromkeys([*within, *keys])))


def partition_faults(assigned: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fault): pages in several parts (twice), in no part (missing), or not expected (unknown)."""
    n = assigned.groupBy(*keys).agg(F.countDistinct("partition").alias("_n"))
    e = expected.select(*keys).distinct().withColumn("_expected", F.lit(True))
    both = n.join(e, keys, "full_outer")
    fault = F.when(F.coalesce("_n", F.lit(0)) == 0, "missing").when(F.col("_expected").isNull(), "unknown").when(F.col("_n") > 1, "twice")
    return both.select(*keys, fault.alias("fault")).where("fault is not null")
