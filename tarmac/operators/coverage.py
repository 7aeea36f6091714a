"""Coverage of aircraft by sources: targets, coverage sets, subscriptions, their state and cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.text import target_key

#: Days after which a snapshot is stale.
MOST_DAYS = 7


def product_type(role: Column) -> Column:
    """The product type that a component's role names."""
    has = F.lower(role).contains
    return F.when(has("engine"), "Engine").when(has("propeller"), "Propeller").when(has("rotorcraft") | has("helicopter"), "Rotorcraft").when(has("appliance") | has("equipment"), "Appliance").otherwise("Aircraft")


def snapshot_stale(captured: Column, now: Column, days: int = MOST_DAYS) -> Column:
    """Strictly older than so many days."""
    return now.cast("timestamp") - captured.cast("timestamp") > F.expr(f"interval {int(days)} days")


def usable_snapshot(snapshots: DataFrame) -> DataFrame:
    """The snapshot of each source_system to use: the latest complete one, else the latest partial one."""
    rank = F.when(F.col("status") == "complete", 0).otherwise(1)
    w = Window.partitionBy("source_system").orderBy(rank, F.desc("captured_at"), F.desc("created_at"), F.desc("snapshot_id"))
    return snapshots.where("status in ('complete', 'partial')").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def link_coverage(components: DataFrame, sets: DataFrame, subscriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coverage sets that the components' identities need, and the subscriptions after that.

    components: aircraft_id, organization_id, role, make, model. sets: target_key.
    subscriptions: target_key, aircraft_id, organization_id, status, triggered_creation.
    Components with neither make nor model are left out. Of a new set the smallest aircraft
    triggered it. Active subscriptions to what an aircraft no longer has become inactive.
    """
    c = components.where("make is not null or model is not null")
    key = target_key(product_type(F.col("role")), F.lit(None).cast("string"), F.col("make"), F.col("model"))
    wanted = c.select(key.alias("target_key"), "aircraft_id", "organization_id").distinct()
    have = sets.select("target_key").distinct().withColumn("_old", F.lit(True))
    needed = wanted.groupBy("target_key").agg(F.min(F.struct("aircraft_id", "organization_id")).alias("_first"))
    needed = needed.join(have, "target_key", "left").select("target_key", F.col("_old").isNull().alias("created"), F.when(F.col("_old").isNull(), F.col("_first.aircraft_id")).alias("triggered_by"))
    looked = components.select("aircraft_id").distinct().withColumn("_looked", F.lit(True))
    both = wanted.withColumnRenamed("organization_id", "_org").withColumn("_wanted", F.lit(True)).join(subscriptions, ["target_key", "aircraft_id"], "full_outer")
    both = both.join(needed, "target_key", "left").join(looked, "aircraft_id", "left")
    status = F.when(F.col("_wanted"), "active").when(F.col("_looked") & (F.col("status") == "active"), "inactive_identity_changed").otherwise(F.col("status"))
    change = F.when(F.col("_wanted") & F.col("status").isNull(), "created").when(F.col("_wanted"), "reused").when(F.col("_looked") & (F.col("status") == "active"), "deactivated").otherwise("kept")
    triggered = F.coalesce("triggered_creation", F.col("created") & (F.col("triggered_by") == F.col("aircraft_id")), F.lit(False))
    return needed, both.select("target_key", "aircraft_id", F.coalesce("_org", "organization_id").alias("organization_id"), status.alias("status"), triggered.alias("triggered_creation"), change.alias("change"))


def coverage_state(sets: DataFrame, applicability: DataFrame, publications: DataFrame, snapshots: DataFrame, now: str, days: int = MOST_DAYS) -> DataFrame:
    """Per coverage set: current directives, publications, their bytes, a status and a version.

    The ladder: no snapshot, one that is not complete, a stale one, no directive, current.
    sets: target_key, source_system. applicability: target_key, directive_id, status.
    publications: publication_id, directive_id, record (the canonical text).
    """
    s = usable_snapshot(snapshots).select("source_system", F.col("status").alias("_s"), "captured_at", "content_hash")
    live = applicability.where("status = 'current'").groupBy("target_key").agg(F.countDistinct("directive_id").alias("directives"))
    reached = applicability.select("target_key", "directive_id").distinct().join(publications, "directive_id").select("target_key", "publication_id", "record").distinct()
    docs = reached.groupBy("target_key").agg(F.count("*").alias("publications"), F.sum(F.octet_length("record")).cast("long").alias("source_bytes"))
    out = sets.join(s, "source_system", "left").join(live, "target_key", "left").join(docs, "target_key", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    status = (
        F.when(F.col("_s").isNull(), "awaiting_source_snapshot").when(F.col("_s") != "complete", "degraded_source")
        .when(snapshot_stale(F.col("captured_at"), F.lit(now), days), "stale_source").when(F.coalesce("directives", F.lit(0)) == 0, "pending_applicability").otherwise("current")
    )
    version = F.when(F.col("_s").isNull(), "unversioned").otherwise(F.substring(F.sha2(F.concat_ws("|", "content_hash", "target_key"), 256), 1, 24))
    return out.select("target_key", n("directives"), n("publications"), n("source_bytes"), status.alias("status"), version.alias("version"))


def aircraft_coverage(components: DataFrame, subscriptions: DataFrame, sets: DataFrame) -> DataFrame:
    """Per aircraft of components a status and sorted warnings: identities that are incomplete or not covered, and sets that are not current."""
    active = subscriptions.where("status = 'active'").select("aircraft_id", "target_key").distinct()
    key = target_key(product_type(F.col("role")), F.lit(None).cast("string"), F.col("make"), F.col("model"))
    c = components.select("aircraft_id", "role", key.alias("target_key"), (F.col("make").isNull() | F.col("model").isNull()).alias("_part"))
    label = F.regexp_replace("role", "_", " ")
    warn = lambda df, text: df.select("aircraft_id", text.alias("w"))
    told = warn(c.where("_part"), F.concat(label, F.lit(": identity incomplete")))
    told = told.unionByName(warn(c.where("not _part").join(active, ["aircraft_id", "target_key"], "left_anti"), F.concat(label, F.lit(": not covered"))))
    told = told.unionByName(warn(active.join(sets.where("status <> 'current'").select("target_key", "status"), "target_key"), F.concat("target_key", F.lit(": "), "status")))
    warnings = told.groupBy("aircraft_id").agg(F.array_sort(F.collect_set("w")).alias("warnings"))
    out = components.select("aircraft_id").distinct().join(active.groupBy("aircraft_id").agg(F.count("*").alias("subscriptions")), "aircraft_id", "left").join(warnings, "aircraft_id", "left")
    status = F.when(F.coalesce("subscriptions", F.lit(0)) == 0, "not_resolved").when(F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0, "degraded").otherwise("current")
    return out.select("aircraft_id", F.coalesce("subscriptions", F.lit(0)).alias("subscriptions"), status.alias("status"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def cost_totals(ledger: DataFrame, snapshots: DataFrame, sets: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row: bytes of sources and of sets, costs, sets, and active organizations and aircraft. Each part is one aggregate; rows of measures are put side by side."""
    measure = lambda df, **m: df.agg(*(v.alias(k) for k, v in m.items())).select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).cast("decimal(38,6)").alias("value")) for k in m))).alias("m")).select("m.*")
    money = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = measure(ledger, actual_cost=money("actual_cost"), allocated_cost=money("allocated_cost"))
    rows = rows.unionByName(measure(snapshots, source_bytes=money("storage_bytes"))).unionByName(measure(sets, derived_bytes=money("source_bytes"), coverage_sets=F.count("*")))
    rows = rows.unionByName(measure(subscriptions.where("status = 'active'"), clients=F.countDistinct("organization_id"), aircraft=F.countDistinct("aircraft_id")))
    names = ("source_bytes", "derived_bytes", "actual_cost", "allocated_cost", "coverage_sets", "clients", "aircraft")
    return rows.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).cast("decimal(18,6)" if n.endswith("cost") else "bigint").alias(n) for n in names))


def ledger_entries(links: DataFrame, sets: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Usage rows of links, sets and sources, one for each idempotency key."""
    row = lambda df, key, scope, category, quantity, unit: df.select(F.concat_ws(":", *key).alias("idempotency_key"), F.lit(scope).alias("scope_type"), F.lit(category).alias("cost_category"), quantity.cast("decimal(18,6)").alias("usage_quantity"), F.lit(unit).alias("usage_unit"))
    out = row(links, (F.lit("coverage-link"), "target_key", "aircraft_id"), "aircraft", "coverage_association", F.lit(1), "coverage_link")
    out = out.unionByName(row(sets, (F.lit("coverage-materialization"), "target_key", "version"), "coverage_set", "derived_index_storage", F.col("source_bytes"), "estimated_logical_byte"))
    out = out.unionByName(row(snapshots, (F.lit("source-storage"), "content_hash"), "shared_source", "source_storage", F.col("storage_bytes"), "byte"))
    return out.dropDuplicates(["idempotency_key"])


#: Copies of a list of clients that are dealt to tasks, so that the coverages of one organisation are not all met in one.
COPIES = 8


def cost_detail(coverages: DataFrame, ledger: DataFrame, subscriptions: DataFrame, groups: DataFrame | None = None, shown: Callable[[Column], Column] = lambda clients: clients) -> DataFrame:
    """(coverage_id, actual_cost, allocated_cost, clients) of each coverage; clients are its active subscriptions by organisation and number, as `shown` makes them of the list.

    ledger: coverage_id, actual_cost, allocated_cost. subscriptions: coverage_id,
    organization_name, number, aircraft_id, status. With groups(coverage_id, group_id) the
    subscriptions are those of a group_id in the place of a coverage_id, and each coverage
    has those of its groups: a list is then made once for the coverages that share it.
    """
    total = lambda c: F.sum(F.col(c).cast("decimal(18,6)")).cast("decimal(18,6)").alias(c)
    costs = ledger.groupBy("coverage_id").agg(total("actual_cost"), total("allocated_cost"))
    if groups is None:
        groups, subscriptions = subscriptions.select("coverage_id", F.col("coverage_id").alias("group_id")).distinct(), subscriptions.withColumnRenamed("coverage_id", "group_id")
    client = F.struct("organization_name", "number", "aircraft_id")
    lists = subscriptions.where("status = 'active'").groupBy("group_id").agg(F.array_sort(F.collect_list(client)).alias("clients"))
    of = groups.where("coverage_id is not null and group_id is not null").groupBy("coverage_id").agg(F.array_sort(F.collect_list("group_id")).alias("_groups"))
    each = of.select("_groups").distinct().select("_groups", F.posexplode("_groups").alias("_i", "group_id")).join(lists, "group_id")
    none = F.array().cast("array<struct<organization_name:string,number:string,aircraft_id:bigint>>")
    several = F.array_sort(F.flatten(F.collect_list("clients")))
    each = each.groupBy("_groups").agg(F.when(F.count("*") == 1, F.first("clients")).otherwise(several).alias("clients")).select("_groups", shown(F.col("clients")).alias("clients"))
    out = coverages.select("coverage_id").distinct().join(costs, "coverage_id", "left").join(of, "coverage_id", "left")
    # Lists are long and their coverages few bytes, so both are dealt out by number.
    n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.withColumn("_copy", F.pmod(F.xxhash64("coverage_id"), F.lit(COPIES))).repartition(n, "_groups", "_copy")
    each = each.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(COPIES - 1).cast("bigint")))).repartition(n, "_groups", "_copy")
    out = out.join(each.hint("merge"), ["_groups", "_copy"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(18,6)")).alias(c)
    return out.select("coverage_id", zero("actual_cost"), zero("allocated_cost"), F.coalesce("clients", shown(none)).alias("clients"))
