"""Streams over several micro-batches: late and repeated events, and tables that are folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import jobs
from tarmac.streaming import status


def _events(spark, path):
    rows = [(k, k % 5, 100 + (k * 37) % 60, ("completed", "invalidated", "other")[k // 3 % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "event_id int, aircraft_id int, event_time int, kind string")
    # Later files hold earlier events, too.
    for n in range(3):
        df.where(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return df


def test_status_over_three_batches(spark, tmp_path):
    path = str(tmp_path)
    df = _events(spark, path)
    stream = status.event_stream(spark, path, "events.parquet", df, files=1)
    status.run_available(status.stream_matcher_status(stream), f"{path}/checkpoint", f"{path}/out")
    log = spark.read.parquet(f"{path}/out")
    assert log.select("batch").distinct().count() == 3
    got = {r["aircraft_id"]: (r["last"]["kind"], r["last"]["event_time"]) for r in status.latest_of(log, "aircraft_id").collect()}
    assert got == {r["aircraft_id"]: (r["last_kind"], r["last_time"]) for r in jobs.matcher_status(df).collect()}


def test_log_over_three_batches(spark, tmp_path):
    path = str(tmp_path)
    df = _events(spark, path)
    stream = status.event_stream(spark, path, "events.parquet", df, files=1)
    status.log_available(stream, f"{path}/checkpoint", f"{path}/log", lambda b: jobs.latest(b, ["aircraft_id"], ["event_time", "event_id"]))
    log = spark.read.parquet(f"{path}/log")
    assert log.count() == 15 and log.select("batch").distinct().count() == 3
    last = jobs.latest(log.drop("batch"), ["aircraft_id"], ["event_time", "event_id"])
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, jobs.latest(df, ["aircraft_id"], ["event_time", "event_id"]).collect()))


def test_effective_directives_long_chains_and_cycles(spark):
    chain = [(f"n{k + 1:03d}", f"n{k:03d}") for k in range(40)]
    edges = chain + [("n005", "x"), ("y", "x"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c1", "into"), ("self", "self")]
    out = {(r["ad_number"], r["effective"]): r["steps"] for r in jobs.effective_directives(spark.createDataFrame(edges, "ad_number string, supersedes string")).collect()}
    want = {(f"n{k:03d}", "n040"): 40 - k for k in range(40)} | {("x", "n040"): 36, ("x", "y"): 1} | {(c, None): None for c in ("c1", "c2", "c3", "into")}
    assert out == want


def test_discovery_in_three_polls(spark, tmp_path):
    import datetime

    path, day = str(tmp_path), lambda d: datetime.date(2020, 1, d) if d else None
    kind = "document_number string, publication_date date, content string, received int"
    feeds = [
        [("a", 5, "x", 1), ("b", 7, "x", 2), ("a", 6, "y", 3), ("n", 0, "x", 4)],
        # Older than the mark of the 7th: not taken. Seen again: updated, unchanged.
        [("c", 6, "x", 5), ("b", 7, "new", 6), ("d", 9, "x", 7), ("a", 8, "y", 8)],
        [("d", 9, "x", 9), ("e", 8, "x", 10), ("f", 20, None, 11), ("n", 0, "z", 12)],
    ]
    table = status.UpsertTable(spark, f"{path}/table", f"{kind}, content_hash string", ["document_number"], ["received"], buckets=3)
    want, logs = {}, []
    expected = [{"a": ("y", 3), "b": ("x", 2), "n": ("x", 4)}, {"b": ("new", 6), "d": ("x", 7), "a": ("y", 8)}, {"d": ("x", 9), "f": (None, 11), "n": ("z", 12)}]
    for feed, taken in zip(feeds, expected):
        spark.createDataFrame([(k, day(d), c, r) for k, d, c, r in feed], kind).write.mode("append").parquet(f"{path}/feed")
        status.poll_discovery(spark.readStream.schema(kind).parquet(f"{path}/feed"), table, f"{path}/checkpoint", f"{path}/log")
        want |= taken
        rows = table.read().collect()
        assert {r["document_number"]: (r["content"], r["received"]) for r in rows} == want and len(rows) == len(want)
        logs.append(len(taken))
    log = spark.read.parquet(f"{path}/log")
    assert sum(logs) == log.count()
    assert sorted(r["action"] for r in log.where("document_number = 'a'").collect()) == ["created", "unchanged"] and sorted(r["action"] for r in log.where("document_number = 'b'").collect()) == ["created", "updated"]
    # Nothing new: no change.
    status.poll_discovery(spark.readStream.schema(kind).parquet(f"{path}/feed"), table, f"{path}/checkpoint", f"{path}/log")
    assert table.read().count() == len(want) and spark.read.parquet(f"{path}/log").count() == sum(logs)
    # A batch that is tried again replaces its own rows.
    before = sorted(map(str, table.read().collect()))
    last = spark.read.parquet(f"{path}/log").agg(F.max("batch")).first()[0]
    again = spark.createDataFrame([("d", day(9), "x", 9), ("f", day(20), None, 11), ("n", None, "z", 12)], kind).withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    table.upsert(again, int(last))
    assert sorted(map(str, table.read().collect())) == before


def test_three_kinds_of_change_over_three_batches(spark, tmp_path):
    from tarmac.operators.applicability import Applicability

    path = str(tmp_path)
    entries = spark.createDataFrame([(100, 1), (101, 2), (102, 3)], "entry_id int, aircraft_id int")
    whole = Applicability(spark.createDataFrame([("c1", "t1"), ("c2", "t1")], "component_class string, target_class string"), spark.createDataFrame([(4, "c1"), (5, "c2"), (6, "c3")], "aircraft_id int, component_class string"), spark.createDataFrame([(50, "t1"), (51, "t2")], "directive_id int, target_class string"))
    subscribers = spark.createDataFrame([(9, 51), (9, 50), (4, 50)], "aircraft_id int, directive_id int")
    batches = [[("entry", 100), ("entry", 100), ("aircraft", 8)], [("extraction", 50), ("entry", 999)], [("extraction", 51), ("aircraft", 8), ("extraction", 77)]]
    for rows in batches:
        spark.createDataFrame(rows, "change_type string, id int").coalesce(1).write.mode("append").parquet(f"{path}/changes")
    stream = spark.readStream.schema("change_type string, id int").option("maxFilesPerTrigger", 1).parquet(f"{path}/changes")
    status.log_available(stream, f"{path}/checkpoint", f"{path}/log", lambda b: status.invalidated(b, entries, whole, subscribers))
    log = spark.read.parquet(f"{path}/log")
    assert log.select("batch").distinct().count() == 3
    got = {(r["aircraft_id"], r["change_type"]) for r in log.collect()}
    assert got == {(1, "entry"), (8, "aircraft"), (4, "extraction"), (5, "extraction"), (9, "extraction")}
