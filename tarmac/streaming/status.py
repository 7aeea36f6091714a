"""Structured Streaming jobs whose end result equals the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_matcher_status(events: DataFrame) -> DataFrame:
    """Streaming aggregate: the last completed or invalidated event per aircraft. No watermark, so late events count."""
    return events.where("kind <> 'other'").groupBy("aircraft_id").agg(F.max(F.struct("event_time", "event_id", "kind")).alias("last"))


def run_available(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Takes all input that is there, in micro-batches, and keeps what each batch changed of the aggregate in a folder of its own.

    State is written where it changed only; a batch that is tried again replaces its own
    folder. latest_of reads the end result.
    """
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def latest_of(log: DataFrame, *keys: str) -> DataFrame:
    """The last state of each key in the log of a streaming maximum `last`: it only grows, so the largest is the last."""
    return log.groupBy(*keys).agg(F.max("last").alias("last"))


def event_stream(spark: SparkSession, folder: str, table: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """The table's files as a stream, whether it is a folder of them or one; `files` of them at most in each micro-batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(like.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{folder}/{table}") if is_folder else reader.option("pathGlobFilter", table).parquet(folder)


def stream_latest(transitions: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Streaming aggregate: the value of the last transition of each key."""
    return transitions.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("last"))


def log_available(stream: DataFrame, checkpoint: str, out: str, change=lambda batch: batch) -> None:
    """Takes all input that is there and keeps change(batch) of each micro-batch in a folder of its own.

    A batch that is tried again replaces its own folder, so readers see each row once.
    """
    write = lambda batch, number: change(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


class UpsertTable:
    """A keyed table that streams update in place: rows are dealt to buckets by a hash of their key, and a micro-batch writes only the buckets that it touches, each as a new version named by the batch's number.

    A batch that is tried again replaces its own versions, and readers take each bucket's
    newest, so that a lost batch leaves no trace.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, keys, order, buckets
        self.schema = schema

    def _versions(self, before: int | None = None) -> DataFrame:
        full = f"{self.schema}, bucket int, batch int"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def read(self, before: int | None = None) -> DataFrame:
        """The table's rows, or as they were before a batch."""
        rows = self._versions(before)
        # One row for each bucket: a fixed number.
        newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(newest), ["bucket", "batch"], "left_semi").drop("bucket", "batch")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """The newest row of each key, by `order`, takes the place of the key's older one."""
        columns, of = batch.columns, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        newest = lambda df: df.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), F.struct(*self.order)).alias("_row")).select("_row.*")
        new = newest(batch).withColumn("bucket", of)
        touched = F.broadcast(new.select("bucket").distinct())
        old = self.read(number).withColumn("bucket", of).join(touched, "bucket", "left_semi").join(new.select(*self.keys), self.keys, "left_anti")
        rows = old.unionByName(new).withColumn("batch", F.lit(number))
        # Only the partitions written are replaced; those read are of earlier batches.
        rows.repartition("bucket").write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)


def high_water(table: DataFrame, column: str = "publication_date"):
    """The newest date that the table holds; null for an empty one."""
    return table.agg(F.max(column)).first()[0]


def poll_discovery(documents: DataFrame, table: UpsertTable, checkpoint: str, log: str) -> None:
    """One poll of a stream of documents(document_number, publication_date, content, received): all that has come since the last poll.

    Of these the documents dated at or after the table's high-water mark, as it was before
    the poll, go into the table: a number seen again updates its row in place. Documents
    without a date are taken. The checkpoint keeps what has been read, so none is read
    twice; the log has a folder for each batch with what became of its documents: created,
    updated, or unchanged by its content hash. Of a number that comes several times in one
    batch the one received last counts.
    """
    mark = high_water(table.read())
    due = documents if mark is None else documents.where((F.col("publication_date") >= F.lit(mark)) | F.col("publication_date").isNull())
    hashed = due.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            new = batch.groupBy("document_number").agg(F.max_by("content_hash", F.struct("received", "content_hash")).alias("content_hash"))
            old = table.read(number).select("document_number", F.col("content_hash").alias("_old"))
            action = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("content_hash"), "unchanged").otherwise("updated")
            new.join(old, "document_number", "left").select("document_number", action.alias("action")).write.mode("overwrite").parquet(f"{log}/batch={number}")
            table.upsert(batch, number)
        finally:
            batch.unpersist()

    hashed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start().awaitTermination()


def invalidated(changes: DataFrame, entries: DataFrame, applicable, subscribers: DataFrame) -> DataFrame:
    """(aircraft_id, change_type) to be matched anew after changes(change_type, id): of an entry its aircraft, of an aircraft itself, of an extraction all aircraft that its directive applies to or that subscribe to it.

    applicable: an Applicability of class links. Only the changed directives meet their classes.
    """
    one = changes.select("change_type", "id").distinct()
    kind = lambda k: one.where(F.col("change_type") == k)
    entry = kind("entry").join(entries.select(F.col("entry_id").alias("id"), "aircraft_id").distinct(), "id").select("aircraft_id", "change_type")
    itself = kind("aircraft").select(F.col("id").alias("aircraft_id"), "change_type")
    directive = kind("extraction").select(F.col("id").alias("directive_id"), "change_type")
    classes = directive.join(applicable.of_directives.select("directive_id", "target_class"), "directive_id").join(applicable.links, "target_class").select("component_class", "change_type").distinct()
    fits = classes.join(applicable.of_aircraft.select("aircraft_id", "component_class"), "component_class").select("aircraft_id", "change_type")
    follows = directive.join(subscribers.select("aircraft_id", "directive_id"), "directive_id").select("aircraft_id", "change_type")
    return entry.unionByName(itself).unionByName(fits).unionByName(follows).distinct()
