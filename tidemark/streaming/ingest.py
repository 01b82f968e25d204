"""Incremental ingest, sliding error alerts and one event per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import ERROR_DECISION, alert_label
from tidemark.sources.tables import upsert_table


def read_landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(stream: DataFrame, normalise: Callable[[DataFrame], DataFrame], table: str, key: Sequence[str], checkpoint: str,
           policy: str = "overwrite", partition: str = "year", available_now: bool = True, order: Sequence[str] = (),
           rejected: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """S20. Land pages into a keyed table. The checkpoint is the cursor: it moves only when a batch
    is stored, and storing the same batch again changes nothing. With ``order`` the stored table keeps the place
    of each row, and the size of a batch does not change it. A batch with ``rejected`` rows writes them to
    ``{table}_rejected`` and fails, so the cursor stays before it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        if rejected is not None:
            bad = rejected(batch)
            if not bad.isEmpty():
                bad.write.mode("overwrite").parquet(f"{table}_rejected/batch={batch_id}")
                raise ValueError(f"batch {batch_id} has rows that cannot be read; see {table}_rejected")
        upsert_table(batch.sparkSession, table, normalise(batch), key, policy, partition, order)

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def sliding_alerts(decisions: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """S21. Failures per label in a sliding event-time window."""
    failed = decisions.where(F.col("decision") == ERROR_DECISION).withWatermark("ts", late)
    out = failed.groupBy(F.window("ts", length, slide), alert_label(F.coalesce("rationale", F.lit(""))).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "label", "n", "last_ts")


def once_per_key(events: DataFrame, key: Sequence[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """S22. The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))
