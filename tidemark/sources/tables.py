"""Stored tables - scans, bucketed tables, keyed upserts, pending ranges and run storage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_bars(spark: SparkSession, path: str, codes: Sequence[str] | None = None, start=None, end=None,
              columns: Sequence[str] = ("code", "d", "o", "h", "l", "c", "v")) -> DataFrame:
    """S01. Bars of a code list and date range; both reach the Parquet scan as filters."""
    return select_bars(spark.read.parquet(path), codes, start, end, columns)


def select_bars(bars: DataFrame, codes=None, start=None, end=None, columns=("code", "d", "o", "h", "l", "c", "v")) -> DataFrame:
    if codes is not None:
        bars = bars.where(F.col("code").isin(*codes))
    if start is not None:
        bars = bars.where(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("d") <= F.lit(end).cast("date"))
    return bars.select(*columns)


def write_bars(bars: DataFrame, path: str) -> None:
    """Partition by year for pruning; contiguous code ranges per file for min/max statistics."""
    out = bars.withColumn("year", F.year("d"))
    out.repartitionByRange("year", "code", "d").sortWithinPartitions("year", "code", "d").write.partitionBy("year").mode(
        "overwrite").parquet(path)


def store_by_code(df: DataFrame, table: str, path: str | None = None, buckets: int = 64) -> None:
    """S01. Write ``df`` as ``table``, bucketed by code and sorted by (code, d) with one file a bucket.

    Tables with the same number of buckets meet on code without an exchange, and so do the windows per code after them: the shuffle is
    paid once, when the table is written. Joins on (code, d) need ``spark.sql.requireAllClusterKeysForCoPartition=false`` for it,
    as ``build_session`` sets. ``path`` puts the files outside the warehouse. A hot code makes its bucket large, never more than its calendar.
    """
    writer = df.repartition(buckets, "code").write.bucketBy(buckets, "code").sortBy("code", "d").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _pick(df: DataFrame, key: Sequence[str], order: str, last: bool) -> DataFrame:
    """One row per key as a mergeable aggregate, so duplicates fold before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    choose = F.max_by if last else F.min_by
    picked = df.groupBy(*key).agg(choose(F.struct(*rest), F.col(order)).alias("_r"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    return _pick(df, key, order, last=False)


def keep_last(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    return _pick(df, key, order, last=True)


def upsert(stored: DataFrame, batch: DataFrame, key: Sequence[str], policy: str = "overwrite", order: Sequence[str] = ()) -> DataFrame:
    """S12. Stored rows merged with a batch; the batch wins ('overwrite') or loses ('keep') on equal keys.

    With ``order`` the larger place wins ('overwrite') or the smaller ('keep'), whichever batch it came in, so
    the table does not depend on how rows were cut into batches. ``batch`` must be unique by key already.
    """
    batch = batch.select(*stored.columns)
    if order and policy in ("overwrite", "keep"):
        both = stored.unionByName(batch).withColumn("_order", F.struct(*order))
        return _pick(both, key, "_order", policy == "overwrite").drop("_order")
    if policy == "overwrite":
        return stored.join(batch.select(*key), list(key), "left_anti").select(*stored.columns).unionByName(batch)
    if policy == "keep":
        return stored.unionByName(batch.join(stored.select(*key), list(key), "left_anti").select(*stored.columns))
    raise ValueError(f"unknown policy: {policy}")


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, key: Sequence[str], policy: str = "overwrite",
                 partition: str = "year", order: Sequence[str] = ()) -> None:
    """S12 on a partitioned Parquet table: merge and replace only the partitions the batch touches.

    ``partition`` must be a column of the batch that is a function of the key (the year of ``d``, say).
    Storing the same batch again gives the same table.
    """
    if not table_exists(spark, path):
        batch.repartitionByRange(partition, *key).write.partitionBy(partition).parquet(path)
        return
    # The list of touched partition values is bounded by the number of partitions of the table.
    batch = batch.persist()  # read for its partitions and again for the merge
    touched = [row[0] for row in batch.select(partition).distinct().collect()]
    stored = spark.read.parquet(path).where(F.col(partition).isin(touched))
    merged = upsert(stored, batch, key, policy, order)
    # By range of the key, so that one large partition is written by many tasks.
    (merged.repartitionByRange(partition, *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
    batch.unpersist()


def pending_ranges(codes: DataFrame, stored: DataFrame, start, end) -> DataFrame:
    """S11. Range still to collect per code: from its newest row, or from ``start``; finished codes drop."""
    last = stored.groupBy("code").agg(F.max("d").alias("last"))
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    out = codes.select("code").join(last, "code", "left").where(F.col("last").isNull() | (F.col("last") < b))
    return out.select("code", F.coalesce("last", a).alias("range_start"), b.alias("range_end")).where(
        F.col("range_start") <= F.col("range_end"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """S14."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def collection_universe(caps: DataFrame, collected: DataFrame, bars: DataFrame, floor: float) -> DataFrame:
    """S16, U01. (Large or already collected) and present in the bars."""
    large = caps.where(F.col("market_cap") >= floor).select("code")
    return large.union(collected.select("code")).intersect(bars.select("code"))


def not_stored(targets: DataFrame, stored: DataFrame, period: str) -> DataFrame:
    """S17. Codes without a row for the period."""
    return targets.join(stored.where(F.col("period") == period).select("code"), "code", "left_anti")


def run_rows(stats: DataFrame) -> DataFrame:
    """S15. Runs as stored: parameters and summary as JSON text."""
    summary = F.to_json(F.struct("n", "mean_pct", "std_pct", "t_val"))
    params = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params"))))
    return stats.select("id", "ts", "strategy", "start_d", "end_d", params.alias("params"), summary.alias("summary"))


def save_runs(path: str, runs: DataFrame, trades: DataFrame) -> None:
    """S15. Replace the strategies named in ``runs``, runs and trades alike; other strategies stay as they are.

    Trades are written first, under a version of their own, and the run rows then point at that version. A re-run
    without trades leaves none behind, and a failure between the two writes leaves the old state readable.
    """
    version = uuid.uuid4().hex
    ranged = trades.repartitionByRange("strategy", *[c for c in ("exit_d", "code", "entry_d") if c in trades.columns])
    ranged.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "strategy").parquet(f"{path}/trades")
    (runs.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("strategy").parquet(f"{path}/runs"))


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """S15. The current runs."""
    return spark.read.parquet(f"{path}/runs").drop("version")


def stored_trades(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S15. The trades of the current runs; ``schema`` names the columns of the trades, ``strategy`` among them."""
    current = spark.read.parquet(f"{path}/runs").select("strategy", "version").distinct()
    trades = spark.read.schema(f"{schema}, version string").parquet(f"{path}/trades")
    return trades.join(current, ["strategy", "version"], "left_semi").drop("version")


def superseded_trades(spark: SparkSession, path: str, older_than: int = 86_400) -> DataFrame:
    """S15. Folders of trades that no run points at, written at least ``older_than`` seconds ago.

    The age keeps a save that has written its trades and not yet its runs. Only partition values and file names are read.
    """
    current = spark.read.parquet(f"{path}/runs").select("strategy", "version").distinct()
    stored = spark.read.option("basePath", f"{path}/trades").parquet(f"{path}/trades")
    files = stored.select("strategy", "version", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"),
                          F.col("_metadata.file_modification_time").alias("written"))
    folders = files.groupBy("strategy", "version", "folder").agg(F.max("written").alias("written"))
    old = folders.where(F.col("written") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(older_than)))
    return old.join(current, ["strategy", "version"], "left_anti").select("strategy", "version", "folder")


def remove_superseded(spark: SparkSession, path: str, older_than: int = 86_400) -> int:
    """S15. Delete the folders of ``superseded_trades``; returns their number, one per strategy and save that was replaced."""
    folders = [row["folder"] for row in superseded_trades(spark, path, older_than).select("folder").toLocalIterator()]
    for folder in folders:
        gone = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return len(folders)
