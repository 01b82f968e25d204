"""Market calendar, month splits and signal dates.

The calendar has one row per trading day, so its unpartitioned windows stay small at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUARTERLY = (2, 5, 8, 11)
MONTHLY = tuple(range(1, 13))


def market_calendar(bars: DataFrame) -> DataFrame:
    """W21. Trading days with their position, neighbours and first-of-month flag."""
    days = bars.select("d").distinct()
    order = Window.orderBy("d")
    month = Window.partitionBy(F.year("d"), F.month("d"))
    return days.select(
        "d",
        F.row_number().over(order).alias("day_no"),
        F.lag("d").over(order).alias("prev_d"),
        F.lead("d").over(order).alias("next_d"),
        (F.col("d") == F.min("d").over(month)).alias("first_of_month"),
    )


def rebalance_days(bars: DataFrame, start=None, end=None, months: tuple[int, ...] = QUARTERLY) -> DataFrame:
    """W21. First trading day of each rebalance month within the range, and the fill day after it."""
    days = market_calendar(bars)
    inside = days
    if start is not None:
        inside = inside.where(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside.where(F.col("d") <= F.lit(end).cast("date"))
    first = inside.groupBy(F.year("d").alias("_y"), F.month("d").alias("_m")).agg(F.min("d").alias("d"))
    return first.where(F.col("_m").isin(*months)).select("d").join(days.select("d", "day_no", "next_d"), "d")


def month_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """S07. One row per calendar month touched by ``[start, end]``, cut at its borders."""
    month = F.explode(F.sequence(F.trunc(start, "month"), F.col(end), F.expr("interval 1 month")))
    return df.where(F.col(start) <= F.col(end)).withColumn("_m", month).withColumn(
        "range_start", F.greatest(F.col(start), F.col("_m").cast("date"))
    ).withColumn("range_end", F.least(F.last_day("_m"), F.col(end))).drop("_m")


def entry_signal_dates(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """C33. For every trading day: the last signal day before it, if that day fills today."""
    marks = (
        bars.select(F.col("d"), F.lit(True).alias("is_bar")).distinct()
        .join(signals.select("d", F.lit(True).alias("is_signal")).distinct(), "d", "full_outer")
    )
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("d").rowsBetween(1, Window.unboundedFollowing)
    dated = marks.select(
        "d", "is_bar",
        F.last(F.when(F.col("is_signal"), F.col("d")), ignorenulls=True).over(before).alias("signal_d"),
        F.when(F.col("is_signal"), F.first(F.when(F.col("is_bar"), F.col("d")), ignorenulls=True).over(after)).alias("fill_d"),
    ).withColumn("signal_fill", F.last("fill_d", ignorenulls=True).over(before))
    return dated.where(F.col("is_bar")).select(
        F.col("d").alias("today"), F.when(F.col("signal_fill") == F.col("d"), F.col("signal_d")).alias("signal_d"))


def with_previous_market_close(bars: DataFrame) -> DataFrame:
    """J11. Each bar with the close of the same code on the previous market day."""
    days = market_calendar(bars).select("d", "prev_d")
    previous = bars.select("code", F.col("d").alias("prev_d"), F.col("c").alias("prev_c"))
    return bars.join(days, "d").join(previous, ["code", "prev_d"], "left")


def latest_day(bars: DataFrame) -> DataFrame:
    """S18. Newest bar date."""
    return bars.agg(F.max("d").alias("d"))
