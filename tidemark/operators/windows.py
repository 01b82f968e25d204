"""Rolling measures per code.

Every window here is partitioned by ``code`` over rows that are unique per (code, d). Such a group
is bounded by the length of the trading calendar, whatever the size of the raw data. All windows
share one partitioning and ordering, so a single exchange and sort serve a whole projection.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import over_positive


def by_code():
    return Window.partitionBy("code").orderBy("d")


def _full(x: Column, frame, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(frame) == n, value)


def sma(x: Column, n: int) -> Column:
    """W01. Mean of the last ``n`` rows including today; NULL until ``n`` values exist."""
    frame = by_code().rowsBetween(-(n - 1), 0)
    return _full(x, frame, n, F.avg(x).over(frame))


def rolling_std(x: Column, n: int) -> Column:
    """W02. Population deviation of the last ``n`` rows."""
    frame = by_code().rowsBetween(-(n - 1), 0)
    return _full(x, frame, n, F.stddev_pop(x).over(frame))


def prior_mean(x: Column, n: int) -> Column:
    """Mean of the ``n`` rows before today, all of them present."""
    frame = by_code().rowsBetween(-n, -1)
    return _full(x, frame, n, F.avg(x).over(frame))


def prior_ratio(x: Column, n: int = 30) -> Column:
    """W03, W07. Today over the mean of the previous ``n`` rows."""
    return over_positive(x, prior_mean(x, n))


def prior_abs_ratio(x: Column, n: int = 30) -> Column:
    """W06. Today over the mean absolute value of the previous ``n`` rows."""
    return over_positive(x, prior_mean(F.abs(x), n))


def with_prior_range(bars: DataFrame, n: int = 252, prefix: str = "_prior", low: str = "l", high: str = "h") -> DataFrame:
    """Smallest ``low``, largest ``high`` and count of ``low`` over the ``n`` rows before today, as ``<prefix>_lo``, ``_hi``, ``_n``.

    Rows are cut into blocks of ``n``. Any ``n`` rows in a row are the end of one block and the start of the next, so two running
    extremes per block answer every row, whatever ``n``: work is linear in the rows.
    """
    row = F.col("_row")
    numbered = bars.withColumn("_row", F.row_number().over(by_code()) - 1).withColumn("_block", F.floor(row / n))
    back = Window.partitionBy("code", "_block").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    forth = Window.partitionBy("code", "_block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("code").orderBy("_block", "d")  # the order by day, in the sort of ``forth``
    ends = numbered.select("*", F.min(low).over(back).alias("_end_lo"), F.max(high).over(back).alias("_end_hi"))
    both = ends.select("*", F.min(low).over(forth).alias("_start_lo"), F.max(high).over(forth).alias("_start_hi"),
                       F.count(low).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_seen"))
    return both.select(
        *bars.columns,
        F.least(F.lag("_end_lo", n).over(line), F.lag("_start_lo", 1).over(line)).alias(f"{prefix}_lo"),
        F.greatest(F.lag("_end_hi", n).over(line), F.lag("_start_hi", 1).over(line)).alias(f"{prefix}_hi"),
        (F.col("_seen") - F.coalesce(F.lag("_seen", n).over(line), F.lit(0))).alias(f"{prefix}_n"))


def range_position(n: int, min_rows: int | None = None, prefix: str = "_prior", close: str = "c") -> Column:
    """W04. Close within the range found by ``with_prior_range``; ``min_rows`` of the ``n`` rows must exist, by default all."""
    lo, hi, seen = (F.col(f"{prefix}_{x}") for x in ("lo", "hi", "n"))
    return F.when((seen >= (n if min_rows is None else min_rows)) & (hi > lo), (F.col(close) - lo) / (hi - lo))


def with_position_in_range(bars: DataFrame, name: str = "pos52w", n: int = 252, min_rows: int | None = None) -> DataFrame:
    """W04. ``bars`` with the close within the range of the previous ``n`` rows."""
    return with_prior_range(bars, n).select(*bars.columns, range_position(n, min_rows).alias(name))


def daily_return(c: Column) -> Column:
    """W05."""
    return c / F.nullif(F.lag(c).over(by_code()), F.lit(0.0)) - 1


def carried(x: Column) -> Column:
    """W08. Latest known value at or before today."""
    return F.last(x, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


def forward_return(o: Column, c: Column, horizon: int) -> Column:
    """W11. Buy at the next open, sell at the close ``horizon`` rows later, no costs."""
    return over_positive(F.lead(c, 1 + horizon).over(by_code()), F.lead(o, 1).over(by_code())) - 1


def return_since(c: Column, bars: int) -> Column:
    """W17. Change against the close ``bars`` rows ago."""
    return c / F.nullif(F.lag(c, bars).over(by_code()), F.lit(0.0)) - 1


def trend(c: Column, bars: int = 20) -> Column:
    """W18. Percent change over the last ``bars`` closes; 0 when there are fewer."""
    return F.coalesce((c / F.nullif(F.lag(c, bars - 1).over(by_code()), F.lit(0.0)) - 1) * 100, F.lit(0.0))


def bar_index() -> Column:
    """W20. 1-based position of a bar in its code."""
    return F.row_number().over(by_code())


def with_forward_returns(bars: DataFrame, horizons: Iterable[int]) -> DataFrame:
    return bars.select("*", *[forward_return(F.col("o"), F.col("c"), h).alias(f"fwd_{h}") for h in horizons])


def indicator_panel(bars: DataFrame) -> DataFrame:
    """C30. Returns, averages, volatility, volume and turnover ratios, 52-week position."""
    base = with_position_in_range(bars.withColumn("ret", daily_return(F.col("c"))), "pos52w", 252)
    c, v = F.col("c"), F.col("v").cast("double")
    return base.select(
        "code", "d", "o", "h", "l", "c", "v", "ret",
        sma(c, 20).alias("sma20"),
        sma(c, 60).alias("sma60"),
        rolling_std(F.col("ret"), 20).alias("vol20"),
        prior_ratio(v, 30).alias("vr30"),
        prior_ratio(c * v, 30).alias("ar30"),
        "pos52w",
    )
