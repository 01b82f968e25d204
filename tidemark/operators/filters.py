"""Row predicates and code filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import is_finite

# Floors of the live strategy, in won, and report name prefixes.
MIN_TURNOVER = 1_000_000_000
TURNOVER_BARS = 20
MIN_MARKET_CAP = 300_000_000_000
REPORT_PREFIXES = ("분기보고서", "반기보고서", "사업보고서")
ROE_MIN = 0.03
DEBT_MAX = 2.0


def is_ordinary(code: Column) -> Column:
    """F01. Ordinary shares have an all-digit code."""
    return code.rlike("^[0-9]+$")


def turnover_mean(bars: int = TURNOVER_BARS) -> Column:
    """F02 for all days: mean of close x volume over the last bars (fewer at the start)."""
    frame = Window.partitionBy("code").orderBy("d").rowsBetween(-(bars - 1), 0)
    return F.avg(F.col("c") * F.col("v").cast("double")).over(frame)


def liquid_on(bars: DataFrame, d, floor: float = MIN_TURNOVER, n: int = TURNOVER_BARS) -> DataFrame:
    """F02 for one day: codes whose mean turnover over the newest bars reaches the floor."""
    recent = Window.partitionBy("code").orderBy(F.col("d").desc())
    return (
        bars.where(F.col("d") <= F.lit(d).cast("date"))
        .select("code", (F.col("c") * F.col("v").cast("double")).alias("t"), F.row_number().over(recent).alias("rn"))
        .where(F.col("rn") <= n).groupBy("code").agg(F.avg("t").alias("turnover"))
        .where(F.col("turnover") >= floor)
    )


def large_enough(cap: Column, floor: float = MIN_MARKET_CAP) -> Column:
    """F03. A missing market cap never passes."""
    return F.coalesce(cap >= floor, F.lit(False))


def tradable_on(codes: DataFrame, bars: DataFrame, d, floor: float = MIN_TURNOVER,
                caps: DataFrame | None = None, cap_floor: float = MIN_MARKET_CAP) -> DataFrame:
    """F04. Ordinary, liquid and, with ``caps``, large enough."""
    out = codes.where(is_ordinary(F.col("code"))).join(liquid_on(bars, d, floor).select("code"), "code", "left_semi")
    if caps is not None:
        out = out.join(caps.where(large_enough(F.col("market_cap"), cap_floor)).select("code"), "code", "left_semi")
    return out


def rankable(x: Column) -> Column:
    """F05."""
    return is_finite(x)


def is_earnings_report(name: Column) -> Column:
    """F06."""
    out = F.lit(False)
    for prefix in REPORT_PREFIXES:
        out = out | name.startswith(prefix)
    return out


def passes_fundamentals(op: Column, prev_op: Column, net: Column, equity: Column, debt: Column) -> Column:
    """F07. All inputs present, profit growing, ROE and debt within bounds."""
    known = op.isNotNull() & prev_op.isNotNull() & net.isNotNull() & equity.isNotNull() & debt.isNotNull()
    sound = (equity > 0) & (op > 0) & (op > prev_op)
    ratios = F.when(equity > 0, (net / equity >= ROE_MIN) & (debt / equity <= DEBT_MAX))
    return F.coalesce(known & sound & ratios, F.lit(False))


def quality_eligible(cap_floor: float = MIN_MARKET_CAP, debt_max: float = DEBT_MAX) -> Column:
    """F08 over market_cap, equity, net_income_ttm, revenue_ttm and liabilities."""
    positive = (F.col("equity") > 0) & (F.col("net_income_ttm") > 0) & (F.col("revenue_ttm") > 0)
    debt = F.when(F.col("equity") > 0, F.col("liabilities") / F.col("equity"))
    return F.coalesce((F.col("market_cap") >= cap_floor) & positive & (debt <= debt_max), F.lit(False))


def superset_universe(bars: DataFrame, shares: DataFrame, signals: DataFrame, floor: float) -> DataFrame:
    """F09. Codes that may ever have reached the cap floor and that have signals."""
    top = bars.groupBy("code").agg(F.max("c").alias("mc"))
    most = shares.groupBy("code").agg(F.max("issued").alias("mi"))
    return top.join(most, "code").where(F.col("mc") * F.col("mi") >= floor).select("code").join(
        signals.select("code").distinct(), "code", "left_semi")


def pbr_within(pbr: Column, limit: float | None) -> Column:
    """F10. Without a limit everything passes; with one a missing value fails."""
    return F.lit(True) if limit is None else F.coalesce(pbr <= limit, F.lit(False))


def entry_gate(avoid: float, start=None, end=None) -> Column:
    """F11. Not overheated and labelled neutral, within a date range."""
    out = (F.col("heat_score") < avoid) & (F.col("signal") == "neutral")
    if start is not None:
        out = out & (F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        out = out & (F.col("d") <= F.lit(end).cast("date"))
    return out


def ledger_rows(ledger: DataFrame, mode: str = "paper", now=None, days: int | None = None,
                side: str = "", reason: str = "") -> DataFrame:
    """F12. Unknown side or exit reason falls back to no filter."""
    out = ledger.where(F.col("mode") == mode)
    if reason:
        hit = F.coalesce(F.col("exit_reason") == reason, F.lit(False))
        columns, one = out.columns, F.lit(1).alias("_one")
        known = out.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_known")).select("_known", one)  # one row
        out = out.select("*", one).join(known, "_one").where(hit | ~F.col("_known")).select(*columns)
    if days is not None:
        out = out.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    if side in ("buy", "sell"):
        out = out.where(F.col("side") == side)
    return out


def not_entered(orders: DataFrame, positions: DataFrame, ledger: DataFrame, today) -> DataFrame:
    """F13. Drop codes that are held or were bought today, per (code, strategy, mode)."""
    key = ["code", "strategy", "mode"]
    bought = ledger.where((F.col("side") == "buy") & (F.col("ts").cast("date") == F.lit(today).cast("date")))
    return orders.join(positions.select(*key), key, "left_anti").join(bought.select(*key), key, "left_anti")


def valid_price(px: Column) -> Column:
    """F14. Halted bars carry price 0."""
    return is_finite(px) & (px > 0)


def trusted_run(params: Column) -> Column:
    """F15. Point-in-time universe, or no market-cap filter at all."""
    dated = F.coalesce(F.try_element_at(params, F.lit("point_in_time_universe")) == "true", F.lit(False))
    unfiltered = F.coalesce(F.try_element_at(params, F.lit("marcap_filter")) == "false", F.lit(False))
    return dated | unfiltered
