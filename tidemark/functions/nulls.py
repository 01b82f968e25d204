"""Missing-value rules (F05, P04, P12): zero denominators and non-finite values become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """F05. True for a real number; false for NULL, NaN and either infinity."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    """P04."""
    return F.when(is_finite(x), x)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL unless the denominator is positive."""
    return F.when(den > 0, num / den)


def over_positive(num: Column, den: Column) -> Column:
    """``ratio`` of doubles that names each operand once, so a window aggregate given to it is evaluated once."""
    return F.try_divide(num, F.greatest(den, F.lit(0.0)))


def quotient(num: Column, den: Column) -> Column:
    """P12. num / den, NULL on a zero or missing denominator."""
    return F.try_divide(num, den)


def financial_ratios(revenue, op_income, net_income, equity, liabilities, market_cap) -> dict[str, Column]:
    """P12. Margin, ROE, debt, PER, PBR, earnings yield and book yield."""
    return {
        "margin": quotient(op_income, revenue),
        "roe": quotient(net_income, equity),
        "debt_ratio": quotient(liabilities, equity),
        "per": quotient(market_cap, net_income),
        "pbr": quotient(market_cap, equity),
        "earnings_yield": quotient(net_income, market_cap),
        "book_yield": quotient(equity, market_cap),
    }
