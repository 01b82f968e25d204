"""Trading costs, sizing, stops and position marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One-way slippage, one-way fee and sell-side tax, in basis points.
SLIPPAGE_BPS = 20
FEE_BPS = 1.5
TAX_BPS = 20

SLIP = SLIPPAGE_BPS / 10000
FEE = FEE_BPS / 10000
TAX = TAX_BPS / 10000
BUY_FACTORS = (1 + SLIP, 1 + FEE)
SELL_FACTORS = (1 - SLIP, 1 - FEE - TAX)


def buy_fill(px: Column) -> Column:
    return px * F.lit(BUY_FACTORS[0]) * F.lit(BUY_FACTORS[1])


def sell_fill(px: Column) -> Column:
    return px * F.lit(SELL_FACTORS[0]) * F.lit(SELL_FACTORS[1])


def net_return(entry_px: Column, exit_px: Column) -> Column:
    """Return of a round trip from raw entry to raw exit price, after costs."""
    return sell_fill(exit_px) / buy_fill(entry_px) - 1


BUY_COST = BUY_FACTORS[0] * BUY_FACTORS[1] - 1.0
SELL_COST = 1.0 - SELL_FACTORS[0] * SELL_FACTORS[1]


def position_size(capital: Column, slots: Column, px: Column) -> Column:
    """P13. Whole shares one slot can buy; NULL when not even one."""
    qty = F.floor(F.try_divide(F.try_divide(capital, slots), px))
    return F.when(qty >= 1, qty)


def stop_price(entry: Column, pct: Column) -> Column:
    """P14. A zero percentage means no stop, stored as price 0."""
    return F.when(pct > 0, entry * (1 - pct)).otherwise(F.lit(0.0))


def blended_entry(held: Column, entry: Column, added: Column, px: Column) -> Column:
    """P15. Quantity-weighted entry price after a top-up."""
    return F.when(held > 0, (held * entry + added * px) / (held + added)).otherwise(px)


def realized(px: Column, entry: Column) -> Column:
    """P15. Realised return of a reduction; 0 when the entry price is missing."""
    return F.when(entry > 0, px / entry - 1).otherwise(F.lit(0.0))


def mark_pct(px: Column, entry: Column) -> Column:
    """P16. Mark-to-market percentage, two digits."""
    return F.round((F.try_divide(px, entry) - 1) * 100, 2)


def unrealized(px: Column, entry: Column, qty: Column) -> Column:
    """P16. Unrealised amount, whole currency units."""
    return F.round((px - entry) * qty, 0)
