"""Contribution of each ratio, the heat score and its label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (base line, slope, symmetric bound) of each scored ratio, and label thresholds.
FLOW = (1.0, 3.0, 4.0)
CREDIT = (1.0, 3.0, 3.0)
VOLUME = (1.5, 2.0, 3.0)
AVOID_AT = 7.0
SELL_AT = 8.5


def contribution(x: Column, shape: tuple[float, float, float]) -> Column:
    """P02. Clipped linear contribution; NULL stays NULL because clipping ignores NULL."""
    base, slope, bound = shape
    raw = (x - F.lit(base)) * F.lit(slope)
    return F.when(x.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), raw)))


def heat_score(flow: Column, credit: Column, volume: Column) -> Column:
    """P03. Sum of the present contributions; 0 when all three are missing."""
    parts = (contribution(flow, FLOW), contribution(credit, CREDIT), contribution(volume, VOLUME))
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    return total


def heat_label(score: Column, avoid: float = AVOID_AT, sell: float = SELL_AT) -> Column:
    return F.when(score >= sell, "sell").when(score >= avoid, "avoid").otherwise("neutral")
