"""Verdicts on run statistics, parameter fingerprints and strategy families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strategy families by name prefix, in matching order.
FAMILIES = (
    ("quality", ("q2_", "q3_", "quality")),
    ("contrarian", ("pit_", "rerun_", "contrarian", "credit_rank", "factor_", "pool_")),
    ("fundamental", ("fundamental",)),
)
# Settings that always move together count as one; some are never compared.
SETTING_GROUPS = {
    "exit_rank_pct": "signal_exit",
    "exit_cols": "signal_exit",
    "pbr_applied": "pbr_applied",
    "selection": "pbr_applied",
}
RANK_SETTINGS = ("rank_col", "ascending")
IGNORED_SETTINGS = ("marcap_filter", "windows", "pbr_limits")


def verdict(n: Column, mean_pct: Column, t_val: Column) -> Column:
    """P22. Sign of the mean after costs and abs(t) >= 2."""
    return (
        F.when(n.isNull() | (n == 0) | mean_pct.isNull() | t_val.isNull(), "none")
        .when((mean_pct >= 0) & (t_val >= 2), "good")
        .when(mean_pct >= 0, "warn")
        .otherwise("bad")
    )


def fingerprint(params: Column) -> Column:
    """P24. JSON of a string map with sorted keys: equal settings give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def family(strategy: Column) -> Column:
    """P25."""
    out = None
    for key, prefixes in FAMILIES:
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | strategy.startswith(prefix)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out.otherwise("other")


def logical_setting(key: Column) -> Column:
    """Name under which a raw setting is compared."""
    out = None
    for raw, group in SETTING_GROUPS.items():
        out = F.when(key == raw, group) if out is None else out.when(key == raw, group)
    return out.otherwise(key)


def any_positive_chance(k: Column) -> Column:
    """A23. Percent chance that one of k null variants looks significant."""
    return F.round((1 - F.pow(F.lit(0.95), k)) * 100, 1)
