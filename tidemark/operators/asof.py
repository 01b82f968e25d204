"""Time-aware joins on (code, date) without range joins.

The probe side is reduced to its distinct (code, date) pairs first, so the per-code window that
resolves the match is bounded by the calendar even when one code holds most of the probe rows;
the answer then goes back through an equi-join, which AQE can split when a code is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _resolve(probe: DataFrame, bars: DataFrame, at: str, columns: tuple[str, ...], forward: bool, strict: bool) -> DataFrame:
    keys = probe.select("code", F.col(at).alias("_at")).distinct()
    marks = keys.select("code", "_at", F.lit(None).cast(
        bars.select(F.struct("d", *columns).alias("s")).schema["s"].dataType).alias("_s"), F.lit(True).alias("_probe"))
    rows = bars.select("code", F.col("d").alias("_at"), F.struct("d", *columns).alias("_s"), F.lit(False).alias("_probe"))
    # A probe on the day of a bar sees that bar unless the match is strict.
    ahead = (not strict) if not forward else strict
    side = F.when(F.col("_probe"), 1 if ahead else 0).otherwise(0 if ahead else 1)
    window = Window.partitionBy("code").orderBy("_at", "_side")
    if forward:
        hit = F.first("_s", ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))
    else:
        hit = F.last("_s", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return (
        marks.unionByName(rows).withColumn("_side", side).withColumn("_hit", hit)
        .where(F.col("_probe")).select("code", F.col("_at").alias(at), "_hit")
    )


def latest_bar(probe: DataFrame, bars: DataFrame, at: str, columns: tuple[str, ...] = ("c",),
               prefix: str = "last_", strict: bool = False) -> DataFrame:
    """J02. Bar at or before ``at`` (before it when strict); NULL columns when there is none."""
    hit = _resolve(probe, bars, at, columns, forward=False, strict=strict)
    picked = hit.select("code", at, *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in ("d", *columns)])
    return probe.join(picked, ["code", at], "left")


def next_bar(probe: DataFrame, bars: DataFrame, at: str, columns: tuple[str, ...] = ("o",),
             prefix: str = "next_") -> DataFrame:
    """J01. First bar strictly after ``at``."""
    hit = _resolve(probe, bars, at, columns, forward=True, strict=True)
    picked = hit.select("code", at, *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in ("d", *columns)])
    return probe.join(picked, ["code", at], "left")


def latest_close_on(bars: DataFrame, d) -> DataFrame:
    """J02 for one date: newest close per code at or before ``d``."""
    return bars.where(F.col("d") <= F.lit(d).cast("date")).groupBy("code").agg(
        F.max("d").alias("last_d"), F.max_by("c", "d").alias("last_c"))


def held_bars(probe: DataFrame, bars: DataFrame, since: str, until: str, name: str = "held_days") -> DataFrame:
    """J05. Bars of the code in ``(since, until]``, as a difference of bar positions."""
    numbered = bars.select("code", "d", F.row_number().over(Window.partitionBy("code").orderBy("d")).alias("seq"))
    out = latest_bar(probe, numbered, since, ("seq",), "_s_")
    out = latest_bar(out, numbered, until, ("seq",), "_u_")
    held = F.coalesce("_u_seq", F.lit(0)) - F.coalesce("_s_seq", F.lit(0))
    return out.withColumn(name, F.greatest(held, F.lit(0))).drop("_s_d", "_s_seq", "_u_d", "_u_seq")
