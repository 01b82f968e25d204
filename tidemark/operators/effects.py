"""C22 without pairs: the effect of one setting from ordered scans over the runs that differ in nothing else.

Runs of one window whose other settings agree form a group; two runs of a group with different values of the setting are
compared. A group of n runs holds up to n * n / 2 comparisons, but what is asked of them needs no list:

* their number and the mean of their differences follow from each run's places in its group and among the runs of its value;
* the smallest and the largest difference of a run to an earlier one follow from the running extreme of the earlier runs of
  another value;
* the largest z lies between two runs that no run beats at both mean and standard error; those few are compared.

Groups are cut into ordered shards; a shard's extremes are carried to the shards after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import row_numbers, with_shard
from tidemark.session import pin

GROUP = ("start_d", "end_d", "setting", "rest")


def _scan(df: DataFrame, part: Sequence[str], order: Sequence[str], x: Column, value: Column, rest: Column | None = None) -> DataFrame:
    """Add what the rows before hold: ``_p`` the smallest (x, value), ``_s`` the smallest x of any value but that one.

    A row of another value than the smallest so far adds the larger of the two to the candidates of ``_s``, ``_c``; what has been
    added before is never smaller than a minimum that is overtaken, so one running minimum of them is enough. ``rest``
    is the ``_s`` of rows that stand for many.
    """
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_p", F.min(F.struct(x.alias("x"), value.alias("value"))).over(before))
    other = F.when(F.col("_p.value") != value, F.greatest(x, F.col("_p.x")))
    return df.withColumn("_c", other if rest is None else F.least(other, rest)).withColumn("_s", F.min("_c").over(before))


def with_earlier(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: Column, value: str = "value", shard_rows: int | None = None) -> DataFrame:
    """Rows with the state of ``_scan`` before them: in their shard (``_p``, ``_s``) and over the shards before it (``_pp``, ``_ss``)."""
    keys = list(keys)
    rows = _scan(with_shard(df.withColumn("_x", x), keys, order, shard_rows=shard_rows), [*keys, "_shard"], order, F.col("_x"), F.col(value))
    per = rows.groupBy(*keys, "_shard").agg(F.min(F.struct(F.col("_x").alias("x"), F.col(value).alias("value"))).alias("_q"), F.min("_c").alias("_r"))
    per = _scan(per, keys, ["_shard"], F.col("_q.x"), F.col("_q.value"), F.col("_r"))
    return rows.join(per.select(*keys, "_shard", F.col("_p").alias("_pp"), F.col("_s").alias("_ss")), [*keys, "_shard"])


def _smallest_other(value: Column) -> Column:
    """Smallest x of the earlier rows of another value."""
    return F.least(*[F.when(F.col(f"{p}.value") != value, F.col(f"{p}.x")).otherwise(F.col(s)) for p, s in (("_p", "_s"), ("_pp", "_ss"))])


def _beaten(value: Column, x: Column) -> Column:
    """An earlier row of the same value, or two of different values, have no larger x."""
    def by(p, s):
        return x >= F.when(F.col(f"{p}.value") == value, F.col(f"{p}.x")).otherwise(F.col(s))

    both = (x >= F.col("_p.x")) & (x >= F.col("_pp.x")) & (F.col("_p.value") != F.col("_pp.value"))
    return F.coalesce(by("_p", "_s"), F.lit(False)) | F.coalesce(by("_pp", "_ss"), F.lit(False)) | F.coalesce(both, F.lit(False))


def effects(members: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """Per setting: ``n_comp`` comparisons, ``mean_delta``, the range ``lo`` to ``hi`` of the differences and ``max_abs_z``.

    ``members`` (start_d, end_d, setting, rest, id, value, n, mean_pct, std_pct) has one row per run and group; a difference is that
    of the run with the larger id less that of the other. Runs without trades or figures do not take part. The runs compared
    for z are few where mean and standard error are unrelated; were every run with a larger error also more extreme, all of a group would be.
    """
    known = members.where(F.col("n") > 0).dropna(subset=["mean_pct", "std_pct"])
    known = known.select(*GROUP, "id", "value", F.col("mean_pct").alias("m"), (F.col("std_pct") * F.col("std_pct") / F.col("n")).alias("e"))
    rows = pin(known, "members")
    m, value, g = F.col("m"), F.col("value"), list(GROUP)

    placed = row_numbers(rows, g, ["id"], "_rn", write_once=False).withColumnRenamed("_total", "_all")
    placed = row_numbers(placed, [*g, "value"], ["id"], "_rs", write_once=False)
    earlier, later = F.col("_rn") - F.col("_rs"), F.col("_all") - F.col("_total") - (F.col("_rn") - F.col("_rs"))
    out = placed.groupBy("setting").agg(F.sum(earlier).alias("n_comp"), F.sum(m * (earlier - later)).alias("_sum"))

    up = with_earlier(rows, g, ["id"], m, shard_rows=shard_rows).groupBy("setting").agg(F.max(m - _smallest_other(value)).alias("hi"))
    down = with_earlier(rows, g, ["id"], -m, shard_rows=shard_rows).groupBy("setting").agg(F.min(m + _smallest_other(value)).alias("lo"))

    # Without a standard error z counts as 0, so runs without spread beat no others.
    apart = rows.withColumn("_still", F.col("e") == 0)

    def best(x):
        some = with_earlier(apart, [*g, "_still"], ["e", "_x", "id"], x, shard_rows=shard_rows)
        return some.where(~_beaten(value, F.col("_x"))).select(*g, "value", "m", "e")

    low = best(m).select(*g, *[F.col(c).alias(f"_a_{c}") for c in ("value", "m", "e")])
    both = low.join(best(-m), g).where(F.col("_a_value") != value)
    se = F.sqrt(F.col("_a_e") + F.col("e"))
    z = both.groupBy("setting").agg(F.max(F.when(se > 0, (m - F.col("_a_m")) / se)).alias("_z"))
    out = out.where(F.col("n_comp") > 0).join(up, "setting").join(down, "setting").join(z, "setting", "left")
    return out.select("setting", "n_comp", (F.col("_sum") / F.col("n_comp")).alias("mean_delta"), "lo", "hi",
                      F.greatest(F.col("_z"), F.lit(0.0)).alias("max_abs_z"))
