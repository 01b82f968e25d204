"""Order statistics and running totals over groups of any size.

A window partitioned only by the group key would put the whole group into one task. These helpers
cut every group into ordered shards first. The cut points are a pure function of the data (a
hash-selected subset of the order keys), so recomputed tasks and separate branches of a plan always
agree, and they only decide where work is split: every row is kept and every result is exact.

Cutting reads the input several times. The public functions therefore write it once to the shared
folder (``pin``) and read narrow columns back, unless told that the input is cheap to read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import pin

SHARD_ROWS = 100_000  # rows of a shard, about; the number of shards follows from a group's rows alone
PER_SHARD = 16


def _cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], shards: int | None, shard_rows: int) -> DataFrame:
    """One row per large group: its ordered cut points, one per ``shard_rows`` rows (at most ``shards``, where given)."""
    size = F.count(F.lit(1))
    want = F.ceil(size / F.lit(shard_rows)).cast("int")
    want = want if shards is None else F.least(F.lit(shards), want)
    large = df.groupBy(*keys).agg(size.alias("_n"), want.alias("_want")).where(F.col("_want") > 1)
    subset = (
        df.join(large, list(keys))
        .where(F.pmod(F.xxhash64(*keys, *order), F.col("_n")) < F.col("_want") * PER_SHARD)
        .select(*keys, "_want", F.struct(*order).alias("_k"))
    )
    ranked = subset.groupBy(*keys).agg(F.sort_array(F.collect_set("_k")).alias("_s"), F.first("_want").alias("_want"))
    step = F.greatest(F.lit(1), F.ceil(F.size("_s") / F.col("_want")).cast("int"))
    return ranked.select(*keys, F.filter("_s", lambda x, i: (i > 0) & (i % step == 0)).alias("_cuts"))


def _position(cuts: Column, key: Column) -> Column:
    """Number of cut points at or below ``key``: first among every n-th, then among the n that follow, n the root of their number."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(cuts))).cast("int"))
    heads = F.filter(cuts, lambda x, i: i % block == 0)
    skip = F.greatest(F.size(F.filter(heads, lambda x: x <= key)) - 1, F.lit(0)) * block
    inside = F.slice(cuts, skip + 1, block)
    return skip + F.size(F.filter(inside, lambda x: x <= key))


def with_shard(df: DataFrame, keys: Sequence[str], order: Sequence[str], shards: int | None = None,
               shard_rows: int | None = None) -> DataFrame:
    """Add ``_shard``: the ordered slice of its group that a row belongs to."""
    cuts = _cuts(df, keys, order, shards, shard_rows or SHARD_ROWS)
    at = F.when(F.col("_cuts").isNotNull(), _position(F.col("_cuts"), F.struct(*order))).otherwise(F.lit(0))
    return df.join(cuts, list(keys), "left").withColumn("_shard", at).drop("_cuts")


def with_offsets(sharded: DataFrame, keys: Sequence[str], measure: Column, name: str = "_before") -> DataFrame:
    """Add the total of ``measure`` over all earlier shards of the group, and the group total."""
    per = sharded.groupBy(*keys, "_shard").agg(measure.alias("_m"))
    across = Window.partitionBy(*keys).orderBy("_shard")  # one row per shard
    per = per.select(
        *keys, "_shard",
        F.coalesce(F.sum("_m").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name),
        F.sum("_m").over(Window.partitionBy(*keys)).alias("_total"),
    )
    return sharded.join(per, [*keys, "_shard"])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
                shards: int | None = None, write_once: bool = True) -> DataFrame:
    """Exact 1-based row number and group size (``_total``); ``order`` must be unique per group."""
    df = pin(df, "rows") if write_once else df
    sharded = with_offsets(with_shard(df, keys, order, shards), keys, F.count(F.lit(1)))
    local = Window.partitionBy(*keys, "_shard").orderBy(*order)
    return sharded.withColumn(name, F.col("_before") + F.row_number().over(local)).drop("_shard", "_before")


def distinct_counts(df: DataFrame, keys: Sequence[str], x: str, shards: int | None = None) -> DataFrame:
    """Per distinct value: ``cnt`` rows, ``below`` rows with a smaller value, ``_total`` rows.

    Counting before ordering folds any number of equal values into one row.
    """
    values = pin(df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("cnt")), "values")
    sharded = with_offsets(with_shard(values, keys, [x], shards), keys, F.sum("cnt"))
    local = Window.partitionBy(*keys, "_shard").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return sharded.withColumn(
        "below", F.col("_before") + F.coalesce(F.sum("cnt").over(local), F.lit(0))
    ).drop("_shard", "_before")


def percentile_rank(df: DataFrame, keys: Sequence[str], x: str, name: str, shards: int | None = None, write_once: bool = True) -> DataFrame:
    """W12. Average-tie rank divided by the number of values; NULL where ``x`` is NULL."""
    df = pin(df, "rank") if write_once else df
    ranks = distinct_counts(df, keys, x, shards).select(
        *keys, x, ((F.col("below") + (F.col("cnt") + 1) / 2) / F.col("_total")).alias(name)
    )
    return df.join(ranks, [*keys, x], "left")


def _grid(x: Column) -> Column:
    """Monotone bucket of a finite number: 256 buckets per power of two, mirrored below zero."""
    steps, shift = 256, 300_000  # the shift keeps exponents of the smallest numbers positive
    size = F.floor(F.log2(F.abs(x)) * steps) + shift
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, size).otherwise(-size)


def exact_quantiles(df: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float],
                    shards: int | None = None, write_once: bool = True) -> DataFrame:
    """Linear-interpolation quantiles per group: ``n`` and ``q`` (array in the order of ``probs``).

    Rows are first only counted on a fixed grid of values; then just the grid cells that hold a
    needed position are ordered. The grid bounds the rows per group of the running count.
    """
    keys = list(keys)
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias(x))
    rows = (pin(rows, "rows") if write_once else rows).withColumn("_b", _grid(F.col(x)))
    across = Window.partitionBy(*keys).orderBy("_b")
    per = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m")).select(
        *keys, "_b", "_m",
        F.coalesce(F.sum("_m").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_m").over(Window.partitionBy(*keys)).alias("_all"),
    )
    prob = F.array(*[F.lit(float(p)) for p in probs])
    wanted = per.withColumn("_p", F.explode(F.transform(prob, lambda p, i: F.struct(i.alias("i"), p.alias("p")))))
    pos = (F.col("_all") - 1) * F.col("_p.p")
    wanted = wanted.select(
        *keys, "_b", "_m", "_before", "_all", F.col("_p.i").alias("_i"), (pos - F.floor(pos)).alias("_w"),
        F.explode(F.array(F.struct(F.floor(pos).alias("at"), F.lit(0).alias("hi")),
                          F.struct(F.ceil(pos).alias("at"), F.lit(1).alias("hi")))).alias("_t"),
    ).where((F.col("_t.at") >= F.col("_before")) & (F.col("_t.at") < F.col("_before") + F.col("_m")))
    wanted = pin(wanted, "wanted")  # at most two rows per group and probability
    cells = wanted.select(*keys, "_b").distinct()
    values = distinct_counts(rows.join(cells, [*keys, "_b"], "left_semi"), [*keys, "_b"], x, shards)
    local = F.col("_t.at") - F.col("_before")
    hit = wanted.join(values, [*keys, "_b"]).where((local >= F.col("below")) & (local < F.col("below") + F.col("cnt")))
    points = hit.groupBy(*keys, "_i").agg(
        F.first("_all").alias("n"), F.first("_w").alias("_w"),
        F.max(F.when(F.col("_t.hi") == 0, F.col(x))).alias("_a"),
        F.max(F.when(F.col("_t.hi") == 1, F.col(x))).alias("_c"),
    ).withColumn("_v", F.col("_a") + (F.col("_c") - F.col("_a")) * F.col("_w"))
    return points.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("q"),
    )
