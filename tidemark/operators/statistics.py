"""Studies over trades and factors."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import finite_or_null
from tidemark.operators.asof import latest_bar
from tidemark.operators.ordered import _grid, exact_quantiles, row_numbers, with_shard
from tidemark.session import pin

RANK_BUCKETS = ((1, 2), (3, 5), (6, 10), (11, 20))
PRIME = 2147483647
# How often a row is drawn in one resample of as many rows: Poisson with mean 1, as cumulative shares of PRIME.
DRAWN = tuple(int(x * PRIME) for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
                                       0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402))


def _std(x, ddof: int) -> Column:
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    return F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x)


def t_value(mean: Column, std: Column, n: Column) -> Column:
    return F.when(std > 0, mean / (std / F.sqrt(n))).otherwise(F.lit(0.0))


def trade_statistics(trades: DataFrame, keys: Sequence[str] = (), ret: str = "ret", ddof: int = 0,
                     held: str | None = "held", reason: str | None = "reason") -> DataFrame:
    """A01. Count, mean, deviation, win rate, t, mean holding and exit reasons per key."""
    keys = list(keys)
    x, n = F.col(ret), F.count(F.col(ret))
    mean, std = F.avg(x), _std(x, ddof)
    stats = trades.groupBy(*keys).agg(
        n.alias("n"), (mean * 100).alias("mean_pct"), (std * 100).alias("std_pct"),
        (F.avg((x > 0).cast("double")) * 100).alias("win_rate"), t_value(mean, std, n).alias("t_val"),
        *([F.avg(F.col(held).cast("double")).alias("avg_held_days")] if held else []))
    if not reason:
        return stats
    # A few rows per key: one per exit reason.
    counts = trades.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "_c")))).alias("reasons"))
    if keys:
        return stats.join(counts, keys)
    one = F.lit(1).alias("_one")
    return stats.select("*", one).join(counts.select("*", one), "_one").drop("_one")


def annualised(stats: DataFrame, slots: Column, days: Column) -> DataFrame:
    """A14. Turnover per slot and year, and mean return times that turnover."""
    years = days / F.lit(365.25)
    turnover = F.try_divide(F.try_divide(F.col("n"), slots), years)
    return stats.withColumn("turnover_per_slot", turnover).withColumn("annualized_pct", F.col("mean_pct") * turnover)


def period_statistics(periods: DataFrame, keys: Sequence[str] = (), per_year: int = 4, ret: str = "net") -> DataFrame:
    """A15. Compound and annualised return of consecutive periods; NULL once wiped out."""
    x = F.col(ret)
    lost = F.max((x <= -1).cast("int"))
    out = periods.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_sd"), F.product(1 + x).alias("_prod"),
        F.sum((x > 0).cast("long")).alias("_w"), F.avg("n").alias("avg_holdings"), lost.alias("_lost"))
    comp = F.col("_prod") - 1
    return out.select(
        *keys, "n", (F.col("_m") * 100).alias("mean_pct"),
        F.when((F.col("n") > 1) & (F.col("_sd") > 0), F.col("_m") / (F.col("_sd") / F.sqrt("n"))).otherwise(0.0).alias("t_val"),
        (comp * 100).alias("compound_pct"),
        F.when(comp > -1, (F.pow(1 + comp, F.lit(float(per_year)) / F.col("n")) - 1) * 100).alias("annual_pct"),
        (F.col("_w") / F.col("n") * 100).alias("win_rate"), "avg_holdings")


def bucket_of(edges: Column, x: Column) -> Column:
    """First right-closed bucket whose upper edge reaches ``x``; the lowest edge is included."""
    return F.greatest(F.size(F.filter(edges, lambda e: e < x)) - 1, F.lit(0))


def quantile_buckets(df: DataFrame, keys: Sequence[str], metric: str, outcome: str, buckets: int = 10,
                     min_rows: int = 1000, accuracy: int | None = None) -> DataFrame:
    """A10. Equal-frequency buckets of ``metric`` with statistics of ``outcome``.

    Exact edges come from a distributed selection; rows then meet only the small edge table. The
    input is read several times: pin it when it is expensive. With ``accuracy`` the edges come from mergeable sketches in one
    pass; their ranks are off by at most n / accuracy rows.
    """
    rows = df.select(*keys, finite_or_null(F.col(metric)).alias("_x"), finite_or_null(F.col(outcome)).alias("_y")).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())
    probs = [i / buckets for i in range(buckets + 1)]
    if accuracy is None:
        found = exact_quantiles(rows, keys, "_x", probs, write_once=False)
    else:
        found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", probs, accuracy).alias("q"))
    edges = found.where(F.col("n") >= min_rows).select(*keys, F.array_distinct("q").alias("_edges"))
    edges = edges.where(F.size("_edges") > 1)
    placed = rows.join(edges, list(keys)).withColumn("bucket", bucket_of(F.col("_edges"), F.col("_x")))
    return placed.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("std"),
        F.min("_x").alias("lo"), F.max("_x").alias("hi"))


def monotonicity(buckets: DataFrame, keys: Sequence[str], min_buckets: int = 3) -> DataFrame:
    """A11. Correlation of bucket position and bucket mean, with the outer spread."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("bucket")).cast("double")
    out = buckets.withColumn("_i", position).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("buckets"),
        F.min_by("mean", "bucket").alias("first_mean"), F.max_by("mean", "bucket").alias("last_mean"),
        F.corr("_i", "mean").alias("mono"))
    enough = F.col("buckets") >= min_buckets
    return out.withColumn("spread", F.col("last_mean") - F.col("first_mean")).withColumn(
        "mono", F.when(enough, F.col("mono")))


def metric_panel(signals: DataFrame, forward: DataFrame, metrics: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """J19, C28. Long form (metric, horizon, x, y) of signals joined to forward returns."""
    joined = pin(signals.select("code", "d", *metrics).join(
        forward.select("code", "d", *[f"fwd_{h}" for h in horizons]), ["code", "d"]), "panel")
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(h).alias("horizon"), F.col(m).alias("x"), F.col(f"fwd_{h}").alias("y"))
        for m in metrics for h in horizons])
    return joined.select(F.explode(cells).alias("_c")).select("_c.*").where(
        F.col("x").isNotNull() & F.col("y").isNotNull())


PART_ROWS = 100_000  # cells of values with more rows are split into equal parts before single values are counted


def conditional_edges(long: DataFrame, outcomes: Sequence[str], probs: Sequence[float], accuracy: int | None = None) -> dict:
    """Linear-interpolation quantiles of ``x`` per ``metric`` among the rows that have an outcome, for all outcomes at once.

    Returns {(metric, outcome): (n, values in the order of ``probs``)}; ``long`` has metric, x (not null) and the outcome columns.
    One histogram over a fixed grid counts every outcome's rows per cell; its size depends on the grid alone. Of the cells
    that hold a wanted position, large ones are counted again in equal parts, and where a position is left in a part with
    several values these are counted one by one. Every pass reads what the one before left and adds up in partial sums.

    With ``accuracy`` the values come from mergeable sketches in one pass instead: their ranks are off by at most n / accuracy rows.
    """
    if accuracy is not None:
        rows = long.groupBy("metric").agg(*[F.struct(F.count(y), F.percentile_approx(F.when(F.col(y).isNotNull(), F.col("x")), list(probs), accuracy)).alias(y) for y in outcomes])
        return {(r["metric"], y): (r[y][0], list(r[y][1])) for r in rows.collect() for y in outcomes if r[y][0]}
    spark, kind = long.sparkSession, dict(long.dtypes)["metric"]
    counts = [F.count(y).alias(y) for y in outcomes]
    keys, rows = ["metric", "_cell"], long.withColumn("_cell", _grid(F.col("x")))
    found = rows.groupBy(*keys).agg(*counts, F.min("x").alias("_lo"), F.max("x").alias("_hi")).collect()
    targets, totals, value = [], {}, {}  # targets: (outcome, number of the probability, side, position in its cell) per cell
    by_metric: dict = {}
    for r in found:
        by_metric.setdefault(r["metric"], []).append(r)
    for metric, cells in by_metric.items():
        cells.sort(key=lambda r: r["_cell"])
        for y in outcomes:
            ends = list(accumulate(r[y] for r in cells))
            if not ends[-1]:
                continue
            totals[(metric, y)] = ends[-1]
            for i, p in enumerate(probs):
                place = (ends[-1] - 1) * float(p)
                for side, at in ((0, floor(place)), (1, ceil(place))):  # positions counted from 0; the quantile lies between the two
                    k = bisect_right(ends, at)
                    targets.append((cells[k], (metric, y, i, side), at - (ends[k] - cells[k][y])))

    def resolve(group: list[str], order: str, at_most: list) -> list:
        """Targets of the cells at hand, each with the row of its cell's finer count that holds it and the position left there."""
        table = spark.createDataFrame([(*[r[c] for c in group], *key[1:], at) for r, key, at in at_most], ", ".join(
            [*(f"{c} {dict(finer.dtypes)[c]}" for c in group), "y string, i int, side int, at long"]))
        window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        before = finer.select("*", *[F.coalesce(F.sum(y).over(window), F.lit(0)).alias(f"_b_{y}") for y in outcomes])
        pick = lambda stem: F.coalesce(*[F.when(F.col("y") == y, F.col(f"{stem}{y}")) for y in outcomes])
        held = before.join(F.broadcast(table), group).withColumn("at", F.col("at") - pick("_b_"))  # one row per wanted position
        return held.where((F.col("at") >= 0) & (F.col("at") < pick(""))).collect()

    def settle(rows_of_targets: list) -> list:
        left = []
        for r, key, at in rows_of_targets:
            if r["_lo"] == r["_hi"]:
                value[key] = r["_lo"]
            else:
                left.append((r, key, at))
        return left

    targets = settle(targets)
    if any(max(r[y] for y in outcomes) > PART_ROWS for r, _, _ in targets):
        cells = {tuple(r[c] for c in keys): (r["_lo"], r["_hi"], 1 + max(r[y] for y in outcomes) // PART_ROWS) for r, _, _ in targets}
        table = spark.createDataFrame([(*k, *v) for k, v in sorted(cells.items())], f"metric {kind}, _cell long, _from double, _to double, _parts long")
        rows = rows.join(F.broadcast(table), keys)  # one row per cell that holds a wanted position
        rows = rows.withColumn("_part", F.floor((F.col("x") - F.col("_from")) / (F.col("_to") - F.col("_from")) * F.col("_parts")))
        finer = rows.groupBy(*keys, "_part").agg(*counts, F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        targets = settle([(r, (r["metric"], r["y"], r["i"], r["side"]), r["at"]) for r in resolve(keys, "_part", targets)])
        keys = [*keys, "_part"]
        rows = rows.drop("_from", "_to", "_parts")
    if targets:
        table = spark.createDataFrame(sorted({tuple(r[c] for c in keys) for r, _, _ in targets}), ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys))
        finer = rows.join(F.broadcast(table), keys).groupBy(*keys, "x").agg(*counts)
        value.update({(r["metric"], r["y"], r["i"], r["side"]): r["x"] for r in resolve(keys, "x", targets)})
    out = {}
    for (metric, y), n in totals.items():
        points = []
        for i, p in enumerate(probs):
            low, high, place = value[(metric, y, i, 0)], value[(metric, y, i, 1)], (n - 1) * float(p)
            points.append(low + (high - low) * (place - floor(place)))
        out[(metric, y)] = (n, points)
    return out


def factor_deciles(signals: DataFrame, forward: DataFrame, metrics: Sequence[str], horizons: Sequence[int],
                   buckets: int = 10, min_rows: int = 3000, accuracy: int | None = None) -> DataFrame:
    """C28, A10. Deciles of every metric against every horizon: rows are multiplied by the metrics, never by the horizons.

    Edges come from ``conditional_edges`` (by sketches with ``accuracy``). The edges of all horizons cut a metric into a few
    stretches; rows add up per stretch, and a horizon's buckets are merged from the stretches. The joined panel is written once.
    """
    outcomes = [f"fwd_{h}" for h in horizons]
    joined = pin(signals.select("code", "d", *[finite_or_null(F.col(m).cast("double")).alias(m) for m in metrics]).join(
        forward.select("code", "d", *[finite_or_null(F.col(y).cast("double")).alias(y) for y in outcomes]), ["code", "d"]).drop("code", "d"), "panel")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])
    long = joined.select(F.explode(cells).alias("_c"), *outcomes).select("_c.*", *outcomes).where(F.col("x").isNotNull())
    found = conditional_edges(long, outcomes, [i / buckets for i in range(buckets + 1)], accuracy)
    edges = {k: sorted(set(values)) for k, (n, values) in found.items() if n >= min_rows and len(set(values)) > 1}

    lines = {m: sorted({e for y in outcomes for e in edges.get((m, y), ())}) for m in metrics}

    def below(x: Column, line: list, first: int = 0) -> Column:
        """How many of the sorted values are smaller than ``x``, by halving."""
        if not line:
            return F.lit(first)
        half = len(line) // 2
        return F.when(x > line[half], below(x, line[half + 1 :], first + half + 1)).otherwise(below(x, line[:half], first))

    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x"), below(F.col(m), lines[m]).alias("_k")) for m in metrics])
    placed = joined.select(F.explode(cells).alias("_c"), *outcomes).select("_c.*", *outcomes).where(F.col("x").isNotNull())
    seen = lambda y: F.when(F.col(y).isNotNull(), F.col("x"))
    # Sums around a common centre: as safe as running deviations, and plain sums merge in generated code.
    centre = joined.agg(*[F.coalesce(F.avg(y), F.lit(0.0)).alias(y) for y in outcomes]).first()
    off = {y: F.col(y) - F.lit(centre[y]) for y in outcomes}
    parts = placed.groupBy("metric", "_k").agg(*[a for y in outcomes for a in (
        F.count(y).alias(f"n_{y}"), F.sum(off[y]).alias(f"s_{y}"), F.sum(off[y] * off[y]).alias(f"q_{y}"), F.min(seen(y)).alias(f"lo_{y}"), F.max(seen(y)).alias(f"hi_{y}"))])
    # All edges of a metric cut its values into a few stretches; each lies in one bucket of every horizon.
    table = [(m, k, h, max(bisect_left(edges[(m, y)], line[k]) if k < len(line) else len(edges[(m, y)]), 1) - 1)
             for m, line in lines.items() for h, y in zip(horizons, outcomes) if (m, y) in edges for k in range(len(line) + 1)]
    told = long.sparkSession.createDataFrame(table, "metric string, _k int, horizon int, bucket int")
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"n_{y}").alias("n"), F.col(f"s_{y}").alias("s"), F.col(f"q_{y}").alias("q"),
                              F.lit(centre[y]).alias("c"), F.col(f"lo_{y}").alias("lo"), F.col(f"hi_{y}").alias("hi")) for h, y in zip(horizons, outcomes)])
    few = parts.select("metric", "_k", F.explode(each).alias("_e")).select("metric", "_k", "_e.*").where(F.col("n") > 0).join(told, ["metric", "_k", "horizon"])
    n, total = F.sum("n"), F.sum("s")
    return few.groupBy("metric", "horizon", "bucket").agg(
        n.alias("n"), (F.first("c") + total / n).alias("mean"), F.when(n > 1, F.sqrt(F.greatest(F.sum("q") - total * total / n, F.lit(0.0)) / (n - 1))).alias("std"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def horizon_baseline(forward: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """A13. Mean, median and count of forward returns per horizon."""
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("y")) for h in horizons])
    base = pin(forward.select(*[f"fwd_{h}" for h in horizons]), "forward")
    long = base.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("y").isNotNull())
    middle = exact_quantiles(long, ["horizon"], "y", [0.5], write_once=False).select("horizon", F.element_at("q", 1).alias("median"))
    return long.groupBy("horizon").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).join(middle, "horizon")


def rank_bucket_statistics(trades: DataFrame, min_rows: int = 30) -> DataFrame:
    """A12. Statistics of fixed rank ranges, sample deviation, small ranges dropped."""
    label = None
    for lo, hi in RANK_BUCKETS:
        hit = F.col("rank").between(lo, hi)
        label = F.when(hit, f"{lo}-{hi}") if label is None else label.when(hit, f"{lo}-{hi}")
    tagged = trades.withColumn("bucket", label).where(F.col("bucket").isNotNull())
    return trade_statistics(tagged, ["bucket"], ddof=1, held=None, reason=None).where(F.col("n") >= min_rows)


def quarterly(trades: DataFrame, keys: Sequence[str] = (), date: str = "d", ret: str = "ret") -> DataFrame:
    """A07. Mean and count per quarter, and the bar share against the largest absolute mean."""
    q = F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    out = trades.groupBy(*keys, q.alias("quarter")).agg(
        (F.avg(ret) * 100).alias("avg_pct"), F.count(F.lit(1)).alias("n"))
    peak = F.max(F.abs("avg_pct")).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return out.withColumn("bar_pct", F.when(peak > 0, F.abs("avg_pct") / peak * 100).otherwise(0.0))


def stability(trades: DataFrame, split, keys: Sequence[str] = (), date: str = "d", ret: str = "ret") -> DataFrame:
    """C29. Quarters and how many of them gained, and the mean before and from the ``split`` day on."""
    day = F.lit(split).cast("date")
    quarters = trades.groupBy(*keys, F.year(date).alias("_y"), F.quarter(date).alias("_q")).agg(
        F.sum(ret).alias("_s"), F.count(ret).alias("_n"),
        F.sum(F.when(F.col(date) < day, F.col(ret))).alias("_a"), F.count(F.when(F.col(date) < day, F.col(ret))).alias("_an"))
    later, late_n = F.sum("_s") - F.coalesce(F.sum("_a"), F.lit(0.0)), F.sum("_n") - F.sum("_an")
    return quarters.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("quarters"), F.count(F.when(F.col("_s") > 0, 1)).alias("positive_quarters"),
        (F.try_divide(F.sum("_a"), F.sum("_an")) * 100).alias("train_pct"), (F.try_divide(later, late_n) * 100).alias("valid_pct"))


def index_benchmark(closes: DataFrame, windows: DataFrame) -> DataFrame:
    """A16. Total and monthly return of a monthly index between the months of ``start`` and ``end``.

    ``closes`` (d, c) is one row per day, ``windows`` (start, end) a short list of ranges.
    """
    index = closes.groupBy(F.trunc("d", "month").alias("m")).agg(F.max_by("c", "d").alias("c")).select(
        F.lit("index").alias("code"), F.col("m").alias("d"), "c")
    df = windows.select(F.lit("index").alias("code"), "*", F.trunc("start", "month").alias("_s"), F.trunc("end", "month").alias("_t"))
    df = latest_bar(latest_bar(df, index, "_s", ("c",), "_a_"), index, "_t", ("c",), "_b_")
    months = (F.year("end") - F.year("start")) * 12 + F.month("end") - F.month("start")
    total = F.col("_b_c") / F.col("_a_c") - 1
    return df.select(
        "start", "end", (total * 100).alias("total_pct"),
        F.when(months > 0, (F.pow(1 + total, 1 / months) - 1) * 100).otherwise(0.0).alias("monthly_pct")
    ).where(F.col("total_pct").isNotNull())


def best_variant(stats: DataFrame, keys: Sequence[str], variant: str, score: str, min_n: int, default) -> DataFrame:
    """A19. Variant with the best score among those with enough observations, else the default."""
    # Rounded, so that variants with the same trades tie whatever the order of their sums.
    usable = F.when(F.col("n") >= min_n, F.struct(F.round(F.col(score), 10).alias("_score"), F.col(variant)))
    return stats.groupBy(*keys).agg(F.coalesce(F.max(usable)[variant], F.lit(default)).alias(variant))


def compound_drawdown(trades: DataFrame, keys: Sequence[str], order: Sequence[str], ret: str = "ret", write_once: bool = True) -> DataFrame:
    """W14, W23. Maximum drawdown of the compounded curve in trade order, per key.

    A scan over ordered shards: each shard yields its growth, running peak and inner drawdown, and
    the shards (a bounded number per key) are combined in order. Everything is in log space; a
    return of -1 or less wipes the curve out.
    """
    keys = list(keys)
    log = F.when(F.col(ret) > -1, F.log1p(F.col(ret))).otherwise(F.lit(float("-inf")))
    rows = trades.select(*keys, *order, log.alias("_g"))
    rows = with_shard(pin(rows, "curve") if write_once else rows, keys, order)
    local = Window.partitionBy(*keys, "_shard").orderBy(*order)
    up = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.sum("_g").over(up))
    rows = rows.withColumn("_peak", F.max("_cum").over(up))
    per = rows.groupBy(*keys, "_shard").agg(
        F.sum("_g").alias("_t"), F.max("_cum").alias("_hi"), F.min("_cum").alias("_lo"),
        F.min(F.when(F.col("_cum") == float("-inf"), float("-inf")).otherwise(F.col("_cum") - F.col("_peak"))).alias("_dd"))
    across = Window.partitionBy(*keys).orderBy("_shard")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))
    per = per.withColumn("_prev", F.max(F.col("_base") + F.col("_hi")).over(before))
    worst = F.least(F.col("_dd"), F.when(F.col("_base") + F.col("_lo") == float("-inf"), float("-inf"))
                    .otherwise(F.col("_base") + F.col("_lo") - F.col("_prev")))
    return per.groupBy(*keys).agg((F.exp(F.least(F.min(worst), F.lit(0.0))) - 1).alias("mdd"))


def sum_curve(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """W15. Simple-sum curve in points over (keys, exit_d, n, ret_sum): one row per day already."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = part.orderBy("exit_d").rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumn("day_pct", F.col("ret_sum") * 100)
    out = out.withColumn("cum_pct", F.sum("day_pct").over(upto))
    out = out.withColumn("peak_pct", F.greatest(F.max("cum_pct").over(upto), F.lit(0.0)))
    return out.withColumn("max_dd", F.least(F.min(F.col("cum_pct") - F.col("peak_pct")).over(part), F.lit(0.0)))


def halves(trades: DataFrame, keys: Sequence[str], order: Sequence[str], write_once: bool = True) -> DataFrame:
    """A21. Mark each trade as first or second half; the first half has floor(n / 2) trades."""
    numbered = row_numbers(trades, keys, order, "_rn", write_once=write_once)
    first = F.col("_rn") <= F.floor(F.col("_total") / 2)
    return numbered.withColumn("half", F.when(first, 1).otherwise(2)).drop("_rn", "_total")


def split_date(trades: DataFrame, keys: Sequence[str], order: Sequence[str], date: str = "entry_d") -> DataFrame:
    """A21. Date of the middle trade, at position floor(n / 2) counting from 0."""
    numbered = row_numbers(trades, keys, order, "_rn")
    return numbered.where(F.col("_rn") == F.floor(F.col("_total") / 2) + 1).select(*keys, F.col(date).alias("split_date"))


def draw_number(row: Column, iteration: Column, seed: int) -> Column:
    """A pseudo-random whole number below PRIME for each (row number, iteration), by 64-bit integer arithmetic alone."""
    x = (row % PRIME * 48271 + iteration * 69621 + seed) % PRIME
    y = (x * x + row % PRIME) % PRIME
    z = (y * 16807 + iteration) % PRIME
    return (z * z + x) % PRIME


def bootstrap_means(trades: DataFrame, order: Sequence[str], ret: str = "ret", iterations: int = 1000, seed: int = 7,
                    keys: Sequence[str] = (), write_once: bool = True) -> DataFrame:
    """C16. Mean of a resample with replacement, per key and iteration.

    How often a row is drawn depends on its number, the iteration and the seed alone, so rows are weighted where they
    are and only sums move; a resample has as many draws as rows on average.
    """
    by = list(keys) or ["_g"]
    rows = trades if keys else trades.withColumn("_g", F.lit(0))
    rows = row_numbers(rows.select(*by, *order, F.col(ret).alias("_y")), by, order, "_rn", write_once=write_once)
    drawn = rows.select(*by, "_y", "_rn", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    u = draw_number(F.col("_rn").cast("long"), F.col("iteration").cast("long"), seed)
    times = sum(((F.col("_u") >= t).cast("long") for t in DRAWN[1:]), (F.col("_u") >= DRAWN[0]).cast("long"))
    drawn = drawn.withColumn("_u", u).withColumn("_times", times)
    out = drawn.groupBy(*by, "iteration").agg(F.try_divide(F.sum(F.col("_times") * F.col("_y")), F.sum("_times")).alias("mean"))
    return out if keys else out.drop("_g")


def bootstrap_positive_rate(trades: DataFrame, order: Sequence[str], ret: str = "ret", iterations: int = 1000,
                            seed: int = 7, keys: Sequence[str] = (), write_once: bool = True) -> DataFrame:
    """C16. Share of iterations with a positive mean; a mean below 1e-12 is 0, whatever the order of the sum."""
    means = bootstrap_means(trades, order, ret, iterations, seed, keys, write_once)
    return means.groupBy(*keys).agg(F.avg((F.round("mean", 12) > 0).cast("double")).alias("positive_rate"), F.count(F.lit(1)).alias("iterations"))


def subset_rows(rounds: int, size: Column, k: int, seed: int, spark) -> DataFrame:
    """(round, _rn): ``k`` different row numbers of 1..size per round, every subset as likely; all rows where there are fewer than k.

    Floyd's sampling: for j from size - k + 1 to size a number up to j is drawn, and j itself taken where that number is taken already.
    """
    pick = lambda j: (draw_number(j, F.col("round"), seed) * PRIME + draw_number(j, F.col("round") + 104729, seed)) % j + 1

    def step(taken, j):
        t = pick(j)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, t), j).otherwise(t)))

    start = F.array().cast("array<bigint>")
    rows = spark.range(rounds).select(F.col("id").alias("round"), size.alias("_n"))
    steps = F.when(F.col("_n") > 0, F.sequence(F.greatest(F.col("_n") - (k - 1), F.lit(1).cast("long")), F.col("_n"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("round", F.explode(F.aggregate(steps, start, step)).alias("_rn"))


def random_control(pool: DataFrame, order: Sequence[str], means: DataFrame, k: int = 50, rounds: int = 200, seed: int = 7,
                   ret: str = "ret", keys: Sequence[str] = ()) -> DataFrame:
    """C17. Share of random ``k``-trade means below the strategy's ``means(keys, mean)``, drawn from the universe pool.

    Each round draws ``k`` different row numbers, which meet the numbered pool by an equi-join: k x rounds rows move, whatever the
    size of the pool. The means of the rounds, one number each, are a scalar subquery of the comparison.
    """
    numbered = row_numbers(pool.select(F.lit(0).alias("_g"), *order, F.col(ret).alias("_y")), ["_g"], order, "_rn")
    rows = numbered.select(F.col("_rn").cast("long").alias("_rn"), "_y")
    size = rows.agg(F.count(F.lit(1))).scalar()
    drawn = subset_rows(rounds, size, k, seed, pool.sparkSession).join(rows, "_rn")
    tried = drawn.groupBy("round").agg(F.avg("_y").alias("_mean")).agg(F.collect_list("_mean")).scalar()
    out = means.select(*keys, "mean", tried.alias("_tried"))
    below = F.size(F.filter("_tried", lambda x: x < F.col("mean")))
    return out.select(*keys, F.try_divide(below, F.size("_tried")).alias("pct_rank"), F.size("_tried").cast("long").alias("rounds"))


def performance_report(sells: DataFrame, order: Sequence[str], keys: Sequence[str] = (), ret: str = "realized_pct",
                       min_rows: int = 5, resampled: int = 50, iterations: int = 200) -> DataFrame:
    """A22. Count, win rate, mean, deviation, t, half means, drawdown and, from ``resampled`` trades on, the bootstrap's share of
    positive means; keys below 5 trades drop out."""
    keys = list(keys)
    rows = pin(sells.where(F.col(ret).isNotNull()).select(*dict.fromkeys([*keys, *order, ret])), "sells")
    if not keys:
        rows, keys = rows.withColumn("_g", F.lit(0)), ["_g"]
    stats = trade_statistics(rows, keys, ret=ret, held=None, reason=None).where(F.col("n") >= min_rows)
    parts = halves(rows.select(*keys, *order, ret), keys, order, write_once=False).groupBy(*keys).agg(
        (F.avg(F.when(F.col("half") == 1, F.col(ret))) * 100).alias("first_half_pct"),
        (F.avg(F.when(F.col("half") == 2, F.col(ret))) * 100).alias("second_half_pct"))
    mdd = compound_drawdown(rows, keys, order, ret, write_once=False).withColumn("mdd_pct", F.col("mdd") * 100).drop("mdd")
    enough = rows.join(stats.where(F.col("n") >= resampled).select(*keys), keys, "left_semi")
    boot = bootstrap_positive_rate(enough, order, ret, iterations, keys=keys, write_once=False).select(*keys, (F.col("positive_rate") * 100).alias("bootstrap_positive_pct"))
    return stats.join(parts, keys).join(mdd, keys).join(boot, keys, "left").drop("_g")


def validate(trades_for, trades: DataFrame, pool: DataFrame, order: Sequence[str], start, end, iterations: int = 1000,
             rounds: int = 200, seed: int = 7, pass_at: float = 0.8, min_trades: int = 10, key: str = "rule") -> DataFrame:
    """C37. Split re-run, bootstrap and random control, one row per ``key`` of ``trades`` in one job.

    ``trades_for(spans)`` re-runs the rules on ``spans(key, half, from, to)``, both days included, and
    returns trades with key and half. A rule below ``min_trades`` has skipped = true and NULL results.
    """
    head = trades.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"))
    middle = split_date(trades, [key], order)
    judged = head.where(F.col("n") >= min_trades).select(key)
    spans = middle.join(judged, key).select(key, F.explode(F.array(
        F.struct(F.lit(1).alias("half"), F.lit(start).cast("date").alias("from"), F.col("split_date").alias("to")),
        F.struct(F.lit(2).alias("half"), F.col("split_date").alias("from"), F.lit(end).cast("date").alias("to")))).alias("s")).select(key, "s.*")
    first, second = F.col("half") == 1, F.col("half") == 2
    means = trades_for(spans).groupBy(key).agg(
        F.count(F.when(first, 1)).alias("t1_n"), F.count(F.when(second, 1)).alias("t2_n"),
        (F.avg(F.when(first, F.col("ret"))) * 100).alias("t1_mean_pct"), (F.avg(F.when(second, F.col("ret"))) * 100).alias("t2_mean_pct"))
    boot = bootstrap_positive_rate(trades.join(judged, key, "left_semi"), order, iterations=iterations, seed=seed, keys=[key]).drop("iterations")
    control = random_control(pool, [c for c in order if c != key], head.join(judged, key, "left_semi"), rounds=rounds, seed=seed, keys=[key]).drop("rounds")
    out = head.join(middle, key).join(judged.withColumn("_judged", F.lit(True)), key, "left").join(means, key, "left").join(boot, key, "left").join(control, key, "left")
    return out.select(
        key, "n", F.col("_judged").isNull().alias("skipped"), F.when(F.col("_judged"), F.col("split_date")).alias("split_date"), "t1_n", "t2_n", "t1_mean_pct", "t2_mean_pct",
        (F.col("positive_rate") * 100).alias("bootstrap_positive_pct"), (F.col("positive_rate") >= pass_at).alias("bootstrap_pass"),
        (F.col("pct_rank") * 100).alias("random_pct_rank"), (F.col("pct_rank") >= pass_at).alias("control_pass"))
