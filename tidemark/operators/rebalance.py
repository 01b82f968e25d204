"""Rebalance periods, walk-forward selection, sweeps and delta orders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.costs import BUY_COST, SELL_COST, blended_entry, buy_fill, realized, sell_fill
from tidemark.operators.asof import latest_bar
from tidemark.operators.filters import valid_price
from tidemark.operators.statistics import best_variant, period_statistics, trade_statistics


def set_changes(targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """U02. Per target row: whether the code was in the previous set and is in the next one."""
    keys = list(keys)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    days = targets.select(*keys, "d").distinct()
    order = part.orderBy("d")
    days = days.select(*keys, "d", F.lag("d").over(order).alias("prev_d"), F.lead("d").over(order).alias("next_d"))
    by_code = Window.partitionBy(*keys, "code").orderBy("d")
    return targets.join(days, [*keys, "d"]).select(
        "*",
        F.coalesce(F.lag("d").over(by_code) == F.col("prev_d"), F.lit(False)).alias("kept_from_prev"),
        F.coalesce(F.lead("d").over(by_code) == F.col("next_d"), F.lit(False)).alias("kept_to_next"))


def rebalance_periods(targets: DataFrame, days: DataFrame, bars: DataFrame, keys: Sequence[str] = (), end=None) -> DataFrame:
    """C13. Equal-weight return between fills with costs on the turned-over share only.

    ``targets`` (keys, d, code); ``days`` (d, next_d) gives the fill day. One period per rebalance
    that has targets, plus the final mark at the last close up to ``end``: a date for all keys, or
    the name of a column of ``targets`` that is constant per key.
    """
    own_end = end if end is not None and end in targets.columns else None
    keys = list(keys)
    fills = days.select("d", F.col("next_d").alias("fill_d")).where(F.col("fill_d").isNotNull())
    opens = bars.where(valid_price(F.col("o"))).select("code", F.col("d").alias("fill_d"), F.col("o").alias("mark"))
    held = targets.join(fills, "d").join(opens, ["code", "fill_d"])
    held = set_changes(held, keys)
    next_fill = fills.select(F.col("d").alias("next_d"), F.col("fill_d").alias("next_fill"))
    next_open = opens.select("code", F.col("fill_d").alias("next_fill"), F.col("mark").alias("next_open"))
    held = held.join(next_fill, "next_d", "left").join(next_open, ["code", "next_fill"], "left")
    closes = bars.where(valid_price(F.col("c"))).select("code", F.col("d").alias("_last"), F.col("c").alias("last_close"))
    if own_end:
        market = bars.select(F.lit("market").alias("code"), "d").distinct()
        ends = held.select(F.lit("market").alias("code"), own_end).distinct()
        last = latest_bar(ends, market, own_end, (), "_last_").select(own_end, F.col("_last_d").alias("_last"))
        held = held.join(last, own_end)
    else:
        inside = bars if end is None else bars.where(F.col("d") <= F.lit(end).cast("date"))
        closes = closes.join(inside.agg(F.max("d").alias("_last")), "_last", "left_semi")
    on = ["code", "_last"] if own_end else ["code"]
    held = held.join(closes if own_end else closes.drop("_last"), on, "left")

    count = F.count(F.lit(1))
    per = held.groupBy(*keys, "d", "prev_d", "next_d").agg(
        F.count("next_open").alias("n_next"), F.avg(F.col("next_open") / F.col("mark") - 1).alias("gross_next"),
        F.count("last_close").alias("n_last"), (F.avg(F.col("last_close") / F.col("mark")) - 1).alias("gross_last"),
        (F.sum((~F.col("kept_to_next")).cast("int")) / count).alias("sold"),
        (F.sum((~F.col("kept_from_prev")).cast("int")) / count).alias("bought"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = part.orderBy("d")
    first = F.col("prev_d").isNull()
    sold = F.when(first, 0.0).otherwise(F.lag("sold").over(order))
    rows = per.select(
        *keys, "d", F.lit(0).alias("final"),
        F.when(first, F.lit(0).cast("long")).otherwise(F.lag("n_next").over(order)).alias("n"),
        F.when(first, 0.0).otherwise(F.coalesce(F.lag("gross_next").over(order), F.lit(0.0))).alias("gross"),
        (sold * F.lit(SELL_COST) + F.col("bought") * F.lit(BUY_COST)).alias("cost"))
    final = per.where(F.col("next_d").isNull() & (F.col("n_last") > 0)).select(
        *keys, "d", F.lit(1).alias("final"), F.col("n_last").alias("n"), F.col("gross_last").alias("gross"),
        F.lit(SELL_COST).alias("cost"))
    return rows.unionByName(final).withColumn("net", (1 + F.col("gross")) * (1 - F.col("cost")) - 1)


def market_pools(priced: DataFrame, eligible: DataFrame, cap_floor: float) -> DataFrame:
    """C13. The unranked pools: every code above the cap floor, and every eligible code."""
    everything = priced.where(F.col("market_cap") >= cap_floor).select(F.lit("all").alias("kind"), "d", "code")
    return everything.unionByName(eligible.select(F.lit("filtered").alias("kind"), "d", "code"))


def in_windows(candidates: DataFrame, windows: list[tuple[str, date, date, date, date]]) -> DataFrame:
    """Each candidate once per (window, phase) that its signal day falls into."""
    spans = []
    for name, train_from, train_to, test_from, test_to in windows:
        spans += [(name, "train", train_from, train_to), (name, "test", test_from, test_to)]
    table = candidates.sparkSession.createDataFrame(spans, "window string, phase string, span_start date, span_end date")
    # One row per year that a span touches, so that any number of spans is found through an equi-join.
    table = table.withColumn("_year", F.explode(F.sequence(F.year("span_start"), F.year("span_end"))))
    out = candidates.withColumn("_year", F.year("d")).join(table, "_year").where(F.col("d").between(F.col("span_start"), F.col("span_end")))
    return out.drop("_year", "span_start")


def walk_forward(trades: DataFrame, min_train: int, default: str, control: str | None = None) -> dict[str, DataFrame]:
    """C14, U03. Choose a variant on each training span, judge it on the following test span.

    ``trades`` has (variant, window, phase, ret, held, reason). Returns the statistics of every cell,
    the choice per window, and the pooled out-of-sample trades of the choice and of the control.
    """
    cells = trade_statistics(trades, ["window", "phase", "variant"])
    train = cells.where(F.col("phase") == "train")
    names = trades.select("window").distinct()
    chosen = names.join(best_variant(train, ["window"], "variant", "mean_pct", min_train, default), "window", "left").select(
        "window", F.coalesce("variant", F.lit(default)).alias("variant"))
    test = trades.where(F.col("phase") == "test")
    picked = test.join(chosen, ["window", "variant"], "left_semi").withColumn("arm", F.lit("selected"))
    fixed = test.where(F.col("variant") == (control or default)).withColumn("arm", F.lit("control"))
    pooled = picked.unionByName(fixed)
    return {"cells": cells, "chosen": chosen, "trades": pooled, "summary": trade_statistics(pooled, ["arm"])}


def walk_forward_periods(periods: DataFrame, min_train: int, default: str, control: str, per_year: int = 12) -> dict[str, DataFrame]:
    """C14 for rebalance periods: (variant, window, phase, d, n, net)."""
    cells = period_statistics(periods, ["window", "phase", "variant"], per_year)
    train = cells.where(F.col("phase") == "train")
    names = periods.select("window").distinct()
    chosen = names.join(best_variant(train, ["window"], "variant", "mean_pct", min_train, default), "window", "left").select(
        "window", F.coalesce("variant", F.lit(default)).alias("variant"))
    test = periods.where(F.col("phase") == "test")
    pooled = test.join(chosen, ["window", "variant"], "left_semi").withColumn("arm", F.lit("selected")).unionByName(
        test.where(F.col("variant") == control).withColumn("arm", F.lit("control")))
    return {"cells": cells, "chosen": chosen, "periods": pooled, "summary": period_statistics(pooled, ["arm"], per_year)}


def hypothesis_sweep(candidates: DataFrame, best: dict[str, int | None], keys: Sequence[str] = ("variant", "window")) -> DataFrame:
    """C15. Trades of every variant and window.

    A variant takes the ``best`` ranked entries of every day as independent trades; one with None takes every entry of
    its pool, but no code again before its last trade is closed.
    """
    from tidemark.operators.outcomes import non_overlapping

    limits = F.create_map(*[F.lit(x) for v, k in best.items() if k is not None for x in (v, k)]) if any(k is not None for k in best.values()) else None
    closed = candidates.where(F.col("entry_d").isNotNull() & F.col("exit_d").isNotNull())
    out = closed.where(F.col("rank") <= F.try_element_at(limits, F.col("variant"))) if limits is not None else closed.limit(0)
    free = [v for v, k in best.items() if k is None]
    if free:
        pool = candidates.where(F.col("variant").isin(free) & F.col("entry_d").isNotNull())
        # An entry that never closes keeps its code blocked, so it takes part in the fold.
        pool = pool.withColumn("exit_d", F.coalesce("exit_d", F.lit(date(9999, 12, 31))))
        out = out.unionByName(non_overlapping(pool, keys, inclusive=False).where(F.col("exit_d") < F.lit(date(9999, 12, 31))))
    return out


def rebalance_orders(targets: DataFrame, positions: DataFrame, prices: DataFrame, books: DataFrame) -> dict[str, DataFrame]:
    """C18. Delta orders towards equal slots, with the resulting positions and ledger rows.

    ``targets`` (mode, strategy, code, name); ``positions`` as stored; ``prices`` (code, px) of the
    fill; ``books`` (mode, strategy, equity, slots). Codes without a price are left alone.
    """
    key = ["mode", "strategy", "code"]
    want = targets.select(*key, F.col("name").alias("t_name"), F.lit(True).alias("_target"))
    have = positions.select(*key, F.col("name").alias("p_name"), F.col("qty").cast("double").alias("held"), "entry_px",
                            "entry_date", "stop_px", "max_hold_days")
    both = want.join(have, key, "full_outer").join(prices.where(valid_price(F.col("px"))), "code").join(books, ["mode", "strategy"])
    goal = F.when(F.col("_target"), F.floor(F.col("equity") / F.col("slots") / F.col("px")).cast("double")).otherwise(0.0)
    both = both.withColumn("goal", goal).where(~(F.coalesce("_target", F.lit(False)) & (F.col("goal") < 1)))
    held, delta = F.coalesce("held", F.lit(0.0)), F.col("delta")
    both = both.withColumn("delta", F.col("goal") - held).withColumn("name", F.coalesce("t_name", "p_name"))
    buy, sell = buy_fill(F.col("px")), sell_fill(F.col("px"))
    orders = both.where(delta != 0).select(
        *key, "name", F.when(delta > 0, "buy").otherwise("sell").alias("side"), F.abs(delta).alias("qty"),
        F.when(delta > 0, buy).otherwise(sell).alias("price"),
        (F.abs(delta) * F.when(delta > 0, buy).otherwise(sell)).alias("amount"),
        F.when(delta < 0, "rebalance").alias("exit_reason"),
        F.when(delta < 0, realized(sell, F.col("entry_px"))).alias("realized_pct"))
    updated = both.where(F.col("goal") > 0).select(
        *key, "name", F.col("goal").alias("qty"),
        F.when(delta > 0, blended_entry(held, F.coalesce("entry_px", F.lit(0.0)), delta, buy)).otherwise(F.col("entry_px")).alias("entry_px"),
        "entry_date", F.coalesce("stop_px", F.lit(0.0)).alias("stop_px"), F.coalesce("max_hold_days", F.lit(99999)).alias("max_hold_days"))
    untouched = positions.select(*key, "name", F.col("qty").cast("double").alias("qty"), "entry_px", "entry_date", "stop_px",
                                 "max_hold_days").join(both.select(*key), key, "left_anti")
    return {"orders": orders, "positions": updated.unionByName(untouched)}
