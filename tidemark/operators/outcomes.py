"""Candidates, exits, barrier outcomes and trade selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.costs import buy_fill, sell_fill
from tidemark.functions.heat import AVOID_AT, SELL_AT
from tidemark.operators.asof import held_bars
from tidemark.operators.calendar import market_calendar
from tidemark.operators.chains import free_chain
from tidemark.operators.filters import entry_gate, is_ordinary, rankable, turnover_mean, valid_price
from tidemark.operators.fundamentals import top_per_day
from tidemark.operators.windows import range_position, with_position_in_range, with_prior_range

MAX_HOLD = 20
STOP_PCT = 0.07
POSITION_MAX = 0.30


def contrarian_candidates(signals: DataFrame, bars: DataFrame, turnover_floor: float,
                          rank_col: str = "institution_flow_ratio", held: DataFrame | None = None,
                          caps: DataFrame | None = None, cap_floor: float = 0.0, avoid: float = AVOID_AT,
                          position_max: float = POSITION_MAX, n: int = 251, min_rows: int = 1, k: int = 50) -> DataFrame:
    """C03 (J03, F04, F05, W04, L01). Candidates of every day, lowest rank value first.

    All filters run before the top-k cut, so no part of the universe is out of reach.
    """
    priced = with_prior_range(bars, n).select(
        "code", "d", F.col("c").alias("close"), turnover_mean().alias("_turnover"), range_position(n, min_rows).alias("pos52w"))
    out = signals.where(entry_gate(avoid) & rankable(F.col(rank_col))).join(priced, ["code", "d"]).where(
        is_ordinary(F.col("code")) & (F.col("_turnover") >= turnover_floor) & (F.col("pos52w") <= position_max))
    if caps is not None:
        out = out.join(caps.where(F.col("market_cap") >= cap_floor).select("code", "d"), ["code", "d"], "left_semi")
    if held is not None:
        on = [c for c in ("code", "d") if c in held.columns]  # with a day, what was held on that day
        out = out.join(held.select(*on), on, "left_anti")
    out = out.select("code", "d", "close", "heat_score", F.col(rank_col).alias("rank_value"), "pos52w")
    return top_per_day(out, [F.col("rank_value"), F.col("code")], k)


def exits(positions: DataFrame, bars: DataFrame, d, signals: DataFrame | None = None, sell: float = SELL_AT,
          min_hold: int = 0) -> DataFrame:
    """C04 (J04, J05). Positions to close on ``d``: stop, then expiry, then heat when signals are given."""
    day = F.lit(d).cast("date")
    today = bars.where(F.col("d") == day).select("code", F.col("c").alias("close"))
    held = held_bars(positions.withColumn("_until", day), bars, "entry_date", "_until").drop("_until").join(today, "code")
    if signals is not None:
        now = signals.where(F.col("d") == day).select("code", "heat_score", "signal")
        held = held.join(now, "code", "left")
    else:
        held = held.withColumn("heat_score", F.lit(None).cast("double")).withColumn("signal", F.lit(None).cast("string"))
    held = held.withColumn("heat_score", F.coalesce("heat_score", F.lit(0.0))).withColumn(
        "signal", F.coalesce("signal", F.lit("neutral")))
    expired = (F.col("held_days") >= F.col("max_hold_days")) & (F.col("held_days") >= min_hold)
    reason = F.when(F.col("close") <= F.col("stop_px"), "stop").when(expired, "expiry")
    if signals is not None:
        reason = reason.when(F.col("heat_score") >= sell, "heat_signal")
    return held.withColumn("reason", reason).where(F.col("reason").isNotNull())


def _outcomes(bars: DataFrame, entries: DataFrame | None, max_hold: int = MAX_HOLD, stop_pct: float = STOP_PCT, stop_on: str = "low",
              monitor_from: int = 1, count: str = "code_bars", min_hold: int = 0, expiry_first: bool = False,
              keep_open: bool = False) -> DataFrame:
    """First hits of ``entries`` (all bars where None); see ``outcome_table`` for the rules.

    Where every bar is an entry, each carries its path through one window. For given entries no other bar has a path: the judged
    bars of a code are numbered and stored in blocks one bar longer than the holding period, each with the block after it.
    Every path lies in one such pair, so a bar is stored twice whatever the holding period, and an entry finds its path by one equi-join.
    """
    if stop_on not in ("low", "close"):
        raise ValueError(f"unknown stop_on: {stop_on}")
    if count not in ("code_bars", "market_days"):
        raise ValueError(f"unknown count: {count}")
    hold = max(max_hold, min_hold)
    size = hold + 1
    line = Window.partitionBy("code").orderBy("d")
    gaps = "judged" in bars.columns
    level = F.col("l") if stop_on == "low" else F.col("c")
    flag = F.coalesce("exit_flag", F.lit(False)) if "exit_flag" in bars.columns else F.lit(False)
    b = bars.join(market_calendar(bars).select("d", F.col("day_no").alias("pos")), "d") if count == "market_days" else bars
    seq = F.row_number().over(line)
    b = b.select(
        "code", "d", (F.col("pos") if count == "market_days" else seq).alias("pos"), "o", "c", level.alias("lvl"), flag.alias("flag"),
        (F.col("judged") if gaps else F.lit(True)).alias("_judged"),
        # Judged bars before this one: the number of the first judged bar from here on.
        (F.coalesce(F.sum(F.col("judged").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if gaps else seq - 1).alias("_j"))

    bar = F.struct("_j", "pos", "d", "o", "c", "lvl", "flag")
    start = F.lead("_j", 1 + monitor_from).over(line) if gaps else F.col("_j") + 1 + monitor_from
    columns = ["code", "d", "pos", F.lead(F.struct("pos", "d", "o")).over(line).alias("_e")]
    if entries is None:
        seen = F.when(F.col("_judged"), bar)
        columns.append(F.collect_list(seen).over(line.rowsBetween(1 + monitor_from, 1 + hold)).alias("_path"))
        if gaps:  # beyond the path only the first judged bar matters: it is past expiry
            backwards = Window.partitionBy("code").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -(2 + hold))
            columns.append(F.last(seen, ignorenulls=True).over(backwards).alias("_tail"))
    else:
        columns.append(start.alias("_start"))
    e = b.select(*columns)
    ok = valid_price(F.col("_e.o"))
    if count == "market_days":
        ok = ok & (F.col("_e.pos") == F.col("pos") + 1)
    e = e.where(F.coalesce(ok, F.lit(False)))
    carried = [c for c in entries.columns if c not in ("code", "d")] if entries is not None else []
    if entries is None:
        path = F.array_append("_path", F.col("_tail")) if gaps else F.col("_path")
    else:
        judged = b.where("_judged") if gaps else b
        blocks = judged.groupBy("code", F.floor(F.col("_j") / size).alias("_block")).agg(F.sort_array(F.collect_list(bar)).alias("_bars"))
        following = F.lead("_bars").over(Window.partitionBy("code").orderBy("_block"))
        blocks = blocks.select("code", "_block", F.when(following.isNull(), F.col("_bars")).otherwise(F.concat("_bars", following)).alias("_bars"))
        e = entries.select("code", "d", F.struct(*(carried or [F.lit(1)])).alias("_entry")).join(e, ["code", "d"])
        e = e.withColumn("_block", F.floor(F.col("_start") / size)).join(blocks, ["code", "_block"], "left")
        path = F.slice("_bars", (F.col("_start") % size).cast("int") + 1, F.lit(size))

    entry = buy_fill(F.col("_e.o"))
    e = e.select("code", "d", *(["_entry"] if carried else []), F.col("_e.d").alias("entry_d"), F.col("_e.pos").alias("_first"), entry.alias("entry_px"),
                 (entry * F.lit(1 - stop_pct)).alias("_stop"), path.alias("_path"))

    def below(x):
        return F.lit(False) if stop_pct <= 0 else x <= F.col("_stop")

    hit = F.filter("_path", lambda x: x.isNotNull() & (below(x["lvl"]) | x["flag"] | (x["pos"] - F.col("_first") >= hold)))
    e = e.withColumn("_x", F.try_element_at(hit, F.lit(1)))
    x = F.col("_x")
    is_stop = below(x["lvl"])
    held = x["pos"] - F.col("_first")
    reason = F.when(x.isNull(), F.lit(None)).when(is_stop, "stop")
    if expiry_first:
        reason = reason.when(held >= hold, "expiry").otherwise("signal")
    else:
        reason = reason.when(x["flag"], "signal").otherwise("expiry")
    raw = F.when(is_stop, F.least(F.col("_stop"), x["o"])).otherwise(x["c"]) if stop_on == "low" else x["c"]
    out = e.select(
        "code", "d", *[F.col(f"_entry.{c}").alias(c) for c in carried], "entry_d", "entry_px", x["d"].alias("exit_d"), sell_fill(raw).alias("exit_px"),
        reason.alias("reason"), held.alias("held"),
    ).withColumn("ret", F.col("exit_px") / F.col("entry_px") - 1)
    return out if keep_open else out.where(F.col("exit_d").isNotNull())


def outcome_table(bars: DataFrame, **rules) -> DataFrame:
    """C10 for every bar as a signal day: what an entry at the next open would have returned.

    ``bars`` may carry ``exit_flag`` (close on this bar's signal) and ``judged`` (false on days on
    which exits are not looked at). Rules: ``max_hold``, ``stop_pct``, ``stop_on``, ``monitor_from``, ``count``, ``min_hold``,
    ``expiry_first``, ``keep_open``.
    """
    return _outcomes(bars, None, **rules)


def barrier_outcomes(bars: DataFrame, entries: DataFrame, **rules) -> DataFrame:
    """C10. Outcome of every entry (code, d, ...), by the rules of ``outcome_table``; entries that run out of bars are dropped.

    Paths are looked up for the entries alone, with all their columns; repeated entries are answered each.
    """
    return _outcomes(bars, entries, **rules)


def non_overlapping(trades: DataFrame, keys: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """C11. Per code, drop signals while the last accepted trade is open; one without exit stays open.

    A (keys, code) group takes one signal a day, the one with the smallest (exit_d, other columns): copies fold before they are
    shuffled. The walk over the days is ``free_chain``.
    """
    group = [*keys, "code"]
    rest = [c for c in trades.columns if c not in group and c not in ("d", "exit_d")]
    first = trades.groupBy(*group, "d").agg(F.min(F.struct("exit_d", *rest)).alias("_t"))
    rows = first.select(*group, "d", *[F.col(f"_t.{c}").alias(c) for c in ("exit_d", *rest)])
    return free_chain(rows, group, inclusive).select(*trades.columns)


def rank_study(signals: DataFrame, bars: DataFrame, metric: str, ascending: bool = True, k: int = 20,
               use_position: bool = True, min_rows: int = 60, **rules) -> DataFrame:
    """C29. Best ``k`` of every day as independent trades: (d, code, rank, ret, ...)."""
    out = signals.where(rankable(F.col(metric))).select("code", "d", metric)
    if use_position:
        low = with_position_in_range(bars, "pos52w", 252, min_rows).select("code", "d", "pos52w")
        out = out.join(low, ["code", "d"]).where(F.col("pos52w") <= POSITION_MAX)
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return barrier_outcomes(bars, top_per_day(out, [order, F.col("code")], k), **rules)
