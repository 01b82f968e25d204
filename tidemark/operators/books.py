"""Ledger, cash, equity and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.costs import mark_pct, unrealized
from tidemark.functions.text import has_key, name_list, non_empty
from tidemark.operators.asof import latest_bar, latest_close_on
from tidemark.operators.ordered import row_numbers
from tidemark.operators.statistics import quarterly, sum_curve

DEFAULT_CAPITAL = 10_000_000.0
BOOK = ["mode", "strategy"]


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """A02."""
    sold = "FILTER (WHERE side = 'sell')"
    return ledger.agg(
        F.expr(f"count(1) {sold}").alias("total_trades"),
        F.expr(f"round(avg(realized_pct) {sold} * 100, 2)").alias("avg_pct"),
        F.expr(f"round(stddev(realized_pct) {sold} * 100, 2)").alias("std_pct"),
        F.expr("count(1) FILTER (WHERE side = 'sell' AND realized_pct > 0)").alias("wins"),
        F.expr(f"min(realized_pct) {sold}").alias("max_loss"),
        F.expr(f"max(realized_pct) {sold}").alias("max_gain"))


def capital_settings(settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P21. Capital per strategy from ``CAPITAL_<strategy>`` keys, and the retired strategies."""
    capital = settings.where(F.col("key").startswith("CAPITAL_")).select(
        F.expr("substring(key, 9)").alias("strategy"), F.col("value").try_cast("double").alias("capital"))
    retired = settings.where(F.col("key") == "RETIRED_STRATEGIES").select(F.explode(name_list(F.col("value"))).alias("strategy"))
    return capital.where(F.col("capital").isNotNull()), retired.distinct()


def cash(ledger: DataFrame, d, settings: DataFrame | None = None, default_capital: float = DEFAULT_CAPITAL) -> DataFrame:
    """A03. Capital less buys plus sells up to ``d`` per (mode, strategy), without retired strategies."""
    flow = F.sum(F.when(F.col("side") == "buy", -F.col("amount")).otherwise(F.col("amount")))
    out = ledger.where(F.col("ts").cast("date") <= F.lit(d).cast("date")).groupBy(*BOOK).agg(flow.alias("_flow"))
    out, capital = _with_capital(out, settings, default_capital)
    return out.select(*BOOK, (capital + F.coalesce("_flow", F.lit(0.0))).alias("cash"))


def _with_capital(df: DataFrame, settings: DataFrame | None, default_capital: float):
    if settings is None:
        return df, F.lit(default_capital)
    capital, retired = capital_settings(settings)
    df = df.join(retired, "strategy", "left_anti").join(capital, "strategy", "left")
    return df, F.coalesce("capital", F.lit(default_capital))


def position_value(positions: DataFrame, prices: DataFrame, px: str = "last_c") -> DataFrame:
    """A04. Quantity x price per (mode, strategy); positions without a price do not count."""
    return positions.join(prices.select("code", F.col(px).alias("_px")), "code").groupBy(*BOOK).agg(
        F.sum(F.col("qty") * F.col("_px")).alias("positions_value"))


def equity_snapshot(ledger: DataFrame, positions: DataFrame, bars: DataFrame, d, settings: DataFrame | None = None,
                    default_capital: float = DEFAULT_CAPITAL) -> DataFrame:
    """C19 (A03, A04, J15). Cash, position value and total per (mode, strategy)."""
    held = position_value(positions, latest_close_on(bars, d))
    both = cash(ledger, d, settings, default_capital).join(held, BOOK, "full_outer")
    both, capital = _with_capital(both, settings, default_capital)
    value = F.coalesce("positions_value", F.lit(0.0))
    money = F.coalesce(F.col("cash"), capital)
    return both.select(F.lit(d).cast("date").alias("d"), *BOOK, money.alias("cash"), value.alias("positions_value"),
                       (money + value).alias("total_equity"))


def equity_by_day(equity: DataFrame) -> DataFrame:
    """A05, W16. Equity of a mode per day with day-over-day and since-first returns."""
    day = equity.groupBy("mode", "d").agg(*[F.sum(x).alias(x) for x in ("cash", "positions_value", "total_equity")])
    order = Window.partitionBy("mode").orderBy("d")  # one row per day
    total = F.col("total_equity")
    return day.select(
        "*", (F.try_divide(total, F.lag("total_equity").over(order)) - 1).alias("day_ret"),
        (F.try_divide(total, F.first("total_equity").over(order)) - 1).alias("cum_ret"))


def exit_reasons(trades: DataFrame, reason: str = "exit_reason", keys: tuple[str, ...] = ()) -> DataFrame:
    """A06. Counts per exit reason."""
    return trades.groupBy(*keys, F.coalesce(F.col(reason), F.lit("-")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def by_exit_day(trades: DataFrame, keys: tuple[str, ...] = (), ret: str = "ret_pct") -> DataFrame:
    """A08."""
    return trades.groupBy(*keys, "exit_d").agg(F.count(F.lit(1)).alias("n"), F.sum(ret).alias("ret_sum"))


def fold_tail(slices: DataFrame, keys: tuple[str, ...], label: str, value: str, limit: int = 7, other: str = "other") -> DataFrame:
    """L06. Largest ``limit`` slices per key; the rest become one slice.

    The kept slices come from a pruned top-k, the tail from totals, so no group is ordered whole.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(label))
    top = slices.select(*keys, label, value, F.row_number().over(order).alias("pos")).where(F.col("pos") <= limit)
    whole = slices.groupBy(*keys).agg(F.sum(value).alias("_all"), F.count(F.lit(1)).alias("_n"))
    kept = top.groupBy(*keys).agg(F.sum(value).alias("_kept"))
    tail = whole.join(kept, list(keys)).where(F.col("_n") > limit).select(
        *keys, F.concat(F.lit(f"{other} "), (F.col("_n") - limit).cast("string")).alias(label),
        (F.col("_all") - F.col("_kept")).alias(value), F.lit(limit + 1).alias("pos"))
    return top.unionByName(tail)


def allocation(positions: DataFrame, prices: DataFrame, cash_by_mode: DataFrame, limit: int = 7) -> DataFrame:
    """C27. Share of every holding and of cash per mode; negative cash counts as 0."""
    px = F.coalesce(F.col("last_c"), F.col("entry_px"))
    holdings = positions.join(prices.select("code", "last_c"), "code", "left").groupBy(
        "mode", F.coalesce("name", "code").alias("label"), "code", "strategy").agg(F.sum(F.col("qty") * px).alias("value"))
    holdings = holdings.select("mode", F.concat_ws(":", "label", "strategy").alias("label"), "value")
    slices = fold_tail(holdings, ("mode",), "label", "value", limit)
    money = cash_by_mode.groupBy("mode").agg(F.greatest(F.sum("cash"), F.lit(0.0)).alias("value")).select(
        "mode", F.lit("cash").alias("label"), "value", F.lit(limit + 2).alias("pos"))
    out = slices.unionByName(money)
    total = F.sum("value").over(Window.partitionBy("mode"))  # at most limit + 2 rows
    return out.withColumn("pct", F.round(F.col("value") / total * 100, 1))


def entry_records(ledger: DataFrame, key: str = "value_trap") -> DataFrame:
    """J14. Best buy record per (code, strategy, mode): non-empty, preferring ``key``, newest first."""
    buys = ledger.where((F.col("side") == "buy") & F.col("agents").isNotNull() & non_empty(F.col("agents")))
    best = F.struct(has_key(F.col("agents"), key).alias("has"), "ts", "id")
    return buys.groupBy("code", "strategy", "mode").agg(F.max_by("agents", best).alias("agents"))


def open_positions_view(positions: DataFrame, bars: DataFrame, ledger: DataFrame) -> DataFrame:
    """C34 (J13, J14, P16). Positions with their newest price, result so far and entry record."""
    newest = bars.groupBy("code").agg(F.max_by("c", "d").alias("current_px"))
    out = positions.join(newest, "code", "left").join(entry_records(ledger), ["code", "strategy", "mode"], "left")
    px, entry = F.col("current_px"), F.col("entry_px")
    return out.withColumn("pct", mark_pct(px, entry)).withColumn("unrealized", unrealized(px, entry, F.col("qty")))


def match_exits(ledger: DataFrame, sells: DataFrame) -> DataFrame:
    """C36. Stamp reason and realised return of the sells on the open buys of their position.

    Sells are taken in time; each goes to the newest open buy before it that no later sell needs more: buys and sells
    of a position are parentheses, and a sell closes the buy that it matches. A sell without an earlier open buy
    stamps nothing.
    """
    key = ["code", "mode", "strategy"]
    buys = ledger.where((F.col("side") == "buy") & F.col("exit_reason").isNull()).select(*key, "ts", "id", F.lit(1).alias("step"))
    sold = sells.select(*key, "ts", "id", F.lit(-1).alias("step"), "exit_reason", "realized_pct")
    order = Window.partitionBy(*key).orderBy("ts", "id")
    moves = buys.unionByName(sold, allowMissingColumns=True)
    run = moves.withColumn("sum", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A sell below every earlier level closes nothing; counting from the lowest level so far leaves it out.
    floor = F.least(F.lit(0), F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.least(F.lit(0), F.coalesce(F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.withColumn("level", F.col("sum") - before + F.when(F.col("step") < 0, 1).otherwise(0)).withColumn("lost", (F.col("step") < 0) & (floor < before))
    # A buy and the next move on its level belong together.
    same = Window.partitionBy(*key, "level").orderBy("ts", "id")
    pairs = run.where(~F.col("lost")).select(
        "id", "step", F.lead("step").over(same).alias("next"), F.lead("exit_reason").over(same).alias("_reason"), F.lead("realized_pct").over(same).alias("_pct"))
    stamps = pairs.where((F.col("step") == 1) & (F.col("next") == -1)).select("id", "_reason", "_pct")
    return ledger.join(stamps, "id", "left").withColumn(
        "exit_reason", F.coalesce("_reason", "exit_reason")).withColumn(
        "realized_pct", F.coalesce("_pct", "realized_pct")).drop("_reason", "_pct")


def newest_trades(ledger: DataFrame, limit: int = 200) -> DataFrame:
    """L03. Newest rows first; Spark keeps ``limit`` rows per task."""
    return ledger.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def run_trade_list(trades: DataFrame, worst: bool = False, limit: int = 100) -> DataFrame:
    """L03. Trades of a run, newest exit or largest loss first."""
    first = F.col("ret_pct").asc() if worst else F.col("exit_d").desc()
    return trades.orderBy(first, "code", "entry_d").limit(limit)


def downsample(points: DataFrame, keys: list[str], order: list[str], max_points: int = 200) -> DataFrame:
    """L05. Every step-th point and the last one."""
    numbered = row_numbers(points, keys, order, "_rn")
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / max_points))
    at = F.col("_rn") - 1
    return numbered.where((at % step == 0) | (F.col("_rn") == F.col("_total"))).drop("_rn", "_total")


def run_curve(trades: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """C35 (A08, W15). Simple-sum curve of every run, reduced to one row per exit day first."""
    return sum_curve(by_exit_day(trades, keys), keys)


def run_report(trades: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> dict[str, DataFrame]:
    """C35. Curve, exit reasons, quarters and trades of every run."""
    return {
        "curve": run_curve(trades, keys), "reasons": exit_reasons(trades, keys=keys),
        "quarters": quarterly(trades.withColumn("_ret", F.col("ret_pct") / 100), keys, "exit_d", "_ret"), "trades": trades}


def free_slots(positions: DataFrame, slots: int) -> DataFrame:
    """A25. Slot limit less open positions per (mode, strategy)."""
    return positions.groupBy(*BOOK).agg((F.lit(slots) - F.count(F.lit(1))).alias("free_slots"))


def same_sector(candidates: DataFrame, positions: DataFrame, prefix: int = 3) -> DataFrame:
    """A25. Held codes sharing the candidate's code prefix, per strategy."""
    p = F.substring("code", 1, prefix).alias("_p")
    held = positions.groupBy("strategy", p).agg(F.count(F.lit(1)).alias("same_sector"))
    return candidates.withColumn("_p", F.substring("code", 1, prefix)).join(held, ["strategy", "_p"], "left").drop("_p").fillna(
        0, ["same_sector"])


def filing_digest(disclosures: DataFrame, candidates: DataFrame, days: int = 90, newest: int = 15) -> DataFrame:
    """A24. Filing count and the newest filings of each (code, d) within the look-back.

    The filings of a code are numbered. The numbers reached by ``d`` and by the day ``days`` before give the count as a difference, and
    the newest filings as a run of numbers: these lie in one block of ``newest`` filings and the block before it, which one
    equi-join brings. No candidate is multiplied by days or filings.
    """
    line = Window.partitionBy("code").orderBy("d", "rcept_no", "report_nm")
    filed = disclosures.select("code", "d", "report_nm", F.row_number().over(line).alias("_no"))
    reached = filed.groupBy("code", "d").agg(F.max("_no").alias("no"))
    asked = candidates.select("code", "d").distinct().withColumn("_since", F.date_sub("d", days))
    asked = latest_bar(latest_bar(asked, reached, "d", ("no",), "_to_"), reached, "_since", ("no",), "_from_")
    last, first = F.coalesce("_to_no", F.lit(0)), F.coalesce("_from_no", F.lit(0))
    asked = asked.select("code", "d", last.alias("_last"), F.greatest(first, last - newest).alias("_first"), (last - first).cast("long").alias("filings"),
                         F.floor((last - 1) / newest).alias("_block"))
    blocks = filed.groupBy("code", F.floor((F.col("_no") - 1) / newest).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_no", "d", "report_nm")), asc=False).alias("_own"))
    before = F.lag("_own").over(Window.partitionBy("code").orderBy("_block"))
    blocks = blocks.select("code", "_block", F.when(before.isNull(), F.col("_own")).otherwise(F.concat("_own", before)).alias("_filed"))
    mine = F.filter("_filed", lambda x: (x["_no"] > F.col("_first")) & (x["_no"] <= F.col("_last")))
    found = asked.join(blocks, ["code", "_block"]).where(F.col("filings") > 0).select(
        "code", "d", "filings", F.transform(mine, lambda x: F.concat(x["d"].cast("string"), F.lit(" "), x["report_nm"])).alias("newest"))
    return candidates.join(found, ["code", "d"], "left").fillna(0, ["filings"])
