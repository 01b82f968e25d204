"""Registered queries: ledger, cash, equity, positions, trade reports and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import costs as K
from tidemark.functions import text as P
from tidemark.operators import books as B
from tidemark.operators import filters as FL
from tidemark.operators import rebalance as R
from tidemark.operators import statistics as ST
from tidemark.operators.asof import latest_close_on
from tidemark.operators.decisions import latest_per_key
from tidemark.plans.domain_sql import cte, num, r
from tidemark.plans.q_outcomes import BUYF, EXIT_DAY, SELLF, entries, outcome_select, outcome_sql, stats_sql  # noqa: F401
from tidemark.plans.q_signals import CAP, CAPS, rounded
from tidemark.plans.registry import query

CASH_DAY = "2000-06-30"
NOW = "2001-06-30"

# Settings derived from the regions: capital overrides, one bad value and one retired strategy.
cte("settings", "", """
SELECT 'CAPITAL_' || CASE r_regionkey WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' ELSE '5-LOW' END AS key,
  CASE WHEN r_regionkey = 2 THEN 'n/a' ELSE CAST(1000000 * (r_regionkey + 1) AS VARCHAR) END AS value FROM region WHERE r_regionkey < 4
UNION ALL SELECT 'RETIRED_STRATEGIES', '4-NOT SPECIFIED, none' FROM region WHERE r_regionkey = 4""")


def settings(t):
    k = F.col("r_regionkey")
    name = F.when(k == 0, "1-URGENT").when(k == 1, "2-HIGH").when(k == 2, "3-MEDIUM").otherwise("5-LOW")
    value = F.when(k == 2, "n/a").otherwise((F.lit(1000000) * (k + 1)).cast("string"))
    return t.raw("region").select(
        F.when(k < 4, F.concat(F.lit("CAPITAL_"), name)).otherwise(F.lit("RETIRED_STRATEGIES")).alias("key"),
        F.when(k < 4, value).otherwise(F.lit("4-NOT SPECIFIED, none")).alias("value"))


@query("a02_ledger_summary", f"""SELECT count(*) FILTER (WHERE side = 'sell') AS total_trades, round(avg(realized_pct) FILTER (WHERE side = 'sell') * 100, 2) + 0.0 AS avg_pct,
  round(stddev(realized_pct) FILTER (WHERE side = 'sell') * 100, 2) + 0.0 AS std_pct, count(*) FILTER (WHERE side = 'sell' AND realized_pct > 0) AS wins,
  min(realized_pct) FILTER (WHERE side = 'sell') AS max_loss, max(realized_pct) FILTER (WHERE side = 'sell') AS max_gain FROM ledger""", "ledger")
def a02(t):
    return B.ledger_summary(t.ledger)


cte("capital", "settings", "SELECT substr(key, 9) AS strategy, TRY_CAST(value AS DOUBLE) AS capital FROM settings WHERE key LIKE 'CAPITAL_%' AND TRY_CAST(value AS DOUBLE) IS NOT NULL")
cte("retired", "settings", "SELECT DISTINCT trim(x) AS strategy FROM (SELECT unnest(string_split(value, ',')) AS x FROM settings WHERE key = 'RETIRED_STRATEGIES') s WHERE trim(x) <> ''")
cte("cash", "ledger capital retired", f"""
SELECT mode, strategy, coalesce(capital, 10000000) + flow AS cash FROM (SELECT mode, strategy, sum(CASE WHEN side = 'buy' THEN -amount ELSE amount END) AS flow
FROM ledger WHERE CAST(ts AS DATE) <= DATE '{CASH_DAY}' GROUP BY mode, strategy) f LEFT JOIN capital USING (strategy) WHERE strategy NOT IN (SELECT strategy FROM retired)""")


@query("a03_cash", f"SELECT mode, strategy, {r('cash', 3)} AS cash FROM cash", "cash")
def a03(t):
    return rounded(B.cash(t.ledger, CASH_DAY, settings(t)), 3)


@query("p21_settings", f"SELECT strategy, capital FROM capital WHERE strategy NOT IN (SELECT strategy FROM retired)", "capital retired")
def p21(t):
    capital, retired = B.capital_settings(settings(t))
    return capital.join(retired, "strategy", "left_anti")


_LAST = f"(SELECT code, arg_max(c, d) AS last_c FROM bars WHERE d <= DATE '{CASH_DAY}' GROUP BY code)"
cte("value", "positions bars", f"SELECT mode, strategy, sum(qty * last_c) AS positions_value FROM positions JOIN {_LAST} b USING (code) GROUP BY mode, strategy")


@query("a04_position_value", f"SELECT mode, strategy, {r('positions_value', 4)} AS positions_value FROM value", "value")
def a04(t):
    return rounded(B.position_value(t.positions, latest_close_on(t.bars, CASH_DAY)), 4)


C19 = f"""SELECT DATE '{CASH_DAY}' AS d, mode, strategy, coalesce(cash, capital, 10000000) AS cash, coalesce(positions_value, 0) AS positions_value,
  coalesce(cash, capital, 10000000) + coalesce(positions_value, 0) AS total_equity
FROM cash FULL JOIN value USING (mode, strategy) LEFT JOIN capital USING (strategy) WHERE strategy NOT IN (SELECT strategy FROM retired)"""


def snapshot(t):
    return B.equity_snapshot(t.ledger, t.positions, t.bars, CASH_DAY, settings(t))


@query("c19_equity_snapshot", f"SELECT d, mode, strategy, {r('cash', 3)} AS cash, {r('positions_value', 3)} AS positions_value, {r('total_equity', 3)} AS total_equity FROM ({C19}) x", "cash value capital retired")
def c19(t):
    return rounded(snapshot(t), 3)


@query("j15_cash_and_holdings", "SELECT mode, strategy, c.cash IS NOT NULL AS has_cash, v.positions_value IS NOT NULL AS has_value FROM cash c FULL JOIN value v USING (mode, strategy)", "cash value")
def j15(t):
    both = B.cash(t.ledger, CASH_DAY, settings(t)).join(B.position_value(t.positions, latest_close_on(t.bars, CASH_DAY)), ["mode", "strategy"], "full_outer")
    return both.select("mode", "strategy", F.col("cash").isNotNull().alias("has_cash"), F.col("positions_value").isNotNull().alias("has_value"))


# Daily equity of the ledger as if every buy were worth its cost: enough to exercise the day tables.
cte("equity", "ledger", """
SELECT d, mode, strategy, 1e9 + sum(CASE WHEN side = 'buy' THEN -amount ELSE amount END) AS cash, sum(CASE WHEN side = 'buy' THEN amount ELSE 0 END) AS positions_value,
  1e9 + sum(CASE WHEN side = 'buy' THEN 0 ELSE amount END) AS total_equity FROM ledger GROUP BY d, mode, strategy""")


def equity(t):
    buy = F.col("side") == "buy"
    a = F.col("amount")
    return t.ledger.groupBy("d", "mode", "strategy").agg(
        (F.lit(1e9) + F.sum(F.when(buy, -a).otherwise(a))).alias("cash"), F.sum(F.when(buy, a).otherwise(0.0)).alias("positions_value"),
        (F.lit(1e9) + F.sum(F.when(buy, 0.0).otherwise(a))).alias("total_equity"))


@query("a05_equity_by_day", f"SELECT mode, d, {r('sum(cash)', 3)} AS cash, {r('sum(positions_value)', 3)} AS positions_value, {r('sum(total_equity)', 3)} AS total_equity FROM equity GROUP BY mode, d", "equity")
def a05(t):
    return rounded(B.equity_by_day(equity(t)).drop("day_ret", "cum_ret"), 3)


@query("w16_equity_returns", f"""SELECT mode, d, {r('e / lag(e) OVER w - 1', 9)} AS day_ret, {r('e / first_value(e) OVER w - 1', 9)} AS cum_ret
FROM (SELECT mode, d, sum(total_equity) AS e FROM equity GROUP BY mode, d) x WINDOW w AS (PARTITION BY mode ORDER BY d)""", "equity")
def w16(t):
    return rounded(B.equity_by_day(equity(t)).select("mode", "d", "day_ret", "cum_ret"), 9)


@query("a06_exit_reasons", "SELECT coalesce(exit_reason, '-') AS reason, count(*) AS n FROM ledger GROUP BY 1", "ledger")
def a06(t):
    return B.exit_reasons(t.ledger)


@query("a08_by_exit_day", f"SELECT run_id, exit_d, count(*) AS n, {r('sum(ret_pct)')} AS ret_sum FROM run_trades GROUP BY run_id, exit_d", "run_trades")
def a08(t):
    return rounded(B.by_exit_day(t.run_trades, ("run_id",)))


_CUM = "sum(p) OVER (PARTITION BY run_id ORDER BY exit_d)"
CURVE = f"""SELECT *, least(min(cum - peak) OVER (PARTITION BY run_id), 0.0) AS dd FROM (SELECT *, greatest(max(cum) OVER (PARTITION BY run_id ORDER BY exit_d), 0.0) AS peak FROM (
  SELECT run_id, exit_d, n, p, {_CUM} AS cum FROM (SELECT run_id, exit_d, count(*) AS n, sum(ret_pct) * 100 AS p FROM run_trades GROUP BY run_id, exit_d) a) b) c"""


@query("w15_sum_curve", f"SELECT run_id, max(exit_d) AS last_d, {r('arg_max(cum, exit_d)', 4)} AS cum_pct, {r('min(dd)', 4)} AS max_dd FROM ({CURVE}) z GROUP BY run_id", "run_trades")
def w15(t):
    out = B.run_curve(t.run_trades).groupBy("run_id").agg(
        F.max("exit_d").alias("last_d"), F.max_by("cum_pct", "exit_d").alias("cum_pct"), F.min("max_dd").alias("max_dd"))
    return rounded(out, 4)


@query("c35_run_report", f"SELECT run_id, exit_d, n, {r('p', 4)} AS day_pct, {r('cum', 4)} AS cum_pct, {r('dd', 4)} AS max_dd FROM ({CURVE}) z", "run_trades")
def c35(t):
    return rounded(B.run_report(t.run_trades)["curve"].select("run_id", "exit_d", "n", "day_pct", "cum_pct", "max_dd"), 4)


@query("c35_run_reasons", "SELECT run_id, exit_reason AS reason, count(*) AS n FROM run_trades GROUP BY 1, 2", "run_trades")
def c35_reasons(t):
    return B.run_report(t.run_trades)["reasons"]


@query("c35_run_quarters", f"""SELECT run_id, quarter, {r('m')} AS avg_pct, n, {r('CASE WHEN max(abs(m)) OVER (PARTITION BY run_id) > 0 THEN abs(m) / max(abs(m)) OVER (PARTITION BY run_id) * 100 ELSE 0 END')} AS bar_pct FROM (
  SELECT run_id, CAST(year(exit_d) AS VARCHAR) || 'Q' || CAST(quarter(exit_d) AS VARCHAR) AS quarter, count(*) AS n, avg(ret_pct / 100) * 100 AS m FROM run_trades GROUP BY 1, 2) x""", "run_trades")
def c35_quarters(t):
    return rounded(B.run_report(t.run_trades)["quarters"])


@query("l05_downsampled_curve", f"""SELECT run_id, exit_d, {r('cum', 4)} AS cum_pct FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY exit_d) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS t FROM ({CURVE}) z) y
WHERE i % greatest(1, t // 20) = 0 OR i = t - 1""", "run_trades")
def l05(t):
    curve = B.run_curve(t.run_trades).select("run_id", "exit_d", "cum_pct")
    return rounded(B.downsample(curve, ["run_id"], ["exit_d"], 20), 4)


@query("l03_newest_ledger_rows", "SELECT id, ts, code FROM ledger ORDER BY ts DESC, id DESC LIMIT 200", "ledger")
def l03(t):
    return B.newest_trades(t.ledger).select("id", "ts", "code")


@query("l03_worst_run_trades", f"SELECT code, entry_d, exit_d, {r('ret_pct')} AS ret_pct FROM run_trades ORDER BY run_trades.ret_pct, code, entry_d LIMIT 100", "run_trades")
def l03_worst(t):
    return rounded(B.run_trade_list(t.run_trades, worst=True).select("code", "entry_d", "exit_d", "ret_pct"))


@query("f12_ledger_filter", f"SELECT id FROM ledger WHERE mode = 'paper' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND side = 'sell' AND exit_reason = 'stop'", "ledger")
def f12(t):
    return FL.ledger_rows(t.ledger, "paper", NOW, 90, "sell", "stop").select("id")


@query("f13_not_entered", f"""SELECT l.code, l.strategy FROM (SELECT DISTINCT code, strategy, mode FROM ledger WHERE side = 'sell') l WHERE NOT EXISTS (
  SELECT 1 FROM positions p WHERE p.code = l.code AND p.strategy = l.strategy AND p.mode = l.mode AND p.entry_date < DATE '2001-07-01')
AND NOT EXISTS (SELECT 1 FROM ledger b WHERE b.side = 'buy' AND b.code = l.code AND b.strategy = l.strategy AND b.mode = l.mode AND b.d = DATE '2001-07-30')""", "ledger positions")
def f13(t):
    orders = t.ledger.where(F.col("side") == "sell").select("code", "strategy", "mode").distinct()
    held = t.positions.where(F.col("entry_date") < "2001-07-01")  # what the book held on that day
    return FL.not_entered(orders, held, t.ledger, "2001-07-30").select("code", "strategy")


@query("a20_distinct_lists", "SELECT DISTINCT exit_reason FROM ledger WHERE mode = 'paper' AND exit_reason IS NOT NULL", "ledger")
def a20(t):
    return t.ledger.where((F.col("mode") == "paper") & F.col("exit_reason").isNotNull()).select("exit_reason").distinct()


@query("a21_halves", f"""SELECT strategy, half, count(*) AS n, {r('avg(realized_pct) * 100')} AS mean_pct FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY strategy ORDER BY ts, id) <= count(*) OVER (PARTITION BY strategy) // 2
  THEN 1 ELSE 2 END AS half FROM ledger WHERE side = 'sell') x GROUP BY strategy, half""", "ledger")
def a21(t):
    sells = t.ledger.where(F.col("side") == "sell").select("strategy", "ts", "id", "realized_pct")
    return rounded(ST.halves(sells, ["strategy"], ["ts", "id"]).groupBy("strategy", "half").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("realized_pct") * 100).alias("mean_pct")))


@query("a21_split_date", """SELECT strategy, d AS split_date FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM ledger WHERE side = 'sell') x WHERE i = n // 2""", "ledger")
def a21_split(t):
    sells = t.ledger.where(F.col("side") == "sell").select("strategy", "ts", "id", "d")
    return ST.split_date(sells, ["strategy"], ["ts", "id"], "d")


# Small returns, so that the compounded curve stays within range.
_SMALL = "CAST((id * 37) % 201 - 100 AS DOUBLE) / 100000"
cte("curve", "ledger", f"""
SELECT strategy, min(exp(cum - peak) - 1) AS mdd, max(cum) AS top FROM (SELECT *, max(cum) OVER (PARTITION BY strategy ORDER BY ts, id) AS peak FROM (
  SELECT strategy, ts, id, sum(ln(1 + {_SMALL})) OVER (PARTITION BY strategy ORDER BY ts, id) AS cum FROM ledger WHERE side = 'sell') a) b GROUP BY strategy""")


def small_sells(t):
    return t.ledger.where(F.col("side") == "sell").select("strategy", "ts", "id", (F.col("realized_pct") / 100).alias("ret"))


@query("w14_compound_drawdown", f"SELECT strategy, {r('mdd')} AS mdd FROM curve", "curve")
def w14(t):
    return rounded(ST.compound_drawdown(small_sells(t), ["strategy"], ["ts", "id"]))


@query("w23_cumulative_product", f"SELECT strategy, {r('top')} AS log_top FROM curve", "curve")
def w23(t):
    """Peak of the compounded curve, from the sharded running sum."""
    from pyspark.sql import Window

    from tidemark.operators.ordered import with_offsets, with_shard
    from tidemark.session import pin

    rows = with_shard(pin(small_sells(t).withColumn("g", F.log1p("ret"))), ["strategy"], ["ts", "id"])
    rows = with_offsets(rows, ["strategy"], F.sum("g"))
    up = Window.partitionBy("strategy", "_shard").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(rows.withColumn("cum", F.col("_before") + F.sum("g").over(up)).groupBy("strategy").agg(F.max("cum").alias("log_top")))


def draw_sql(rows, times):
    """Numbered ``rows(g, y, rn)`` with a draw number u for each of ``times`` iterations i."""
    p, n = ST.PRIME, f"rn % {ST.PRIME}"
    return (f"SELECT *, (z * z + x) % {p} AS u FROM (SELECT *, (yy * 16807 + i) % {p} AS z FROM (SELECT *, (x * x + {n}) % {p} AS yy FROM ("
            f"SELECT g, y, rn, i, (({n}) * 48271 + i * 69621 + 7) % {p} AS x FROM ({rows}) q, (SELECT unnest(generate_series(0, {times - 1})) AS i) t)))")


_TIMES = " + ".join(f"(u >= {x})::BIGINT" for x in ST.DRAWN)


def positive_sql(rows, times):
    return f"""SELECT g, avg(CASE WHEN round(m, 12) > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate, count(*) AS iterations FROM (
  SELECT g, i, sum(w * y) / nullif(sum(w), 0) AS m FROM (SELECT *, {_TIMES} AS w FROM ({draw_sql(rows, times)})) GROUP BY g, i) GROUP BY g"""


_SOLD = "SELECT strategy AS g, realized_pct AS y, row_number() OVER (PARTITION BY strategy ORDER BY ts, id) AS rn FROM ledger WHERE side = 'sell' AND realized_pct IS NOT NULL"


@query("a22_performance_report", f"""SELECT s.*, first_half_pct, second_half_pct, {r('mdd * 100')} AS mdd_pct, CASE WHEN s.n >= 50 THEN {r('b.positive_rate * 100')} END AS bootstrap_positive_pct FROM ({stats_sql("(SELECT *, realized_pct / 100 AS ret FROM ledger WHERE side = 'sell') q", "strategy", held=None)}) s
JOIN (SELECT strategy, {r('avg(CASE WHEN h = 1 THEN realized_pct END)')} AS first_half_pct, {r('avg(CASE WHEN h = 2 THEN realized_pct END)')} AS second_half_pct FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY strategy ORDER BY ts, id) <= count(*) OVER (PARTITION BY strategy) // 2 THEN 1 ELSE 2 END AS h FROM ledger WHERE side = 'sell') x GROUP BY strategy) h USING (strategy)
JOIN curve USING (strategy) JOIN ({positive_sql(_SOLD, 200)}) b ON b.g = s.strategy""", "ledger curve")
def a22(t):
    return rounded(ST.performance_report(small_sells(t), ["ts", "id"], ["strategy"], "ret"))


@query("a23_multiple_comparison", "SELECT strategy, count(*) AS k, round((1 - pow(0.95, count(*))) * 100, 1) + 0.0 AS chance FROM (SELECT substr(strategy, 1, 3) AS strategy FROM runs) x GROUP BY strategy", "runs")
def a23(t):
    from tidemark.functions.verdicts import any_positive_chance

    g = t.runs.groupBy(F.substring("strategy", 1, 3).alias("strategy")).agg(F.count(F.lit(1)).alias("k"))
    return g.withColumn("chance", any_positive_chance(F.col("k")))


cte("probe", "positions", "SELECT code, CAST(entry_date AS DATE) AS d, strategy, mode FROM positions")


def probe(t):
    return t.positions.select("code", F.col("entry_date").alias("d"), "strategy", "mode")


@query("a24_filing_digest", """SELECT p.code, p.d, p.strategy, count(f.code) AS filings, coalesce(string_agg(strftime(f.d, '%Y-%m-%d') || ' ' || f.report_nm, ' | ' ORDER BY f.k) FILTER (f.k <= 15), '') AS newest
FROM probe p LEFT JOIN (SELECT q.code AS c, q.d AS at, f.*, row_number() OVER (PARTITION BY q.code, q.d ORDER BY f.d DESC, f.rcept_no DESC, f.report_nm DESC) AS k FROM (SELECT DISTINCT code, d FROM probe) q
  JOIN disclosures f ON f.code = q.code AND f.d <= q.d AND f.d > q.d - 90) f ON f.c = p.code AND f.at = p.d GROUP BY p.code, p.d, p.strategy""", "probe disclosures")
def a24(t):
    out = B.filing_digest(t.disclosures, probe(t))
    return out.select("code", "d", "strategy", "filings", F.coalesce(F.array_join("newest", " | "), F.lit("")).alias("newest"))


@query("a25_free_slots", "SELECT mode, strategy, 30 - count(*) AS free_slots FROM positions GROUP BY mode, strategy", "positions")
def a25(t):
    return B.free_slots(t.positions, 30).select("mode", "strategy", F.col("free_slots").cast("bigint").alias("free_slots"))


@query("a25_same_sector", "SELECT code, d, p.strategy, (SELECT count(*) FROM positions q WHERE q.strategy = p.strategy AND substr(q.code, 1, 4) = substr(p.code, 1, 4)) AS same_sector FROM probe p", "probe positions")
def a25_sector(t):
    return B.same_sector(probe(t), t.positions, 4).select("code", "d", "strategy", "same_sector")


cte("slices", "ledger", "SELECT mode, code AS label, round(sum(amount), 2) AS value FROM ledger GROUP BY mode, code")


@query("l06_fold_tail", f"""SELECT mode, label, {r('value', 2)} AS value FROM (SELECT mode, label, value, row_number() OVER (PARTITION BY mode ORDER BY value DESC, label) AS pos FROM slices) x WHERE pos <= 7
UNION ALL SELECT mode, 'other ' || CAST(count(*) AS VARCHAR), {r('sum(value)', 2)} FROM (SELECT mode, value, row_number() OVER (PARTITION BY mode ORDER BY value DESC, label) AS pos FROM slices) y WHERE pos > 7 GROUP BY mode""", "slices")
def l06(t):
    slices = t.ledger.groupBy("mode", F.col("code").alias("label")).agg(F.round(F.sum("amount"), 2).alias("value"))
    return rounded(B.fold_tail(slices, ("mode",), "label", "value").drop("pos"), 2)


C27 = f"""WITH h AS (SELECT p.mode, p.name || ':' || p.strategy AS label, sum(qty * coalesce(last_c, entry_px)) AS value FROM positions p LEFT JOIN {_LAST} b USING (code) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY value DESC, label) AS pos FROM h),
u AS (SELECT mode, label, value FROM k WHERE pos <= 7 UNION ALL SELECT mode, 'other ' || CAST(count(*) AS VARCHAR), sum(value) FROM k WHERE pos > 7 GROUP BY mode
  UNION ALL SELECT mode, 'cash', greatest(sum(cash), 0.0) FROM cash GROUP BY mode)
SELECT mode, label, {r('value', 3)} AS value, round(value / sum(value) OVER (PARTITION BY mode) * 100, 1) + 0.0 AS pct FROM u"""


@query("c27_allocation", C27, "positions bars cash")
def c27(t):
    out = B.allocation(t.positions, latest_close_on(t.bars, CASH_DAY), B.cash(t.ledger, CASH_DAY, settings(t)))
    return rounded(out.drop("pos"), 3, pct=1)


BEST = """SELECT code, strategy, mode, agents FROM (SELECT *, row_number() OVER (PARTITION BY code, strategy, mode ORDER BY agents LIKE '%"value_trap"%' DESC, ts DESC, id DESC) AS rn
FROM ledger WHERE side = 'buy' AND agents <> '{}') x WHERE rn = 1"""


@query("j14_best_entry_record", BEST, "ledger")
def j14(t):
    return B.entry_records(t.ledger)


@query("j13_position_latest_price", f"SELECT p.code, p.strategy, {r('b.c', 8)} AS current_px FROM positions p LEFT JOIN (SELECT code, arg_max(c, d) AS c FROM bars GROUP BY code) b USING (code)", "positions bars")
def j13(t):
    newest = t.bars.groupBy("code").agg(F.max_by("c", "d").alias("current_px"))
    return rounded(t.positions.select("code", "strategy").join(newest, "code", "left"))


@query("c34_open_positions", f"""SELECT p.code, p.strategy, p.mode, {r('b.c', 8)} AS current_px, round((b.c / p.entry_px - 1) * 100, 2) + 0.0 AS pct, round((b.c - p.entry_px) * p.qty, 0) + 0.0 AS unrealized, t.agents
FROM positions p LEFT JOIN (SELECT code, arg_max(c, d) AS c FROM bars GROUP BY code) b USING (code) LEFT JOIN ({BEST}) t USING (code, strategy, mode)""", "positions bars ledger")
def c34(t):
    out = B.open_positions_view(t.positions, t.bars, t.ledger)
    return rounded(out.select("code", "strategy", "mode", "current_px", "pct", "unrealized", "agents"))


# The exit of a buy is the first sell after it by which more sells than buys have followed it.
@query("c36_match_exits", """WITH m AS (SELECT id, code, mode, strategy, ts, side, CASE WHEN side = 'sell' THEN 1 ELSE -1 END AS step, exit_reason, realized_pct FROM ledger WHERE side = 'sell' OR exit_reason IS NULL),
f AS (SELECT b.id AS buy, s.*, sum(s.step) OVER (PARTITION BY b.id ORDER BY s.ts, s.id) AS total FROM m b JOIN m s ON b.side = 'buy' AND s.code = b.code AND s.mode = b.mode AND s.strategy = b.strategy AND (s.ts, s.id) > (b.ts, b.id)),
x AS (SELECT buy, arg_min(exit_reason, (ts, id)) AS reason, arg_min(realized_pct, (ts, id)) AS pct FROM f WHERE total = 1 GROUP BY buy)
SELECT l.id, coalesce(x.reason, l.exit_reason) AS exit_reason, coalesce(x.pct, l.realized_pct) AS realized_pct FROM ledger l LEFT JOIN x ON x.buy = l.id""", "ledger")
def c36(t):
    return B.match_exits(t.ledger, t.ledger.where(F.col("side") == "sell")).select("id", "exit_reason", "realized_pct")


@query("w19_latest_per_key", "SELECT code, agent, id FROM (SELECT *, row_number() OVER (PARTITION BY code, agent ORDER BY ts DESC, id DESC) AS rn FROM decisions) x WHERE rn = 1", "decisions")
def w19(t):
    return latest_per_key(t.decisions, ["code", "agent"]).select("code", "agent", "id")


_G = f"""WITH w AS (SELECT DISTINCT 'paper' AS mode, strategy, n.code, 'N' || n.code AS tname FROM ledger, nat n WHERE ledger.code = n.code AND n.n_nationkey % 3 = 0),
j AS (SELECT coalesce(w.mode, p.mode) AS mode, coalesce(w.strategy, p.strategy) AS strategy, coalesce(w.code, p.code) AS code, coalesce(p.qty, 0) AS held, p.entry_px, w.tname IS NOT NULL AS target
  FROM w FULL JOIN positions p ON p.mode = w.mode AND p.strategy = w.strategy AND p.code = w.code),
g AS (SELECT j.*, b.o AS px, CASE WHEN target THEN floor(1000000.0 / 50 / b.o) ELSE 0 END AS goal FROM j JOIN bars b ON b.code = j.code AND b.d = DATE '{EXIT_DAY}' AND b.o > 0)"""
C18 = _G + f"""
SELECT mode, strategy, code, CASE WHEN goal > held THEN 'buy' ELSE 'sell' END AS side, abs(goal - held) AS qty, {r(f"CASE WHEN goal > held THEN {BUYF.format('px')} ELSE {SELLF.format('px')} END")} AS price,
  {r(f"CASE WHEN goal < held THEN {SELLF.format('px')} / entry_px - 1 END")} AS realized_pct FROM g WHERE goal <> held AND NOT (target AND goal < 1)"""
P15 = _G + f"""
SELECT mode, strategy, code, goal + 0.0 AS qty, {r(f"CASE WHEN goal > held AND held > 0 THEN (held * entry_px + (goal - held) * {BUYF.format('px')}) / goal WHEN goal > held THEN {BUYF.format('px')} ELSE entry_px END", 8)} AS entry_px
FROM g WHERE goal > 0 AND NOT (target AND goal < 1)
UNION ALL SELECT mode, strategy, code, qty, {r('entry_px', 8)} FROM positions p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.mode = p.mode AND g.strategy = p.strategy AND g.code = p.code AND NOT (g.target AND g.goal < 1))"""


def _orders(t):
    nat = t.raw("nation").where(F.col("n_nationkey") % 3 == 0)
    from tidemark.plans.domain import nation_code

    codes = nat.select(nation_code(F.col("n_nationkey")).alias("code"))
    targets = t.ledger.select("mode", "strategy", "code", "name").distinct().join(codes, "code", "left_semi")
    prices = t.bars.where(F.col("d") == F.lit(EXIT_DAY).cast("date")).select("code", F.col("o").alias("px"))
    books = t.ledger.groupBy("mode", "strategy").agg(F.lit(1e6).alias("equity"), F.lit(50).alias("slots"))
    return R.rebalance_orders(targets, t.positions, prices, books)


@query("c18_rebalance_orders", C18, "ledger nat positions bars")
def c18(t):
    return rounded(_orders(t)["orders"].select("mode", "strategy", "code", "side", "qty", "price", "realized_pct"), 6, price=6)


@query("p15_positions_after_rebalance", P15, "ledger nat positions bars")
def p15(t):
    return rounded(_orders(t)["positions"].select("mode", "strategy", "code", "qty", "entry_px"), 6)


@query("p13_position_size", f"""SELECT code, d, CASE WHEN floor(10000000.0 / 10 / (c * 200)) >= 1 THEN CAST(floor(10000000.0 / 10 / (c * 200)) AS BIGINT) END AS qty FROM bars""", "bars")
def p13(t):
    return t.bars.select("code", "d", K.position_size(F.lit(10000000.0), F.lit(10), F.col("c") * 200).alias("qty"))


@query("p14_stop_price", f"SELECT code, d, {r(f'CASE WHEN v % 2 > 0 THEN o * (1 - (v % 2) * 0.07) ELSE 0 END', 9)} AS stop_px FROM bars", "bars")
def p14(t):
    return rounded(t.bars.select("code", "d", K.stop_price(F.col("o"), (F.col("v") % 2) * F.lit(0.07)).alias("stop_px")), 9, stop_px=9)


@query("p16_mark", """SELECT code, d, round((c / o - 1) * 100, 2) + 0.0 AS pct, round((c - o) * CAST(v AS DOUBLE), 0) + 0.0 AS unrealized FROM bars""", "bars")
def p16(t):
    return t.bars.select("code", "d", K.mark_pct(F.col("c"), F.col("o")).alias("pct"), K.unrealized(F.col("c"), F.col("o"), F.col("v").cast("double")).alias("unrealized"))


# ---- text functions -----------------------------------------------------------------------------

@query("p10_amount", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 IN (1, 2) THEN -CAST(floor(o_totalprice) AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END AS amount FROM orders""")
def p10(t):
    key, plain = F.col("o_orderkey"), F.format_number(F.floor("o_totalprice"), 0)
    text = (F.when(key % 10 == 0, "-").when(key % 10 == 5, "").when(key % 5 == 1, F.concat(F.lit("("), plain, F.lit(")")))
            .when(key % 5 == 2, F.concat(F.lit("-"), plain)).otherwise(F.concat(F.lit(" "), plain)))
    return t.raw("orders").select("o_orderkey", P.amount(text).alias("amount"))


@query("p11_count", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS n FROM orders")
def p11(t):
    key, plain = F.col("o_orderkey"), F.format_number(F.floor("o_totalprice"), 0)
    text = F.when(key % 8 == 0, "-").when(key % 8 == 4, F.concat(plain, F.lit(".5"))).otherwise(plain)
    return t.raw("orders").select("o_orderkey", P.count(text).alias("n"))


def replies(t):
    """Replies in the known format, with the emphasis marks of real answers, and some broken ones."""
    e, k = t.raw("events"), F.col("event_id") % 4
    word = F.when(F.col("event_type") == "click", P.EXIT).when(F.col("event_type") == "signup", P.WATCH).otherwise(P.BUY)
    score = F.floor("value").cast("string")
    text = (F.when(F.col("event_type") == "error", F.concat(F.lit("no format "), F.col("props")))
            .when(k == 0, F.concat(F.lit("결정: "), word, F.lit("\n확신: "), score, F.lit("\n이유: "), F.col("props")))
            .when(k == 1, F.concat(F.lit("**결정: "), word, F.lit(" / 확신: "), score, F.lit(" / 이유: "), F.col("props"), F.lit("**")))
            .when(k == 2, F.concat(F.lit("결정: **"), word, F.lit("** / 이유: "), F.col("props")))
            .otherwise(F.concat(F.lit("**결정**: "), word, F.lit(" / **확신: "), score, F.lit("** / **이유: "), F.col("props"), F.lit("**"))))
    return e.withColumn("text", text)


_WORD = "CASE event_type WHEN 'click' THEN '청산' WHEN 'signup' THEN '관망' ELSE '매수' END"


@query("p17_reply", f"""SELECT event_id, CASE WHEN event_type <> 'error' THEN {_WORD} END AS decision, CASE WHEN event_type = 'error' OR event_id % 4 = 2 THEN 5.0 ELSE floor(value) END AS score,
  CASE WHEN event_type = 'error' THEN 'no format ' || props ELSE props END AS reason FROM events""")
def p17(t):
    x = F.col("text")
    return replies(t).select("event_id", P.reply_decision(x).alias("decision"), P.reply_score(x).alias("score"), P.reply_reason(x).alias("reason"))


@query("p18_failure_label", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '크레딧 잔액 부족' WHEN 1 THEN 'API 키 인증 실패' WHEN 2 THEN '요청 한도 초과' WHEN 3 THEN 'API 연결 실패' ELSE 'API 오류' END AS label
FROM events WHERE event_type = 'error'""")
def p18(t):
    k = F.col("event_id") % 5
    kind = F.when(k == 1, "authentication_error").when(k == 2, "rate_limit_error").when(k == 3, "connection_error").otherwise("api_error")
    message = F.when(k == 0, F.concat(F.lit("your credit balance is too low "), "props")).otherwise(F.col("props"))
    return t.raw("events").where(F.col("event_type") == "error").select("event_id", P.failure_label(kind, message).alias("label"))


@query("p19_label_and_detail", "SELECT id, split_part(rationale, ' - ', 1) AS label, CASE WHEN instr(rationale, ' - ') > 0 THEN substr(rationale, instr(rationale, ' - ') + 3) ELSE '' END AS detail FROM decisions", "decisions")
def p19(t):
    return t.decisions.select("id", P.alert_label(F.col("rationale")).alias("label"), P.alert_detail(F.col("rationale")).alias("detail"))


@query("p20_content_key", "SELECT event_id, md5(event_type || CAST(user_id AS VARCHAR) || props) AS key FROM events")
def p20(t):
    return t.raw("events").select("event_id", P.content_key(F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("key"))


@query("p27_json_keys", """SELECT id, agents LIKE '%"value_trap"%' AS has_key, agents <> '{}' AS filled FROM ledger WHERE agents IS NOT NULL""", "ledger")
def p27(t):
    a = F.col("agents")
    return t.ledger.where(a.isNotNull()).select("id", P.has_key(a, "value_trap").alias("has_key"), P.non_empty(a).alias("filled"))


# ---- resampling ---------------------------------------------------------------------------------

@query("c16_bootstrap", "SELECT positive_rate, iterations FROM (" + positive_sql("SELECT 0 AS g, ret AS y, row_number() OVER (ORDER BY d, code) AS rn FROM entries", 200) + ") w", "entries")
def c16(t):
    """Resampled share of positive means over all entries."""
    return ST.bootstrap_positive_rate(entries(t).select("code", "d", "ret"), ["d", "code"], iterations=200)


def pool_rows(t):
    from tidemark.operators import outcomes as O
    from tidemark.session import pin

    return pin(O.outcome_table(t.bars, stop_pct=0.6).select("code", "d", "ret"), "pool")


cte("control_pool", "bars signals", outcome_sql(stop=0.6))


_U = "((i * 69621 + 7 + (j + 1) % 2147483647 * 48271) % 2147483647)"  # the sums of draw_number, written out
_V = f"(({_U} * {_U} + (j + 1) % 2147483647) % 2147483647)"
_Z = f"(({_V} * 16807 + i) % 2147483647)"
_DRAW = f"(({_Z} * {_Z} + {_U}) % 2147483647)"


def _control_sql(rounds):
    """CTEs up to ``tried``: the mean m of each round's draw from the pool."""
    return f"""pool AS MATERIALIZED (SELECT ret AS y, row_number() OVER (ORDER BY d, code) AS rn FROM control_pool), size AS MATERIALIZED (SELECT count(*) AS n FROM pool),
floyd(i, j, s) AS (SELECT r.i, n - 50, []::BIGINT[] FROM range({rounds}) r(i), size
  UNION ALL SELECT i, j + 1, CASE WHEN list_contains(s, t) THEN list_append(s, j + 1) ELSE list_append(s, t) END FROM (SELECT i, j, s, 1 + ({_DRAW} * 2147483647 + {_DRAW.replace('(i * 69621', '((i + 104729) * 69621').replace('16807 + i', '16807 + i + 104729')}) % (j + 1) AS t FROM floyd WHERE j < (SELECT n FROM size)) x),
tried AS MATERIALIZED (SELECT i, avg(y) AS m FROM (SELECT i, unnest(s) AS rn FROM floyd WHERE j = (SELECT n FROM size)) p JOIN pool USING (rn) GROUP BY i)"""


@query("c17_random_control", f"""WITH RECURSIVE {_control_sql(200)}
SELECT avg(CASE WHEN m < (SELECT avg(ret) FROM entries) THEN 1.0 ELSE 0.0 END) AS pct_rank, count(*) AS rounds FROM tried z""", "entries control_pool")
def c17(t):
    return ST.random_control(pool_rows(t), ["d", "code"], entries(t).agg(F.avg("ret").alias("mean")))


# Parity of the CRC-32 of a code, bit by bit.
_EVEN = """SELECT code, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(substr(code, CAST(p AS INTEGER), 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0] for p in range(1, length(code) + 1)])),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) & 1 = 1 AS even FROM (SELECT DISTINCT code FROM entries) x"""


def _walk_sql(name, rows, keys):
    """CTEs ``name`` (rows numbered per keys and code) and ``name``_kept: the trades left when none may start before the last has closed."""
    keys = [*keys, "code"]
    cols = ", ".join(keys)

    def same(a, b):
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)

    def of(a):
        return ", ".join(f"{a}.{k}" for k in keys)

    return f"""{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY d) AS i FROM ({rows}) q),
{name}_next AS MATERIALIZED (SELECT {of('n')}, n.i, m.i AS j FROM {name} n ASOF JOIN (SELECT {cols}, d, i FROM {name}) m ON {same('m', 'n')} AND n.exit_d < m.d),
{name}_walk({cols}, i) AS (SELECT {cols}, min(i) FROM {name} GROUP BY {cols} UNION ALL SELECT {of('w')}, x.j FROM {name}_walk w JOIN {name}_next x ON {same('x', 'w')} AND x.i = w.i),
{name}_kept AS MATERIALIZED (SELECT * FROM {name} JOIN {name}_walk USING ({cols}, i))"""


C37_FROM, C37_TO = "1995-01-01", "2001-12-31"
_HALVES = f"""SELECT s.half, r.* FROM ruled r JOIN mid USING (rule) JOIN head USING (rule) JOIN (VALUES (1), (2)) s(half)
  ON CASE WHEN s.half = 1 THEN d BETWEEN DATE '{C37_FROM}' AND split_date ELSE d BETWEEN split_date AND DATE '{C37_TO}' END WHERE n >= 10"""
C37_SQL = f"""WITH RECURSIVE ruled AS MATERIALIZED (SELECT 'all' AS rule, * FROM entries UNION ALL SELECT 'half', e.* FROM entries e JOIN ({_EVEN}) f USING (code) WHERE even),
{_walk_sql('b', 'SELECT * FROM ruled', ['rule'])},
trades AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY entry_d, code) AS rn FROM b_kept),
head AS MATERIALIZED (SELECT rule, count(*) AS n, avg(ret) AS mean FROM trades GROUP BY rule),
mid AS MATERIALIZED (SELECT t.rule, t.entry_d AS split_date FROM trades t JOIN head USING (rule) WHERE t.rn = head.n // 2 + 1),
{_walk_sql('h', _HALVES, ['rule', 'half'])},
boot AS (SELECT g AS rule, positive_rate FROM ({positive_sql('SELECT rule AS g, ret AS y, rn FROM trades', 200)}) p),
{_control_sql(100)},
means AS (SELECT rule, count(*) FILTER (WHERE half = 1) AS t1_n, count(*) FILTER (WHERE half = 2) AS t2_n, avg(ret) FILTER (WHERE half = 1) * 100 AS t1, avg(ret) FILTER (WHERE half = 2) * 100 AS t2 FROM h_kept GROUP BY rule),
told AS (SELECT h.*, (SELECT avg(CASE WHEN m < h.mean THEN 1.0 ELSE 0.0 END) FROM tried) AS pct_rank FROM head h)
SELECT rule, n, n < 10 AS skipped, CASE WHEN n >= 10 THEN split_date END AS split_date, t1_n, t2_n, {r('t1')} AS t1_mean_pct, {r('t2')} AS t2_mean_pct, CASE WHEN n >= 10 THEN {r('positive_rate * 100')} END AS bootstrap_positive_pct,
  CASE WHEN n >= 10 THEN positive_rate >= 0.8 END AS bootstrap_pass, CASE WHEN n >= 10 THEN {r('pct_rank * 100')} END AS random_pct_rank, CASE WHEN n >= 10 THEN pct_rank >= 0.8 END AS control_pass
FROM told JOIN mid USING (rule) LEFT JOIN means USING (rule) LEFT JOIN boot USING (rule)"""


@query("c37_validation", C37_SQL, "entries control_pool")
def c37(t):
    """All rules in one job: every entry, and the cheaper half of the codes."""
    from tidemark.operators import outcomes as O
    from tidemark.session import pin

    rules = F.array(F.lit("all"), F.when(F.pmod(F.crc32("code"), F.lit(2)) == 0, "half"))
    base = pin(entries(t).select("*", F.explode(F.array_compact(rules)).alias("rule")), "entries")

    def between(spans):
        inside = base.join(spans, "rule").where(F.col("d").between(F.col("from"), F.col("to"))).drop("from", "to")
        return O.non_overlapping(inside, ["rule", "half"])

    trades = pin(O.non_overlapping(base, ["rule"]), "trades")
    pool = pool_rows(t).withColumnRenamed("d", "entry_d")
    return rounded(ST.validate(between, trades, pool, ["entry_d", "code"], C37_FROM, C37_TO, iterations=200, rounds=100))
