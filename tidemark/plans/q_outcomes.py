"""Registered queries: candidates, exits, barrier outcomes, studies, rebalancing and walk-forward."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import costs as K
from tidemark.operators import filters as FL
from tidemark.operators import outcomes as O
from tidemark.operators import rebalance as R
from tidemark.operators import statistics as ST
from tidemark.operators import windows as W
from tidemark.operators.fundamentals import top_per_day
from tidemark.operators.ordered import percentile_rank
from tidemark.operators.signals import METRICS
from tidemark.plans.domain_sql import cte, num, r
from tidemark.plans.q_signals import HORIZONS, TURN20, TURNOVER, _pos_sql, fwd_sql, rounded
from tidemark.plans.q_value import C05_SQL, QCAP, _pr, days, pool
from tidemark.plans.registry import query
from tidemark.session import pin

B1, B2 = (num(x) for x in K.BUY_FACTORS)
S1, S2 = (num(x) for x in K.SELL_FACTORS)
BUYF = f"({{}} * {B1} * {B2})"
SELLF = f"({{}} * {S1} * {S2})"


@query("p01_cost_model", f"""SELECT l_returnflag, count(*) AS n, {r(f"avg({SELLF.format('l_extendedprice')} / {BUYF.format('l_extendedprice')} - 1)", 9)} AS flat,
  {r(f"min({SELLF.format('(l_extendedprice * (1 - l_discount))')} / {BUYF.format('l_extendedprice')} - 1)", 9)} AS worst FROM lineitem GROUP BY l_returnflag""")
def p01(t):
    p = F.col("l_extendedprice")
    return rounded(t.raw("lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg(K.net_return(p, p)).alias("flat"),
        F.min(K.net_return(p, p * (1 - F.col("l_discount")))).alias("worst")), 9)


cte("candidates", "signals bars", f"""
SELECT *, row_number() OVER (PARTITION BY d ORDER BY rank_value, code) AS rk FROM (
SELECT s.code, s.d, p.c AS close, s.heat_score, s.institution_flow_ratio AS rank_value, p.pos52w
FROM signals s JOIN (SELECT code, d, c, {TURN20} AS t, {_pos_sql(251, 1)} AS pos52w FROM bars) p ON p.code = s.code AND p.d = s.d
WHERE heat_score < 7 AND signal = 'neutral' AND institution_flow_ratio IS NOT NULL AND regexp_full_match(s.code, '[0-9]+')
AND p.t >= {TURNOVER} AND pos52w <= 0.30) x""")


@query("c03_contrarian_candidates", f"""SELECT code, d, {r('close', 8)} AS close, {r('heat_score')} AS heat_score, {r('rank_value')} AS rank_value, {r('pos52w')} AS pos52w,
  CAST(rk AS INTEGER) AS rank FROM candidates WHERE rk <= 50""", "candidates")
def c03(t):
    return rounded(O.contrarian_candidates(t.signals, t.bars, TURNOVER))


@query("l01_limit_after_filters", "SELECT code, d FROM candidates WHERE rk <= 2", "candidates")
def l01(t):
    return O.contrarian_candidates(t.signals, t.bars, TURNOVER, k=2).select("code", "d")


EXIT_DAY = "2001-07-06"
_HELD = f"(SELECT count(*) FROM bars b WHERE b.code = p.code AND b.d > p.entry_date AND b.d <= DATE '{EXIT_DAY}')"
C04 = f"""SELECT * FROM (SELECT *, CASE WHEN close <= stop_px THEN 'stop' WHEN held_days >= max_hold_days AND held_days >= {{minimum}} THEN 'expiry' {{heat}} END AS reason FROM (
SELECT p.code, p.strategy, p.qty, p.entry_px, p.stop_px, p.max_hold_days, p.mode, b.c AS close, coalesce(s.heat_score, 0) AS heat_score, {_HELD} AS held_days
FROM positions p JOIN bars b ON b.code = p.code AND b.d = DATE '{EXIT_DAY}' LEFT JOIN signals s ON s.code = p.code AND s.d = DATE '{EXIT_DAY}') x) y WHERE reason IS NOT NULL"""
_EXIT_COLS = ("code", "strategy", "close", "entry_px", "qty", "mode", "reason")
_EXIT_SELECT = f"code, strategy, {r('close', 8)} AS close, {r('entry_px', 8)} AS entry_px, qty, mode, reason, held_days"


def _exits(t, **kw):
    out = O.exits(t.positions, t.bars, EXIT_DAY, **kw)
    return rounded(out.select(*_EXIT_COLS, F.col("held_days").cast("bigint").alias("held_days")))


@query("c04_exits", f"SELECT {_EXIT_SELECT} FROM ({C04.format(minimum=0, heat='WHEN heat_score >= 3 THEN' + chr(32) + chr(39) + 'heat_signal' + chr(39))}) z", "positions bars signals")
def c04(t):
    return _exits(t, signals=t.signals, sell=3.0)


@query("c04_exits_minimum_hold", f"SELECT {_EXIT_SELECT} FROM ({C04.format(minimum=25, heat='')}) z", "positions bars signals")
def c04_min(t):
    return _exits(t, min_hold=25)


@query("j04_positions_with_marks", f"""SELECT p.code, p.strategy, {r('b.c', 8)} AS close, {r('coalesce(s.heat_score, 0)')} AS heat_score, coalesce(s.signal, 'neutral') AS signal
FROM positions p JOIN bars b ON b.code = p.code AND b.d = DATE '{EXIT_DAY}' LEFT JOIN signals s ON s.code = p.code AND s.d = DATE '{EXIT_DAY}'""", "positions bars signals")
def j04(t):
    day = F.lit(EXIT_DAY).cast("date")
    now = t.signals.where(F.col("d") == day).select("code", "heat_score", "signal")
    out = t.positions.join(t.bars.where(F.col("d") == day).select("code", F.col("c").alias("close")), "code").join(now, "code", "left")
    return rounded(out.select("code", "strategy", "close", F.coalesce("heat_score", F.lit(0.0)).alias("heat_score"),
                              F.coalesce("signal", F.lit("neutral")).alias("signal")))


# ---- barrier outcomes ---------------------------------------------------------------------------

def outcome_sql(hold=20, stop=0.07, monitor=1, level="l", flag="FALSE", market=False):
    """Twin of ``outcome_table``: every bar as a signal day, first hit on the following bars."""
    pos = "dense_rank() OVER (ORDER BY b.d)" if market else "row_number() OVER (PARTITION BY b.code ORDER BY b.d)"
    seq = "row_number() OVER (PARTITION BY b.code ORDER BY b.d)"
    must = "AND e.pos = s.pos + 1" if market else ""
    fill = "least(stop_px, o)" if level == "l" else "c"
    return f"""
WITH n AS (SELECT b.*, {pos} AS pos, {seq} AS seq, coalesce({flag}, FALSE) AS flag FROM bars b LEFT JOIN signals s USING (code, d)),
e AS (SELECT s.code, s.d, e.d AS entry_d, e.seq AS eseq, e.pos AS epos, {BUYF.format('e.o')} AS entry_px FROM n s JOIN n e ON e.code = s.code AND e.seq = s.seq + 1 {must} WHERE e.o > 0),
h AS (SELECT e.*, entry_px * {num(1 - stop)} AS stop_px, x.d AS xd, x.o, x.l, x.c, x.flag, x.pos - epos AS held,
        row_number() OVER (PARTITION BY e.code, e.d ORDER BY x.seq) AS k
      FROM e JOIN n x ON x.code = e.code AND x.seq BETWEEN eseq + {monitor} AND eseq + {hold}
      WHERE x.{level} <= entry_px * {num(1 - stop)} OR x.flag OR x.pos - epos >= {hold})
SELECT code, d, entry_d, entry_px, xd AS exit_d, {SELLF.format(f'(CASE WHEN {level} <= stop_px THEN {fill} ELSE c END)')} AS exit_px,
  CASE WHEN {level} <= stop_px THEN 'stop' WHEN flag THEN 'signal' ELSE 'expiry' END AS reason, held,
  {SELLF.format(f'(CASE WHEN {level} <= stop_px THEN {fill} ELSE c END)')} / entry_px - 1 AS ret FROM h WHERE k = 1"""


def outcome_select(src, extra=""):
    return (f"SELECT code, d, entry_d, {r('entry_px', 6)} AS entry_px, exit_d, {r('exit_px', 6)} AS exit_px, reason, CAST(held AS INTEGER) AS held, "
            f"{r('ret')} AS ret{extra} FROM {src}")


def outcome_rows(df, *extra):
    out = df.select("code", "d", "entry_d", "entry_px", "exit_d", "exit_px", "reason", F.col("held").cast("int").alias("held"), "ret", *extra)
    return rounded(out, 6, entry_px=6, exit_px=6)


def flagged(t, sell=5.0):
    """Bars with an exit flag where heat reaches ``sell``."""
    return t.bars.join(t.signals.select("code", "d", (F.col("heat_score") >= sell).alias("exit_flag")), ["code", "d"], "left")


# A wide stop keeps all three exit reasons alive on this noisy price series.
STOP = 0.6
cte("outcomes", "bars signals", outcome_sql(stop=STOP, flag="heat_score >= 5.0"))


@query("c10_barrier_outcomes", outcome_select("outcomes"), "outcomes")
def c10(t):
    return outcome_rows(O.outcome_table(flagged(t), stop_pct=STOP))


@query("c10_default_stop", outcome_select("(" + outcome_sql() + ") z"), "bars signals")
def c10_default(t):
    return outcome_rows(O.outcome_table(t.bars))


@query("c10_stop_on_close", outcome_select("(" + outcome_sql(stop=STOP, level="c") + ") z"), "bars signals")
def c10_close(t):
    return outcome_rows(O.outcome_table(t.bars, stop_pct=STOP, stop_on="close"))


@query("c10_market_days", outcome_select("(" + outcome_sql(stop=STOP, monitor=0, market=True, hold=10) + ") z"), "bars signals")
def c10_market(t):
    return outcome_rows(O.outcome_table(t.bars, max_hold=10, stop_pct=STOP, monitor_from=0, count="market_days"))


cte("entries", "signals outcomes", """
SELECT o.* FROM outcomes o JOIN signals s USING (code, d) WHERE s.heat_score < 7 AND s.signal = 'neutral'""")
cte("numbered", "entries", "SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) AS i FROM entries")


def chain_sql(op):
    cmp = "<" if op == ">" else "<="
    return f"""WITH RECURSIVE nxt AS MATERIALIZED (SELECT n.code, n.i, m.i AS j FROM numbered n ASOF JOIN (SELECT code, d, i FROM numbered) m ON m.code = n.code AND n.exit_d {cmp} m.d),
kept(code, i) AS (SELECT code, min(i) FROM numbered GROUP BY code UNION ALL SELECT k.code, x.j FROM kept k JOIN nxt x ON x.code = k.code AND x.i = k.i)
{outcome_select('numbered JOIN kept USING (code, i)')}"""


def entries(t):
    gate = FL.entry_gate(7.0)
    return O.barrier_outcomes(flagged(t), t.signals.where(gate).select("code", "d"), stop_pct=STOP)


@query("c11_non_overlapping", chain_sql(">"), "numbered")
def c11(t):
    return outcome_rows(O.non_overlapping(entries(t)))


@query("c11_re_entry_on_exit_day", chain_sql(">="), "numbered")
def c11_exclusive(t):
    return outcome_rows(O.non_overlapping(entries(t), inclusive=False))


cte("ranked", "signals outcomes bars", f"""
SELECT o.*, rk AS rank FROM (SELECT code, d, row_number() OVER (PARTITION BY d ORDER BY round(s.heat_score, 9), code) AS rk
  FROM signals s JOIN (SELECT code, d, {_pos_sql(252, 60)} AS pos52w FROM bars) p USING (code, d) WHERE pos52w <= 0.30) x
JOIN ({outcome_sql(stop=STOP)}) o USING (code, d) WHERE rk <= 20""")


def study(t):
    signals = t.signals.withColumn("heat_score", F.round("heat_score", 9))
    return O.rank_study(signals, t.bars, "heat_score", stop_pct=STOP)


@query("c29_rank_study", outcome_select("ranked", ", CAST(rank AS INTEGER) AS rank"), "ranked")
def c29(t):
    return outcome_rows(study(t), "rank")


@query("c29_stability", f"""SELECT count(*) AS quarters, count(CASE WHEN m > 0 THEN 1 END) AS positive_quarters,
  (SELECT {r('avg(ret) * 100')} FROM ranked WHERE d < DATE '1999-01-01') AS train_pct, (SELECT {r('avg(ret) * 100')} FROM ranked WHERE d >= DATE '1999-01-01') AS valid_pct
FROM (SELECT avg(ret) AS m FROM ranked GROUP BY year(d), quarter(d)) q""", "ranked")
def c29_stability(t):
    return rounded(ST.stability(study(t), "1999-01-01"))


def stats_sql(src, keys, ddof=0, ret="ret", held="held", where="", extra=""):
    sd = f"{'stddev_pop' if ddof == 0 else 'stddev_samp'}({ret})"
    k = f"{keys}, " if keys else ""
    h = f", {r(f'avg({held})')} AS avg_held_days" if held else ""
    g = f"GROUP BY {keys}" if keys else ""
    return (f"SELECT {k}count({ret}) AS n, {r(f'avg({ret}) * 100')} AS mean_pct, {r(f'{sd} * 100')} AS std_pct, "
            f"{r(f'avg(CASE WHEN {ret} > 0 THEN 1.0 ELSE 0.0 END) * 100')} AS win_rate, "
            f"{r(f'CASE WHEN {sd} > 0 THEN avg({ret}) / ({sd} / sqrt(count({ret}))) ELSE 0 END')} AS t_val{h}{extra} FROM {src} {where} {g}")


@query("a12_rank_buckets", "SELECT * FROM (" + stats_sql(
    "(SELECT *, CASE WHEN rank <= 2 THEN '1-2' WHEN rank <= 5 THEN '3-5' WHEN rank <= 10 THEN '6-10' ELSE '11-20' END AS bucket FROM ranked) z", "bucket", ddof=1, held=None)
    + ") y WHERE n >= 30", "ranked")
def a12(t):
    return rounded(ST.rank_bucket_statistics(study(t)))


@query("a07_quarterly", f"""SELECT quarter, n, {r('m')} AS avg_pct, {r('CASE WHEN max(abs(m)) OVER () > 0 THEN abs(m) / max(abs(m)) OVER () * 100 ELSE 0 END')} AS bar_pct FROM (
  SELECT CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS quarter, count(*) AS n, avg(ret) * 100 AS m FROM ranked GROUP BY 1) x""", "ranked")
def a07(t):
    return rounded(ST.quarterly(study(t)))


@query("a01_trade_statistics", stats_sql("entries", "") , "entries")
def a01(t):
    return rounded(ST.trade_statistics(entries(t)).drop("reasons"))


@query("a01_statistics_by_code", stats_sql("entries", "code", ddof=1), "entries")
def a01_code(t):
    return rounded(ST.trade_statistics(entries(t), ["code"], ddof=1, reason=None))


@query("a01_reason_counts", "SELECT code, reason, count(*) AS n FROM entries GROUP BY code, reason", "entries")
def a01_reasons(t):
    return ST.trade_statistics(entries(t), ["code"]).select("code", F.explode("reasons").alias("reason", "n"))


@query("a14_turnover", f"""SELECT code, n, {r('n / 10.0 / (2500 / 365.25)')} AS turnover_per_slot, {r('m * (n / 10.0 / (2500 / 365.25))')} AS annualized_pct
FROM (SELECT code, count(*) AS n, avg(ret) * 100 AS m FROM entries GROUP BY code) x""", "entries")
def a14(t):
    stats = ST.trade_statistics(entries(t), ["code"], reason=None)
    return rounded(ST.annualised(stats, F.lit(10.0), F.lit(2500)).select("code", "n", "turnover_per_slot", "annualized_pct"))


# ---- factor studies -----------------------------------------------------------------------------

_FWD = ", ".join(f"{fwd_sql(h)} AS fwd_{h}" for h in HORIZONS)
cte("panel", "signals bars", "SELECT metric, horizon, x, y FROM (SELECT s.*, f.* EXCLUDE (code, d) FROM signals s JOIN (SELECT code, d, " + _FWD + " FROM bars) f USING (code, d)) j, LATERAL (VALUES "
    + ", ".join(f"('{m}', {h}, {m}, fwd_{h})" for m in METRICS for h in HORIZONS) + ") AS v(metric, horizon, x, y) WHERE x IS NOT NULL AND y IS NOT NULL")
cte("edges", "panel", """
SELECT metric, horizon, list_distinct(list(e)) AS edges FROM (SELECT metric, horizon, unnest(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS e
FROM panel GROUP BY metric, horizon HAVING count(*) >= 3000) q GROUP BY metric, horizon""")
cte("buckets", "panel edges", """
SELECT metric, horizon, greatest(len(list_filter(edges, lambda e: e < x)) - 1, 0) AS bucket, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS std, min(x) AS lo, max(x) AS hi
FROM panel JOIN edges USING (metric, horizon) GROUP BY ALL""")


def forward(t):
    return W.with_forward_returns(t.bars, HORIZONS).select("code", "d", *[f"fwd_{h}" for h in HORIZONS])


@query("c28_factor_deciles", f"""SELECT metric, horizon, CAST(bucket AS INTEGER) AS bucket, n, {r('mean')} AS mean, {r('std')} AS std, {r('lo')} AS lo, {r('hi')} AS hi FROM buckets""", "buckets")
def c28(t):
    return rounded(ST.factor_deciles(t.signals, forward(t), METRICS, HORIZONS))


@query("a10_quantile_buckets", f"""SELECT CAST(bucket AS INTEGER) AS bucket, n, {r('mean')} AS mean, {r('std')} AS std, {r('lo')} AS lo, {r('hi')} AS hi FROM buckets
WHERE metric = 'volume_ratio' AND horizon = 5""", "buckets")
def a10(t):
    panel = ST.metric_panel(t.signals, forward(t), ["volume_ratio"], [5])
    return rounded(ST.quantile_buckets(panel, ["metric", "horizon"], "x", "y").drop("metric", "horizon"))


@query("a11_monotonicity", f"""SELECT metric, horizon, CAST(sum(n) AS BIGINT) AS n, count(*) AS buckets, {r('arg_min(mean, bucket)')} AS first_mean, {r('arg_max(mean, bucket)')} AS last_mean,
  {r('CASE WHEN count(*) >= 3 THEN corr(i, mean) END')} AS mono, {r('arg_max(mean, bucket) - arg_min(mean, bucket)')} AS spread
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY metric, horizon ORDER BY bucket) AS DOUBLE) AS i FROM buckets) b GROUP BY metric, horizon""", "buckets")
def a11(t):
    buckets = ST.factor_deciles(t.signals, forward(t), METRICS, HORIZONS)
    return rounded(ST.monotonicity(buckets, ["metric", "horizon"]))


@query("a13_horizon_baseline", f"""SELECT horizon, {r('avg(y)')} AS mean, count(*) AS n, {r('median(y)')} AS median FROM (SELECT {_FWD} FROM bars) f,
LATERAL (VALUES {', '.join(f'({h}, fwd_{h})' for h in HORIZONS)}) AS v(horizon, y) WHERE y IS NOT NULL GROUP BY horizon""", "bars")
def a13(t):
    return rounded(ST.horizon_baseline(forward(t), HORIZONS))


@query("j19_signals_with_forward", f"SELECT metric, horizon, count(*) AS n, {r('avg(x)')} AS mx, {r('avg(y)')} AS my FROM panel GROUP BY metric, horizon", "panel")
def j19(t):
    panel = ST.metric_panel(t.signals, forward(t), METRICS, HORIZONS)
    return rounded(panel.groupBy("metric", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")))


# ---- rebalancing --------------------------------------------------------------------------------

def period_cte(target, keys, last="(SELECT max(d) FROM bars)"):
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    on = "".join(f" AND a.{x} = b.{x}" for x in keys)
    sell, buy = num(K.SELL_COST), num(K.BUY_COST)
    return f"""
SELECT *, (1 + gross) * (1 - cost) - 1 AS net FROM (
WITH held AS (SELECT {''.join(f't.{x}, ' for x in keys)}t.d, t.code, f.next_d AS fill, b.o AS mark FROM {target} t JOIN cal f ON f.d = t.d JOIN bars b ON b.code = t.code AND b.d = f.next_d WHERE b.o > 0),
eff AS (SELECT {k}d, lag(d) OVER ({part} ORDER BY d) AS pd, lead(d) OVER ({part} ORDER BY d) AS nd FROM (SELECT DISTINCT {k}d FROM held) q),
h AS (SELECT a.*, b.pd, b.nd FROM held a JOIN eff b ON a.d = b.d{on}),
x AS (SELECT h.*, nb.o AS nopen, lb.c AS lclose,
  EXISTS (SELECT 1 FROM held b WHERE b.d = h.pd AND b.code = h.code{on.replace('a.', 'h.')}) AS was, EXISTS (SELECT 1 FROM held b WHERE b.d = h.nd AND b.code = h.code{on.replace('a.', 'h.')}) AS stays
  FROM h LEFT JOIN cal nf ON nf.d = h.nd LEFT JOIN bars nb ON nb.code = h.code AND nb.d = nf.next_d AND nb.o > 0
  LEFT JOIN bars lb ON lb.code = h.code AND lb.d = {last} AND lb.c > 0),
p AS (SELECT {k}d, pd, nd, count(nopen) AS nn, avg(nopen / mark - 1) AS gn, count(lclose) AS nl, avg(lclose / mark) - 1 AS gl,
  sum(CASE WHEN NOT stays THEN 1.0 ELSE 0.0 END) / count(*) AS sold, sum(CASE WHEN NOT was THEN 1.0 ELSE 0.0 END) / count(*) AS bought FROM x GROUP BY {k}d, pd, nd)
SELECT {k}d, 0 AS final, CASE WHEN pd IS NULL THEN 0 ELSE lag(nn) OVER w END AS n, CASE WHEN pd IS NULL THEN 0.0 ELSE coalesce(lag(gn) OVER w, 0.0) END AS gross,
  CASE WHEN pd IS NULL THEN 0.0 ELSE lag(sold) OVER w END * {sell} + bought * {buy} AS cost FROM p WINDOW w AS ({part} ORDER BY d)
UNION ALL SELECT {k}d, 1, nl, gl, {sell} FROM p WHERE nd IS NULL AND nl > 0) z"""


cte("cal", "bars", "SELECT d, lead(d) OVER (ORDER BY d) AS next_d FROM (SELECT DISTINCT d FROM bars) x")
cte("periods", "targets cal bars", period_cte("targets", ["kind"]))
PERIOD_COLS = f"d, final, n, {r('gross')} AS gross, {r('cost', 9)} AS cost, {r('net')} AS net"


def all_targets(t):
    from tidemark.operators.fundamentals import quality_score

    p = pin(pool(t, TURNOVER), "pool")
    out = None
    for kind in ("quality", "value", "combo"):
        top = top_per_day(quality_score(p, kind), [F.col("score").desc(), F.col("code")], 5)
        part = top.select(F.lit(kind).alias("kind"), "d", "code")
        out = part if out is None else out.unionByName(part)
    return pin(out, "targets")


@query("c13_rebalance_periods", f"SELECT kind, {PERIOD_COLS} FROM periods", "periods")
def c13(t):
    out = R.rebalance_periods(all_targets(t), days(t), t.bars, ["kind"])
    return rounded(out.select("kind", "d", "final", "n", "gross", "cost", "net"), 6, cost=9)


cte("pools", "pool bars shares rebal", f"""
SELECT 'filtered' AS kind, d, code FROM pool UNION ALL
SELECT 'all', b.d, b.code FROM bars b JOIN rebal ON rebal.d = b.d JOIN LATERAL (SELECT issued FROM shares s WHERE s.code = b.code AND s.issued > 0
  AND s.period <= CAST(year(b.d) - 1 AS VARCHAR) || 'Q4' ORDER BY s.period DESC LIMIT 1) s ON TRUE WHERE b.c * CAST(s.issued AS DOUBLE) >= {QCAP}""")
cte("pool_periods", "pools cal bars", period_cte("pools", ["kind"]))


@query("c13_market_pools", f"SELECT kind, {PERIOD_COLS} FROM pool_periods", "pool_periods")
def c13_pools(t):
    from tidemark.operators.fundamentals import cap_by_latest_shares

    priced = cap_by_latest_shares(t.bars.join(days(t).select("d"), "d", "left_semi"), t.shares)
    targets = R.market_pools(priced, pool(t), QCAP)
    out = R.rebalance_periods(targets, days(t), t.bars, ["kind"])
    return rounded(out.select("kind", "d", "final", "n", "gross", "cost", "net"), 6, cost=9)


@query("u02_set_changes", """SELECT kind, d, count(*) AS n, sum(CASE WHEN was THEN 0 ELSE 1 END)::BIGINT AS bought, sum(CASE WHEN stays THEN 0 ELSE 1 END)::BIGINT AS sold FROM (
  SELECT t.*, EXISTS (SELECT 1 FROM targets b WHERE b.kind = t.kind AND b.code = t.code AND b.d = e.pd) AS was, EXISTS (SELECT 1 FROM targets b WHERE b.kind = t.kind AND b.code = t.code AND b.d = e.nd) AS stays
  FROM targets t JOIN (SELECT kind, d, lag(d) OVER w AS pd, lead(d) OVER w AS nd FROM (SELECT DISTINCT kind, d FROM targets) x WINDOW w AS (PARTITION BY kind ORDER BY d)) e ON e.kind = t.kind AND e.d = t.d) y GROUP BY kind, d""", "targets")
def u02(t):
    out = R.set_changes(all_targets(t), ["kind"])
    return out.groupBy("kind", "d").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("kept_from_prev")).cast("bigint")).alias("bought"),
        F.sum((~F.col("kept_to_next")).cast("bigint")).alias("sold"))


def period_stats_sql(src, keys, per_year):
    return (f"SELECT {keys}, count(net) AS n, {r('avg(net) * 100')} AS mean_pct, {r('CASE WHEN count(net) > 1 AND stddev_samp(net) > 0 THEN avg(net) / (stddev_samp(net) / sqrt(count(net))) ELSE 0 END')} AS t_val, "
            f"{r('(product(1 + net) - 1) * 100')} AS compound_pct, {r(f'CASE WHEN product(1 + net) > 0 THEN (pow(product(1 + net), {float(per_year)} / count(net)) - 1) * 100 END')} AS annual_pct, "
            f"{r('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) * 100')} AS win_rate, {r('avg(n)')} AS avg_holdings FROM {src} GROUP BY {keys}")


@query("a15_period_statistics", period_stats_sql("periods", "kind", 12), "periods")
def a15(t):
    return rounded(ST.period_statistics(R.rebalance_periods(all_targets(t), days(t), t.bars, ["kind"]), ["kind"], 12))


_IDX = "(SELECT date_trunc('month', d) AS m, arg_max(c, d) AS c FROM (SELECT d, avg(c) AS c FROM bars GROUP BY d) a GROUP BY 1)"


@query("a16_index_benchmark", f"""SELECT start, "end", {r('(b / a - 1) * 100')} AS total_pct, {r('(pow(b / a, 1.0 / months) - 1) * 100')} AS monthly_pct FROM (
  SELECT start, "end", (year("end") - year(start)) * 12 + month("end") - month(start) AS months,
    (SELECT arg_max(c, m) FROM {_IDX} i WHERE i.m <= date_trunc('month', start)) AS a, (SELECT arg_max(c, m) FROM {_IDX} i WHERE i.m <= date_trunc('month', "end")) AS b
  FROM (SELECT min(d) AS start, max(d) AS "end" FROM bars GROUP BY year(d)) w) x WHERE months > 0""", "bars")
def a16(t):
    bars = t.bars
    index = bars.groupBy("d").agg(F.avg("c").alias("c"))
    spans = bars.groupBy(F.year("d")).agg(F.min("d").alias("start"), F.max("d").alias("end")).select("start", "end")
    out = ST.index_benchmark(index, spans).where(F.add_months("start", 1) <= F.last_day("end"))
    return rounded(out.where(F.trunc("start", "month") < F.trunc("end", "month")))


# ---- walk-forward -------------------------------------------------------------------------------

WINDOWS = [
    ("w1", date(1996, 1, 1), date(1997, 12, 31), date(1998, 1, 1), date(1998, 12, 31)),
    ("w2", date(1996, 1, 1), date(1998, 12, 31), date(1999, 1, 1), date(1999, 12, 31)),
    ("w3", date(1996, 1, 1), date(1999, 12, 31), date(2000, 1, 1), date(2000, 12, 31)),
    ("w4", date(1996, 1, 1), date(2000, 12, 31), date(2001, 1, 1), date(2001, 9, 30)),
]
_SPANS = ", ".join(f"('{w}', '{p}', DATE '{a}', DATE '{b}')" for w, ta, tb, va, vb in WINDOWS for p, a, b in (("train", ta, tb), ("test", va, vb)))


def variant_trades(t, k=2):
    """Best ``k`` of every day under each of the six factors, as independent trades."""
    cells = F.array(*[F.struct(F.lit(m).alias("variant"), F.round(m, 9).alias("x")) for m in METRICS])
    long = t.signals.select("code", "d", F.explode(cells).alias("v")).select("code", "d", "v.*").where(F.col("x").isNotNull())
    order = Window.partitionBy("variant", "d").orderBy("x", "code")
    top = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("x")
    return R.in_windows(O.barrier_outcomes(t.bars, top, stop_pct=STOP), WINDOWS).drop("span_end")


cte("variants", "signals bars", f"""
SELECT t.variant, t.rk AS rank, w."window", w.phase, o.* FROM (SELECT code, d, variant, row_number() OVER (PARTITION BY variant, d ORDER BY x, code) AS rk
  FROM signals, LATERAL (VALUES {', '.join(f"('{m}', round({m}, 9))" for m in METRICS)}) AS v(variant, x) WHERE x IS NOT NULL) t
JOIN ({outcome_sql(stop=STOP)}) o USING (code, d) JOIN (VALUES {_SPANS}) AS w("window", phase, a, b) ON o.d BETWEEN w.a AND w.b WHERE rk <= 2""")
cte("chosen", "variants", """
SELECT "window", coalesce(arg_max(variant, (m, variant)), 'heat_score') AS variant FROM (SELECT "window", variant, round(avg(ret), 12) AS m FROM variants WHERE phase = 'train' GROUP BY 1, 2 HAVING count(*) >= 30) x GROUP BY 1""")


@query("c14_walk_forward", stats_sql(f"""(SELECT 'selected' AS arm, v.* FROM variants v JOIN chosen c ON c."window" = v."window" AND c.variant = v.variant WHERE phase = 'test'
  UNION ALL SELECT 'control', * FROM variants WHERE phase = 'test' AND variant = 'heat_score') z""", "arm"), "variants chosen")
def c14(t):
    return rounded(R.walk_forward(variant_trades(t), 30, "heat_score")["summary"].drop("reasons"))


@query("a19_best_variant", 'SELECT "window", variant FROM chosen', "chosen")
def a19(t):
    return R.walk_forward(variant_trades(t), 30, "heat_score")["chosen"]


@query("u03_pooled_test_trades", f"""SELECT arm, code, d, {r('ret')} AS ret FROM (SELECT 'selected' AS arm, v.* FROM variants v JOIN chosen c ON c."window" = v."window" AND c.variant = v.variant WHERE phase = 'test'
  UNION ALL SELECT 'control', * FROM variants WHERE phase = 'test' AND variant = 'heat_score') z""", "variants chosen")
def u03(t):
    return rounded(R.walk_forward(variant_trades(t), 30, "heat_score")["trades"].select("arm", "code", "d", "ret"))


cte("wtargets", "targets", f"""
SELECT t.kind, t.d, t.code, w."window", w.phase, w.b AS span_end FROM targets t JOIN (VALUES {_SPANS}) AS w("window", phase, a, b) ON t.d BETWEEN w.a AND w.b""")
cte("wperiods", "wtargets cal bars", period_cte("wtargets", ["kind", '"window"', "phase"],
    f"""(SELECT max(z.d) FROM bars z JOIN (VALUES {_SPANS}) AS s("window", phase, a, b) ON z.d <= s.b WHERE s."window" = h."window" AND s.phase = h.phase)"""))
cte("wchosen", "wperiods", """
SELECT "window", arg_max(kind, (m, kind)) AS kind FROM (SELECT "window", kind, avg(net) * 100 AS m FROM wperiods WHERE phase = 'train' GROUP BY 1, 2 HAVING count(*) >= 8) x GROUP BY 1""")


def window_periods(t):
    """Rebalance periods of every score kind, started afresh in each window and phase."""
    targets = R.in_windows(all_targets(t), WINDOWS)
    out = R.rebalance_periods(targets, days(t), t.bars, ["kind", "window", "phase"], end="span_end")
    return pin(out.withColumnRenamed("kind", "variant"), "periods")


@query("c14_quality_walk_forward", period_stats_sql("""(SELECT 'selected' AS arm, p.* FROM wperiods p JOIN wchosen c ON c."window" = p."window" AND c.kind = p.kind WHERE phase = 'test'
  UNION ALL SELECT 'control', * FROM wperiods WHERE phase = 'test' AND kind = 'quality') z""", "arm", 12), "wperiods wchosen")
def c14_quality(t):
    return rounded(R.walk_forward_periods(window_periods(t), 8, "quality", "quality")["summary"])


PBR_CAPS = (("none", None), ("pbr100", 100.0), ("pbr200", 200.0), ("pbr300", 300.0))
_CAPS = ", ".join(f"('{n}', {'NULL::DOUBLE' if x is None else num(x)})" for n, x in PBR_CAPS)
cte("capped", "disclosures bars quarters caps08 signals", f"""
SELECT t.variant, w."window", w.phase, o.* FROM (SELECT variant, code, d, row_number() OVER (PARTITION BY variant, d ORDER BY rank, code) AS k
  FROM ({C05_SQL}) f LEFT JOIN (SELECT code, d, market_cap / equity AS pbr FROM caps08 WHERE equity > 0) p USING (code, d), (VALUES {_CAPS}) AS v(variant, most)
  WHERE most IS NULL OR pbr <= most) t
JOIN ({outcome_sql(stop=STOP, monitor=0, market=True)}) o USING (code, d) JOIN (VALUES {_SPANS}) AS w("window", phase, a, b) ON o.d BETWEEN w.a AND w.b WHERE k <= 5""")
cte("cap_chosen", "capped", """
SELECT "window", coalesce(arg_max(variant, (m, variant)), 'none') AS variant FROM (SELECT DISTINCT "window" FROM capped) n
LEFT JOIN (SELECT "window", variant, round(avg(ret), 12) AS m FROM capped WHERE phase = 'train' GROUP BY 1, 2) x USING ("window") GROUP BY 1""")


@query("c14_fundamental_walk_forward", stats_sql("""(SELECT 'selected' AS arm, v.* FROM capped v JOIN cap_chosen c ON c."window" = v."window" AND c.variant = v.variant WHERE phase = 'test'
  UNION ALL SELECT 'control', * FROM capped WHERE phase = 'test' AND variant = 'none') z""", "arm"), "capped cap_chosen")
def c14_fundamental(t):
    """The five best filers of each day under four PBR caps, as independent trades; the cap is selected on training windows."""
    from tidemark.operators import fundamentals as V

    caps = pin(V.pbr(V.market_caps(t.bars, t.shares, t.statements, sanity=800.0)).select("code", "d", "pbr"), "pbr")
    filers = pin(V.fundamental_candidates(t.disclosures, t.statements, t.bars, TURNOVER), "filers")
    filers = filers.join(caps, ["code", "d"], "left")
    parts = None
    for name, limit in PBR_CAPS:
        part = filers.where(FL.pbr_within(F.col("pbr"), limit)).select("code", "d", "rank", F.lit(name).alias("variant"))
        parts = part if parts is None else parts.unionByName(part)
    order = Window.partitionBy("variant", "d").orderBy("rank", "code")
    best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5)
    closed = O.barrier_outcomes(t.bars, best, stop_pct=STOP, monitor_from=0, count="market_days", min_hold=5)
    return rounded(R.walk_forward(R.in_windows(closed, WINDOWS).drop("span_end"), 1, "none")["summary"].drop("reasons"))


SWEEP_SPANS = {"train": ("1996-01-01", "1998-12-31"), "valid": ("1999-01-01", "2001-09-30")}
cte("judged", "bars signals", f"""
SELECT b.code, b.d, b.o, b.l, b.c, dense_rank() OVER (ORDER BY b.d) AS pos, row_number() OVER (PARTITION BY b.code ORDER BY b.d) AS seq, j.d IS NOT NULL AS judged, coalesce(q.pct >= 0.9, FALSE) AS hot,
  coalesce(count(j.d) OVER (PARTITION BY b.code ORDER BY b.d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS judged_before
FROM bars b LEFT JOIN (SELECT DISTINCT d FROM signals) j ON j.d = b.d LEFT JOIN (SELECT code, d, {_pr('credit_surge_ratio')} AS pct FROM signals) q ON q.code = b.code AND q.d = b.d""")


def judged_sql(flag):
    """First hit on judged bars alone, expiry before the signal; entries without one stay open."""
    stop = f"(e.entry_px * {num(1 - STOP)})"
    return f"""SELECT code, d, x.entry_d, x.entry_px, h.exit_d, h.held, h.exit_px / x.entry_px - 1 AS ret FROM (
  SELECT s.code, s.d, e.d AS entry_d, {BUYF.format('e.o')} AS entry_px FROM judged s JOIN judged e ON e.code = s.code AND e.seq = s.seq + 1 AND e.pos = s.pos + 1 WHERE e.o > 0) x
LEFT JOIN (SELECT e.code, e.d, arg_min(x.d, x.seq) AS exit_d, arg_min(x.pos - e.epos, x.seq) AS held,
    arg_min({SELLF.format(f'(CASE WHEN x.l <= {stop} THEN least({stop}, x.o) ELSE x.c END)')}, x.seq) AS exit_px
  FROM (SELECT s.code, s.d, e.pos AS epos, e.judged_before AS first, {BUYF.format('e.o')} AS entry_px FROM judged s JOIN judged e ON e.code = s.code AND e.seq = s.seq + 1) e
  JOIN judged x ON x.code = e.code AND x.judged AND x.judged_before BETWEEN e.first AND e.first + 20
  WHERE x.l <= {stop} OR {flag} OR x.pos - e.epos >= 20 GROUP BY e.code, e.d) h USING (code, d)"""


def _best_sql(metric, k):
    return f"SELECT code, d FROM (SELECT code, d, row_number() OVER (PARTITION BY d ORDER BY round({metric}, 9), code) AS k FROM signals WHERE {metric} IS NOT NULL) x WHERE k <= {k}"


_PHASE = "CASE " + " ".join(f"WHEN d BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in SWEEP_SPANS.items()) + " END"
C15_SQL = f"""WITH RECURSIVE plain AS MATERIALIZED (SELECT *, {_PHASE} AS "window" FROM ({judged_sql('FALSE')}) z), exiting AS MATERIALIZED (SELECT *, {_PHASE} AS "window" FROM ({judged_sql('x.hot')}) z),
pool AS MATERIALIZED (SELECT p.*, row_number() OVER (PARTITION BY "window", code ORDER BY d) AS i FROM plain p JOIN (SELECT code, d FROM signals WHERE heat_score IS NOT NULL) s USING (code, d) WHERE "window" IS NOT NULL),
nxt AS MATERIALIZED (SELECT n."window", n.code, n.i, m.i AS j FROM pool n ASOF JOIN (SELECT "window", code, d, i FROM pool) m ON m."window" = n."window" AND m.code = n.code AND n.exit_d <= m.d),
walk("window", code, i) AS (SELECT "window", code, min(i) FROM pool GROUP BY 1, 2 UNION ALL SELECT w."window", w.code, x.j FROM walk w JOIN nxt x ON x."window" = w."window" AND x.code = w.code AND x.i = w.i),
trades AS (SELECT 'base5' AS variant, p.* FROM plain p JOIN ({_best_sql('heat_score', 5)}) b USING (code, d) UNION ALL SELECT 'slot2', p.* FROM plain p JOIN ({_best_sql('heat_score', 2)}) b USING (code, d)
  UNION ALL SELECT 'credit', p.* FROM plain p JOIN ({_best_sql('credit_surge_ratio', 5)}) b USING (code, d) UNION ALL SELECT 'exit', p.* FROM exiting p JOIN ({_best_sql('credit_surge_ratio', 5)}) b USING (code, d)
  UNION ALL SELECT 'pool', p.code, p.d, p.entry_d, p.entry_px, p.exit_d, p.held, p.ret, p."window" FROM pool p JOIN walk w ON w."window" = p."window" AND w.code = p.code AND w.i = p.i)
""" + stats_sql("trades", 'variant, "window"', where='WHERE exit_d IS NOT NULL AND "window" IS NOT NULL')


@query("c15_hypothesis_sweep", C15_SQL, "judged signals")
def c15(t):
    """Variants of the best entries of each day, and the pool of all entries, over a training and a validation span."""
    signals = pin(t.signals, "signals")
    judged = signals.select("d", F.lit(True).alias("judged")).distinct()
    ranks = percentile_rank(signals.select("code", "d", "credit_surge_ratio"), ["d"], "credit_surge_ratio", "pct")
    bars = pin(t.bars.join(judged, "d", "left").withColumn("judged", F.coalesce("judged", F.lit(False))), "bars")
    rules = dict(stop_pct=STOP, monitor_from=0, count="market_days", expiry_first=True, keep_open=True)
    plain = pin(O.outcome_table(bars, **rules), "outcomes")
    hot = ranks.select("code", "d", (F.col("pct") >= 0.9).alias("exit_flag"))
    exiting = pin(O.outcome_table(bars.join(hot, ["code", "d"], "left"), **rules), "outcomes")
    best = {"base5": 5, "slot2": 2, "credit": 5, "exit": 5, "pool": None}
    metric = {"base5": "heat_score", "slot2": "heat_score", "credit": "credit_surge_ratio", "exit": "credit_surge_ratio", "pool": "heat_score"}
    parts = None
    for name, limit in best.items():
        rows = signals.where(FL.rankable(F.col(metric[name]))).select("code", "d", F.round(metric[name], 9).alias("x"))
        if limit is None:
            rows = rows.select("code", "d", F.lit(1).alias("rank"))
        else:
            rows = top_per_day(rows, [F.col("x"), F.col("code")], limit).select("code", "d", "rank")
        rows = rows.join(exiting if name == "exit" else plain, ["code", "d"], "left").withColumn("variant", F.lit(name))
        parts = rows if parts is None else parts.unionByName(rows)
    cells = F.when(F.col("d").between(*SWEEP_SPANS["train"]), "train").when(F.col("d").between(*SWEEP_SPANS["valid"]), "valid")
    parts = parts.withColumn("window", cells).where(F.col("window").isNotNull())
    return rounded(ST.trade_statistics(R.hypothesis_sweep(parts, best), ["variant", "window"]).drop("reasons"))
