"""Registered queries: signals, rolling windows and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import heat as H
from tidemark.functions.nulls import finite_or_null
from tidemark.operators import filters as FL
from tidemark.operators import signals as S
from tidemark.operators import windows as W
from tidemark.plans.domain_sql import full_avg, r
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources.tables import select_bars


PRICES = ("o", "h", "l", "c", "close", "last_c", "next_o", "prev_c", "entry_px", "exit_px", "stop_px", "price", "current_px")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, for comparison across engines; raw prices keep eight digits."""
    return df.select(*[
        F.round(F.col(c), special.get(c, 8 if c in PRICES else digits)).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ])


DAY = "1999-06-30"
TURNOVER = 60_000.0
CAP = 2e8
SIGNAL_COLS = ("individual_flow_ratio", "credit_surge_ratio", "volume_ratio", "foreign_flow_ratio",
               "institution_flow_ratio", "credit_ratio_level", "heat_score")
SIGNAL_SELECT = "code, d, " + ", ".join(f"{r(c)} AS {c}" for c in SIGNAL_COLS) + ", signal"


@query("c02_signals_history", f"SELECT {SIGNAL_SELECT} FROM signals", "signals")
def c02(t):
    return rounded(S.signals_history(t.bars, t.flows, t.credit))


RANGE = ("1998-03-01", "1998-05-31")


@query("c02_signals_range", f"SELECT {SIGNAL_SELECT} FROM signals WHERE d BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'", "signals")
def c02_range(t):
    """Three months, read with their warm-up alone."""
    return rounded(S.signals_history(t.bars, t.flows, t.credit, *RANGE))


@query("c02_incremental", f"SELECT {SIGNAL_SELECT} FROM signals", "signals")
def c02_incremental(t):
    """The history in five batches of whole days, each from the stored state of the one before; the last one is delivered twice."""
    folder = f"{shared_folder(t.spark)}/increments/{uuid.uuid4().hex}"
    cuts = [None, "1995-02-01", "1996-06-30", "1999-01-01", "2001-07-01", None]
    parts = [(F.lit(True) if a is None else F.col("d") >= F.lit(a).cast("date")) & (F.lit(True) if b is None else F.col("d") < F.lit(b).cast("date")) for a, b in zip(cuts, cuts[1:])]
    for number, part in enumerate([*parts, parts[-1]], 1):
        S.advance_signals(folder, number, *(x.where(part) for x in (t.bars, t.flows, t.credit)))
    return rounded(S.stored_signals(t.spark, folder))


def _latest_sql(src, values):
    cols = []
    for name, x in values.items():
        cols += [f"max(CASE WHEN rn = 1 THEN {x} END) AS {name}_now", f"avg(CASE WHEN rn > 1 THEN {x} END) AS {name}_mean",
                 f"avg(CASE WHEN rn > 1 THEN abs({x}) END) AS {name}_abs"]
    return (f"SELECT code, count(*) AS n, {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS rn "
            f"FROM {src} WHERE d <= DATE '{DAY}') z WHERE rn <= 31 GROUP BY code")


_FLOW = {x: f"CAST({x}_net AS DOUBLE)" for x in ("individual", "foreign", "institution")}
C01_SQL = f"""
WITH b AS ({_latest_sql('bars', {'amt': 'c * CAST(v AS DOUBLE)'})}), f AS ({_latest_sql('flows', _FLOW)}),
k AS ({_latest_sql('credit', {'cr': 'CAST(credit_amt AS DOUBLE)', 'lvl': 'credit_ratio'})}),
x AS (SELECT bars.code, d,
  {', '.join(f"CASE WHEN f.n >= 31 AND {x}_abs > 0 THEN {x}_now / {x}_abs END AS {x}_flow_ratio" for x in _FLOW)},
  CASE WHEN k.n >= 31 AND cr_mean > 0 THEN cr_now / cr_mean END AS credit_surge_ratio, lvl_now AS credit_ratio_level,
  CASE WHEN amt_mean > 0 THEN amt_now / amt_mean END AS volume_ratio
  FROM bars JOIN b ON b.code = bars.code AND b.n >= 31 LEFT JOIN f ON f.code = bars.code LEFT JOIN k ON k.code = bars.code
  WHERE d = DATE '{DAY}'),
y AS (SELECT *, CASE WHEN individual_flow_ratio IS NULL THEN 0.0 ELSE greatest(-4.0, least(4.0, (individual_flow_ratio - 1.0) * 3.0)) END
  + CASE WHEN credit_surge_ratio IS NULL THEN 0.0 ELSE greatest(-3.0, least(3.0, (credit_surge_ratio - 1.0) * 3.0)) END
  + CASE WHEN volume_ratio IS NULL THEN 0.0 ELSE greatest(-3.0, least(3.0, (volume_ratio - 1.5) * 2.0)) END AS heat_score FROM x)
SELECT code, d, {', '.join(f"{r(c)} AS {c}" for c in SIGNAL_COLS)},
  CASE WHEN heat_score >= 8.5 THEN 'sell' WHEN heat_score >= 7 THEN 'avoid' ELSE 'neutral' END AS signal FROM y"""


@query("c01_signals_on_day", C01_SQL, "bars flows credit")
def c01(t):
    return rounded(S.signals_on(t.bars, t.flows, t.credit, DAY))


_P = "(PARTITION BY code ORDER BY d ROWS BETWEEN {} PRECEDING AND {})"
_LAG1 = "(c / nullif(lag(c) OVER (PARTITION BY code ORDER BY d), 0) - 1)"


def _ratio_sql(x, n):
    return f"CASE WHEN {full_avg(x, n)} > 0 THEN {x} / {full_avg(x, n)} END"


def _pos_sql(n, least_rows):
    w = _P.format(n, "1 PRECEDING")
    return (f"CASE WHEN count(l) OVER {w} >= {least_rows} AND max(h) OVER {w} > min(l) OVER {w} "
            f"THEN (c - min(l) OVER {w}) / (max(h) OVER {w} - min(l) OVER {w}) END")


_W20 = _P.format(19, "CURRENT ROW")
C30_SQL = f"""
WITH x AS (SELECT *, {_LAG1} AS ret FROM bars)
SELECT code, d, {', '.join(f"{r(c, 8)} AS {c}" for c in 'ohlc')}, v, {r('ret')} AS ret, {r(full_avg('c', 20, last=0))} AS sma20,
  {r(full_avg('c', 60, last=0))} AS sma60,
  {r(f'CASE WHEN count(ret) OVER {_W20} = 20 THEN stddev_pop(ret) OVER {_W20} END')} AS vol20,
  {r(_ratio_sql('CAST(v AS DOUBLE)', 30))} AS vr30, {r(_ratio_sql('(c * CAST(v AS DOUBLE))', 30))} AS ar30, {r(_pos_sql(252, 252))} AS pos52w
FROM x"""


@query("c30_indicator_panel", C30_SQL, "bars")
def c30(t):
    return rounded(W.indicator_panel(t.bars))


@query("w01_sma", f"SELECT code, d, {r(full_avg('c', 20, last=0))} AS sma20, {r(full_avg('c', 60, last=0))} AS sma60 FROM bars", "bars")
def w01(t):
    return rounded(t.bars.select("code", "d", W.sma(F.col("c"), 20).alias("sma20"), W.sma(F.col("c"), 60).alias("sma60")))


@query("w02_rolling_std", f"""SELECT code, d, {r(f'CASE WHEN count(ret) OVER {_W20} = 20 THEN stddev_pop(ret) OVER {_W20} END')} AS vol20
FROM (SELECT *, {_LAG1} AS ret FROM bars) x""", "bars")
def w02(t):
    base = t.bars.withColumn("ret", W.daily_return(F.col("c")))
    return rounded(base.select("code", "d", W.rolling_std(F.col("ret"), 20).alias("vol20")))


@query("w03_volume_ratio", f"SELECT code, d, {r(_ratio_sql('CAST(v AS DOUBLE)', 30))} AS vr30 FROM bars", "bars")
def w03(t):
    return rounded(t.bars.select("code", "d", W.prior_ratio(F.col("v").cast("double"), 30).alias("vr30")))


@query("w04_position_52w", f"""SELECT code, d, {r(_pos_sql(252, 252))} AS exact252, {r(_pos_sql(251, 1))} AS any251, {r(_pos_sql(252, 60))} AS min60
FROM bars""", "bars")
def w04(t):
    both = W.with_prior_range(W.with_prior_range(t.bars, 252, "_year"), 251, "_less")
    return rounded(both.select("code", "d", W.range_position(252, prefix="_year").alias("exact252"), W.range_position(251, 1, "_less").alias("any251"),
                               W.range_position(252, 60, "_year").alias("min60")))


@query("w05_daily_return", f"SELECT code, d, {r(_LAG1)} AS ret FROM bars", "bars")
def w05(t):
    return rounded(t.bars.select("code", "d", W.daily_return(F.col("c")).alias("ret")))


_IND = "CAST(individual_net AS DOUBLE)"


@query("w06_abs_mean_ratio", f"""SELECT code, d, {r(f"CASE WHEN {full_avg(f'abs({_IND})', 30)} > 0 THEN {_IND} / {full_avg(f'abs({_IND})', 30)} END")} AS flow_ratio
FROM flows""", "flows")
def w06(t):
    return rounded(t.flows.select("code", "d", W.prior_abs_ratio(F.col("individual_net").cast("double")).alias("flow_ratio")))


@query("w07_surge_ratio", f"SELECT code, d, {r(_ratio_sql('CAST(credit_amt AS DOUBLE)', 30))} AS surge FROM credit", "credit")
def w07(t):
    return rounded(t.credit.select("code", "d", W.prior_ratio(F.col("credit_amt").cast("double")).alias("surge")))


@query("w08_forward_fill", f"""SELECT code, d, last_value(credit_amt IGNORE NULLS) OVER (PARTITION BY code ORDER BY d) AS credit_amt,
  {r('last_value(credit_ratio IGNORE NULLS) OVER (PARTITION BY code ORDER BY d)')} AS credit_ratio
FROM bars LEFT JOIN credit USING (code, d)""", "bars credit")
def w08(t):
    both = t.bars.join(t.credit, ["code", "d"], "left")
    return rounded(both.select("code", "d", *[W.carried(F.col(x)).alias(x) for x in ("credit_amt", "credit_ratio")]))


HORIZONS = (1, 3, 5, 10, 20)


def fwd_sql(h):
    w = "OVER (PARTITION BY code ORDER BY d)"
    return f"CASE WHEN lead(o, 1) {w} > 0 THEN lead(c, {1 + h}) {w} / lead(o, 1) {w} - 1 END"


@query("w11_forward_return", f"SELECT code, d, {', '.join(f'{r(fwd_sql(h))} AS fwd_{h}' for h in HORIZONS)} FROM bars", "bars")
def w11(t):
    return rounded(W.with_forward_returns(t.bars, HORIZONS).select("code", "d", *[f"fwd_{h}" for h in HORIZONS]))


@query("w17_return_since", f"""SELECT code, d, {r('c / nullif(lag(c, 59) OVER w, 0) - 1')} AS r60, {r('c / nullif(lag(c, 249) OVER w, 0) - 1')} AS r250
FROM bars WINDOW w AS (PARTITION BY code ORDER BY d)""", "bars")
def w17(t):
    c = F.col("c")
    return rounded(t.bars.select("code", "d", W.return_since(c, 59).alias("r60"), W.return_since(c, 249).alias("r250")))


PROXY = "000070"


@query("w18_proxy_trend", f"""SELECT d, {r('coalesce((c / nullif(lag(c, 19) OVER (ORDER BY d), 0) - 1) * 100, 0)')} AS trend_pct
FROM bars WHERE code = '{PROXY}'""", "bars")
def w18(t):
    return rounded(t.bars.where(F.col("code") == PROXY).select("d", W.trend(F.col("c")).alias("trend_pct")))


@query("w20_bar_index", "SELECT code, d, row_number() OVER (PARTITION BY code ORDER BY d) AS bar_no FROM bars", "bars")
def w20(t):
    return t.bars.select("code", "d", W.bar_index().alias("bar_no"))


@query("j12_aligned_sources", f"""SELECT code, d, {r('c', 8)} AS c, v, individual_net, foreign_net, institution_net, credit_amt, {r('credit_ratio')} AS credit_ratio
FROM bars LEFT JOIN flows USING (code, d) LEFT JOIN credit USING (code, d)""", "bars flows credit")
def j12(t):
    return rounded(S.aligned_sources(t.bars, t.flows, t.credit).drop("o", "h", "l"))


@query("j03_signals_with_bars", f"""SELECT code, d, {r('heat_score')} AS heat_score, signal, {r('institution_flow_ratio')} AS rank_value, {r('c', 8)} AS close
FROM signals JOIN bars USING (code, d)""", "signals bars")
def j03(t):
    out = S.signals_history(t.bars, t.flows, t.credit, keep=("c",))
    return rounded(out.select("code", "d", "heat_score", "signal", F.col("institution_flow_ratio").alias("rank_value"), F.col("c").alias("close")))


def _contrib(x, base, slope, bound):
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(-{bound}, least({bound}, ({x} - {base}) * {slope})) END"


@query("p02_contributions", f"""SELECT code, d, {r(_contrib('individual_flow_ratio', 1.0, 3.0, 4.0))} AS flow, {r(_contrib('credit_surge_ratio', 1.0, 3.0, 3.0))} AS credit,
  {r(_contrib('volume_ratio', 1.5, 2.0, 3.0))} AS volume FROM signals""", "signals")
def p02(t):
    return rounded(t.signals.select(
        "code", "d", H.contribution(F.col("individual_flow_ratio"), H.FLOW).alias("flow"),
        H.contribution(F.col("credit_surge_ratio"), H.CREDIT).alias("credit"),
        H.contribution(F.col("volume_ratio"), H.VOLUME).alias("volume")))


@query("p03_heat_label", f"SELECT signal, count(*) AS n, {r('min(heat_score)')} AS lo, {r('max(heat_score)')} AS hi FROM signals GROUP BY signal", "signals")
def p03(t):
    return rounded(t.signals.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n"), F.min("heat_score").alias("lo"), F.max("heat_score").alias("hi")))


@query("p04_finite_or_null", f"""SELECT l_linenumber, count(x) AS finite, count(*) AS total, {r('sum(x)', 2)} AS s FROM (
  SELECT l_linenumber, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS x FROM lineitem) t GROUP BY l_linenumber""")
def p04(t):
    # Division by a zero discount gives NaN or infinity here, which must count as missing.
    raw = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).when(
        F.col("l_tax") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    x = t.raw("lineitem").select("l_linenumber", finite_or_null(raw).alias("x"))
    return rounded(x.groupBy("l_linenumber").agg(F.count("x").alias("finite"), F.count(F.lit(1)).alias("total"), F.sum("x").alias("s")), 2)


# ---- filters ------------------------------------------------------------------------------------

@query("f01_ordinary", "SELECT code, n_name AS name FROM nat WHERE regexp_full_match(code, '[0-9]+')", "nat")
def f01(t):
    return t.instruments.where(FL.is_ordinary(F.col("code"))).select("code", "name")


TURN20 = f"avg(c * CAST(v AS DOUBLE)) OVER {_W20}"


@query("f02_liquid_history", f"SELECT code, d FROM (SELECT code, d, {TURN20} AS t FROM bars) x WHERE t >= {TURNOVER}", "bars")
def f02(t):
    return t.bars.select("code", "d", FL.turnover_mean().alias("t")).where(F.col("t") >= TURNOVER).select("code", "d")


LIQUID_ON = f"""SELECT code, avg(t) AS turnover FROM (SELECT code, c * CAST(v AS DOUBLE) AS t, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS rn
FROM bars WHERE d <= DATE '{DAY}') x WHERE rn <= 20 GROUP BY code HAVING avg(t) >= {TURNOVER}"""


@query("f02_liquid_on_day", f"SELECT code, {r('turnover', 4)} AS turnover FROM ({LIQUID_ON}) y", "bars")
def f02_day(t):
    return rounded(FL.liquid_on(t.bars, DAY, TURNOVER), 4)


CAPS = """SELECT code, d, c, c * CAST(issued AS DOUBLE) AS market_cap FROM bars LEFT JOIN LATERAL (
  SELECT issued FROM shares s WHERE s.code = bars.code AND CAST(substr(period, 1, 4) AS INTEGER) <= year(bars.d) - 1 ORDER BY period DESC LIMIT 1) k ON TRUE"""


@query("f03_cap_floor", f"SELECT code, d, {r('market_cap', 2)} AS market_cap FROM ({CAPS}) x WHERE market_cap >= {CAP}", "bars shares")
def f03(t):
    from tidemark.operators.fundamentals import dated_market_cap

    caps = dated_market_cap(t.bars, t.shares)
    return rounded(caps.where(FL.large_enough(F.col("market_cap"), CAP)).select("code", "d", "market_cap"), 2)


@query("f04_tradable", f"""SELECT code FROM nat WHERE regexp_full_match(code, '[0-9]+') AND code IN (SELECT code FROM ({LIQUID_ON}) y)
AND code IN (SELECT code FROM ({CAPS}) x WHERE d = DATE '{DAY}' AND market_cap >= {CAP})""", "nat bars shares")
def f04(t):
    from tidemark.operators.fundamentals import dated_market_cap

    caps = dated_market_cap(t.bars.where(F.col("d") == F.lit(DAY).cast("date")), t.shares)
    return FL.tradable_on(t.instruments.select("code"), t.bars, DAY, TURNOVER, caps, CAP)


@query("f05_rankable", "SELECT d, count(*) AS n FROM signals WHERE institution_flow_ratio IS NOT NULL AND isfinite(institution_flow_ratio) GROUP BY d", "signals")
def f05(t):
    return t.signals.where(FL.rankable(F.col("institution_flow_ratio"))).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query("f06_earnings_reports", """SELECT DISTINCT d FROM disclosures WHERE report_nm LIKE '분기보고서%' OR report_nm LIKE '반기보고서%'
OR report_nm LIKE '사업보고서%'""", "disclosures")
def f06(t):
    return t.disclosures.where(FL.is_earnings_report(F.col("report_nm"))).select("d").distinct()


@query("f09_superset_universe", f"""SELECT p.code FROM (SELECT code, max(c) AS mc FROM bars GROUP BY code) p
JOIN (SELECT code, max(issued) AS mi FROM shares GROUP BY code) s ON s.code = p.code
WHERE mc * mi >= {CAP * 2} AND p.code IN (SELECT code FROM signals)""", "bars shares signals")
def f09(t):
    return FL.superset_universe(t.bars, t.shares, t.signals, CAP * 2)


@query("f11_entry_gate", "SELECT code, d FROM signals WHERE heat_score < 7 AND signal = 'neutral' AND d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", "signals")
def f11(t):
    return t.signals.where(FL.entry_gate(7.0, "1996-01-01", "1999-12-31")).select("code", "d")


@query("f14_valid_price", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_extendedprice * l_discount > 0 GROUP BY l_returnflag")
def f14(t):
    li = t.raw("lineitem")
    return li.where(FL.valid_price(F.col("l_extendedprice") * F.col("l_discount"))).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("s01_bar_scan", f"""SELECT code, d, {', '.join(f"{r(c, 8)} AS {c}" for c in 'ohlc')}, v FROM bars
WHERE d BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND code IN ('000010', '000120')""", "bars")
def s01(t):
    return rounded(select_bars(t.bars, ["000010", "000120"], "1998-01-01", "1999-12-31"))
