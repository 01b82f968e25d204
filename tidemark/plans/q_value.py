"""Registered queries: periods, statements, share counts, valuation and quality targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import nulls as N
from tidemark.functions import periods as P
from tidemark.operators import calendar as C
from tidemark.operators import filters as FL
from tidemark.operators import fundamentals as V
from tidemark.operators.ordered import percentile_rank
from tidemark.plans.domain_sql import cte, r
from tidemark.plans.q_signals import CAP, CAPS, DAY, TURN20, TURNOVER, rounded
from tidemark.plans.registry import query

AMOUNTS = ("revenue", "op_income", "net_income", "assets", "liabilities", "equity")


def money(names, digits=6):
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


@query("p05_report_period", """SELECT report_nm, code, CASE WHEN m <> '' THEN regexp_extract(report_nm, '\\((\\d{4})\\.', 1) || 'Q' ||
  CASE m WHEN '03' THEN '1' WHEN '06' THEN '2' WHEN '09' THEN '3' ELSE '4' END END AS period
FROM (SELECT *, regexp_extract(report_nm, '\\(\\d{4}\\.(03|06|09|12)\\)', 1) AS m FROM disclosures) x""", "disclosures")
def p05(t):
    return t.disclosures.select("report_nm", "code", P.report_period(F.col("report_nm")).alias("period"))


@query("p06_year_before", "SELECT code, period, CAST(CAST(substr(period, 1, 4) AS INTEGER) - 1 AS VARCHAR) || substr(period, 5) AS prev FROM statements", "statements")
def p06(t):
    return t.statements.select("code", "period", P.year_before(F.col("period")).alias("prev"))


@query("p07_annual_period", """SELECT d, count(*) AS n, CAST(CASE WHEN month(d) >= 4 THEN year(d) - 1 ELSE year(d) - 2 END AS VARCHAR) || 'Q4' AS by_filing,
  CAST(year(d) - 1 AS VARCHAR) || 'Q4' AS by_year FROM li GROUP BY d""", "li")
def p07(t):
    return t.lines.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select(
        "d", "n", P.annual_period_known(F.col("d")).alias("by_filing"), P.annual_period_known(F.col("d"), "prev_year").alias("by_year"))


@query("p08_latest_report", """SELECT d, n, CASE WHEN m >= 5 THEN y WHEN m >= 4 THEN y - 1 ELSE y - 2 END AS year,
  CASE WHEN m >= 11 THEN '11014' WHEN m >= 8 THEN '11012' WHEN m >= 5 THEN '11013' ELSE '11011' END AS report
FROM (SELECT d, count(*) AS n, CAST(month(d) AS INTEGER) AS m, CAST(year(d) AS INTEGER) AS y FROM li GROUP BY d) x""", "li")
def p08(t):
    return t.lines.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d", "n", P.latest_report(F.col("d")).alias("r")).select("d", "n", "r.*")


@query("p09_available_on", """SELECT code, period, CAST(last_day(make_date(CAST(substr(period, 1, 4) AS INTEGER), CAST(substr(period, 6, 1) AS INTEGER) * 3, 1)) + 90 AS DATE) AS avail
FROM statements""", "statements")
def p09(t):
    return t.statements.select("code", "period", P.available_on(P.year_of(F.col("period")), P.quarter_of(F.col("period"))).alias("avail"))


@query("p26_quarter_label", "SELECT CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS quarter, count(*) AS n FROM li GROUP BY 1", "li")
def p26(t):
    return t.lines.groupBy(P.quarter_label(F.col("d")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("p12_ratios", f"""SELECT code, period, {r('op_income / nullif(revenue, 0)')} AS margin, {r('net_income / nullif(equity, 0)')} AS roe,
  {r('liabilities / nullif(equity, 0)')} AS debt_ratio, {r('assets / nullif(net_income, 0)')} AS per, {r('assets / nullif(equity, 0)')} AS pbr,
  {r('net_income / nullif(assets, 0)')} AS earnings_yield, {r('equity / nullif(assets, 0)')} AS book_yield FROM statements""", "statements")
def p12(t):
    c = F.col
    ratios = N.financial_ratios(c("revenue"), c("op_income"), c("net_income"), c("equity"), c("liabilities"), c("assets"))
    return rounded(t.statements.select("code", "period", *[x.alias(n) for n, x in ratios.items()]))


@query("w22_preferred_statement", f"SELECT code, period, fs_div, {money(AMOUNTS)} FROM statements", "statements")
def w22(t):
    return rounded(V.preferred(t.financials))


cte("quarters", "statements", """
SELECT *, CAST(substr(period, 1, 4) AS INTEGER) AS y, CAST(substr(period, 6, 1) AS INTEGER) AS q FROM statements""")
cte("standalone", "quarters", "SELECT *, " + ", ".join(
    f"CASE WHEN q <= 3 THEN {x} ELSE {x} - sum(CASE WHEN q <= 3 THEN {x} END) OVER (PARTITION BY code, y) END AS {x}_q"
    for x in V.FLOW_ITEMS) + " FROM quarters")
_TTM = "(PARTITION BY code ORDER BY y, q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
cte("ttm", "standalone", "SELECT *, " + ", ".join(
    f"CASE WHEN count({x}_q) OVER {_TTM} = 4 THEN sum({x}_q) OVER {_TTM} END AS {x}_ttm" for x in V.FLOW_ITEMS)
    + ", CAST(last_day(make_date(y, q * 3, 1)) + 90 AS DATE) AS avail FROM standalone")


@query("w10_standalone_quarter", f"SELECT code, period, {money([f'{x}_q' for x in V.FLOW_ITEMS])} FROM standalone", "standalone")
def w10(t):
    out = V.standalone_quarters(t.statements)
    return rounded(out.select("code", "period", *[f"{x}_q" for x in V.FLOW_ITEMS]))


@query("w10_year_to_date_quarter", f"""SELECT code, period, {r('CASE WHEN q = 1 THEN revenue WHEN lag(q) OVER w = q - 1 THEN revenue - lag(revenue) OVER w END')} AS revenue_q
FROM quarters WINDOW w AS (PARTITION BY code, y ORDER BY q)""", "quarters")
def w10_ytd(t):
    return rounded(V.standalone_quarters(t.statements, "ytd").select("code", "period", "revenue_q"))


@query("w09_trailing_year", f"SELECT code, period, {money([f'{x}_ttm' for x in V.FLOW_ITEMS])} FROM ttm", "ttm")
def w09(t):
    out = V.trailing_year(V.standalone_quarters(t.statements))
    return rounded(out.select("code", "period", *[f"{x}_ttm" for x in V.FLOW_ITEMS]))


@query("c06_ttm_financials", f"SELECT code, period, fs_div, avail, {money([f'{x}_ttm' for x in V.FLOW_ITEMS])}, {money(['equity', 'liabilities'])} FROM ttm", "ttm")
def c06(t):
    out = V.ttm_financials(t.financials)
    return rounded(out.select("code", "period", "fs_div", "avail", *[f"{x}_ttm" for x in V.FLOW_ITEMS], "equity", "liabilities"))


@query("j07_latest_published", """SELECT b.code, b.d, k.period FROM bars b JOIN LATERAL (
  SELECT period FROM ttm WHERE ttm.code = b.code AND ttm.avail <= b.d ORDER BY y DESC, q DESC LIMIT 1) k ON TRUE""", "bars ttm")
def j07(t):
    return V.published_by(V.ttm_financials(t.financials), t.bars.select("code", "d")).select("code", "d", "period")


@query("j08_latest_shares_cap", f"""SELECT b.code, b.d, {r('b.c * CAST(k.issued AS DOUBLE)', 2)} AS market_cap FROM bars b LEFT JOIN LATERAL (
  SELECT issued FROM shares s WHERE s.code = b.code AND s.issued > 0 AND s.period <= CAST(year(b.d) - 1 AS VARCHAR) || 'Q4' ORDER BY s.period DESC LIMIT 1) k ON TRUE""", "bars shares")
def j08(t):
    return rounded(V.cap_by_latest_shares(t.bars, t.shares).select("code", "d", "market_cap"), 2)


@query("j09_year_grid", """SELECT code, CAST(y AS INTEGER) AS y, issued FROM (SELECT code, unnest(generate_series(y, coalesce(nxt - 1, 2003))) AS y, issued FROM (
  SELECT code, CAST(substr(period, 1, 4) AS INTEGER) AS y, issued, lead(CAST(substr(period, 1, 4) AS INTEGER)) OVER (PARTITION BY code ORDER BY period) AS nxt FROM shares) x) z""", "shares")
def j09_grid(t):
    return V.year_grid(t.shares, 2003)


@query("j09_dated_market_cap", f"SELECT code, d, {r('market_cap', 2)} AS market_cap FROM ({CAPS}) x", "bars shares")
def j09(t):
    return rounded(V.dated_market_cap(t.bars, t.shares).select("code", "d", "market_cap"), 2)


@query("j10_year_over_year", f"""SELECT a.code, a.period, {r('a.op_income', 2)} AS op_income, {r('b.op_income', 2)} AS prev_op_income
FROM quarters a LEFT JOIN quarters b ON b.code = a.code AND b.q = a.q AND b.y = a.y - 1""", "quarters")
def j10(t):
    return rounded(V.year_over_year(t.statements).select("code", "period", "op_income", "prev_op_income"), 2)


PASS = """b.op_income IS NOT NULL AND a.equity > 0 AND a.op_income > 0 AND a.op_income > b.op_income AND a.net_income / a.equity >= 0.03
AND a.liabilities / a.equity <= 2.0"""


@query("f07_fundamental_pass", f"""SELECT a.code, a.period FROM quarters a JOIN quarters b ON b.code = a.code AND b.q = a.q AND b.y = a.y - 1 WHERE {PASS}""", "quarters")
def f07(t):
    c = F.col
    ok = FL.passes_fundamentals(c("op_income"), c("prev_op_income"), c("net_income"), c("equity"), c("liabilities"))
    return V.year_over_year(t.statements).where(ok).select("code", "period")


@query("a18_median_per_code", f"SELECT code, {r('median(CAST(issued AS DOUBLE))')} AS med FROM shares GROUP BY code", "shares")
def a18(t):
    return rounded(t.shares.groupBy("code").agg(F.median(F.col("issued").cast("double")).alias("med")))


cte("reliable", "shares", """
SELECT s.* FROM shares s JOIN (SELECT code, median(CAST(issued AS DOUBLE)) AS med FROM shares GROUP BY code) m ON m.code = s.code
WHERE issued > 0 AND NOT (med > 0 AND (issued / med > 5 OR med / issued > 5))""")
cte("caps08", "bars reliable statements", """
SELECT b.code, b.d, b.period, b.c * CAST(r.issued AS DOUBLE) AS market_cap, f.equity
FROM (SELECT *, CAST(CASE WHEN month(d) >= 4 THEN year(d) - 1 ELSE year(d) - 2 END AS VARCHAR) || 'Q4' AS period FROM bars) b
JOIN reliable r ON r.code = b.code AND r.period = b.period LEFT JOIN statements f ON f.code = b.code AND f.period = b.period
WHERE f.equity IS NULL OR f.equity <= 0 OR b.c * CAST(r.issued AS DOUBLE) / f.equity <= 800""")


@query("c08_market_caps", f"SELECT code, d, period, {r('market_cap', 2)} AS market_cap, {r('equity', 2)} AS equity FROM caps08", "caps08")
def c08(t):
    return rounded(V.market_caps(t.bars, t.shares, t.statements, sanity=800.0), 2)


@query("j20_cap_sanity", """SELECT code, count(*) AS kept, count(CASE WHEN equity > 0 THEN 1 END) AS with_equity FROM caps08 GROUP BY code""", "caps08")
def j20(t):
    caps = V.market_caps(t.bars, t.shares, t.statements, sanity=800.0)
    return caps.groupBy("code").agg(F.count(F.lit(1)).alias("kept"), F.count(F.when(F.col("equity") > 0, 1)).alias("with_equity"))


@query("c09_pbr", f"SELECT code, d, {r('market_cap / equity')} AS pbr FROM caps08 WHERE equity > 0", "caps08")
def c09(t):
    return rounded(V.pbr(V.market_caps(t.bars, t.shares, t.statements, sanity=800.0)).select("code", "d", "pbr"))


@query("j21_cap_with_equity", f"SELECT d, count(*) AS n, {r('min(market_cap / equity)')} AS lo, {r('max(market_cap / equity)')} AS hi FROM caps08 WHERE equity > 0 GROUP BY d", "caps08")
def j21(t):
    out = V.pbr(V.market_caps(t.bars, t.shares, t.statements, sanity=800.0))
    return rounded(out.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min("pbr").alias("lo"), F.max("pbr").alias("hi")))


@query("f10_pbr_cap", "SELECT code, d FROM caps08 WHERE equity > 0 AND market_cap / equity <= 300", "caps08")
def f10(t):
    out = V.pbr(V.market_caps(t.bars, t.shares, t.statements, sanity=800.0))
    return out.where(FL.pbr_within(F.col("pbr"), 300.0)).select("code", "d")


C05_SQL = f"""
WITH filed AS (SELECT code, d, CAST(year(e) AS VARCHAR) || 'Q' || CAST(quarter(e) AS VARCHAR) AS period FROM (SELECT code, d, CAST(d - 45 AS DATE) AS e FROM disclosures) x),
x AS (SELECT p.code, p.d, p.c AS close, f.period, (a.op_income - b.op_income) / a.equity AS improvement
FROM filed f JOIN (SELECT code, d, c, {TURN20} AS t FROM bars) p ON p.code = f.code AND p.d = f.d
JOIN quarters a ON a.code = f.code AND a.period = f.period JOIN quarters b ON b.code = a.code AND b.q = a.q AND b.y = a.y - 1
WHERE regexp_full_match(f.code, '[0-9]+') AND p.t >= {TURNOVER} AND {PASS})
SELECT code, d, {r('close', 8)} AS close, period, {r('improvement')} AS improvement, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY improvement DESC, code) AS rk FROM x) y WHERE rk <= 50"""


@query("c05_fundamental_candidates", C05_SQL, "disclosures bars quarters")
def c05(t):
    return rounded(V.fundamental_candidates(t.disclosures, t.statements, t.bars, TURNOVER))


cte("rebal", "bars", """
SELECT d, next_d FROM (SELECT d, lead(d) OVER (ORDER BY d) AS next_d FROM (SELECT DISTINCT d FROM bars) x) y
WHERE d IN (SELECT min(d) FROM bars WHERE d BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' GROUP BY year(d), month(d))""")
QCAP = 5e7
cte("pool", "bars rebal shares ttm", f"""
SELECT x.code, x.d, x.c, k.period, k.equity, k.liabilities, k.net_income_ttm, k.op_income_ttm, k.revenue_ttm, x.c * CAST(s.issued AS DOUBLE) AS market_cap, x.t
FROM (SELECT code, d, c, {TURN20} AS t FROM bars) x JOIN rebal ON rebal.d = x.d
JOIN LATERAL (SELECT issued FROM shares s WHERE s.code = x.code AND s.issued > 0 AND s.period <= CAST(year(x.d) - 1 AS VARCHAR) || 'Q4' ORDER BY s.period DESC LIMIT 1) s ON TRUE
JOIN LATERAL (SELECT * FROM ttm WHERE ttm.code = x.code AND ttm.avail <= x.d ORDER BY y DESC, q DESC LIMIT 1) k ON TRUE
WHERE x.c * CAST(s.issued AS DOUBLE) >= {QCAP} AND k.equity > 0 AND k.net_income_ttm > 0 AND k.revenue_ttm > 0 AND k.liabilities / k.equity <= 2.0""")


def days(t):
    return C.rebalance_days(t.bars, "1996-01-01", "2001-06-30", C.MONTHLY)


def pool(t, turnover=None):
    return V.quality_pool(V.ttm_financials(t.financials), t.shares, t.bars, days(t), QCAP, turnover)


@query("f08_quality_eligible", f"SELECT code, d, period, {r('market_cap', 2)} AS market_cap FROM pool", "pool")
def f08(t):
    return rounded(pool(t).select("code", "d", "period", "market_cap"), 2)


def _pr(x):
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY d ORDER BY {x}) + (count(*) OVER (PARTITION BY d, {x}) - 1) / 2.0) "
            f"/ count({x}) OVER (PARTITION BY d) END")


_ROE, _MARGIN, _DEBT, _EY, _BY = (_pr(x) for x in (
    "(net_income_ttm / equity)", "(op_income_ttm / revenue_ttm)", "(-(liabilities / equity))", "(net_income_ttm / market_cap)", "(equity / market_cap)"))
_SCORES = {"quality": f"({_ROE} + {_MARGIN} + {_DEBT}) / 3.0", "value": f"({_EY} + {_BY}) / 2.0",
           "combo": f"({_ROE} + {_MARGIN} + {_DEBT}) / 6.0 + ({_EY} + {_BY}) / 4.0"}
cte("scored", "pool", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, *, round({s}, 12) AS score FROM pool WHERE regexp_full_match(code, '[0-9]+') AND t >= {TURNOVER}" for k, s in _SCORES.items()))
cte("targets", "scored", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, d ORDER BY score DESC, code) AS rk FROM scored) x WHERE rk <= 5")


def _targets(t, kind):
    return V.quality_targets(V.ttm_financials(t.financials), t.shares, t.bars, days(t), 5, kind, QCAP, TURNOVER)


for _kind in _SCORES:
    @query(f"c07_quality_targets_{_kind}", f"""SELECT d, code, {r('c', 8)} AS close, {r('score')} AS score, CAST(rk AS INTEGER) AS rank, period, {r('net_income_ttm / equity')} AS roe,
      {r('liabilities / equity')} AS debt_ratio, {r('market_cap / equity')} AS pbr, {r('market_cap / net_income_ttm')} AS per FROM targets WHERE kind = '{_kind}'""", "targets")
    def c07(t, kind=_kind):
        return rounded(_targets(t, kind))


@query("j22_targets_with_close", f"SELECT d, code, {r('c', 8)} AS close FROM targets WHERE kind = 'value'", "targets")
def j22(t):
    return rounded(_targets(t, "value").select("d", "code").join(t.bars.select("d", "code", F.col("c").alias("close")), ["d", "code"]))


@query("w12_percentile_rank", f"SELECT code, d, {r(_pr('institution_flow_ratio'))} AS pct FROM signals", "signals")
def w12(t):
    return rounded(percentile_rank(t.signals.select("code", "d", "institution_flow_ratio"), ["d"], "institution_flow_ratio", "pct").select("code", "d", "pct"))


@query("w13_rank_in_day", """SELECT code, d, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY heat_score, code) AS rk FROM (
  SELECT code, d, round(heat_score, 9) AS heat_score FROM signals) s) x WHERE rk <= 10""", "signals")
def w13(t):
    s = t.signals.select("code", "d", F.round("heat_score", 9).alias("heat_score"))
    return V.top_per_day(s, [F.col("heat_score"), F.col("code")], 10).select("code", "d", "rank")


@query("l02_best_score", "SELECT d, code FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, code) AS rn FROM scored WHERE kind = 'quality') x WHERE rn <= 3", "scored")
def l02(t):
    p = V.quality_score(pool(t, TURNOVER), "quality")
    return V.top_per_day(p, [F.col("score").desc(), F.col("code")], 3).select("d", "code")


@query("l04_head_per_day", """SELECT code, d FROM (SELECT code, d, row_number() OVER (PARTITION BY d ORDER BY volume_ratio DESC, code) AS rn FROM signals WHERE volume_ratio IS NOT NULL) x
WHERE rn <= 3""", "signals")
def l04(t):
    s = t.signals.where(F.col("volume_ratio").isNotNull()).select("code", "d", "volume_ratio")
    return V.top_per_day(s, [F.col("volume_ratio").desc(), F.col("code")], 3).select("code", "d")
