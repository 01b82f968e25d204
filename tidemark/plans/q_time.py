"""Registered queries: joins in time and the market calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import calendar as C
from tidemark.plans.domain_sql import r
from tidemark.plans.q_signals import DAY, rounded
from tidemark.plans.registry import query


@query("j01_next_bar", f"""SELECT code, d, b.nd AS next_d, {r('b.no', 8)} AS next_o FROM disclosures f LEFT JOIN LATERAL (
  SELECT bars.d AS nd, bars.o AS no FROM bars WHERE bars.code = f.code AND bars.d > f.d ORDER BY bars.d LIMIT 1) b ON TRUE""", "disclosures bars")
def j01(t):
    return rounded(A.next_bar(t.disclosures.select("code", "d"), t.bars, "d"))


@query("j02_latest_close", f"""SELECT id, code, l.d AS d, b.bd AS last_d, {r('b.c', 8)} AS last_c FROM ledger l LEFT JOIN LATERAL (
  SELECT bars.d AS bd, bars.c FROM bars WHERE bars.code = l.code AND bars.d <= l.d ORDER BY bars.d DESC LIMIT 1) b ON TRUE""", "ledger bars")
def j02(t):
    return rounded(A.latest_bar(t.ledger.select("id", "code", "d"), t.bars, "d"))


@query("j02_latest_close_on_day", f"""SELECT code, max(d) AS last_d, {r('arg_max(c, d)', 8)} AS last_c FROM bars WHERE d <= DATE '{DAY}' GROUP BY code""", "bars")
def j02_day(t):
    return rounded(A.latest_close_on(t.bars, DAY))


HELD = """(SELECT count(*) FROM bars b WHERE b.code = p.code AND b.d > p.entry_date AND b.d <= DATE '2001-06-29')"""


@query("j05_held_bars", f"SELECT code, strategy, {HELD} AS held_days FROM positions p", "positions bars")
def j05(t):
    probe = t.positions.withColumn("until", F.lit("2001-06-29").cast("date"))
    return A.held_bars(probe, t.bars, "entry_date", "until").select("code", "strategy", F.col("held_days").cast("bigint").alias("held_days"))


@query("j06_exclude_and_keep", """SELECT id, code FROM ledger WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE p.code = ledger.code AND p.strategy = ledger.strategy
  AND p.entry_date = ledger.d) AND code IN (SELECT code FROM nat WHERE regexp_full_match(code, '[0-9]+'))""", "ledger positions nat")
def j06(t):
    from tidemark.operators.filters import is_ordinary

    held = t.positions.select("code", "strategy", F.col("entry_date").alias("d"))
    allowed = t.instruments.where(is_ordinary(F.col("code"))).select("code")
    return t.ledger.join(held, ["code", "strategy", "d"], "left_anti").join(allowed, "code", "left_semi").select("id", "code")


PREV = """SELECT a.code, a.d, a.c, b.c AS prev_c FROM bars a JOIN (SELECT d, lag(d) OVER (ORDER BY d) AS prev_d FROM (SELECT DISTINCT d FROM bars) x) k ON k.d = a.d
LEFT JOIN bars b ON b.code = a.code AND b.d = k.prev_d"""


@query("j11_previous_market_day", f"SELECT code, d, {r('c', 8)} AS c, {r('prev_c', 8)} AS prev_c FROM ({PREV}) y", "bars")
def j11(t):
    return rounded(C.with_previous_market_close(t.bars).select("code", "d", "c", "prev_c"))


@query("w21_market_calendar", """SELECT d, row_number() OVER (ORDER BY d) AS day_no, lag(d) OVER (ORDER BY d) AS prev_d, lead(d) OVER (ORDER BY d) AS next_d,
  d = min(d) OVER (PARTITION BY year(d), month(d)) AS first_of_month FROM (SELECT DISTINCT d FROM bars) x""", "bars")
def w21(t):
    return C.market_calendar(t.bars)


@query("w21_rebalance_days", """SELECT d, day_no, next_d FROM (SELECT d, row_number() OVER (ORDER BY d) AS day_no, lead(d) OVER (ORDER BY d) AS next_d FROM (SELECT DISTINCT d FROM bars) x) y
WHERE d IN (SELECT min(d) FROM bars WHERE d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY year(d), month(d)) AND month(d) IN (2, 5, 8, 11)""", "bars")
def w21_rebalance(t):
    return C.rebalance_days(t.bars, "1996-01-01", "2000-12-31")


@query("s07_month_ranges", """SELECT code, greatest(a, CAST(m AS DATE)) AS range_start, least(last_day(CAST(m AS DATE)), b) AS range_end FROM (
  SELECT code, min(d) AS a, max(d) AS b, unnest(generate_series(CAST(date_trunc('month', min(d)) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM bars GROUP BY code) x""", "bars")
def s07(t):
    spans = t.bars.groupBy("code").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return C.month_ranges(spans, "a", "b").select("code", "range_start", "range_end")


@query("s18_latest_day", "SELECT max(d) AS d FROM bars", "bars")
def s18(t):
    return C.latest_day(t.bars)


@query("c33_entry_signal_date", """WITH s AS (SELECT DISTINCT d FROM signals), b AS (SELECT DISTINCT d FROM bars)
SELECT b.d AS today, CASE WHEN (SELECT min(x.d) FROM b x WHERE x.d > k.sd) = b.d THEN k.sd END AS signal_d
FROM b LEFT JOIN LATERAL (SELECT max(s.d) AS sd FROM s WHERE s.d < b.d) k ON TRUE""", "signals bars")
def c33(t):
    return C.entry_signal_dates(t.signals, t.bars)
