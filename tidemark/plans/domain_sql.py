"""The same domain tables as SQL common table expressions, for the side-by-side check."""

from __future__ import annotations

CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, uses: str, sql: str) -> None:
    CTES[name] = (uses, sql.strip())


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0].split():
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def full_avg(x: str, n: int, cond: str = "", first: int | None = None, last: int = 1) -> str:
    """Mean of the n rows before today (or including today with last=0), all present."""
    lo = n if last == 1 else n - 1
    hi = "1 PRECEDING" if last == 1 else "CURRENT ROW"
    w = f"(PARTITION BY code ORDER BY d ROWS BETWEEN {lo} PRECEDING AND {hi})"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN avg({x}) OVER {w} END"


CODE = "lpad(CAST({k} AS VARCHAR), 5, '0') || CASE WHEN {k} % 12 = 11 THEN 'K' ELSE '0' END"

cte("nat", "", f"SELECT n_nationkey, n_name, {CODE.format(k='n_nationkey')} AS code FROM nation")
cte("li", "nat", """
SELECT nat.code, n_nationkey AS nk, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS px, lineitem.*
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey""")
ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
BARS = f"""
SELECT code, d, first(px ORDER BY {ORD}) AS o, max(px) AS h, min(px) AS l, last(px ORDER BY {ORD}) AS c,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM {{src}} GROUP BY code, d"""
cte("bars", "li", BARS.format(src="li"))
cte("sli", "", """
SELECT lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS code, CAST(l_shipdate AS DATE) AS d,
       l_extendedprice / l_quantity AS px, lineitem.* FROM lineitem""")
cte("sbars", "sli", BARS.format(src="sli"))
FLOWS = """
SELECT code, d,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN amt ELSE 0 END) AS BIGINT) AS individual_net,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN amt ELSE 0 END) AS BIGINT) AS foreign_net,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN amt ELSE 0 END) AS BIGINT) AS institution_net
FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) * CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS amt FROM {src}) t
GROUP BY code, d"""
cte("flows", "li", FLOWS.format(src="li"))
cte("sales", "nat", """
SELECT nat.code, c_nationkey, c_mktsegment, CAST(o_orderdate AS DATE) AS d, orders.*
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey""")
cte("credit", "sales", """
SELECT code, d, credit_amt, CAST(credit_amt AS DOUBLE) / CAST(total AS DOUBLE) AS credit_ratio FROM (
  SELECT code, d, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS credit_amt,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total
  FROM sales GROUP BY code, d) t""")
cte("shares", "sales", """
SELECT code, CAST(y AS VARCHAR) || 'Q4' AS period, CAST(n * 1000 * unit AS BIGINT) AS issued,
       CAST(f * 10 AS BIGINT) AS treasury, CAST(n * 1000 * unit - f * 10 AS BIGINT) AS floating
FROM (SELECT code, year(d) AS y, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f,
             CASE WHEN c_nationkey % 7 = 3 AND year(d) = 1998 THEN 1000 ELSE 1 END AS unit
      FROM sales GROUP BY code, c_nationkey, year(d)) t""")
cte("financials", "li", """
SELECT code, period, fs_div, revenue * k AS revenue, op_income * k AS op_income, net_income * k AS net_income,
       (equity + liabilities) * k AS assets, liabilities * k AS liabilities, equity * k AS equity
FROM (SELECT *, CASE WHEN fs_div = 'OFS' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS k FROM (
  SELECT code, nk, CAST(y AS VARCHAR) || 'Q' || CAST(q AS VARCHAR) AS period,
    CAST(CASE WHEN q = 4 THEN sum(rev) OVER w ELSE rev END AS DOUBLE) / 100 AS revenue,
    CAST(CASE WHEN q = 4 THEN sum(op) OVER w ELSE op END AS DOUBLE) / 10000 AS op_income,
    CAST(CASE WHEN q = 4 THEN sum(net) OVER w ELSE net END AS DOUBLE) / 100000 AS net_income,
    CAST(b AS DOUBLE) / 10 - 100000 AS equity, abs(CAST(b AS DOUBLE) / 10) * (nk % 5 + 1) * CAST(0.5 AS DOUBLE) AS liabilities
  FROM (SELECT code, nk, year(d) AS y, quarter(d) AS q, CAST(sum(p) AS BIGINT) AS rev, CAST(sum(p * (6 - disc)) AS BIGINT) AS op,
               CAST(sum(p * (55 - disc * 10 - tax)) AS BIGINT) AS net
        FROM (SELECT code, nk, d, CAST(round(l_extendedprice * 100) AS BIGINT) AS p,
                     CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM li) a
        GROUP BY code, nk, year(d), quarter(d)) f
  JOIN (SELECT s_nationkey, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS b FROM supplier GROUP BY s_nationkey) s
    ON s.s_nationkey = f.nk
  WINDOW w AS (PARTITION BY code, y)) x
  JOIN (VALUES ('CFS'), ('OFS')) kinds(fs_div)
    ON (fs_div = 'CFS' AND nk % 5 <> 4) OR (fs_div = 'OFS' AND (nk % 2 = 0 OR nk % 5 = 4))) z""")
cte("statements", "financials", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY code, period ORDER BY CASE fs_div WHEN 'CFS' THEN 0 ELSE 1 END) AS rn
FROM financials) t WHERE rn = 1""")
cte("disclosures", "li", """
SELECT strftime(e + 45, '%Y%m%d') || code AS rcept_no, code, CAST(e + 45 AS DATE) AS d,
  CASE q WHEN 4 THEN '사업보고서' WHEN 2 THEN '반기보고서' ELSE '분기보고서' END || ' (' || strftime(e, '%Y.%m') || ')' AS report_nm,
  'https://dart.fss.or.kr/dsaf001/main.do?rcpNo=' || strftime(e + 45, '%Y%m%d') || code AS url
FROM (SELECT DISTINCT code, quarter(d) AS q, last_day(make_date(year(d), quarter(d) * 3, 1)) AS e FROM li) t""")
cte("ledger", "sales", """
SELECT o_orderkey AS id, o_orderdate AS ts, d, 'paper' AS mode, CASE WHEN sold THEN 'sell' ELSE 'buy' END AS side, code,
  'N' || code AS name, qty, o_totalprice / qty AS price, o_totalprice AS amount, o_orderpriority AS strategy,
  CASE WHEN NOT sold THEN CASE o_orderkey % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{"value_trap":"buy"}' ELSE '{"risk":"buy"}' END END AS agents,
  CASE WHEN sold THEN CASE o_orderkey % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'expiry' ELSE 'heat_signal' END END AS exit_reason,
  CASE WHEN sold THEN CAST((o_orderkey * 37) % 201 - 100 AS DOUBLE) / 1000 END AS realized_pct
FROM (SELECT *, o_orderstatus = 'F' AS sold, CAST(1 + o_orderkey % 10 AS DOUBLE) AS qty FROM sales) t""")
cte("positions", "ledger", """
SELECT code, strategy, name, d AS entry_date, price / 40 AS entry_px, qty, price / 40 * CAST(0.93 AS DOUBLE) AS stop_px,
  20 AS max_hold_days, mode
FROM (SELECT *, row_number() OVER (PARTITION BY code, strategy, mode ORDER BY ts DESC, id DESC) AS rn FROM ledger WHERE side = 'buy') t
WHERE rn = 1""")
cte("decisions", "", f"""
SELECT event_id AS id, ts, {CODE.format(k='(user_id % 25)')} AS code,
  CASE event_id % 5 WHEN 0 THEN 'market_state' WHEN 1 THEN 'risk' WHEN 2 THEN 'disclosure' WHEN 3 THEN 'financials' ELSE 'value_trap' END AS agent,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE round(value % 10, 2) END AS score,
  CASE event_type WHEN 'error' THEN '오류' WHEN 'signup' THEN '관망' WHEN 'click' THEN '청산' ELSE '매수' END AS decision,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN '요청 한도 초과' ELSE 'API 연결 실패' END || ' - ' || props ELSE event_type END AS rationale,
  'model' AS model,
  CASE WHEN event_type <> 'error' THEN md5(event_type || CAST(user_id % 25 AS VARCHAR) || ':' || props) END AS input_hash
FROM events""")

W30 = "(PARTITION BY code ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"


def _prior(x: str, absolute: bool) -> str:
    y = f"abs({x})" if absolute else x
    return f"CASE WHEN count({x}) OVER w30 = 30 AND avg({y}) OVER w30 > 0 THEN {x} / avg({y}) OVER w30 END"


def signals_sql(bars: str, flows: str, credit: str) -> str:
    return f"""
SELECT *, CASE WHEN heat_score >= 8.5 THEN 'sell' WHEN heat_score >= 7.0 THEN 'avoid' ELSE 'neutral' END AS signal FROM (
SELECT code, d, individual_flow_ratio, credit_surge_ratio, volume_ratio, foreign_flow_ratio, institution_flow_ratio, credit_ratio_level,
  CASE WHEN individual_flow_ratio IS NULL THEN 0.0 ELSE greatest(-4.0, least(4.0, (individual_flow_ratio - 1.0) * 3.0)) END
  + CASE WHEN credit_surge_ratio IS NULL THEN 0.0 ELSE greatest(-3.0, least(3.0, (credit_surge_ratio - 1.0) * 3.0)) END
  + CASE WHEN volume_ratio IS NULL THEN 0.0 ELSE greatest(-3.0, least(3.0, (volume_ratio - 1.5) * 2.0)) END AS heat_score
FROM (
SELECT code, d, seq, {_prior('individual_net', True)} AS individual_flow_ratio, {_prior('cr', False)} AS credit_surge_ratio,
  {_prior('amt', False)} AS volume_ratio, {_prior('foreign_net', True)} AS foreign_flow_ratio,
  {_prior('institution_net', True)} AS institution_flow_ratio, lvl AS credit_ratio_level
FROM (SELECT code, d, c * CAST(v AS DOUBLE) AS amt, CAST(individual_net AS DOUBLE) AS individual_net, CAST(foreign_net AS DOUBLE) AS foreign_net,
        CAST(institution_net AS DOUBLE) AS institution_net,
        last_value(CAST(credit_amt AS DOUBLE) IGNORE NULLS) OVER w AS cr, last_value(credit_ratio IGNORE NULLS) OVER w AS lvl,
        row_number() OVER w AS seq
      FROM {bars} LEFT JOIN {flows} USING (code, d) LEFT JOIN {credit} USING (code, d)
      WINDOW w AS (PARTITION BY code ORDER BY d)) a
WINDOW w30 AS {W30}) b WHERE seq > 30) e"""


cte("signals", "bars flows credit", signals_sql("bars", "flows", "credit"))

cte("run_trades", "sales", """
SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10000 + instr('ABFHM', substr(c_mktsegment, 1, 1)) * 1000 + (wy - 1990) * 2 + wl AS run_id,
  substr(o_orderpriority, 1, 1) AS priority, substr(c_mktsegment, 1, 1) AS segment, wy AS y, wl AS long, o_orderkey AS id, code,
  CAST(d - 10 AS DATE) AS entry_d, d AS exit_d, o_totalprice / CAST(1 + o_orderkey % 10 AS DOUBLE) AS entry_px,
  o_totalprice / CAST(1 + o_orderkey % 10 AS DOUBLE) * (1 + ret) AS exit_px, ret AS ret_pct,
  CASE o_orderkey % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'expiry' ELSE 'heat_signal' END AS exit_reason
FROM (SELECT *, CAST((o_orderkey * 37) % 201 - 100 AS DOUBLE) / 1000 AS ret FROM (
  SELECT *, year(d) AS wy, 0 AS wl FROM sales WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT *, CASE WHEN year(d) % 2 = 0 THEN year(d) ELSE year(d) - 1 END AS wy, 1 AS wl FROM sales
  WHERE o_orderstatus = 'F' AND (year(d) IN (1996, 1998) OR (year(d) IN (1997, 1999) AND month(d) <= 6))) u) v""")
cte("runs", "run_trades", """
SELECT *, coalesce(rank_col, '') || '|' || slots || '|' || coalesce(exit_rank, '') || '|' || coalesce(pit, '') || '|' || coalesce(marcap, '')
    || '|' || coalesce(wf, '') || '|' || coalesce(control, '') AS fp
FROM (SELECT run_id AS id, CAST(DATE '2002-01-01' + CAST((run_id * 37) % 500 AS INTEGER) AS TIMESTAMP) AS ts,
  CASE priority WHEN '1' THEN 'q3_' WHEN '2' THEN 'contrarian_' WHEN '3' THEN 'pit_' WHEN '4' THEN 'fundamental_' ELSE 'wf_' END
    || segment || '_' || CAST(y AS VARCHAR) || CASE WHEN long = 1 THEN 'L' ELSE '' END AS strategy,
  make_date(y, 1, 1) AS start_d, CASE WHEN long = 1 THEN make_date(y + 1, 6, 30) ELSE make_date(y, 12, 31) END AS end_d,
  CASE priority WHEN '1' THEN 'heat_score' WHEN '2' THEN 'volume_ratio' WHEN '3' THEN 'credit_surge_ratio' WHEN '4' THEN 'institution_flow_ratio' END AS rank_col,
  CASE WHEN segment = 'B' THEN '12' ELSE '5' END AS slots, CASE WHEN segment = 'F' THEN '0.9' END AS exit_rank,
  CASE WHEN segment = 'H' THEN 'true' END AS pit, CASE WHEN segment = 'M' THEN 'false' END AS marcap,
  CASE WHEN priority = '5' THEN 'true' END AS wf, CASE WHEN priority = '5' AND segment = 'A' THEN 'true' END AS control,
  n, m * 100 AS mean_pct, sd * 100 AS std_pct, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) ELSE 0 END AS t_val
FROM (SELECT run_id, priority, segment, y, long, count(*) AS n, avg(ret_pct) AS m, stddev_pop(ret_pct) AS sd FROM run_trades GROUP BY ALL) g) h""")
