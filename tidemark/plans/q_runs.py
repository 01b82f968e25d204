"""Registered queries: comparison of test runs and agent decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as P
from tidemark.functions import verdicts as V
from tidemark.operators import decisions as D
from tidemark.operators import filters as FL
from tidemark.operators import runs as U
from tidemark.plans.domain_sql import cte, r
from tidemark.plans.q_books import _WORD, probe, replies
from tidemark.plans.q_signals import PROXY, rounded
from tidemark.plans.q_time import PREV
from tidemark.plans.registry import query
from tidemark.sources.tables import run_rows

_JSON = "'{' || array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '\"{k}\":\"' || {c} || '\"' END" for k, c in (
        ("exit_cols", "CASE WHEN exit_rank IS NOT NULL THEN 'credit_surge_ratio' END"), ("exit_rank_pct", "exit_rank"), ("is_control", "control"),
        ("marcap_filter", "marcap"), ("point_in_time_universe", "pit"), ("rank_col", "rank_col"), ("slots", "slots"), ("walkforward", "wf")))
_JSON += "], lambda x: x IS NOT NULL), ',') || '}'"


@query("p24_fingerprint", f"SELECT id, {_JSON} AS fp FROM runs", "runs")
def p24(t):
    return t.runs.select("id", V.fingerprint(F.col("params")).alias("fp"))


VERDICT = "CASE WHEN n = 0 THEN 'none' WHEN mean_pct >= 0 AND t_val >= 2 THEN 'good' WHEN mean_pct >= 0 THEN 'warn' ELSE 'bad' END"


@query("p22_verdict", f"SELECT id, {VERDICT} AS verdict, n, {r('mean_pct')} AS mean_pct, {r('std_pct')} AS std_pct, {r('t_val')} AS t_val FROM runs", "runs")
def p22(t):
    return rounded(t.runs.select("id", V.verdict(F.col("n"), F.col("mean_pct"), F.col("t_val")).alias("verdict"), "n", "mean_pct", "std_pct", "t_val"))


FAMILY = """CASE WHEN starts_with(strategy, 'q2_') OR starts_with(strategy, 'q3_') OR starts_with(strategy, 'quality') THEN 'quality'
  WHEN starts_with(strategy, 'pit_') OR starts_with(strategy, 'contrarian') THEN 'contrarian' WHEN starts_with(strategy, 'fundamental') THEN 'fundamental' ELSE 'other' END"""


@query("p25_family", f"SELECT id, {FAMILY} AS family FROM runs", "runs")
def p25(t):
    return t.runs.select("id", V.family(F.col("strategy")).alias("family"))


@query("f15_trusted_runs", "SELECT id FROM runs WHERE pit = 'true' OR marcap = 'false'", "runs")
def f15(t):
    return t.runs.where(FL.trusted_run(F.col("params"))).select("id")


@query("j18_window_overlap", "SELECT id, EXISTS (SELECT 1 FROM runs b WHERE a.fp = b.fp AND a.id <> b.id AND a.start_d <= b.end_d AND b.start_d <= a.end_d) AS overlaps FROM runs a", "runs")
def j18(t):
    return U.measured_again(t.runs).select("id", "overlaps")


# Greedy choice per rule, newest first: run k is kept unless it overlaps a kept newer run.
cte("ordered_runs", "runs", "SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ts DESC, id DESC) AS k FROM runs")
GREEDY = """WITH RECURSIVE walk(fp, k, id, start_d, end_d, kept, spans) AS (
  SELECT fp, k, id, start_d, end_d, TRUE, [{'s': start_d, 'e': end_d}] FROM ordered_runs WHERE k = 1
  UNION ALL SELECT o.fp, o.k, o.id, o.start_d, o.end_d, len(list_filter(w.spans, lambda x: x.s <= o.end_d AND o.start_d <= x.e)) = 0,
    CASE WHEN len(list_filter(w.spans, lambda x: x.s <= o.end_d AND o.start_d <= x.e)) = 0 THEN list_append(w.spans, {'s': o.start_d, 'e': o.end_d}) ELSE w.spans END
  FROM walk w JOIN ordered_runs o ON o.fp = w.fp AND o.k = w.k + 1)
"""


@query("c21_current_runs", GREEDY + "SELECT id, kept AS current FROM walk", "ordered_runs")
def c21(t):
    return U.current_runs(t.runs).select("id", "current")


_LIVE = GREEDY + ", live AS (SELECT runs.* FROM runs JOIN walk ON walk.id = runs.id WHERE kept)\n"
_DIFF = """(CASE WHEN a.slots <> b.slots THEN 1 ELSE 0 END) + (CASE WHEN coalesce(a.exit_rank, '') <> coalesce(b.exit_rank, '') THEN 1 ELSE 0 END)
  + (CASE WHEN coalesce(a.pit, '') <> coalesce(b.pit, '') THEN 1 ELSE 0 END) + (CASE WHEN coalesce(a.wf, '') <> coalesce(b.wf, '') THEN 1 ELSE 0 END)
  + (CASE WHEN coalesce(a.control, '') <> coalesce(b.control, '') THEN 1 ELSE 0 END)"""
PAIRS = f"""pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.start_d, a.end_d, CASE WHEN a.slots <> b.slots THEN 'slots' WHEN coalesce(a.exit_rank, '') <> coalesce(b.exit_rank, '') THEN 'signal_exit'
  WHEN coalesce(a.pit, '') <> coalesce(b.pit, '') THEN 'point_in_time_universe' WHEN coalesce(a.wf, '') <> coalesce(b.wf, '') THEN 'walkforward' ELSE 'is_control' END AS setting,
  b.mean_pct - a.mean_pct AS delta, sqrt(a.std_pct * a.std_pct / a.n + b.std_pct * b.std_pct / b.n) AS se
FROM live a JOIN live b ON a.id < b.id AND a.start_d = b.start_d AND a.end_d = b.end_d AND coalesce(a.rank_col, '') = coalesce(b.rank_col, '') WHERE {_DIFF} = 1)
"""


@query("j16_setting_pairs", _LIVE + ", " + PAIRS + f"SELECT setting, a_id, b_id, {r('delta')} AS delta, {r('se')} AS se, {r('CASE WHEN se > 0 THEN delta / se ELSE 0 END')} AS z FROM pairs", "runs ordered_runs")
def j16(t):
    out = U.with_delta(U.setting_pairs(U.only_current(t.runs)))
    return rounded(out.select("setting", "a_id", "b_id", "delta", "se", "z"))


@query("c22_setting_effects", _LIVE + ", " + PAIRS + f"""SELECT setting, count(*) AS n_comp, {r('avg(delta)')} AS mean_delta, {r('max(CASE WHEN se > 0 THEN abs(delta / se) ELSE 0 END)')} AS max_abs_z,
  CASE WHEN count(*) < 2 THEN 'none' WHEN min(delta) > 0 OR max(delta) < 0 THEN CASE WHEN max(CASE WHEN se > 0 THEN abs(delta / se) ELSE 0 END) >= 2 THEN 'good' ELSE 'warn' END ELSE 'bad' END AS verdict FROM pairs GROUP BY setting""", "runs ordered_runs")
def c22(t):
    return rounded(U.setting_effects(t.runs))


@query("c23_rank_factors", _LIVE + f"""SELECT rank_col, slots, coalesce(exit_rank, '') AS exit_rank, coalesce(pit, '') AS pit, coalesce(marcap, '') AS marcap, count(*) AS windows, {r('min(mean_pct)')} AS worst_mean,
  {r('max(mean_pct)')} AS best_mean, {r('max(abs(t_val))')} AS max_abs_t, CASE WHEN count(*) < 2 THEN 'none' WHEN min(mean_pct) > 0 THEN CASE WHEN max(abs(t_val)) >= 2 THEN 'good' ELSE 'warn' END ELSE 'bad' END AS verdict
FROM live WHERE rank_col IS NOT NULL AND wf IS NULL GROUP BY rank_col, slots, exit_rank, pit, marcap""", "runs ordered_runs")
def c23(t):
    def part(key):
        return F.coalesce(F.get_json_object("fp", f"$.{key}"), F.lit(""))

    out = U.rank_factor_table(t.runs)
    return rounded(out.select("rank_col", part("slots").alias("slots"), part("exit_rank_pct").alias("exit_rank"), part("point_in_time_universe").alias("pit"),
                              part("marcap_filter").alias("marcap"), "windows", "worst_mean", "best_mean", "max_abs_t", "verdict"))


_EDGE = """FROM live a LEFT JOIN (SELECT start_d, end_d, arg_min(id, id) AS id, arg_min(mean_pct, id) AS m FROM live WHERE wf = 'true' AND control = 'true' GROUP BY start_d, end_d) b
ON a.start_d = b.start_d AND a.end_d = b.end_d WHERE a.wf = 'true' AND a.control IS NULL"""


@query("c24_walkforward_edges", _LIVE + f"""SELECT a.id, a.start_d, b.id AS base_id, {r('a.mean_pct - b.m')} AS edge, CASE WHEN b.m IS NULL THEN 'none' WHEN a.mean_pct - b.m > 0 AND abs(a.t_val) >= 2 THEN 'good'
  WHEN a.mean_pct - b.m > 0 THEN 'warn' ELSE 'bad' END AS verdict {_EDGE}""", "runs ordered_runs")
def c24(t):
    return rounded(U.walkforward_edges(t.runs).select("id", "start_d", "base_id", "edge", "verdict"))


@query("j17_selected_with_control", _LIVE + f"SELECT a.id, b.id AS base_id {_EDGE}", "runs ordered_runs")
def j17(t):
    return U.walkforward_edges(t.runs).select("id", "base_id")


@query("c25_combined_verdict", _LIVE + f"""SELECT fp_json AS fp, count(*) AS windows, {r('min(mean_pct)')} AS lo, {r('max(mean_pct)')} AS hi, CASE WHEN max(mean_pct) < 0 THEN 'bad' WHEN min(mean_pct) >= 0 THEN 'good' ELSE 'warn' END AS verdict
FROM (SELECT *, {_JSON} AS fp_json FROM live) x GROUP BY 1 HAVING count(*) >= 2""", "runs ordered_runs")
def c25(t):
    return rounded(U.combined_verdict(t.runs))


_SECTION = f"SELECT *, {FAMILY} AS family, CASE WHEN pit = 'true' OR marcap = 'false' THEN 'trusted' ELSE 'biased' END AS section FROM runs"


@query("c26_run_sections", f"""SELECT id, family, section, CASE WHEN pos <= 12 THEN CAST(pos AS INTEGER) END AS pos, pos <= 12 OR id = 11010 OR section = 'biased' AS shown FROM (
  SELECT *, row_number() OVER (PARTITION BY family, section ORDER BY ts DESC, id DESC) AS pos FROM ({_SECTION}) s) x""", "runs")
def c26(t):
    return U.run_sections(t.runs, selected=11010).select("id", "family", "section", "pos", "shown")


@query("l07_newest_runs", f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY family, section ORDER BY ts DESC, id DESC) AS pos FROM ({_SECTION}) s) x WHERE pos <= 12 OR id = 11010 OR section = 'biased'", "runs")
def l07(t):
    return U.run_sections(t.runs, selected=11010).where(F.col("shown")).select("id")


@query("s15_run_rows", f"SELECT id, strategy, {_JSON} AS params FROM runs", "runs")
def s15(t):
    return run_rows(t.runs).select("id", "strategy", "params")


# ---- agent decisions ----------------------------------------------------------------------------

ALERT_NOW = "2024-01-20 12:00:00"


@query("a17_error_alerts", f"""SELECT split_part(rationale, ' - ', 1) AS label, count(*) AS n, arg_max(substr(rationale, instr(rationale, ' - ') + 3), (ts, id)) AS detail, max(ts) AS ts FROM (
  SELECT * FROM decisions WHERE decision = '오류' AND ts > TIMESTAMP '{ALERT_NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{ALERT_NOW}') x GROUP BY 1""", "decisions")
def a17(t):
    return D.error_alerts(t.decisions, ALERT_NOW)


BREADTH = f"SELECT d, count(*) AS codes, CAST(sum(CASE WHEN c < prev_c THEN 1 ELSE 0 END) AS BIGINT) AS falling FROM ({PREV}) p GROUP BY d"


@query("a09_market_breadth", f"SELECT d, codes, falling, {r('falling / codes * 100')} AS fall_pct FROM ({BREADTH}) b", "bars")
def a09(t):
    return rounded(D.market_breadth(t.bars))


GATE = """SELECT code, d, agents, errors, vetoes, buys, reason, reason = 'approved' AS approved, CASE WHEN reason = 'approved' THEN {m} END AS avg_score FROM (
  SELECT *, CASE WHEN errors > 0 THEN 'error' WHEN vetoes > 0 THEN 'veto' WHEN buys < {need} THEN 'consensus' ELSE 'approved' END AS reason FROM (
  SELECT code, CAST(ts AS DATE) AS d, count(*) AS agents, CAST(sum(CASE WHEN decision = '오류' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
    CAST(sum(CASE WHEN agent IN ('market_state', 'risk') AND decision IN ('관망', '청산') THEN 1 ELSE 0 END) AS BIGINT) AS vetoes,
    CAST(sum(CASE WHEN agent IN ({names}) AND decision = '매수' THEN 1 ELSE 0 END) AS BIGINT) AS buys, avg(score) AS m
  FROM decisions e WHERE NOT EXISTS (SELECT 1 FROM decisions n WHERE n.code = e.code AND n.agent = e.agent AND CAST(n.ts AS DATE) = CAST(e.ts AS DATE) AND (n.ts > e.ts OR n.ts = e.ts AND n.id > e.id))
  GROUP BY 1, 2) x) y"""


@query("c20_two_agents", GATE.format(m=r("m"), need=2, names="'disclosure', 'financials'"), "decisions")
def c20_two(t):
    """Both consensus agents must buy; a second reply of one of them is no second vote."""
    return rounded(D.gate(t.decisions.withColumn("d", F.col("ts").cast("date")), ["code", "d"], ("disclosure", "financials")))


@query("c20_gate", GATE.format(m=r("m"), need=1, names="'value_trap'"), "decisions")
def c20(t):
    return rounded(D.gate(t.decisions.withColumn("d", F.col("ts").cast("date")), ["code", "d"], ("value_trap",)))


C31 = f"""SELECT p.code, p.d, p.strategy, {r('x.r60')} AS r60, {r('x.r250')} AS r250, {r('coalesce(b.falling / b.codes * 100, 50)')} AS fall_pct, {r('coalesce(i.trend, 0)')} AS trend_pct,
  CAST(30 - (SELECT count(*) FROM positions q WHERE q.strategy = p.strategy) AS BIGINT) AS free_slots,
  (SELECT count(*) FROM positions q WHERE q.strategy = p.strategy AND substr(q.code, 1, 3) = substr(p.code, 1, 3)) AS same_sector,
  (SELECT count(*) FROM disclosures f WHERE f.code = p.code AND f.d <= p.d AND f.d > p.d - 90) AS filings, CASE WHEN h.n > 0 THEN least(h.n, 5) END AS periods, h.newest
FROM probe p LEFT JOIN (SELECT code, d, c / nullif(lag(c, 59) OVER w, 0) - 1 AS r60, c / nullif(lag(c, 249) OVER w, 0) - 1 AS r250 FROM bars WINDOW w AS (PARTITION BY code ORDER BY d)) x
  ON x.code = p.code AND x.d = p.d LEFT JOIN ({BREADTH}) b ON b.d = p.d LEFT JOIN (SELECT d, (c / nullif(lag(c, 19) OVER (ORDER BY d), 0) - 1) * 100 AS trend FROM bars WHERE code = '{PROXY}') i ON i.d = p.d
LEFT JOIN LATERAL (SELECT count(*) AS n, max(period) AS newest FROM statements f WHERE f.code = p.code
  AND CAST(last_day(make_date(CAST(substr(f.period, 1, 4) AS INTEGER), CAST(substr(f.period, 6, 1) AS INTEGER) * 3, 1)) + 90 AS DATE) <= p.d) h ON TRUE"""


@query("c31_decision_features", C31, "probe positions disclosures bars statements")
def c31(t):
    out = D.decision_features(probe(t), t.bars, t.positions, t.disclosures, t.statements, PROXY, 30)
    return rounded(out.select("code", "d", "strategy", "r60", "r250", "fall_pct", "trend_pct", F.col("free_slots").cast("bigint").alias("free_slots"),
                              "same_sector", "filings", F.size("history").cast("bigint").alias("periods"), F.element_at("history", -1).period.alias("newest")))


@query("c31_statement_history", f"""SELECT code, d, strategy, period, {r('op_income / nullif(revenue, 0)')} AS margin, {r('net_income / nullif(equity, 0)')} AS roe, {r('liabilities / nullif(equity, 0)')} AS debt
FROM (SELECT p.code, p.d, p.strategy, p.mode, f.* EXCLUDE (code), row_number() OVER (PARTITION BY p.code, p.d, p.strategy, p.mode ORDER BY f.period DESC) AS k FROM probe p JOIN statements f ON f.code = p.code
  AND CAST(last_day(make_date(CAST(substr(f.period, 1, 4) AS INTEGER), CAST(substr(f.period, 6, 1) AS INTEGER) * 3, 1)) + 90 AS DATE) <= p.d) x WHERE k <= 5""", "probe statements")
def c31_history(t):
    """The periods and ratios that a candidate's features hold."""
    out = D.decision_features(probe(t), t.bars, t.positions, t.disclosures, t.statements, PROXY, 30)
    return rounded(out.select("code", "d", "strategy", F.explode("history").alias("_h")).select("code", "d", "strategy", "_h.*"))


def _ingest(t):
    e = replies(t)
    broken = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)
    raw = e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("code"), F.col("event_type").alias("agent"),
        (F.col("user_id") % 25).cast("string").alias("scope"), F.concat(F.lit(":"), F.col("props")).alias("prompt"), F.col("text").alias("reply"),
        F.when(broken, "rate_limit_error").alias("error_kind"), F.when(broken, F.col("props")).alias("error_text"))
    stored = t.decisions.where((F.col("decision") != P.ERROR_DECISION) & (F.col("ts") < "2024-01-16"))
    return D.decision_ingest(raw, stored)


@query("c32_decision_ingest", """SELECT CASE WHEN EXISTS (SELECT 1 FROM decisions s WHERE s.ts < TIMESTAMP '2024-01-16' AND s.input_hash = md5(e.event_type || CAST(e.user_id % 25 AS VARCHAR) || ':' || e.props)) THEN 'reused'
  WHEN e.event_type = 'error' THEN 'failures' ELSE 'decided' END AS outcome, count(*) AS n FROM events e GROUP BY 1""", "decisions")
def c32(t):
    out = None
    for name, df in _ingest(t).items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_PROMPT = "md5(e.event_type || CAST(e.user_id % 25 AS VARCHAR) || ':' || e.props)"
_ANSWERED = "(SELECT *, row_number() OVER (PARTITION BY input_hash ORDER BY ts DESC, id DESC) AS rn FROM decisions WHERE decision <> '오류' AND ts < TIMESTAMP '2024-01-16')"
_DECISION = ("id", "code", "agent", "decision", "score", "rationale", "input_hash")


@query("c32_decided", f"""SELECT event_id AS id, CAST(user_id AS VARCHAR) AS code, event_type AS agent, {_WORD} AS decision, CASE WHEN event_id % 4 = 2 THEN 5.0 ELSE floor(value) END AS score,
  props AS rationale, {_PROMPT} AS input_hash FROM events e WHERE event_type <> 'error' AND {_PROMPT} NOT IN (SELECT input_hash FROM {_ANSWERED} s)""", "decisions")
def c32_decided(t):
    return _ingest(t)["decided"].select(*_DECISION)


@query("c32_reused", f"""SELECT e.event_id AS id, CAST(e.user_id AS VARCHAR) AS code, e.event_type AS agent, s.decision, s.score, s.rationale, s.input_hash
FROM events e JOIN {_ANSWERED} s ON s.rn = 1 AND s.input_hash = {_PROMPT}""", "decisions")
def c32_reused(t):
    return _ingest(t)["reused"].select(*_DECISION)


@query("c32_failures", """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '요청 한도 초과 - ' || props ELSE '응답 형식 오류 - no format ' || props END AS rationale FROM events WHERE event_type = 'error'""")
def c32_failures(t):
    return _ingest(t)["failures"].select("id", "rationale")
