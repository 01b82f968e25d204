from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import books as B
from tidemark.operators import calendar as C
from tidemark.operators import decisions as D
from tidemark.operators import filters as FL
from tidemark.operators import outcomes as O
from tidemark.operators import runs as U

RUN = "id bigint, ts timestamp, strategy string, start_d date, end_d date, params map<string,string>, n bigint, mean_pct double, std_pct double, t_val double"


def run(i, params, start="2022-01-01", end="2024-12-31", ts="2026-08-20", mean=0.0, std=15.0, n=250, t=0.0, strategy="s"):
    return (i, datetime.fromisoformat(ts), strategy, date.fromisoformat(start), date.fromisoformat(end), params, n, mean, std, t)


def effects(spark, rows):
    return {r["setting"]: r for r in U.setting_effects(spark.createDataFrame(rows, RUN)).collect()}


def test_only_one_setting_may_differ(spark):
    rows = [run(1, {"slots": "5", "rank_col": "heat_score"}), run(2, {"slots": "12", "rank_col": "heat_score"}), run(3, {"slots": "12", "rank_col": "volume_ratio"})]
    assert set(effects(spark, rows)) == {"slots"}


def test_windows_must_match(spark):
    assert effects(spark, [run(1, {"slots": "5"}), run(2, {"slots": "12"}, "2025-01-01", "2026-08-19")]) == {}


def test_settings_that_move_together_count_once(spark):
    got = effects(spark, [run(1, {"slots": "5"}), run(2, {"slots": "5", "exit_rank_pct": "0.9", "exit_cols": "x"})])
    assert set(got) == {"signal_exit"} and got["signal_exit"]["verdict"] == "none"


def test_sign_flip_and_agreement(spark):
    def four(b):
        return [run(1, {"slots": "5"}, mean=-1.5), run(2, {"slots": "12"}, mean=-0.5), run(3, {"slots": "5"}, "2025-01-01", "2026-01-01", mean=1.0),
                run(4, {"slots": "12"}, "2025-01-01", "2026-01-01", mean=b)]

    assert effects(spark, four(-1.0))["slots"]["verdict"] == "bad"
    assert effects(spark, four(1.5))["slots"]["verdict"] == "warn"
    assert effects(spark, four(9.0))["slots"]["verdict"] == "good"


def test_standard_error(spark):
    pairs = spark.createDataFrame([(100, 1.0, 10.0, 100, 2.0, 10.0)], "a_n long, a_mean_pct double, a_std_pct double, b_n long, b_mean_pct double, b_std_pct double")
    assert U.with_delta(pairs).first()["se"] == pytest.approx(2 ** 0.5)


def test_measured_again(spark):
    rows = [run(1, {"a": "1"}, "2025-01-01", "2026-08-18", "2026-08-19"), run(2, {"a": "1"}, "2025-01-01", "2026-08-19", "2026-08-20"), run(3, {"a": "1"}, ts="2026-08-20")]
    got = {r["id"]: r["current"] for r in U.current_runs(spark.createDataFrame(rows, RUN)).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_walk_forward_edge_and_rank_table(spark):
    wf = {"walkforward": "true", "rank_col": "x"}
    rows = [run(1, {**wf, "slots": "5"}, mean=1.0, t=2.5), run(2, {**wf, "is_control": "true"}, mean=0.2), run(3, {**wf}, "2020-01-01", "2020-12-31")]
    got = {r["id"]: (r["verdict"], r["base_id"]) for r in U.walkforward_edges(spark.createDataFrame(rows, RUN)).collect()}
    assert got == {1: ("good", 2), 3: ("none", None)}
    ranks = [run(1, {"rank_col": "x"}, mean=1.0, t=2.5), run(2, {"rank_col": "x"}, "2025-01-01", "2026-01-01", mean=0.5), run(3, {"rank_col": "y"}, mean=-1.0)]
    assert {r["rank_col"]: r["verdict"] for r in U.rank_factor_table(spark.createDataFrame(ranks, RUN)).collect()} == {"x": "good", "y": "none"}


def test_trust(spark):
    rows = [run(1, {"point_in_time_universe": "true"}), run(2, {"marcap_filter": "false"}), run(3, {"slots": "5"}), run(4, {"marcap_filter": "true"})]
    assert {r["id"] for r in spark.createDataFrame(rows, RUN).where(FL.trusted_run(F.col("params"))).collect()} == {1, 2}


AGENT = "k string, agent string, decision string, score double, ts timestamp, id long"


@pytest.mark.parametrize("votes,reason", [
    ({"market_state": "매수", "risk": "매수", "value_trap": "매수"}, "approved"), ({"market_state": "관망", "risk": "매수", "value_trap": "매수"}, "veto"),
    ({"market_state": "매수", "risk": "청산", "value_trap": "매수"}, "veto"), ({"market_state": "매수", "risk": "매수", "value_trap": "관망"}, "consensus"),
    ({"market_state": "관망", "risk": "매수", "value_trap": "오류"}, "error")])
def test_gate(spark, votes, reason):
    rows = [("x", a, d, 8.0, datetime(2026, 8, 20), i) for i, (a, d) in enumerate(votes.items())]
    r = D.gate(spark.createDataFrame(rows, AGENT), ["k"], ("value_trap",)).first()
    assert r["reason"] == reason and r["approved"] == (reason == "approved") and r["avg_score"] == (8.0 if reason == "approved" else None)


def test_gate_counts_agents_not_replies(spark):
    def ask(*votes):
        rows = [("x", a, d, 8.0, datetime(2026, 8, 20), i) for i, (a, d) in enumerate(votes)]
        return D.gate(spark.createDataFrame(rows, AGENT), ["k"], ("one", "two")).first()["reason"]

    assert ask(("one", "매수"), ("one", "매수")) == "consensus"
    assert ask(("one", "매수"), ("two", "관망"), ("two", "매수")) == "approved"
    assert ask(("one", "매수"), ("two", "매수"), ("two", "관망")) == "consensus"


def test_alerts_count_every_failure(spark):
    now = datetime(2026, 8, 20, 12)
    rows = [(i, now, "오류", "요청 한도 초과 - x") for i in range(501)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, decision string, rationale string")
    assert D.error_alerts(df, "2026-08-20 12:00:00").first()["n"] == 501


def test_history_is_what_was_public(spark):
    statement = "code string, period string, revenue double, op_income double, net_income double, equity double, liabilities double"
    facts = spark.createDataFrame([("A", f"{y}Q4", 10.0, float(y), 1.0, 2.0, 1.0) for y in range(2018, 2026)], statement)
    asked = spark.createDataFrame([("A", date(2021, 6, 1)), ("A", date(2026, 6, 1)), ("A", date(2018, 6, 1))], "code string, d date")
    got = {r["d"].year: [h["period"] for h in r["history"]] for r in D.statement_history(facts, asked).collect()}
    assert got == {2021: ["2018Q4", "2019Q4", "2020Q4"], 2026: [f"{y}Q4" for y in range(2021, 2026)]}


def test_failures_keep_the_whole_reply(spark):
    schema = "id bigint, ts timestamp, code string, agent string, scope string, prompt string, reply string, error_kind string, error_text string"
    raw = spark.createDataFrame([(1, datetime(2026, 8, 20), "A", "risk", None, "p", "?" * 900, None, None)], schema)
    assert D.decision_ingest(raw)["failures"].first()["rationale"].count("?") == 900


def test_ingest_reuses_and_separates(spark):
    schema = "id bigint, ts timestamp, code string, agent string, scope string, prompt string, reply string, error_kind string, error_text string"
    t = datetime(2026, 8, 20)
    raw = spark.createDataFrame([
        (1, t, "A", "risk", None, "p", "결정: 매수 / 확신: 8 / 이유: x", None, None), (2, t, "A", "risk", None, "q", "??", None, None),
        (3, t, "A", "market_state", "market:s", "p", None, "api_error", "your credit balance is too low"), (4, t, "B", "market_state", "market:s", "z", "x", None, None)], schema)
    first = D.decision_ingest(raw)
    assert [r["id"] for r in first["decided"].collect()] == [1]
    bad = {r["id"]: r for r in first["failures"].collect()}
    assert set(bad) == {2, 3, 4} and bad[3]["rationale"].startswith("크레딧 잔액 부족 - ") and bad[2]["input_hash"] is None
    stored = first["decided"].unionByName(first["failures"])
    again = D.decision_ingest(raw, stored)
    assert [r["decision"] for r in again["reused"].collect()] == ["매수"] and again["decided"].count() == 0


def ledger(spark, rows):
    full = [(i, datetime.fromisoformat(ts), "paper", side, code, code, qty, px, qty * px, s, agents, None, None) for i, (ts, side, code, qty, px, s, agents) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.TRADES)


def test_cash_and_snapshot(spark):
    book = ledger(spark, [("2024-01-02", "buy", "A", 10.0, 100.0, "s", "{}"), ("2024-01-03", "sell", "A", 5.0, 120.0, "s", None), ("2024-01-03", "buy", "B", 1.0, 50.0, "old", "{}")])
    settings = spark.createDataFrame([("CAPITAL_s", "5000"), ("CAPITAL_bad", "x"), ("RETIRED_STRATEGIES", " old , ")], schemas.SETTINGS)
    pos = spark.createDataFrame([("A", "s", "a", date(2024, 1, 2), 100.0, 5.0, 0.0, 20, "paper"), ("A", "t", "a", date(2024, 1, 2), 100.0, 1.0, 0.0, 20, "paper")], schemas.POSITIONS)
    bars = spark.createDataFrame([("A", date(2024, 1, 3), 1.0, 1.0, 1.0, 130.0, 1)], schemas.STOCK_DAILY)
    got = {r["strategy"]: (r["cash"], r["positions_value"], r["total_equity"]) for r in B.equity_snapshot(book, pos, bars, "2024-01-05", settings).collect()}
    assert got == {"s": (4600.0, 650.0, 5250.0), "t": (1e7, 130.0, 1e7 + 130.0)}


def test_entry_record_prefers_the_named_opinion(spark):
    book = ledger(spark, [("2024-01-02", "buy", "A", 1.0, 1.0, "s", '{"value_trap": 1}'), ("2024-01-03", "buy", "A", 1.0, 1.0, "s", '{"risk": 1}'), ("2024-01-04", "buy", "A", 1.0, 1.0, "s", "{}")])
    assert B.entry_records(book).first()["agents"] == '{"value_trap": 1}'


def test_match_exits_touches_the_newest_open_buy(spark):
    book = ledger(spark, [("2024-01-02", "buy", "A", 1.0, 1.0, "s", "{}"), ("2024-01-03", "buy", "A", 1.0, 1.0, "s", "{}")])
    sells = spark.createDataFrame([(9, datetime(2024, 1, 5), "A", "paper", "s", "stop", -0.1)], "id long, ts timestamp, code string, mode string, strategy string, exit_reason string, realized_pct double")
    assert {r["id"]: r["exit_reason"] for r in B.match_exits(book, sells).collect()} == {0: None, 1: "stop"}


def test_every_sell_closes_the_newest_open_buy_before_it(spark):
    book = ledger(spark, [(f"2024-01-{d:02}", "buy", "A", 1.0, 1.0, "s", "{}") for d in (2, 3, 6, 20)])
    kind = "id long, ts timestamp, code string, mode string, strategy string, exit_reason string, realized_pct double"
    sells = spark.createDataFrame([(90 + d, datetime(2024, 1, d), "A", "paper", "s", f"r{d}", 0.1) for d in (1, 5, 7, 8, 9)], kind)
    assert {r["id"]: r["exit_reason"] for r in B.match_exits(book, sells).collect()} == {0: "r8", 1: "r5", 2: "r7", 3: None}


def test_ratios_of_nothing_are_null(spark):
    equity = spark.createDataFrame([("paper", date(2024, 1, i), 0.0, 0.0, float(i - 2)) for i in (2, 3)], "mode string, d date, cash double, positions_value double, total_equity double")
    assert [r["day_ret"] for r in B.equity_by_day(equity).collect()] == [None, None]


def test_exit_priority(spark):
    d = date(2024, 1, 10)
    bars = spark.createDataFrame([("A", date(2024, 1, i), 1.0, 1.0, 1.0, 90.0, 1) for i in range(2, 11)], schemas.STOCK_DAILY)

    def reason(stop, hold, heat, **kw):
        pos = spark.createDataFrame([("A", "s", "a", date(2024, 1, 3), 100.0, 1.0, stop, hold, "paper")], schemas.POSITIONS)
        sig = spark.createDataFrame([("A", d, heat, "sell")], "code string, d date, heat_score double, signal string")
        row = O.exits(pos, bars, d, None if heat is None else sig, **kw).first()
        return row and row["reason"]

    assert reason(95.0, 1, 9.0) == "stop" and reason(50.0, 7, 9.0) == "expiry" and reason(50.0, 8, 9.0) == "heat_signal"
    assert reason(50.0, 8, 5.0) is None and reason(50.0, 3, None, min_hold=8) is None and reason(50.0, 3, None, min_hold=5) == "expiry"


def test_month_ranges_and_signal_date(spark):
    df = spark.createDataFrame([(date(2024, 1, 15), date(2024, 3, 10))], "a date, b date")
    got = [(r["range_start"], r["range_end"]) for r in C.month_ranges(df, "a", "b").orderBy("range_start").collect()]
    assert got == [(date(2024, 1, 15), date(2024, 1, 31)), (date(2024, 2, 1), date(2024, 2, 29)), (date(2024, 3, 1), date(2024, 3, 10))]
    bars = spark.createDataFrame([(date(2024, 1, i),) for i in (2, 3, 4, 5)], "d date")
    signals = spark.createDataFrame([(date(2024, 1, 2),), (date(2024, 1, 3),)], "d date")
    got = {r["today"].day: r["signal_d"] and r["signal_d"].day for r in C.entry_signal_dates(signals, bars).collect()}
    assert got == {2: None, 3: 2, 4: 3, 5: None}


def test_alerts_group_by_label(spark):
    rows = [(i, datetime(2024, 1, 1, 12, i), "A", "risk", 0.0, "오류", f"{lab} - d{i}", "m", None) for i, lab in enumerate(["x", "y", "x"])]
    rows.append((9, datetime(2023, 12, 30), "A", "risk", 0.0, "오류", "x - old", "m", None))
    got = {r["label"]: (r["n"], r["detail"]) for r in D.error_alerts(spark.createDataFrame(rows, schemas.DECISIONS), "2024-01-01 13:00:00").collect()}
    assert got == {"x": (2, "d2"), "y": (1, "d1")}


def test_allocation_folds_the_tail(spark):
    pos = spark.createDataFrame([(f"C{i}", "s", f"n{i}", date(2024, 1, 1), 10.0, float(i + 1), 0.0, 20, "paper") for i in range(9)], schemas.POSITIONS)
    prices = spark.createDataFrame([("C0", 10.0)], "code string, last_c double")
    out = B.allocation(pos, prices, spark.createDataFrame([("paper", "s", -5.0)], "mode string, strategy string, cash double")).collect()
    assert len(out) == 9 and {r["label"]: r["value"] for r in out}["cash"] == 0.0
    assert [r["value"] for r in out if r["label"].startswith("other")] == [30.0]
