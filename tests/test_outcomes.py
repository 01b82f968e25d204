"""Barrier outcomes and trade selection against direct row-by-row folds."""
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.costs import BUY_FACTORS, SELL_FACTORS
from tidemark.operators import outcomes as O
from tidemark.operators import rebalance as R
from tidemark.operators.statistics import trade_statistics


def buy(px):
    return px * BUY_FACTORS[0] * BUY_FACTORS[1]


def sell(px):
    return px * SELL_FACTORS[0] * SELL_FACTORS[1]


def day(i):
    return date(2024, 1, 1) + timedelta(days=i)


def flat(spark, days, code="A", px=100.0):
    return spark.createDataFrame([(code, d, px, px, px, px, 1) for d in days], schemas.STOCK_DAILY)


def test_overlap_case(spark):
    days = [date(2024, 1, i) for i in (2, 3, 4, 5, 8, 9, 10, 11, 12, 15)]
    entries = spark.createDataFrame([("A", date(2024, 1, i)) for i in (2, 3, 9)], "code string, d date")
    # The first entry fills on 01-03 and expires three bars later.
    out = O.non_overlapping(O.barrier_outcomes(flat(spark, days), entries, max_hold=3)).orderBy("d").collect()
    assert [(r["d"].day, r["exit_d"].day, r["reason"]) for r in out] == [(2, 8, "expiry"), (9, 15, "expiry")]
    assert out[0]["ret"] == pytest.approx(-0.00628, abs=1e-5)


def test_stop_fills_at_the_worse_of_stop_and_open(spark):
    rows = [("A", day(0), 100.0, 100.0, 100.0, 100.0, 1), ("A", day(1), 100.0, 100.0, 100.0, 100.0, 1),
            ("A", day(2), 92.0, 95.0, 80.0, 90.0, 1), ("A", day(3), 100.0, 100.0, 100.0, 100.0, 1)]
    bars = spark.createDataFrame(rows, schemas.STOCK_DAILY)
    r = O.outcome_table(bars, max_hold=2).where(F.col("d") == day(0)).first()
    assert (r["exit_d"], r["reason"]) == (day(2), "stop") and r["exit_px"] == pytest.approx(sell(92.0))
    c = O.outcome_table(bars, max_hold=2, stop_on="close").where(F.col("d") == day(0)).first()
    assert c["reason"] == "stop" and c["exit_px"] == pytest.approx(sell(90.0))


def test_unfinished_and_halted_entries_drop(spark):
    bars = flat(spark, [day(i) for i in range(4)])
    assert O.outcome_table(bars, max_hold=5).count() == 0
    assert O.outcome_table(bars, max_hold=5, keep_open=True).count() == 3
    assert O.outcome_table(flat(spark, [day(i) for i in range(4)], px=0.0), max_hold=1).count() == 0
    for bad in (dict(stop_on="high"), dict(count="weeks")):
        with pytest.raises(ValueError):
            O.outcome_table(bars, **bad)


@pytest.fixture(scope="module")
def market():
    """Random walk with gaps, halts and codes that end early; 12 codes over 90 market days."""
    rng = random.Random(11)
    rows, flags = {}, {}
    for k in range(12):
        px = 100.0
        for i in range(90 if k % 4 else 60):
            if rng.random() < 0.05:
                continue
            px = max(5.0, px * (1 + rng.uniform(-0.06, 0.06)))
            o = 0.0 if rng.random() < 0.03 else px * (1 + rng.uniform(-0.02, 0.02))
            rows[(f"C{k:02}", i)] = (o, px * 1.03, px * 0.97, px)
            flags[(f"C{k:02}", i)] = rng.random() < 0.03
    return rows, flags


def frames(spark, market):
    rows, flags = market
    bars = spark.createDataFrame([(c, day(i), *v, 1) for (c, i), v in rows.items()], schemas.STOCK_DAILY)
    marks = spark.createDataFrame([(c, day(i), f) for (c, i), f in flags.items()], "code string, d date, exit_flag boolean")
    return bars.join(marks, ["code", "d"])


def by_code(rows):
    out = {}
    for code, i in sorted(rows):
        out.setdefault(code, []).append(i)
    return out


def test_outcomes_match_a_direct_loop(spark, market):
    rows, flags = market
    want = {}
    for code, days in by_code(rows).items():
        for n, i in enumerate(days[:-1]):
            o = rows[(code, days[n + 1])][0]
            if o <= 0:
                continue
            entry, stop = buy(o), buy(o) * (1 - 0.07)
            for held, j in enumerate(days[n + 2:n + 12], 1):
                oo, _, low, close = rows[(code, j)]
                if low <= stop:
                    want[(code, i)] = (j, "stop", sell(min(stop, oo)) / entry - 1)
                elif flags[(code, j)]:
                    want[(code, i)] = (j, "signal", sell(close) / entry - 1)
                elif held >= 10:
                    want[(code, i)] = (j, "expiry", sell(close) / entry - 1)
                else:
                    continue
                break
    got = {(r["code"], (r["d"] - day(0)).days): r for r in O.outcome_table(frames(spark, market), max_hold=10).collect()}
    assert set(got) == set(want) and len(want) > 500
    for key, (j, reason, ret) in want.items():
        assert (got[key]["exit_d"], got[key]["reason"]) == (day(j), reason) and got[key]["ret"] == pytest.approx(ret)


@pytest.mark.parametrize("inclusive", [True, False])
def test_non_overlapping_matches_a_direct_loop(spark, market, inclusive):
    trades = O.outcome_table(frames(spark, market), max_hold=5)
    want, last = set(), {}
    for r in sorted(trades.collect(), key=lambda r: (r["code"], r["d"])):
        if r["code"] in last and (r["d"] <= last[r["code"]] if inclusive else r["d"] < last[r["code"]]):
            continue
        last[r["code"]] = r["exit_d"]
        want.add((r["code"], r["d"]))
    assert {(r["code"], r["d"]) for r in O.non_overlapping(trades, inclusive=inclusive).collect()} == want


def simulate(rows, flags, rank, slots, hold, stop, judged):
    """Day loop: exits first, then the best unheld candidates for the free slots."""
    market_days = sorted({i for _, i in rows})
    pos = {d: n for n, d in enumerate(market_days)}
    held, trades = {}, []
    for d in market_days[:-1]:
        if d not in judged:
            continue
        nxt = market_days[pos[d] + 1]
        for code in list(held):
            if (code, d) not in rows or pos[d] < held[code][0]:
                continue
            at, entry, signal = held[code]
            o, _, low, close = rows[(code, d)]
            if low <= entry * (1 - stop):
                fill, reason = sell(min(entry * (1 - stop), o)), "stop"
            elif pos[d] - at >= hold:
                fill, reason = sell(close), "expiry"
            elif flags[(code, d)]:
                fill, reason = sell(close), "signal"
            else:
                continue
            trades.append((code, signal, d, reason, round(fill / entry - 1, 9)))
            del held[code]
        free = slots - len(held)
        today = sorted((x, c) for (c, i), x in rank.items() if i == d and c not in held)
        for _, code in today[:max(free, 0)]:
            if (code, nxt) in rows and rows[(code, nxt)][0] > 0:
                held[code] = (pos[nxt], buy(rows[(code, nxt)][0]), d)
    return trades


def test_best_of_each_day_are_independent_trades(spark, market):
    rows, _ = market
    rng = random.Random(5)
    table = O.outcome_table(frames(spark, market), max_hold=6)
    ranked = spark.createDataFrame([(c, day(i), rng.random()) for c, i in rows], "code string, d date, x double")
    ranked = O.top_per_day(ranked, [F.col("x"), F.col("code")], 4).drop("x").join(table, ["code", "d"], "left").withColumn("window", F.lit("w"))
    both = ranked.withColumn("variant", F.lit("a")).unionByName(ranked.withColumn("variant", F.lit("b")))
    got = R.hypothesis_sweep(both, {"a": 1, "b": 3}).collect()
    want = ranked.where(F.col("exit_d").isNotNull()).collect()
    for v, k in (("a", 1), ("b", 3)):
        assert sorted((r["code"], r["d"]) for r in got if r["variant"] == v) == sorted((r["code"], r["d"]) for r in want if r["rank"] <= k)


def test_unlimited_pool_is_the_fold_with_re_entry(spark, market):
    rows, flags = market
    rank = {key: 1.0 for key in rows}
    last = max(i for _, i in rows)
    bars = frames(spark, market).withColumn("judged", F.col("d") != day(last))
    table = O.outcome_table(bars, max_hold=6, monitor_from=0, count="market_days", expiry_first=True, keep_open=True)
    cand = table.withColumn("rank", F.lit(1)).withColumn("variant", F.lit("pool")).withColumn("window", F.lit("w"))
    got = R.hypothesis_sweep(cand, {"pool": None}).collect()
    want = simulate(rows, flags, rank, 10 ** 6, 6, 0.07, {i for _, i in rows})
    assert sorted((r["code"], (r["d"] - day(0)).days) for r in got) == sorted((c, s) for c, s, *_ in want)


def test_statistics_add_up(spark):
    df = spark.createDataFrame([("a", 0.1, 3, "stop"), ("a", -0.1, 5, "expiry"), ("b", 0.2, 1, "stop")], "k string, ret double, held int, reason string")
    s = {r["k"]: r for r in trade_statistics(df, ["k"]).collect()}
    assert s["a"]["n"] == 2 and s["a"]["std_pct"] == pytest.approx(10) and s["a"]["reasons"] == {"expiry": 1, "stop": 1}
    assert s["b"]["t_val"] == 0.0 and trade_statistics(df).first()["n"] == 3


def test_rebalance_periods_cost_only_the_turnover(spark):
    days = spark.createDataFrame([(day(0), day(1)), (day(10), day(11))], "d date, next_d date")
    px = {"A": (10.0, 20.0, 30.0), "B": (10.0, 10.0, 10.0), "C": (10.0, 10.0, 5.0)}
    bars = spark.createDataFrame([(c, d, p, p, p, p, 1) for c, v in px.items() for d, p in zip((day(1), day(11), day(20)), v)], schemas.STOCK_DAILY)
    targets = spark.createDataFrame([(day(0), "A"), (day(0), "B"), (day(10), "B"), (day(10), "C")], "d date, code string")
    rows = R.rebalance_periods(targets, days, bars).orderBy("d", "final").collect()
    buy_cost, sell_cost = buy(1.0) - 1, 1 - sell(1.0)
    assert [r["n"] for r in rows] == [0, 2, 2]
    assert rows[0]["cost"] == pytest.approx(buy_cost) and rows[1]["gross"] == pytest.approx(0.5)
    assert rows[1]["cost"] == pytest.approx(0.5 * sell_cost + 0.5 * buy_cost)
    assert rows[2]["gross"] == pytest.approx(-0.25) and rows[2]["cost"] == pytest.approx(sell_cost)


def orders(spark, held, target, price=100.0, equity=1000.0, entry=80.0):
    pos = spark.createDataFrame([("A", "s", "a", day(0), entry, float(held), 0.0, 99999, "paper")] if held else [], schemas.POSITIONS)
    tgt = spark.createDataFrame([("paper", "s", "A", "a")] if target else [], "mode string, strategy string, code string, name string")
    books = spark.createDataFrame([("paper", "s", equity, 1)], "mode string, strategy string, equity double, slots int")
    return R.rebalance_orders(tgt, pos, spark.createDataFrame([("A", price)], "code string, px double"), books)


def test_delta_orders(spark):
    r = orders(spark, 8, True)["orders"].first()
    assert (r["side"], r["qty"]) == ("buy", 2.0)
    r = orders(spark, 12, True)
    assert (r["orders"].first()["side"], r["orders"].first()["qty"]) == ("sell", 2.0) and r["positions"].first()["entry_px"] == 80.0
    r = orders(spark, 10, False)
    assert r["orders"].first()["qty"] == 10.0 and r["positions"].count() == 0
    assert orders(spark, 10, True)["orders"].count() == 0
    assert orders(spark, 0, True, price=5000.0)["orders"].count() == 0
    blended = orders(spark, 5, True)["positions"].first()["entry_px"]
    assert 80.0 < blended < 101.0


@pytest.mark.parametrize("rules", [
    {}, {"max_hold": 3}, {"max_hold": 40, "stop_pct": 0.2}, {"max_hold": 10, "monitor_from": 0, "count": "market_days"}, {"max_hold": 8, "stop_on": "close"},
    {"max_hold": 4, "min_hold": 9, "expiry_first": True}, {"max_hold": 12, "stop_pct": 0.0}, {"max_hold": 6, "keep_open": True}])
@pytest.mark.parametrize("gaps", [False, True])
def test_given_entries_find_the_paths_of_the_table(spark, market, rules, gaps):
    """Block lookup and sliding paths agree for every rule, with days that are not judged, repeated entries and unknown days."""
    bars = frames(spark, market)
    if gaps:
        bars = bars.withColumn("judged", F.pmod(F.hash("d"), F.lit(3)) != 0)
    table = O.outcome_table(bars, **rules)
    entries = bars.where(F.pmod(F.hash("code", "d"), F.lit(2)) == 0).select("code", "d", F.lit("v").alias("reason_in"))
    entries = entries.unionByName(entries.limit(7)).unionByName(spark.createDataFrame([("C00", date(1990, 1, 1), "v"), ("none", day(3), "v")], "code string, d date, reason_in string"))
    got = O.barrier_outcomes(bars, entries, **rules)
    want = entries.join(table, ["code", "d"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and (rules.get("max_hold") == 40 or want.count() > 100)
    assert O.barrier_outcomes(bars, entries.limit(0), **rules).collect() == []
