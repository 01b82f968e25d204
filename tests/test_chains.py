"""Greedy walks against plain loops: cut into many eras, with ties, nulls and one group that holds everything."""
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains
from tidemark.operators.outcomes import non_overlapping
from tidemark.operators.runs import current_runs

START = date(2000, 1, 1)
TRADE = "rule string, code string, d date, exit_d date, ret double"


def day(i):
    return START + timedelta(days=i)


def plain_walk(rows, inclusive):
    kept, last = set(), {}
    days = {}
    for rule, code, d, x, ret in rows:
        key = (rule, code, d)
        item = (x is not None, x or date.min, ret)
        days[key] = min(days.get(key, item), item)
    for rule, code, d in sorted(days, key=lambda k: (k[0] or "", k[1] or "", k[2])):
        has, x, ret = days[(rule, code, d)]
        at = last.get((rule, code))
        if at is not None and (d <= at if inclusive else d < at):
            continue
        kept.add((rule, code, d, x if has else None, ret))
        last[(rule, code)] = x if has else date.max
    return kept


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("era", [1, 16, 8192])
def test_walk_against_a_loop(spark, monkeypatch, inclusive, era):
    monkeypatch.setattr(chains, "ERA_DAYS", era)
    rng = random.Random(era)
    rows = []
    for rule in ("a", "b", None):
        for code in ("X", "Y", None):
            for i in range(120):
                if rng.random() < 0.7:
                    hold = rng.choice([0, 1, 2, 5, 20, 60]) if rng.random() < 0.98 else None
                    rows += [(rule, code, day(i), None if hold is None else day(i + hold), rng.random())] * rng.choice([1, 1, 1, 2])
    rows += [("c", "Z", day(5), None, 0.0), ("c", "Z", day(9), day(10), 0.0), ("d", "Z", day(9), day(9), 0.0), ("d", "Z", day(9), day(12), 1.0)]
    trades = spark.createDataFrame(rows, TRADE)
    got = [tuple(r) for r in non_overlapping(trades, ["rule"], inclusive).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_walk(rows, inclusive)
    assert non_overlapping(trades.limit(0), ["rule"]).collect() == []


def test_a_million_signals_of_one_code_are_walked_by_many_tasks(spark):
    n = 1_000_000
    hold = F.col("id") * 7919 % 23 + 1
    trades = spark.range(n).select(F.lit("X").alias("code"), F.date_add(F.lit("0001-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
                                   F.date_add(F.lit("0001-01-01").cast("date"), (F.col("id") + hold).cast("int")).alias("exit_d"))
    want, at = [], 0
    while at < n:
        want.append(at)
        at += at * 7919 % 23 + 2
    got = non_overlapping(trades).select(F.datediff("d", F.lit("0001-01-01").cast("date")).alias("i"), F.spark_partition_id().alias("p")).collect()
    assert sorted(r["i"] for r in got) == want and len({r["p"] for r in got}) > 1


RUN = "id long, ts timestamp, strategy string, start_d date, end_d date, params map<string,string>, n long, mean_pct double, std_pct double, t_val double"


def plain_current(rows):
    """Newest first per rule, each kept unless it overlaps a kept one."""
    kept, spans = set(), {}
    for key, ts, rule, a, b in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
        mine = spans.setdefault(rule, [])
        if all(hi < a or b < lo for lo, hi in mine):
            mine.append((a, b))
            kept.add(key)
    return kept


def frame(spark, rows):
    return spark.createDataFrame([(k, ts, "s", a, b, {"rank_col": rule}, 1, 0.0, 0.0, 0.0) for k, ts, rule, a, b in rows], RUN)


def test_current_runs_against_a_loop(spark):
    from datetime import datetime

    rng = random.Random(2)
    rows = []
    for k in range(900):
        a = rng.randrange(400)
        rows.append((k, datetime(2024, 1, 1, rng.randrange(24)), rng.choice("pqr"), day(a), day(a + rng.choice([0, 3, 10, 90]))))
    got = {r["id"] for r in current_runs(frame(spark, rows)).where("current").collect()}
    assert got == plain_current(rows) and len(got) > 20


def test_many_windows_of_one_rule(spark):
    """A staircase, each window newer than the one it overlaps: one component of 10^5 windows, decided from its newest end."""
    n = 100_000
    step = lambda c, k: F.date_add(F.lit("0001-01-01").cast("date"), (F.col(c) * 2 + k).cast("int"))
    runs = spark.range(n).select("id", F.timestamp_seconds("id").alias("ts"), F.lit("s").alias("strategy"), step("id", 0).alias("start_d"), step("id", 2).alias("end_d"),
                                 F.create_map(F.lit("rank_col"), F.lit("x")).alias("params"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("mean_pct"))
    got = current_runs(runs).where("current").select("id").collect()
    assert sorted(r["id"] for r in got) == list(range(1, n, 2))
