"""Deciles of every metric and horizon against plain sorting, with coarse and fine cells, ties and missing values."""
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from tidemark import schemas  # noqa: F401
from tidemark.operators import statistics as ST

PROBS = [i / 10 for i in range(11)]


def plain_edges(rows, m, y):
    xs = sorted(r[m] for r in rows if r[m] is not None and r[y] is not None)
    out = []
    for p in PROBS:
        at = (len(xs) - 1) * p
        low = xs[int(at)]
        out.append(low + (xs[min(int(at) + 1, len(xs) - 1)] - low) * (at - int(at)) if at > int(at) else low)
    return len(xs), out


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        x = rng.choice([rng.gauss(0, 1), rng.choice([0.0, 1.0, -2.5]), rng.uniform(0.1, 0.1001), 1e300, -1e-300, None])
        rows.append({"code": f"{i % 40}", "d": i, "a": x, "b": rng.choice([None, float("nan"), rng.expovariate(1)]), "one": 3.0,
                     "fwd_1": rng.choice([None, rng.gauss(1000, 1)]), "fwd_5": rng.gauss(0, 0.1) if i % 3 else None, "fwd_9": None})
    return rows


def frames(spark, panel):
    df = spark.createDataFrame([tuple(r.values()) for r in panel], "code string, d long, a double, b double, one double, fwd_1 double, fwd_5 double, fwd_9 double")
    return df.select("code", "d", "a", "b", "one"), df.select("code", "d", "fwd_1", "fwd_5", "fwd_9")


@pytest.mark.parametrize("part_rows", [1, 50, 100_000])
def test_deciles_match_sorting(spark, panel, monkeypatch, part_rows):
    monkeypatch.setattr(ST, "PART_ROWS", part_rows)
    signals, forward = frames(spark, panel)
    got = ST.factor_deciles(signals, forward, ["a", "b", "one"], [1, 5, 9], min_rows=10).collect()
    clean = [{k: (None if isinstance(v, float) and v != v else v) for k, v in r.items()} for r in panel]
    want = {}
    for m in ("a", "b"):
        for h in (1, 5):
            edges = sorted(set(plain_edges(clean, m, f"fwd_{h}")[1]))
            for r in clean:
                x, y = r[m], r[f"fwd_{h}"]
                if x is not None and y is not None:
                    want.setdefault((m, h, max(sum(e < x for e in edges) - 1, 0)), []).append((x, y))
    assert {(r["metric"], r["horizon"], r["bucket"]) for r in got} == set(want)  # no edges for one value or without outcomes
    for r in got:
        rows = want[(r["metric"], r["horizon"], r["bucket"])]
        ys = [y for _, y in rows]
        assert (r["n"], r["lo"], r["hi"]) == (len(rows), min(x for x, _ in rows), max(x for x, _ in rows))
        assert r["mean"] == pytest.approx(st.fmean(ys)) and (len(ys) < 2 or r["std"] == pytest.approx(st.stdev(ys), rel=1e-6))


def test_sketched_edges_are_close_in_rank(spark):
    rng = random.Random(1)
    xs = [rng.lognormvariate(0, 2) for _ in range(20_000)]
    long = spark.createDataFrame([("m", x, 1.0) for x in xs], "metric string, x double, y double").repartition(7)
    accuracy = 200
    n, points = ST.conditional_edges(long, ["y"], PROBS, accuracy)[("m", "y")]
    assert n == len(xs)
    for p, q in zip(PROBS, points):
        rank = sum(x <= q for x in xs)
        assert abs(rank - p * n) <= n / accuracy + 1
    rows = ST.quantile_buckets(long, ["metric"], "x", "y", accuracy=accuracy).collect()
    assert sum(r["n"] for r in rows) == n and all(abs(r["n"] - n / 10) <= 2 * n / accuracy + 1 for r in rows)


def test_no_row_is_multiplied_by_the_horizons(spark, panel):
    signals, forward = frames(spark, panel)
    plan = ST.factor_deciles(signals, forward, ["a", "b"], [1, 5], min_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sample" not in plan and plan.count("Generate explode") == 2  # by metric, and once more over the few added-up stretches
    assert ST.factor_deciles(signals.limit(0), forward, ["a"], [1], min_rows=1).collect() == []
