import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.effects import effects

SCHEMA = "start_d int, end_d int, setting string, rest string, id long, value string, n long, mean_pct double, std_pct double"


def by_pairs(rows):
    out = {}
    for a in rows:
        for b in rows:
            known = all(r[6] and r[7] is not None and r[8] is not None for r in (a, b))
            if a[:4] == b[:4] and a[4] < b[4] and a[5] != b[5] and known:
                delta, se = b[7] - a[7], math.sqrt(a[8] ** 2 / a[6] + b[8] ** 2 / b[6])
                out.setdefault(a[2], []).append((delta, abs(delta / se) if se > 0 else 0.0))
    return {k: (len(v), sum(d for d, _ in v) / len(v), min(d for d, _ in v), max(d for d, _ in v), max(z for _, z in v)) for k, v in out.items()}


def compare(spark, rows, shard_rows):
    got = {r["setting"]: (r["n_comp"], r["mean_delta"], r["lo"], r["hi"], r["max_abs_z"])
           for r in effects(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_rows).collect()}
    want = by_pairs(rows)
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9), k


def test_effects_agree_with_all_pairs(spark):
    rnd = random.Random(3)
    rows = []
    for setting in ("slots", "exit", "lone", "same", "ties"):
        for i in range(60):
            value = "x" if setting == "same" else rnd.choice(("", "a", "b", "c")) if setting != "lone" else str(i)
            mean = rnd.choice((0.0, 1.0, 2.0)) if setting == "ties" else rnd.gauss(0, 3) + (i if setting == "lone" else 0)
            rows.append((2020 + rnd.randrange(2), 2021, setting, rnd.choice(("r", "s")), rnd.randrange(10**6) * 5 + len(rows) % 5, value, rnd.choice((0, 5, 30, 200)),
                         rnd.choice((None, mean, mean, mean, mean)), rnd.choice((None, 0.0, 1.0, 2.5, 9.0, rnd.random()))))
    rows = list({r[4]: r for r in rows}.values())
    compare(spark, rows, None)
    compare(spark, rows, 4)  # many shards in every group


def test_larger_errors_with_larger_means(spark):
    rows = [(1, 2, "s", "r", i, "ab"[i % 2], 10, float(i), float(i)) for i in range(40)]
    compare(spark, rows, 7)


def test_a_group_of_many_runs(spark):
    n = 200_000
    runs = spark.range(n).select(
        F.lit(1).alias("start_d"), F.lit(2).alias("end_d"), F.lit("s").alias("setting"), F.lit("r").alias("rest"), "id", (F.col("id") % 3).cast("string").alias("value"),
        F.lit(10).cast("long").alias("n"), (F.col("id") * 7919 % 100_003).cast("double").alias("mean_pct"), (F.col("id") * 104_729 % 99_991 + 1.0).alias("std_pct"))
    row = effects(runs).first()
    sizes = [len(range(k, n, 3)) for k in range(3)]
    assert row["n_comp"] == (n * n - sum(x * x for x in sizes)) // 2


def test_no_comparisons(spark):
    assert effects(spark.createDataFrame([], SCHEMA)).count() == 0
    assert effects(spark.createDataFrame([(1, 2, "s", "r", 1, "a", 5, 1.0, 1.0)], SCHEMA)).count() == 0
