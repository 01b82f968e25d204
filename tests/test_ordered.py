"""Sharded order statistics against pandas, with shards small enough to be used."""
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.ordered import with_shard
from tidemark.operators.statistics import bootstrap_means, compound_drawdown, random_control, validate


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(ordered, "SHARD_ROWS", 20)


@pytest.fixture
def frame(spark):
    rng = random.Random(3)
    # One group holds most rows, and a third of its values are equal.
    rows = [("a" if i % 10 else "b", i, 0.0 if i % 3 == 0 else rng.uniform(-5, 5)) for i in range(1500)]
    return pd.DataFrame(rows, columns=["g", "i", "x"])


def test_row_numbers(spark, small_shards, frame):
    df = ordered.row_numbers(spark.createDataFrame(frame), ["g"], ["x", "i"])
    got = df.toPandas().sort_values(["g", "rn"]).reset_index(drop=True)
    want = frame.sort_values(["g", "x", "i"]).reset_index(drop=True)
    assert list(got["i"]) == list(want["i"])
    assert got.groupby("g")["_total"].first().to_dict() == frame.groupby("g").size().to_dict()


def test_large_group_is_split(spark, small_shards, frame):
    df = ordered.with_shard(spark.createDataFrame(frame), ["g"], ["x", "i"])
    per = df.groupBy("g", "_shard").count().toPandas()
    assert (per[per["g"] == "a"]["count"].max()) < 200 and per[per["g"] == "a"].shape[0] > 30


def test_percentile_rank(spark, small_shards, frame):
    got = ordered.percentile_rank(spark.createDataFrame(frame), ["g"], "x", "p").toPandas().set_index("i")["p"].sort_index()
    want = frame.assign(p=frame.groupby("g")["x"].rank(pct=True)).set_index("i")["p"].sort_index()
    assert np.allclose(got, want)


def test_quantiles(spark, small_shards, frame):
    probs = [i / 10 for i in range(11)]
    got = {r["g"]: r["q"] for r in ordered.exact_quantiles(spark.createDataFrame(frame), ["g"], "x", probs).collect()}
    for g, part in frame.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["x"], probs))


def test_drawdown(spark, small_shards, frame):
    data = frame.assign(r=frame["x"] / 50)
    got = {r["g"]: r["mdd"] for r in compound_drawdown(spark.createDataFrame(data), ["g"], ["i"], "r").collect()}
    for g, part in data.groupby("g"):
        curve = np.cumprod(1 + part.sort_values("i")["r"])
        assert got[g] == pytest.approx(float((curve / np.maximum.accumulate(curve) - 1).min()))


def test_wiped_out_curve(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -1.0), ("a", 3, 0.5)], "g string, i int, r double")
    assert compound_drawdown(df, ["g"], ["i"], "r").first()["mdd"] == -1.0


def test_bootstrap_matches_its_theory(spark, frame):
    df = spark.createDataFrame(frame)
    means = bootstrap_means(df, ["i"], "x", iterations=300).toPandas()["mean"]
    assert len(means) == 300
    assert abs(means.mean() - frame["x"].mean()) < 4 * frame["x"].std() / np.sqrt(1500 * 300)
    assert means.std() == pytest.approx(frame["x"].std() / np.sqrt(1500), rel=0.2)
    again = bootstrap_means(df.repartition(7), ["i"], "x", iterations=300).toPandas()
    assert np.allclose(sorted(again["mean"]), sorted(means))


def test_more_than_256_shards(spark):
    df = spark.range(6000).select(F.lit("a").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("x"))
    sharded = with_shard(df, ["g"], ["x"], shard_rows=10)
    assert sharded.select("_shard").distinct().count() > 256
    local = sharded.groupBy("_shard").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_shard").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(local, local[1:]))


def test_control_and_validation(spark):
    rng = random.Random(3)
    pool = spark.createDataFrame([(i, rng.gauss(0, 1)) for i in range(400)], "i int, ret double")
    got = {r["rule"]: r["pct_rank"] for r in random_control(pool, ["i"], spark.createDataFrame([("low", -9.0), ("mid", 0.0), ("high", 9.0)], "rule string, mean double"), 20, 100, keys=["rule"]).collect()}
    assert got["low"] == 0.0 and got["high"] == 1.0 and 0.2 < got["mid"] < 0.8
    day = lambda i: date(2024, 1, 1) + timedelta(days=i)
    rows = [("good", day(i), f"c{i}", 1.0 + i % 2) for i in range(40)] + [("few", day(i), "c", 1.0) for i in range(9)]
    trades = spark.createDataFrame(rows, "rule string, d date, code string, ret double")

    def between(spans):
        return trades.join(spans, "rule").where(F.col("d").between(F.col("from"), F.col("to")))

    pool = pool.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("d"), F.lit("c").alias("code"), "ret")
    out = {r["rule"]: r for r in validate(lambda s: between(s), trades.withColumn("entry_d", F.col("d")), pool.withColumnRenamed("d", "entry_d"), ["entry_d", "code"], "2024-01-01", "2024-12-31", 50, 50).collect()}
    assert out["good"]["skipped"] is False and out["good"]["bootstrap_pass"] and out["good"]["control_pass"] and out["good"]["t1_n"] + out["good"]["t2_n"] == 41
    assert out["few"]["skipped"] is True and out["few"]["n"] == 9 and out["few"]["bootstrap_pass"] is None and out["few"]["split_date"] is None


def test_owners_delete_only_their_own_tables(spark):
    from tidemark.session import Pins, pin

    rows = spark.range(100).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) AS x")
    ranked = ordered.percentile_rank(rows, ["k"], "x", "pct")  # read lazily from tables that nobody owns
    outer, inner = Pins(), Pins()
    with outer:
        a = pin(rows, "a")
        with inner:
            b = pin(rows, "b")
            kept = pin(rows, "kept", keep=True)
        c = pin(rows, "c")
    inner.clear(spark)
    assert ranked.count() == a.count() == c.count() == kept.count() == 100
    with pytest.raises(Exception):
        b.count()
    outer.clear(spark)
    assert ranked.count() == 100 and outer.paths == []
