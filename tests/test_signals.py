import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import signals as S
from tidemark.operators import windows as W


def day(i):
    return date(2024, 1, 1) + timedelta(days=i)


def bars_of(spark, closes, volumes=None, code="000010"):
    v = volumes or [100] * len(closes)
    return spark.createDataFrame([(code, day(i), float(c), float(c), float(c), float(c), v[i]) for i, c in enumerate(closes)], schemas.STOCK_DAILY)


@pytest.fixture
def sources(spark):
    bars = bars_of(spark, [100] * 30 + [300])
    flows = spark.createDataFrame([("000010", day(i), 100, 100, 50) for i in range(30)] + [("000010", day(30), 300, -200, 100)], schemas.INVESTOR_FLOW)
    credit = spark.createDataFrame([("000010", day(i), 1000, 0.5) for i in range(30)] + [("000010", day(30), 2000, 1.25)], schemas.CREDIT_BALANCE)
    return bars, flows, credit


def check(row):
    assert row["individual_flow_ratio"] == pytest.approx(3) and row["credit_surge_ratio"] == pytest.approx(2)
    assert row["volume_ratio"] == pytest.approx(3) and row["foreign_flow_ratio"] == pytest.approx(-2)
    assert row["institution_flow_ratio"] == pytest.approx(2) and row["credit_ratio_level"] == 1.25
    assert row["heat_score"] == pytest.approx(10) and row["signal"] == "sell"


def test_six_factors_on_one_day(sources):
    check(S.signals_on(*sources, "2024-01-31").first())


def test_history_agrees_with_one_day(sources):
    rows = S.signals_history(*sources).collect()
    assert len(rows) == 1
    check(rows[0])


def test_zero_denominator_is_missing(spark, sources):
    _, _, credit = sources
    zero = spark.createDataFrame([("000010", day(i), 0, 0, 0) for i in range(30)] + [("000010", day(30), 100, 1, 1)], schemas.INVESTOR_FLOW)
    row = S.signals_history(sources[0], zero, credit).first()
    assert row["individual_flow_ratio"] is None and row["heat_score"] == pytest.approx(6)


def test_missing_flow_row_breaks_the_window(sources):
    bars, flows, credit = sources
    row = S.signals_history(bars, flows.where(F.col("d") != day(5)), credit).first()
    assert row["individual_flow_ratio"] is None and row["volume_ratio"] is not None


def test_credit_is_carried_forward(sources):
    bars, flows, credit = sources
    row = S.signals_history(bars, flows, credit.where(F.col("d") < day(30))).first()
    assert row["credit_surge_ratio"] == pytest.approx(1) and row["credit_ratio_level"] == 0.5


def test_thirty_bars_are_not_enough(sources):
    bars, flows, credit = sources
    assert S.signals_history(bars.where(F.col("d") < day(30)), flows, credit).count() == 0


def test_no_look_ahead(spark):
    closes = [100 + (i * 7) % 13 for i in range(60)]
    full = bars_of(spark, closes)
    changed = bars_of(spark, closes[:45] + [9999] * 15)
    cols = ["d", "ret", "sma20", "vol20", "vr30", "ar30", "pos52w"]
    a = W.indicator_panel(full).where(F.col("d") < day(45)).select(cols).orderBy("d").collect()
    b = W.indicator_panel(changed).where(F.col("d") < day(45)).select(cols).orderBy("d").collect()
    assert a == b


def test_range_position_excludes_today_and_flat_ranges(spark):
    bars = bars_of(spark, [10, 20, 30, 15])
    pos = [r["p"] for r in W.with_position_in_range(bars, "p", 3, 1).orderBy("d").collect()]
    assert pos[0] is None and pos[1] is None and pos[2] == pytest.approx(2.0) and pos[3] == pytest.approx(0.25)


def test_prior_ranges_match_a_loop(spark):
    """Blocks of every length against all rows before, with halted bars (no low, no high) and codes shorter than a block."""
    rng = random.Random(3)
    rows = []
    for code, size in (("A", 61), ("B", 7), ("C", 1)):
        for i in range(size):
            low = rng.choice([None, rng.uniform(1, 9)])
            rows.append((code, day(i), 5.0, None if low is None else low + rng.random(), low, 5.0, 1))
    bars = spark.createDataFrame(rows, schemas.STOCK_DAILY)
    for n in (1, 2, 5, 7, 20, 61, 100):
        got = {(r["code"], r["d"]): r for r in W.with_prior_range(bars, n).collect()}
        assert len(got) == len(rows)
        for code in "ABC":
            mine = [r for r in rows if r[0] == code]
            for i, r in enumerate(mine):
                before = [x for x in mine[max(0, i - n) : i] if x[4] is not None]
                g = got[(code, r[1])]
                assert (g["_prior_n"], g["_prior_lo"], g["_prior_hi"]) == (len(before), min((x[4] for x in before), default=None), max((x[3] for x in before), default=None))


def test_forward_return_skips_halted_open(spark):
    bars = spark.createDataFrame([("A", day(i), o, o, o, c, 1) for i, (o, c) in enumerate([(10.0, 10.0), (0.0, 11.0), (12.0, 12.0), (13.0, 15.0)])], schemas.STOCK_DAILY)
    got = [r["r"] for r in bars.select("d", W.forward_return(F.col("o"), F.col("c"), 1).alias("r")).orderBy("d").collect()]
    assert got[0] is None and got[1] == pytest.approx(15 / 12 - 1) and got[2] is None


def test_a_range_is_a_slice_of_the_full_run(spark):
    bars = bars_of(spark, [100 + i * 7 % 13 for i in range(40)])
    flows = spark.createDataFrame([("000010", day(i), 100 + i * 5 % 11, 100, 50) for i in range(40)], schemas.INVESTOR_FLOW)
    credit = spark.createDataFrame([("000010", day(i), 1000 + i, 0.5) for i in range(0, 40, 3)], schemas.CREDIT_BALANCE)
    sources = (bars, flows, credit)
    full = S.signals_history(*sources)
    start, end = day(33), day(36)
    part = S.signals_history(*sources, start=start, end=end)
    want = full.where(F.col("d").between(F.lit(start), F.lit(end)))
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, want.collect())) and part.count() > 0
    plan = S.signals_history(bars, flows, credit, end=end)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(str(end)) >= 1


def test_any_cut_into_batches_gives_the_history(spark, tmp_path):
    """Codes that start late, pause over whole batches or lack sources; batches of one day and of many; a batch delivered again."""
    rng = random.Random(6)
    bars, flows, credit = [], [], []
    for code, days in (("000010", range(90)), ("000020", range(50, 90)), ("000030", [*range(40), *range(70, 90)]), ("000040", range(88, 90))):
        for i in days:
            bars.append((code, day(i), 1.0, 2.0, 1.0, rng.uniform(1, 9), rng.randrange(1, 99)))
            if rng.random() < 0.97:
                flows.append((code, day(i), rng.randrange(-50, 50), rng.randrange(-50, 50), rng.randrange(-50, 50)))
            if rng.random() < 0.2:
                credit.append((code, day(i), rng.randrange(100, 900), rng.choice([None, 0.5, 0.7])))
    sources = [spark.createDataFrame(r, k) for r, k in ((bars, schemas.STOCK_DAILY), (flows, schemas.INVESTOR_FLOW), (credit, schemas.CREDIT_BALANCE))]
    want = sorted(map(str, S.signals_history(*sources).collect()))
    assert len(want) > 60
    for k, cuts in enumerate(([0, 90], [0, 31, 60, 90], [0, 5, 45, 46, 47, 71, 89, 90])):
        folder = str(tmp_path / str(k))
        spans = list(zip(cuts, cuts[1:]))
        for number, (a, b) in enumerate([*spans, spans[-1]], 1):
            S.advance_signals(folder, number, *(x.where((F.col("d") >= day(a)) & (F.col("d") < day(b))) for x in sources))
        assert sorted(map(str, S.stored_signals(spark, folder).collect())) == want
        state = spark.read.parquet(f"{folder}/state/{len(spans) + 1}").groupBy("code").count().collect()
        assert {r["code"]: r["count"] for r in state} == {"000010": 30, "000020": 30, "000030": 30, "000040": 2}


def test_held_codes_leave_only_on_their_days(spark):
    from tidemark.operators.outcomes import contrarian_candidates

    rows = [("000010", day(i), 1.0, 1.0, 0.2, 0.2, 100) for i in range(25)]
    bars = spark.createDataFrame(rows, schemas.STOCK_DAILY)
    signals = bars.select("code", "d", F.lit(1.0).alias("heat_score"), F.lit("neutral").alias("signal"), F.lit(0.1).alias("institution_flow_ratio"))
    got = lambda held: sorted(r["d"] for r in contrarian_candidates(signals, bars, 0.0, held=held).collect())
    free = got(None)
    assert day(23) in free and got(spark.createDataFrame([("000010", day(23))], "code string, d date")) == [d for d in free if d != day(23)]
    assert got(spark.createDataFrame([("000010",)], "code string")) == []


def uneven_sources(spark, seed=5):
    """Codes with suspensions, late listings and delistings, and credit told daily, rarely, once, on days without a bar, or never."""
    rnd = random.Random(seed)
    bars, flows, credit = [], [], []
    for k in range(24):
        code, keep, told = f"{k:05}0", rnd.choice((1.0, 0.6, 0.15)), rnd.choice((1.0, 0.02, 0.0))
        first, last = rnd.choice((0, 0, 150, 230)), rnd.choice((400, 400, 260))
        gap = rnd.choice(((0, 0), (60, 200), (180, 215)))
        for i in range(first, last):
            if gap[0] <= i < gap[1] or rnd.random() > keep:
                if rnd.random() < 0.02:
                    credit.append((code, day(i), rnd.randrange(1, 99), rnd.random()))  # no bar on that day
                continue
            bars.append((code, day(i), *[float(rnd.randrange(1, 50))] * 4, rnd.randrange(0, 9)))
            if rnd.random() < 0.9:
                flows.append((code, day(i), *[rnd.randrange(-9, 9) for _ in range(3)]))
            if rnd.random() < told or (i == first + 3 and k % 3 == 0):
                credit.append((code, day(i), rnd.choice((None, rnd.randrange(1, 99))), rnd.choice((None, rnd.random()))))
    frames = (spark.createDataFrame(rows, schema) for rows, schema in (
        (bars, schemas.STOCK_DAILY), (flows, schemas.INVESTOR_FLOW), (credit, schemas.CREDIT_BALANCE)))
    return tuple(df.repartition(2) for df in frames)


def rows_of(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in row]) for row in df.collect())


def test_range_with_warmup_equals_the_full_run(spark):
    sources = uneven_sources(spark)
    full = S.signals_history(*sources).cache()
    for start, end in ((day(205), day(245)), (day(35), None), (day(300), day(301)), (day(500), None)):
        want = full.where((F.col("d") >= F.lit(start)) & (F.lit(True) if end is None else F.col("d") <= F.lit(end)))
        got = rows_of(S.signals_history(*sources, start=start, end=end))
        assert got == rows_of(want) and (len(got) > 0) == (start < day(400))
    full.unpersist()


def test_one_day_reads_recent_days_first(spark, tmp_path):
    sources = uneven_sources(spark, 9)
    stored = []
    for name, df in zip(("bars", "flows", "credit"), sources):
        df.write.parquet(f"{tmp_path}/{name}")
        stored.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for d in (day(90), day(240), day(399)):
        want = S.signals_on(*sources, d)
        recent = [x.where(F.col("d") <= F.lit(d)) for x in sources]
        by_hand = {r["code"]: r["_n"] for r in recent[0].groupBy("code").agg(F.count("*").alias("_n"), F.max("d").alias("l")).where(F.col("l") == F.lit(d)).collect()}
        got = {r["code"]: r["volume_ratio"] for r in S.signals_on(*stored, d).collect()}
        assert set(got) == {c for c, n in by_hand.items() if n > 30} and len(got) > 0
        assert rows_of(want) == rows_of(S.signals_on(*stored, d))
        rows = {c: [r["x"] for r in recent[0].where(F.col("code") == c).orderBy(F.desc("d")).select((F.col("c") * F.col("v")).alias("x")).limit(31).collect()] for c in list(got)[:3]}
        for c, x in rows.items():
            mean = sum(x[1:]) / 30
            assert got[c] == (pytest.approx(x[0] / mean) if mean > 0 else None)
    plan = S.signals_history(*stored, start=day(300), end=day(310))._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(d,{day(210)})" in plan
