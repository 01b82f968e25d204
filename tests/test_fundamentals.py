from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import filters as FL
from tidemark.operators import fundamentals as V


def statements(spark, rows):
    full = [(c, p, div, *[float(x) if x is not None else None for x in rest]) for c, p, div, *rest in rows]
    return spark.createDataFrame(full, schemas.FINANCIALS)


def quarters(spark, values):
    return statements(spark, [("A", p, "CFS", v, v, v, 1000, 500, 500) for p, v in values])


SERIES = [("2024Q1", 100), ("2024Q2", 110), ("2024Q3", 120), ("2024Q4", 500), ("2025Q1", 130), ("2025Q2", 140), ("2025Q3", 150), ("2025Q4", 600)]


def test_fourth_quarter_and_trailing_year(spark):
    rows = {r["period"]: r for r in V.ttm_financials(quarters(spark, SERIES)).collect()}
    assert rows["2024Q4"]["revenue_q"] == 170 and rows["2024Q4"]["revenue_ttm"] == 500
    assert rows["2025Q2"]["revenue_ttm"] == 560 and rows["2024Q3"]["revenue_ttm"] is None
    assert rows["2024Q4"]["avail"] == date(2025, 3, 31)


def test_year_to_date_convention(spark):
    rows = {r["period"]: r for r in V.standalone_quarters(quarters(spark, [("2024Q1", 100), ("2024Q2", 210), ("2024Q4", 500)]), "ytd").collect()}
    assert rows["2024Q2"]["revenue_q"] == 110 and rows["2024Q4"]["revenue_q"] is None
    with pytest.raises(ValueError):
        V.standalone_quarters(quarters(spark, SERIES), "other")


def test_published_by(spark):
    ttm = V.ttm_financials(quarters(spark, SERIES[:4]))
    probe = spark.createDataFrame([("A", date(2025, 3, 30)), ("A", date(2025, 4, 1))], "code string, d date")
    got = {r["d"]: r["period"] for r in V.published_by(ttm, probe).collect()}
    assert got == {date(2025, 3, 30): "2024Q3", date(2025, 4, 1): "2024Q4"}


def test_consolidated_wins(spark):
    rows = statements(spark, [("A", "2024Q1", "OFS", 1, 1, 1, 1, 1, 1), ("A", "2024Q1", "CFS", 2, 2, 2, 2, 2, 2), ("B", "2024Q1", "OFS", 3, 3, 3, 3, 3, 3)])
    assert {r["code"]: r["revenue"] for r in V.preferred(rows).collect()} == {"A": 2.0, "B": 3.0}


def pool(spark):
    rows = [("A", 1e12, 100.0, 10.0, 20.0, 200.0, 50.0), ("B", 1e12, 100.0, 10.0, 20.0, 200.0, 500.0), ("C", 1e12, 100.0, -10.0, 20.0, 200.0, 50.0), ("D", 1e12, -100.0, 10.0, 20.0, 200.0, 50.0)]
    return spark.createDataFrame([(date(2025, 1, 2), *r) for r in rows], "d date, code string, market_cap double, equity double, net_income_ttm double, op_income_ttm double, revenue_ttm double, liabilities double")


def test_eligible(spark):
    assert [r["code"] for r in pool(spark).where(FL.quality_eligible()).collect()] == ["A"]
    assert pool(spark).where(FL.quality_eligible(2e12)).count() == 0


def test_score_direction(spark):
    rows = [("cheap", 100.0, 100.0, 5.0, 5.0, 100.0, 150.0), ("good", 1000.0, 100.0, 30.0, 40.0, 100.0, 10.0)]
    p = spark.createDataFrame([(date(2025, 1, 2), *r) for r in rows], "d date, code string, market_cap double, equity double, net_income_ttm double, op_income_ttm double, revenue_ttm double, liabilities double")

    def best(kind):
        return V.quality_score(p, kind).orderBy(F.col("score").desc()).first()["code"]

    assert best("value") == "cheap" and best("quality") == "good"
    with pytest.raises(ValueError):
        V.quality_score(p, "other")


def test_share_unit_error_is_dropped(spark):
    rows = [("A", f"{y}Q4", n, 0, 0) for y, n in zip(range(2021, 2025), (8207361, 8207361, 16027989, 16027989000))]
    kept = {r["period"] for r in V.reliable_shares(spark.createDataFrame(rows, schemas.SHARES)).collect()}
    assert kept == {"2021Q4", "2022Q4", "2023Q4"}


def caps_of(spark, equity, issued=1000, close=100.0, sanity=50.0):
    bars = spark.createDataFrame([("A", date(2026, 8, 18), close, close, close, close, 1)], schemas.STOCK_DAILY)
    shares = spark.createDataFrame([("A", "2025Q4", issued, 0, 0)], schemas.SHARES)
    return V.market_caps(bars, shares, statements(spark, [("A", "2025Q4", "CFS", 1, 1, 1, 1, 1, equity)]), sanity)


def test_cap_sanity_and_pbr(spark):
    assert caps_of(spark, 1e12, 11_855_168_000, 13_650.0).count() == 0
    assert V.pbr(caps_of(spark, 50_000)).first()["pbr"] == 2.0
    assert caps_of(spark, -10_000).count() == 1 and V.pbr(caps_of(spark, -10_000)).count() == 0


@pytest.mark.parametrize("op,prev,net,equity,debt,ok", [
    (200, 100, 100, 1000, 500, True), (100, 100, 100, 1000, 500, False), (-10, -50, 100, 1000, 500, False),
    (200, 100, 20, 1000, 500, False), (200, 100, 100, 1000, 2500, False), (None, 100, 100, 1000, 500, False)])
def test_fundamental_pass(one, op, prev, net, equity, debt, ok):
    cols = {k: (None if v is None else float(v), "double") for k, v in dict(o=op, p=prev, n=net, e=equity, l=debt).items()}
    assert one(lambda: FL.passes_fundamentals(*[F.col(c) for c in "opnel"]), **cols) is ok


def test_fundamental_candidates_order(spark):
    d = date(2026, 8, 18)
    filings = spark.createDataFrame([(str(i), c, d, "반기보고서 (2026.06)", "") for i, c in enumerate(("000010", "000020"))], schemas.DISCLOSURES)
    rows = [(c, p, "CFS", 1000, op, 100, 1500, 500, 1000) for c, now in (("000010", 150), ("000020", 300)) for p, op in (("2026Q2", now), ("2025Q2", 100))]
    bars = spark.createDataFrame([(c, d, 10.0, 10.0, 10.0, 10.0, 1000) for c in ("000010", "000020")], schemas.STOCK_DAILY)
    got = V.fundamental_candidates(filings, statements(spark, rows), bars, 1.0).orderBy("rank").collect()
    assert [r["code"] for r in got] == ["000020", "000010"] and got[1]["improvement"] == pytest.approx(0.05)


def test_dated_cap_uses_the_prior_year(spark):
    bars = spark.createDataFrame([("A", date(y, 6, 1), 10.0, 10.0, 10.0, 10.0, 1) for y in (2021, 2022, 2024)], schemas.STOCK_DAILY)
    shares = spark.createDataFrame([("A", "2021Q4", 100, 0, 0)], schemas.SHARES)
    got = {r["d"].year: r["market_cap"] for r in V.dated_market_cap(bars, shares).collect()}
    assert got == {2021: None, 2022: 1000.0, 2024: 1000.0}
