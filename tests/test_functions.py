import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import costs, heat, nulls, periods, text, verdicts


@pytest.mark.parametrize("value", [float("inf"), float("-inf"), float("nan"), None])
def test_non_finite_becomes_null(one, value):
    assert one(lambda: nulls.finite_or_null(F.col("x")), x=(value, "double")) is None


def test_ratios_are_null_on_zero(one):
    assert one(lambda: nulls.ratio(F.col("a"), F.col("b")), a=(1.0, "double"), b=(0.0, "double")) is None
    assert one(lambda: nulls.quotient(F.col("a"), F.col("b")), a=(1.0, "double"), b=(0.0, "double")) is None


def test_costs(one):
    buy = one(lambda: costs.buy_fill(F.col("p")), p=(10000.0, "double"))
    sell = one(lambda: costs.sell_fill(F.col("p")), p=(10000.0, "double"))
    assert buy > 10000 > sell
    flat = one(lambda: costs.net_return(F.col("p"), F.col("p")), p=(10000.0, "double"))
    assert flat == pytest.approx(-0.00628, abs=1e-5)
    assert one(lambda: costs.net_return(F.col("p"), F.lit(0.0)), p=(10000.0, "double")) == -1.0


def test_sizing_stop_and_blend(one):
    lit = F.lit
    assert one(lambda: costs.position_size(lit(1e7), lit(10), lit(300000.0))) == 3
    assert one(lambda: costs.position_size(lit(1e7), lit(10), lit(2e6))) is None
    assert one(lambda: costs.stop_price(lit(100.0), lit(0.07))) == pytest.approx(93)
    assert one(lambda: costs.stop_price(lit(100.0), lit(0.0))) == 0.0
    entry = one(lambda: costs.blended_entry(lit(100.0), lit(10000.0), lit(100.0), lit(20000.0)))
    assert 10000 < entry < 20000


CASES = [
    ((None, None, None), 0.0, "neutral"), ((3.0, None, None), 4.0, "neutral"), ((None, None, 1.0), -1.0, "neutral"),
    ((3.0, 3.0, 2.0), 8.0, "avoid"), ((3.5, 2.0, None), 7.0, "avoid"), ((3.5, 3.0, 3.0), 10.0, "sell"),
    ((-5.0, -5.0, -5.0), -10.0, "neutral"),
]


@pytest.mark.parametrize("ratios,score,label", CASES)
def test_heat(one, ratios, score, label):
    cols = dict(zip(("f", "k", "v"), [(x, "double") for x in ratios]))
    got = one(lambda: F.struct(heat.heat_score(F.col("f"), F.col("k"), F.col("v")).alias("s"),
                               heat.heat_label(heat.heat_score(F.col("f"), F.col("k"), F.col("v"))).alias("l")), **cols)
    assert got["s"] == pytest.approx(score) and got["l"] == label


@pytest.mark.parametrize("name,period", [
    ("반기보고서 (2026.06)", "2026Q2"), ("분기보고서 (2026.03)", "2026Q1"), ("사업보고서 (2025.12)", "2025Q4"),
    ("분기보고서 (2026.09)", "2026Q3"), ("임원ㆍ주요주주 소유보고", None), ("사업보고서 (2026.02)", None)])
def test_report_period(one, name, period):
    assert one(lambda: periods.report_period(F.col("x")), x=(name, "string")) == period


@pytest.mark.parametrize("d,period", [("2026-08-18", "2025Q4"), ("2026-04-01", "2025Q4"), ("2026-03-31", "2024Q4"), ("2022-01-05", "2020Q4")])
def test_annual_period_known(one, d, period):
    assert one(lambda: periods.annual_period_known(F.lit(d).cast("date"))) == period


def test_annual_period_rejects_unknown_rule(spark):
    with pytest.raises(ValueError):
        periods.annual_period_known(F.lit("2020-01-01").cast("date"), "other")


@pytest.mark.parametrize("d,year,code", [
    ("2026-08-18", 2026, "11012"), ("2026-11-20", 2026, "11014"), ("2026-05-20", 2026, "11013"), ("2026-04-10", 2025, "11011"), ("2026-02-10", 2024, "11011")])
def test_latest_report(one, d, year, code):
    got = one(lambda: periods.latest_report(F.lit(d).cast("date")))
    assert (got["year"], got["report"]) == (year, code)


def test_availability_and_previous_year(one):
    assert one(lambda: periods.available_on(F.lit(2024), F.lit(4))) == date(2025, 3, 31)
    assert one(lambda: periods.year_before(F.lit("2026Q2"))) == "2025Q2"
    assert one(lambda: periods.quarter_label(F.lit("2024-05-02").cast("date"))) == "2024Q2"


@pytest.mark.parametrize("raw,value", [("7,018,300,000", 7018300000), ("-56,070", -56070), ("(81,905)", -81905), ("", None), ("-", None), (None, None), ("abc", None)])
def test_amount(one, raw, value):
    assert one(lambda: text.amount(F.col("x")), x=(raw, "string")) == value


@pytest.mark.parametrize("raw,value", [("90,817", 90817), ("-", None), ("", None), ("12.5", None), (None, None)])
def test_count(one, raw, value):
    assert one(lambda: text.count(F.col("x")), x=(raw, "string")) == value


@pytest.mark.parametrize("reply", [
    "**결정: 매수\n확신: 7.5\n이유: 저평가 구간**", "생각해 보면\n**결정:** 매수\n**확신:** 7.5\n**이유:** 저평가 구간",
    "결정 : *매수*, 결정 근거 있음\n확신 :7.5\n이유: 저평가 구간", "결정: 보류\n결정: 매수\n확신: 없음\n확신: 7.5점\n이유: 저평가 구간"])
def test_reply_tolerates_emphasis(one, reply):
    got = one(lambda: F.struct(text.reply_decision(F.col("x")).alias("d"), text.reply_score(F.col("x")).alias("s"), text.reply_reason(F.col("x")).alias("r")), x=(reply, "string"))
    assert (got["d"], got["s"], got["r"]) == ("매수", 7.5, "저평가 구간")


def test_reply_defaults(one):
    assert one(lambda: text.reply_decision(F.col("x")), x=("확신: 3\n이유: 자료 부족", "string")) is None
    assert one(lambda: text.reply_score(F.col("x")), x=("결정: 관망\n이유: 거래 적음", "string")) == 5.0
    assert one(lambda: text.reply_reason(F.col("x")), x=("형식 없는 답 " * 60, "string")) == ("형식 없는 답 " * 60).strip()


def test_settings(one):
    assert one(lambda: text.setting(F.col("x"), 10), x=("12", "string")) == 12
    assert one(lambda: text.setting(F.col("x"), 10), x=("many", "string")) == 10
    assert one(lambda: text.setting(F.col("x"), 0.07), x=(None, "string")) == 0.07
    assert one(lambda: text.name_list(F.col("x")), x=(" a, ,b", "string")) == ["a", "b"]


def test_json_keys(one):
    assert one(lambda: text.has_key(F.col("x"), "a"), x=('{"a": 1}', "string")) is True
    assert one(lambda: text.non_empty(F.col("x")), x=("{}", "string")) is False


@pytest.mark.parametrize("mean,t,kind", [(1.5, 2.4, "good"), (1.5, 1.1, "warn"), (-1.1, -2.2, "bad"), (-0.6, -0.6, "bad"), (None, None, "none")])
def test_verdict(one, mean, t, kind):
    assert one(lambda: verdicts.verdict(F.lit(100), F.col("m"), F.col("t")), m=(mean, "double"), t=(t, "double")) == kind


def test_fingerprint_ignores_order(one):
    a = one(lambda: verdicts.fingerprint(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))))
    b = one(lambda: verdicts.fingerprint(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))))
    assert a == b == '{"a":"2","b":"1"}'


def test_chance_of_a_lucky_variant(one):
    assert one(lambda: verdicts.any_positive_chance(F.lit(10))) == round((1 - 0.95 ** 10) * 100, 1)
    assert math.isclose(costs.BUY_COST, 1.002 * 1.00015 - 1)
