"""Report names, fiscal periods and their availability dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AVAILABILITY_LAG_DAYS = 90

# Report codes by filing season.
REPORT_Q1, REPORT_HALF, REPORT_Q3, REPORT_ANNUAL = "11013", "11012", "11014", "11011"


def report_period(name: Column) -> Column:
    """P05. ``... (YYYY.MM)`` with a quarter-end month gives ``YYYYQn``, anything else NULL."""
    pattern = r"\((\d{4})\.(03|06|09|12)\)"
    year = F.regexp_extract(name, pattern, 1)
    month = F.regexp_extract(name, pattern, 2)
    quarter = F.when(month == "03", "1").when(month == "06", "2").when(month == "09", "3").when(month == "12", "4")
    return F.when(year != "", F.concat(year, F.lit("Q"), quarter))


def year_of(period: Column) -> Column:
    return F.substring(period, 1, 4).cast("int")


def quarter_of(period: Column) -> Column:
    return F.substring(period, 6, 1).cast("int")


def year_before(period: Column) -> Column:
    """P06."""
    return F.concat((year_of(period) - 1).cast("string"), F.substring(period, 5, 2))


def annual_period_known(d: Column, rule: str = "filing") -> Column:
    """P07. Latest annual period public at ``d``: by filing season, or always the prior year."""
    if rule == "filing":
        year = F.when(F.month(d) >= 4, F.year(d) - 1).otherwise(F.year(d) - 2)
    elif rule == "prev_year":
        year = F.year(d) - 1
    else:
        raise ValueError(f"unknown rule: {rule}")
    return F.concat(year.cast("string"), F.lit("Q4"))


def latest_report(d: Column) -> Column:
    """P08. struct(year, report) of the newest report whose filing deadline has passed."""
    m, y = F.month(d), F.year(d)

    def pick(year: Column, code: str) -> Column:
        return F.struct(year.alias("year"), F.lit(code).alias("report"))

    return (
        F.when(m >= 11, pick(y, REPORT_Q3))
        .when(m >= 8, pick(y, REPORT_HALF))
        .when(m >= 5, pick(y, REPORT_Q1))
        .when(m >= 4, pick(y - 1, REPORT_ANNUAL))
        .otherwise(pick(y - 2, REPORT_ANNUAL))
    )


def available_on(year: Column, quarter: Column, lag_days: int = AVAILABILITY_LAG_DAYS) -> Column:
    """P09. Quarter end plus the publication lag."""
    return F.date_add(F.last_day(F.make_date(year, quarter * 3, F.lit(1))), lag_days)


def quarter_label(d: Column) -> Column:
    """P26."""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
