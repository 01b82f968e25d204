"""Statements, share counts, valuation, quality targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import quotient
from tidemark.functions.periods import (
    annual_period_known, available_on, quarter_of, report_period, year_before, year_of)
from tidemark.operators.asof import latest_bar
from tidemark.operators.filters import (
    is_earnings_report, is_ordinary, passes_fundamentals, quality_eligible, turnover_mean)
from tidemark.operators.ordered import percentile_rank
from tidemark.session import pin

FLOW_ITEMS = ("revenue", "op_income", "net_income")
OUTLIER_RATIO = 5.0
PBR_SANITY_MAX = 50.0
SCORE_KINDS = {
    "quality": {"roe": 1 / 3, "margin": 1 / 3, "low_debt": 1 / 3},
    "value": {"earnings_yield": 0.5, "book_yield": 0.5},
    "combo": {"roe": 1 / 6, "margin": 1 / 6, "low_debt": 1 / 6, "earnings_yield": 0.25, "book_yield": 0.25},
}


def preferred(statements: DataFrame) -> DataFrame:
    """W22. Consolidated statement of a (code, period) where there is one, else the separate one."""
    rank = F.when(F.col("fs_div") == "CFS", 0).when(F.col("fs_div") == "OFS", 1).otherwise(2)
    rest = [c for c in statements.columns if c not in ("code", "period")]
    picked = statements.groupBy("code", "period").agg(F.min_by(F.struct(*rest), rank).alias("s"))
    return picked.select("code", "period", *[F.col(f"s.{c}").alias(c) for c in rest])


def standalone_quarters(statements: DataFrame, convention: str = "q4_annual") -> DataFrame:
    """W10. Single-quarter income: Q4 less Q1-Q3 of its year, or differences of year-to-date figures."""
    df = statements.withColumn("y", year_of(F.col("period"))).withColumn("q", quarter_of(F.col("period")))
    year = Window.partitionBy("code", "y")
    if convention == "q4_annual":
        def single(x):
            earlier = F.sum(F.when(F.col("q") <= 3, F.col(x))).over(year)
            return F.when(F.col("q") <= 3, F.col(x)).otherwise(F.col(x) - earlier)
    elif convention == "ytd":
        def single(x):
            before = year.orderBy("q")
            adjacent = F.lag("q").over(before) == F.col("q") - 1
            return F.when(F.col("q") == 1, F.col(x)).when(adjacent, F.col(x) - F.lag(x).over(before))
    else:
        raise ValueError(f"unknown convention: {convention}")
    return df.select("*", *[single(x).alias(f"{x}_q") for x in FLOW_ITEMS])


def trailing_year(quarters: DataFrame) -> DataFrame:
    """W09. Sum of the last four statement rows, all of them present."""
    frame = Window.partitionBy("code").orderBy("y", "q").rowsBetween(-3, 0)
    return quarters.select("*", *[
        F.when(F.count(f"{x}_q").over(frame) == 4, F.sum(f"{x}_q").over(frame)).alias(f"{x}_ttm") for x in FLOW_ITEMS
    ])


def ttm_financials(statements: DataFrame, convention: str = "q4_annual") -> DataFrame:
    """C06. Preferred statements with single-quarter and trailing-year income and publication date."""
    out = trailing_year(standalone_quarters(preferred(statements), convention))
    return out.withColumn("avail", available_on(F.col("y"), F.col("q")))


def published_by(ttm: DataFrame, probe: DataFrame) -> DataFrame:
    """J07. Latest statement published at or before ``d`` for every (code, d) of ``probe``."""
    rest = tuple(c for c in ttm.columns if c not in ("code", "avail"))
    facts = ttm.where(F.col("avail").isNotNull()).select("code", F.col("avail").alias("d"), *rest)
    hit = latest_bar(probe, facts, "d", rest, prefix="s_")
    return hit.where(F.col("s_d").isNotNull()).select(
        *probe.columns, F.col("s_d").alias("avail"), *[F.col(f"s_{c}").alias(c) for c in rest])


def yearly_shares(shares: DataFrame) -> DataFrame:
    """Largest share count of each code and year."""
    return shares.where(F.col("issued").isNotNull()).groupBy("code", year_of(F.col("period")).alias("y")).agg(
        F.max("issued").alias("issued"))


def year_grid(shares: DataFrame, last_year: int) -> DataFrame:
    """J09. One row per code and year up to ``last_year``, carrying the last known share count."""
    following = F.lead("y").over(Window.partitionBy("code").orderBy("y"))
    spans = yearly_shares(shares).withColumn("_to", F.coalesce(following - 1, F.lit(last_year)))
    return spans.where(F.col("_to") >= F.col("y")).select("code", F.explode(F.sequence("y", "_to")).alias("y"), "issued")


def _with_cap(bars: DataFrame, known: DataFrame) -> DataFrame:
    """Close x newest count of ``known`` (code, y, issued) at or before the prior year."""
    dated = latest_bar(bars.withColumn("_y", F.year("d") - 1), known.withColumnRenamed("y", "d"), "_y", ("issued",), "s_")
    return dated.withColumn("market_cap", F.col("c") * F.col("s_issued").cast("double")).drop("_y", "s_d", "s_issued")


def cap_by_latest_shares(bars: DataFrame, shares: DataFrame) -> DataFrame:
    """J08. Close x newest positive share count of a period up to Q4 of the prior year."""
    known = shares.where(F.col("issued") > 0).groupBy("code", year_of(F.col("period")).alias("y")).agg(
        F.max_by("issued", "period").alias("issued"))
    return _with_cap(bars, known)


def dated_market_cap(bars: DataFrame, shares: DataFrame) -> DataFrame:
    """J09. Bars with the market cap known at the time, gaps filled from earlier years."""
    return _with_cap(bars, yearly_shares(shares))


def reliable_shares(shares: DataFrame, ratio_max: float = OUTLIER_RATIO) -> DataFrame:
    """A18, C08. Share counts within ``ratio_max`` of the code's own median, both ways."""
    middle = shares.groupBy("code").agg(F.median(F.col("issued").cast("double")).alias("_med"))
    x = F.col("issued").cast("double")
    odd = (F.col("_med") > 0) & ((x / F.col("_med") > ratio_max) | (F.col("_med") / x > ratio_max))
    return shares.where(F.col("issued") > 0).join(middle, "code").where(~odd).drop("_med")


def market_caps(bars: DataFrame, shares: DataFrame, statements: DataFrame, sanity: float = PBR_SANITY_MAX) -> DataFrame:
    """C08, J20. Cap of every bar from reliable shares, dropped when absurd against equity."""
    period = annual_period_known(F.col("d"))
    out = bars.select("code", "d", "c", period.alias("period")).join(
        reliable_shares(shares).select("code", "period", "issued"), ["code", "period"])
    out = out.withColumn("market_cap", F.col("c") * F.col("issued").cast("double"))
    equity = statements.select("code", "period", "equity")
    out = out.join(equity, ["code", "period"], "left")
    keep = F.col("equity").isNull() | (F.col("equity") <= 0) | F.coalesce(
        quotient(F.col("market_cap"), F.col("equity")) <= sanity, F.lit(False))
    return out.where(keep).select("code", "d", "period", "market_cap", "equity")


def pbr(caps: DataFrame) -> DataFrame:
    """C09, J21. Market cap over equity where equity is positive."""
    return caps.where(F.col("equity") > 0).withColumn("pbr", F.col("market_cap") / F.col("equity"))


def year_over_year(statements: DataFrame) -> DataFrame:
    """J10. Each statement with operating income of the same quarter a year before."""
    previous = statements.select("code", F.col("period").alias("_prev"), F.col("op_income").alias("prev_op_income"))
    return statements.withColumn("_prev", year_before(F.col("period"))).join(previous, ["code", "_prev"], "left").drop("_prev")


def top_per_day(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """L01, L02, L04, W13. First ``k`` rows of every day; pruned to k per task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("d").orderBy(*order))).where(F.col(name) <= k)


def fundamental_candidates(disclosures: DataFrame, statements: DataFrame, bars: DataFrame, turnover_floor: float,
                           held: DataFrame | None = None, caps: DataFrame | None = None, cap_floor: float = 0.0,
                           k: int = 50) -> DataFrame:
    """C05. Filers of every day whose profit grew on the year, best improvement first."""
    filed = disclosures.where(is_earnings_report(F.col("report_nm"))).select(
        "code", "d", report_period(F.col("report_nm")).alias("period")).where(F.col("period").isNotNull())
    filed = filed.groupBy("code", "d").agg(F.max("period").alias("period"))
    if held is not None:
        on = [c for c in ("code", "d") if c in held.columns]  # with a day, what was held on that day
        filed = filed.join(held.select(*on), on, "left_anti")
    current = year_over_year(statements).select(
        "code", "period", "op_income", "prev_op_income", "net_income", "equity", "liabilities")
    priced = bars.select("code", "d", F.col("c").alias("close"), turnover_mean().alias("_turnover"))
    out = filed.join(priced, ["code", "d"]).where(
        is_ordinary(F.col("code")) & (F.col("_turnover") >= turnover_floor))
    if caps is not None:
        out = out.join(caps.where(F.col("market_cap") >= cap_floor).select("code", "d"), ["code", "d"], "left_semi")
    out = out.join(current, ["code", "period"]).where(passes_fundamentals(
        F.col("op_income"), F.col("prev_op_income"), F.col("net_income"), F.col("equity"), F.col("liabilities")))
    out = out.withColumn("improvement", (F.col("op_income") - F.col("prev_op_income")) / F.col("equity"))
    return top_per_day(out.select("code", "d", "close", "period", "improvement"),
                       [F.col("improvement").desc(), F.col("code")], k)


def quality_score(pool: DataFrame, kind: str) -> DataFrame:
    """W12, C07. Weighted mean of percentile ranks within the day."""
    if kind not in SCORE_KINDS:
        raise ValueError(f"unknown score kind: {kind}")
    weights = SCORE_KINDS[kind]
    pool = pin(pool, "pool")
    values = {
        "roe": F.col("net_income_ttm") / F.col("equity"),
        "margin": F.col("op_income_ttm") / F.col("revenue_ttm"),
        "low_debt": -F.col("liabilities") / F.col("equity"),
        "earnings_yield": F.col("net_income_ttm") / F.col("market_cap"),
        "book_yield": F.col("equity") / F.col("market_cap"),
    }
    long = pool.select("d", "code", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), values[m].alias("x"), F.lit(w).alias("w")) for m, w in weights.items()
    ])).alias("s")).select("d", "code", "s.m", "s.x", "s.w")
    ranked = percentile_rank(long, ["d", "m"], "x", "pr", write_once=False)
    total = ranked.groupBy("d", "code").agg(F.sum(F.col("pr") * F.col("w")).alias("_sum"), F.count("pr").alias("_n"))
    # Rounded so that equal scores compare equal whatever the order of summation.
    return pool.join(total, ["d", "code"]).withColumn(
        "score", F.when(F.col("_n") == len(weights), F.round("_sum", 12))).drop("_sum", "_n")


def quality_pool(ttm: DataFrame, shares: DataFrame, bars: DataFrame, days: DataFrame, cap_floor: float,
                 turnover_floor: float | None = None) -> DataFrame:
    """J07, J08, F08. Eligible statements with their market cap on each rebalance day."""
    priced = bars.select("code", "d", "c", turnover_mean().alias("_turnover")).join(days.select("d"), "d", "left_semi")
    caps = cap_by_latest_shares(priced, shares)
    pool = published_by(ttm, caps).where(quality_eligible(cap_floor))
    if turnover_floor is not None:
        pool = pool.where(is_ordinary(F.col("code")) & (F.col("_turnover") >= turnover_floor))
    return pool


def quality_targets(ttm: DataFrame, shares: DataFrame, bars: DataFrame, days: DataFrame, slots: int,
                    kind: str = "value", cap_floor: float = 0.0, turnover_floor: float | None = None) -> DataFrame:
    """C07. Best ``slots`` codes of every rebalance day with their ratios."""
    pool = quality_score(quality_pool(ttm, shares, bars, days, cap_floor, turnover_floor), kind)
    top = top_per_day(pool, [F.col("score").desc_nulls_last(), F.col("code")], slots)
    return top.select(
        "d", "code", F.col("c").alias("close"), "score", "rank", "period",
        (F.col("net_income_ttm") / F.col("equity")).alias("roe"),
        (F.col("liabilities") / F.col("equity")).alias("debt_ratio"),
        (F.col("market_cap") / F.col("equity")).alias("pbr"),
        (F.col("market_cap") / F.col("net_income_ttm")).alias("per"))
