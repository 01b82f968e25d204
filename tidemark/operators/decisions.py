"""Agent decisions as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as P
from tidemark.functions.nulls import quotient
from tidemark.functions.periods import available_on
from tidemark.operators.books import filing_digest, free_slots, same_sector
from tidemark.operators.calendar import with_previous_market_close
from tidemark.operators.windows import return_since, trend

VETO_AGENTS = ("market_state", "risk")


def latest_per_key(df: DataFrame, keys: list[str], ts: str = "ts", tie: str = "id") -> DataFrame:
    """W19. Newest row per key, as an aggregate: no group is ever sorted or held whole."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def error_alerts(decisions: DataFrame, now, hours: int = 24) -> DataFrame:
    """A17. Failures of the last day by label: count, newest detail and time."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    rows = decisions.where((F.col("decision") == P.ERROR_DECISION) & (F.col("ts") > since) & (F.col("ts") <= F.lit(now).cast("timestamp")))
    text = F.coalesce("rationale", F.lit(""))
    return rows.groupBy(P.alert_label(text).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(P.alert_detail(text), F.struct("ts", "id")).alias("detail"), F.max("ts").alias("ts"))


def market_breadth(bars: DataFrame) -> DataFrame:
    """A09, J11. Share of codes that closed below the previous market day, per day."""
    falling = F.sum((F.col("c") < F.col("prev_c")).cast("int"))
    out = with_previous_market_close(bars).groupBy("d").agg(F.count(F.lit(1)).alias("codes"), F.coalesce(falling, F.lit(0)).alias("falling"))
    return out.withColumn("fall_pct", F.col("falling") / F.col("codes") * 100)


def gate(decisions: DataFrame, keys: list[str], consensus: tuple[str, ...]) -> DataFrame:
    """C20. Failures first, then vetoes, then unanimous consensus; mean score of the approved.

    Only the newest decision of each agent counts, so one agent cannot stand in for another.
    """
    decisions = latest_per_key(decisions, [*keys, "agent"])
    failed = F.col("decision") == P.ERROR_DECISION
    veto = F.col("agent").isin(*VETO_AGENTS) & F.col("decision").isin(P.WATCH, P.EXIT)
    agree = F.col("agent").isin(*consensus) & (F.col("decision") == P.BUY)

    def total(cond: Column) -> Column:
        return F.sum(cond.cast("int"))

    out = decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("agents"), total(failed).alias("errors"), total(veto).alias("vetoes"),
        total(agree).alias("buys"), F.avg("score").alias("avg_score"))
    reason = (F.when(F.col("errors") > 0, "error").when(F.col("vetoes") > 0, "veto")
              .when(F.col("buys") < len(consensus), "consensus").otherwise("approved"))
    return out.withColumn("reason", reason).withColumn("approved", F.col("reason") == "approved").withColumn(
        "avg_score", F.when(F.col("approved"), F.col("avg_score")))


def statement_history(statements: DataFrame, candidates: DataFrame, n: int = 5) -> DataFrame:
    """C31, P12. Per (code, d) the newest ``n`` periods that were public on ``d``, with margin, ROE and debt ratio,
    oldest first. A code has a statement per quarter at most, so the join on code stays small."""
    period = F.col("period")
    known = statements.withColumn("avail", available_on(F.substring(period, 1, 4).cast("int"), F.substring(period, 6, 1).cast("int")))
    wanted = candidates.select("code", "d").distinct().join(known, "code").where(F.col("avail") <= F.col("d"))
    newest = Window.partitionBy("code", "d").orderBy(F.col("period").desc())
    top = wanted.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    line = F.struct(
        "period", quotient(F.col("op_income"), F.col("revenue")).alias("margin"),
        quotient(F.col("net_income"), F.col("equity")).alias("roe"), quotient(F.col("liabilities"), F.col("equity")).alias("debt"))
    return top.groupBy("code", "d").agg(F.sort_array(F.collect_list(line)).alias("history"))


def decision_features(candidates: DataFrame, bars: DataFrame, positions: DataFrame, disclosures: DataFrame,
                      statements: DataFrame, proxy: str, slots: int) -> DataFrame:
    """C31. One feature row per candidate (code, d, strategy, mode) for any external judge."""
    prices = bars.select("code", "d", return_since(F.col("c"), 59).alias("r60"), return_since(F.col("c"), 249).alias("r250"),
                         trend(F.col("c"), 20).alias("_trend"))
    index = prices.where(F.col("code") == proxy).select("d", F.col("_trend").alias("trend_pct"))
    out = candidates.join(prices.drop("_trend"), ["code", "d"], "left")
    out = out.join(market_breadth(bars).select("d", "fall_pct"), "d", "left").fillna(50.0, ["fall_pct"])
    out = out.join(index, "d", "left").fillna(0.0, ["trend_pct"])
    out = out.join(free_slots(positions, slots), ["mode", "strategy"], "left").fillna(slots, ["free_slots"])
    out = same_sector(out, positions)
    out = filing_digest(disclosures, out)
    return out.join(statement_history(statements, candidates), ["code", "d"], "left")


def decision_ingest(replies: DataFrame, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """C32. Raw replies (id, ts, code, agent, scope, prompt, reply, error_kind, error_text) to typed rows.

    A prompt already answered reuses the stored decision; failures are kept apart without a cache key.
    """
    key = P.content_key(F.col("agent"), F.coalesce("scope", "code"), F.col("prompt"))
    keyed = replies.withColumn("key", key)
    if stored is not None:
        known = latest_per_key(stored.where(F.col("input_hash").isNotNull()).select(
            F.col("input_hash").alias("key"), "id", "ts", "decision", "score", "rationale"), ["key"]).select(
            "key", F.struct("decision", F.coalesce("score", F.lit(0.0)).alias("score"), "rationale").alias("hit"))
        keyed = keyed.join(known, "key", "left")
    else:
        keyed = keyed.withColumn("hit", F.lit(None).cast("struct<decision:string,score:double,rationale:string>"))
    reused = keyed.where(F.col("hit").isNotNull()).select("id", "ts", "code", "agent", "hit.*", F.col("key").alias("input_hash"))
    fresh = keyed.where(F.col("hit").isNull())
    decision = P.reply_decision(F.col("reply"))
    broken = F.col("error_kind").isNotNull()
    label = F.when(broken, P.failure_label(F.col("error_kind"), F.col("error_text"))).otherwise(P.FAIL_FORMAT)
    detail = F.when(broken, F.col("error_text")).otherwise(F.col("reply"))
    bad = broken | decision.isNull()
    failures = fresh.where(bad).select(
        "id", "ts", "code", "agent", F.lit(P.ERROR_DECISION).alias("decision"), F.lit(0.0).alias("score"),
        F.concat(label, F.lit(P.ERROR_SEPARATOR), F.coalesce(detail, F.lit(""))).alias("rationale"),
        F.lit(None).cast("string").alias("input_hash"))
    decided = fresh.where(~bad).select(
        "id", "ts", "code", "agent", decision.alias("decision"), P.reply_score(F.col("reply")).alias("score"),
        P.reply_reason(F.col("reply")).alias("rationale"), F.col("key").alias("input_hash"))
    return {"decided": decided, "failures": failures, "reused": reused}
