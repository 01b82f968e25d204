"""Test runs derived from the sells of the ledger.

A run collects the sells of one priority (the ranking rule), one market segment (the other settings)
and one window: a calendar year, or eighteen months for two rules that were measured again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = {"1": "heat_score", "2": "volume_ratio", "3": "credit_surge_ratio", "4": "institution_flow_ratio"}
PREFIXES = {"1": "q3_", "2": "contrarian_", "3": "pit_", "4": "fundamental_", "5": "wf_"}


def run_trades(t) -> DataFrame:
    sold = t.sales.where(F.col("o_orderstatus") == "F")
    y, m = F.year("d"), F.month("d")
    long = ((y.isin(1996, 1998)) | (y.isin(1997, 1999) & (m <= 6)))
    windows = F.array_compact(F.array(
        F.struct(y.alias("y"), F.lit(0).alias("long")),
        F.when(long, F.struct(F.when(y % 2 == 0, y).otherwise(y - 1).alias("y"), F.lit(1).alias("long")))))
    rows = sold.withColumn("w", F.explode(windows))
    p, s = F.substring("o_orderpriority", 1, 1), F.substring("c_mktsegment", 1, 1)
    seg = F.instr(F.lit("ABFHM"), s)
    key = F.col("o_orderkey")
    reason = F.when(key % 3 == 0, "stop").when(key % 3 == 1, "expiry").otherwise("heat_signal")
    ret = ((key * 37) % 201 - 100).cast("double") / 1000.0
    return rows.select(
        (p.cast("bigint") * 10000 + seg * 1000 + (F.col("w.y") - 1990) * 2 + F.col("w.long")).alias("run_id"),
        p.alias("priority"), s.alias("segment"), F.col("w.y").alias("y"), F.col("w.long").alias("long"),
        key.alias("id"), "code", F.date_sub("d", 10).alias("entry_d"), F.col("d").alias("exit_d"),
        (F.col("o_totalprice") / (1 + key % 10).cast("double")).alias("entry_px"),
        (F.col("o_totalprice") / (1 + key % 10).cast("double") * (1 + ret)).alias("exit_px"),
        ret.alias("ret_pct"), reason.alias("exit_reason"))


def runs(t) -> DataFrame:
    trades = run_trades(t)
    x = F.col("ret_pct")
    g = trades.groupBy("run_id", "priority", "segment", "y", "long").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("sd"))
    p, s = F.col("priority"), F.col("segment")

    def chosen(pairs):
        out = None
        for k, v in pairs.items():
            out = F.when(p == k, v) if out is None else out.when(p == k, v)
        return out

    entries = F.array(
        F.struct(F.lit("rank_col").alias("k"), chosen(RANKS).alias("v")),
        F.struct(F.lit("slots").alias("k"), F.when(s == "B", "12").otherwise("5").alias("v")),
        F.struct(F.lit("exit_rank_pct").alias("k"), F.when(s == "F", "0.9").alias("v")),
        F.struct(F.lit("exit_cols").alias("k"), F.when(s == "F", "credit_surge_ratio").alias("v")),
        F.struct(F.lit("point_in_time_universe").alias("k"), F.when(s == "H", "true").alias("v")),
        F.struct(F.lit("marcap_filter").alias("k"), F.when(s == "M", "false").alias("v")),
        F.struct(F.lit("walkforward").alias("k"), F.when(p == "5", "true").alias("v")),
        F.struct(F.lit("is_control").alias("k"), F.when((p == "5") & (s == "A"), "true").alias("v")))
    params = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    name = F.concat(chosen(PREFIXES), s, F.lit("_"), F.col("y").cast("string"), F.when(F.col("long") == 1, "L").otherwise(""))
    end = F.when(F.col("long") == 1, F.make_date(F.col("y") + 1, F.lit(6), F.lit(30))).otherwise(
        F.make_date(F.col("y"), F.lit(12), F.lit(31)))
    ts = F.date_add(F.lit("2002-01-01").cast("date"), ((F.col("run_id") * 37) % 500).cast("int")).cast("timestamp")
    return g.select(
        F.col("run_id").alias("id"), ts.alias("ts"), name.alias("strategy"), F.make_date(F.col("y"), F.lit(1), F.lit(1)).alias("start_d"),
        end.alias("end_d"), params.alias("params"), "n", (F.col("m") * 100).alias("mean_pct"), (F.col("sd") * 100).alias("std_pct"),
        F.when(F.col("sd") > 0, F.col("m") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0).alias("t_val"))
