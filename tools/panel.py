"""Time the headline operators on a generated panel of about 3.5 million bars, each as one job.

usage: python tools/panel.py [CPUS] [CODES] [DAYS]
"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])


def panel(spark, codes, days):
    from pyspark.sql import functions as F

    base = spark.range(codes * days, numPartitions=64).select(
        (F.col("id") % codes).alias("k"), F.floor(F.col("id") / codes).cast("int").alias("i"))
    code = F.concat(F.lpad(F.col("k").cast("string"), 5, "0"), F.lit("0"))
    week, rest = F.floor(F.col("i") / 5).cast("int"), F.col("i") % 5
    d = F.date_add(F.lit("2022-01-03").cast("date"), (week * 7 + rest).cast("int"))

    def noise(seed, buckets=1000):
        return F.pmod(F.xxhash64("k", "i", F.lit(seed)), F.lit(buckets)) / buckets

    px = 10000 * F.exp(0.3 * F.sin(F.col("i") / 40 + F.col("k")) + 0.1 * (noise(1) - 0.5))
    rows = base.where(noise(2) >= 0.02).where((F.col("k") % 17 != 0) | (F.col("i") < days * 0.7))
    bars = rows.select(
        code.alias("code"), d.alias("d"), F.when(noise(3) < 0.01, 0.0).otherwise(px * (1 + 0.02 * (noise(4) - 0.5))).alias("o"),
        (px * 1.02).alias("h"), (px * 0.98).alias("l"), px.alias("c"), (noise(5) * 100000).cast("bigint").alias("v"))
    flows = rows.select(code.alias("code"), d.alias("d"), *[((noise(s) - 0.5) * 1e9).cast("bigint").alias(n) for s, n in (
        (6, "individual_net"), (7, "foreign_net"), (8, "institution_net"))])
    credit = rows.where(F.col("i") % 3 == 0).select(
        code.alias("code"), d.alias("d"), (noise(9) * 1e9).cast("bigint").alias("credit_amt"), noise(10).alias("credit_ratio"))
    return bars, flows, credit


def main():
    from tidemark.operators import outcomes as O
    from tidemark.operators import signals as S
    from tidemark.operators import statistics as ST
    from tidemark.operators import windows as W
    from tidemark.session import build_session, pin

    cpus, codes, days = (int(x) for x in (sys.argv[1:] + ["4", "3000", "1170"][len(sys.argv) - 1:]))
    spark = build_session(f"local[{cpus}]", "panel", **{
        "spark.sql.shuffle.partitions": "32", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    bars, flows, credit = (pin(x) for x in panel(spark, codes, days))
    print("bars", bars.count(), "flows", flows.count(), "credit", credit.count(), flush=True)
    horizons = (1, 3, 5, 10, 20)

    def timed(name, make):
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        print(f"{name:24} {time.time() - start:7.1f}s", flush=True)

    timed("c02_signals_history", lambda: S.signals_history(bars, flows, credit))
    timed("c10_barrier_outcomes", lambda: O.outcome_table(bars))
    signals = pin(S.signals_history(bars, flows, credit))
    timed("c29_rank_study", lambda: O.rank_study(signals, bars, "institution_flow_ratio"))
    timed("c28_factor_deciles", lambda: ST.factor_deciles(signals, W.with_forward_returns(bars, horizons), ["institution_flow_ratio", "heat_score"], horizons))


if __name__ == "__main__":
    main()
