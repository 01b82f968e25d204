"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Bars are keyed by supplier, so the panel has many codes, as a market has. Every query is run to the
end through the no-op sink: all rows and columns are computed, nothing is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def headline(t):
    from pyspark.sql import functions as F

    from tidemark.operators import outcomes as O
    from tidemark.operators import rebalance as R
    from tidemark.operators import signals as S
    from tidemark.operators import statistics as ST
    from tidemark.operators import windows as W
    from tidemark.operators.ordered import percentile_rank
    from tidemark.plans import q_outcomes as Q
    from tidemark.plans.q_signals import TURNOVER

    horizons = (1, 3, 5, 10, 20)

    def forward():
        return W.with_forward_returns(t.bars, horizons).select("code", "d", *[f"fwd_{h}" for h in horizons])

    return {
        "c02_signals_history": lambda: S.signals_history(t.bars, t.flows, t.credit),
        "c30_indicator_panel": lambda: W.indicator_panel(t.bars),
        "c03_contrarian_candidates": lambda: O.contrarian_candidates(t.signals, t.bars, TURNOVER, n=251),
        "c10_barrier_outcomes": lambda: O.outcome_table(t.bars, stop_pct=0.6),
        "c11_non_overlapping": lambda: O.non_overlapping(O.outcome_table(t.bars, stop_pct=0.6)),
        "c28_factor_deciles": lambda: ST.factor_deciles(t.signals, forward(), S.METRICS, horizons),
        "c29_rank_study": lambda: O.rank_study(t.signals, t.bars, "heat_score", stop_pct=0.6),
        "w12_percentile_rank": lambda: percentile_rank(t.signals.select("code", "d", "heat_score"), ["d"], "heat_score", "pct"),
        "c14_walk_forward": lambda: R.walk_forward(Q.variant_trades(t), 30, "heat_score")["summary"],
        "a01_trade_statistics": lambda: ST.trade_statistics(O.outcome_table(t.bars, stop_pct=0.6).withColumn("y", F.year("d")), ["y"]),
    }


def main():
    from tidemark.plans.domain import Domain
    from tidemark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    only = sys.argv[1:]
    # One small run starts the JVM's compiler before anything is timed.
    Domain(spark, sf_dir, "supplier").bars.write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in headline(Domain(spark, sf_dir, "supplier")):
        if only and name not in only:
            continue
        make = headline(Domain(spark, sf_dir, "supplier"))[name]
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
