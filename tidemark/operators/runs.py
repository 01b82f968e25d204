"""Comparison of stored test runs.

A run is (id, ts, strategy, start_d, end_d, params map<string,string>, n, mean_pct, std_pct, t_val).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.verdicts import (
    IGNORED_SETTINGS, RANK_SETTINGS, SETTING_GROUPS, family, fingerprint, logical_setting)
from tidemark.operators.chains import free_windows
from tidemark.operators.effects import effects
from tidemark.operators.filters import trusted_run


def setting(name: str) -> Column:
    return F.try_element_at(F.col("params"), F.lit(name))


def current_runs(runs: DataFrame) -> DataFrame:
    """C21 (P24, J18). Every run with ``current``: newest of its rule among overlapping windows.

    Equal windows are settled first by a plain maximum, so the ordered walk sees one run per
    (rule, window), a number bounded by the calendar. A kept run never overlaps another kept one.
    """
    r = runs.withColumn("fp", fingerprint(F.col("params")))
    newest = r.groupBy("fp", "start_d", "end_d").agg(F.max(F.struct("ts", "id")).alias("_o"))
    kept = free_windows(newest.select("fp", "start_d", "end_d", "_o.ts", "_o.id"), ["fp"], "id").withColumn("current", F.lit(True))
    return r.join(kept, "id", "left").withColumn("current", F.coalesce("current", F.lit(False)))


def measured_again(runs: DataFrame) -> DataFrame:
    """J18. Every run with ``overlaps``: another run of its rule covers part of its window.

    Settled on the distinct windows of a rule by running extremes, without listing pairs.
    """
    r = runs.withColumn("fp", fingerprint(F.col("params")))
    spans = r.groupBy("fp", "start_d", "end_d").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy("fp").orderBy("start_d", "end_d")
    before = F.max("end_d").over(order.rowsBetween(Window.unboundedPreceding, -1))
    touched = F.coalesce(before >= F.col("start_d"), F.lit(False)) | F.coalesce(F.lead("start_d").over(order) <= F.col("end_d"), F.lit(False))
    spans = spans.withColumn("overlaps", (F.col("_c") > 1) | touched).drop("_c")
    return r.join(spans, ["fp", "start_d", "end_d"])


def only_current(runs: DataFrame) -> DataFrame:
    return current_runs(runs).where(F.col("current")).drop("current", "fp")


def _by_setting(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with their settings as text (``full``), and each run once per own setting with that setting taken out (``rest``, ``value``)."""
    keep = F.map_filter(F.col("params"), lambda k, v: ~k.isin(*IGNORED_SETTINGS))
    base = runs.select("id", "start_d", "end_d", "n", "mean_pct", "std_pct", keep.alias("p"))
    base = base.withColumn("full", fingerprint(F.col("p")))
    own = F.array_distinct(F.transform(F.map_keys(F.map_filter(F.col("p"), lambda k, v: ~k.isin(*RANK_SETTINGS))), logical_setting))
    out = base.withColumn("setting", F.explode(own))
    less = F.map_filter(F.col("p"), lambda k, v: logical_setting(k) != F.col("setting"))
    part = F.map_filter(F.col("p"), lambda k, v: logical_setting(k) == F.col("setting"))
    return base, out.withColumn("rest", fingerprint(less)).withColumn("value", fingerprint(part)).drop("p", "full")


def setting_members(runs: DataFrame) -> DataFrame:
    """C22. Runs by (window, setting, rest): those with the setting, and those that lack it but agree in the rest, with value ''."""
    base, out = _by_setting(runs)
    groups = out.select("start_d", "end_d", "setting", "rest").distinct()
    lacking = base.withColumn("rest", F.col("full")).join(groups, ["start_d", "end_d", "rest"]).withColumn("value", F.lit(""))
    return out.unionByName(lacking.select(*out.columns))


def setting_pairs(runs: DataFrame, setting: str | None = None, start=None, end=None) -> DataFrame:
    """J16. Pairs of runs of one window that differ in exactly one logical setting; with ``setting``, ``start`` and ``end`` those of one view.

    Each run is listed once per own setting with that setting taken out of its fingerprint. Partners
    then meet by equality: both have the setting with other values, or only one of them has it.
    """
    if start is not None:
        runs = runs.where(F.col("start_d") == F.lit(start).cast("date"))
    if end is not None:
        runs = runs.where(F.col("end_d") == F.lit(end).cast("date"))
    base, out = _by_setting(runs)
    if setting is not None:
        out = out.where(F.col("setting") == setting)
    stats = ["n", "mean_pct", "std_pct"]
    left = out.select(*[F.col(c).alias(f"a_{c}") if c in ("id", "value", *stats) else F.col(c) for c in out.columns])
    right = out.select(*[F.col(c).alias(f"b_{c}") if c in ("id", "value", *stats) else F.col(c) for c in out.columns])
    both = left.join(right, ["start_d", "end_d", "setting", "rest"]).where(
        (F.col("a_id") < F.col("b_id")) & (F.col("a_value") != F.col("b_value")))
    lacking = base.select(F.col("id").alias("b_id"), "start_d", "end_d", F.col("full").alias("rest"),
                          *[F.col(c).alias(f"b_{c}") for c in stats])
    one = left.join(lacking, ["start_d", "end_d", "rest"])
    first = F.col("a_id") < F.col("b_id")
    cols = [F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"a_{c}") for c in ("id", *stats)]
    cols += [F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"b_{c}") for c in ("id", *stats)]
    names = ["setting", "start_d", "end_d"]
    both = both.select(*names, *[f"{s}_{c}" for s in "ab" for c in ("id", *stats)])
    return both.unionByName(one.select(*names, *cols))


def with_delta(pairs: DataFrame) -> DataFrame:
    """C22. Difference of means, its standard error for independent samples, and z."""
    known = pairs.where((F.col("a_n") > 0) & (F.col("b_n") > 0)).dropna(
        subset=["a_mean_pct", "b_mean_pct", "a_std_pct", "b_std_pct"])
    se = F.sqrt(F.col("a_std_pct") * F.col("a_std_pct") / F.col("a_n") + F.col("b_std_pct") * F.col("b_std_pct") / F.col("b_n"))
    out = known.withColumn("delta", F.col("b_mean_pct") - F.col("a_mean_pct")).withColumn("se", se)
    return out.withColumn("z", F.when(F.col("se") > 0, F.col("delta") / F.col("se")).otherwise(0.0))


def setting_effects(runs: DataFrame) -> DataFrame:
    """C22. Verdict per setting from sign agreement and the largest abs(z), without listing pairs."""
    out = effects(setting_members(only_current(runs)))
    same = (F.col("lo") > 0) | (F.col("hi") < 0)
    kind = (F.when(F.col("n_comp") < 2, "none").when(same & (F.col("max_abs_z") >= 2), "good")
            .when(same, "warn").otherwise("bad"))
    return out.withColumn("verdict", kind).drop("lo", "hi")


def rank_factor_table(runs: DataFrame) -> DataFrame:
    """C23. Same ranking rule across windows: sign agreement and abs(t) >= 2, survivors first."""
    ranked = only_current(runs).where(setting("rank_col").isNotNull() & (F.coalesce(setting("walkforward"), F.lit("false")) != "true"))
    out = ranked.groupBy(fingerprint(F.col("params")).alias("fp")).agg(
        F.first(setting("rank_col")).alias("rank_col"), F.count("mean_pct").alias("windows"),
        F.min("mean_pct").alias("worst_mean"), F.max("mean_pct").alias("best_mean"), F.max(F.abs("t_val")).alias("max_abs_t"),
        F.transform(F.sort_array(F.collect_list(F.struct("start_d", "mean_pct"))), lambda x: x["mean_pct"]).alias("means"))
    out = out.where(F.col("windows") > 0)
    strong = F.coalesce(F.col("max_abs_t") >= 2, F.lit(False))
    kind = (F.when(F.col("windows") < 2, "none").when((F.col("worst_mean") > 0) & strong, "good")
            .when(F.col("worst_mean") > 0, "warn").otherwise("bad"))
    place = F.when(kind == "good", 0).when(kind == "warn", 1).when(kind == "none", 2).otherwise(3)
    return out.withColumn("verdict", kind).withColumn("place", place)


def walkforward_edges(runs: DataFrame) -> DataFrame:
    """C24, J17. Selected walk-forward runs against the control run of the same window."""
    wf = only_current(runs).where(F.coalesce(setting("walkforward"), F.lit("false")) == "true")
    control = F.coalesce(setting("is_control"), F.lit("false")) == "true"
    base = wf.where(control).groupBy("start_d", "end_d").agg(
        F.min_by(F.struct(F.col("id").alias("id"), F.col("mean_pct").alias("m")), "id").alias("b"))
    out = wf.where(~control).join(base, ["start_d", "end_d"], "left").withColumn("edge", F.col("mean_pct") - F.col("b.m"))
    strong = F.coalesce(F.abs("t_val"), F.lit(0.0)) >= 2
    kind = (F.when(F.col("edge").isNull(), "none").when((F.col("edge") > 0) & strong, "good")
            .when(F.col("edge") > 0, "warn").otherwise("bad"))
    return out.select("id", "strategy", "start_d", "end_d", "mean_pct", "t_val", F.col("b.id").alias("base_id"), "edge",
                      kind.alias("verdict"))


def combined_verdict(runs: DataFrame) -> DataFrame:
    """C25. One rule over at least two current windows: all negative, all non-negative, or unstable."""
    cur = only_current(runs).where(F.col("mean_pct").isNotNull())
    out = cur.groupBy(fingerprint(F.col("params")).alias("fp")).agg(
        F.count(F.lit(1)).alias("windows"), F.min("mean_pct").alias("lo"), F.max("mean_pct").alias("hi"))
    kind = F.when(F.col("hi") < 0, "bad").when(F.col("lo") >= 0, "good").otherwise("warn")
    return out.where(F.col("windows") >= 2).withColumn("verdict", kind)


def run_sections(runs: DataFrame, visible: int = 12, selected: int | None = None) -> DataFrame:
    """C26, L07. Family and trust of every run, its place within its section, newest first.

    Only the trusted section folds away its older runs; biased runs are all shown.
    """
    out = runs.withColumn("family", family(F.col("strategy"))).withColumn(
        "section", F.when(trusted_run(F.col("params")), "trusted").otherwise("biased"))
    # The shown rows are a pruned top-k; all others only carry their section.
    order = Window.partitionBy("family", "section").orderBy(F.col("ts").desc(), F.col("id").desc())
    top = out.select("id", F.row_number().over(order).alias("pos"), "family", "section").where(F.col("pos") <= visible)
    shown = F.col("pos").isNotNull() | (F.col("section") == "biased")
    if selected is not None:
        shown = shown | (F.col("id") == selected)
    return out.join(top.select("id", "pos"), "id", "left").withColumn("shown", shown)
