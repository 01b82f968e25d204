"""The six ratios, heat score and label of every code and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.heat import heat_label, heat_score
from tidemark.functions.nulls import finite_or_null, ratio
from tidemark.operators.windows import bar_index, by_code, carried

WINDOW = 30
METRICS = (
    "heat_score",
    "individual_flow_ratio",
    "credit_surge_ratio",
    "volume_ratio",
    "foreign_flow_ratio",
    "institution_flow_ratio",
)


def aligned_sources(bars: DataFrame, flows: DataFrame, credit: DataFrame) -> DataFrame:
    """J12. Bars with the flow and credit row of the same code and day, where there is one."""
    return bars.join(flows, ["code", "d"], "left").join(credit, ["code", "d"], "left")


def with_heat(df: DataFrame) -> DataFrame:
    score = heat_score(F.col("individual_flow_ratio"), F.col("credit_surge_ratio"), F.col("volume_ratio"))
    return df.withColumn("heat_score", score).withColumn("signal", heat_label(F.col("heat_score")))


STATE = ("code", "d", "_amount", "individual_net", "foreign_net", "institution_net", "_credit", "_level", "_seq")


def _rows(bars: DataFrame, flows: DataFrame, credit: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Aligned sources as the windows read them; credit as told on its day."""
    return aligned_sources(bars, flows, credit).select(
        "code", "d", *keep, (F.col("c") * F.col("v").cast("double")).alias("_amount"),
        *[F.col(x).cast("double").alias(x) for x in ("individual_net", "foreign_net", "institution_net")],
        F.col("credit_amt").cast("double").alias("_credit"), F.col("credit_ratio").alias("_level"))


def with_warmup(bars: DataFrame, flows: DataFrame, credit: DataFrame, start, window: int = WINDOW, keep: tuple[str, ...] = (),
                span: int | None = None) -> DataFrame:
    """Aligned rows from ``start`` on and, before it, enough for their windows and carried credit.

    Every source is read from ``span`` calendar days before ``start`` on, which reaches the scans as a filter. A code whose
    ``window`` rows or whose credit lie further back (a long suspension, the last credit told long ago) gets its older rows as
    well, found by a semi-join; where there is no such code, adaptive execution drops that branch.
    """
    first = F.lit(start).cast("date")
    edge = F.date_sub(first, 3 * window if span is None else span)
    near = _rows(*(x.where(F.col("d") >= edge) for x in (bars, flows, credit)), keep)
    before = F.when(F.col("d") < first, F.col("d"))
    codes = near.groupBy("code").agg(
        F.max("d").alias("_last"),
        # At most ``span`` days: the day from which on windows look at rows.
        F.try_element_at(F.sort_array(F.collect_list(before), asc=False), F.lit(window)).alias("_from"),
        *[F.min(F.when(F.col(x).isNotNull(), F.col("d"))).alias(f"_told{x}") for x in ("_credit", "_level")])
    untold = [F.coalesce(F.col(f"_told{x}") > F.col("_from"), F.lit(True)) for x in ("_credit", "_level")]
    codes = codes.where((F.col("_last") >= first) & (F.col("_from").isNull() | untold[0] | untold[1]))
    older = [x.where(F.col("d") < edge) for x in (bars, flows, credit)]
    # Codes whose rows reach back far enough need older rows for their credit alone, and only where some was told.
    told = older[2].select("code").distinct().withColumn("_older", F.lit(True))
    codes = codes.join(told, "code", "left").where(F.col("_from").isNull() | F.col("_older")).select("code")
    far = _rows(older[0].join(codes, "code", "left_semi"), older[1], older[2], keep)
    return near.unionByName(far)


def _ratios(base: DataFrame, window: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The six ratios of rows with carried credit and position ``_seq``, from position ``window`` + 1 on."""
    # One pass over the prior window for all sources; ratios follow as plain expressions.
    prior = by_code().rowsBetween(-window, -1)
    parts = {
        "individual_flow_ratio": (F.col("individual_net"), F.abs("individual_net")),
        "credit_surge_ratio": (F.col("_credit"), F.col("_credit")),
        "volume_ratio": (F.col("_amount"), F.col("_amount")),
        "foreign_flow_ratio": (F.col("foreign_net"), F.abs("foreign_net")),
        "institution_flow_ratio": (F.col("institution_net"), F.abs("institution_net")),
    }
    wide = base.select(
        "code", "d", *keep, "_seq", "_level",
        *[now.alias(f"_x_{n}") for n, (now, _) in parts.items()],
        *[F.avg(past).over(prior).alias(f"_m_{n}") for n, (_, past) in parts.items()],
        *[F.count(past).over(prior).alias(f"_n_{n}") for n, (_, past) in parts.items()],
    ).where(F.col("_seq") > window)
    return wide.select(
        "code", "d", *keep,
        *[finite_or_null(F.when(F.col(f"_n_{n}") == window, ratio(F.col(f"_x_{n}"), F.col(f"_m_{n}")))).alias(n) for n in parts],
        finite_or_null(F.col("_level")).alias("credit_ratio_level"),
    )


def signals_history(bars: DataFrame, flows: DataFrame, credit: DataFrame,
                    start=None, end=None, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """C02. Signals of all days in one job: one exchange on code carries every window.

    ``keep`` names bar columns to carry along, so later per-code windows need no second join. With ``start`` the scans read the
    days from there on and a warm-up before it, see ``with_warmup``; the rows are those of the whole history cut at ``start``.
    """
    if end is not None:  # no window looks ahead, so later rows need not be read
        bars, flows, credit = (x.where(F.col("d") <= F.lit(end).cast("date")) for x in (bars, flows, credit))
    rows = _rows(bars, flows, credit, keep) if start is None else with_warmup(bars, flows, credit, start, window, keep)
    base = rows.withColumns(
        {"_credit": carried(F.col("_credit")), "_level": carried(F.col("_level")), "_seq": bar_index()})
    ratios = _ratios(base, window, keep)
    if start is not None:
        ratios = ratios.where(F.col("d") >= F.lit(start).cast("date"))
    return with_heat(ratios)


def empty_state(spark: SparkSession) -> DataFrame:
    """The state before any day."""
    values = ", ".join(f"{c} double" for c in STATE[2:-1])
    return spark.createDataFrame([], f"code string, d date, {values}, _seq int")


def signals_increment(state: DataFrame, bars: DataFrame, flows: DataFrame, credit: DataFrame,
                      window: int = WINDOW) -> dict[str, DataFrame]:
    """C02 for new days alone: ``signals`` of the rows after each code's newest state row, and the ``state`` after them.

    The state is the newest ``window`` rows of every code with the credit carried so far and their positions in the code's history,
    which is all that the windows of later days can see. History cut into batches of whole days gives the same rows as
    ``signals_history`` in one run. Rows of days that a code's state has reached already are ignored, so a batch that is
    delivered again adds nothing. The work is that of the batch and the state, whatever the length of the history.
    """
    last = state.groupBy("code").agg(F.max("d").alias("_last"))
    new = _rows(bars, flows, credit).join(last, "code", "left").where(F.col("_last").isNull() | (F.col("d") > F.col("_last"))).drop("_last")
    both = state.select(*STATE, F.lit(False).alias("_new")).unionByName(
        new.withColumns({"_seq": F.lit(None).cast("int"), "_new": F.lit(True)}).select(*STATE, "_new"))
    code = Window.partitionBy("code")
    rows = both.withColumns({
        "_credit": carried(F.col("_credit")), "_level": carried(F.col("_level")),
        "_seq": F.coalesce(F.min("_seq").over(code), F.lit(1)) - 1 + bar_index()})
    marks = rows.where("_new").select("code", "d")
    newest = Window.partitionBy("code").orderBy(F.col("d").desc())
    after = rows.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= window).select(*STATE)
    return {"signals": with_heat(_ratios(rows, window).join(marks, ["code", "d"], "left_semi")), "state": after}


def advance_signals(folder: str, number: int, bars: DataFrame, flows: DataFrame, credit: DataFrame, window: int = WINDOW) -> None:
    """Store batch ``number`` (1, 2, ...) of the daily run under ``folder``.

    The signals of the batch are written before the state that follows it, and a batch reads the state of the one before. A run that
    fails in between is repeated under its number and replaces what it left.
    """
    spark = bars.sparkSession
    state = empty_state(spark) if number == 1 else spark.read.parquet(f"{folder}/state/{number - 1}")
    out = signals_increment(state, bars, flows, credit, window)
    out["signals"].write.mode("overwrite").parquet(f"{folder}/signals/batch={number}")
    out["state"].write.mode("overwrite").parquet(f"{folder}/state/{number}")


def stored_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of all stored batches."""
    return spark.read.option("basePath", f"{folder}/signals").parquet(f"{folder}/signals").drop("batch")


def newest_rows(df: DataFrame, codes: DataFrame, d, rows: int, span: int | None = None) -> DataFrame:
    """Rows of ``codes`` up to day ``d`` that hold the newest ``rows`` of every code.

    The days of the last ``span`` are read first, by a filter on the scan; codes with fewer rows there get their older ones too.
    """
    day = F.lit(d).cast("date")
    edge = F.date_sub(day, 3 * rows if span is None else span)
    near = df.where((F.col("d") > edge) & (F.col("d") <= day)).join(codes, "code", "left_semi")
    enough = near.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows)
    short = codes.select("code").join(enough, "code", "left_anti")
    return near.unionByName(df.where(F.col("d") <= edge).join(short, "code", "left_semi"))


def _latest(df: DataFrame, codes: DataFrame, d, rows: int, values: dict) -> DataFrame:
    """Newest ``rows`` rows of each of ``codes`` up to ``d``, reduced to today's value and the mean before it."""
    recent = Window.partitionBy("code").orderBy(F.col("d").desc())
    top = newest_rows(df, codes, d, rows).select(
        "code", *[x.alias(n) for n, x in values.items()], F.row_number().over(recent).alias("rn")
    ).where(F.col("rn") <= rows)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for n in values:
        aggs += [
            F.max(F.when(F.col("rn") == 1, F.col(n))).alias(f"{n}_now"),
            F.avg(F.when(F.col("rn") > 1, F.col(n))).alias(f"{n}_mean"),
            F.avg(F.when(F.col("rn") > 1, F.abs(n))).alias(f"{n}_abs"),
        ]
    return top.groupBy("code").agg(*aggs)


def signals_on(bars: DataFrame, flows: DataFrame, credit: DataFrame, d, window: int = WINDOW) -> DataFrame:
    """C01. Signals of one day from the newest ``window + 1`` rows of each source."""
    need = window + 1
    day = F.lit(d).cast("date")
    today = bars.where(F.col("d") == day).select("code")
    b = _latest(bars, today, d, need, {"amount": F.col("c") * F.col("v").cast("double")}).where(F.col("rows") >= need)
    f = _latest(flows, today, d, need, {x: F.col(f"{x}_net").cast("double") for x in ("individual", "foreign", "institution")})
    k = _latest(credit, today, d, need, {"credit_amt": F.col("credit_amt").cast("double"), "level": F.col("credit_ratio")})
    f = f.select("code", *[
        F.when(F.col("rows") >= need, finite_or_null(ratio(F.col(f"{x}_now"), F.col(f"{x}_abs")))).alias(f"{x}_flow_ratio")
        for x in ("individual", "foreign", "institution")
    ])
    k = k.select(
        "code",
        F.when(F.col("rows") >= need, finite_or_null(ratio(F.col("credit_amt_now"), F.col("credit_amt_mean"))))
        .alias("credit_surge_ratio"),
        finite_or_null(F.col("level_now")).alias("credit_ratio_level"),
    )
    b = b.select("code", finite_or_null(ratio(F.col("amount_now"), F.col("amount_mean"))).alias("volume_ratio"))
    out = today.join(b, "code").join(f, "code", "left").join(k, "code", "left")
    return with_heat(out.select(
        "code", day.alias("d"), "individual_flow_ratio", "credit_surge_ratio", "volume_ratio",
        "foreign_flow_ratio", "institution_flow_ratio", "credit_ratio_level",
    ))
