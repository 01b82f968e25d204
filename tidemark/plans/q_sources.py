"""Registered queries: landed pages, keyed tables and streams.

Landed pages are written the way the sources deliver them, from the given tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.signals import signals_history
from tidemark.plans.domain import nation_code
from tidemark.plans.domain_sql import r
from tidemark.plans.q_signals import CAP, CAPS, DAY, SIGNAL_SELECT, rounded
from tidemark.plans.registry import query
from tidemark.session import pin, shared_folder
from tidemark.sources import landing as L
from tidemark.sources import tables as T
from tidemark.streaming import ingest as I


def compact(d):
    return F.date_format(d, "yyyyMMdd")


def flow_pages(t, broken=False):
    """Pages of one code and month, amounts in millions; the first days of a month come twice. ``broken``: one day's amounts are no numbers."""
    def millions(x):
        return F.floor(F.col(x) / 1000.0).cast("string")

    rows = t.flows.withColumn("page", F.explode(F.when(F.dayofmonth("d") <= 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    late = F.col("page") == 1
    cell = F.struct(
        F.when(F.dayofmonth("d") == 31, "").otherwise(compact(F.col("d"))).alias("stck_bsop_date"),
        F.when(late, F.lit("7")).when(F.lit(broken) & (F.dayofmonth("d") == 25), F.concat(millions("individual_net"), F.lit(",0"))).otherwise(millions("individual_net")).alias("prsn_ntby_tr_pbmn"),
        F.when(F.dayofmonth("d") == 20, F.lit(None).cast("string")).otherwise(millions("foreign_net")).alias("frgn_ntby_tr_pbmn"),
        millions("institution_net").alias("orgn_ntby_tr_pbmn"))
    month = F.year("d") * 12 + F.month("d")
    return rows.groupBy("code", month.alias("_m"), "page").agg(F.collect_list(cell).alias("rows")).select(
        "code", (F.col("_m") + F.col("page") * 100_000).cast("int").alias("page"), "rows")


_M = "CAST(floor({x} / 1000.0) AS BIGINT) * 1000000"
S03 = f"""SELECT code, d, CASE WHEN day(d) <= 5 THEN 7000000 ELSE {_M.format(x='individual_net')} END AS individual_net,
  CASE WHEN day(d) = 20 THEN 0 ELSE {_M.format(x='foreign_net')} END AS foreign_net, {_M.format(x='institution_net')} AS institution_net FROM flows WHERE day(d) <> 31"""


@query("s03_flow_pages", S03, "flows")
def s03(t):
    return L.normalise_flows(flow_pages(t))




@query("s03_rejected_flows", "SELECT code, d FROM flows WHERE day(d) = 25", "flows")
def s03_rejected(t):
    """Rows whose amount is no number are set apart, not stored as 0."""
    return L.rejected_flows(flow_pages(t, broken=True)).select("code", "d")


@query("s02_raw_bars", f"""SELECT code, d, CAST(floor(o) AS DOUBLE) AS o, CAST(floor(h) AS DOUBLE) AS h, CAST(floor(l) AS DOUBLE) AS l, CAST(floor(c) AS DOUBLE) AS c, v FROM bars""", "bars")
def s02(t):
    raw = t.bars.select("code", "d", *[F.floor(v).cast("string").alias(k) if v != "v" else F.col(v).cast("string").alias(k) for k, v in L.BAR_HEADERS.items()])
    first = raw.withColumn("seq", F.lit(0))
    again = raw.withColumn("시가", F.lit("1")).withColumn("seq", F.lit(1))
    return L.normalise_bars(first.unionByName(again))


def credit_pages(t):
    rows = t.credit.withColumn("page", F.explode(F.array(F.lit(0), F.lit(1))))
    cell = F.struct(
        compact(F.col("d")).alias("stlm_date"), F.when(F.col("page") == 1, "1").otherwise(F.col("credit_amt").cast("string")).alias("whol_loan_rmnd_amt"),
        F.when(F.col("credit_amt") > 0, F.round("credit_ratio", 6).cast("string")).alias("whol_loan_rmnd_rate"))
    return rows.groupBy("code", (F.year("d") * 12 + F.month("d")).alias("_m"), "page").agg(F.collect_list(cell).alias("rows")).select("code", "page", "rows")


@query("s04_credit_pages", f"SELECT code, d, credit_amt, CASE WHEN credit_amt > 0 THEN {r('credit_ratio')} ELSE 0.0 END AS credit_ratio FROM credit", "credit")
def s04(t):
    return L.normalise_credit(credit_pages(t))


@query("s05_zero_credit", """SELECT code, d, CAST(0 AS BIGINT) AS credit_amt, CAST(0 AS DOUBLE) AS credit_ratio FROM bars WHERE d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
AND NOT EXISTS (SELECT 1 FROM credit k WHERE k.code = bars.code AND k.d = bars.d)""", "bars credit")
def s05(t):
    return L.zero_credit(t.bars, t.credit, "1996-01-01", "2000-12-31")


def filing_pages(t):
    item = F.struct(F.concat(F.lit(" "), "code").alias("stock_code"), F.when(F.month("d") == 2, "").otherwise(F.col("rcept_no")).alias("rcept_no"),
                    compact(F.col("d")).alias("rcept_dt"), F.concat("report_nm", F.lit(" ")).alias("report_nm"))
    old = item.withField("report_nm", F.concat(F.lit("~"), "report_nm"))  # an earlier arrival, later in the alphabet
    pages = t.disclosures.groupBy("d", "code").agg(F.collect_list(item).alias("list"), F.collect_list(old).alias("olds"))
    page = F.explode(F.array(F.struct(F.lit(1).alias("page"), F.col("olds").alias("list")), F.struct(F.lit(2).alias("page"), F.col("list"))))
    return pages.select(page.alias("p")).select("p.page", "p.list")


@query("s06_filing_pages", "SELECT rcept_no, code, d, report_nm, url FROM disclosures WHERE month(d) <> 2 AND regexp_full_match(code, '[0-9]+')", "disclosures")
def s06(t):
    from tidemark.operators.filters import is_ordinary

    return L.normalise_filings(filing_pages(t), t.instruments.where(is_ordinary(F.col("code"))))


def corp_list(t):
    k = F.col("n_nationkey")
    entry = F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("99999999").alias("corp")), F.struct(F.lit(2).alias("seq"), F.lpad(k.cast("string"), 8, "0").alias("corp"))))
    return t.raw("nation").select("*", entry.alias("e")).select(
        F.col("e.corp").alias("corp_code"), F.col("e.seq").alias("seq"), F.when(k % 5 == 0, " ").when(k % 5 == 1, F.concat(nation_code(k), F.lit(" "))).otherwise(nation_code(k)).alias("stock_code"))


@query("s08_corp_codes", "SELECT code, n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 8, '0') END AS corp_code FROM nat", "nat")
def s08(t):
    return L.attach_corp_codes(t.instruments, L.corp_codes(corp_list(t)))


@query("s19_mapping_coverage", "SELECT count(CASE WHEN n_nationkey % 5 <> 0 THEN 1 END) AS filled, count(*) AS known FROM nation")
def s19(t):
    return L.mapping_coverage(L.attach_corp_codes(t.instruments, L.corp_codes(corp_list(t))))


def account_lines(t):
    """Statements as the source lists them: one line per account, names with spaces."""
    names = {"revenue": "수익 (매출액)", "op_income": "영업이익(손실)", "net_income": "당기순이익 (손실)", "assets": "자산 총계", "liabilities": "부채총계", "equity": "자본총계"}

    def text(x):
        n = F.format_number(F.floor(F.abs(x)), 0)
        return F.when(F.col(x) < 0, F.concat(F.lit("("), n, F.lit(")"))).otherwise(n)

    items = F.array(*[F.struct(F.lit(v).alias("account_nm"), text(k).alias("thstrm_amount"), F.lit(i).alias("seq")) for i, (k, v) in enumerate(names.items())],
                    F.struct(F.lit("이익잉여금").alias("account_nm"), F.lit("1").alias("thstrm_amount"), F.lit(9).alias("seq")))
    corp = F.concat(F.lit("corp"), "code").alias("corp_code")
    return t.financials.withColumn("x", F.explode(items)).select(corp, "period", "fs_div", "x.*")


@query("s09_account_lines", "SELECT code, period, fs_div, " + ", ".join(
    f"CASE WHEN {x} < 0 THEN -floor(-{x}) ELSE floor({x}) END + 0.0 AS {x}" for x in ("revenue", "op_income", "net_income", "assets", "liabilities", "equity")) + " FROM statements", "statements")
def s09(t):
    mapping = t.instruments.select("code", F.concat(F.lit("corp"), "code").alias("corp_code"))
    return L.normalise_accounts(account_lines(t), mapping).select("code", "period", "fs_div", "revenue", "op_income", "net_income", "assets", "liabilities", "equity")


@query("s10_share_rows", "SELECT code, period, issued, treasury, CASE WHEN issued % 2000 = 0 THEN floating END AS floating FROM shares WHERE substr(period, 1, 4) <> '1999'", "shares")
def s10(t):
    n = F.format_number("issued", 0)
    common = F.struct(F.lit(" 보통주").alias("se"), F.when(F.col("period") == "1999Q4", "-").otherwise(n).alias("istc_totqy"), F.format_number("treasury", 0).alias("tesstk_co"),
                      F.when(F.col("issued") % 2000 == 0, F.format_number("floating", 0)).otherwise("-").alias("distb_stock_co"))
    other = F.struct(F.lit("우선주").alias("se"), F.lit("5").alias("istc_totqy"), F.lit("5").alias("tesstk_co"), F.lit("5").alias("distb_stock_co"))
    return L.normalise_shares(t.shares.select("code", "period", F.array(other, common).alias("list")))


@query("s11_pending_ranges", """SELECT n.code, coalesce(k.last, DATE '1995-01-01') AS range_start, DATE '2001-07-31' AS range_end FROM nat n LEFT JOIN (SELECT code, max(d) AS last FROM credit GROUP BY code) k ON k.code = n.code
WHERE k.last IS NULL OR k.last < DATE '2001-07-31'""", "nat credit")
def s11(t):
    return T.pending_ranges(t.instruments, t.credit, "1995-01-01", "2001-07-31")


@query("s12_upsert_overwrite", f"SELECT code, d, credit_amt, CASE WHEN d >= DATE '1999-01-01' THEN 1.0 ELSE {r('credit_ratio')} END AS credit_ratio FROM credit", "credit")
def s12(t):
    batch = t.credit.where(F.col("d") >= "1999-01-01").withColumn("credit_ratio", F.lit(1.0))
    return rounded(T.upsert(t.credit.where(F.col("d") < "2000-01-01"), batch, ["code", "d"]))


@query("s12_upsert_keep", f"SELECT code, d, credit_amt, CASE WHEN d >= DATE '2000-01-01' THEN 1.0 ELSE {r('credit_ratio')} END AS credit_ratio FROM credit", "credit")
def s12_keep(t):
    batch = t.credit.where(F.col("d") >= "1999-01-01").withColumn("credit_ratio", F.lit(1.0))
    return rounded(T.upsert(t.credit.where(F.col("d") < "2000-01-01"), batch, ["code", "d"], "keep"))


@query("s13_derived_flows", "SELECT code, d, -(foreign_net + CASE WHEN day(d) = 10 THEN 0 ELSE institution_net END) AS individual_net, foreign_net, CASE WHEN day(d) = 10 THEN 0 ELSE institution_net END AS institution_net FROM flows", "flows")
def s13(t):
    src = t.flows.select("code", "d", "foreign_net", F.when(F.dayofmonth("d") != 10, F.col("institution_net")).alias("inst_net"))
    return L.derive_flows(src)


@query("s14_row_counts", "SELECT 'stock_daily' AS \"table\", count(*) AS n FROM bars UNION ALL SELECT 'investor_flow', count(*) FROM flows UNION ALL SELECT 'instruments', count(*) FROM nation", "bars flows")
def s14(t):
    return T.row_counts({"stock_daily": t.bars, "investor_flow": t.flows, "instruments": t.instruments})


@query("s01_stored_bars", "SELECT code, d, c, v FROM bars WHERE d BETWEEN DATE '1996-03-01' AND DATE '1997-06-30'", "bars")
def s01_stored(t):
    """Bars by year on disk; the range reads the files of two years."""
    path = scratch(t, "bars")
    T.write_bars(t.bars, path)
    return T.scan_bars(t.spark, path, None, "1996-03-01", "1997-06-30", ("code", "d", "c", "v"))


@query("s04_landed_credit", f"SELECT code, d, credit_amt, CASE WHEN credit_amt > 0 THEN {r('credit_ratio')} ELSE 0.0 END AS credit_ratio FROM credit", "credit")
def s04_landed(t):
    path = scratch(t, "credit")
    credit_pages(t).write.json(path)
    return L.normalise_credit(L.read_json(t.spark, path, schemas.LANDED_CREDIT))


@query("s12_stored_keep", f"SELECT code, d, credit_amt, CASE WHEN d >= DATE '2000-01-01' THEN 1.0 ELSE {r('credit_ratio')} END AS credit_ratio FROM credit", "credit")
def s12_stored(t):
    """Two batches into a table by year: of equal keys the stored row stays."""
    path = scratch(t, "kept")
    year = F.year("d").alias("year")
    T.upsert_table(t.spark, path, t.credit.where(F.col("d") < "2000-01-01").select("*", year), ["code", "d"], "keep")
    T.upsert_table(t.spark, path, t.credit.where(F.col("d") >= "1999-01-01").withColumn("credit_ratio", F.lit(1.0)).select("*", year), ["code", "d"], "keep")
    return rounded(t.spark.read.parquet(path).select("code", "d", "credit_amt", "credit_ratio"))


@query("s08_xml_corp_codes", "SELECT code, n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 8, '0') END AS corp_code FROM nat", "nat")
def s08_xml(t):
    """The corporation list landed as XML, one file per place in the list, read back and attached."""
    path = scratch(t, "corp")
    rows = corp_list(t).select("corp_code", F.concat(F.lit("N"), "corp_code").alias("corp_name"), "stock_code", F.lit("20240101").alias("modify_date"), "seq")
    for place in (1, 2):
        part = rows.where(F.col("seq") == place).drop("seq")
        part.write.format("xml").option("rowTag", "list").option("rootTag", "result").save(f"{path}/place={place}")
    return L.attach_corp_codes(t.instruments, L.read_corp_codes(t.spark, path))


@query("s15_stored_runs", """WITH x AS (SELECT strategy, count(DISTINCT id) AS runs, sum(n)::BIGINT AS trades, min(id) % 3 AS kind FROM runs GROUP BY strategy)
SELECT strategy, runs, CASE kind WHEN 0 THEN trades WHEN 1 THEN 0 ELSE (SELECT count(*) FROM run_trades r JOIN runs q ON q.id = r.run_id WHERE q.strategy = x.strategy AND r.ret_pct > 0) END AS trades,
  CASE WHEN kind = 0 THEN 0 ELSE 1 END AS removed FROM x""", "runs run_trades")
def s15_stored(t):
    """All runs saved with their trades; a third saved again without trades, a third with the gains alone; then what no run points at is removed."""
    path = scratch(t, "runs")
    stored = pin(T.run_rows(t.runs).select("*", (F.min("id").over(Window.partitionBy("strategy")) % 3).alias("kind")), "runs")
    trades = t.run_trades.withColumnRenamed("id", "trade").join(stored.select(F.col("id").alias("run_id"), "strategy", "kind"), "run_id")
    trades = pin(trades.select("strategy", "code", "trade", "entry_d", "exit_d", "ret_pct", "kind"), "trades")
    kind = F.col("kind")
    T.save_runs(path, stored.drop("kind"), trades.drop("kind"))
    T.save_runs(path, stored.where(kind == 1).drop("kind"), trades.where(F.lit(False)).drop("kind"))
    T.save_runs(path, stored.where(kind == 2).drop("kind"), trades.where((kind == 2) & (F.col("ret_pct") > 0)).drop("kind"))
    gone = pin(T.superseded_trades(t.spark, path, older_than=0), "gone")
    T.remove_superseded(t.spark, path, older_than=0)
    kept = T.stored_trades(t.spark, path, "strategy string, code string, trade bigint, entry_d date, exit_d date, ret_pct double")
    out = T.stored_runs(t.spark, path).groupBy("strategy").agg(F.count_distinct("id").alias("runs"))
    out = out.join(kept.groupBy("strategy").agg(F.count(F.lit(1)).alias("trades")), "strategy", "left")
    out = out.join(gone.groupBy("strategy").agg(F.count(F.lit(1)).cast("int").alias("removed")), "strategy", "left")
    return out.select("strategy", "runs", F.coalesce("trades", F.lit(0).cast("bigint")).alias("trades"), F.coalesce("removed", F.lit(0)).alias("removed"))


@query("s01_bucketed_signals", f"SELECT {SIGNAL_SELECT} FROM signals", "signals")
def s01_bucketed(t):
    """C02 from tables bucketed by code: no exchange between the scans and the windows."""
    return rounded(signals_history(*bucketed(t)))


def bucketed(t, buckets=16):
    """Bars, flows and credit stored by code, read back."""
    base, names = scratch(t, "bucketed"), []
    for name in ("bars", "flows", "credit"):
        names.append(f"{name}_{uuid.uuid4().hex}")
        T.store_by_code(getattr(t, name), names[-1], f"{base}/{name}", buckets)
    return [t.spark.table(name) for name in names]


@query("s16_collection_universe", f"""SELECT DISTINCT code FROM bars WHERE code IN (SELECT code FROM ({CAPS}) x WHERE d = DATE '{DAY}' AND market_cap >= {CAP}) OR code IN (SELECT code FROM credit)""", "bars shares credit")
def s16(t):
    from tidemark.operators.fundamentals import dated_market_cap

    caps = dated_market_cap(t.bars.where(F.col("d") == F.lit(DAY).cast("date")), t.shares)
    return T.collection_universe(caps, t.credit, t.bars, CAP)


@query("u01_code_sets", "SELECT code FROM credit UNION SELECT code FROM nat", "credit nat")
def u01(t):
    known = t.raw("nation").select(nation_code(F.col("n_nationkey")).alias("code"))
    return t.credit.select("code").union(known).distinct()


@query("s17_not_stored", "SELECT code FROM nat WHERE code NOT IN (SELECT code FROM shares WHERE period = '1998Q4' AND issued > 80000)", "nat shares")
def s17(t):
    stored = t.shares.where(F.col("issued") > 80000)  # every code has a row of every period; this leaves some to collect
    return T.not_stored(t.instruments.select("code"), stored, "1998Q4")


# ---- streams ------------------------------------------------------------------------------------

def scratch(t, name):
    return f"{shared_folder(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


@query("s20_incremental_ingest", S03, "flows")
def s20(t):
    """Flow pages landed as JSON, ingested twice: the replay must not change the table."""
    base = scratch(t, "flows")
    flow_pages(t).write.json(f"{base}/landed")

    def normalise(batch):
        return L.normalise_flows(batch, keep_seq=True).withColumn("year", F.year("d"))

    for attempt, files in (("a", 1000), ("b", 3)):
        stream = I.read_landed(t.spark, f"{base}/landed", schemas.LANDED_FLOW, files)
        I.ingest(stream, normalise, f"{base}/table", ["code", "d"], f"{base}/checkpoint-{attempt}", order=["page", "pos"], rejected=L.rejected_flows).awaitTermination()
    return t.spark.read.parquet(f"{base}/table").drop("year", "page", "pos")


def event_stream(t):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(t, stream, base, mode):
    """Run a bounded stream to its end; the checkpoint under ``base`` lets a later run go on from there."""

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    run = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


CUT = "2024-01-20 00:00:00"
# The second run brings what is new and what comes late: windows that the first run's watermark closed take no more rows, and those that
# the last watermark has not reached are not out yet.
@query("s21_sliding_alerts", f"""WITH f AS (SELECT *, ts >= TIMESTAMP '{CUT}' OR id % 7 = 0 AS second FROM decisions WHERE decision = '오류'),
m AS (SELECT max(ts) FILTER (WHERE NOT second) - INTERVAL 2 HOUR AS first_mark, max(ts) - INTERVAL 2 HOUR AS last_mark FROM f),
x AS (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM f)
SELECT w AS window_start, w + INTERVAL 24 HOUR AS window_end, split_part(rationale, ' - ', 1) AS label, count(*) AS n, max(ts) AS last_ts
FROM x, m WHERE w + INTERVAL 24 HOUR <= last_mark AND (NOT second OR w + INTERVAL 24 HOUR > first_mark) GROUP BY w, label""", "decisions")
def s21(t):
    base = scratch(t, "alerts")
    failed = t.decisions.where(F.col("decision") == "오류").select("id", "ts", "decision", "rationale")
    second = (F.col("ts") >= F.lit(CUT).cast("timestamp")) | (F.col("id") % 7 == 0)
    for rows in (failed.where(~second), failed.where(second)):
        rows.write.mode("append").parquet(f"{base}/landed")
        stream = I.sliding_alerts(t.spark.readStream.schema(failed.schema).parquet(f"{base}/landed"))
        drain(t, stream, base, "append")
    return t.spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out").select(*stream.columns)


@query("s22_once_per_key", "SELECT DISTINCT user_id, event_type FROM events")
def s22(t):
    stream = I.once_per_key(event_stream(t), ["user_id", "event_type"], late="60 days").select("user_id", "event_type")
    return drain(t, stream, scratch(t, "once"), "append")
