import json
import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.signals import signals_history
from tidemark.sources import landing as L
from tidemark.sources import tables as T
from tidemark.streaming import ingest as I


def page(code, number, *rows):
    keys = ("stck_bsop_date", "prsn_ntby_tr_pbmn", "frgn_ntby_tr_pbmn", "orgn_ntby_tr_pbmn")
    return {"code": code, "page": number, "rows": [dict(zip(keys, r)) for r in rows]}


def land(folder, name, *pages):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(json.dumps(p) for p in pages))


def test_flow_units_dates_and_order(spark, tmp_path):
    land(f"{tmp_path}/in", "a", page("A", 1, ("20260818", "51", "-40", "-11"), ("", "1", "1", "1"), ("2026081", "1", "1", "1")), page("A", 2, ("20260817", None, " ", None), ("20260818", "52", "-40", "-12"), ("20260819", "1,2", "0", "0")))
    df = L.normalise_flows(L.read_json(spark, f"{tmp_path}/in", schemas.LANDED_FLOW))
    got = {r["d"].day: (r["individual_net"], r["foreign_net"], r["institution_net"]) for r in df.collect()}
    assert got == {18: (52_000_000, -40_000_000, -12_000_000), 17: (0, 0, 0)}
    assert L.normalise_flows(L.read_json(spark, f"{tmp_path}/in", schemas.LANDED_FLOW), "2026-08-18").count() == 1
    bad = L.rejected_flows(L.read_json(spark, f"{tmp_path}/in", schemas.LANDED_FLOW)).collect()
    assert [r["d"].day for r in bad] == [19] and json.loads(bad[0]["row"])["prsn_ntby_tr_pbmn"] == "1,2"


def test_corp_code_xml(spark, tmp_path):
    (tmp_path / "corp.xml").write_text(
        "<result><list><corp_code>00126380</corp_code><corp_name>a</corp_name><stock_code>005930</stock_code><modify_date>1</modify_date></list>"
        "<list><corp_code>00055555</corp_code><corp_name>a</corp_name><stock_code>005930</stock_code><modify_date>2</modify_date></list>"
        "<list><corp_code>00000001</corp_code><corp_name>b</corp_name><stock_code> </stock_code><modify_date>1</modify_date></list></result>")
    assert [(r["code"], r["corp_code"]) for r in L.read_corp_codes(spark, str(tmp_path / "corp.xml")).collect()] == [("005930", "00055555")]


def test_accounts_prefer_consolidated_and_last_line(spark):
    rows = [("c1", "2024Q1", "OFS", "매출액", "1", 1), ("c1", "2024Q1", "CFS", "매 출 액", "2", 2), ("c1", "2024Q1", "CFS", "영업이익(손실)", "(5)", 3),
            ("c1", "2024Q1", "CFS", "자본총계", "7", 4), ("c1", "2024Q1", "CFS", "자본총계", "-", 5), ("zz", "2024Q1", "CFS", "매출액", "9", 6)]
    lines = spark.createDataFrame(rows, "corp_code string, period string, fs_div string, account_nm string, thstrm_amount string, seq int")
    r = L.normalise_accounts(lines, spark.createDataFrame([("c1", "A")], "corp_code string, code string")).collect()
    assert len(r) == 1 and (r[0]["code"], r[0]["fs_div"], r[0]["revenue"], r[0]["op_income"], r[0]["equity"]) == ("A", "CFS", 2.0, -5.0, None)


def test_zero_credit_fills_every_bar(spark):
    bars = spark.createDataFrame([("A", date(2024, 1, i)) for i in range(1, 11)], "code string, d date")
    credit = spark.createDataFrame([("A", date(2024, 1, 3), 5, 0.1)], schemas.CREDIT_BALANCE)
    assert L.zero_credit(bars, credit, "2024-01-02", "2024-01-09").count() == 7
    many = spark.range(50_001).select(F.concat(F.lit("C"), "id").alias("code"), F.lit("2024-01-02").cast("date").alias("d"))
    assert L.zero_credit(many, credit, "2024-01-01", "2024-01-09").count() == 50_001


def test_upsert_table_rewrites_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/t"

    def batch(*rows):
        return spark.createDataFrame([(c, date.fromisoformat(d), v) for c, d, v in rows], "code string, d date, v int").withColumn("year", F.year("d"))

    T.upsert_table(spark, path, batch(("A", "2023-01-02", 1), ("A", "2024-01-02", 1)), ["code", "d"])
    before = {f: os.stat(f"{path}/year=2023/{f}").st_mtime_ns for f in os.listdir(f"{path}/year=2023")}
    T.upsert_table(spark, path, batch(("A", "2024-01-02", 2), ("A", "2024-01-03", 2)), ["code", "d"])
    T.upsert_table(spark, path, batch(("A", "2024-01-03", 9)), ["code", "d"], "keep")
    got = {str(r["d"]): r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {"2023-01-02": 1, "2024-01-02": 2, "2024-01-03": 2}
    assert before == {f: os.stat(f"{path}/year=2023/{f}").st_mtime_ns for f in os.listdir(f"{path}/year=2023")}
    with pytest.raises(ValueError):
        T.upsert(batch(("A", "2024-01-02", 1)), batch(("A", "2024-01-02", 1)), ["code", "d"], "other")


def test_save_runs_replaces_a_strategy(spark, tmp_path):
    def save(strategy, n):
        runs = spark.createDataFrame([(1, strategy, n)], "id int, strategy string, n int")
        trades = spark.createDataFrame([(strategy, i) for i in range(n)], "strategy string, i int")
        T.save_runs(str(tmp_path), runs, trades)

    def trades():
        return {r["strategy"]: r["count"] for r in T.stored_trades(spark, str(tmp_path), "strategy string, i int").groupBy("strategy").count().collect()}

    save("a", 3), save("b", 2), save("a", 1)
    assert trades() == {"a": 1, "b": 2}
    save("a", 0)
    assert trades() == {"b": 2} and T.stored_runs(spark, str(tmp_path)).count() == 2


def test_superseded_trades_are_removed(spark, tmp_path):
    path = f"{tmp_path}/a b%c"  # blanks and percent signs are escaped in file addresses

    def save(*names):
        runs = spark.createDataFrame([(1, n) for n in names], "id int, strategy string")
        T.save_runs(path, runs, spark.createDataFrame([(n, len(names)) for n in names], "strategy string, i int"))

    def trades():
        return sorted((r["strategy"], r["i"]) for r in T.stored_trades(spark, path, "strategy string, i int").collect())

    save("x", "y/z"), save("x")
    assert T.remove_superseded(spark, path) == 0  # too young: a save under way may still point at them
    assert T.remove_superseded(spark, path, older_than=0) == 1 and trades() == [("x", 1), ("y/z", 2)]
    save("y/z")
    assert T.remove_superseded(spark, path, older_than=0) == 1 and trades() == [("x", 1), ("y/z", 1)]
    assert T.superseded_trades(spark, path, older_than=0).count() == 0


def test_corp_code_files_in_order(spark, tmp_path):
    entry = "<list><corp_code>{}</corp_code><corp_name>n</corp_name><stock_code>005930</stock_code><modify_date>20240101</modify_date></list>"
    for name, codes in (("b", ("00000003", "00000004")), ("a", ("00000001", "00000002"))):
        (tmp_path / f"{name}.xml").write_text("<result>" + "".join(entry.format(c) for c in codes) + "</result>")
    assert [r["corp_code"] for r in L.read_corp_codes(spark, str(tmp_path)).collect()] == ["00000004"]


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    codes = ("000010", "000020", "000030")
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(40)]
    bars = spark.createDataFrame([(c, d, 9.0, 11.0, 8.0, 10.0 + i, 100 + i) for c in codes for i, d in enumerate(days)], schemas.STOCK_DAILY)
    flows = bars.select("code", "d", (F.col("v") * 3).alias("individual_net"), F.col("v").alias("foreign_net"), (-F.col("v")).alias("institution_net"))
    credit = bars.select("code", "d", F.col("v").alias("credit_amt"), (F.col("c") / 100).alias("credit_ratio"))
    want = sorted(signals_history(bars, flows, credit).collect())
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        tables = []
        for name, df in (("tb_bars", bars), ("tb_flows", flows), ("tb_credit", credit)):
            T.store_by_code(df, name, f"{tmp_path}/{name}", 4)
            tables.append(spark.table(name))
        got = signals_history(*tables)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in signals_history(bars, flows, credit)._jdf.queryExecution().executedPlan().toString()
        assert sorted(got.collect()) == want and len(want) == 30
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in ("tb_bars", "tb_flows", "tb_credit"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stored_bars_prune(spark, tmp_path):
    bars = spark.createDataFrame([("A", date(y, 1, 2), 1.0, 1.0, 1.0, 1.0, 1) for y in (2022, 2023)], schemas.STOCK_DAILY)
    T.write_bars(bars, f"{tmp_path}/bars")
    assert T.scan_bars(spark, f"{tmp_path}/bars", ["A"], "2023-01-01").count() == 1


def test_pending_ranges(spark):
    codes = spark.createDataFrame([("A",), ("B",), ("C",)], "code string")
    stored = spark.createDataFrame([("A", date(2024, 1, 5)), ("B", date(2024, 1, 10))], "code string, d date")
    got = {r["code"]: r["range_start"] for r in T.pending_ranges(codes, stored, "2024-01-01", "2024-01-10").collect()}
    assert got == {"A": date(2024, 1, 5), "C": date(2024, 1, 1)}


def test_ingest_resumes_and_tolerates_replay(spark, tmp_path):
    folder, table = f"{tmp_path}/in", f"{tmp_path}/table"

    def normalise(batch):
        return L.normalise_flows(batch, keep_seq=True).withColumn("year", F.year("d"))

    def go(checkpoint, files=1000):
        stream = I.read_landed(spark, folder, schemas.LANDED_FLOW, files)
        I.ingest(stream, normalise, table, ["code", "d"], f"{tmp_path}/{checkpoint}", order=["page", "pos"], rejected=L.rejected_flows).awaitTermination()
        return {str(r["d"]): r["individual_net"] for r in spark.read.parquet(table).collect()}

    land(folder, "a", page("A", 1, ("20260817", "1", "0", "0"), ("20260818", "2", "0", "0")))
    assert go("one") == {"2026-08-17": 1_000_000, "2026-08-18": 2_000_000}
    land(folder, "b", page("A", 2, ("20260818", "3", "0", "0")))
    want = {"2026-08-17": 1_000_000, "2026-08-18": 3_000_000}
    assert go("one") == want and go("two") == want
    land(folder, "c", page("A", 0, ("20260818", "9", "0", "0"), ("20260817", "8", "0", "0")))  # an earlier page that arrives late
    assert go("one") == want and go("three", 1) == want
    land(folder, "d", page("A", 3, ("20260818", "x", "0", "0")))
    with pytest.raises(Exception, match="cannot be read"):
        go("one")
    assert spark.read.parquet(f"{table}_rejected").count() == 1


def test_filings_keep_the_last_arrival(spark):
    filing = lambda name: {"stock_code": "A", "rcept_no": "1", "rcept_dt": "20240102", "report_nm": name}
    pages = spark.createDataFrame([(1, [filing("zz old")]), (2, [filing("mm"), filing("[corrected]")])], schemas.LANDED_FILING)
    assert [r["report_nm"] for r in L.normalise_filings(pages, spark.createDataFrame([("A",)], "code string")).collect()] == ["[corrected]"]
