"""Domain tables derived from the given star schema.

Amounts are summed as whole cents, so results do not depend on the order of summation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nation_code(key: Column) -> Column:
    """Six characters; two of the 25 codes end in a letter (not ordinary shares)."""
    tail = F.when(key % 12 == 11, "K").otherwise("0")
    return F.concat(F.lpad(key.cast("string"), 5, "0"), tail)


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


class Domain:
    """Lazily built tables; ``level`` chooses nation codes (few, long) or supplier codes (many)."""

    def __init__(self, spark: SparkSession, sf_dir: str, level: str = "nation"):
        self.spark, self.sf_dir, self.level = spark, sf_dir, level

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def supplier_level(self) -> Domain:
        return Domain(self.spark, self.sf_dir, "supplier")

    @cached_property
    def lines(self) -> DataFrame:
        li = self.raw("lineitem").withColumn("d", F.col("l_shipdate").cast("date"))
        if self.level == "supplier":
            return li.withColumn("code", F.lpad(F.col("l_suppkey").cast("string"), 7, "0"))
        supplier = self.raw("supplier").select("s_suppkey", "s_nationkey")
        return li.join(supplier, li.l_suppkey == supplier.s_suppkey).withColumn(
            "code", nation_code(F.col("s_nationkey")))

    @cached_property
    def bars(self) -> DataFrame:
        px = F.col("l_extendedprice") / F.col("l_quantity")
        at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        return self.lines.groupBy("code", "d").agg(
            F.min_by(px, at).alias("o"), F.max(px).alias("h"), F.min(px).alias("l"), F.max_by(px, at).alias("c"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("v"),
        )

    @cached_property
    def flows(self) -> DataFrame:
        amt = F.floor("l_extendedprice").cast("bigint") * F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)

        def of(flag):
            return F.sum(F.when(F.col("l_returnflag") == flag, amt).otherwise(F.lit(0)))

        return self.lines.groupBy("code", "d").agg(
            of("N").alias("individual_net"), of("A").alias("foreign_net"), of("R").alias("institution_net"))

    @cached_property
    def sales(self) -> DataFrame:
        """Orders with the code of the customer's nation (or the customer key at supplier level)."""
        orders = self.raw("orders").withColumn("d", F.col("o_orderdate").cast("date"))
        if self.level == "supplier":
            return orders.withColumn("code", F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
        customer = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        return orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn(
            "code", nation_code(F.col("c_nationkey")))

    @cached_property
    def credit(self) -> DataFrame:
        amt = F.floor("o_totalprice").cast("bigint")
        both = self.sales.groupBy("code", "d").agg(
            F.sum(F.when(F.col("o_orderstatus") == "O", amt).otherwise(F.lit(0))).alias("credit_amt"),
            F.sum(amt).alias("_all"))
        return both.select("code", "d", "credit_amt",
                           (F.col("credit_amt").cast("double") / F.col("_all").cast("double")).alias("credit_ratio"))

    @cached_property
    def shares(self) -> DataFrame:
        per = self.sales.groupBy("code", "c_nationkey", F.year("d").alias("y")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"))
        unit = F.when((F.col("c_nationkey") % 7 == 3) & (F.col("y") == 1998), 1000).otherwise(1)
        issued = F.col("n") * 1000 * unit
        return per.select(
            "code", F.concat(F.col("y").cast("string"), F.lit("Q4")).alias("period"),
            issued.cast("bigint").alias("issued"), (F.col("f") * 10).cast("bigint").alias("treasury"),
            (issued - F.col("f") * 10).cast("bigint").alias("floating"))

    @cached_property
    def financials(self) -> DataFrame:
        """Consolidated and separate statements; Q1-Q3 stand alone, Q4 carries the whole year."""
        p, disc, tax = (cents(F.col(x)) for x in ("l_extendedprice", "l_discount", "l_tax"))
        flows = self.lines.groupBy("code", "s_nationkey", F.year("d").alias("y"), F.quarter("d").alias("q")).agg(
            F.sum(p).alias("rev"), F.sum(p * (6 - disc)).alias("op"), F.sum(p * (55 - disc * 10 - tax)).alias("net"))
        year = Window.partitionBy("code", "y")

        def yearly(x):
            return F.when(F.col("q") == 4, F.sum(x).over(year)).otherwise(F.col(x)).cast("double")

        balance = self.raw("supplier").groupBy("s_nationkey").agg(F.sum(cents(F.col("s_acctbal"))).alias("b"))
        whole = flows.join(balance, "s_nationkey").select(
            "code", "s_nationkey", F.concat(F.col("y").cast("string"), F.lit("Q"), F.col("q").cast("string")).alias("period"),
            (yearly("rev") / 100.0).alias("revenue"), (yearly("op") / 10000.0).alias("op_income"),
            (yearly("net") / 100000.0).alias("net_income"),
            (F.col("b").cast("double") / 10.0 - 100000.0).alias("equity"),
            (F.abs(F.col("b").cast("double") / 10.0) * (F.col("s_nationkey") % 5 + 1) * 0.5).alias("liabilities"),
        ).withColumn("assets", F.col("equity") + F.col("liabilities"))
        nat = F.col("s_nationkey")
        cols = ["code", "period", "fs_div", "revenue", "op_income", "net_income", "assets", "liabilities", "equity"]
        kinds = F.array_compact(F.array(F.when(nat % 5 != 4, "CFS"), F.when((nat % 2 == 0) | (nat % 5 == 4), "OFS")))
        half = F.when(F.col("fs_div") == "OFS", 0.5).otherwise(1.0)
        out = whole.withColumn("fs_div", F.explode(kinds))
        return out.select(*[F.col(c) if c in cols[:3] else (F.col(c) * half).alias(c) for c in cols])

    @cached_property
    def statements(self) -> DataFrame:
        """One preferred statement per (code, period)."""
        from tidemark.operators.fundamentals import preferred

        return preferred(self.financials)

    @cached_property
    def disclosures(self) -> DataFrame:
        """One earnings report per code and quarter, filed 45 days after the quarter ends."""
        periods = self.lines.groupBy("code", F.year("d").alias("y"), F.quarter("d").alias("q")).agg(
            F.count(F.lit(1)).alias("n"))
        end = F.last_day(F.make_date(F.col("y"), F.col("q") * 3, F.lit(1)))
        name = F.when(F.col("q") == 4, "사업보고서").when(F.col("q") == 2, "반기보고서").otherwise("분기보고서")
        rcept = F.concat(F.date_format(F.date_add(end, 45), "yyyyMMdd"), F.col("code"))
        return periods.select(
            rcept.alias("rcept_no"), "code", F.date_add(end, 45).alias("d"),
            F.concat(name, F.lit(" ("), F.date_format(end, "yyyy.MM"), F.lit(")")).alias("report_nm"),
            F.concat(F.lit("https://dart.fss.or.kr/dsaf001/main.do?rcpNo="), rcept).alias("url"))

    @cached_property
    def ledger(self) -> DataFrame:
        key = F.col("o_orderkey")
        side = F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy")
        sold = F.col("o_orderstatus") == "F"
        qty = (1 + key % 10).cast("double")
        reason = F.when(key % 3 == 0, "stop").when(key % 3 == 1, "expiry").otherwise("heat_signal")
        agents = F.when(key % 3 == 0, "{}").when(key % 3 == 1, '{"value_trap":"buy"}').otherwise('{"risk":"buy"}')
        return self.sales.select(
            key.alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"), "d", F.lit("paper").alias("mode"), side.alias("side"),
            "code", F.concat(F.lit("N"), F.col("code")).alias("name"), qty.alias("qty"),
            (F.col("o_totalprice") / qty).alias("price"), F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("strategy"), F.when(~sold, agents).alias("agents"),
            F.when(sold, reason).alias("exit_reason"),
            F.when(sold, ((key * 37) % 201 - 100).cast("double") / 1000.0).alias("realized_pct"))

    @cached_property
    def positions(self) -> DataFrame:
        """Newest buy per (code, strategy)."""
        newest = F.struct("ts", "id")
        buys = self.ledger.where(F.col("side") == "buy").groupBy("code", "strategy", "mode").agg(
            F.max_by(F.struct("name", "d", "price", "qty"), newest).alias("b"))
        return buys.select(
            "code", "strategy", F.col("b.name").alias("name"), F.col("b.d").alias("entry_date"),
            (F.col("b.price") / F.lit(40.0)).alias("entry_px"), F.col("b.qty").alias("qty"),
            (F.col("b.price") / F.lit(40.0) * F.lit(0.93)).alias("stop_px"), F.lit(20).alias("max_hold_days"), "mode")

    @cached_property
    def decisions(self) -> DataFrame:
        """Agent verdicts: one row per event."""
        u = F.col("user_id")
        names = F.array(*[F.lit(x) for x in ("market_state", "risk", "disclosure", "financials", "value_trap")])
        failed = F.col("event_type") == "error"
        decision = (F.when(failed, "오류").when(F.col("event_type") == "signup", "관망")
                    .when(F.col("event_type") == "click", "청산").otherwise("매수"))
        label = F.when(F.col("event_id") % 2 == 0, "요청 한도 초과").otherwise("API 연결 실패")
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), nation_code(u % 25).alias("code"),
            F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("agent"),
            F.when(failed, 0.0).otherwise(F.round(F.col("value") % 10, 2)).alias("score"), decision.alias("decision"),
            F.when(failed, F.concat(label, F.lit(" - "), F.col("props"))).otherwise(F.col("event_type")).alias("rationale"),
            F.lit("model").alias("model"),
            F.when(~failed, F.md5(F.concat(F.col("event_type"), (u % 25).cast("string"), F.lit(":"), F.col("props")))).alias("input_hash"))

    @cached_property
    def instruments(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(nation_code(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"),
                        F.lit(None).cast("string").alias("corp_code"))

    @cached_property
    def signals(self) -> DataFrame:
        from tidemark.operators.signals import signals_history

        return signals_history(self.bars, self.flows, self.credit)

    @cached_property
    def run_trades(self) -> DataFrame:
        """Sells of the ledger, assigned to the test runs they belong to."""
        from tidemark.plans.run_tables import run_trades

        return run_trades(self)

    @cached_property
    def runs(self) -> DataFrame:
        from tidemark.plans.run_tables import runs

        return runs(self)
