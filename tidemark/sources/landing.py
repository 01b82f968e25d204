"""Landed pages and files to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.text import amount, count
from tidemark.sources.tables import keep_first, keep_last

# Flow amounts arrive in millions of won; the common-share label; the filing viewer.
MILLION = 1_000_000
COMMON_SHARE = "보통주"
VIEWER_URL = "https://dart.fss.or.kr/dsaf001/main.do?rcpNo="

# Account names (spaces removed) by field.
ACCOUNT_ALIASES = {
    "revenue": ("매출액", "수익(매출액)", "영업수익"),
    "op_income": ("영업이익", "영업이익(손실)"),
    "net_income": ("당기순이익", "당기순이익(손실)"),
    "assets": ("자산총계",),
    "liabilities": ("부채총계",),
    "equity": ("자본총계",),
}

# Column headers of the daily bar source.
BAR_HEADERS = {"시가": "o", "고가": "h", "저가": "l", "종가": "c", "거래량": "v"}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def compact_date(text: Column) -> Column:
    """``yyyymmdd`` to a date, NULL for any other length or an impossible day."""
    return F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd"))


def whole(text: Column, kind: str = "bigint") -> Column:
    """A number in text; empty and missing count as 0, NULL for anything else that is no number."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(0).cast(kind)).otherwise(F.trim(text).try_cast(kind))


def _rows(pages: DataFrame, date: str, numbers: dict[str, Column]) -> DataFrame:
    """Rows of landed pages with a valid date, their numbers, and their place in the order of arrival."""
    rows = pages.select("code", "page", F.posexplode("rows").alias("pos", "r"))
    return rows.select("code", compact_date(F.col(f"r.{date}")).alias("d"), *[c.alias(n) for n, c in numbers.items()],
                       F.struct("page", "pos").alias("seq"), "r").where(F.col("d").isNotNull())


def _all_numbers(numbers: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name in numbers:
        out = out & F.col(name).isNotNull()
    return out


def _bounded(rows: DataFrame, bound: str | Column | None) -> DataFrame:
    if bound is None:
        return rows
    return rows.where(F.col("d") >= (F.lit(bound) if isinstance(bound, str) else bound).cast("date"))


def _flow_numbers() -> dict[str, Column]:
    source = {"individual_net": "prsn_ntby_tr_pbmn", "foreign_net": "frgn_ntby_tr_pbmn", "institution_net": "orgn_ntby_tr_pbmn"}
    return {name: whole(F.col(f"r.{k}")) * MILLION for name, k in source.items()}


def _credit_numbers() -> dict[str, Column]:
    return {"credit_amt": whole(F.col("r.whol_loan_rmnd_amt")), "credit_ratio": whole(F.col("r.whol_loan_rmnd_rate"), "double")}


def _rejected(pages: DataFrame, date: str, numbers: dict[str, Column]) -> DataFrame:
    return _rows(pages, date, numbers).where(~_all_numbers(numbers)).select("code", "d", F.to_json("r").alias("row"))


def rejected_flows(pages: DataFrame) -> DataFrame:
    """S03. Flow rows with a number that cannot be read, as they arrived; a batch that has any must not be stored."""
    return _rejected(pages, "stck_bsop_date", _flow_numbers())


def rejected_credit(pages: DataFrame) -> DataFrame:
    """S04. The same for credit rows."""
    return _rejected(pages, "stlm_date", _credit_numbers())


def normalise_bars(raw: DataFrame) -> DataFrame:
    """S02. Source headers to o, h, l, c, v; the first row of a (code, d) wins."""
    out = raw.select(
        "code", F.col("d").cast("date").alias("d"),
        *[F.col(f"`{k}`").cast("bigint").cast("double").alias(v) if v != "v" else F.col(f"`{k}`").cast("bigint").alias(v)
          for k, v in BAR_HEADERS.items()], "seq")
    return keep_first(out, ["code", "d"], "seq").drop("seq")


def normalise_flows(pages: DataFrame, bound: str | Column | None = None, keep_seq: bool = False) -> DataFrame:
    """S03. Flow pages to won; malformed dates, rows before the bound and rejected rows drop, the last page wins.

    ``keep_seq`` keeps the place of the winning row, so that a stored table can decide between batches.
    """
    numbers = _flow_numbers()
    rows = _bounded(_rows(pages, "stck_bsop_date", numbers), bound).where(_all_numbers(numbers)).select("code", "d", *numbers, "seq")
    out = keep_last(rows, ["code", "d"], "seq")
    return out.select("code", "d", *numbers, "seq.page", "seq.pos") if keep_seq else out.drop("seq")


def normalise_credit(pages: DataFrame, bound: str | None = None) -> DataFrame:
    """S04. Credit pages by settlement date; rejected rows drop, the first row of a (code, d) wins."""
    numbers = _credit_numbers()
    rows = _bounded(_rows(pages, "stlm_date", numbers), bound).where(_all_numbers(numbers)).select("code", "d", *numbers, "seq")
    return keep_first(rows, ["code", "d"], "seq").drop("seq")


def zero_credit(bars: DataFrame, credit: DataFrame, start, end) -> DataFrame:
    """S05. A zero row for every bar without a credit row."""
    inside = bars.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("code", "d").distinct()
    missing = inside.join(credit.select("code", "d"), ["code", "d"], "left_anti")
    return missing.withColumn("credit_amt", F.lit(0).cast("bigint")).withColumn("credit_ratio", F.lit(0.0))


def normalise_filings(pages: DataFrame, known: DataFrame) -> DataFrame:
    """S06. Filings of known codes; of equal receipt numbers the last to arrive, by page and place, stays."""
    r = pages.select("page", F.posexplode("list").alias("pos", "r"))
    out = r.select(
        F.trim("r.rcept_no").alias("rcept_no"), F.trim("r.stock_code").alias("code"), compact_date(F.col("r.rcept_dt")).alias("d"),
        F.trim("r.report_nm").alias("report_nm"), F.struct("page", "pos").alias("seq")).where(F.coalesce(F.col("rcept_no") != "", F.lit(False)))
    out = out.join(known.select("code"), "code", "left_semi").withColumn("url", F.concat(F.lit(VIEWER_URL), "rcept_no"))
    return keep_last(out, ["rcept_no"], "seq").select("rcept_no", "code", "d", "report_nm", "url")


def read_corp_codes(spark: SparkSession, path: str) -> DataFrame:
    """S08. Listed companies of the corporation list: six-character stock codes only."""
    raw = spark.read.format("xml").option("rowTag", "list").schema(schemas.CORP_CODE_XML).load(path)
    # Numbers rise along a file, so they stand for the order of its entries; of several files the last by path wins.
    return corp_codes(raw.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))))


def corp_codes(raw: DataFrame) -> DataFrame:
    """S08. The last entry of each stock code, by ``seq``."""
    out = raw.select(F.trim("stock_code").alias("code"), F.trim("corp_code").alias("corp_code"), "seq")
    out = out.where((F.length("code") == 6) & (F.col("corp_code") != ""))
    return keep_last(out, ["code"], "seq").drop("seq")


def attach_corp_codes(instruments: DataFrame, mapping: DataFrame) -> DataFrame:
    """S08. Update the known instruments, keeping old values where the list has none."""
    new = mapping.select("code", F.col("corp_code").alias("_new"))
    return instruments.join(new, "code", "left").withColumn("corp_code", F.coalesce("_new", "corp_code")).drop("_new")


def mapping_coverage(instruments: DataFrame) -> DataFrame:
    """S19."""
    return instruments.agg(F.count("corp_code").alias("filled"), F.count(F.lit(1)).alias("known"))


def account_field(name: Column) -> Column:
    """Field of an account name, spaces ignored; NULL for accounts that are not kept."""
    plain = F.replace(name, F.lit(" "), F.lit(""))
    out = None
    for field, aliases in ACCOUNT_ALIASES.items():
        hit = plain.isin(*aliases)
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out


def normalise_accounts(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """S09. Account lines (corp_code, period, fs_div, account_nm, thstrm_amount, seq) to one row per (code, period)."""
    from tidemark.operators.fundamentals import preferred

    known = lines.join(mapping.select("corp_code", "code"), "corp_code").withColumn("field", account_field(F.col("account_nm")))
    known = known.where(F.col("field").isNotNull()).withColumn("value", amount(F.col("thstrm_amount")).cast("double"))
    # Wrapped, so that a last line without an amount still replaces an earlier one.
    last = [F.max_by(F.when(F.col("field") == f, F.struct("value")), F.when(F.col("field") == f, F.col("seq"))).getField("value").alias(f)
            for f in ACCOUNT_ALIASES]
    return preferred(known.groupBy("code", "period", "fs_div").agg(*last))


def normalise_shares(pages: DataFrame) -> DataFrame:
    """S10. First common-share row of each page; dropped when the issued count is missing."""
    rows = pages.select("code", "period", F.posexplode("list").alias("pos", "r")).where(F.trim("r.se") == COMMON_SHARE)
    out = rows.select(
        "code", "period", "pos", count(F.col("r.istc_totqy")).alias("issued"), count(F.col("r.tesstk_co")).alias("treasury"),
        count(F.col("r.distb_stock_co")).alias("floating"))
    return keep_first(out, ["code", "period"], "pos").drop("pos").where(F.col("issued").isNotNull())


def derive_flows(source: DataFrame) -> DataFrame:
    """S13. Individual net as the mirror of foreign and institution net, missing counted as 0."""
    foreign, inst = F.coalesce("foreign_net", F.lit(0)), F.coalesce("inst_net", F.lit(0))
    return source.select("code", "d", (-(foreign + inst)).alias("individual_net"), foreign.alias("foreign_net"),
                         inst.alias("institution_net"))
