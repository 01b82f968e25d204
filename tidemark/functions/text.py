"""Parsing of amounts, counts, replies, failures and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply labels and the three known decisions (buy, watch, exit).
LABEL_DECISION, LABEL_SCORE, LABEL_REASON = "결정", "확신", "이유"
BUY, WATCH, EXIT = "매수", "관망", "청산"
DECISIONS = (BUY, WATCH, EXIT)
ERROR_DECISION = "오류"
ERROR_SEPARATOR = " - "
DEFAULT_SCORE = 5.0

# Failure labels.
FAIL_NO_KEY = "API 키 미설정"
FAIL_CREDIT = "크레딧 잔액 부족"
FAIL_AUTH = "API 키 인증 실패"
FAIL_RATE = "요청 한도 초과"
FAIL_NETWORK = "API 연결 실패"
FAIL_FORMAT = "응답 형식 오류"
FAIL_OTHER = "API 오류"


def amount(text: Column) -> Column:
    """P10. Thousands separators, ``-``/empty as NULL, parentheses as negative."""
    t = F.regexp_replace(F.trim(text), ",", "")
    negative = t.startswith("(") & t.endswith(")")
    digits = F.when(negative, F.regexp_replace(t, r"^\((.*)\)$", "$1")).otherwise(t)
    value = F.when(~t.isin("", "-"), digits.try_cast("double").try_cast("bigint"))
    return F.when(negative, -value).otherwise(value)


def count(text: Column) -> Column:
    """P11. Whole number with thousands separators, else NULL."""
    t = F.regexp_replace(F.trim(text), ",", "")
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def _stated(text: Column, label: str) -> Column:
    """What follows each mention of ``label`` and a colon, up to the end of the line, without emphasis before it."""
    after = F.slice(F.split(text, label), F.lit(2), F.greatest(F.size(F.split(text, label)) - 1, F.lit(1)))
    values = F.transform(after, lambda x: F.regexp_extract(x, r"^[\s*]*:[\s*]*([^\n]*)", 1))
    return F.filter(values, lambda x: x != "")


def reply_decision(text: Column) -> Column:
    """P17. The known decision named in a reply, NULL when there is none."""
    def known(value: Column) -> Column:
        out = F.when(value.startswith(DECISIONS[0]), DECISIONS[0])
        for d in DECISIONS[1:]:
            out = out.when(value.startswith(d), d)
        return out

    return F.get(F.array_compact(F.transform(_stated(text, LABEL_DECISION), known)), 0)


def reply_score(text: Column) -> Column:
    """P17. Confidence, 5.0 when not stated."""
    numbers = F.filter(F.transform(_stated(text, LABEL_SCORE), lambda x: F.regexp_extract(x, r"^[0-9.]+", 0)), lambda x: x != "")
    return F.coalesce(F.get(numbers, 0).try_cast("double"), F.lit(DEFAULT_SCORE))


def reply_reason(text: Column) -> Column:
    """P17. Stated reason, or the whole reply."""
    raw = F.coalesce(F.get(_stated(text, LABEL_REASON), 0), text)
    return F.trim(F.regexp_replace(F.trim(raw), r"^\*+|\*+$", ""))


def failure_label(kind: Column, message: Column) -> Column:
    """P18. Exhausted credit first, then authentication, rate limit, network, other."""
    return (
        F.when(message.contains("credit balance") | (kind == "billing_error"), FAIL_CREDIT)
        .when(kind == "authentication_error", FAIL_AUTH)
        .when(kind == "rate_limit_error", FAIL_RATE)
        .when(kind == "connection_error", FAIL_NETWORK)
        .otherwise(FAIL_OTHER)
    )


def alert_label(rationale: Column) -> Column:
    """P19. Text before the separator."""
    return F.substring_index(rationale, ERROR_SEPARATOR, 1)


def alert_detail(rationale: Column) -> Column:
    """P19. Text after the first separator, empty without one."""
    at = F.instr(rationale, ERROR_SEPARATOR)
    return F.when(at > 0, F.substr(rationale, at + F.lit(len(ERROR_SEPARATOR)))).otherwise(F.lit(""))


def content_key(*parts: Column) -> Column:
    """P20."""
    return F.md5(F.concat(*parts))


def setting(value: Column, default) -> Column:
    """P21. Stored text cast to the type of its default, or the default itself."""
    kind = {int: "bigint", float: "double", str: "string"}[type(default)]
    return F.coalesce(value.try_cast(kind), F.lit(default))


def name_list(value: Column) -> Column:
    """P21. Comma list without blanks."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def has_key(doc: Column, key: str) -> Column:
    """P27. The JSON object has ``key`` at top level."""
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def non_empty(doc: Column) -> Column:
    """P27. The JSON object exists and has at least one key."""
    return F.coalesce(F.size(F.json_object_keys(doc)) > 0, F.lit(False))
