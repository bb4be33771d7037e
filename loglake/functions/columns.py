"""Column helpers shared by the operators. All of them are built-in Spark expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake import schema


def is_blank(col: Column) -> Column:
    """NULL, empty or whitespace only."""
    text = F.coalesce(F.trim(col), F.lit(""))
    return (text == "") | ((F.ascii(text) < 32) & ~text.rlike(r"\S"))


def stripped(col: Column) -> Column:
    """Text without surrounding whitespace; only text that has some is rewritten."""
    edge = (F.ascii(col) <= 32) | (F.ascii(F.substring(col, -1, 1)) <= 32)
    return F.when(edge, F.regexp_replace(col, r"^\s+|\s+$", "")).otherwise(col)


def blank_to_null(col: Column) -> Column:
    return F.when(~is_blank(col), col)


def canon_enum(col: Column, values: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Canonical spelling of an enum name, ignoring case; NULL if it is none.

    Names only: numeric enum text is not accepted.
    """
    spelling = {v.lower(): v for v in values} | (aliases or {})
    pairs = [F.lit(x) for pair in spelling.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(col)))


def level_ord(col: Column) -> Column:
    """Severity rank, 0 = Trace … 5 = Fatal."""
    pairs = [F.lit(x) for i, v in enumerate(schema.LEVELS) for x in (v.lower(), i)]
    return F.try_element_at(F.create_map(*pairs), F.lower(col))


# -- time --------------------------------------------------------------------


def ts_lit(df: DataFrame, value: dt.datetime | str | Column, col: str = "timestamp") -> Column:
    """Literal of the column's own timestamp type, so that comparisons reach the scan as they are.

    A column, such as the time of a stream's batch, is cast to that type.
    """
    if isinstance(value, Column):
        return value.cast(df.schema[col].dataType)
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return F.lit(text).cast(df.schema[col].dataType)


def trunc_time(df: DataFrame, unit: str, col: str = "timestamp") -> Column:
    """``date_trunc`` that keeps TIMESTAMP_NTZ columns NTZ."""
    return F.date_trunc(unit, F.col(col)).cast(df.schema[col].dataType)


def window_start(col: str, width: str, slide: str | None = None) -> Column:
    w = F.window(F.col(col), width, slide) if slide else F.window(F.col(col), width)
    return w["start"]


def interval(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def as_instant(col: Column) -> Column:
    return col.cast(T.TimestampType())


def partition_parts(ts: Column) -> dict[str, Column]:
    """Zero-padded year, month, day and hour strings of the event time."""
    return {
        "year": F.date_format(ts, "yyyy"),
        "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"),
        "hour": F.date_format(ts, "HH"),
    }


# -- ids ---------------------------------------------------------------------


def uuid7(millis: Column, *keys: Column) -> Column:
    """Time-ordered id: 48-bit millisecond prefix, version 7, then a hash of the given keys.

    Hashing content instead of drawing random bits gives a retried entry the same id.
    """
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))
    return F.concat(
        F.lpad(F.lower(F.hex(millis)), 12, "0"),
        F.lit("7"),
        F.substring(digest, 1, 3),
        F.lit("8"),
        F.substring(digest, 4, 15),
    )


def uuid7_millis(id_col: Column) -> Column:
    return F.conv(F.substring(F.regexp_replace(id_col, "-", ""), 1, 12), 16, 10).cast("bigint")


def uuid7_time(id_col: Column) -> Column:
    return F.timestamp_millis(uuid7_millis(id_col))


# -- value probes --------------------------------------------------------------
# Accepted grammar, for text without surrounding blanks (`stripped`): bool is true/false only; int64 is an
# optionally signed digit string in range; double also takes thousands separators, exponents, NaN and
# Infinity; timestamps are ISO dates with an optional time and offset. Each probe looks at the first
# character before it tries anything dearer.

_DOUBLE = r"^[+-]?((\d[\d,]*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL_DOUBLES = [sign + name for name in ("nan", "infinity", "∞") for sign in ("", "+", "-")]
_ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"


def _starts_like_number(text: Column) -> Column:
    return F.ascii(text).between(ord("+"), ord("9"))


def parses_bool(text: Column) -> Column:
    return F.length(text).between(4, 5) & F.lower(text).isin("true", "false")


def parses_int64(text: Column) -> Column:
    # A cast that fails is dear, so it is left to the digit strings that may be out of range.
    digits = _starts_like_number(text) & text.rlike(r"^[+-]?\d+$")
    return digits & ((F.length(text) <= 18) | text.try_cast("bigint").isNotNull())


def _is_plain_double(text: Column) -> Column:
    return _starts_like_number(text) & text.rlike(_DOUBLE)


def _is_special_double(text: Column) -> Column:
    return F.lower(text).isin(_SPECIAL_DOUBLES)


def to_double(col: Column) -> Column:
    """Number held in text, or NULL."""
    text = stripped(col)
    special = F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).otherwise(
        F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    )
    return F.when(_is_plain_double(text), F.translate(text, ",", "").try_cast("double")).when(
        _is_special_double(text), special
    )


def parses_double(text: Column) -> Column:
    return _is_plain_double(text) | _is_special_double(text)


def parses_timestamp(text: Column) -> Column:
    dated = _starts_like_number(text) & (F.substring(text, 5, 1) == "-")
    return dated & text.rlike(_ISO_TIMESTAMP) & text.try_cast("timestamp").isNotNull()


# -- small predicates ----------------------------------------------------------


def error_list(*checks: tuple[Column, str]) -> Column:
    """Array of the messages whose condition holds. All conditions are looked at."""
    entries = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)) for cond, msg in checks])
    return F.filter(entries, lambda e: e.isNotNull())


def breached(value: Column, op: Column, threshold: Column) -> Column:
    """Threshold comparison; NULL for an unknown operator."""
    o = F.trim(op)
    return (
        F.when(o == ">", value > threshold)
        .when(o == "<", value < threshold)
        .when(o == ">=", value >= threshold)
        .when(o == "<=", value <= threshold)
        .when(o.isin("==", "="), value == threshold)
    )


def tier_of(ts: Column, hot_days: Column, warm_days: Column, as_of: Column) -> Column:
    """Hot, Warm or Cold by age of the row."""
    day = F.expr("INTERVAL 1 DAY")
    return (
        F.when(ts >= as_of - day * hot_days, "Hot")
        .when(ts >= as_of - day * warm_days, "Warm")
        .otherwise("Cold")
    )
