"""Row filters. All are plain predicates, so Catalyst pushes them to the scan."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake import schema
from loglake.functions.columns import interval, is_blank, ts_lit

_CANONICAL = {"level": schema.LEVELS, "log_type": schema.LOG_TYPES}


def tenant_scope(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(F.col("tenant_id") == F.lit(tenant))


def check_tenant_id(col: Column) -> Column:
    """`empty`, `unsafe` or NULL when the tenant id may be used."""
    unsafe = [F.contains(col, F.lit(c)) for c in ("'", '"', ";", "\\", "--")]
    return F.when(is_blank(col), "empty").when(reduce(or_, unsafe), "unsafe")


def time_range(
    df: DataFrame,
    t_from: dt.datetime | str | None = None,
    t_to: dt.datetime | str | None = None,
    closed: bool = False,
    col: str = "timestamp",
) -> DataFrame:
    """``[t_from, t_to)``, or ``[t_from, t_to]`` with `closed` as the search functions use it."""
    if t_from is not None:
        df = df.filter(F.col(col) >= ts_lit(df, t_from, col))
    if t_to is not None:
        bound = ts_lit(df, t_to, col)
        df = df.filter(F.col(col) <= bound if closed else F.col(col) < bound)
    return df


def last(df: DataFrame, width: str, as_of: dt.datetime | str, col: str = "timestamp") -> DataFrame:
    """Rows of the `width` (such as ``2 MINUTES``) before `as_of`."""
    return df.filter(F.col(col) >= ts_lit(df, as_of, col) - interval(width))


def day_filter(df: DataFrame, year: str, month: str, day: str, hour: str | None = None) -> DataFrame:
    """Equality on the partition strings."""
    pred = (F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day)
    if hour is not None:
        pred &= F.col("hour") == hour
    return df.filter(pred)


def day_between(df: DataFrame, year: str, month: str, day_from: str, day_to: str) -> DataFrame:
    return df.filter(
        (F.col("year") == year) & (F.col("month") == month) & F.col("day").between(day_from, day_to)
    )


def partition_range(df: DataFrame, t_from: dt.datetime | None, t_to: dt.datetime | None) -> DataFrame:
    """Partition predicates implied by ``[t_from, t_to)``.

    Spark does not infer them from a filter on `timestamp`; stated on the partition columns alone
    they prune directories before any file is listed for reading.
    """
    key = F.concat("year", "month", "day", "hour")
    if t_from is not None:
        df = df.filter((F.col("year") >= f"{t_from:%Y}") & (key >= f"{t_from:%Y%m%d%H}"))
    if t_to is not None:
        df = df.filter((F.col("year") <= f"{t_to:%Y}") & (key <= f"{t_to:%Y%m%d%H}"))
    return df


def name_in(df: DataFrame, col: str, *names: str) -> DataFrame:
    """Enum or keyword equality / IN, ignoring case.

    Levels and types are canonical in the `logs` view, so the given names are made canonical instead of
    the column, and the predicate reaches the scan.
    """
    if col in _CANONICAL:
        spelling = {v.lower(): v for v in _CANONICAL[col]}
        return df.filter(F.col(col).isin([spelling.get(n.lower(), n) for n in names]))
    return df.filter(F.lower(F.col(col)).isin([n.lower() for n in names]))


def errors_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("level") == "Error")


def min_severity(df: DataFrame, level: str) -> DataFrame:
    """Entries at `level` or above."""
    names = [v.lower() for v in schema.LEVELS]
    if level.lower() not in names:
        raise ValueError(f"unknown level {level!r}")
    return df.filter(F.col("level").isin(schema.LEVELS[names.index(level.lower()) :]))


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def contains(df: DataFrame, text: str, col: str = "message") -> DataFrame:
    return df.filter(F.col(col).contains(text))


def trace_lookup(df: DataFrame, trace_id: str) -> DataFrame:
    return df.filter(F.col("trace_id") == trace_id)


def has_tag(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.map_contains_key("tags", key))


def tag_eq(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.try_element_at("tags", F.lit(key)) == value)


def result_limit(requested: int | None, default: int = 50) -> int:
    """Row limit of a search result: what is asked for, or a default."""
    return default if requested is None else requested
