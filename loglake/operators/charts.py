"""Result shaping for charts, and which chart suits a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglake.operators.joins import densify

_TIME_WORDS = ("time", "date", "bucket")


def pick_roles(schema: T.StructType) -> dict[str, str | list[str] | None]:
    """First time column, first categorical column and all numeric columns of a result."""
    numeric = [f.name for f in schema if isinstance(f.dataType, T.NumericType)]
    stamped = [f.name for f in schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    time = next((f.name for f in schema if f.name in stamped or any(w in f.name.lower() for w in _TIME_WORDS)), None)
    category = next((f.name for f in schema if f.name not in numeric and f.name not in stamped), None)
    return {"time": time, "category": category, "numeric": numeric}


def describe_columns(df: DataFrame, result_id: str, row_count: int) -> DataFrame:
    """Column descriptors of one result, as `suggest_charts` takes them."""
    roles = pick_roles(df.schema)
    rows = [
        (
            result_id,
            row_count,
            i,
            f.name,
            f.name in roles["numeric"],
            isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)),
            isinstance(f.dataType, T.StringType),
        )
        for i, f in enumerate(df.schema)
    ]
    names = "result_id string, row_count long, position int, name string, is_numeric boolean, is_timestamp boolean, is_categorical boolean"
    return df.sparkSession.createDataFrame(rows, names)


def suggest_charts(columns: DataFrame) -> DataFrame:
    """(result_id, chart, confidence, reason, rank), for any number of results at once.

    Input: one row per result column. The flags of a result are partial aggregates.
    """
    name = F.lower("name")
    any_of = F.bool_or
    flags = columns.groupBy("result_id").agg(
        F.max("row_count").alias("row_count"),
        any_of(F.col("is_timestamp") | name.rlike("|".join(_TIME_WORDS))).alias("has_time"),
        any_of(name.isin("count", "error_count", "occurrences")).alias("has_count"),
        any_of("is_categorical").alias("has_cat"),
        (F.count_if(F.col("is_numeric")) == 1).alias("one_number"),
        (any_of(name == "hour_of_day") & any_of(name == "day_of_week")).alias("hour_day"),
        (
            (any_of(name == "duration_ms") & any_of(name == "request_bytes"))
            | (any_of(name == "p99_ms") & any_of(name == "error_count"))
        ).alias("correlated"),
    )
    c = F.col
    # Chart kinds with their confidence.
    rules = [
        (c("has_time") & c("has_count"), "AreaChart", 0.95, "count over time"),
        ((c("row_count") == 1) & c("one_number"), "Gauge", 0.92, "single value"),
        (c("has_time") & ~c("has_count"), "LineChart", 0.90, "trend over time"),
        (c("hour_day") & c("has_count"), "HeatMap", 0.88, "density by hour and weekday"),
        (c("has_cat") & c("has_count") & ~c("has_time"), "BarChart", 0.80, "counts by category"),
        (c("correlated"), "Scatter", 0.75, "two related measures"),
        (c("has_time") & c("has_cat"), "StackedAreaChart", 0.70, "categories over time"),
    ]
    options = F.array(
        *[
            F.when(
                cond,
                F.struct(F.lit(chart).alias("chart"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason")),
            )
            for cond, chart, conf, why in rules
        ]
    )
    ranked = flags.select("result_id", F.posexplode(F.filter(options, lambda o: o.isNotNull())).alias("pos", "o"))
    return ranked.select("result_id", "o.chart", "o.confidence", "o.reason", (F.col("pos") + 1).alias("rank"))


def chart_choice(suggestions: DataFrame) -> DataFrame:
    """The first suggestion of each result, and the first three as alternatives."""
    top = suggestions.filter("rank <= 3").groupBy("result_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "chart"))).alias("s")
    )
    return top.select("result_id", F.col("s")[0]["chart"].alias("chart"), F.array_join("s.chart", ",").alias("alternatives"))


def _number(col: Column) -> Column:
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def series_long(df: DataFrame, label: str | None = None, numeric: list[str] | None = None) -> DataFrame:
    """(label, series, value) for line, bar, area and pie charts."""
    roles = pick_roles(df.schema)
    label = label or roles["time"] or roles["category"]
    numeric = numeric or roles["numeric"]
    wide = df.select(F.col(label).cast("string").alias("label"), *[_number(F.col(n)).alias(n) for n in numeric])
    return wide.unpivot("label", numeric, "series", "value")


def matrix(df: DataFrame) -> DataFrame:
    """(x, y, v): the first two columns and the first number."""
    x, y = df.columns[:2]
    v = next(iter(pick_roles(df.schema)["numeric"]), x)
    return df.select(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y"), _number(F.col(v)).alias("v"))


def scatter_points(df: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    x, y = (numeric or pick_roles(df.schema)["numeric"])[:2]
    return df.select(_number(F.col(x)).alias("x"), _number(F.col(y)).alias("y"))


def stacked_series(df: DataFrame, time: str, category: str, value: str, order: list[str]) -> DataFrame:
    """Every label for every category; the first row by `order` wins, no row means 0."""
    cells = df.groupBy(
        F.col(time).alias("label"), F.coalesce(F.col(category), F.lit("unknown")).alias("series")
    ).agg(_number(F.min_by(value, F.struct(*order))).alias("value"))
    return densify(cells, "label", "series", "value")


def stat_value(df: DataFrame, col: str | None = None) -> DataFrame:
    """Sum of the first number, or the row count when there is none."""
    col = col or next(iter(pick_roles(df.schema)["numeric"]), None)
    if col is None:
        return df.agg(F.lit("count").alias("label"), F.count(F.lit(1)).cast("double").alias("value"))
    return df.agg(F.lit(col).alias("label"), F.coalesce(F.sum(_number(F.col(col))), F.lit(0.0)).alias("value"))


def gauge_value(df: DataFrame, col: str | None = None) -> DataFrame:
    """The stat with a dial maximum of twice its value (1 when it is not positive) and the remainder."""
    top = F.when(F.col("value") <= 0, F.lit(1.0)).otherwise(F.col("value") * 2)
    return stat_value(df, col).withColumn("max_value", top).withColumn("remaining", F.col("max_value") - F.col("value"))
