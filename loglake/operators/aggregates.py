"""Aggregations over the `logs` view.

Counts, sums, averages, extremes and approximate percentiles are all combined on the map side, so a hot
service or tenant reaches the shuffle as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.columns import ts_lit, trunc_time, window_start
from loglake.operators.filters import errors_only, last, time_range
from loglake.operators.search import search_predicate
from loglake.session import ensure_checkpoint_dir

# Relative rank error of the approximate percentiles is 1 / ACCURACY.
ACCURACY = 10_000
QUANTILES = (0.50, 0.95, 0.99)

# Upper bounds in milliseconds of the latency histogram.
LATENCY_BUCKETS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0]


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


# -- standard views ------------------------------------------------------------


def error_rate_per_minute(logs: DataFrame, as_of, look_back: str = "2 MINUTES", by: tuple[str, ...] = ()) -> DataFrame:
    rows = last(logs, look_back, as_of).filter((F.col("log_type") == "Error") & F.col("level").isin("Error", "Fatal"))
    return rows.groupBy(
        *by, trunc_time(rows, "minute").alias("minute_bucket"), F.col("source_id").alias("service")
    ).agg(_count("error_count"))


def latency_percentiles(
    logs: DataFrame, as_of, look_back: str = "10 MINUTES", by: tuple[str, ...] = (), accuracy: int = ACCURACY
) -> DataFrame:
    rows = last(logs, look_back, as_of).filter(
        (F.col("log_type") == "Metric") & (F.col("category") == "http-latency")
    )
    grouped = rows.groupBy(
        *by, window_start("timestamp", "5 minutes").alias("bucket"), F.col("source_id").alias("service")
    ).agg(F.percentile_approx("metric_value", list(QUANTILES), accuracy).alias("q"))
    names = ["p50_ms", "p95_ms", "p99_ms"]
    return grouped.select(*by, "bucket", "service", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def log_volume_by_type(logs: DataFrame, as_of, look_back: str = "2 MINUTES", by: tuple[str, ...] = ()) -> DataFrame:
    rows = last(logs, look_back, as_of)
    return rows.groupBy(
        *by, trunc_time(rows, "minute").alias("minute_bucket"), F.col("log_type").alias("logtype")
    ).agg(_count("entry_count"))


def http_status_per_hour(logs: DataFrame, as_of, look_back: str = "7 DAYS", tag: str = "http_status") -> DataFrame:
    rows = last(logs, look_back, as_of).filter(
        (F.col("log_type") == "Metric") & (F.col("category") == "http-request")
    )
    return rows.groupBy(
        trunc_time(rows, "hour").alias("hour_bucket"),
        F.try_element_at("tags", F.lit(tag)).alias("status_code"),
    ).agg(_count("request_count"))


# -- chart templates -----------------------------------------------------------


def _sorted(df: DataFrame, *by: str, limit: int | None) -> DataFrame:
    """In chart order; cut only if the caller says where."""
    rows = df.orderBy(*by)
    return rows if limit is None else rows.limit(limit)


def error_heatmap(logs: DataFrame, t_from, t_to, limit: int | None = None) -> DataFrame:
    rows = errors_only(time_range(logs, t_from, t_to))
    cells = rows.groupBy("hour_of_day", "day_of_week").agg(_count("error_count"))
    return _sorted(cells, "hour_of_day", "day_of_week", limit=limit)


def latency_p99_trend(
    logs: DataFrame, t_from, t_to, width: str = "1 hour", limit: int | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """`timestamp` is the start of a bucket of `width`, here and in the charts below."""
    rows = time_range(logs, t_from, t_to).filter(F.col("duration_ms").isNotNull())
    cells = rows.groupBy(window_start("timestamp", width).alias("timestamp"), "service").agg(
        F.percentile_approx("duration_ms", 0.99, accuracy).alias("p99_ms")
    )
    return _sorted(cells, "timestamp", "service", limit=limit)


def error_gauge(logs: DataFrame, t_from, t_to) -> DataFrame:
    return errors_only(time_range(logs, t_from, t_to)).agg(_count("error_count"))


def top_errors(logs: DataFrame, t_from, t_to, k: int = 10) -> DataFrame:
    return top_k_by_count(errors_only(time_range(logs, t_from, t_to)), "message", k, "error_count")


def status_distribution(logs: DataFrame, t_from, t_to, limit: int | None = None) -> DataFrame:
    rows = time_range(logs, t_from, t_to).filter(F.col("status_code").isNotNull())
    return _sorted(rows.groupBy("status_code").agg(_count("count")), "status_code", limit=limit)


def service_error_scatter(logs: DataFrame, t_from, t_to, limit: int | None = None) -> DataFrame:
    rows = errors_only(time_range(logs, t_from, t_to)).filter(F.col("duration_ms").isNotNull())
    points = rows.groupBy("service").agg(_count("error_count"), F.avg("duration_ms").alias("avg_latency_ms"))
    return _sorted(points, "service", limit=limit)


def volume_stacked(logs: DataFrame, t_from, t_to, width: str = "1 hour", limit: int | None = None) -> DataFrame:
    rows = time_range(logs, t_from, t_to)
    cells = rows.groupBy(window_start("timestamp", width).alias("timestamp"), "log_type").agg(_count("count"))
    return _sorted(cells, "timestamp", "log_type", limit=limit)


def alert_timeline(
    logs: DataFrame, t_from, t_to, category: str = "alert", width: str = "1 hour", limit: int | None = None
) -> DataFrame:
    rows = time_range(logs, t_from, t_to).filter(F.col("category") == category)
    points = rows.groupBy(window_start("timestamp", width).alias("timestamp")).agg(_count("alert_count"))
    return _sorted(points, "timestamp", limit=limit)


# -- search aggregations -------------------------------------------------------

_AGG_COLUMNS = {"category": "category", "level": "level", "logtype": "log_type", "environment": "environment"}


def _aggregated_field(field: str) -> Column:
    column = _AGG_COLUMNS.get(field.lower())
    return F.col(column) if column else F.try_element_at("tags", F.lit(field))


def terms_agg(
    df: DataFrame, field: str, query: str | None = None, size: int = 100, t_from=None, t_to=None
) -> DataFrame:
    """Most frequent values of a column or tag; rows without the tag are not counted."""
    rows = time_range(df, t_from, t_to, closed=True).filter(search_predicate(query))
    return (
        rows.groupBy(_aggregated_field(field).alias("key"))
        .agg(_count("count"))
        .filter(F.col("key").isNotNull())
        .orderBy(F.col("count").desc(), "key")
        .limit(size)
    )


def date_histogram(df: DataFrame, unit: str = "hour") -> DataFrame:
    return df.groupBy(trunc_time(df, unit).alias("bucket")).agg(_count("count"))


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(_count("count"))


def top_k_by_count(df: DataFrame, col: str, k: int, name: str = "count") -> DataFrame:
    """Ties go to the smaller value, so the result does not depend on the partitioning."""
    return df.groupBy(col).agg(_count(name)).orderBy(F.col(name).desc(), col).limit(k)


def slowest(df: DataFrame, k: int = 10, by: str = "endpoint", value: str = "duration_ms") -> DataFrame:
    return df.groupBy(by).agg(F.max(value).alias("max_ms")).orderBy(F.col("max_ms").desc(), by).limit(k)


def average_latency(df: DataFrame, by: str = "endpoint", value: str = "duration_ms") -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("avg_ms"), _count("requests"))


def daily_errors(logs: DataFrame, as_of, look_back: str = "7 DAYS") -> DataFrame:
    rows = errors_only(last(logs, look_back, as_of))
    return rows.groupBy(trunc_time(rows, "day").alias("day")).agg(_count("error_count")).orderBy("day")


def weekly_percentile(
    logs: DataFrame, service: str, as_of, q: float = 0.99, accuracy: int = ACCURACY
) -> DataFrame:
    """One service's approximate percentile since the start of the week of `as_of`."""
    week = F.date_trunc("week", ts_lit(logs, as_of)).cast(logs.schema["timestamp"].dataType)
    rows = logs.filter((F.col("source_id") == service) & (F.col("timestamp") >= week))
    return rows.agg(F.percentile_approx("duration_ms", q, accuracy).alias("p_ms"), _count("entries"))


def ordered_bits(value: Column) -> Column:
    """A double as a whole number of the same order: its exponent and mantissa, as the number's bits hold them.

    NaN comes last, as Spark sorts it; both zeros are 0.
    """
    size = F.abs(value)
    rough = F.floor(F.log2(size))
    exponent = rough - (F.pow(F.lit(2.0), rough) > size).cast("int") + (F.pow(F.lit(2.0), rough + 1) <= size).cast("int")
    mantissa = (size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)
    bits = (
        F.when(size < 2.0**-1022, (size * 2.0**537 * 2.0**537).cast("long"))
        .when(size == float("inf"), F.lit(2047 << 52))
        .otherwise((exponent + 1023) * (1 << 52) + mantissa.cast("long"))
    )
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -bits).otherwise(bits)


DIGIT = 4096


def exact_percentile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """Interpolated percentile without holding a group's values in one place: selection by digits.

    Values become whole numbers of the same order (`ordered_bits`). Every round divides the range that holds a wanted
    rank in 4096 parts, counts the rows of each part, and goes on with the part of the rank, cut to its own smallest
    and largest value, until these are equal. A round leaves one in 4096 of the range, so six rounds do for any
    doubles; it is one aggregation combined before the shuffle, whatever a group's size.
    """
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("all"))
    kind = df.schema[value].dataType.typeName()
    number = F.col(value).cast("long") if kind in ("byte", "short", "integer", "long") else ordered_bits(F.col(value).cast("double"))
    rows = df.filter(F.col(value).isNotNull()).select(group.alias("g"), number.alias("k"), F.col(value).cast("double").alias("v"))
    ensure_checkpoint_dir(df.sparkSession)
    position = (F.col("n") - 1) * F.lit(q)
    state = (
        rows.groupBy("g")
        .agg(_count("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.min("v").alias("v"))
        .withColumn("rank", F.explode(F.array(F.floor(position), F.ceil(position))))
        .select("g", "n", F.col("rank").alias("wanted"), "rank", "low", "high", "v")
        .distinct()
        .checkpoint()
    )
    while not state.where("low < high").isEmpty():
        ranges = state.where("low < high").select("g", "low", "high").distinct()
        # Only rows in an open range are looked at again.
        rows = rows.join(ranges, "g").where(F.col("k").between(F.col("low"), F.col("high"))).checkpoint()
        # Halves, so that no difference overflows; ranges of a few thousand numbers are divided into single ones.
        width = F.shiftright("high", 1) - F.shiftright("low", 1)
        part = F.when(width < DIGIT // 2, F.col("k") - F.col("low")).otherwise(
            F.floor((F.shiftright("k", 1) - F.shiftright("low", 1)) / (F.floor(width / DIGIT) + 1))
        )
        counted = rows.groupBy("g", "low", "high", part.alias("part")).agg(
            _count("c"), F.min("k").alias("first"), F.max("k").alias("last"), F.min("v").alias("least")
        )
        before = Window.partitionBy("g", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = counted.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))
        chosen = (
            state.where("low < high")
            .join(parts, ["g", "low", "high"])
            .where("rank >= below AND rank < below + c")
            .select("g", "n", "wanted", (F.col("rank") - F.col("below")).alias("rank"), F.col("first").alias("low"), F.col("last").alias("high"), F.col("least").alias("v"))
        )
        state = state.where("low = high").unionByName(chosen).checkpoint()
        rows = rows.select("g", "k", "v")
    pair = state.groupBy("g", "n").agg(F.min_by("v", "wanted").alias("a"), F.max_by("v", "wanted").alias("b"))
    share = position - F.floor(position)
    mixed = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * share)
    return pair.select(*(F.col("g")[c].alias(c) for c in by), mixed.alias("percentile"))


# -- operational metrics -------------------------------------------------------


def ingestion_rate(df: DataFrame, width: str = "5 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Entries per second in each window."""
    start = F.window("timestamp", width)
    grouped = df.groupBy(*by, start.alias("w")).agg(_count("entries"))
    seconds = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end"))
    return grouped.select(*by, F.col("w.start").alias("bucket"), "entries", (F.col("entries") / seconds).alias("per_second"))


def error_ratio(df: DataFrame, width: str = "5 minutes") -> DataFrame:
    grouped = df.groupBy(window_start("timestamp", width).alias("bucket")).agg(
        _count("entries"), F.count_if(F.lower("level").isin("error", "fatal")).alias("errors")
    )
    return grouped.withColumn("error_ratio", F.col("errors") / F.col("entries"))


def histogram_quantile(
    df: DataFrame, value: str, q: float, by: list[str], bounds: list[float] | None = None
) -> DataFrame:
    """Quantile estimated from cumulative buckets with linear interpolation inside the bucket.

    One aggregation with a conditional count per bound; a rank beyond the last bound gives that bound.
    """
    bounds = bounds or LATENCY_BUCKETS
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        _count("total"),
        F.array(*[F.count_if(F.col(value) <= b) for b in bounds]).alias("cum"),
    )
    rank = F.lit(q) * F.col("total")
    estimate = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = 0.0 if i == 0 else bounds[i - 1]
        below = F.lit(0) if i == 0 else F.col("cum")[i - 1]
        inside = F.col("cum")[i] - below
        part = F.lit(low) + F.lit(bounds[i] - low) * (rank - below) / F.nullif(inside, F.lit(0))
        estimate = F.when(F.col("cum")[i] >= rank, part).otherwise(estimate)
    return counts.select(*by, "total", estimate.alias("estimate"))


def query_cost_by_tenant(query_log: DataFrame, alarm: float = 100.0) -> DataFrame:
    """Cost per tenant and day, with the alarm flag."""
    day = trunc_time(query_log, "day", "submitted_at").alias("day")
    daily = query_log.groupBy("tenant_id", day).agg(F.sum("cost_usd").alias("cost_usd"), _count("queries"))
    return daily.withColumn("over_budget", F.col("cost_usd") > alarm)


def stage_metrics(audit: DataFrame, dims: list[str], duration: str, accuracy: int = ACCURACY) -> DataFrame:
    """Counters and duration percentiles of a processing stage, by any dimensions."""
    grouped = audit.groupBy(*dims).agg(
        _count("events"),
        F.sum(duration).alias("duration_total_ms"),
        F.percentile_approx(duration, [0.5, 0.99], accuracy).alias("q"),
    )
    return grouped.select(*dims, "events", "duration_total_ms", F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p99_ms"))


def metric_rollup(logs: DataFrame, width: str = "1 hour", accuracy: int = ACCURACY) -> DataFrame:
    """Counters are summed, gauges keep their last and mean value, distributions their percentiles."""
    kind, value = F.col("metric.metric_type"), F.col("metric.value")
    grouped = logs.filter(F.col("metric").isNotNull()).groupBy(
        window_start("timestamp", width).alias("bucket"),
        F.col("metric.metric_name").alias("metric_name"),
        kind.alias("metric_type"),
    ).agg(
        _count("samples"),
        F.sum(value).alias("s"),
        F.max_by(value, F.struct("timestamp", "id")).alias("last"),
        F.avg(value).alias("mean"),
        F.percentile_approx(value, [0.5, 0.99], accuracy).alias("q"),
    )
    counter = F.col("metric_type") == "Counter"
    gauge = F.col("metric_type") == "Gauge"
    dist = F.col("metric_type").isin("Histogram", "Summary")
    return grouped.select(
        "bucket",
        "metric_name",
        "metric_type",
        "samples",
        F.when(counter, F.col("s")).alias("total"),
        F.when(gauge, F.col("last")).alias("last_value"),
        F.when(gauge, F.col("mean")).alias("mean_value"),
        F.when(dist, F.col("q")[0]).alias("p50"),
        F.when(dist, F.col("q")[1]).alias("p99"),
    )
