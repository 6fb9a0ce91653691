"""Metric aggregation, retention, instruments, health and alerts.

Metrics are rows (name, type, value, labels map, ts, source).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..sources.shared import durable

#: What is aggregated by default: name, window, functions.
DEFAULTS = (("request_rate", "1 minute", ("sum", "avg", "max")), ("error_rate", "5 minutes", ("sum", "avg")), ("latency", "5 minutes", ("p50", "p95", "p99")))

_SIZES = (1024, 4096, 16384, 65536, 262144, 1048576, 4194304, 16777216)
_SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
#: Instruments by name: kind, labels, bucket bounds.
INSTRUMENTS = {
    "service_up": ("gauge", "service instance version", ()),
    "service_info": ("gauge", "service version instance build_time git_commit", ()),
    "request_count_total": ("counter", "service method endpoint status protocol", ()),
    "request_duration_seconds": ("histogram", "service method endpoint protocol", _SECONDS),
    "request_size_bytes": ("histogram", "service method endpoint", _SIZES),
    "response_size_bytes": ("histogram", "service method endpoint", _SIZES),
    "search_count_total": ("counter", "service type cluster", ()),
    "search_duration_seconds": ("histogram", "service type cluster", (0.001, 0.01, 0.1, 1.0, 10.0, 60.0)),
    "search_results_count": ("histogram", "service type cluster", (1, 10, 100, 1000, 10000)),
    "search_errors_total": ("counter", "service type cluster error_type", ()),
    "storage_vectors_total": ("gauge", "service cluster node", ()),
    "storage_segments_total": ("gauge", "service cluster node", ()),
    "storage_size_bytes": ("gauge", "service cluster node", ()),
    "storage_operations_total": ("counter", "service operation cluster node", ()),
    "storage_operation_duration_seconds": ("histogram", "service operation cluster node", (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0)),
    "cluster_nodes_total": ("gauge", "service cluster status", ()),
    "cluster_replicas_total": ("gauge", "service cluster status", ()),
}


def observe(df: DataFrame, name: str) -> DataFrame:
    """The series of one instrument from raw metrics (name, labels, value, ts): sums, last values or buckets by labels."""
    kind, _, bounds = INSTRUMENTS[name]
    rows = df.where(F.col("name") == name).withColumn("label", label_key(F.col("labels")))
    if kind == "histogram":
        return histogram(rows, list(bounds), ["label"])
    return counters(rows, ["label"]) if kind == "counter" else gauges(rows, ["label"])


def summary(df: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.9, 0.99), value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """Quantiles of a sketch, count and sum: for groups too large to rank."""
    return df.groupBy(*by).agg(F.percentile_approx(value, list(quantiles), accuracy).alias("quantiles"), F.count(value).alias("n"), F.sum(value).alias("sum"))


def idle_connections(df: DataFrame, now: Column, timeout_s: float, last: str = "last_active") -> DataFrame:
    return df.where(micros(now) - micros(F.col(last)) >= int(timeout_s * 1e6))


def label_key(labels: Column) -> Column:
    """Labels in the order of their names, as one string."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")


def percentile(values: Column, p: float) -> Column:
    """The value at floor((n - 1) p) of the sorted values, as an aggregate: for groups that are small, like a window of a series."""
    s = F.array_sort(F.collect_list(values))
    return F.get(s, F.floor((F.count(values) - 1) * F.lit(p)).cast("int"))


def function(name: str, value: Column) -> Column:
    if name.startswith("p") and name[1:].isdigit():
        return percentile(value, int(name[1:]) / 100)
    return {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}[name](value)


def exact_percentiles(df: DataFrame, by: list[str], ps: list[float], value: str = "value") -> DataFrame:
    """Percentiles at floor((n - 1) p).  Equal values are counted first, in each task; a group of any
    number of values is then cut in ranges, and its counts are added up range by range."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    sorted_ = counted.repartitionByRange(*by, "__v").withColumn("__p", F.spark_partition_id())
    rows = durable(sorted_)
    inner = Window.partitionBy("__p", *by).orderBy("__v")
    # of each group, the rows in each range, and those in the ranges before it: as many rows as ranges and groups
    parts = rows.groupBy(*by, "__p").agg(F.sum("__c").alias("__s"))
    of = Window.partitionBy(*by).orderBy("__p")
    parts = parts.withColumns({"__before": F.sum("__s").over(of) - F.col("__s"), "__n": F.sum("__s").over(Window.partitionBy(*by))}).drop("__s")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    parts = parts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__p").alias("__q"), "__before", "__n")
    rows = rows.join(parts, [*same, F.col("__p") == F.col("__q")]) if by else rows.join(parts, F.col("__p") == F.col("__q"))
    rows = rows.withColumn("__end", F.col("__before") + F.sum("__c").over(inner))
    at = lambda p: F.floor((F.col("__n") - 1) * F.lit(p))
    return rows.groupBy(*by).agg(*(F.max(F.when((F.col("__end") > at(p)) & (F.col("__end") - F.col("__c") <= at(p)), F.col("__v"))).alias(f"p{round(p * 100)}") for p in ps))


def aggregate(df: DataFrame, by: list[Column], functions: tuple[str, ...] = ("sum", "avg", "max", "min"), value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(*(function(f, F.col(value)).alias(f) for f in functions))


def windowed(df: DataFrame, by: list[str], size: str, slide: str | None = None, functions: tuple[str, ...] = ("sum", "avg", "max"), ts: str = "ts", value: str = "value") -> DataFrame:
    """Tumbling or sliding windows over event time; batch or stream."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    out = df.groupBy(w, *by).agg(*(function(f, F.col(value)).alias(f) for f in functions))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *functions)


def retention(df: DataFrame, now: Column, hours: float = 24, most: int = 10_000, ts: str = "ts", id_: str = "id") -> DataFrame:
    """The newest rows within the time, at most `most`."""
    return df.where(micros(F.col(ts)) >= micros(now) - int(hours * 3_600_000_000)).orderBy(F.desc(ts), F.desc(id_)).limit(most)


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, bounds: list[float], by: list[str], value: str = "value") -> DataFrame:
    """Cumulative bucket counts: rows (by, le, n), le = infinity last."""
    sums = df.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"__{i}") for i, b in enumerate(bounds)), F.count(value).alias("__all"))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"__{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("__all").alias("n")))
    return sums.select(*by, F.explode(cells).alias("c")).select(*by, "c.le", "c.n")


def counters(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("value").alias("value"))


def gauges(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*by).agg(F.max_by("value", ts).alias("value"))


def running(df: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Mean, least and greatest so far; 0 counts as unset for the last two."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    some = F.when(v != 0, v)
    return df.withColumns({"mean": F.avg(v).over(w), "least": F.coalesce(F.min(some).over(w), F.lit(0.0)), "greatest": F.coalesce(F.max(some).over(w), F.lit(0.0))})


@dataclass(frozen=True)
class Alert:
    name: str
    predicate: str
    severity: str = "warning"


def evaluate_alerts(aggregates: DataFrame, alerts: list[Alert], ts: str | None = None) -> DataFrame:
    """name, severity, hits, last: of each alert, in one pass over the aggregates."""
    cells = F.array(*(F.struct(F.lit(a.name).alias("name"), F.lit(a.severity).alias("severity"), F.expr(a.predicate).alias("hit")) for a in alerts))
    rows = aggregates.select(F.explode(cells).alias("a"), *([F.col(ts).alias("__ts")] if ts else []))
    last = [F.max(F.when(F.col("a.hit"), F.col("__ts"))).alias("last")] if ts else []
    return rows.groupBy(F.col("a.name").alias("name"), F.col("a.severity").alias("severity")).agg(F.count_if("a.hit").alias("hits"), *last)


def health_rollup(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """status of checks (status, critical): unhealthy, degraded, healthy or unknown."""
    bad = F.col("status") == "unhealthy"
    status = F.when(F.count_if(bad & F.col("critical")) > 0, "unhealthy").when(F.count_if(bad) > 0, "degraded").when((F.count("*") > 0) & (F.count_if(F.col("status") == "healthy") == F.count("*")), "healthy").otherwise("unknown")
    return (checks.groupBy(*by) if by else checks.groupBy()).agg(status.alias("health"))


def connection_health(last_active: Column, now: Column, timeout_s: float) -> tuple[Column, Column]:
    """Status and score by idle time: under T healthy (1), under 2 T degraded (0.5), else unhealthy (0)."""
    idle = (micros(now) - micros(last_active)) / 1e6
    status = F.when(idle < timeout_s, "healthy").when(idle < 2 * timeout_s, "degraded").otherwise("unhealthy")
    return status, F.when(idle < timeout_s, 1.0).when(idle < 2 * timeout_s, 0.5).otherwise(0.0)


def system_status(checks: DataFrame, alerts: DataFrame) -> DataFrame:
    """healthy_checks, checks, active_alerts."""
    c = checks.agg(F.count_if(F.col("status") == "healthy").alias("healthy_checks"), F.count("*").alias("checks"))
    return c.crossJoin(F.broadcast(alerts.agg(F.count_if(F.col("hits") > 0).alias("active_alerts"))))


def prometheus(df: DataFrame) -> DataFrame:
    """name, labels, value as lines of the text exposition format."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e.key, F.lit('="'), e.value, F.lit('"'))), ",")
    return df.select(F.concat("name", F.when(F.length(labels) > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("value"))
