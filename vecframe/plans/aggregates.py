"""Metrics, health, limiter and backpressure queries, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import stateful as S
from .registry import query, r6, table


def events(spark, sf):
    return table(spark, sf, "events")


@query("agg_window_basic", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, round(sum(value), 4) AS sum, round(avg(value), 6) AS avg, max(value) AS max FROM events GROUP BY ALL")
def basic(spark, sf):
    out = M.windowed(events(spark, sf), ["event_type"], "1 hour")
    return out.select("event_type", "window_start", F.round("sum", 4).alias("sum"), r6(F.col("avg")).alias("avg"), "max")


@query("agg_window_sliding", "WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS window_start FROM events) SELECT event_type, window_start, count(*) AS count, round(sum(value), 4) AS sum FROM w GROUP BY ALL")
def sliding(spark, sf):
    out = M.windowed(events(spark, sf), ["event_type"], "2 hours", "1 hour", ("count", "sum"))
    return out.select("event_type", "window_start", "count", F.round("sum", 4).alias("sum"))


_P = "list_sort(list(value))[CAST(floor((count(value) - 1) * {p}) AS INT) + 1] AS p{n}"


@query("agg_percentiles", f"SELECT event_type, {_P.format(p='0.5::DOUBLE', n=50)}, {_P.format(p='0.95::DOUBLE', n=95)}, {_P.format(p='0.99::DOUBLE', n=99)} FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentiles(spark, sf):
    return M.exact_percentiles(events(spark, sf), ["event_type"], [0.5, 0.95, 0.99])


@query("histogram_buckets", "SELECT event_type, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events, (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (50.0::DOUBLE), ('inf'::DOUBLE)) t(le) GROUP BY event_type, le")
def histogram(spark, sf):
    return M.histogram(events(spark, sf), [1, 5, 10, 50], ["event_type"])


@query("retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR ORDER BY ts DESC, event_id DESC LIMIT 10000")
def retention(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("ts")).first()[0]
    return M.retention(e, F.lit(now), id_="event_id").select("event_id")


@query("count_by_key", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_key(spark, sf):
    return M.counts(events(spark, sf), "event_type")


@query("agg_by_labels", "SELECT 'type=' || event_type || ',user=' || CAST(user_id % 5 AS VARCHAR) AS labels, round(sum(value), 4) AS sum, min(value) AS min FROM events GROUP BY ALL")
def by_labels(spark, sf):
    labels = F.create_map(F.lit("user"), (F.col("user_id") % 5).cast("string"), F.lit("type"), F.col("event_type"))
    out = M.aggregate(events(spark, sf), [M.label_key(labels).alias("labels")], ("sum", "min"))
    return out.select("labels", F.round("sum", 4).alias("sum"), "min")


@query("gauge_last", "SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def gauge(spark, sf):
    return M.gauges(events(spark, sf).withColumn("at", F.struct("ts", "event_id")), ["event_type"], "at")


@query("running_stats", "SELECT event_id, round(avg(value) OVER w, 10) AS mean, coalesce(min(nullif(value, 0)) OVER w, 0) AS least, coalesce(max(nullif(value, 0)) OVER w, 0) AS greatest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running(spark, sf):
    return M.running(events(spark, sf), ["user_id"], ["ts", "event_id"]).select("event_id", F.round("mean", 10).alias("mean"), "least", "greatest")


@query(
    "health_rollup",
    "WITH c AS (SELECT user_id, event_type, CASE WHEN avg(value) > 25 THEN 'unhealthy' ELSE 'healthy' END AS status FROM events GROUP BY ALL) SELECT user_id, CASE WHEN count(*) FILTER (status = 'unhealthy' AND event_type = 'error') > 0 THEN 'unhealthy' WHEN count(*) FILTER (status = 'unhealthy') > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM c GROUP BY user_id",
)
def health(spark, sf):
    c = events(spark, sf).groupBy("user_id", "event_type").agg(F.when(F.avg("value") > 25, "unhealthy").otherwise("healthy").alias("status"))
    return M.health_rollup(c.withColumn("critical", F.col("event_type") == "error"), ["user_id"])


_NOW = "(SELECT max(ts) FROM events)"


@query("connection_health", f"WITH l AS (SELECT user_id, epoch({_NOW} - max(ts)) AS idle FROM events GROUP BY user_id) SELECT user_id, CASE WHEN idle < 3600 THEN 'healthy' WHEN idle < 7200 THEN 'degraded' ELSE 'unhealthy' END AS status, CASE WHEN idle < 3600 THEN 1.0::DOUBLE WHEN idle < 7200 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM l")
def connection(spark, sf):
    e = events(spark, sf)
    now = F.lit(e.agg(F.max("ts")).first()[0])
    status, score = M.connection_health(F.col("last"), now, 3600)
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", status.alias("status"), score.alias("score"))


@query("node_status", f"WITH l AS (SELECT user_id, max(ts) AS last, avg(value) / 50 AS load FROM events GROUP BY user_id) SELECT user_id, CASE WHEN epoch({_NOW} - last) > 3600 THEN 'unhealthy' WHEN load > 0.8 THEN 'degraded' ELSE 'healthy' END AS status FROM l")
def node_status(spark, sf):
    from ..operators.topology import node_status as status

    e = events(spark, sf)
    now = F.lit(e.agg(F.max("ts")).first()[0])
    rows = e.groupBy("user_id").agg(F.max("ts").alias("last"), (F.avg("value") / 50).alias("load"))
    return rows.select("user_id", status(F.col("last"), now, F.col("load"), 3600).alias("status"))


@query("alert_eval", "WITH a AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, avg(value) AS avg, max(value) AS max FROM events GROUP BY ALL) SELECT name, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM (SELECT 'high_mean' AS name, avg > 22 AS hit FROM a UNION ALL SELECT 'spike', max > 100 FROM a) GROUP BY name")
def alerts(spark, sf):
    a = M.windowed(events(spark, sf), [], "1 hour", functions=("avg", "max"))
    return M.evaluate_alerts(a, [M.Alert("high_mean", "avg > 22"), M.Alert("spike", "max > 100", "critical")]).select("name", "hits")


@query("load_trend", "WITH l AS (SELECT event_id, user_id, ts, value / 50 AS load FROM events), w AS (SELECT event_id, load, first_value(load) OVER x AS f, count(*) OVER x AS n FROM l WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT event_id, round(CASE WHEN n > 1 THEN (load - f) / (n - 1) ELSE 0 END, 6) + 0.0 AS trend, round(load + 0.2 * CASE WHEN n > 1 THEN (load - f) / (n - 1) ELSE 0 END, 6) + 0.0 AS predicted FROM w")
def trend(spark, sf):
    rows = S.load_trend(events(spark, sf).withColumn("load", F.col("value") / 50), ["user_id"], ["ts", "event_id"])
    return rows.select("event_id", r6(F.col("trend")).alias("trend"), r6(F.col("predicted")).alias("predicted"))


@query("backpressure_actions", "SELECT event_id, CASE WHEN value >= 47.5 THEN 'reject' WHEN value >= 42.5 THEN 'delay' WHEN value >= 35 THEN 'limit' ELSE 'allow' END AS action, CASE WHEN value < 47.5 AND value >= 42.5 THEN 100 ELSE 0 END AS delay_ms FROM events")
def pressure(spark, sf):
    warning, critical, emergency = S.thresholds(F.lit(0.0), 35.0, 42.5, 47.5, adaptive=False)
    rows = events(spark, sf).withColumn("p", S.backpressure(F.col("value"), warning, critical, emergency))
    return rows.select("event_id", "p.action", "p.delay_ms")


#: A key's events by number, and a recursion over them: {first} and {next} give the columns of the state, `decision` among them.
_FOLD = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value / 50 AS load, CAST(event_type <> 'error' AS INT) AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, n, event_id, t, {first} FROM (SELECT *, {start} FROM e WHERE n = 1)
UNION ALL SELECT user_id, n, event_id, t, {next} FROM (SELECT e.*, {before} FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT event_id, decision FROM s"""
_SEVEN = "CAST(1 AS DOUBLE) / 7200"
_FOLDS = {
    # the bucket of a new key stays full
    "token_bucket": ("3.0::DOUBLE AS tokens, 'allow' AS decision", "1 AS one", "CASE WHEN x >= 1 THEN x - 1 ELSE x END, CASE WHEN x >= 1 THEN 'allow' ELSE 'reject' END", f"least(3.0::DOUBLE, s.tokens + {_SEVEN} * (e.t - s.t)) AS x"),
    "sliding_limiter": ("[t] AS seen, 'allow' AS decision", "1 AS one", "CASE WHEN len(x) < 3 THEN list_append(x, t) ELSE x END, CASE WHEN len(x) < 3 THEN 'allow' ELSE 'reject' END", "list_filter(s.seen, lambda y: y > e.t - 36000) AS x"),
    "fixed_limiter": (
        "t AS start, 1 AS used, 1 AS spare, 'allow' AS decision",
        "1 AS one",
        "b, CASE WHEN u < 3 THEN u + 1 ELSE u END, CASE WHEN u >= 3 AND p > 0 THEN p - 1 ELSE p END, CASE WHEN u < 3 OR p > 0 THEN 'allow' ELSE 'reject' END",
        "CASE WHEN e.t - s.start >= 36000 THEN e.t ELSE s.start END AS b, CASE WHEN e.t - s.start >= 36000 THEN 0 ELSE s.used END AS u, CASE WHEN e.t - s.start >= 36000 THEN 1 ELSE s.spare END AS p",
    ),
    "load_circuit": ("load >= 0.9 AS opened, 'allow' AS decision", "1 AS one", "CASE WHEN o THEN load > 0.5 ELSE load >= 0.9 END, CASE WHEN o AND load > 0.5 THEN 'reject' ELSE 'allow' END", "s.opened AS o"),
    "circuit_breaker": (
        # two failures open it, and two successes after 7200 s close it
        "'closed' AS kind, 1 - ok AS used, t AS since, 'closed' AS decision",
        "1 AS one",
        """CASE WHEN k = 'open' THEN 'open' WHEN ok = 1 THEN CASE WHEN k = 'half' AND c + 1 < 2 THEN 'half' ELSE 'closed' END WHEN k = 'half' OR c + 1 >= 2 THEN 'open' ELSE 'closed' END,
        CASE WHEN k = 'open' THEN c WHEN ok = 1 THEN CASE WHEN k = 'half' AND c + 1 < 2 THEN c + 1 ELSE 0 END WHEN k = 'half' OR c + 1 >= 2 THEN 0 ELSE c + 1 END,
        CASE WHEN k = 'open' THEN z WHEN ok = 1 THEN CASE WHEN k = 'half' AND c + 1 >= 2 THEN t ELSE z END WHEN k = 'half' OR c + 1 >= 2 THEN t ELSE z END,
        CASE WHEN k = 'open' THEN 'reject' WHEN ok = 1 THEN CASE WHEN k = 'half' AND c + 1 < 2 THEN 'half_open' ELSE 'closed' END WHEN k = 'half' OR c + 1 >= 2 THEN 'open' ELSE 'closed' END""",
        "CASE WHEN s.kind = 'open' AND e.t - s.since >= 7200 THEN 'half' ELSE s.kind END AS k, CASE WHEN s.kind = 'open' AND e.t - s.since >= 7200 THEN 0 ELSE s.used END AS c, s.since AS z",
    ),
    "consecutive_health": (
        "ok AS up, 1 - ok AS down, 'healthy' AS decision",
        "1 AS one",
        "u, d, CASE WHEN d >= 3 THEN 'unhealthy' WHEN u >= 2 THEN 'healthy' ELSE was END",
        "CASE WHEN e.ok = 1 THEN s.up + 1 ELSE 0 END AS u, CASE WHEN e.ok = 1 THEN 0 ELSE s.down + 1 END AS d, s.decision AS was",
    ),
}


def _machine(name, machine, value=None):
    first, start, after, before = _FOLDS[name]

    @query(name, _FOLD.format(first=first, start=start, next=after, before=before))
    def run(spark, sf):
        e = events(spark, sf).select("event_id", "user_id", "ts", (F.col("value") / 50).alias("load"), (F.col("event_type") != "error").cast("double").alias("ok"))
        return S.fold(e, machine, "user_id", "ts", ("event_id",), value).select("event_id", "decision")


_machine("token_bucket", S.TokenBucket(1 / 7200, 3))
_machine("sliding_limiter", S.SlidingWindow(3, 36_000))
_machine("fixed_limiter", S.FixedWindow(3, 36_000, 1))
_machine("load_circuit", S.LoadCircuit(0.9, 0.5), "load")
_machine("circuit_breaker", S.CircuitBreaker(2, 2, 7200), "ok")
_machine("consecutive_health", S.ConsecutiveHealth(), "ok")


_TREND = "CASE WHEN n > 1 THEN (load - f) / (n - 1) ELSE 0 END"


@query(
    "backpressure_adaptive",
    f"WITH l AS (SELECT event_id, user_id, ts, value / 50 AS load FROM events), w AS (SELECT event_id, load, first_value(load) OVER x AS f, count(*) OVER x AS n FROM l WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), t AS (SELECT event_id, load + 0.2 * {_TREND} AS p, greatest(0.1, least(0.9, 0.7 - 0.1 * {_TREND})) AS w, greatest(0.1, least(0.9, 0.85 - 0.1 * {_TREND})) AS c FROM w) SELECT event_id, round(w, 9) AS warning, round(c, 9) AS critical, CASE WHEN p >= 0.95 THEN 'reject' WHEN p >= c THEN 'delay' WHEN p >= w THEN 'limit' ELSE 'allow' END AS action FROM t",
)
def adaptive_pressure(spark, sf):
    """The trend moves the thresholds, and the predicted load is held against them."""
    rows = S.load_trend(events(spark, sf).withColumn("load", F.col("value") / 50), ["user_id"], ["ts", "event_id"])
    warning, critical, emergency = S.thresholds(F.col("trend"))
    rows = rows.withColumns({"warning": warning, "critical": critical}).withColumn("p", S.backpressure(F.col("predicted"), F.col("warning"), F.col("critical"), emergency))
    return rows.select("event_id", F.round("warning", 9).alias("warning"), F.round("critical", 9).alias("critical"), "p.action")


@query("instrument_series", "SELECT 'cluster=' || event_type || ',service=' || CAST(user_id % 3 AS VARCHAR) AS label, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events, (VALUES (1.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE), (1000.0::DOUBLE), (10000.0::DOUBLE), ('inf'::DOUBLE)) t(le) GROUP BY ALL")
def instrument(spark, sf):
    labels = F.create_map(F.lit("service"), (F.col("user_id") % 3).cast("string"), F.lit("cluster"), F.col("event_type"))
    raw = events(spark, sf).select(F.lit("search_results_count").alias("name"), labels.alias("labels"), "value", "ts")
    return M.observe(raw, "search_results_count")


@query("idle_connections", f"SELECT user_id FROM events GROUP BY user_id HAVING epoch({_NOW} - max(ts)) >= 3600")
def idle(spark, sf):
    e = events(spark, sf)
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return M.idle_connections(e.groupBy("user_id").agg(F.max("ts").alias("last_active")), now, 3600).select("user_id")
