"""Limiters, breakers and backpressure.

A decision of these machines depends on earlier decisions, so each is a pure
step (state, event) -> (state, decision) in Python.  A batch folds it over a key's
events in order, streaming through Arrow batches that are sorted by key, so
no key has to fit in memory; streaming/jobs.py runs the same steps on streams.
Where the state follows from the last event that set it (load circuit, consecutive health), a
batch reads it by a window instead.  What needs no decisions (load trend, thresholds) is windows and CASE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import micros
from .ranges import ranked_by_range


@dataclass(frozen=True)
class TokenBucket:
    """A new key is let through and its bucket stays full; then rate a second, at most burst, one token each."""

    rate: float
    burst: float

    def step(self, state: tuple | None, t: float, value: float) -> tuple[tuple, str]:
        if state is None:
            return (self.burst, t), "allow"
        tokens = min(self.burst, state[0] + self.rate * (t - state[1]))
        return ((tokens - 1, t), "allow") if tokens >= 1 else ((tokens, t), "reject")


@dataclass(frozen=True)
class SlidingWindow:
    """Allowed if fewer than limit were allowed in (t - seconds, t]."""

    limit: int
    seconds: float

    def step(self, state: tuple | None, t: float, value: float) -> tuple[tuple, str]:
        recent = tuple(x for x in state or () if x > t - self.seconds)
        return ((*recent, t), "allow") if len(recent) < self.limit else (recent, "reject")


@dataclass(frozen=True)
class FixedWindow:
    """limit a window from the first event on, then burst tokens, which refill with the window."""

    limit: int
    seconds: float
    burst: int = 0

    def step(self, state: tuple | None, t: float, value: float) -> tuple[tuple, str]:
        start, count, spare = state or (t, 0, self.burst)
        if t - start >= self.seconds:
            start, count, spare = t, 0, self.burst
        if count < self.limit:
            return (start, count + 1, spare), "allow"
        return ((start, count, spare - 1), "allow") if spare > 0 else ((start, count, spare), "reject")


@dataclass(frozen=True)
class LoadCircuit:
    """Opens at `trip`, closes at `recover`; the call that opens it still passes."""

    trip: float = 0.9
    recover: float = 0.5

    def __post_init__(self):
        if not self.recover < self.trip:
            raise ValueError("a circuit recovers below the load that trips it")

    def step(self, state: tuple | None, t: float, value: float) -> tuple[tuple, str]:
        opened = bool(state and state[0])
        if opened:
            return ((False,), "allow") if value <= self.recover else ((True,), "reject")
        return (value >= self.trip,), "allow"

    def by_window(self, df: DataFrame, load: Column, w: WindowSpec) -> DataFrame:
        """The decisions of all rows; loads at `trip` or over open it, those at `recover` or under close it,
        others (unknown ones too) leave it as it is."""
        known = F.when(~F.isnan(load), load)
        change = F.when(known >= self.trip, True).when(known <= self.recover, False)
        opened = F.coalesce(F.last(change, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        return df.withColumn("decision", F.when(opened & ~F.coalesce(known <= self.recover, F.lit(False)), "reject").otherwise("allow"))


@dataclass(frozen=True)
class CircuitBreaker:
    """value 1: success, 0: failure.  Decisions name the state after the event; refused ones don't count."""

    failures: int = 5
    successes: int = 2
    timeout: float = 30.0

    def step(self, state: tuple | None, t: float, value: float) -> tuple[tuple, str]:
        kind, count, since = state or ("closed", 0, t)
        if kind == "open":
            if t - since < self.timeout:
                return (kind, count, since), "reject"
            kind, count = "half_open", 0
        if value:
            if kind == "half_open":
                count += 1
                return (("closed", 0, t), "closed") if count >= self.successes else ((kind, count, since), "half_open")
            return ("closed", 0, since), "closed"
        if kind == "half_open":
            return ("open", 0, t), "open"
        return (("open", 0, t), "open") if count + 1 >= self.failures else (("closed", count + 1, since), "closed")


@dataclass(frozen=True)
class ConsecutiveHealth:
    """Unhealthy after `bad` bad events running, healthy again after `good` good ones."""

    bad: int = 3
    good: int = 2

    def step(self, state: tuple | None, t: float, value: float) -> tuple[tuple, str]:
        kind, up, down = state or ("healthy", 0, 0)
        up, down = (up + 1, 0) if value else (0, down + 1)
        kind = "unhealthy" if down >= self.bad else "healthy" if up >= self.good else kind
        return (kind, up, down), kind

    def by_window(self, df: DataFrame, value: Column, w: WindowSpec) -> DataFrame:
        """The decisions of all rows: the last `bad` or `good` rows alike set the state, which lasts until the next such row."""
        fine = F.coalesce(value != 0, F.lit(False))
        alike = lambda which, n: F.sum(which.cast("int")).over(w.rowsBetween(1 - n, 0)) >= n
        rows = df.withColumn("__set", F.when(alike(~fine, self.bad), "unhealthy").when(alike(fine, self.good), "healthy"))
        kept = F.last("__set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("decision", F.coalesce(kept, F.lit("healthy"))).drop("__set")


def fold(df: DataFrame, machine: Any, key: str, ts: str, order: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """All columns of df and `decision`: the machine over each key's rows by time."""
    rows = df.withColumns({"__t": micros(F.col(ts)) / 1e6, "__v": F.col(value).cast("double") if value else F.lit(0.0), "__k": F.col(key).cast("string")})
    if hasattr(machine, "by_window"):
        return machine.by_window(rows, F.col("__v"), Window.partitionBy("__k").orderBy("__t", *order)).drop("__t", "__v", "__k")
    rows = rows.repartition(key).sortWithinPartitions("__k", "__t", *order)

    def run(batches):
        now, state = object(), None
        for b in batches:
            out = []
            n = b.num_columns
            for t, v, k in zip(b.column(n - 3).to_pylist(), b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True):
                if k != now:
                    now, state = k, None
                state, said = machine.step(state, t, v)
                out.append(said)
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 3], pa.array(out, pa.string())], names=[*b.schema.names[: n - 3], "decision"])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decision", T.StringType())]))


def replay(machine: Any, events: list[tuple[float, float]]) -> list[str]:
    """The decisions over one key's (time, value) events."""
    state, out = None, []
    for t, v in events:
        state, said = machine.step(state, t, v)
        out.append(said)
    return out


# -- backpressure


def load_trend(df: DataFrame, by: list[str], order: list[str], load: str = "load", samples: int = 10) -> DataFrame:
    """All columns, `trend` (mean change over the last samples, 0 for a first one) and `predicted` = load + 0.2 trend."""
    w = Window.partitionBy(*by).orderBy(*order)
    near = w.rowsBetween(-(samples - 1), 0)
    n = F.count("*").over(near)
    first = F.first(load).over(near)
    trend = F.when(n > 1, (F.col(load) - first) / (n - 1)).otherwise(0.0)
    out = df.withColumn("trend", trend)
    return out.withColumn("predicted", F.col(load) + 0.2 * F.col("trend"))


def thresholds(trend: Column, warning: float = 0.7, critical: float = 0.85, emergency: float = 0.95, adaptive: bool = True) -> tuple[Column, Column, Column]:
    move = lambda x: F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.lit(x) - trend * 0.1)) if adaptive else F.lit(x)
    return move(warning), move(critical), F.lit(emergency)


def backpressure(load: Column, warning: Column, critical: Column, emergency: Column) -> Column:
    """action, delay_ms and rate_limit by load."""
    cell = lambda a, d, r: F.struct(F.lit(a).alias("action"), F.lit(d).alias("delay_ms"), F.lit(r).cast("int").alias("rate_limit"))
    return F.when(load >= emergency, cell("reject", 0, None)).when(load >= critical, cell("delay", 100, 50)).when(load >= warning, cell("limit", 0, 100)).otherwise(cell("allow", 0, None))


def evict(df: DataFrame, policy: str, max_size: int, order_id: str = "id") -> DataFrame:
    """The rows that stay in a buffer: at its size or over, the max(1, n/10) least by the policy's column go."""
    column = {"lru": "last_access", "lfu": "access_count", "fifo": "added_at"}[policy]
    n = df.count()
    if n < max_size:
        return df
    gone = ranked_by_range(df.select(order_id, column), [F.col(column), F.col(order_id)], "__rank").where(F.col("__rank") <= max(1, n // 10)).select(order_id)
    return df.join(gone, order_id, "left_anti")


Step = Callable[[tuple | None, float, float], tuple[tuple, str]]
