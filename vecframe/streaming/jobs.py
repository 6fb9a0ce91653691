"""Structured Streaming jobs: ingest, search, metric windows, limits."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics, search
from ..sources import requests
from ..sources.store import VectorStore, prepare

PARSERS = {"http": requests.from_http, "websocket": requests.from_websocket, "redis": requests.from_redis}


def ingest(lines: DataFrame, store: VectorStore, checkpoint: str, protocol: str = "http", rejects: str | None = None, clusters: int = 1024, trigger: dict | None = None) -> StreamingQuery:
    """Lines of requests into the store; rows that fail go to `rejects`.  A batch that is replayed adds nothing, as ids are unique."""
    rows = PARSERS[protocol](lines)

    def write(batch: DataFrame, _: int) -> None:
        good, bad = prepare(batch, clusters)
        store.append(good)
        if rejects:
            bad.write.mode("append").json(rejects)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def search_stream(queries: DataFrame, vectors: DataFrame, sink: str, checkpoint: str, k: int = 10, metric: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A stream of queries (query_id, q) against stored vectors."""

    def write(batch: DataFrame, _: int) -> None:
        search.knn_batch(vectors, batch, k, metric).write.mode("append").parquet(sink)

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def metric_windows(events: DataFrame, by: list[str], size: str = "5 minutes", slide: str | None = "1 minute", late: str = "10 minutes", functions: tuple[str, ...] = ("sum", "avg", "max"), ts: str = "ts", value: str = "value") -> DataFrame:
    """Windowed aggregates of a stream with a watermark."""
    return metrics.windowed(events.withWatermark(ts, late), by, size, slide, functions, ts, value)


def limited(events: DataFrame, machine: Any, key: str, ts: str, value: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """`columns`, key, ts and decision of a stream: the machine's steps with its state kept by key.

    Within a batch a key's events are taken by time; state expires never."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout
    from pyspark.sql.types import StringType, StructField, StructType

    rows = events.select(key, ts, *columns, (F.col(value).cast("double") if value else F.lit(0.0)).alias("__v"))
    out = StructType([*(f for f in rows.schema.fields if f.name != "__v"), StructField("decision", StringType())])

    def run(_, parts, state):
        import ast

        now = ast.literal_eval(state.get[0]) if state.exists else None
        frames = list(parts)
        if frames:
            df = pd.concat(frames).sort_values(ts, kind="stable")
            said = []
            for t, v in zip(df[ts].astype("int64") / (1e9 if str(df[ts].dtype).endswith("[ns]") else 1e6), df["__v"], strict=True):
                now, d = machine.step(now, float(t), float(v))
                said.append(d)
            state.update((repr(now),))
            yield df.drop(columns="__v").assign(decision=said)

    return rows.groupBy(key).applyInPandasWithState(run, out, "state string", "append", GroupStateTimeout.NoTimeout)
