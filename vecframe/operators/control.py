"""Deadlines for queries, and pluggable indexes."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

DEFAULT_TIMEOUT = 30.0


class QueryTimeout(RuntimeError):
    pass


def with_timeout(spark: SparkSession, run: Callable[[], Any], seconds: float = DEFAULT_TIMEOUT) -> Any:
    """run(), whose jobs are cancelled after `seconds`; they carry a tag of their own."""
    if seconds <= 0:
        raise ValueError("a timeout must be positive")
    tag, late = f"timeout-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return run()
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


class SearchIndex(Protocol):
    """What an index of one's own has to offer; ivf.IVF does."""

    def search(self, query, k: int = 10) -> DataFrame: ...

    def add(self, vectors: DataFrame) -> SearchIndex: ...

    def delete(self, ids: DataFrame) -> SearchIndex: ...

    def clear(self) -> SearchIndex: ...

    def stats(self) -> DataFrame: ...
