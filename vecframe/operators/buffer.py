"""A write buffer of recent vectors: entries (id, data, metadata, added_at, last_access, access_count).

Operations take a buffer and give the next one; a streaming job keeps it between
batches and writes it to the store when it is due (streaming/jobs.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stateful import evict

MAX_SIZE, MAX_MEMORY_MB, FLUSH_AT, FLUSH_SECONDS = 100_000, 512, 0.8, 30
#: Bytes of an entry besides its numbers and keys; of a metadata key.
ENTRY_BYTES, KEY_BYTES = 72, 16


def entry_bytes(data: Column, metadata: Column | None = None) -> Column:
    """4 bytes a number, 16 a metadata key, and the entry."""
    keys = F.coalesce(F.size(F.map_keys(metadata)), F.lit(0)) if metadata is not None else F.lit(0)
    return (4 * F.size(data) + KEY_BYTES * keys + ENTRY_BYTES).cast("bigint")


def usage(buffer: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """One row: vectors, bytes, memory_mb, usage (share of max_size)."""
    size = entry_bytes(F.col("data"), F.col("metadata") if "metadata" in buffer.columns else None)
    one = buffer.agg(F.count("*").alias("vectors"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return one.select("vectors", "bytes", (F.col("bytes") / float(1 << 20)).alias("memory_mb"), (F.col("vectors") / float(max_size)).alias("usage"))


def add(buffer: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Rows by id: a known id gets the new vector, this access and its count plus one; of ids that repeat any row is taken."""
    new = rows.dropDuplicates(["id"])
    old = buffer.select("id", F.col("added_at").alias("__added"), F.col("access_count").alias("__count"))
    put = new.join(old, "id", "left").withColumns({"added_at": F.coalesce("__added", now), "last_access": now, "access_count": F.coalesce(F.col("__count"), F.lit(0)) + 1}).drop("__added", "__count")
    return buffer.join(new.select("id"), "id", "left_anti").unionByName(put, allowMissingColumns=True)


def get(buffer: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entries with these ids, the buffer with their access noted)."""
    asked = ids.groupBy("id").agg(F.count("*").alias("__asked"))
    both = buffer.join(asked, "id", "left")
    after = both.withColumns({"last_access": F.when(F.col("__asked").isNotNull(), now).otherwise(F.col("last_access")), "access_count": F.col("access_count") + F.coalesce("__asked", F.lit(0))})
    return after.where("__asked is not null").drop("__asked"), after.drop("__asked")


def hits_and_misses(buffer: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: hits and misses of these reads."""
    known = ids.join(buffer.select("id", F.lit(1).alias("__known")).dropDuplicates(["id"]), "id", "left")
    return known.agg(F.count("__known").alias("hits"), (F.count("*") - F.count("__known")).alias("misses"))


def has(buffer: DataFrame, id_) -> bool:
    return not buffer.where(F.col("id") == id_).isEmpty()


def ids(buffer: DataFrame) -> DataFrame:
    return buffer.select("id")


def remove(buffer: DataFrame, gone: DataFrame) -> DataFrame:
    return buffer.join(gone.select("id"), "id", "left_anti")


def room_for_more(buffer: DataFrame, policy: str = "lru", max_size: int = MAX_SIZE, max_mb: float = MAX_MEMORY_MB) -> DataFrame:
    """The buffer as it is before an insert: at its size or memory the max(1, n / 10) least by the policy go."""
    now = usage(buffer, max_size).first()
    return evict(buffer, policy, 0) if now.vectors and (now.vectors >= max_size or now.memory_mb >= max_mb) else buffer


def flush_due(share: Column, idle_seconds: Column, vectors: Column, at: float = FLUSH_AT, seconds: float = FLUSH_SECONDS) -> Column:
    """Whether a buffer is written: its share of the size is reached, or it has rows and the interval is over."""
    return (share >= at) | ((vectors > 0) & (idle_seconds >= seconds))
