"""Exact nearest-neighbour search over a DataFrame of vectors.

One query is a literal: distances are computed in the scan's stage and
TakeOrderedAndProject keeps k rows a task, without a shuffle of vectors.  A
batch is a DataFrame of queries, sent to the tasks in blocks of a checked
size; products of matrices find each task's nearest rows before rows meet by
query (other metrics: a rank limit by query over all pairs).
Ties are broken by id.  A threshold is inclusive, and 0 or None is none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from . import products

DEFAULT_K, MAX_K = 10, 1000
#: Numbers of a block of queries that may be broadcast.
MAX_BROADCAST = 4_000_000
#: The clamp of a query's own k.
OWN_K = f"if(k is null or k <= 0, {DEFAULT_K}, least(k, {MAX_K}))"


@dataclass(frozen=True)
class Query:
    vector: tuple[float, ...]
    k: int = DEFAULT_K
    metric: str | None = None
    threshold: float | None = None

    def validate(self, max_dim: int = 10_000) -> None:
        if not self.vector or len(self.vector) > max_dim:
            raise ValueError("a query needs 1 to %d dimensions" % max_dim)
        if not all(math.isfinite(x) for x in self.vector):
            raise ValueError("a query's numbers must be finite")
        if self.k < 0:
            raise ValueError("k must not be negative")
        if self.threshold is not None and self.threshold < 0:
            raise ValueError("a threshold must not be negative")
        D.metric_name(self.metric)


def clamp_k(k: int | None) -> int:
    return DEFAULT_K if not k or k <= 0 else min(k, MAX_K)


def ranked(df: DataFrame, k: int | None, by: list[str] | None = None, order: list[Column] | None = None, name: str = "rank") -> DataFrame:
    """Rows 1..k of each group by distance and id."""
    order = order or [F.col("distance"), F.col("id")]
    if not by:
        top = df.orderBy(*order)
        top = top.limit(k) if k is not None else top
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w).cast("bigint"))
    return out.where(F.col(name) <= k) if k is not None else out


def with_distance(vectors: DataFrame, query, metric: str | None = None, data: str = "data") -> DataFrame:
    return vectors.withColumn("distance", D.distance(F.col(data), D.vector(query), metric))


def knn(vectors: DataFrame, query, k: int = DEFAULT_K, metric: str | None = None, threshold: float | None = None, where: Column | None = None, post: bool = False, include_vector: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, distance, score, rank of the k nearest; `where` before the distances, or after the limit with post=True."""
    Query(tuple(query), k, metric, threshold).validate()
    rows = vectors if where is None or post else vectors.where(where)
    extra = [*keep, *(["data"] if include_vector else [])]
    wide = [c for c in vectors.columns if c not in ("id", "distance")] if post and where is not None else extra
    rows = with_distance(rows, query, metric).where("distance is not null")
    rows = rows.select("id", "distance", *dict.fromkeys(wide))
    if threshold:
        rows = rows.where(F.col("distance") <= threshold)
    out = rows.orderBy("distance", "id").limit(k)
    if post and where is not None:
        out = out.where(where)
    out = ranked(out, None)
    return out.select("id", "distance", D.score_metric(F.col("distance"), metric).alias("score"), "rank", *extra)


def query_blocks(queries: DataFrame, most: int | None = None, k: int = 1):
    """The queries in DataFrames whose numbers, and results at k a query, are at most `most`; one pass finds how many."""
    n, size = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    blocks = max(1, -(-n * max(1, size or 1, k) // (most or MAX_BROADCAST)))
    if blocks == 1:
        yield queries
        return
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: str | None = None, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, distance, rank; queries have query_id, q and may have k and threshold."""
    rows = (vectors if where is None else vectors.where(where)).select("id", "data", *keep)
    own = [c for c in ("k", "threshold") if c in queries.columns]
    queries = queries.select("query_id", "q", *own)
    if "k" in own:
        k = queries.agg(F.max(F.expr(OWN_K))).first()[0] or DEFAULT_K
    by_products, out = D.metric_name(metric) in products.METRICS and k is not None and k > 0, None
    for block in query_blocks(queries, k=k if by_products else 1):
        if by_products:
            pairs = products.nearest(rows, block, k, D.metric_name(metric), keep)
        else:
            pairs = rows.crossJoin(F.broadcast(block)).withColumn("distance", D.distance(F.col("data"), F.col("q"), metric)).where("distance is not null")
        if "threshold" in own:
            pairs = pairs.where("threshold is null or threshold = 0 or distance <= threshold")
        part = ranked(pairs.select("query_id", "id", "distance", *keep, *(["k"] if "k" in own else [])), k, ["query_id"])
        if "k" in own:
            part = part.where(f"rank <= {OWN_K}").drop("k")
        out = part if out is None else out.unionByName(part)
    return out


def range_search(vectors: DataFrame, query, radius: float, metric: str | None = None) -> DataFrame:
    """All ids within the radius, with their distances."""
    return with_distance(vectors, query, metric).where(F.col("distance") <= radius).select("id", "distance")


def multi_cluster(vectors: DataFrame, query, clusters: list[int], **kw) -> DataFrame:
    """Search of the given clusters; a literal list, so partitions are pruned."""
    return knn(vectors, query, where=F.col("cluster_id").isin(clusters), **kw)


def dual(buffer: DataFrame, segments: DataFrame, query, **kw) -> DataFrame:
    """Search of recent and stored rows; a recent row stands for a stored one with its id."""
    stored = segments.join(buffer.select("id"), "id", "left_anti")
    return knn(buffer.unionByName(stored, allowMissingColumns=True), query, **kw)


def scatter_gather(results: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Results of several nodes as one: least distance of each id, nearest k."""
    one = results.groupBy(*by, "id").agg(F.min("distance").alias("distance"))
    return ranked(one, k, list(by))


class IndexRegistry:
    """Named DataFrames of vectors, one of them active; the first added becomes it."""

    def __init__(self):
        self.indexes: dict[str, DataFrame] = {}
        self.active: str | None = None

    def add(self, name: str, vectors: DataFrame) -> None:
        old = self.indexes.get(name)
        self.indexes[name] = vectors if old is None else old.unionByName(vectors)
        self.active = self.active or name

    def build(self, name: str, vectors: DataFrame) -> None:
        self.indexes[name] = vectors
        self.active = self.active or name

    def delete(self, name: str, ids: DataFrame) -> None:
        self.indexes[name] = self.indexes[name].join(ids.select("id"), "id", "left_anti")

    def clear(self, name: str) -> None:
        self.indexes[name] = self.indexes[name].limit(0)

    def use(self, name: str) -> None:
        if name not in self.indexes:
            raise KeyError(name)
        self.active = name

    def search(self, query, **kw) -> DataFrame:
        if self.active is None:
            raise LookupError("no index")
        return knn(self.indexes[self.active], query, **kw)
