"""Inverted lists: vectors in the list of their nearest centroid.

Centroids are few and fixed in number (a parameter), so they go to every
task as one row and the assignment is a map: no join, no shuffle.  A stored
index is partitioned by list, so a query reads the lists it probes only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from . import products
from .search import query_blocks, ranked

MAX_LISTS = 65_536
#: Numbers that the centroids may have together.
MAX_NUMBERS = 8_000_000
#: Shares of the lists that a recall preference probes.
PREFERENCE = {"fast": 0.25, "accurate": 0.5}


def first_k(vectors: DataFrame, lists: int) -> list[list[float]]:
    """The first vectors by id as centroids."""
    return [list(map(float, r[0])) for r in vectors.orderBy("id").limit(lists).select("data").collect()]


def kmeans(vectors: DataFrame, lists: int, seed: int = 42, rounds: int = 20) -> list[list[float]]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(F.col("data").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=rounds).fit(rows)
    return [list(map(float, c)) for c in model.clusterCenters()]


def nearest_list(data: Column, centroids: list[list[float]], metric: str | None = None) -> Column:
    """The number of the nearest centroid; ties go to the lowest, other lengths to none."""
    table = F.array(*(F.struct(F.lit(i).cast("bigint").alias("i"), D.vector(c).alias("c")) for i, c in enumerate(centroids)))
    near = F.transform(table, lambda t: F.struct(D.distance(data, t.c, metric).alias("d"), t.i.alias("i")))
    return F.array_min(F.filter(near, lambda x: x.d.isNotNull())).i


@dataclass
class IVF:
    lists: DataFrame
    centroids: list[list[float]]
    metric: str | None = None
    spark: SparkSession | None = field(default=None, repr=False)

    @classmethod
    def build(cls, vectors: DataFrame, lists: int, metric: str | None = None, method: str = "first_k") -> IVF:
        if not 0 < lists <= MAX_LISTS:
            raise ValueError("bad number of lists")
        centroids = {"first_k": first_k, "kmeans": kmeans}[method](vectors, lists)
        if not centroids or len(centroids) * len(centroids[0]) > MAX_NUMBERS:
            raise ValueError("no centroids, or too many numbers to send to every task")
        return cls(cls.assign(vectors, centroids, metric), centroids, metric, vectors.sparkSession)

    @staticmethod
    def assign(vectors: DataFrame, centroids: list[list[float]], metric: str | None = None) -> DataFrame:
        """All columns and list_id; the centroids are one broadcast row, not an expression a vector long."""
        spark = vectors.sparkSession
        rows = [(i, c) for i, c in enumerate(centroids)]
        table = spark.createDataFrame(rows, "i bigint, c array<double>").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("__centroids"))
        both = vectors.crossJoin(F.broadcast(table))
        near = F.transform("__centroids", lambda t: F.struct(D.distance(F.col("data"), t.c, metric).alias("d"), t.i.alias("i")))
        return both.withColumn("list_id", F.array_min(F.filter(near, lambda x: x.d.isNotNull())).i).drop("__centroids")

    def probes(self, query, nprobe: int | None) -> list[int]:
        """The nearest lists of a query, worked out here: there are as many distances as lists."""
        import numpy as np

        c, q = np.array(self.centroids), np.array(query, float)
        name = D.metric_name(self.metric)
        if name == "euclidean":
            d = np.sqrt(((c - q) ** 2).sum(1))
        elif name == "manhattan":
            d = np.abs(c - q).sum(1)
        elif name == "dotproduct":
            d = -(c @ q)
        elif name == "hamming":
            d = (c != q).sum(1).astype(float)
        elif name == "cosine":
            n = np.sqrt((c * c).sum(1)) * np.sqrt((q * q).sum())
            d = np.where(n > 0, 1 - (c @ q) / np.where(n > 0, n, 1), 1.0)
        else:
            some = ((c > 0) | (q > 0)).sum(1)
            d = np.where(some > 0, 1 - ((c > 0) & (q > 0)).sum(1) / np.maximum(some, 1), 0.0)
        n = len(c) if not nprobe or nprobe <= 0 or nprobe > len(c) else nprobe
        return [int(i) for i in np.lexsort((np.arange(len(c)), d))[:n]]

    def nprobe_for(self, preference: str) -> int:
        return max(1, round(PREFERENCE[preference] * len(self.centroids)))

    def search(self, query, k: int = 10, nprobe: int | None = 1, threshold: float | None = None) -> DataFrame:
        rows = self.lists.where(F.col("list_id").isin(self.probes(query, nprobe)))
        rows = rows.withColumn("distance", D.distance(F.col("data"), D.vector(query), self.metric)).where("distance is not null")
        if threshold:
            rows = rows.where(F.col("distance") <= threshold)
        return ranked(rows.select("id", "distance"), k)

    def search_batch(self, queries: DataFrame, k: int = 10, nprobe: int = 1) -> DataFrame:
        """query_id, id, distance, rank.  A task meets each query with the rows of its lists only."""
        out, name = None, D.metric_name(self.metric)
        by_products = name in products.METRICS and k is not None and k > 0
        for block in query_blocks(queries.select("query_id", "q"), k=max(k, nprobe) if by_products else 1):
            if by_products:
                pairs = products.nearest(self.lists, self.probe_lists(block, nprobe), k, name)
            else:
                pairs = self.lists.select("id", "data", "list_id").join(F.broadcast(self.assigned_probes(block, nprobe)), "list_id")
                pairs = pairs.withColumn("distance", D.distance(F.col("data"), F.col("q"), self.metric)).where("distance is not null")
            part = ranked(pairs.select("query_id", "id", "distance"), k, ["query_id"])
            out = part if out is None else out.unionByName(part)
        return out

    def probe_lists(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """query_id, q and probes, the numbers of the nearest lists."""
        spark = queries.sparkSession
        table = spark.createDataFrame(list(enumerate(self.centroids)), "i bigint, c array<double>").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("t"))
        near = F.transform("t", lambda t: F.struct(D.distance(F.col("q"), t.c, self.metric).alias("d"), t.i.alias("i")))
        return queries.crossJoin(F.broadcast(table)).select("query_id", "q", F.transform(F.slice(F.array_sort(near), 1, nprobe), lambda x: x.i).alias("probes"))

    def assigned_probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        return self.probe_lists(queries, nprobe).select("query_id", "q", F.explode("probes").alias("list_id"))

    def add(self, vectors: DataFrame) -> IVF:
        return IVF(self.lists.unionByName(self.assign(vectors, self.centroids, self.metric)), self.centroids, self.metric, self.spark)

    def delete(self, ids: DataFrame) -> IVF:
        return IVF(self.lists.join(ids.select("id"), "id", "left_anti"), self.centroids, self.metric, self.spark)

    def clear(self) -> IVF:
        return IVF(self.lists.limit(0), self.centroids, self.metric, self.spark)

    def rebuild(self, method: str = "first_k") -> IVF:
        return IVF.build(self.lists.drop("list_id"), len(self.centroids), self.metric, method)

    def stats(self) -> DataFrame:
        return self.lists.groupBy("list_id").agg(F.count("*").alias("vectors"))

    def save(self, path: str) -> None:
        """Vectors by list under `path`, centroids beside them; a task a core writes a list, however large."""
        share = F.pmod(F.xxhash64("id"), F.lit(self.lists.sparkSession.sparkContext.defaultParallelism))
        self.lists.repartition("list_id", share).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
        self.spark.createDataFrame([(i, c, self.metric) for i, c in enumerate(self.centroids)], "i bigint, c array<double>, metric string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IVF:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("i").limit(MAX_LISTS).collect()
        return cls(spark.read.parquet(f"{path}/lists").withColumn("list_id", F.col("list_id").cast("bigint")), [list(r.c) for r in rows], rows[0].metric, spark)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact rows that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
