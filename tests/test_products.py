"""Batch search by products of matrices, against all pairs in Spark's own expressions."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecframe.functions import distance as D
from vecframe.operators import ivf, products, search
from vecframe.plans import nearest, registry


def plan(df):
    return df._jdf.queryExecution().toString()


def shown(df, *more):
    return sorted((r.query_id, r["rank"], r.id, repr(r.distance), *(r[c] for c in more)) for r in df.collect())


def all_pairs(v, q, k, metric, *more):
    pairs = v.crossJoin(q).withColumn("distance", D.distance(F.col("data"), F.col("q"), metric))
    pairs = pairs.where(D.inner_product(F.col("data"), F.col("q")).isNotNull() & F.col("distance").isNotNull())
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return shown(pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), *more)


def odd_rows(scale=1.0):
    rng = np.random.default_rng(5)
    rows = [(rng.normal(size=6) * scale).tolist() for _ in range(90)]
    rows += [rows[3]] * 40 + [(np.array(rows[4]) * s).tolist() for s in (1, 2, -1, 1e-3, 1e8, 1 + 1e-15)]
    rows += [[0.0] * 6, [-0.0] * 6, [1e200] * 6, [1e200] * 5 + [-1e200], [1e-200] * 6, [1e-160] * 5 + [0.0], [math.nan] * 6, [1.0] * 5 + [math.nan], [math.inf] + [1.0] * 5, [-math.inf] * 6]
    rows += [[], [], [1.0], [2.0, 3.0], [2.0, 3.5], None, [1.0] * 5 + [None]]
    return [(f"{(i * 37) % 1009:04}", x, i) for i, x in enumerate(rows)]


@pytest.mark.parametrize("metric", products.METRICS)
@pytest.mark.parametrize("cells", [2_000_000, 50])
def test_batch_of_odd_vectors_equals_all_pairs(spark, metric, cells, monkeypatch):
    rows = [r for r in odd_rows() if metric != "cosine" or r[1] is None or not any(x and 0 < abs(x) < 1e-150 for x in r[1])]
    v = spark.createDataFrame(rows, "id string, data array<double>, n int").repartition(3)
    q = v.select(F.col("id").alias("query_id"), F.col("data").alias("q"))
    monkeypatch.setattr(products, "CELLS", cells)
    for k in (1, 4, 30):
        assert shown(search.knn_batch(v, q, k, metric, keep=("n",)), "n") == all_pairs(v, q, k, metric, "n")


def test_batch_of_many_rows_equals_all_pairs(spark):
    """More rows than one batch has, in an order in which every row is nearer than those before it."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(3000, 8)) * np.linspace(9, 1, 3000)[:, None]
    v = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "id long, data array<float>")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("data").alias("q"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for metric in products.METRICS:
            assert shown(search.knn_batch(v, q, 7, metric)) == all_pairs(v, q, 7, metric)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_own_k_threshold_and_equal_queries(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "id long, data array<float>")
    rows = [("a", [0.0], 2, None), ("b", [0.0], 5, 2.0), ("c", [0.0], None, 0.0), ("d", [3.0], 0, 1.0), ("e", None, 3, None)]
    got = search.knn_batch(v, spark.createDataFrame(rows, "query_id string, q array<double>, k int, threshold double"))
    assert {x: sorted(r.id for r in got.collect() if r.query_id == x) for x in "abcde"} == {"a": [0, 1], "b": [0, 1, 2], "c": list(range(10)), "d": [2, 3, 4], "e": []}
    assert search.knn_batch(v.limit(0), v.limit(2).select(F.col("id").alias("query_id"), F.col("data").alias("q")), 3).count() == 0
    assert search.knn_batch(v, v.limit(0).select(F.col("id").alias("query_id"), F.col("data").alias("q")), 3).count() == 0


@pytest.mark.parametrize("name", ["knn_batch_cosine", "scatter_gather", "knn_batch"])
def test_no_row_for_each_pair(spark, sf, name):
    got = plan(registry.QUERIES[name](spark, sf))
    assert "BroadcastNestedLoopJoin" not in got and "CartesianProduct" not in got


def test_few_pairs_are_worked_out_and_fewer_by_row_in_longer_tables(monkeypatch):
    """Before, each of rows x queries was; now what a task works out and returns hardly grows with its rows."""
    m = np.random.default_rng(7).normal(size=(16_000, 64)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1)[:, None]
    seen, distance = [], products.Queries._distance
    monkeypatch.setattr(products.Queries, "_distance", lambda self, rows, r, side, q: seen.append(len(r)) or distance(self, rows, r, side, q))
    vector = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, 64, dtype=np.int32)), pa.array(m.ravel()))
    queries = pa.table({"query_id": pa.array(range(40)), "q": vector[:40].cast(pa.list_(pa.float64()))})
    pairs = []
    for n in (4_000, 16_000):
        seen.clear()
        batches = [pa.RecordBatch.from_arrays([vector[i : i + 1000], pa.array(range(i, i + 1000))], names=["data", "id"]) for i in range(0, n, 1000)]
        out = list(products.Queries(queries, "euclidean", 10, ["query_id"]).scan(iter(batches), ["query_id", "distance", "id"]))
        assert sum(b.num_rows for b in out) == 400
        pairs.append(sum(seen))
    assert pairs[0] < 40 * 4_000 / 20 and pairs[1] < 2 * pairs[0]


def kinds_of_vectors():
    """(vectors, whether single precision tells their distances apart) by name."""
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(3000, 24))
    some = np.repeat(rng.normal(size=(60, 24)), 50, axis=0)
    return {
        "plain": (plain, True),
        "whole numbers with ties": (rng.integers(-2, 3, size=(3000, 24)).astype(float), True),
        "near copies": (some + rng.normal(size=some.shape) * 1e-9, None),
        "far from zero": (plain + 1e5, False),
        "small and large": (plain * 10.0 ** rng.integers(-16, 17, size=3000)[:, None], None),
        "too small for single precision": (plain * 1e-30, False),
    }


@pytest.mark.parametrize("metric", products.METRICS)
@pytest.mark.parametrize("name", kinds_of_vectors())
def test_bounds_are_single_first_and_lose_no_pair(name, metric, monkeypatch):
    """Before, all bounds were products in double precision, which take twice the time."""
    m, told = kinds_of_vectors()[name]
    used, near = {np.float32: 0, np.float64: 0}, products.Queries._near

    def counted(self, rows, side, some, last):
        used[side.factors.dtype.type] += len(some) * len(rows.square)
        return near(self, rows, side, some, last)

    monkeypatch.setattr(products.Queries, "_near", counted)
    worked, distance = [], products.Queries._distance
    monkeypatch.setattr(products.Queries, "_distance", lambda self, rows, r, side, q: worked.append(len(r)) or distance(self, rows, r, side, q))
    vector = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
    queries = products.Queries(pa.table({"query_id": pa.array(range(30)), "q": vector.take(pa.array(range(0, 3000, 100)))}), metric, 10, ["query_id"])
    batches = [pa.RecordBatch.from_arrays([vector[i : i + 1000], pa.array(range(i, i + 1000))], names=["data", "id"]) for i in range(0, 3000, 1000)]
    got = [r for b in queries.scan(iter(batches), ["query_id", "distance", "id"]) for r in b.to_pylist()]
    assert used[np.float32] == 30 * 3000
    if told:
        assert used[np.float64] < used[np.float32] / 10
    if told is False:
        assert used[np.float64] == 30 * 3000
    assert sum(worked) < 30 * 3000 / 4
    rows, side = products.Side(m, metric, False), products.Side(m[::100], metric, True)
    for q in range(30):
        d = distance(queries, rows, np.arange(3000), side, np.full(3000, q))
        best = np.lexsort((np.arange(3000), d))[:10]
        found = sorted((r for r in got if r["query_id"] == q), key=lambda r: (r["distance"], r["id"]))
        assert [(r["id"], r["distance"]) for r in found] == [(i, d[i]) for i in best.tolist()]


def test_rows_of_one_file_are_dealt_to_all_cores(spark, sf):
    rows, q = registry.vectors(spark, sf), nearest.query_set(spark, sf)
    assert rows.rdd.getNumPartitions() == 1
    assert products.nearest(rows, q, 10, "euclidean").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_every_label_is_on_a_node(spark, sf, tmp_path):
    """Before, vectors without a label were on no node and in no result."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    odd = F.expr("case when vec_id % 3 = 0 then null when vec_id % 7 = 0 then 99 when vec_id % 11 = 0 then -5 else label end")
    rows.withColumn("label", odd.cast("int")).write.parquet(str(tmp_path / "embeddings.parquet"))
    v, q = registry.vectors(spark, str(tmp_path)), nearest.query_set(spark, str(tmp_path))
    want = [(a, b, c) for a, b, c, _ in all_pairs(v, q, 10, "euclidean")]
    assert want and [(a, b, c) for a, b, c, _ in shown(registry.QUERIES["scatter_gather"](spark, str(tmp_path)))] == want


@pytest.mark.parametrize("metric", products.METRICS)
def test_batch_over_lists_equals_their_pairs(spark, metric):
    rows = [r for r in odd_rows() if r[1] is None or all(x is None or x == 0 or 1e-150 < abs(x) < 1e150 for x in r[1])]
    v = spark.createDataFrame(rows, "id string, data array<double>, n int")
    q = v.select(F.col("id").alias("query_id"), F.col("data").alias("q"))
    index = ivf.IVF.build(v, 9, metric)
    pairs = index.lists.join(index.assigned_probes(q, 3), "list_id").withColumn("distance", D.distance(F.col("data"), F.col("q"), metric))
    pairs = pairs.where(D.inner_product(F.col("data"), F.col("q")).isNotNull() & F.col("distance").isNotNull())
    want = shown(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where("rank <= 5"))
    assert want and shown(index.search_batch(q, 5, 3)) == want


def test_recall_joins_no_vectors(spark, sf):
    rows, q = registry.vectors(spark, sf), nearest.query_set(spark, sf)
    got = plan(ivf.IVF.build(rows, 4, method="kmeans").search_batch(q, 10, 3)).split("== Physical Plan ==")[-1]
    assert "HashJoin" not in got and "SortMergeJoin" not in got and "MapInArrow" in got


def test_a_list_of_most_rows_is_dealt_to_several_tasks(spark, tmp_path):
    """Before, a list was one file, and one task met all of it with all its queries."""
    far = spark.createDataFrame([(-1, [9.0]), (-2, [0.0])], "id long, data array<float>")
    v = far.unionByName(spark.range(4000).select("id", F.array((F.col("id") % 50 / 1000).cast("float")).alias("data")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ivf.IVF.build(v, 2).save(str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = ivf.IVF.load(spark, str(tmp_path / "i"))
    large = index.lists.groupBy("list_id", F.input_file_name().alias("f")).count().orderBy(F.desc("count")).first()
    assert index.lists.count() == 4002 and large["count"] < 3500
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("data").alias("q"))
    got = plan(index.search_batch(q, 3, 2))
    assert "Join" not in got.split("== Physical Plan ==")[-1]
    assert shown(index.search_batch(q, 3, 2)) == all_pairs(v, q, 3, "euclidean")
