"""Distance, search and inverted-list queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import ivf, search
from ..sources.shared import shared_folder
from .registry import DISTANCE, Q, V, query, r6, vector_of, vectors

LISTS = 16


def _distance(metric):
    @query(f"dist_{metric}", f"WITH {Q}, {V} SELECT id, round({DISTANCE[metric]}, 6) + 0.0 AS d FROM v, q")
    def run(spark, sf):
        return search.with_distance(vectors(spark, sf), vector_of(spark, sf), metric).select("id", r6(F.col("distance")).alias("d"))

    @query(f"knn_{metric}", f"WITH {Q}, {V}, t AS (SELECT id, {DISTANCE[metric]} AS d FROM v, q ORDER BY d, id LIMIT 10) SELECT id, round(d, 6) + 0.0 AS distance, row_number() OVER (ORDER BY d, id) AS rank FROM t")
    def near(spark, sf):
        return search.knn(vectors(spark, sf), vector_of(spark, sf), 10, metric).select("id", r6(F.col("distance")).alias("distance"), "rank")


for _m in D.METRICS:
    _distance(_m)


@query("inner_product", f"WITH {Q}, {V} SELECT id, round(list_inner_product(v, q), 6) + 0.0 AS d FROM v, q")
def inner(spark, sf):
    return vectors(spark, sf).select("id", r6(D.inner_product(F.col("data"), D.vector(vector_of(spark, sf)))).alias("d"))


@query("vec_norm", f"WITH {V} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS n FROM v")
def norm(spark, sf):
    return vectors(spark, sf).select("id", r6(D.norm(F.col("data"))).alias("n"))


@query("vec_normalize", f"WITH {V} SELECT id, round(v[1] / sqrt(list_inner_product(v, v)), 6) + 0.0 AS first, round(v[64] / sqrt(list_inner_product(v, v)), 6) + 0.0 AS last FROM v")
def normalize(spark, sf):
    rows = vectors(spark, sf).select("id", D.normalize(F.col("data")).alias("u"))
    return rows.select("id", r6(F.col("u")[0]).alias("first"), r6(F.col("u")[63]).alias("last"))


@query("score_metric", f"WITH {Q}, {V} SELECT id, round(1 / (1 + {DISTANCE['euclidean']}), 6) AS euclidean, round(1 - {DISTANCE['cosine']}, 6) + 0.0 AS cosine, round(1 + list_inner_product(v, q), 6) AS dot FROM v, q")
def scores(spark, sf):
    v, q = F.col("data"), D.vector(vector_of(spark, sf))
    one = lambda m: r6(D.score_metric(D.distance(v, q, m), m))
    return vectors(spark, sf).select("id", one("euclidean").alias("euclidean"), one("cosine").alias("cosine"), one("dotproduct").alias("dot"))


@query("score_decay", f"WITH {Q}, {V}, d AS (SELECT id, {DISTANCE['euclidean']} AS d FROM v, q) SELECT id, round(CASE WHEN d <= 0 THEN 1.0 ELSE exp(-d / 10) END, 6) AS s FROM d")
def decay(spark, sf):
    return search.with_distance(vectors(spark, sf), vector_of(spark, sf)).select("id", r6(D.score_decay(F.col("distance"))).alias("s"))


def _similarity(kind, sql):
    @query(f"sim_{kind}", f"WITH {Q}, {V} SELECT id, round({sql}, 6) + 0.0 AS s FROM v, q")
    def run(spark, sf):
        return vectors(spark, sf).select("id", r6(D.similarity(F.col("data"), D.vector(vector_of(spark, sf)), kind)).alias("s"))


_similarity("angular", "list_cosine_similarity(v, q)")
_similarity("euclidean", f"1 / (1 + {DISTANCE['euclidean']})")
_similarity("manhattan", f"1 / (1 + {DISTANCE['manhattan']})")


def _knn(where="", k=10, limit_first=False):
    inner = f"SELECT id, label, {DISTANCE['euclidean']} AS d FROM v, q {'' if limit_first else where} ORDER BY d, id LIMIT {k}"
    return f"WITH {Q}, {V}, t AS ({inner}) SELECT id, round(d, 6) + 0.0 AS distance, round(1 / (1 + d), 6) AS score, row_number() OVER (ORDER BY d, id) AS rank FROM t {where if limit_first else ''}"


def _shown(df):
    return df.select("id", r6(F.col("distance")).alias("distance"), r6(F.col("score")).alias("score"), "rank")


@query("knn_exact", _knn())
def knn_exact(spark, sf):
    return _shown(search.knn(vectors(spark, sf), vector_of(spark, sf), 10))


@query("knn_threshold", _knn(f"WHERE {DISTANCE['euclidean']} <= 1.1", 100))
def knn_threshold(spark, sf):
    return _shown(search.knn(vectors(spark, sf), vector_of(spark, sf), 100, threshold=1.1))


@query("knn_prefilter", _knn("WHERE label IN (1, 3)"))
def knn_prefilter(spark, sf):
    return _shown(search.knn(vectors(spark, sf), vector_of(spark, sf), 10, where=F.col("label").isin(1, 3)))


@query("knn_postfilter", _knn("WHERE label IN (1, 3)", 50, True))
def knn_postfilter(spark, sf):
    return _shown(search.knn(vectors(spark, sf), vector_of(spark, sf), 50, where=F.col("label").isin(1, 3), post=True))


@query("knn_multi_cluster", _knn("WHERE label IN (2, 5, 7)"))
def knn_multi(spark, sf):
    rows = vectors(spark, sf).withColumn("cluster_id", F.col("label"))
    return _shown(search.multi_cluster(rows, vector_of(spark, sf), [2, 5, 7], k=10))


@query("knn_dual", _knn())
def knn_dual(spark, sf):
    rows = vectors(spark, sf)
    return _shown(search.dual(rows.where("label >= 7"), rows.where("label < 8"), vector_of(spark, sf), k=10))


@query("range_search", f"WITH {Q}, {V} SELECT id, round({DISTANCE['euclidean']}, 6) + 0.0 AS distance FROM v, q WHERE {DISTANCE['euclidean']} <= 1.3")
def range_search(spark, sf):
    return search.range_search(vectors(spark, sf), vector_of(spark, sf), 1.3).select("id", r6(F.col("distance")).alias("distance"))


#: The stated query set of the batch queries: every vector whose id is divisible by 100, against all vectors.
QS = "qs AS (SELECT id AS query_id, v AS q FROM v WHERE id % 100 = 0)"


def query_set(spark, sf):
    return vectors(spark, sf).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("data").alias("q"))


def _batch(metric, source="v", extra=""):
    return f"WITH {V}, {QS}{extra}, t AS (SELECT query_id, id, {DISTANCE[metric]} AS d FROM {source}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM t) SELECT query_id, id, round(d, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10"


def _pairs(df):
    return df.select("query_id", "id", r6(F.col("distance")).alias("distance"), "rank")


@query("knn_batch", _batch("euclidean", "v, qs"))
def knn_batch(spark, sf):
    return _pairs(search.knn_batch(vectors(spark, sf), query_set(spark, sf), 10))


@query("knn_batch_cosine", _batch("cosine", "v, qs"))
def knn_batch_cosine(spark, sf):
    return _pairs(search.knn_batch(vectors(spark, sf), query_set(spark, sf), 10, "cosine"))


@query("scatter_gather", _batch("euclidean", "v, qs"))
def scatter(spark, sf):
    """Two nodes with overlapping vectors, merged; every vector is on one of them, whatever its label."""
    rows, qs = vectors(spark, sf), query_set(spark, sf)
    a, b = (search.knn_batch(rows.where(w), qs, 10).drop("rank") for w in ("label <= 6 or label is null", "label >= 4"))
    return _pairs(search.scatter_gather(a.unionByName(b), 10))


# -- inverted lists

CENTROIDS = f"c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS list_id, v AS c FROM v QUALIFY row_number() OVER (ORDER BY id) <= {LISTS})"
ASSIGNED = "a AS (SELECT id, any_value(v) AS v, arg_min(list_id, list_distance(v, c) * 1e9 + list_id * 1e-9) AS list_id FROM v, c GROUP BY id)"
PROBES = "p AS (SELECT list_id FROM c, q ORDER BY list_distance(c, q), list_id LIMIT {n})"


@query("ivf_assign", f"WITH {V}, {CENTROIDS}, {ASSIGNED} SELECT id, list_id FROM a")
def ivf_assign(spark, sf):
    rows = vectors(spark, sf)
    return ivf.IVF.assign(rows, ivf.first_k(rows, LISTS)).select("id", "list_id")


def index(spark, sf, lists=LISTS):
    """The stored index of the vectors, built and written once a session and table."""
    key = (spark.sparkContext.applicationId, sf, lists)
    if key not in _STORED:
        _STORED[key] = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        ivf.IVF.build(vectors(spark, sf), lists).save(_STORED[key])
    return ivf.IVF.load(spark, _STORED[key])


_STORED: dict = {}


@query("ivf_list_stats", f"WITH {V}, {CENTROIDS}, {ASSIGNED} SELECT list_id, count(*) AS vectors FROM a GROUP BY list_id")
def ivf_stats(spark, sf):
    return index(spark, sf).stats()


def _ivf(n, where=""):
    return f"WITH {Q}, {V}, {CENTROIDS}, {ASSIGNED}, {PROBES.format(n=n)}, t AS (SELECT id, list_distance(v, q) AS d FROM a, q WHERE list_id IN (SELECT list_id FROM p) {where} ORDER BY d, id LIMIT 10) SELECT id, round(d, 6) + 0.0 AS distance, row_number() OVER (ORDER BY d, id) AS rank FROM t"


def _hits(df):
    return df.select("id", r6(F.col("distance")).alias("distance"), "rank")


for _n in (1, 4, LISTS):

    def _run(spark, sf, n=_n):
        return _hits(index(spark, sf).search(vector_of(spark, sf), 10, n))

    query("ivf_search_all" if _n == LISTS else f"ivf_search_nprobe{_n}", _ivf(_n))(_run)


@query("ivf_add", _ivf(4))
def ivf_add(spark, sf):
    """Built on nine labels, the tenth added with the centroids frozen."""
    rows = vectors(spark, sf)
    centroids = ivf.first_k(rows, LISTS)
    part = ivf.IVF(ivf.IVF.assign(rows.where("label < 9"), centroids), centroids, None, spark)
    return _hits(part.add(rows.where("label = 9")).search(vector_of(spark, sf), 10, 4))


@query("ivf_delete", _ivf(4, "AND label_of <> 3").replace("any_value(v) AS v,", "any_value(v) AS v, any_value(label) AS label_of,"))
def ivf_delete(spark, sf):
    rows = vectors(spark, sf)
    return _hits(index(spark, sf).delete(rows.where("label = 3")).search(vector_of(spark, sf), 10, 4))


@query(
    "ivf_batch",
    f"WITH {V}, {QS}, {CENTROIDS}, {ASSIGNED}, p AS (SELECT query_id, q, list_id FROM qs, c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_distance(c, q), list_id) <= 4), t AS (SELECT query_id, id, list_distance(v, q) AS d FROM a JOIN p USING (list_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM t) SELECT query_id, id, round(d, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10",
)
def ivf_batch(spark, sf):
    return _pairs(index(spark, sf).search_batch(query_set(spark, sf), 10, 4))


@query("ivf_recall")
def ivf_recall(spark, sf):
    """Recall@10 of k-means lists at three quarters of the probes, by query: 0.9 or more in all."""
    rows, qs = vectors(spark, sf), query_set(spark, sf)
    found = ivf.IVF.build(rows, LISTS, method="kmeans").search_batch(qs, 10, 3 * LISTS // 4)
    return ivf.recall(search.knn_batch(rows, qs, 10), found)
