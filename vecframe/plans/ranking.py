"""Top-k strategies and rank fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import merge as M
from ..operators import search, topk
from .registry import DISTANCE, Q, V, query, r6, vector_of, vectors

S = f"s AS (SELECT id, label, 1 / (1 + {DISTANCE['euclidean']}) AS score FROM v, q)"


def scored(spark, sf):
    rows = search.with_distance(vectors(spark, sf), vector_of(spark, sf))
    return rows.select("id", "label", "data", D.score_metric(F.col("distance")).alias("score"))


def _shown(df, *by):
    return df.select(*by, "id", r6(F.col("score")).alias("score"), "rank")


def _topk(where, k):
    limit = f"LIMIT {k}" if k else ""
    return f"WITH {Q}, {V}, {S}, t AS (SELECT id, score FROM s {where} ORDER BY score DESC, id {limit}) SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM t"


@query("topk_score", _topk("", 25))
def by_score(spark, sf):
    return _shown(topk.by_score(scored(spark, sf), 25))


@query("topk_threshold", _topk("WHERE score >= 0.43", None))
def by_threshold(spark, sf):
    return _shown(topk.by_threshold(scored(spark, sf), 0.43))


@query("topk_hybrid", _topk("WHERE score >= 0.43", 15))
def hybrid(spark, sf):
    return _shown(topk.hybrid(scored(spark, sf), 15, 0.43))


@query("topk_adaptive", f"WITH {Q}, {V}, {S}, f AS (SELECT score FROM s ORDER BY id LIMIT 100), l AS (SELECT avg(score) - 0.5 * stddev_pop(score) AS lim FROM f), t AS (SELECT id, score FROM s, l WHERE score >= lim ORDER BY score DESC, id LIMIT 200) SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM t")
def adaptive(spark, sf):
    return _shown(topk.adaptive(scored(spark, sf), 200, position="id"))


@query("topk_by_group", f"WITH {Q}, {V}, {S}, r AS (SELECT label, id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM s) SELECT label, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def by_group(spark, sf):
    return _shown(topk.by_score(scored(spark, sf), 5, ("label",)), "label")


# greedy: the best row at most 0.8 like all chosen ones, five times
_GREEDY = """
WITH RECURSIVE {Q}, {V}, {S}, x AS (SELECT s.label, s.id, s.score, v.v, row_number() OVER (PARTITION BY s.label ORDER BY s.score DESC, s.id) AS n, count(*) OVER (PARTITION BY s.label) AS c FROM s JOIN v USING (id)),
g AS (SELECT label, n, [v] AS chosen, id, score, 1::BIGINT AS rank FROM x WHERE n = 1
UNION ALL SELECT label, n, list_append(chosen, v), id, score, rank + 1 FROM (
  SELECT x.*, g.chosen, g.rank, row_number() OVER (PARTITION BY x.label ORDER BY x.n) AS pick FROM g JOIN x ON x.label = g.label AND x.n > g.n
  WHERE g.rank < 5 AND (x.c <= 5 OR len(list_filter(g.chosen, lambda y: list_cosine_similarity(y, x.v) > 0.8)) = 0)) WHERE pick = 1)
SELECT label, id, round(score, 6) AS score, rank FROM g"""


@query("topk_diverse", _GREEDY.format(Q=Q, V=V, S=S))
def diverse(spark, sf):
    return _shown(topk.diverse(scored(spark, sf), 5, ("label",)), "label")


# three result sets for one query: by three metrics, the nearest 40 each
_ONE = "SELECT {n} AS set_no, id, d AS distance, 1 / (1 + d) AS score, rank, rank AS pos FROM (SELECT id, {d} AS d, row_number() OVER (ORDER BY {d}, id) AS rank FROM v, q) WHERE rank <= 40"
SETS = "sets AS (" + " UNION ALL ".join(_ONE.format(n=i, d=DISTANCE[m]) for i, m in enumerate(("euclidean", "cosine", "manhattan"))) + ")"
UNIQUE = "u AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY id ORDER BY set_no, pos) = 1)"


def sets(spark, sf):
    rows, q = vectors(spark, sf), vector_of(spark, sf)
    parts = []
    for m in ("euclidean", "cosine", "manhattan"):
        one = search.knn(rows, q, 40, m).select("id", "distance", (1.0 / (1.0 + F.col("distance"))).alias("score"), "rank", F.col("rank").alias("pos"))
        parts.append(one)
    return M.flatten(parts)


def _merged(order, score="score", source="u", k=50):
    return f"WITH {Q}, {V}, {SETS}, {UNIQUE}, m AS (SELECT id, rank AS old, distance, {score} AS score FROM {source}), t AS (SELECT * FROM m ORDER BY {order} LIMIT {k}) SELECT id, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY {order}) AS rank FROM t"


@query("merge_rank", _merged("old, id"))
def merge_rank(spark, sf):
    return _shown(M.merge(sets(spark, sf), "rank", most=50))


@query("merge_distance", _merged("distance, id"))
def merge_distance(spark, sf):
    return _shown(M.merge(sets(spark, sf), "distance", most=50))


@query("merge_score", _merged("score DESC, id"))
def merge_score(spark, sf):
    return _shown(M.merge(sets(spark, sf), "score", most=50))


@query("merge_weighted", _merged("score DESC, id", "score / rank"))
def merge_weighted(spark, sf):
    return _shown(M.merge(sets(spark, sf), "weighted", most=50))


@query("merge_rrf", f"WITH {Q}, {V}, {SETS}, m AS (SELECT id, round(sum(1.0 / (rank + 60)), 12) AS score FROM sets GROUP BY id), t AS (SELECT * FROM m ORDER BY score DESC, id LIMIT 500) SELECT id, round(score, 6) AS score FROM t")
def merge_rrf(spark, sf):
    return M.reciprocal(sets(spark, sf), most=500).select("id", r6(F.col("score")).alias("score"))


@query("merge_hybrid", _merged("score DESC, id", "0.5 * (distance / (distance + 1)) + 0.5 * (score / (score + 1))"))
def merge_hybrid(spark, sf):
    return _shown(M.hybrid(sets(spark, sf), most=50))


@query("merge_set_weights", _merged("score DESC, id", "score * CASE set_no WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END"))
def merge_set_weights(spark, sf):
    return _shown(M.weighted_sets(sets(spark, sf), [0.5, 0.3, 0.2], most=50))


def _norm(name, sql):
    @query(f"norm_{name}", _merged("score DESC, id", sql))
    def run(spark, sf):
        return _shown(M.merge(sets(spark, sf), "score", {"minmax": "min_max", "zscore": "z_score", "unit": "unit_vector"}[name], most=50))


_norm("minmax", "(score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ())")
_norm("zscore", "(score - avg(score) OVER ()) / stddev_pop(score) OVER ()")
_norm("unit", "score / sqrt(sum(score * score) OVER ())")

_COORD = f"WITH {Q}, {V}, {SETS}, o AS (SELECT id, min(distance) AS d FROM sets GROUP BY id), r AS (SELECT id, d, row_number() OVER (ORDER BY d, id) AS rank FROM o)"


@query("coord_merge", f"{_COORD} SELECT id, round(d, 6) + 0.0 AS distance, rank, round(0.7 * (1 - d / 2) + 0.3 / rank, 6) + 0.0 AS score FROM r WHERE rank <= 20")
def coord(spark, sf):
    return M.coordinator(sets(spark, sf), 20).select("id", r6(F.col("distance")).alias("distance"), "rank", r6(F.col("score")).alias("score"))


@query("merge_sources", f"{_COORD} SELECT id, array_to_string(list_sort(list(DISTINCT 'node' || set_no)), ',') AS sources FROM r JOIN sets USING (id) WHERE r.rank <= 20 AND abs(r.d - sets.distance) < 0.001 GROUP BY id")
def sources(spark, sf):
    rows = sets(spark, sf).withColumn("node_id", F.concat(F.lit("node"), F.col("set_no").cast("string")))
    return M.with_sources(M.coordinator(rows, 20), rows).select("id", F.array_join("sources", ",").alias("sources"))


@query("near_ties", f"WITH RECURSIVE {Q}, {V}, {SETS}, o AS (SELECT id, distance AS d, row_number() OVER (ORDER BY distance, id) AS n FROM sets), g AS (SELECT id, d, n, 1 AS k FROM o WHERE n = 1 UNION ALL SELECT * FROM (SELECT o.id, o.d, o.n, g.k + 1 FROM g JOIN o ON o.n > g.n AND o.d - g.d >= 0.001 WHERE g.k < 50 ORDER BY o.n LIMIT 1)) SELECT id, round(d, 6) + 0.0 AS distance FROM g")
def near_ties(spark, sf):
    return M.collapse_near_ties(sets(spark, sf), 0.001, 50).select("id", r6(F.col("distance")).alias("distance"))
