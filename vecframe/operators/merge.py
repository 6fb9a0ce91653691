"""Merging result sets: rank fusion, score normalisation, coordinator merge.

Sets are one DataFrame with set_no, pos, id, distance, score, rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import ranked

MAX_RESULTS, RRF = 1000, 60
#: Other names of the strategies.
ALIASES = {"rank_fusion": "rank", "score_fusion": "score", "reciprocal_rank_fusion": "reciprocal"}


def flatten(sets: list[DataFrame]) -> DataFrame:
    """The sets as one, with their number."""
    out = None
    for i, s in enumerate(sets):
        s = s.withColumn("set_no", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def dedup(df: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each key by set and position."""
    w = Window.partitionBy(key).orderBy("set_no", "pos")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def normalise(df: DataFrame, method: str | None) -> DataFrame:
    """Scores by min_max, z_score (population) or unit_vector, over all rows: one aggregate of a row, joined back."""
    if method in (None, "none"):
        return df
    s = F.col("score")
    stats = df.agg(F.min(s).alias("__lo"), F.max(s).alias("__hi"), F.avg(s).alias("__m"), F.stddev_pop(s).alias("__sd"), F.sqrt(F.sum(s * s)).alias("__len"))
    both = df.crossJoin(F.broadcast(stats))
    new = {
        "min_max": F.when(F.col("__hi") == F.col("__lo"), 0.5).otherwise((s - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))),
        "z_score": F.when(F.col("__sd") == 0, 0.0).otherwise((s - F.col("__m")) / F.col("__sd")),
        "unit_vector": F.when(F.col("__len") == 0, 0.0).otherwise(s / F.col("__len")),
    }
    if method not in new:
        raise ValueError(f"unknown normaliser: {method}")
    return both.withColumn("score", new[method]).select(*df.columns)


def _top(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    top = df.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def reciprocal(df: DataFrame, constant: int = RRF, most: int = MAX_RESULTS) -> DataFrame:
    """Sum of 1/(rank + constant) by id, over the sets before any dedup; the row shown is the one of the least rank."""
    rest = [c for c in ("distance", "set_no", "pos") if c in df.columns]
    one = df.groupBy("id").agg(F.sum(1.0 / (F.col("rank") + constant)).alias("score"), F.min_by(F.struct(*rest), F.struct("rank", "set_no", "pos")).alias("__r"))
    return _top(one.select("id", "score", *(F.col(f"__r.{c}").alias(c) for c in rest)), [F.desc("score"), F.col("id")], most)


def merge(df: DataFrame, strategy: str = "score", normaliser: str | None = None, unique: bool = True, most: int = MAX_RESULTS, constant: int = RRF) -> DataFrame:
    strategy = ALIASES.get(strategy, strategy)
    if strategy == "reciprocal":
        return reciprocal(df, constant, most)
    rows = normalise(dedup(df) if unique else df, normaliser)
    if strategy == "weighted":
        rows = rows.withColumn("score", F.when(F.col("rank") >= 1, F.col("score") / F.col("rank")))
    order = {"rank": [F.col("rank"), F.col("id")], "distance": [F.col("distance"), F.col("id")], "score": [F.desc_nulls_last("score"), F.col("id")], "weighted": [F.desc_nulls_last("score"), F.col("id")]}
    if strategy not in order:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "rank":
        rows = rows.withColumnRenamed("rank", "__old")
        return _top(rows, [F.col("__old"), F.col("id")], most).drop("__old")
    return _top(rows.drop("rank"), order[strategy], most)


def weighted_sets(df: DataFrame, weights: list[float], **kw) -> DataFrame:
    """Scores times the weight of their set, then merged; sets without a weight are an error."""
    table = F.array(*(F.lit(float(w)) for w in weights))
    bad = (F.col("set_no") < 0) | (F.col("set_no") >= len(weights))
    factor = F.when(bad, F.raise_error(F.lit("a set has no weight")).cast("double")).otherwise(F.get(table, F.col("set_no")))
    return merge(df.withColumn("score", F.col("score") * factor), **kw)


def hybrid(df: DataFrame, distance_weight: float = 0.5, score_weight: float = 0.5, invert_distance: bool = False, most: int = MAX_RESULTS) -> DataFrame:
    """wd d/(d+1) + ws s/(s+1), highest first; invert_distance uses 1/(d+1)."""
    d, s = F.col("distance"), F.col("score")
    near = 1.0 / (d + 1.0) if invert_distance else d / (d + 1.0)
    rows = dedup(df).withColumn("score", distance_weight * near + score_weight * (s / (s + 1.0)))
    return _top(rows.drop("rank"), [F.desc("score"), F.col("id")], most)


def coordinator(df: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Least distance by id, nearest k, and the blended score of distance and rank."""
    from ..functions.distance import score_rank_blend

    one = df.groupBy(*by, "id").agg(F.min("distance").alias("distance"))
    out = ranked(one, k, list(by))
    return out.withColumn("score", score_rank_blend(F.col("distance"), F.col("rank") - 1))


def with_sources(merged: DataFrame, df: DataFrame, eps: float = 0.001) -> DataFrame:
    """merged and `sources`: sorted nodes that gave the id at about its distance."""
    hits = merged.alias("m").join(df.select("id", F.col("distance").alias("__d"), "node_id"), "id").where(F.abs(F.col("distance") - F.col("__d")) < eps)
    return merged.join(hits.groupBy("id").agg(F.sort_array(F.collect_set("node_id")).alias("sources")), "id", "left")


def collapse_near_ties(df: DataFrame, eps: float = 0.001, k: int = MAX_RESULTS) -> DataFrame:
    """In order of distance and id, drop a row within eps of the last one kept.

    A pass folds over the nearest 10 k rows; while fewer than k are kept and rows are left, another one
    goes on from the last one kept. Passes run when this is called."""
    item = F.struct("distance", "id")
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x.distance - F.element_at(acc, -1).distance < eps), acc).otherwise(F.concat(acc, F.array(x)))
    rows = df.select("distance", "id")
    rest, kept = rows, []
    while True:
        one = rest.orderBy("distance", "id").limit(10 * k).agg(F.array_sort(F.collect_list(item)).alias("c"))
        size, got = one.select(F.size("c"), F.slice(F.aggregate("c", F.slice(F.col("c"), 1, 0), step), 1, k - len(kept))).first()
        kept += got
        if size < 10 * k or len(kept) >= k:
            break
        last = F.lit(kept[-1].distance)
        # what is not a number comes last and is kept: those seen come first again
        rest = rows.where((F.col("distance") >= last) & (F.col("distance") - last >= eps)).orderBy("distance", "id").offset(sum(x.distance != x.distance for x in kept))
    return df.sparkSession.createDataFrame([(x.distance, x.id) for x in kept], rows.schema).orderBy("distance", "id")


def merge_batches(batches: list[DataFrame], k: int) -> DataFrame:
    return coordinator(flatten(batches), k)


def valid_results(df: DataFrame) -> Column:
    return F.col("id").isNotNull() & (F.length("id") > 0) & F.col("distance").between(0, 2)
