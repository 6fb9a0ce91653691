"""Top-k strategies over rows (id, score), for one result or by query.

All order by score, highest first, then id.  `by` names the columns of a
query; without it all rows are one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable
from .ranges import ranked_by_range
from .search import clamp_k

DEFAULT_THRESHOLD, SIMILAR, SAMPLE, SPREAD = 0.5, 0.8, 100, 0.5
#: Candidates of a query that a round of the greedy choice holds.
POOL = 1000


def _rank(df: DataFrame, by: list[str], k: int | None) -> DataFrame:
    order = [F.col("score").desc(), F.col("id")]
    if not by:
        if k is None:
            return ranked_by_range(df, order)
        # without a key: the limit first, so only k rows meet for their ranks
        top = df.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return out.where(F.col("rank") <= k) if k is not None else out


def by_score(df: DataFrame, k: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    return _rank(df, list(by), clamp_k(k))


def by_threshold(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    return _rank(df.where(F.col("score") >= threshold), list(by), None)


def hybrid(df: DataFrame, k: int | None = None, threshold: float = DEFAULT_THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    return by_score(df.where(F.col("score") >= threshold), k, by)


def adaptive(df: DataFrame, k: int | None = None, by: tuple[str, ...] = (), position: str = "pos", sample: int = SAMPLE, spread: float = SPREAD) -> DataFrame:
    """Threshold mean - spread * deviation of the first `sample` rows by position; no more rows than that: plain top-k."""
    keys = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where(F.col("__n") <= sample)
    stats = first.groupBy(*keys).agg(F.avg("score").alias("__m"), F.stddev_pop("score").alias("__s"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("__c"))
    limits = stats.join(total, keys).select(*keys, F.when(F.col("__c") > sample, F.col("__m") - spread * F.col("__s")).alias("__t"))
    kept = rows.join(F.broadcast(limits) if not by else limits, keys).where(F.col("__t").isNull() | (F.col("score") >= F.col("__t")))
    return _rank(kept.select(*df.columns), list(by), clamp_k(k))


def diverse(df: DataFrame, k: int | None = None, by: tuple[str, ...] = (), similar: float = SIMILAR, data: str = "data") -> DataFrame:
    """Greedy: best first, then whoever is at most `similar` to all chosen; may return fewer than k.

    A round folds over the best POOL rows of each query that may still be chosen.
    Queries with rows left and under k chosen have another one, over the rows at
    most `similar` to all these; it chooses one row at least, so there are k rounds at most,
    and one where pools are not full of likenesses.  With k or fewer rows all of them stay.
    Rounds run when this is called; k rows of a query are kept between them, as a checkpoint."""
    from ..functions.distance import similarity

    k = clamp_k(k)
    keys = [f"__k{i}" for i in range(max(1, len(by)))]
    values = [F.col(c) for c in by] or [F.lit(0)]
    rows = df.select(*(v.alias(n) for v, n in zip(values, keys, strict=True)), "id", "score", F.col(data).alias("data"))
    pool = max(POOL, k + 1)
    item = F.struct(F.col("__n").alias("n"), "id", "score", "data")
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"), F.col("data"))
    near = lambda chosen, x: F.exists(chosen, lambda y: similarity(y.data, x, "cosine") > similar)

    def step(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) >= k) | near(acc, x.data), acc).otherwise(F.concat(acc, F.array(x)))

    def pools(left: DataFrame, skip: Column) -> DataFrame:
        best = left.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= pool + k)
        return best.where((F.col("__n") > skip) & (F.col("__n") <= skip + pool)).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))

    def state(chosen: Column) -> list[Column]:
        return [*map(F.col, keys), chosen.alias("chosen"), ((F.size("c") >= pool) & (F.size(chosen) < k)).alias("open")]

    empty = F.slice(F.col("c"), 1, 0)
    first = F.when(F.size("c") <= k, F.col("c")).otherwise(F.aggregate("c", empty, step))
    now = durable(pools(rows, F.lit(0)).select(*state(first)))
    done = now.where(~F.col("open"))
    while not (now := now.where("open")).isEmpty():
        # chosen rows that are not even like themselves (without a length) come first again
        again = F.size(F.filter("chosen", lambda y: similarity(y.data, y.data, "cosine") <= similar))
        been = now.select(*(F.col(c).alias(f"{c}b") for c in keys), "chosen", again.alias("again"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}b")) for c in keys]
        left = rows.join(been, same).where(~near(F.col("chosen"), F.col("data"))).select(*keys, "id", "score", "data", "again")
        more = pools(left, F.col("again"))
        after = more.select(*(F.col(c).alias(f"{c}b") for c in keys), "c")
        both = now.join(after, same, "left").withColumn("c", F.coalesce("c", F.slice("chosen", 1, 0)))
        now = durable(both.select(*state(F.aggregate("c", F.col("chosen"), step))))
        done = done.unionByName(now.where(~F.col("open")))
    out = done.select(*(F.col(n).alias(c) for n, c in zip(keys, by)), F.posexplode("chosen").alias("p", "x"))
    return out.select(*by, F.col("x.id").alias("id"), F.col("x.score").alias("score"), (F.col("p") + 1).cast("bigint").alias("rank"))


STRATEGIES = {"topk": by_score, "threshold": by_threshold, "hybrid": hybrid, "diverse": diverse, "adaptive": adaptive}


def select(df: DataFrame, strategy: str = "topk", **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    return STRATEGIES[strategy](df, **options)


def truncate(df: DataFrame, k: int, position: str = "pos") -> DataFrame:
    return df.orderBy(position).limit(k)
