"""Distances, similarities and scores between array columns, as Column builders.

Arithmetic is in double whatever the element type.  Arrays of different
lengths have no distance: builders give NULL for them, so a `where` drops
such rows; `strict=True` raises instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "manhattan", "dotproduct", "hamming", "jaccard")
DEFAULT_METRIC = "euclidean"


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def vector(values) -> Column:
    """A literal array of doubles."""
    return F.array(*(F.lit(float(x)) for x in values))


def _sum(v: Column, q: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(v, q, f), F.lit(0.0), lambda a, x: a + x)


def inner_product(v: Column, q: Column) -> Column:
    return _sum(as_double(v), as_double(q), lambda x, y: x * y)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda a, x: a + x * x))


def normalize(v: Column) -> Column:
    """v over its L2 norm; NULL for an empty or zero vector."""
    n = norm(v)
    return F.when((F.size(v) > 0) & (n > 0), F.transform(as_double(v), lambda x: x / n))


def _euclidean(v, q):
    return F.sqrt(_sum(v, q, lambda x, y: (x - y) * (x - y)))


def cosine_of(product: Column, a: Column, b: Column) -> Column:
    """The cosine distance from the product and the two norms; 1 where a norm is 0."""
    return F.when((a == 0) | (b == 0), 1.0).otherwise(1.0 - product / (a * b))


def _cosine(v, q):
    return cosine_of(_sum(v, q, lambda x, y: x * y), norm(v), norm(q))


def _jaccard(v, q):
    both = _sum(v, q, lambda x, y: F.when((x > 0) & (y > 0), 1.0).otherwise(0.0))
    some = _sum(v, q, lambda x, y: F.when((x > 0) | (y > 0), 1.0).otherwise(0.0))
    return F.when(some == 0, 0.0).otherwise(1.0 - both / some)


_BUILD: dict[str, Callable] = {
    "euclidean": _euclidean,
    "cosine": _cosine,
    "manhattan": lambda v, q: _sum(v, q, lambda x, y: F.abs(x - y)),
    "dotproduct": lambda v, q: -_sum(v, q, lambda x, y: x * y),
    "hamming": lambda v, q: _sum(v, q, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)),
    "jaccard": _jaccard,
}


def metric_name(metric: str | None) -> str:
    name = metric or DEFAULT_METRIC
    if name not in _BUILD:
        raise ValueError(f"unknown metric: {metric}")
    return name


def distance(v: Column, q: Column, metric: str | None = None, strict: bool = False) -> Column:
    d = _BUILD[metric_name(metric)](as_double(v), as_double(q)) + F.lit(0.0)
    same = F.size(v) == F.size(q)
    return F.when(same, d).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("double")) if strict else F.when(same, d)


def similarity(v: Column, q: Column, kind: str = "angular") -> Column:
    """Pairwise similarity; 0 for NULL, different lengths or a zero norm."""
    if kind in ("angular", "cosine"):
        d = norm(v) * norm(q)
        s = F.when(d > 0, inner_product(v, q) / d)
    elif kind in ("euclidean", "manhattan"):
        s = 1.0 / (1.0 + distance(v, q, kind))
    else:
        raise ValueError(f"unknown similarity: {kind}")
    return F.coalesce(F.when(F.size(v) == F.size(q), s), F.lit(0.0))


def score_metric(d: Column, metric: str | None = None, inverted_dot: bool = False) -> Column:
    """1/(1+d); cosine: 1-d; dot product: 1 plus the product (1 minus it with inverted_dot)."""
    name = metric_name(metric)
    if name == "cosine":
        return 1.0 - d
    if name == "dotproduct":
        return 1.0 + d if inverted_dot else 1.0 - d
    return 1.0 / (1.0 + d)


def score_decay(d: Column) -> Column:
    return F.when(d <= 0, 1.0).otherwise(F.exp(-d / 10.0))


def score_rank_blend(d: Column, rank0: Column) -> Column:
    """0.7 (1 - d/2) + 0.3 / (rank + 1), rank from 0."""
    return 0.7 * (1.0 - d / 2.0) + 0.3 / (rank0 + 1.0)


def metric_catalogue(spark: SparkSession):
    """Range of each metric; of the dot product, the greater one is the better (its distance is minus it)."""
    rows = [(m, None if m == "dotproduct" else 0.0, {"cosine": 2.0, "jaccard": 1.0}.get(m), m != "dotproduct") for m in METRICS]
    return spark.createDataFrame(rows, "metric string, lowest double, highest double, lower_is_better boolean")


def register(spark: SparkSession) -> None:
    """The distances as SQL functions vf_<metric>(a, b); Catalyst inlines their bodies."""
    zipped = "aggregate(zip_with(cast(a as array<double>), cast(b as array<double>), (x, y) -> {f}), 0D, (s, t) -> s + t)"
    bodies = {
        "euclidean": "sqrt(" + zipped.format(f="(x - y) * (x - y)") + ")",
        "manhattan": zipped.format(f="abs(x - y)"),
        "dotproduct": "-" + zipped.format(f="x * y"),
        "hamming": zipped.format(f="if(x <> y, 1D, 0D)"),
        "inner_product": zipped.format(f="x * y"),
    }
    n = "sqrt(aggregate(cast({v} as array<double>), 0D, (s, t) -> s + t * t))"
    bodies["cosine"] = f"if({n.format(v='a')} = 0 or {n.format(v='b')} = 0, 1D, 1D - {zipped.format(f='x * y')} / nullif({n.format(v='a')} * {n.format(v='b')}, 0D))"
    some = zipped.format(f="if(x > 0 or y > 0, 1D, 0D)")
    bodies["jaccard"] = f"if({some} = 0, 0D, 1D - {zipped.format(f='if(x > 0 and y > 0, 1D, 0D)')} / nullif({some}, 0D))"
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vf_{name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN if(size(a) = size(b), {body}, NULL)")
