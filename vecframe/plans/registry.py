"""All queries over the driver's tables, and the SQL they are held against.

A query is registered with its DuckDB text where SQL can say it; the two are
written apart, so one checks the other.  Doubles are rounded to six places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as id, data, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("data"), F.col("label").cast("bigint").alias("label"))


def vector_of(spark: SparkSession, sf_dir: str, id_: int = 0) -> list[float]:
    """One vector, as the literal of a single query."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == id_).select("embedding").first()[0])


def r6(c):
    """Rounded, and without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


#: SQL that several oracles share.
Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"
DISTANCE = {
    "euclidean": "list_distance(v, q)",
    "cosine": "list_cosine_distance(v, q)",
    "manhattan": "list_sum(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2])))",
    "dotproduct": "-list_inner_product(v, q)",
    "hamming": "list_sum(list_transform(list_zip(v, q), lambda p: CASE WHEN p[1] <> p[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))",
    "jaccard": "(1.0::DOUBLE - list_sum(list_transform(list_zip(v, q), lambda p: CASE WHEN p[1] > 0 AND p[2] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / list_sum(list_transform(list_zip(v, q), lambda p: CASE WHEN p[1] > 0 OR p[2] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))",
}

from . import aggregates, filtering, nearest, ranking, routing  # noqa: E402, F401
