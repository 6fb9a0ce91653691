"""Inserts as they come from HTTP, WebSocket and Redis clients, parsed to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR = "struct<id:string,vector:array<float>,metadata:map<string,string>>"


def http_body(body: Column) -> Column:
    """array of vectors from one JSON object or an array of them."""
    one = F.from_json(body, VECTOR)
    return F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{VECTOR}>")).otherwise(F.array(one))


def from_http(df: DataFrame, column: str = "value") -> DataFrame:
    rows = df.select(F.explode(http_body(F.col(column))).alias("v"))
    return rows.select("v.id", F.col("v.vector").alias("data"), F.coalesce("v.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def from_websocket(df: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes {type, data}: insert_vector with one, insert_batch with {vectors: [...]}."""
    kind = F.get_json_object(column, "$.type")
    one = F.array(F.from_json(F.get_json_object(column, "$.data"), VECTOR))
    many = F.from_json(F.coalesce(F.get_json_object(column, "$.data.vectors"), F.get_json_object(column, "$.data")), f"array<{VECTOR}>")
    rows = df.where(kind.isin("insert_vector", "insert_batch")).select(F.explode(F.when(kind == "insert_vector", one).otherwise(many)).alias("v"))
    return rows.select("v.id", F.col("v.vector").alias("data"), F.coalesce("v.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def from_redis(df: DataFrame, column: str = "value") -> DataFrame:
    """VECTOR.ADD id x,y,... and VECTOR.MADD id x,y,... id x,y,...; other commands give no rows."""
    words = F.split(F.trim(F.col(column)), r"\s+")
    adds = F.upper(F.get(words, F.lit(0))).isin("VECTOR.ADD", "VECTOR.MADD")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1, F.lit(2)), lambda i: F.struct(F.get(words, i).alias("id"), F.transform(F.split(F.get(words, i + 1), ","), lambda x: x.try_cast("float")).alias("data")))
    return df.where(adds & (F.size(words) >= 3)).select(F.explode(pairs).alias("v")).select("v.id", "v.data", F.create_map().cast("map<string,string>").alias("metadata"))


def redis_reply(column: Column) -> Column:
    """What a client gets for a command line: PONG, OK, the number of arguments, or an error."""
    words = F.split(F.trim(column), r"\s+")
    name, n = F.upper(F.get(words, F.lit(0))), F.size(words) - 1
    wrong = lambda c: F.lit(f"-ERR wrong number of arguments for '{c}' command\r\n")
    known = F.when(name == "PING", F.lit("+PONG\r\n")).when(name == "VECTOR.ADD", F.when(n < 1, wrong("vector.add")).otherwise(F.lit("+OK\r\n")))
    known = known.when(name == "VECTOR.MADD", F.when(n < 1, wrong("vector.madd")).otherwise(F.concat(F.lit(":"), n.cast("string"), F.lit("\r\n"))))
    return F.when(F.trim(column) == "", F.lit("-ERR empty command\r\n")).otherwise(F.coalesce(known, F.concat(F.lit("-ERR unknown command '"), name, F.lit("'\r\n"))))


def respond(results: DataFrame, by: str = "query_id", pretty: bool = False) -> DataFrame:
    """One JSON body a query: {"results": [...], "total": n}."""
    cols = [c for c in results.columns if c != by]
    rows = results.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in cols if c != "rank")))).alias("results"))
    return rows.select(by, F.to_json(F.struct("results", F.size("results").alias("total")), {"pretty": str(pretty).lower()}).alias("body"))
