"""Hash, assignment, topology and store queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import buffer, stateful
from ..operators import topology as T
from ..sources import requests, store
from ..sources.shared import shared_folder
from .registry import query, r6, table, vectors

CLUSTERS, NODES = 256, ["node-a", "node-b", "node-c"]
#: SQL: bytes of a text (ASCII) and of a vector's floats, little-endian; the FNV folds over them.
_TEXT = "list_transform(range(1, len({s}) + 1), lambda i: CAST(ascii(substr({s}, i, 1)) AS UBIGINT))"
_BITS = "list_transform({v}, lambda x: CAST(CAST(x AS BIT) AS UINTEGER))"
_BYTES = "flatten(list_transform(" + _BITS + ", lambda b: [CAST(b & 255 AS UBIGINT), CAST((b >> 8) & 255 AS UBIGINT), CAST((b >> 16) & 255 AS UBIGINT), CAST((b >> 24) & 255 AS UBIGINT)]))"
_FNV32 = "list_reduce(list_prepend(2166136261::UBIGINT, {b}), lambda h, b: (xor(h, b) * 16777619::UBIGINT) & 4294967295::UBIGINT)"
_FNV64 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform({b}, lambda z: CAST(z AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_FNV1 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform({b}, lambda z: CAST(z AS HUGEINT))), lambda h, b: xor((h * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, b))"


def _fnv32_text(s):
    return _FNV32.format(b=_TEXT.format(s=s))


VEC = _BYTES.format(v="embedding")
CLUSTERED = f"cl AS (SELECT vec_id AS id, CAST({_FNV32.format(b=VEC)} % {CLUSTERS} AS BIGINT) AS cluster_id FROM embeddings)"


def clustered(spark, sf):
    return vectors(spark, sf).withColumn("cluster_id", H.cluster_of_vector(F.col("data"), CLUSTERS))


@query("hash_fnv32_id", f"SELECT vec_id AS id, CAST({_fnv32_text('CAST(vec_id AS VARCHAR)')} AS BIGINT) AS h FROM embeddings")
def fnv32_id(spark, sf):
    return vectors(spark, sf).select("id", H.fnv1a32(H.text_bytes(F.col("id").cast("string"))).alias("h"))


@query("hash_fnv32_vec", f"SELECT vec_id AS id, CAST({_FNV32.format(b=VEC)} AS BIGINT) AS h FROM embeddings")
def fnv32_vec(spark, sf):
    return vectors(spark, sf).select("id", H.fnv1a32(H.float_bytes(F.col("data"))).alias("h"))


@query("hash_fnv64_vec", f"SELECT vec_id AS id, CAST({_FNV64.format(b=VEC)} AS VARCHAR) AS h FROM embeddings")
def fnv64_vec(spark, sf):
    return vectors(spark, sf).select("id", H.fnv1a64(H.float_bytes(F.col("data"))).cast("string").alias("h"))


@query("hash_fnv1_64_vec", f"SELECT vec_id AS id, CAST({_FNV1.format(b=VEC)} AS VARCHAR) AS h FROM embeddings")
def fnv1_vec(spark, sf):
    return vectors(spark, sf).select("id", H.fnv1_64(H.float_bytes(F.col("data"))).cast("string").alias("h"))


_BIG = "list_reduce(list_prepend('', list_transform(embedding, lambda x: lpad(hex(CAST(CAST(x AS BIT) AS UINTEGER)), 8, '0'))), lambda a, b: a || b)"


@query(
    "hash_sha1_fold",
    f"WITH h AS (SELECT vec_id AS id, sha1(encode(CAST(vec_id AS VARCHAR)) || unhex({_BIG})) AS d FROM embeddings) SELECT id, CAST(list_reduce(list_prepend(0::UBIGINT, list_transform(range(0, 40), lambda i: CAST(ascii(substr(d, i + 1, 1)) AS UBIGINT) << CAST(i % 32 AS INT))), lambda a, b: (a + b) & 4294967295::UBIGINT) % {CLUSTERS} AS BIGINT) AS cluster_id FROM h",
)
def sha1(spark, sf):
    return vectors(spark, sf).select("id", H.sha1_fold(F.col("id").cast("string"), F.col("data"), CLUSTERS).alias("cluster_id"))


@query("assign_modulo_range", f"WITH h AS (SELECT vec_id AS id, {_FNV64.format(b=VEC)} AS h FROM embeddings) SELECT id, CAST(h % {CLUSTERS} AS BIGINT) AS by_modulo, least(CAST(h // (18446744073709551615::HUGEINT // {CLUSTERS}) AS BIGINT), {CLUSTERS - 1}) AS by_range FROM h")
def assign(spark, sf):
    rows = vectors(spark, sf).select("id", H.fnv1a64(H.float_bytes(F.col("data"))).alias("h"))
    return rows.select("id", H.assign(F.col("h"), CLUSTERS).alias("by_modulo"), H.assign(F.col("h"), CLUSTERS, "range").alias("by_range"))


@query("cluster_distribution", f"WITH {CLUSTERED} SELECT cluster_id, count(*) AS vectors FROM cl GROUP BY cluster_id")
def distribution(spark, sf):
    return T.cluster_distribution(clustered(spark, sf))


@query("cluster_balance", f"WITH {CLUSTERED}, n AS (SELECT count(*) AS n FROM cl GROUP BY cluster_id) SELECT round(greatest(0.0, 1.0 - stddev_pop(n) / avg(n)), 6) AS balance FROM n")
def balance(spark, sf):
    return T.cluster_balance(clustered(spark, sf)).select(r6(F.col("balance")).alias("balance"))


_RANGES = f"r AS (SELECT s AS start, least(s + 63, {CLUSTERS - 1}) AS \"end\", ['node-a', 'node-b', 'node-c'][CAST(s / 64 AS INT) % 3 + 1] AS node_id FROM range(0, {CLUSTERS}, 64) t(s))"


def ranges(spark):
    return T.ranges_frame(spark, T.uniform_ranges(CLUSTERS, NODES, factor=2))


@query("range_lookup", f"WITH {CLUSTERED}, {_RANGES} SELECT id, cluster_id, node_id FROM cl JOIN r ON cluster_id BETWEEN start AND \"end\"")
def lookup(spark, sf):
    return T.range_lookup(clustered(spark, sf), ranges(spark)).select("id", "cluster_id", "node_id")


@query("range_validate", "SELECT * FROM (VALUES (60::BIGINT, 99::BIGINT, 'overlap'), (120::BIGINT, 200::BIGINT, 'gap')) t(start, \"end\", problem)")
def range_validate(spark, sf):
    bad = [T.Range(0, 63, "a"), T.Range(60, 99, "b"), T.Range(100, 110, "c"), T.Range(120, 200, "a"), T.Range(201, 255, "b")]
    return T.validate_ranges(T.ranges_frame(spark, bad), CLUSTERS)


@query("range_balance", f"WITH {_RANGES}, n AS (SELECT count(start) AS n FROM (VALUES ('node-a'), ('node-b'), ('node-c'), ('node-d')) t(node_id) LEFT JOIN r USING (node_id) GROUP BY node_id) SELECT round(greatest(0.0, 1 - stddev_pop(n) / avg(n)), 6) AS balance FROM n")
def range_balance(spark, sf):
    nodes = spark.createDataFrame([(n,) for n in [*NODES, "node-d"]], "node_id string")
    return T.range_balance(ranges(spark), nodes).select(r6(F.col("balance")).alias("balance"))


@query("range_stats", f"WITH {_RANGES} SELECT node_id, count(*) AS ranges, CAST(sum(\"end\" - start + 1) AS BIGINT) AS clusters, round(sum(\"end\" - start + 1) * 100.0 / {CLUSTERS}, 6) AS percent FROM r GROUP BY node_id")
def range_stats(spark, sf):
    return T.range_stats(ranges(spark), CLUSTERS).select("node_id", "ranges", "clusters", r6(F.col("percent").cast("double")).alias("percent"))


_POINTS = "ring AS (SELECT CAST(" + _fnv32_text("s") + " AS BIGINT) AS h, n FROM (SELECT n, n || '#' || i AS s FROM (VALUES ('node-a'), ('node-b'), ('node-c')) t(n), range(160) x(i)))"


@query("ring_route", f"WITH {_POINTS}, k AS (SELECT vec_id AS id, CAST({_fnv32_text('CAST(vec_id AS VARCHAR)')} AS BIGINT) AS key FROM embeddings), f AS (SELECT k.id, k.key, min(ring.h) AS h FROM k LEFT JOIN ring ON ring.h >= k.key GROUP BY ALL), g AS (SELECT id, coalesce(h, (SELECT min(h) FROM ring)) AS h FROM f) SELECT id, min(n) AS node_id FROM g JOIN ring USING (h) GROUP BY id")
def ring_route(spark, sf):
    rows = vectors(spark, sf)
    return T.ring_route(rows, T.ring(NODES), H.fnv1a32(H.text_bytes(F.col("id").cast("string")))).select("id", "node_id")


def _nodes(spark):
    return spark.createDataFrame([("node-a", 0.9, "healthy"), ("node-b", 0.2, "healthy"), ("node-c", 0.5, "unhealthy")], "id string, load_score double, status string")


@query("route_vectors", f"WITH {CLUSTERED}, {_RANGES} SELECT id, CASE node_id WHEN 'node-c' THEN 'node-a' ELSE node_id END AS \"primary\" FROM cl JOIN r ON cluster_id BETWEEN start AND \"end\"")
def route(spark, sf):
    """node-c is unhealthy, so its replica node-a takes over."""
    return T.route(clustered(spark, sf), ranges(spark), _nodes(spark)).select("id", "primary")


@query("route_batch", f"WITH {CLUSTERED}, {_RANGES}, p AS (SELECT id, CASE node_id WHEN 'node-c' THEN ['node-a'] WHEN 'node-a' THEN ['node-a', 'node-b'] ELSE ['node-b', 'node-a'] END AS ns FROM cl JOIN r ON cluster_id BETWEEN start AND \"end\"), x AS (SELECT unnest(ns) AS node FROM p) SELECT node, count(*) AS vectors FROM x GROUP BY node")
def route_batch(spark, sf):
    return T.route_batch(T.route(clustered(spark, sf), ranges(spark), _nodes(spark)))


# -- store


@query("segment_assign", f"WITH {CLUSTERED} SELECT id, cluster_id, CAST((row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1) // 2 AS BIGINT) AS segment_id FROM cl")
def segment_assign(spark, sf):
    return store.segments(clustered(spark, sf), 2).select("id", "cluster_id", "segment_id")


@query("manifest_stats", f"WITH {CLUSTERED}, s AS (SELECT cluster_id, CAST((row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1) // 2 AS BIGINT) AS segment_id FROM cl) SELECT cluster_id, segment_id, count(*) AS vectors, CAST(count(*) * 256 AS BIGINT) AS bytes FROM s GROUP BY ALL")
def manifest(spark, sf):
    return store.manifest_of(store.segments(clustered(spark, sf), 2))


@query("upsert_latest", "SELECT CAST(user_id AS BIGINT) AS id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("bigint").alias("id"), "event_id", F.struct("ts", "event_id").alias("at"))
    return store.latest(e, "id", "at").select("id", "event_id")


def stored(spark, sf):
    """The vectors in a store of their own, in 16 clusters."""
    s = store.VectorStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = vectors(spark, sf).withColumns({"ts": F.lit(2), "cluster_id": H.cluster_of_vector(F.col("data"), 16)})
    s.append(rows)
    return s, rows


@query("delete_by_id", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_id(spark, sf):
    s, _ = stored(spark, sf)
    s.delete(table(spark, sf, "labels").select(F.col("doc_id").alias("id")))
    return s.ids()


@query("delete_by_filter", "SELECT vec_id AS id FROM embeddings WHERE label <> 4")
def delete_by_filter(spark, sf):
    s, _ = stored(spark, sf)
    s.delete_where(F.col("label") == 4)
    return s.ids()


@query("store_upsert", "SELECT vec_id AS id, CAST(label AS BIGINT) + CASE WHEN vec_id % 5 = 0 THEN 100 ELSE 0 END AS label FROM embeddings")
def store_upsert(spark, sf):
    """Newer rows take the place of older ones, and older ones none; compacted, so one folder a cluster is left."""
    s, rows = stored(spark, sf)
    s.upsert(rows.where("id % 5 = 0").withColumns({"ts": F.lit(3), "label": F.col("label") + 100}))
    s.upsert(rows.where("id % 7 = 0").withColumns({"ts": F.lit(1), "label": F.lit(-1).cast("bigint")}))
    s.compact()
    return s.read().select("id", "label")


@query("store_point_lookup", "SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id IN (3, 77, 199)")
def store_lookup(spark, sf):
    return stored(spark, sf)[0].get([3, 77, 199]).select("id", "label")


@query("store_segment_scan", f"WITH cl AS (SELECT vec_id AS id, CAST({_FNV32.format(b=VEC)} % 16 AS BIGINT) AS cluster_id FROM embeddings) SELECT id, cluster_id FROM cl WHERE cluster_id IN (2, 5)")
def store_segments(spark, sf):
    s, _ = stored(spark, sf)
    wanted = [r.segment for r in s.entries().where("cluster_id in (2, 5)").collect()]
    return s.read(segments=wanted).select("id", "cluster_id")


@query("manifest_table", f"WITH cl AS (SELECT CAST({_FNV32.format(b=VEC)} % 16 AS BIGINT) AS cluster_id FROM embeddings), n AS (SELECT cluster_id, count(*) AS n FROM cl GROUP BY cluster_id), e AS (SELECT n, CASE cluster_id WHEN 3 THEN 'readonly' ELSE 'active' END AS status FROM n WHERE cluster_id NOT IN (4, 9) UNION ALL SELECT 7, 'active') SELECT status, count(*) AS segments, CAST(sum(n) AS BIGINT) AS vectors FROM e GROUP BY status")
def manifest_table(spark, sf):
    """Entries added, removed, set read-only and deleted; deleted ones leave at the compact."""
    s, _ = stored(spark, sf)
    e = s.entries()
    e = store.with_status(e, ["1-3"], "readonly")
    e = store.with_status(e, ["1-4"], "deleted")
    e = store.without_entry(store.without_deleted(e), "1-9")
    e = store.with_entry(e, {"segment": "9-99", "cluster_id": 99, "vectors": 7, "dim": 64, "bytes": 7 * 256, "status": "active", "created": 9})
    return store.manifest_totals(e).select("status", "segments", "vectors")


@query("list_page", "SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 100 OFFSET 50")
def page(spark, sf):
    return stored(spark, sf)[0].page(100, 50).select("id")


_BUFFER = "b AS (SELECT user_id AS id, max(ts) AS last_access, count(*) AS access_count, min(ts) AS added_at FROM events GROUP BY user_id)"


def _evict(policy, column):
    @query(f"evict_{policy}", f"WITH {_BUFFER} SELECT id FROM b WHERE id NOT IN (SELECT id FROM b ORDER BY {column}, id LIMIT (SELECT greatest(1, count(*) // 10) FROM b))")
    def run(spark, sf):
        b = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_access"), F.count("*").alias("access_count"), F.min("ts").alias("added_at"))
        return stateful.evict(b, policy, 10).select("id")


def _entries(spark, sf):
    """A buffer of the vectors whose id is under 150, added in the order of their ids."""
    at = F.timestamp_seconds(F.col("id"))
    return vectors(spark, sf).where("id < 150").select("id", "data", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), at.alias("added_at"), at.alias("last_access"), F.lit(1).cast("bigint").alias("access_count"))


_READS = "r AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT vec_id AS id, CAST(vec_id AS BIGINT) AS seen FROM embeddings WHERE vec_id < 150)"


@query("buffer_get", f"WITH {_READS} SELECT b.id, CAST(1 + coalesce(n, 0) AS BIGINT) AS access_count, CASE WHEN n IS NULL THEN seen ELSE 1000000 END AS last_access FROM b LEFT JOIN r USING (id)")
def buffer_get(spark, sf):
    """Every event reads its user's entry."""
    reads = table(spark, sf, "events").select(F.col("user_id").cast("bigint").alias("id"))
    _, after = buffer.get(_entries(spark, sf), reads, F.timestamp_seconds(F.lit(1_000_000)))
    return after.select("id", "access_count", F.unix_seconds("last_access").alias("last_access"))


@query("buffer_hits", "SELECT count(*) FILTER (user_id < 150) AS hits, count(*) FILTER (user_id >= 150) AS misses FROM events")
def buffer_hits(spark, sf):
    reads = table(spark, sf, "events").select(F.col("user_id").cast("bigint").alias("id"))
    return buffer.hits_and_misses(_entries(spark, sf), reads)


@query("buffer_add", "SELECT vec_id AS id, CAST(CASE WHEN vec_id BETWEEN 100 AND 149 THEN 2 ELSE 1 END AS BIGINT) AS access_count, CASE WHEN vec_id < 150 THEN vec_id ELSE 500 END AS added_at, CASE WHEN vec_id < 100 THEN vec_id ELSE 500 END AS last_access FROM embeddings WHERE vec_id < 180")
def buffer_add(spark, sf):
    rows = vectors(spark, sf).where("id >= 100 and id < 180").select("id", "data", F.create_map().cast("map<string,string>").alias("metadata"))
    after = buffer.add(_entries(spark, sf), rows, F.timestamp_seconds(F.lit(500)))
    return after.select("id", "access_count", F.unix_seconds("added_at").alias("added_at"), F.unix_seconds("last_access").alias("last_access"))


@query("buffer_memory", "SELECT count(*) AS vectors, CAST(count(*) * (4 * 64 + 16 + 72) AS BIGINT) AS bytes, count(*) / 200.0::DOUBLE AS usage, count(*) / 200.0 >= 0.8 AS due FROM embeddings WHERE vec_id < 150")
def buffer_memory(spark, sf):
    one = buffer.usage(_entries(spark, sf), 200)
    return one.select("vectors", "bytes", "usage", buffer.flush_due(F.col("usage"), F.lit(12), F.col("vectors")).alias("due"))


@query("node_registry", "SELECT * FROM (VALUES ('node-a', 'healthy', 0.9::DOUBLE), ('node-c', 'unhealthy', 0.5::DOUBLE), ('node-d', 'healthy', 0.675::DOUBLE)) t(id, status, load_score)")
def node_registry(spark, sf):
    """A node added, one removed, a new capacity: (40 + 50) / 100 * (1 - 25 / 100)."""
    now = F.timestamp_seconds(F.lit(100))
    nodes = _nodes(spark).withColumns({"address": F.lit("10.0.0.1"), "port": F.lit(7000), "last_seen": F.timestamp_seconds(F.lit(1))})
    nodes = T.with_node(nodes, {"id": "node-d", "address": "10.0.0.4", "port": 7000}, now)
    nodes = T.with_capacity(T.without_node(nodes, "node-b"), "node-d", 40, 50, 25, 100, now)
    return nodes.select("id", "status", r6(F.col("load_score")).alias("load_score"))


@query("redis_replies", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '+PONG' WHEN 1 THEN '+OK' WHEN 2 THEN ':4' WHEN 3 THEN '-ERR wrong number of arguments for ''vector.add'' command' ELSE '-ERR unknown command ' || chr(39) || 'GET' || chr(39) END AS reply FROM events")
def redis_replies(spark, sf):
    lines = F.element_at(F.array(*map(F.lit, ("ping", "VECTOR.ADD v1 1,2", "vector.madd a 1 b 2", "VECTOR.ADD", "get x"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.regexp_replace(requests.redis_reply(lines), r"\s+$", "").alias("reply"))


_evict("lru", "last_access")
_evict("lfu", "access_count")
_evict("fifo", "added_at")
