"""Cluster ranges, the hash ring, routing and balance.

Ranges, nodes and rings are small tables (a row a range, node or virtual
node); they are joined by broadcast once their size is checked.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..functions.hashing import FNV32_PRIME, FNV32_START, MASK

WIDTH, VNODES = 64, 160
MAX_TOPOLOGY_ROWS = 1_000_000


@dataclass(frozen=True)
class Range:
    start: int
    end: int
    node: str
    replicas: tuple[str, ...] = ()
    status: str = "active"


def replicas_of(node: str, nodes: list[str], factor: int) -> tuple[str, ...]:
    return tuple(n for n in nodes if n != node)[: max(0, factor - 1)]


def uniform_ranges(clusters: int, nodes: list[str], width: int = WIDTH, factor: int = 1) -> list[Range]:
    """Ranges of `width` clusters, nodes in turn, the last range clipped."""
    return [Range(s, min(s + width, clusters) - 1, n := nodes[i % len(nodes)], replicas_of(n, nodes, factor)) for i, s in enumerate(range(0, clusters, width))]


def contiguous_ranges(clusters: int, nodes: list[str]) -> list[Range]:
    """One range a node; the remainder goes to the first nodes."""
    base, more = divmod(clusters, len(nodes))
    out, at = [], 0
    for i, n in enumerate(nodes):
        size = base + (i < more)
        if size:
            out.append(Range(at, at + size - 1, n))
        at += size
    return out


def split_range(ranges: list[Range], start: int, point: int, node: str | None = None) -> list[Range]:
    """The range from `start` cut after `point`; its second part may go to another node."""
    out = []
    for r in ranges:
        if r.start == start:
            if not r.start < point < r.end:
                raise ValueError("the point must be inside the range")
            out += [replace(r, end=point), replace(r, start=point + 1, node=node or r.node)]
        else:
            out.append(r)
    return out


def merge_ranges(ranges: list[Range], first: int, second: int) -> list[Range]:
    a, b = (next(r for r in ranges if r.start == s) for s in (first, second))
    if a.end + 1 != b.start or a.node != b.node:
        raise ValueError("ranges must be neighbours on one node")
    return [replace(a, end=b.end) if r is a else r for r in ranges if r is not b]


def move_range(ranges: list[Range], start: int, node: str) -> list[Range]:
    return [replace(r, node=node) if r.start == start else r for r in ranges]


def rebalance(ranges: list[Range], nodes: list[str]) -> list[Range]:
    """Whole ranges from nodes above floor(n / nodes) to those under it."""
    want = len(ranges) // len(nodes)
    out = [r if r.node in nodes else replace(r, node="") for r in ranges]
    count = {n: sum(r.node == n for r in out) for n in nodes}
    for i, r in enumerate(out):
        low = min(nodes, key=lambda n: (count[n], n))
        if r.node == "" or (count[r.node] > want and count[low] < want):
            if r.node:
                count[r.node] -= 1
            out[i] = replace(r, node=low)
            count[low] += 1
    return out


def add_node(ranges: list[Range], nodes: list[str], node: str) -> list[Range]:
    return rebalance(ranges, [*nodes, node])


def remove_node(ranges: list[Range], nodes: list[str], node: str) -> list[Range]:
    return rebalance(ranges, [n for n in nodes if n != node])


def ranges_frame(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    return spark.createDataFrame([(r.start, r.end, r.node, list(r.replicas), r.status) for r in ranges], "start bigint, end bigint, node_id string, replicas array<string>, status string")


def small(df: DataFrame, most: int = MAX_TOPOLOGY_ROWS) -> DataFrame:
    """A broadcast hint for a topology table, if it is one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def range_lookup(rows: DataFrame, ranges: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """rows with the range their cluster is in; rows in none are dropped."""
    return rows.join(small(ranges), F.col(cluster).between(F.col("start"), F.col("end")))


def validate_ranges(ranges: DataFrame, clusters: int) -> DataFrame:
    """start, end, problem: overlaps, gaps, missing cover at the ends, ranges without a node."""
    w = Window.orderBy("start", "end")
    last = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumns({"__last": last, "__next": F.lead("start").over(w)})
    problem = (
        F.when(F.col("start") > F.col("end"), "bad bounds")
        .when(F.col("node_id").isNull() | (F.col("node_id") == ""), "no node")
        .when(F.col("__last").isNull() & (F.col("start") > 0), "gap")
        .when(F.col("start") <= F.col("__last"), "overlap")
        .when(F.col("start") > F.col("__last") + 1, "gap")
        .when(F.col("__next").isNull() & (F.greatest("end", F.coalesce("__last", F.lit(-1))) < clusters - 1), "gap")
    )
    return rows.select("start", "end", problem.alias("problem")).where("problem is not null")


def _balance(counts: DataFrame) -> DataFrame:
    m, s = F.avg("n"), F.stddev_pop("n")
    return counts.agg(F.coalesce(F.when(m > 0, F.greatest(F.lit(0.0), 1.0 - s / m)), F.lit(0.0)).alias("balance"))


def cluster_distribution(rows: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return rows.groupBy(cluster).agg(F.count("*").alias("vectors"))


def cluster_balance(rows: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """1 - deviation / mean of vectors over clusters that have some; at least 0."""
    return _balance(rows.groupBy(cluster).agg(F.count("*").alias("n")))


def range_balance(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same of ranges over all nodes, empty ones too."""
    n = ranges.groupBy("node_id").agg(F.count("*").alias("n"))
    return _balance(nodes.select("node_id").join(n, "node_id", "left").select(F.coalesce("n", F.lit(0)).alias("n")))


def range_stats(ranges: DataFrame, clusters: int) -> DataFrame:
    size = F.col("end") - F.col("start") + 1
    return ranges.groupBy("node_id").agg(F.count("*").alias("ranges"), F.count_if(F.col("status") == "active").alias("active"), F.sum(size).alias("clusters"), (F.sum(size) * 100.0 / clusters).alias("percent"))


def capacity_stats(nodes: DataFrame) -> DataFrame:
    """Totals, used, free and percent of vectors, memory and disk (columns <x>_total, <x>_used)."""
    out = []
    for x in ("vectors", "memory", "disk"):
        t, u = F.sum(f"{x}_total"), F.sum(f"{x}_used")
        out += [t.alias(f"{x}_total"), u.alias(f"{x}_used"), (t - u).alias(f"{x}_free"), F.when(t > 0, u * 100.0 / t).otherwise(0.0).alias(f"{x}_percent")]
    return nodes.agg(*out)


# -- ring


def fnv1a32_text(s: str) -> int:
    h = FNV32_START
    for b in s.encode():
        h = ((h ^ b) * FNV32_PRIME) & MASK
    return h


def ring(nodes: list[str], vnodes: int = VNODES, kind: str = "fnv") -> list[tuple[int, str]]:
    """Sorted (hash, node): FNV-1a 32 of `node#i`, or the first 4 bytes of the SHA-1 of `node_virtual_i`."""
    if kind == "fnv":
        points = [(fnv1a32_text(f"{n}#{i}"), n) for n in nodes for i in range(vnodes)]
    else:
        points = [(int.from_bytes(hashlib.sha1(f"{n}_virtual_{i}".encode()).digest()[:4], "big"), n) for n in nodes for i in range(vnodes)]
    return sorted(points)


def successors(points: list[tuple[int, str]], key: int, n: int = 1) -> list[str]:
    """The first n different nodes at or after key, around the ring."""
    at, out = bisect.bisect_left(points, (key, "")), []
    for i in range(len(points)):
        node = points[(at + i) % len(points)][1]
        if node not in out:
            out.append(node)
            if len(out) == n:
                break
    return out


def ring_route(rows: DataFrame, points: list[tuple[int, str]], key: Column) -> DataFrame:
    """rows with `node_id`, the ring successor of key; the ring goes along as one row, searched by halving."""
    spark = rows.sparkSession
    if len(points) > MAX_TOPOLOGY_ROWS:
        raise ValueError("the ring is too large to broadcast")
    table = spark.createDataFrame([(h, n) for h, n in points], "h bigint, n string").agg(F.sort_array(F.collect_list(F.struct("h", "n"))).alias("__ring"))
    both = rows.withColumn("__key", key).crossJoin(F.broadcast(table))
    steps = max(1, len(points).bit_length())
    # lower bound by halving: (lo, hi) narrows for a fixed number of steps
    find = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(points)).alias("hi")),
        lambda s, _: F.when(s.lo < s.hi, F.when(F.get(F.col("__ring"), F.floor((s.lo + s.hi) / 2).cast("int")).h < F.col("__key"), F.struct((F.floor((s.lo + s.hi) / 2) + 1).cast("int").alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), F.floor((s.lo + s.hi) / 2).cast("int").alias("hi")))).otherwise(s),
        lambda s: s.lo,
    )
    return both.withColumn("node_id", F.get(F.col("__ring"), find % len(points)).n).drop("__ring", "__key")


# -- routing


def load_score(cpu: Column, net: Column, mem: Column, vectors: Column) -> Column:
    return F.when(vectors > 0, (cpu + net) / 100.0 * (1.0 - mem / vectors)).otherwise(0.0)


def node_status(last_seen: Column, now: Column, load: Column, timeout_s: float, status: Column | None = None) -> Column:
    silent = micros(now) - micros(last_seen) > int(timeout_s * 1e6)
    out = F.when(silent, "unhealthy").when(load > 0.8, "degraded").otherwise("healthy")
    return F.when(status == "offline", "offline").otherwise(out) if status is not None else out


def route(rows: DataFrame, ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with primary (of the nodes of the range, the one least loaded), replicas and fallbacks (other healthy nodes)."""
    healthy = nodes.where("status = 'healthy'").select("id", "load_score")
    table = healthy.agg(F.sort_array(F.collect_list(F.struct("load_score", "id"))).alias("__nodes"))
    both = range_lookup(rows, ranges).crossJoin(F.broadcast(table))
    mine = F.filter("__nodes", lambda n: (n.id == F.col("node_id")) | F.array_contains(F.col("replicas"), n.id))
    own = F.filter("__nodes", lambda n: n.id == F.col("node_id"))
    primary = F.coalesce(F.get(own, F.lit(0)).id, F.get(mine, F.lit(0)).id, F.get(F.col("__nodes"), F.lit(0)).id)
    out = both.withColumn("primary", primary)
    out = out.withColumn("fallbacks", F.transform(F.filter("__nodes", lambda n: (n.id != F.col("primary")) & ~F.array_contains(F.col("replicas"), n.id)), lambda n: n.id))
    return out.drop("__nodes")


def route_batch(routed: DataFrame) -> DataFrame:
    """node, vectors: rows by each node that gets them, primary or replica."""
    to = F.array_distinct(F.concat(F.array("primary"), F.coalesce("replicas", F.array().cast("array<string>"))))
    return routed.select("id", F.explode(to).alias("node")).groupBy("node").agg(F.count("*").alias("vectors"))


def plan_report(nodes: int, has_filter: bool) -> dict:
    """Strategy, cost and latency (ms) that the planner would name."""
    strategy = "single" if nodes == 1 else "parallel" if nodes <= 3 else "broadcast" if nodes > 10 else "hybrid"
    return {"strategy": strategy, "cost": 1.0 + 0.5 * nodes + (0.3 if has_filter else 0.0), "latency_ms": 10 + {"single": 0, "parallel": 5, "broadcast": 20, "hybrid": 15}[strategy]}


# -- the node registry: nodes as a table (id, address, port, status, load_score, last_seen, ...)


def with_node(nodes: DataFrame, node: dict, now: Column) -> DataFrame:
    """One node more, healthy and just seen; its id must be new and not empty, its address set, its port positive."""
    if not node.get("id") or not node.get("address") or (node.get("port") or 0) <= 0:
        raise ValueError("a node needs an id, an address and a positive port")
    if not nodes.where(F.col("id") == node["id"]).isEmpty():
        raise ValueError(f"node {node['id']} already exists")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    row = nodes.sparkSession.createDataFrame([tuple(node.get(f.name) for f in nodes.schema.fields)], kinds)
    return nodes.unionByName(row.withColumns({"status": F.lit("healthy"), "last_seen": now}))


def _known(nodes: DataFrame, id_: str) -> Column:
    if nodes.where(F.col("id") == id_).isEmpty():
        raise KeyError(f"node {id_} not found")
    return F.col("id") == id_


def without_node(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(~_known(nodes, id_))


def with_node_status(nodes: DataFrame, id_: str, status: str, now: Column) -> DataFrame:
    own = _known(nodes, id_)
    return nodes.withColumns({"status": F.when(own, status).otherwise(F.col("status")), "last_seen": F.when(own, now).otherwise(F.col("last_seen"))})


def with_capacity(nodes: DataFrame, id_: str, cpu: float, net: float, mem: float, vectors: float, now: Column) -> DataFrame:
    """The node's load score from its new capacity."""
    own = _known(nodes, id_)
    score = load_score(*(F.lit(float(x)) for x in (cpu, net, mem, vectors)))
    return nodes.withColumns({"load_score": F.when(own, score).otherwise(F.col("load_score")), "last_seen": F.when(own, now).otherwise(F.col("last_seen"))})


def healthy_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("status = 'healthy'")
