import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe.functions import distance as D
from vecframe.functions import hashing as H
from vecframe.operators import filters as L
from vecframe.operators import ivf, merge, metrics, search, stateful, topk, topology, validate


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id string, data array<float>")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pinned_distances(spark):
    a, b = D.vector([1, 0]), D.vector([0, 1])
    want = {"euclidean": math.sqrt(2), "cosine": 1, "manhattan": 2, "dotproduct": 0, "hamming": 2, "jaccard": 1}
    for m, d in want.items():
        assert value(spark, D.distance(a, b, m)) == pytest.approx(d, abs=1e-5)
    p, q = D.vector([1, 2]), D.vector([4, 6])
    assert value(spark, D.distance(p, q)) == pytest.approx(5)
    assert value(spark, D.inner_product(p, q)) == pytest.approx(16)
    assert value(spark, D.distance(D.vector([0, 0]), q, "cosine")) == 1
    assert value(spark, D.distance(D.vector([0, 0]), D.vector([0, 0]), "jaccard")) == 0
    assert value(spark, D.distance(D.vector([1]), q)) is None
    assert value(spark, D.normalize(D.vector([3, 4]))) == pytest.approx([0.6, 0.8])
    assert value(spark, D.normalize(D.vector([0, 0]))) is None
    with pytest.raises(ValueError):
        D.distance(p, q, "chebyshev")


def test_sql_functions(spark):
    D.register(spark)
    row = spark.sql("SELECT vf_euclidean(a, b) e, vf_cosine(a, b) c, vf_jaccard(a, b) j, vf_dotproduct(a, b) d FROM (SELECT array(1F, 0F) a, array(0F, 1F) b)").first()
    assert row.e == pytest.approx(math.sqrt(2)) and row.c == 1 and row.j == 1 and row.d == 0


def test_search_order_limit_threshold(spark):
    v = vecs(spark, [("c", [2.0, 2.0]), ("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("x", [1.0])])
    assert [(r.id, r["rank"]) for r in search.knn(v, [0.0, 0.0], 2).collect()] == [("a", 1), ("b", 2)]
    assert [r.id for r in search.knn(v, [0.0, 0.0], 10, threshold=0.5).collect()] == ["a"]
    assert search.knn(v.limit(0), [0.0, 0.0], 3).count() == 0
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            search.knn(v, bad, 1)


def test_batch_equals_single_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = vecs(spark, [(f"{i:03}", rng.normal(size=4).astype(float).tolist()) for i in range(60)])
    q = v.limit(7).select(F.col("id").alias("query_id"), F.col("data").alias("q"))
    whole = search.knn_batch(v, q, 5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(search, "MAX_BROADCAST", 8)
    assert search.knn_batch(v, q, 5).count() == 35
    parts = [b.count() for b in search.query_blocks(q, 8)]
    assert len(parts) > 1 and sum(parts) == 7
    one = q.first()
    assert [r.id for r in search.knn(v, list(one.q), 5).collect()] == [r.id for r in whole if r.query_id == one.query_id]


def test_pre_and_post_filter(spark):
    v = vecs(spark, [(str(i), [float(i)]) for i in range(10)]).withColumn("even", F.col("id").cast("int") % 2 == 0)
    assert [r.id for r in search.knn(v, [0.0], 3, where=F.col("even")).collect()] == ["0", "2", "4"]
    assert [r.id for r in search.knn(v, [0.0], 3, where=F.col("even"), post=True).collect()] == ["0", "2"]


def test_dual_prefers_recent(spark):
    old, new = vecs(spark, [("a", [5.0]), ("b", [1.0])]), vecs(spark, [("a", [0.0])])
    assert [(r.id, r.distance) for r in search.dual(new, old, [0.0], k=5).collect()] == [("a", 0.0), ("b", 1.0)]


@pytest.mark.parametrize("metric", D.METRICS)
def test_ivf_all_lists_is_exact(spark, metric):
    rng = np.random.default_rng(3)
    v = vecs(spark, [(f"{i:02}", rng.normal(size=3).tolist()) for i in range(40)])
    index, q = ivf.IVF.build(v, 4, metric), rng.normal(size=3).tolist()
    exact = [r.id for r in search.knn(v, q, 6, metric).collect()]
    assert [r.id for r in index.search(q, 6, 0).collect()] == exact
    assert sum(r.vectors for r in index.stats().collect()) == 40


def test_ivf_blobs_save_and_delete(spark, tmp_path):
    pts = [("a1", [0.0, 0.0]), ("b1", [10.0, 10.0]), ("c1", [-10.0, 10.0]), ("a2", [0.1, 0.0]), ("b2", [10.1, 10.0]), ("c2", [-10.1, 10.0])]
    index = ivf.IVF.build(vecs(spark, pts).withColumn("id", F.col("id")), 3)
    got = [r.id for r in index.search([0.0, 0.0], 2, 1).collect()]
    assert got[0] in ("a1", "a2") and len(got) == 2
    index.save(str(tmp_path / "ivf"))
    again = ivf.IVF.load(spark, str(tmp_path / "ivf"))
    assert [r.id for r in again.search([0.0, 0.0], 2, 1).collect()] == got
    left = index.delete(spark.createDataFrame([("a1",)], "id string"))
    assert "a1" not in [r.id for r in left.search([0.0, 0.0], 9, 0).collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, '{"n": 5, "s": "abc", "b": true}'), (2, '{"n": "5", "s": "xbz"}'), (3, '{"n": 50.5}'), (4, None), (5, "{}"), (6, '{"n": 9, "s": "a.c"}')]
    return spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("m"))


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        (("n", "eq", 5), [1, 2]),
        (("n", "eq", "5"), [1, 2]),
        (("b", "eq", True), [1]),
        (("n", "ne", 5), [3, 6]),
        (("n", "gt", 8), [3, 6]),
        (("n", "ge", 9), [3, 6]),
        (("n", "lt", 6), [1, 2]),
        (("n", "le", 5), [1, 2]),
        (("n", "in", [9, "5"]), [1, 2, 6]),
        (("n", "in", 5), []),
        (("n", "nin", 5), [1, 2, 3, 6]),
        (("s", "contains", "b"), [1, 2]),
        (("n", "contains", "5"), [2]),
        (("s", "ncontains", "b"), [6]),
        (("s", "startswith", "a"), [1, 6]),
        (("s", "endswith", "c"), [1, 6]),
        (("s", "regex", "^a.c$"), [1, 6]),
        (("s", "regex", "("), []),
        (("s", "regex", "(?=a)"), []),
        (("s", "exists", None), [1, 2, 6]),
        (("s", "nexists", None), [3, 5]),
    ],
)
def test_conditions(mixed, condition, want):
    root = L.Group("and", (L.Condition(*condition),))
    got = mixed.where(L.compile_filter(root, L.VariantFields("m"), F.col("m")))
    assert sorted(r.i for r in got.collect()) == want


def test_groups(mixed):
    empty = {op: L.compile_filter(L.Group(op), L.VariantFields("m")) for op in L.LOGICAL}
    assert {op: mixed.where(c).count() for op, c in empty.items()} == {"and": 6, "or": 0, "not": 0}
    c = L.Condition("n", "gt", 8)
    nested = L.Group("or", (L.Condition("b", "exists"),), (L.Group("not", (c,)),))
    assert sorted(r.i for r in mixed.where(L.compile_filter(nested, L.VariantFields("m"))).collect()) == [1, 2, 4, 5]


def test_filter_validation():
    deep = L.Group("and")
    for _ in range(11):
        deep = L.Group("and", (), (deep,))
    for bad in (None, deep, L.Group("xor"), L.Group("and", (L.Condition("", "eq", 1),)), L.Group("and", (L.Condition("a", "like", 1),)), L.Group("and", (L.Condition("a", "eq"),)), L.Group("and", tuple(L.Condition("a", "exists") for _ in range(101)))):
        with pytest.raises(ValueError):
            L.validate(bad)
    with pytest.raises(ValueError):
        L.from_request([{"key": "a", "operator": "=", "value": "<script>"}])


def test_strict_match(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    f = lambda *c: df.where(L.compile_filter(L.from_match([c]), L.TypedFields(df), strict=True))
    assert f("n", "=", 1).count() == 1 and f("n", "=", "1").count() == 0
    with pytest.raises(Exception, match="needs numbers"):
        f("s", ">", 1).collect()
    with pytest.raises(Exception, match="needs numbers"):
        f("s", ">", "a").collect()


def test_wire_metadata_is_text(spark):
    df = spark.createDataFrame([(1, {"n": "10"}), (2, {"n": "9"})], "i int, metadata map<string,string>")
    got = df.where(L.compile_filter(L.parse({"logical_operator": "AND", "conditions": [{"field": "n", "operator": "gt", "value": 8}]}), L.MapFields()))
    assert [r.i for r in got.collect()] == [2]


def fnv(data, start, prime, bits, xor_first=True):
    h = start
    for b in data:
        h = (h ^ b) * prime % (1 << bits) if xor_first else (h * prime % (1 << bits)) ^ b
    return h


def test_hashes_match_numpy(spark):
    odd = [0.0, -0.0, 1.0, -1.5, 2.0**-140, 1e-45, 3.4e38, 0.1, 2.0**31, 1.9999999, -(2.0**-126)]
    rng = np.random.default_rng(4)
    rows = [(str(i), [float(np.float32(x)) for x in (odd if i == 0 else rng.normal(size=11) * 10.0 ** rng.integers(-30, 30))]) for i in range(20)]
    df = vecs(spark, rows)
    got = df.select("id", H.fnv1a32(H.float_bytes(F.col("data"))).alias("a"), H.fnv1a64(H.float_bytes(F.col("data")), 7).alias("b"), H.fnv1_64(H.float_bytes(F.col("data"))).alias("c")).collect()
    for r, (_, v) in zip(sorted(got, key=lambda r: int(r.id)), rows, strict=True):
        data = np.array(v, np.float32).tobytes()
        assert r.a == fnv(data, H.FNV32_START, H.FNV32_PRIME, 32)
        assert int(r.b) == fnv((7).to_bytes(8, "little") + data, H.FNV64_START, H.FNV64_PRIME, 64)
        assert int(r.c) == fnv(data, H.FNV64_START, H.FNV64_PRIME, 64, False)
    text = value(spark, H.fnv1a64(H.text_bytes(F.lit("foobar"))))
    assert int(text) == 0x85944171F73967E8
    assert value(spark, H.fnv1a32(H.text_bytes(F.lit("")))) == H.FNV32_START


def test_topk_strategies(spark):
    df = spark.createDataFrame([(i, i, float(100 - i) / 100, [float(i % 2), float(1 - i % 2)]) for i in range(150)], "id int, pos int, score double, data array<double>")
    assert [r.id for r in topk.select(df, "topk", k=3).orderBy("rank").collect()] == [0, 1, 2]
    assert topk.select(df, "threshold", threshold=0.9).count() == 11
    assert topk.select(df, "hybrid", k=5, threshold=0.9).count() == 5
    assert [r.id for r in topk.select(df, "diverse", k=4).orderBy("rank").collect()] == [0, 1]
    first = [(100 - i) / 100 for i in range(100)]
    t = np.mean(first) - 0.5 * np.std(first)
    assert topk.select(df, "adaptive", k=1000).count() == sum((100 - i) / 100 >= t for i in range(150))
    assert topk.adaptive(df.limit(20), 1000).count() == 20
    with pytest.raises(ValueError):
        topk.select(df, "best")


def test_diverse_goes_past_a_pool_of_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "POOL", 6)
    rng = np.random.default_rng(7)
    kinds = np.eye(6).tolist() + [[0.0] * 6]
    at = {"a": [0] * 40 + [1] * 30 + [2, 3, 4, 5], "b": [6] * 2 + [0] * 30 + [6, 1] + [2] * 20, None: [0] * 25, "c": [0, 0, 1], "d": rng.integers(0, 7, 60).tolist()}
    data = [(g, i, float(-(i // 2)), kinds[x]) for g, xs in at.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "g string, id int, score double, data array<double>")
    for k in (1, 4, 5):
        want = set()
        for g, xs in at.items():
            chosen = []
            for i, x in enumerate(xs):
                if len(chosen) < k and (len(xs) <= k or x == 6 or x not in [xs[j] for j in chosen]):
                    chosen.append(i)
            want |= {(g, i, n + 1) for n, i in enumerate(chosen)}
        assert {(r.g, r.id, r["rank"]) for r in topk.diverse(df, k, ("g",)).collect()} == want
    assert [r.id for r in topk.diverse(df.where("g = 'a'"), 5).orderBy("rank").collect()] == [0, 40, 70, 71, 72]


def test_near_ties_go_past_copies(spark):
    near = spark.createDataFrame([(f"{i:03}", float(i // 40)) for i in range(200)], "id string, distance double")
    assert [r.id for r in merge.collapse_near_ties(near, k=3).collect()] == ["000", "040", "080"]
    assert [r.id for r in merge.collapse_near_ties(near, k=9).collect()] == ["000", "040", "080", "120", "160"]
    odd = near.selectExpr("id", "if(id < '035', 0D, double('nan')) as distance")
    assert [r.id for r in merge.collapse_near_ties(odd, k=3).collect()] == ["000", "035", "036"]
    assert merge.collapse_near_ties(near.limit(0)).count() == 0


def test_merging(spark):
    s = lambda rows: spark.createDataFrame(rows, "pos int, id string, distance double, score double, rank int")
    sets = merge.flatten([s([(1, "a", 0.1, 0.9, 1), (2, "b", 0.2, 0.8, 2)]), s([(1, "b", 0.15, 0.7, 1), (2, "c", 0.4, 0.6, 0)])])
    rrf = {r.id: r.score for r in merge.merge(sets, "reciprocal_rank_fusion").collect()}
    assert rrf["b"] == pytest.approx(1 / 62 + 1 / 61)
    weighted = {r.id: r.score for r in merge.merge(sets, "weighted").collect()}
    assert weighted["c"] is None and weighted["b"] == pytest.approx(0.4)
    assert [r.id for r in merge.merge(sets, "distance").orderBy("rank").collect()] == ["a", "b", "c"]
    same = s([(1, "a", 0.0, 0.5, 1), (2, "b", 0.0, 0.5, 2)])
    for method, x in (("min_max", 0.5), ("z_score", 0.0)):
        assert {r.score for r in merge.normalise(same, method).collect()} == {x}
    top = merge.coordinator(sets, 2).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in top] == [("a", 0.1), ("b", 0.15)]
    assert top[0].score == pytest.approx(0.7 * 0.95 + 0.3)
    near = spark.createDataFrame([("a", 0.1), ("b", 0.1005), ("c", 0.1012), ("d", 0.3)], "id string, distance double")
    assert [r.id for r in merge.collapse_near_ties(near).collect()] == ["a", "c", "d"]
    with pytest.raises(Exception, match="no weight"):
        merge.weighted_sets(sets, [1.0]).collect()


def test_topology(spark):
    ranges = topology.uniform_ranges(200, ["a", "b", "c"], 64)
    assert [(r.start, r.end, r.node) for r in ranges] == [(0, 63, "a"), (64, 127, "b"), (128, 191, "c"), (192, 199, "a")]
    assert topology.validate_ranges(topology.ranges_frame(spark, ranges), 200).count() == 0
    cut = topology.split_range(ranges, 0, 31)
    assert topology.merge_ranges(cut, 0, 32) == ranges
    with pytest.raises(ValueError):
        topology.split_range(ranges, 0, 63)
    moved = topology.add_node(ranges, ["a", "b", "c"], "d")
    assert sorted(r.node for r in moved) == ["a", "b", "c", "d"]
    assert {r.node for r in topology.remove_node(ranges, ["a", "b", "c"], "b")} == {"a", "c"}
    assert [(r.start, r.end) for r in topology.contiguous_ranges(10, ["a", "b", "c"])] == [(0, 3), (4, 6), (7, 9)]
    points = topology.ring(["a", "b", "c"])
    rows = spark.range(300).select(F.col("id"), F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("k"))
    for r in topology.ring_route(rows, points, F.col("k")).collect():
        assert r.node_id == topology.successors(points, r.k)[0]
    assert topology.plan_report(1, False)["strategy"] == "single" and topology.plan_report(0, False)["strategy"] == "parallel" and topology.plan_report(12, True)["cost"] == pytest.approx(7.3)


def test_state_machines():
    replay = stateful.replay
    bucket = stateful.TokenBucket(1, 2)
    assert replay(bucket, [(0, 0)] * 4) == ["allow", "allow", "allow", "reject"]
    assert replay(bucket, [(0, 0), (0, 0), (0, 0), (1.5, 0), (1.5, 0)]) == ["allow", "allow", "allow", "allow", "reject"]
    assert replay(stateful.SlidingWindow(2, 10), [(0, 0), (1, 0), (2, 0), (10, 0), (11, 0)]) == ["allow", "allow", "reject", "allow", "allow"]
    assert replay(stateful.FixedWindow(1, 10, 1), [(0, 0), (1, 0), (2, 0), (10, 0)]) == ["allow", "allow", "reject", "allow"]
    assert replay(stateful.LoadCircuit(), [(0, 0.95), (1, 0.7), (2, 0.5), (3, 0.6)]) == ["allow", "reject", "allow", "allow"]
    with pytest.raises(ValueError):
        stateful.LoadCircuit(0.5, 0.5)
    breaker = stateful.CircuitBreaker(2, 1, 10)
    assert replay(breaker, [(0, 0), (1, 0), (2, 1), (12, 1), (13, 0)]) == ["closed", "open", "reject", "closed", "closed"]


@pytest.mark.parametrize("machine", [stateful.SlidingWindow(3, 60), stateful.LoadCircuit(), stateful.LoadCircuit(0.6, 0.4), stateful.ConsecutiveHealth(), stateful.ConsecutiveHealth(1, 3)], ids=repr)
def test_fold_equals_replay(spark, machine):
    rng = random.Random(2)
    value = (lambda: rng.random() < 0.6) if isinstance(machine, stateful.ConsecutiveHealth) else rng.random
    rows = [(i, rng.randrange(5), rng.randrange(1000), float(value())) for i in range(400)]
    rows[7:9] = [(7, 2, 30, float("nan")), (8, 2, 31, float("nan"))] if isinstance(machine, stateful.LoadCircuit) else rows[7:9]
    df = spark.createDataFrame(rows, "i int, k int, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    out = stateful.fold(df, machine, "k", "ts", ("i",), "v")
    assert out.columns == [*df.columns, "decision"]
    got = {r.i: r.decision for r in out.collect()}
    for k in range(5):
        own = sorted((s, i, v) for i, kk, s, v in rows if kk == k)
        assert [got[i] for _, i, _ in own] == stateful.replay(machine, [(s, v) for s, _, v in own])


def test_percentile_forms_agree(spark):
    df = spark.createDataFrame([(k, float(v)) for k in "ab" for v in range(1, 11)], "k string, value double")
    a = df.groupBy("k").agg(metrics.percentile(F.col("value"), 0.95).alias("p")).collect()
    b = metrics.exact_percentiles(df, ["k"], [0.95]).collect()
    assert {r.p for r in a} == {9.0} == {r.p95 for r in b}


def test_rejects(spark):
    rows = [("a", [1.0]), ("", [1.0]), ("b", []), ("c", [float("nan")]), ("d", [float("inf")]), (None, [1.0]), ("e", [1.0, 2.0, 3.0])]
    good, bad = validate.split(vecs(spark, rows), validate.reject_reason(F.col("id"), F.col("data"), max_dim=2))
    assert [r.id for r in good.collect()] == ["a"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["dimension", "empty id", "empty id", "empty vector", "not finite", "not finite"]


def test_health(spark):
    rows = [("u", "unhealthy", True), ("d", "unhealthy", False), ("h", "healthy", True), ("x", "unknown", False)]
    got = {r.s: r.health for r in metrics.health_rollup(spark.createDataFrame(rows, "s string, status string, critical boolean"), ["s"]).collect()}
    assert got == {"u": "unhealthy", "d": "degraded", "h": "healthy", "x": "unknown"}


def test_plans(spark, sf):
    from vecframe.plans import registry

    plan = lambda df: df._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["knn_exact"](spark, sf))
    assert "WindowGroupLimit" in plan(registry.QUERIES["knn_batch"](spark, sf))
    got = plan(registry.QUERIES["flt_eq"](spark, sf))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src0)]" in got
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in got


def test_rules_and_redaction(spark):
    from vecframe.operators import rules

    df = spark.createDataFrame([("DROP it",), ("plain",), ("a; <script>",), (None,)], "t string")
    got = [r.b for r in df.select(rules.broken_rules(F.col("t")).alias("b")).collect()]
    assert got == [["sql_injection"], [], ["xss", "command_injection"], []]
    m = value(spark, rules.redact(F.create_map(F.lit("Token"), F.lit("x"), F.lit("b"), F.lit("y")), ["token"]))
    assert m == {"Token": "[REDACTED]", "b": "y"}


def test_timeout(spark):
    from vecframe.operators.control import QueryTimeout, with_timeout

    assert with_timeout(spark, lambda: spark.range(5).count(), 30) == 5
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    with pytest.raises(QueryTimeout):
        with_timeout(spark, lambda: spark.range(2).select(slow("id")).collect(), 1)


def test_sinks_and_summary(spark, tmp_path):
    from vecframe.sources import sinks

    df = spark.createDataFrame([("up", {"b": "2", "a": "1"}, 1.0)], "name string, labels map<string,string>, value double")
    sinks.export(df, "prometheus", str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ['up{a="1",b="2"} 1.0']
    sinks.export(df, "log", str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 1
    with pytest.raises(ValueError):
        sinks.export(df, "graphite", str(tmp_path))
    row = metrics.summary(spark.range(1, 101).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("value")), ["k"]).first()
    assert row.n == 100 and row.quantiles[0] == 50.0
    back = sinks.metadata_from_json(sinks.metadata_to_json(df, "labels"), "labels")
    assert back.select(F.try_variant_get("labels", "$.a", "string").alias("x")).first().x == "1"


def test_variant_schema(spark):
    rows = ['{"n":5,"s":"abc","d":"2024-01-01","a":[1],"o":{"x":1},"b":true,"z":1}', '{"n":"x","s":5,"d":"nope","a":1,"o":2,"b":"t"}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("m"))
    R = validate.Rule
    rules = {"n": R("int", required=True, min=6), "s": R("string", max=2), "d": R("datetime"), "a": R("array"), "o": R("object"), "b": R("bool", enum=(True,))}
    got = [r.e for r in df.select(validate.schema_errors(F.col("m"), rules, strict=True).alias("e")).collect()]
    assert got == [["n: min", "s: max", "z: unknown"], ["n: type", "s: type", "d: type", "a: type", "o: type", "b: type", "b: enum"], ["n: required"]]
    first = df.select(validate.get_int(F.col("m"), "n").alias("i"), validate.get_string(F.col("m"), "s").alias("s"), validate.get_bool(F.col("m"), "b").alias("b")).first()
    assert (first.i, first.s, first.b) == (5, "abc", True)
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert value(spark, validate.set_keys(m, {"a": "9", "c": "3"})) == {"a": "9", "b": "2", "c": "3"}
    assert value(spark, validate.delete_keys(m, ["a"])) == {"b": "2"}


def test_buffer_eviction(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(20)], "id int, access_count int").withColumns({"last_access": F.col("id"), "added_at": -F.col("id")})
    assert sorted(r.id for r in df.join(stateful.evict(df, "lfu", 20), "id", "left_anti").collect()) == [0, 7]
    assert sorted(r.id for r in df.join(stateful.evict(df, "fifo", 20), "id", "left_anti").collect()) == [18, 19]
    assert stateful.evict(df, "lru", 21).count() == 20
