import json

import pytest
from pyspark.sql import functions as F

from vecframe import api
from vecframe.operators import buffer, ivf, stateful, topology
from vecframe.sources import requests, store
from vecframe.sources.store import VectorStore, prepare
from vecframe.streaming import jobs


def rows(spark, ids, ts="2024-01-01", x=1.0):
    return spark.createDataFrame([(i, [x, float(n)]) for n, i in enumerate(ids)], "id string, data array<float>").withColumn("ts", F.lit(ts).cast("timestamp"))


def test_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "t"), segment=2)
    good, bad = prepare(rows(spark, ["a", "b", "c", "", "d"]), 4)
    assert bad.count() == 1
    s.append(good)
    s.append(prepare(rows(spark, ["a", "e"]), 4)[0])
    assert sorted(r.id for r in s.ids().collect()) == list("abcde")
    assert s.has("a") and not s.has("z") and s.get(["a", "b"]).count() == 2
    m = s.manifest().collect()
    assert sum(r.vectors for r in m) == 5 and all(r.vectors <= 2 for r in m)
    assert s.validate().count() == 0
    s.upsert(prepare(rows(spark, ["a"], "2025-01-01", 9.0), 4)[0])
    assert [round(r.data[0]) for r in s.get(["a"]).collect()] == [9]
    s.delete(spark.createDataFrame([("b",)], "id string"))
    assert s.delete_where(F.col("id") == "c") == 1
    s.backup(str(tmp_path / "b"))
    s.delete_where(F.lit(True))
    s.restore(str(tmp_path / "b"))
    s.compact()
    assert [r.id for r in s.page(2, 1).collect()] == ["d", "e"]
    one = s.read().first().cluster_id
    assert "PartitionFilters: [isnotnull(cluster_id" in s.read([one])._jdf.queryExecution().toString()


def test_store_keeps_what_a_lost_write_leaves(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "t"))
    s.append(prepare(rows(spark, list("abcdefgh")), 4)[0])
    before = {r.segment: r.created for r in s.entries().collect()}
    one = s.read().where("id = 'a'").first().cluster_id
    s.delete(spark.createDataFrame([("a",)], "id string"))
    now = s.entries().where("status <> 'deleted'").collect()
    # only the cluster of the id was written anew
    assert {r.cluster_id for r in now if r.created == 2} <= {one} and all(before[r.segment] == 1 for r in now if r.created == 1)
    assert s.count() == s.read().count() == 7
    # data, and a manifest, that a lost driver didn't finish
    spark.range(3).write.parquet(f"{s.path}/data/version=3/cluster_id=0")
    (tmp_path / "t" / "manifest" / "3").mkdir()
    assert s.versions()[-1] == 2 and s.read().count() == 7 and s.validate().count() == 0
    s.append(prepare(rows(spark, ["i", "b"]), 4)[0])
    assert sorted(r.id for r in s.ids().collect()) == list("bcdefghi")
    s.compact()
    assert sorted(r.id for r in s.ids().collect()) == list("bcdefghi") and s.entries().where("status = 'deleted'").count() == 0
    assert s.entries().groupBy("cluster_id").count().where("count > 1").count() == 0
    first = s.entries().first()
    s.set_status([first.segment], "readonly")
    assert s.read(segments=[first.segment]).count() == first.vectors and store.of_status(s.entries(), "readonly").count() == 1
    for wrong in (lambda: s.set_status(["x"], "deleted"), lambda: store.without_entry(s.entries(), "x"), lambda: store.with_entry(s.entries(), first.asDict())):
        with pytest.raises((KeyError, ValueError)):
            wrong()
    assert [store.codec_for(n) for n in (10, 5000, 50 << 20)] == ["uncompressed", "zstd", "uncompressed"]


def test_stored_index_opens_probed_lists_only(spark, sf):
    from vecframe.plans import nearest, registry

    found = nearest.index(spark, sf).search(registry.vector_of(spark, sf), 10, 1)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan or "PartitionFilters: [list_id" in plan or "PartitionFilters: [cast(list_id" in plan, plan


def test_buffer(spark):
    now = F.timestamp_seconds(F.lit(9))
    empty = spark.createDataFrame([], "id string, data array<float>, metadata map<string,string>, added_at timestamp, last_access timestamp, access_count bigint")
    new = spark.createDataFrame([(c, [1.0, 2.0], {"k": "v"}) for c in "abcb"], "id string, data array<float>, metadata map<string,string>")
    b = buffer.add(empty, new, now)
    assert buffer.usage(b, 4).first().asDict() == {"vectors": 3, "bytes": 3 * (8 + 16 + 72), "memory_mb": 288 / (1 << 20), "usage": 0.75}
    hits, b = buffer.get(b, spark.createDataFrame([("a",), ("a",), ("z",)], "id string"), now)
    assert [(r.id, r.access_count) for r in hits.collect()] == [("a", 3)]
    assert buffer.has(b, "b") and not buffer.has(b, "z") and buffer.ids(b).count() == 3
    assert sorted(r.id for r in buffer.room_for_more(b, "lfu", 3).collect()) == ["a", "c"] and buffer.room_for_more(b, "lfu", 4).count() == 3
    assert buffer.remove(b, spark.createDataFrame([("a",)], "id string")).count() == 2
    due = spark.createDataFrame([(0.8, 0.0, 5, True), (0.79, 29.0, 5, False), (0.1, 30.0, 5, True), (0.0, 99.0, 0, False)], "s double, t double, n int, want boolean")
    assert due.where(buffer.flush_due(F.col("s"), F.col("t"), F.col("n")) != F.col("want")).count() == 0


def test_node_registry_refuses(spark):
    nodes = spark.createDataFrame([("a", "x", 1, "healthy", 0.0)], "id string, address string, port int, status string, load_score double").withColumn("last_seen", F.current_timestamp())
    now = F.current_timestamp()
    for bad in ({"id": "", "address": "x", "port": 1}, {"id": "b", "address": "", "port": 1}, {"id": "b", "address": "x", "port": 0}, {"id": "a", "address": "x", "port": 1}):
        with pytest.raises(ValueError):
            topology.with_node(nodes, bad, now)
    with pytest.raises(KeyError):
        topology.without_node(nodes, "z")
    assert topology.healthy_nodes(topology.with_node_status(nodes, "a", "offline", now)).count() == 0


def test_parsers(spark):
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    http = requests.from_http(text('{"id":"a","vector":[1,2],"metadata":{"k":"v"}}', '[{"id":"b","vector":[3]},{"id":"c","vector":[4]}]'))
    assert sorted((r.id, r.data) for r in http.collect()) == [("a", [1.0, 2.0]), ("b", [3.0]), ("c", [4.0])]
    ws = requests.from_websocket(text('{"type":"insert_vector","data":{"id":"a","vector":[1]}}', '{"type":"insert_batch","data":{"vectors":[{"id":"b","vector":[2]}]}}', '{"type":"ping"}'))
    assert sorted(r.id for r in ws.collect()) == ["a", "b"]
    redis = requests.from_redis(text("VECTOR.ADD a 1,2", "vector.madd b 1 c 2,3", "PING"))
    assert sorted((r.id, r.data) for r in redis.collect()) == [("a", [1.0, 2.0]), ("b", [1.0]), ("c", [2.0, 3.0])]


def test_ingest_and_search_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text('{"id":"a","vector":[0,0]}\n{"id":"b","vector":[1,1]}\n{"id":"","vector":[1]}\n')
    s = VectorStore(spark, str(tmp_path / "t"))
    lines = spark.readStream.text(str(source))
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest(lines, s, str(tmp_path / "c1"), rejects=str(tmp_path / "rejects")).awaitTermination()
    assert sorted(r.id for r in s.ids().collect()) == ["a", "b"]
    assert spark.read.json(str(tmp_path / "rejects")).count() == 1
    qs = tmp_path / "q"
    qs.mkdir()
    (qs / "1.json").write_text('{"query_id":"x","q":[0.1,0.1]}\n')
    stream = spark.readStream.schema("query_id string, q array<float>").json(str(qs))
    jobs.search_stream(stream, s.read(), str(tmp_path / "out"), str(tmp_path / "c2"), k=1).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_windows_and_limits_on_streams(spark, tmp_path):
    source = tmp_path / "e"
    source.mkdir()
    (source / "1.json").write_text("".join(json.dumps({"k": "u", "ts": f"2024-01-01T00:00:{i:02}Z", "value": 1.0}) + "\n" for i in range(6)))
    read = lambda: spark.readStream.schema("k string, ts timestamp, value double").json(str(source))
    q = jobs.metric_windows(read(), ["k"], "1 minute", None).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.sum for r in spark.table("w").collect()] == [6.0]
    machine = stateful.SlidingWindow(2, 60)
    q = jobs.limited(read(), machine, "k", "ts").writeStream.format("memory").queryName("l").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.decision for r in spark.table("l").orderBy("ts").collect()] == ["allow"] * 2 + ["reject"] * 4


def test_engine(spark):
    v = spark.createDataFrame([(str(i), [float(i), 0.0], "en" if i % 2 else "de", i % 3) for i in range(12)], "id string, data array<double>, lang string, cluster_id int")
    e = api.Engine(v, index=ivf.IVF.build(v.select("id", "data"), 3))
    ids = lambda r: [x.id for x in e.search(r).orderBy("rank").collect()]
    assert ids({"vector": [0, 0], "k": 3}) == ["0", "1", "2"]
    assert ids({"vector": [0, 0], "k": 2, "filter": {"lang": "en"}}) == ["1", "3"]
    assert ids({"vector": [0, 0], "k": 2, "filter": [{"key": "lang", "operator": "!=", "value": "en"}], "cluster_ids": [0]}) == ["0", "6"]
    assert ids({"vector": [0, 0], "k": 2, "filter": {"metadata.cluster_id": {"$gte": 2}}}) == ["2", "5"]
    assert len(ids({"vector": [0, 0], "k": 2, "recall_preference": "accurate"})) == 2
    assert json.loads(e.respond({"vector": [0, 0], "k": 1}))["total"] == 1
    assert e.search_batch([{"vector": [0, 0], "k": 1}, {"vector": []}]).count() == 1
    with pytest.raises(ValueError):
        e.search({"vector": [0, 0], "threshold": -1})
