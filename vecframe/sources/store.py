"""Vectors as Parquet segments: append, upsert, delete, compact, manifest.

Data is never changed in place.  Each write puts a folder
<path>/data/version=<n>/cluster_id=<c> for the clusters it touches, in files of
at most SEGMENT rows, and then a manifest <path>/manifest/<n>: a row a folder, with its
status.  The newest manifest that is whole (Parquet's _SUCCESS is written last) is the
table, so a lost job or driver leaves the table as it was.  What a
write replaces is `deleted` in the manifest until compact() drops it.

Reads open the folders of the clusters or segments asked for, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import cluster_of_vector
from ..operators.validate import reject_reason, split

SEGMENT = 10_000
#: Codecs by the names of the reference.
CODECS = {"none": "uncompressed", "lz4": "lz4", "gzip": "gzip", "zlib": "gzip", "flate": "gzip", "lzw": "snappy", "snappy": "snappy", "zstd": "zstd"}
#: Sizes that are compressed at all: smaller ones don't pay, larger ones are left alone.
LEAST_BYTES, MOST_BYTES = 1 << 10, 10 << 20
ENTRY = "segment string, cluster_id bigint, vectors bigint, dim int, bytes bigint, crc32 bigint, status string, created bigint"


def codec_for(size: int, codec: str = "zstd") -> str:
    """The codec of data of this size: none under LEAST_BYTES and over MOST_BYTES."""
    return CODECS[codec] if LEAST_BYTES <= size <= MOST_BYTES else "uncompressed"


def prepare(rows: DataFrame, clusters: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Rows for the table (cluster_id and ts added) and rejects with reject_reason."""
    good, bad = split(rows, reject_reason(F.col("id"), F.col("data")))
    if "ts" not in good.columns:
        good = good.withColumn("ts", F.current_timestamp())
    return good.withColumn("cluster_id", cluster_of_vector(F.col("data"), clusters)), bad


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, codec: str = "zstd", segment: int = SEGMENT):
        self.spark, self.path, self.codec, self.segment = spark, path.rstrip("/"), CODECS[codec], segment

    # -- the manifest

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Numbers of the whole manifests."""
        fs, at = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        names = [s.getPath() for s in fs.listStatus(at)]
        jvm = self.spark._jvm
        return sorted(int(n.getName()) for n in names if n.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))

    def exists(self) -> bool:
        return bool(self.versions())

    def entries(self, version: int | None = None) -> DataFrame:
        """A row a folder: segment (version-cluster), cluster_id, vectors, dim, bytes, crc32, status, created (version)."""
        found = self.versions()
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/manifest/{version or found[-1]}") if found else self.spark.createDataFrame([], ENTRY)

    def _publish(self, entries: DataFrame, version: int) -> None:
        """Rows of a manifest: at most clusters times versions since the last compact()."""
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")

    def set_status(self, segments: list[str], status: str) -> None:
        """active, readonly, compacting or deleted; an unknown segment is an error."""
        now = self.entries()
        if now.where(F.col("segment").isin(segments)).count() != len(set(segments)):
            raise KeyError("segment not found")
        self._publish(with_status(now, segments, status), self._next())

    def _next(self) -> int:
        return (self.versions() or [0])[-1] + 1

    def read(self, clusters: list[int] | None = None, segments: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        live = self.entries().where("status <> 'deleted'")
        if clusters is not None:
            live = live.where(F.col("cluster_id").isin(clusters))
        if segments is not None:
            live = live.where(F.col("segment").isin(segments))
        paths = [f"{self.path}/data/version={r.created}/cluster_id={r.cluster_id}" for r in live.select("created", "cluster_id").collect()]  # a row a folder
        if not paths:
            anywhere = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
            return anywhere.where(F.lit(False)).withColumn("cluster_id", F.col("cluster_id").cast("bigint")).drop("version")
        df = self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).withColumn("cluster_id", F.col("cluster_id").cast("bigint")).drop("version")
        return df.where(F.col("cluster_id").isin(clusters)) if clusters is not None else df

    # -- writes

    def _put(self, rows: DataFrame, replaced: list[int] = ()) -> None:
        """A new version: `rows`, in place of all that the replaced clusters have."""
        version = self._next()
        at = f"{self.path}/data/version={version}"
        rows.repartition("cluster_id").sortWithinPartitions("cluster_id", "id").write.mode("overwrite").option("compression", self.codec).option("maxRecordsPerFile", self.segment).partitionBy("cluster_id").parquet(at)
        old = self.entries()
        if replaced:
            old = old.withColumn("status", F.when(F.col("cluster_id").isin(list(replaced)), "deleted").otherwise(F.col("status")))
        fs, p = self._fs(at)
        new = old.limit(0)
        if any(s.isDirectory() for s in fs.listStatus(p)):
            written = self.spark.read.parquet(at).groupBy("cluster_id").agg(F.count("*").alias("vectors"), F.max(F.size("data")).alias("dim"), F.sum(4 * F.size("data")).cast("bigint").alias("bytes"), crc32().alias("crc32"))
            new = written.select(F.concat_ws("-", F.lit(version), "cluster_id").alias("segment"), F.col("cluster_id").cast("bigint").alias("cluster_id"), "vectors", "dim", "bytes", "crc32", F.lit("active").alias("status"), F.lit(version).cast("bigint").alias("created"))
        self._publish(old.unionByName(new), version)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r.cluster_id for r in rows.select("cluster_id").distinct().collect()]  # clusters at most

    def append(self, rows: DataFrame) -> None:
        """Rows whose id is new; the first by ts of ids that repeat among them.

        Of what is stored only ids are read, and only those of the batch go on (a small batch is sent to where the
        ids are)."""
        if "ts" in rows.columns:
            w = Window.partitionBy("id").orderBy("ts", F.xxhash64("data"))
            rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        else:
            rows = rows.dropDuplicates(["id"])
        if self.exists():
            known = self.read().select("id").join(rows.select("id"), "id", "left_semi")
            rows = rows.join(known, "id", "left_anti")
        self._put(rows)

    def upsert(self, rows: DataFrame) -> None:
        """The newest row of each id stays; only clusters that hold one of the ids are written anew."""
        if not self.exists():
            self._put(latest(rows))
            return
        ids = rows.select("id").distinct()
        stored = self.read()
        known = stored.join(ids, "id", "left_semi")
        touched = self._touched(known)
        best = latest(known.unionByName(rows, allowMissingColumns=True))
        rest = self.read(touched).join(ids, "id", "left_anti") if touched else stored.limit(0)
        self._put(rest.unionByName(best, allowMissingColumns=True), touched)

    def delete(self, ids: DataFrame) -> None:
        """Only clusters that hold one of the ids are written anew."""
        touched = self._touched(self.read().join(ids.select("id"), "id", "left_semi"))
        if touched:
            self._put(self.read(touched).join(ids.select("id"), "id", "left_anti"), touched)

    def delete_where(self, predicate: Column) -> int:
        rows = self.read()
        n = rows.where(predicate).count()
        if n:
            touched = self._touched(rows.where(predicate))
            self._put(self.read(touched).where(~F.coalesce(predicate, F.lit(False))), touched)
        return n

    def compact(self) -> None:
        """Clusters of several folders become one; `deleted` entries leave the manifest, and their folders the disk."""
        live = self.entries().where("status <> 'deleted'")
        many = [r.cluster_id for r in live.groupBy("cluster_id").count().where("count > 1").collect()]  # clusters at most
        if many:
            self._put(self.read(many), many)
        gone = self.entries().where("status = 'deleted'").collect()  # folders since the last compact()
        self._publish(without_deleted(self.entries()), self._next())
        for r in gone:
            fs, at = self._fs(f"{self.path}/data/version={r.created}/cluster_id={r.cluster_id}")
            fs.delete(at, True)

    # -- lookups

    def get(self, ids: list[str]) -> DataFrame:
        return self.read().where(F.col("id").isin(ids))

    def has(self, id_: str) -> bool:
        return not self.get([id_]).isEmpty()

    def ids(self) -> DataFrame:
        return self.read().select("id")

    def count(self) -> int:
        return int(self.entries().where("status <> 'deleted'").agg(F.coalesce(F.sum("vectors"), F.lit(0))).first()[0])

    def compression_ratio(self) -> float:
        """Bytes of the table's files over those of its numbers."""
        fs, at = self._fs(f"{self.path}/data")
        raw = self.entries().agg(F.sum("bytes")).first()[0] or 0
        return fs.getContentSummary(at).getLength() / raw if raw else 0.0

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        return self.read().orderBy("id").offset(offset).limit(limit)

    def manifest(self) -> DataFrame:
        """A row a segment file: cluster, segment, vectors, dimensions, bytes of data, status."""
        df = self.read().withColumn("segment", F.element_at(F.split(F.input_file_name(), "/"), -1))
        return df.groupBy("cluster_id", "segment").agg(F.count("*").alias("vectors"), F.max(F.size("data")).alias("dim"), F.sum(4 * F.size("data")).alias("bytes"), F.when(F.count("*") >= self.segment, "sealed").otherwise("active").alias("status"))

    def validate(self) -> DataFrame:
        """Segments whose vectors differ in length, repeat an id, or are not those of the manifest (counts and crc32)."""
        live = self.entries().where("status <> 'deleted'").select("cluster_id", "vectors", "crc32")
        want = live.groupBy("cluster_id").agg(F.sum("vectors").alias("want"), F.expr("bit_xor(crc32)").alias("sum"))
        got = self.read().groupBy("cluster_id").agg(F.min(F.size("data")).alias("least"), F.max(F.size("data")).alias("greatest"), (F.count("*") - F.count_distinct("id")).alias("repeats"), F.count("*").alias("vectors"), crc32().alias("crc32"))
        return want.join(got, "cluster_id", "left").where("least <> greatest or repeats > 0 or vectors is null or vectors <> want or crc32 <> sum")

    def backup(self, to: str) -> None:
        self.read().write.mode("overwrite").partitionBy("cluster_id").parquet(to)

    def restore(self, source: str) -> None:
        rows = self.spark.read.parquet(source).withColumn("cluster_id", F.col("cluster_id").cast("bigint"))
        self._put(rows, [r.cluster_id for r in self.entries().select("cluster_id").distinct().collect()])  # clusters at most


def crc32() -> Column:
    """A checksum of a segment's rows in any order."""
    return F.expr("bit_xor(crc32(encode(concat_ws('|', id, array_join(cast(data AS array<string>), ',')), 'UTF-8')))")


# -- manifests as tables


def with_entry(entries: DataFrame, entry: dict) -> DataFrame:
    """A manifest with one entry more; its segment must be new, and its dimension that of its cluster's others."""
    if not entries.where(F.col("segment") == entry["segment"]).isEmpty():
        raise ValueError("segment already added")
    if not entries.where((F.col("cluster_id") == entry["cluster_id"]) & (F.col("dim") != entry["dim"])).isEmpty():
        raise ValueError("vector dimension mismatch")
    row = entries.sparkSession.createDataFrame([tuple(entry.get(f.name) for f in entries.schema.fields)], entries.schema)
    return entries.unionByName(row)


def without_entry(entries: DataFrame, segment: str) -> DataFrame:
    if entries.where(F.col("segment") == segment).isEmpty():
        raise KeyError("segment not found")
    return entries.where(F.col("segment") != segment)


def with_status(entries: DataFrame, segments: list[str], status: str) -> DataFrame:
    return entries.withColumn("status", F.when(F.col("segment").isin(segments), status).otherwise(F.col("status")))


def of_status(entries: DataFrame, status: str = "active") -> DataFrame:
    """active or readonly segments."""
    return entries.where(F.col("status") == status)


def without_deleted(entries: DataFrame) -> DataFrame:
    return entries.where("status <> 'deleted'")


def manifest_totals(entries: DataFrame) -> DataFrame:
    """status, segments, vectors, bytes."""
    return entries.groupBy("status").agg(F.count("*").alias("segments"), F.sum("vectors").cast("bigint").alias("vectors"), F.sum("bytes").cast("bigint").alias("bytes"))


def latest(rows: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    """The newest row of each key: an aggregate with partial maxima in each task, no sort of a group."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("__r"))
    return one.select(*(F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns))


def segments(rows: DataFrame, size: int = SEGMENT, cluster: str = "cluster_id") -> DataFrame:
    """Rows with segment_id: floor((row number in the cluster by id - 1) / size)."""
    w = Window.partitionBy(cluster).orderBy("id")
    return rows.withColumn("segment_id", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def manifest_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster_id", "segment_id").agg(F.count("*").alias("vectors"), F.sum(4 * F.size("data")).cast("bigint").alias("bytes"))
