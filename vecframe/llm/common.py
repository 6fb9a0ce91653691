"""What the operators of this subpackage share.

The Python operators are maps over Arrow batches.  A map sees slices of a
batch whose text is bounded in bytes (``SLICE_BYTES``), or a single row
where one text alone is larger, so memory does not follow the batch size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import durable, shared_folder, ship  # noqa: F401

SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as a compressed table beside the checkpoints."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after those that df has already (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null: empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice's text is at most `most` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.binary())).fill_null(0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def numbered(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that no name of theirs matters."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """All columns of `df`, and `fields`, by a map of batches with numbered columns to (batch, new columns).

    New names that `df` has already get underscores; the new columns are the last ones."""
    own = numbered(df)
    schema = T.StructType([*own.schema.fields, *(T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, made in run(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return own.mapInArrow(work, schema).toDF(*df.columns, *fresh(df, *(n for n, _ in fields)))


def append_arrow(df: DataFrame, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], fields: list[tuple[str, T.DataType]], text: str = "text") -> DataFrame:
    """map_arrow() of a function on the bytes of `text`; `make()` runs once a task and returns it."""
    name = f"c{df.columns.index(text)}"

    def run(batches):
        work = make()
        for part in slices(batches, name):
            yield part, work(utf8(part.column(part.schema.get_field_index(name))))

    return map_arrow(df, run, fields)


def held_out(doc_id) -> "F.Column":
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> Iterator[tuple[int, str, int]]:
    """At most `rows` labelled training texts, the first by a hash of doc_id; that bound of the fit is documented.

    Held-out rows and null labels are not learnt from.  A doc_id with several labels
    has the greatest one; one with several texts gives each of them."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))
    pick = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(pick), "doc_id")  # `rows` rows at most
    return (tuple(r) for r in got.select("doc_id", "t", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(rows).toLocalIterator())
