"""Line dedup by winnowing over line hashes.

Lines are cut at \\n; those without words are not compared.  A window is
`run` lines that follow each other (lines without words left out), or a
line or pair of lines of `heavy` words or more (0: every line).  A window is deleted if
the same lines also start earlier: in a smaller doc_id, or before it in the
same document; windows are judged on the input and may overlap, so what goes
is every later repeated run, extended both ways as far as it matches.

1. Winnowing: of each window the line with the least hash is its fingerprint; a line
   that is the least of several windows is one row.  Equal windows
   have equal fingerprints at equal places, so each repeated run has one.
2. Positions are joined: fingerprints that occur once are put aside by a count
   with map-side sums.
3. From the positions left, the documents' windows around them extend both ways.
   Windows are one if their lines are (by 128 bits of line hashes, besides the
   fingerprint); the first of each is found by an aggregate, and the later ones are
   marked.  A maximal repeated run is the union of its windows.

A fingerprint with a third of all rows costs one row a task in the counts, and
its joins are between many rows and one, which adaptive execution splits.  Both
joins with the documents share one exchange of them.

A line without words goes if the nearest line with words before it goes.  Null
texts stay null and have no lines; a text may become empty.  Rows that repeat
doc_id and text are one document, and each gets its result; a null doc_id
comes before all others.  Columns may have any names; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, numbered, slices, utf8

RUN_LINES = 3
HEAVY_WORDS = 50


def lines_of(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those with words."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def windows(texts: list[bytes], run: int, heavy: int) -> tuple[np.ndarray, ...]:
    """Of all windows of all texts: number of the text, fingerprint, its line, two hashes of the lines, first line, lines; lines are counted among those with words."""
    hashes, checks, words, sizes = [], [], [], []
    for t in texts:
        lines, own = lines_of(t)
        sizes.append(len(own))
        for i in own:
            x = lines[i]
            hashes.append(xxhash.xxh3_64_intdigest(x))
            checks.append(xxhash.xxh3_64_intdigest(x, 1))
            words.append(len(x.split()))
    h, c, n = np.array(hashes, np.uint64), np.array(checks, np.uint64), np.array(words, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for k in sorted({1, 2, run}):
        m = len(h) - k + 1
        if m <= 0:
            continue
        keep = doc[:m] == doc[k - 1 :]
        if k < run:
            keep &= sum(n[j : m + j] for j in range(k)) >= heavy
        i = np.flatnonzero(keep)
        least, where = h[i], np.zeros(len(i), np.int64)
        for j in range(1, k):
            less = h[i + j] < least
            least, where = np.where(less, h[i + j], least), np.where(less, j, where)
        whole = []
        for x in (h, c):
            total = np.full(len(i), k, np.uint64)
            for j in range(k):
                total = (total ^ x[i + j]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(32)
            whole.append(total.view(np.int64))
        out.append((doc[i], least.view(np.int64), at[i] + where, *whole, at[i], np.full(len(i), k)))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(7))


#: Stands for a null doc_id in joins.
NONE = -(2**63)


def _beside(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """k, row, the columns of docs by number, and the set of marks of each document (null: none).

    Uses that pass on all columns have equal exchanges of the documents, so Spark makes one."""
    named = numbered(docs)
    text, doc = (named[f"c{docs.columns.index(x)}"] for x in ("text", "doc_id"))
    keyed = named.withColumns({"k": F.coalesce(doc.cast("long"), F.lit(NONE)), "row": F.xxhash64(text)})
    value = [c for c in marks.columns if c not in ("k", "row")]
    grouped = marks.groupBy("k", "row").agg(F.collect_set(F.struct(*value)).alias("marks")).select(F.col("k").alias("k2"), F.col("row").alias("row2"), "marks")
    return keyed.join(grouped, (F.col("k") == F.col("k2")) & (F.col("row") == F.col("row2")), "left").select("k", "row", *named.columns, "marks")


def later_windows(docs: DataFrame, run: int = RUN_LINES, heavy: int = HEAVY_WORDS) -> DataFrame:
    """k (doc_id), row (a hash of the text), first, lines: windows that also start earlier."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("k"), F.xxhash64("text").alias("row"), "text")

    def winnow(batches):
        for part in slices(batches, "text"):
            doc, least, where = windows(utf8(part.column(2)), run, heavy)[:3]
            # the fingerprints of neighbouring windows are one line
            order = np.lexsort((where, doc))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(doc[order]) != 0) | (np.diff(where[order]) != 0)
            keep = order[new]
            own = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([pa.array(least[keep]), part.column(0).take(own), part.column(1).take(own), pa.array(where[keep].astype(np.int32))], names=["least", "k", "row", "at"])

    found = texts.mapInArrow(winnow, "least long, k long, row long, at int")
    # aggregates group by another form of the key than the joins use, so both sides of a join have an
    # exchange of its own, and adaptive execution may split what is frequent
    repeated = found.select(F.struct("least").alias("g")).groupBy("g").count().where("count > 1").select("g.least")
    near = found.join(repeated, "least", "left_semi").select("k", "row", "at")
    both = _beside(docs, near)
    place = 2 + docs.columns.index("text")

    def extend(batches):
        for batch in batches:
            with_marks = batch.filter(batch.column(batch.num_columns - 1).is_valid())
            for part in slices(iter([with_marks]), with_marks.schema.names[place]):
                doc, least, where, whole, check, first, lines = windows(utf8(part.column(place)), run, heavy)
                marks = part.column(part.num_columns - 1)
                size = np.diff(marks.offsets.to_numpy())
                at = marks.flatten().flatten()[0].to_numpy()
                base = int(where.max(initial=0)) + 1
                hit = np.isin(doc * base + where, (np.repeat(np.arange(len(size)), size) * base + at)[at < base])
                own = pa.array(doc[hit])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[hit]) for x in (least, whole, check)), part.column(0).take(own), part.column(1).take(own), *(pa.array(x[hit].astype(np.int32)) for x in (first, lines))],
                    names=["least", "whole", "check", "k", "row", "first", "lines"],
                )

    around = both.mapInArrow(extend, "least long, whole long, check long, k long, row long, first int, lines int")
    key, start = ("least", "whole", "check"), F.struct("k", "row", "first")
    first = around.groupBy(F.struct(*reversed(key)).alias("g")).agg(F.min(start).alias("start"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.struct(*(f"g.{x}" for x in key)).alias("window"), "start")
    return around.select(F.struct(*key).alias("window"), "k", "row", "first", "lines").join(first, "window").where(start > F.col("start")).select("k", "row", "first", "lines")


def cut(text: bytes, marks: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The kept lines joined again; lines removed; runs removed."""
    lines, own = lines_of(text)
    gone = np.zeros(len(own) + 1, np.int64)
    for first, k in marks:
        gone[first] += 1
        gone[first + k] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    keep, drop, of = [], False, dict(zip(own, gone.tolist(), strict=True))
    for i, x in enumerate(lines):
        drop = of.get(i, drop)
        if not drop:
            keep.append(x)
    return b"\n".join(keep), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())


def dedup(docs: DataFrame, run: int = RUN_LINES, heavy: int = HEAVY_WORDS) -> DataFrame:
    """All columns of docs with the text cut, and two more, __removed and __runs: lines and runs of lines that went."""
    both = _beside(docs, later_windows(docs, run, heavy))
    place, n = docs.columns.index("text"), len(docs.columns)

    def work(batches):
        for part in slices(batches, f"c{place}"):
            texts, counts = [], []
            for raw, own in zip(part.column(place + 2).to_pylist(), part.column(n + 2).to_pylist(), strict=True):
                got = (None if raw is None else raw.encode(), 0, 0) if not own else cut(raw.encode(), [(x["first"], x["lines"]) for x in own])
                texts.append(None if got[0] is None else got[0].decode())
                counts.append(got[1:])
            columns = [c if i != place else pa.array(texts, pa.string()) for i, c in enumerate(part.columns[2 : n + 2])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[j] for c in counts], pa.int64()) for j in (0, 1))], names=[*(f"c{i}" for i in range(n)), "removed", "runs"])

    kinds = T.StructType([*(T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema.fields)), T.StructField("removed", T.LongType()), T.StructField("runs", T.LongType())])
    return both.mapInArrow(work, kinds).toDF(*docs.columns, *fresh(docs, "__removed", "__runs"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN_LINES, heavy: int = HEAVY_WORDS) -> DataFrame:
    """The documents with their own columns; n_chars, if there, is that of the new text."""
    out = dedup(docs, run, heavy).select(*map(col, docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def digest(docs: DataFrame) -> DataFrame:
    got = dedup(docs.select("doc_id", "text"))
    return got.select("doc_id", F.col("__removed").alias("n_removed"), F.col("__runs").alias("n_runs"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
