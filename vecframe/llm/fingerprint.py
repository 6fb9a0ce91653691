"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence into phrases: a symbol's label is
the place and value of the lowest bit in which it differs from the symbol
before it, taken again of the labels until they are small; a phrase begins at
each local maximum.  A phrase's name is a hash of its symbols; names are the
next level's symbols.  Cuts depend on a few symbols around them only, so equal
substrings have equal phrases inside, whatever their offset.  The names of
all levels are a text's signatures, whatever its length.

A fingerprint keeps BINS minima of them (one permutation): in each bin,
16 bits of the least name, 0000 if it has none.  The likeness of two
fingerprints is the share of bins that agree among those not empty in both, which
estimates the Jaccard similarity of the signatures; two without any are alike (1).

The next document is found by ranges of doc_id, not by one window: rows are
dealt to as many buckets as Spark has tasks after a shuffle, about four each,
by bounds from a sample of doc_ids; a doc_id with many rows gets several
buckets, by a hash of the text.  Each bucket also gets the last document of the
bucket before it (the first one: of all), so every row meets its neighbour in its own
task, which reads its rows in order and holds a slice of them.

Null texts are empty.  A null doc_id counts as less than all others; rows that
repeat a doc_id are in the order of a hash of their texts, identical ones next to
each other in either order, with the same result.  Texts may be of any length;
columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, slices

BINS = 64
CHUNK = 1 << 20
_K1, _K2, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x9FB21C651E98DF25
_POWERS = np.array([pow(_P, k, 1 << 64) for k in range(4096)], np.uint64)


def _toss_table(size: int) -> np.ndarray:
    """label[before * size + own] for symbols below `size`; equal ones get the greatest label."""
    a, b = np.divmod(np.arange(size * size), size)
    d = a ^ b
    place = np.bitwise_count((d & -d) - 1).astype(np.int64)
    bits = max(1, (size - 1).bit_length())
    return np.where(d == 0, 2 * bits, 2 * place + (b >> np.minimum(place, 62) & 1)).astype(np.uint8)


_BYTES, _WIDE, _MIDDLE, _SMALL = _toss_table(256), _toss_table(256), _toss_table(32), _toss_table(16)


def _cuts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin; first: whether a symbol begins a text."""
    n = len(codes)
    out = np.empty(n, bool)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        a, b = max(0, lo - 4), min(n, hi + 1)
        x = codes[a:b]
        if x.dtype == np.uint8:
            label = np.zeros(len(x), np.uint8)
            label[1:] = _BYTES[x[:-1].astype(np.uint16) << 8 | x[1:]]
        else:
            d = x[1:] ^ x[:-1]
            low = d & (~d + np.uint64(1))
            label = np.zeros(len(x), np.uint8)
            label[1:] = np.where(d == 0, 128, 2 * np.bitwise_count(low - np.uint64(1)) + ((x[1:] & low) != 0))
            again = np.zeros(len(x), np.uint8)
            again[1:] = _WIDE[label[:-1].astype(np.uint16) << 8 | label[1:]]
            label = again
        for table, size in ((_MIDDLE, 5), (_SMALL, 4)):
            again = np.zeros(len(x), np.uint8)
            again[1:] = table[label[:-1].astype(np.uint16) << size | label[1:]]
            label = again
        peak = np.zeros(len(x), bool)
        peak[1:] = label[1:] > label[:-1]
        peak[:-1] &= label[:-1] >= label[1:]
        out[lo:hi] = peak[lo - a : hi - a]
    # the symbols next to a text's start have no labels of their own text, and its last one has
    # no neighbour there; they never cut
    for k in (1, 2, 3, 4):
        out[k:] &= ~first[:-k]
    out[:-1] &= ~first[1:]
    out[-1] = False
    return out | first


def _names(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each phrase's symbols and their order."""
    names = np.empty(len(starts), np.uint64)
    edges = np.append(starts, len(codes))
    table = (np.arange(1, 257, dtype=np.uint64) * _K1) ^ (np.arange(1, 257, dtype=np.uint64) * _K2 >> np.uint64(7)) if codes.dtype == np.uint8 else None
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CHUNK)))
        s, e = int(edges[lo]), int(edges[hi])
        x = codes[s:e]
        h = table[x] if table is not None else x * _K1
        at = starts[lo:hi] - s
        place = np.arange(e - s) - np.repeat(at, np.diff(edges[lo : hi + 1]))
        # a phrase longer than the powers is a run of equal symbols: the powers begin anew
        names[lo:hi] = np.add.reduceat(h * _POWERS[place & 4095] + (place >> 12).astype(np.uint64), at)
        lo = hi
    names ^= names >> np.uint64(32)
    names *= _K2
    names ^= names >> np.uint64(29)
    return names


def sketches(texts: list[bytes]) -> np.ndarray:
    """A row of BINS numbers for each text."""
    out = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer(b"".join(texts), np.uint8)
    full = np.flatnonzero(sizes)
    heads = np.cumsum(sizes)[full] - sizes[full]
    level = 0
    while len(codes):
        level += 1
        first = np.zeros(len(codes), bool)
        first[heads] = True
        starts = np.flatnonzero(_cuts(codes, first))
        codes = _names(codes, starts)
        heads = np.searchsorted(starts, heads)
        own = np.repeat(full, np.diff(np.append(heads, len(codes))))
        h = (codes + np.uint64(level)) * _K1
        h ^= h >> np.uint64(31)
        np.minimum.at(out, own * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), h >> np.uint64(6))
        # texts that are one phrase are done
        many = np.diff(np.append(heads, len(codes))) > 1
        codes = codes[np.repeat(many, np.diff(np.append(heads, len(codes))))]
        sizes = np.diff(np.append(heads, len(own)))[many]
        full, heads = full[many], np.cumsum(sizes) - sizes
    least = out.reshape(-1, BINS)
    short = (least & np.uint64(0xFFFF)).astype(np.uint16)
    short[short == 0] = 1
    short[least == np.iinfo(np.uint64).max] = 0
    return short


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    some = (a > 0) | (b > 0)
    return float(((a == b) & some).sum() / some.sum()) if some.any() else 1.0


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def fingerprint(docs: DataFrame, column: str = "text") -> DataFrame:
    """All columns of docs, and one more, __fingerprint: a hex string."""

    def make():
        return lambda texts: [pa.array([s.astype(">u2").tobytes().hex() for s in sketches(texts)], pa.string())]

    return append_arrow(docs, make, [("__fingerprint", T.StringType())], column)


class Ranges:
    """Buckets by doc_id; one whose bounds have a doc_id several times has that many, by a hash."""

    def __init__(self, sample: list[int], parts: int):
        ids = np.sort(np.array(sample, np.int64))
        bounds = ids[[len(ids) * k // parts for k in range(1, parts)]] if len(ids) else ids
        self.edge, times = np.unique(bounds, return_counts=True)
        # numbers of buckets left of, and at, each edge: an edge that is one bound begins the bucket on its right
        self.wide = np.where(times > 1, times, 0)
        self.first = np.cumsum(1 + self.wide) - self.wide
        self.hot = bool((times > 1).any())

    def of(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.edge, ids, "right")
        out = np.concatenate(([0], self.first + self.wide))[at]
        own = (at > 0) & (ids == self.edge[np.maximum(at - 1, 0)]) if len(self.edge) else np.zeros(len(ids), bool)
        wide = self.wide[np.maximum(at - 1, 0)] if len(self.edge) else np.zeros(len(ids), np.int64)
        own &= wide > 0
        part = (h.astype(np.float64) / 2.0**64 + 0.5) * wide
        return np.where(own, out - wide + np.minimum(part.astype(np.int64), np.maximum(wide - 1, 0)), out).astype(np.int32)


#: Stands for a null doc_id.
NONE = -(2**63)


def digest(docs: DataFrame, parts: int | None = None, sampled: int = 40) -> DataFrame:
    """parts: buckets; sampled: rows a bucket in the sample that gives their bounds."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ids = rows.select("doc_id").sample(min(1.0, sampled * parts / n), 7).collect() if n else []  # about sampled * parts numbers
    ranges = Ranges([r.doc_id for r in ids], parts)
    rows = rows.withColumn("h", F.xxhash64("text"))

    def place(batches):
        for batch in batches:
            at = ranges.of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["b", *batch.schema.names])

    # the texts are hashed twice only where a doc_id has several buckets
    known = rows.select("doc_id", "h" if ranges.hot else F.lit(0).cast("long").alias("h"))
    ends = known.mapInArrow(place, "b int, doc_id long, h long").groupBy("b").agg(F.max(F.struct("doc_id", "h")).alias("end")).orderBy("b").collect()  # a row a bucket
    after = [(*ends[k - 1]["end"], ends[k]["b"]) for k in range(len(ends))]
    wanted = F.broadcast(spark.createDataFrame(after, "i long, g long, b int"))  # a row a bucket
    same = (F.col("doc_id") == F.col("i")) & ((F.col("h") == F.col("g")) if ranges.hot else F.lit(True))
    carried = rows.join(wanted, same).select("b", "doc_id", "h", "text", F.lit(0).alias("own"))
    dealt = rows.select("doc_id", "h", "text").mapInArrow(place, "b int, doc_id long, h long, text string").select("b", "doc_id", "h", "text", F.lit(1).alias("own"))
    near = dealt.unionByName(carried).repartition("b").sortWithinPartitions("b", "own", "doc_id", "h", "text").select("b", "doc_id", "text", "own")

    def work(batches):
        before, mark = "", np.zeros(BINS, np.uint16)
        for part in slices(batches, "text", 2 << 20):
            texts, own = part.column(2).to_pylist(), part.column(3).to_pylist()
            nexts = [before, *texts[:-1]]
            before = texts[-1]
            new = [edited(t, x) for t, x in zip(texts, nexts, strict=True)]
            raw = [t.encode() for t in new]
            both = sketches([*(t.encode() for t in texts), *raw])
            mine, other = both[: len(texts)], both[len(texts) :]
            prior = np.concatenate((mark[None], mine[:-1]))
            mark = mine[-1]
            keep = [i for i, x in enumerate(own) if x]
            yield pa.RecordBatch.from_arrays(
                [
                    pc.if_else(pc.equal(ids := part.column(1).take(pa.array(keep, pa.int64())), NONE), None, ids),
                    pa.array([len(texts[i]) for i in keep], pa.int64()),
                    pa.array([hashlib.sha256(raw[i]).hexdigest() for i in keep], pa.string()),
                    pa.array([mine[i].astype(">u2").tobytes().hex() for i in keep], pa.string()),
                    pa.array([other[i].astype(">u2").tobytes().hex() for i in keep], pa.string()),
                    pa.array([likeness(mine[i], other[i]) for i in keep], pa.float64()),
                    pa.array([likeness(mine[i], prior[i]) for i in keep], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return near.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
