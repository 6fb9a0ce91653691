"""The nearest rows of a block of queries, by products of blocks of vectors.

A task gets rows in the order of their ids and holds the k nearest of every
query so far.  A matrix product bounds the distances of a batch from below,
with a margin for rounding that its terms carry: first in single precision,
then in double for queries that this leaves too many pairs.  Only pairs
whose bound is within the query's k-th distance are worked out, number by
number in the order of ``distance``, and these results alone are compared
and returned.  Numbers too large or small for both bounds, and NaN, are
always worked out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import ship

METRICS = ("euclidean", "cosine", "dotproduct")
#: Numbers of a block of products, pairs that are worked out at once, and rows of a batch of results.
CELLS, PAIRS, ROWS = 1_000_000, 1 << 17, 100_000
NONE = np.int64(2**62)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the arrays of each length; null ones and those with a null number have no distance."""
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets, values = column.offsets.to_numpy().astype(np.int64), column.values
    if values.null_count:
        gaps = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        size[gaps[offsets[1:]] > gaps[offsets[:-1]]] = -1
    numbers = values.to_numpy(zero_copy_only=False)
    for n in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == n)
        yield at, numbers[offsets[at][:, None] + np.arange(n)].astype(np.float64)


def copies(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and the number of the row at each place."""
    if not m.shape[1] or not len(m):
        return np.arange(len(m)), np.arange(len(m))
    whole = np.ascontiguousarray(m).view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel()
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    return first, which.ravel()


def first_copies(m: np.ndarray, k: int) -> np.ndarray:
    """The places of rows with fewer than k copies before them; others are in no list of k."""
    first, which = copies(m)
    if len(first) == len(m):
        return np.arange(len(m))
    order = np.argsort(which, kind="stable")
    ordered = which[order]
    nth = np.arange(len(m)) - np.searchsorted(ordered, ordered)
    return np.sort(order[nth < k])


def counts(flat: np.ndarray, n: int, width: int) -> np.ndarray:
    """How many of the sorted places are in each of n rows of this width."""
    return np.diff(np.searchsorted(flat, np.arange(n + 1) * width))


def above(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The numbers as this kind, none of them less."""
    return x if x.dtype == kind else np.nextafter(x.astype(kind), kind.type(np.inf))


class Factors:
    """Factors of the products in one precision, with a margin for its rounding."""

    def __init__(self, m: np.ndarray, square: np.ndarray, norm: np.ndarray, metric: str, query: bool, kind: type):
        small, large, unit = (1e-20, 1e20, 2.0**-24) if kind is np.float32 else (1e-290, 1e290, 2.0**-53)
        self.odd = ~(square < large) | ((square < small) & m.any(1))
        #: 16 times what rounding can add up to, of the squared norms
        self.margin = 16 * (m.shape[1] + 16) * unit
        self.square = np.where(self.odd, 0.0, square)
        plain = np.where(self.odd[:, None], 0.0, m)
        if metric == "cosine":
            plain /= np.where(self.odd | (norm == 0), 1.0, norm)[:, None]
        own = 1.0 if query else {"euclidean": 1 - self.margin, "cosine": 0.0, "dotproduct": -self.margin}[metric] * self.square
        self.slack = ((0.0 if metric == "cosine" else 2 * self.margin) * self.square).astype(kind)
        by = 1.0 if query else -2.0 if metric == "euclidean" else -1.0
        self.factors = np.column_stack([plain * by, np.broadcast_to(own, len(m))]).astype(kind)


class Side:
    """Vectors of one length: their numbers by place, norms, and factors of the products."""

    def __init__(self, m: np.ndarray, metric: str, query: bool):
        self.columns = np.ascontiguousarray(m.T)
        self.square = np.zeros(len(m))
        for x in self.columns:
            self.square += x * x
        self.norm = np.sqrt(self.square)
        self.single, self.double = (Factors(m, self.square, self.norm, metric, query, kind) for kind in (np.float32, np.float64))


class Queries:
    """Queries of a block, equal vectors as one; with `probes` they meet only rows of these lists."""

    def __init__(self, table: pa.Table, metric: str, k: int, own: list[str]):
        self.metric, self.k, self.own = metric, k, table.select(own).combine_chunks()
        self.sides: dict[int, tuple[int, Side]] = {}
        self.lists: dict[int, dict[int, np.ndarray]] | None = {} if "probes" in table.column_names else None
        probes = table.column("probes").to_pylist() if self.lists is not None else None
        place, number, n = [], [], 0
        for at, m in matrices(one_array(table.column("q"))):
            first, which = copies(m)
            with np.errstate(all="ignore"):
                self.sides[m.shape[1]] = (n, Side(m[first], metric, True))
            if probes is not None:
                by: dict[int, list[int]] = {}
                for i, p in enumerate(at[first]):
                    for x in probes[p] or ():
                        by.setdefault(x, []).append(i)
                self.lists[m.shape[1]] = {x: np.array(v) for x, v in by.items()}
            place.append(at)
            number.append(which + n)
            n += len(first)
        self.n = n
        number = np.concatenate(number) if number else np.array([], np.int64)
        order = np.argsort(number, kind="stable")
        #: rows of `own` by number of their vector, and where a number's begin
        self.rows = np.concatenate(place)[order] if place else number
        self.begin = np.searchsorted(number[order], np.arange(n + 1))

    def scan(self, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        """Of batches with data first, then list where there are lists, then the columns that are returned as `names`."""
        self.near, self.at = np.full((self.n, self.k), np.nan), np.full((self.n, self.k), NONE)
        held, places, start = None, np.array([], np.int64), 0
        skip = 1 if self.lists is None else 2
        for batch in batches:
            rest = pa.Table.from_arrays(batch.columns[skip:], names=[f"r{i}" for i in range(len(batch.columns) - skip)])
            lists = None if self.lists is None else batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                came = [self._batch(at, m, lists, start) for at, m in matrices(batch.column(0))]
            if any(came):
                used = np.unique(self.at[self.at != NONE])
                old, new = used[used < start], used[used >= start]
                fresh = rest.take(pa.array(new - start))
                held = fresh if held is None else pa.concat_tables([held.take(pa.array(np.searchsorted(places, old))), fresh]).combine_chunks()
                places = used
            start += batch.num_rows
        if held is not None:
            yield from self._found(held, places, names)

    def _batch(self, at: np.ndarray, m: np.ndarray, lists: np.ndarray | None, start: int) -> bool:
        if m.shape[1] not in self.sides:
            return False
        base, side = self.sides[m.shape[1]]
        if lists is None:
            return self._blocks(m, at + start, side, base, np.arange(len(side.square)))
        came = False
        for x, some in self.lists[m.shape[1]].items():
            own = np.flatnonzero(lists[at] == x)
            if len(own):
                came |= self._blocks(m[own], at[own] + start, side, base, some)
        return came

    def _blocks(self, m: np.ndarray, place: np.ndarray, side: Side, base: int, some: np.ndarray) -> bool:
        came, step = False, max(1, CELLS // max(1, m.shape[1]))
        for lo in range(0, len(m), step):
            part, where = m[lo : lo + step], place[lo : lo + step]
            keep = first_copies(part, self.k)
            rows, where = Side(part[keep], self.metric, False), where[keep]
            width = max(1, CELLS // len(where))
            for q in range(0, len(some), width):
                came |= self._pairs(rows, where, side, base, some[q : q + width])
        return came

    def _pairs(self, rows: Side, place: np.ndarray, side: Side, base: int, some: np.ndarray) -> bool:
        last, n = self.near[base + some, self.k - 1], len(place)
        flat, came = self._near(rows.single, side.single, some, last), False
        loose = np.flatnonzero(counts(flat, len(some), n) > 8 * self.k)
        if len(loose):
            q, r = np.divmod(self._near(rows.double, side.double, some[loose], last[loose]), n)
            flat = np.concatenate([flat[~np.isin(flat // n, loose)], loose[q] * n + r])
        for lo in range(0, len(flat), PAIRS):
            q, r = np.divmod(flat[lo : lo + PAIRS], n)
            q = some[q]
            came |= self._merge(base + q, self._distance(rows, r, side, q), place[r])
        return came

    def _near(self, rows: Factors, side: Factors, some: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The pairs, query's place x rows + row's, whose bound is within the query's k-th distance, here or in `last`."""
        k, e, square, odd = self.k, side.margin, side.square[some], side.odd[some]
        low = side.factors[some] @ rows.factors.T
        if self.metric == "euclidean":
            most = last * last * (1 + 1e-12) - (1 - e) * square + 1e-300
        elif self.metric == "cosine":
            most = last - 1 + 4 * e
        else:
            most = last + e * square + 1e-12 * np.abs(last) + 1e-300

        def tighten(which: np.ndarray) -> None:
            # k rows of this block alone are as near as their upper bounds say
            high = (low if len(which) == len(low) else low[which]) + rows.slack
            if rows.odd.any():
                high[:, rows.odd] = np.inf
            high = np.partition(high, k - 1, axis=1)[:, k - 1].astype(np.float64)
            own = 4 * e if self.metric == "cosine" else 2 * e * square[which] + 1e-12 * (np.abs(high) + 2 * square[which]) + 1e-300
            most[which] = np.fmin(most[which], high + own)

        enough = low.shape[1] - np.count_nonzero(rows.odd) >= k
        fresh = np.isnan(most) & ~odd
        if enough and fresh.any():
            tighten(np.flatnonzero(fresh))
        most[np.isnan(most)] = np.inf
        near = low <= above(most, low.dtype)[:, None]
        flat = np.flatnonzero(near)
        many = np.flatnonzero((counts(flat, *low.shape) > 4 * k) & ~fresh & ~odd)
        if enough and len(many):
            tighten(many)
            near[many] = low[many] <= above(most[many], low.dtype)[:, None]
            flat = np.flatnonzero(near)
        if odd.any() or rows.odd.any():
            near[odd] = True
            near[:, rows.odd] = True
            flat = np.flatnonzero(near)
        return flat

    def _distance(self, rows: Side, r: np.ndarray, side: Side, q: np.ndarray) -> np.ndarray:
        total = np.zeros(len(r))
        for x, y in zip(rows.columns, side.columns, strict=True):
            if self.metric == "euclidean":
                d = x[r] - y[q]
                total += d * d
            else:
                total += x[r] * y[q]
        if self.metric == "euclidean":
            return np.sqrt(total)
        if self.metric == "dotproduct":
            return -total + 0.0
        a, b = rows.norm[r], side.norm[q]
        return np.where((a == 0) | (b == 0), 1.0, 1.0 - total / (a * b))

    def _merge(self, q: np.ndarray, d: np.ndarray, place: np.ndarray) -> bool:
        """Hold the k least by distance, NaN last, and place."""
        keep = ~(d > self.near[q, self.k - 1])
        q, d, place = q[keep], d[keep], place[keep]
        if not len(q):
            return False
        own, which = np.unique(q, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(own)), self.k), which.ravel()])
        d, place = np.concatenate([self.near[own].ravel(), d]), np.concatenate([self.at[own].ravel(), place])
        order = np.lexsort((place, d, owner))
        best = order[np.searchsorted(owner[order], np.arange(len(own)))[:, None] + np.arange(self.k)]
        self.near[own], self.at[own] = d[best], place[best]
        return True

    def _found(self, held: pa.Table, places: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        q, slot = np.nonzero(self.at != NONE)
        times = self.begin[q + 1] - self.begin[q]
        ends = np.cumsum(times)
        lo = 0
        while lo < len(q):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + ROWS, "right")))
            n = times[lo:hi]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            qs, slots = np.repeat(q[lo:hi], n), np.repeat(slot[lo:hi], n)
            left = self.own.take(pa.array(self.rows[self.begin[qs] + nth]))
            right = held.take(pa.array(np.searchsorted(places, self.at[qs, slots])))
            out = pa.Table.from_arrays([*left.columns, pa.array(self.near[qs, slots]), *right.columns], names=names)
            yield from out.combine_chunks().to_batches()
            lo = hi


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The query's columns but q and probes, distance, id and `keep`: k rows or fewer for each query and task.

    rows: id, data, `keep` and, where queries have probes, list_id.  The rows are dealt to two tasks a core,
    so what the tasks return grows with the queries, not with the rows."""
    spark = rows.sparkSession
    ship(spark)
    own = [c for c in queries.columns if c not in ("q", "probes")]
    probes = "probes" in queries.columns
    table = queries.withColumn("q", F.col("q").cast("array<double>")).toArrow()
    block = spark.sparkContext.broadcast(Queries(table, metric, k, own))
    kind = rows.schema["data"].dataType.elementType
    data = F.col("data") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("data").cast("array<double>")
    back = rows.select("id", *keep).schema.fields
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(queries.select(*own).schema.fields)), T.StructField("d", T.DoubleType()), *(T.StructField(f"r{i}", f.dataType) for i, f in enumerate(back))])
    names = schema.names
    dealt = rows.repartition(2 * spark.sparkContext.defaultParallelism).sortWithinPartitions("id")
    part = dealt.select(data.alias("__data"), *([F.col("list_id").cast("bigint").alias("__list")] if probes else []), *(F.col(f.name).alias(f"__r{i}") for i, f in enumerate(back)))

    def work(batches):
        return block.value.scan(batches, names)

    return part.mapInArrow(work, schema).toDF(*own, "distance", "id", *keep)
