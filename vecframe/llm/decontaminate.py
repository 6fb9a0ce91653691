"""Benchmark decontamination with suffix arrays over the training text.

A shard is a slice of documents.  Its words become the numbers they have in
the benchmark's vocabulary (0: not in it; also after each document, so no match
crosses documents).  The shard's suffix array holds, in the order of their
first WINDOW words, the suffixes that can begin a match: those whose
first words form a benchmark gram.  Every benchmark suffix is
binary-searched in it, which gives the range of its verbatim occurrences;
matches that go on in the next item word are joined for the longest one.

The benchmark goes to the executors in blocks of at most BLOCK_CHARS code
points (about 110 bytes of a worker's memory each), one map each over the documents,
and nothing is shuffled.  A further block has a stage of its own, so a worker holds
one at a time.  A longer item is cut into parts that share WINDOW - 1 words.

Null and empty texts have no words and are never contaminated; repeated rows
are each judged; item ids may repeat (their texts are judged together, and
the id counts once); a null item id is written as an empty string.  A very long
document is a shard of its own.  Columns may have any names; an empty table, of
documents or of items, gives no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, col, durable, fresh, numbered

WINDOW = 13
GRAM = 6
BLOCK_CHARS = 2_000_000
#: A-Z to a-z; 0-9, a-z and all of UTF-8 beyond ASCII stay; the rest separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = 0x9E3779B97F4A7C15
_BITS = 22


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words, as a number of _BITS bits; ids has n - 1 more at its end."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * np.uint64(_MIX)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


class Benchmark:
    """A block of items: vocabulary, test suffixes, grams that begin one."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        number: dict[str, int] = {}
        rows, owner, place, length = [], [], [], []
        at = 0
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            n = min(len(ids), window)
            for i in range(len(ids) - n + 1 if n else 0):
                rows.append(ids[i : i + n] + [0] * (window - n))
                owner.append(number.setdefault(item, len(number)))
                place.append(at + i)
                length.append(n)
            at += len(ids) + 2
        self.items = list(number)
        self.suffixes = np.array(rows, np.int64).reshape(-1, window)
        self.owner, self.place, self.length = (np.array(x, np.int64) for x in (owner, place, length))
        self.low = self._keys(self.suffixes)
        high = self.suffixes.copy()
        high[np.arange(window)[None, :] >= self.length[:, None]] = 0xFFFFFFFF
        self.high = self._keys(high)
        self.grams: dict[int, np.ndarray] = {}
        for n in set(np.minimum(self.length, GRAM).tolist()):
            own = self.suffixes[np.minimum(self.length, GRAM) == n][:, :n]
            seen = np.zeros(1 << _BITS, bool)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = (h ^ own[:, k].astype(np.uint64)) * np.uint64(_MIX)
                h ^= h >> np.uint64(29)
            seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.grams[n] = seen

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").reshape(-1)

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of their suffixes, and the suffixes' first words; ids ends with `window` zeros."""
        can = np.zeros(len(ids) - self.window, bool)
        for n, seen in self.grams.items():
            can |= seen[_grams(ids, n)[: len(can)]] & (ids[: len(can)] > 0)
        at = np.flatnonzero(can)
        keys = self._keys(ids[at[:, None] + np.arange(self.window)[None, :]])
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ids, number of the test suffix that occurs there)."""
        array, keys = self.suffix_array(ids)
        low = np.searchsorted(keys, self.low, "left")
        count = np.searchsorted(keys, self.high, "right") - low
        hit = np.flatnonzero(count > 0)
        n = count[hit]
        which = np.repeat(hit, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return array[low[which] + nth], which

    def judge(self, texts: list[bytes]) -> list[tuple[int, list[list[int]], list[str], int]]:
        """For each text: words, spans of hit words, items that occur, words of the longest match."""
        tokens = [words(t) for t in texts]
        get = self.vocab.get
        sizes = np.array([len(t) for t in tokens], np.int64)
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        ids = np.zeros(int(ends[-1]) + self.window if len(ends) else self.window, np.int64)
        for s, t in zip(starts.tolist(), tokens, strict=True):
            ids[s : s + len(t)] = [get(w, 0) for w in t]
        at, which = self.matches(ids) if len(self.length) else (np.zeros(0, np.int64),) * 2
        doc = np.searchsorted(ends, at, "right")
        n = self.length[which]
        # occurrences that go on in both texts are one longer match
        order = np.lexsort((at, at - self.place[which]))
        a, diag, m = at[order], (at - self.place[which])[order], n[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (diag[1:] != diag[:-1]) | (a[1:] != a[:-1] + 1)
        run = np.cumsum(fresh) - 1
        longest = np.zeros(len(texts), np.int64)
        if len(a):
            first = np.flatnonzero(fresh)
            np.maximum.at(longest, doc[order][first], np.bincount(run) - 1 + m[first])
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + n, -1)
        hit = np.cumsum(step)[:-1] > 0
        out = []
        found: dict[int, set[int]] = {}
        for d, i in zip(doc.tolist(), self.owner[which].tolist(), strict=True):
            found.setdefault(d, set()).add(i)
        for d, (s, k) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            spans: list[list[int]] = []
            if d in found:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[s : s + k].astype(np.int8), [0]))))
                spans = [[int(x), int(y)] for x, y in zip(edge[::2], edge[1::2], strict=True)]
            out.append((k, spans, sorted(self.items[i] for i in found.get(d, ())), int(longest[d])))
        return out


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, window: int = WINDOW):
    """The items in lists of at most about block_chars code points, read one after another."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    block, chars = [], 0
    for i, t in rows.toLocalIterator():
        for part in [t.encode()] if len(t) <= block_chars else parts_of(words(t.encode()), block_chars, window):
            if block and chars + len(part) > block_chars:
                yield block
                block, chars = [], 0
            block.append((i, part))
            chars += len(part)
    yield block


def parts_of(own: list[bytes], size: int, window: int):
    """A long item's words in texts of about `size` bytes that share window - 1 words, so every window is in one."""
    start, total = 0, 0
    for k, w in enumerate(own):
        total += len(w) + 1
        if total > size and k - start >= 2 * window or k == len(own) - 1:
            yield b" ".join(own[start : k + 1])
            start = k + 2 - window
            total = sum(len(x) + 1 for x in own[start : k + 1])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, text: str = "text") -> DataFrame:
    """All columns of docs and four more: __n_words, __spans (hit words, from and to), __items, __longest."""
    spark = docs.sparkSession
    span = T.ArrayType(T.ArrayType(T.IntegerType()))
    fields = [("n_words", T.LongType()), ("spans", span), ("items", T.ArrayType(T.StringType())), ("longest", T.LongType())]
    out, place = numbered(docs), f"c{docs.columns.index(text)}"
    for k, block in enumerate(blocks(benchmark, block_chars, window)):
        shared = spark.sparkContext.broadcast(block)  # of about block_chars code points

        def make(shared=shared):
            bench = Benchmark(shared.value, window)

            def work(texts):
                cols = list(zip(*bench.judge(texts), strict=True)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.int64())
                return [pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True)]

            return work

        if k:
            out = durable(out)
        out = append_arrow(out, make, [(n if k == 0 else f"{n}_{k}", t) for n, t in fields], place)
        if k:
            out = out.withColumns({"spans": F.concat("spans", f"spans_{k}"), "items": F.concat("items", f"items_{k}"), "longest": F.greatest("longest", f"longest_{k}")}).drop(*(f"{n}_{k}" for n, _ in fields))
    # spans of several blocks may overlap: a native fold over the sorted ones joins them
    joined = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<array<int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= s[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], s[1]))))).otherwise(F.concat(acc, F.array(s))),
    )
    out = out.withColumns({"spans": joined, "items": F.array_sort(F.array_distinct("items"))})
    return out.toDF(*docs.columns, *fresh(docs, *(f"__{n}" for n, _ in fields)))


def judged(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """find_contamination() and two more columns: __n_hit, __contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    out = find_contamination(docs, benchmark, **kw)
    total, spans = (col(c) for c in out.columns[-4:-2])
    hit, flag = fresh(out, "__n_hit", "__contaminated")
    out = out.withColumn(hit, F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0])))
    return out.withColumn(flag, (col(hit) > 0) & (20 * col(hit) >= total))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    out = judged(docs, benchmark, **kw)
    return out.where(~col(out.columns[-1])).select(*map(col, docs.columns))
