"""Exact substring dedup by external induced sorting.

Every byte covered by a LENGTH-byte string that also starts earlier (smaller
doc_id, or before it in the same document) is removed; strings are judged on
the input.  The work is cut so that only what can repeat is sorted:

1. Each LENGTH-byte window has a fingerprint, the least hash of its
   GRAM-byte strings.  Following windows with one fingerprint are a run, of
   at most RUN windows; equal windows are in runs of equal fingerprints.  Of runs
   that are equal in one task all but the first are later, so a frequent run
   goes on once a task.
2. Runs meet by fingerprint, in order.  A run alone is done.  A run whose whole content
   another run had before is later in every window (contents are told by 128 bits:
   the fingerprint and a hash).  The first run of each content is compared if the
   fingerprint has other contents.
3. The texts of those runs meet in shards by fingerprint, or, where a fingerprint is
   frequent, by a finer one that also has the bytes beside it.  A shard of any size
   goes through `induced`: its windows come in the order of their suffixes with
   the common prefix of neighbours, and those that share LENGTH bytes are one
   string.  All but its first place are later.  A sieve before that passes over
   windows whose hash is alone in the shard; it decides nothing, and with any
   other hash the result is the same.
4. Marks meet their document, whose bytes are cut.

Texts are packed (zstd) where they are shuffled; a shard's text, tuples and ranks
are in files beside Spark's own spills where they are large.  Null texts are empty.
Rows that repeat doc_id and text are one document, and each gets its result;
a null doc_id comes before all others.  Other columns aren't read; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced
from .common import slices, stored, utf8

LENGTH = 100
GRAM = 32
RUN = 64
#: Bytes of a shard, about (whole fingerprints), and its runs that are worked on at once.
TAKEN = 2 << 20
AT_ONCE = 4096
#: A fingerprint of more contents than HOT is cut finer; at most MAX_HOT of them are broadcast.
HOT, MAX_HOT = 50_000, 200_000
#: Bytes left and right of a fingerprint's string that all windows hold in which it stands in the first, second, third, last quarter.
SIDES = ((0, 51), (17, 34), (34, 17), (51, 0))
#: Stands for a null doc_id.
NONE = -(2**63)
_P = 0x9FB21C651E98DF25
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = ((np.arange(1, 257, dtype=np.uint64) * _MIX) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(9)))


def _pow(k: int) -> np.uint64:
    return np.uint64(pow(_P, k, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Polynomial hashes of all strings of 4 and 32 bytes; of 100 bytes at given places."""

    def __init__(self, x: np.ndarray):
        h, k = _BYTE[x], 1
        while k < 32:
            h = h[: len(h) - k] + _pow(k) * h[k:]
            k *= 2
            if k == 4:
                self.four = h
        self.wide = h

    def hundred(self, at: np.ndarray) -> np.ndarray:
        w = self.wide
        return w[at] + _pow(32) * w[at + 32] + _pow(64) * w[at + 64] + _pow(96) * self.four[at + 96]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    m, k = h, 1
    while 2 * k <= width:
        m = np.minimum(m[: len(m) - k], m[k:])
        k *= 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - k : width - k + n])


def runs(x: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """x: texts joined; ends and doc: of each text.  Fingerprint, content hash, text, first place in x, windows;
    these are negative where the fingerprint's string is there twice, so that a run may repeat a window of its own."""
    none = np.zeros(0, np.int64)
    if len(x) < LENGTH:
        return none, none, none, none, none
    hashes = Hashes(x)
    gram = _mixed(hashes.wide)
    wide = LENGTH - GRAM + 1
    low = _least(gram, wide)
    own = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))[: len(low)]
    ok = np.arange(LENGTH, len(low) + LENGTH) <= ends[own]
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, none, none
    fresh = np.ones(len(at), bool)
    fresh[1:] = (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(at)))
    # long runs are cut every RUN windows
    cuts = -(-size // RUN)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first = at[np.repeat(head, cuts)] + nth * RUN
    n = np.minimum(RUN, np.repeat(size, cuts) - nth * RUN)
    content = _mixed(_mixed(hashes.hundred(first)) + hashes.hundred(first + n - 1) + n.astype(np.uint64))
    key, text = low[first], own[first]
    twice = np.zeros(len(first), bool)
    span = np.arange(wide)
    for lo in range(0, len(first), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        left = first[part] + (gram[first[part, None] + span] == key[part, None]).argmax(1)
        end = (first + n - 1)[part]
        right = end + wide - 1 - (gram[end[:, None] + span[::-1]] == key[part, None]).argmax(1)
        twice[part] = left != right
    return key.view(np.int64), content.view(np.int64), doc[text], first, np.where(twice, -n, n)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans, one span after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Shard:
    """Runs of a shard, in the order of their documents and places."""

    def __init__(self):
        self.text, self.runs, self.size, self.last = induced.Spool(np.uint8), [induced.Spool(np.int64) for _ in range(4)], 0, None

    def put(self, doc: np.ndarray, row: np.ndarray, first: np.ndarray, texts: list[bytes], low: np.ndarray) -> None:
        key = np.stack((low, doc, row, first))
        fresh = np.ones(len(texts), bool)
        # repeated rows of one document give a run more than once, next to each other
        fresh[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        fresh[0] = self.last is None or (key[:, 0] != self.last).any()
        self.last = key[:, -1]
        texts = [t for t, new in zip(texts, fresh.tolist(), strict=True) if new]
        n = np.array([len(t) for t in texts], np.int64)
        for spool, x in zip(self.runs, (doc[fresh], row[fresh], first[fresh], n), strict=True):
            spool.put(x)
        self.text.put(np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1))
        self.size += int(n.sum())

    def later(self):
        """doc, row, first place, windows: runs of windows that also start earlier, in blocks."""
        x, (doc, row, first, size) = self.text.done(), (r.done() for r in self.runs)
        n = len(size)
        start = induced.room(n + 1, np.int64)
        for lo in range(0, n, AT_ONCE):
            part = size[lo : lo + AT_ONCE]
            start[lo + 1 : lo + 1 + len(part)] = start[lo] + np.cumsum(part)
        # what may repeat, as a text of its own: of each run, from the first to the last such window
        kept, parts = induced.Spool(np.uint8), [induced.Spool(np.int64) for _ in range(3)]
        twice, total = _sieved(x, start[:n], size), 0
        for lo in range(0, n, AT_ONCE):
            at, count = start[lo : min(n, lo + AT_ONCE)], size[lo : lo + AT_ONCE] - (LENGTH - 1)
            base, stop = int(at[0]), int(at[-1] + count[-1] + LENGTH - 1)
            hit = np.flatnonzero(twice[base:stop])
            if not len(hit):
                continue
            run = np.searchsorted(at, hit + base, "right") - 1
            head = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            tail = np.append(head[1:], len(run)) - 1
            own, windows = run[head], hit[tail] - hit[head] + 1
            kept.put(x[base:stop][_spans(hit[head], windows + LENGTH - 1)])
            for spool, y in zip(parts, (own + lo, hit[head] + base - at[own], windows), strict=True):
                spool.put(y)
        kept.put(np.zeros(9, np.uint8))
        text, (own, offset, windows) = kept.done(), (p.done() for p in parts)

        def places():
            total = 0
            for lo in range(0, len(own), AT_ONCE):
                k = np.asarray(windows[lo : lo + AT_ONCE])
                size = k + LENGTH - 1
                yield total + _spans(np.cumsum(size) - size, k)
                total += int(size.sum())

        gone = later(text, places())
        for lo in range(0, len(own), AT_ONCE):
            k = np.asarray(windows[lo : lo + AT_ONCE])
            begin = np.cumsum(k + LENGTH - 1) - (k + LENGTH - 1)
            hit = np.flatnonzero(gone[total : total + int((k + LENGTH - 1).sum())])
            total += int((k + LENGTH - 1).sum())
            if not len(hit):
                continue
            which = np.searchsorted(begin, hit, "right") - 1
            head = np.ones(len(hit), bool)
            head[1:] = (hit[1:] != hit[:-1] + 1) | (which[1:] != which[:-1])
            i = np.flatnonzero(head)
            run = own[lo : lo + AT_ONCE][which[i]]
            yield doc[run], row[run], first[run] + offset[lo : lo + AT_ONCE][which[i]] + hit[i] - begin[which[i]], np.diff(np.append(i, len(hit)))


def _sieved(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each place, whether it begins a window of a run whose hash another window has: only these can repeat."""
    out, heap, last = induced.room(len(x), bool), induced.Heap(1), (None, 0)
    for lo in range(0, len(start), AT_ONCE):
        at, n = start[lo : lo + AT_ONCE], size[lo : lo + AT_ONCE]
        own = x[int(at[0]) : int(at[-1] + n[-1])]
        places = _spans(at - at[0], n - (LENGTH - 1))
        heap.put(Hashes(own).hundred(places), places + at[0])
    for h, at in heap.pop():
        same = np.concatenate(([h[0] == last[0]], h[1:] == h[:-1]))
        out[at[same]] = True
        out[np.concatenate(([last[1]], at))[:-1][same]] = True
        last = (h[-1], at[-1])
    return out


def later(x: np.ndarray, places) -> np.ndarray:
    """Whether each place of x begins a window that also starts before it in x; places: of all windows, in order.

    x has bytes greater by one, and nine zeros at its end."""
    out, open_ = induced.room(len(x), bool), -1
    for at, _, shared in induced.of_bytes(x).suffixes(places):
        out[at] = True
        fresh = np.flatnonzero(shared < LENGTH)
        lead = at[: fresh[0]] if len(fresh) else at
        if len(lead):
            # a string goes on from the block before
            out[open_] = True
            open_ = min(open_, int(lead.min()))
            out[open_] = False
        if len(fresh):
            least = np.minimum.reduceat(at, fresh)
            out[least] = False
            open_ = int(least[-1])
    return out


# -- Spark


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, row, text; row tells rows with one doc_id apart, and is 0 where doc_ids are unique, so it costs no bytes."""
    text = F.coalesce("text", F.lit(""))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("i"))
    repeated = ids.groupBy("i").count().where("count > 1").limit(1).count() > 0
    return docs.select(F.col("doc_id").cast("long").alias("doc"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("row"), text.alias("text"))


def _packed(keyed: DataFrame) -> DataFrame:
    """k, row, z: the text packed; k is the doc_id, NONE for a null."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0).fill_null(NONE), part.column(1), pa.array([press.compress(t) for t in utf8(part.column(2))], pa.binary())], names=["k", "row", "z"])

    return keyed.mapInArrow(pack, "k long, row long, z binary")


def _first_of_equal(content, low, doc, row, first) -> tuple[np.ndarray, np.ndarray]:
    """Rows but for repeated ones of the same place; of these, the ones that are later: an equal run in another place is before them."""
    every = np.arange(len(content))
    order = np.argsort(content)
    s = content[order]
    tied = np.zeros(len(s) + 1, bool)
    tied[1:-1] = s[1:] == s[:-1]
    t = order[tied[1:] | tied[:-1]]
    if not len(t):
        return every, t
    t = t[np.lexsort((first[t], row[t], doc[t], low[t], content[t]))]
    new = np.ones(len(t), bool)
    new[1:] = (content[t[1:]] != content[t[:-1]]) | (low[t[1:]] != low[t[:-1]])
    head = t[new][np.cumsum(new) - 1]
    other = (doc[t] != doc[head]) | (row[t] != row[head]) | (first[t] != first[head])
    gone = np.zeros(len(content), bool)
    gone[t[~new & ~other]] = True
    return every[~gone] if gone.any() else every, t[~new & other]


def _found(keyed: DataFrame) -> DataFrame:
    """low, content, doc, row, at: the runs of all texts; at: first place << 8 | windows + 128, or | windows - 1 if the run is later."""

    def scan(batches):
        for part in slices(batches, "text", 2 << 20):
            texts = utf8(part.column(2))
            ends = np.cumsum([len(t) for t in texts])
            low, content, own, first, n = runs(np.frombuffer(b"".join(texts), np.uint8), ends, np.arange(len(texts)))
            doc, row = part.column(0).fill_null(NONE).to_numpy()[own], part.column(1).to_numpy()[own]
            first = first - (ends - np.array([len(t) for t in texts]))[own]
            keep, again = _first_of_equal(content, low, doc, row, first)
            code, to = n + 128, low
            if len(again):
                # those are dealt anywhere, as they are done
                code = np.where(np.isin(np.arange(len(n)), again), np.abs(n) - 1, code)
                to, content = low.copy(), content.copy()
                to[again] = _mixed((doc[again] * 64 + first[again]).view(np.uint64)).view(np.int64)
                content[again] = 0
                if len(keep) < len(n):
                    low, to, content, doc, row, first, code = (c[keep] for c in (low, to, content, doc, row, first, code))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(content), pa.array(doc, mask=doc == NONE), pa.array(row), pa.array(first << 8 | code)], names=["low", "content", "doc", "row", "at"])

    return keyed.mapInArrow(scan, "low long, content long, doc long, row long, at long")


def _classes(found: DataFrame) -> DataFrame:
    """Runs that repeat: all of a later run of equal content, and (compare) the first of each content where a fingerprint has several.

    A row whose compare is null says that its fingerprint has more than HOT contents."""

    def marks(rows, flag):
        at = rows.column(4).to_numpy()
        code = at & 255
        n = np.where(code < RUN, code + 1, np.abs(code - 128)).astype(np.int32)
        return pa.RecordBatch.from_arrays([rows.column(0), *rows.columns[2:4], pa.array(at >> 8), pa.array(n), pa.array([flag] * rows.num_rows, pa.bool_())], names=["low", "doc", "row", "first", "n", "compare"])

    def sift(batches):
        # the run before this batch's first row: its fingerprint and content, and the first row of the
        # fingerprint if it is still open whether there are other contents
        low0, content0, open_row, place0, many = None, None, None, None, 0
        for batch in batches:
            code = batch.column(4).to_numpy() & 255
            done = pa.array(code < RUN)
            if (gone := batch.filter(done)).num_rows:
                yield marks(gone, False)
                batch = batch.filter(pc.invert(done))
            if not batch.num_rows:
                continue
            low, content = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new_low = np.ones(len(low), bool)
            new_low[1:] = low[1:] != low[:-1]
            new_low[0] = low0 is None or low[0] != low0
            new = new_low.copy()
            new[1:] |= content[1:] != content[:-1]
            new[0] |= content0 is None or content[0] != content0
            # rows with the place of their content's first row are that document again
            place = np.stack([batch.column(i).cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]) >> np.array([[0], [0], [8]])
            heads = np.concatenate((place0[:, None] if place0 is not None else place[:, :1], place[:, np.flatnonzero(new)]), 1)
            head = heads[:, np.cumsum(new)]
            later_rows = np.flatnonzero(~new & (place != head).any(0))
            place0 = head[:, -1]
            other = new & ~new_low  # the first of a second or later content
            group = np.cumsum(new_low)  # 0: goes on from the batch before
            several = np.bincount(group, other, group[-1] + 1) > 0
            contents = np.bincount(group, new, group[-1] + 1)
            before = np.zeros(len(contents), np.int64)
            before[0] = many
            crossed = np.flatnonzero((before <= HOT) & (before + contents > HOT))
            many = int(before[-1] + contents[-1])
            own = new & ((batch.column(4).to_numpy() & 255) < 128)
            compare = np.flatnonzero(other | own | (new_low & several[group]))
            parts = []
            if open_row is not None and several[0] and group[0] == 0:
                parts.append((open_row, True))
                open_row = None
            if len(later_rows):
                parts.append((batch.take(pa.array(later_rows)), False))
            if len(compare):
                parts.append((batch.take(pa.array(compare)), True))
            if len(crossed):
                parts.append((batch.take(pa.array(np.searchsorted(group, crossed))), None))
            for rows, flag in parts:
                yield marks(rows, flag)
            if group[-1] > 0:
                head = int(np.flatnonzero(new_low)[-1])
                open_row = None if several[group[-1]] or own[head] else batch.slice(head, 1)
            low0, content0 = low[-1], content[-1]

    near = found.repartition("low").sortWithinPartitions("low", "content", "doc", "row", "at")
    return near.mapInArrow(sift, "low long, doc long, row long, first long, n int, compare boolean")


def _by_document(marks: DataFrame, *fields: str) -> DataFrame:
    """k, row, marks: distinct marks of each document; k is its doc_id, NONE for a null."""
    k = F.coalesce("doc", F.lit(NONE)).alias("k")
    return marks.select(k, "row", F.struct(*fields).alias("m")).groupBy("k", "row").agg(F.collect_set("m").alias("marks"))


def _joined(packed: DataFrame, marks: DataFrame) -> DataFrame:
    """Both uses are left joins on the same keys, so they share one exchange of the texts, and the marks keep that of their grouping."""
    return packed.join(marks.select(F.col("k").alias("k2"), F.col("row").alias("r2"), "marks"), (F.col("k") == F.col("k2")) & (F.col("row") == F.col("r2")), "left").select("k", "row", "z", "marks")


def _unpacked(batch: pa.RecordBatch, own: zstandard.ZstdDecompressor):
    """Number of the row in the batch, text, from and to of its marks in the flat arrays of marks."""
    offsets = batch.column(3).offsets.to_numpy()
    valid = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
    base = int(offsets[0])
    for i, z in enumerate(batch.column(2)):
        yield i, z, (int(offsets[i]) - base, int(offsets[i + 1]) - base) if valid[i] else (0, 0)


def _flat(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The fields of all marks of a batch, as arrays."""
    return [f.to_numpy(zero_copy_only=False) for f in batch.column(3).flatten().flatten()]


def parts_of(text: bytes, low: int) -> list[tuple[int, int, int]]:
    """A run's text in parts by what its windows have beside the fingerprint's string: (finer fingerprint, first window, windows).

    Equal windows have the string at the same place, so they share the bytes that SIDES names for that place, and meet again."""
    x = np.frombuffer(text, np.uint8)
    wide = LENGTH - GRAM + 1
    n = len(x) - LENGTH + 1
    hashes = Hashes(x)
    places = np.flatnonzero(_mixed(hashes.wide).view(np.int64) == low)
    window = np.arange(n)
    at = places[np.searchsorted(places, window)]  # the leftmost one in each window
    side = np.minimum((at - window) * len(SIDES) // wide, len(SIDES) - 1)
    change = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (side[1:] != side[:-1]))))
    out = []
    for i, j in zip(change.tolist(), [*change[1:].tolist(), n], strict=True):
        a, b = SIDES[side[i]]
        s, e = int(at[i]) - a, int(at[i]) + GRAM + b
        out.append((xxhash.xxh3_64_intdigest(text[s:e], int(side[i])) - (1 << 63), i, j - i))
    return out


def _compared(packed: DataFrame, runs_: DataFrame, hot: DataFrame) -> DataFrame:
    """doc, row, first, n: windows that also start earlier, of runs to compare; hot has the fingerprints to cut finer."""
    spark = runs_.sparkSession
    found = [r.low for r in hot.limit(MAX_HOT + 1).collect()]  # there is one for HOT runs at most
    hot = F.broadcast(spark.createDataFrame([(x, True) for x in found], "low long, hot boolean")) if len(found) <= MAX_HOT else hot.select("low", F.lit(True).alias("hot"))
    runs_ = runs_.join(hot, "low", "left") if found else runs_.withColumn("hot", F.lit(False))
    own = _by_document(runs_, "first", "n", "low", "hot")

    def texts(batches):
        own = zstandard.ZstdDecompressor()
        for part in slices(batches, "z", 2 << 20):
            first, n, low, hot = _flat(part)
            source, lows, firsts, out = [], [], [], []
            for i, z, (a, b) in _unpacked(part, own):
                if a == b:
                    continue
                text = own.decompress(z.as_buffer())
                if not hot[a:b].any():
                    f = first[a:b]
                    out += [text[s:e] for s, e in zip(f.tolist(), (f + n[a:b] + (LENGTH - 1)).tolist(), strict=True)]
                    source.append(np.full(b - a, i))
                    lows.append(low[a:b])
                    firsts.append(f)
                    continue
                for f, k, key, finer in zip(first[a:b].tolist(), n[a:b].tolist(), low[a:b].tolist(), hot[a:b].tolist(), strict=True):
                    run = text[f : f + k + LENGTH - 1]
                    for x, at, m in parts_of(run, key) if finer else [(key, 0, k)]:
                        out.append(run[at : at + m + LENGTH - 1])
                        source.append(np.array([i]))
                        lows.append(np.array([x]))
                        firsts.append(np.array([f + at]))
            if out:
                take = pa.array(np.concatenate(source))
                k = part.column(0).take(take)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lows)), pc.if_else(pc.equal(k, NONE), None, k), part.column(1).take(take), pa.array(np.concatenate(firsts)), pa.array(out, pa.binary())], names=["low", "doc", "row", "first", "text"])

    def shard(batches):
        def done(held):
            for doc, row, first, n in held.later():
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NONE), pa.array(row), pa.array(first), pa.array(n.astype(np.int32))], names=["doc", "row", "first", "n"])

        held, last = Shard(), None
        for part in slices(batches, "text", TAKEN // 2):
            low = part.column(0).to_numpy()
            doc = part.column(1).fill_null(NONE).to_numpy()
            row, first, texts = part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_pylist()
            k = 0
            if held.size > TAKEN and (other := low != last).any():
                # whole fingerprints only: what goes on from before stays with it
                if k := int(np.argmax(other)):
                    held.put(doc[:k], row[:k], first[:k], texts[:k], low[:k])
                yield from done(held)
                held = Shard()
            held.put(doc[k:], row[k:], first[k:], texts[k:], low[k:])
            last = low[-1]
        if held.size:
            yield from done(held)

    near = _joined(packed, own).mapInArrow(texts, "low long, doc long, row long, first long, text binary").repartition("low").sortWithinPartitions("low", "doc", "row", "first")
    return near.mapInArrow(shard, "doc long, row long, first long, n int")


def cut(text: bytes, marks: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The remaining bytes; bytes removed; maximal removed runs.  A mark is a first window and a count."""
    if not len(marks):
        return text, 0, 0
    m = np.asarray(marks, np.int64)
    m = m[np.argsort(m[:, 0], kind="stable")]
    end = np.maximum.accumulate(m[:, 0] + m[:, 1] + LENGTH - 1)
    head = np.flatnonzero(np.concatenate(([True], m[1:, 0] > end[:-1])))
    starts, ends = m[head, 0].tolist(), end[np.append(head[1:], len(m)) - 1].tolist()
    keep = [text[e:s] for e, s in zip([0, *ends], [*starts, len(text)], strict=True)]
    return b"".join(keep), sum(ends) - sum(starts), len(starts)


def marked(docs: DataFrame) -> DataFrame:
    """k, row, z (the text packed), marks: array of (first, n), a row for each row of docs."""
    keyed = _keyed(docs)
    packed = _packed(keyed)
    seen = stored(_classes(_found(keyed)))
    part = _compared(packed, seen.where("compare"), seen.where("compare is null").select("low"))
    marks = seen.where("not compare").select("doc", "row", "first", "n").unionByName(part)
    return _joined(packed, _by_document(marks, "first", "n"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256."""

    def work(batches):
        own = zstandard.ZstdDecompressor()
        for part in slices(batches, "z", 2 << 20):
            marks = np.stack(_flat(part), 1).astype(np.int64)
            texts = [(own.decompress(z.as_buffer()), a, b) for _, z, (a, b) in _unpacked(part, own)]
            rows = [(len(t), *cut(t, marks[a:b])) for t, a, b in texts]
            kept = [r[1] for r in rows]
            k = part.column(0)
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(pc.equal(k, NONE), None, k), pa.array(kept, pa.binary()), *(pa.array([r[j] for r in rows], pa.int64()) for j in (0, 2, 3)), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return marked(docs).mapInArrow(work, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
