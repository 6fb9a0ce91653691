"""SimHash near-duplicates, by a binary trie self-join on fingerprints.

A bit of a fingerprint is 1 if more than half of the shingles' hashes have
it.  Equal fingerprints are one node.  Two fingerprints that differ in at
most BUDGET bits agree in at least m - BUDGET of any m blocks of bits; for
each choice of m - BUDGET blocks the fingerprints are written with those
bits first and dealt out by them, so every linked pair meets in some group,
whatever m is; m only balances rows against pairs, and follows the number of
fingerprints.  A group that a sample of the fingerprints shows to be large (thousands of
millions of near copies share most bits) is dealt again: two of its fingerprints differ
in the bits that it has not fixed only, so these are cut in the same way, into so many blocks
that FREE bits are left at most.  So a task holds at most 2^FREE fingerprints of such a group,
whatever the data; the sample decides how rows are dealt, not which pairs meet.  A group is a subtree of a binary trie (a sorted array is one:
a node is a range).  The self-join goes down pairs of nodes, adds up
differing bits, and drops a pair when it is over the budget, or when
both nodes lie in one component already, which keeps groups of
thousands of near copies from giving all their pairs: only links that join
what is not yet joined are returned, at most one fewer than the nodes.

Components come from star steps over those links.  A text without words has
fingerprint zero (null and empty too); texts of fewer than four words have
one shingle, the whole sequence; a text of any length is hashed whole.  Repeated
rows link like any copies; the component's id is its smallest doc_id that is not
null (null if all are).  Columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, durable, numbered
from .components import components

SHINGLE = 4
BUDGET = 4
SEED = 42
#: Fingerprints of whole groups that a task takes at once, bits that a large group's finer layouts leave free, and node pairs.
TAKEN = 1 << 19
FREE = 20
PAIRS = 1 << 18


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    last = (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):
        ones += np.unpackbits(h[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns of docs, and __fp: the fingerprint as a signed long."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return append_arrow(docs, make, [("__fp", T.LongType())])


def blocks_for(n: int, budget: int = BUDGET) -> int:
    """How many blocks to cut 64 bits into for n fingerprints: rows against expected pairs."""
    def cost(m: int) -> float:
        keys = math.comb(m, budget)
        return keys * (1 + n / 2 ** (64 * (m - budget) / m) / 20)

    return min(range(budget + 1, budget + 5), key=cost)


def layouts(m: int, budget: int = BUDGET, width: int = 64) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of blocks of the last `width` bits: all blocks as (shift, bits), the bits before them
    and the chosen ones first, and the number of those bits."""
    edge = [width * i // m for i in range(m + 1)]
    cuts = [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]
    fixed = [(width, 64 - width)] if width < 64 else []
    out = []
    for pick in itertools.combinations(range(m), m - budget):
        order = [*fixed, *(cuts[i] for i in pick), *(cuts[i] for i in range(m) if i not in pick)]
        out.append((order, 64 - width + sum(cuts[i][1] for i in pick)))
    return out


def finer(bits: int, budget: int = BUDGET) -> list[tuple[list[tuple[int, int]], int]]:
    """Layouts of a group that has fixed `bits` bits; they leave at most FREE bits free."""
    width = 64 - bits
    left = lambda m: budget * (width // m) + min(budget, width % m)
    return layouts(next(m for m in range(budget + 1, 65) if left(m) <= FREE), budget, width)


class Ways:
    """All layouts by number: those of all fingerprints, then the finer ones of each."""

    def __init__(self, m: int):
        self.plan = layouts(m)
        self.fine = {bits: finer(bits) for bits in {bits for _, bits in self.plan}}
        counts = [len(self.fine[bits]) for _, bits in self.plan]
        self.first = [len(self.plan) + n for n in itertools.accumulate(counts, initial=0)]

    def of(self, k: int) -> tuple[list[list[tuple[int, int]]], int]:
        """The arrangements of layout k, one after the other, and the bits that it fixes."""
        if k < len(self.plan):
            return [self.plan[k][0]], self.plan[k][1]
        own = bisect.bisect_right(self.first, k) - 1
        order, bits = self.fine[self.plan[own][1]][k - self.first[own]]
        return [self.plan[own][0], order], bits


def arranged(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for shift, bits in order:
        out = (out << np.uint64(bits)) | ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
    return out


def restored(r: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, low = np.zeros(len(r), np.uint64), 64
    for shift, bits in order:
        low -= bits
        out |= ((r >> np.uint64(low)) & np.uint64((1 << bits) - 1)) << np.uint64(shift)
    return out


class Forest:
    """Components of numbers 0..n-1, and the links that made them."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def labels(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.labels()
        open_ = up[a] != up[b]
        if not open_.any():
            return
        parent = up.tolist()

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pairs = np.unique(np.stack([a[open_], b[open_]], 1), axis=0)
        for x, y in pairs.tolist():
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.links.append((x, y))
        self.up = np.array(parent)


def trie_join(r: np.ndarray, depth: int, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Links between places of the sorted array r that join its components under
    "same first `depth` bits and at most `budget` different ones"."""
    n = len(r)
    if n < 2:
        return []
    forest = Forest(n)
    top = r >> np.uint64(64 - depth)
    # neighbours by several orders are tested first: it joins most of a large group of near copies
    for turn in range(0, 64 - depth, 8):
        low = r << np.uint64(depth) >> np.uint64(depth)
        turned = (low << np.uint64(turn) | low >> np.uint64(64 - depth - turn)) & np.uint64((1 << (64 - depth)) - 1) if turn else low
        order = np.lexsort((turned, top))
        a, b = order[:-1], order[1:]
        near = (top[a] == top[b]) & (np.bitwise_count(r[a] ^ r[b]) <= budget)
        forest.join(a[near], b[near])
    first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    last = np.concatenate((first[1:], [n]))
    big = last - first > 1
    root = np.stack([first[big], last[big], first[big], last[big], np.zeros(int(big.sum()), np.int64)])
    stack = [(depth, root)]
    while stack:
        d, x = stack.pop()
        if x.shape[1] > PAIRS:
            half = x.shape[1] // 2
            stack += [(d, x[:, :half]), (d, x[:, half:])]
            continue
        label = forest.labels()
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        x = x[:, ~((change[x[0]] == change[x[1] - 1]) & (change[x[2]] == change[x[3] - 1]) & (label[x[0]] == label[x[2]]))]
        small = ((x[1] - x[0]) * (x[3] - x[2]) <= 9) | (d >= 64)
        leaf = x[:, small]
        if leaf.shape[1]:
            wide = leaf[3] - leaf[2]
            size = (leaf[1] - leaf[0]) * wide
            which = np.repeat(np.arange(leaf.shape[1]), size)
            nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            a, b = leaf[0][which] + nth // wide[which], leaf[2][which] + nth % wide[which]
            near = (a < b) & (np.bitwise_count(r[a] ^ r[b]) <= budget)
            forest.join(a[near], b[near])
        x = x[:, ~small]
        if not x.shape[1]:
            continue
        bit = np.uint64(63 - d)
        middle = lambda lo: np.searchsorted(r, (r[lo] >> bit | np.uint64(1)) << bit)
        m, k = np.clip(middle(x[0]), x[0], x[1]), np.clip(middle(x[2]), x[2], x[3])
        own = x[0] == x[2]
        parts = [
            np.stack([x[0], m, x[2], k, x[4]]),
            np.stack([m, x[1], k, x[3], x[4]]),
            np.stack([x[0], m, k, x[3], x[4] + 1]),
            np.stack([m, x[1], x[2], k, x[4] + 1])[:, ~own],
        ]
        y = np.concatenate(parts, 1)
        y = y[:, (y[0] < y[1]) & (y[2] < y[3]) & (y[4] <= budget)]
        if y.shape[1]:
            stack.append((d + 1, y))
    return forest.links


def _row(k: int, r: np.ndarray, bits: int) -> pa.RecordBatch:
    group = (r >> np.uint64(64 - bits)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), k, np.int32)), pa.array(group), pa.array(r.view(np.int64))], names=["k", "g", "r"])


def links(fps: DataFrame, count: int, taken: int = TAKEN) -> DataFrame:
    """u, v: links between distinct fingerprints (column __fp) that make their components.

    taken: about so many fingerprints make a group large, to be dealt by finer layouts."""
    ways = Ways(blocks_for(count))

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, (order, bits) in enumerate(ways.plan):
                yield _row(k, arranged(fp, order), bits)

    def deal_again(batches):
        for batch in batches:
            k, r, large = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~large)).select(["k", "g", "r"])
            for own in np.unique(k[large]).tolist():
                for j, (order, bits) in enumerate(ways.fine[ways.plan[own][1]]):
                    yield _row(ways.first[own] + j, arranged(r[large & (k == own)], order), bits)

    def meet(batches):
        held: list[np.ndarray] = []
        own = -1

        def done(parts):
            if not parts:
                return
            orders, bits = ways.of(own)
            r = np.sort(np.concatenate(parts))
            if pairs := trie_join(r, bits):
                fp = r
                for order in reversed(orders):
                    fp = restored(fp, order)
                i, fp = np.array(pairs), fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp[i[:, 0]]), pa.array(fp[i[:, 1]])], names=["u", "v"])

        for batch in batches:
            k, r = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            for start, stop in itertools.pairwise([0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]):
                if stop == start:
                    continue
                part = r[start:stop]
                if k[start] != own:
                    yield from done(held)
                    held, own = [], int(k[start])
                elif sum(map(len, held)) > TAKEN:
                    # groups are in order: all but the newest one are complete
                    free = np.uint64(64 - ways.of(own)[1])
                    g, before = part >> free, held[-1][-1] >> free
                    cut = int(np.argmax(g != before)) if (g != before).any() else None
                    if cut is not None:
                        held.append(part[:cut])
                        yield from done(held)
                        held, part = [], part[cut:]
                held.append(part)
        yield from done(held)

    shape = "k int, g long, r long"
    dealt = fps.select("__fp").mapInArrow(deal, shape)
    if count > taken:  # else no group can be large
        share = max(1, taken // 64)
        some = fps.select("__fp").where(F.pmod(F.xxhash64("__fp"), F.lit(share)) == 0).mapInArrow(deal, shape)
        large = durable(some.groupBy("k", "g").agg(F.count("*").alias("large")).where(F.col("large") >= max(1, taken * 3 // 4 // share)))
        if groups := large.count():  # at most a row for each `taken` rows dealt, about
            dealt = dealt.join(F.broadcast(large) if groups <= 1 << 20 else large, ["k", "g"], "left").select("k", "g", "r", "large").mapInArrow(deal_again, shape)
    near = dealt.repartition("k", "g").sortWithinPartitions("k", "g")
    return near.mapInArrow(meet, "u long, v long")


#: Stands for a null doc_id in joins.
NONE = -(2**63)


def clustered(docs: DataFrame) -> DataFrame:
    """doc_id, __fp, __text (a hash), __root, __component: one row for each row of docs; __root names a component, __component is its id."""
    own = fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    marked = durable(own.select("doc_id", "__fp", F.xxhash64("text").alias("__text")))
    nodes = marked.groupBy("__fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(nodes, nodes.count()))
    rooted = nodes.join(linked.select(F.col("u").alias("__fp"), F.col("v").alias("__root")), "__fp", "left").withColumn("__root", F.coalesce("__root", "__fp"))
    # grouped by another form of the key, so the join's sides have exchanges of their own and a large component can be split
    least = rooted.groupBy(F.struct("__root").alias("g")).agg(F.min("least").alias("__component")).select("g.__root", "__component")
    return marked.join(rooted.join(least, "__root").select("__fp", "__root", "__component"), "__fp")


def digest(docs: DataFrame) -> DataFrame:
    got = clustered(docs)
    return got.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, one row of it, with its own columns.

    In a component whose doc_ids are all null one of its rows stays."""
    number = lambda c: F.coalesce(c.cast("long"), F.lit(NONE))
    first = clustered(docs).where(F.col("doc_id").eqNullSafe(F.col("__component")))
    kept = first.groupBy("__root").agg(F.min(F.struct(number(F.col("doc_id")).alias("k"), F.col("__text").alias("t"))).alias("m")).select("m.*")
    named = numbered(docs)
    doc, text = (named[f"c{docs.columns.index(x)}"] for x in ("doc_id", "text"))
    rows = named.withColumns({"k": number(doc), "t": F.xxhash64(text)})
    # repeated rows are next to each other after the join, which dealt them by the same keys
    return rows.join(kept, ["k", "t"]).dropDuplicates(["k", "t"]).select(*named.columns).toDF(*docs.columns)
