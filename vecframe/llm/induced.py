"""External induced sorting: the suffixes of a string in order, and what neighbours have in common.

A place is S if its suffix is less than the next one, L if greater; an S place
after an L place is LMS.  A block is a suffix's symbols up to its next LMS place
(and with it), so it stands for the types too: where one block is another's
beginning, the shorter one is S there and the greater.  The order of LMS suffixes
gives that of all: a suffix is the tuple (block, rank of the LMS suffix at its
end).  LMS suffixes themselves are ordered by naming their blocks and by recursion
on the string of names.

Tuples go through disk-backed priority queues.  The common prefix of neighbours
comes out with them: equal symbols of two blocks, or, for equal blocks, the
block and the least common prefix between the two ranks, which the recursion
hands up.  Strings, ranks and common prefixes are arrays in memory or, over
HELD bytes, in files, and are passed over in chunks; nothing is hashed.

Files are made in the folders that Spark gives its own spills.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of an array, and tuples of a queue, that are held in memory; items that are worked on at once.
HELD = 32 << 20
TUPLES = 1 << 20
CHUNK = 1 << 18
#: Common prefixes are told up to this many symbols.
CAP = 100


def _file():
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def room(n: int, dtype) -> np.ndarray:
    """n zeros, in a file if they are many."""
    size = n * np.dtype(dtype).itemsize
    if size <= HELD:
        return np.zeros(n, dtype)
    with _file() as f:
        f.truncate(size)
        return np.memmap(f, dtype, "r+", shape=(n,))


class Spool:
    """An array that grows at its end, in a file if it is long."""

    def __init__(self, dtype):
        self.dtype, self.parts, self.size, self.count, self.file = np.dtype(dtype), [], 0, 0, None

    def put(self, x: np.ndarray) -> None:
        self.parts.append(x.astype(self.dtype, copy=False))
        self.size += x.size * self.dtype.itemsize
        self.count += x.size
        if self.size > HELD:
            self.file = self.file or _file()
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts, self.size = [], 0

    def done(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        for p in self.parts:
            self.file.write(p.tobytes())
        self.file.flush()
        with self.file as f:
            return np.memmap(f, self.dtype, "r+", shape=(self.count,))


def order_of(keys) -> np.ndarray:
    """The order by several columns, the first one first."""
    out = np.argsort(keys[0])
    s = keys[0][out]
    new = np.ones(len(out), bool)
    new[1:] = s[1:] != s[:-1]
    for key in keys[1:]:
        # only what is equal so far
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, value = np.cumsum(new[at]), key[out[at]]
        bits = int(value.max()).bit_length()
        if bits + len(at).bit_length() < 64:
            turn = np.argsort(group.astype(np.uint64) << np.uint64(bits) | value.astype(np.uint64))
        else:
            turn = np.lexsort((value, group))
        out[at], value = out[at][turn], value[turn]
        new[at[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])
    return out


class Heap:
    """A priority queue of tuples, given as columns, of which the first `keys` are the key: it fills, then empties in order."""

    def __init__(self, keys: int):
        self.keys, self.parts, self.size, self.runs = keys, [], 0, []

    def put(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > TUPLES:
            self._spill()

    def _ordered(self, parts) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = order_of(columns[: self.keys])
        return [c[order] for c in columns]

    def _spill(self) -> None:
        columns, f = self._ordered(self.parts), _file()
        self.parts, self.size = [], 0
        for lo in range(0, len(columns[0]), CHUNK // 4):
            for c in columns:
                f.write(c[lo : lo + CHUNK // 4].tobytes())
        self.runs.append((f, len(columns[0]), [c.dtype for c in columns]))

    def _read(self, f, n: int, kinds):
        f.seek(0)
        for lo in range(0, n, CHUNK // 4):
            k = min(CHUNK // 4, n - lo)
            yield [np.frombuffer(f.read(k * t.itemsize), t) for t in kinds]
        f.close()

    def _upto(self, columns, bound) -> int:
        lo, hi = 0, len(columns[0])
        for c, b in zip(columns, bound, strict=False):
            lo, hi = (lo + int(np.searchsorted(c[lo:hi], b, side)) for side in ("left", "right"))
        return hi

    def pop(self):
        """The tuples in order, in blocks of columns."""
        if not self.runs:
            if self.parts:
                columns = self._ordered(self.parts)
                self.parts = []
                for lo in range(0, len(columns[0]), CHUNK):
                    yield [c[lo : lo + CHUNK] for c in columns]
            return
        if self.parts:
            self._spill()
        readers = [self._read(*run) for run in self.runs]
        heads = [next(r) for r in readers]
        while readers:
            # the run whose block ends first gives all of it, the others what is not beyond
            bound = min(tuple(c[-1] for c in h[: self.keys]) for h in heads)
            out = []
            for i in reversed(range(len(readers))):
                n = self._upto(heads[i], bound)
                out.append([c[:n] for c in heads[i]])
                if n < len(heads[i][0]):
                    heads[i] = [c[n:] for c in heads[i]]
                elif (more := next(readers[i], None)) is not None:
                    heads[i] = more
                else:
                    del heads[i], readers[i]
            yield self._ordered(out)


class RangeMin:
    """The least of any range of small numbers: minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        k = 1
        while 2 * k <= len(values):
            last, n = self.levels[-1], len(values) - 2 * k + 1
            level = room(n, np.uint8)
            for lo in range(0, n, CHUNK):
                hi = min(n, lo + CHUNK)
                level[lo:hi] = np.minimum(last[lo:hi], last[lo + k : hi + k])
            self.levels.append(level)
            k *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo] to values[hi], for each pair."""
        out = np.empty(len(lo), np.uint8)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            table = self.levels[k]
            out[own] = np.minimum(table[lo[own]], table[hi[own] + 1 - (1 << k)])
        return out


class String:
    """Symbols over 0, which stands once, at the end; `bits` hold every symbol and one above all."""

    def __init__(self, x: np.ndarray, bits: int, words: int):
        """x: the symbols, the 0, and zeros for `words` words more."""
        self.x, self.bits, self.words = x, bits, words
        self.wide = 64 // bits
        self.reach = self.wide * words
        self.n = len(x) - 1 - self.reach
        self.pad = np.array([(1 << ((self.wide - k) * bits)) - 1 for k in range(self.wide + 1)], np.uint64)
        self.lms = self._lms()

    def _lms(self) -> np.ndarray:
        """LMS places in order; the last one is that of the 0."""
        most = self.n // 2 + 2
        out, at, after = room(most, np.int64), most, True
        for lo in range((self.n - 1) // CHUNK * CHUNK, -1, -CHUNK):
            part = self.x[lo : min(self.n, lo + CHUNK) + 1]
            # an equal one is what the next different one is
            same = np.where(part[:-1] == part[1:], len(part) - 1, np.arange(len(part) - 1))
            small = np.append(part[:-1] < part[1:], after)
            small = np.append(small[np.minimum.accumulate(same[::-1])[::-1]], after)
            own = np.flatnonzero(small[1:] & ~small[:-1]) + lo + 1
            out[at - len(own) : at] = own
            at, after = at - len(own), small[0]
        if not self.n:
            at -= 1
            out[at] = 0
        return out[at:]

    def keys(self, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The first words of the blocks of `size` symbols at these places; what is over their end is greater than any symbol."""
        out = []
        for t in range(self.words):
            key = np.zeros(len(at), np.uint64)
            for k in range(t * self.wide, (t + 1) * self.wide):
                key = key << np.uint64(self.bits) | self.x[at + k]
            out.append(key | self.pad[np.clip(size - t * self.wide, 0, self.wide)])
        return out

    def tuples(self, places, rank: np.ndarray | None) -> Heap:
        """Blocks, rank of the LMS suffix at their end (0 where the block fills its words and may go on), place, size, number of that LMS place."""
        heap = Heap(self.words + (rank is not None))
        for at in places:
            if not len(at):
                continue
            # places are in order, so their LMS places are in a part of the table
            first, last = np.searchsorted(self.lms, at[[0, -1]], "right")
            near = self.lms[first : last + 1]
            j = np.searchsorted(near, at, "right")
            size = near[j] - at + 1
            own = np.zeros(len(at), np.int64) if rank is None else np.where(size < self.reach, rank[first : last + 1][j], 0)
            heap.put(*self.keys(at, np.minimum(size, self.reach)), own, at, size, j + first)
        return heap

    def refined(self, columns: list[np.ndarray], rank: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """Blocks that fill their words, equal so far, are ordered by what follows.  Also: whether a block equals the one before."""
        *_, size, end = columns
        new = np.ones(len(size), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in columns[: self.words]])
        group, gone = np.cumsum(new), self.reach
        todo = np.flatnonzero(size >= gone)
        while len(todo):
            # only those with a neighbour that is equal so far
            g = group[todo]
            twin = np.zeros(len(todo), bool)
            twin[1:] = g[1:] == g[:-1]
            twin[:-1] |= g[1:] == g[:-1]
            todo = todo[twin]
            if not len(todo):
                break
            g, n = group[todo], size[todo] - gone
            more = self.keys(columns[-3][todo] + gone, np.minimum(n, self.reach))
            last = np.zeros(len(todo), np.int64) if rank is None else np.where(n < self.reach, rank[end[todo]], 0)
            turn = order_of((g, *more, last))
            for c in columns:
                c[todo] = c[todo[turn]]
            fresh = np.logical_or.reduce([g[1:] != g[:-1], *(k[turn][1:] != k[turn][:-1] for k in more)])
            new[todo[1:]] = fresh
            # groups become finer; their numbers stay in order
            group[todo] = np.concatenate(([0], np.cumsum(fresh)))
            gone += self.reach
            todo = todo[size[todo] >= gone]
        return columns, ~new

    def ordered(self, places, rank: np.ndarray | None, least: RangeMin | None):
        """Blocks (places in the order of their suffixes; whether the block is the one before's; common prefix with the one before).

        Without ranks, in the order of their blocks only, without common prefixes, and numbers of the LMS places at their ends in place of places."""
        before: list[np.ndarray] | None = None
        for columns in self._whole_groups(self.tuples(places, rank).pop()):
            columns, same = self.refined(columns, rank)
            both = columns if before is None else [np.concatenate(c) for c in zip(before, columns, strict=True)]
            shared = np.zeros(len(same), np.uint8)
            if least is not None:
                got = self.common(both, least)
                shared[len(shared) - len(got) :] = got
            # a group of blocks that have ended may come in several parts
            same[0] = before is not None and all(k[0] == b[0] for k, b in zip(columns[: self.words], before, strict=False)) and columns[-2][0] < self.reach
            yield columns[-1] if rank is None else columns[-3], same, shared
            before = [c[-1:] for c in columns]

    def _whole_groups(self, blocks):
        """Cut blocks so that tuples with the same words are not apart where these are full."""
        held = None
        for columns in blocks:
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            cut = n = len(columns[0])
            if columns[-2][-1] >= self.reach:
                other = np.logical_or.reduce([k != k[-1] for k in columns[: self.words]])
                cut = int(n - np.argmax(other[::-1])) if other.any() else 0
            held = [c[cut:] for c in columns]
            if cut:
                yield [c[:cut].copy() for c in columns]
        if held is not None and len(held[0]):
            yield [c.copy() for c in held]

    def common(self, columns: list[np.ndarray], least: RangeMin) -> np.ndarray:
        """Common prefixes of neighbours."""
        *keys, own, at, size, _ = columns
        a, b = at[:-1], at[1:]
        n = np.minimum(size[:-1], size[1:])
        out = np.zeros(len(a), np.int64)
        open_ = np.ones(len(a), bool)
        for k in keys:
            x, y = k[:-1], k[1:]
            for s in range((self.wide - 1) * self.bits, -1, -self.bits):
                open_ &= x >> np.uint64(s) == y >> np.uint64(s)
                out += open_
        equal = np.flatnonzero(open_ & (n < self.reach))
        if len(equal):
            out[equal] = n[equal] - 1 + least.of(own[:-1][equal] + 1, own[1:][equal])
        # full words, or one block begins the other: go on symbol by symbol
        rest = np.flatnonzero((open_ & (n >= self.reach)) | (~open_ & (out >= n)))
        if len(rest):
            out[rest] = self.extended(a[rest], b[rest], np.minimum(out[rest], n[rest]))
        return np.minimum(out, CAP).astype(np.uint8)

    def extended(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Common prefixes from `length` symbols on."""
        out = np.minimum(length, CAP)
        go = np.flatnonzero(out < CAP)
        while len(go):
            go = go[self.x[a[go] + out[go]] == self.x[b[go] + out[go]]]
            out[go] += 1
            go = go[out[go] < CAP]
        return out

    def ranked(self) -> tuple[np.ndarray, RangeMin]:
        """Ranks of the LMS suffixes, in the order of their places, and common prefixes of neighbours by rank."""
        lms, m = self.lms, len(self.lms)
        name, count = room(m + 1, np.int64), 0
        for end, same, _ in self.ordered(_parts(lms[:-1]), None, None):
            own = count + np.cumsum(~same)
            name[end - 1] = own
            count = int(own[-1])
        rank, shared = room(m, np.int64), room(m, np.uint8)
        done, last = 1, np.full(1, m - 1)
        for j, names in self._by_name(name[:m], count):
            both = np.concatenate((last, j))
            # equal names are equal symbols; the rest is compared
            start = lms[j + names] - lms[j]
            shared[done : done + len(j)] = self.extended(lms[both[:-1]], lms[both[1:]], start)
            rank[j] = np.arange(done, done + len(j))
            done, last = done + len(j), j[-1:]
        return rank, RangeMin(shared)

    def _by_name(self, name: np.ndarray, count: int):
        """LMS places by number, in the order of their suffixes, and the names they share with the one before."""
        m = len(name)
        if count == m - 1:
            order = room(m, np.int64)
            for lo in range(0, m - 1, CHUNK):
                hi = min(m - 1, lo + CHUNK)
                order[name[lo:hi]] = np.arange(lo, hi)
            for lo in range(1, m, CHUNK):
                j = np.asarray(order[lo : lo + CHUNK])
                yield j, np.zeros(len(j), np.int64)
            return
        bits = (count + 1).bit_length()
        words = 1 if 64 // bits >= 6 else 2
        x = room(m + 64 // bits * words, np.uint32 if bits <= 32 else np.uint64)
        for lo in range(0, m, CHUNK):
            x[lo : min(m, lo + CHUNK)] = name[lo : lo + CHUNK]
        for j, _, shared in String(x, bits, words).suffixes():
            yield j, shared.astype(np.int64)

    def suffixes(self, places=None):
        """Blocks of (places, -, common prefixes) of all suffixes in order, or of the places given (arrays, in order)."""
        if self.n:
            rank, least = self.ranked()
            yield from self.ordered(places if places is not None else (np.arange(lo, min(self.n, lo + CHUNK)) for lo in range(0, self.n, CHUNK)), rank, least)


def _parts(x: np.ndarray):
    for lo in range(0, len(x), CHUNK):
        yield np.asarray(x[lo : lo + CHUNK])


def of_bytes(x: np.ndarray) -> String:
    """x: bytes under 254, each greater by one, and nine zeros."""
    return String(x, 8, 1)
