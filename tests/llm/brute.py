"""Second implementations of the operators, by brute force; for tests only."""

import hashlib
import itertools
import math

import xxhash

from vecframe.llm import decontaminate, line_dedup, suffix_dedup


def suffixes(docs, length=100):
    """The rows of op4 from a dictionary of all windows; for tests (distinct doc_ids)."""
    seen: set[bytes] = set()
    got = {}
    for d, t in sorted((d, (t or "").encode()) for d, t in docs):
        marks = []
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                marks.append((i, 1))
            else:
                seen.add(w)
        keep, removed, spans = suffix_dedup.cut(t, marks)
        got[d] = (d, len(t), removed, spans, hashlib.sha256(keep).hexdigest())
    return [got[d] for d, _ in docs]


def near(docs, budget=4):
    """The rows of op5 by all pairs of documents; for tests."""
    words = [[w for w in (t or "").encode().lower().split()] for _, t in docs]
    prints = []
    for w in words:
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 4 + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(docs)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                p, q = root(i), root(j)
                comp[max(p, q)] = min(p, q)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(docs)]


def linked(edges):
    """Each node that is not the least of its component, and that least node; for tests."""
    comp: dict[int, int] = {}
    for x in itertools.chain.from_iterable(edges):
        comp.setdefault(x, x)
    moved = True
    while moved:
        moved = False
        for x, y in edges:
            low = min(comp[x], comp[y])
            moved |= comp[x] != low or comp[y] != low
            comp[x] = comp[y] = low
    return {x: low for x, low in comp.items() if x != low}


def contamination(docs, items, window=13):
    """The rows of op9 from sets of tuples; for tests."""
    wins: dict[tuple, set[str]] = {}
    for i, t in items:
        w = decontaminate.words((t or "").encode())
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = {len(x) for x in wins}
    out = []
    for d, t in docs:
        w = decontaminate.words((t or "").encode())
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def lines(docs, run=3, heavy=50):
    """The rows of op10 from a dictionary of windows; for tests."""
    seen: dict[tuple, tuple] = {}
    marks: dict[tuple, list] = {}
    rows = sorted({(d, xxhash.xxh64_intdigest((t or "").encode()), t or "") for d, t in docs})
    for d, h, t in rows:
        lines, own = line_dedup.lines_of(t.encode())
        for i in range(len(own)):
            for k in sorted({1, 2, run}):
                w = tuple(lines[j] for j in own[i : i + k])
                if len(w) == k and (k == run or sum(len(x.split()) for x in w) >= heavy):
                    if w in seen and seen[w] < (d, h, i):
                        marks.setdefault((d, t), []).append((i, k))
                    seen.setdefault(w, (d, h, i))
    out = []
    for d, t in docs:
        got = line_dedup.cut((t or "").encode(), marks.get((d, t or ""), []))
        out.append((d, got[1], got[2], len(got[0].decode()), hashlib.sha256(got[0]).hexdigest()))
    return out


def page(body):
    """(html, main text) of a tree of [tag, kids] and texts, by the definitions; no articles, no class names."""

    def write(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(write, x[1]))}</{x[0]}>"

    def letters(x):
        return len("".join(x.split())) if isinstance(x, str) else sum(map(letters, x[1]))

    def tags(x):
        return 0 if isinstance(x, str) else sum(tags(k) + (not isinstance(k, str)) for k in x[1])

    def linked(x, inside=False):
        inside = inside or x[0] == "a" and not isinstance(x, str)
        return sum((letters(k) if inside else 0) if isinstance(k, str) else linked(k, inside) for k in x[1])

    def links(x):
        return 0 if isinstance(x, str) else (x[0] == "a") + sum(map(links, x[1]))

    share = linked(body) / max(1, letters(body))

    def density(x, in_link=False):
        c = letters(x)
        lc, t, lt = (c if in_link else 0, 0, 0) if isinstance(x, str) else (linked(x), tags(x), links(x))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base + 1e-9) if base > 1.000001 else c / max(1, t) * math.log(max(1.0, c * max(1, t)) + 1)

    def total(x):
        return sum(density(k, x[0] == "a") for k in x[1])

    def under(x):
        return [x, *(y for k in x[1] if not isinstance(k, str) for y in under(k))]

    up = {id(k): x for x in under(body) for k in x[1] if not isinstance(k, str)}
    if not letters(body):
        return write(body), ""
    x = max(under(body), key=total)
    low = density(x)
    while id(x) in up:
        x = up[id(x)]
        low = min(low, density(x))
    block = lambda x: x[0] in ("div", "p", "ul", "li", "body")
    chosen = set()
    centre = max(under(body), key=total)
    chosen.add(id(centre))
    for x in under(body):
        if letters(x) and density(x) >= low:
            y = max(under(x), key=total)
            while not block(y):
                y = up[id(y)]
            chosen.add(id(y))
    out, line = [], []

    def flush():
        if " ".join("".join(line).split()):
            out.append(" ".join("".join(line).split()))
        line.clear()

    def read(x, on):
        if isinstance(x, str):
            if on:
                line.append(x)
            return
        if block(x) and links(x) >= 3 and linked(x) > 0.6 * letters(x):
            return
        begins = id(x) in chosen and not on
        if block(x) or begins:
            flush()
        for k in x[1]:
            read(k, on or begins)
        if block(x) or begins:
            flush()

    read(body, False)
    return write(body), "\n".join(out)


def parsing(text):
    """All names of all levels of locally consistent parsing, symbol by symbol, as (level, name)."""
    mask = (1 << 64) - 1
    k1, k2, power = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25

    def toss(before, own, bits):
        d = before ^ own
        if d == 0:
            return 2 * bits
        place = (d & -d).bit_length() - 1
        return 2 * place + (own >> place & 1)

    out, level, codes = set(), 0, list(text)
    while codes:
        level += 1
        label = [0] + [toss(a, b, 8 if level == 1 else 64) for a, b in zip(codes, codes[1:])]
        for bits in (5, 4) if level == 1 else (8, 5, 4):
            label = [0] + [toss(a, b, bits) for a, b in zip(label, label[1:])]
        n = len(codes)
        starts = [i for i in range(n) if i == 0 or (4 < i < n - 1 and label[i] > label[i - 1] and label[i] >= label[i + 1])]
        names = []
        for s, e in zip(starts, [*starts[1:], n]):
            h = 0
            for i, x in enumerate(codes[s:e]):
                x = ((x + 1) * k1 & mask) ^ (((x + 1) * k2 & mask) >> 7) if level == 1 else x * k1 & mask
                h = (h + x * pow(power, i & 4095, 1 << 64) + (i >> 12)) & mask
            h ^= h >> 32
            h = h * k2 & mask
            names.append(h ^ h >> 29)
        out |= {(level, x) for x in names}
        if len(names) == 1:
            break
        codes = names
    return out


def fingerprint(text, bins=64):
    """Minima of the names, bin by bin, as numbers of 16 bits."""
    mask, least = (1 << 64) - 1, {}
    for level, x in parsing(text):
        h = (x + level) * 0x9E3779B97F4A7C15 & mask
        h ^= h >> 31
        least[h % bins] = min(least.get(h % bins, mask), h >> 6)
    return [(least[b] & 0xFFFF or 1) if b in least else 0 for b in range(bins)]
