"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels mark whole documents, so tokens are labelled first: a feature of a token (its
word, its first 4, 5 and 6 bytes) is a seed if it occurs in at least SEED_DOCS
toxic training documents and its smoothed log-odds against the others, less
SEED_ERRORS standard errors, are over SEED_ODDS; tokens of toxic documents
with a seed are toxic.  Two
labels, those features and the transitions make the field, fitted by AdaGrad
on the exact gradient (forward-backward) of labelled windows: every token of the
sampled rows with one of those features is in one, and two random places a document.

Only features that a toxic token had can have a weight, so all other tokens
share one emission.  Forward and backward messages run over the tokens
with weights and cross the gaps by powers of the transfer matrix, which
is the full recursion in fewer steps.  A logistic curve on the log-odds that some
word of a document is toxic (by each word's largest marginal) makes its score;
tokens whose marginal is at least 0.5 make its spans.

The fit uses at most FIT_ROWS labelled rows, chosen by a hash of doc_id from the
rows that are not held out; their whole texts are read one by one and kept as numbers
of words.  Every document is scored from its whole text.  Null and empty texts
have no tokens: the curve's lowest value is their score.  Repeated rows score
alike; a doc_id with several labels has the greatest.  With labels of one class
only, or none, every score is that class's share (0 with none) and nothing is
tagged.  Columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, col, held_out, labelled_sample
from .decontaminate import FOLD
from .quality import curve

FIT_ROWS = 7000
SEED_DOCS = 4
SEED_ODDS = 2.0
SEED_ERRORS = 1.64
SIDE = 8


def features(word: bytes) -> tuple[bytes, ...]:
    return (b"w" + word, *(b"%d" % n + word[:n] for n in (4, 5, 6) if len(word) >= n))


class Corpus:
    """Documents as numbers of words, and the words' features."""

    def __init__(self, sample: Iterable[tuple[int, str | None, int]]):
        number: dict[bytes, int] = {}
        self.docs: list[np.ndarray] = []
        labels = []
        for _, text, label in sample:
            words = (text or "").encode().translate(FOLD).split()
            self.docs.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
            labels.append(1 if label else 0)
        self.toxic, self.words = np.array(labels, np.int64), list(number)
        code: dict[bytes, int] = {}
        #: Of each word; the last feature stands for none.
        self.features = np.full((len(number), 4), -1, np.int32)
        for i, w in enumerate(self.words):
            for k, f in enumerate(features(w)):
                self.features[i, k] = code.setdefault(f, len(code))
        self.names = list(code)
        self.features[self.features < 0] = len(code)

    def seeds(self, rows: np.ndarray) -> np.ndarray:
        """Whether a feature tells the toxic ones of these documents from the others."""
        seen = np.zeros((2, len(self.names) + 1))
        for i in rows.tolist():
            seen[self.toxic[i], np.unique(self.features[np.unique(self.docs[i])])] += 1
        y = self.toxic[rows]
        n1, n0 = int(y.sum()) + 1, int(len(y) - y.sum()) + 1
        k, other = seen[1] + 0.5, seen[0] + 0.5
        odds = np.log(k / n1) - np.log(other / n0) - SEED_ERRORS * np.sqrt(1 / k + 1 / other)
        out = (seen[1] >= SEED_DOCS) & (odds > SEED_ODDS)
        out[-1] = False
        return out


class Field:
    """Weights of a two-label chain: label 1 (toxic) against 0."""

    def __init__(self, weight: dict[bytes, float], bias: float, move: np.ndarray, first: float):
        self.weight, self.bias, self.move, self.first = weight, bias, move, first
        self.known: dict[bytes, float] = {}
        # potentials of a step into a token without weights: rows are the label before
        self.step = np.exp(move) * np.array([1.0, math.exp(bias)])[None, :]
        val, vec = np.linalg.eig(self.step)
        self.top = float(val.real.max())
        self.small = float(val.real.min()) / self.top
        inv = np.linalg.inv(vec)
        k = int(val.real.argmax())
        self.parts = [np.outer(vec[:, i], inv[i]).real for i in (k, 1 - k)]

    def gap(self, n: int) -> np.ndarray:
        """The n-th power of the transfer matrix, over that of its larger eigenvalue."""
        return self.parts[0] + self.parts[1] * self.small**n

    def emission(self, word: bytes) -> float | None:
        """What the word's features add for label 1; None: no feature has a weight."""
        got = self.known.get(word, 0)
        if got != 0:
            return got
        if len(self.known) > 300_000:
            self.known.clear()
        hit = [self.weight[f] for f in features(word) if f in self.weight]
        self.known[word] = out = sum(hit) or 1e-12 if hit else None
        return out

    def marginals(self, words: list[bytes]) -> tuple[list[int], list[float]]:
        """Tokens with weights, and their probability of being toxic."""
        em = self.emission
        at, gain = [], []
        known = self.known
        for i, w in enumerate(words):
            e = known.get(w, 0)
            if e == 0:
                e = em(w)
            if e is not None:
                at.append(i)
                gain.append(e)
        if not at:
            return [], []
        m = np.exp(self.move)
        a, b, c, d = float(m[0, 0]), float(m[0, 1]), float(m[1, 0]), float(m[1, 1])
        eb = math.exp(self.bias)
        alphas, betas = [], [(0.5, 0.5)] * len(at)
        p0, p1, last = 0.0, 0.0, -1
        for i, g in zip(at, gain, strict=True):
            e = math.exp(min(self.bias + g, 60.0))
            if last < 0 and i == 0:
                q0, q1 = 1.0, math.exp(self.first) * e
            else:
                if last < 0:
                    p0, p1, last = 1.0, math.exp(self.first) * eb, 0
                if i - last > 1:
                    k = self.gap(i - last - 1)
                    p0, p1 = p0 * k[0, 0] + p1 * k[1, 0], p0 * k[0, 1] + p1 * k[1, 1]
                q0, q1 = p0 * a + p1 * c, (p0 * b + p1 * d) * e
            z = q0 + q1
            p0, p1, last = q0 / z, q1 / z, i
            alphas.append((p0, p1))
        r0, r1 = 1.0, 1.0
        k = self.gap(len(words) - 1 - at[-1])
        r0, r1 = float(k[0].sum()), float(k[1].sum())
        for j in range(len(at) - 1, -1, -1):
            z = r0 + r1
            r0, r1 = r0 / z, r1 / z
            betas[j] = (r0, r1)
            if j:
                e = math.exp(min(self.bias + gain[j], 60.0))
                r0, r1 = a * r0 + b * e * r1, c * r0 + d * e * r1
                if at[j] - at[j - 1] > 1:
                    k = self.gap(at[j] - at[j - 1] - 1)
                    r0, r1 = k[0, 0] * r0 + k[0, 1] * r1, k[1, 0] * r0 + k[1, 1] * r1
        return at, [float(x1 * y1 / (x0 * y0 + x1 * y1)) for (x0, x1), (y0, y1) in zip(alphas, betas, strict=True)]


def chain(e: np.ndarray, first: float, m: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Forward-backward over windows, a column each: e and first are the factors of label 1, m those of 00, 01, 10, 11.

    The probability of label 1 at each place, and of each pair of labels at neighbours."""
    wide = len(e)
    # messages of label 1, as shares: from the left with the token's own factor, from the right without
    left, right = np.empty(e.shape), np.empty(e.shape)
    q = first * e[0]
    left[0], right[-1] = q / (1 + q), 0.5
    for k in range(1, wide):
        p = left[k - 1]
        q = ((1 - p) * m[1] + p * m[3]) * e[k]
        left[k] = q / ((1 - p) * m[0] + p * m[2] + q)
    for k in range(wide - 2, -1, -1):
        q, r = e[k + 1] * right[k + 1], 1 - right[k + 1]
        u, v = m[0] * r + m[1] * q, m[2] * r + m[3] * q
        right[k] = v / (u + v)
    q = left * right
    a, b = (1 - left[:-1], left[:-1]), (1 - right[1:], e[1:] * right[1:])
    pair = [a[i] * m[2 * i + j] * b[j] for i in (0, 1) for j in (0, 1)]
    total = pair[0] + pair[1] + pair[2] + pair[3]
    return q / (q + (1 - left) * (1 - right)), [x / total for x in pair]


def train(corpus: Corpus, rows: np.ndarray, rounds: int = 15, still: float = 0.03, rate: float = 0.5, penalty: float = 1e-4, seed: int = 5) -> Field | None:
    """A field from these documents and their labels; None if no token can be labelled.

    Ends after `rounds` passes, or one that moves the weights by less than `still` of their length."""
    hot = corpus.seeds(rows)[corpus.features].any(1)
    said = np.zeros(len(corpus.words), bool)
    for i in rows[corpus.toxic[rows] == 1].tolist():
        said[corpus.docs[i]] = True
    used = np.unique(corpus.features[hot & said])
    used = used[used < len(corpus.names)]
    if not len(used):
        return None
    none = len(used)
    number = np.full(len(corpus.names) + 1, none, np.int32)
    number[used] = np.arange(none)
    # words with the same features are one; the first one has none
    kinds, own = np.unique(np.concatenate((np.full((1, 4), none, np.int32), np.sort(number[corpus.features], 1))), axis=0, return_inverse=True)
    blank, own = int(own[0]), own[1:].astype(np.int32)
    rng = np.random.default_rng(seed)
    wide = 2 * SIDE + 1
    parts = []
    for i in rows.tolist():
        d = corpus.docs[i]
        if not len(d):
            continue
        # around all toxic tokens, around all others that share a feature with one, and anywhere; twice the number, and 1 where toxic
        code = np.full(len(d) + 2 * SIDE, 2 * blank, np.int32)
        code[SIDE : SIDE + len(d)] = 2 * own[d] + (hot[d] & bool(corpus.toxic[i]))
        mid, last = rng.integers(0, len(d), 2).tolist(), -wide
        for k in np.flatnonzero(own[d] != blank).tolist():
            # a window stands for all tokens in its second half
            if k - last > SIDE:
                mid.append(k)
                last = k
        parts.append(code[np.array(mid)[:, None] + np.arange(wide)])
    # equal windows count as often as they are there
    x, times = np.unique(np.concatenate(parts).view(np.dtype((np.void, 4 * wide))).ravel(), return_counts=True)
    x = x.view(np.int32).reshape(-1, wide)
    weight, grad_sq = np.zeros(none + 1), np.full(none + 1, 1e-6)
    rest = np.zeros(6)  # bias, first, move
    rest_sq = np.full(6, 1e-6)
    for _ in range(rounds):
        before = weight.copy()
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 1024)):
            t = times[part] / times[part].sum()
            word, y = x[part].T >> 1, x[part].T & 1
            m = np.exp(rest[2:])
            e = np.exp(np.clip(weight[kinds].sum(1) + rest[0], -30, 30))[word]
            toxic, pair = chain(e, math.exp(rest[1]), m)
            move = np.array([(z.sum(0) * t).sum() for z in pair])
            step = 2 * y[:-1] + y[1:]
            off = (toxic - y) * t
            g = np.bincount(word.ravel(), off.ravel(), len(kinds))
            g = np.bincount(kinds.ravel(), np.repeat(g, 4), none + 1) + penalty * weight
            g[none] = 0
            gr = np.concatenate(([off.sum(), off[0].sum()], move - np.bincount(step.ravel(), np.broadcast_to(t, step.shape).ravel(), 4))) + penalty * rest
            grad_sq += g * g
            rest_sq += gr * gr
            weight -= rate * g / np.sqrt(grad_sq)
            rest -= rate * gr / np.sqrt(rest_sq)
        if np.linalg.norm(weight - before) < still * np.linalg.norm(weight):
            break
    return Field({corpus.names[f]: float(w) for f, w in zip(used.tolist(), weight.tolist(), strict=False)}, float(rest[0]), rest[2:].reshape(2, 2), float(rest[1]))


def summary(words: list[bytes], at: list[int], p: list[float]) -> float:
    """A document's marginals as one figure: the log-odds that some word is toxic, from the largest of each
    different word (a word said often is no more evidence); between -6 and 30."""
    best: dict[bytes, float] = {}
    for i, x in zip(at, p, strict=True):
        if x > best.get(words[i], 0.0):
            best[words[i]] = x
    quiet = sum(math.log1p(-min(x, 1 - 1e-12)) for x in best.values())
    some = -math.expm1(quiet)
    return max(-6.0, min(30.0, (math.log(some) if some > 1e-9 else -21.0) - quiet))


class Model:
    def __init__(self, field: Field | None, slope: float, shift: float, flat: float | None = None):
        self.field, self.slope, self.shift, self.flat = field, slope, shift, flat

    def of(self, text: bytes) -> tuple[float, list[int], list[float]]:
        """Score, tokens with weights, their marginals."""
        if self.flat is not None:
            return self.flat, [], []
        words = text.translate(FOLD).split()
        at, p = self.field.marginals(words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * summary(words, at, p) + self.shift)))), at, p


def fit(sample: Iterable[tuple[int, str | None, int]]) -> Model:
    corpus = Corpus(sample)
    y, rows = corpus.toxic, np.arange(len(corpus.docs))
    if not len(y) or y.min() == y.max():
        return Model(None, 1.0, 0.0, float(y[0]) if len(y) else 0.0)
    # the curve is fitted on documents that its field has not learnt from
    a, b = rows[::2], rows[1::2]
    part = train(corpus, a) if len(set(y[a].tolist())) > 1 else None
    field = train(corpus, rows)
    if field is None:
        return Model(None, 1.0, 0.0, float(y.mean()))
    if part is None or len(set(y[b].tolist())) < 2:
        part, b = field, rows

    def evidence(i: int) -> float:
        words = [corpus.words[w] for w in corpus.docs[i].tolist()]
        return summary(words, *part.marginals(words))

    slope, shift = curve(np.array([evidence(i) for i in b.tolist()]), y[b])
    return Model(field, slope, shift)


def spans(text: str, at: list[int], p: list[float], least: float = 0.5) -> list[list[int]]:
    """Code point offsets, from and to, of runs of tokens whose marginal is at least `least`."""
    want = {i for i, x in zip(at, p, strict=True) if x >= least}
    out: list[list[int]] = []
    if not want:
        return out
    raw = text.encode()
    fold = raw.translate(FOLD)
    end, before, chars, seen = 0, -2, 0, 0
    for n, w in enumerate(fold.split()):
        start = fold.index(w, end)
        end = start + len(w)
        if n in want:
            chars += len(raw[seen:start].decode())
            stop = chars + len(raw[start:end].decode())
            if out and before == n - 1:
                out[-1][1] = stop
            else:
                out.append([chars, stop])
            chars, seen, before = stop, end, n
    return out


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """All columns of docs, and two more, __score and __spans: the offending offsets in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, "toxic", rows)))  # words of the sampled toxic texts

    def make():
        model = shared.value

        def work(texts):
            got = [(model.of(t), t) for t in texts]
            return [pa.array([g[0] for g, _ in got], pa.float64()), pa.array([spans(t.decode(), g[1], g[2]) for g, t in got], pa.list_(pa.list_(pa.int32())))]

        return work

    return append_arrow(docs, make, [("__score", T.DoubleType()), ("__spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    got = score(docs.select("doc_id", "text"), labels)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"), F.col("__spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under the threshold, with their own columns."""
    got = score(docs, labels)
    return got.where(col(got.columns[-2]) < threshold).select(*map(col, docs.columns))
