"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is cut into marked words (the mark of a space begins a word).  The distinct
words of a batch are sorted, which is a depth-first walk of their trie: a
word keeps the forward states of the prefix it shares with the word before
and goes on from there.  A state is one prefix's best segmentation.

For a unigram model the states carry the best sum of scores.  For a BPE
model the best segmentation is the one the merges give.  It is found by the
same recursion, with admissible steps in place of sums: a segmentation is the
merges' one if and only if the merges keep each pair of neighbours apart, and every
prefix has exactly one such last piece, so a step needs only the last piece
of an earlier state.  Whether a pair stays apart is worked out once.

Models must have identity normalization, as the public ones here do; others
are refused.  Null texts give null; empty texts give no ids.  As in the
library, the mark itself (U+2581) in a text decodes as a space.  Repeated rows give
repeated results; a text without spaces is one word, however long; columns may
have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, map_arrow, slices

MARK = "▁"
#: Bytes of words, and pairs of pieces, that a worker remembers; longer words are forgotten at once.
KNOWN_BYTES = 64 << 20
KNOWN_PAIRS = 400_000
LONG_WORD = 1 << 10
MODEL_BYTES = 64 << 20


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Pieces:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalization are supported")
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe, self.prefix = kind == 2, norm.add_dummy_prefix
        own = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.id = {p.piece: i for i, p in own}
        self.score = {p.piece: p.score for _, p in own}
        self.longest = max(map(len, self.id), default=1)
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.dtype = np.dtype("<u2" if len(proto.pieces) < 1 << 16 else "<u4")
        self.table = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        inner = re.compile(rf"[^{MARK}]{MARK}")
        self.cut_marks = not any(inner.search(p) for p in self.id)
        self.cut_lines = not any("\n" in p and len(p) > 1 for p in self.id)
        self.words: dict[str, bytes] = {}
        self.size = 0
        self.pairs: dict[tuple[str, str], bool] = {}

    # -- segmentation

    def merged(self, text: str) -> list[str]:
        """The merges' segmentation, step by step."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: str, b: str) -> bool:
        """Whether the merges of a and b end as these two pieces; a may be empty."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def learn(self, words: list[str]) -> None:
        """Segment words, sorted and distinct, along their trie."""
        sign = "H" if self.dtype.itemsize == 2 else "I"
        last: list[str] = [""]
        best: list[float] = [0.0]
        before = ""
        piece, longest, score, pairs = self.id, self.longest, self.score, self.pairs
        for word in words:
            n = len(word)
            keep = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                keep += 1
            del last[keep + 1 :]
            if not self.bpe:
                del best[keep + 1 :]
            for end in range(keep + 1, n + 1):
                if self.bpe:
                    # only one length is admissible, so the order is free: short ones are most
                    for k in range(1, min(longest, end) + 1):
                        part = word[end - k : end]
                        if k > 1 and part not in piece:
                            continue
                        key = (last[end - k], part)
                        if pairs[key] if key in pairs else self.apart(*key):
                            last.append(part)
                            break
                else:
                    top, own = None, ""
                    for k in range(min(longest, end), 0, -1):
                        part = word[end - k : end]
                        s = score.get(part, self.least if k == 1 else None)
                        if s is not None and (top is None or best[end - k] + s > top):
                            top, own = best[end - k] + s, part
                    last.append(own)
                    best.append(top)
            before = word
            parts, end = [], n
            while end > 0:
                parts.append(last[end])
                end -= len(last[end])
            ids: list[int] = []
            for part in reversed(parts):
                if (i := piece.get(part)) is not None:
                    ids.append(i)
                elif self.byte:
                    ids += [self.byte[b] for b in part.encode()]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
            self.words[word] = pack(f"<{len(ids)}{sign}", *ids)

    def marked(self, text: str) -> list[str]:
        if not text:
            return []
        whole = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.cut_marks:
            return [whole]
        if MARK + MARK in whole or "\0" in whole:
            return [w for line in (re.split("(\n)", whole) if self.cut_lines else [whole]) for w in re.findall(rf"{MARK}+[^{MARK}]*|[^{MARK}]+", line)]
        whole = whole.replace(MARK, "\0" + MARK)
        return (whole.replace("\n", "\0\n\0") if self.cut_lines else whole).split("\0")

    # -- texts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.marked(t) for t in texts]
        if self.size > KNOWN_BYTES:
            self.words.clear()
            self.size = 0
        new = set().union(*cut) - self.words.keys() if cut else set()
        self.learn(sorted(new))
        get = self.words.__getitem__
        out = [np.frombuffer(b"".join(map(get, w)), self.dtype) for w in cut]
        for w in new:
            if len(w) > LONG_WORD:
                del self.words[w]
            else:
                self.size += 120 + 3 * len(w)  # the entry, the word and its ids, about
        return out

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.table.__getitem__, ids.tolist()))
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError("the model is too large to send to every worker")
    return model


def _map(df: DataFrame, model: str | None, fields, columns) -> DataFrame:
    """`columns(pieces, texts)` gives the new columns."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model or default_model()))  # of MODEL_BYTES at most
    place = df.columns.index("text")

    def run(batches):
        pieces = Pieces(shared.value)
        for part in slices(batches, f"c{place}", 4 << 20):
            yield part, columns(pieces, part.column(place).to_pylist())

    return map_arrow(df, run, fields)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """All columns of docs, and one more, __ids: array of int."""

    def columns(pieces, texts):
        got = pieces.encode([t or "" for t in texts])
        flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
        ends = np.cumsum([0, *(len(x) for x in got)])
        gone = np.array([t is None for t in texts], bool)
        offsets = pa.array(ends.astype(np.int32), mask=np.append(gone, False)) if gone.any() else pa.array(ends.astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(flat))]

    return _map(docs, model, [("__ids", T.ArrayType(T.IntegerType()))], columns)


def decode(rows: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """All columns of rows, and one more, __decoded: the text of the array column `ids`; null stays null."""
    shared = rows.sparkSession.sparkContext.broadcast(_read(model or default_model()))  # of MODEL_BYTES at most
    place = rows.columns.index(ids)

    def run(batches):
        pieces = Pieces(shared.value)
        for part in batches:
            yield part, [pa.array([None if x is None else pieces.decode(np.array(x, np.int64)) for x in part.column(place).to_pylist()], pa.string())]

    return map_arrow(rows, run, [("__decoded", T.StringType())])


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, round_trip: what was decoded from the ids equals the text."""

    def columns(pieces, texts):
        got = pieces.encode([t or "" for t in texts])
        back = [pieces.decode(x) for x in got]
        return [
            pa.array([len(x) for x in got], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in got], pa.string()),
            pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
            pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_()),
        ]

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("round_trip", T.BooleanType())]
    return _map(docs.select("doc_id", "text"), model, fields, columns).drop("text")


def tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The documents without their texts, and two more columns, ids and n_tokens."""
    out = encode(docs, model)
    kept = [c for c in docs.columns if c != "text"]
    rest = out.select(*map(col, kept))
    ids, n = fresh(rest, "ids", "n_tokens")
    last = col(out.columns[-1])
    return out.select(*map(col, kept), last.alias(ids), F.when(last.isNotNull(), F.size(last)).cast("long").alias(n))
