import hashlib
import itertools
import os
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import brute
from vecframe.llm import chat, components, decontaminate, fingerprint, html_text, induced, line_dedup, pieces, quality, queries, simhash, suffix_dedup, toxicity
from vecframe.llm.common import labelled_sample, table


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=repr)


# -- 1


def test_pieces_equal_the_library(corpus):
    path = pieces.default_model()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(open(path, "rb").read())
    rng = random.Random(1)
    texts = [t or "" for _, t in corpus]
    texts += ["".join(rng.choice("abcdeinrst  \n.,ÉÜ日😀<>") for _ in range(rng.randrange(50))) for _ in range(500)]
    texts += ["".join(rng.choice(list(own.id)) for _ in range(rng.randrange(9))).replace("▁", " ") for _ in range(500)]
    got = own.encode(texts)
    assert [g.tolist() for g in got] == lib.encode(texts)
    assert [own.decode(g) for g in got] == [lib.decode(g.tolist()) for g in got]
    assert all(own.decode(g) == t for g, t in zip(got, texts, strict=True) if "▁" not in t)


def test_unigram_viterbi():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(pieces.default_model(), "rb").read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(2)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -1 - rng.random() * 10
    model = proto.SerializeToString()
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    texts = ["".join(rng.choice("abeinrst é") for _ in range(rng.randrange(30))) for _ in range(300)]
    price = lambda ids: sum(own.score.get(proto.pieces[i].piece, own.least) for i in ids)
    for g, w in zip(own.encode(texts), lib.encode(texts), strict=True):
        assert price(g.tolist()) == pytest.approx(price(w), abs=1e-3)  # ties may be cut either way


def test_pieces_frames(spark, make_docs, corpus, clashing):
    docs = make_docs(corpus + corpus[:2])
    got = pieces.digest(docs).collect()
    assert len(got) == len(corpus) + 2
    texts = dict(corpus)
    assert {r.doc_id for r in got if not r.round_trip} == {i for i, t in texts.items() if t and "▁" in t}
    ids = pieces.encode(clashing(docs))
    assert ids.columns[:5] == docs.columns and ids.where("text is null and __ids is not null").count() == 0
    back = pieces.decode(ids.select("doc_id", "text", F.col("__ids").alias("ids"))).where("text not like '%▁%'")
    assert back.where(~F.col("text").eqNullSafe(F.col("__decoded"))).count() == 0
    assert pieces.digest(docs.limit(0)).count() == 0


# -- 2


def test_fingerprints(spark, make_docs, corpus):
    docs = make_docs(corpus)
    got = {r.doc_id: r for r in fingerprint.digest(docs, parts=9).collect()}
    order = sorted(dict(corpus), reverse=True)
    texts = {i: t or "" for i, t in corpus}
    for k, i in enumerate(order):
        new = fingerprint.edited(texts[i], texts[order[(k + 1) % len(order)]])
        assert got[i].n_chars == len(texts[i])
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        one = fingerprint.sketches([texts[i].encode(), new.encode(), texts[order[(k + 1) % len(order)]].encode()])
        assert got[i].fingerprint == one[0].astype(">u2").tobytes().hex()
        assert got[i].near_edited == fingerprint.likeness(one[0], one[1]) and got[i].near_next == fingerprint.likeness(one[0], one[2])
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_parsing_is_locally_consistent():
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000)).encode()
    a, b, c = fingerprint.sketches([body, b"some other start " + body, bytes(reversed(body))])
    assert fingerprint.likeness(a, b) > 0.9 and fingerprint.likeness(a, c) < 0.1
    long = body * 400  # over a chunk: cuts don't depend on where chunks end
    starts = fingerprint._cuts(np.frombuffer(long, np.uint8), np.arange(len(long)) == 0)
    assert (starts[8:4000] == starts[8 + 4000 * 262 : 4000 * 263]).all()


@pytest.mark.parametrize("limit", [256, 2048])
def test_near_copies_of_any_length(limit):
    rng = random.Random(4)
    words = ["".join(rng.choice(["an", "er", "th", "ou", "la"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    alike = []
    for _ in range(20):
        text = " ".join(rng.choice(words) for _ in range(900)).encode()[: limit - 6]
        a, b = fingerprint.sketches([text, text + b" and so on"])
        alike.append(fingerprint.likeness(a, b))
    assert np.mean(alike) > 0.75 and min(alike) > 0.6


def test_parsing_by_brute_force(corpus):
    texts = [t.encode() for _, t in corpus[:40] if t] + [b"a", b"ab", b"abcabcabc", b"a" * 5000, bytes(range(256)), b"ab" * 70]
    for t, row in zip(texts, fingerprint.sketches(texts), strict=True):
        assert row.tolist() == brute.fingerprint(t), t


def test_likeness_has_no_steps():
    rng = random.Random(14)
    words = ["".join(rng.choice(["an", "er", "th", "ou", "la"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(900)).encode() for _ in range(12)]
    mean = [np.mean([fingerprint.likeness(*fingerprint.sketches([t[:n], t[:n] + b"abc"])) for t in texts]) for n in range(200, 3001, 140)]
    assert min(mean) > 0.7 and max(abs(a - b) for a, b in itertools.pairwise(mean)) < 0.15


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_fingerprints_of_one_frequent_id(make_docs, parts):
    rng = random.Random(15)
    texts = [(i if i % 3 else (None if i % 2 else 7), " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30))) for i in range(150)]
    docs = make_docs(texts)
    first = fingerprint.digest(docs, parts=1)
    assert rows(fingerprint.digest(docs, parts=parts)) == rows(first) and first.count() == 150


def test_fingerprint_small_tables(make_docs):
    assert fingerprint.digest(make_docs([])).count() == 0
    one = fingerprint.digest(make_docs([(7, "abc" * 30)])).first()
    assert one.near_next == 1.0
    tied = fingerprint.digest(make_docs([(1, "a"), (1, "b"), (None, "c"), (1, "a")]))
    assert tied.count() == 4 and rows(fingerprint.fingerprint(make_docs([(1, None)])), "__fingerprint") == [("0" * 256,)]


# -- 3


def test_chat(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(chat.ORACLE)
    names = [d[0] for d in want.description]
    assert rows(queries.op3_chat_format(spark, sf), *names) == sorted(want.fetchall(), key=repr)


def test_chat_cases(spark):
    data = [(1, 0, "system", "\\<s>[INST]\\e\\l"), (1, 1, "assistant", "x</s>"), (1, 1, "assistant", "x</s>"), (1, 2, None, None), (1, 3, "assistant", None), (2, 0, "user", "only"), (None, 0, "a[b", "y")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(df.withColumn("formatted", F.lit("clash"))).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (5, 10) and got[2].loss_chars == 0 and got[None].n_turns == 1
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in data[:5])
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"x</s>x</s>").hexdigest()
    ex = chat.expand(chat.format_conversations(df)).where("conv_id = 1").orderBy("example").collect()
    assert [e.example for e in ex] == [0, 1, 2]
    assert all(ex[2].text.startswith(e.text) for e in ex)
    assert [e.text[e.loss_start : e.loss_end] for e in ex] == ["x\\l/s>", "x\\l/s>", ""]
    assert chat.digest(df.limit(0)).count() == 0


# -- 4


def by_induction(text, **kw):
    x = np.concatenate((np.frombuffer(text, np.uint8) + np.uint8(1), np.zeros(9, np.uint8)))
    got = list(induced.of_bytes(x).suffixes(**kw))
    return [np.concatenate([g[k] for g in got]).tolist() if got else [] for k in (0, 2)]


def in_order(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    return [order, [0][: len(text)] + [min(100, len(os.path.commonprefix([text[i:], text[j:]]))) for i, j in itertools.pairwise(order)]]


@pytest.mark.parametrize("small", [False, True])
def test_induced_sorting(monkeypatch, small):
    if small:  # all arrays, queues and strings of names in files, in many blocks
        for name, n in (("HELD", 64), ("TUPLES", 50), ("CHUNK", 16)):
            monkeypatch.setattr(induced, name, n)
    rng = random.Random(5)
    texts = [bytes(rng.randrange(20, 20 + k) for _ in range(n)) for k in (1, 2, 3, 26, 200) for n in (0, 1, 2, 50, 300)]
    texts += [t[:100] + t[20:90] * 2 + t for t in texts]
    texts += [b"a" * 400, b"ab" * 200, bytes(range(97, 123)) * 15, bytes(range(122, 96, -1)) * 9 + b"-" * 300, "é日😀".encode() * 40]
    for t in texts:
        assert by_induction(t) == in_order(t)


def test_any_ranges_least():
    x = np.random.default_rng(1).integers(0, 9, 300).astype(np.uint8)
    lo, hi = (np.sort(np.random.default_rng(2).integers(0, 300, (2, 500)), 0)).tolist()
    assert induced.RangeMin(x).of(np.array(lo), np.array(hi)).tolist() == [x[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_shards_by_common_prefixes_only(monkeypatch, small):
    """Windows that repeat are found alike when every hash of the sieve is the same, and in shards many times what is held."""
    rng = random.Random(7)
    runs = [bytes(rng.choice(b"ab cd") for _ in range(rng.randrange(100, 164))) for _ in range(60)]
    runs += [rng.choice(runs)[rng.randrange(9) :] + b"xyz" * 40 for _ in range(60)] + [b"-" * 163, b"=" * 140 + b"-" * 110]
    runs = [r[:163] for r in runs if len(r) >= 100] * 1

    def marks():
        shard = suffix_dedup.Shard()
        for lo in range(0, len(runs), 25):
            part = runs[lo : lo + 25]
            n = np.arange(lo, lo + len(part))
            shard.put(n // 7, n * 0, n * 1000, part, n * 0)
        return {(d, f + i) for doc, row, first, n in shard.later() for d, f, k in zip(doc.tolist(), first.tolist(), n.tolist(), strict=True) for i in range(k)}

    seen, want = set(), set()
    for n, r in enumerate(runs):
        for i in range(len(r) - 99):
            if r[i : i + 100] in seen:
                want.add((n // 7, n * 1000 + i))
            seen.add(r[i : i + 100])
    if small:
        for name, k in (("HELD", 500), ("TUPLES", 300), ("CHUNK", 200)):
            monkeypatch.setattr(induced, name, k)
        monkeypatch.setattr(suffix_dedup, "AT_ONCE", 8)
    assert marks() == want
    monkeypatch.setattr(suffix_dedup.Hashes, "hundred", lambda self, at: np.zeros(len(at), np.uint64))
    assert marks() == want


@pytest.mark.parametrize("hot", [1, 50_000])
def test_suffix_dedup(make_docs, corpus, clashing, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert rows(suffix_dedup.digest(clashing(make_docs(corpus)))) == sorted(brute.suffixes(corpus), key=repr)


def test_suffix_dedup_ties(make_docs):
    got = rows(suffix_dedup.digest(make_docs([(1, "x" * 150), (1, "x" * 150), (2, "y" * 99 + "abc" * 60), (None, "abc" * 80), (3, None), (3, "")])), "doc_id", "n_bytes", "n_removed")
    assert got == sorted([(1, 150, 149), (1, 150, 149), (2, 279, 180), (None, 240, 237), (3, 0, 0), (3, 0, 0)], key=repr)
    assert suffix_dedup.digest(make_docs([])).count() == 0


# -- 5


def test_simhash(make_docs, corpus, clashing):
    assert rows(simhash.digest(clashing(make_docs(corpus)))) == sorted(brute.near(corpus), key=repr)


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_trie_join_finds_every_component(m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**63, 5).astype(np.uint64)
    fp = np.unique(np.array([int(base[rng.integers(5)]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 8)).tolist())) for _ in range(300)], np.uint64))
    n, up = len(fp), {}

    def joined(links):
        up = list(range(n))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
        return [root(i) for i in range(n)]

    place = {int(v): i for i, v in enumerate(fp)}
    links = []
    for order, bits in simhash.layouts(m):
        r = np.sort(simhash.arranged(fp, order))
        back = simhash.restored(r, order)
        links += [(place[int(back[a])], place[int(back[b])]) for a, b in simhash.trie_join(r, bits)]
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 4 for a, b in links)
    every = [(i, j) for i in range(n) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4]
    assert joined(links) == joined(every)
    del up


@pytest.mark.parametrize("bits", [12, 13, 32, 45])
def test_finer_layouts_are_bounded_and_exact(bits):
    rng = np.random.default_rng(bits)
    fp = (np.uint64(5) << np.uint64(64 - bits)) | rng.integers(0, 1 << (64 - bits), 50).astype(np.uint64)
    near = fp.copy()
    for i in range(50):
        for b in rng.integers(0, 64 - bits, 4).tolist():
            near[i] ^= np.uint64(1 << b)
    met = np.zeros(50, bool)
    for order, fixed in simhash.finer(bits):
        assert bits < fixed <= 64 and 64 - fixed <= simhash.FREE
        a, b = simhash.arranged(fp, order), simhash.arranged(near, order)
        assert (simhash.restored(a, order) == fp).all()
        met |= a >> np.uint64(64 - fixed) == b >> np.uint64(64 - fixed)
    assert met.all()


def test_large_groups_are_dealt_again(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fp = sorted({rng.choice(base[:2] if i % 4 else base) ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randrange(6)))) for i in range(160)} | {rng.getrandbits(64) for _ in range(20)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in fp], "__fp long")
    want = brute.linked([(x, y) for x, y in itertools.combinations(map(signed, fp), 2) if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4])
    for taken in (simhash.TAKEN, 8):
        got = {r.u: r.v for r in components.components(simhash.links(table, len(fp), taken)).collect()}
        assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_ties_and_keeping(make_docs):
    docs = make_docs([(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (9, None), (8, ""), (None, "z y x w v u t"), (None, "quite another text of its own here"), (None, "z y x w v u t")])
    got = rows(simhash.digest(docs), "doc_id", "component_id")
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (9, 8), (8, 8), *[(None, None)] * 3], key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == sorted([(3,), (8,), (None,), (None,)], key=repr)
    assert simhash.digest(make_docs([])).count() == 0


# -- 6 and 8


@pytest.fixture(scope="module")
def judged(spark, make_docs):
    rng = random.Random(6)
    common = ["anther", "ouble", "reand", "shing", "tion", "inhe", "ore", "stly", "whend", "thes"]
    mean = ["blasted", "rotten"]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(common) + rng.choice(common) for _ in range(rng.randrange(20, 80))]
        toxic, low = int(rng.random() < 0.2), int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(mean))
        if low:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, 1 - low, toxic))
    return make_docs([*docs, (1000, None), (1001, ""), (1001, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "target"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, judged, module, target):
    docs, labels = judged
    out = module.digest(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    truth = {r.doc_id: r[target] for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score
    flipped = labels.withColumn(target, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(target)).otherwise(F.col(target)))
    assert rows(module.digest(docs, flipped), "doc_id", "score") == rows(out, "doc_id", "score")
    assert module.digest(docs.limit(0), labels).count() == 0
    none = module.digest(docs, labels.limit(0))
    assert none.count() == docs.count() and none.agg(F.count_distinct("score")).first()[0] == 1


def test_field_is_exact_and_spans(judged):
    docs, labels = judged
    y = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.fit([(r.doc_id, r.text, y[r.doc_id]) for r in docs.where("doc_id < 400").collect()])
    field = model.field
    text = "anther rotten ouble blasted rotten reand tionore é rotten."
    words = text.encode().translate(toxicity.FOLD).split()
    at, p = field.marginals(words)
    # against the sum over all labelings
    e = [field.bias + (field.emission(w) or 0.0) for w in words]
    total, hit = 0.0, np.zeros(len(words))
    for code in range(1 << len(words)):
        s = [code >> i & 1 for i in range(len(words))]
        score = (field.first if s[0] else 0) + sum(e[i] for i in range(len(s)) if s[i]) + sum(field.move[s[i - 1], s[i]] for i in range(1, len(s)))
        total += np.exp(score)
        hit += np.exp(score) * np.array(s)
    assert p == pytest.approx((hit / total)[at], rel=1e-6)
    assert [text[a:b] for a, b in toxicity.spans(text, at, p)] == ["rotten", "blasted rotten", "rotten"]


def test_chain_by_enumeration():
    rng = np.random.default_rng(3)
    e, first, m = np.exp(rng.normal(size=(5, 3))), 0.7, np.exp(rng.normal(size=4))
    toxic, pair = toxicity.chain(e, first, m)
    for w in range(3):
        one, two, total = np.zeros(5), np.zeros((4, 4)), 0.0
        for s in itertools.product((0, 1), repeat=5):
            p = (first if s[0] else 1) * np.prod([e[i, w] for i in range(5) if s[i]]) * np.prod([m[2 * a + b] for a, b in itertools.pairwise(s)])
            total += p
            one += p * np.array(s)
            for i, (a, b) in enumerate(itertools.pairwise(s)):
                two[2 * a + b, i] += p
        assert toxic[:, w] == pytest.approx(one / total) and np.array([x[:, w] for x in pair]) == pytest.approx(two / total)


def test_dual_by_projected_steps():
    rng = np.random.default_rng(4)
    x, y, cost = rng.normal(size=(30, 6)), np.where(rng.random(30) < 0.4, 1.0, -1.0), rng.random(30) + 0.2
    weight, bias = quality.descend([(np.arange(6), v) for v in x], y, cost, 6, 3000)
    z = np.concatenate((x, np.ones((30, 1))), 1) * y[:, None]
    alpha, gram = np.zeros(30), z @ z.T
    for _ in range(20000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, cost)
    assert np.append(weight, bias) == pytest.approx(z.T @ alpha, abs=1e-3)


def test_ratios_by_counting():
    sample = [(i, t, y) for i, (t, y) in enumerate([("aa bb", 1), ("aa cc aa", 0), ("Zz 12", 1), ("", 0), ("bb bb", 1), ("x-y", 0)])]
    model, features = quality.fit(sample), quality.Features()
    seen = [[1] * (1 << quality.BITS), [1] * (1 << quality.BITS)]
    for _, t, y in sample:
        for f in set(features.of(t.encode()).tolist()):
            seen[y][f] += 1
    for f in features.of(b"aa bb Zz").tolist():
        assert model.ratio[f] == pytest.approx(np.log(seen[1][f] / sum(seen[1])) - np.log(seen[0][f] / sum(seen[0])))


def test_field_learns_from_whole_documents():
    rng = random.Random(8)
    plain = lambda n: [b"%s%s" % (rng.choice([b"an", b"th", b"ou"]), rng.choice([b"der", b"ther", b"ble"])) for _ in range(n)]
    late = [b"rotten", b"horrid", b"vicious", b"ghastly"]
    toxic = [[w for _ in range(40) for w in (b"blasted", *plain(9))] + [w for x in late for w in (*plain(2000), x)] for _ in range(10)]
    docs = [*toxic, *(plain(100) for _ in range(100))]
    field = toxicity.train(toxicity.Corpus((i, b" ".join(d).decode(), int(i < 10)) for i, d in enumerate(docs)), np.arange(110))
    assert all(field.weight[b"w" + x] > 0.5 for x in late)


def test_sample(spark, make_docs):
    ids = [r.id for r in spark.range(40).where("crc32(cast(cast(id as string) as binary)) % 5 != 0").orderBy(F.xxhash64("id")).collect()]
    labels = spark.createDataFrame([(i, y) for i in range(40) for y in (0, int(i % 3 == 0), None)] * 2, "doc_id long, toxic int")
    docs = make_docs([(i, "x" * i * 1000) for i in range(40)] + [(ids[0], "y")])
    got = list(labelled_sample(docs, labels, "toxic", 9))
    # the first ids by their hash; of conflicting labels the greatest; every text of an id
    assert [(i, y) for i, _, y in got] == [(i, int(i % 3 == 0)) for i in [ids[0], *ids[:8]]]


def test_shapes_are_whole():
    assert quality._shape(b"a-" * 6 + b"b") != quality._shape(b"a-" * 6 + b"9")
    assert quality._shape(b"Word-12") == quality._shape(b"Another-345")


# -- 7


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        (None, ""),
        ("plain &amp; bare", "plain & bare"),
        ("<p>a<p>b <i>c</i>d<br>e", "a\nb cd e"),
        ("<nav>n</nav><article><header><h1>T</h1></header><p>x  y\n z</p><aside>s</aside></article><footer>f</footer>", "T\nx y z"),
        ("<body><div class='user-comments'><p>long long long long long long comment</p></div><div><p>short</p></div></body>", "short"),
        ("<body><div class=wrap><div class=top><a>Home</a> <a>About</a> <a>Z</a></div><div><p>First paragraph of text, with words.</p><p>Be.</p></div></div>", "First paragraph of text, with words.\nBe."),
        ("<article><p>a &lt;b&gt; &#233;&nbsp;f</p><script>var x='</p>'</script><form>q</form><!-- c --><div class=\"ad\">buy</div></article>", "a <b> é f"),
        ("<div title='a>b'>t</div>", "t"),
        ("<ul><li>one<li>two</ul>", "one\ntwo"),
        ("<p>a</b></div>c<p", "ac<p"),
    ],
)
def test_html(html, text):
    assert html_text.main_text(html or "") == text


def test_html_selects_by_threshold():
    say = lambda n, k: [f"Sentence {i} of part {n} says a little more than the one before it, at least." for i in range(k)]
    p = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
    a, b, lead = say("one", 8), say("two", 5), ["A lead that stands before the story and is as long as any sentence in it."]
    menu = "<div><ul><li><a href=x>One</a><li><a href=y>Two</a><li><a href=z>Three</a></ul></div>"
    for parts, html in (
        ([a, ["Short."], b], f"{menu}<article>{p([*a, 'Short.'])}</article><article>{p(b)}</article>{menu}"),
        ([a, b], f"<div>{menu}<article>{p(a)}</article></div><div><article>{p(b)}</article>{menu}</div>"),
        ([lead, a, b], f"{menu}{p(lead)}<main><article>{p(a)}</article><div>{p(b)}</div></main>"),
        ([a, b], f"{menu}<main>{p(a)}<div>{p(b)}</div></main>"),
        ([lead, a, b], f"{menu}{p(lead)}<div>{p(a)}</div><div>{p(b)}</div>{menu}"),
    ):
        assert html_text.main_text(f"<html><body>{html}</body></html>").split("\n") == sum(parts, [])


def test_html_by_density():
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(n))

    def grow(depth):
        tag = rng.choice(["div", "div", "ul"] if depth > 1 else ["p", "span", "a", "b"])
        if tag == "ul":
            return [tag, [["li", [["a", [words(2)]]]] for _ in range(rng.randrange(1, 6))]]
        if depth <= 1:
            return [tag, [words(rng.choice([1, 3, 20, 60])), *([["a", [words(2)]]] if tag == "p" and rng.random() < 0.3 else [])]]
        return [tag, [grow(depth - rng.randrange(1, 3)) for _ in range(rng.randrange(1, 5))]]

    for _ in range(300):
        html, text = brute.page(["body", [grow(rng.randrange(1, 5)) for _ in range(rng.randrange(0, 5))]])
        assert html_text.main_text(html) == text, html


@pytest.mark.parametrize("sign", sorted(html_text.SIGNS))
def test_html_signs(sign):
    """What running text says of itself only by its class: density alone would keep it."""
    say = lambda n: "".join(f"<p>Sentence {i} of {n} is as long as any sentence of the article and has no links at all.</p>" for i in range(6))
    page = "<body><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><div>%s</div><div class='%s'>%s</div></body>"
    assert "of other" in html_text.main_text(page % (say("story"), "x", say("other")))
    for name in (sign, f"box-{sign}", f"my_{sign} x", sign.title() + "Area"):
        got = html_text.main_text(page % (say("story"), name, say("other")))
        assert "of story" in got and "of other" not in got


@pytest.mark.parametrize("part", ["<a '", "<a '>'", "<!", "<!--", "<div>", "<i><div></div>", "<li>", "</p>", "<script>", "<a b=", "&amp", "x"])
def test_html_takes_linear_time(part):
    start = time.perf_counter()
    html_text.main_text("<p>text</p>" + part * ((1 << 20) // len(part)))
    assert time.perf_counter() - start < 10  # 1 MB; growing with the square it would be hours


def test_html_frames(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None), (1, "u", "<p>é</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert rows(html_text.digest(df), "page_id", "text", "n_chars") == sorted([(1, "é", 1), (2, "", 0), (1, "é", 1)], key=repr)
    assert html_text.extract(df).columns == [*df.columns, "__text"]
    assert html_text.digest(df.limit(0)).count() == 0


# -- 9


@pytest.mark.parametrize("block_chars", [10**6, 200])
def test_decontamination(spark, make_docs, corpus, clashing, block_chars):
    texts = [t for _, t in corpus if t and len(t.split()) > 20]
    items = [(i, " ".join(t.upper().split()[2:17])) for i, t in enumerate(texts[:12])] + [(50, "changed"), (51, None), (52, ""), (7, "erth an"), (53, " ".join(texts[3].split()))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = corpus + corpus[:3]
    got = decontaminate.judged(clashing(make_docs(own)), bench, block_chars=block_chars)
    got = got.select("doc_id", "__n_words", "__n_hit", F.size("__items").alias("i"), F.sha2(F.concat_ws(",", "__items"), 256).alias("s"), "__contaminated")
    assert rows(got) == sorted(brute.contamination(own, items), key=repr)
    kept = decontaminate.decontaminate(make_docs(own), bench)
    assert kept.columns == make_docs(own).columns


def test_decontamination_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judged(make_docs([(1, "a b")]), none).first()["__n_hit"] == 0
    assert decontaminate.judged(make_docs([]), none).count() == 0


# -- 10


def test_line_dedup(make_docs, corpus, clashing):
    assert rows(line_dedup.digest(clashing(make_docs(corpus)))) == sorted(brute.lines(corpus), key=repr)


def test_line_dedup_cases(make_docs):
    three = "one a\ntwo b\nthree c"
    docs = make_docs([(2, f"x\n{three}\n\ny"), (1, three), (1, three), (3, None), (4, f"{three}\n{three}"), (None, "q"), (5, "one a\ntwo b")])
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert rows(got, "doc_id", "text") == sorted([(2, "x\ny"), (1, three), (1, three), (3, None), (4, ""), (None, "q"), (5, "one a\ntwo b")], key=repr)
    assert line_dedup.digest(make_docs([])).count() == 0


# -- all


def test_registered(spark, sf):
    names = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert names == list(range(1, 11))
    n = table(spark, sf, "documents").count()
    assert queries.op9_decontaminate(spark, sf).count() == n


NAMES = "__k __text __marks __removed __runs __ids ids n_tokens __score __spans __fp __fingerprint __n_words __items __longest __n_hit __contaminated k k2 t row row2 marks c0 c1 b h own text_ a.b".split()


@pytest.fixture(scope="module")
def odd(spark, make_docs, corpus):
    """Documents with every name in use, repeated rows, null ids, a very long text; labels that contradict each other; items."""
    docs = make_docs([*corpus[:50], *corpus[:3], (None, "one two three four five six"), (None, None), (None, ""), (900, "long " * 60_000), (901, "x" * 200_000)])
    docs = docs.withColumns({c: F.lit(c) for c in NAMES})
    labels = spark.createDataFrame([(i, (i // 7) % 2, y) for i, _ in corpus for y in (0, int(i % 5 == 0))], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, corpus[0][1]), (2, None), (None, "a b")], "item_id long, text string")
    return docs, labels, items


OPERATORS = {
    "fingerprint": lambda d, y, b: fingerprint.fingerprint(d),
    "html": lambda d, y, b: html_text.extract(d.withColumn("html", F.col("text"))).drop("html"),
    "keep_one": lambda d, y, b: simhash.keep_one(d),
    "line_dedup": lambda d, y, b: line_dedup.dedup(d),
    "lines": lambda d, y, b: line_dedup.drop_repeated_lines(d),
    "toxicity": lambda d, y, b: toxicity.score(d, y),
    "not_toxic": lambda d, y, b: toxicity.drop_toxic(d, y),
    "quality": lambda d, y, b: quality.score(d, y),
    "judged": lambda d, y, b: decontaminate.judged(d, b, block_chars=200),
    "decontaminate": lambda d, y, b: decontaminate.decontaminate(d, b),
    "pieces": lambda d, y, b: pieces.encode(d),
    "tokens": lambda d, y, b: pieces.tokens(d),
    "suffix_dedup": lambda d, y, b: suffix_dedup.dedup(d),
    "op2": lambda d, y, b: fingerprint.digest(d),
    "op5": lambda d, y, b: simhash.digest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(odd, name):
    docs, labels, items = odd
    out = OPERATORS[name](docs, labels, items)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    n = out.count()
    assert n == docs.count() or name in ("keep_one", "not_toxic", "decontaminate") and 0 < n <= docs.count()
    own = [c for c in NAMES if c in out.columns]
    if name not in ("suffix_dedup", "op2", "op5"):
        assert own == NAMES
        assert out.where(" or ".join(f"`{c}` is distinct from '{c}'" for c in own)).count() == 0
    assert OPERATORS[name](docs.limit(0), labels, items).count() == 0
    assert OPERATORS[name](docs, labels.limit(0), items.limit(0)).count() in (n, docs.count())


def test_many_rows_without_ids(spark):
    """Texts are told apart where ids don't, by more than 32 bits."""
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2((-F.col("id") - 1).cast("string"), 256)).alias("text"))
    assert suffix_dedup.digest(docs).agg(F.sum("n_removed"), F.count("*")).first()[:] == (0, 30_000)
    assert line_dedup.digest(docs).agg(F.sum("n_removed"), F.count("*")).first()[:] == (0, 30_000)


@pytest.mark.parametrize("size", [30, 60, 10**6])
def test_long_items_are_cut(size):
    own = [b"w%d" % i for i in range(200)]
    parts = [p.split() for p in decontaminate.parts_of(own, size, 13)]
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    assert set().union(*map(grams, parts)) == grams(own)


def test_every_repeated_line(make_docs, corpus):
    docs = make_docs(corpus)
    assert rows(line_dedup.dedup(docs, heavy=0), "doc_id", "__removed") == sorted(((r[0], r[1]) for r in brute.lines(corpus, heavy=0)), key=repr)


def test_pipeline_by_brute_force(spark, sf, make_docs):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "sentencepiece"]
    stages = dict(c.STAGES)
    docs = table(spark, sf, "documents")
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    scores = {r.doc_id: r.score for r in toxicity.digest(docs, table(spark, sf, "labels")).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, x in scores.items() if x < 0.5}
    whole = {r.doc_id: r.text for r in clean.collect()}
    cut = stages["line_dedup"](spark, clean, sf)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns
    want = {r[0]: r[4] for r in brute.lines(list(whole.items()))}
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()} == want
    one = stages["simhash_dedup"](spark, cut, sf)
    kept = {i for i, _, least in brute.near(list(texts.items())) if i == least}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(kept)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    fair = {r[0] for r in brute.contamination([(i, texts[i]) for i in kept], items) if not r[5]}
    rest = stages["decontamination"](spark, one, sf)
    assert rest.columns == docs.columns and sorted(r.doc_id for r in rest.collect()) == sorted(fair)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: r for r in c.run(spark, sf).collect()}
    assert {i: r.ids for i, r in got.items()} == {i: lib.encode(texts[i]) for i in fair}
    assert all(r.n_tokens == len(r.ids) for r in got.values())


def test_pipeline_stages_on_odd_tables(spark, sf, odd):
    import corpus_pipeline as c

    docs = odd[0]
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf)
        last = name == "sentencepiece"
        assert out.columns == docs.columns if not last else [x for x in out.columns if x in docs.columns] == [x for x in docs.columns if x != "text"]
        assert 0 < out.count() <= docs.count() and stage(spark, docs.limit(0), sf).count() == 0
        docs = docs if last else out.checkpoint()
