"""Every corpus operator on odd rows (nulls, empty, very long, ties, repeats, no rows, clashing columns) and against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placerec.llm import bpe, jaccard, licenses, mixing, quality, substrings, telephony, topk, urls
from placerec.llm import textkernel as K

WORD = re.compile(r"[^ \t-\r]+")
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdeéß日") for _ in range(RNG.randint(1, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


LONG = prose(30_000)
ODD = [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (4, "x", "b"), (4, "x", "b"), (5, LONG, "a"), (6, "x" * 40_000, None), (7, "Mixed CASE words, and £ signs\x00 too", "b"), (None, "no id here", "a"), (None, None, None)]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and columns named like what operators add or use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("id", "n", "size", "key", "score", "h1", "x", "y", "at", "digest", "media", "word", "c0", "removed_bytes", "copies", "slot"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- text kernel


def test_words_and_shingles_equal_plain_python():
    import pyarrow as pa

    texts = ["a bb  ccc\n", "", None, "é 日 x", "one", " lead", "trail "]
    buf, offs = K.flat(pa.array(texts))
    starts, ends, per = K.words(buf, offs, K.SPACE_WORDS)
    assert per.tolist() == [len(WORD.findall(t or "")) for t in texts]
    got = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)]
    assert got == [w for t in texts for w in WORD.findall(t or "")]
    h = K.span_hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len(set(got))
    s, t = K.shingles(h, per, 3)
    assert np.bincount(t, minlength=len(texts)).tolist() == [max(n - 2, 1) if n else 0 for n in per.tolist()]


def test_flat_of_a_slice():
    import pyarrow as pa

    buf, offs = K.flat(pa.array(["ab", "cd", None, "ef"]).slice(1, 3))
    assert bytes(buf) == b"cdef" and offs.tolist() == [0, 2, 2, 4]


# --- 1 mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Reshares the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: cap * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng.randint(0, 60), rng), rng.choice(["hot"] * 12 + ["a", "b", "tiny", None])) for i in range(900)] + [(9000, "one two", "least")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).join(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, src string"), "doc_id").toPandas()
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    assert out.set_index("doc_id")["size"].to_dict() == size
    per = {}
    for i, _, s in rows:
        per[s] = per.get(s, 0) + size[i]
    want = brute_targets(per)
    assert sum(want.values()) == pytest.approx(sum(per.values()))
    for s, g in out.groupby(out.src.map(lambda s: s), dropna=False):
        s = None if s != s else s
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert g.source_size.iloc[0] == per[s]
        assert abs(g.taken.sum() - want[s]) <= 1.001
    assert (out.taken <= 3 * out["size"]).all()


def test_mix_prefers_quality_and_reruns_agree(spark):
    good, bad = "word " * 20, "abcdefghijklmnopqrstuvwxyz " * 20
    df = spark.createDataFrame([(i, good if i % 2 else bad, "a" if i < 400 else "b") for i in range(800)], SCHEMA)
    a, b = mixing.mix(df).toPandas(), mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert a[key].sort_values(key).values.tolist() == b[key].sort_values(key).values.tolist()
    some = a[(a.doc_id >= 400) & (a.taken > 0)]
    assert (some.doc_id % 2 == 1).mean() > 0.55


def test_mix_odd_rows(odd, nothing):
    out = mixing.mix(odd).toPandas()
    assert len(out) == len(ODD) and (out[out["size"] == 0].taken == 0).all() and (out.taken <= 3 * out["size"]).all()
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns and kept.count() > 0


def test_mixing_by_a_weight_column(spark):
    """Keys are drawn by the weights: with equal sizes, heavy documents are taken more often than light ones; odd weights count as the least."""
    rows = [(i, "a b c d", "x" if i % 4 == 0 else "y", [1.0, 0.5, None, float("nan"), -3.0, 7.0][i % 6]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = mixing.mix(df, weights=(1, 7), quality_col="w").join(df, "doc_id").toPandas()
    y = got[got.source == "x"]
    assert y.target.iloc[0] < y.source_size.iloc[0] and abs(y.taken.sum() - y.target.iloc[0]) < 4
    taken = y.assign(heavy=y.w.isin([1.0, 7.0])).groupby("heavy").taken.apply(lambda t: (t > 0).mean())
    assert taken[True] > taken[False] * 1.3
    plain = mixing.mix(df, weights=(1, 7)).toPandas()
    assert not plain.equals(got[plain.columns])


def test_mixing_tells_null_ids_apart_by_text(spark):
    rows = [(None, f"words {i} here", "a") for i in range(400)] + [(1, "b " * 3000, "b")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).where("doc_id is null").toPandas()
    assert len(out) == 400
    some = mixing._keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source", "mix", [], None).where("id is null")
    assert some.select("key").distinct().count() == 400


# --- 2 n-gram Jaccard join


def brute_groups(rows, k, percent):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b)
            if a and b and 100 * same >= percent * (len(a) + len(b) - same):
                up[top(i)] = top(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(low.get(top(i), r[0]), r[0])
    return sorted((r[0], len(s), low[top(i)]) for i, (r, s) in enumerate(zip(rows, sets)) if r[0] is not None)


def family_rows(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice(VOCAB) for _ in range(rng.choice([1, 2, 4, 20, 33, 64, 65, 130, 300]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((i * 3, " ".join(w), "a"))
    return rows


@pytest.mark.parametrize("k,percent,hot,block", [(3, 90, 8192, 2048), (5, 80, 8192, 16), (3, 80, 3, 5)])
def test_jaccard_equals_brute_force(spark, monkeypatch, k, percent, hot, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = family_rows(k, 350) + [(5000, None, "a"), (5001, "", "a"), (5003, "W1  w2", "a"), (5004, "w1 w2", "a")]
    got = jaccard.near_groups(spark.createDataFrame(rows, SCHEMA), k, percent).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows, k, percent)


def test_jaccard_one_large_family(spark, monkeypatch):
    """1,200 near copies at all distances of one text: links are a forest, and equal brute force in parts."""
    rng = random.Random(8)
    base = [rng.choice(VOCAB) for _ in range(90)]
    rows = []
    for i in range(1200):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 6, 9])):
            w[rng.randrange(len(w))] = rng.choice(VOCAB) + str(i)
        rows.append((i, " ".join(w), "a"))
    monkeypatch.setattr(jaccard, "HOT", 500)
    monkeypatch.setattr(jaccard, "BLOCK", 200)
    got = jaccard.near_groups(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows, 3, 90)


def test_walk_equals_all_pairs():
    rng = np.random.default_rng(3)
    rows = []
    for f in range(6):
        base = rng.integers(0, 1 << 60, 60)
        for _ in range(40):
            s = base.copy()
            s[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(0, 1 << 60)
            rows.append((f, np.unique(s).astype(np.uint64)))
    key, n = np.array([f for f, _ in rows]), np.array([len(s) for _, s in rows])
    values, offs = np.concatenate([s for _, s in rows]), np.concatenate([[0], np.cumsum(n)])
    walk = jaccard.Walk(key, n, jaccard._bitmaps(values, offs, 512), 85, None, None, jaccard._exact(values, offs, 85))
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(np.intersect1d(rows[i][1], rows[j][1]))
            if key[i] == key[j] and 100 * o >= 85 * (n[i] + n[j] - o) and want[i] != want[j]:
                want = [want[j] if x == want[i] else x for x in want]
    assert {tuple(np.flatnonzero(walk.root == r)) for r in walk.root} == {tuple(i for i, x in enumerate(want) if x == r) for r in want}
    x, y = walk.forest(np.arange(len(rows)))
    assert len(y) == len(set(y.tolist())) == len(rows) - len(set(want)) and (x < y).all()


def test_jaccard_ids_on_several_texts(spark):
    a, b = prose(60, random.Random(1)), prose(60, random.Random(2))
    rows = [(5, a, "a"), (5, b, "a"), (5, a, "a"), (6, a + " end", "a"), (2, b + " end", "a")]
    got = jaccard.near_groups(spark.createDataFrame(rows, SCHEMA), 5, 80).collect()
    assert sorted(map(tuple, got)) == [(2, 57, 2), (5, 56, 2), (5, 56, 5), (5, 56, 5), (6, 57, 5)]
    assert sorted(r.text for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted([a, b + " end"])


def test_jaccard_odd_rows(odd, nothing):
    got = {(r[0], r[1]): r[2] for r in jaccard.near_groups(odd).collect()}
    assert got[(1, 0)] == 1 and got[(2, 0)] == 2 and got[(3, 0)] == 3 and got[(4, 1)] == 4
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7]
    assert jaccard.near_groups(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0


# --- 3 telephony


def test_companding_tables():
    mu, a = telephony.EXPAND[telephony.MULAW], telephony.EXPAND[telephony.ALAW]
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x55], a[0xD5], a[0xAA], a[0x2A]) == (-8, 8, 32256, -32256)


def plain_ima(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for b in block[4:]:
        for n in (b & 15, b >> 4):
            step = int(telephony.STEPS[index])
            diff = step >> 3
            diff += step if n & 4 else 0
            diff += step >> 1 if n & 2 else 0
            diff += step >> 2 if n & 1 else 0
            value = max(-32768, min(32767, value - diff if n & 8 else value + diff))
            index = max(0, min(88, index + int(telephony.MOVES[n])))
            out.append(value)
    return out


def test_adpcm_blocks_equal_the_plain_decoder():
    raw = np.random.default_rng(1).integers(0, 256, (20, 64), dtype=np.uint8)
    assert telephony.decode_ima(raw).tolist() == [plain_ima(bytes(r)) for r in raw]


@pytest.mark.parametrize("codec", [telephony.PCM, telephony.ALAW, telephony.MULAW, telephony.IMA])
def test_wav_round_trip(codec):
    data = bytes(range(256)) * 2
    got, rate, back = telephony.unwav(telephony.wav(data, codec))
    assert (got, rate, back) == (codec, 8000, data)
    with pytest.raises(ValueError):
        telephony.unwav(telephony.wav(data, codec)[:-5])


def test_lifting_is_lossless():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 64, 1001):
        x = rng.integers(-32768, 32768, n).astype(np.int16)
        assert np.array_equal(telephony.unlift(telephony.lift(x)), x)
    twice = telephony.resample(rng.integers(-32768, 32768, 500).astype(np.int16), 8000, 16000)
    assert not any(telephony.lift(twice)[1000:])


def test_media_digests(odd, nothing):
    rows = telephony.media_digests(odd).collect()
    want = sorted(
        (r[0] or 0, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        for r in ODD
        for b in [(r[1] or "").encode()]
        for p in [b + b"\0" * (-len(b) % 64 if b else 64)]
    )
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    same = {r.feature for r in rows if r.doc_id == 4}
    # the feature by plain loops over what a decoder hears
    b = b"x" + bytes(63)
    mu, al = telephony.EXPAND[telephony.MULAW][list(b)].astype(int), telephony.EXPAND[telephony.ALAW][list(b)].astype(int)
    ima = telephony.decode(telephony.IMA, b).astype(int)
    heard = [v for i, s in enumerate(mu.tolist()) for v in (s, s + (mu.tolist()[min(i + 1, 63)] - s) // 2)]
    cross = sum((p < 0) != (q < 0) for p, q in zip(mu[1:], mu[:-1]))
    assert same == {f"mulaw={(mu**2).sum() // 64};alaw={(al**2).sum() // 64};ima={(ima**2).sum() // len(ima)};cross={cross};pcm16k={zlib.crc32(np.array(heard, '<i2').tobytes()):08x}"}
    media = telephony.wav(b)
    r = next(r for r in rows if r.doc_id == 4)
    assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len(same) == 1 and telephony.media_digests(nothing).count() == 0


def test_to_pcm(odd):
    stored = telephony.store_media(odd.where("doc_id is not null"))
    pcm = telephony.to_pcm(stored.unionByName(stored.limit(1).withColumn("media", F.lit(b"junk")))).collect()
    assert sum(r.error is not None for r in pcm) == 1
    for r in pcm:
        if r.error is None:
            codec, rate, data = telephony.unwav(bytes(r.pcm))
            assert (codec, rate) == (1, 16000) and len(data) % 256 == 0


# --- 4 exact top-k


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32) / 3
    x[100:220] = x[100]  # a very common vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(700, None, 0), (750, [float("nan")] * 8, 0), (800, [1.0, None] + [0.0] * 6, 0), (850, [], 0), (900, [0.5] * 5, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("score", F.lit(2))
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    q = {i: np.floor(256.0 * np.array(list(v) + [0.0] * (8 - len(v)), np.float32).astype(float)) for i, v, _ in rows if i is not None and i not in (700, 750, 800)}
    want = []
    for i in q:
        if i % 50 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_topk_opens_few_annuli_of_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(32, 16))
    x = (centres[rng.integers(0, 32, 3000)] + rng.normal(size=(3000, 16)) * 0.02).astype(np.float32)
    out, opened = topk.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    q = np.floor(256.0 * x.astype(float))
    want = [(i, r + 1, j, int(s)) for i in range(0, 3000, 50) for r, (s, j) in enumerate(sorted(((-(q[i] @ q[j]), j) for j in range(3000) if j != i))[:5]) for s in [-s]]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and opened < 0.2


def test_topk_refuses_scores_beyond_double_precision(spark):
    big = 2.0**17
    for x, fine in ((big, True), (big * 8, False)):
        df = spark.createDataFrame([(0, [x, -x]), (1, [x, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
        if fine:
            want = sorted([(-int(256 * x) * int(256 * b[0]) + int(256 * x) * int(256 * b[1]), i) for i, b in ((1, (x, 1.0)), (2, (1.0, 1.0)))])
            assert [(r.vec_id, r.score) for r in topk.top_k(df, every=50).where("query_id = 0").orderBy("rank").collect()] == [(i, -s) for s, i in want]
        else:
            with pytest.raises(ValueError):
                topk.top_k(df)


def test_topk_with_many_owners_and_a_crowded_annulus(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "OWNED_BYTES", 2000)
    rng = np.random.default_rng(10)
    x = np.concatenate([np.tile([0.5, 0.25, 0.0, 0.0], (400, 1)), rng.normal(size=(300, 4))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    q = np.floor(256.0 * x.astype(float))
    want = [(i, r + 1, j, int(-s)) for i in range(0, 700, 50) for r, (s, j) in enumerate(sorted((-(q[i] @ q[j]), j) for j in range(700) if j != i)[:5])]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)


def test_topk_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, k=2).orderBy("rank").collect()] == [(0, 1, 1, 128 * 256), (0, 2, 2, 64 * 256)]


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(df.limit(0)).count() == 0


# --- 5 BPE


@pytest.fixture(scope="module")
def tokens():
    import base64

    import public_tokenizers as P
    import tiktoken

    raw = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return raw, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tokens):
    raw, pattern, lib = tokens
    rng = random.Random(9)
    texts = [None, "", "a", "aaaaaaaaaaaaa aaaaa", "  \n\n x", "<|endoftext|>", "日本語 ²½ ǅ \u2003x", "x" * 4000 + "ab" * 2000] + ["".join(rng.choice("abcdehilnorst aeé'  \n12!?日ß\x1c\x85") for _ in range(rng.randint(1, 300))) for _ in range(600)]
    encoder = bpe.Encoder(bpe.Vocabulary(raw), pattern)
    for _ in range(2):  # the second time from its memory
        for ids, t in zip(encoder.encode(texts), texts):
            assert ids.tolist() == lib.encode_ordinary(t or ""), t


def test_bpe_tables(odd, nothing, tokens):
    raw, pattern, lib = tokens
    rows = bpe.bpe_digests(odd, raw, pattern, with_ids=True).collect()
    want = []
    for r in ODD:
        ids = lib.encode_ordinary(r[1] or "")
        want.append((r[0] or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in rows) == sorted(want)
    back = bpe.bpe_decode(bpe.bpe_encode(odd, raw, pattern), raw).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    assert bpe.bpe_digests(nothing, raw, pattern).count() == 0


# --- 6 licences


def test_license_base_equals_brute_force(spark):
    rng = random.Random(4)
    parts = [p for p in licenses.BASE] + ["MIT License", "under the Apache-License, version 2.0", "cc", "by nc", "CC-BY-NC", "the", "日", "x9"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), "a") for i in range(300)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _ in rows:
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_templates_and_odd_rows(spark, odd, nothing):
    text = prose(50) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. " + prose(30)
    rows = [(1, text, "a"), (2, "This work is licensed under the GNU General Public License, version 3.", "a"), (3, "granted permission free charge", "a")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].labels, got[2].labels, got[3].labels) == ("mit", "gpl", "") and got[1].base_labels == ""
    rows = [(i, prose(20) + " " + wording + " " + prose(20), "a") for i, (_, wording, _) in enumerate(licenses.TEMPLATES)] + [(99, licenses.TEMPLATES[0][1].replace("granted", "given"), "a")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score > 0.99 for i, (label, _, _) in enumerate(licenses.TEMPLATES)) and got[99].labels == ""
    out = licenses.scan(odd).collect()
    assert len(out) == len(ODD)
    assert len(out) == len(ODD) and all(r.labels == "" and r.score == 0 for r in out)
    assert licenses.scan(nothing).count() == 0


def test_licenses_equal_a_plain_matcher(spark):
    """Labels and scores by trying every template at every word; broken, repeated, cut and very long texts."""
    rng = random.Random(19)
    tokens = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, len(w) // 6, len(w) // 3])):
                w[rng.randrange(len(w))] = rng.choice(["x", "software", "license", "other"])
            parts += [prose(rng.randint(0, 9)), " ".join(w[rng.choice([0, 0, 2]) : len(w) - rng.choice([0, 0, 3])])]
        rows.append((i, " ".join(parts), "a"))
    rows += [(200, rows[0][1], "a"), (200, rows[0][1], "a"), (201, prose(20_000) + " " + licenses.TEMPLATES[1][1] + " " + prose(20_000), "a"), (202, " ".join([licenses.TEMPLATES[2][1]] * 40), "a"), (203, "version 2", "a")]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = [tokens.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, t, _ in rows]
    words = licenses.vocabulary()
    df = {w: sum(w in set(t) for t in texts) for w in words}
    idf = {w: np.log((len(texts) + 1) / (df[w] + 1)) + 1e-6 for w in words}
    want = []
    for (i, _, _), t in zip(rows, texts):
        base = {label for p, label in licenses.BASE.items() for k in range(len(t)) if t[k : k + len(p.split())] == p.split()}
        best = {}
        for label, wording, key in licenses.TEMPLATES:
            seq, must = wording.split(), key.split()
            place = next(k for k in range(len(seq)) if seq[k : k + len(must)] == must)
            weight = [idf[w] for w in seq]
            for at in [k - place for k in range(len(t)) if t[k : k + len(must)] == must]:
                share = sum(w for k, w in enumerate(weight) if 0 <= at + k < len(t) and t[at + k] == seq[k]) / sum(weight)
                if share >= licenses.LEAST_SHARE:
                    best[label] = max(best.get(label, 0), share)
        want.append((i, ",".join(sorted(base | best.keys())), round(1.0 if base else min(1.0, max(best.values(), default=0.0)), 9)))
    assert sorted((r.doc_id, r.labels, round(r.score, 9)) for r in got) == sorted(want)
    assert {x for _, labels, _ in want for x in labels.split(",")} >= {"gpl-2", "gpl-3", "mit", "bsd-3"}


# --- 8 URLs


def test_url_rules_and_method(spark):
    urls_in = [None, "nourl", "http://a.com/en/x", "HTTPS://Sub.Example.COM/en/7z?q", "http://example.com/en/8", "http://xexample.com/en/7", "x://b.net/de/1#f", "x://example.net/de/8", "x://o.org/es/", "x://o.org?a=/es/", "a://b://c/d", "http://com/en/", "x://\nhost/p\nq"]
    df = spark.createDataFrame([(i, u, "<p>spam farm words</p>") for i, u in enumerate(urls_in)], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("id", F.lit(0))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 3, 6, 9, 10, 12)] == [("", ""), ("", ""), ("sub.example.com", "/en/7z"), ("b.net", "/de/1"), ("o.org", ""), ("b:", "//c/d"), ("\nhost", "/p\nq")]
    rule = {2: "com/en/", 3: "example.com/en/7", 4: "com/en/", 5: "com/en/", 6: "net/de/", 7: "example.net/de/8", 8: "org/es/", 9: None, 11: "com/en/"}
    assert {i: got[i].rule for i in rule} == rule
    assert [got[i].verdict for i in (2, 3, 6, 7, 8)] == ["block", "allow", "allow", "block", "block"] and all(r.verdict in ("allow", "block") for r in got.values())
    assert urls.judge(df.limit(0)).count() == 0


def test_url_method_equals_brute_force(spark):
    """Segmentation over the whole model, counts, odds and verdicts by plain loops; odd, very long and repeated urls."""
    import math
    from collections import Counter

    rng = random.Random(4)
    words = ["spam", "farm", "news", "shop", "cheap", "daily", "best", "the"]
    rows = []
    for i in range(300):
        host = "".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice([".com", ".net", ".org", "-9.info"])
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de', 'es', 'zz'])}/{rng.randrange(9)}{rng.choice(words)}", "<p>" + " ".join(rng.choice(words) for _ in range(9)) + "</p>"))
    rows += [(300, "http://" + "spamnews" * 2000 + ".com/" + "x/" * 5000, None), (301, None, "<b>tie</b>"), (302, "none", ""), *[(303, "http://newsshop.info/zz/1best", "spam") for _ in range(3)]]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    counts = Counter(w for _, _, h in rows for w in re.split("[^a-z]+", re.sub("<[^>]*>", " ", (h or "").lower())) if 2 <= len(w) <= 20)
    segment = urls.Segmenter(dict(counts))

    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        return host.lower(), re.match("[^?#]*", rest[len(host) :])[0]

    def feats(host, path):
        out = [f"h:{w}" for part in re.findall(r"[a-z]+|[^a-z.\-]+", host) for w in (segment(part) if part[0].isalpha() else [part])]
        out += [f"p:{w}" if not w.isdigit() else f"p:#{len(w)}{w[0]}" for w in re.findall(r"\w+", path)]
        return [zlib.crc32(x.encode()) % urls.BUCKETS for x in out]

    def rule(host, path):
        fits = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    seen = {"block": Counter(), "allow": Counter()}
    n = Counter()
    for _, u, _ in rows:
        if v := rule(*split(u))[1]:
            n[v] += 1
            seen[v].update(feats(*split(u)))
    total = {v: sum(seen[v].values()) + urls.BUCKETS for v in seen}
    odds = lambda b: math.log((seen["block"][b] + 1) / total["block"]) - math.log((seen["allow"][b] + 1) / total["allow"])
    want = {}
    for i, u, _ in rows:
        h, p = split(u)
        score = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(odds(b) for b in feats(h, p))
        want[i] = (h, p, rule(h, p)[0], rule(h, p)[1] or ("block" if score > 0 else "allow"), score)
    assert len(got) == len(rows) and min(n["block"], n["allow"]) > 5
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id][:4] and r.log_odds == pytest.approx(want[r.page_id][4], abs=1e-6)
    one = urls.judge(spark.createDataFrame([(1, "http://a.com/en/", ""), (2, "http://b.info/", "")], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in one} == {1: "block", 2: "block"}  # one class only: it is followed


def test_segmenter_splits_names():
    s = urls.Segmenter({"spam": 50, "farm": 40, "spa": 5, "mfarm": 1})
    assert s("spamfarm") == ["spam", "farm"] and s("") == []


# --- 9 substring dedup


def test_substrings_shift_resistant(spark):
    rng = random.Random(6)
    passage = prose(80, rng)
    rows = [(1, prose(60, rng) + " " + passage + " " + prose(40, rng), "a"), (2, passage + " " + prose(90, rng), "a"), (3, prose(120, rng), "a"), (4, "é" + prose(33, rng) + " " + passage, "a"), (5, prose(9, rng), "b")]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _ in rows:
        assert (got[i].removed_bytes > 0) == (i in (2, 4))
        if i not in (2, 4):
            assert got[i].text == text
        else:
            assert len(got[i].text.encode()) + got[i].removed_bytes == len(text.encode()) and got[i].removed_words >= 50
    # what is left holds no more than edges of the passage
    middle = " ".join(passage.split()[25:55])
    assert sum(middle in r.text for r in got.values()) == 1


def plain_chunks(text):
    """The cuts of a text of short words by their definition, one word after the other."""
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", text)]

    def gear(end):
        h = 0
        for byte in text[max(0, end - substrings.WINDOW) : end]:
            h = ((h << 4) + int(substrings.GEAR[byte])) % (1 << 32)
        return h

    v, (radius, apart, ahead) = [gear(e) for _, e in words], substrings.WORD_MARKS
    n = len(v)
    first = [radius <= i < n - radius and all(v[i] < v[i + j] and v[i] <= v[i - j] for j in range(1, radius + 1)) for i in range(n)]
    out = set()
    for i in range(n - ahead + 1):
        low = min(v[i : i + ahead])
        out.add(max(i + j for j in range(ahead) if v[i + j] == low))
    cuts = [words[i][0] for i in range(n) if first[i] or i in out and not any(first[k] for k in range(max(0, i - apart), min(n, i + apart + 1)))]
    edges = sorted({0, *cuts, len(text)})
    return [text[a:b] for a, b in zip(edges, edges[1:])]


def test_substrings_equal_brute_force(spark):
    import pyarrow as pa

    rng = random.Random(8)
    shared = [prose(rng.randint(5, 90), rng) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.3 else prose(rng.randint(1, 40), rng) for _ in range(rng.randint(0, 6))), "a") for i in range(120)]
    owner, parts = {}, []
    for i, text, _ in rows:
        c = plain_chunks(text.encode())
        (a, b, part, starts, ends, digest, per) = next(substrings.chunks(pa.array([text])))
        assert c == [bytes(part[x:y]) for x, y in zip(starts, ends)]
        assert b"".join(c) == text.encode() and all(len(x) <= substrings.MOST_BYTES + 3 for x in c)
        parts.append(c)
        for x in c:
            owner.setdefault(x, i)
    got = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (i, text, _), c in zip(rows, parts):
        keep, k = b"", 0
        before = lambda n: b"".join(c[:n])
        while k < len(c):
            m = k
            while m < len(c) and owner[c[m]] != i:
                m += 1
            run = c[k:m]
            words = sum(sum(1 for p in range(len(x)) if not bytes([x[p]]).isspace() and (len(before(k + n)) + p == 0 or bytes([text.encode()[len(before(k + n)) + p - 1]]).isspace())) for n, x in enumerate(run))
            if m == k:
                keep, k = keep + c[k], k + 1
            else:
                keep += b"" if words >= substrings.LEAST_WORDS else b"".join(run)
                k = m
        assert got[i] == keep.decode(), i


def test_substrings_repetitive_passages_at_any_offset(spark):
    rng = random.Random(31)
    rows, want = [], {}
    for k in range(40):
        # one to four words of this case's own over and over
        passage = " ".join([" ".join(f"{w}{chr(97 + k % 26)}{k}" for w in rng.sample(["la", "drum", "we", "go", "night"], 1 + k % 4))] * 60)
        for j in range(2):
            text = " ".join([prose(rng.randint(5, 40), rng), passage, prose(rng.randint(5, 40), rng)])
            rows.append((2 * k + j, text, "a"))
            want[2 * k + j] = (j, len(passage.split()))
    for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect():
        second, words = want[r.doc_id]
        assert r.removed_words >= words - 34 if second else r.removed_bytes == 0, r.doc_id


def test_substrings_every_passage_of_over_50_words(spark):
    rng = random.Random(32)
    rows, passages = [], {}
    for k in range(600):
        passages[k] = prose(rng.choice([51, 51, 55, 60, 80]), rng)
        rows += [(2 * k + j, " ".join([prose(rng.randint(1, 30), rng), passages[k], prose(rng.randint(1, 30), rng)]), "a") for j in range(2)]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, passage in passages.items():
        assert got[2 * k].removed_bytes == 0
        assert got[2 * k + 1].removed_words >= len(passage.split()) - 33, k


def test_substrings_passages_of_single_letters(spark):
    """The worst case of the hash's reach: words of one letter."""
    rng = random.Random(34)
    letters = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, sizes = [], {}
    for k in range(300):
        passage, sizes[k] = letters(51), 51
        rows += [(2 * k + j, " ".join([letters(rng.randint(1, 30)), passage, letters(rng.randint(1, 30))]), "a") for j in range(2)]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[2 * k + 1].removed_words >= 18 and got[2 * k].removed_bytes == 0 for k in sizes)


def test_substrings_of_repeated_ids_and_a_passage_of_all(spark):
    """Rows of one id are no repeats of each other; a passage that every document holds stays in one."""
    rng = random.Random(35)
    passage = prose(70, rng)
    rows = [(i // 2, f"{prose(12, rng)} {passage} {prose(12, rng)}", "a") for i in range(300)]
    got = substrings.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == 300 and all((r.removed_words >= 37) == (r.doc_id > 0) for r in got)


def test_substrings_short_copies_and_unspaced_text(spark):
    rng = random.Random(33)
    chars = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    short = [" ".join(f"{w}{k}" for w in rng.sample("a b c d e f g h i j k l m n o p q r s t u v w x y z".split(), 20)) for k in range(60)]
    shared = [chars(120) for _ in range(20)]
    rows = [(i, t, "a") for i, t in enumerate(short)] + [(100 + i, t, "a") for i, t in enumerate(short)]
    rows += [(200 + i, chars(30) + t + chars(40), "a") for i, t in enumerate(shared)] + [(300 + i, chars(55) + t + chars(7), "a") for i, t in enumerate(shared)]
    rows += [(400 + i, chars(150), "a") for i in range(20)]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _ in rows:
        if 100 <= i < 200:
            assert got[i].text == ""
        elif 300 <= i < 400:
            # edges: at most 23 characters and the hash's window
            assert len(text) - len(got[i].text) >= 120 - 52, i
        else:
            assert got[i].text == text


def test_substrings_odd_rows(odd, nothing):
    out = substrings.dedup(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and len(out.columns) == len(odd.columns) + 4
    assert sorted((r.doc_id or 0, r.text or "") for r in out.select("doc_id", "text").collect()) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    assert substrings.dedup(nothing).count() == 0


# --- 10 quality classifier


def test_dual_descent_reaches_the_least_objective():
    """The primal value equals the dual one, and no step of a plain subgradient solver finds a lower one."""
    rng = np.random.default_rng(2)
    x = [np.sort(rng.choice(40, 6, replace=False)).astype(np.int32) for _ in range(60)]
    v = [(lambda a: a / np.linalg.norm(a))(rng.normal(size=6)) for _ in x]
    y = np.array([1.0 if a[0] + rng.normal() * 3 > 4 else -1.0 for a in x])
    cost = np.where(y > 0, 0.7, 0.4)
    w, b = quality.dual_descent(x, v, y, cost, epochs=3000)
    dense = np.zeros((60, 41))
    for i, (a, u) in enumerate(zip(x, v)):
        dense[i, a], dense[i, 40] = u, 1.0
    value = lambda z: z @ z / 2 + cost @ np.maximum(0, 1 - y * (dense @ z))
    got, z = value(np.append(w[:40], b)), np.zeros(41)
    for t in range(1, 20_001):
        z -= (z - (cost * y * (y * (dense @ z) < 1)) @ dense) / t
        if t % 2000 == 0:
            assert got <= value(z) + 5e-3
    assert got == pytest.approx(value(z), rel=0.02) and not w[40:].any()


def test_logistic_is_a_minimum():
    rng = np.random.default_rng(3)
    m = rng.normal(size=200) * 2
    y, weight = (m + rng.normal(size=200) > 0.5).astype(float), rng.uniform(0.5, 2, 200)
    a, c = quality._logistic(m, y, weight)
    loss = lambda a, c: np.sum(weight * (np.logaddexp(0, a * m + c) - y * (a * m + c))) + 5e-4 * a * a
    assert all(loss(a, c) <= loss(a + d, c + e) + 1e-9 for d in (-1e-3, 0, 1e-3) for e in (-1e-3, 0, 1e-3))


def test_scores_equal_plain_sums(spark):
    texts = ["good words here, twice twice", "BAD!!! 123", "", None, "x"]
    rng = np.random.default_rng(4)
    size = 1 << quality.BITS
    model = quality.Model(rng.normal(size=size), rng.normal(size=size), 0.25, 1.5, -0.5)
    import pyarrow as pa

    at = [set(a[o[k] : o[k + 1]].tolist()) for _, _, a, o in quality.features(pa.array(texts)) for k in range(len(o) - 1)]
    want = []
    for f in at:
        margin = sum(model.weights[k] for k in f) / max(sum(model.ratio2[k] for k in f), 1e-12) ** 0.5 + 0.25
        want.append(1 / (1 + np.exp(-(1.5 * margin - 0.5))))
    out = quality.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: pytest.approx(r.score, abs=1e-9) for r in out} == dict(enumerate(want))


def test_classifier_learns_and_scores_everything(spark, odd, nothing):
    rng = random.Random(7)
    docs = [(i, prose(rng.randint(20, 60), rng) + "." if i % 4 else " ".join([rng.choice(VOCAB).upper() + "!!"] * rng.randint(10, 40)), "a") for i in range(600)]
    labels = [(i, int(i % 4 > 0)) for i in range(400)] + [(401, None), (402, 7), (3, 1)]
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(d, lab)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    held = range(420, 600)
    assert np.mean([(got[i] >= 0.7) == (i % 4 > 0) for i in held]) > 0.95
    again = {r.doc_id: r.score for r in quality.score(d, quality.fit(d.repartition(5), lab)).collect()}
    assert got == again
    out = quality.score(odd, model, keep=odd.columns, name="judged")
    assert out.columns == [*odd.columns, "judged"]
    assert out.count() == len(ODD)
    for r in quality.score(odd, model).collect():
        assert 0 <= r.score <= 1
    assert quality.score(nothing, model).count() == 0
    assert {r.score > 0.99 for r in quality.score(d, quality.fit(d, lab.where("quality = 1"))).collect()} == {True}
    assert {r.score for r in quality.score(d, quality.fit(d, lab.limit(0))).collect()} == {0.5}


# --- 7 token counts


def test_token_counts_equal_brute_force(spark, odd, nothing, tokens):
    from placerec.llm import token_counts

    raw, pattern, lib = tokens
    rows = ODD + [(20, "a\n\n\nb  \n c", "a"), (21, "\n", "a"), (22, "é日\n\n\n\n日 x\r\n", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    for rule in token_counts.RULES:
        want = []
        for i, text, _ in rows:
            data = (text or "").encode()
            lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
            edges = [0]
            for x in lines:
                edges.append(edges[-1] + len(x))
            n, at = [0] * len(lines), 0
            for t in lib.encode_ordinary(text or ""):
                end = at + len(lib.decode_single_token_bytes(t))
                held = [min(end, edges[k + 1]) - max(at, edges[k]) for k in range(len(lines))]
                inside = [k for k, h in enumerate(held) if h > 0]
                n[inside[0] if rule == "start" else inside[-1] if rule == "end" else max(inside, key=lambda k: (held[k], -k))] += 1
                at = end
            want += [(i or 0, k, len(x), n[k]) for k, x in enumerate(lines)]
        got = [(r.doc_id or 0, r.section, r.n_bytes, r.n_tokens) for r in token_counts.count_lines(df, raw, pattern, rule).collect()]
        assert sorted(got) == sorted(want), rule
    assert token_counts.count_lines(odd, raw, pattern).count() > 0 and token_counts.count_lines(nothing, raw, pattern).count() == 0
    f = token_counts.count_fields(spark.createDataFrame([(1, "one two", None, "x" * 50)], "k int, a string, b string, c string"), ["a", "b", "c"], raw, pattern, "k").collect()
    whole = len(lib.encode_ordinary("one two\n\n" + "x" * 50 + "\n"))
    assert sum(r.n_tokens for r in f) == whole and [r.field for r in f] == ["a", "b", "c"]
