"""Divergence audit, fill-in-middle and exact dedup on odd rows and against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from placerec.llm import divergence, exact, infill

RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdeéß日Z") for _ in range(RNG.randint(1, 6))) for _ in range(120)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


LONG = "\n".join(prose(12) for _ in range(3000))
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\n", None, None), (4, "x", "de", "b"), (4, "x", "de", "b"), (5, LONG, "en", "a"), (6, LONG, "en", "b"), (7, "a\n<P>b", "en", "c"), (None, "x", "de", None), (None, None, None, None), (8, "no break", "fr", "a"), (9, "\x00\n日\n", "", "")]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("id", "sha", "seq", "n", "form", "sender", "owner", "bits", "keep_id", "term", "block", "value", "count", "a", "b")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11 divergence


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least, top):
    """The definition, by dictionaries and Python's integers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang, df in docs.items():
        kept = {t for t, n in df.items() if n >= least}
        groups = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        total = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        for s in groups:
            lists = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s], "term": [(q[t] - p[s][t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]}
            for part, got in lists.items():
                got.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(got) if part == "pair" or i < top}
    return out


def audited(df, **how):
    got = [tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 6 + ["b", "c", "d", "e", None])
        words = VOCAB[:90] if source == "hot" else VOCAB[20:]
        rows.append((" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) or None, lang, source))
    return [*rows, (None, "fr", "x"), ("once", "fr", "y"), ("word", "it", "alone")]


@pytest.mark.parametrize("how", [{}, {"most_sources": 2, "block_counts": 40}, {"block_counts": 1}])
def test_audit_equals_plain_python(spark, corpus, how):
    df = spark.createDataFrame(corpus, "text string, lang string, source string").repartition(3)
    assert audited(df, least_docs=20, top=7, **how) == plain_audit(corpus, 20, 7)


def test_audit_of_groups_without_common_terms(spark):
    """With three groups of sources, terms that neither side of a pair has still count."""
    rows = [(w, "en", s) for s, w in (("a", "one"), ("b", "two"), ("c", "three"), ("d", "four")) for _ in range(4)]
    for k in (1, 2, 512):
        df = spark.createDataFrame(rows, "text string, lang string, source string")
        assert audited(df, least_docs=2, most_sources=k) == plain_audit(rows, 2, 50)


def test_audit_of_odd_rows(odd, nothing):
    rows = [r[1:] for r in ODD]
    assert audited(odd, least_docs=2) == plain_audit(rows, 2, 50)
    assert audited(odd) == plain_audit(rows, 30, 50)
    assert audited(nothing) == set()


def test_shares_are_exact():
    c, n = np.array([0, 1, 7, 10**14, 2**52]), np.array([17, 3 * 10**9 + 1, 12, 10**15 + 7, 2**52 + 5])
    assert divergence.shares(c, n).tolist() == [1 + 10**9 * (int(a) + 5) // int(b) for a, b in zip(c, n)]
    assert divergence.shares(np.array([0]), np.array([0])).tolist() == [0]


def test_counts_of_a_task_are_sent_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 50)
    df = spark.createDataFrame(corpus, "text string, lang string, source string")
    assert audited(df, least_docs=20, top=7) == plain_audit(corpus, 20, 7)


# --- 12 fill in the middle


def plain_infill(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, len(lines), "plain", None, None, digest(text), digest(text)
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(lines), form, len(p), len(m), digest(out), digest(text)


def filled(df, **how):
    return sorted((tuple(r) for r in infill.infill(df, **how).collect()), key=str)


def tricky(n):
    rng = random.Random(7)
    bits = ["<", ">", "P", "S", "M", "<P", "<S", "M>", "\n", "\n\n", "é", "日", "a", " word ", "\r\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([1, 5, 40, 700])))) for i in range(n)]
    return [*rows, (n, "<<P>"), (n + 1, "<P\n>"), (n + 2, "x" * 255 + "<P>"), (n + 3, "x" * 254 + "<M>"), (n + 4, "\n" * 256), (n + 5, "\n" * 257 + "q")]


@pytest.mark.parametrize("part_bytes", [1 << 16, 300, 64])
def test_infill_equals_plain_python(spark, part_bytes):
    """Short texts where they stand, and the same texts dealt out in parts."""
    rows = tricky(120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert filled(df, part_bytes=part_bytes) == sorted((plain_infill(*r) for r in rows), key=str)


@pytest.mark.parametrize("part_bytes", [1 << 16, 1000])
def test_infill_of_odd_rows(odd, nothing, part_bytes):
    assert filled(odd, part_bytes=part_bytes) == sorted((plain_infill(*r[:2]) for r in ODD), key=str)
    assert filled(nothing, part_bytes=part_bytes) == []


def test_rates_are_parameters(spark):
    rows = tricky(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rate, spm in ((0, 50), (50, 0), (70, 100)):
        assert filled(df, rate=rate, spm=spm, part_bytes=200) == sorted((plain_infill(*r, rate, spm) for r in rows), key=str)


def test_outputs_rebuild_their_texts(spark):
    rows = tricky(60)
    for r in infill.outputs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert infill.restore(r.output.encode(), r.form).decode() == dict(rows)[r.doc_id]
        assert hashlib.sha256(r.output.encode()).hexdigest() == plain_infill(r.doc_id, dict(rows)[r.doc_id])[5]


def test_composition_is_associative_and_equals_a_walk():
    rng = np.random.default_rng(2)
    text = rng.choice(np.frombuffer(b"\n<PSM>ab", np.uint8), 5000)
    for start in range(4):
        state, lines, marks = start, 0, 0
        for byte in text.tolist():
            state, n, m = infill._step(state, int(infill.CLASS[byte]))
            lines, marks = lines + n, marks + m
        whole = infill.chunk_functions(text, np.array([0, len(text)]))
        f, ln, mk = (x[-1] for x in infill.scan(*whole))
        assert (infill.TO[f, start], ln[start], mk[start]) == (state, lines, marks)
    f, g, h = rng.integers(0, 256, (3, 50))
    assert (infill.THEN[infill.THEN[f, g], h] == infill.THEN[f, infill.THEN[g, h]]).all()


# --- 13 exact dedup


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = ids.index(keep)
        out += [(i, keep, len(ids), n == first, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def deduped(df, **how):
    return sorted((tuple(r) for r in exact.dedup(df, **how).collect()), key=str)


def test_golomb_codes_come_back():
    rng = np.random.default_rng(1)
    for n, low, high in ((0, 0, 9), (1, 0, 1 << 48), (1, 5, 6), (3, 0, 3), (1000, 1 << 40, 1 << 47), (5000, 100, 101), (300, 7, 4000)):
        v = np.sort(rng.integers(low, high, n))
        r, code = exact.golomb_encode(v, low, high)
        assert exact.golomb_decode(code, n, r, low).tolist() == v.tolist()
    v = np.sort(rng.integers(0, 1 << 48, 60_000))
    assert len(exact.golomb_encode(v, 0, 1 << 48)[1]) * 8 / len(v) < 36


@pytest.mark.parametrize("sender_rows", [1, 7, 1 << 16])
def test_dedup_equals_plain_python(spark, sender_rows):
    rng = random.Random(9)
    texts = [prose(5, rng) for _ in range(60)]
    rows = [(i, texts[0] if i % 3 == 0 else rng.choice(texts) if i % 3 == 1 else f"own {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert deduped(df, sender_rows=sender_rows) == plain_dedup(rows)


def test_dedup_of_odd_rows(odd, nothing):
    for n in (1, 1 << 16):
        assert deduped(odd, sender_rows=n) == plain_dedup([r[:2] for r in ODD])
    assert deduped(nothing) == []


def test_dedup_with_string_ids_and_repeats(spark):
    rows = [("b", "t"), ("b", "t"), ("a", "t"), (None, "t"), (None, "u"), (None, "u")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = deduped(df, sender_rows=1)
    assert got == plain_dedup(rows)
    assert Counter(r[3] for r in got) == {True: 2, False: 4}


def test_equal_fingerprints_of_different_texts_make_no_group(spark, monkeypatch):
    """With fingerprints of one value all texts are suspects; the bytes tell them apart."""
    monkeypatch.setattr(exact, "FP_BITS", 4)
    rows = [(i, f"text {i % 30}" if i % 2 else f"single {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert deduped(df, sender_rows=10) == plain_dedup(rows)
