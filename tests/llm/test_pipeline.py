"""The pipeline's stages against brute force on small tables."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_groups, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    at = str(tmp_path_factory.mktemp("tables"))
    passage = prose(90, rng)
    rows = []
    for i in range(160):
        text = prose(rng.randint(30, 80), rng)
        if i % 10 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 10 == 1 and i > 1:
            text = rows[1][1]
        elif i % 10 == 2:
            text += " " + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def test_stages_one_by_one(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard", "substring_dedup", "source_mix", "byte_bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "byte_bpe":
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        seen[name] = docs.collect()
    clean = {r[0] for r in rows if r[0] % 10}
    assert {r.doc_id for r in seen["quality_classifier"]} == clean
    groups = brute_groups([(r.doc_id, r.text) for r in seen["quality_classifier"]], 5, 80)
    assert sorted(r.doc_id for r in seen["ngram_jaccard"]) == sorted(i for i, _, g in groups if i == g)
    text = {r.doc_id: r.text for r in seen["ngram_jaccard"]}
    cut = {r.doc_id: r for r in seen["substring_dedup"]}
    assert cut.keys() == text.keys()
    assert {i for i in cut if cut[i].text != text[i]} == {i for i in text if i % 10 == 2 and i > 2}
    assert all(r.n_chars == len(r.text) for r in cut.values())
    size = {i: len((r.text or "").split()) for i, r in cut.items()}
    per, taken = {}, {}
    for i, r in cut.items():
        per[r.source] = per.get(r.source, 0) + size[i]
    for r in seen["source_mix"]:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    from tests.llm.test_operators import brute_targets

    for s, t in brute_targets(per).items():
        assert abs(taken.get(s, 0) - t) <= max(size.values())
    assert len(seen["byte_bpe"]) == len(seen["source_mix"])


def test_run_equals_the_stages(spark, folder):
    at, _ = folder
    got = corpus_pipeline.run(spark, at).select("doc_id", "n_tokens", "ids_sha256").collect()
    want = spark.read.parquet(f"{at}/byte_bpe").select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and ids, no rows, and columns named as those used inside."""
    from pyspark.sql import functions as F

    clash = ("id", "n", "h1", "rows", "gone", "copies", "__maybe", "__word", "__copies", "__score", "key", "size", "text_x", "at", "c0", "removed_bytes")
    rng = random.Random(11)
    good = [(i, prose(40, rng)) for i in range(40)]
    rows = [(i, t, "en", "a", 1) for i, t in good] + [(100 + i, t.upper().replace(" ", "!! "), "en", "b", 1) for i, t in good]
    odd = [(200, None, None, None, None), (201, "", "en", "a", 0), (202, "  \n", "en", None, 3), (None, good[3][1], "en", "a", 1), (None, None, None, None, None), (7, good[7][1], "en", "a", 1), (7, good[9][1] + " more", "en", "a", 1), (203, prose(20_000, rng), "en", "b", 1), (204, "x" * 50_000, "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for n, given in enumerate((rows + odd, [])):
        docs = spark.createDataFrame(given, schema)
        for c in clash:
            docs = docs.withColumn(c, F.lit("clash"))
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "byte_bpe":
                assert out.columns == names
            out.write.parquet(f"{tmp_path}/{n}{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}{name}")
            if name != "byte_bpe":
                assert docs.where(" or ".join(f"`{c}` <> 'clash'" for c in clash)).isEmpty()
            assert docs.isEmpty() == (not given)
            if given and name == "ngram_jaccard":
                kept = {(r.doc_id, r.text) for r in docs.collect()}
                assert (7, good[7][1]) in kept and (7, good[9][1] + " more") in kept and (9, good[9][1]) not in kept
