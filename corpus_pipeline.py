"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Defined results, the same in all stages: further columns of ``docs`` pass through whatever their names; an empty table
stays empty; texts of any length are taken whole; null and empty texts and null ids are told stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerec.llm import bpe, jaccard, mixing, quality, registry, substrings
from placerec.llm.shared import cut, free, small_batches, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold go; the model learns from labels of rows that are not held out.

    A null or empty text is scored like any other, by what the model has without features. Repeated rows have one score and
    stay or go together. With labels of one class only every text gets that class's score; without any it is 0.5, and all go.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~registry.held_out()))
    name = free("score", docs.columns)
    return quality.score(docs, model, keep=docs.columns, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more stays: that of the smallest id.

    Null and wordless texts are copies of nothing and stay, and so do rows with a null id. Of rows that share an id and the
    set of shingles one stays; rows that share an id alone are told apart.
    """
    small_batches(spark)
    return jaccard.keep_one(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id holds are taken out; n_chars follows the text.

    A null text stays null; a text that is only repeats becomes empty; rows with a null id stay whole, and rows of one id are no
    repeats of each other.
    """
    small_batches(spark)
    removed = substrings.added_names(docs.columns)[0]
    out = substrings.dedup(docs).withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows that repeat are taken one by one.

    A text without words has no size: it comes once, and once more for each whole epoch of its source, if its place in the
    order is reached. A null source is a source of its own; equal keys are ordered by id.
    """
    small_batches(spark)
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; a null or empty text has no ids."""
    small_batches(spark)
    import public_tokenizers

    return bpe.bpe_digests(docs, registry.rank_file(), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The classifier and the chunk hash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
