"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets an exponential key ``-ln(u) / quality`` whose ``u`` is a digest
of its id (of its text, where the id is null), so reruns agree. The quality is a column
of weights, as a classifier's scores, or else a plain rule of characters a word. A source's target is a water level: its share of all
words by weight, but no more than ``cap`` times what the source holds, the excess
going to the others by weight. Whole epochs of a source come first; the rest of its
target is filled in key order, by prefix sums. Of the document at the edge the words
that fit are taken; where documents stay whole (``copies``), it is taken if half of it fits.

A source's prefix sums never stand in one task: keys fall into 1,024 buckets of
1,024, sums by bucket (a fixed number of rows a source, partial sums first) tell the
bucket where the target ends, and only that bucket of that bucket is sorted.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a
source of its own, last in order; equal keys are ordered by id, then size; rows that
repeat an id are taken one by one; a weight that is null, not a number or under
``LEAST_QUALITY`` counts as that, one over 1 as 1; an empty table gives an empty table; only the
id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerec.llm.shared import cut, free

WEIGHTS, CAP, SEED, LEAST_QUALITY, FAN = (5, 2, 1), 3.0, "mix", 0.5, 1024
#: A word is a run of other bytes than these.
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """1 for texts of 3 to 10 characters a word, space included, else ``LEAST_QUALITY``."""
    return F.when((F.length(text) >= 3 * size) & (F.length(text) <= 10 * size) & (size > 0), F.lit(1.0)).otherwise(F.lit(LEAST_QUALITY))


def weight(column: Column) -> Column:
    """A given weight, kept between ``LEAST_QUALITY`` and 1."""
    w = column.cast("double")
    return F.when(w.isNull() | F.isnan(w), F.lit(LEAST_QUALITY)).otherwise(F.greatest(F.least(w, F.lit(1.0)), F.lit(LEAST_QUALITY)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order, every = Window.orderBy("ratio", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("water") * F.col("w")), "cap").alias("target"))


def _edge(sums: DataFrame, bucket: str, rest: str) -> DataFrame:
    """Of each source: the first bucket that doesn't fit whole, and what is left of ``rest`` when it begins."""
    run = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("end", F.sum("words").over(run)).where(F.col("end") > F.col(rest))
    at = F.min(F.struct(bucket, (F.col(rest) - (F.col("end") - F.col("words"))).alias("left")))
    return over.groupBy("source").agg(at.alias("at")).select("source", F.col(f"at.{bucket}").alias(f"{bucket}_edge"), F.col("at.left").alias(f"{bucket}_left"))


def _with(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined to one row a source; null is a source too."""
    sources = sources.withColumnRenamed("source", "its_source")
    return rows.join(sources, F.col("source").eqNullSafe(F.col("its_source")), how).drop("its_source")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, keep: list[str], quality_col: str | None) -> DataFrame:
    """Each document's size, key and the two numbers of its bucket, beside the columns ``keep`` as k0, k1, ..."""
    given = (F.lit(None).cast("double") if quality_col is None else weight(F.col(quality_col))).alias("given")
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), given, *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).withColumn("size", words_in(F.col("text")))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    d = d.withColumn("key", -F.log(u) / (quality(F.col("text"), F.col("size")) if quality_col is None else F.col("given")))
    slot = F.least(F.floor((1 - F.exp(-F.col("key") * LEAST_QUALITY)) * (FAN * FAN)), F.lit(FAN * FAN - 1)).cast("long")
    d = d.withColumn("slot", slot)
    return d.select("id", "source", "size", "key", F.floor(F.col("slot") / FAN).cast("int").alias("b1"), (F.col("slot") % FAN).cast("int").alias("b2"), *[f"k{i}" for i in range(len(keep))])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = CAP, share: float = 1.0, seed: str = SEED, keep: list[str] | None = None, copies: str = "copies", quality_col: str | None = None) -> DataFrame:
    """Per document: size, its source's size and target, epochs taken whole, and the words taken in all.

    With ``keep``: those columns and, named ``copies``, the number of times the mix takes the document.
    """
    base = cut(_keyed(docs, id_col, text_col, source_col, seed, [], quality_col), "mix")
    first = cut(base.groupBy("source", "b1").agg(F.sum("size").alias("words")), "mix-buckets")
    plan = source_targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap, share)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = _with(first, plan.select("source", "rest")).select("source", "b1", "words", "rest")
    plan = cut(_with(plan, _edge(sums, "b1", "rest"), "left"), "mix-edges")
    inner = _with(base, plan.select("source", "b1_edge", "b1_left")).where(F.col("b1") == F.col("b1_edge")).groupBy("source", "b2", "b1_left").agg(F.sum("size").alias("words"))
    plan = cut(_with(plan, _edge(inner, "b2", "b1_left"), "left"), "mix-plan")
    d = _with(_keyed(docs, id_col, text_col, source_col, seed, keep, quality_col) if keep else base, plan)
    on_edge = (F.col("b1") == F.coalesce("b1_edge", F.lit(FAN))) & (F.col("b2") == F.coalesce("b2_edge", F.lit(FAN)))
    below = (F.col("b1") < F.coalesce("b1_edge", F.lit(FAN))) | (F.col("b1") == F.col("b1_edge")) & (F.col("b2") < F.coalesce("b2_edge", F.lit(FAN)))
    run = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    # what is left of the target when the document's turn comes
    left = F.col("b2_left") - F.coalesce(F.sum("size").over(run), F.lit(0))
    edge = d.where(on_edge).withColumn("left", left).withColumn("more", (F.col("size") / 2 <= F.col("left")).cast("long")).withColumn("words", F.greatest(F.lit(0), F.least("size", F.floor("left"))).cast("long")).drop("left")
    out = d.where(~on_edge).withColumn("more", below.cast("long")).withColumn("words", F.col("more") * F.col("size")).unionByName(edge)
    if keep:
        return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], (F.col("epochs") + F.col("more")).cast("int").alias(copies))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs") + F.col("words")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    name = free("copies", docs.columns)
    out = mix(docs, keep=docs.columns, copies=name, **how).where(F.col(name) > 0)
    return out.withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col(name)))).drop(name)


#: The same result of the documents table in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / CASE WHEN length(text) >= 3 * size AND length(text) <= 10 * size AND size > 0 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (
  SELECT *, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / w AS ratio,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0::DOUBLE)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(least(cap, w * max(CASE WHEN level <= ratio THEN level END) OVER ()), cap) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t)
SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
       (k.size * e.epochs + greatest(0, least(k.size, floor(e.target - e.epochs * e.source_size - coalesce(sum(k.size) OVER p, 0)))))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
WINDOW p AS (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
