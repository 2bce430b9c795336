"""Exact nearest neighbours of vectors through a stored pivot index.

Each base row is keyed by its nearest pivot and the distance to it; rows of one pivot fall into annuli of equal width, of which
the index keeps the least and greatest distance and the number of rows. A query finds a lower bound for every annulus from its
distances to the pivots: by the triangle inequality, and by the half plane between two pivots. It first meets the annuli of
least bounds that hold k rows; the k-th distance found there tells which other annuli can hold anything nearer. Both meetings
are equi-joins on (pivot, annulus, block), so no pair beyond the bounds is made, and a crowded annulus is cut in blocks.

Pivots are chosen farthest-first from at most ``SAMPLE`` rows; every row is indexed and the result is exact. What is sent to all
is bounded by parameters: the pivots, and at most ``PIVOTS * 4 * ANNULI`` annuli. Vectors have one length, ``dims``; those that
are null or of another length, or hold null or non-finite values, are not indexed and find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, ANNULI, SAMPLE, BLOCK = 64, 32, 4096, 2048


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))


def usable(key: str, dims: int) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(key) == dims) & ~F.exists(key, bad), F.lit(False))


@dataclass(frozen=True)
class Index:
    """``rows`` hold the base's columns with ``cell``, ``reach`` and ``annulus``; ``pivots`` one row ``points``; ``annuli`` one row each."""

    rows: DataFrame
    pivots: DataFrame
    annuli: DataFrame
    key: str
    dims: int


def choose(base: DataFrame, id_col: str, key: str, dims: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[list[list[float]], float]:
    """Pivots, each the farthest of the sample from those before it, and the width of an annulus."""
    some = base.where(usable(key, dims)).select(id_col, F.transform(key, lambda x: x.cast("double")).alias("v")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    v = np.array([r.v for r in some.collect()], float).reshape(-1, dims)
    if not len(v):
        return [[0.0] * dims], 1.0
    chosen, near = [0], np.sqrt(((v - v[0]) ** 2).sum(1))
    while len(chosen) < min(pivots, len(v)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((v - v[chosen[-1]]) ** 2).sum(1)))
    # the last radius is what rows lie from their pivots, about; further annuli take what lies beyond
    return v[chosen].tolist(), float(near.max() / ANNULI) or 1.0


def keyed(base: DataFrame, key: str, pivots: DataFrame, width: float) -> DataFrame:
    """Adds ``cell``, ``reach`` and ``annulus`` to rows with usable keys."""
    at = F.array_min(F.transform("points", lambda p, i: F.struct(l2(key, p).alias("reach"), i.alias("cell"))))
    d = base.crossJoin(F.broadcast(pivots.select("points"))).withColumn("_at", at)
    return d.select(*base.columns, F.col("_at.cell").alias("cell"), F.col("_at.reach").alias("reach"), F.least(F.floor(F.col("_at.reach") / width), F.lit(4 * ANNULI - 1)).cast("int").alias("annulus"))


def summed(rows: DataFrame) -> DataFrame:
    """(cell, annulus, low, high, n, blocks): at most ``PIVOTS * 4 * ANNULI`` rows."""
    s = rows.groupBy("cell", "annulus").agg(F.min("reach").alias("low"), F.max("reach").alias("high"), F.count("*").alias("n"))
    return s.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))


def index(base: DataFrame, id_col: str, key: str, dims: int, save, pivots: int = PIVOTS) -> Index:
    """The index of ``base``; ``save(name, frame)`` writes a table and returns it as read back."""
    spark = base.sparkSession
    points, width = choose(base, id_col, key, dims, pivots)
    p = save("pivots", spark.createDataFrame([(points, width)], "points array<array<double>>, width double"))
    rows = save("indexed", keyed(base.where(usable(key, dims)), key, p, width))
    return Index(rows, p, save("annuli", summed(rows)), key, dims)


def _bounded(queries: DataFrame, key: str, ix: Index) -> DataFrame:
    """Each query with its annuli in the order of their lower bounds: ``rings`` of (bound, cell, annulus, n, blocks)."""
    one = ix.annuli.agg(F.sort_array(F.collect_list(F.struct("cell", "annulus", "low", "high", "n", "blocks"))).alias("all"))
    q = queries.crossJoin(F.broadcast(ix.pivots.select("points"))).withColumn("_to", F.transform("points", lambda p: l2(key, p))).drop("points")
    q = q.withColumn("_near", F.array_min("_to")).crossJoin(F.broadcast(one))
    reach = lambda r: F.element_at("_to", r["cell"] + 1)
    bound = lambda r: F.greatest(F.lit(0.0), reach(r) - r["high"], r["low"] - reach(r), (reach(r) - F.col("_near")) / 2)
    rings = F.array_sort(F.transform("all", lambda r: F.struct(bound(r).alias("bound"), r["cell"].alias("cell"), r["annulus"].alias("annulus"), r["n"].alias("n"), r["blocks"].alias("blocks"))))
    return q.withColumn("rings", rings).drop("all", "_to")


def _met(opened: DataFrame, ix: Index, q: str, c: str, key: str) -> DataFrame:
    """(q, c, distance): queries beside the rows of the annuli that they open."""
    o = opened.select(q, key, F.explode("open").alias("r")).select(q, key, F.col("r.cell").alias("cell"), F.col("r.annulus").alias("annulus"), F.explode(F.sequence(F.lit(0), F.col("r.blocks") - 1)).alias("block"))
    base = ix.rows.join(F.broadcast(ix.annuli.select("cell", "annulus", "blocks")), ["cell", "annulus"]).select("cell", "annulus", F.pmod(F.xxhash64(c), F.col("blocks")).cast("int").alias("block"), c, F.col(ix.key).alias("_base"))
    return o.join(base, ["cell", "annulus", "block"]).select(q, c, l2(key, "_base").alias("distance"))


def _opened(queries: DataFrame, ix: Index, k: int, q: str, c: str, key: str) -> DataFrame:
    """Each query with ``open``: the annuli that can hold one of its k nearest rows."""
    bounded = _bounded(queries.where(usable(key, ix.dims)), key, ix)
    count = F.aggregate("rings", F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n")), lambda a, r: F.when(a["n"] >= k, a).otherwise(F.struct((a["i"] + 1).alias("i"), (a["n"] + r["n"]).alias("n"))))
    first = bounded.withColumn("open", F.slice("rings", F.lit(1), F.greatest(count["i"], F.lit(1))))
    got = _met(first, ix, q, c, key)
    ranked = got.withColumn("_r", F.row_number().over(Window.partitionBy(q).orderBy("distance", c))).where(F.col("_r") <= k)
    kth = ranked.groupBy(q).agg(F.when(F.count("*") >= k, F.max("distance")).alias("kth"))
    d = bounded.join(kth, q, "left")
    slack = F.lit(1e-9) * (1 + F.col("kth") + F.col("_near"))
    return d.withColumn("open", F.filter("rings", lambda r: F.col("kth").isNull() | (r["bound"] <= F.col("kth") + slack)))


def nearest(queries: DataFrame, ix: Index, k: int, q: str, c: str, key: str) -> DataFrame:
    """(q, c, distance, rank): the k nearest rows of each query, ties by id."""
    got = _met(_opened(queries, ix, k, q, c, key), ix, q, c, key)
    return got.withColumn("rank", F.row_number().over(Window.partitionBy(q).orderBy("distance", c))).where(F.col("rank") <= k)


def scored_share(queries: DataFrame, ix: Index, k: int, q: str, c: str, key: str) -> DataFrame:
    """One row (queries, rows, scored, share): pairs of the second meeting against all pairs."""
    opened = _opened(queries, ix, k, q, c, key).select(F.aggregate("open", F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("n"))
    total = ix.annuli.agg(F.sum("n").alias("rows"))
    s = opened.agg(F.count("*").alias("queries"), F.sum("n").alias("scored"))
    return s.crossJoin(F.broadcast(total)).select("queries", "rows", "scored", (F.col("scored") / (F.col("queries") * F.col("rows"))).alias("share"))
