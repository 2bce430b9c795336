"""Retrieval evaluation: ranks, recall, intervals, curves, paired tests, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 100)


def first_correct_rank(candidates: DataFrame, truth: DataFrame, radius: float) -> DataFrame:
    """Per query with a truth: rank of the first candidate within the radius, top-1 error, candidate count.

    Queries without candidates stay, as failures. Input: candidates (query_id, rank, x, y), truth (query_id, tx, ty).
    """
    d = F.sqrt((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")))
    j = truth.join(candidates, "query_id", "left").withColumn("error", d)
    return j.groupBy("query_id").agg(F.min(F.when(F.col("error") <= radius, F.col("rank"))).alias("first_rank"), F.min(F.when(F.col("rank") == 1, F.col("error"))).alias("top1_error"), F.count("rank").alias("candidates"))


def recall(ranks: DataFrame, ks=KS, by=()) -> DataFrame:
    flags = [F.avg((F.coalesce("first_rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_at_{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *flags)


def recall_curve(ranks: DataFrame, most: int = 5) -> DataFrame:
    k = ranks.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return k.groupBy("k").agg((100 * F.avg((F.coalesce("first_rank", F.lit(1 << 30)) <= F.col("k")).cast("double"))).alias("recall"))


def quantile(c: str, q: float) -> Column:
    """Exact, linear between neighbours."""
    return F.percentile(c, F.lit(q))


def error_summary(rows: DataFrame, c: str, by=()) -> DataFrame:
    """Count, median, p95 and maximum of the finite values."""
    ok = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return ok.groupBy(*by).agg(F.count("*").alias("n"), quantile(c, 0.5).alias("median"), quantile(c, 0.95).alias("p95"), F.max(c).alias("max"))


def yaw_errors(candidates: DataFrame, ranks: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(query_id, dt, error) in radians of the yaw seed of correct best candidates, against the reference of the nearest stamp.

    Candidates are (key, query_id, rank, stamp, yaw, yaw_shift), ranks of :func:`first_correct_rank`, the reference (key, stamp, yaw);
    ``key`` names the session, a time line of its own.
    """
    from placerec.functions import geom as G
    from placerec.operators.trajectory import asof_nearest

    top = candidates.where("rank = 1").join(ranks.where("first_rank = 1").select("query_id"), "query_id")
    top = top.select(key, "query_id", "stamp", G.seed_yaw(F.col("yaw"), F.col("yaw_shift")).alias("seed"))
    near = asof_nearest(top, reference.select(key, "stamp", "yaw"), key, tie="later")
    return near.select("query_id", "dt", F.abs(G.wrap(F.col("seed") - F.col("ref_yaw"))).alias("error"))


def vertical_errors(candidates: DataFrame, truth: DataFrame, radius: float, offset: float = 0.0) -> DataFrame:
    """(query_id, estimate, reference, error) of the highest-ranked candidate within the radius; queries without one are left out.

    Candidates are (query_id, rank, x, y, z, vertical_shift), truth (query_id, tx, ty, tz).
    """
    j = candidates.join(truth, "query_id")
    near = j.where(F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2) <= radius)
    best = near.groupBy("query_id").agg(F.min_by(F.struct((F.col("vertical_shift") + offset).alias("estimate"), (F.col("tz") - F.col("z")).alias("reference")), "rank").alias("b"))
    return best.select("query_id", "b.estimate", "b.reference", (F.col("b.estimate") - F.col("b.reference")).alias("error"))


def signed_summary(rows: DataFrame, c: str) -> DataFrame:
    """One row of signed errors: count, mean and root mean square size, median, spread between quartiles, p95 of the size."""
    e = F.col(c)
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), quantile(c, 0.5).alias("median"), (quantile(c, 0.75) - quantile(c, 0.25)).alias("iqr"), F.percentile(F.abs(e), F.lit(0.95)).alias("p95"))


def nearest_quantile(rows: DataFrame, c: str, q: float, by: str) -> DataFrame:
    """The value at the index nearest to q (n - 1), halves to even."""
    w = Window.partitionBy(by)
    r = rows.where(F.col(c).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(c)) - 1).withColumn("n", F.count("*").over(w))
    return r.where(F.col("i") == F.rint(q * (F.col("n") - 1))).groupBy(by).agg(F.min(c).alias("value"))


def wilson(successes: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    p, n = successes / n, n.cast("double")
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def pr_curve(rows: DataFrame, by: str, score: str, correct: str, total: str, order: str, ascending: bool = True) -> DataFrame:
    """Cumulative precision and recall, best scores first; recall is of all queries."""
    w = Window.partitionBy(by).orderBy(F.asc(score) if ascending else F.desc(score), order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("k", F.row_number().over(w)).withColumn("tp", F.sum(F.col(correct).cast("int")).over(run))
    return d.withColumns({"precision": F.col("tp") / F.col("k"), "recall": F.col("tp") / F.col(total)})


def f1_aupr(curve: DataFrame, by: str) -> DataFrame:
    """Greatest F1, and the area by trapezoids from (0, first precision)."""
    w = Window.partitionBy(by).orderBy("k")
    r0, p0 = F.coalesce(F.lag("recall").over(w), F.lit(0.0)), F.coalesce(F.lag("precision").over(w), F.col("precision"))
    d = curve.withColumn("area", (F.col("recall") - r0) * (F.col("precision") + p0) / 2)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return d.groupBy(by).agg(F.max(f1).alias("f1_max"), F.sum("area").alias("aupr"))


def mcnemar(pairs: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Discordant counts and the exact two-sided binomial p of two methods' paired flags."""
    n = pairs.groupBy(by).agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"))
    m = F.col("only_a") + F.col("only_b")
    # log binomial coefficients as running sums of logs
    low = F.least("only_a", "only_b")
    logs = F.aggregate(F.sequence(F.lit(0), low.cast("int")), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda acc, i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(acc["c"] + F.log((m - i + 1) / F.greatest(i, F.lit(1)))).alias("c"), (acc["s"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(acc["c"] + F.log((m - i + 1) / F.greatest(i, F.lit(1)))) - m * F.log(F.lit(2.0)))).alias("s")))
    return n.select(by, "only_a", "only_b", F.least(F.lit(1.0), 2 * logs["s"]).alias("p"))


def latency_summary(rows: DataFrame, by: str, total: str, ordinal: str, limit: float = 100.0) -> DataFrame:
    """Median, p95, mean and share within a limit; methods in the order in which they first come up."""
    out = rows.groupBy(by).agg(F.min(ordinal).alias("first"), quantile(total, 0.5).alias("median"), quantile(total, 0.95).alias("p95"), F.avg(total).alias("mean"), (100 * F.avg((F.col(total) <= limit).cast("double"))).alias("within"))
    return out.orderBy("first", by)


def macro(rows: DataFrame, dataset: str, weight: str, value: str) -> DataFrame:
    """Dataset rows with the mean over datasets of each weight, as one GROUPING SETS aggregation."""
    g = rows.groupingSets([[F.col(dataset), F.col(weight)], [F.col(weight)]], dataset, weight).agg(F.avg(value).alias("_value"), (F.grouping(dataset) == 1).alias("is_macro"))
    return g.select(F.coalesce(dataset, F.lit("macro")).alias(dataset), weight, F.col("_value").alias(value), "is_macro")


def delta_from(rows: DataFrame, by: str, weight: str, value: str, at: float) -> DataFrame:
    """The value less that of the weight ``at`` in the same group."""
    base = F.max(F.when(F.abs(F.col(weight) - at) < 1e-9, F.col(value))).over(Window.partitionBy(by))
    return rows.withColumn("delta", F.col(value) - base)


def select_weight(rows: DataFrame, weight: str, r1: str, r5: str) -> DataFrame:
    """The weight of the greatest mean recall at 1, then at 5, then the first."""
    m = rows.groupBy(weight).agg(F.round(F.avg(r1), 9).alias("r1"), F.round(F.avg(r5), 9).alias("r5"))
    return m.agg(F.max_by(F.struct(weight, "r1", "r5"), F.struct("r1", "r5", (-F.col(weight)).alias("f"))).alias("b")).select("b.*")


def gate(rows: DataFrame, expected: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """``rows`` if they hold the recorded figures; a missing key or a figure beyond the tolerance is an error."""
    from placerec.operators.relational import assert_none

    e = expected.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    off = F.lit(False)
    for c in columns:
        off |= ~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(f"_{c}")), F.col(c).isNull() & F.col(f"_{c}").isNull())
    assert_none(rows.join(e, F.col(key) == F.col("_k"), "full_outer").where(F.col(key).isNull() | F.col("_k").isNull() | off), "figures differ from the recorded ones")
    return rows
