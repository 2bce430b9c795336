"""Set, order, log and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from placerec import domain as M
from placerec.operators import relational as R
from placerec.plans.register import registry, rounded

QUERIES, query = registry()


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS new_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)")
def semi_subset(spark, d):
    wanted = M.table(spark, d, "lineitem").where((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.09)).select(F.col("l_suppkey").alias("s_suppkey"))
    return R.subset(M.table(spark, d, "supplier").select("s_suppkey", "s_name"), wanted, "s_suppkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_missing(spark, d):
    return R.missing(M.table(spark, d, "documents").select("doc_id", "lang"), M.table(spark, d, "labels"), "doc_id")


@query("SELECT 'supplier' AS method, s_suppkey AS id, round(s_acctbal, 4) AS score FROM supplier UNION ALL SELECT 'customer', c_custkey, round(c_acctbal, 4) FROM customer")
def union_methods(spark, d):
    s = M.table(spark, d, "supplier").select(F.lit("supplier").alias("method"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    c = M.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.lit("customer").alias("method"))
    return rounded(s.unionByName(c), 4)


@query("SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def except_ids(spark, d):
    return R.same_ids(M.table(spark, d, "documents").select("doc_id").distinct(), M.table(spark, d, "labels").select("doc_id").distinct())


@query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersect_windows(spark, d):
    e = M.table(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT n_nationkey, n_name, 'old' AS origin FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey, upper(n_name) || '!', 'new' FROM nation WHERE n_nationkey % 4 = 0")
def replace_by_key(spark, d):
    n = M.table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("old").alias("origin"))
    new = n.where("n_nationkey % 4 = 0").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"), F.lit("new").alias("origin"))
    return R.replace_by_key(n, new, "n_nationkey")


@query("SELECT o_orderpriority AS method, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 3 ELSE 4 END AS place FROM orders GROUP BY 1")
def method_order_merge(spark, d):
    n = M.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("n"))
    return R.in_order(n, "method", ["3-MEDIUM", "1-URGENT", "5-LOW"])


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages")
def log_extract(spark, d):
    p = M.table(spark, d, "pages")
    ext = lambda r: F.regexp_extract("url", r, 1)
    return p.select("page_id", ext("^([a-z]+)://").alias("scheme"), ext("/(en|de|fr|es)/").alias("lang"), F.nullif(ext("/([0-9]+)"), F.lit("")).try_cast("bigint").alias("number"))


@query(r"SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '(\d+)(?:\.[A-Za-z]+)?/?(?:[?#].*)?$', 1), '') AS BIGINT) AS stem FROM pages")
def stem_sort(spark, d):
    p = M.table(spark, d, "pages")
    return p.select("page_id", R.stem(F.col("url")).alias("stem")).orderBy("stem", "page_id")


@query("""SELECT event_type AS protocol, '{"protocol":"' || event_type || '","frames":' || count(*) || ',"first":' || min(event_id) || ',"users":' || count(DISTINCT user_id) || '}' AS manifest FROM events GROUP BY 1""")
def manifest_json(spark, d):
    e = M.table(spark, d, "events").groupBy(F.col("event_type").alias("protocol")).agg(F.count("*").alias("frames"), F.min("event_id").alias("first"), F.count_distinct("user_id").alias("users"))
    return e.select("protocol", F.to_json(F.struct("protocol", "frames", "first", "users")).alias("manifest"))


@query("SELECT item_id, sha256(text) AS sha FROM benchmark")
def sha_manifest(spark, d):
    return M.table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS sec, ((epoch_us(ts) % 1000000) * 1000)::BIGINT AS nsec, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000::DOUBLE, 6) AS since FROM events WHERE event_type = 'view'")
def time_split(spark, d):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = M.table(spark, d, "events").where("event_type = 'view'").withColumn("us", us)
    return rounded(e.select("event_id", F.floor(F.col("us") / 1000000).alias("sec"), (F.col("us") % 1000000 * 1000).alias("nsec"), ((F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / 1000000.0).alias("since")))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id")
def topic_index_scan(spark, d):
    e = M.table(spark, d, "events").where("event_type = 'click'")
    return e.orderBy("ts", "event_id").select("event_id", "user_id")


@query("""WITH n AS (SELECT user_id AS track, event_type AS m, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1, 2), k AS (SELECT track FROM n WHERE m IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(*) = 3)
SELECT track, max(n) FILTER (m = 'view') AS "view n", max(v) FILTER (m = 'view') AS "view v", max(n) FILTER (m = 'click') AS "click n", max(v) FILTER (m = 'click') AS "click v", max(n + 1) FILTER (m = 'purchase') AS "purchase n", max(v) FILTER (m = 'purchase') AS "purchase v" FROM n JOIN k USING (track) GROUP BY 1""")
def method_table(spark, d):
    """Three kinds of events as methods of two tables, side by side for each track that has all; the second table's purchases replace the first's."""
    e = M.table(spark, d, "events").groupBy(F.col("user_id").alias("track"), F.col("event_type").alias("algorithm")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("v"))
    names = ["view", "click", "purchase"]
    e = e.where(F.col("algorithm").isin(names))
    whole = e.groupBy("track").count().where("count = 3").select("track")
    e = e.join(whole, "track")
    plus = e.withColumn("algorithm", F.when(F.col("algorithm") != "click", F.concat("algorithm", F.lit(" + G"))).otherwise(F.col("algorithm")))
    return R.method_table([plus, e.where("algorithm = 'purchase'").withColumn("n", F.col("n") + 1)], names, "track", ["n", "v"])


@query("""WITH q AS (SELECT s_suppkey AS query_id, s_suppkey % 5 IN (0, 1, 3) AS valid, s_acctbal FROM supplier) SELECT count(*) AS n, min(query_id) AS first, round(sum(s_acctbal), 4) AS total FROM q WHERE valid""")
def eligible_queries(spark, d):
    """Query metadata with truth flags in five spellings, written as a file and read back: those with a valid truth."""
    from placerec.folders import shared_dir
    from placerec.sources import tables as S

    at, k = shared_dir(spark, "metadata"), F.col("s_suppkey") % 5
    flag = F.when(k == 0, "True").when(k == 1, " yes ").when(k == 2, "False").when(k == 3, "1").otherwise("")
    m = M.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("query_id"), F.col("s_suppkey").cast("int").alias("window"), F.lit(0.0).alias("start_s"), F.lit(0).alias("points"), F.lit("x.bin").alias("file"), flag.alias("truth_valid"), F.lit(0.0).alias("truth_x"), F.lit(0.0).alias("truth_y"), "s_acctbal")
    m.write.csv(at, header=True)
    q = S.eligible(S.read_query_meta(spark, at))
    return rounded(q.agg(F.count("*").alias("n"), F.min("query_id").cast("long").alias("first"), F.sum(F.col("s_acctbal").cast("double")).alias("total")), 4)


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_type = 'view'")
def results_csv(spark, d):
    """Per-query rows written as CSV and read back for one algorithm."""
    from placerec.sources import tables as S
    from placerec.folders import shared_dir

    at = shared_dir(spark)
    e = M.table(spark, d, "events")
    S.write_results(e.select(F.col("event_type").alias("algorithm"), "event_id", "user_id", "value"), at)
    return rounded(S.read_results(spark, at, "algorithm string, event_id bigint, user_id bigint, value double", "view").drop("algorithm"))


@query("""SELECT l_suppkey AS scan_id, count(*) AS n, round(sum((l_quantity - 25.3::DOUBLE)::FLOAT::DOUBLE), 3) AS x, round(max((l_discount * 40::DOUBLE + l_tax * 12.5::DOUBLE)::FLOAT::DOUBLE), 5) AS z FROM lineitem
WHERE sqrt((l_quantity - 25.3::DOUBLE)**2 + (l_extendedprice / 2000::DOUBLE - 26.03::DOUBLE)**2 + (l_discount * 40::DOUBLE + l_tax * 12.5::DOUBLE)**2) BETWEEN 0.3::DOUBLE AND 80::DOUBLE GROUP BY 1""")
def cloud_decode(spark, d):
    """Scans packed as point buffers with gaps between the fields, decoded again."""
    from placerec.sources import tables as S

    def pack(pdf):
        import numpy as np
        import pandas as pd

        kind = np.dtype({"names": ["x", "y", "z", "intensity"], "formats": ["<f4"] * 4, "offsets": [0, 4, 8, 16], "itemsize": 32})
        a = np.zeros(len(pdf), kind)
        for c in "xyz":
            a[c] = pdf[c]
        return pd.DataFrame({"scan_id": [pdf["scan_id"].iloc[0]], "data": [a.tobytes()], "width": [len(pdf)], "height": [1], "point_step": [32], "row_step": [32 * len(pdf)]})

    packed = M.points(spark, d).select("scan_id", "x", "y", "z").groupBy("scan_id").applyInPandas(pack, "scan_id bigint, data binary, width int, height int, point_step int, row_step int")
    p = S.decode_clouds(packed, {"x": (0, 7), "y": (4, 7), "z": (8, 7), "intensity": (16, 7)})
    return rounded(p.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.max("z").alias("z")), 3, z=5)


@query("SELECT event_type AS method, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def regression_gate(spark, d):
    """Figures by method held against the same figures by another path."""
    from placerec.operators import evaluate as E

    e = M.table(spark, d, "events")
    again = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).groupBy(F.col("event_type").alias("method")).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    return rounded(E.gate(e.groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), again, "method", ["n", "mean"]))
