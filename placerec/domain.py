"""The driver's tables as domain views: points, poses, gravity, tracks, descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, ord, x, y, z): each supplier's line items as one scan; ord is unique and fixed."""
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_suppkey").alias("scan_id"), order.alias("ord"), (F.col("l_quantity") - 25.3).alias("x"), (F.col("l_extendedprice") / 2000.0 - 26.03).alias("y"), (F.col("l_discount") * 40.0 + F.col("l_tax") * 12.5).alias("z"))


POINTS = """points AS (SELECT l_suppkey AS scan_id, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS ord,
  l_quantity - 25.3::DOUBLE AS x, l_extendedprice / 2000::DOUBLE - 26.03::DOUBLE AS y, l_discount * 40::DOUBLE + l_tax * 12.5::DOUBLE AS z FROM lineitem)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, stamp, x, y, z, yaw): suppliers on a serpentine path."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(k.alias("scan_id"), k.cast("double").alias("stamp"), (k % 37 * 1.7).alias("x"), (k % 23 * 2.3 + F.col("s_acctbal") / 10000.0).alias("y"), (k % 5 * 0.1).alias("z"), (k % 61 * 0.1 - 3.0).alias("yaw"))


POSES = """poses AS (SELECT s_suppkey AS scan_id, s_suppkey::DOUBLE AS stamp, (s_suppkey % 37) * 1.7::DOUBLE AS x,
  (s_suppkey % 23) * 2.3::DOUBLE + s_acctbal / 10000::DOUBLE AS y, (s_suppkey % 5) * 0.1::DOUBLE AS z, (s_suppkey % 61) * 0.1::DOUBLE - 3::DOUBLE AS yaw FROM supplier)"""


def gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, ux, uy, uz): unit up vectors of slightly tilted sensors."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    a, b = (k % 7 - 3) * 0.02, (k % 5 - 2) * 0.03
    n = F.sqrt(a * a + b * b + 1.0)
    return s.select(k.alias("scan_id"), (a / n).alias("ux"), (b / n).alias("uy"), (F.lit(1.0) / n).alias("uz"))


GRAVITY = """gravity AS (SELECT scan_id, a / n AS ux, b / n AS uy, 1::DOUBLE / n AS uz FROM (SELECT *, sqrt(a * a + b * b + 1::DOUBLE) AS n FROM
  (SELECT s_suppkey AS scan_id, (s_suppkey % 7 - 3) * 0.02::DOUBLE AS a, (s_suppkey % 5 - 2) * 0.03::DOUBLE AS b FROM supplier)))"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, event_id, kind, stamp, x, y): events as positions of moving users."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("track_id"), "event_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").cast("double").alias("stamp"), F.col("value").alias("x"), (F.col("event_id") % 97 * 0.5).alias("y"))


TRACK = """track AS (SELECT user_id AS track_id, event_id, event_type AS kind, epoch_us(ts) / 1000000::DOUBLE AS stamp, value AS x, (event_id % 97) * 0.5::DOUBLE AS y FROM events)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, place, v): embeddings as flat descriptors of doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("place"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


DESCRIPTORS = """descriptors AS (SELECT vec_id, label AS place, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""
