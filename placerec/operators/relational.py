"""Set, order and file-listing operators over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subset(entries: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted entries, numbered anew in key order."""
    return entries.join(wanted.select(key).distinct(), key, "left_semi").withColumn("new_id", (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have, key, "left_anti")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids on one side only; empty if both hold the same."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def in_order(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Rows with the place of their name in a list; names outside come last."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(key))
    return rows.withColumn("place", F.when(place > 0, place).otherwise(F.lit(len(names) + 1)).cast("int"))


def method_table(parts: list[DataFrame], methods: list[str], key: str, values: list[str], name: str = "algorithm", suffix: str = " + G") -> DataFrame:
    """A row a key, a column for each value of each method (``method value``), of several tables that name methods with or without a suffix.

    Of methods that stand in several tables the last table's row counts; one that no table has for a key is an error.
    """
    every = None
    for i, part in enumerate(parts):
        plain = F.when(F.col(name).endswith(suffix), F.substring(name, 1, F.length(name) - len(suffix))).otherwise(F.col(name))
        rows = part.select(key, plain.alias(name), *values, F.lit(i).alias("_table"))
        every = rows if every is None else every.unionByName(rows)
    last = every.groupBy(key, name).agg(F.max_by(F.struct(*values), "_table").alias("_v"))
    wide = last.groupBy(key).pivot(name, methods).agg(F.first("_v"))
    assert_none(wide.where(" or ".join(f"`{m}` is null" for m in methods)), "a method is missing")
    return wide.select(key, *[F.col(f"`{m}`.{v}").alias(f"{m} {v}") for m in methods for v in values])


def stem(path: Column) -> Column:
    """The number a file name begins with; null if it is none."""
    return F.regexp_extract(path, r"(\d+)(?:\.[A-Za-z]+)?/?(?:[?#].*)?$", 1).try_cast("bigint")


def assert_none(rows: DataFrame, what: str) -> DataFrame:
    """Raises if any row is there."""
    if not rows.isEmpty():
        raise ValueError(what)
    return rows
