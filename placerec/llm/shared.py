"""Session helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="placerec-"))
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and a lost executor costs nothing.

    The table is dropped with the folder; :func:`drop` frees it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/placerec-{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._placerec_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_placerec_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay at a few MB, so that a Python worker's memory does."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """``name``, longer by underscores if the columns have it (names that differ in case alone count as the same)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


FILTER_WORDS = 1 << 17


def maybe_among(rows: DataFrame, ids: DataFrame, id_col: str, id_of: str = "id", flag: str = "__maybe") -> DataFrame:
    """``rows`` with a flag: false only if the id is surely none of ``ids`` (a null id never is).

    The filter has a fixed size, 1 MB of bits in at most 131,072 rows, whatever the number of ids, so it can be
    sent to all; with very many ids it only lets more rows through to the join that follows.
    """
    bit = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_WORDS * 64))
    words = ids.select(F.floor(bit(id_of) / 64).cast("int").alias("__word"), (bit(id_of) % 64).cast("int").alias("__b"))
    words = words.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __b)")).alias("__mask"))
    out = rows.withColumns({"__word": F.floor(bit(id_col) / 64).cast("int"), "__b": (bit(id_col) % 64).cast("int")}).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.getbit("__mask", F.col("__b")) == 1, F.lit(False)) & F.col(id_col).isNotNull()
    return out.withColumn(flag, hit).drop("__word", "__b", "__mask")
