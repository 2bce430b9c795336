"""Text and CSV sources and sinks: trajectories, gravity, query metadata, poses, IMU, indices, logs, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placerec.operators.relational import assert_none

QUERY_META = "query_id int, window int, start_s double, points int, file string, truth_valid string, truth_x double, truth_y double"
POSE_CSV = "stamp double, x double, y double, z double, qx double, qy double, qz double, qw double"
_TUM = ("stamp", "tx", "ty", "tz", "qx", "qy", "qz", "qw")


def truthy(c):
    """One rule for booleans in text: 1, true and yes in any case."""
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes")


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, stamp, tx .. qw): one pose a line of eight fields, quaternions normalised, stamps strictly rising."""
    raw = spark.read.text(path).where(F.trim("value") != "").withColumn("scan_id", F.monotonically_increasing_id())
    parts = raw.select("scan_id", F.split(F.trim("value"), r"\s+").alias("p"))
    assert_none(parts.where(F.size("p") != 8), "a trajectory line has eight fields")
    p = parts.select("scan_id", *[F.element_at("p", i + 1).cast("double").alias(c) for i, c in enumerate(_TUM)])
    n = F.sqrt(sum(F.col(c) * F.col(c) for c in ("qx", "qy", "qz", "qw")))
    p = p.withColumns({c: F.col(c) / n for c in ("qx", "qy", "qz", "qw")})
    # ids as lines count up, whatever the partitions
    p = p.withColumn("scan_id", F.row_number().over(Window.orderBy("scan_id")) - 1)
    assert_none(p.withColumn("before", F.lag("stamp").over(Window.orderBy("scan_id"))).where("stamp <= before"), "stamps must rise")
    return p


def write_tum(poses: DataFrame, path: str) -> None:
    line = F.format_string(" ".join(["%.9f"] * 8), *[F.col(c).cast("double") for c in _TUM])
    poses.orderBy("stamp").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_gravity(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, stamp, ux, uy, uz): unit up vectors; the id column may be index, query_id or keyframe_id and counts from 0."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    key = next((c for c in ("index", "query_id", "keyframe_id") if c in raw.columns), None)
    if key is None or not {"up_x", "up_y", "up_z"} <= set(raw.columns):
        raise ValueError("gravity needs an id and up_x, up_y, up_z")
    g = raw.select(F.col(key).cast("long").alias("scan_id"), F.col("stamp").cast("double").alias("stamp"), *[F.col(f"up_{c}").cast("double").alias(f"u{c}") for c in "xyz"])
    n = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    assert_none(g.where(F.isnan(n) | (n < 1e-12) | n.isNull()), "an up vector has no length")
    h = g.agg(F.count("*").alias("n"), F.max("scan_id").alias("m"), F.min("scan_id").alias("l"), F.count_distinct("scan_id").alias("d")).first()
    if h.n and (h.l != 0 or h.m + 1 != h.n or h.d != h.n):
        raise ValueError("gravity ids must count from 0")
    return g.withColumns({c: F.col(c) / n for c in ("ux", "uy", "uz")})


def read_query_meta(spark: SparkSession, path: str) -> DataFrame:
    """Query metadata; further columns are kept as text."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST")
    need = [c.split()[0] for c in QUERY_META.split(", ")]
    if missing := [c for c in need if c not in raw.columns]:
        raise ValueError(f"query metadata lacks {missing}")
    kinds = dict(c.split() for c in QUERY_META.split(", "))
    typed = [F.nullif(F.col(c), F.lit("")).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns]
    return raw.select(*typed).withColumn("truth_valid", truthy(F.col("truth_valid")))


def eligible(meta: DataFrame) -> DataFrame:
    """The queries that have a valid truth; the others take no part in an evaluation."""
    return meta.where(F.coalesce("truth_valid", F.lit(False)))


def write_queries(points: DataFrame, meta: DataFrame, gravity: DataFrame | None, path: str) -> DataFrame:
    """A query session: clouds as ``clouds/*.bin``, ``metadata`` and ``gravity`` as CSV with a header, in the order of their ids; the metadata.

    ``meta`` has query_id, start_s, truth_valid, truth_x, truth_y and what else it likes; window, file and points are filled in. Every
    query needs a cloud, and with ``gravity`` (scan_id, stamp, ux, uy, uz) an up vector.
    """
    from placerec.sources.pcd import write_clouds

    files = write_clouds(points, f"{path.removeprefix('file:')}/clouds", "bin").select(F.col("scan_id").alias("query_id"), F.element_at(F.split("file", "/"), -1).alias("file"), "points")
    files = spark_table(files, f"{path}/.files")
    out = meta.drop("window", "file", "points").join(files, "query_id", "left").withColumn("window", F.col("query_id"))
    assert_none(out.where("file is null"), "a query has no cloud")
    first = ["query_id", "window", "start_s", "points", "file", "truth_valid", "truth_x", "truth_y"]
    out = out.select(*first, *[c for c in out.columns if c not in first])
    out.orderBy("query_id").coalesce(1).write.mode("overwrite").csv(f"{path}/metadata", header=True)
    if gravity is not None:
        assert_none(meta.join(gravity.select(F.col("scan_id").alias("query_id")), "query_id", "left_anti"), "a query has no up vector")
        g = gravity.select(F.col("scan_id").alias("query_id"), "stamp", *[F.col(f"u{c}").alias(f"up_{c}") for c in "xyz"])
        g.orderBy("query_id").coalesce(1).write.mode("overwrite").csv(f"{path}/gravity", header=True)
    return out


def spark_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_pose_csv(spark: SparkSession, path: str) -> DataFrame:
    """Odometry or trusted poses in stamp order; the first of equal stamps; ``stamp_ns`` counts nanoseconds."""
    raw = spark.read.csv(path, header=True).withColumn("_line", F.monotonically_increasing_id())
    stamp = (F.col("stamp_ns").cast("long") / 1e9) if "stamp_ns" in raw.columns else F.col("stamp").cast("double")
    p = raw.select("_line", stamp.alias("stamp"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "qx", "qy", "qz", "qw")])
    first = F.row_number().over(Window.partitionBy("stamp").orderBy("_line"))
    return p.withColumn("_r", first).where("_r = 1").drop("_r", "_line").orderBy("stamp")


def read_gnss(spark: SparkSession, path: str) -> DataFrame:
    """Fixes with a valid status."""
    kinds = "stamp double, status int, lat double, lon double, alt double, cov_xx double, cov_yy double, cov_zz double"
    return spark.read.csv(path, header=True, schema=kinds).where("status >= 0")


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """(stamp, wx .. az) of comma lines (idx), sec, nsec, six values; comments and short lines are passed over."""
    p = spark.read.text(path).where(~F.trim("value").startswith("#")).select(F.split("value", ",").alias("p")).where(F.size("p") >= 8)
    at = lambda i: F.trim(F.element_at("p", i))
    # the last eight fields: an index before them may be absent
    stamp = at(-8).cast("long") + at(-7).cast("long") * 1e-9
    return p.select(stamp.alias("stamp"), *[at(i - 6).cast("double").alias(c) for i, c in enumerate(("wx", "wy", "wz", "ax", "ay", "az"))])


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    """Entry numbers, one a line: not negative, strictly rising, at least one."""
    p = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("_line"), F.trim("value").cast("long").alias("scan_id"))
    if p.isEmpty():
        raise ValueError("no index")
    assert_none(p.withColumn("before", F.lag("scan_id").over(Window.orderBy("_line"))).where("scan_id < 0 or scan_id <= before"), "indices must rise from 0")
    return p.select("scan_id")


def scan_logs(spark: SparkSession, path: str, fields: dict[str, str], alarm: str | None = None) -> DataFrame:
    """Numbers that patterns find in log lines; raises if a line holds the alarm."""
    raw = spark.read.text(path)
    if alarm:
        assert_none(raw.where(F.col("value").rlike(alarm)), "the log holds a health warning")
    found = raw.select(*[F.nullif(F.regexp_extract("value", r, 1), F.lit("")).cast("double").alias(c) for c, r in fields.items()])
    return found.where(F.coalesce(*[F.col(c) for c in fields]).isNotNull())


def replay_index(spark: SparkSession, path: str, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """(path, stamp) of files whose names hold sec_nsec, within a span from the first."""
    f = spark.read.format("binaryFile").load(path).select("path")
    f = f.withColumn("stamp", F.regexp_extract("path", r"(\d+)[_.](\d{9})\D*$", 1).try_cast("double") + F.regexp_extract("path", r"(\d+)[_.](\d{9})\D*$", 2).try_cast("double") * 1e-9).where("stamp is not null")
    first = f.agg(F.min("stamp")).first()[0]
    f = f.where(F.col("stamp") >= F.lit((first or 0.0) + offset))
    return (f if duration is None else f.where(F.col("stamp") <= F.lit((first or 0.0) + offset + duration))).orderBy("stamp")


def candidate_csv(candidates: DataFrame, path: str) -> None:
    """The columns of a candidate file, by query and rank; what a file has no place for, as ``yaw_matches``, is left out."""
    from placerec.operators.match import CANDIDATE_COLUMNS

    candidates.select(*CANDIDATE_COLUMNS).orderBy("query_index", "candidate_rank").write.mode("overwrite").csv(path, header=True)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A candidate file."""
    from placerec.operators.match import CANDIDATE_COLUMNS

    whole = ("query_index", "candidate_rank", "candidate_index", "sector_shift")
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} {'bigint' if c in whole else 'double'}" for c in CANDIDATE_COLUMNS), mode="FAILFAST")


def timing(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_index, retrieval_ms, candidate_count): one row a query, also without candidates; the time is that of its candidates, null without."""
    ms = F.max("retrieval_ms") if "retrieval_ms" in candidates.columns else F.lit(None).cast("double")
    n = candidates.groupBy("query_index").agg(ms.alias("retrieval_ms"), F.count("*").alias("n"))
    return queries.select("query_index").distinct().join(n, "query_index", "left").select("query_index", "retrieval_ms", F.coalesce("n", F.lit(0)).alias("candidate_count"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of a folder's files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def build_missing(spark: SparkSession, wanted: DataFrame, path: str, build, key: str = "scan_id", parts: int = 16) -> DataFrame:
    """A Parquet cache of descriptors that grows part by part: only keys that it lacks are built, and a build that broke off goes on.

    Keys fall into ``parts`` by a hash. ``build`` turns the wanted rows of one part into descriptors with the same key column; they are
    written to a folder of their own, and a line of the log, renamed into place, commits it. Folders without a line, such as a
    crash leaves, are never read. A build that gives nothing for a key is asked for it again by the next run.
    """
    fs, log = _folder(spark, f"{path}/log")
    done = _committed(spark, path)
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    todo = wanted.withColumn("_part", part)
    if done:
        todo = todo.join(spark.read.parquet(*done).select(key).distinct(), key, "left_anti")
    left = sorted(r._part for r in todo.select("_part").distinct().collect())
    schema = None
    for p in left:
        run = uuid.uuid4().hex
        out = build(todo.where(F.col("_part") == p).drop("_part"))
        out.write.parquet(f"{path}/data/{p}-{run}")
        schema = out.schema
        _put(spark, fs, log, f"{p}-{run}")
    done = _committed(spark, path)
    if not done:
        return spark.createDataFrame([], (schema or build(wanted.limit(0)).schema))
    return spark.read.parquet(*done)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    return fs, p


def _put(spark: SparkSession, fs, log, name: str) -> None:
    """A file of the log: written aside, then renamed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    aside = path(log, f".{name}")
    fs.create(aside).close()
    if not fs.rename(aside, path(log, name)):
        raise OSError(f"the log of {name} could not be written")


def _committed(spark: SparkSession, path: str) -> list[str]:
    fs, log = _folder(spark, f"{path}/log")
    return sorted(f"{path}/data/{s.getPath().getName()}" for s in fs.listStatus(log) if not s.getPath().getName().startswith("."))


#: Datatypes of point fields, fixed values of the message format: number to NumPy type.
POINT_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}


def decode_clouds(clouds: DataFrame, fields: dict[str, tuple[int, int]], low: float = 0.3, high: float = 80.0) -> DataFrame:
    """(scan_id, ord, x, y, z, intensity) of packed point buffers, finite and ``low`` to ``high`` from the sensor.

    Input: (scan_id, data, width, height, point_step, row_step); ``fields`` has the offset and datatype number of each name.
    A missing field, another datatype or a buffer that is too short is an error.
    """
    import numpy as np
    import pyarrow as pa

    names = ("x", "y", "z", "intensity")
    if lack := [n for n in names if n not in fields or fields[n][1] not in POINT_TYPES]:
        raise ValueError(f"fields are missing or of an unknown type: {lack}")

    def run(batches):
        for batch in batches:
            for scan, data, width, height, step, row in zip(*(batch.column(c).to_pylist() for c in ("scan_id", "data", "width", "height", "point_step", "row_step")), strict=True):
                kind = np.dtype({"names": names, "formats": [POINT_TYPES[fields[n][1]] for n in names], "offsets": [fields[n][0] for n in names], "itemsize": step})
                p = np.ndarray((height, width), kind, data, 0, (row, step)).ravel()
                v = np.stack([p[n].astype(np.float32) for n in names], 1)
                r = np.sqrt((v[:, :3] ** 2).sum(1))
                at = np.flatnonzero(np.isfinite(v[:, :3]).all(1) & (r >= low) & (r <= high))
                yield pa.RecordBatch.from_arrays([pa.array([scan] * len(at), pa.int64()), pa.array(at), *(pa.array(v[at, i].astype(np.float64)) for i in range(4))], ["scan_id", "ord", *names])

    part = clouds.select(F.col("scan_id").cast("long").alias("scan_id"), "data", "width", "height", "point_step", "row_step")
    return part.mapInArrow(run, "scan_id bigint, ord bigint, x double, y double, z double, intensity double")


def write_results(rows: DataFrame, path: str) -> None:
    """Per-query or summary rows as CSV with a header."""
    rows.write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str, schema: str, algorithm: str | None = None) -> DataFrame:
    """Rows of a results file, of one algorithm if wanted; none at all is an error."""
    rows = spark.read.csv(path, header=True, schema=schema)
    rows = rows if algorithm is None else rows.where(F.col("algorithm") == algorithm)
    if rows.isEmpty():
        raise ValueError(f"no rows{'' if algorithm is None else ' of ' + algorithm} in {path}")
    return rows


def settings(environment: dict[str, str], defaults: dict) -> dict:
    """Defaults with what the environment overrides, by the defaults' types; empty values count as absent."""
    out = dict(defaults)
    for name, value in defaults.items():
        raw = environment.get(name, "")
        if raw:
            out[name] = raw.strip().lower() in ("1", "true", "yes") if isinstance(value, bool) else type(value)(raw)
    return out
