"""The stored map: cells, keys, flags and entries of a session, written once and read by every retrieval.

A build goes over the points twice. The first pass votes for the split height; its one row is frozen into the configuration,
and may turn the whole map single-layer. The second makes cells, which are written bucketed by scan: what follows (keys, column
counts, boundary marks) needs no shuffle, and neither does a later join of candidates with the map's side. ``config`` is
written last: a folder without it is a build that did not end and cannot be opened.

Tables: ``cells`` (scan_id, layer, ring, sector, h, n, edge), n being the valid cells of the cell's own column and edge telling of
the boundary mask; ``entries`` (scan_id, the pose's columns, has_lower, has_upper, cells, ring_key, sector_key, columns), columns
holding the valid cells of each (layer, sector); ``index-*``, the pivot index over ring keys; ``config``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placerec.config import DescriptorConfig
from placerec.folders import kept, saved
from placerec.functions import geom as G
from placerec.operators import descriptor as D
from placerec.operators import match as R
from placerec.operators import metric as X
from placerec.operators import points as P
from placerec.operators import vertical as V
from placerec.operators.relational import assert_none

POSE = ("stamp", "x", "y", "z", "roll", "pitch", "yaw", "canonical_yaw")


@dataclass(frozen=True)
class StoredMap:
    cfg: DescriptorConfig
    entries: DataFrame
    cells: DataFrame
    index: X.Index
    #: What the first pass found: adapted, enabled, split, score, keyframes, support.
    split: dict

    def where(self, condition: str | Column) -> StoredMap:
        """A part of the map: the scans of a condition on ``scan_id``. The index stays whole, so only queries may be cut off it."""
        return replace(self, entries=self.entries.where(condition), cells=self.cells.where(condition))

    def scored_by(self, cfg: DescriptorConfig) -> StoredMap:
        """The same descriptors under other scoring settings; keys are worked out anew from the stored cells if the height offset differs."""
        if not self.cfg.compatible(cfg):
            raise ValueError("the descriptors were made with other shapes")
        if cfg.height_offset == self.cfg.height_offset:
            return replace(self, cfg=cfg)
        e = self.entries.drop("ring_key", "sector_key").join(_keys(self.cells, cfg), "scan_id", "left")
        return replace(self, cfg=cfg, entries=e.select(self.entries.columns), index=None)


def session_entries(poses: DataFrame, gravity: DataFrame | None = None) -> DataFrame:
    """(scan_id, ``POSE``) of poses (scan_id, stamp, x, y, z, qx, qy, qz, qw); with gravity the heading of the levelled frame."""
    if gravity is not None:
        ids = lambda d: d.select("scan_id")
        assert_none(ids(poses).join(ids(gravity), "scan_id", "left_anti").unionByName(ids(gravity).join(ids(poses), "scan_id", "left_anti")), "poses and gravity differ in number")
        poses = poses.join(gravity.select("scan_id", "ux", "uy", "uz"), "scan_id")
    m = G.quaternion_matrix(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    roll, pitch, yaw = G.rpy(m)
    heading = yaw if gravity is None else G.canonical_yaw(m, G.level_rotation(F.col("ux"), F.col("uy"), F.col("uz")))
    return poses.select("scan_id", "stamp", "x", "y", "z", roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw"), heading.alias("canonical_yaw"))


def choose_split(points: DataFrame, cfg: DescriptorConfig) -> tuple[DescriptorConfig, dict]:
    """The configuration with the split that the points ask for, and what was found. One pass, at most a row a height bin on the driver."""
    found = {"adapted": False, "enabled": cfg.dual_layer, "split": cfg.split_height, "score": 0.0, "keyframes": 0, "support": 0}
    if not (cfg.dual_layer and cfg.split_auto):
        return cfg, found
    spark = points.sparkSession
    votes, scans = D.histogram_totals(points, cfg)
    found |= {"adapted": True, "keyframes": scans, "support": sum(votes)}
    bins = spark.createDataFrame(list(enumerate(votes)), "bin int, n bigint")
    best = D.adaptive_split(bins, found["keyframes"], cfg).first()
    if not best.enabled or not found["support"]:
        return cfg.with_(dual_layer=False), found | {"enabled": False}
    return cfg.with_(split_height=best.split), found | {"enabled": True, "split": best.split, "score": best.score}


def _keys(cells: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    return D.ring_keys(cells, cfg).withColumnRenamed("key", "ring_key").join(D.sector_keys(cells, cfg).withColumnRenamed("key", "sector_key"), "scan_id")


def _marked(cells: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """Cells with their column's count and their boundary mark, by windows inside a scan."""
    column, place = Window.partitionBy("scan_id", "layer", "sector"), Window.partitionBy("scan_id", "ring", "sector")
    near = cfg.boundary_margin + 1e-9
    low, up = (F.max(F.when(F.col("layer") == k, F.col("h"))).over(place) for k in (0, 1))
    edge = F.coalesce((cfg.split_height - low <= near) & (up - cfg.split_height <= near), F.lit(False))
    return cells.withColumn("n", F.count("*").over(column).cast("int")).withColumn("edge", edge)


def described(points: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """The cells of clouds as a map stores them, by one shuffle on the scan for all that follows."""
    cells = D.envelope_cells(points, cfg).select(F.col("scan_id").cast("long").alias("scan_id"), "layer", "ring", "sector", "h")
    return _marked(cells.repartition("scan_id"), cfg)


def summaries(cells: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, has_lower, has_upper, cells, ring_key, sector_key, columns) of scans that have cells."""
    n = F.map_from_entries(F.collect_set(F.struct((F.col("layer") * cfg.sectors + F.col("sector")).alias("at"), "n")))
    flags = cells.groupBy("scan_id").agg(F.bool_or(F.col("layer") == 0).alias("has_lower"), F.bool_or(F.col("layer") == 1).alias("has_upper"), F.count("*").alias("cells"), n.alias("n"))
    columns = F.transform(F.sequence(F.lit(0), F.lit(2 * cfg.sectors - 1)), lambda i: F.coalesce(F.element_at("n", i), F.lit(0)))
    return flags.join(_keys(cells, cfg), "scan_id").withColumn("columns", columns).drop("n")


def queries_of(points: DataFrame, cfg: DescriptorConfig) -> StoredMap:
    """Clouds as the query side of a retrieval, not written anywhere: poses are unknown, scans without points in range are left out."""
    cells = described(points.select("scan_id", "x", "y", "z"), cfg)
    e = summaries(cells, cfg).select("scan_id", *[F.lit(None).cast("double").alias(x) for x in POSE], "has_lower", "has_upper", "cells", "ring_key", "sector_key", "columns")
    return StoredMap(cfg, e, cells, None, {})


def _bucketed(df: DataFrame, path: str, buckets: int) -> None:
    """One sorted file a bucket."""
    name = f"placerec_{uuid.uuid4().hex}"
    df.repartition(buckets, "scan_id").write.bucketBy(buckets, "scan_id").sortBy("scan_id").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def _table(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    name = f"placerec_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (scan_id) SORTED BY (scan_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


CELLS = "scan_id bigint, layer int, ring int, sector int, h double, n int, edge boolean"
ENTRIES = "scan_id bigint, " + ", ".join(f"{c} double" for c in POSE) + ", has_lower boolean, has_upper boolean, cells bigint, ring_key array<double>, sector_key array<double>, columns array<int>"


def build(points: DataFrame, entries: DataFrame, path: str, cfg: DescriptorConfig, gravity: DataFrame | None = None, z_offset: float = 0.0, split: float | None = None, buckets: int | None = None) -> StoredMap:
    """Writes the map of a session to a new folder and opens it.

    ``entries`` are (scan_id, ``POSE``), one a scan; points of other scans are an error, and a scan without points in range is an
    entry without cells. With ``gravity`` the clouds are levelled; ``split`` fixes the height that is otherwise chosen.
    """
    spark = points.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if split is not None:
        cfg = cfg.with_(split_height=split, split_auto=False)
    cfg = cfg.with_(gravity_canonicalized=gravity is not None)
    p = points.select("scan_id", "x", "y", "z") if gravity is None else P.level(points.select("scan_id", "x", "y", "z"), gravity)
    p = P.shift_z(p, z_offset) if z_offset else p
    cfg, found = choose_split(p, cfg)
    return _stored(described(p, cfg), entries, path, cfg, found, buckets)


def _stored(cells: DataFrame, entries: DataFrame, path: str, cfg: DescriptorConfig, found: dict, buckets: int) -> StoredMap:
    """Writes cells, entries, index and, last, the configuration."""
    spark = cells.sparkSession
    _bucketed(cells, f"{path}/cells", buckets)
    of = summaries(_table(spark, f"{path}/cells", CELLS, buckets), cfg)
    e = entries.select(F.col("scan_id").cast("long").alias("scan_id"), *[F.col(x).cast("double").alias(x) for x in POSE]).join(of, "scan_id", "full")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    e = e.select(
        "scan_id", *POSE, F.coalesce("has_lower", F.lit(False)).alias("has_lower"), F.coalesce("has_upper", F.lit(False)).alias("has_upper"), F.coalesce("cells", F.lit(0)).alias("cells"),
        F.coalesce("ring_key", zeros(cfg.layers * cfg.rings)).alias("ring_key"), F.coalesce("sector_key", zeros(cfg.sectors)).alias("sector_key"),
        F.coalesce("columns", F.array_repeat(F.lit(0), 2 * cfg.sectors)).alias("columns"),
    )
    _bucketed(e, f"{path}/entries", buckets)
    stored = _table(spark, f"{path}/entries", ENTRIES, buckets)
    assert_none(stored.where("stamp is null"), "points of a scan without an entry, or an entry without a pose")
    X.index(stored.select("scan_id", "ring_key"), "scan_id", "ring_key", cfg.layers * cfg.rings, lambda name, df: saved(df, f"{path}/index-{name}"))
    about = json.dumps({"cfg": asdict(cfg), "split": found, "buckets": buckets})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    return open_map(spark, path)


def open_map(spark: SparkSession, path: str) -> StoredMap:
    """A map that :func:`build` has written, in this session or another."""
    about = json.loads(spark.read.text(f"{path}/config").first().value)
    cfg = DescriptorConfig(**about["cfg"])
    read = lambda name: spark.read.parquet(f"{path}/index-{name}")
    index = X.Index(read("indexed"), read("pivots"), read("annuli"), "ring_key", cfg.layers * cfg.rings)
    return StoredMap(cfg, _table(spark, f"{path}/entries", ENTRIES, about["buckets"]), _table(spark, f"{path}/cells", CELLS, about["buckets"]), index, about["split"])


def database_rows(m: StoredMap) -> tuple[DataFrame, dict]:
    """(scan_id, ``POSE``, h) and the parameters, as the data source ``descriptor_db`` writes them; h is row-major, null where nothing is valid."""
    c = m.cfg
    at = (F.col("layer") * c.rings + F.col("ring")) * c.sectors + F.col("sector")
    h = m.cells.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "h"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(c.layers * c.rings * c.sectors - 1)), lambda i: F.element_at("m", i))
    rows = m.entries.select("scan_id", *POSE).join(h, "scan_id", "left").select("scan_id", *POSE, F.when(F.col("m").isNull(), F.array_repeat(F.lit(None).cast("double"), c.layers * c.rings * c.sectors)).otherwise(dense).alias("h"))
    return rows, {"rings": c.rings, "sectors": c.sectors, "max_radius": c.max_radius, "dual_layer": c.dual_layer, "split_height": c.split_height, "origin_height": c.origin_height, "lower_weight": c.lower_weight, "upper_weight": c.upper_weight, "min_joint_rings": c.min_joint_rings, "gravity": c.gravity_canonicalized}


def from_database(rows: DataFrame, path: str, max_radius: float, cfg: DescriptorConfig | None = None, buckets: int | None = None) -> StoredMap:
    """A stored map of database entries (``descriptor_db``); scoring settings that a file does not hold are those of ``cfg``."""
    from placerec.sources import descriptor_db

    spark = rows.sparkSession
    shape = ("rings", "sectors", "dual_layer", "split_height", "origin_height", "lower_weight", "upper_weight", "min_joint_rings")
    kinds = rows.select(*shape, "gravity").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError("entries of one map have the same parameters")
    cfg = (cfg or DescriptorConfig()).with_(max_radius=max_radius, gravity_canonicalized=kinds[0].gravity, **{c: kinds[0][c] for c in shape})
    cells = descriptor_db.cells_of(rows).select(F.col("scan_id").cast("long").alias("scan_id"), "layer", "ring", "sector", "h").repartition("scan_id")
    found = {"adapted": False, "enabled": cfg.dual_layer, "split": cfg.split_height, "score": 0.0, "keyframes": 0, "support": 0}
    return _stored(_marked(cells, cfg), rows.select("scan_id", *POSE), path, cfg, found, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))


def shortlist(queries: StoredMap, base: StoredMap, k: int | None = None, exhaustive: bool = False) -> DataFrame:
    """(query_id, map_id, distance, rank): the k entries of the nearest ring keys, through the index of the whole map."""
    k = max(1, k or base.cfg.shortlist)
    q = queries.entries.select(F.col("scan_id").alias("query_id"), F.col("ring_key").alias("qk"))
    if exhaustive or base.index is None:
        m = base.entries.select(F.col("scan_id").alias("map_id"), F.col("ring_key").alias("mk"))
        return R.top_k(q, m, R.l2("qk", "mk"), k, "query_id", "map_id").select("query_id", "map_id", "distance", "rank")
    ix = replace(base.index, rows=base.index.rows.withColumnRenamed("scan_id", "map_id"))
    return X.nearest(q, ix, k, "query_id", "map_id", "qk")


def turns(queries: StoredMap, base: StoredMap, pairs: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """A row for each pair and turn near the coarse one, with both sides' supports and flags; a few rows a candidate, written once."""
    s = cfg.sectors
    support = lambda k: F.size(F.filter(F.slice("columns", k * s + 1, s), lambda n: n >= cfg.min_joint_rings))
    side = lambda e, key, tag, vec: e.select(F.col("scan_id").alias(key), F.col("sector_key").alias(vec), F.col("has_lower").alias(f"{tag}0"), F.col("has_upper").alias(f"{tag}1"), support(0).alias(f"s{tag}0"), support(1).alias(f"s{tag}1"))
    d = pairs.select("query_id", "map_id").join(side(queries.entries, "query_id", "q", "qs"), "query_id").join(side(base.entries, "map_id", "m", "ms"), "map_id")
    cost = lambda t: F.aggregate(F.sequence(F.lit(0), F.lit(s - 1)), F.lit(0.0), lambda a, c: a + F.pow(F.element_at("qs", (c + 1).cast("int")) - F.element_at("ms", (F.pmod(c - t, F.lit(s)) + 1).cast("int")), F.lit(2.0)))
    every = F.transform(F.sequence(F.lit(0), F.lit(s - 1)), lambda t: F.struct(F.round(cost(t), 9).alias("cost"), t.alias("shift")))
    return kept(R.turns_near(d.withColumn("coarse", F.array_min(every)["shift"]).drop("qs", "ms"), s, cfg.search_radius).drop("coarse"), "turns")


def scores(queries: StoredMap, base: StoredMap, turned: DataFrame, cfg: DescriptorConfig, omittable: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Adds ``distance`` to the rows of :func:`turns`: one join of stored cells, column counts with them, both layers at once."""
    key, off, s = ["query_id", "map_id", "shift"], cfg.height_offset, cfg.sectors
    m = base.cells.select(F.col("scan_id").alias("map_id"), "layer", "ring", F.col("sector").alias("own"), (F.col("h") + off).alias("b"), F.col("n").alias("nb"))
    q = queries.cells.select(F.col("scan_id").alias("query_id"), "layer", "ring", "sector", (F.col("h") + off).alias("a"), F.col("n").alias("na"))
    d = turned.select(*key).join(m, "map_id").withColumn("sector", F.pmod(F.col("own") + F.col("shift"), F.lit(s)).cast("int")).join(q, ["query_id", "layer", "ring", "sector"])
    a, b = F.col("a"), F.col("b")
    col = d.groupBy(*key, "layer", "sector").agg(F.count("*").alias("j"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    col = col.where((F.col("j") >= cfg.min_joint_rings) & (F.col("aa") > 1e-24) & (F.col("bb") > 1e-24))
    like = F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")) * F.col("j") / F.sqrt((F.col("na") * F.col("nb")).cast("double"))
    of = lambda k: F.when(F.col("layer") == k, like)
    wide = col.groupBy(*key).agg(*[x for k in (0, 1) for x in (F.sum(of(k)).alias(f"sim{k}"), F.count(of(k)).alias(f"eff{k}"))])
    dist = lambda k: F.when(F.col(f"eff{k}") > 0, 1 - F.col(f"sim{k}") / F.col(f"eff{k}") * F.pow(F.col(f"eff{k}") / F.sqrt((F.col(f"sq{k}") * F.col(f"sm{k}")).cast("double")), F.lit(cfg.support_exponent)))
    t = turned.join(wide, key, "left").withColumns({"d0": dist(0), "d1": dist(1)}).drop("sim0", "sim1", "eff0", "eff1", "sq0", "sq1", "sm0", "sm1")
    return R.combined(t, cfg, omittable, weights)


def retrieve(queries: StoredMap, base: StoredMap, cfg: DescriptorConfig | None = None, omittable: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """Ranked candidates (query_id, map_id, distance, shift, rank, yaw_shift) of two-stage retrieval on stored maps."""
    cfg = cfg or base.cfg
    best = R.best_turn(scores(queries, base, turns(queries, base, shortlist(queries, base, cfg.shortlist), cfg), cfg, omittable))
    best = best if threshold is None else best.where(F.col("distance") <= threshold)
    return R.rank(best).withColumn("yaw_shift", F.col("shift") * (G.TAU / cfg.sectors))


def retrieve_full(queries: StoredMap, base: StoredMap, cfg: DescriptorConfig | None = None, threshold: float | None = None) -> DataFrame:
    """Whole candidates: ``match.CANDIDATE_COLUMNS`` and ``yaw_matches``, an array of (distance, shift, vertical_shift), from stored maps.

    Jointly absent upper layers are left out where the map's surroundings show none; heights are estimated for every yaw match
    after the ranking and never change it. ``retrieval_ms`` is null: a distributed plan has no time of its own for a query.
    """
    cfg = cfg or base.cfg
    omittable = D.absent_upper_flags(base.entries.select("scan_id", "x", "y", "has_upper"), cfg) if cfg.dual_layer else None
    turned = turns(queries, base, shortlist(queries, base, cfg.shortlist), cfg)
    hyps = R.yaw_hypotheses(scores(queries, base, turned, cfg, omittable), cfg).select("query_id", "map_id", F.posexplode("hyps").alias("n", "h")).select("query_id", "map_id", "n", "h.distance", "h.shift")
    if cfg.dual_layer and cfg.vertical_estimation:
        hyps = kept(hyps, "hypotheses")
        hyps = hyps.join(V.vertical_shift(residuals(queries, base, hyps, cfg), cfg, hyps), ["query_id", "map_id", "shift"])
    else:
        hyps = hyps.withColumn("dz", F.lit(0.0))
    return R.candidates(hyps, queries.entries, base.entries, cfg, threshold)


def residuals(queries: StoredMap, base: StoredMap, hyps: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """As :func:`vertical.residuals`, from stored boundary marks."""
    inner = lambda m: m.cells.where("not edge").select("scan_id", "layer", "ring", "sector", "h")
    return V.joint_residuals(hyps, inner(queries), inner(base), cfg)
