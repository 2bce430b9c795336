"""Stored maps of the driver's tables, written once a session and read by the retrieval queries; the build as a query of its own."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from placerec import domain as M
from placerec.config import DescriptorConfig
from placerec.folders import shared_dir
from placerec.functions import geom as G
from placerec.operators import points as P
from placerec.operators import stored as S
from placerec.plans.pointwise import CFG
from placerec.plans.register import registry, rounded
from placerec.plans.trajectories import _QUAT, orientations

QUERIES, query = registry()

_BUILT: dict[tuple, S.StoredMap] = {}


def _files(spark: SparkSession, d: str) -> tuple:
    """Path, size and time of the files that a map is made of."""
    out = []
    for name in ("lineitem", "supplier", "embeddings"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)]
    return tuple(sorted(out))


def built(spark: SparkSession, d: str, name: str, make) -> S.StoredMap:
    """The map of this name over these files: the first query of a session that needs it writes it, later ones read it."""
    key = (spark.sparkContext.applicationId, name, d, _files(spark, d))
    if key not in _BUILT:
        _BUILT[key] = make(shared_dir(spark, "map"))
    return _BUILT[key]


def session_map(spark: SparkSession, d: str, cfg: DescriptorConfig = CFG, name: str = "all", scans: str = "true", points=None, entries=None) -> S.StoredMap:
    """The scans of a condition on ``scan_id`` as a map, their poses as they come."""
    p = (M.points(spark, d) if points is None else points).where(scans)
    e = entries if entries is not None else M.poses(spark, d).select("scan_id", "stamp", "x", "y", "z", F.lit(0.0).alias("roll"), F.lit(0.0).alias("pitch"), "yaw", F.col("yaw").alias("canonical_yaw"))
    return built(spark, d, f"{name} {cfg}", lambda at: S.build(p, e.where(scans), at, cfg))


BUILD = CFG.with_(split_auto=True)
BUILD_SQL = f"""WITH {_QUAT}, {M.GRAVITY}, {M.POINTS},
lv AS (SELECT scan_id, (1 - ux*ux*k)*x + (-ux*uy*k)*y + (-ux)*z AS x, (-ux*uy*k)*x + (1 - uy*uy*k)*y + (-uy)*z AS y, ux*x + uy*y + uz*z + 0.35::DOUBLE AS z FROM (SELECT *, 1::DOUBLE / (1::DOUBLE + uz) AS k FROM points JOIN gravity USING (scan_id))),
polar AS (SELECT scan_id, z AS h, least(greatest(ceil(sqrt(x*x + y*y) / 30::DOUBLE * 8) - 1, 0), 7)::INTEGER AS ring,
  least(greatest(ceil((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 12) - 1, 0), 11)::INTEGER AS sector FROM lv WHERE sqrt(x*x + y*y) > 1e-6::DOUBLE AND sqrt(x*x + y*y) <= 30::DOUBLE),
votes AS (SELECT DISTINCT scan_id, ring, sector, least(floor(h / 0.1::DOUBLE), 59)::INTEGER AS bin FROM polar WHERE h >= 0 AND h < 6),
g AS (SELECT r.bin, coalesce(n, 0)::DOUBLE AS n, (r.bin + 0.5::DOUBLE) * 0.1::DOUBLE AS mid FROM range(60) r(bin) LEFT JOIN (SELECT bin, count(*) AS n FROM votes GROUP BY 1) USING (bin)),
c AS (SELECT (bin + 1) * 0.1::DOUBLE AS thr, sum(n) OVER w AS n0, sum(n * mid) OVER w AS s0, sum(n) OVER () AS t, sum(n * mid) OVER () AS s FROM g WINDOW w AS (ORDER BY bin)),
o AS (SELECT thr, n0 / t AS f, (n0 / t) * (1 - n0 / t) * (s0 / n0 - (s - s0) / nullif(t - n0, 0)) ** 2 AS score FROM c WHERE n0 > 0),
best AS (SELECT *, max(score) OVER () AS best FROM o WHERE thr BETWEEN 1::DOUBLE - 1e-9::DOUBLE AND 4::DOUBLE + 1e-9::DOUBLE AND f >= 0.05::DOUBLE AND 1 - f >= 0.05::DOUBLE),
sp AS (SELECT (min(thr) IS NOT NULL AND (SELECT count(DISTINCT scan_id) FROM votes) >= 5) AS dual, (min(thr) + max(thr)) / 2 AS split FROM best WHERE abs(score - best) <= 1e-12::DOUBLE * greatest(1, abs(best))),
cells AS (SELECT scan_id, up::INTEGER AS layer, ring, sector, CASE WHEN up THEN min(h) ELSE max(h) END AS h FROM (SELECT polar.*, dual AND h > split AS up FROM polar, sp) GROUP BY scan_id, up, ring, sector),
cn AS (SELECT *, count(*) OVER (PARTITION BY scan_id, layer, sector) AS n, max(h) FILTER (layer = 0) OVER (PARTITION BY scan_id, ring, sector) AS low, max(h) FILTER (layer = 1) OVER (PARTITION BY scan_id, ring, sector) AS up FROM cells),
k AS (SELECT scan_id, bool_or(layer = 0) AS has_lower, bool_or(layer = 1) AS has_upper, count(*) AS cells, count(*) FILTER (coalesce(split - low <= 0.2::DOUBLE + 1e-9::DOUBLE AND up - split <= 0.2::DOUBLE + 1e-9::DOUBLE, false)) AS edges,
  sum((h + 2::DOUBLE) / 12 * (layer * 8 + ring + 1)) AS ring_sum, sum((h + 2::DOUBLE) / CASE WHEN dual THEN 16 ELSE 8 END * (sector + 1)) AS sector_sum, sum(layer * 12 + sector + 1)::BIGINT AS column_sum FROM cn, sp GROUP BY 1),
cy AS (SELECT scan_id, cos(yaw)*cos(pitch) AS r00, cos(yaw)*sin(pitch)*sin(roll) - sin(yaw)*cos(roll) AS r01, cos(yaw)*sin(pitch)*cos(roll) + sin(yaw)*sin(roll) AS r02,
  sin(yaw)*cos(pitch) AS r10, sin(yaw)*sin(pitch)*sin(roll) + cos(yaw)*cos(roll) AS r11, sin(yaw)*sin(pitch)*cos(roll) - cos(yaw)*sin(roll) AS r12 FROM q)
SELECT scan_id, dual, round(split, 6) AS split, round(x, 6) AS x, round(y, 6) AS y, round(atan2(r10 * (1 - ux*ux/(1 + uz)) - r11 * ux*uy/(1 + uz) - r12 * ux, r00 * (1 - ux*ux/(1 + uz)) - r01 * ux*uy/(1 + uz) - r02 * ux), 6) + 0.0::DOUBLE AS canonical_yaw,
  coalesce(has_lower, false) AS has_lower, coalesce(has_upper, false) AS has_upper, coalesce(cells, 0) AS cells, coalesce(edges, 0) AS edges, round(coalesce(ring_sum, 0), 6) AS ring_sum, round(coalesce(sector_sum, 0), 6) AS sector_sum, coalesce(column_sum, 0) AS column_sum
FROM poses JOIN cy USING (scan_id) JOIN gravity USING (scan_id) LEFT JOIN k USING (scan_id), sp"""


def weighted(c) -> Column:
    """Sum of an array's values times their places from 1.

    Sums of unlevelled scans end in a half at the seventh place: what rounding left of their sums is taken off, so that a half always goes up.
    """
    return F.round(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 12)


@query(BUILD_SQL)
def map_build(spark, d):
    """A session in gravity mode from clouds, poses and gravity to a stored map, opened again: a row an entry."""
    g = M.gravity(spark, d)
    m = S.build(M.points(spark, d), S.session_entries(orientations(spark, d), g), shared_dir(spark, "map"), BUILD, g, z_offset=0.35)
    edges = m.cells.groupBy("scan_id").agg(F.count_if("edge").alias("edges"))
    e = m.entries.join(edges, "scan_id", "left")
    return rounded(e.select(
        "scan_id", F.lit(m.cfg.dual_layer).alias("dual"), F.lit(m.cfg.split_height).alias("split"), "x", "y", "canonical_yaw", "has_lower", "has_upper", "cells", F.coalesce("edges", F.lit(0)).alias("edges"),
        weighted("ring_key").alias("ring_sum"), weighted("sector_key").alias("sector_sum"), weighted(F.transform("columns", lambda n: n.cast("double"))).cast("long").alias("column_sum"),
    ))
