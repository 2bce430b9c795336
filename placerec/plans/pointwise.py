"""Point and descriptor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from placerec import domain as M
from placerec.config import DescriptorConfig
from placerec.functions import geom as G
from placerec.operators import descriptor as D
from placerec.operators import points as P
from placerec.plans.register import registry, rounded

QUERIES, query = registry()

#: A small grid, so that SQL can check every cell.
CFG = DescriptorConfig(
    rings=8, sectors=12, max_radius=30.0, dual_layer=True, shortlist=5, search_ratio=0.1, height_offset=2.0, min_joint_rings=1, distance_threshold=1.0,
    histogram_max=6.0, split_min=1.0, split_max=4.0, min_keyframes=5, boundary_margin=0.2, vertical_min=-2.0, vertical_max=2.0,
)


def ords():
    return [F.col(f"ord.{c}").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]


_ORD = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"


def _u64(a: str, by: int) -> str:
    """a times a constant modulo 2^64, in SQL."""
    return f"((({a} * {by}::HUGEINT) % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT"


POINTS = f"""points AS (SELECT {_ORD}, l_suppkey AS scan_id, l_quantity - 25.3::DOUBLE AS x, l_extendedprice / 2000::DOUBLE - 26.03::DOUBLE AS y,
  l_discount * 40::DOUBLE + l_tax * 12.5::DOUBLE AS z FROM lineitem)"""
POLAR = f"""{POINTS}, polar AS (SELECT *, z AS h, least(greatest(ceil(sqrt(x*x + y*y) / 30::DOUBLE * 8) - 1, 0), 7)::INTEGER AS ring,
  least(greatest(ceil((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 12) - 1, 0), 11)::INTEGER AS sector
  FROM points WHERE sqrt(x*x + y*y) > 1e-6::DOUBLE AND sqrt(x*x + y*y) <= 30::DOUBLE)"""
CELLS = f"""{POLAR}, cells AS (SELECT scan_id, up::INTEGER AS layer, ring, sector, CASE WHEN up THEN min(h) ELSE max(h) END AS h
  FROM (SELECT scan_id, ring, sector, h, h > 2.5::DOUBLE AS up FROM polar) GROUP BY scan_id, up, ring, sector)"""


def cells(spark, d, cfg=CFG):
    return D.envelope_cells(M.points(spark, d), cfg)


def flat(p):
    """A point table with its order spelt out as columns."""
    return rounded(p.select("scan_id", *ords(), *[c for c in p.columns if c not in ("scan_id", "ord")]))


@query(f"WITH {POINTS} SELECT scan_id, {_ORD}, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points WHERE sqrt(x*x+y*y) BETWEEN 0.3::DOUBLE AND 30::DOUBLE")
def crop_annulus(spark, d):
    return flat(P.crop_annulus(M.points(spark, d)))


@query(f"WITH {POINTS} SELECT scan_id, count(*) AS n FROM points WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY scan_id")
def finite_filter(spark, d):
    return P.finite_points(M.points(spark, d)).groupBy("scan_id").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT scan_id, count(*) AS n FROM points WHERE NOT (sqrt(x*x+y*y) <= 6::DOUBLE AND z BETWEEN -0.5::DOUBLE AND 2::DOUBLE) GROUP BY scan_id")
def blind_box(spark, d):
    return P.drop_blind_box(M.points(spark, d), radius=6.0).groupBy("scan_id").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT scan_id, count(*) AS n FROM points WHERE sqrt(x*x+y*y) > 0.5::DOUBLE AND sqrt(x*x+y*y) < 25::DOUBLE AND z > 0.5::DOUBLE AND z < 2::DOUBLE GROUP BY scan_id")
def wall_slab(spark, d):
    return P.wall_slab(M.points(spark, d)).groupBy("scan_id").agg(F.count("*").alias("n"))


@query(f"WITH {POLAR} SELECT ring, sector, count(*) AS n, round(sum(h), 4) AS h FROM polar GROUP BY ring, sector")
def polar_bin(spark, d):
    return rounded(D.polar(M.points(spark, d), CFG).groupBy("ring", "sector").agg(F.count("*").alias("n"), F.sum("h").alias("h")), 4)


@query(f"WITH {POINTS} SELECT scan_id, round(avg(z + 0.35::DOUBLE), 6) AS z, round(max(z + 0.35::DOUBLE + 1.5::DOUBLE), 6) AS top FROM points GROUP BY scan_id")
def z_offset(spark, d):
    p = P.shift_z(M.points(spark, d), 0.35)
    return rounded(p.groupBy("scan_id").agg(F.avg("z").alias("z"), F.max(F.col("z") + 1.5).alias("top")))


@query(f"""WITH {POINTS}, {M.GRAVITY}, r AS (SELECT scan_id, {_ORD}, x, y, z, ux, uy, uz, 1::DOUBLE / (1::DOUBLE + uz) AS k FROM points JOIN gravity USING (scan_id))
SELECT scan_id, {_ORD}, round((1 - ux*ux*k)*x + (-ux*uy*k)*y - ux*z, 8) + 0.0::DOUBLE AS x, round((-ux*uy*k)*x + (1 - uy*uy*k)*y - uy*z, 8) + 0.0::DOUBLE AS y, round(ux*x + uy*y + uz*z, 8) + 0.0::DOUBLE AS z FROM r""")
def gravity_rotate(spark, d):
    p = P.level(M.points(spark, d), M.gravity(spark, d))
    return rounded(p.select("scan_id", *ords(), "x", "y", "z"), 8)


@query(f"""WITH {POINTS}, q AS (SELECT s_suppkey AS scan_id, sin((s_suppkey % 61) * 0.05::DOUBLE) AS qz, cos((s_suppkey % 61) * 0.05::DOUBLE) AS qw FROM supplier),
m AS (SELECT p.scan_id, (1 - 2*qz*qz)*x - 2*qz*qw*y AS wx, 2*qz*qw*x + (1 - 2*qz*qz)*y AS wy, z, atan2(2*qz*qw, 1 - 2*qz*qz) AS yaw FROM points p JOIN q USING (scan_id))
SELECT scan_id, round(sum(cos(yaw)*wx + sin(yaw)*wy), 4) AS x, round(sum(cos(yaw)*wy - sin(yaw)*wx), 4) AS y, round(sum(z), 4) AS z FROM m GROUP BY scan_id""")
def gravity_level_heading(spark, d):
    s = M.table(spark, d, "supplier").select(F.col("s_suppkey").alias("scan_id"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("s_suppkey") % 61 * 0.05).alias("qz"), F.cos(F.col("s_suppkey") % 61 * 0.05).alias("qw"))
    p = P.level_heading(M.points(spark, d), s)
    return rounded(p.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in "xyz"]), 4)


@query(f"""WITH {POINTS}, {M.POSES} SELECT p.scan_id, round(sum(cos(yaw)*p.x - sin(yaw)*p.y + q.x), 4) AS x, round(sum(sin(yaw)*p.x + cos(yaw)*p.y + q.y), 4) AS y, round(sum(p.z + q.z), 4) AS z
FROM points p JOIN poses q USING (scan_id) GROUP BY p.scan_id""")
def rigid_transform(spark, d):
    p = P.to_world(M.points(spark, d), M.poses(spark, d))
    return rounded(p.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in "xyz"]), 4)


@query(f"""WITH {POINTS}, {M.POSES}, w AS (SELECT p.scan_id, cos(yaw)*p.x - sin(yaw)*p.y + q.x - 10::DOUBLE AS dx, sin(yaw)*p.x + cos(yaw)*p.y + q.y - 5::DOUBLE AS dy FROM points p JOIN poses q USING (scan_id))
SELECT scan_id, round(sum(cos(0.5::DOUBLE)*dx + sin(0.5::DOUBLE)*dy), 4) AS x, round(sum(cos(0.5::DOUBLE)*dy - sin(0.5::DOUBLE)*dx), 4) AS y FROM w GROUP BY scan_id""")
def reference_frame(spark, d):
    w = P.to_world(M.points(spark, d), M.poses(spark, d))
    p = P.to_reference(w, F.lit(10.0), F.lit(5.0), F.lit(0.0), F.lit(0.5))
    return rounded(p.groupBy("scan_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y")), 4)


_LEVEL = """lv AS (SELECT *, (1 - ux*ux*k)*x + (-ux*uy*k)*y + (-ux)*z AS lx, (-ux*uy*k)*x + (1 - uy*uy*k)*y + (-uy)*z AS ly, ux*x + uy*y + uz*z AS lz FROM (SELECT *, 1::DOUBLE / (1::DOUBLE + uz) AS k FROM p0 JOIN gravity USING (scan_id)))"""


@query(f"""WITH {POINTS}, {M.GRAVITY}, p0 AS (SELECT scan_id, x - 1::DOUBLE AS x, y + 2::DOUBLE AS y, z - 0.5::DOUBLE AS z FROM points), {_LEVEL}
SELECT scan_id, round(sum(lx::FLOAT::DOUBLE), 3) AS x, round(sum(ly::FLOAT::DOUBLE), 3) AS y, round(sum(lz::FLOAT::DOUBLE), 3) AS z, count(*) AS n FROM lv GROUP BY 1""")
def level_about_origin(spark, d):
    """Levelled about another origin, in single precision."""
    p = P.level(M.points(spark, d), M.gravity(spark, d), (1.0, -2.0, 0.5), True)
    return rounded(p.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in "xyz"], F.count("*").alias("n")), 3)


@query(f"""WITH {POINTS}, {M.GRAVITY}, p0 AS (SELECT scan_id, x, y, z, sqrt(x*x + y*y) AS r FROM points), {_LEVEL},
ids AS (SELECT scan_id FROM (SELECT scan_id, row_number() OVER (ORDER BY scan_id) - 1 AS k, count(*) OVER () AS n FROM gravity) WHERE k % greatest(1, n // 40) = 0),
f AS (SELECT scan_id, quantile_cont(lz, 0.02) AS p2, count(*) AS n FROM lv JOIN ids USING (scan_id) WHERE r > 1 AND r < 20 GROUP BY 1 HAVING count(*) > 50) SELECT round(-median(p2), 6) AS origin_height, count(*) AS scans FROM f""")
def origin_height_levelled(spark, d):
    """The audit over some forty keyframes; farther and with fewer points than a lidar's."""
    return rounded(D.origin_height_audit(M.points(spark, d), M.gravity(spark, d), high=20.0, least=50))


@query(f"""WITH {POINTS}, n AS (SELECT scan_id, least(floor((x + 20::DOUBLE) / (40::DOUBLE / 11)), 10)::INTEGER AS px, least(floor((y + 15::DOUBLE) / (30::DOUBLE / 8)), 7)::INTEGER AS py, count(*) AS n FROM points WHERE x BETWEEN -20::DOUBLE AND 20::DOUBLE AND y BETWEEN -15::DOUBLE AND 15::DOUBLE GROUP BY 1, 2, 3),
t AS (SELECT scan_id, quantile_cont(ln(1 + n::DOUBLE), 0.98) AS top FROM n GROUP BY 1) SELECT scan_id, px, py, n, round(least(ln(1 + n::DOUBLE) / greatest(top, 1e-9::DOUBLE), 1) ** 0.48::DOUBLE, 6) AS level FROM n JOIN t USING (scan_id)""")
def density_image(spark, d):
    return rounded(D.density_image(M.points(spark, d), (-20.0, 20.0, -15.0, 15.0), (11, 8)))


@query(f"""WITH {POINTS}, t AS (SELECT scan_id, {_ORD}, (l_orderkey % 1000) * CASE scan_id % 5 WHEN 0 THEN 1e-4::DOUBLE WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 100::DOUBLE WHEN 3 THEN 100000::DOUBLE ELSE 0::DOUBLE END AS t FROM points),
s AS (SELECT *, t - min(t) OVER w AS since, count(*) OVER w AS n, row_number() OVER (PARTITION BY scan_id ORDER BY {_ORD}) - 1 AS k FROM t WINDOW w AS (PARTITION BY scan_id)),
u AS (SELECT *, max(since) OVER (PARTITION BY scan_id) AS span FROM s), v AS (SELECT *, CASE WHEN span <= 0.2 THEN 1e9::DOUBLE WHEN span <= 200 THEN 1e6::DOUBLE WHEN span <= 200000 THEN 1e3::DOUBLE ELSE 1::DOUBLE END AS unit FROM u)
SELECT scan_id, sum(CASE WHEN span * unit > 1 AND span * unit <= 200000000 THEN floor(since * unit) ELSE floor(k * coalesce(99999999::DOUBLE / nullif(n - 1, 0), 0)) END)::BIGINT AS total, count(*) AS n FROM v GROUP BY 1""")
def point_times(spark, d):
    """Point times in five units, one of them without any span."""
    k = F.col("scan_id") % 5
    unit = F.when(k == 0, 1e-4).when(k == 1, 0.1).when(k == 2, 100.0).when(k == 3, 100000.0).otherwise(0.0)
    p = M.points(spark, d).withColumn("t", F.col("ord.l_orderkey") % 1000 * unit)
    return P.point_times(p).groupBy("scan_id").agg(F.sum("t").alias("total"), F.count("*").alias("n"))


@query(f"""WITH {POINTS} SELECT scan_id, floor(x/2::DOUBLE)::BIGINT AS vx, floor(y/2::DOUBLE)::BIGINT AS vy, floor(z/2::DOUBLE)::BIGINT AS vz, round(avg(x), 9) + 0.0::DOUBLE AS x, round(avg(y), 9) + 0.0::DOUBLE AS y, round(avg(z), 9) AS z, count(*) AS n FROM points GROUP BY 1, 2, 3, 4""")
def voxel_centroid(spark, d):
    return rounded(P.voxel_centroids(M.points(spark, d), 2.0), 9)


@query(f"""WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, floor(x/2::DOUBLE), floor(y/2::DOUBLE), floor(z/2::DOUBLE) ORDER BY {_ORD}) AS r FROM points)
SELECT scan_id, {_ORD}, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r WHERE r = 1""")
def voxel_first(spark, d):
    return flat(P.voxel_first(M.points(spark, d), 2.0))


@query(f"""WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, round_even(x/3::DOUBLE, 0), round_even(y/3::DOUBLE, 0) ORDER BY {_ORD}) AS r FROM points)
SELECT scan_id, {_ORD}, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r WHERE r = 1""")
def voxel_dedup(spark, d):
    return flat(P.dedup_cells(M.points(spark, d), 3.0))


@query(f"""WITH {POINTS}, m AS (SELECT *, round_even(x * 1000, 0)::HUGEINT AS mx, round_even(y * 1000, 0)::HUGEINT AS my, round_even(z * 1000, 0)::HUGEINT AS mz FROM points),
k AS (SELECT *, xor(xor({_u64('mx', P.HASH_X)}, {_u64('my', P.HASH_Y)}), {_u64('mz', P.HASH_Z)}) AS key FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY key, {_ORD}) AS r FROM k)
SELECT scan_id, {_ORD}, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r WHERE r <= 64""")
def point_cap(spark, d):
    return flat(P.point_cap(M.points(spark, d), 64))


@query(f"""WITH {POINTS} SELECT scan_id, root_id::INTEGER AS root_id, round(avg(y - dy), 6) AS y, count(*) AS n FROM points, (VALUES (0, 0::DOUBLE), (1, -2::DOUBLE), (2, 2::DOUBLE)) t(root_id, dy) GROUP BY scan_id, root_id""")
def virtual_roots(spark, d):
    return rounded(P.virtual_roots(M.points(spark, d)).groupBy("scan_id", "root_id").agg(F.avg("y").alias("y"), F.count("*").alias("n")))


@query(f"""WITH {POINTS} SELECT scan_id, count(*) AS n, round(avg(x / 70::DOUBLE), 6) AS x, round(avg((z - 1::DOUBLE) / 19::DOUBLE), 6) AS z FROM points WHERE abs(x) < 70 AND abs(y) < 70 AND z > 1 AND z < 20 GROUP BY scan_id""")
def ringpp_normalise(spark, d):
    return rounded(P.ringpp_normalise(M.points(spark, d)).groupBy("scan_id").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("z").alias("z")))


@query(f"""WITH {POINTS}, c AS (SELECT scan_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM points WINDOW w AS (PARTITION BY scan_id)),
s AS (SELECT scan_id, -0.5::DOUBLE / avg(sqrt(x*x+y*y+z*z)) OVER (PARTITION BY scan_id) AS s, x, y, z FROM c)
SELECT scan_id, count(*) AS n, round(avg(x*s), 6) + 0.0::DOUBLE AS x, round(avg(abs(z*s)), 6) AS z FROM s WHERE abs(x*s) <= 1 AND abs(y*s) <= 1 AND abs(z*s) <= 1 GROUP BY scan_id""")
def pointnet_norm(spark, d):
    p = P.centred_unit(M.points(spark, d))
    return rounded(p.groupBy("scan_id").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg(F.abs("z")).alias("z")))


def _range_sql(rows: int, cols: int) -> str:
    return f"""WITH {POINTS}, r AS (SELECT *, sqrt(x*x+y*y+z*z) AS d FROM points), i AS (SELECT scan_id, least(greatest(floor((1 - (degrees(asin(z/d)) + 25::DOUBLE) / 28::DOUBLE) * {rows}), 0), {rows - 1})::INTEGER AS row,
least(greatest(floor((1 - atan2(y, x) / pi()) * 0.5::DOUBLE * {cols}), 0), {cols - 1})::INTEGER AS col, d FROM r WHERE d > 0 AND d < 80)
SELECT scan_id, row, col, round(min(d), 6) AS range, least(greatest(round_even(min(d) / 80::DOUBLE * 255, 0), 0), 255)::INTEGER AS level FROM i GROUP BY 1, 2, 3"""


@query(_range_sql(64, 900))
def range_quantise_full(spark, d):
    """The size of a lidar's own image."""
    return rounded(P.range_image(M.points(spark, d)))


@query(_range_sql(16, 90))
def range_quantise(spark, d):
    return rounded(P.range_image(M.points(spark, d), rows=16, cols=90))


@query(f"""WITH {POINTS} SELECT scan_id, round(sum(-sin(0.6::DOUBLE)*x + cos(0.6::DOUBLE)*y), 4) AS u, round(max(-sin(0.4::DOUBLE)*cos(0.6::DOUBLE)*x - sin(0.4::DOUBLE)*sin(0.6::DOUBLE)*y + cos(0.4::DOUBLE)*z), 6) AS v,
round(min(cos(0.4::DOUBLE)*cos(0.6::DOUBLE)*x + cos(0.4::DOUBLE)*sin(0.6::DOUBLE)*y + sin(0.4::DOUBLE)*z), 6) AS depth FROM points GROUP BY scan_id""")
def ortho_project(spark, d):
    p = P.orthographic(M.points(spark, d), 0.6, 0.4)
    return rounded(p.groupBy("scan_id").agg(F.sum("u").alias("u"), F.max("v").alias("v"), F.min("depth").alias("depth")), u=4)


@query(f"""WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {_ORD}) - 1 AS r FROM points) SELECT scan_id, {_ORD}, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r WHERE r % 10 = 0""")
def stride_sample(spark, d):
    return flat(P.stride(M.points(spark, d), 10))


@query(f"""WITH {POINTS}, q AS (SELECT scan_id, quantile_cont(x, 0.02) AS x0, quantile_cont(x, 0.98) AS x1, quantile_cont(y, 0.02) AS y0, quantile_cont(y, 0.98) AS y1 FROM points GROUP BY scan_id)
SELECT scan_id, count(*) AS n FROM points JOIN q USING (scan_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY scan_id""")
def percentile_crop(spark, d):
    return P.percentile_crop(M.points(spark, d), 0.02, 0.98).groupBy("scan_id").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS} SELECT scan_id, layer, ring, sector, round(h, 6) AS h FROM cells")
def envelope_cells(spark, d):
    return rounded(cells(spark, d))


@query(f"""WITH {POINTS}, v AS (SELECT scan_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points WHERE sqrt(x*x+y*y) BETWEEN 0.3::DOUBLE AND 30::DOUBLE GROUP BY scan_id, floor(x/0.25::DOUBLE), floor(y/0.25::DOUBLE), floor(z/0.25::DOUBLE)),
p AS (SELECT *, least(greatest(ceil(sqrt(x*x + y*y) / 30::DOUBLE * 8) - 1, 0), 7)::INTEGER AS ring, least(greatest(ceil((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 12) - 1, 0), 11)::INTEGER AS sector FROM v WHERE sqrt(x*x+y*y) <= 30::DOUBLE)
SELECT scan_id, ring, sector, round(max(z + 2::DOUBLE), 6) AS h FROM p GROUP BY 1, 2, 3""")
def sc_max(spark, d):
    return rounded(D.sc_max(M.points(spark, d), CFG))


@query(f"""WITH {POINTS}, v AS (SELECT scan_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points WHERE sqrt(x*x+y*y) BETWEEN 0.3::DOUBLE AND 30::DOUBLE GROUP BY scan_id, floor(x/0.5::DOUBLE), floor(y/0.5::DOUBLE), floor(z/0.5::DOUBLE)),
r AS (SELECT scan_id, root_id::INTEGER AS root_id, x, y - dy AS y, z FROM v, (VALUES (0, 0::DOUBLE), (1, -2::DOUBLE), (2, 2::DOUBLE)) t(root_id, dy)),
p AS (SELECT *, least(greatest(floor(sqrt(x*x + y*y) / 3.75::DOUBLE), 0), 7)::INTEGER AS ring, least(greatest(ceil((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi()) * 12) - 1, 0), 11)::INTEGER AS sector FROM r)
SELECT scan_id, root_id, ring, sector, round(max(z), 6) AS h FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5""")
def scpp_polar(spark, d):
    return rounded(D.scpp_cells(M.points(spark, d), CFG, least=5))


@query(f"""WITH {POINTS}, v AS (SELECT scan_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points WHERE sqrt(x*x+y*y) BETWEEN 0.3::DOUBLE AND 30::DOUBLE GROUP BY scan_id, floor(x), floor(y), floor(z)),
b AS (SELECT scan_id, least(greatest(floor(sqrt(x*x+y*y) / 3.75::DOUBLE), 0), 7)::INTEGER AS ring, least(greatest(floor((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / (2 * pi() / 12)), 0), 11)::INTEGER AS sector,
least(greatest(floor((degrees(atan2(z, sqrt(x*x+y*y))) + 90::DOUBLE) / 22.5::DOUBLE), 0), 7)::INTEGER AS e FROM v),
t AS (SELECT g.scan_id, g.e, coalesce(t, 0) AS t FROM (SELECT DISTINCT scan_id, e::INTEGER AS e FROM b, range(8) r(e) WHERE true) g0 RIGHT JOIN (SELECT s.scan_id, r.e::INTEGER AS e FROM (SELECT DISTINCT scan_id FROM b) s, range(8) r(e)) g ON false LEFT JOIN (SELECT scan_id, e, count(*) AS t FROM b GROUP BY 1, 2) c ON c.scan_id = g.scan_id AND c.e = g.e),
w AS (SELECT scan_id, e, coalesce((t - min(t) OVER p) / nullif((max(t) OVER p - min(t) OVER p)::DOUBLE, 0), 0) AS w FROM t WINDOW p AS (PARTITION BY scan_id))
SELECT b.scan_id, 'range' AS kind, ring AS idx, round(sum(w), 6) AS value FROM b JOIN w USING (scan_id, e) GROUP BY 1, 3 UNION ALL SELECT b.scan_id, 'angle', sector, round(sum(w), 6) FROM b JOIN w USING (scan_id, e) GROUP BY 1, 3""".replace("(SELECT DISTINCT scan_id, e::INTEGER AS e FROM b, range(8) r(e) WHERE true) g0 RIGHT JOIN ", "").replace(" g ON false LEFT JOIN", " g LEFT JOIN"))
def solid_vec(spark, d):
    return rounded(D.solid(M.points(spark, d)))


RING_KEY = f"""{CELLS}, ring_key AS (SELECT scan_id, layer * 8 + ring AS row, sum(h + 2::DOUBLE) / 12 AS v FROM cells GROUP BY 1, 2)"""
SECTOR_KEY = """sector_key AS (SELECT scan_id, sector, sum(h + 2::DOUBLE) / 16 AS v FROM cells GROUP BY 1, 2)"""


@query(f"WITH {RING_KEY}, g AS (SELECT s.scan_id, r.row FROM (SELECT DISTINCT scan_id FROM cells) s, range(16) r(row)) SELECT scan_id, row::INTEGER AS row, round(coalesce(v, 0), 9) AS v FROM g LEFT JOIN ring_key USING (scan_id, row)")
def ring_key(spark, d):
    return rounded(D.ring_keys(cells(spark, d), CFG).select("scan_id", F.posexplode("key").alias("row", "v")), 9)


@query(f"WITH {CELLS}, {SECTOR_KEY}, g AS (SELECT s.scan_id, r.sector FROM (SELECT DISTINCT scan_id FROM cells) s, range(12) r(sector)) SELECT scan_id, sector::INTEGER AS sector, round(coalesce(v, 0), 9) AS v FROM g LEFT JOIN sector_key USING (scan_id, sector)")
def sector_key(spark, d):
    return rounded(D.sector_keys(cells(spark, d), CFG).select("scan_id", F.posexplode("key").alias("sector", "v")), 9)


BOUNDARY = """boundary AS (SELECT l.scan_id, l.ring, l.sector FROM cells l JOIN cells u ON l.scan_id = u.scan_id AND l.ring = u.ring AND l.sector = u.sector AND l.layer = 0 AND u.layer = 1
  WHERE 2.5::DOUBLE - l.h <= 0.2::DOUBLE + 1e-9::DOUBLE AND u.h - 2.5::DOUBLE <= 0.2::DOUBLE + 1e-9::DOUBLE)"""


@query(f"WITH {CELLS}, {BOUNDARY} SELECT * FROM boundary")
def boundary_mask(spark, d):
    return D.boundary_mask(cells(spark, d), CFG)


@query(f"WITH {CELLS} SELECT scan_id, bool_or(layer = 0) AS has_lower, bool_or(layer = 1) AS has_upper, count(*) AS cells FROM cells GROUP BY scan_id")
def observation_flags(spark, d):
    return D.observation_flags(cells(spark, d))


@query(f"WITH {CELLS}, b AS (SELECT scan_id, (layer * 8 + ring) * 12 + sector AS bit FROM cells) SELECT scan_id, (bit // 8)::INTEGER AS byte_idx, sum(1 << (bit % 8)::INTEGER)::INTEGER AS byte FROM b GROUP BY 1, 2")
def mask_bits(spark, d):
    return D.mask_bytes(cells(spark, d), CFG)


HIST = f"""{POLAR}, hist AS (SELECT bin, count(*) AS n FROM (SELECT DISTINCT scan_id, ring, sector, least(floor(h / 0.1::DOUBLE), 59)::INTEGER AS bin FROM polar WHERE h >= 0 AND h < 6) GROUP BY bin)"""


@query(f"WITH {HIST} SELECT * FROM hist")
def height_histogram(spark, d):
    return D.height_histogram(M.points(spark, d), CFG)


@query(f"""WITH {HIST}, g AS (SELECT r.bin, coalesce(n, 0)::DOUBLE AS n, (r.bin + 0.5::DOUBLE) * 0.1::DOUBLE AS mid FROM range(60) r(bin) LEFT JOIN hist USING (bin)),
c AS (SELECT (bin + 1) * 0.1::DOUBLE AS thr, sum(n) OVER w AS n0, sum(n * mid) OVER w AS s0, sum(n) OVER () AS t, sum(n * mid) OVER () AS s FROM g WINDOW w AS (ORDER BY bin)),
o AS (SELECT thr, n0 / t AS f, (n0 / t) * (1 - n0 / t) * (s0 / n0 - (s - s0) / nullif(t - n0, 0)) ** 2 AS score FROM c WHERE n0 > 0),
k AS (SELECT *, max(score) OVER () AS best FROM o WHERE thr BETWEEN 1::DOUBLE - 1e-9::DOUBLE AND 4::DOUBLE + 1e-9::DOUBLE AND f >= 0.05::DOUBLE AND 1 - f >= 0.05::DOUBLE)
SELECT (min(thr) IS NOT NULL AND (SELECT count(DISTINCT scan_id) FROM polar) >= 5) AS enabled, round((min(thr) + max(thr)) / 2, 6) AS split, round(max(score), 6) AS score FROM k WHERE abs(score - best) <= 1e-12::DOUBLE * greatest(1, abs(best))""")
def adaptive_split(spark, d):
    p = M.points(spark, d)
    keyframes = D.polar(p, CFG).agg(F.count_distinct("scan_id").alias("n")).first()["n"]
    return rounded(D.adaptive_split(D.height_histogram(p, CFG), keyframes, CFG))


@query(f"""WITH {M.POSES}, e AS (SELECT scan_id, x, y, scan_id % 29 = 0 AS has_upper FROM poses)
SELECT a.scan_id, count(*) >= 3 AND avg((b.has_upper)::INTEGER) <= 0.03::DOUBLE AS omittable FROM e a JOIN e b ON (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 100 GROUP BY a.scan_id""")
def absent_upper_flags(spark, d):
    e = M.poses(spark, d).withColumn("has_upper", F.col("scan_id") % 29 == 0)
    return D.absent_upper_flags(e, CFG.with_(absent_upper_fraction=0.03))


@query(f"""WITH {POLAR}, c AS (SELECT scan_id, ring, sector, min(h) AS lo, max(h) AS up FROM polar GROUP BY 1, 2, 3)
SELECT scan_id, count(*) FILTER (lo <= 2.5::DOUBLE AND up > 2.5::DOUBLE) AS hidden, count(*) AS occupied, count(*) FILTER (up > 2.5::DOUBLE) AS overhead, count(*) FILTER (up >= 4) AS over_range,
count(*) FILTER (lo <= 2.5::DOUBLE) AS lower, count(*) FILTER (up > 2.5::DOUBLE) AS upper,
round(count(*) FILTER (lo <= 2.5::DOUBLE AND up > 2.5::DOUBLE) / count(*), 6) AS hidden_fraction, round(count(*) FILTER (up > 2.5::DOUBLE) / count(*), 6) AS overhead_fraction FROM c GROUP BY scan_id""")
def roof_stats(spark, d):
    return rounded(D.roof_stats(M.points(spark, d), CFG))


@query(f"""WITH {POINTS}, n AS (SELECT scan_id, floor((z + 0.003::DOUBLE - (2.1::DOUBLE + 0.2::DOUBLE)) / 0.02::DOUBLE) AS bin, count(*) AS n FROM points WHERE z + 0.003::DOUBLE BETWEEN 2.1::DOUBLE + 0.2::DOUBLE AND 4.5::DOUBLE GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, bin) AS r FROM n)
SELECT scan_id, round(2.3::DOUBLE + (bin + 0.5::DOUBLE) * 0.02::DOUBLE, 6) AS ceiling, round(2.3::DOUBLE + (bin + 0.5::DOUBLE) * 0.02::DOUBLE + 0.12::DOUBLE, 6) AS cut FROM r WHERE r = 1""")
def dominant_ceiling(spark, d):
    return rounded(D.dominant_ceiling(P.shift_z(M.points(spark, d), 0.003)))


@query(f"""WITH {POINTS}, n AS (SELECT scan_id, floor(x / 2::DOUBLE)::BIGINT AS gx, floor(y / 2::DOUBLE)::BIGINT AS gy, count(*) AS n FROM points GROUP BY 1, 2, 3), t AS (SELECT scan_id, quantile_cont(ln(1 + n::DOUBLE), 0.98) AS top FROM n GROUP BY 1)
SELECT scan_id, gx, gy, n, round(least(ln(1 + n::DOUBLE) / top, 1::DOUBLE) ** 0.48::DOUBLE, 5) AS level FROM n JOIN t USING (scan_id)""")
def density_grid(spark, d):
    return rounded(D.density_grid(M.points(spark, d)), 5)


@query(f"WITH {CELLS} SELECT scan_id, layer, ring, ((sector + 5) % 12)::INTEGER AS sector, round(h, 6) AS h FROM cells")
def cell_roll(spark, d):
    return rounded(D.roll(cells(spark, d), 5, 12))


@query(f"""WITH {CELLS}, n AS (SELECT scan_id, sector, count(*) AS n FROM cells GROUP BY 1, 2), w AS (SELECT scan_id, s.start::INTEGER AS start, sum(n)::BIGINT AS total FROM n, range(12) s(start) WHERE (sector - s.start + 12) % 12 < 3 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY total DESC, start) AS r FROM w) SELECT scan_id, start, total FROM r WHERE r = 1""")
def circular_window(spark, d):
    n = cells(spark, d).groupBy("scan_id", "sector").agg(F.count("*").alias("n"))
    return D.best_window(D.circular_windows(n, 12, 3))


_APART = "least((start - {0} + 12) % 12, ({0} - start + 12) % 12) >= 3"


@query(f"""WITH {POLAR}, ctx AS (SELECT scan_id, ring, sector, max(h) AS top, max(h) FILTER (h <= 2.5::DOUBLE) AS low, min(h) FILTER (h > 2.5::DOUBLE) AS up FROM polar GROUP BY 1, 2, 3),
w AS (SELECT scan_id, s.start::INTEGER AS start, count(*) FILTER (low IS NOT NULL AND up IS NOT NULL) AS mixed, count(*) FILTER (top > 2.5 AND top - up > 0.3::DOUBLE) AS gaps, median(top - up) FILTER (top > 2.5 AND top - up > 0.3::DOUBLE) AS gap_median,
  count(low) AS lows, stddev_pop(low) AS low_std, count(*) FILTER (top > 2.5) AS tops, stddev_pop(top) FILTER (top > 2.5) AS top_std FROM ctx, range(12) s(start) WHERE (sector - s.start + 12) % 12 < 3 GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN lows >= 5 AND tops >= 5 THEN low_std / (top_std + 1e-6::DOUBLE) END AS ratio FROM w),
m AS (SELECT scan_id, start AS m0, mixed FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY mixed DESC, start) AS r FROM x) WHERE r = 1),
g AS (SELECT scan_id, start AS g0, gaps, gap_median FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY gaps DESC, start) AS r FROM x JOIN m USING (scan_id) WHERE {_APART.format('m0')} AND gaps > 0) WHERE r = 1),
r AS (SELECT scan_id, start AS r0, ratio, low_std, top_std FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ratio DESC, start) AS r FROM x JOIN m USING (scan_id) LEFT JOIN g USING (scan_id) WHERE {_APART.format('m0')} AND (g0 IS NULL OR {_APART.format('g0')}) AND ratio > 0) WHERE r = 1)
SELECT scan_id, m0 AS mixed_start, m.mixed AS mixed_cells, coalesce(g0, -1) AS gap_start, coalesce(g.gaps, 0) AS gap_cells, round(coalesce(g.gap_median, 0), 6) AS gap_median,
  coalesce(r0, -1) AS ratio_start, round(coalesce(r.ratio, 0), 6) AS ratio, round(coalesce(r.low_std, 0), 6) AS low_std, round(coalesce(r.top_std, 0), 6) AS top_std FROM m LEFT JOIN g USING (scan_id) LEFT JOIN r USING (scan_id)""")
def disjoint_window(spark, d):
    """Three windows a scan, chosen in turn."""
    return rounded(D.detail_windows(D.context_cells(M.points(spark, d), CFG), CFG, 3, 5))


@query("""SELECT ring::INTEGER AS ring, sector::INTEGER AS sector, round(ring * 3.75::DOUBLE, 6) AS r_inner, round((ring + 1) * 3.75::DOUBLE, 6) AS r_outer, round(sector * 30::DOUBLE, 6) AS theta_start, round((sector + 1) * 30::DOUBLE, 6) AS theta_end FROM range(8) r(ring), range(12) s(sector)""")
def cell_geometry(spark, d):
    g = spark.range(8 * 12).select(F.floor(F.col("id") / 12).cast("int").alias("ring"), (F.col("id") % 12).cast("int").alias("sector"))
    return rounded(g.select("ring", "sector", (F.col("ring") * 3.75).alias("r_inner"), ((F.col("ring") + 1) * 3.75).alias("r_outer"), (F.col("sector") * 30.0).alias("theta_start"), ((F.col("sector") + 1) * 30.0).alias("theta_end")))


@query(f"""WITH {M.POSES}, q AS (SELECT scan_id, sin(yaw/2) AS qz, cos(yaw/2) AS qw FROM poses) SELECT scan_id, round(atan2(2*qz*qw, 1 - 2*qz*qz), 6) + 0.0::DOUBLE AS yaw, 0.0::DOUBLE AS roll, 0.0::DOUBLE AS pitch FROM q""")
def quat_rpy(spark, d):
    p = M.poses(spark, d)
    m = G.quaternion_matrix(F.lit(0.0), F.lit(0.0), F.sin(F.col("yaw") / 2), F.cos(F.col("yaw") / 2))
    r, pitch, yaw = G.rpy(m)
    return rounded(p.select("scan_id", r.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw")))


@query(f"""WITH {M.POSES}, a AS (SELECT scan_id, yaw * 3 - 1.3::DOUBLE AS a FROM poses), r AS (SELECT scan_id, a - 2*pi() * round_even(a / (2*pi()), 0) AS r FROM a)
SELECT scan_id, round(CASE WHEN r <= -pi() THEN r + 2*pi() WHEN r > pi() THEN r - 2*pi() ELSE r END, 6) + 0.0::DOUBLE AS yaw FROM r""")
def yaw_wrap(spark, d):
    return rounded(M.poses(spark, d).select("scan_id", G.seed_yaw(F.col("yaw") * 3, F.lit(1.3)).alias("yaw")))


@query(f"""WITH {POINTS}, f AS (SELECT scan_id, quantile_cont(z, 0.02) AS p2, count(*) AS n FROM points WHERE sqrt(x*x+y*y) > 1 AND sqrt(x*x+y*y) < 20 GROUP BY scan_id) SELECT round(-median(p2), 6) + 0.0::DOUBLE AS origin_height, count(*) AS scans FROM f WHERE n > 200""")
def origin_height(spark, d):
    # the scans of these tables are thin: a wider ring than the default
    return rounded(D.origin_height(M.points(spark, d), high=20.0))
