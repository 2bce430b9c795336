"""Trajectory queries over events (tracks), suppliers (poses) and customers (fixes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placerec import domain as M
from placerec.functions import geom as G
from placerec.operators import descriptor as D
from placerec.operators import evaluate as E
from placerec.operators import points as P
from placerec.operators import trajectory as T
from placerec.plans.register import registry, rounded

QUERIES, query = registry()


@query(f"""WITH RECURSIVE {M.TRACK}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY stamp, event_id) AS k FROM track),
f AS (SELECT track_id, k, x AS kx, y AS ky, true AS keep FROM o WHERE k = 1
  UNION ALL SELECT o.track_id, o.k, CASE WHEN sqrt((o.x-f.kx)*(o.x-f.kx) + (o.y-f.ky)*(o.y-f.ky)) >= 20 THEN o.x ELSE f.kx END, CASE WHEN sqrt((o.x-f.kx)*(o.x-f.kx) + (o.y-f.ky)*(o.y-f.ky)) >= 20 THEN o.y ELSE f.ky END,
  sqrt((o.x-f.kx)*(o.x-f.kx) + (o.y-f.ky)*(o.y-f.ky)) >= 20 FROM f JOIN o ON o.track_id = f.track_id AND o.k = f.k + 1)
SELECT o.track_id, event_id, round(x, 6) AS x, round(y, 6) AS y FROM f JOIN o USING (track_id, k) WHERE keep""")
def keyframes(spark, d):
    return rounded(T.spatial_keyframes(M.track(spark, d), 20.0).select("track_id", "event_id", "x", "y"))


@query(f"""WITH {M.POSES}, p AS (SELECT q.scan_id AS query_id, m.scan_id AS map_id, round(sqrt((q.x-m.x)*(q.x-m.x) + (q.y-m.y)*(q.y-m.y)), 9) AS d FROM poses q JOIN poses m ON q.scan_id % 2 = 1 AND m.scan_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, map_id) AS r FROM p) SELECT query_id, map_id, round(d, 6) AS d FROM r WHERE r = 1""")
def nearest_map_pose(spark, d):
    p = M.poses(spark, d)
    return rounded(T.nearest_pose(p.where("scan_id % 2 = 1"), p.where("scan_id % 2 = 0")))


def _asof(spark, d, tie, tolerance=None):
    t = M.track(spark, d)
    left = t.where("kind = 'click'").select("track_id", "event_id", "stamp")
    right = t.where("kind = 'view'").select("track_id", "event_id", "stamp", "x").dropDuplicates(["track_id", "stamp"])
    return rounded(T.asof_nearest(left, right, "track_id", tie=tie, tolerance=tolerance).select("track_id", "event_id", F.col("ref_event_id").alias("ref_id"), "dt"), 3)


def _asof_sql(tie: str, where: str = "") -> str:
    order = "r.stamp" if tie == "earlier" else "r.stamp DESC"
    return f"""WITH {M.TRACK}, l AS (SELECT * FROM track WHERE kind = 'click'), r0 AS (SELECT *, row_number() OVER (PARTITION BY track_id, stamp ORDER BY event_id) AS k FROM track WHERE kind = 'view'),
    p AS (SELECT l.track_id, l.event_id, r.event_id AS ref_id, abs(l.stamp - r.stamp) AS dt, row_number() OVER (PARTITION BY l.track_id, l.event_id ORDER BY abs(l.stamp - r.stamp), {order}) AS n FROM l LEFT JOIN r0 r ON r.track_id = l.track_id AND r.k = 1)
    SELECT track_id, event_id, ref_id, round(dt, 3) AS dt FROM p WHERE n = 1 {where}"""


@query(_asof_sql("earlier"))
def asof_nearest_earlier(spark, d):
    return _asof(spark, d, "earlier")


@query(_asof_sql("later"))
def asof_nearest_later(spark, d):
    return _asof(spark, d, "later")


@query(_asof_sql("earlier", "AND dt <= 7200"))
def asof_tolerance(spark, d):
    return _asof(spark, d, "earlier", 7200.0)


_SPAN = f"""{M.TRACK}, s AS (SELECT DISTINCT track_id, stamp FROM track WHERE kind = 'click'), p0 AS (SELECT track_id, stamp, min(x) AS x, min(y) AS y, min(event_id) AS e FROM track WHERE kind = 'view' GROUP BY 1, 2),
p AS (SELECT *, (e % 63) * 0.1::DOUBLE - 3.1::DOUBLE AS yaw, (e % 9 - 4) * 0.05::DOUBLE AS pitch, (e % 8 - 3) * 0.04::DOUBLE AS roll, (e % 5) * 0.3::DOUBLE AS z FROM p0),
j AS (SELECT s.track_id, s.stamp, (SELECT max(p.stamp) FROM p WHERE p.track_id = s.track_id AND p.stamp <= s.stamp) AS b, (SELECT min(p.stamp) FROM p WHERE p.track_id = s.track_id AND p.stamp > s.stamp) AS a FROM s),
k AS (SELECT track_id, stamp, coalesce(b, a) AS b, coalesce(a, b) AS a FROM j WHERE a IS NOT NULL OR b IS NOT NULL),
t AS (SELECT k.*, greatest(0::DOUBLE, least(1::DOUBLE, coalesce((k.stamp - b) / nullif(a - b, 0), 0))) AS t FROM k)"""


def _views(spark, d):
    """Stamps to interpolate at, and poses that turn about all three axes."""
    t, e = M.track(spark, d), F.col("e")
    p = t.where("kind = 'view'").groupBy("track_id", "stamp").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("event_id").alias("e"))
    p = p.withColumns({"yaw": e % 63 * 0.1 - 3.1, "pitch": (e % 9 - 4) * 0.05, "roll": (e % 8 - 3) * 0.04, "z": e % 5 * 0.3})
    return t.where("kind = 'click'").select("track_id", "stamp").distinct(), p


@query(f"""WITH {_SPAN}, w AS (SELECT t.track_id, t.stamp, t.t, pb.x AS bx, pa.x AS ax, pb.y AS b_y, pa.y AS a_y, pb.yaw AS byaw, pa.yaw - pb.yaw AS dyaw FROM t JOIN p pb ON pb.track_id = t.track_id AND pb.stamp = t.b JOIN p pa ON pa.track_id = t.track_id AND pa.stamp = t.a),
v AS (SELECT *, byaw + (dyaw - 2*pi() * round_even(dyaw / (2*pi()), 0)) * t AS yaw FROM w)
SELECT track_id, stamp, round(bx + (ax - bx) * t, 6) AS x, round(b_y + (a_y - b_y) * t, 6) AS y, round(yaw - 2*pi() * round_even(yaw / (2*pi()), 0), 6) + 0.0::DOUBLE AS yaw FROM v""")
def pose_interp(spark, d):
    s, p = _views(spark, d)
    return rounded(T.interpolate_poses(s, p, "track_id"))


@query(f"""WITH {_SPAN}, h AS (SELECT *, yaw / 2 AS ha, pitch / 2 AS hb, roll / 2 AS hc FROM p),
q AS (SELECT track_id, stamp, x, y, z, sin(hc)*cos(hb)*cos(ha) - cos(hc)*sin(hb)*sin(ha) AS qx, cos(hc)*sin(hb)*cos(ha) + sin(hc)*cos(hb)*sin(ha) AS qy, cos(hc)*cos(hb)*sin(ha) - sin(hc)*sin(hb)*cos(ha) AS qz, cos(hc)*cos(hb)*cos(ha) + sin(hc)*sin(hb)*sin(ha) AS qw FROM h),
w AS (SELECT t.track_id, t.stamp, t.t, qb AS b, qa AS a, qb.qx * qa.qx + qb.qy * qa.qy + qb.qz * qa.qz + qb.qw * qa.qw AS dot FROM t JOIN q qb ON qb.track_id = t.track_id AND qb.stamp = t.b JOIN q qa ON qa.track_id = t.track_id AND qa.stamp = t.a),
u AS (SELECT *, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg, least(abs(dot), 1) AS c, acos(least(abs(dot), 1)) AS angle FROM w),
v AS (SELECT *, CASE WHEN c > 1 - 1e-12::DOUBLE THEN 1 - t ELSE sin((1 - t) * angle) / sin(angle) END AS wb, CASE WHEN c > 1 - 1e-12::DOUBLE THEN t ELSE sin(t * angle) / sin(angle) END * sg AS wa FROM u),
m AS (SELECT *, wb*b.qx + wa*a.qx AS x, wb*b.qy + wa*a.qy AS y, wb*b.qz + wa*a.qz AS z, wb*b.qw + wa*a.qw AS w FROM v), n AS (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n FROM m)
SELECT track_id, stamp, round(b.x + (a.x - b.x) * t, 6) AS x, round(b.y + (a.y - b.y) * t, 6) AS y, round(b.z + (a.z - b.z) * t, 6) AS z,
  round(atan2(2 * (y*z + x*w) / (n*n), 1 - 2 * (x*x + y*y) / (n*n)), 6) + 0.0::DOUBLE AS roll, round(asin(greatest(-1, least(1, 2 * (y*w - x*z) / (n*n)))), 6) + 0.0::DOUBLE AS pitch, round(atan2(2 * (x*y + z*w) / (n*n), 1 - 2 * (y*y + z*z) / (n*n)), 6) + 0.0::DOUBLE AS yaw FROM n""")
def pose_interp_full(spark, d):
    """Whole poses between two others, as angles."""
    s, p = _views(spark, d)
    a, b, c = (F.col(x) / 2 for x in ("yaw", "pitch", "roll"))
    sa, ca, sb, cb, sc, cc = F.sin(a), F.cos(a), F.sin(b), F.cos(b), F.sin(c), F.cos(c)
    p = p.select("track_id", "stamp", "x", "y", "z", (sc * cb * ca - cc * sb * sa).alias("qx"), (cc * sb * ca + sc * cb * sa).alias("qy"), (cc * cb * sa - sc * sb * ca).alias("qz"), (cc * cb * ca + sc * sb * sa).alias("qw"))
    out = T.interpolate_full(s, p, "track_id")
    roll, pitch, yaw = G.rpy(G.quaternion_matrix(*[F.col(q) for q in ("qx", "qy", "qz", "qw")]))
    return rounded(out.select("track_id", "stamp", "x", "y", "z", roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw")))


@query(f"WITH {M.POSES} SELECT a.scan_id, count(*) AS neighbours, round(sum((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 4) AS d2 FROM poses a JOIN poses b ON (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 100 GROUP BY 1")
def radius_neighbours(spark, d):
    return rounded(D.radius_pairs(M.poses(spark, d), 10.0).groupBy("scan_id").agg(F.count("*").alias("neighbours"), F.sum("d2").alias("d2")), 4)


_ROLL = f"""o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY stamp, event_id) - 1 AS k FROM track)"""


@query(f"""WITH {M.TRACK}, {_ROLL} SELECT a.track_id, a.k AS submap_id, count(*) AS frames, min(b.k) AS first_k, round(avg(b.x), 6) AS x, round(avg(b.y), 6) AS y FROM o a JOIN o b ON b.track_id = a.track_id AND b.k BETWEEN a.k - 9 AND a.k WHERE a.k >= 9 GROUP BY 1, 2""")
def submap_rolling(spark, d):
    s = T.rolling_submaps(M.track(spark, d), "track_id", ["stamp", "event_id"], 10)
    return rounded(s.groupBy("track_id", F.col("submap_id").cast("long").alias("submap_id")).agg(F.count("*").alias("frames"), F.min("k").cast("long").alias("first_k"), F.avg("x").alias("x"), F.avg("y").alias("y")))


@query(f"""WITH {M.POSES}, {M.TRACK.replace('track AS', 'track0 AS')}, f AS (SELECT p.scan_id, m.scan_id AS member FROM poses p JOIN poses m ON m.scan_id BETWEEN p.scan_id - 4 AND p.scan_id WHERE p.scan_id >= 5),
pt AS (SELECT l_suppkey AS scan_id, l_quantity - 25.3::DOUBLE AS x, l_extendedprice / 2000::DOUBLE - 26.03::DOUBLE AS y, l_discount * 40::DOUBLE + l_tax * 12.5::DOUBLE AS z FROM lineitem),
w AS (SELECT f.scan_id, cos(q.yaw)*pt.x - sin(q.yaw)*pt.y + q.x - r.x AS x, sin(q.yaw)*pt.x + cos(q.yaw)*pt.y + q.y - r.y AS y, pt.z + q.z - r.z AS z FROM f JOIN poses q ON q.scan_id = f.member JOIN poses r ON r.scan_id = f.scan_id JOIN pt ON pt.scan_id = f.member),
v AS (SELECT scan_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM w GROUP BY scan_id, floor(x / 4.03::DOUBLE), floor(y / 4.03::DOUBLE), floor(z / 4.03::DOUBLE))
SELECT scan_id, count(*) AS voxels, sum(n)::BIGINT AS points, round(sum(z), 3) AS z FROM v GROUP BY 1""")
def submap_points(spark, d):
    """Points of the five latest scans in the frame of the last, by voxel."""
    poses = M.poses(spark, d)
    world = P.to_world(M.points(spark, d), poses).withColumnRenamed("scan_id", "member")
    ends = poses.where("scan_id >= 5").select("scan_id", *[F.col(c).alias(f"r{c}") for c in "xyz"], F.explode(F.sequence(F.col("scan_id") - 4, F.col("scan_id"))).alias("member"))
    p = P.to_reference(world.join(ends, "member"), F.col("rx"), F.col("ry"), F.col("rz"))
    v = P.voxel_centroids(p, 4.03)
    return rounded(v.groupBy("scan_id").agg(F.count("*").alias("voxels"), F.sum("n").alias("points"), F.sum("z").alias("z")), 3)


@query(f"""WITH {M.TRACK}, s AS (SELECT track_id, event_id, stamp FROM track WHERE kind <> 'purchase'), t AS (SELECT track_id, event_id AS target_id, stamp FROM track WHERE kind = 'purchase'),
p AS (SELECT t.track_id, target_id, s.event_id AS scan_id, row_number() OVER (PARTITION BY t.track_id, target_id ORDER BY s.stamp DESC, s.event_id DESC) AS r, count(*) OVER (PARTITION BY t.track_id, target_id) AS n FROM t JOIN s ON s.track_id = t.track_id AND s.stamp <= t.stamp)
SELECT track_id, target_id, scan_id FROM p WHERE r <= 10 AND n >= 10""")
def submap_causal(spark, d):
    t = M.track(spark, d)
    s = T.causal_submaps(t.where("kind = 'purchase'").select("track_id", "stamp", F.col("event_id").alias("target_id")), t.where("kind <> 'purchase'").select("track_id", "stamp", F.col("event_id").alias("scan_id")), "track_id")
    return s.select("track_id", "target_id", "scan_id")


@query(_asof_sql("earlier", "AND dt <= 86400").replace("SELECT track_id, event_id, ref_id, round(dt, 3) AS dt FROM p WHERE n = 1 AND dt <= 86400", "SELECT track_id, ref_id, min(event_id) AS centre, count(*) AS uses FROM p WHERE n = 1 AND dt <= 86400 GROUP BY 1, 2"))
def centre_to_submap(spark, d):
    """Centres by the native submap nearest in time, with the number of centres that share it."""
    near = _asof(spark, d, "earlier", 86400.0)
    return near.groupBy("track_id", "ref_id").agg(F.min("event_id").alias("centre"), F.count("*").alias("uses"))


@query(f"WITH {M.TRACK}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY stamp, event_id) AS k, count(*) OVER (PARTITION BY track_id) AS n FROM track) SELECT track_id, CASE WHEN k <= n // 2 THEN 'map' ELSE 'query' END AS role, count(*) AS frames, round(avg(x), 6) AS x FROM o GROUP BY 1, 2")
def half_split(spark, d):
    t = T.half_split(M.track(spark, d), "track_id", ["stamp", "event_id"])
    return rounded(t.groupBy("track_id", "role").agg(F.count("*").alias("frames"), F.avg("x").alias("x")))


@query("WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 1000000::DOUBLE AS stamp, lag(epoch_us(o_orderdate) / 1000000::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) SELECT o_custkey, o_orderkey, round(previous - stamp, 3) AS back FROM o WHERE stamp <= previous")
def monotonic_check(spark, d):
    o = M.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").cast("double").alias("stamp"))
    v = T.monotonic_violations(o, "o_custkey", "o_orderkey")
    return rounded(v.select("o_custkey", "o_orderkey", (F.col("previous") - F.col("stamp")).alias("back")), 3)


@query("""WITH g AS (SELECT c_custkey AS id, c_custkey % 3 - 1 AS status, 30::DOUBLE + c_acctbal / 100000::DOUBLE AS lat, 114::DOUBLE + c_nationkey / 1000::DOUBLE AS lon FROM customer), o AS (SELECT avg(lat) AS lat0, avg(lon) AS lon0 FROM g WHERE status >= 0)
SELECT id, round(radians(lon - lon0) * cos(radians(lat0)) * 6378137::DOUBLE, 4) + 0.0::DOUBLE AS east, round(radians(lat - lat0) * 6378137::DOUBLE, 4) + 0.0::DOUBLE AS north FROM g, o WHERE status >= 0""")
def geodetic_enu(spark, d):
    g = M.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3 - 1).alias("status"), (30.0 + F.col("c_acctbal") / 100000.0).alias("lat"), (114.0 + F.col("c_nationkey") / 1000.0).alias("lon")).where("status >= 0")
    e, n = G.geodetic_enu(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    origin = g.agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))  # one row
    return rounded(g.crossJoin(F.broadcast(origin)).select("id", e.alias("east"), n.alias("north")), 4)


@query(f"WITH {M.POSES} SELECT scan_id, round(x*cos(0.7::DOUBLE) - y*sin(0.7::DOUBLE) + 3::DOUBLE, 6) AS x, round(x*sin(0.7::DOUBLE) + y*cos(0.7::DOUBLE) - 2::DOUBLE, 6) AS y FROM poses")
def se2_apply(spark, d):
    x, y = G.se2(F.col("x"), F.col("y"), 0.7, 3.0, -2.0)
    return rounded(M.poses(spark, d).select("scan_id", x.alias("x"), y.alias("y")))


@query(f"WITH {M.POSES} SELECT scan_id, round((x-3::DOUBLE)*cos(0.7::DOUBLE) + (y+2::DOUBLE)*sin(0.7::DOUBLE), 6) AS x, round(-(x-3::DOUBLE)*sin(0.7::DOUBLE) + (y+2::DOUBLE)*cos(0.7::DOUBLE), 6) AS y FROM poses")
def se2_inverse(spark, d):
    x, y = G.se2_inverse(F.col("x"), F.col("y"), 0.7, 3.0, -2.0)
    return rounded(M.poses(spark, d).select("scan_id", x.alias("x"), y.alias("y")))


def _pairs(spark, d):
    """Poses and the same turned, moved and disturbed a little."""
    p = M.poses(spark, d)
    x, y = G.se2(F.col("x"), F.col("y"), 0.7, 3.0, -2.0)
    return p.select(F.lit(0).alias("g"), F.col("x").alias("sx"), F.col("y").alias("sy"), (x + F.col("scan_id") % 3 * 0.05).alias("x"), (y - F.col("scan_id") % 5 * 0.04).alias("y"))


_PAIRS = f"""{M.POSES}, pr AS (SELECT x AS sx, y AS sy, x*cos(0.7::DOUBLE) - y*sin(0.7::DOUBLE) + 3::DOUBLE + scan_id % 3 * 0.05::DOUBLE AS x, x*sin(0.7::DOUBLE) + y*cos(0.7::DOUBLE) - 2::DOUBLE - scan_id % 5 * 0.04::DOUBLE AS y FROM poses)"""


@query(f"""WITH {_PAIRS}, m AS (SELECT avg(sx) AS msx, avg(sy) AS msy, avg(x) AS mx, avg(y) AS my, covar_pop(sx, y) - covar_pop(sy, x) AS s, covar_pop(sx, x) + covar_pop(sy, y) AS c FROM pr)
SELECT 0 AS g, round(atan2(s, c), 5) AS yaw, round(mx - (cos(atan2(s, c))*msx - sin(atan2(s, c))*msy), 4) AS tx, round(my - (sin(atan2(s, c))*msx + cos(atan2(s, c))*msy), 4) AS ty FROM m""")
def se2_fit(spark, d):
    return rounded(T.se2_sums(_pairs(spark, d).withColumn("w", F.lit(1.0)), ["g"]), 4, yaw=5)


@query()
def se2_robust_fit(spark, d):
    return rounded(T.robust_se2(_pairs(spark, d), ["g"]), 4)


@query()
def se3_fit_grid(spark, d):
    """Every scan's pose against itself 0.7 s later, turned and with an arm: offset, arm and turn must be found again."""
    p = M.poses(spark, d).withColumn("stamp", F.col("scan_id") * 0.5)
    src = p.select((F.col("scan_id") * 0).alias("track"), "stamp", "x", "y", "z", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("yaw") / 2).alias("qz"), F.cos(F.col("yaw") / 2).alias("qw"))
    ax, ay = F.col("x") + 0.4 * F.cos("yaw"), F.col("y") + 0.4 * F.sin("yaw")
    x, y = G.se2(ax, ay, 0.7, 3.0, -2.0)
    truth = p.select((F.col("scan_id") * 0).alias("track"), (F.col("stamp") - 0.7).alias("stamp"), x.alias("x"), y.alias("y"), "z")
    out = T.clock_offset_grid(src, truth, "track", least=5)
    return rounded(out.select("track", "offset", "rmse", "n", "yaw", F.element_at("lever", 1).alias("arm_x"), F.element_at("lever", 2).alias("arm_y")), 4)


@query()
def icp2d(spark, d):
    """Every scan against itself turned by 0.3 rad about the sensor: the turn must be found again."""
    p = M.points(spark, d)
    x, y = G.se2(F.col("x"), F.col("y"), 0.3, 0.0, 0.0)
    return rounded(T.icp2d(p.select("scan_id", x.alias("x"), y.alias("y")), p), 4)


@query(f"""WITH {M.POSES}, {M.GRAVITY}, c AS (SELECT l_suppkey AS scan_id, count(*) AS points FROM lineitem GROUP BY 1)
SELECT scan_id, round(stamp, 6) AS stamp, points, round(uz, 6) AS uz FROM poses JOIN c USING (scan_id) JOIN gravity USING (scan_id)""")
def positional_join(spark, d):
    clouds = M.points(spark, d).groupBy("scan_id").agg(F.count("*").alias("points"))
    p = M.poses(spark, d).join(clouds.select("scan_id"), "scan_id", "left_semi")
    g = M.gravity(spark, d).join(clouds.select("scan_id"), "scan_id", "left_semi")
    return rounded(T.positional_join(p, clouds, g).select("scan_id", "stamp", "points", "uz"))


_BROKEN = "CASE WHEN scan_id % 7 = 0 THEN 'nan'::DOUBLE WHEN scan_id % 11 = 0 THEN NULL ELSE x END"


@query(f"WITH {M.POSES} SELECT scan_id, round(x, 6) AS x, round(y, 6) AS y FROM poses WHERE scan_id % 7 <> 0 AND scan_id % 11 <> 0")
def entry_admission(spark, d):
    k = F.col("scan_id")
    p = M.poses(spark, d).withColumn("x", F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(None)).otherwise(F.col("x")))
    return rounded(T.admitted(p, "stamp", "x", "y", "z", "yaw").select("scan_id", "x", "y"))


#: Orientations with all three angles: half angles of yaw, pitch and roll.
_QUAT = f"""{M.POSES}, h AS (SELECT scan_id, yaw / 2 AS a, (scan_id % 9 - 4) * 0.05::DOUBLE AS b, (scan_id % 8 - 3) * 0.04::DOUBLE AS c FROM poses),
q AS (SELECT scan_id, 2*a AS yaw, 2*b AS pitch, 2*c AS roll, sin(c)*cos(b)*cos(a) - cos(c)*sin(b)*sin(a) AS qx, cos(c)*sin(b)*cos(a) + sin(c)*cos(b)*sin(a) AS qy, cos(c)*cos(b)*sin(a) - sin(c)*sin(b)*cos(a) AS qz, cos(c)*cos(b)*cos(a) + sin(c)*sin(b)*sin(a) AS qw FROM h)"""


def orientations(spark, d):
    k = F.col("scan_id")
    a, b, c = F.col("yaw") / 2, (k % 9 - 4) * 0.05, (k % 8 - 3) * 0.04
    sa, ca, sb, cb, sc, cc = F.sin(a), F.cos(a), F.sin(b), F.cos(b), F.sin(c), F.cos(c)
    return M.poses(spark, d).select("*", (sc * cb * ca - cc * sb * sa).alias("qx"), (cc * sb * ca + sc * cb * sa).alias("qy"), (cc * cb * sa - sc * sb * ca).alias("qz"), (cc * cb * ca + sc * sb * sa).alias("qw"))


@query(f"WITH {_QUAT} SELECT scan_id, round(roll, 6) + 0.0::DOUBLE AS roll, round(pitch, 6) + 0.0::DOUBLE AS pitch, round(yaw, 6) + 0.0::DOUBLE AS yaw FROM q")
def pose_angles(spark, d):
    """Angles of poses that roll, pitch and turn, from their quaternions."""
    r, p, y = G.rpy(G.quaternion_matrix(*[F.col(c) for c in ("qx", "qy", "qz", "qw")]))
    return rounded(orientations(spark, d).select("scan_id", r.alias("roll"), p.alias("pitch"), y.alias("yaw")))


@query(f"WITH {_QUAT} SELECT scan_id, round(-sin(pitch), 6) + 0.0::DOUBLE AS ux, round(cos(pitch) * sin(roll), 6) + 0.0::DOUBLE AS uy, round(cos(pitch) * cos(roll), 6) + 0.0::DOUBLE AS uz FROM q")
def gravity_from_quaternion(spark, d):
    up = G.up_in_body(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    return rounded(orientations(spark, d).select("scan_id", *[u.alias(n) for u, n in zip(up, ("ux", "uy", "uz"), strict=True)]))


@query(f"""WITH {_QUAT}, pt AS (SELECT l_suppkey AS scan_id, l_quantity - 25.3::DOUBLE AS px, l_extendedprice / 2000::DOUBLE - 26.03::DOUBLE AS py, l_discount * 40::DOUBLE + l_tax * 12.5::DOUBLE AS pz FROM lineitem),
w AS (SELECT scan_id, cos(yaw)*cos(pitch)*px + (cos(yaw)*sin(pitch)*sin(roll) - sin(yaw)*cos(roll))*py + (cos(yaw)*sin(pitch)*cos(roll) + sin(yaw)*sin(roll))*pz + s.x - 3::DOUBLE AS x,
  sin(yaw)*cos(pitch)*px + (sin(yaw)*sin(pitch)*sin(roll) + cos(yaw)*cos(roll))*py + (sin(yaw)*sin(pitch)*cos(roll) - cos(yaw)*sin(roll))*pz + s.y + 4::DOUBLE AS y, -sin(pitch)*px + cos(pitch)*sin(roll)*py + cos(pitch)*cos(roll)*pz + s.z AS z
  FROM pt JOIN q USING (scan_id) JOIN (SELECT scan_id, x, y, z FROM poses) s USING (scan_id))
SELECT scan_id, round(sum(x), 4) + 0.0::DOUBLE AS x, round(sum(y), 4) + 0.0::DOUBLE AS y, round(sum(z), 4) + 0.0::DOUBLE AS z FROM w GROUP BY 1""")
def rigid_full(spark, d):
    """Scans in the world by whole poses, seen from an origin."""
    p = P.to_world_full(M.points(spark, d), orientations(spark, d), (3.0, -4.0, 0.0))
    return rounded(p.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in "xyz"]), 4)


@query(f"""WITH {_QUAT}, {M.GRAVITY}, r AS (SELECT scan_id, cos(yaw)*cos(pitch) AS r00, cos(yaw)*sin(pitch)*sin(roll) - sin(yaw)*cos(roll) AS r01, cos(yaw)*sin(pitch)*cos(roll) + sin(yaw)*sin(roll) AS r02,
sin(yaw)*cos(pitch) AS r10, sin(yaw)*sin(pitch)*sin(roll) + cos(yaw)*cos(roll) AS r11, sin(yaw)*sin(pitch)*cos(roll) - cos(yaw)*sin(roll) AS r12 FROM q)
SELECT scan_id, round(atan2(r10 * (1 - ux*ux/(1 + uz)) - r11 * ux*uy/(1 + uz) - r12 * ux, r00 * (1 - ux*ux/(1 + uz)) - r01 * ux*uy/(1 + uz) - r02 * ux), 6) + 0.0::DOUBLE AS canonical_yaw FROM r JOIN gravity USING (scan_id)""")
def canonical_yaw(spark, d):
    o = orientations(spark, d).join(M.gravity(spark, d), "scan_id")
    m = G.quaternion_matrix(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    return rounded(o.select("scan_id", G.canonical_yaw(m, G.level_rotation(F.col("ux"), F.col("uy"), F.col("uz"))).alias("canonical_yaw")))


@query(f"""WITH {M.POSES}, w AS (SELECT scan_id, x*cos(0.2::DOUBLE) - y*sin(0.2::DOUBLE) + 1::DOUBLE AS x, x*sin(0.2::DOUBLE) + y*cos(0.2::DOUBLE) - 4::DOUBLE AS y FROM poses),
v AS (SELECT scan_id, x*cos(0.7::DOUBLE) - y*sin(0.7::DOUBLE) + 3::DOUBLE AS x, x*sin(0.7::DOUBLE) + y*cos(0.7::DOUBLE) - 2::DOUBLE AS y FROM w)
SELECT scan_id, round((x-5::DOUBLE)*cos(0.4::DOUBLE) + (y-6::DOUBLE)*sin(0.4::DOUBLE), 6) AS x, round(-(x-5::DOUBLE)*sin(0.4::DOUBLE) + (y-6::DOUBLE)*cos(0.4::DOUBLE), 6) AS y FROM v""")
def frame_chain(spark, d):
    """Query positions through their session's alignment, the planar alignment of both sessions, and back by the map's."""
    p = M.poses(spark, d)
    x, y = G.se2(F.col("x"), F.col("y"), 0.2, 1.0, -4.0)
    p = p.select("scan_id", x.alias("x"), y.alias("y"))
    x, y = G.se2(F.col("x"), F.col("y"), 0.7, 3.0, -2.0)
    p = p.select("scan_id", x.alias("x"), y.alias("y"))
    x, y = G.se2_inverse(F.col("x"), F.col("y"), 0.4, 5.0, 6.0)
    return rounded(p.select("scan_id", x.alias("x"), y.alias("y")))


@query("""WITH g AS (SELECT c_custkey % 3 - 1 AS status, 30::DOUBLE + c_acctbal / 100000::DOUBLE AS lat, 114::DOUBLE + c_nationkey / 1000::DOUBLE AS lon FROM customer),
h AS (SELECT s_suppkey % 4 - 1 AS status, 31::DOUBLE + s_acctbal / 100000::DOUBLE AS lat, 115::DOUBLE + s_nationkey / 1000::DOUBLE AS lon FROM supplier)
SELECT round(avg(lat), 6) AS lat0, round(avg(lon), 6) AS lon0 FROM (FROM g UNION ALL FROM h) WHERE status >= 0""")
def common_origin(spark, d):
    fix = lambda t, n, by, lat, lon: M.table(spark, d, t).select((F.col(f"{n}key") % by - 1).alias("status"), (lat + F.col(f"{t[0]}_acctbal") / 100000.0).alias("lat"), (lon + F.col(f"{t[0]}_nationkey") / 1000.0).alias("lon"))
    return rounded(T.common_origin(fix("customer", "c_cust", 3, 30.0, 114.0), fix("supplier", "s_supp", 4, 31.0, 115.0)))


@query(f"WITH {M.POSES} SELECT scan_id AS submap_id, round(x + 1::DOUBLE, 6) AS truth_x FROM poses")
def submap_truth(spark, d):
    p = M.poses(spark, d).withColumnRenamed("scan_id", "submap_id")
    return rounded(T.truth_of_submaps(p.select("submap_id", "stamp"), p.select("submap_id", "stamp", (F.col("x") + 1.0).alias("truth_x"))).select("submap_id", "truth_x"))


@query("""WITH c AS (SELECT c_custkey % 500 AS win, row_number() OVER (PARTITION BY c_custkey % 500 ORDER BY c_acctbal, c_custkey) AS rank, c_custkey AS candidate FROM customer), t AS (SELECT p_partkey % 500 AS win, min(p_retailprice) AS ms FROM part GROUP BY 1)
SELECT win, candidate, round(ms, 4) AS retrieval_ms FROM c JOIN t USING (win) WHERE rank = 1""")
def window_join(spark, d):
    """The best candidate of each query window with the window's timing."""
    c = M.table(spark, d, "customer").groupBy((F.col("c_custkey") % 500).alias("win")).agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("candidate"))
    t = M.table(spark, d, "part").groupBy((F.col("p_partkey") % 500).alias("win")).agg(F.min("p_retailprice").alias("retrieval_ms"))
    return rounded(c.join(t, "win"), 4)


@query(f"""WITH {M.TRACK}, e AS (SELECT track_id, abs(x - 50::DOUBLE) AS e FROM track) SELECT count(*) AS n, round(median(e), 6) AS median, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS max FROM e""")
def residual_summary(spark, d):
    return rounded(E.error_summary(M.track(spark, d).withColumn("e", F.abs(F.col("x") - 50.0)), "e"))


@query(f"""WITH {M.TRACK}, f AS (SELECT event_id, stamp, x, y FROM track WHERE abs(x) < 90) SELECT count(*) AS n, round(count(*) / (SELECT count(*) FROM track), 6) AS share, round(median(abs(x)), 6) AS median, round(quantile_cont(abs(x), 0.95), 6) AS p95, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM f""")
def trajectory_error(spark, d):
    t = M.track(spark, d)
    ok = F.abs("x") < 90
    a = F.when(ok, F.abs("x"))
    box = [f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))]
    return rounded(t.select("*", a.alias("a")).agg(F.count("a").alias("n"), (F.count("a") / F.count("*")).alias("share"), F.percentile("a", F.lit(0.5)).alias("median"), F.percentile("a", F.lit(0.95)).alias("p95"), *box))
