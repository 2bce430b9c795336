"""Point operators: filters, projections, voxels, caps. Input rows: (scan_id, ord, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerec.functions import geom as G



def finite_points(p: DataFrame) -> DataFrame:
    return p.where(G.finite(F.col("x"), F.col("y"), F.col("z")))


def crop_annulus(p: DataFrame, low: float = 0.3, high: float = 30.0) -> DataFrame:
    return p.where(G.finite(F.col("x"), F.col("y"), F.col("z")) & G.range_xy(F.col("x"), F.col("y")).between(low, high))


def in_descriptor_range(p: DataFrame, radius: float) -> DataFrame:
    r = G.range_xy(F.col("x"), F.col("y"))
    return p.where(G.finite(F.col("x"), F.col("y"), F.col("z")) & (r > 1e-6) & (r <= radius))


def drop_blind_box(p: DataFrame, radius: float = 0.3, low: float = -0.5, high: float = 2.0) -> DataFrame:
    return p.where(~((G.range_xy(F.col("x"), F.col("y")) <= radius) & F.col("z").between(low, high)))


def wall_slab(p: DataFrame, r=(0.5, 25.0), z=(0.5, 2.0)) -> DataFrame:
    d = G.range_xy(F.col("x"), F.col("y"))
    return p.where((d > r[0]) & (d < r[1]) & (F.col("z") > z[0]) & (F.col("z") < z[1]))


def shift_z(p: DataFrame, offset: float) -> DataFrame:
    return p.withColumn("z", F.col("z") + F.lit(offset))


def level(p: DataFrame, gravity: DataFrame, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), single: bool = False) -> DataFrame:
    """Gravity-canonical points: each scan's up vector turned to +z about an origin; up vectors without length are passed over.

    ``single`` rounds coordinates to single precision, as clouds at rest hold them.
    """
    norm = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    # a unit vector stays as it is: dividing by a length that only rounding keeps from 1 would move points off the edges of bins
    norm = F.when(F.abs(norm - 1.0) <= 1e-15, F.lit(1.0)).otherwise(norm)
    # null without length, so that the points go with all that is not finite: a filter here would be inferred for the points' side
    # as well, where the view behind ``gravity`` would be worked out for every point
    g = gravity.withColumn("norm", norm).withColumn("norm", F.when(G.finite(F.col("norm")) & (F.col("norm") > 1e-6), F.col("norm"))).select("scan_id", *[(F.col(c) / F.col("norm")).alias(c) for c in ("ux", "uy", "uz")])
    # nine columns a scan, not a matrix a point; not a number in place of null, so that no test for null is inferred for each of the
    # nine and spelt out before the view (it went beyond what can be compiled)
    m = G.level_rotation(F.col("ux"), F.col("uy"), F.col("uz"))
    g = g.select("scan_id", *[F.coalesce(m[i][j], F.lit(float("nan"))).alias(f"_r{i}{j}") for i in range(3) for j in range(3)])
    turned = G.rotate([[F.col(f"_r{i}{j}") for j in range(3)] for i in range(3)], *[F.col(c) - o if o else F.col(c) for c, o in zip("xyz", origin, strict=True)])
    x, y, z = (c.cast("float").cast("double") if single else c for c in turned)
    return finite_points(p.join(g, "scan_id").select(*[c for c in p.columns if c not in "xyz"], x.alias("x"), y.alias("y"), z.alias("z")))


def level_heading(p: DataFrame, poses: DataFrame) -> DataFrame:
    """Roll and pitch removed, heading kept: Rz(yaw) transposed times the body rotation (qx, qy, qz, qw)."""
    d = p.join(poses.select("scan_id", "qx", "qy", "qz", "qw"), "scan_id")
    m = G.quaternion_matrix(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    yaw = F.atan2(m[1][0], m[0][0])
    wx, wy, wz = G.rotate(m, F.col("x"), F.col("y"), F.col("z"))
    c, s = F.cos(yaw), F.sin(yaw)
    return d.select(*[k for k in p.columns if k not in "xyz"], (c * wx + s * wy).alias("x"), (c * wy - s * wx).alias("y"), wz.alias("z"))


def to_world(p: DataFrame, poses: DataFrame) -> DataFrame:
    """Planar rigid transform of each scan by its pose (x, y, z, yaw)."""
    d = p.join(poses.select("scan_id", *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "z", "yaw")]), "scan_id")
    c, s = F.cos("p_yaw"), F.sin("p_yaw")
    return d.select(*[k for k in p.columns if k not in "xyz"], (c * F.col("x") - s * F.col("y") + F.col("p_x")).alias("x"), (s * F.col("x") + c * F.col("y") + F.col("p_y")).alias("y"), (F.col("z") + F.col("p_z")).alias("z"))


def to_world_full(p: DataFrame, poses: DataFrame, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Rigid transform of each scan by its whole pose (x, y, z, qx, qy, qz, qw), seen from an origin."""
    q = ("qx", "qy", "qz", "qw")
    m = G.quaternion_matrix(*[F.col(c) for c in q])
    # twelve columns a scan, not a matrix a point
    rows = poses.select("scan_id", *[m[i][j].alias(f"_m{i}{j}") for i in range(3) for j in range(3)], *[(F.col(c) - o).alias(f"_t{c}") for c, o in zip("xyz", origin, strict=True)])
    moved = G.rotate([[F.col(f"_m{i}{j}") for j in range(3)] for i in range(3)], F.col("x"), F.col("y"), F.col("z"))
    return p.join(rows, "scan_id").select(*[k for k in p.columns if k not in "xyz"], *[(v + F.col(f"_t{c}")).alias(c) for v, c in zip(moved, "xyz", strict=True)])


def point_times(p: DataFrame, time: str = "t") -> DataFrame:
    """``time`` of each point since its scan's first, in nanoseconds, whatever unit it came in.

    A scan spans at most 0.2 s, so a span of up to 0.2 is in seconds, up to 200 in milliseconds, up to 200,000 in microseconds, beyond in
    nanoseconds. Where times are absent, not finite, or span nothing or too much, a tenth of a second is dealt out by order.
    """
    w, order = Window.partitionBy("scan_id"), Window.partitionBy("scan_id").orderBy("ord")
    since = F.col(time) - F.min(time).over(w)
    d = p.withColumn("_since", since).withColumn("_span", F.max("_since").over(w)).withColumn("_n", F.count("*").over(w))
    unit = F.when(F.col("_span") <= 0.2, 1e9).when(F.col("_span") <= 200.0, 1e6).when(F.col("_span") <= 200_000.0, 1e3).otherwise(1.0)
    ok = F.coalesce(F.bool_and(G.finite(F.col(time)) & F.col(time).isNotNull()).over(w) & (F.col("_span") * unit > 1.0) & (F.col("_span") * unit <= 200_000_000.0), F.lit(False))
    dealt = F.coalesce(F.floor((F.row_number().over(order) - 1) * F.try_divide(F.lit(99_999_999.0), F.col("_n") - 1)), F.lit(0))
    at = F.when(ok, F.floor(F.least(F.greatest(F.col("_since") * unit, F.lit(0.0)), F.lit(200_000_000.0)))).otherwise(dealt)
    return d.withColumn(time, at.cast("long")).drop("_since", "_span", "_n")


def to_reference(world: DataFrame, rx: Column, ry: Column, rz: Column, yaw: Column | None = None) -> DataFrame:
    """World points seen from a reference: moved to it, and turned into its axes if it has a yaw."""
    dx, dy = F.col("x") - rx, F.col("y") - ry
    if yaw is None:
        return world.withColumns({"x": dx, "y": dy, "z": F.col("z") - rz})
    return world.withColumns({"x": F.cos(yaw) * dx + F.sin(yaw) * dy, "y": F.cos(yaw) * dy - F.sin(yaw) * dx, "z": F.col("z") - rz})


def _voxel(leaf: float, axes=("x", "y", "z")) -> list[Column]:
    return [F.floor(F.col(a) / leaf).alias(f"v{a}") for a in axes]


def voxel_centroids(p: DataFrame, leaf: float) -> DataFrame:
    """The mean of each voxel's points, of all their numbers (intensity too), and how many there are."""
    fields = [c for c, t in p.dtypes if c not in ("scan_id", "x", "y", "z", "n") and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return p.groupBy("scan_id", *_voxel(leaf)).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", *fields)], F.count("*").alias("n"))


def voxel_first(p: DataFrame, leaf: float) -> DataFrame:
    """The first point, by order, of each voxel."""
    first = F.min_by(F.struct("x", "y", "z"), "ord")
    return p.groupBy("scan_id", *_voxel(leaf)).agg(F.min("ord").alias("ord"), first.alias("p")).select("scan_id", "ord", "p.*")


def dedup_cells(p: DataFrame, cell: float = 0.15) -> DataFrame:
    """The first point of each rounded planar cell."""
    return p.groupBy("scan_id", F.rint(F.col("x") / cell).alias("cx"), F.rint(F.col("y") / cell).alias("cy")).agg(F.min("ord").alias("ord"), F.min_by(F.struct("x", "y", "z"), "ord").alias("p")).select("scan_id", "ord", "p.*")


#: Multipliers of the coordinate hash, fixed values.
HASH_X, HASH_Y, HASH_Z = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _times(a: Column, by: int) -> Column:
    """a * by modulo 2^64 as a signed long, for an a of less than 32 bits, in halves, as sums of longs may not wrap."""
    half = F.lit(0xFFFFFFFF)
    low = a * F.lit(by & 0xFFFFFFFF)
    high = (F.shiftright(low, 32) + (a * F.lit(by >> 32)).bitwiseAND(half)).bitwiseAND(half)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))


def coordinate_hash(x: Column, y: Column, z: Column) -> Column:
    """The exclusive or of millimetres times a constant each, ordered as an unsigned number by its top bit turned."""
    mm = [F.rint(c * 1000).cast("long") for c in (x, y, z)]
    h = _times(mm[0], HASH_X).bitwiseXOR(_times(mm[1], HASH_Y)).bitwiseXOR(_times(mm[2], HASH_Z))
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def point_cap(p: DataFrame, limit: int, key: Column | None = None) -> DataFrame:
    """The ``limit`` points of each scan with the smallest keys (the coordinate hash); ties by order."""
    key = coordinate_hash(F.col("x"), F.col("y"), F.col("z")) if key is None else key
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(key, "ord"))
    return p.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def virtual_roots(p: DataFrame, shifts=(0.0, -2.0, 2.0)) -> DataFrame:
    """Each point seen from several roots across the road: y minus the shift."""
    roots = F.array(*[F.struct(F.lit(i).alias("root_id"), F.lit(s).alias("dy")) for i, s in enumerate(shifts)])
    return p.withColumn("_r", F.explode(roots)).withColumns({"root_id": F.col("_r.root_id"), "y": F.col("y") - F.col("_r.dy")}).drop("_r")


def ringpp_normalise(p: DataFrame, span: float = 70.0, low: float = 1.0, high: float = 20.0) -> DataFrame:
    inside = (F.abs(F.col("x")) < span) & (F.abs(F.col("y")) < span) & (F.col("z") > low) & (F.col("z") < high)
    return p.where(inside).withColumns({"x": F.col("x") / span, "y": F.col("y") / span, "z": (F.col("z") - low) / (high - low)})


def centred_unit(p: DataFrame) -> DataFrame:
    """Points minus their scan's centroid, turned about and scaled to half a mean radius, at most 1 on each axis."""
    mid = p.groupBy("scan_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    d = p.join(mid, "scan_id").select("scan_id", "ord", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    scale = d.groupBy("scan_id").agg((F.lit(-0.5) / F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))).alias("s"))
    d = d.join(scale, "scan_id").select("scan_id", "ord", *[(F.col(c) * F.col("s")).alias(c) for c in "xyz"])
    return d.where((F.abs(F.col("x")) <= 1) & (F.abs(F.col("y")) <= 1) & (F.abs(F.col("z")) <= 1))


def range_image(p: DataFrame, rows: int = 64, cols: int = 900, up: float = 3.0, down: float = -25.0, far: float = 80.0) -> DataFrame:
    """Nearest range of each (row, col) of a spherical image, quantised to 0..255."""
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    pitch = F.degrees(F.asin(F.col("z") / d))
    row = G.clamp(F.floor((1 - (pitch - down) / (up - down)) * rows), 0, rows - 1).cast("int")
    col = G.clamp(F.floor((1 - F.atan2(F.col("y"), F.col("x")) / G.PI) * 0.5 * cols), 0, cols - 1).cast("int")
    near = p.where((d > 0) & (d < far)).groupBy("scan_id", row.alias("row"), col.alias("col")).agg(F.min(d).alias("range"))
    return near.withColumn("level", G.clamp(F.rint(F.col("range") / far * 255), 0.0, 255.0).cast("int"))


def orthographic(p: DataFrame, azimuth: float, elevation: float) -> DataFrame:
    """Screen axes (u, v) and depth of a view from an azimuth and elevation."""
    import math

    ca, sa, ce, se = math.cos(azimuth), math.sin(azimuth), math.cos(elevation), math.sin(elevation)
    return p.select("scan_id", "ord", (-sa * F.col("x") + ca * F.col("y")).alias("u"), (-se * ca * F.col("x") - se * sa * F.col("y") + ce * F.col("z")).alias("v"), (ce * ca * F.col("x") + ce * sa * F.col("y") + se * F.col("z")).alias("depth"))


def stride(p: DataFrame, n: int) -> DataFrame:
    """Every n-th point of each scan, from the first."""
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("ord"))
    return p.withColumn("_rank", rank).where((F.col("_rank") - 1) % n == 0).drop("_rank")


def percentile_crop(p: DataFrame, low: float, high: float) -> DataFrame:
    """Points between two percentiles of x and of y of their scan."""
    q = p.groupBy("scan_id").agg(*[F.percentile(c, F.lit(s)).alias(f"{c}{i}") for c in "xy" for i, s in enumerate((low, high))])
    d = p.join(q, "scan_id")
    for c in "xy":
        d = d.where(F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1")))
    return d.select(*p.columns)
