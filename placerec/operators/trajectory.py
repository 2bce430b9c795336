"""Trajectory operators: keyframes, as-of and nearest joins, interpolation, submaps, alignment."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerec.functions import geom as G
from placerec.operators.neighbours import Grid, Raster


def _kept(points: np.ndarray, last: np.ndarray | None, spacing: float) -> list[int]:
    """Rows at least ``spacing`` from the last one kept, looked for in runs that double until one is found."""
    kept, at, run = [], 0, 64
    if last is None and len(points):
        kept, last, at = [0], points[0], 1
    while at < len(points):
        far = np.flatnonzero(np.sqrt(((points[at : at + run] - last) ** 2).sum(1)) >= spacing)
        if len(far):
            at += int(far[0])
            kept.append(at)
            last, at, run = points[at], at + 1, 64
        else:
            at, run = at + run, min(run * 2, 1 << 16)
    return kept


def spatial_keyframes(track: DataFrame, spacing: float, key: str = "track_id", order=("stamp", "event_id"), axes=("x", "y")) -> DataFrame:
    """Per track: the first row, then each row at least ``spacing`` from the last one kept.

    Tracks are dealt out by key and sorted; a task passes over its rows once, a batch at a time, and carries the last kept
    position from batch to batch. The work is linear in a track, however long, and nothing of it is gathered.
    """
    import pyarrow as pa

    rows = track.select(key, *order, *axes).repartition(key).sortWithinPartitions(key, *order)
    first = 1 + len(order)

    def run(batches):
        now, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            code = keys.indices.to_numpy(zero_copy_only=False)
            points = np.stack([batch.column(first + c).to_numpy(zero_copy_only=False).astype(float) for c in range(len(axes))], 1)
            edges = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                name = batch.column(0)[a].as_py()
                if now is None or now[0] != name:
                    now, last = (name,), None
                kept = [a + i for i in _kept(points[a:b], last, spacing)]
                out += kept
                last = points[kept[-1]] if kept else last
            yield batch.take(pa.array(out, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def asof_nearest(left: DataFrame, right: DataFrame, key: str, stamp: str = "stamp", tie: str = "earlier", tolerance: float | None = None) -> DataFrame:
    """Each left row with the ``ref_`` columns of the right row of the nearest stamp of its key.

    Both sides are put on one time line per key and the nearest neighbour on either side is carried over by windows:
    one shuffle, no pairs. Equal distances go to the earlier or later row. Right rows beyond the tolerance count as none.
    """
    cols = [c for c in right.columns if c != key]
    payload = F.struct(*[F.col(c).alias(f"ref_{c}") for c in cols])
    u = left.select(key, F.col(stamp).alias("_t"), F.lit(1).alias("_side"), F.struct(*[c for c in left.columns if c != key]).alias("_l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_r"))
    v = right.select(key, F.col(stamp).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(u.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    w = Window.partitionBy(key).orderBy("_t", "_side")
    back = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # a right row of the same stamp stands before the left one and is found looking back
    ahead = F.first("_r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    j = u.unionByName(v).withColumns({"_b": back, "_a": ahead}).where(F.col("_side") == 1)
    db, da = F.abs(F.col("_t") - F.col(f"_b.ref_{stamp}")), F.abs(F.col(f"_a.ref_{stamp}") - F.col("_t"))
    first = (da < db) if tie == "earlier" else (da <= db)
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNotNull() & first, F.col("_a")).otherwise(F.col("_b"))
    out = j.withColumn("_n", near).withColumn("dt", F.abs(F.col("_t") - F.col(f"_n.ref_{stamp}")))
    if tolerance is not None:
        out = out.where(F.col("dt") <= tolerance)
    return out.select(key, "_l.*", "_n.*", "dt")


def _between(stamps: DataFrame, poses: DataFrame, key: str, columns: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Stamps with the poses before (b) and after (a) them, one of them twice beyond the ends, and the share of the way between."""
    p = F.struct("stamp", *columns)
    u = stamps.select(key, F.col("stamp").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(poses.select(p.alias("p")).schema["p"].dataType).alias("_p"))
    v = poses.select(key, F.col("stamp").alias("_t"), F.lit(0).alias("_side"), p.alias("_p"))
    w = Window.partitionBy(key).orderBy("_t", "_side")
    j = u.unionByName(v).withColumn("b", F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.first("_p", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).where(F.col("_side") == 1)
    j = j.withColumns({"b": F.coalesce("b", "a"), "a": F.coalesce("a", "b")}).where(F.col("a").isNotNull())
    t = F.coalesce(F.try_divide(F.col("_t") - F.col("b.stamp"), F.col("a.stamp") - F.col("b.stamp")), F.lit(0.0))
    return j.withColumn("t", G.clamp(t, 0.0, 1.0)), F.col("t")


def _lerp(c: str, t: Column) -> Column:
    return (F.col(f"b.{c}") + (F.col(f"a.{c}") - F.col(f"b.{c}")) * t).alias(c)


def interpolate_full(stamps: DataFrame, poses: DataFrame, key: str) -> DataFrame:
    """Poses (x, y, z, qx, qy, qz, qw) at stamps: linear translation, shortest turn, held beyond the ends."""
    q = ("qx", "qy", "qz", "qw")
    j, t = _between(stamps, poses, key, ("x", "y", "z", *q))
    turned = G.slerp([F.col(f"b.{c}") for c in q], [F.col(f"a.{c}") for c in q], t)
    return j.select(key, F.col("_t").alias("stamp"), *[_lerp(c, t) for c in "xyz"], *[v.alias(c) for v, c in zip(turned, q, strict=True)])


def interpolate_poses(stamps: DataFrame, poses: DataFrame, key: str) -> DataFrame:
    """Planar poses (x, y, yaw) at stamps, linear between neighbours, held beyond the ends."""
    j, t = _between(stamps, poses, key, ("x", "y", "yaw"))
    return j.select(key, F.col("_t").alias("stamp"), _lerp("x", t), _lerp("y", t), G.slerp_yaw(F.col("b.yaw"), F.col("a.yaw"), t).alias("yaw"))


def nearest_pose(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(query_id, map_id, d): the nearest base pose in the plane, ties to the smaller id; poses that are not finite take no part.

    Through a pivot index over the plane: bounded rings are equi-joined in blocks, so a far query meets the map's nearest
    rings and never the whole of it in one task.
    """
    from placerec.operators import metric as X

    at = F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("at")
    ix = X.index(base.select(F.col("scan_id").alias("map_id"), at), "map_id", "at", 2, lambda name, df: df)
    return X.nearest(queries.select(F.col("scan_id").alias("query_id"), at), ix, 1, "query_id", "map_id", "at").select("query_id", "map_id", F.col("distance").alias("d"))


def monotonic_violations(rows: DataFrame, key: str, order: str, stamp: str = "stamp") -> DataFrame:
    """Rows whose stamp doesn't rise above the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("previous", F.lag(stamp).over(w)).where(F.col(stamp) <= F.col("previous"))


def rolling_submaps(frames: DataFrame, key: str, order, n: int = 10) -> DataFrame:
    """(key, submap_id, k, member...): each frame with the n - 1 before it; the incomplete start has none."""
    w = Window.partitionBy(key).orderBy(*order)
    f = frames.withColumn("k", F.row_number().over(w) - 1)
    ends = f.where(F.col("k") >= n - 1).select(key, F.col("k").alias("submap_id"), F.explode(F.sequence(F.col("k") - (n - 1), F.col("k"))).alias("k"))
    return ends.join(f, [key, "k"])


def causal_submaps(targets: DataFrame, scans: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n latest scans up to each target's stamp; targets with fewer are passed over."""
    w = Window.partitionBy(key).orderBy("_t", "_side", "_id")
    s = scans.select(key, F.col("stamp").alias("_t"), F.lit(0).alias("_side"), F.col("scan_id").alias("_id"))
    t = targets.select(key, F.col("stamp").alias("_t"), F.lit(1).alias("_side"), F.col("target_id").alias("_id"))
    before = F.sum(F.when(F.col("_side") == 0, F.lit(1)).otherwise(F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    j = s.unionByName(t).withColumn("k", before)
    ends = j.where((F.col("_side") == 1) & (F.col("k") >= n)).select(key, F.col("_id").alias("target_id"), F.explode(F.sequence(F.col("k") - (n - 1), F.col("k"))).alias("k"))
    return ends.join(j.where(F.col("_side") == 0).select(key, "k", F.col("_id").alias("scan_id"), F.col("_t").alias("scan_stamp")), [key, "k"])


def half_split(rows: DataFrame, key: str, order) -> DataFrame:
    """role: the first half (rounded down) of each track is the map, the rest are queries."""
    w = Window.partitionBy(key)
    return rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("role", F.when(F.col("_k") <= F.floor(F.count("*").over(w) / 2), F.lit("map")).otherwise(F.lit("query"))).drop("_k")


def se2_sums(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Closed-form planar fit (yaw, tx, ty) of (sx, sy) onto (x, y), by sums alone; ``w`` weighs rows."""
    w = F.col("w")
    s = pairs.groupBy(*key).agg(F.sum("w").alias("n"), *[F.sum(w * F.col(c)).alias(f"s_{c}") for c in ("sx", "sy", "x", "y")], *[F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a in ("sx", "sy") for b in ("x", "y")])
    m = lambda c: F.col(f"s_{c}") / F.col("n")
    cov = lambda a, b: F.col(f"s_{a}{b}") / F.col("n") - m(a) * m(b)
    yaw = F.atan2(cov("sx", "y") - cov("sy", "x"), cov("sx", "x") + cov("sy", "y"))
    s = s.withColumn("yaw", yaw)
    c, n = F.cos("yaw"), F.sin("yaw")
    return s.select(*key, "yaw", (m("x") - (c * m("sx") - n * m("sy"))).alias("tx"), (m("y") - (n * m("sx") + c * m("sy"))).alias("ty"))


def robust_se2(pairs: DataFrame, key: list[str], scale: float = 0.5, rounds: int = 10) -> DataFrame:
    """Planar fit of least soft-L1 loss of each component's residual, from the closed form by reweighted Gauss-Newton steps.

    Each round is one aggregation of the normal equations. Input: (sx, sy, x, y).
    """
    fit = se2_sums(pairs.withColumn("w", F.lit(1.0)), key)
    for _ in range(rounds):
        c, s = F.cos("yaw"), F.sin("yaw")
        px, py = c * F.col("sx") - s * F.col("sy"), s * F.col("sx") + c * F.col("sy")
        d = pairs.join(fit, key).select(*key, "yaw", "tx", "ty", (-py).alias("jx"), px.alias("jy"), (px + F.col("tx") - F.col("x")).alias("ex"), (py + F.col("ty") - F.col("y")).alias("ey"))
        for k in "xy":
            d = d.withColumn(f"w{k}", 1 / F.sqrt(1 + F.col(f"e{k}") * F.col(f"e{k}") / (scale * scale)))
        w = lambda k, *of: F.sum(math.prod([F.col(f"w{k}"), *[F.col(x) for x in of]], start=F.lit(1.0)))
        n = d.groupBy(*key, "yaw", "tx", "ty").agg(
            (w("x", "jx", "jx") + w("y", "jy", "jy")).alias("_a"), w("x", "jx").alias("_b"), w("y", "jy").alias("_c"), w("x").alias("_nx"), w("y").alias("_ny"),
            (w("x", "jx", "ex") + w("y", "jy", "ey")).alias("_g"), w("x", "ex").alias("_gx"), w("y", "ey").alias("_gy"),
        )
        # translations are eliminated: the normal matrix is an arrow
        turn = F.coalesce(F.try_divide(F.col("_g") - F.col("_b") * F.col("_gx") / F.col("_nx") - F.col("_c") * F.col("_gy") / F.col("_ny"), F.col("_a") - F.col("_b") * F.col("_b") / F.col("_nx") - F.col("_c") * F.col("_c") / F.col("_ny")), F.lit(0.0))
        n = n.withColumn("_turn", turn)
        fit = n.select(*key, (F.col("yaw") - F.col("_turn")).alias("yaw"), (F.col("tx") - (F.col("_gx") - F.col("_b") * F.col("_turn")) / F.col("_nx")).alias("tx"), (F.col("ty") - (F.col("_gy") - F.col("_c") * F.col("_turn")) / F.col("_ny")).alias("ty"))
    return fit


def se3_fit(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of least squares (SVD), for the few points that one task holds."""
    ms, mt = source.mean(0), target.mean(0)
    u, _, vt = np.linalg.svd((source - ms).T @ (target - mt))
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ d @ u.T
    return r, mt - r @ ms


def lever_fit(positions: np.ndarray, rotations: np.ndarray, truth: np.ndarray, rounds: int = 12):
    """(rotation, translation, lever arm, rmse) that bring body positions with a fixed arm onto the truth, by turns."""
    lever = np.zeros(3)
    for _ in range(rounds):
        r, t = se3_fit(positions + rotations @ lever, truth)
        turned = (r @ rotations).reshape(-1, 3)
        lever = np.linalg.lstsq(turned, (truth - positions @ r.T - t).ravel(), rcond=None)[0]
    error = (positions + rotations @ lever) @ r.T + t - truth
    return r, t, lever, float(np.sqrt((error**2).sum(1).mean()))


def _rotations(q: np.ndarray) -> np.ndarray:
    """(n, 3, 3) of unit quaternions x, y, z, w."""
    x, y, z, w = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1).reshape(-1, 3, 3)


def clock_offset_grid(source: DataFrame, truth: DataFrame, key: str, span: float = 3.0, step: float = 0.25, fine: float = 0.05, tolerance: float = 0.1, least: int = 50) -> DataFrame:
    """(key, offset, rmse, n, yaw, lever array): the clock offset of the truth with the best rigid fit and lever arm.

    A grid over -span .. span first, then a finer one around the best. Each source pose (stamp, x, y, z, qx .. qw) meets the
    nearest truth position (stamp, x, y, z), the later of equals, within the tolerance; offsets with under ``least`` pairs are
    passed over, and a track without any other is left out. A recording of one track fits a task.
    """

    def solve(k, a, b):
        import pandas as pd

        a, b = a.sort_values("stamp"), b.sort_values("_stamp")
        stamp, pos, rot = a["stamp"].to_numpy(float), a[["x", "y", "z"]].to_numpy(float), _rotations(a[["qx", "qy", "qz", "qw"]].to_numpy(float)) if len(a) else None
        ref, at = b["_stamp"].to_numpy(float), b[["_x", "_y", "_z"]].to_numpy(float)
        best = None
        if len(a) >= least and len(b) >= 2:
            for grid in (np.arange(-span, span + step / 25, step), None):
                if grid is None:
                    if best is None:
                        break
                    grid = np.arange(best[0] - step, best[0] + step + fine / 5, fine)
                for offset in grid:
                    t = ref + offset
                    i = np.clip(np.searchsorted(t, stamp), 1, len(t) - 1)
                    i = i - (np.abs(t[i - 1] - stamp) < np.abs(t[i] - stamp))
                    ok = np.abs(t[i] - stamp) < tolerance
                    if ok.sum() < least:
                        continue
                    r, _, lever, rmse = lever_fit(pos[ok], rot[ok], at[i[ok]])
                    if best is None or rmse < best[1]:
                        best = (float(offset), rmse, int(ok.sum()), float(np.arctan2(r[1, 0], r[0, 0])), lever.tolist())
        columns = [key, "offset", "rmse", "n", "yaw", "lever"]
        return pd.DataFrame([(k[0], *best)] if best else [], columns=columns)

    # other names, as both sides may come from one table
    names = {"_key": key, "_stamp": "stamp", "_x": "x", "_y": "y", "_z": "z"}
    truth = truth.select(*[F.col(c).alias(n) for n, c in names.items()])
    return source.groupBy(key).cogroup(truth.groupBy("_key")).applyInPandas(solve, f"{key} {source.schema[key].dataType.simpleString()}, offset double, rmse double, n bigint, yaw double, lever array<double>")


#: Source points, of all yaws together, that are looked up at once.
MOVED = 1 << 15


def _rounds(s: np.ndarray, near: Raster, turns: np.ndarray, rounds: int, gate: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(yaw, tx, ty) of each row of ``turns`` after rounds of nearest neighbours within the gate and closed-form planar fits, and the median distance of all points.

    All in the raster's units.
    """
    ones, turns, medians = np.vstack([s.T, np.ones(len(s))]), turns.copy(), np.full(len(turns), np.inf)
    sums = np.ascontiguousarray(ones.T)

    def moved(at):
        c, n = np.cos(turns[at, 0]), np.sin(turns[at, 0])
        return np.column_stack([c, -n, turns[at, 1]]) @ ones, np.column_stack([n, c, turns[at, 2]]) @ ones

    wide = max(1, MOVED // len(s))
    for first in range(0, len(turns), wide):
        every = at = np.arange(first, min(first + wide, len(turns)))
        lost = np.zeros(len(turns), bool)
        for _ in range(rounds):
            x, y, d = near.nearest(*moved(at))
            w = (d < gate * gate).astype(float)
            x *= w
            y *= w
            ax, ay, n = (w @ sums).T
            (bxx, bxy, bx), (byx, byy, by) = (x @ sums).T, (y @ sums).T
            # under ``least`` partners there is no fit
            on = n >= least
            lost[at[~on]] = True
            n = np.maximum(n, 1)
            yaw = np.arctan2((byx - by * ax / n) - (bxy - bx * ay / n), (bxx - bx * ax / n) + (byy - by * ay / n))
            c, k = np.cos(yaw), np.sin(yaw)
            fit = np.column_stack([yaw, (bx - c * ax + k * ay) / n, (by - k * ax - c * ay) / n])
            # from the same place the same partners and the same fit follow: nothing changes any more
            on &= (fit != turns[at]).any(1)
            at = at[on]
            turns[at] = fit[on]
            if not len(at):
                break
        every = every[~lost[every]]
        if len(every):
            medians[every] = _medians(near, *moved(every))
    return turns, medians


def _medians(near: Raster, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The median distance of each row of points from their nearest ones."""
    d = np.sqrt(near.nearest(x, y)[2])
    out = np.median(d, axis=1)
    # outside of the raster distances are too great: that tells only where half of the points are beyond its margin
    for i in np.flatnonzero(np.partition(d, d.shape[1] // 2, axis=1)[:, d.shape[1] // 2] > near.margin):
        out[i] = np.median(Grid(np.column_stack([near.x, near.y])).nearest(np.column_stack([x[i], y[i]]))[1])
    return out


def icp_planar(s: np.ndarray, t: np.ndarray, seeds: int = 180, least: int = 50) -> tuple[float, float, float, float]:
    """(yaw, tx, ty, median): centroids joined and ``seeds`` yaws tried, 8 rounds at 1.5 m each; the best refined by 25 at 0.6 m."""
    # about the middles of both sides, in the raster's units
    at, to = s.mean(0), t.mean(0)
    near = Raster(t - to, 1.5)
    unit, middle = near.size, -near.low / near.size
    s = (s - at) / unit
    turns, medians = _rounds(s, near, np.column_stack([np.arange(seeds) * 2 * np.pi / seeds, np.tile(middle, (seeds, 1))]), 8, 1.5 / unit, least)
    best = int(medians.argmin())
    start = turns[[best]] if medians[best] < np.inf else np.array([[0.0, *((at - to) / unit + middle)]])
    ((yaw, *m),), (median,) = _rounds(s, near, start, 25, 0.6 / unit, least)
    c, k = np.cos(yaw), np.sin(yaw)
    x, y = (np.array(m) - middle) * unit + to - [c * at[0] - k * at[1], k * at[0] + c * at[1]]
    return float(np.arctan2(k, c)), float(x), float(y), float(median * unit)


def icp2d(source: DataFrame, target: DataFrame, key: str = "scan_id", seeds: int = 180, least: int = 50) -> DataFrame:
    """(key, yaw, tx, ty, median): planar registration of each source scan onto the target scan of the same key, a task a scan.

    A scan is bounded; one that has no counterpart, or never has ``least`` points within the gate, has an infinite median.
    """

    def solve(k, a, b):
        import pandas as pd

        s, t = a[["x", "y"]].to_numpy(float), b[["_x", "_y"]].to_numpy(float)
        row = (k[0], *icp_planar(s, t, seeds, least)) if len(s) and len(t) else (k[0], 0.0, 0.0, 0.0, np.inf)
        return pd.DataFrame([row], columns=[key, "yaw", "tx", "ty", "median"])

    return source.select(key, "x", "y").groupBy(key).cogroup(target.select(F.col(key).alias("_key"), F.col("x").alias("_x"), F.col("y").alias("_y")).groupBy("_key")).applyInPandas(solve, f"{key} {source.schema[key].dataType.simpleString()}, yaw double, tx double, ty double, median double")


def checked_pairs(rows: DataFrame, used: str, dt: str = "dt", tolerance: float | None = None) -> DataFrame:
    """As-of pairs that must be one to one: a partner used twice, or one beyond the tolerance, is an error."""
    from placerec.operators.relational import assert_none

    if tolerance is not None:
        assert_none(rows.where(F.col(dt) > tolerance), "a pair is too far apart in time")
    assert_none(rows.groupBy(used).count().where("count > 1"), "a partner is used twice")
    return rows


def positional_join(poses: DataFrame, clouds: DataFrame, gravity: DataFrame, key: str = "scan_id") -> DataFrame:
    """Pose, cloud and up vector of the same number; a number that one of them lacks is an error."""
    from placerec.operators.relational import assert_none

    ids = lambda d: d.select(key).distinct()
    for other, what in ((clouds, "clouds"), (gravity, "gravity")):
        assert_none(ids(poses).join(ids(other), key, "left_anti").unionByName(ids(other).join(ids(poses), key, "left_anti")), f"poses and {what} differ in number")
    return poses.join(clouds, key).join(gravity, key)


def admitted(entries: DataFrame, *columns: str) -> DataFrame:
    """Entries whose stamp and pose are finite; the others are dropped without a word."""
    return entries.where(F.coalesce(G.finite(*[F.col(c) for c in columns]), F.lit(False)))


def truth_of_submaps(submaps: DataFrame, truth: DataFrame, key: str = "submap_id", tolerance: float = 1e-6) -> DataFrame:
    """Each submap with its truth, one to one: a missing one, a second one or another stamp is an error."""
    from placerec.operators.relational import assert_none

    t = truth.withColumnRenamed("stamp", "truth_stamp")
    assert_none(truth.groupBy(key).count().where("count > 1"), "a submap has two truths")
    out = submaps.join(t, key, "left")
    assert_none(out.where(F.col("truth_stamp").isNull() | (F.abs(F.col("truth_stamp") - F.col("stamp")) > tolerance)), "stamps of submap and truth differ")
    return out


def common_origin(*fixes: DataFrame) -> DataFrame:
    """One row (lat0, lon0): the mean of the valid fixes of all recordings together."""
    every = fixes[0]
    for f in fixes[1:]:
        every = every.unionByName(f)
    return every.where("status >= 0").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
