"""Stored maps, the pivot index, neighbours inside a scan, ordered streams, long tracks and files against plain loops."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from placerec import domain as M
from placerec.config import DescriptorConfig
from placerec.operators import descriptor as D
from placerec.operators import evaluate as E
from placerec.operators import kernels as N
from placerec.operators import match as R
from placerec.operators import metric as X
from placerec.operators import neighbours as L
from placerec.operators import points as P
from placerec.operators import stored as S
from placerec.operators import trajectory as T
from placerec.plans import retrieval as plans
from placerec.plans.pointwise import CFG
from placerec.sources import tables as files
from placerec.streaming import online
from placerec.streaming import ordered as O

SF = "/root/testdata/sf0.001"
POSES = ", ".join(f"{c} double" for c in S.POSE)


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and abs(p - q) < 1e-9) for p, q in zip(x, y)), (x, y)


# --- stored maps


def test_stored_map_gives_what_the_operators_give(spark):
    q, m = plans.sides(spark, SF)
    p = M.points(spark, SF)
    cells = [D.envelope_cells(p.where(f"scan_id % 2 = {k}"), CFG) for k in (1, 0)]
    names = ("query_id", "rank", "map_id", "distance", "shift")
    close(rows_of(S.retrieve(q, m), *names), rows_of(R.retrieve(*cells, CFG), *names))
    assert rows_of(m.cells.where("edge").select("scan_id", "ring", "sector").distinct(), "scan_id", "ring", "sector") == rows_of(D.boundary_mask(cells[1], CFG), "scan_id", "ring", "sector")
    again = S.open_map(spark, m.cells.inputFiles()[0].rsplit("/cells/", 1)[0])
    assert again.cfg == m.cfg and rows_of(again.entries, "scan_id", "x") == rows_of(m.entries, "scan_id", "x")


def test_stored_full_candidates_equal_the_operators(spark):
    q, m = plans.full_sides(spark, SF)
    cfg, p, e = plans.FULL_CFG, M.points(spark, SF), plans.entries(spark, SF)
    cells = D.envelope_cells(p, cfg)
    map_cells = cells.where("scan_id % 2 = 0 and (scan_id % 4 = 0 or layer = 0)")
    want = R.retrieve_full(e.where("scan_id % 2 = 1"), e.where("scan_id % 2 = 0"), cells.where("scan_id % 2 = 1"), map_cells, cfg)
    names = [c for c in R.CANDIDATE_COLUMNS if c != "retrieval_ms"]
    close(rows_of(S.retrieve_full(q, m), *names), rows_of(want, *names))


def scans(df):
    """File scans of a physical plan, and of those the ones that read stored cells or entries."""
    text = df._jdf.queryExecution().sparkPlan().toString()
    return text.count("FileScan"), text.count("FileScan parquet spark_catalog")


def test_retrieval_reads_few_tables(spark):
    """Plans read stored tables, never points: cells and entries of either side a few times, however many steps there are."""
    flagship, full = plans.flagship_retrieval(spark, SF), plans.retrieve_full(spark, SF)
    print(scans(flagship), scans(full))
    assert scans(flagship)[1] <= 6 and scans(full)[1] <= 12
    assert "l_quantity" not in flagship._jdf.queryExecution().optimizedPlan().toString() + full._jdf.queryExecution().optimizedPlan().toString()


def test_empty_scans_other_scoring_and_errors(spark, tmp_path):
    pts = spark.createDataFrame([(1, 3.0, 1.0, 0.5), (1, 4.0, 2.0, 3.0), (2, 500.0, 0.0, 0.0), (4, 2.0, 1.0, 0.2)], "scan_id long, x double, y double, z double")
    entries = spark.createDataFrame([(i, *([float(i)] * 8)) for i in (1, 2, 3, 4)], f"scan_id long, {POSES}")
    m = S.build(pts, entries, str(tmp_path / "a"), CFG, buckets=2)
    got = {r.scan_id: r for r in m.entries.collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[2].cells == got[3].cells == 0 and got[3].ring_key == [0.0] * 16 and not got[3].has_lower
    assert got[1].has_upper and got[1].cells == 2
    other = m.scored_by(CFG.with_(height_offset=1.0))
    a, b = ({r.scan_id: sum(r.ring_key or [0.0]) for r in x.entries.collect()} for x in (m, other))
    assert abs(a[1] - b[1] - 2 * 1.0 / 12) < 1e-9
    with pytest.raises(ValueError):
        m.scored_by(CFG.with_(rings=9))
    with pytest.raises(ValueError):
        S.build(pts, entries.where("scan_id < 4"), str(tmp_path / "b"), CFG, buckets=2)
    with pytest.raises(Exception, match="config"):
        S.open_map(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        S.session_entries(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "scan_id long, stamp double, x double, y double, z double, qx double, qy double, qz double, qw double"), spark.createDataFrame([(2, 0.0, 0.0, 1.0)], "scan_id long, ux double, uy double, uz double"))


def test_split_decides_for_the_whole_map(spark, tmp_path):
    """Too few scans with support: one layer; a fixed split: two, whatever the points say."""
    rng = random.Random(2)
    pts = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.3, 3.3]) + rng.random() * 0.4) for i in range(8) for _ in range(200)]
    df = spark.createDataFrame(pts, "scan_id long, x double, y double, z double")
    e = spark.createDataFrame([(i, *([0.0] * 8)) for i in range(8)], f"scan_id long, {POSES}")
    auto = S.build(df, e, str(tmp_path / "auto"), CFG.with_(split_auto=True), buckets=2)
    assert auto.cfg.dual_layer and auto.split["keyframes"] == 8 and 1.0 <= auto.cfg.split_height <= 3.3
    few = S.build(df, e, str(tmp_path / "few"), CFG.with_(split_auto=True, min_keyframes=9), buckets=2)
    assert not few.cfg.dual_layer and few.cells.where("layer = 1").isEmpty() and len(few.entries.first().ring_key) == 8
    fixed = S.build(df, e, str(tmp_path / "fixed"), CFG.with_(split_auto=True, min_keyframes=9), split=2.0, buckets=2)
    assert fixed.cfg.dual_layer and fixed.cfg.split_height == 2.0 and not fixed.cells.where("layer = 1").isEmpty()
    assert not S.retrieve(few, few).isEmpty()


def test_votes_as_bits_equal_votes_as_rows(spark):
    p = M.points(spark, SF)
    for cfg in (CFG, CFG.with_(histogram_bin=0.037)):
        votes, scans = D.histogram_totals(p, cfg)
        rows = {r.bin: r.n for r in D.height_histogram(p, cfg).collect()}
        assert votes == [rows.get(i, 0) for i in range(D.height_bins(cfg))] and scans == D.height_votes(p, cfg).select("scan_id").distinct().count()
    assert D.histogram_totals(p.limit(0), CFG) == ([0] * 60, 0)


# --- pivot index


def brute(q, b, k):
    out = []
    for i, v in q:
        d = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w))), j) for j, w in b if w is not None and len(w) == len(v))
        out += [(i, r + 1, j) for r, (_, j) in enumerate(d[:k])]
    return out


def indexed(spark, q, b, k, dims, **how):
    f = lambda rows, name: spark.createDataFrame(rows, f"{name} long, v{name} array<double>")
    ix = X.index(f(b, "c"), "c", "vc", dims, lambda name, df: df.cache(), **how)
    return ix, f(q, "q"), X.nearest(f(q, "q"), ix, k, "q", "c", "vq")


def test_pivot_index_equals_brute_force_on_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 20, (40, 8))
    b = [(i, (centres[i % 40] + rng.normal(0, 0.3, 8)).tolist()) for i in range(3000)]
    b += [(3000 + i, centres[0].tolist()) for i in range(1200)] + [(9000, None), (9001, [1.0]), (9002, [math.nan] * 8)]
    q = [(i, (centres[rng.integers(40)] + rng.normal(0, 0.3, 8)).tolist()) for i in range(60)] + [(98, centres[0].tolist()), (99, (centres[0] + 300).tolist())]
    ix, frame, got = indexed(spark, q, b, 5, 8)
    usable = [x for x in b if x[1] is not None and not any(map(math.isnan, x[1]))]
    assert rows_of(got, "q", "rank", "c") == sorted(brute(q, usable, 5))
    share = X.scored_share(frame, ix, 5, "q", "c", "vq").first()
    assert share.rows == 4200 and share.share < 0.3, share


@pytest.mark.parametrize("n", [0, 1, 3, 70])
def test_pivot_index_on_few_rows_and_ties(spark, n):
    b = [(i, [float(i % 3), 0.0]) for i in range(n)]
    q = [(0, [0.0, 0.0]), (1, [1.0, 5.0]), (2, None), (3, [math.inf, 0.0])]
    _, _, got = indexed(spark, q, b, 5, 2, pivots=4)
    assert rows_of(got, "q", "rank", "c") == sorted(brute(q[:2], b, 5))


# --- neighbours inside a scan


def test_leaves_and_grid_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    for n, k in ((30, 30), (31, 30), (700, 8), (900, 30)):
        p = np.concatenate([rng.normal(0, 1, (n - n // 3, 3)), rng.normal(3, 0.01, (n // 3, 3))])
        p[: n // 10] = p[0]
        d = ((p[:, None] - p[None]) ** 2).sum(2)
        seen = np.zeros(n, bool)
        for rows, near in L.Leaves(p, 16).own(k):
            seen[rows] = True
            for r, got in zip(rows, near):
                assert np.allclose(np.sort(d[r, got]), np.sort(d[r])[:k], rtol=0, atol=1e-12) and len(set(got.tolist())) == k
        assert seen.all()
    for n in (1, 2, 400):
        t = np.concatenate([rng.uniform(-30, 30, (n, 2)), rng.normal(5, 0.05, (n, 2))])
        q = np.concatenate([rng.uniform(-45, 45, (300, 2)), t[:1], [[400.0, -900.0]]])
        d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(2))
        for reach, pairs in ((np.inf, 1), (1.5, 1), (np.inf, 1 << 20), (1.5, 1 << 20)):
            monkeypatch.setattr(L, "PAIRS", pairs)
            at, dist = L.Grid(t, 0.7).nearest(q, reach)
            want = np.where(d.min(1) <= reach, d.argmin(1), -1)
            assert (at == want).all() and np.allclose(dist[at >= 0], d.min(1)[at >= 0])


def test_a_real_scan_fits_in_memory():
    rng = np.random.default_rng(6)
    r = rng.gamma(2, 6, 60_000)
    a = rng.uniform(0, 2 * np.pi, len(r))
    p = np.stack([r * np.cos(a) / 70, r * np.sin(a) / 70, rng.random(len(r))], 1)
    tracemalloc.start()
    f = N.local_features(p)
    L.Grid(p[:, :2] * 70).nearest(p[:, :2] * 70 + 0.1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert f.shape == (60_000, 6) and np.isfinite(f).all() and most < 300e6, most


# --- ordered streams


def events(spark, tmp_path, batches):
    schema = "track_id long, ts timestamp, type int, id long, a double, b double, c double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "track_id long, us long, type int, id long, a double, b double, c double").selectExpr("track_id", "timestamp_micros(us) ts", "type", "id", "a", "b", "c").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*"), spark.read.schema(schema).parquet(*[f"{tmp_path}/in/{i}" for i in range(len(batches))])


def wandering(rng, n=60):
    """Two tracks with equal stamps among them, then a row that moves the watermark past all."""
    rows = []
    for track in (1, 2):
        x = y = 0.0
        for i in range(n):
            x, y = x + rng.uniform(-1, 2), y + rng.uniform(-1, 2)
            rows.append((track, 1_000_000_000 + (i // 2) * 1_000_000 + track, int(rng.random() < 0.3), track * 1000 + i, x, y, rng.uniform(-3.1, 3.1)))
    return rows, (3, 400_000_000_000_000, 0, 9999, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("make", [lambda: O.Keyframes(3.0, 2.0), lambda: O.History(4), lambda: O.Replay(5.0, 12.0, 2.5, 0.2)], ids=["keyframes", "history", "replay"])
def test_ordered_streams_do_not_depend_on_arrival(spark, tmp_path, make):
    rows, last = wandering(random.Random(3))
    want = None
    for seed in (1, 2):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        # the watermark stays behind all of them until the last batch
        stream, rest = events(spark, tmp_path / f"{seed}", [mixed[:50], mixed[50:], [last], [(3, last[1] + 1_000_000, 0, 9998, 0.0, 0.0, 0.0)]])
        got = sorted(tuple(r) for r in online.drain(O.run(stream, make(), "100 days")).collect())
        plain = sorted(O.plain(rest.where("track_id < 3"), make()))
        assert [r for r in got if r[0] < 3] == plain and plain
        want = want or got
        assert got == want


def test_late_rows_are_dropped_and_waiting_ones_stay(spark, tmp_path):
    s = lambda sec, i: (1, sec * 1_000_000, 0, i, float(i) * 10, 0.0, 0.0)
    stream, _ = events(spark, tmp_path, [[s(100, 1), s(130, 2)], [s(131, 4)], [s(50, 3), s(90, 5), s(132, 6)]])
    got = sorted(r.event_id for r in online.drain(O.run(stream, O.Keyframes(1.0, 9.0), "20 seconds")).collect())
    # 50 and 90 lie behind the watermark of 110 when they come; 130 and what follows are not passed by it
    assert got == [1]


def test_clouds_of_a_stream_equal_a_batch(spark):
    q, m = plans.sides(spark, SF)
    from placerec.streaming.plans import stream_clouds

    names = ("query_id", "rank", "map_id", "distance", "shift")
    close(rows_of(stream_clouds(spark, SF), *names), rows_of(S.retrieve(q, m).withColumn("distance", F.round("distance", 6)), *names))


# --- tracks and poses


def test_keyframes_of_a_long_track(spark):
    n = 1_000_000
    track = spark.range(n, numPartitions=4).select(F.lit(1).alias("track_id"), F.col("id").cast("double").alias("stamp"), F.col("id").alias("event_id"), (F.sin(F.col("id") * 0.001) * 40).alias("x"), (F.col("id") * 0.0007).alias("y"))
    got = [r.event_id for r in T.spatial_keyframes(track, 2.5).orderBy("event_id").collect()]
    ids = np.arange(n)
    x, y = np.sin(ids * 0.001) * 40, ids * 0.0007
    want, lx, ly = [0], x[0], y[0]
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        if math.sqrt((a - lx) ** 2 + (b - ly) ** 2) >= 2.5:
            want.append(i)
            lx, ly = a, b
    assert got == want


def test_keyframes_of_many_tracks_in_small_batches(spark):
    rng = random.Random(8)
    rows = [(k, float(i), i, rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(7) for i in range(40)]
    want = set()
    for k in range(7):
        last = None
        for _, _, i, x, y in [r for r in rows if r[0] == k]:
            if last is None or math.hypot(x - last[0], y - last[1]) >= 4:
                want.add((k, i))
                last = (x, y)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = T.spatial_keyframes(spark.createDataFrame(rows, "track_id long, stamp double, event_id long, x double, y double"), 4.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {(r.track_id, r.event_id) for r in got} == want and len(got) == len(want)


def test_context_windows_equal_plain_loops(spark):
    rng, n, width, least, gap, split = random.Random(12), 12, 3, 4, 0.3, CFG.split_height
    rows = []
    for scan in range(12):
        for ring in range(6):
            for s in range(n):
                if rng.random() < (0.9 if scan else 0.02):
                    low, up = (rng.uniform(0, split) if rng.random() < 0.8 else None), (rng.uniform(split + 0.01, 5) if rng.random() < 0.6 else None)
                    if low is None and up is None:
                        continue
                    top = up + rng.choice([0, 0, 0.5, 1.0]) if up is not None else low
                    rows.append((scan, ring, s, top, low, up))
    got = {r.scan_id: r for r in D.detail_windows(spark.createDataFrame(rows, "scan_id long, ring int, sector int, top double, low double, up double"), CFG, width, least, gap).collect()}
    for scan in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == scan]
        inside = lambda s: [r for r in mine if (r[2] - s) % n < width]  # noqa: E731, B023
        apart = lambda s, taken: all(min((s - t) % n, (t - s) % n) >= width for t in taken if t >= 0)
        mixed = [sum(r[4] is not None and r[5] is not None for r in inside(s)) for s in range(n)]
        m = mixed.index(max(mixed))
        best, gaps = -1, 0
        for s in range(n):
            c = sum(r[5] is not None and r[3] > split and r[3] - r[5] > gap for r in inside(s))
            if apart(s, [m]) and c > gaps:
                best, gaps = s, c
        ratio = (-1, 0.0)
        for s in range(n):
            low, top = [r[4] for r in inside(s) if r[4] is not None], [r[3] for r in inside(s) if r[3] > split]
            if apart(s, [m, best]) and len(low) >= least and len(top) >= least and np.std(low) / (np.std(top) + 1e-6) > ratio[1] + 1e-12:
                ratio = (s, np.std(low) / (np.std(top) + 1e-6))
        r = got[scan]
        assert (r.mixed_start, r.mixed_cells, r.gap_start, r.gap_cells, r.ratio_start) == (m, max(mixed), best, gaps, ratio[0]) and abs(r.ratio - ratio[1]) < 1e-6
        if best >= 0:
            assert abs(r.gap_median - np.median([x[3] - x[5] for x in inside(best) if x[5] is not None and x[3] > split and x[3] - x[5] > gap])) < 1e-9


def test_errors_of_correct_candidates(spark):
    c = spark.createDataFrame([(1, 1, 1, 10.0, 3.0, 0.5, 0.0, 0.0, 1.0, 0.2), (1, 1, 2, 10.0, 0.0, 0.0, 9.0, 0.0, 1.0, 0.0), (1, 2, 1, 20.0, 1.0, 0.0, 9.0, 0.0, 5.0, 0.7), (1, 2, 2, 20.0, 1.0, 0.0, 0.5, 0.0, 2.0, -0.1), (1, 3, 1, 30.0, 0.0, 0.0, 50.0, 0.0, 0.0, 0.0)], "s int, query_id long, rank int, stamp double, yaw double, yaw_shift double, x double, y double, z double, vertical_shift double")
    t = spark.createDataFrame([(i, 0.0, 0.0, 1.5) for i in (1, 2, 3)], "query_id long, tx double, ty double, tz double")
    ref = spark.createDataFrame([(1, 9.9, -3.1), (1, 20.0, 0.0)], "s int, stamp double, yaw double")
    y = E.yaw_errors(c, E.first_correct_rank(c, t, 2.0), ref, "s").collect()
    assert [r.query_id for r in y] == [1] and abs(y[0].error - abs(math.remainder(2.5 + 3.1, 2 * math.pi))) < 1e-12 and abs(y[0].dt - 0.1) < 1e-9
    v = {r.query_id: r for r in E.vertical_errors(c, t, 2.0, 0.05).collect()}
    assert sorted(v) == [1, 2] and abs(v[1].error - (0.25 - 0.5)) < 1e-12 and abs(v[2].error - (-0.05 + 0.5)) < 1e-12


def test_intensity_and_point_times(spark):
    p = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.1, 10.0), (1, 2, 0.3, 0.1, 0.1, 30.0)], "scan_id long, ord long, x double, y double, z double, intensity double")
    r = P.voxel_centroids(p, 1.0).first()
    assert r.intensity == 20.0 and abs(r.x - 0.2) < 1e-12 and r.n == 2
    t = lambda times: [r.t for r in P.point_times(spark.createDataFrame([(1, i, 0.0, v) for i, v in enumerate(times)], "scan_id long, ord long, x double, t double")).orderBy("ord").collect()]
    assert t([5.0, 5.1]) == [0, 99999999] or t([5.0, 5.1]) == [0, 100000000]
    assert t([0.0, 50.0]) == [0, 50_000_000] and t([0.0, 50_000.0]) == [0, 50_000_000] and t([7.0, 50_000_007.0]) == [0, 50_000_000]
    assert t([0.0, math.nan, 1.0]) == t([2.0, 2.0, 2.0]) == t([0.0, 3e8, 1.0]) == [0, 49_999_999, 99_999_999] and t([None, 1.0]) == [0, 99_999_999] and t([4.0]) == [0]


def test_whole_poses_turn_points(spark):
    rng = np.random.default_rng(9)
    q = rng.normal(0, 1, (5, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    poses = spark.createDataFrame([(i, 1.0 * i, 2.0, 3.0, *map(float, v)) for i, v in enumerate(q)], "scan_id long, x double, y double, z double, qx double, qy double, qz double, qw double")
    pts = spark.createDataFrame([(i, 0.5, -1.0, 2.0) for i in range(5)], "scan_id long, x double, y double, z double")
    for r in P.to_world_full(pts, poses, (1.0, 1.0, 1.0)).collect():
        u, w, v = q[r.scan_id][:3], q[r.scan_id][3], np.array([0.5, -1.0, 2.0])
        want = v + 2 * np.cross(u, np.cross(u, v) + w * v) + [r.scan_id - 1.0, 1.0, 2.0]
        assert np.allclose([r.x, r.y, r.z], want)
    # halfway between two turns about one axis lies half the angle, along the shorter arc
    s = spark.createDataFrame([(1, 0.5), (1, -1.0), (1, 9.0)], "k int, stamp double")
    a = lambda deg: (0.0, 0.0, math.sin(math.radians(deg) / 2), math.cos(math.radians(deg) / 2))
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, *a(170)), (1, 1.0, 2.0, 4.0, 6.0, *(-c for c in a(-170)))], "k int, stamp double, x double, y double, z double, qx double, qy double, qz double, qw double")
    got = {r.stamp: r for r in T.interpolate_full(s, p, "k").collect()}
    assert abs(abs(got[0.5].qz) - 1) < 1e-9 and (got[0.5].x, got[0.5].y, got[0.5].z) == (1.0, 2.0, 3.0) and got[9.0].x == 2.0 and got[-1.0].x == 0.0


# --- files


def test_candidate_file_comes_back(spark, tmp_path):
    c = S.retrieve_full(*plans.full_sides(spark, SF))
    files.candidate_csv(c, f"{tmp_path}/candidates")
    names = [n for n in R.CANDIDATE_COLUMNS if n != "retrieval_ms"]
    back = files.read_candidates(spark, f"{tmp_path}/candidates")
    assert back.columns == R.CANDIDATE_COLUMNS
    close(rows_of(back, *names), rows_of(c, *names))
    t = files.timing(spark.createDataFrame([(1,), (10**6,)], "query_index long"), c).collect()
    assert {r.query_index: r.candidate_count for r in t} == {1: 5, 10**6: 0}


def test_two_stage_contexts_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    cfg = DescriptorConfig(rings=4, sectors=8, max_radius=30.0, search_ratio=0.15)
    images = {(i, r): np.where(rng.random((4, 8)) < 0.7, rng.uniform(0.5, 4, (4, 8)), 0.0) for i in range(12) for r in range(3)}
    rows = [(i, r, a, b, float(v[a, b])) for (i, r), v in images.items() for a in range(4) for b in range(8) if v[a, b] > 0]
    c = spark.createDataFrame(rows, "scan_id long, root_id int, ring int, sector int, h double")
    got = rows_of(R.scpp_retrieve(c.where("scan_id < 4"), c.where("scan_id >= 4"), cfg, 3), "query_id", "rank", "map_id", "root_id", "shift", "distance")

    def exact(a, b):
        turn = min(range(8), key=lambda s: (round(float(((a.mean(0) - np.roll(b.mean(0), s)) ** 2).sum()), 9), s))
        out = []
        for s in sorted({(turn + d) % 8 for d in range(-cfg.search_radius, cfg.search_radius + 1)}):
            t = np.roll(b, s, 1)
            ok = (np.linalg.norm(a, axis=0) > 0) & (np.linalg.norm(t, axis=0) > 0)
            out.append((round(1 - float(np.mean((a * t).sum(0)[ok] / (np.linalg.norm(a, axis=0) * np.linalg.norm(t, axis=0))[ok])), 9), s))
        return min(out)

    want = []
    for q in range(4):
        a = images[q, 0]
        frames = sorted((min(float(np.linalg.norm(images[m, r].mean(1) - a.mean(1))) for r in range(3)), m) for m in range(4, 12))[:3]
        found = sorted((*min((*exact(a, images[m, r]), r) for r in range(3)), m) for _, m in frames)
        found = sorted(found, key=lambda x: (x[0], x[3]))
        want += [(q, k + 1, m, r, s, d) for k, (d, s, r, m) in enumerate(found)]
    close(got, sorted(want))


@pytest.fixture(scope="module")
def database(spark):
    from placerec.sources import database_source

    database_source.register(spark)
    return spark


def test_databases_of_all_formats_are_read_in_ranges(database, tmp_path):
    from placerec.sources import descriptor_db as DB

    rng = np.random.default_rng(7)
    for version in range(1, 8):
        p = {"rings": 3, "sectors": 4, "max_radius": 30.0, "dual_layer": True, "split_height": 2.0, "origin_height": 0.5, "lower_weight": 0.3, "upper_weight": 0.7, "min_joint_rings": 2, "gravity": True}
        entries = [{"stamp": float(i), "x": i * 1.5, "y": -1.0, "z": 0.0, "roll": 0.0, "pitch": 0.1, "yaw": 0.2, "canonical_yaw": 0.3, "h": np.where(rng.random(24) < 0.6, rng.uniform(1, 3, 24), np.nan)} for i in range(23)]
        data = _as_format(DB.dump(p, entries), version)
        (tmp_path / f"v{version}.scd").write_bytes(data)
        _, _, want = DB.parse(data)
        for step in (97, 1000, 1 << 20):
            got = database.read.format("descriptor_db").option("rangeBytes", step).load(str(tmp_path / f"v{version}.scd")).orderBy("scan_id").collect()
            assert [r.scan_id for r in got] == list(range(23)), (version, step)
            for r, e in zip(got, want):
                assert r.x == e["x"] and np.array_equal(np.array([math.nan if v is None else v for v in r.h]), e["h"], equal_nan=True)
    with pytest.raises(Exception, match="ends early"):
        (tmp_path / "cut.scd").write_bytes(data[: len(data) * 2 // 3])
        database.read.format("descriptor_db").load(str(tmp_path / "cut.scd")).count()
    with pytest.raises(Exception, match="not a descriptor database"):
        (tmp_path / "other.scd").write_bytes(b"something else\n")
        database.read.format("descriptor_db").load(str(tmp_path / "other.scd")).count()


def _as_format(data, version):
    """A format 7 file written as an older format would hold it."""
    from placerec.sources import descriptor_db as DB

    _, p, entries = DB.parse(data)
    shift = {1: p["origin_height"], 2: p["origin_height"], 3: p["origin_height"], 4: p["origin_height"], 6: -p["origin_height"]}.get(version, 0.0)
    g = DB._g
    params = [str(p["rings"]), str(p["sectors"]), g(p["max_radius"]), *([g(0.5)] if version <= 4 else []), "1", g(p["split_height"]), *([g(p["origin_height"])] if version >= 6 else []), g(0.3), g(0.7), *(["2"] if version > 1 else []), *(["1"] if version >= 4 else [])]
    out = [f"{DB.MAGIC}{version}\nPARAMS {' '.join(params)}\nENTRIES {len(entries)}\n".encode()]
    for i, e in enumerate(entries):
        scalars = [e[c] for c in ("stamp", "x", "y", "z", "roll", "pitch", "yaw", *(["canonical_yaw"] if version >= 4 else []))]
        valid = ~np.isnan(e["h"])
        h = np.where(valid, e["h"] + shift, 0.0)
        body = f"ENTRY {i} {' '.join(map(g, scalars))}\nDESC\n{' '.join(map(g, h.tolist()))}\n".encode()
        if version == 2:
            body += b"MASK\n" + " ".join("1" if v else "0" for v in valid).encode() + b"\n"
        elif version > 2:
            bits = np.packbits(valid, bitorder="little").tobytes()
            body += f"MASK_BITS {len(bits)}\n".encode() + bits + b"\n"
        out.append(body + b"END_ENTRY\n")
    return b"".join(out)


def test_a_stored_map_goes_through_a_database(database, tmp_path):
    import json

    _, m = plans.sides(database, SF)
    rows, params = S.database_rows(m)
    at = str(tmp_path / "map.scd")
    rows.repartition(3).write.format("descriptor_db").option("params", json.dumps(params)).mode("overwrite").save(at)
    back = database.read.format("descriptor_db").option("rangeBytes", 5000).load(at)
    assert back.count() == m.entries.count() and sorted(p.name for p in tmp_path.iterdir()) == ["map.scd"]
    # entries are numbered in the order of their scans
    ids = [r.scan_id for r in m.entries.select("scan_id").orderBy("scan_id").collect()]
    again = S.from_database(back, str(tmp_path / "again"), CFG.max_radius, CFG, buckets=2)
    assert again.cfg == m.cfg
    close(rows_of(again.cells.withColumn("scan_id", F.element_at(F.array(*map(F.lit, ids)), F.col("scan_id").cast("int") + 1)), "scan_id", "layer", "ring", "sector", "h", "n"), rows_of(m.cells, "scan_id", "layer", "ring", "sector", "h", "n"))
    with pytest.raises(Exception, match="FileExists"):
        rows.write.format("descriptor_db").option("params", json.dumps(params)).mode("append").save(at)
    with pytest.raises(Exception, match="another shape"):
        rows.withColumn("h", F.slice("h", 1, 5)).write.format("descriptor_db").option("params", json.dumps(params)).mode("overwrite").save(at)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["again", "map.scd"] and database.read.format("descriptor_db").load(at).count() == len(ids)


def test_a_broken_build_goes_on_where_it_stopped(spark, tmp_path):
    asked = []

    def build(todo, fail_after=None):
        ids = sorted(r.scan_id for r in todo.select("scan_id").collect())
        if fail_after is not None and len(asked) >= fail_after:
            raise RuntimeError("killed")
        asked.append(ids)
        return todo.select("scan_id", (F.col("scan_id") * 2).alias("v"))

    wanted, at = spark.range(100).select(F.col("id").alias("scan_id")), str(tmp_path / "cache")
    with pytest.raises(RuntimeError):
        files.build_missing(spark, wanted, at, lambda t: build(t, 3), parts=8)
    first = {i for ids in asked for i in ids}
    # what a crash leaves behind a part that was never committed is not read
    spark.range(5).selectExpr("id scan_id", "-1L v").write.parquet(f"{at}/data/7-crashed")
    asked.clear()
    got = {r.scan_id: r.v for r in files.build_missing(spark, wanted, at, build, parts=8).collect()}
    assert got == {i: 2 * i for i in range(100)} and {i for ids in asked for i in ids} == set(range(100)) - first and len(first) > 0
    asked.clear()
    assert files.build_missing(spark, spark.range(103).select(F.col("id").alias("scan_id")), at, build, parts=8).count() == 103
    assert sorted(i for ids in asked for i in ids) == [100, 101, 102]
    asked.clear()
    assert files.build_missing(spark, wanted, at, build, parts=8).count() == 103 and not asked


def test_weighted_sums_that_end_in_a_half_go_up(spark):
    """Doubles added up lay below the half for some scans and above it for others, by the order of their cells."""
    from decimal import ROUND_HALF_UP, Decimal

    from placerec.plans import maps

    rng = np.random.default_rng(18)
    heights = rng.integers(0, 240, (300, 12, 16))  # in fortieths, as points of unlevelled scans have them
    keys = [[sum((k * 0.025 + 2.35) for k in column) / 16 for column in scan] for scan in heights.tolist()]
    exact = [sum((Decimal(k) / 40 + Decimal("2.35")) / 16 * (i + 1) for i, column in enumerate(scan) for k in column) for scan in heights.tolist()]
    want = [float(x.quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in exact]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, v array<double>").select("i", F.round(maps.weighted("v"), 6).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == want
    assert sum(x != x.quantize(Decimal("0.000001")) for x in exact) > 100
