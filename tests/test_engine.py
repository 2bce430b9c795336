"""Properties of descriptors and retrieval, kernels against plain loops, sources and sinks, streaming against batch."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placerec.config import DescriptorConfig
from placerec.functions import geom as G
from placerec.operators import descriptor as D
from placerec.operators import evaluate as E
from placerec.operators import kernels as N
from placerec.operators import match as R
from placerec.operators import points as P
from placerec.operators import trajectory as T
from placerec.operators import vertical as V

SF = "/root/testdata/sf0.001"
CFG = DescriptorConfig(rings=4, sectors=12, max_radius=20.0, dual_layer=True, shortlist=3, search_ratio=0.2, height_offset=2.0, min_joint_rings=1, split_min=1.0, split_max=4.0, min_keyframes=5, vertical_min=-2.0, vertical_max=2.0)


def cloud(spark, scans):
    """A point at the middle of each chosen cell: {scan: {(ring, sector): [heights]}}."""
    rows = []
    for scan, cells in scans.items():
        for (ring, sector), heights in cells.items():
            r, a = (ring + 0.5) * 5.0, (sector + 0.5) * math.pi / 6
            rows += [(scan, len(rows) + k, r * math.cos(a), r * math.sin(a), h) for k, h in enumerate(heights)]
    return spark.createDataFrame(rows, "scan_id long, ord long, x double, y double, z double")


def scene(seed):
    rng = random.Random(seed)
    return {(r, s): [rng.uniform(0, 2.4), rng.uniform(2.6, 5)] for r in range(4) for s in range(12) if rng.random() < 0.7}


def direct_distance(q, m, shift, cfg, upper_may_lack):
    """The dual-layer distance by loops over cells: q, m are {(layer, ring, sector): h}."""
    off, S = cfg.height_offset, cfg.sectors
    m = {(l, r, (s + shift) % S): h for (l, r, s), h in m.items()}
    total = score = 0.0
    for layer, w in ((0, cfg.lower_weight), (1, cfg.upper_weight)):
        if w <= 0:
            continue
        a, b = ({k: h for k, h in x.items() if k[0] == layer} for x in (q, m))
        if not a and not b and (layer == 0 or upper_may_lack):
            continue
        col = lambda x, s: {k[1]: h + off for k, h in x.items() if k[2] == s}
        sim, eff = 0.0, 0
        for s in range(S):
            u, v = col(a, s), col(b, s)
            j = set(u) & set(v)
            if len(j) < cfg.min_joint_rings:
                continue
            uu, vv = sum(u[r] ** 2 for r in j), sum(v[r] ** 2 for r in j)
            if uu <= 1e-24 or vv <= 1e-24:
                continue
            sim += sum(u[r] * v[r] for r in j) / math.sqrt(uu * vv) * len(j) / math.sqrt(len(u) * len(v))
            eff += 1
        sq, sm = (sum(len(col(x, s)) >= cfg.min_joint_rings for s in range(S)) for x in (a, b))
        if not eff:
            return 1.0
        d = 1 - sim / eff * (eff / math.sqrt(sq * sm)) ** cfg.support_exponent
        total, score = total + w, score + w * d
    return score / total if total > 1e-12 else None


@pytest.mark.parametrize("weights,lack", [((0.3, 0.7), False), ((0.3, 0.7), True), ((0.0, 1.0), False), ((1.0, 0.0), False)])
def test_exact_distance_equals_loops(spark, weights, lack):
    cfg = CFG.with_(lower_weight=weights[0], upper_weight=weights[1], min_joint_rings=2)
    scans = {i: scene(i) for i in range(4)} | {4: {k: [h[0]] for k, h in scene(4).items()}, 5: {k: [h[0]] for k, h in scene(5).items()}}
    cells = D.envelope_cells(cloud(spark, scans), cfg).cache()
    held = {}
    for r in cells.collect():
        held.setdefault(r.scan_id, {})[(r.layer, r.ring, r.sector)] = r.h
    turned = spark.createDataFrame([(q, m, s) for q in scans for m in scans for s in (0, 5)], "query_id long, map_id long, shift int")
    omit = spark.createDataFrame([(i, lack) for i in scans], "scan_id long, omittable boolean")
    got = {(r.query_id, r.map_id, r["shift"]): r.distance for r in R.exact_distances(turned, cells, cells, cfg, omit).collect()}
    for q in scans:
        for m in scans:
            for s in (0, 5):
                want = direct_distance(held[q], held[m], s, cfg, lack)
                assert (q, m, s) not in got if want is None else got[(q, m, s)] == pytest.approx(want, abs=1e-9), (q, m, s)


def test_retrieval_finds_itself_and_the_turn(spark):
    base = {i: scene(i) for i in range(6)}
    turned = {100 + i: {(r, (s + 4) % 12): h for (r, s), h in c.items()} for i, c in base.items()}
    m, q = D.envelope_cells(cloud(spark, base), CFG), D.envelope_cells(cloud(spark, turned), CFG)
    for r in R.retrieve(q, m, CFG).where("rank = 1").collect():
        assert (r.map_id, r["shift"]) == (r.query_id - 100, 4) and abs(r.distance) < 1e-9
    own = R.retrieve(m, m, CFG).where("rank = 1").collect()
    assert all(r.query_id == r.map_id and r["shift"] == 0 and abs(r.distance) < 1e-9 for r in own)


def test_descriptor_ignores_copies_and_order(spark):
    p = cloud(spark, {0: scene(3)})
    a = D.envelope_cells(p, CFG)
    b = D.envelope_cells(p.unionByName(p).orderBy(F.rand(1)), CFG)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert D.envelope_cells(p.limit(0), CFG).isEmpty() and D.envelope_cells(p.withColumn("x", F.lit(500.0)), CFG).isEmpty()


def test_vertical_shift_recovers_an_offset(spark):
    cells = D.envelope_cells(cloud(spark, {0: scene(8)}), CFG)
    q = cells.select((F.col("scan_id") + 1).alias("scan_id"), "layer", "ring", "sector", (F.col("h") - 0.4).alias("h"))
    hyp = spark.createDataFrame([(1, 0, 0)], "query_id long, map_id long, shift int")
    none = cells.limit(0).select("scan_id", "ring", "sector")
    out = V.vertical_shift(V.residuals(hyp, q, cells, none, none, CFG), CFG).first()
    assert out.dz == pytest.approx(0.4)


def direct_shift(res, cfg):
    """The trimmed weighted median by loops over (layer, residual, stability)."""
    kept = []
    for layer, w in ((0, cfg.lower_weight), (1, cfg.upper_weight)):
        rows = sorted((r for r in res if r[0] == layer), key=lambda r: r[2] if layer == 0 else -r[2])
        if rows and w > 0:
            kept += [(r[1], w) for r in rows[: max(1, math.ceil(cfg.stable_fraction * len(rows)))]]
    run, half = 0.0, sum(w for _, w in kept) / 2
    for value, w in sorted(kept):
        run += w
        if run >= half - 1e-9:
            return value if cfg.vertical_min <= value <= cfg.vertical_max else 0.0
    return 0.0


def test_vertical_shift_equals_loops(spark):
    a, b = D.envelope_cells(cloud(spark, {0: scene(8), 1: scene(9), 2: {(0, 0): [0.5]}}), CFG), D.envelope_cells(cloud(spark, {5: scene(12), 6: scene(13)}), CFG)
    none = a.limit(0).select("scan_id", "ring", "sector")
    hyps = [(q, m, s) for q in (0, 1, 2) for m in (5, 6) for s in (0, 3, 7)]
    h = spark.createDataFrame(hyps, "query_id long, map_id long, shift int")
    got = {(r.query_id, r.map_id, r.shift): r.dz for r in V.vertical_shift(V.residuals(h, a, b, none, none, CFG), CFG, h).collect()}
    qs, ms = ({(r.scan_id, r.layer, r.ring, r.sector): r.h for r in x.collect()} for x in (a, b))
    assert set(got) == set(hyps)
    for q, m, s in hyps:
        res = []
        for (scan, layer, ring, sector), h in ms.items():
            if scan == m and (v := qs.get((q, layer, ring, (sector + s) % 12))) is not None:
                res.append((layer, h - v, max(h, v) if layer == 0 else min(h, v)))
        assert got[q, m, s] == pytest.approx(direct_shift(res, CFG))


def test_coordinate_hash_orders_as_unsigned(spark):
    rng = np.random.default_rng(4)
    xyz = rng.uniform(-50, 50, (300, 3))
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "scan_id long, ord long, x double, y double, z double")
    mm, wrap = np.rint(xyz * 1000).astype(int).tolist(), 1 << 64
    keys = [(x * P.HASH_X % wrap) ^ (y * P.HASH_Y % wrap) ^ (z * P.HASH_Z % wrap) for x, y, z in mm]
    want = sorted(range(300), key=keys.__getitem__)[:40]
    assert sorted(r.ord for r in P.point_cap(df, 40).collect()) == sorted(want)


def test_unit_scaling_turns_about(spark):
    df = spark.createDataFrame([(0, i, float(x), 0.0, 0.0) for i, x in enumerate((1, 2, 6))], "scan_id long, ord long, x double, y double, z double")
    assert sorted(r.x for r in P.centred_unit(df).collect()) == pytest.approx([-0.75, 0.25, 0.5])


def test_yaw_hypotheses_keep_apart(spark):
    rows = [(1, 1, s, d) for s, d in ((3, 0.1), (4, 0.11), (7, 0.3), (2, 0.12))]
    h = R.yaw_hypotheses(spark.createDataFrame(rows, "query_id long, map_id long, shift int, distance double"), CFG).first().hyps
    assert [x["shift"] for x in h] == [3, 4, 7]  # 3 and 7 apart, then the best of the rest; by distance


def test_gravity_turns_up_to_z(spark):
    ups = [(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, -1.0), (2, 0.6, 0.0, 0.8), (3, 0.0, 0.0, 0.0), (4, 3.0, 0.0, 4.0)]
    g = spark.createDataFrame(ups, "scan_id long, ux double, uy double, uz double")
    p = g.select("scan_id", F.lit(0).alias("ord"), F.col("ux").alias("x"), F.col("uy").alias("y"), F.col("uz").alias("z"))
    out = {r.scan_id: r for r in P.level(p, g).collect()}
    assert 3 not in out and all(abs(r.x) < 1e-9 and abs(r.y) < 1e-9 and r.z > 0.99 for r in out.values())


def test_split_is_off_with_few_keyframes(spark):
    h = D.height_histogram(cloud(spark, {0: {(0, 0): [0.5], (1, 1): [4.9]}}), CFG)
    assert not D.adaptive_split(h, 1, CFG).first().enabled
    assert D.adaptive_split(h, 9, CFG).first().split == pytest.approx(2.5, abs=0.01)


def test_config_is_checked():
    for bad in ({"rings": 0}, {"sectors": 5000}, {"max_radius": -1.0}, {"lower_weight": -0.1}, {"lower_weight": 0.0, "upper_weight": 0.0}, {"split_height": math.nan}):
        with pytest.raises(ValueError):
            DescriptorConfig(**bad)
    assert DescriptorConfig(sectors=50).search_radius == 3 and CFG.compatible(CFG.with_(shortlist=9)) and not CFG.compatible(CFG.with_(rings=5))


def test_wrap(spark):
    a = [0.0, math.pi, -math.pi, 3 * math.pi, 7.0, -7.0, float("nan"), float("inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in a], "a double").select(G.wrap(F.col("a"))).collect()]
    want = [0.0, math.pi, math.pi, math.pi, math.remainder(7, math.tau), math.remainder(-7, math.tau), 0.0, 0.0]
    assert got == pytest.approx(want)


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 0.0), (2, 5.0)], "k int, stamp double")
    right = spark.createDataFrame([(1, 8.0, "a"), (1, 12.0, "b")], "k int, stamp double, v string")
    for tie, v in (("earlier", "a"), ("later", "b")):
        got = {(r.k, r.stamp): r.ref_v for r in T.asof_nearest(left, right, "k", tie=tie).collect()}
        assert got == {(1, 10.0): v, (1, 0.0): "a", (2, 5.0): None}
    assert T.asof_nearest(left, right, "k", tolerance=2.0).count() == 1


def test_robust_fit_passes_over_outliers(spark):
    rng = np.random.default_rng(0)
    s = rng.uniform(-20, 20, (80, 2))
    t = s @ np.array([[math.cos(0.4), math.sin(0.4)], [-math.sin(0.4), math.cos(0.4)]]) + [3, -1]
    t[:6] += 15
    df = spark.createDataFrame([(0, *map(float, a), *map(float, b)) for a, b in zip(s, t)], "g int, sx double, sy double, x double, y double")
    r = T.robust_se2(df, ["g"]).first()

    def loss(v):
        u = s @ np.array([[math.cos(v[0]), math.sin(v[0])], [-math.sin(v[0]), math.cos(v[0])]]) + v[1:] - t
        return (np.sqrt(1 + (u / 0.5) ** 2) - 1).sum()

    at = np.array([r.yaw, r.tx, r.ty])
    assert all(loss(at) <= loss(at + e * h) + 1e-9 for e in np.eye(3) for h in (-1e-3, 1e-3))  # a minimum of the soft-L1 loss of each component
    assert r.yaw == pytest.approx(0.4, abs=0.02) and (r.tx, r.ty) == pytest.approx((3, -1), abs=0.3)


def test_clock_offset_grid_and_icp(spark):
    rng = np.random.default_rng(1)
    xyz, q = rng.normal(size=(120, 3)).cumsum(0), rng.normal(size=(120, 4))
    rot = T._rotations(q)
    arm, turn = np.array([0.3, -0.2, 0.5]), T._rotations(np.array([[0.1, 0.2, 0.3, 0.9]]))[0]
    ref = (xyz + rot @ arm) @ turn.T + [1, 2, 3]
    src = spark.createDataFrame([(1, i * 0.5, *map(float, p), *map(float, o)) for i, (p, o) in enumerate(zip(xyz, q))] + [(2, 0.0, *[0.0] * 6, 1.0)], "k long, stamp double, x double, y double, z double, qx double, qy double, qz double, qw double")
    truth = spark.createDataFrame([(1, i * 0.5 - 1.3, *map(float, p)) for i, p in enumerate(ref)], "k long, stamp double, x double, y double, z double")
    out = T.clock_offset_grid(src, truth, "k").collect()
    assert len(out) == 1 and out[0].offset == pytest.approx(1.3, abs=0.09) and out[0].rmse < 1e-6 and out[0].lever == pytest.approx(arm.tolist(), abs=1e-5)
    pts = rng.uniform(-10, 10, (150, 2))
    c, s = math.cos(0.3), math.sin(0.3)
    frame = lambda x: spark.createDataFrame([(7, *map(float, p)) for p in x], "scan_id long, x double, y double")
    best = T.icp2d(frame(pts @ [[c, s], [-s, c]] + [4, 1]), frame(pts)).first()
    assert best.median < 1e-6 and best.yaw == pytest.approx(-0.3, abs=1e-6)


def test_mcnemar_is_the_binomial_tail(spark):
    rows = [("m", 1, 0)] * 9 + [("m", 0, 1)] * 2 + [("m", 1, 1)] * 5 + [("e", 1, 1)] * 3
    got = {r.method: r for r in E.mcnemar(spark.createDataFrame(rows, "method string, a int, b int"), "a", "b", "method").collect()}
    assert got["m"].p == pytest.approx(2 * sum(math.comb(11, i) for i in range(3)) / 2**11) and got["e"].p == 1.0


def test_kernels_equal_plain_loops():
    """Projections, features and scores point by point, from their definitions."""
    rng = np.random.default_rng(6)
    p = rng.normal(size=(70, 3)) * [5, 2, 1]
    rows, far = [], np.linalg.norm(p, axis=1).max()
    for a in np.linspace(-math.pi / 2, math.pi / 2, 4):
        for e in np.linspace(0, math.pi / 2, 16):
            n = np.array([math.cos(e) * math.cos(a), math.cos(e) * math.sin(a), math.sin(e)])
            u = np.array([1.0, 0, 0]) - n[0] * n
            v, hist = np.cross(n, u), np.zeros((8, 16))
            for q in p:
                x, y = q @ u, q @ v
                ring = next(i for i in range(8) if math.hypot(x, y) < far * ((i + 1) / 8) ** 2 + (0.001 if i == 7 else 0))
                hist[ring, min(int((math.atan2(y, x) + math.pi) / (2 * math.pi) * 16), 15)] += 1 / len(p)
            rows.append(hist.ravel())
    left, _, right = np.linalg.svd(np.array(rows), full_matrices=False)
    want = np.concatenate([left[:, 0], right[0]])
    want *= 1 if want[:64][np.abs(want[:64]).argmax()] >= 0 else -1
    assert N.m2dp_vector(p) == pytest.approx(want, abs=1e-9)
    f = N.local_features(p)
    for i in (0, 13, 69):
        near = p[np.argsort(((p - p[i]) ** 2).sum(1), kind="stable")[:30]]
        w = np.sort(np.linalg.eigvalsh(np.cov(near.T)))[::-1]
        flat, s = np.sort(np.linalg.eigvalsh(np.cov(near[:, :2].T))), w / w.sum()
        assert f[i] == pytest.approx([s[2], np.cbrt(w.prod() / w.sum() ** 3), -(s * np.log(s)).sum(), flat[0] / flat[1], np.ptp(near[:, 2]), near[:, 2].var()], abs=1e-9)
    a, b = rng.normal(size=(2, 6, 8, 8))
    curve = [sum(abs(np.fft.ifft(np.fft.fft(a[c, :, k], norm="ortho") * np.conj(np.fft.fft(b[c, :, k], norm="ortho")), norm="ortho")[s]) for c in range(6) for k in range(8)) for s in range(8)]
    assert N.circular_score(a, b) == (pytest.approx(max(curve) / (0.15 * 6 * 8 * 8)), int(np.argmax(curve)))


def test_kernels_are_invariant():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(200, 3)) * [5, 2, 1]
    a, _ = N.pca_frame(p)
    assert np.abs(np.diff(a.var(0))).min() > 0 and (np.diff(a.var(0)) < 0).all()
    v = N.m2dp_vector(a)
    assert v.shape == (192,) and np.linalg.norm(v[:64]) == pytest.approx(1)
    f = N.local_features(p)
    assert (N.local_features(p[:20]) == 0).all() and (f[:, 0] >= 0).all()
    t = N.radon_spectrum(N.bev(p / 20, f, 24), 24)
    s, turn = N.circular_score(t, np.roll(t, 5, axis=1))
    assert turn in (5, 19, 7, 17) and s == pytest.approx(N.circular_score(t, t)[0])


# --- sources and sinks


def test_clouds_round_trip(spark, tmp_path):
    from placerec.sources import pcd

    rows = [(i, k, float(k), -1.5, 2.0 + i, 0.25) for i in range(3) for k in range(5)]
    df = spark.createDataFrame(rows, pcd.POINT)
    for suffix in ("pcd", "bin"):
        at = str(tmp_path / suffix)
        assert pcd.write_clouds(df, at, suffix).count() == 3
        back = pcd.read_clouds(spark, at, strict=True, contiguous=True)
        assert sorted(map(tuple, back.collect())) == rows
    (tmp_path / "bin" / "7.bin").write_bytes(np.array([np.nan, 0, 0, 1], "<f4").tobytes())
    assert pcd.read_clouds(spark, str(tmp_path / "bin")).count() == 15
    with pytest.raises(ValueError):
        pcd.read_clouds(spark, str(tmp_path / "bin"), contiguous=True)
    head = b"# c\nFIELDS x y z t\nSIZE 8 4 4 2\nTYPE F F F U\nPOINTS 1\nDATA "
    assert float(pcd.decode_pcd(head + b"ascii\n1.5 2 3 4\n")["x"][0]) == 1.5
    for bad in (head + b"binary\nxx", b"junk", head.replace(b"x y z", b"a b c") + b"ascii\n1 2 3 4\n"):
        with pytest.raises(ValueError):
            pcd.decode_pcd(bad)
    with pytest.raises(ValueError):
        pcd.decode_pcd(head + b"binary\n" + bytes(18), strict=True)


def test_text_sources(spark, tmp_path):
    from placerec.sources import tables as S

    w = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    t = S.read_tum(spark, w("t.txt", "1.0 1 2 3 0 0 0 2\n\n2.5 1 2 3 0 0 1 1\n"))
    assert [r.scan_id for r in t.collect()] == [0, 1] and t.first().qw == 1.0
    S.write_tum(t, str(tmp_path / "out"))
    assert [pytest.approx(tuple(r), abs=1e-8) for r in S.read_tum(spark, str(tmp_path / "out")).collect()] == [tuple(r) for r in t.collect()]
    for bad in ("1 2 3\n", "2 0 0 0 0 0 0 1\n1 0 0 0 0 0 0 1\n"):
        with pytest.raises(ValueError):
            S.read_tum(spark, w("bad.txt", bad))
    g = S.read_gravity(spark, w("g.csv", "query_id,stamp,up_x,up_y,up_z\n0,1.0,0,0,2\n1,2.0,3,0,4\n"))
    assert [tuple(r)[2:] for r in g.orderBy("scan_id").collect()] == [(0, 0, 1), (0.6, 0, 0.8)]
    for bad in ("index,stamp,up_x,up_y,up_z\n1,1.0,0,0,2\n", "index,stamp,up_x,up_y,up_z\n0,1.0,0,0,0\n", "a,b\n1,2\n"):
        with pytest.raises(ValueError):
            S.read_gravity(spark, w("bad.csv", bad))
    m = S.read_query_meta(spark, w("m.csv", "query_id,window,start_s,points,file,truth_valid,truth_x,truth_y,track\n1,2,0.5,9,a.bin,Yes,1,2,h\n2,3,0.6,9,b.bin,0,,,h\n"))
    assert [(r.truth_valid, r.truth_x) for r in m.collect()] == [(True, 1.0), (False, None)]
    p = S.read_pose_csv(spark, w("p.csv", "stamp_ns,x,y,z,qx,qy,qz,qw\n2000000000,1,0,0,0,0,0,1\n1000000000,5,0,0,0,0,0,1\n2000000000,9,0,0,0,0,0,1\n"))
    assert [(r.stamp, r.x) for r in p.collect()] == [(1.0, 5.0), (2.0, 1.0)]
    assert S.read_gnss(spark, w("f.csv", "stamp,status,lat,lon,alt,cov_xx,cov_yy,cov_zz\n1,0,30,114,5,1,1,1\n2,-1,30,114,5,1,1,1\n")).count() == 1
    assert [tuple(r)[:2] for r in S.read_imu(spark, w("i.csv", "# h\n0,10,500000000,1,2,3,4,5,6\n1,2\n")).collect()] == [(10.5, 1.0)]
    assert S.read_indices(spark, w("n.txt", "0\n3\n9\n")).count() == 3
    with pytest.raises(ValueError):
        S.read_indices(spark, w("n2.txt", "3\n3\n"))
    log = w("l.log", "time=1.5 fitness=0.25\nnoise\n")
    assert [tuple(r) for r in S.scan_logs(spark, log, {"t": r"time=([\d.]+)", "f": r"fitness=([\d.]+)"}).collect()] == [(1.5, 0.25)]
    with pytest.raises(ValueError):
        S.scan_logs(spark, log, {"t": "x(y)"}, alarm="noise")
    q, c = spark.createDataFrame([(1,), (2,)], "query_index int"), spark.createDataFrame([(1, 1), (1, 2)], "query_index int, candidate_rank int")
    assert sorted(map(tuple, S.timing(q, c).collect())) == [(1, None, 2), (2, None, 0)]
    S.candidate_csv(c.select(*[F.col(n) if n in c.columns else F.lit(0.0).alias(n) for n in R.CANDIDATE_COLUMNS]), str(tmp_path / "cand"))
    assert spark.read.csv(str(tmp_path / "cand"), header=True).count() == 2
    S.write_manifest(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "man"))
    assert S.read_manifest(spark, str(tmp_path / "man")).first().s == "a"
    assert S.file_digests(spark, str(tmp_path / "n.txt")).first().size == 6
    built = []

    def build(todo):
        built.append(todo.count())
        return todo

    cache = str(tmp_path / "cache")
    for n, new in ((3, 3), (5, 2), (5, 0)):
        built.clear()
        assert S.build_missing(spark, spark.range(n).withColumnRenamed("id", "scan_id"), cache, build).count() == n and sum(built) == new


def test_config_file():
    from placerec.sources.config_file import load_config

    head = "/**:\n  ros__parameters:\n    prior_map:\n      scan_context:\n"
    c = load_config(head + "        num_rings: 10  # x\n        dual_z_layer_enable: true\n        max_radius: 12.5\n        candidate_top_k: 100\n        retrieval_height_offset: 0.3\n        vertical_correction_max: 1.25\n")
    assert (c.rings, c.dual_layer, c.max_radius, c.sectors, c.shortlist, c.height_offset, c.vertical_max) == (10, True, 12.5, 60, 100, 0.3, 1.25)
    assert load_config("scan_context:\n  sectors: 30\n").sectors == 30 and load_config("scan_context:\n  sectors: 30\n", True).gravity_canonicalized
    for bad in (head + "        unknown: 3\n", "other:\n  a: 1\n"):
        with pytest.raises(ValueError):
            load_config(bad)


def test_config_defaults_of_the_method():
    c = DescriptorConfig()
    assert (c.rings, c.sectors, c.max_radius, c.dual_layer, c.height_offset, c.min_joint_rings, c.shortlist, c.yaw_top_k, c.distance_threshold) == (20, 60, 80.0, False, 0.1, 2, 5, 3, 0.5)
    assert (c.split_min, c.split_max, c.histogram_max, c.min_keyframes, c.boundary_margin, c.vertical_min, c.vertical_max, c.stable_fraction) == (1.5, 4.5, 8.0, 20, 0.1, -1.5, 1.5, 0.5)
    assert not c.compatible(c.with_(gravity_canonicalized=True))


def test_descriptor_database_versions(spark, tmp_path):
    from placerec.sources import descriptor_db as S

    params = {"rings": 1, "sectors": 3, "max_radius": 20.0, "dual_layer": True, "split_height": 2.5, "origin_height": 0.5, "lower_weight": 0.3, "upper_weight": 0.7, "min_joint_rings": 1, "gravity": True}
    entries = [{"stamp": 1.25, "x": 0.1, "y": 2.0, "z": 3.0, "roll": 0.0, "pitch": 0.0, "yaw": 0.5, "canonical_yaw": 0.7, "h": [1.0, math.nan, 0.0, 3.5, math.nan, 1 / 3]}]
    data = S.dump(params, entries)
    version, p, back = S.parse(data)
    assert version == 7 and p | {"offset": 0} == params | {"offset": 0} and np.array_equal(back[0]["h"], entries[0]["h"], equal_nan=True) and back[0]["canonical_yaw"] == 0.7
    assert S.parse(data.replace(b"MASK_BITS 1\n", b"MASK_BITS 1\r\n"))[2][0]["x"] == 0.1
    mask = bytes([0b101101])
    body = lambda tail, scalars="1 0 0 0 0 0 0.5": f"ENTRIES 1\nENTRY 0 {scalars}\nDESC\n3 0 2\n5 0 4\n".encode() + tail + b"END_ENTRY\n"
    bits = b"MASK_BITS 1\n" + mask + b"\n"
    head = lambda v, params: f"{S.MAGIC}{v}\nPARAMS {params}\n".encode()
    nan = math.nan
    cases = {
        1: (head(1, "1 3 20 2 1 2.5 0.3 0.7") + body(b""), [1, nan, 0, 3, nan, 2]),
        2: (head(2, "1 3 20 2 1 2.5 0.3 0.7 1") + body(b"MASK\n1 0 1\n1 1 1\n"), [1, nan, 0, 3, -2, 2]),
        3: (head(3, "1 3 20 2 1 2.5 0.3 0.7 1") + body(bits), [1, nan, 0, 3, nan, 2]),
        4: (head(4, "1 3 20 2 1 2.5 0.3 0.7 1 1") + body(bits, "1 0 0 0 0 0 0.5 0.9"), [1, nan, 0, 3, nan, 2]),
        5: (head(5, "1 3 20 1 2.5 0.3 0.7 1 1") + body(bits, "1 0 0 0 0 0 0.5 0.9"), [3, nan, 2, 5, nan, 4]),
        6: (head(6, "1 3 20 1 2.5 0.5 0.3 0.7 1 1") + body(bits, "1 0 0 0 0 0 0.5 0.9"), [3.5, nan, 2.5, 5.5, nan, 4.5]),
        7: (head(7, "1 3 20 1 2.5 0.5 0.3 0.7 1 1") + body(bits, "1 0 0 0 0 0 0.5 0.9"), [3, nan, 2, 5, nan, 4]),
    }
    for v, (raw, want) in cases.items():
        got, _, e = S.parse(raw)
        assert got == v and np.array_equal(e[0]["h"], np.array(want, float), equal_nan=True), v
        assert e[0]["canonical_yaw"] == (0.5 if v < 4 else 0.9)
        (tmp_path / f"{v}.scd").write_bytes(raw)
    for bad in (b"junk", data[:-20], data.replace(b"MASK_BITS 1", b"MASK_BITS 9"), data.replace(b"ENTRIES 1", b"ENTRIES 99999"), data.replace(b"PARAMS 1 3", b"PARAMS 9999 3"), data.replace(b" 1 1\nENTRIES", b" 1 2\nENTRIES")):
        with pytest.raises((ValueError, KeyError)):
            S.parse(bad)
    df = S.read(spark, str(tmp_path))
    assert df.count() == 7 and S.cells_of(df).where("h is null").count() == 0 and S.cells_of(df).count() == 4 * 6 + 5
    assert S.convert(str(tmp_path / "2.scd"), str(tmp_path / "c")) == 1 and S.parse((tmp_path / "c").read_bytes())[0] == 7
    S.write(str(tmp_path / "m"), params, entries * 4)
    S.subset(str(tmp_path / "m"), str(tmp_path / "s"), [0, 2])
    assert len(S.parse((tmp_path / "s").read_bytes())[2]) == 2
    with pytest.raises(ValueError):
        S.subset(str(tmp_path / "m"), str(tmp_path / "s"), [2, 1])


# --- streaming


def test_streams_equal_batch(spark):
    from placerec import domain as M
    from placerec.plans import trajectories
    from placerec.streaming import plans

    a = sorted((r.track_id, r.event_id) for r in plans.stream_keyframes(spark, SF).collect())
    b = sorted((r.track_id, r.event_id) for r in trajectories.keyframes(spark, SF).collect())
    assert a == b and a
    a = sorted((r.track_id, r.target_id, r.scan_id) for r in plans.stream_history(spark, SF).collect())
    b = sorted((r.track_id, r.target_id, r.scan_id) for r in trajectories.submap_causal(spark, SF).collect())
    assert a == b
    found = plans.stream_retrieval(spark, SF).where("rank = 1")
    assert found.count() == M.descriptors(spark, SF).where("vec_id % 10 = 0").count()


def test_topic_index_scan_returns_every_click_in_order(spark, tmp_path):
    from placerec.plans import relational

    rows = [(i, i % 7, "click" if i % 3 else "view", (i * 7919) % 2500) for i in range(2500)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s int")
    events.selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(s) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in relational.topic_index_scan(spark, str(tmp_path)).collect()]
    assert got == [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[3], r[0])) if r[2] == "click"]


def test_joins_with_checks_raise(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "scan_id long, stamp double")
    same = a.withColumnRenamed("scan_id", "submap_id")
    assert T.truth_of_submaps(same, same.withColumn("t", F.lit(1))).count() == 2 and T.positional_join(a, a.select("scan_id"), a.select("scan_id")).count() == 2
    for bad in (
        lambda: T.truth_of_submaps(same, same.withColumn("stamp", F.col("stamp") + 1e-3)), lambda: T.truth_of_submaps(same, same.limit(1)),
        lambda: T.truth_of_submaps(same, same.unionByName(same)), lambda: T.positional_join(a, a.limit(1).select("scan_id"), a.select("scan_id")),
        lambda: T.checked_pairs(spark.createDataFrame([(1, 0.1), (1, 0.2)], "ref long, dt double"), "ref"), lambda: T.checked_pairs(spark.createDataFrame([(1, 9.0)], "ref long, dt double"), "ref", tolerance=1.0),
    ):
        with pytest.raises(ValueError):
            bad()


def test_gate_results_and_settings(spark, tmp_path):
    from placerec.sources import tables as S

    a = spark.createDataFrame([("m", 0.5, None), ("k", 0.25, 1.0)], "method string, r double, s double")
    assert E.gate(a, a, "method", ["r", "s"]).count() == 2
    for other in (a.limit(1), a.withColumn("r", F.col("r") + 1e-3), a.fillna(2.0)):
        with pytest.raises(ValueError):
            E.gate(a, other, "method", ["r", "s"])
    S.write_results(a.withColumnRenamed("method", "algorithm"), str(tmp_path / "r"))
    kind = "algorithm string, r double, s double"
    assert S.read_results(spark, str(tmp_path / "r"), kind, "m").first().r == 0.5
    with pytest.raises(ValueError):
        S.read_results(spark, str(tmp_path / "r"), kind, "absent")
    assert S.settings({"A": "7", "B": "yes", "C": ""}, {"A": 1, "B": False, "C": 2.5}) == {"A": 7, "B": True, "C": 2.5}


def test_full_candidates(spark):
    """A scan turned by three sectors and lifted by 0.3 m finds itself, with its turn and its height."""
    cells = D.envelope_cells(cloud(spark, {0: scene(3), 1: scene(4), 2: scene(5)}), CFG)
    up = cells.select("scan_id", "layer", "ring", ((F.col("sector") + 3) % 12).cast("int").alias("sector"), (F.col("h") + 0.3 * (F.col("layer") * 0 + 1)).alias("h"))
    e = spark.createDataFrame([(i, *map(float, range(8))) for i in range(3)], "scan_id long, stamp double, x double, y double, z double, roll double, pitch double, yaw double, canonical_yaw double")
    cfg = CFG.with_(vertical_estimation=True, boundary_margin=-1.0)
    out = R.retrieve_full(e, e, up, cells, cfg)
    assert out.columns == [*R.CANDIDATE_COLUMNS, "yaw_matches"]
    best = {r.query_index: r for r in out.where("candidate_rank = 1").collect()}
    assert all(best[i].candidate_index == i and best[i].sector_shift == 3 and best[i].vertical_shift == pytest.approx(-0.3) and len(best[i].yaw_matches) == 3 for i in range(3))


def test_nearest_pose_reaches_far_ones(spark):
    rng = np.random.default_rng(7)
    q, m = np.concatenate([rng.uniform(0, 30, (40, 2)), [[5000.0, -7000.0]]]), rng.uniform(0, 30, (25, 2))
    m[3] = m[4]  # a tie
    frame = lambda x: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(900, math.nan, 0.0)], "scan_id long, x double, y double")
    got = {r.query_id: (r.map_id, r.d) for r in T.nearest_pose(frame(q), frame(m)).collect()}
    d = np.round(np.sqrt(((q[:, None] - m[None]) ** 2).sum(2)), 9)
    assert got == {i: (int(d[i].argmin()), pytest.approx(d[i].min())) for i in range(len(q))}
    assert T.nearest_pose(frame(q), frame(m).limit(0)).count() == 0


@pytest.mark.parametrize("rows", [2, 5])
def test_pairs_in_blocks_equal_a_broadcast_base(spark, monkeypatch, rows):
    rng = random.Random(5)
    keys = lambda lo, hi: spark.createDataFrame([(i, [rng.choice([0.0, 1.0, 2.5]) for _ in range(4)] if i % 7 else None) for i in range(lo, hi)], "scan_id long, key array<double>")
    q, m = keys(0, 23), keys(100, 141)
    runs = lambda: [sorted(map(tuple, R.ring_shortlist(q, m, 3).collect())), sorted((r.a, r.b, r.rank, r.distance) for r in R.top_k(q.select(F.col("scan_id").alias("a"), F.col("key").alias("u")), m.select(F.col("scan_id").alias("b"), F.col("key").alias("v")), F.coalesce(R.l2("u", "v"), F.lit(9.0)), 2, "a", "b").collect())]
    sent = runs()
    monkeypatch.setattr(R, "SEND_BYTES", 0)
    monkeypatch.setattr(R, "BLOCK_ROWS", rows)
    assert runs() == sent and len(sent[0]) == 3 * 19 and len(sent[1]) == 2 * 23
    plan = R.ring_shortlist(q, m, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    empty = m.where("scan_id < 0")
    assert R.ring_shortlist(q, empty, 3).count() == 0 == R.ring_shortlist(empty, m, 3).count()
