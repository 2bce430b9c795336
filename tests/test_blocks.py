"""Block searches against plain loops, rankings by rounded distances, and tables that are folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placerec.operators import blocks as B


def frame(spark, v, key, vec):
    return spark.createDataFrame([(int(i), None if x is None else [float(y) for y in x]) for i, x in v], f"{key} long, {vec} array<double>")


def plain(q, m, k, kind):
    """The k nearest of each query by loops over pairs."""
    out = []
    for i, a in q:
        got = []
        for j, b in m:
            less, more = sum((x - y) ** 2 for x, y in zip(a, b)), sum((x + y) ** 2 for x, y in zip(a, b))
            dot, aa, bb = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a), sum(y * y for y in b)
            d = {"squared": less, "l2": less**0.5, "cosine": -dot / max((aa * bb) ** 0.5, 1e-12), "sign_invariant": min(less, more) ** 0.5}[kind]
            got.append((round(d, 9), j))
        out += [(i, r + 1, j, -d if kind == "cosine" else d) for r, (d, j) in enumerate(sorted(got)[:k])]
    return out


@pytest.mark.parametrize("kind", sorted(B.KINDS))
@pytest.mark.parametrize("rows", [7, 4096])
def test_blocks_equal_plain_loops(spark, monkeypatch, kind, rows):
    monkeypatch.setattr(B, "ROWS", rows)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5)).round(1)
    v[40:50] = v[3]  # copies: ties by id
    v[50] = -v[3]
    q, m = [(i, v[i].tolist()) for i in range(0, 60, 4)], [(i, v[i].tolist()) for i in range(60) if i % 4]
    got = B.nearest(frame(spark, q, "q", "a"), frame(spark, [*m, (90, None), (91, [float("nan")] * 5)], "c", "b"), 6, "q", "c", "a", "b", kind).collect()
    got, want = sorted((r.q, r["rank"], r.c, r.distance) for r in got), sorted(plain(q, m, 6, kind))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-9)
    assert B.nearest(frame(spark, q, "q", "a"), frame(spark, m[:2], "c", "b"), 6, "q", "c", "a", "b", kind).count() == 2 * len(q)
    assert B.nearest(frame(spark, q, "q", "a"), frame(spark, m, "c", "b").limit(0), 6, "q", "c", "a", "b", kind).count() == 0


def test_candidates_and_two_stages_keep_vectors_out_of_sorts(spark):
    """Pairs of all vectors were sorted with the vectors themselves: no plan may cross the tables any more."""
    from placerec.plans import evaluation, retrieval

    for query in (evaluation.ranks, retrieval.two_stage_topk, retrieval.cosine_topk, retrieval.sign_invariant_topk, retrieval.l2_topk):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoopJoin" not in plan


def test_first_right_rows_are_counted_without_a_cut(spark, monkeypatch, tmp_path):
    """Recall at 100 looked at ten candidates only."""
    from placerec.plans import evaluation

    monkeypatch.setattr(B, "ROWS", 17)
    rng = np.random.default_rng(16)
    v = rng.normal(size=(150, 4)).round(1)
    v[60:90] = v[5]  # copies: ties by id
    label = rng.integers(0, 50, 150)
    label[:150:40] = 99  # the places of queries that no other row shares
    q, m = [i for i in range(150) if i % 10 == 0], [i for i in range(150) if i % 10]
    want = {}
    for i in q:
        order = sorted((round(float(((v[i] - v[j]) ** 2).sum()), 9), j) for j in m)
        want |= {i: r + 1 for r, (_, j) in reversed(list(enumerate(order))) if label[j] == label[i]}
    side = lambda ids, key, vec, x, y: spark.createDataFrame([(i, v[i].tolist(), float(label[i]), 0.0) for i in ids], f"{key} long, {vec} array<double>, {x} double, {y} double")
    got = B.first_right(side(q, "q", "a", "tx", "ty"), side(m, "c", "b", "x", "y"), 0.5, "q", "c", "a", "b")
    assert {r.q: r.first_rank for r in got.collect()} == want and max(want.values()) > 100
    spark.createDataFrame([(i, int(label[i]), v[i].tolist()) for i in range(150)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    r = evaluation.recall_at_k(spark, str(tmp_path)).first()
    assert r.n == 15 and r.recall_at_100 > r.recall_at_10
    assert r.recall_at_100 == pytest.approx(sum(x <= 100 for x in want.values()) / 15, abs=1e-6)


def test_streamed_table_may_be_a_folder(spark, tmp_path):
    from placerec.streaming import plans

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = lambda d: sorted(tuple(r) for r in plans.stream_retrieval(spark, d).collect())
    assert rows(str(tmp_path)) == rows(sf) != []


def test_bearings_beside_the_y_axis(spark):
    """The JVM's atan2 put this point into the next sector."""
    import math

    from placerec.functions import geom as G

    at = [(-0.000000000000000666, 22.669804999999997), (0.000000000000000666, -22.669804999999997), (0.0, 3.0), (0.0, -3.0), (-1e-12, 7.0), (2.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (-1.0, 2.0)]
    got = [r.b for r in spark.createDataFrame(at, "x double, y double").coalesce(1).select(G.bearing(F.col("x"), F.col("y")).alias("b")).collect()]
    want = [math.atan2(y, x) + (2 * math.pi if math.atan2(y, x) < 0 else 0) for x, y in at]
    assert got[:7] == want[:7] and got == pytest.approx(want, abs=1e-15)


def test_unit_up_vectors_stay_as_they_are(spark):
    """Dividing by a length of one and a last place moved points off the edges of sectors."""
    from placerec.operators import points as P

    n = (0.06**2 + 0.09**2 + 1.0) ** 0.5
    up = (0.06 / n, 0.09 / n, 1.0 / n)
    g = spark.createDataFrame([(1, *up)], "scan_id long, ux double, uy double, uz double")
    r = P.level(spark.createDataFrame([(1, -0.3, 4.0, 5.0)], "scan_id long, x double, y double, z double"), g).first()
    assert r.z == up[0] * -0.3 + up[1] * 4.0 + up[2] * 5.0


@pytest.mark.parametrize("radius", [None, 1])
def test_turned_contexts_equal_the_operators(spark, radius):
    from placerec.operators import descriptor as D
    from placerec.operators import match as R

    rng = np.random.default_rng(8)
    cells = [(i, r, s, float(rng.integers(1, 40)) * 0.025) for i in range(14) for r in range(4) for s in range(6) if rng.random() < 0.6]
    c = spark.createDataFrame(cells, "scan_id long, ring int, sector int, h double").cache()
    q, m = c.where("scan_id % 2 = 1"), c.where("scan_id % 2 = 0")
    pairs = R.all_pairs(q.select(F.col("scan_id").alias("query_id")).distinct(), m.select(F.col("scan_id").alias("map_id")).distinct())
    keys = lambda x: D._dense(x.groupBy("scan_id", "sector").agg((F.sum("h") / 4).alias("v")), "sector", 6)
    turned = R.turns_near(pairs, 6, 3) if radius is None else R.turns_near(R.coarse_yaw(pairs, keys(q), keys(m), 6), 6, 1).drop("coarse")
    rows = lambda d: sorted((r.query_id, r.map_id, r["shift"], round(r.distance, 8)) for r in d.collect())
    out = B.turned_contexts(q, m, 4, 6, radius)
    assert rows(out) == rows(R.best_turn(R.context_distances(turned, q, m, 6))) and out.count() == 49
    assert "Generate explode(sequence(0, 5" not in out._jdf.queryExecution().toString()


def test_least_over_frames_equals_loops(spark):
    rng = np.random.default_rng(9)
    v = {(i, f): rng.normal(size=6) for i in range(10) for f in range(3)}
    v |= {(8, f): -v[3, f] for f in range(3)}
    df = spark.createDataFrame([(i, x.tolist()) for (i, _), x in v.items()], "scan_id long, v array<double>")
    got = {(r.query_id, r.map_id): r.distance for r in B.least_over_frames(df.where("scan_id % 2 = 1"), df.where("scan_id % 2 = 0")).collect()}
    want = {(i, j): min(np.linalg.norm(v[i, f] - s * v[j, g]) for f in range(3) for g in range(3) for s in (1, -1)) for i in range(1, 10, 2) for j in range(0, 10, 2)}
    assert got == pytest.approx(want, abs=2e-9) and got[3, 8] == 0


def test_two_stage_contexts_deal_keys_out_in_blocks(spark):
    """Each query met each root in a row of its own, and cells of all candidates were joined turn by turn."""
    from placerec.plans import retrieval

    plan = retrieval.scpp_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" in plan and "NestedLoopJoin" not in plan and "sector#" not in plan


def test_keys_of_roots_are_compared_without_a_row_for_each_root(spark, tmp_path):
    """Pairs were made once for each root and grouped again; a scan out of range had no key at all."""
    from placerec.plans import retrieval

    rng = np.random.default_rng(17)
    rows = [(s, i, 1, 1, float(rng.integers(1, 50)), float(rng.integers(900, 90000)), rng.integers(0, 10) / 100, rng.integers(0, 8) / 100) for s in range(8) for i in range(40)]
    rows += [(9, i, 1, 1, 900.0, 900.0, 0.05, 0.02) for i in range(5)]  # all beyond 30
    li = spark.createDataFrame([tuple(map(float, r[4:])) + tuple(map(int, r[:4])) for r in rows], "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_suppkey long, l_orderkey long, l_linenumber long, l_partkey long")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = {}
    for s in {r[0] for r in rows}:
        p = np.array([(r[4] - 25.3, r[5] / 2000 - 26.03, r[6] * 40 + r[7] * 12.5) for r in rows if r[0] == s])
        for root, dy in enumerate((0.0, -2.0, 2.0)):
            r = np.hypot(p[:, 0], p[:, 1] - dy)
            ring = np.minimum(r // 3.75, 7)
            keys[s, root] = np.array([p[(ring == i) & (r <= 30), 2].mean() if ((ring == i) & (r <= 30)).any() else 0.0 for i in range(8)])
    want = {(q, m): min(np.linalg.norm(keys[q, 0] - keys[m, r]) for r in range(3)) for q in (1, 3, 5, 7, 9) for m in (0, 2, 4, 6)}
    out = retrieval.scpp_min_root(spark, str(tmp_path))
    assert {(r.query_id, r.map_id): r.distance for r in out.collect()} == pytest.approx(want, abs=1e-6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "root_id" not in plan


def test_line_sums_turn_filled_cells_only():
    """A full turn of every image took 0.8 s at 120 cells a side."""
    import time

    from placerec.operators import kernels as N

    rng = np.random.default_rng(4)
    image = np.zeros((6, 120, 120))
    image[:, rng.integers(0, 120, 500), rng.integers(0, 120, 500)] = rng.random((6, 500))
    N.radon_spectrum(image, 120)
    began = time.process_time()
    got = N.radon_spectrum(image, 120)
    assert time.process_time() - began < 0.25
    for i in (0, 7, 61):
        cells, weights = N._turn(120, i * 2 * np.pi / 120)
        line = sum(image.reshape(6, -1)[:, c] * w for c, w in zip(cells, weights)).reshape(6, 120, 120).sum(1)
        assert np.allclose(got[:, i], np.abs(np.fft.fft(line, axis=1, norm="ortho")))


def test_raster_finds_the_nearest_points():
    from placerec.operators import neighbours as L

    rng = np.random.default_rng(12)
    clouds = [rng.uniform(-20, 20, (300, 2)), rng.integers(-4, 5, (200, 2)) * 1.0, np.repeat(rng.normal(size=(3, 2)), 40, 0), np.zeros((1, 2)), np.column_stack([np.arange(50.0), np.zeros(50)])]
    for t in clouds:
        r = L.Raster(t, 1.5)
        q = np.concatenate([rng.uniform(t.min(0) - 5, t.max(0) + 5, (2000, 2)), t])
        plain = ((q[:, None] - t[None]) ** 2).sum(2).min(1)
        x, y = ((q - r.low) / r.size).T
        px, py, d = (v[0] for v in r.nearest(x[None], y[None]))
        near = plain <= 1.5**2
        assert near.any() and d[near] * r.size**2 == pytest.approx(plain[near], abs=1e-9) and (d[~near] > r.margin**2).all()
        at = np.column_stack([px, py])[near] * r.size + r.low
        assert np.abs(at[:, None] - t[None]).max(2).min(1).max() < 1e-9


def test_planar_registration_tries_all_yaws_in_little_time():
    """180 yaws of a scan of 600 points took 1.2 s; all are tried still, with the results of plain loops."""
    import time

    from placerec.operators import trajectory as T

    def step(s, t, yaw, m, rounds, gate, least):
        fit = lambda: s @ np.array([[np.cos(yaw), np.sin(yaw)], [-np.sin(yaw), np.cos(yaw)]]) + m
        for _ in range(rounds):
            d = np.sqrt(((fit()[:, None] - t[None]) ** 2).sum(2))
            j, ok = d.argmin(1), d.min(1) < gate
            if ok.sum() < least:
                return yaw, m, np.inf
            a, b = s[ok] - s[ok].mean(0), t[j[ok]] - t[j[ok]].mean(0)
            yaw = np.arctan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a * b).sum())
            m = t[j[ok]].mean(0) - s[ok].mean(0) @ np.array([[np.cos(yaw), np.sin(yaw)], [-np.sin(yaw), np.cos(yaw)]])
        return yaw, m, np.median(np.sqrt(((fit()[:, None] - t[None]) ** 2).sum(2)).min(1))

    rng = np.random.default_rng(13)
    for noise, n in ((0.0, 120), (0.2, 120), (9.0, 120), (0.1, 60)):
        t = rng.uniform(-12, 12, (n, 2))
        s = (t + rng.normal(size=t.shape) * noise) @ np.array([[np.cos(2.0), np.sin(2.0)], [-np.sin(2.0), np.cos(2.0)]]) + [3, -8]
        best = (0.0, np.zeros(2), np.inf)
        for yaw in np.arange(180) * 2 * np.pi / 180:
            got = step(s, t, yaw, t.mean(0) - s.mean(0) @ np.array([[np.cos(yaw), np.sin(yaw)], [-np.sin(yaw), np.cos(yaw)]]), 8, 1.5, 50)
            best = got if got[2] < best[2] else best
        yaw, m, median = step(s, t, best[0], best[1], 25, 0.6, 50)
        got = T.icp_planar(s, t)
        assert got == pytest.approx((np.arctan2(np.sin(yaw), np.cos(yaw)), *m, median), abs=1e-7)
    t = rng.uniform(-25, 25, (600, 2))
    began = time.process_time()
    T.icp_planar(t, t)
    assert time.process_time() - began < 0.5


@pytest.mark.parametrize("grid", [6, 7])
def test_best_tensors_equal_scores_of_all_pairs(spark, monkeypatch, grid):
    """Whole tensors were copied and sorted for every pair; half of each row's spectrum is enough, in blocks."""
    from placerec.operators import kernels as N

    monkeypatch.setattr(B, "TENSOR_ROWS", 9)
    rng = np.random.default_rng(15)
    v = {i: N.instance_normalise(np.abs(np.fft.fft(rng.normal(size=(3, grid, grid)), axis=2))).astype(np.float32) for i in range(60)}
    for i in range(40, 50):
        v[i] = np.roll(v[i - 40], i % 3, 1)  # turned copies: ties by id
    v[50], v[52] = v[4], v[4]
    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in v.items()], "scan_id long, v array<float>")
    out = B.best_tensors(df.where("scan_id % 2 = 1"), df.where("scan_id % 2 = 0"), 4, grid)
    want = []
    for i in range(1, 60, 2):
        s = {j: N.circular_score(v[i].astype(float), v[j].astype(float)) for j in range(0, 60, 2)}
        want += [(i, r + 1, j, s[j][1]) for r, j in enumerate(sorted(s, key=lambda j: (-round(s[j][0], 6), j))[:4])]
    assert sorted((r.query_id, r["rank"], r.map_id, r.turn) for r in out.collect()) == want


def test_best_tensors_of_a_query_are_found_without_copying_whole_tensors(spark):
    from placerec.plans import retrieval

    plan = retrieval.ringpp_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoopJoin" not in plan and "SortMergeJoin" not in plan
