"""Retrieval: ring-key shortlist, yaw alignment, exact dual-layer distance, ranking.

Cells of both sides meet in one inner equi-join on (layer, ring, turned sector): what a column
holds on its own does not depend on the turn, so it is counted once per entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from placerec.config import DescriptorConfig


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_l2(a, b))


def squared_l2(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)


#: Bytes of a side that may be sent to all; beyond it, rows and bytes of a block of either side.
SEND_BYTES, BLOCK_ROWS, BLOCK_BYTES = 64 << 20, 2048, 8 << 20

#: Queries of a task that compares them with every root.
ROOT_ROWS = 512


def _weight(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes at eight a value: the arrays' elements are counted, not guessed."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    values = sum((F.coalesce(F.size(c), F.lit(0)) for c in arrays), F.lit(len(df.columns)))
    n, v = df.agg(F.count("*"), F.sum(values.cast("long"))).first()
    return n, 8 * (v or 0)


def all_pairs(queries: DataFrame, base: DataFrame) -> DataFrame:
    """Every query beside every base row, as an exhaustive search needs them. Rows of a side should differ, in an id say.

    The base is weighed and sent to all if it is no more than ``SEND_BYTES``. A heavier one and the queries are dealt out in
    blocks by a hash of the row, and each block of one side meets each of the other in an equi-join on both numbers: a task
    holds one block of the base, and a lost task makes its own pairs again.
    """
    n, size = _weight(base)
    if size <= SEND_BYTES:
        return queries.crossJoin(F.broadcast(base))
    m, q_size = _weight(queries)
    blocks = lambda rows, held: max(1, -(-rows // BLOCK_ROWS), -(-held // BLOCK_BYTES))
    dealt = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    kq, kb = blocks(m, q_size), blocks(n, size)
    q = queries.withColumn("_q_block", dealt(queries, kq)).withColumn("_b_block", every(kb))
    b = base.withColumn("_b_block", dealt(base, kb)).withColumn("_q_block", every(kq))
    return q.join(b.hint("merge"), ["_q_block", "_b_block"]).drop("_q_block", "_b_block")


def top_k(queries: DataFrame, base: DataFrame, distance: Column, k: int, q: str, c: str, descending: bool = False) -> DataFrame:
    """The k nearest base rows of each query, ties by base id; each task passes on no more than k rows of a query."""
    pairs = all_pairs(queries, base).withColumn("distance", distance)
    order = F.desc("distance") if descending else F.asc("distance")
    rank = F.row_number().over(Window.partitionBy(q).orderBy(order, c))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def ring_shortlist(query_keys: DataFrame, map_keys: DataFrame, k: int) -> DataFrame:
    """(query_id, map_id, distance, rank) by L2 over ring keys of equal length and finite distance."""
    q = query_keys.select(F.col("scan_id").alias("query_id"), F.col("key").alias("qk"))
    m = map_keys.select(F.col("scan_id").alias("map_id"), F.col("key").alias("mk"))
    d = F.when(F.size("qk") == F.size("mk"), l2("qk", "mk"))
    pairs = all_pairs(q, m).withColumn("distance", d).where(F.col("distance").isNotNull() & (F.abs("distance") < float("inf")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "map_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= max(1, k)).select("query_id", "map_id", "distance", "rank")


def coarse_yaw(pairs: DataFrame, query_keys: DataFrame, map_keys: DataFrame, sectors: int) -> DataFrame:
    """Adds ``coarse``: the first turn of the candidate's sector key of least squared difference."""
    q = query_keys.select(F.col("scan_id").alias("query_id"), F.col("key").alias("qs"))
    m = map_keys.select(F.col("scan_id").alias("map_id"), F.col("key").alias("ms"))
    cost = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(sectors - 1)), F.lit(0.0), lambda a, c: a + F.pow(F.element_at("qs", (c + 1).cast("int")) - F.element_at("ms", (F.pmod(c - s, F.lit(sectors)) + 1).cast("int")), F.lit(2.0)))
    turns = F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), lambda s: F.struct(F.round(cost(s), 9).alias("cost"), s.alias("shift")))
    return pairs.join(q, "query_id").join(m, "map_id").withColumn("coarse", F.array_min(turns)["shift"]).drop("qs", "ms")


def turns_near(pairs: DataFrame, sectors: int, radius: int) -> DataFrame:
    """One row per pair and turn within ``radius`` of the coarse one; all turns if the radius covers them."""
    if 2 * radius + 1 >= sectors:
        return pairs.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))))
    return pairs.withColumn("shift", F.explode(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.pmod(F.col("coarse") + d, F.lit(sectors)).cast("int"))))


def support(cells: DataFrame, min_joint: int) -> tuple[DataFrame, DataFrame]:
    """Valid cells of each column, and each layer's columns with enough of them and cells at all."""
    cols = cells.groupBy("scan_id", "layer", "sector").agg(F.count("*").alias("n"))
    return cols, cols.groupBy("scan_id", "layer").agg(F.count_if(F.col("n") >= min_joint).alias("s"))


def layer_distances(turned: DataFrame, query_cells: DataFrame, map_cells: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(query_id, map_id, shift, layer, distance) of the layers that can be compared."""
    off, s = cfg.height_offset, cfg.sectors
    qn, qs = support(query_cells, cfg.min_joint_rings)
    mn, ms = support(map_cells, cfg.min_joint_rings)
    q = query_cells.join(qn, ["scan_id", "layer", "sector"]).select(F.col("scan_id").alias("query_id"), "layer", "ring", "sector", (F.col("h") + off).alias("a"), F.col("n").alias("na"))
    m = map_cells.join(mn, ["scan_id", "layer", "sector"]).select(F.col("scan_id").alias("map_id"), "layer", "ring", F.col("sector").alias("own"), (F.col("h") + off).alias("b"), F.col("n").alias("nb"))
    # column c of a turned candidate is its own column c - shift
    d = turned.select("query_id", "map_id", "shift").join(m, "map_id").withColumn("sector", F.pmod(F.col("own") + F.col("shift"), F.lit(s)).cast("int")).join(q, ["query_id", "layer", "ring", "sector"])
    a, b = F.col("a"), F.col("b")
    col = d.groupBy("query_id", "map_id", "shift", "layer", "sector").agg(F.count("*").alias("j"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    col = col.where((F.col("j") >= cfg.min_joint_rings) & (F.col("aa") > 1e-24) & (F.col("bb") > 1e-24))
    like = F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")) * F.col("j") / F.sqrt((F.col("na") * F.col("nb")).cast("double"))
    lay = col.groupBy("query_id", "map_id", "shift", "layer").agg(F.sum(like).alias("sim"), F.count("*").alias("eff"))
    lay = lay.join(qs.select(F.col("scan_id").alias("query_id"), "layer", F.col("s").alias("sq")), ["query_id", "layer"]).join(ms.select(F.col("scan_id").alias("map_id"), "layer", F.col("s").alias("sm")), ["map_id", "layer"])
    dist = 1 - F.col("sim") / F.col("eff") * F.pow(F.col("eff") / F.sqrt((F.col("sq") * F.col("sm")).cast("double")), F.lit(cfg.support_exponent))
    return lay.select("query_id", "map_id", "shift", "layer", dist.alias("distance"))


def exact_distances(turned: DataFrame, query_cells: DataFrame, map_cells: DataFrame, cfg: DescriptorConfig, omittable: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Adds ``distance`` to (query_id, map_id, shift) rows; pairs without any weight are dropped.

    ``omittable`` (scan_id, omittable) tells of map entries whose jointly absent upper layer may be left out; without
    it none may. The lower layer always may. ``weights`` (weight_id, w0, w1) makes a row for each weighting.
    """
    lay = layer_distances(turned, query_cells, map_cells, cfg)
    wide = lay.groupBy("query_id", "map_id", "shift").agg(*[F.max(F.when(F.col("layer") == k, F.col("distance"))).alias(f"d{k}") for k in (0, 1)])
    seen = lambda cells, key, tag: cells.groupBy(F.col("scan_id").alias(key)).agg(*[F.bool_or(F.col("layer") == k).alias(f"{tag}{k}") for k in (0, 1)])
    d = turned.join(wide, ["query_id", "map_id", "shift"], "left").join(seen(query_cells, "query_id", "q"), "query_id", "left").join(seen(map_cells, "map_id", "m"), "map_id", "left")
    return combined(d, cfg, omittable, weights)


def combined(d: DataFrame, cfg: DescriptorConfig, omittable: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Adds ``distance`` to rows of both layers' distances d0 and d1 (null: not comparable) and the layers seen on either side."""
    if omittable is not None:
        d = d.join(omittable.select(F.col("scan_id").alias("map_id"), "omittable"), "map_id", "left")
    else:
        d = d.withColumn("omittable", F.lit(False))
    if weights is not None:
        d = d.crossJoin(F.broadcast(weights))
    else:
        d = d.withColumns({"w0": F.lit(cfg.lower_weight), "w1": F.lit(cfg.upper_weight if cfg.dual_layer else 0.0)})
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    skip = {0: (F.col("w0") <= 0) | (no("q0") & no("m0")), 1: (F.col("w1") <= 0) | (no("q1") & no("m1") & F.coalesce("omittable", F.lit(False)))}
    total = sum(F.when(skip[k], F.lit(0.0)).otherwise(F.col(f"w{k}")) for k in (0, 1))
    score = sum(F.when(skip[k], F.lit(0.0)).otherwise(F.col(f"w{k}") * F.coalesce(f"d{k}", F.lit(0.0))) for k in (0, 1))
    broken = (~skip[0] & F.col("d0").isNull()) | (~skip[1] & F.col("d1").isNull())
    if not cfg.dual_layer:
        # a single layer that cannot be compared drops the pair
        d = d.where(F.col("d0").isNotNull())
    return d.withColumn("distance", F.when(broken, F.lit(1.0)).when(total > 1e-12, score / total)).where(F.col("distance").isNotNull()).drop("d0", "d1", "q0", "q1", "m0", "m1", "omittable", *([] if weights is not None else ["w0", "w1"]))


def yaw_hypotheses(scored: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(query_id, map_id, hyps): up to yaw_top_k turns, first those more than a sector apart, then any; by distance."""
    s = scored.groupBy("query_id", "map_id").agg(F.array_sort(F.collect_set(F.struct(F.round("distance", 9).alias("distance"), "shift"))).alias("all"))
    n = F.lit(cfg.sectors)
    gap = lambda a, b: F.least(F.pmod(a - b, n), F.pmod(b - a, n))
    kind = "array<struct<distance:double,shift:int>>"
    empty = F.array().cast(kind)
    apart = F.aggregate("all", empty, lambda got, x: F.when((F.size(got) < cfg.yaw_top_k) & ~F.exists(got, lambda y: gap(x["shift"], y["shift"]) <= 1), F.concat(got, F.array(x))).otherwise(got))
    s = s.withColumn("apart", apart)
    filled = F.aggregate("all", F.col("apart"), lambda got, x: F.when((F.size(got) < cfg.yaw_top_k) & ~F.exists(got, lambda y: x["shift"] == y["shift"]), F.concat(got, F.array(x))).otherwise(got))
    return s.select("query_id", "map_id", F.array_sort(filled).alias("hyps"))


def best_turn(scored: DataFrame, *more: str) -> DataFrame:
    """The best turn of each pair, ties to the smaller."""
    best = F.min(F.struct(F.round("distance", 9).alias("distance"), "shift")).alias("b")
    return scored.groupBy("query_id", "map_id", *more).agg(best).select("query_id", "map_id", *more, "b.distance", "b.shift")


def rank(best: DataFrame, *more: str) -> DataFrame:
    """1-based rank of each query's candidates by distance, ties by id."""
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *more).orderBy("distance", "map_id")))


def retrieve(query_cells: DataFrame, map_cells: DataFrame, cfg: DescriptorConfig, keys=None, omittable: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """Ranked candidates (query_id, map_id, distance, shift, yaw_shift, rank) of two-stage retrieval."""
    from placerec.functions.geom import TAU
    from placerec.operators import descriptor as D

    pairs = ring_shortlist(D.ring_keys(query_cells, cfg), D.ring_keys(map_cells, cfg), cfg.shortlist).drop("distance", "rank")
    pairs = coarse_yaw(pairs, D.sector_keys(query_cells, cfg), D.sector_keys(map_cells, cfg), cfg.sectors)
    best = best_turn(exact_distances(turns_near(pairs, cfg.sectors, cfg.search_radius), query_cells, map_cells, cfg, omittable))
    best = best if threshold is None else best.where(F.col("distance") <= threshold)
    return rank(best).withColumn("yaw_shift", F.col("shift") * (TAU / cfg.sectors))


#: The columns of a candidate file, fixed names of the format.
CANDIDATE_COLUMNS = [
    "query_index", "query_stamp", "query_x", "query_y", "query_z", "query_roll", "query_pitch", "query_yaw", "query_canonical_yaw",
    "candidate_rank", "candidate_index", "candidate_stamp", "candidate_x", "candidate_y", "candidate_z", "candidate_roll", "candidate_pitch", "candidate_yaw", "candidate_canonical_yaw",
    "distance", "sector_shift", "yaw_shift_rad", "coarse_vertical_shift", "vertical_shift", "retrieval_ms",
]


def retrieve_full(query_entries: DataFrame, map_entries: DataFrame, query_cells: DataFrame, map_cells: DataFrame, cfg: DescriptorConfig, threshold: float | None = None) -> DataFrame:
    """Whole candidates: ``CANDIDATE_COLUMNS`` and ``yaw_matches``, an array of (distance, shift, vertical_shift).

    Entries are (scan_id, stamp, x, y, z, roll, pitch, yaw, canonical_yaw). Jointly absent upper layers are left out where
    the map's surroundings show none; heights are estimated for every yaw match after the ranking and never change it.
    ``retrieval_ms`` is null: a distributed plan has no time of its own for a query.
    """
    from placerec.operators import descriptor as D
    from placerec.operators import vertical as V

    flags = map_entries.select("scan_id", "x", "y").join(D.observation_flags(map_cells).select("scan_id", "has_upper"), "scan_id")
    omittable = D.absent_upper_flags(flags, cfg) if cfg.dual_layer else None
    pairs = ring_shortlist(D.ring_keys(query_cells, cfg), D.ring_keys(map_cells, cfg), cfg.shortlist).select("query_id", "map_id")
    pairs = coarse_yaw(pairs, D.sector_keys(query_cells, cfg), D.sector_keys(map_cells, cfg), cfg.sectors)
    scored = exact_distances(turns_near(pairs, cfg.sectors, cfg.search_radius).drop("coarse"), query_cells, map_cells, cfg, omittable)
    hyps = yaw_hypotheses(scored, cfg).select("query_id", "map_id", F.posexplode("hyps").alias("n", "h")).select("query_id", "map_id", "n", "h.distance", "h.shift")
    if cfg.dual_layer and cfg.vertical_estimation:
        res = V.residuals(hyps, query_cells, map_cells, D.boundary_mask(query_cells, cfg), D.boundary_mask(map_cells, cfg), cfg)
        hyps = hyps.join(V.vertical_shift(res, cfg, hyps), ["query_id", "map_id", "shift"])
    else:
        hyps = hyps.withColumn("dz", F.lit(0.0))
    return candidates(hyps, query_entries, map_entries, cfg, threshold)


def candidates(hyps: DataFrame, query_entries: DataFrame, map_entries: DataFrame, cfg: DescriptorConfig, threshold: float | None = None) -> DataFrame:
    """Whole candidates of yaw matches (query_id, map_id, n, distance, shift, dz), ranked, with the poses of both sides."""
    from placerec.functions.geom import TAU

    best = hyps.groupBy("query_id", "map_id").agg(F.sort_array(F.collect_list(F.struct("n", "distance", "shift", F.col("dz").alias("vertical_shift")))).alias("all"))
    first = F.element_at("all", 1)
    best = best.select("query_id", "map_id", F.transform("all", lambda h: F.struct(h["distance"].alias("distance"), h["shift"].alias("shift"), h["vertical_shift"].alias("vertical_shift"))).alias("yaw_matches"), first["distance"].alias("distance"), first["shift"].alias("shift"), first["vertical_shift"].alias("dz"))
    best = rank(best if threshold is None else best.where(F.col("distance") <= threshold))
    names = ("stamp", "x", "y", "z", "roll", "pitch", "yaw", "canonical_yaw")
    side = lambda e, key, tag: e.select(F.col("scan_id").alias(key), *[F.col(c).alias(f"{tag}_{c}") for c in names])
    out = best.join(side(query_entries, "query_id", "query"), "query_id").join(side(map_entries, "map_id", "candidate"), "map_id")
    out = out.withColumns({"query_index": F.col("query_id"), "candidate_index": F.col("map_id"), "candidate_rank": F.col("rank"), "sector_shift": F.col("shift"), "yaw_shift_rad": F.col("shift") * (TAU / cfg.sectors), "coarse_vertical_shift": F.col("dz"), "vertical_shift": F.col("dz"), "retrieval_ms": F.lit(None).cast("double")})
    return out.select(*CANDIDATE_COLUMNS, "yaw_matches")


def least_over_roots(queries: DataFrame, base: DataFrame, n: int, roots: int) -> DataFrame:
    """(query_id, map_id, distance) of every pair: the least L2 distance of a query's key of length n to the keys of an entry's roots.

    Sides are (scan_id, key); an entry's key holds those of its roots one after another. Keys are plain columns here, so that a pair is a
    few operations of generated code and never a row for each root.
    """
    wide = lambda d, key, tag, m: d.select(F.col("scan_id").alias(key), *[F.coalesce(F.element_at("key", i + 1), F.lit(0.0)).alias(f"{tag}{i}") for i in range(m)])
    q = wide(queries, "query_id", "a", n)
    q = q.repartition(max(1, -(-q.count() // ROOT_ROWS)), "query_id")
    square = lambda i, j: (F.col(f"a{i}") - F.col(f"b{j}")) * (F.col(f"a{i}") - F.col(f"b{j}"))
    sums = [sum((square(i, r * n + i) for i in range(1, n)), square(0, r * n)) for r in range(roots)]
    d = F.sqrt(F.least(*sums) if roots > 1 else sums[0])
    return all_pairs(q, wide(base, "map_id", "b", roots * n)).select("query_id", "map_id", (F.rint(d * 1e9) / 1e9).alias("distance"))


def scpp_retrieve(queries: DataFrame, base: DataFrame, cfg: DescriptorConfig, k: int) -> DataFrame:
    """(query_id, map_id, root_id, distance, shift, rank): the k frames of least key distance over their roots, by the least exact distance over them.

    Both sides are cells (scan_id, root_id, ring, sector, h); a query is seen from root 0. A key is the mean of each ring. Contexts, one
    row for each scan and root, are worked out once and kept; key distances are ranked as rounded to nine places.
    """
    from placerec.folders import kept
    from placerec.operators import blocks as B

    n, sectors = cfg.rings * cfg.sectors, cfg.sectors
    cell = F.struct((F.col("ring") * sectors + F.col("sector")).cast("int").alias("at"), F.col("h").alias("v"))
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)))
    # grouped by both columns, so that cells made beside each other are not exchanged once more
    whole = lambda c: c.groupBy("scan_id", "root_id").agg(F.map_from_entries(F.collect_list(cell)).alias("m")).select("scan_id", "root_id", full.alias("context"))
    q, m = kept(whole(queries.where("root_id = 0")), "contexts"), kept(whole(base), "contexts")
    row = lambda i: F.aggregate(F.slice("context", i * sectors + 1, sectors), F.lit(0.0), lambda s, x: s + x) / sectors
    key = F.array(*[row(i) for i in range(cfg.rings)])
    roots = (m.agg(F.max("root_id")).first()[0] or 0) + 1
    # a root's own number; of the k best frames, the best roots are among the k * roots best
    near = B.nearest(q.select(F.col("scan_id").alias("query_id"), key.alias("a")), m.select((F.col("scan_id") * roots + F.col("root_id")).alias("root"), key.alias("b")), k * roots, "query_id", "root", "a", "b", "l2")
    frame = F.floor((F.col("root") - F.pmod("root", F.lit(roots))) / roots).cast("long") if roots > 1 else F.col("root")
    near = near.groupBy("query_id", frame.alias("frame")).agg(F.min("distance").alias("distance"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "frame"))).where(F.col("r") <= k)
    pairs = near.join(q.select(F.col("scan_id").alias("query_id"), F.col("context").alias("a")), "query_id").join(m.select(F.col("scan_id").alias("frame"), "root_id", F.col("context").alias("b")), "frame")
    best = B.turned_rows(pairs.select("query_id", F.col("frame").alias("map_id"), "root_id", "a", "b"), cfg.rings, sectors, cfg.search_radius)
    least = best.groupBy("query_id", "map_id").agg(F.min(F.struct("distance", "shift", "root_id")).alias("b"))
    return rank(least.select("query_id", "map_id", "b.root_id", "b.distance", "b.shift"))


def context_distances(turned: DataFrame, q: DataFrame, m: DataFrame, sectors: int) -> DataFrame:
    """Mean column cosine distance of max-height contexts over columns with cells on both sides; 1 without any."""
    norm = lambda c, key, name: c.groupBy(F.col("scan_id").alias(key), "sector").agg(F.sum(F.col("h") * F.col("h")).alias(name)).where(F.col(name) > 0)
    qn, mn = norm(q, "query_id", "aa"), norm(m, "map_id", "bb").withColumnRenamed("sector", "own")
    cols = turned.select("query_id", "map_id", "shift").join(mn, "map_id").withColumn("sector", F.pmod(F.col("own") + F.col("shift"), F.lit(sectors)).cast("int")).join(qn, ["query_id", "sector"])
    cells = turned.select("query_id", "map_id", "shift").join(m.select(F.col("scan_id").alias("map_id"), "ring", F.col("sector").alias("own"), F.col("h").alias("b")), "map_id").withColumn("sector", F.pmod(F.col("own") + F.col("shift"), F.lit(sectors)).cast("int"))
    dots = cells.join(q.select(F.col("scan_id").alias("query_id"), "ring", "sector", F.col("h").alias("a")), ["query_id", "ring", "sector"]).groupBy("query_id", "map_id", "shift", "sector").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    cos = F.coalesce("ab", F.lit(0.0)) / F.sqrt(F.col("aa") * F.col("bb"))
    d = cols.join(dots, ["query_id", "map_id", "shift", "sector"], "left").groupBy("query_id", "map_id", "shift").agg((1 - F.avg(cos)).alias("distance"))
    return turned.join(d, ["query_id", "map_id", "shift"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
