"""Polar descriptors in cell form: one row per occupied (scan, layer, ring, sector)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerec.config import DescriptorConfig
from placerec.functions import geom as G
from placerec.operators import points as P



def polar(p: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """Points in range with ring, sector and ground-relative height h."""
    ring = G.polar_bin(G.range_xy(F.col("x"), F.col("y")), cfg.max_radius, cfg.rings)
    sector = G.polar_bin(G.bearing(F.col("x"), F.col("y")), G.TAU, cfg.sectors)
    h = F.col("z") + F.lit(cfg.vertical_shift + cfg.origin_height)
    return P.in_descriptor_range(p, cfg.max_radius).withColumns({"ring": ring, "sector": sector, "h": h})


def envelope_cells(p: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, layer, ring, sector, h): layer 0 keeps the highest h up to the split, layer 1 the lowest above it."""
    layer = F.when(F.col("h") <= cfg.split_height, F.lit(0)).otherwise(F.lit(1)) if cfg.dual_layer else F.lit(0)
    d = polar(p, cfg).withColumn("layer", layer)
    agg = d.groupBy("scan_id", "layer", "ring", "sector").agg(F.max("h").alias("top"), F.min("h").alias("bottom"))
    return agg.select("scan_id", "layer", "ring", "sector", F.when(F.col("layer") == 0, F.col("top")).otherwise(F.col("bottom")).alias("h"))


def sc_max(p: DataFrame, cfg: DescriptorConfig, lidar_height: float = 2.0, leaf: float = 0.25) -> DataFrame:
    """Single-layer context: highest z over the ground of voxel centroids."""
    v = P.voxel_centroids(P.crop_annulus(p, 0.3, cfg.max_radius), leaf)
    return polar(v, cfg).groupBy("scan_id", "ring", "sector").agg(F.max(F.col("z") + lidar_height).alias("h"))


def scpp_cells(p: DataFrame, cfg: DescriptorConfig, leaf: float = 0.5, least: int = 5) -> DataFrame:
    """Three-root context: floor rings, those beyond the last in it, ceil sectors, cells of at least ``least`` voxels."""
    v = P.virtual_roots(P.voxel_centroids(P.crop_annulus(p, 0.3, cfg.max_radius), leaf).drop("n"))
    r = G.range_xy(F.col("x"), F.col("y"))
    v = v.withColumns({"ring": G.floor_bin(r, cfg.max_radius / cfg.rings, cfg.rings), "sector": G.polar_bin(G.bearing(F.col("x"), F.col("y")), G.TAU, cfg.sectors)})
    return v.groupBy("scan_id", "root_id", "ring", "sector").agg(F.max("z").alias("h"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def solid(p: DataFrame, rings: int = 8, sectors: int = 12, bins: int = 8, radius: float = 30.0, leaf: float = 1.0, fov=(-90.0, 90.0)) -> DataFrame:
    """(scan_id, kind, idx, value): range and angle vectors weighted by how full each elevation is."""
    v = P.voxel_centroids(P.crop_annulus(p, 0.3, radius), leaf)
    r = G.range_xy(F.col("x"), F.col("y"))
    v = v.select("scan_id", G.floor_bin(r, radius / rings, rings).alias("ring"), G.floor_bin(G.bearing(F.col("x"), F.col("y")), G.TAU / sectors, sectors).alias("sector"), G.floor_bin(F.degrees(F.atan2(F.col("z"), r)) - fov[0], (fov[1] - fov[0]) / bins, bins).alias("e"))
    n = v.groupBy("scan_id", "ring", "sector", "e").agg(F.count("*").alias("n"))
    total = n.groupBy("scan_id", "e").agg(F.sum("n").alias("t"))
    grid = total.select("scan_id").distinct().withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    w = Window.partitionBy("scan_id")
    t = grid.join(total, ["scan_id", "e"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    t = t.withColumn("w", F.coalesce(F.try_divide(F.col("t") - F.min("t").over(w), F.max("t").over(w) - F.min("t").over(w)), F.lit(0.0))).select("scan_id", "e", "w")
    d = n.join(t, ["scan_id", "e"])
    value = F.sum(F.col("n") * F.col("w")).alias("value")
    return d.groupBy("scan_id", F.lit("range").alias("kind"), F.col("ring").alias("idx")).agg(value).unionByName(d.groupBy("scan_id", F.lit("angle").alias("kind"), F.col("sector").alias("idx")).agg(value))


def ring_keys(cells: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, key array): row sums of h + offset over valid cells, divided by all sectors; layer 0 rows first."""
    n = cfg.layers * cfg.rings
    row = F.col("layer") * cfg.rings + F.col("ring")
    s = cells.groupBy("scan_id", row.alias("row")).agg((F.sum(F.col("h") + cfg.height_offset) / cfg.sectors).alias("v"))
    return _dense(s, "row", n)


def sector_keys(cells: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, key array): column sums of h + offset over valid cells, divided by all rows."""
    s = cells.groupBy("scan_id", "sector").agg((F.sum(F.col("h") + cfg.height_offset) / (cfg.layers * cfg.rings)).alias("v"))
    return _dense(s, "sector", cfg.sectors)


def _dense(s: DataFrame, at: str, n: int) -> DataFrame:
    m = F.map_from_entries(F.collect_list(F.struct(at, "v")))
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)))
    return s.groupBy("scan_id").agg(m.alias("m")).select("scan_id", full.alias("key"))


def boundary_mask(cells: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, ring, sector) whose two layers both end within the margin of the split."""
    low, up = (cells.where(F.col("layer") == k).select("scan_id", "ring", "sector", F.col("h").alias(n)) for k, n in ((0, "low"), (1, "up")))
    near = cfg.boundary_margin + 1e-9
    both = low.join(up, ["scan_id", "ring", "sector"])
    return both.where((cfg.split_height - F.col("low") <= near) & (F.col("up") - cfg.split_height <= near)).select("scan_id", "ring", "sector")


def observation_flags(cells: DataFrame) -> DataFrame:
    return cells.groupBy("scan_id").agg(F.bool_or(F.col("layer") == 0).alias("has_lower"), F.bool_or(F.col("layer") == 1).alias("has_upper"), F.count("*").alias("cells"))


def mask_bytes(cells: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, byte_idx, byte): the row-major validity mask packed from the lowest bit."""
    bit = (F.col("layer") * cfg.rings + F.col("ring")) * cfg.sectors + F.col("sector")
    return cells.groupBy("scan_id", F.floor(bit / 8).cast("int").alias("byte_idx")).agg(F.sum(F.pow(F.lit(2.0), bit % 8)).cast("int").alias("byte"))


def height_histogram(p: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(bin, n): each (scan, ring, sector) votes at most once a bin."""
    return height_votes(p, cfg).groupBy("bin").agg(F.count("*").alias("n"))


def height_bins(cfg: DescriptorConfig) -> int:
    return math.ceil(cfg.histogram_max / cfg.histogram_bin)


def height_votes(p: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, ring, sector, bin): the votes themselves."""
    d = polar(p, cfg).where((F.col("h") >= 0) & (F.col("h") < cfg.histogram_max))
    return d.select("scan_id", "ring", "sector", F.least(F.floor(F.col("h") / cfg.histogram_bin), F.lit(height_bins(cfg) - 1)).cast("int").alias("bin")).distinct()


def histogram_totals(p: DataFrame, cfg: DescriptorConfig) -> tuple[list[int], int]:
    """The votes of each height bin, and the scans that have any, in one pass: a column's bins are the bits of a few words, so no vote is a row."""
    n = height_bins(cfg)
    b = F.least(F.floor(F.col("h") / cfg.histogram_bin), F.lit(n - 1)).cast("int")
    d = polar(p, cfg).where((F.col("h") >= 0) & (F.col("h") < cfg.histogram_max)).withColumn("bin", b)
    words = range(-(-n // 64))
    bit = lambda k: F.bit_or(F.when(F.floor(F.col("bin") / 64) == k, F.expr("shiftleft(1L, bin % 64)")).otherwise(F.lit(0))).alias(f"w{k}")
    columns = d.groupBy("scan_id", "ring", "sector").agg(*[bit(k) for k in words])
    scans = columns.groupBy("scan_id").agg(*[F.sum(F.getbit(f"w{i // 64}", F.lit(i % 64)).cast("long")).alias(f"b{i}") for i in range(n)])
    got = scans.agg(F.count("*").alias("scans"), *[F.sum(f"b{i}").alias(f"b{i}") for i in range(n)]).first()
    return [got[f"b{i}"] or 0 for i in range(n)], got.scans


def adaptive_split(histogram: DataFrame, keyframes: int, cfg: DescriptorConfig) -> DataFrame:
    """One row (enabled, split, score): the threshold of greatest between-class variance, the middle of a plateau."""
    n = height_bins(cfg)
    spark = histogram.sparkSession
    h = spark.range(n).select(F.col("id").cast("int").alias("bin")).join(histogram, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    # one row a bin: histogram_max / histogram_bin rows in all
    w, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    mid = (F.col("bin") + 0.5) * cfg.histogram_bin
    h = h.withColumns({"mass": F.col("n") * mid})
    h = h.select("bin", F.sum("n").over(w).alias("n0"), F.sum("mass").over(w).alias("s0"), F.sum("n").over(every).alias("t"), F.sum("mass").over(every).alias("s"))
    at, f0 = (F.col("bin") + 1) * cfg.histogram_bin, F.try_divide("n0", "t")
    gap = F.try_divide("s0", "n0") - F.try_divide(F.col("s") - F.col("s0"), F.col("t") - F.col("n0"))
    h = h.select(at.alias("at"), f0.alias("f"), (f0 * (1 - f0) * gap * gap).alias("score"))
    ok = h.where(F.col("at").between(cfg.split_min - 1e-9, cfg.split_max + 1e-9)).where((F.col("f") >= cfg.min_fraction) & (1 - F.col("f") >= cfg.min_fraction))
    ok = ok.withColumn("best", F.max("score").over(every)).where(F.abs(F.col("score") - F.col("best")) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("best")))
    return ok.agg(((F.min("at") + F.max("at")) / 2).alias("split"), F.max("score").alias("score")).select((F.col("split").isNotNull() & F.lit(keyframes >= cfg.min_keyframes)).alias("enabled"), "split", "score")


def absent_upper_flags(entries: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, omittable): entries whose surroundings show no upper layer. Input: (scan_id, x, y, has_upper).

    If hardly any entry has one, all are; else the share is taken among the entries within a radius, themselves
    included, found by an equi-join over grid cells of that radius.
    """
    share = F.avg(F.col("has_upper").cast("double"))
    overall = entries.agg(share.alias("s")).first()["s"]
    if overall is None or overall <= cfg.absent_upper_fraction:
        return entries.select("scan_id", F.lit(True).alias("omittable"))
    near = radius_pairs(entries, cfg.absent_upper_radius).join(entries.select(F.col("scan_id").alias("other"), "has_upper"), "other")
    return near.groupBy("scan_id").agg(((F.count("*") >= cfg.absent_upper_neighbours) & (share <= cfg.absent_upper_fraction)).alias("omittable"))


def radius_pairs(e: DataFrame, radius: float) -> DataFrame:
    """(scan_id, other, d2): pairs within a radius, itself included; a grid of that radius makes it an equi-join."""
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = e.select("scan_id", "x", "y", F.explode(steps).alias("s")).select("scan_id", "x", "y", (cell("x") + F.col("s.i")).alias("gx"), (cell("y") + F.col("s.j")).alias("gy"))
    b = e.select(F.col("scan_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("gx"), cell("y").alias("gy"))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return a.join(b, ["gx", "gy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("scan_id", "other", "d2")


def roof_stats(p: DataFrame, cfg: DescriptorConfig, over: float = 4.0) -> DataFrame:
    """Per scan: columns with both layers (hidden), with any (occupied), whose highest point is over the split (overhead)
    or at least ``over`` (over_range); those most under a roof first."""
    c = polar(p, cfg).groupBy("scan_id", "ring", "sector").agg(F.min("h").alias("lo"), F.max("h").alias("up"))
    low, high = F.col("lo") <= cfg.split_height, F.col("up") > cfg.split_height
    s = c.groupBy("scan_id").agg(F.count_if(low & high).alias("hidden"), F.count("*").alias("occupied"), F.count_if(high).alias("overhead"), F.count_if(F.col("up") >= over).alias("over_range"), F.count_if(low).alias("lower"), F.count_if(high).alias("upper"))
    return s.withColumns({"hidden_fraction": F.col("hidden") / F.col("occupied"), "overhead_fraction": F.col("overhead") / F.col("occupied")}).orderBy(F.desc("overhead"), F.desc("over_range"), F.desc("hidden"), "scan_id")


def dominant_ceiling(p: DataFrame, split: float = 2.1, highest: float = 4.5, width: float = 0.02, margin: float = 0.12) -> DataFrame:
    """Per scan: the centre of the fullest height bin (the lowest of equals) and the cut above it.

    Bins start 0.2 over the split and end at ``highest``; a scan without points there has no ceiling.
    """
    low = split + 0.2
    n = p.where(F.col("z").between(low, highest)).groupBy("scan_id", F.floor((F.col("z") - low) / width).alias("bin")).agg(F.count("*").alias("n"))
    best = n.groupBy("scan_id").agg(F.max_by("bin", F.struct("n", (-F.col("bin")).alias("low"))).alias("bin"))
    centre = low + (F.col("bin") + 0.5) * width
    return best.select("scan_id", centre.alias("ceiling"), (centre + margin).alias("cut"))


def origin_height(p: DataFrame, low: float = 1.0, high: float = 8.0, least: int = 200) -> DataFrame:
    """One row (origin_height, scans): minus the median of the scans' second percentiles of z in a ring, if enough points lie there."""
    r = F.col("r") if "r" in p.columns else G.range_xy(F.col("x"), F.col("y"))
    f = p.where((r > low) & (r < high)).groupBy("scan_id").agg(F.percentile("z", F.lit(0.02)).alias("p2"), F.count("*").alias("n")).where(F.col("n") > least)
    return f.agg((-F.median("p2")).alias("origin_height"), F.count("*").alias("scans"))


def origin_height_audit(p: DataFrame, gravity: DataFrame, keyframes: int = 40, **how) -> DataFrame:
    """:func:`origin_height` of levelled heights, by ranges as the sensor saw them, over about so many keyframes spread evenly by id."""
    ids = gravity.select("scan_id").withColumn("_k", F.row_number().over(Window.orderBy("scan_id")) - 1)
    some = ids.crossJoin(F.broadcast(gravity.agg(F.count("*").alias("_n")))).where(F.col("_k") % F.greatest(F.lit(1), F.floor(F.col("_n") / keyframes)) == 0).select("scan_id")
    seen = p.join(some, "scan_id").withColumn("r", G.range_xy(F.col("x"), F.col("y")))
    return origin_height(P.level(seen, gravity), **how)


def density_image(p: DataFrame, bounds: tuple[float, float, float, float], bins: tuple[int, int] = (1100, 850)) -> DataFrame:
    """(scan_id, px, py, n, level): points of each cell of a fixed raster over x and y, its last edges included, and the level as in :func:`density_grid`."""
    x0, x1, y0, y1 = bounds
    at = lambda c, low, high, k: F.least(F.floor((F.col(c) - low) / ((high - low) / k)), F.lit(k - 1)).cast("int")
    inside = p.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    n = inside.groupBy("scan_id", at("x", x0, x1, bins[0]).alias("px"), at("y", y0, y1, bins[1]).alias("py")).agg(F.count("*").alias("n"))
    top = n.groupBy("scan_id").agg(F.percentile(F.log1p("n"), F.lit(0.98)).alias("top"))
    return n.join(top, "scan_id").select("scan_id", "px", "py", "n", F.pow(F.least(F.log1p("n") / F.greatest("top", F.lit(1e-9)), F.lit(1.0)), 0.48).alias("level"))


def density_grid(p: DataFrame, cell: float = 2.0) -> DataFrame:
    """(scan_id, gx, gy, n, level): counts, and log counts against the scan's 98th percentile to the power 0.48."""
    n = p.groupBy("scan_id", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(F.count("*").alias("n"))
    top = n.groupBy("scan_id").agg(F.percentile(F.log1p("n"), F.lit(0.98)).alias("top"))
    return n.join(top, "scan_id").select("scan_id", "gx", "gy", "n", F.pow(F.least(F.log1p("n") / F.col("top"), F.lit(1.0)), 0.48).alias("level"))


def roll(cells: DataFrame, shift: Column | int, sectors: int) -> DataFrame:
    """Cells turned by a number of sectors."""
    return cells.withColumn("sector", F.pmod(F.col("sector") + shift, F.lit(sectors)).cast("int"))


def circular_windows(counts: DataFrame, sectors: int, width: int) -> DataFrame:
    """(scan_id, start, total): sums over windows of sectors that wrap around. Input: (scan_id, sector, n)."""
    grid = counts.select("scan_id").distinct().withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1)))).withColumn("sector", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (F.col("start") + k) % sectors)))
    return grid.join(counts, ["scan_id", "sector"], "left").groupBy("scan_id", "start").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def best_window(windows: DataFrame) -> DataFrame:
    """The first window of the greatest total."""
    return windows.groupBy("scan_id").agg(F.max_by("start", F.struct("total", (-F.col("start")).alias("first"))).alias("start"), F.max("total").alias("total"))


def context_cells(p: DataFrame, cfg: DescriptorConfig) -> DataFrame:
    """(scan_id, ring, sector, top, low, up): the highest point of a column, of its lower layer, and the lowest of its upper layer."""
    h, lower = F.col("h"), F.col("h") <= cfg.split_height
    return polar(p, cfg).groupBy("scan_id", "ring", "sector").agg(F.max(h).alias("top"), F.max(F.when(lower, h)).alias("low"), F.min(F.when(~lower, h)).alias("up"))


def detail_windows(cells: DataFrame, cfg: DescriptorConfig, width: int = 12, least: int = 30, gap: float = 0.3) -> DataFrame:
    """Per scan three windows of sectors in turn, each apart from those before it: ``mixed``, ``gap`` and ``ratio``.

    mixed: most columns that both layers fill. gap: most overhead columns whose top lies more than ``gap`` over their upper layer, with
    the median of what they lie over it. ratio: the greatest spread of the lower layer over the spread of the tops of overhead
    columns (1e-6 added), both of at least ``least`` cells. Overhead: the top is over the split. Windows wrap around; the
    first of equals is taken; where nothing fits, the start is -1. Input: :func:`context_cells`.
    """
    n, overhead = cfg.sectors, F.col("top") > cfg.split_height
    hollow = overhead & (F.col("top") - F.col("up") > gap)
    starts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.pmod(F.col("sector") - k, F.lit(n)).cast("int"))
    tops = F.when(overhead, F.col("top"))
    w = cells.withColumn("start", F.explode(starts)).groupBy("scan_id", "start").agg(
        F.count_if(F.col("low").isNotNull() & F.col("up").isNotNull()).alias("mixed"), F.count_if(hollow).alias("gaps"), F.percentile(F.when(hollow, F.col("top") - F.col("up")), F.lit(0.5)).alias("median"),
        F.count("low").alias("lows"), F.stddev_pop("low").alias("low_std"), F.count(tops).alias("tops"), F.stddev_pop(tops).alias("top_std"),
    )
    fit = (F.col("lows") >= least) & (F.col("tops") >= least)
    w = w.withColumn("ratio", F.when(fit, F.col("low_std") / (F.col("top_std") + 1e-6)))
    # one short list a scan: the choices follow from each other without another shuffle
    d = w.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("start", "mixed", "gaps", "median", "ratio", "low_std", "top_std"))).alias("all"))
    none = F.expr("named_struct('start', -1, 'mixed', 0L, 'gaps', 0L, 'median', 0.0D, 'ratio', 0.0D, 'low_std', 0.0D, 'top_std', 0.0D)")
    near = lambda a, b: F.least(F.pmod(a - b, F.lit(n)), F.pmod(b - a, F.lit(n))) < width

    def best(by: str, taken: list[Column]) -> Column:
        free = lambda x: ~F.coalesce(*[F.when((t >= 0) & near(x["start"], t), F.lit(True)) for t in taken], F.lit(False)) if taken else F.lit(True)
        return F.aggregate("all", none, lambda a, x: F.when(free(x) & (F.coalesce(x[by].cast("double"), F.lit(0.0)) > a[by].cast("double")), x).otherwise(a))

    d = d.withColumn("m", best("mixed", [])).withColumn("m_at", F.greatest(F.col("m.start"), F.lit(0)))
    d = d.withColumn("g", best("gaps", [F.col("m_at")])).withColumn("r", best("ratio", [F.col("m_at"), F.col("g.start")]))
    return d.select("scan_id", F.col("m_at").alias("mixed_start"), F.col("m.mixed").alias("mixed_cells"), F.col("g.start").alias("gap_start"), F.col("g.gaps").alias("gap_cells"), F.col("g.median").alias("gap_median"), F.col("r.start").alias("ratio_start"), F.col("r.ratio").alias("ratio"), F.col("r.low_std").alias("low_std"), F.col("r.top_std").alias("top_std"))
