"""Exhaustive comparisons of two sides of vectors: blocks of either side meet in a cogroup, and NumPy compares a block with a block.

Both sides are dealt out by a hash of the id; every block of one meets every block of the other once, in a task of its own. A search
passes on no more than k rows of a query from each meeting: matrix products find what can be among them, and only that is compared term
by term. Distances are ranked as rounded to ``DIGITS``, ties by id, so that the order does not depend on how sums were added up.

Ids are integers. Vectors have one length; those that are null or of another length than the base's longest, or hold null or non-finite
values, take no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerec.operators.metric import usable

#: Rows and bytes of a block, numbers held at a time, and decimal places that count in a ranking.
ROWS, BYTES, AT_ONCE, DIGITS = 4096, 16 << 20, 1 << 22, 9

TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def matrix(t: pa.Table, name: str) -> np.ndarray:
    """A list column of one length as the rows of a matrix."""
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in t[name].chunks]
    return np.concatenate(flat).astype(float, copy=False).reshape(len(t), -1)


def meet(queries: DataFrame, base: DataFrame, q: str, c: str, run: Callable[[pa.Table, pa.Table], list[np.ndarray]], schema: str, counts: tuple[int, int], row_bytes: int, rows: int | None = None, most: int | None = None) -> DataFrame:
    """The columns that ``run`` makes of each block of queries beside each block of the base; a row has about ``row_bytes``, a block no more than ``most``."""
    size = max(1, min(rows or ROWS, (most or BYTES) // max(1, row_bytes)))
    kq, kb = (max(1, -(-n // size)) for n in counts)
    dealt = lambda col, k: F.pmod(F.xxhash64(col), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = queries.withColumn("_q", dealt(q, kq)).withColumn("_b", every(kb))
    b = base.withColumn("_b", dealt(c, kb)).withColumn("_q", every(kq))
    kinds = pa.schema([(name, TYPES[kind]) for name, kind in (part.split() for part in schema.split(", "))])

    def step(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return kinds.empty_table()
        return pa.table([pa.array(v, t) for v, t in zip(run(x, y), kinds.types, strict=True)], schema=kinds)

    return a.groupBy("_q", "_b").cogroup(b.groupBy("_q", "_b")).applyInArrow(step, schema)


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def _summed(term: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    """Terms added one by one, as a loop over a vector does."""
    out = term(0)
    for i in range(1, n):
        out = out + term(i)
    return out


def _squared(a, b, sign=-1):
    return _summed(lambda i: (a[:, i] + sign * b[:, i]) ** 2, a.shape[1])


def _cosine(a, b):
    dot = lambda x, y: _summed(lambda i: x[:, i] * y[:, i], a.shape[1])
    return dot(a, b) / np.maximum(np.sqrt(dot(a, a) * dot(b, b)), 1e-12)


#: Of each kind: what grows with the distance, from (squares of a, of b, a b); the value of a pair; whether more is nearer.
KINDS = {
    "squared": (lambda aa, bb, ab: aa + bb - 2 * ab, _squared, False),
    "l2": (lambda aa, bb, ab: aa + bb - 2 * ab, lambda a, b: np.sqrt(_squared(a, b)), False),
    "cosine": (lambda aa, bb, ab: -ab / np.maximum(np.sqrt(aa * bb), 1e-12), _cosine, True),
    "sign_invariant": (lambda aa, bb, ab: aa + bb - 2 * np.abs(ab), lambda a, b: np.sqrt(np.minimum(_squared(a, b), _squared(a, b, 1))), False),
}


def nearest_rows(a: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int, kind: str, among: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, value): the k nearest rows of b to each row of a, by the rounded value, ties to smaller ids.

    ``among`` tells of a run of a's rows which pairs count; without it all do.
    """
    near, value, descending = KINDS[kind]
    aa, bb, got = _squares(a), _squares(b), []
    width = max(1, AT_ONCE // len(b))
    for at in range(0, len(a), width):
        part = slice(at, at + width)
        d = near(aa[part, None], bb[None, :], a[part] @ b.T)
        if among is not None:
            d[~among(part)] = np.inf
        # what rounding and the products' errors can let pass; what is worse than the k-th by more is never among the k
        slack = 1e-8 * (1 + aa[part] + bb.max())
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(b) else d.max(1)
        i, j = np.nonzero((d <= (kth + slack)[:, None]) & (d < np.inf))
        if not len(i):
            continue
        v = np.concatenate([np.round(value(a[part][i[s : s + (1 << 17)]], b[j[s : s + (1 << 17)]]), DIGITS) for s in range(0, len(i), 1 << 17)])
        order = np.lexsort((b_ids[j], -v if descending else v, i))
        i, j, v = i[order], j[order], v[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        got.append((i[keep] + at, j[keep], v[keep]))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def measured(queries: DataFrame, base: DataFrame, q_key: str, c_key: str) -> tuple[DataFrame, DataFrame, tuple[int, int], int]:
    """Both sides' usable rows, their numbers, and the length of a vector, by one job a side."""
    n, dims = base.agg(F.count("*"), F.max(F.size(c_key))).first()
    dims = max(0, dims or 0)
    return queries.where(usable(q_key, dims)), base.where(usable(c_key, dims)), (queries.count(), n), dims


def nearest(queries: DataFrame, base: DataFrame, k: int, q: str, c: str, q_key: str, c_key: str, kind: str = "squared", turns: Callable[[Column], Column] | None = None) -> DataFrame:
    """(q, c, distance, rank): the k nearest base rows of each query by a distance of ``KINDS``, ties by base id.

    ``turns`` makes further vectors of a query; the least distance counts. Each is a row here: of the k nearest over all, each is among
    the k nearest of some turn.
    """
    own = queries.select(F.col(q).alias("_qid"), F.col(q_key).alias("_a"))
    own = own if turns is None else own.select("_qid", F.explode(turns(F.col("_a"))).alias("_a"))
    a, b, counts, dims = measured(own, base.select(F.col(c).alias("_cid"), F.col(c_key).alias("_v")), "_a", "_v")

    def run(x: pa.Table, y: pa.Table) -> list[np.ndarray]:
        own, other = x["_qid"].to_numpy(), y["_cid"].to_numpy()
        i, j, v = nearest_rows(matrix(x, "_a"), matrix(y, "_v"), other, k, kind)
        return [own[i], other[j], v]

    found = meet(a, b, "_qid", "_cid", run, "_qid bigint, _cid bigint, distance double", counts, 8 * dims)
    order = F.desc("distance") if KINDS[kind][2] else F.asc("distance")
    if turns is not None:
        found = found.groupBy("_qid", "_cid").agg((F.max if KINDS[kind][2] else F.min)("distance").alias("distance"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_qid").orderBy(order, "_cid"))).where(F.col("rank") <= k)
    return ranked.select(F.col("_qid").alias(q), F.col("_cid").alias(c), "distance", "rank")


def first_right(queries: DataFrame, base: DataFrame, radius: float, q: str, c: str, q_key: str, c_key: str) -> DataFrame:
    """(q, first_rank): where the first row within the radius stands among all base rows, by squared distance of the vectors, ties by base id.

    Queries hold their place as (tx, ty), the base as (x, y). No ranking is cut off: one meeting finds the nearest right row of each
    query, another counts the rows that come before it. Queries without a right row have no row here.
    """
    own = queries.select(F.col(q).alias("_qid"), F.col(q_key).alias("_a"), "tx", "ty")
    a, b, counts, dims = measured(own, base.select(F.col(c).alias("_cid"), F.col(c_key).alias("_v"), "x", "y"), "_a", "_v")
    at = lambda t, name: t[name].to_numpy()

    def right(x: pa.Table, y: pa.Table) -> list[np.ndarray]:
        tx, ty, mx, my = at(x, "tx"), at(x, "ty"), at(y, "x"), at(y, "y")
        within = lambda part: np.sqrt((mx[None] - tx[part, None]) ** 2 + (my[None] - ty[part, None]) ** 2) <= radius
        i, j, v = nearest_rows(matrix(x, "_a"), matrix(y, "_v"), at(y, "_cid"), 1, "squared", within)
        return [at(x, "_qid")[i], at(y, "_cid")[j], v]

    def before(x: pa.Table, y: pa.Table) -> list[np.ndarray]:
        v, m, ids, least, first = matrix(x, "_a"), matrix(y, "_v"), at(y, "_cid"), at(x, "_least"), at(x, "_first")
        aa, bb, n = _squares(v), _squares(m), []
        width = max(1, AT_ONCE // len(m))
        for start in range(0, len(v), width):
            part = slice(start, start + width)
            d = KINDS["squared"][0](aa[part, None], bb[None], v[part] @ m.T) - least[part, None]
            slack = (1e-8 * (1 + aa[part] + bb.max()))[:, None]
            count = (d < -slack).sum(1)
            i, j = np.nonzero(np.abs(d) <= slack)
            near = np.round(_squared(v[part][i], m[j]), DIGITS)
            ahead = (near < least[part][i]) | ((near == least[part][i]) & (ids[j] < first[part][i]))
            n.append(count + np.bincount(i[ahead], minlength=len(count)))
        return [at(x, "_qid"), np.concatenate(n)]

    found = meet(a, b, "_qid", "_cid", right, "_qid bigint, _cid bigint, distance double", counts, 8 * dims)
    best = found.groupBy("_qid").agg(F.min(F.struct("distance", "_cid")).alias("_b"))
    a = a.join(best, "_qid").select("_qid", "_a", F.col("_b.distance").alias("_least"), F.col("_b._cid").alias("_first"))
    ahead = meet(a, b, "_qid", "_cid", before, "_qid bigint, n bigint", counts, 8 * dims)
    return ahead.groupBy("_qid").agg((F.sum("n") + 1).alias("first_rank")).withColumnRenamed("_qid", q)


#: Rows of a block where every pair is put out.
PAIR_ROWS = 1024


def turned_contexts(queries: DataFrame, base: DataFrame, rings: int, sectors: int, radius: int | None = None) -> DataFrame:
    """(query_id, map_id, distance, shift) of every pair: the turn of the least mean column cosine distance, ties to the smaller.

    Sides are cells (scan_id, ring, sector, h); columns with cells on both sides count, and a turn without any has distance 1. With
    ``radius`` only the turns that near to the coarse one are tried: the first of least squared difference of the columns' means.
    """
    from placerec.operators import descriptor as D

    whole = lambda c: D._dense(c.select("scan_id", (F.col("sector") * rings + F.col("ring")).cast("int").alias("at"), F.col("h").alias("v")), "at", rings * sectors)
    a, b, counts, dims = measured(whole(queries).select(F.col("scan_id").alias("_qid"), F.col("key").alias("_a")), whole(base).select(F.col("scan_id").alias("_cid"), F.col("key").alias("_v")), "_a", "_v")

    def columns(v: np.ndarray):
        v = v.reshape(len(v), sectors, rings)
        norm = np.sqrt((v * v).sum(2))
        return np.divide(v, norm[:, :, None], out=np.zeros_like(v), where=norm[:, :, None] > 0), (norm > 0).astype(float), v.sum(2) / rings

    def run(x: pa.Table, y: pa.Table) -> list[np.ndarray]:
        (q, q_seen, q_key), (m, m_seen, m_key) = columns(matrix(x, "_a")), columns(matrix(y, "_v"))
        flat = q.reshape(len(q), -1)
        shape, none = (len(q), len(m)), np.inf
        best, shift, coarse, least = np.full(shape, none), np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.full(shape, none)
        for t in range(sectors) if radius is not None else ():
            cost = np.round(_squares(q_key)[:, None] + _squares(m_key)[None] - 2 * q_key @ np.roll(m_key, t, 1).T, DIGITS)
            coarse[cost < least] = t
            least = np.minimum(least, cost)
        for t in range(sectors):
            both = q_seen @ np.roll(m_seen, t, 1).T
            cos = flat @ np.roll(m, t, 1).reshape(len(m), -1).T
            d = np.round(1 - np.divide(cos, both, out=np.zeros(shape), where=both > 0), DIGITS)
            better = d < best
            if radius is not None:
                better &= np.minimum((coarse - t) % sectors, (t - coarse) % sectors) <= radius
            best[better], shift[better] = d[better], t
        return [np.repeat(x["_qid"].to_numpy(), len(m)), np.tile(y["_cid"].to_numpy(), len(q)), best.ravel() + 0.0, shift.ravel()]

    return meet(a, b, "_qid", "_cid", run, "query_id bigint, map_id bigint, distance double, shift int", counts, 8 * dims, PAIR_ROWS)


def turned_rows(pairs: DataFrame, rings: int, sectors: int, radius: int) -> DataFrame:
    """Rows (query_id, map_id, root_id, a, b) with ``distance`` and ``shift`` of b's best turn in place of the contexts a and b.

    Contexts are flat, ring by ring. Distances and turns are those of :func:`turned_contexts`.
    """

    def step(batches):
        for t in batches:
            t = pa.Table.from_batches([t])
            if not len(t):
                continue
            a, b = (matrix(t, name).reshape(len(t), rings, sectors) for name in ("a", "b"))
            aa, bb, ka, kb = (a * a).sum(1), (b * b).sum(1), a.sum(1) / rings, b.sum(1) / rings
            cost = np.stack([np.round(((ka - np.roll(kb, s, 1)) ** 2).sum(1), DIGITS) for s in range(sectors)], 1)
            coarse, found = cost.argmin(1), []
            for s in range(sectors):
                other = np.roll(bb, s, 1)
                both = (aa > 0) & (other > 0)
                cos = np.divide((a * np.roll(b, s, 2)).sum(1), np.sqrt(aa * other), out=np.zeros_like(aa), where=both)
                seen = both.sum(1)
                d = np.round(1 - np.divide(cos.sum(1), seen, out=np.zeros(len(t)), where=seen > 0), DIGITS)
                found.append(np.where(np.minimum((coarse - s) % sectors, (s - coarse) % sectors) <= radius, d, np.inf))
            found = np.stack(found, 1)
            shift = found.argmin(1)
            columns = [t["query_id"].combine_chunks(), t["map_id"].combine_chunks(), t["root_id"].combine_chunks(), pa.array(found[np.arange(len(t)), shift] + 0.0), pa.array(shift.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "map_id", "root_id", "distance", "shift"])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(step, ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "map_id", "root_id")) + ", distance double, shift int")


def least_over_frames(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(query_id, map_id, distance) of every pair of scans: the least sign-invariant L2 distance over their frames' vectors.

    Sides are (scan_id, v) with as many rows a scan as it has frames.
    """
    a, b, counts, dims = measured(queries.select(F.col("scan_id").alias("_qid"), F.col("v").alias("_a")), base.select(F.col("scan_id").alias("_cid"), F.col("v").alias("_v")), "_a", "_v")

    def run(x: pa.Table, y: pa.Table) -> list[np.ndarray]:
        x, y = x.sort_by("_qid"), y.sort_by("_cid")
        q, m = matrix(x, "_a"), matrix(y, "_v")
        (qi, qs), (mi, ms) = (np.unique(i, return_index=True) for i in (x["_qid"].to_numpy(), y["_cid"].to_numpy()))
        ab = q @ m.T
        near = _squares(q)[:, None] + _squares(m)[None] - 2 * np.abs(ab)
        # the frames of least distance, then that distance term by term
        low = np.minimum.reduceat(np.minimum.reduceat(near, qs, 0), ms, 1)
        at = np.full(low.shape, -1)
        rows, cols = np.nonzero(near <= np.repeat(np.repeat(low, np.diff([*qs, len(q)]), 0), np.diff([*ms, len(m)]), 1))
        at[np.searchsorted(qs, rows, "right") - 1, np.searchsorted(ms, cols, "right") - 1] = rows * len(m) + cols
        i, j = np.divmod(at.ravel(), len(m))
        d = np.concatenate([_squares(q[i[s : s + 4096]] - np.where(ab[i[s : s + 4096], j[s : s + 4096]] < 0, -1, 1)[:, None] * m[j[s : s + 4096]]) for s in range(0, len(i), 4096)])
        return [np.repeat(qi, len(mi)), np.tile(mi, len(qi)), np.round(np.sqrt(d), DIGITS)]

    return meet(a, b, "_qid", "_cid", run, "query_id bigint, map_id bigint, distance double", counts, 8 * dims, PAIR_ROWS)


#: Rows and bytes of a block of tensors, the least number of blocks of a side, and how far single precision may be off, as a share of the greatest score.
TENSOR_ROWS, TENSOR_BYTES, TENSOR_BLOCKS, OFF = 8192, 48 << 20, 5, 2e-5


def _near_tensors(q: np.ndarray, m: np.ndarray, k: int, grid: int, scale: float):
    """For runs of q's rows, (row of q, rows of m that can be among its k of greatest score); tensors (n, channels, angles, half a row's spectrum)."""
    n, channels, angles, half = m.shape
    twice = np.full(half, 2.0, np.float32)
    twice[0] = 1.0
    twice[grid // 2 + grid % 2 :] = 1.0
    columns = lambda v: np.ascontiguousarray(v.transpose(1, 3, 0, 2)).reshape(channels * half, len(v), angles)
    lengths = lambda v: np.sqrt(np.einsum("nijk,nijk,k->n", v, v, twice).max())
    slack, base = OFF * float(lengths(q) * lengths(m)) / scale, columns(m)
    # (angle, turn): which angle of a query lies beside it
    beside = (np.arange(angles)[:, None] + np.arange(angles)) % angles
    for at in range(0, len(q), 16):
        turned = columns(q[at : at + 16] * twice)[:, :, beside].transpose(0, 2, 1, 3)
        turned = np.ascontiguousarray(turned).reshape(len(base), angles, -1)
        scores = []
        for row in range(0, n, 256):
            part = base[:, row : row + 256]
            total = np.abs(part[0] @ turned[0])
            room = np.empty_like(total)
            for c in range(1, len(base)):
                np.matmul(part[c], turned[c], out=room)
                np.abs(room, out=room)
                total += room
            scores.append(total.reshape(len(total), -1, angles).max(2))
        scores = np.concatenate(scores).T / scale
        least = np.partition(scores, n - k, axis=1)[:, n - k] if k < n else scores.min(1)
        for i, row in enumerate(scores):
            yield at + i, np.flatnonzero(row >= least[i] - 2 * slack)


def best_tensors(queries: DataFrame, base: DataFrame, k: int, grid: int) -> DataFrame:
    """(query_id, map_id, score, turn, rank): the k tensors of greatest circular score of each query, by the score rounded to six places, ties by map id.

    Sides are (scan_id, v) of :func:`kernels.ringpp`. Spectra of real rows mirror each other about their middle, so that half of a row says all:
    only that is dealt out. Single precision finds what can be among the k, and only that is scored as :func:`kernels.circular_score` does.
    """
    from placerec.operators.kernels import circular_score

    half = grid // 2 + 1
    own = lambda d, name, v: d.select(F.col("scan_id").alias(name), F.flatten(F.transform(F.sequence(F.lit(0), (F.size("v") / grid - 1).cast("int")), lambda i: F.slice("v", (i * grid + 1).cast("int"), half))).alias(v))
    a, b, counts, dims = measured(own(queries, "_qid", "_a"), own(base, "_cid", "_v"), "_a", "_v")

    def tensors(t: pa.Table, name: str) -> np.ndarray:
        return np.concatenate([x.flatten().to_numpy() for x in t[name].chunks]).astype(np.float32, copy=False).reshape(len(t), -1, grid, half)

    def whole(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, v[..., (grid - 1) // 2 : 0 : -1]], axis=2).astype(float)

    def run(x: pa.Table, y: pa.Table) -> list[np.ndarray]:
        q, m, own_ids, ids, got = tensors(x, "_a"), tensors(y, "_v"), x["_qid"].to_numpy(), y["_cid"].to_numpy(), []
        scale = np.sqrt(grid) * 0.15 * q.shape[1] * grid * grid
        for i, near in _near_tensors(q, m, k, grid, scale):
            one = whole(q[i])
            found = sorted((-round(s, 6), ids[j], s, turn) for j in near for s, turn in [circular_score(one, whole(m[j]))])
            got += [(own_ids[i], j, s, turn) for _, j, s, turn in found[:k]]
        return [np.array(v) for v in zip(*got)]

    rows = min(TENSOR_ROWS, max(64, -(-max(counts) // TENSOR_BLOCKS)))
    found = meet(a, b, "_qid", "_cid", run, "query_id bigint, map_id bigint, score double, turn int", counts, 4 * dims, rows, TENSOR_BYTES)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "map_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
