"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; the distances of a pivot are cut
into annuli, and annuli of more than ``BLOCK`` rows into blocks. Of each annulus the nearest and the
farthest distance from every pivot is kept. With norms known, a score bound is a distance bound, and the
triangle inequality over all pivots tells how near an annulus can be to a query. A query opens its annuli
in the order of these bounds, ``ROUNDS`` of them at a time; between the rounds its k-th score so far
becomes its floor, and it stops at the first annulus whose bound lies below. No row is copied for
different queries: blocks are dealt out to owners of about ``OWNED_BYTES``, and the rows of an owner's blocks
wait in a task while the queries that ask for any of them stream past. A query is sent once to an owner, with the
numbers of the blocks it asks for, so what is sent grows with owners, not with blocks.

Scores are integers computed in double precision, exact while
``256 ** 2 * dimensions * max|x| ** 2`` stays below 2 ** 53; vectors that could go beyond are an error.

Defined results: a vector that is null or holds a null or non-finite component takes no
part; shorter vectors count as padded with zeros; equal scores go to the smaller id;
an id that stands on several rows counts as one candidate a row, but never for itself, and as
a query it gets the best of all its rows; rows with a null id take no part; an empty table gives
an empty table; only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerec.llm.shared import cut, drop

PIVOTS, ANNULI, BLOCK, SAMPLE, SCALE, OWNED_BYTES = 32, 12, 2048, 4096, 256, 32 << 20
#: Up to so many annuli in the order of bounds are open after each round; the last round may open all that are left.
ROUNDS = (6, 48, PIVOTS * ANNULI)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles, padded with zeros to ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = np.asarray(column.offsets)
    flat = np.asarray(column.values, np.float64)
    lens = np.diff(offs)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), lens)
    col = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[row, col] = flat[offs[0] : offs[-1]]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(x, pivots)
    p = d.argmin(1)
    return p, d[np.arange(len(x)), p]


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Lloyd's means of a bounded sample, begun at rows far from each other."""
    got = [sample[0]]
    far = ((sample - got[0]) ** 2).sum(1)
    while len(got) < min(n, len(sample)) and far.max() > 0:
        got.append(sample[far.argmax()])
        far = np.minimum(far, ((sample - got[-1]) ** 2).sum(1))
    pivots = np.array(got)
    for _ in range(5):
        p, _ = _nearest(sample, pivots)
        for i in range(len(pivots)):
            if (p == i).any():
                pivots[i] = sample[p == i].mean(0)
    return pivots


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids and scores of each query's k best rows of one block, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    scores = q @ x[order].T
    n = len(ids)
    if n > k and np.abs(scores).max(initial=0) < (1 << 52) // n - 1 and len(np.unique(ids)) == n:
        # score and place in one number, so that ties are settled by the id
        mixed = scores * n - np.arange(n)[None, :]
        mixed[ids[None, :] == q_ids[:, None]] = -np.inf
        top = np.argpartition(mixed, n - k, axis=1)[:, n - k :]
        keep = np.take_along_axis(mixed, top, 1) > -np.inf
        return [(ids[t[m]], scores[i, t[m]]) for i, (t, m) in enumerate(zip(top, keep, strict=True))]
    out = []
    for i, me in enumerate(q_ids):
        s = scores[i]
        ok = ids != me
        if not ok.all():
            s, at = s[ok], ids[ok]
        else:
            at = ids
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > edge)
            pick = np.concatenate([above, np.flatnonzero(s == edge)[: k - len(above)]])
        else:
            pick = np.arange(len(s))
        out.append((at[pick], s[pick]))
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): the k best other rows of every row whose id is divisible by ``every``."""
    return search(vectors, k, every, id_col, vec_col, scale, measure=False)[0]


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, measure: bool = True) -> tuple[DataFrame, float]:
    """The result of :func:`top_k`, and the share of annuli that queries opened on average (counted by jobs of its own)."""
    spark = vectors.sparkSession
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    head = v.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    schema = f"query_id bigint, rank int, {id_col} bigint, score bigint"
    if not head.n:
        return spark.createDataFrame([], schema), 0.0
    dims = int(head.dims)
    if dims * (head.most or 0.0) ** 2 >= 1 << 53:
        raise ValueError("scores of such large components are not exact in double precision")
    # about SAMPLE rows: any pivots give the same result
    some = v if head.n <= SAMPLE else v.sample(SAMPLE / head.n, seed=3)
    rows = some.select("v").toArrow()["v"]
    rows = rows if len(rows) else v.limit(1).select("v").toArrow()["v"]
    sample = _matrix(rows, dims)
    pivots = _pivots(sample, PIVOTS)
    p, r = _nearest(sample, pivots)
    edges = np.array([np.quantile(r[p == i], np.linspace(0, 1, ANNULI + 1)[1:-1]) if (p == i).any() else np.zeros(ANNULI - 1) for i in range(len(pivots))])
    share = spark.sparkContext.broadcast((pivots, edges))

    def indexed(batches):
        pivots, edges = share.value
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            if not len(x):
                continue
            p, r = _nearest(x, pivots)
            cell = p * ANNULI + (r[:, None] > edges[p]).sum(1)
            packed = [row.astype("<f4").tobytes() if np.abs(row).max(initial=0) < 1 << 24 else row.astype("<f8").tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(packed, pa.binary())], ["row", "id", "cell", "x"])

    index = cut(v.select(F.monotonically_increasing_id().alias("row"), "id", "v").mapInArrow(indexed, "row bigint, id bigint, cell int, x binary"), "topk-index")
    unpack = lambda col: np.array([np.frombuffer(b, "<f4" if len(b) == 4 * dims else "<f8") for b in col.to_pylist()], np.float64).reshape(len(col), dims)

    def spans(batches):
        """Of each annulus in a task: rows, greatest norm, and least and greatest distance from every pivot."""
        pivots, _ = share.value
        n, norm = np.zeros(PIVOTS * ANNULI, np.int64), np.zeros(PIVOTS * ANNULI)
        low, high = np.full((PIVOTS * ANNULI, len(pivots)), np.inf), np.zeros((PIVOTS * ANNULI, len(pivots)))
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, x = batch.column("cell").to_numpy(), unpack(batch.column("x"))
            d = _distances(x, pivots)
            np.add.at(n, cell, 1)
            np.maximum.at(norm, cell, (x**2).sum(1))
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(norm[at]), pa.array(low[at].tolist(), pa.list_(pa.float64())), pa.array(high[at].tolist(), pa.list_(pa.float64()))], ["cell", "n", "norm2", "low", "high"])

    ends = index.mapInArrow(spans, "cell int, n bigint, norm2 double, low array<double>, high array<double>")
    ends = ends.select("cell", "n", "norm2", F.posexplode(F.arrays_zip("low", "high")).alias("p", "d")).groupBy("cell", "p").agg(F.sum("n").alias("n"), F.max("norm2").alias("norm2"), F.min("d.low").alias("low"), F.max("d.high").alias("high"))
    ends = ends.toPandas().sort_values(["cell", "p"])  # PIVOTS * ANNULI * PIVOTS rows at most
    cells = ends[ends.p == 0]
    reach = lambda c: ends[c].to_numpy(float).reshape(len(cells), -1)
    blocks = -(-cells.n.to_numpy() // BLOCK)
    table = spark.sparkContext.broadcast((cells.cell.to_numpy(), reach("low"), reach("high"), cells.norm2.to_numpy(float), blocks))
    per_cell = np.ones(PIVOTS * ANNULI, np.int64)
    per_cell[cells.cell.to_numpy()] = blocks
    of_cell = lambda values: F.element_at(F.array(*[F.lit(int(b)) for b in values]), F.col("cell") + 1)
    sub = F.pmod(F.xxhash64("row"), of_cell(per_cell)).cast("int")
    # blocks in the order of their cells are dealt out to owners in turn
    ahead = np.cumsum(per_cell) - per_cell
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-head.n * dims * 8 // OWNED_BYTES))

    def asked(start: int, end: int):
        def run(batches):
            """A query's row for each owner of blocks of the annuli that come next and whose bound reaches its floor."""
            pivots, _ = share.value
            cell, low, high, norm2, n_blocks = table.value
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    q = unpack(part.column("x"))
                    floor = np.array([-np.inf if f is None else f for f in part.column("floor").to_pylist()])
                    to, q2 = _distances(q, pivots), (q**2).sum(1)
                    gap = np.zeros((len(q), len(cell)))
                    for j in range(len(pivots)):
                        gap = np.maximum(gap, np.maximum(to[:, j, None] - high[None, :, j], low[None, :, j] - to[:, j, None]))
                    bound = (q2[:, None] + norm2[None, :] - gap**2) / 2
                    bound += 1e-6 * (1 + np.abs(bound))
                    order = np.argsort(-bound, axis=1, kind="stable")[:, start:end]
                    i, c = np.nonzero(np.take_along_axis(bound, order, 1) >= floor[:, None])
                    c = order[i, c]
                    reps = n_blocks[c]
                    i, c = np.repeat(i, reps), np.repeat(c, reps)
                    block = ahead[cell[c]] + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
                    owner = block % owners
                    by = np.lexsort((block, owner, i))
                    i, block, owner = i[by], block[by], owner[by]
                    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), bool), (i[1:] != i[:-1]) | (owner[1:] != owner[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(i)), pa.int32()), pa.array(block))
                    for b in range(0, len(heads), 20_000):
                        s = heads[b : b + 20_000]
                        at = pa.array(i[s])
                        yield pa.RecordBatch.from_arrays([pa.array(owner[s].astype(np.int32)), pa.array(np.ones(len(at), np.int32)), lists.slice(b, len(s)), part.column("row").take(at), part.column("id").take(at), part.column("floor").take(at), part.column("x").take(at)], ["owner", "side", "blocks", "row", "id", "floor", "x"])

        return run

    kinds = "owner int, side int, blocks array<bigint>, row bigint, id bigint, floor bigint, x binary"

    def match(batches):
        """An owner's rows come first and wait by block; the asking queries stream past."""
        key, held, ready = None, [], None
        for batch in batches:
            owner, side = batch.column("owner").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((owner[1:] != owner[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key != owner[a]:
                    key, held, ready = owner[a], [], None
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    held.append((part.column("id").to_numpy(), part.column("blocks").flatten().to_numpy(), unpack(part.column("x")).astype(np.float32 if head.most < 1 << 24 else np.float64)))
                    continue
                if ready is None:
                    ids, block, x = (np.concatenate(h) for h in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims)))
                    by, held = np.argsort(block, kind="stable"), []
                    ids, block, x = ids[by], block[by], x[by]
                    edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
                    ready = {int(block[u]): (ids[u:w], x[u:w]) for u, w in zip(edges[:-1], edges[1:], strict=True)}
                for c in range(0, part.num_rows, 512):
                    some = part.slice(c, 512)
                    me, rows, q = some.column("id").to_numpy(), some.column("row").to_numpy(), unpack(some.column("x"))
                    floor = np.array([-np.inf if f is None else f for f in some.column("floor").to_pylist()])
                    of, want = some.column("blocks").value_parent_indices().to_numpy(), some.column("blocks").flatten().to_numpy()
                    for block in np.unique(want).tolist():
                        if block not in ready:
                            continue
                        i = of[want == block]
                        got = _best(me[i], q[i], ready[block][0], ready[block][1].astype(np.float64), k)
                        lens = [len(f) for f, _ in got]
                        found, score = np.concatenate([f for f, _ in got]), np.concatenate([v for _, v in got])
                        i = np.repeat(i, lens)
                        ok = score >= floor[i]
                        yield pa.RecordBatch.from_arrays([pa.array(rows[i[ok]]), pa.array(me[i[ok]]), pa.array(found[ok]), pa.array(score[ok].astype(np.int64))], ["row", "query_id", "id", "score"])

    queries = index.where(F.col("id") % every == 0).select("row", "id", "x")
    best, start, opened, n_queries = None, 0, 0, queries.count() if measure else 0
    for end in ROUNDS:
        if best is None:
            now = queries.withColumn("floor", F.lit(None).cast("long"))
        else:
            floor = best.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            now = queries.join(floor, "row", "left")
        asks = cut(now.mapInArrow(asked(start, end), kinds), "topk-asks")
        block = F.explode("blocks").alias("block")
        # the cells of the blocks asked for, at most PIVOTS * ANNULI
        wanted = asks.select(block).distinct().select((F.size(F.filter(F.array(*[F.lit(int(a)) for a in ahead]), lambda a: a <= F.col("block"))) - 1).alias("cell")).distinct().collect()
        if not wanted:
            drop(asks)
            break
        if measure:
            opened += asks.select("row", block).join(spark.createDataFrame([(int(a),) for a in ahead[cells.cell.to_numpy()]], "block bigint"), "block").count()
        mine = of_cell(ahead).cast("long") + sub
        data = index.where(F.col("cell").isin([r.cell for r in wanted])).select(F.pmod(mine, F.lit(owners)).cast("int").alias("owner"), F.lit(0).alias("side"), F.array(mine).alias("blocks"), "row", "id", F.lit(None).cast("long").alias("floor"), "x")
        found = data.unionByName(asks).repartition(owners, "owner").sortWithinPartitions("owner", "side").mapInArrow(match, "row bigint, query_id bigint, id bigint, score bigint")
        found = found if best is None else found.unionByName(best)
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
        new = cut(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "topk-best")
        drop(asks, *([best] if best is not None else []))
        best, start = new, end
    drop(index)
    # rows of one id are one query
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    if best is None:
        return spark.createDataFrame([], schema), 0.0
    out = best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
    return out, opened / max(1, n_queries * len(cells)) if measure else math.nan


#: The same result of the embeddings table in DuckDB.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
