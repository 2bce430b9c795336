"""N-gram Jaccard join with signature trees.

Documents whose shingle sets are equal form a class, told apart by a 128-bit digest.
Two sets of the wanted similarity share a token among the first few of each in any order
common to all (prefix filter); the order takes tokens of rare words first and tokens that a
sample of texts holds often last. Every such token is a bucket of classes, cut by size (a link
keeps sizes within the similarity); buckets of equal members are one.

In a bucket, classes are leaves of a signature tree: nodes hold OR- and AND-combined
token bitmaps and size ranges. A dual traversal of the tree with itself drops node
pairs whose greatest possible overlap is too small, or that are joined already. What it leaves
is not emitted pair by pair but as a forest: which classes may hang together (a *family*).
Buckets of more than ``HOT`` classes are not walked, their classes are one family.

Then every class goes to its family once, with its text, and the same trees are walked with
exact overlaps: a task returns a forest of at most a link a row. A family of more than
``BLOCK`` classes is dealt out in blocks: first each block for itself, then one class of each part
found, and at last, of classes that are still apart from the largest part, each block with
every other block; rows of the largest part are not compared with each other again.

Defined results: a null or wordless text has no shingles and is linked with nothing; a
text of fewer words than a shingle is one shingle; repeated rows are copies; a null id
gets a null component unless another copy has an id; rows that share an id but not the text are
documents of their own; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerec.llm import textkernel as K
from placerec.llm.components import components
from placerec.llm.shared import cut, drop, maybe_among

#: The order of tokens comes from about so many texts: counts of words by slot, and of tokens held OFTEN times or more.
SAMPLE_DOCS, OFTEN, MOST_OFTEN, WORD_SLOTS = 16_384, 3, 1 << 20, 1 << 18
FANOUT, HOT, BLOCK, BLOCK_TOKENS, FEW, RUN_ROWS, RUN_BYTES = 8, 8192, 2048, 1 << 19, 4, 20_000, 6 << 20
#: The least and most bits of a bitmap, as powers of two; exact walks use EXTRA times as many.
LEAST_BITS, MOST_BITS, EXTRA = 6, 14, 8
#: So many classes of a family are compared one by one, and so many bytes of exact bitmaps are built for more.
PLAIN, EXACT_BYTES = 12, 32 << 20
#: A task remembers so many digests, to send tokens of copies once.
SEEN = 200_000


def shingle_sets(texts: pa.Array, k: int):
    """(first row, end row, sorted distinct shingle hashes behind each other, offsets)."""
    buf, offs = K.flat(texts)
    for i, j, part, at in K.chunks(buf, offs):
        part = K.LOWER[part]
        starts, ends, per = K.words(part, at, K.SPACE_WORDS)
        values, text = K.shingles(K.span_hashes(part, starts, ends), per, k)
        yield (i, j, *K.distinct_sets(values, text, j - i))


def _weighted_sets(texts: pa.Array, k: int, rarity: np.ndarray):
    """As :func:`shingle_sets`, and of each shingle the sum of its words' weights."""
    buf, offs = K.flat(texts)
    for i, j, part, at in K.chunks(buf, offs):
        part = K.LOWER[part]
        starts, ends, per = K.words(part, at, K.SPACE_WORDS)
        hashes = K.span_hashes(part, starts, ends)
        values, text = K.shingles(hashes, per, k)
        sums = np.concatenate([[0], np.cumsum(rarity[(hashes & np.uint64(WORD_SLOTS - 1)).astype(np.int64)])])
        left = np.repeat(np.cumsum(per), per) - np.arange(len(hashes))
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        begins = np.sort(np.concatenate([np.flatnonzero(left >= k), first[(per > 0) & (per < k)]]))
        weight = sums[np.minimum(begins + k, len(hashes))] - sums[begins]
        weight[per[text] < k] = 0  # the only shingle of its text
        at = np.searchsorted(text, np.arange(j - i + 1))
        order = np.empty(len(values), np.int64)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            order[a:b] = a + np.argsort(values[a:b])
        v, w = values[order], weight[order]
        keep = np.ones(len(v), bool)
        keep[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
        yield i, j, v[keep], w[keep], np.searchsorted(text[keep], np.arange(j - i + 1))


def _need(n, percent: int):
    """The least overlap of a set of n with one it links to."""
    return -(-percent * n // 100)


def _fold(bits: bytes) -> bytes:
    """The bitmap at half its width, as the smaller sizes of its bucket have it."""
    x = np.frombuffer(bits, np.uint8)
    return (x[: len(x) // 2] | x[len(x) // 2 :]).tobytes()


def size_class(n: int) -> int:
    """Bitmaps of a set of n have 2 to this power bits, one to two a token."""
    return min(max(int(n - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _order(docs: DataFrame, k: int, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that a sample holds often (at most MOST_OFTEN) and their counts, and a weight of words by slot of their hash.

    Nothing but the choice of tokens depends on it; any order gives the same links.
    """
    n = docs.count()
    part = docs.select(text_col)
    part = part.sample(SAMPLE_DOCS / n, seed=5) if n > SAMPLE_DOCS else part

    def run(batches):
        slots = np.zeros(WORD_SLOTS, np.int64)
        for batch in batches:
            for _, _, values, _ in shingle_sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(values), bool)), pa.array(values.view(np.int64)), pa.array(np.ones(len(values), np.int64))], ["word", "token", "n"])
            buf, offs = K.flat(batch.column(0))
            for _, _, text, at in K.chunks(buf, offs):
                text = K.LOWER[text]
                starts, ends, _ = K.words(text, at, K.SPACE_WORDS)
                slots += np.bincount((K.span_hashes(text, starts, ends) & np.uint64(WORD_SLOTS - 1)).astype(np.int64), minlength=WORD_SLOTS)
        at = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), pa.array(at), pa.array(slots[at])], ["word", "token", "n"])

    got = part.mapInArrow(K.releasing(run), "word boolean, token bigint, n bigint").groupBy("word", "token").agg(F.sum("n").alias("n"))
    got = cut(got.where(f"word or n >= {OFTEN}"), "order")
    least, total = OFTEN, 0
    for row in sorted(got.where("not word").groupBy("n").count().collect(), reverse=True):  # a row a count, at most SAMPLE_DOCS or so
        total += row["count"]
        if total > MOST_OFTEN:
            least = row["n"] + 1
            break
    often, words = got.where(f"not word and n >= {least}").toArrow(), got.where("word").toArrow()
    drop(got)
    token, count = often["token"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(token)
    rarity = np.zeros(WORD_SLOTS, np.int64)
    rarity[words["token"].to_numpy()] = np.round(16 * np.log2(1 + words["n"].to_numpy()))
    return token[order], count[order], rarity


def signatures(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, h2, prefix tokens, bitmap) of every text; the last two of a task's copies, and of rows without id, are left out."""
    share = docs.sparkSession.sparkContext.broadcast(_order(docs, k, text_col))

    def run(batches):
        often, counts, rarity = share.value
        seen: set[bytes] = set()
        for batch in batches:
            nulls = batch.column(0).is_null().to_pylist()
            for i, j, values, rare_sum, offs in _weighted_sets(batch.column(1), k, rarity):
                if len(often):
                    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                    weight = np.where(often[at] == values, counts[at] << 20, 0) + rare_sum
                else:
                    weight = rare_sum
                digests, prefixes, bitmaps = [], [], []
                none = np.zeros(0, np.uint64)
                for row, a, b in zip(range(i, j), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    s, w, n = values[a:b], weight[a:b], b - a
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    digests.append(np.frombuffer(digest, np.int64))
                    if not n or nulls[row] or digest in seen:
                        prefixes.append(none)
                        bitmaps.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    take = n - _need(n, percent) + 1
                    head = np.argpartition(w, take - 1)[:take] if take < n else np.arange(n)
                    edge = w[head].max()  # ties at the edge by hash
                    head = np.concatenate([np.flatnonzero(w < edge), np.flatnonzero(w == edge)])[:take]
                    prefixes.append(s[head[np.lexsort((s[head], w[head]))]])
                    bits = np.zeros(1 << size_class(n), np.uint8)
                    bits[(s >> np.uint64(20)) & np.uint64(len(bits) - 1)] = 1
                    bitmaps.append(np.packbits(bits, bitorder="little").tobytes())
                digests = np.array(digests).reshape(-1, 2)
                lens = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
                flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(offs), pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                    pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat)), pa.array(bitmaps, pa.binary()),
                ], ["id", "n", "h1", "h2", "prefix", "bits"])

    part = docs.select(id_col, text_col)
    return part.mapInArrow(K.releasing(run), f"id {part.schema[id_col].dataType.simpleString()}, n bigint, h1 bigint, h2 bigint, prefix array<bigint>, bits binary")


class Walk:
    """Joins the rows of many buckets (sorted by bucket) that may link, or do if ``check(a, b)`` tells so.

    ``root`` names the part of each row; rows of one bucket and one ``label`` belong together from the start.
    """

    def __init__(self, bucket: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int, guest: np.ndarray | None = None, label: np.ndarray | None = None, check=None):
        self.bucket = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]).astype(np.int64)]))
        self.n, self.bits, self.percent, self.check = n, bits, percent, check
        self.guest = np.zeros(len(n), bool) if guest is None else guest
        self.root = np.arange(len(n))
        if label is not None:
            order = np.lexsort((label, self.bucket))
            head = np.ones(len(n), bool)
            head[1:] = (label[order][1:] != label[order][:-1]) | (self.bucket[order][1:] != self.bucket[order][:-1])
            self.root[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        self.first = self.root.copy()
        self._pivots()
        self._trees()

    def _fit(self, some, every, low, high, guest, same, a, b) -> np.ndarray:
        """Which node pairs can hold a link between parts."""
        p = self.percent
        fit = (100 * high[a] >= p * low[b]) & (100 * high[b] >= p * low[a]) & ~(guest[a] & guest[b])
        fit &= (same[a] < 0) | (same[a] != same[b])
        at = np.flatnonzero(fit)
        few = max(1, (1 << 19) // some.shape[1])
        for c in range(0, len(at), few):
            i = at[c : c + few]
            x, y = a[i], b[i]
            over_x = high[x] - np.bitwise_count(every[x] & ~some[y]).sum(1, dtype=np.int64)
            over_y = high[y] - np.bitwise_count(every[y] & ~some[x]).sum(1, dtype=np.int64)
            # overlap o of sizes s and t links if 100 o >= p (s + t - o)
            fit[i] = ((100 + p) * over_x >= p * (high[x] + low[y])) & ((100 + p) * over_y >= p * (high[y] + low[x]))
        return fit

    def _linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which row pairs of different parts link."""
        ok = self._fit(self.bits, self.bits, self.n, self.n, self.guest, self.root, a, b)
        if self.check is not None and ok.any():
            at = np.flatnonzero(ok)
            ok[at] = self.check(a[at], b[at])
        return ok

    def _pivots(self) -> None:
        """A few rows of each bucket are compared with all others of it: most parts are found by then."""
        done = np.zeros(len(self.n), bool)
        for _ in range(FEW):
            wait = np.flatnonzero(~done)
            if not len(wait):
                return
            b = self.bucket[wait]
            pivot = np.full(int(self.bucket[-1]) + 1, -1)
            head = np.concatenate([[True], b[1:] != b[:-1]])
            pivot[b[head]] = wait[head]
            mine = pivot[self.bucket]
            rows = np.flatnonzero((mine >= 0) & (self.root != self.root[mine]))
            rows = rows[self._linked(mine[rows], rows)]
            up = np.arange(len(self.n))
            up[self.root[rows]] = self.root[mine[rows]]
            self.root = up[self.root]
            done |= (mine >= 0) & (self.root == self.root[mine])

    def _trees(self) -> None:
        starts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]]))
        mixed = np.minimum.reduceat(self.root, starts) != np.maximum.reduceat(self.root, starts)
        rows = np.flatnonzero(mixed[self.bucket])
        if not len(rows):
            return
        rows = rows[np.lexsort((self.n[rows], self.root[rows], self.bucket[rows]))]
        bucket = self.bucket[rows]
        bits, n = self.bits[rows], self.n[rows]
        levels = [(bits, bits, n, n, self.guest[rows], self.root[rows], None, None)]
        while True:
            some, every, low, high, guest, same, _, _ = levels[-1]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            if len(starts) == len(bucket):
                break
            rank = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(bucket)]])))
            first = np.flatnonzero(rank % FANOUT == 0)
            top, bottom = np.maximum.reduceat(same, first), np.minimum.reduceat(same, first)
            levels.append((np.bitwise_or.reduceat(some, first), np.bitwise_and.reduceat(every, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.logical_and.reduceat(guest, first), np.where(top == bottom, top, -1), first, np.diff(np.concatenate([first, [len(bucket)]]))))
            bucket = bucket[first]
        top = np.arange(len(levels[-1][2]))
        stack = [(len(levels) - 1, top, top)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                a, b = rows[a], rows[b]
                apart = self.root[a] != self.root[b]
                a, b = a[apart], b[apart]
                ok = self._linked(a, b)
                self._join(a[ok], b[ok])
                continue
            fit = self._fit(*levels[level][:6], a, b)
            if level > 0:
                fit |= a == b  # a node with itself: its rows differ
                fit &= (levels[level][5][a] < 0) | (a != b)
            a, b = a[fit], b[fit]
            first, count = levels[level][6:]
            for c in range(0, len(a), 2048):
                x, y = a[c : c + 2048], b[c : c + 2048]
                many = count[x] * count[y]
                x, y, i = np.repeat(x, many), np.repeat(y, many), np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                u, v = first[x] + i // count[y], first[y] + i % count[y]
                keep = (x != y) | ((u <= v) if level > 1 else (u < v))
                stack.append((level - 1, u[keep], v[keep]))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        pairs = np.unique(np.stack([self.root[a], self.root[b]], 1), axis=0).tolist()
        up: dict[int, int] = {}

        def find(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = up[x]
            return x

        for x, y in pairs:
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        old = np.array(sorted(up))
        if len(old):
            to = np.arange(len(self.root))
            to[old] = [find(int(x)) for x in old]
            self.root = to[self.root]

    def forest(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least name of a part, name) of each row, or label, that is not the first of its part."""
        order = np.lexsort((name, self.root))
        head = np.concatenate([[True], self.root[order][1:] != self.root[order][:-1]])
        least = np.empty(len(order), name.dtype)
        least[order] = name[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        at = np.flatnonzero((self.first == np.arange(len(name))) & (least != name))
        return least[at], name[at]


def _bitmaps(values: np.ndarray, offs: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of ``width`` bits of each set, 64 a word."""
    out = np.zeros((len(offs) - 1, width // 64), np.uint64)
    bit = (values >> np.uint64(20)) & np.uint64(width - 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _exact(values: np.ndarray, offs: np.ndarray, percent: int):
    """check(a, b): which pairs of sets link, by their whole overlap."""
    n, row = np.diff(offs), np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    number, count = np.cumsum(new) - 1, np.diff(np.concatenate([np.flatnonzero(new), [len(v)]]))
    both = count >= 2  # a token of one set is in no overlap
    width = max(1, -(-int(both.sum()) // 64))
    if len(n) * width * 8 > EXACT_BYTES:
        sets = [values[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        over = lambda a, b: np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        place = np.cumsum(both) - 1
        kept = both[number]
        at, r = place[number[kept]].astype(np.uint64), row[order][kept]
        bits = np.zeros((len(n), width), np.uint64)
        np.bitwise_or.at(bits, (r, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        few = max(1, (1 << 19) // width)
        over = lambda a, b: np.concatenate([np.bitwise_count(bits[a[c : c + few]] & bits[b[c : c + few]]).sum(1, dtype=np.int64) for c in range(0, len(a), few)])

    def check(a, b):
        o = over(a, b)
        return 100 * o >= percent * (n[a] + n[b] - o)

    return check


def _families(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y): a forest of the classes of each bucket that bitmaps and sizes do not keep apart; rows come sorted by size and key."""

    def solve(t: pa.Table):
        maps = [_fold(b) if g else b for b, g in zip(t["bits"].to_pylist(), t["fold"].to_pylist(), strict=True)]
        bits = np.frombuffer(b"".join(maps), np.uint64).reshape(t.num_rows, -1)
        walk = Walk(t["key"].to_numpy(), t["n"].to_numpy(), bits, percent, t["guest"].to_numpy())
        x, y = walk.forest(t["h1"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    def run(batches):
        for t in _whole_keys(batches):
            size = t["size"].to_numpy()
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield solve(t.slice(a, b - a))

    return rows.mapInArrow(K.releasing(run), "x bigint, y bigint")


def _whole_keys(batches):
    """Tables of whole (size, key) runs, of about RUN_ROWS rows or RUN_BYTES bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= RUN_ROWS or sum(b.nbytes for b in held) >= RUN_BYTES:
            t = pa.Table.from_batches(held)
            key, size = t["key"].to_numpy(), t["size"].to_numpy()
            whole = np.flatnonzero((key != key[-1]) | (size != size[-1]))
            if len(whole):
                end = int(whole[-1]) + 1
                yield t.slice(0, end)
                held = t.slice(end).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _links(docs: DataFrame, rows: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(x, y, alone): a forest of the classes that link, of the rows (key, size, id, h1, label, alone) that share a key.

    Classes of one label count as joined. Texts come by the class's smallest id; one of another set is passed over.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # a filter of fixed size keeps most texts that no family needs out of the shuffle
    d = maybe_among(d, rows, "id").where("__maybe").select("id", "text")
    dealt = d.join(rows, "id").drop("id").repartition("key").sortWithinPartitions("size", "key")

    def solve(h1, label, values, offs, size):
        n = np.diff(offs)
        if len(n) <= PLAIN:
            root = [int(np.flatnonzero(label == x)[0]) for x in label]
            first = list(root)
            for i in range(len(n)):
                for j in range(i):
                    s, t = int(n[i]), int(n[j])
                    if root[i] == root[j] or 100 * min(s, t) < percent * max(s, t):
                        continue
                    o = len(np.intersect1d(values[offs[i] : offs[i + 1]], values[offs[j] : offs[j + 1]], assume_unique=True))
                    if 100 * o >= percent * (s + t - o):
                        a, b = root[i], root[j]
                        root = [b if r == a else r for r in root]
            least: dict[int, int] = {}
            for r, x in zip(root, h1.tolist(), strict=True):
                least[r] = min(x, least.get(r, x))
            out = [(least[root[i]], int(h1[i])) for i in range(len(n)) if first[i] == i and least[root[i]] != h1[i]]
            return np.array([x for x, _ in out], np.int64), np.array([y for _, y in out], np.int64)
        walk = Walk(np.zeros(len(n), np.int64), n, _bitmaps(values, offs, 1 << size), percent, None, label, _exact(values, offs, percent))
        return walk.forest(h1)

    def run(batches):
        for t in _whole_keys(batches):
            key, h1, label, size, alone = (t[c].to_numpy() for c in ("key", "h1", "label", "size", "alone"))
            values, lens = [], []
            for c in t["text"].chunks:
                for _, _, v, o in shingle_sets(c, k):
                    values.append(v)
                    lens.append(np.diff(o))
            values, lens = np.concatenate(values), np.concatenate(lens)
            offs = np.concatenate([[0], np.cumsum(lens)])
            out = [[], [], []]
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pick, seen = [], set()
                for i in range(a, b):
                    name = int(h1[i])
                    if name not in seen and lens[i] and int.from_bytes(hashlib.blake2b(values[offs[i] : offs[i + 1]].tobytes(), digest_size=16).digest()[:8], "little", signed=True) == name:
                        seen.add(name)
                        pick.append(i)
                if len(pick) < 2:
                    continue
                at = np.array(pick)
                part = values[offs[a] : offs[b]] if len(at) == b - a else np.concatenate([values[offs[i] : offs[i + 1]] for i in pick])
                x, y = solve(h1[at], label[at], part, np.concatenate([[0], np.cumsum(lens[at])]), int(size[a]))
                out[0].append(x)
                out[1].append(y)
                out[2].append(np.full(len(x), alone[a]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["x", "y", "alone"])

    return dealt.mapInArrow(K.releasing(run), "x bigint, y bigint, alone boolean")


def _placed(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with the number of blocks their ``by`` is dealt out in, their own block, and the width of its bitmaps."""
    of = rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.max("n").alias("most"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    size = F.least(F.greatest(F.length(F.bin(F.col("most") - 1)), F.lit(LEAST_BITS)), F.lit(MOST_BITS)).cast("int") + EXTRA.bit_length() - 1
    of = of.select(by, blocks.alias("blocks"), size.alias("size"))
    return rows.join(of, by).withColumn("block", F.pmod(F.xxhash64("h1", F.lit(3)), F.col("blocks")).cast("int"))


def _groups(docs: DataFrame, rows: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, group): the least h1 that links reach, of the classes (h1, id, n, family) that have links."""
    link = lambda r: _links(docs, r.select("key", "size", "id", "h1", "label", "alone"), k, percent, id_col, text_col)
    placed = cut(_placed(rows, "family"), "placed")
    one = placed.select(F.xxhash64("family", "block").alias("key"), "size", "id", "h1", F.col("h1").alias("label"), (F.col("blocks") == 1).alias("alone"))
    found = cut(link(one), "links")
    own = lambda e: e.select(F.col("y").alias("h1"), F.col("x").alias("group"))
    alone = own(found.where("alone"))
    alone = alone.unionByName(alone.select(F.col("group").alias("h1"), "group").distinct())
    many = placed.where("blocks > 1")
    if many.isEmpty():
        return alone
    # one class of each part found so far, dealt out anew
    inner = found.where("not alone").select("x", "y")
    heads = many.select("h1", "id", "n", "family").join(inner.select(F.col("y").alias("h1")).distinct(), "h1", "left_anti")
    heads = _placed(heads, "family")
    across = cut(link(heads.select(F.xxhash64("family", "block", F.lit(1)).alias("key"), "size", "id", "h1", F.col("h1").alias("label"), F.lit(False).alias("alone"))).select("x", "y"), "links")
    links = inner.unionByName(across)
    node = components(links)
    # the rest: every block of rows outside a family's largest part with every block
    rest = many.drop("blocks", "block", "size").join(node.select(F.col("node").alias("h1"), "component"), "h1", "left").withColumn("label", F.coalesce("component", "h1")).drop("component")
    rest = cut(rest, "rest")
    count = rest.groupBy("family", "label").agg(F.count("*").alias("rows"))
    largest = count.groupBy("family").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("rows", "label")).alias("largest")).where("parts > 1").drop("parts")
    rest = rest.join(largest, "family").withColumn("minor", F.col("label") != F.col("largest")).drop("largest")
    sides = _placed(rest.withColumn("side", F.xxhash64("family", "minor")), "side")
    blocks = sides.groupBy("family", "minor").agg(F.max("blocks").alias("blocks"), F.max("size").alias("size")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    left = blocks.where("minor").select("family", F.col("block").alias("a"), F.col("size").alias("size_a"))
    pairs = left.join(blocks, "family").where("not minor or a <= block").select("family", "a", "block", "minor", F.greatest("size", "size_a").alias("size"), F.xxhash64("family", "a", "block", "minor").alias("key"))
    pairs = cut(pairs, "block-pairs")
    ends = pairs.select("family", F.lit(True).alias("minor"), F.col("a").alias("block"), "size", "key").unionByName(pairs.where("not minor or a <> block").select("family", "minor", "block", "size", "key"))
    last = sides.select("family", "minor", "block", "id", "h1", "label").join(ends, ["family", "minor", "block"])
    final = cut(link(last.withColumn("alone", F.lit(False))).select("x", "y").distinct(), "links")
    every = links.unionByName(final)
    node2 = node if final.isEmpty() else components(every)
    return alone.unionByName(node2.select(F.col("node").alias("h1"), F.col("component").alias("group")))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, the size of its shingle set, and the smallest id that links reach from it."""
    out = _grouped(docs, k, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, component_id) of every row."""
    if not 75 <= percent <= 100:
        raise ValueError("percent is 75 to 100: a slot of sizes spans two widths of bitmaps at most")
    sig = cut(signatures(docs, k, percent, id_col, text_col), "signatures")
    classes = cut(sig.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "classes")
    posts = sig.select("h1", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    # written, so that the join's partitions can be split where a token stands in very many rows
    shared = cut(posts.groupBy("token").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("token"), "shared")
    # spread by both columns, so that a token of many classes can be dealt out
    member = posts.join(shared, "token").repartition("token", "h1").distinct()
    # linked sizes lie in the same or in neighbouring bands; slot s holds the bands s - 1 and s
    step = -math.log(percent / 100) if percent < 100 else math.log(2.0)
    band = F.floor(F.log("n") / step).cast("int")
    member = member.withColumn("band", band).withColumn("slot", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    # if a token is the first that two sets share, what comes from it on holds their whole overlap
    least_n = F.greatest(F.floor(F.exp((F.col("slot") - 1) * step) - 1e-6), F.lit(1)).cast("long")
    need = F.ceil((F.col("n") + least_n) * percent / F.lit(100.0 + percent) - 1e-9)
    member = member.where(F.col("pos") <= F.col("n") - need)
    member = cut(member.select("token", "slot", "band", "h1", "n"), "members")
    mark = lambda salt: F.bit_xor(F.xxhash64("h1", F.lit(salt)))
    slots = member.groupBy("token", "slot").agg(F.count("*").alias("rows"), F.max("band").alias("top"), F.min("h1").alias("first"), mark(1).alias("m1"), mark(2).alias("m2")).where("rows > 1 and top = slot")
    # buckets of the same members are one
    buckets = slots.groupBy("slot", "rows", "m1", "m2").agg(F.min("token").alias("token"), F.min("first").alias("first")).select("token", "slot", "rows", "first")
    buckets = cut(buckets, "buckets")
    lives = member.join(buckets, ["token", "slot"])
    hot = lives.where(F.col("rows") > HOT).where("first <> h1").select(F.col("first").alias("x"), F.col("h1").alias("y"))
    width = lambda n: F.least(F.greatest(F.length(F.bin(n - 1)), F.lit(LEAST_BITS)), F.lit(MOST_BITS)).cast("int")
    size = width(least_n)
    lives = lives.where(F.col("rows") <= HOT).withColumns({"size": size, "fold": width(F.col("n")) > size, "guest": F.col("band") < F.col("slot"), "key": F.xxhash64("token", "slot")})
    bits = sig.where("bits is not null").select("h1", "bits").dropDuplicates(["h1"])
    lives = lives.select("key", "size", "fold", "guest", F.col("n").cast("long").alias("n"), "h1").join(bits, "h1")
    open_ = cut(_families(lives.repartition("key").sortWithinPartitions("size", "key"), percent).unionByName(hot).distinct(), "families")
    drop(member, shared, buckets)
    if open_.isEmpty():
        return sig.join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left").select("id", "n", "h1", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("component_id"))
    family = components(open_)
    rows = classes.where("rep is not null").join(family.select(F.col("node").alias("h1"), F.col("component").alias("family")), "h1").select("h1", F.col("rep").alias("id"), "n", "family")
    groups = cut(_groups(docs, rows, k, percent, id_col, text_col), "groups")
    drop(open_, family)
    # the smallest id of each group
    named = classes.join(groups, "h1").groupBy("group").agg(F.min("rep").alias("least"))
    place = classes.join(groups.join(named, "group").select("h1", "least"), "h1", "left").select("h1", "h2", F.coalesce("least", "rep").alias("component_id"))
    return sig.select("id", "n", "h1", "h2").join(place, ["h1", "h2"], "left").select("id", "n", "h1", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that a document of a smaller id stands for.

    Of rows that share an id and the shingle set one stays; rows that share an id alone are told apart by their set.
    Rows with a null id stay.
    """
    names = docs.columns
    groups = cut(_grouped(docs, k, percent, id_col, text_col).where(F.col("id").isNotNull()).select("id", "h1", (F.col("component_id") < F.col("id")).alias("gone")), "groups")
    many = cut(groups.groupBy("id").agg(F.count("*").alias("rows"), F.max("gone").alias("gone")).where("rows > 1 or gone"), "gone")
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the input clashes with one used here
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    marked = maybe_among(safe, many, key)
    stay = marked.where("not __maybe").drop("__maybe")
    rest = marked.where("__maybe").drop("__maybe").join(many, F.col(key) == F.col("id"), "left").drop("id")
    single = rest.where("rows is null or rows = 1 and not gone").select(*safe.columns)
    # rows that share an id: by the digest of their set
    at, inner = names.index(text_col), safe.columns

    def digests(batches):
        for batch in batches:
            found = [int.from_bytes(hashlib.blake2b(v[a:b].tobytes(), digest_size=16).digest()[:8], "little", signed=True) for _, _, v, o in shingle_sets(batch.column(at), k) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*inner, "h1"])

    twice = rest.where("rows > 1").select(*safe.columns).mapInArrow(K.releasing(digests), T.StructType([*safe.schema.fields, T.StructField("h1", T.LongType())]))
    lost = groups.where("gone").select(F.col("id").alias(key), "h1").distinct()
    again = twice.join(lost, [key, "h1"], "left_anti").dropDuplicates([key, "h1"]).select(*safe.columns)
    return stay.unionByName(single).unionByName(again).toDF(*names)
