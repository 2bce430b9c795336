"""Divergence audit of sources: how the words of one source differ from another's and from its language's.

Tasks count the terms of their documents by (language, source), and one shuffle by (language, term) brings a term's counts of
all sources together: the terms that stand in enough documents of a language are kept. They are dealt out in blocks. A block
is a dense int64 matrix, sources by terms, of fixed-point shares, worked on a tile of a few terms at a time: all pairs of its
sources are compared at once by broadcasting, and tiles add up to the block's matrix of pairs and to one heap a source of the
terms that are most over the language's share. Blocks send only those; pair matrices are summed and heaps merged by Spark.

A block holds at least as many counts as it has pairs, so that what blocks send never outgrows the counts. Languages with more than
``SOURCES`` sources are cut in groups of sources by a hash, and each pair of groups is a block of its own.

Defined results: null text, language and source count as ''; a group without terms is still a group, its shares are those of
counts of zero; where a language keeps no term, pairs have the value 0 and no term is listed; repeated rows count each; other
columns are not read; an empty table gives an empty table. Arithmetic is exact: shares are floors of fractions of integers,
found by long division, right up to 2^53 words of one language.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placerec.llm import textkernel as K
from placerec.llm.shared import cut

LEAST_DOCS, SCALE, ADD, TOP = 30, 10**9, 5, 50
#: Counts of a block (more where there are more pairs), sources of a group, numbers of one tile's broadcast.
BLOCK_COUNTS, SOURCES, TILE = 1 << 14, 512, 1 << 18
#: A task sends its counts on when it holds so many.
HELD_COUNTS = 1 << 19

#: Bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[0x61:0x7B] = True
TERM_BYTES[0x80:] = True


def batch_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of a batch."""
    groups = pa.table({"lang": langs, "source": sources}).group_by(["lang", "source"], use_threads=False).aggregate([])
    group = pa.table({"lang": langs, "source": sources, "at": pa.array(np.arange(len(langs)))}).join(groups.append_column("g", pa.array(np.arange(len(groups)))), ["lang", "source"], use_threads=False).sort_by("at").column("g").to_numpy()
    out = []
    buf, offs = K.flat(texts)
    for i, j, part, at in K.chunks(buf, offs):
        low = K.LOWER[part]
        starts, ends, per = K.words(low, at, TERM_BYTES)
        if not len(starts):
            continue
        inside = TERM_BYTES[low]
        terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)), pa.py_buffer(low[inside])]).dictionary_encode()
        code, words = terms.indices.to_numpy().astype(np.int64), terms.dictionary.cast(pa.string())
        # a term once a document, with its number there; then by group
        seen, n = np.unique(np.repeat(np.arange(i, j), per) * len(words) + code, return_counts=True)
        key, back = np.unique(group[seen // len(words)] * len(words) + seen % len(words), return_inverse=True)
        g = pa.array(key // len(words))
        out.append(pa.table([groups.column("lang").take(g), groups.column("source").take(g), words.take(pa.array(key % len(words))), pa.array(np.bincount(back, n).astype(np.int64)), pa.array(np.bincount(back))], COUNTS))
    return _summed(out) if out else None


COUNTS = ["lang", "source", "term", "n", "docs"]


def _summed(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).combine_chunks()
    t = t.group_by(COUNTS[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select([*COUNTS[:3], "n_sum", "docs_sum"]).rename_columns(COUNTS)


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs) of what each task has read, summed up there."""
    part = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            got = batch_counts(*(batch.column(k) for k in range(3)))
            if got is None:
                continue
            held.append(got)
            rows += len(got)
            if rows >= HELD_COUNTS:
                held = [_summed(held)]
                rows = len(held[0])
                if rows >= HELD_COUNTS // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
        if held:
            yield from _summed(held).to_batches(max_chunksize=1 << 16)

    return part.mapInArrow(K.releasing(run), "lang string, source string, term string, n bigint, docs bigint")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / total), elementwise, by three steps of long division; 0 where the total is 0."""
    den = np.maximum(totals, 1)
    whole, rest = np.divmod(counts + ADD, den)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, den)
        whole = whole * 1000 + digit
    return np.where(totals > 0, 1 + whole, 0)


def _block(key: tuple, terms: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Sums of all pairs of sources and the heaps of each source, of the terms of one block."""
    a, b = key[1].as_py(), key[2].as_py()
    out = {c: [] for c in ("lang", "source", "item", "value", "covered")}
    lang_of = np.array(terms.column("lang").to_pylist(), object)
    groups = groups.sort_by([("lang", "ascending"), ("source", "ascending")])
    names, of_lang = groups.column("source").to_pylist(), np.array(groups.column("lang").to_pylist(), object)
    sides, total = groups.column("side").to_numpy(), groups.column("total").to_numpy()
    of_all = groups.column("lang_total").to_numpy()
    for lang in sorted(set(of_lang.tolist())):
        mine = np.flatnonzero(of_lang == lang)
        place = {names[i]: k for k, i in enumerate(mine.tolist())}
        left, right = (np.flatnonzero(sides[mine] == s) for s in (a, b))
        pairs, heaps = np.zeros((len(left), len(right)), np.int64), [[] for _ in left]
        at = np.flatnonzero(lang_of == lang)
        m, width = total[mine], max(1, TILE // max(1, len(left) * len(right)))
        for k in range(0, len(at), width):
            tile = terms.take(pa.array(at[k : k + width]))
            lists = tile.column("counts").combine_chunks()
            column = np.repeat(np.arange(len(tile)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            dense = np.zeros((len(mine), len(tile)), np.int64)
            dense[[place[s] for s in flat.field("source").to_pylist()], column] = flat.field("n").to_numpy()
            p = shares(dense, m[:, None])
            pairs += np.abs(p[left][:, None, :] - p[right][None, :, :]).sum(-1)
            if a == b:
                words = [w.encode() for w in tile.column("term").to_pylist()]
                q = shares(tile.column("n").to_numpy(), of_all[mine[:1]])
                over = np.where(dense[left] > 0, p[left] - q, 0)
                for g, h in enumerate(heaps):
                    for t in np.flatnonzero(over[g] > (-h[-1][0] - 1 if len(h) == top else 0)).tolist():
                        h.append((-int(over[g, t]), words[t]))
                    heaps[g] = heapq.nsmallest(top, h)
        for i, x in enumerate(left.tolist()):
            for j, y in enumerate(right.tolist()):
                if a != b or x < y:
                    for c, v in zip(out, (lang, names[mine[x]], names[mine[y]], int(pairs[i, j]), len(at)), strict=True):
                        out[c].append(v)
            for v, w in heaps[i]:
                for c, o in zip(out, (lang, names[mine[x]], w.decode(), -v, -1), strict=True):
                    out[c].append(o)
    return pa.table([pa.array(v, pa.string() if c in ("lang", "source", "item") else pa.int64()) for c, v in out.items()], list(out))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, most_sources: int = SOURCES, block_counts: int = BLOCK_COUNTS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source of the language, ``term`` rows for the terms most over its share."""
    counts = term_counts(docs, text_col, lang_col, source_col)
    # all of a term in one place, so that both sums below need no shuffle of their own
    by_term = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_term.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("counts"), F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "n", "counts"), "kept-terms")
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("words"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_words"))
    # one row a group from here on
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))])
    groups = named.distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.select("lang", "source", "v", (F.col("words") + ADD * F.col("v")).alias("total"), (F.col("lang_words") + ADD * F.col("v")).alias("lang_total"))
    groups = cut(groups, "lang-groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    held = kept.agg(F.sum(F.size("counts"))).first()[0] or 0
    sides = max(1, -(-most // most_sources))
    blocks = max(1, held // max(block_counts, min(most, most_sources) ** 2))
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides)).cast("int")
    both = F.explode(F.expr(f"flatten(transform(sequence(0, {sides - 1}), a -> transform(sequence(a, {sides - 1}), b -> struct(a, b))))"))
    terms = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int")).withColumn("ab", both)
    mine = F.filter("counts", lambda c: (side(c["source"]) == F.col("ab.a")) | (side(c["source"]) == F.col("ab.b")))
    terms = terms.select("block", "ab.a", "ab.b", "lang", "term", "n", mine.alias("counts")).where(F.size("counts") > 0)
    heads = groups.withColumn("side", side(F.col("source"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("ab", both)
    heads = heads.where((F.col("side") == F.col("ab.a")) | (F.col("side") == F.col("ab.b"))).select("block", "ab.a", "ab.b", "lang", "source", "side", "total", "lang_total")
    keys = ["block", "a", "b"]

    def block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _block(key, left, right, top)

    found = cut(terms.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(block, "lang string, source string, item string, value bigint, covered bigint"), "divergence")
    one = groups.select("lang", "source", "v", F.when(F.col("total") > 0, 1 + F.expr(f"({SCALE}L * {ADD}) div total")).otherwise(F.lit(0)).alias("zero"))
    pairs = found.where("covered >= 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
    # terms that neither of the two sources has are in no block of theirs: they differ by the shares of a count of zero
    pairs = pairs.join(one, ["lang", "source"]).join(one.select("lang", F.col("source").alias("item"), F.col("zero").alias("other")), ["lang", "item"])
    pairs = pairs.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("covered")) * F.abs(F.col("zero") - F.col("other"))).alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    listed = found.where("covered < 0").select("lang", "source", "item", "value", F.lit("term").alias("part"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda d: d.withColumn("rank", F.row_number().over(by))
    return ranked(pairs).unionByName(ranked(listed).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


#: The same result of the documents table in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::BIGINT AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS n FROM k GROUP BY 1),
m AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT + 5 * coalesce(any_value(l.v), 0) AS total FROM g LEFT JOIN c USING (lang, source) LEFT JOIN l ON l.lang = g.lang GROUP BY 1, 2),
p AS (SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // m.total AS p, 1 + (1000000000 * (k.n + 5)) // (l.n + 5 * l.v) AS q
  FROM m JOIN k ON k.lang = m.lang JOIN l ON l.lang = m.lang LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""
