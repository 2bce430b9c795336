"""Substring dedup by content-defined chunking.

A gear rolling hash of the last 8 bytes chooses the cuts: before words at whose end it is less than at
the ends of their neighbours, and, inside long words and white space, at characters where it is. Whether
a cut falls at a place depends on a few neighbours on either side alone, in texts that repeat themselves
too, so that two copies of a passage are cut alike but for their edges. Neighbouring chunks are known by a 64-bit digest
of both. A pair that stands in several documents belongs to the one with the smallest id; in every
other document a run of such chunks of at least ``LEAST_WORDS`` words is taken out. Repeats inside one
document stay. In text without spaces ``WORD_BYTES`` bytes count as a word.

A shared passage of n words has at least n - 33 in chunks that both copies hold: at most 15 words are lost
at its end and 18 at its start, four of them because the hash still reaches before the passage, which takes
words of a single letter. So every passage of 51 words or more is found. A chunk holds at most 10 words, so a
passage that is one chunk alone is under the threshold.

Defined results: a null text stays null and holds no chunk; a text that is only repeats
becomes empty; of rows that share an id none is a repeat of the other; rows with a null id
stay whole, and nothing is taken out because of them; an
empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerec.llm import textkernel as K
from placerec.llm.shared import cut, free, maybe_among

WINDOW, LEAST_WORDS = 8, 18
#: (radius, apart, ahead) of :func:`_marks`, in words, and in characters where a text has no spaces.
WORD_MARKS, CHAR_MARKS = (2, 3, 4), (4, 5, 5)
#: Words and stretches of white space of more bytes than these are cut at characters.
LONG_WORD, LONG_SPACE = 24, 16
#: So many bytes of a long word count as one word of a run.
WORD_BYTES = 6
#: No chunk is longer: it holds at most 2 * apart + ahead words. Nothing is cut for its length.
MOST_BYTES = (2 * WORD_MARKS[1] + WORD_MARKS[2]) * (LONG_WORD + LONG_SPACE)
#: So many neighbouring chunks are looked up by one digest: single ones are short and may repeat by chance.
TOGETHER = 2
#: The gear table: 32 mixed bits of each byte's number. A byte moves the hash by four bits, so that it forgets it after ``WINDOW``.
GEAR, MOVE = (K.mix(np.arange(256, dtype=np.uint64)) >> np.uint64(7)).astype(np.uint32), np.uint32(4)


def _marks(values: np.ndarray, group: np.ndarray, radius: int, apart: int, ahead: int) -> np.ndarray:
    """The places to cut, found from their neighbours alone: at most 2 * apart + ahead places lie from one to the next.

    First those with a value less than all others within ``radius``; where none is within ``apart`` (values that
    repeat have no single least one), the last least value of any ``ahead`` neighbours.
    """
    n = len(values)
    first, near, out = np.ones(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for j in range(1, radius + 1):
        same = group[j:] == group[:-j]
        first[:-j] &= same & (values[:-j] < values[j:])
        first[j:] &= same & (values[j:] <= values[:-j])
        first[-j:] = first[:j] = False
    for j in range(1, apart + 1):
        same = group[j:] == group[:-j]
        near[j:] |= same & first[:-j]
        near[:-j] |= same & first[j:]
    m = n - ahead + 1
    if m > 0:
        best, at = values[:m].copy(), np.arange(m)
        for j in range(1, ahead):
            less = values[j : j + m] <= best
            best[less] = values[j : j + m][less]
            at[less] = np.flatnonzero(less) + j
        out[at[group[:m] == group[ahead - 1 :]]] = True
    return first | (out & ~near)


def _gear(buf: np.ndarray, offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rolling hash as it stands behind each byte of ``at`` (ascending): of the last ``WINDOW`` bytes of its text."""
    before = at - offs[np.searchsorted(offs, at, "right") - 1]
    h = GEAR[buf[at]]
    for j in range(1, WINDOW):
        h += np.where(before >= j, GEAR[buf[np.maximum(at - j, 0)]], np.uint32(0)) << (MOVE * np.uint32(j))
    return h


def stretches(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes or white space, whether it is a word, and whether it is a long one."""
    word = K.SPACE_WORDS[buf]
    edge = np.ones(len(buf), bool)
    edge[1:] = word[1:] != word[:-1]
    edge[offs[:-1][offs[:-1] < len(buf)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(buf))
    return starts, ends, word[starts], ends - starts > np.where(word[starts], LONG_WORD, LONG_SPACE)


def cuts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End byte of each chunk, and the number of chunks of each text; chunks end at whole characters."""
    n = len(offs) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    starts, ends, word, long = stretches(buf, offs)
    text = np.searchsorted(offs, starts, "right")
    # short words; a long stretch or the end of a text ends a group of them
    unit = word & ~long
    group = (np.cumsum(long) + text)[unit]
    found = [starts[unit][_marks(_gear(buf, offs, ends[unit] - 1), group, *WORD_MARKS)], starts[long], ends[long]]
    if long.any():
        size = (ends - starts)[long]
        at = np.repeat(starts[long] - np.cumsum(size) + size, size) + np.arange(size.sum())
        stretch = np.repeat(np.arange(len(size)), size)
        begins = (buf[at] & 0xC0) != 0x80
        at, stretch = at[begins], stretch[begins]
        found.append(at[_marks(_gear(buf, offs, at), stretch, *CHAR_MARKS)])
    out = np.unique(np.concatenate([*found, offs]))
    out = out[out > 0]
    return out, np.diff(np.searchsorted(out, offs, "right"))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, chunk starts, ends, digests, chunks of each text).

    The digest at a chunk is that of it and the next one together; it is not valid at the last one of a text (:func:`_whole`).
    """
    buf, offs = K.flat(texts)
    for i, j, part, at in K.chunks(buf, offs):
        ends, per = cuts(part, at)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        after = np.minimum(np.arange(len(ends)) + TOGETHER - 1, len(ends) - 1)
        yield i, j, part, starts, ends, K.span_hashes(part, starts, ends[after]).view(np.int64), per


def _whole(per: np.ndarray) -> np.ndarray:
    """Whether a chunk's digest ends in its own text."""
    last = np.repeat(np.cumsum(per), per)
    return np.arange(len(last)) + TOGETHER <= last


def _unspaced(part: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes of long words in each chunk."""
    begin, end, word, long = stretches(part, offs)
    return np.add.reduceat(np.repeat((word & long).astype(np.int64), end - begin), starts)


def _runs(mine: np.ndarray, text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The chunks to take out: those of runs of repeated chunks with enough words."""
    edge = np.ones(len(mine), bool)
    edge[1:] = (mine[1:] != mine[:-1]) | (text[1:] != text[:-1])
    run = np.cumsum(edge) - 1
    return mine & (np.bincount(run, words)[run] >= LEAST_WORDS)


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digests array): of each document, the digests of neighbouring chunks that a document with a smaller id holds.

    The documents of a batch that hold a digest are one row, so that a passage of very many documents is a row a batch where rows meet.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            digests, holders = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, _, _, _, digest, per in chunks(batch.column(1)):
                rows, whole = np.repeat(np.arange(i, j), per), _whole(per)
                digests.append(digest[whole])
                holders.append(rows[whole])
            values, rows = np.concatenate(digests), np.concatenate(holders)
            order = np.lexsort((rows, values))
            values, rows = values[order], rows[order]
            # a digest once a text
            once = np.ones(len(values), bool)
            once[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
            values, rows = values[once], rows[once]
            heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
            ids = pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)), pa.int32()), batch.column(0).take(pa.array(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(values[heads]), ids], ["digest", "ids"])

    every = docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(K.releasing(run), f"digest bigint, ids array<{kind}>")
    first = every.groupBy("digest").agg(F.min(F.array_min("ids")).alias("low"), F.max(F.array_max("ids")).alias("high")).where("low <> high").select("digest", "low")
    # written, so that the join's partitions can be split where very many batches hold a digest
    first = cut(first, "first-holders")
    again = every.join(first, "digest").select("digest", "low", F.explode("ids").alias("id")).where("id <> low").select("id", "digest")
    return again.groupBy("id").agg(F.collect_set("digest").alias("digests"))


def added_names(names: list[str]) -> list[str]:
    """What :func:`dedup` calls its figures beside columns of these names."""
    return [free(a, names) for a in ("removed_bytes", "removed_words", "removed_runs", "removed_chunks")]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, the text without what documents with smaller ids hold, and what was taken out: bytes, words, runs, chunks."""
    again = cut(repeated_chunks(docs, id_col, text_col), "repeats")
    names = docs.columns
    key, text_at = f"c{names.index(id_col)}", names.index(text_col)
    every = maybe_among(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]), again, key)
    # texts that hold no repeat stay where they are
    clean = every.where("not __maybe").drop("__maybe")
    marked = every.where("__maybe").drop("__maybe").join(again.withColumnRenamed("id", "again_id"), F.col(key) == F.col("again_id"), "left").drop("again_id")

    def run(batches):
        for batch in batches:
            texts, known = batch.column(text_at), batch.column(batch.num_columns - 1)
            out, figures = [], [[], [], [], []]
            lists = known.to_pylist()
            for i, j, part, starts, ends, digest, per in chunks(texts):
                text = np.repeat(np.arange(j - i), per)
                found = np.zeros(len(digest), bool)
                first = np.concatenate([[0], np.cumsum(per)])
                for k in range(i, j):
                    if lists[k]:
                        a, b = first[k - i], first[k - i + 1]
                        found[a:b] = np.isin(digest[a:b], np.array(lists[k], np.int64))
                found &= _whole(per)
                mine = found.copy()
                for k in range(1, TOGETHER):
                    mine[k:] |= found[:-k]
                space = ~K.SPACE_WORDS[part]
                begin = np.concatenate([[not space[0]], ~space[1:] & space[:-1]]) if len(part) else space
                heads = starts[first[:-1][per > 0]]
                begin[heads] = ~space[heads]
                words = np.add.reduceat(begin.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
                gone = _runs(mine, text, words + _unspaced(part, np.concatenate([[0], ends])[first], starts) / WORD_BYTES) if len(mine) else mine
                for k in range(i, j):
                    a, b = first[k - i], first[k - i + 1]
                    g = gone[a:b]
                    if g.any():
                        keep = np.flatnonzero(~g)
                        out.append(b"".join(part[starts[a + x] : ends[a + x]].tobytes() for x in keep.tolist()))
                        figures[0].append(int((ends[a:b] - starts[a:b])[g].sum()))
                        figures[1].append(int(words[a:b][g].sum()))
                        figures[2].append(int((g & np.concatenate([[True], ~g[:-1]])).sum()))
                        figures[3].append(int(g.sum()))
                    else:
                        out.append(None)
                        for f in figures:
                            f.append(0)
            old = texts.cast(pa.binary())
            new = pa.array([o if o is not None else old[k].as_py() for k, o in enumerate(out)], pa.binary()).cast(pa.string())
            columns = [new if k == text_at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(f, pa.int64()) for f in figures)], [*(f"c{k}" for k in range(len(names))), "f0", "f1", "f2", "f3"])

    fields = [T.StructField(f"c{k}", docs.schema[k].dataType) for k in range(len(names))]
    zeros = [F.lit(0).cast("long").alias(f"f{k}") for k in range(4)]
    done = clean.select("*", *zeros).unionByName(marked.mapInArrow(K.releasing(run), T.StructType([*fields, *(T.StructField(f"f{k}", T.LongType()) for k in range(4))])))
    return done.toDF(*names, *added_names(names))
