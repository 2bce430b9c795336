"""Fill-in-the-middle documents by a parallel scan of a finite automaton.

The automaton reads bytes and has four states: at the start of a line, inside one, after ``<``, and after ``<`` with a letter
of a marker. A chunk of text emits what it does to each of them: the state it ends in (a function of four states to four, in
one byte), and, for each state it may be entered in, how many lines begin in it and how many markers end in it. Chunks need
nothing of each other for that. Functions compose associatively, so a tree of compositions gives a chunk's function from
those of four bytes, a scan over chunks gives the state in which each one is entered, and so the lines and markers before it.
The cut after line k is then selected: the chunk in which line k + 1 begins, and its place there.

A text of up to ``PART_BYTES`` is done where it stands. A longer one is dealt out in parts of that size over all tasks; each
part's function is composed by text, the parts that hold a cut find it, and the output is hashed part by part in order, read
back, told apart by its markers and hashed again in the text's order. Only the task that reads a long text's row holds it whole.

Defined results: a null text counts as the empty one, which is ``plain``; a null id is drawn like the id ''; rows that repeat
both id and text have equal results, one each; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerec.llm import textkernel as K
from placerec.llm.shared import cut

SEED, RATE, SPM = "7", 100, 50
#: The markers.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of one part of a long text, of one chunk, and of the chunks that numpy takes together.
PART_BYTES, CHUNK, BLOCK = 1 << 16, 256, 1 << 19
#: States: at a line's start, inside a line, after "<", after "<" and a marker's letter.
START, INSIDE, OPEN, LETTER = range(4)
#: Classes of bytes: other, line break, "<", letter of a marker, ">", and none (padding).
OTHER, BREAK, LESS, NAME, MORE, NONE = range(6)
CLASS = np.zeros(256, np.uint8)
CLASS[[10, 60, 62]] = BREAK, LESS, MORE
CLASS[list(b"PSM")] = NAME


def _step(state: int, kind: int) -> tuple[int, int, int]:
    """Next state, lines that begin, markers that end."""
    if kind == NONE:
        return state, 0, 0
    to = {BREAK: START, LESS: OPEN, NAME: LETTER if state == OPEN else INSIDE}.get(kind, INSIDE)
    return to, int(state == START), int(state == LETTER and kind == MORE)


def _pack(f) -> int:
    return sum(s << (2 * i) for i, s in enumerate(f))


_STATES = np.arange(4)
#: Where function f leads from each state; f after g for all pairs of functions (first f, then g).
TO = (np.arange(256)[:, None] >> (2 * _STATES)) & 3
THEN = (TO[np.arange(256)[None, :, None], TO[:, None, :]] << (2 * _STATES)).sum(-1).astype(np.uint8)
IDENTITY = _pack(range(4))


def _four() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Function, lines and markers of any four classes of bytes, the first in the highest place."""
    f, lines, marks = np.zeros(6**4, np.uint8), np.zeros((6**4, 4), np.int32), np.zeros((6**4, 4), np.int32)
    for code in range(6**4):
        kinds = [code // 6**k % 6 for k in (3, 2, 1, 0)]
        ends = []
        for start in range(4):
            state = start
            for kind in kinds:
                state, line, mark = _step(state, kind)
                lines[code, start] += line
                marks[code, start] += mark
            ends.append(state)
        f[code] = _pack(ends)
    return f, lines, marks


FOUR_F, FOUR_LINES, FOUR_MARKS = _four()


def compose(a: tuple, b: tuple) -> tuple:
    """What (function, lines, markers) of ``a`` and then of ``b`` do: arrays of any number of both, the last axis of counts being the state."""
    (f, la, ma), (g, lb, mb) = a, b
    via = TO[f]
    return THEN[f, g], la + np.take_along_axis(lb, via, -1), ma + np.take_along_axis(mb, via, -1)


def chunk_functions(buf: np.ndarray, offs: np.ndarray) -> tuple[tuple, np.ndarray]:
    """Functions and counts of each chunk of ``CHUNK`` bytes, and how many chunks each text has (at least one)."""
    size = np.diff(offs)
    if not len(size):
        return (np.zeros(0, np.uint8), np.zeros((0, 4), np.int32), np.zeros((0, 4), np.int32)), size
    per = np.maximum(1, -(-size // CHUNK))
    first = np.cumsum(per) - per
    kinds = np.full(int(per.sum()) * CHUNK, NONE, np.uint8)
    kinds[np.arange(len(buf)) + np.repeat(first * CHUNK - offs[:-1], size)] = CLASS[buf]
    done = []
    for a in range(0, len(kinds), BLOCK):
        k = kinds[a : a + BLOCK].reshape(-1, 4).astype(np.uint16)
        code = (k[:, 0] * 216 + k[:, 1] * 36 + k[:, 2] * 6 + k[:, 3]).reshape(-1, CHUNK // 4)
        now = FOUR_F[code], FOUR_LINES[code], FOUR_MARKS[code]
        while now[0].shape[1] > 1:
            now = compose(tuple(x[:, 0::2] for x in now), tuple(x[:, 1::2] for x in now))
        done.append(tuple(x[:, 0] for x in now))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)), per


def scan(chunks: tuple, per: np.ndarray) -> tuple:
    """Of each chunk: functions and counts from its text's start through its end, by doubling steps."""
    out, n = chunks, len(chunks[0])
    place = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
    step = 1
    while step < (per.max() if len(per) else 0):
        at = np.flatnonzero(place >= step)
        got = compose(tuple(x[at - step] for x in out), tuple(x[at] for x in out))
        out = tuple(x.copy() for x in out)
        for x, y in zip(out, got, strict=True):
            x[at] = y
        step *= 2
    return out


def draws(doc_id, n: int, seed: str = SEED) -> tuple[int, int, int, int]:
    """Lines of the prefix, lines through the middle, and the two draws below 100."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b), h3 % 100, h4 % 100


def form_of(size: int, marks: int, h3: int, h4: int, rate: int = RATE, spm: int = SPM) -> str:
    return "plain" if size == 0 or marks or h3 >= rate else "spm" if h4 < spm else "psm"


def arrange(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> list[bytes]:
    """The output's pieces in their order."""
    if form == "plain":
        return [prefix, middle, suffix]
    return [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle] if form == "psm" else [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]


def restore(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    i, j = output.index(second, 3), output.rindex(MIDDLE)
    one, two, middle = output[3:i], output[i + 3 : j], output[j + 3 :]
    return one + middle + two if form == "psm" else two + middle + one


def line_starts(part: np.ndarray, at_start: bool) -> np.ndarray:
    """Where lines begin in bytes that are entered at a line's start, or not."""
    s = np.flatnonzero(part[:-1] == 10) + 1
    return np.concatenate([[0], s]) if at_start and len(part) else s


def characters(part: np.ndarray) -> int:
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def _select(part: np.ndarray, lines: np.ndarray, first: int, last: int, k: int) -> int:
    """The byte at which line k (from 0) begins, or the end: chunks first to last of a text hold so many lines through each one."""
    c = first + int(np.searchsorted(lines[first:last], k, "right"))
    if c == last:
        return len(part)
    before = int(lines[c - 1]) if c > first else 0
    a = (c - first) * CHUNK
    piece = part[a : a + CHUNK]
    at_start = a == 0 or part[a - 1] == 10
    starts = np.flatnonzero(np.concatenate([[at_start], piece[:-1] == 10]))
    return a + int(starts[k - before])


def _texts(buf: np.ndarray, offs: np.ndarray, ids: list, seed: str, rate: int, spm: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of whole texts."""
    chunks, per = chunk_functions(buf, offs)
    f, lines, marks = scan(chunks, per)
    lines, marks = lines[:, START], marks[:, START]
    ends = np.cumsum(per)
    out = []
    for i, doc_id in enumerate(ids):
        text, first, last = buf[offs[i] : offs[i + 1]], int(ends[i] - per[i]), int(ends[i])
        n = int(lines[last - 1])
        a, b, h3, h4 = draws(doc_id, n, seed)
        form = form_of(len(text), int(marks[last - 1]), h3, h4, rate, spm)
        if form == "plain":
            h = hashlib.sha256(text.tobytes()).hexdigest()
            out.append((n, form, None, None, h, h))
            continue
        x, y = _select(text, lines, first, last, a), _select(text, lines, first, last, b)
        output = b"".join(arrange(text[:x].tobytes(), text[x:y].tobytes(), text[y:].tobytes(), form))
        out.append((n, form, characters(text[:x]), characters(text[x:y]), hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()))
    return out


RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_NAMES = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def _short(docs: DataFrame, kind: str, seed: str, rate: int, spm: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            buf, offs = K.flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j, part, at in K.chunks(buf, offs):
                rows = _texts(part, at, ids[i:j], seed, rate, spm)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES))], ["id", *_NAMES])

    return docs.select("id", "text").mapInArrow(K.releasing(run), f"id {kind}, {RESULT}")


# --- long texts: (id, sha) names a text, seq a part of it


def _parts(docs: DataFrame, kind: str, part_bytes: int) -> DataFrame:
    """(id, sha, seq, bytes): each part once, however often a row repeats; parts of one text lie in different tasks."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                view = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                sha = hashlib.sha256(view).digest()
                for seq, a in enumerate(range(0, len(view), part_bytes)):
                    yield pa.RecordBatch.from_arrays([ids.slice(i, 1), pa.array([sha], pa.binary()), pa.array([seq], pa.int64()), pa.array([bytes(view[a : a + part_bytes])], pa.binary())], ["id", "sha", "seq", "bytes"])

    rows = docs.select("id", "text").mapInArrow(K.releasing(run), f"id {kind}, sha binary, seq bigint, bytes binary")
    return rows.groupBy("id", "sha", "seq").agg(F.first("bytes").alias("bytes"))


def _functions(parts: DataFrame, kind: str) -> DataFrame:
    """(id, sha, seq, f, lines, marks, chars, size): what each part does, found where it lies."""

    def run(batches):
        for batch in batches:
            buf, offs = K.flat(batch.column(3))
            for i, j, piece, at in K.chunks(buf, offs):
                chunks, per = chunk_functions(piece, at)
                f, lines, marks = scan(chunks, per)
                last = np.cumsum(per) - 1
                chars = [characters(piece[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(f[last].astype(np.int32)), pa.array(lines[last].tolist(), pa.list_(pa.int64())), pa.array(marks[last].tolist(), pa.list_(pa.int64())), pa.array(chars, pa.int64()), pa.array(np.diff(at))], ["id", "sha", "seq", "f", "lines", "marks", "chars", "size"])

    return parts.mapInArrow(K.releasing(run), f"id {kind}, sha binary, seq bigint, f int, lines array<bigint>, marks array<bigint>, chars bigint, size bigint")


def _selected(functions: DataFrame, kind: str, seed: str, rate: int, spm: int) -> DataFrame:
    """Of each part: its text's lines, form and characters, and of both cuts the part, the line's number in it, whether it is entered at a line's start, and characters before it.

    The functions of one text meet here, one row for each ``PART_BYTES``: a text of the longest kind that a row can hold has some 32,000.
    """

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        f = rows.column("f").to_numpy().astype(np.uint8)
        lines, marks = (np.array(rows.column(c).to_pylist(), np.int64).reshape(len(f), 4) for c in ("lines", "marks"))
        through, lines, marks = scan((f, lines, marks), np.array([len(f)]))
        lines, marks = lines[:, START], marks[:, START]
        chars = np.cumsum(rows.column("chars").to_numpy())
        n, size = int(lines[-1]), int(np.sum(rows.column("size").to_numpy()))
        a, b, h3, h4 = draws(key[0].as_py(), n, seed)
        out = {"n": n, "form": form_of(size, int(marks[-1]), h3, h4, rate, spm), "total": int(chars[-1])}
        for tag, k in (("a", a), ("b", b)):
            p = int(np.searchsorted(lines, k, "right"))
            out[f"{tag}_seq"] = p
            out[f"{tag}_line"] = k - (int(lines[p - 1]) if p else 0)
            out[f"{tag}_fresh"] = p == 0 or bool(TO[through[p - 1], START] == START)
            out[f"{tag}_chars"] = int(chars[p - 1]) if p else 0
        return pa.table({**{c: rows.column(c) for c in ("id", "sha", "seq")}, **{k: pa.array([v] * len(f)) for k, v in out.items()}})

    side = lambda t: f"{t}_seq bigint, {t}_line bigint, {t}_fresh boolean, {t}_chars bigint"
    return functions.groupBy("id", "sha").applyInArrow(one, f"id {kind}, sha binary, seq bigint, n bigint, form string, total bigint, {side('a')}, {side('b')}")


def _pieces(parts: DataFrame, plan: DataFrame, kind: str) -> DataFrame:
    """(id, sha, form, segment 0 to 2, seq, bytes, a_at, b_at): parts cut where a cut falls, and the cuts' characters where they were found."""
    plan = plan.withColumnsRenamed({"id": "its_id", "sha": "its_sha", "seq": "its_seq"})
    rows = parts.join(plan, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("sha") == F.col("its_sha")) & (F.col("seq") == F.col("its_seq"))).select("id", "sha", "seq", "bytes", "form", *[f"{t}_{c}" for t in "ab" for c in ("seq", "line", "fresh", "chars")])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                part = np.frombuffer(r["bytes"], np.uint8)
                at, found = [], []
                for t in "ab":
                    s = r[f"{t}_seq"]
                    x = len(part) if r["seq"] < s else 0
                    if r["seq"] == s:
                        x = int(line_starts(part, r[f"{t}_fresh"])[r[f"{t}_line"]])
                    at.append(x)
                    found.append(r[f"{t}_chars"] + characters(part[:x]) if r["seq"] == s else None)
                edges = [0, *at, len(part)] if r["form"] != "plain" else [0, len(part), len(part), len(part)]
                data = [r["bytes"][edges[k] : edges[k + 1]] for k in range(3)]
                same = [r[c] for c in ("id", "sha", "form", "seq")]
                cols = list(zip(*[(*same, k, d, *found) for k, d in enumerate(data)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.schema.field("id").type, pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["id", "sha", "form", "seq", "segment", "bytes", "a_at", "b_at"])

    return rows.mapInArrow(K.releasing(run), f"id {kind}, sha binary, form string, seq bigint, segment int, bytes binary, a_at bigint, b_at bigint")


def _hashed(rows: DataFrame, kind: str, name: str, *order: str) -> DataFrame:
    """(id, sha, name): SHA-256 of the bytes of each text's rows in an order, a batch at a time."""
    sorted_rows = rows.select("id", "sha", *order, "bytes").repartition("id", "sha").sortWithinPartitions("id", "sha", *order)

    def run(batches):
        key, h = None, None
        for batch in batches:
            data = batch.column(batch.num_columns - 1)
            for i, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if h is None or now != key:
                    if h is not None:
                        yield row(key, h, batch)
                    key, h = now, hashlib.sha256()
                h.update(memoryview(data[i].as_buffer()))
            last = batch
        if h is not None:
            yield row(key, h, last)

    def row(key, h, batch):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], batch.schema.field("id").type), pa.array([key[1]], pa.binary()), pa.array([h.hexdigest()])], ["id", "sha", name])

    return sorted_rows.mapInArrow(run, f"id {kind}, sha binary, {name} string")


def _outputs(pieces: DataFrame) -> DataFrame:
    """(id, sha, form, slot, seq, bytes): the output in its order, markers as rows of their own."""
    nth = {"psm": (0, 2, 1), "spm": (1, 2, 0), "plain": (0, 1, 2)}
    slot = F.coalesce(*[F.when(F.col("form") == f, F.element_at(F.array(*[F.lit(2 * x + 1) for x in s]), F.col("segment") + 1)) for f, s in nth.items()])
    mark = F.element_at(F.array(*[F.lit(m.decode()).cast("binary") for m in (PREFIX, MIDDLE, SUFFIX)]), F.col("segment") + 1)
    text = pieces.select("id", "sha", "form", slot.alias("slot"), "seq", "bytes")
    marks = pieces.where("seq = 0 and form <> 'plain'").select("id", "sha", "form", (slot - 1).alias("slot"), "seq", mark.alias("bytes"))
    return text.unionByName(marks)


def _restored(outputs: DataFrame) -> DataFrame:
    """The output's rows behind the number of the segment that the last marker before them names."""
    named = F.coalesce(*[F.when(F.col("bytes") == F.lit(m.decode()).cast("binary"), F.lit(k)) for k, m in enumerate((PREFIX, MIDDLE, SUFFIX))])
    # a text with a marker is plain, so a row that is a marker's bytes stands for it
    at = outputs.where("form <> 'plain'").where(named.isNotNull()).select(F.col("id").alias("its_id"), F.col("sha").alias("its_sha"), (F.col("slot") + 1).alias("its_slot"), named.alias("segment"))
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("sha") == F.col("its_sha")) & (F.col("slot") == F.col("its_slot"))
    psm = outputs.where("form <> 'plain'").join(at, same).select("id", "sha", "segment", "seq", "bytes")
    return psm.unionByName(outputs.where("form = 'plain'").select("id", "sha", F.col("slot").alias("segment"), "seq", "bytes"))


def _long(docs: DataFrame, kind: str, seed: str, rate: int, spm: int, part_bytes: int) -> DataFrame:
    parts = cut(_parts(docs, kind, part_bytes), "parts")
    plan = cut(_selected(_functions(parts, kind), kind, seed, rate, spm), "cuts")
    pieces = cut(_pieces(parts, plan, kind), "pieces")
    outputs = _outputs(pieces)
    found = pieces.groupBy("id", "sha").agg(F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"))
    keys = lambda d, tag: d.withColumnsRenamed({"id": f"id_{tag}", "sha": f"sha_{tag}"})
    out = docs.select("id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    for tag, d in (("p", plan.where("seq = 0").select("id", "sha", "n", "form", "total")), ("f", found), ("o", _hashed(outputs, kind, "output_sha256", "slot", "seq")), ("r", _hashed(_restored(outputs), kind, "restored_sha256", "segment", "seq"))):
        out = out.join(keys(d, tag), F.col("id").eqNullSafe(F.col(f"id_{tag}")) & (F.col("sha") == F.col(f"sha_{tag}")), "left")
    end = lambda c: F.when(F.col("form") != "plain", F.coalesce(c, "total"))
    return out.select("id", "n", "form", end("a_at").alias("prefix_chars"), (end("b_at") - end("a_at")).alias("middle_chars"), "output_sha256", "restored_sha256")


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm: int = SPM, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: its id, lines n, form (plain, psm or spm), characters of prefix and middle, digests of output and restored text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    long = F.coalesce(F.octet_length("text") > part_bytes, F.lit(False))
    short = _short(rows.where(~long), kind, seed, rate, spm)
    out = short.unionByName(_long(rows.where(long), kind, seed, rate, spm, part_bytes))
    return out.withColumnRenamed("id", id_col)


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(id, form, output): the transformed texts themselves, as training reads them; a row holds a text as the input's does."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            buf, offs = K.flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j, part, at in K.chunks(buf, offs):
                chunks, per = chunk_functions(part, at)
                _, lines, marks = scan(chunks, per)
                ends, got = np.cumsum(per), []
                for k in range(j - i):
                    text, first, last = part[at[k] : at[k + 1]], int(ends[k] - per[k]), int(ends[k])
                    a, b, h3, h4 = draws(ids[i + k], int(lines[last - 1, START]), seed)
                    form = form_of(len(text), int(marks[last - 1, START]), h3, h4, rate, spm)
                    x, y = (_select(text, lines[:, START], first, last, c) for c in (a, b))
                    got.append((form, b"".join(arrange(text[:x].tobytes(), text[x:y].tobytes(), text[y:].tobytes(), form))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.binary()).cast(pa.string())], ["id", "form", "output"])

    return rows.mapInArrow(K.releasing(run), f"id {kind}, form string, output string").withColumnRenamed("id", id_col)


#: The same result of the documents table in DuckDB: the output is split at its markers again to rebuild the text.
ORACLE = r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(lines) AS n, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT for k in range(4)] AS r FROM l),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (SELECT *, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:n], '') AS z FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END AS output FROM s),
q AS (SELECT *, string_split(output, '<M>') AS halves FROM o),
t AS (SELECT *, string_split(halves[1][4:], CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS two FROM q)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN two[1] || halves[2] || two[2] ELSE two[2] || halves[2] || two[1] END) AS restored_sha256 FROM t
"""
