"""Token counts by offset-mapped attribution.

A text is encoded once, whole, so that its tokens are those a model sees. Tokens and
sections are intervals of the text's bytes; both are sorted, so the join of tokens to
sections is one merge by binary search. A token that crosses a boundary counts for one
section, by the rule asked for: that of its first byte ("start"), of its last byte
("end"), or the one that holds most of it, the earlier of equals ("most"). A section's
counts add up to the text's.

Sections are the text's lines, line break included, or the fields of a record behind
each other. Defined results: a null or empty text has no section; an empty field has no
tokens; repeated rows give equal rows; an empty table gives an empty table; only the id
and the text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placerec.llm import textkernel as K
from placerec.llm.bpe import Encoder, _parts, _vocabulary

RULES = ("start", "end", "most")


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. Both arguments are ascending ends of intervals from 0."""
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    crossing = first != last
    home = first if rule == "start" else last
    if rule == "most":
        home = first.copy()
        for t in np.flatnonzero(crossing):
            cuts = np.concatenate([[starts[t]], section_ends[first[t] : last[t]], [token_ends[t]]])
            home[t] = first[t] + np.diff(cuts).argmax()
    return np.bincount(home, minlength=n)[:n], np.bincount(home[crossing], minlength=n)[:n]


def line_ends(text: bytes) -> np.ndarray:
    """End of each line, its break included."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return at if len(text) == 0 or (len(at) and at[-1] == len(text)) else np.append(at, len(text))


def _rows(encoder: Encoder, lens: np.ndarray, texts: list[str | None], ends_of, rule: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i, ids in enumerate(encoder.encode(texts)):
        ends = ends_of(i)
        yield (ends, *attribute(np.cumsum(lens[ids]), ends, rule))


def count_lines(docs: DataFrame, rank_file: bytes, pattern: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, n_bytes, n_tokens, n_crossing): tokens of each line of each text, encoded whole."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    share = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches):
        vocabulary = _vocabulary(share.value)
        encoder, lens = Encoder(vocabulary, pattern), np.array([len(b) for b in vocabulary.bytes_of])
        for batch in batches:
            for keys, part in _parts(batch):
                texts = part.to_pylist()
                got = list(_rows(encoder, lens, texts, lambda i, t=texts: line_ends((t[i] or "").encode()), rule))
                per = np.array([len(e) for e, _, _ in got], np.int64)
                flat = lambda k: np.concatenate([np.zeros(0, np.int64), *(g[k] for g in got)])
                sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(e, prepend=0) for e, _, _ in got)])
                section = np.arange(len(sizes)) - np.repeat(np.cumsum(per) - per, per)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(per)), per))), pa.array(section, pa.int32()), pa.array(sizes, pa.int64()), pa.array(flat(1), pa.int64()), pa.array(flat(2), pa.int64())], [id_col, "section", "n_bytes", "n_tokens", "n_crossing"])

    part = docs.select(id_col, text_col)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, section int, n_bytes bigint, n_tokens bigint, n_crossing bigint")


def count_fields(rows: DataFrame, fields: list[str], rank_file: bytes, pattern: str, id_col: str, rule: str = "start", glue: str = "\n") -> DataFrame:
    """(id, field, n_tokens): tokens of each field of a record that is encoded as its fields with ``glue`` behind each."""
    share = rows.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches):
        vocabulary = _vocabulary(share.value)
        encoder, lens = Encoder(vocabulary, pattern), np.array([len(b) for b in vocabulary.bytes_of])
        for batch in batches:
            columns = [batch.column(k + 1).to_pylist() for k in range(len(fields))]
            parts = [[(c[i] or "") + glue for c in columns] for i in range(batch.num_rows)]
            ends = [np.cumsum([len(p.encode()) for p in row]) for row in parts]
            got = [n for _, n, _ in _rows(encoder, lens, ["".join(row) for row in parts], ends.__getitem__, rule)]
            rows_at = np.repeat(np.arange(batch.num_rows), len(fields))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_at)), pa.array(fields * batch.num_rows, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *got]), pa.int64())], [id_col, "field", "n_tokens"])

    part = rows.select(id_col, *fields)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, field string, n_tokens bigint")
