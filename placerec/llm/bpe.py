"""Byte-level BPE by corpus-level merge replay.

The distinct words of a batch of texts are laid out behind each other as byte
tokens. An inverted index maps the rank of a token pair to the positions where
the pair stands; ranks are replayed from a heap, each merge is applied at all of
its positions at once, and only the neighbours it touched are looked up again.
A word seen before by the same task is not replayed.

Defined results: a null text encodes as the empty text (no ids); repeated rows
give equal rows; texts of any length are encoded whole; an empty table gives an
empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from placerec.llm import textkernel as K

_NONE = np.int32(2**31 - 1)
#: Words a task remembers; more only cost memory, a forgotten word is replayed again.
CACHE_WORDS = 250_000
#: Text bytes of one replay.
REPLAY_BYTES = 10 << 20


class Vocabulary:
    """Ranks of a tiktoken rank file, the pairs that merge, and the bytes of each id."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        keys, values, self.risky = [], [], set()
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
                    # a part of a higher rank than the whole: its merge can bring up an earlier rank
                    self.risky.update(x for x in (left, right) if x > rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and their offsets."""
        offs = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=offs[1:])
        n = int(offs[-1])
        if not n:
            return np.zeros(0, np.int32), offs
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), np.diff(offs))
        nxt = np.arange(1, n + 1)
        nxt[offs[1:][np.diff(offs) > 0] - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[offs[:-1][np.diff(offs) > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.pair_ranks(tok[inner], tok[nxt[inner]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            firsts = r[np.concatenate([[0], cuts])].tolist()
            bounds = [0, *cuts.tolist(), len(at)]
            for k, x in enumerate(firsts):
                got = index.get(x)
                if got is None:
                    index[x] = [at[bounds[k] : bounds[k + 1]]]
                    heapq.heappush(heap, x)
                else:
                    got.append(at[bounds[k] : bounds[k + 1]])

        post(inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if len(at) > 1:
                at.sort()
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if not len(at):
                continue
            if r in self.risky and len(at) > 1:  # one place a word at a time: an earlier rank may come up behind it
                first = np.ones(len(at), bool)
                first[1:] = word[at[1:]] != word[at[:-1]]
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(heap, r)
                    at = at[first]
            chained = np.zeros(len(at), bool)
            chained[1:] = nxt[at[:-1]] == at[1:]
            if chained.any():  # overlapping pairs: every second one of a run, from the left
                i = np.arange(len(at))
                start = np.maximum.accumulate(np.where(chained, 0, i))
                at = at[(i - start) % 2 == 0]
            gone = nxt[at]
            beyond = nxt[gone]
            tok[at] = r
            alive[gone] = False
            rank[gone] = _NONE
            nxt[at] = beyond
            has = beyond >= 0
            prv[beyond[has]] = at[has]
            before = prv[at]
            touched = np.concatenate([at, before[before >= 0]])
            following = nxt[touched]
            new = np.full(len(touched), _NONE, np.int32)
            ok = following >= 0
            new[ok] = self.pair_ranks(tok[touched[ok]], tok[following[ok]])
            rank[touched] = new
            post(touched)
        ends = np.concatenate([[0], np.cumsum(alive)])[offs]
        return tok[alive], ends


class _Numbers(dict):
    """Numbers keys as they come up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


#: In printable ASCII, white space and U+00A1 to U+017F these are all letters and numbers.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_BEYOND = re.compile("[^\t-\r -~¡-ſ]").search


def _splitter(pattern: str):
    """findall of ``pattern``; texts without other characters take the same pattern with its classes spelt out, which is faster."""
    import regex

    full = regex.compile(pattern).findall
    near = pattern.replace(r"\s\p{L}\p{N}", rf"\s{_LETTERS}{_NUMBERS}").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
    if "\\p" in near:
        return full
    fast = re.compile(near).findall
    return lambda text: full(text) if _BEYOND(text) else fast(text)


class Encoder:
    """Encodes batches of texts; keeps the ids of words it has seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, _splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.ids, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        known, before = self.known, len(self.known)
        places = []
        for text in texts:
            found = self.split(text) if text else ()
            places.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        if len(known) > before:
            fresh = [w.encode("utf-8", "surrogatepass") for w in list(known)[before:]]
            ids, offs = self.vocabulary.replay(fresh)
            self.starts = np.concatenate([self.starts, offs[:-1] + len(self.ids)])
            self.lens = np.concatenate([self.lens, np.diff(offs)])
            self.ids = np.concatenate([self.ids, ids])
        for at in places:
            lens = self.lens[at]
            ends = np.cumsum(lens)
            n = int(ends[-1]) if len(ends) else 0
            yield self.ids[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(n)]


_CACHE: dict[tuple[int, int], Vocabulary] = {}


def _vocabulary(rank_file: bytes) -> Vocabulary:
    key = (len(rank_file), hash(rank_file))
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Vocabulary(rank_file)
    return _CACHE[key]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of runs of rows of about REPLAY_BYTES."""
    text = batch.column(1)
    sizes = np.asarray(pc.binary_length(text.cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    cum, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(cum, cum[i] + REPLAY_BYTES, "right")) - 1)
        yield batch.column(0).slice(i, j - i), text.slice(i, j - i)
        i = j


def bpe_encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text, as the rank file encodes each match of ``pattern``."""
    share = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches):
        encoder = Encoder(_vocabulary(share.value), pattern)
        for batch in batches:
            for keys, texts in _parts(batch):
                ids = list(encoder.encode(texts.to_pylist()))
                offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], [id_col, "ids"])

    part = docs.select(id_col, text_col)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, rank_file: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of every list of ids; a null list decodes to no bytes."""
    share = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches):
        of = _vocabulary(share.value).bytes_of.__getitem__
        for batch in batches:
            out = [b"".join(map(of, x)) if x else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    part = encoded.select(id_col, ids_col)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, decoded binary")


def bpe_digests(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per text: the number and SHA-256 of its ids, the SHA-256 of the bytes they decode to, and the ids if wanted."""
    share = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches):
        vocabulary = _vocabulary(share.value)
        encoder, of = Encoder(vocabulary, pattern), vocabulary.bytes_of.__getitem__
        for batch in batches:
            for keys, texts in _parts(batch):
                n, ids_sha, text_sha, every = [], [], [], []
                for ids in encoder.encode(texts.to_pylist()):
                    if with_ids:
                        every.append(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(of, ids.tolist()))).hexdigest())
                columns = [keys, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *every]))))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    part = docs.select(id_col, text_col)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
