"""Vectorised byte-level text kernels shared by the corpus operators.

Everything works on one flat ``uint8`` buffer holding the UTF-8 bytes of many
texts plus an offset array, so a whole Arrow batch is tokenised, hashed and
shingled by a few dozen numpy calls whatever the number or length of texts.
A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one numpy pass (one longer text is one pass of its own).
CHUNK_BYTES = 512 << 10

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Separators of ``[^\x20\x09-\x0D]+``: every other byte belongs to a word.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def releasing(run):
    """``run`` of mapInArrow; when a task's batches end, freed memory goes back to the system, as workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind each other, and n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each text."""
    n = len(offs) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    inside = is_word[buf]
    prev = np.empty_like(inside)
    prev[0], prev[1:] = False, inside[:-1]
    prev[offs[:-1][offs[:-1] < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~prev)
    ends = np.flatnonzero(inside & ~after) + 1
    per = np.diff(np.searchsorted(starts, offs, "left"))
    return starts, ends, per


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for slot, base in ((0, _BASE), (1, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[slot] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MULT)


def shingles(hashes: np.ndarray, per: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their text's index; a text of 1 to k - 1 words is one shingle."""
    text = np.repeat(np.arange(len(per)), per)
    if not len(hashes):
        return np.zeros(0, np.uint64), text
    ends = np.cumsum(per)
    left = np.repeat(ends, per) - np.arange(len(hashes))  # words from here to the text's end
    whole = left >= k
    out = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        out = out * _MULT + padded[j : j + len(hashes)]
    out = mix(out + np.uint64(k))
    short = (per > 0) & (per < k)
    if short.any():
        first = (ends - per)[short]
        for at, n in zip(first.tolist(), per[short].tolist(), strict=True):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in hashes[at : at + n]:
                    h = h * _MULT + x
                out[at] = mix(np.array([h + np.uint64(n)], np.uint64))[0]
        whole[first] = True
    return out[whole], text[whole]


def distinct_sets(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text (``text`` ascends), behind each other, and n + 1 offsets."""
    offs = np.searchsorted(text, np.arange(n + 1), "left")
    v = values.copy()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
    return v[keep], np.searchsorted(text[keep], np.arange(n + 1), "left")
