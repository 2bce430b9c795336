"""Telephony audio: G.711 and IMA ADPCM in WAV containers, decoded a batch at a time.

Mu-law and A-law codes are expanded by 256-entry tables built from the companding
rule; the ADPCM predictor runs over the nibbles of *all* blocks of a batch at once.

Defined results: null bytes (or a null text) count as empty; a payload is padded
with zero bytes to a positive multiple of ``BLOCK``; rows are independent, so
repeated rows give equal rows and an empty table an empty one; only the id and
content columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from placerec.llm import textkernel as K
from placerec.llm.shared import cut

BLOCK, RATE = 64, 8000
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11

# The step sizes and index moves of IMA ADPCM.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    power, size = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = np.where(power, (size + 0x100) << np.maximum(power - 1, 0), size)
    return np.where(a & 0x80, size, -size).astype(np.int16)


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def _ima_moves() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and nibble: the signed difference and the next index."""
    nibble, step = np.arange(16)[None, :], STEPS[:, None]
    diff = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    index = np.clip(np.arange(89)[:, None] + MOVES[None, :], 0, 88)
    return np.where(nibble & 8, -diff, diff).astype(np.int32).ravel(), index.astype(np.int32).ravel()


_IMA_DIFF, _IMA_NEXT = _ima_moves()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of IMA ADPCM blocks (one row each): the header's sample, then two a byte, low nibble first.

    A header's step index above 88 counts as 88. The loop is over nibbles, each step works on all blocks.
    """
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for j, nibble in ((1, data[i] & 15), (2, data[i] >> 4)):
            key = index * 16 + nibble
            value += _IMA_DIFF[key]
            np.clip(value, -32768, 32767, out=value)
            index = _IMA_NEXT[key]
            out[2 * i + j] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """int16 samples at another rate, by linear interpolation in integers; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    i, frac = at // to, at % to
    a, b = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
    return (a + (b - a) * frac // to).astype(np.int16)


def wav(payload: bytes, codec: int = MULAW, rate: int = RATE) -> bytes:
    """A mono WAV file; 8-bit G.711 codes, 16-bit PCM or 64-byte IMA ADPCM blocks."""
    bits, align = {PCM: (16, 2), IMA: (4, BLOCK)}.get(codec, (8, 1))
    per = 2 * (BLOCK - 4) + 1
    samples = {PCM: len(payload) // 2, IMA: len(payload) // BLOCK * per}.get(codec, len(payload))
    speed = rate * BLOCK // per if codec == IMA else rate * align
    form = struct.pack("<HHIIHHH", codec, 1, rate, speed, align, bits, 2 if codec == IMA else 0) + (struct.pack("<H", per) if codec == IMA else b"")
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """(codec, rate, data bytes) of a WAV file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data" and codec is not None:
            if at + 8 + size > len(media):
                raise ValueError("cut short")
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def decode(codec: int, data: bytes) -> np.ndarray:
    """int16 samples of a WAV file's data; a last part of an ADPCM block is padded with zeros."""
    raw = np.frombuffer(data, np.uint8)
    if codec in EXPAND:
        return EXPAND[codec][raw]
    if codec == PCM:
        return np.frombuffer(data[: len(data) & ~1], "<i2")
    if codec == IMA:
        raw = np.concatenate([raw, np.zeros(-len(raw) % BLOCK, np.uint8)])
        return decode_ima(raw.reshape(-1, BLOCK)).ravel()
    raise ValueError(f"codec {codec}")


def lift(pcm: np.ndarray) -> bytes:
    """int16 samples without loss: the even ones, then how far each odd one lies from the mean of its neighbours.

    The predict step of the 5/3 lifting wavelet, modulo 2^16; audio brought to twice its rate has few details left, which
    compress well.
    """
    even, odd = pcm[0::2].astype(np.int64), pcm[1::2].astype(np.int64)
    after = np.append(even[1:], even[-1:])[: len(odd)]
    return np.concatenate([even, odd - ((even[: len(odd)] + after) >> 1)]).astype("<u2", casting="unsafe").tobytes()


def unlift(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, "<i2").astype(np.int64)
    even, detail = x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :]
    after = np.append(even[1:], even[-1:])[: len(detail)]
    out = np.empty(len(x), np.int16)
    out[0::2], out[1::2] = even, (detail + ((even[: len(detail)] + after) >> 1)).astype(np.int16)
    return out


def pad(data: bytes) -> bytes:
    return data + b"\0" * ((-len(data) % BLOCK) or (0 if data else BLOCK))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: int = MULAW) -> DataFrame:
    """(id, media binary): each text's padded UTF-8 bytes as the codes of a WAV file."""

    def run(batches):
        for batch in batches:
            media = [wav(pad(x or b""), codec) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], [id_col, "media"])

    part = docs.select(id_col, text_col)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, media binary")


def to_pcm(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate: int = 16000) -> DataFrame:
    """(id, pcm binary, error string): any stored telephony WAV as a PCM WAV at ``rate``; null or broken media give null and the reason."""

    def run(batches):
        for batch in batches:
            pcm, why = [], []
            for media in batch.column(1).to_pylist():
                try:
                    if media is None:
                        raise ValueError("null")
                    codec, at, data = unwav(media)
                    pcm.append(wav(resample(decode(codec, data), at, rate).astype("<i2").tobytes(), PCM, rate))
                    why.append(None)
                except (ValueError, struct.error) as e:
                    pcm.append(None)
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pcm, pa.binary()), pa.array(why, pa.string())], [id_col, "pcm", "error"])

    part = stored.select(id_col, media_col)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, pcm binary, error string")


def _features(payloads: list[bytes]) -> list[str]:
    """Mean squares of the payload as mu-law, A-law and ADPCM, and zero crossings."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads], np.int64)
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    mu = EXPAND[MULAW][data]
    square = lambda x: np.add.reduceat(x.astype(np.int64) ** 2, firsts) // sizes
    mu_ms, a_ms = square(mu), square(EXPAND[ALAW][data])
    blocks = decode_ima(data.reshape(-1, BLOCK)).astype(np.int64)
    ima_ms = np.add.reduceat((blocks**2).sum(1), firsts // BLOCK) // (sizes // BLOCK * blocks.shape[1])
    sign = mu < 0
    cross = np.zeros(len(mu), np.int64)
    cross[1:] = sign[1:] != sign[:-1]
    cross[firsts] = 0
    cross = np.add.reduceat(cross, firsts)
    return [f"mulaw={m};alaw={a};ima={i};cross={c}" for m, a, i, c in zip(mu_ms.tolist(), a_ms.tolist(), ima_ms.tolist(), cross.tolist(), strict=True)]


def stored_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 16000) -> DataFrame:
    """(id, n_bytes, media, pcm): each text as a mu-law WAV and, lifted, that as PCM at ``rate``, to be written."""

    def run(batches):
        for batch in batches:
            buf, offs = K.flat(batch.column(1))
            for i, j, part, at in K.chunks(buf, offs):
                media = [wav(pad(part[at[k] : at[k + 1]].tobytes())) for k in range(j - i)]
                pcm = [lift(resample(decode(MULAW, unwav(m)[2]), RATE, rate)) for m in media]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], [id_col, "n_bytes", "media", "pcm"])

    part = docs.select(id_col, text_col)
    return part.mapInArrow(K.releasing(run), f"`{id_col}` {part.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary, pcm binary")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each text's mu-law WAV and its resampled PCM at 16 kHz (lifted, without loss) to the shared folder, reads both back, and digests what it read."""
    stored = cut(stored_columns(docs, id_col, text_col), "media", compression="zstd", **{"parquet.compression.codec.zstd.level": "6"})

    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), np.int64)
            for i, j, _, _ in K.chunks(np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)])):
                media, pcm = batch.column(2).slice(i, j - i).to_pylist(), batch.column(3).slice(i, j - i).to_pylist()
                back = [unwav(m)[2] for m in media]
                heard = [f";pcm16k={zlib.crc32(unlift(p).astype("<i2").tobytes()):08x}" for p in pcm]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                    pa.array([zlib.crc32(p[-BLOCK:]) for p in back], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                    pa.array([f + h for f, h in zip(_features(back), heard, strict=True)], pa.string()),
                ], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(K.releasing(run), f"`{id_col}` {stored.schema[id_col].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
