"""Descriptor databases as text with packed masks: reader of formats 1 to 7, writer of format 7.

A file is a magic word, a PARAMS line, ENTRIES n, and per entry its pose scalars, the rows of the
dense matrix and a validity mask. The Spark source splits by file; at rest the engine's own form is Parquet.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from placerec.config import MAX_CELLS, MAX_ENTRIES, MAX_RINGS, MAX_SECTORS, DescriptorConfig

# Fixed value: the magic word of format n is this and n.
MAGIC = "FAST_LIO_SCAN_CONTEXT_DB_V"
ENTRY = "file string, scan_id int, stamp double, x double, y double, z double, roll double, pitch double, yaw double, canonical_yaw double, rings int, sectors int, dual_layer boolean, split_height double, origin_height double, lower_weight double, upper_weight double, min_joint_rings int, gravity boolean, h array<double>"

#: What a format holds beside the common part.
_OFFSET = {1, 2, 3, 4}
_ORIGIN = {6, 7}
_GRAVITY = {4, 5, 6, 7}


class _Text:
    """Words and lines of a buffer that also holds raw bytes."""

    _word = re.compile(rb"\s*(\S+)")

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def word(self) -> str:
        m = self._word.match(self.data, self.at)
        if not m:
            raise ValueError("the file ends early")
        self.at = m.end()
        return m[1].decode("ascii", "replace")

    def expect(self, token: str) -> None:
        if (got := self.word()) != token:
            raise ValueError(f"{token} expected, {got} found")

    def line(self) -> str:
        end = self.data.find(b"\n", self.at)
        end = len(self.data) if end < 0 else end
        out, self.at = self.data[self.at : end], end + 1
        return out.decode("ascii", "replace")

    def line_break(self) -> None:
        for b in (b"\n", b"\r\n"):
            if self.data.startswith(b, self.at):
                self.at += len(b)
                return
        raise ValueError("line break expected")

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]


def _params(words: list[str], version: int) -> dict:
    d, left = DescriptorConfig(), iter(words)
    try:
        p = {"rings": int(next(left)), "sectors": int(next(left)), "max_radius": float(next(left))}
        p["offset"] = float(next(left)) if version in _OFFSET else 0.0
    except StopIteration:
        raise ValueError("PARAMS is cut short") from None
    rest = list(left)
    p |= {"dual_layer": False, "split_height": d.split_height, "origin_height": 0.0, "lower_weight": d.lower_weight, "upper_weight": d.upper_weight, "min_joint_rings": d.min_joint_rings, "gravity": False}
    if len(rest) >= 2 or version > 1:
        names = ["dual_layer", "split_height", *(["origin_height"] if version in _ORIGIN else []), "lower_weight", "upper_weight", *(["min_joint_rings"] if version > 1 else []), *(["gravity"] if version in _GRAVITY else [])]
        if len(rest) < len(names):
            raise ValueError("PARAMS is cut short")
        for name, raw in zip(names, rest, strict=False):
            if name == "gravity" and raw not in ("0", "1"):
                raise ValueError("the gravity flag is 0 or 1")
            p[name] = int(raw) != 0 if name in ("dual_layer", "gravity") else int(raw) if name == "min_joint_rings" else float(raw)
    if not (0 < p["rings"] <= MAX_RINGS and 0 < p["sectors"] <= MAX_SECTORS and p["rings"] * p["sectors"] * 2 <= MAX_CELLS):
        raise ValueError("descriptor shape out of range")
    if not all(np.isfinite(v) for v in p.values()):
        raise ValueError("PARAMS hold a non-finite value")
    return p


def header(data: bytes) -> tuple[int, dict, int, int]:
    """(format, parameters, entries, where they begin) of a file's start."""
    t = _Text(data)
    magic = t.word()
    if not magic.startswith(MAGIC) or magic.removeprefix(MAGIC) not in "1234567":
        raise ValueError("not a descriptor database")
    version = int(magic.removeprefix(MAGIC))
    t.expect("PARAMS")
    p = _params((t.line().strip() or t.line()).split(), version)
    t.expect("ENTRIES")
    n = int(t.word())
    if not 0 <= n <= MAX_ENTRIES:
        raise ValueError("too many entries")
    return version, p, n, t.at


def cells_in(p: dict) -> int:
    return p["rings"] * (2 if p["dual_layer"] else 1) * p["sectors"]


def entry(t: _Text | bytes, version: int, p: dict, i: int) -> dict:
    """The next entry; its h is row-major, NaN where the mask is 0. Heights come out as format 7 has them."""
    t = _Text(t) if isinstance(t, bytes) else t
    cells = cells_in(p)
    t.expect("ENTRY")
    t.word()
    e = {name: float(t.word()) for name in ("stamp", "x", "y", "z", "roll", "pitch", "yaw", *(["canonical_yaw"] if version in _GRAVITY else []))}
    e.setdefault("canonical_yaw", e["yaw"])
    t.expect("DESC")
    h = np.array([float(t.word()) for _ in range(cells)])
    if not (np.isfinite(h).all() and np.isfinite(list(e.values())).all()):
        raise ValueError(f"entry {i} holds a non-finite value")
    if version == 1:
        valid = h != 0.0
    elif version == 2:
        t.expect("MASK")
        bits = [t.word() for _ in range(cells)]
        if set(bits) - {"0", "1"}:
            raise ValueError("mask")
        valid = np.array(bits) == "1"
    else:
        t.expect("MASK_BITS")
        if int(t.word()) != (cells + 7) // 8:
            raise ValueError("mask size")
        t.line_break()
        valid = np.unpackbits(np.frombuffer(t.raw((cells + 7) // 8), np.uint8), bitorder="little")[:cells].astype(bool)
        t.line_break()
    if version in _OFFSET:
        h = h - p["offset"]
    elif version == 6:
        h = h + p["origin_height"]
    t.expect("END_ENTRY")
    return e | {"scan_id": i, "h": np.where(valid, h, np.nan)}


def parse(data: bytes) -> tuple[int, dict, list[dict]]:
    """(format, parameters, entries) of a whole file."""
    version, p, n, at = header(data)
    if n * cells_in(p) * 2 > len(data):
        raise ValueError("more entries than the file can hold")
    t = _Text(data)
    t.at = at
    return version, p, [entry(t, version, p, i) for i in range(n)]


def _g(v: float) -> str:
    return f"{v:.17g}"


def header_bytes(p: dict, n: int) -> bytes:
    """What stands before the entries of a format 7 file."""
    return f"{MAGIC}7\nPARAMS {p['rings']} {p['sectors']} {_g(p['max_radius'])} {int(p['dual_layer'])} {_g(p['split_height'])} {_g(p['origin_height'])} {_g(p['lower_weight'])} {_g(p['upper_weight'])} {p['min_joint_rings']} {int(p['gravity'])}\nENTRIES {n}\n".encode()


def entry_bytes(p: dict, e: dict) -> bytes:
    """An entry of format 7 behind its number."""
    h = np.asarray(e["h"], float)
    if h.size != cells_in(p):
        raise ValueError("an entry has another shape than its file")
    valid = ~np.isnan(h)
    rows = np.where(valid, h, 0.0).reshape(-1, p["sectors"])
    scalars = " ".join(_g(e[c]) for c in ("stamp", "x", "y", "z", "roll", "pitch", "yaw", "canonical_yaw"))
    mask = np.packbits(valid, bitorder="little").tobytes()
    return f"{scalars}\nDESC\n".encode() + "".join(" ".join(map(_g, r)) + "\n" for r in rows.tolist()).encode() + f"MASK_BITS {len(mask)}\n".encode() + mask + b"\nEND_ENTRY\n"


def dump(params: dict, entries: list[dict]) -> bytes:
    """A whole format 7 file."""
    return header_bytes(params, len(entries)) + b"".join(f"ENTRY {i} ".encode() + entry_bytes(params, e) for i, e in enumerate(entries))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of each database file; h has nulls where the mask is 0."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                _, p, entries = parse(row.content)
                keep = {k: v for k, v in p.items() if k not in ("offset", "max_radius")}
                if entries:
                    yield pd.DataFrame([{"file": row.path, **e, **keep, "h": [None if np.isnan(v) else float(v) for v in e["h"]]} for e in entries])[[c.split()[0] for c in ENTRY.split(", ")]]

    return files.mapInPandas(run, ENTRY)


def cells_of(entries: DataFrame) -> DataFrame:
    """Database entries in cell form (scan_id, layer, ring, sector, h)."""
    from pyspark.sql import functions as F

    c = entries.select("scan_id", "rings", "sectors", F.posexplode("h").alias("at", "h")).where("h is not null")
    row = F.floor(F.col("at") / F.col("sectors"))
    return c.select("scan_id", F.floor(row / F.col("rings")).cast("int").alias("layer"), (row % F.col("rings")).cast("int").alias("ring"), (F.col("at") % F.col("sectors")).cast("int").alias("sector"), "h")


def write(path: str, params: dict, entries: list[dict]) -> None:
    """Writes one database beside its place and renames it there. A database has at most MAX_ENTRIES entries."""
    import os

    if len(entries) > MAX_ENTRIES:
        raise ValueError("too many entries")
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(dump(params, entries))
    os.replace(part, path)


def convert(source: str, target: str) -> int:
    """Any format to format 7; returns the number of entries."""
    with open(source, "rb") as f:
        _, p, entries = parse(f.read())
    write(target, p, entries)
    return len(entries)


def subset(source: str, target: str, indices: list[int]) -> None:
    """The entries of strictly rising indices, as a database of their own."""
    with open(source, "rb") as f:
        _, p, entries = parse(f.read())
    if not indices or any(b <= a for a, b in zip(indices, indices[1:], strict=False)) or indices[0] < 0 or indices[-1] >= len(entries):
        raise ValueError("indices must rise within the database")
    write(target, p, [entries[i] for i in indices])
