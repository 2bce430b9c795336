"""Point clouds: PCD v0.7 files with typed fields, and packed float32 x, y, z, intensity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4"}
POINT = "scan_id bigint, point_idx int, x float, y float, z float, intensity float"


def decode_pcd(content: bytes, strict: bool = False) -> np.ndarray:
    """A structured array of a binary or ascii PCD; ``strict`` wants 4-byte floats of count 1 only.

    Sizes are checked against the content before anything is allocated.
    """
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError("PCD header without DATA")
        words = content[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            head[words[0].upper()] = words[1:]
    try:
        names, sizes, kinds = head["FIELDS"], [int(x) for x in head["SIZE"]], head["TYPE"]
        counts = [int(x) for x in head.get("COUNT", ["1"] * len(names))]
        n = int(head["POINTS"][0])
    except (KeyError, ValueError) as e:
        raise ValueError(f"PCD header: {e}") from None
    if strict and any((k, s, c) != ("F", 4, 1) for k, s, c in zip(kinds, sizes, counts, strict=True)):
        raise ValueError("every field must be a 4-byte float of count 1")
    if not {"x", "y", "z"} <= set(names) or n < 0:
        raise ValueError("x, y and z are needed")
    dtype = np.dtype([(name, _KINDS[k, s], *([(c,)] if c > 1 else [])) for name, k, s, c in zip(names, kinds, sizes, counts, strict=True)])
    if head["DATA"][0] == "ascii":
        rows = [tuple(line.split()) for line in content[at:].decode().splitlines() if line.strip()]
        if len(rows) != n:
            raise ValueError("number of points")
        return np.array([tuple(float(v) for v in r) for r in rows], dtype=[(name, "<f8") for name in names])
    if head["DATA"][0] != "binary":
        raise ValueError(f"DATA {head['DATA'][0]}")
    if len(content) - at < n * dtype.itemsize:
        raise ValueError("PCD is cut short")
    return np.frombuffer(content, dtype, n, at)


def encode_pcd(points: np.ndarray) -> bytes:
    """Binary PCD of eight float fields (x y z, zero normals, intensity, zero curvature) from rows of x, y, z, intensity."""
    names = "x y z normal_x normal_y normal_z intensity curvature"
    rows = np.zeros((len(points), 8), "<f4")
    rows[:, :3], rows[:, 6] = points[:, :3], points[:, 3]
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {names}\nSIZE{' 4' * 8}\nTYPE{' F' * 8}\nCOUNT{' 1' * 8}\nWIDTH {len(rows)}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {len(rows)}\nDATA binary\n"
    return head.encode() + rows.tobytes()


def decode_bin(content: bytes) -> np.ndarray:
    if len(content) % 16:
        raise ValueError("not rows of four floats")
    return np.frombuffer(content, "<f4").reshape(-1, 4)


def _points(content: bytes, suffix: str, strict: bool) -> np.ndarray:
    if suffix == "bin":
        return decode_bin(content)
    raw = decode_pcd(content, strict)
    return np.stack([np.asarray(raw[c], np.float32) if c in raw.dtype.names else np.zeros(len(raw), np.float32) for c in ("x", "y", "z", "intensity")], 1)


def read_clouds(spark: SparkSession, path: str, strict: bool = False, drop_non_finite: bool = True, contiguous: bool = False) -> DataFrame:
    """(scan_id, point_idx, x, y, z, intensity) of every ``<number>.pcd`` and ``.bin`` under a folder, a task decoding some files.

    ``contiguous`` raises unless the numbers are 0, 1, 2, ... without gap.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"(\d+)\.(pcd|bin)$", 1)
    files = files.where(name != "").select(name.cast("long").alias("scan_id"), F.regexp_extract("path", r"\.(pcd|bin)$", 1).alias("suffix"), "content")
    if contiguous:
        h = files.select("scan_id").agg(F.count("*").alias("n"), F.max("scan_id").alias("m"), F.count_distinct("scan_id").alias("d")).first()
        if h.n and (h.m + 1 != h.n or h.d != h.n):
            raise ValueError("cloud numbers are not contiguous from 0")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                p = _points(row.content, row.suffix, strict)
                at = np.arange(len(p), dtype=np.int32)
                if drop_non_finite:
                    ok = np.isfinite(p[:, :3]).all(1)
                    p, at = p[ok], at[ok]
                yield pd.DataFrame({"scan_id": row.scan_id, "point_idx": at, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "intensity": p[:, 3]})

    return files.mapInPandas(run, POINT)


def write_clouds(points: DataFrame, path: str, suffix: str = "pcd") -> DataFrame:
    """Writes each scan's points, in point_idx order, as one file in a shared folder; returns (scan_id, file, points).

    Files go through Hadoop-style rename where the folder is local to all (a mounted share); a rerun task overwrites its own file.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        pdf = pdf.sort_values("point_idx")
        p = pdf[["x", "y", "z", "intensity"]].to_numpy(np.float32)
        file = os.path.join(path, f"{int(pdf['scan_id'].iloc[0])}.{suffix}")
        os.makedirs(path, exist_ok=True)
        part = f"{file}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(encode_pcd(p) if suffix == "pcd" else p.astype("<f4").tobytes())
        os.replace(part, file)
        return pd.DataFrame({"scan_id": [int(pdf["scan_id"].iloc[0])], "file": [file], "points": [len(p)]})

    return points.groupBy("scan_id").applyInPandas(run, "scan_id bigint, file string, points bigint")
