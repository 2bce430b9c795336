"""Descriptor databases as a Spark data source: ``spark.read.format("descriptor_db").load(path)`` and ``.write``.

A read cuts each file in ranges of bytes; a range holds the entries that begin in it, so a large database is read by many tasks,
each of its own part of the file. A write lets every task put its entries beside the target, numbered by nothing yet; the commit
streams them behind one header in the order of ``scan_id`` and renames the whole into place, so a reader sees the old file
or the new one. A failed write leaves nothing but what the abort removes.

Paths are those of pyarrow's file systems (local and shared folders, and stores with a scheme of their own).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from placerec.config import MAX_ENTRIES
from placerec.sources import descriptor_db as D

RANGE_BYTES, COPY_BYTES = 8 << 20, 1 << 20
#: Where an entry begins behind another one; so far back it is looked for from the start of a range.
NEXT, BACK = re.compile(rb"END_ENTRY\s+(?=ENTRY\s)"), 64


def _at(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


def _found(path: str) -> tuple[files.FileSystem, list[files.FileInfo]]:
    """The file of a path, or the files of a folder, but for hidden ones."""
    system, at = _at(path)
    info = system.get_file_info(at)
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.type == files.FileType.File else system.get_file_info(files.FileSelector(at))
    return system, sorted((f for f in every if f.type == files.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class DatabaseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        _, found = _found(self.path)
        return [Range(f.path, a, min(a + self.step, f.size)) for f in found for a in range(0, max(1, f.size), self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _at(self.path)
        with system.open_input_file(partition.path) as f:
            version, p, n, begin = D.header(f.read_at(min(f.size(), 1 << 16), 0))
            if n * D.cells_in(p) * 2 > f.size():
                raise ValueError("more entries than the file can hold")
            for number, data, last in _entries(f, max(partition.start, begin), partition.end, begin) if n else ():
                if last and number != n - 1:
                    raise ValueError("the file ends early")
                yield self._batch(partition.path, D.entry(data, version, p, number), p)

    @staticmethod
    def _batch(path: str, e: dict, p: dict) -> pa.RecordBatch:
        h = [None if np.isnan(v) else float(v) for v in e["h"]]
        row = {"file": path, **e, **{k: v for k, v in p.items() if k not in ("offset", "max_radius")}, "h": h}
        return pa.RecordBatch.from_pylist([{c: row[c] for c in SCHEMA.names}], schema=SCHEMA)


def _entries(f, start: int, end: int, begin: int) -> Iterator[tuple[int, bytes, bool]]:
    """(number, bytes, whether it is the file's last) of the entries that begin in [start, end); the first of a file does at ``begin``."""
    if start >= end:
        return
    inside, held, size = start == begin, b"", f.size()
    base = start if inside else max(begin, start - BACK)
    while True:
        cut = NEXT.search(held)
        if cut is None:
            more = f.read_at(min(COPY_BYTES, size - base - len(held)), base + len(held)) if base + len(held) < size else b""
            if more:
                held += more
                continue
            if inside and held.strip():
                yield _number(held), held, True
            return
        head = cut.end()
        if inside:
            yield _number(held), held[:head], False
        held, base = held[head:], base + head
        inside = inside or base >= start
        if base >= end:
            return


def _number(data: bytes) -> int:
    word = data[:64].split()
    if len(word) < 2 or word[0] != b"ENTRY":
        raise ValueError("ENTRY expected")
    return int(word[1])


class Written(WriterCommitMessage):
    def __init__(self, part: str, scans: list[int]):
        self.part, self.scans = part, scans


class DatabaseWriter(DataSourceWriter):
    """Rows need scan_id, the pose's columns and h; the shape and scoring come by the option ``params`` (JSON)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.params = options["path"], json.loads(options["params"])
        self.overwrite, self.run = overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        system, at = _at(self.path)
        part = f"{at}.{self.run}.{uuid.uuid4().hex}"
        scans = []
        with system.open_output_stream(part) as out:
            for r in rows:
                body = D.entry_bytes(self.params, {**r.asDict(), "h": [float("nan") if v is None else v for v in r.h]})
                out.write(struct.pack("<qq", r.scan_id, len(body)) + body)
                scans.append(r.scan_id)
        return Written(part, scans)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _at(self.path)
        done = [m for m in messages if m is not None]
        order = sorted((s, i, n) for i, m in enumerate(done) for n, s in enumerate(m.scans))
        if len(order) > MAX_ENTRIES:
            raise ValueError("too many entries")
        if not self.overwrite and system.get_file_info(at).type != files.FileType.NotFound:
            raise FileExistsError(self.path)
        whole = f"{at}.{self.run}.whole"
        opened = [system.open_input_file(m.part) for m in done]
        try:
            places = [self._places(f) for f in opened]
            with system.open_output_stream(whole) as out:
                out.write(D.header_bytes(self.params, len(order)))
                for number, (_, i, n) in enumerate(order):
                    start, size = places[i][n]
                    out.write(f"ENTRY {number} ".encode() + opened[i].read_at(size, start))
        finally:
            for f in opened:
                f.close()
        system.move(whole, at)
        for m in done:
            system.delete_file(m.part)

    @staticmethod
    def _places(f) -> list[tuple[int, int]]:
        at, out = 0, []
        while at < f.size():
            _, size = struct.unpack("<qq", f.read_at(16, at))
            out.append((at + 16, size))
            at += 16 + size
        return out

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _at(self.path)
        folder, _, name = at.rpartition("/")
        for f in system.get_file_info(files.FileSelector(folder or ".")):
            if f.base_name.startswith(f"{name}.{self.run}."):
                system.delete_file(f.path)


class DescriptorDatabase(DataSource):
    @classmethod
    def name(cls) -> str:
        return "descriptor_db"

    def schema(self) -> str:
        return D.ENTRY

    def reader(self, schema) -> DatabaseReader:
        return DatabaseReader(self.options)

    def writer(self, schema, overwrite: bool) -> DatabaseWriter:
        return DatabaseWriter(self.options, overwrite)


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in D.ENTRY.split(", ")])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DescriptorDatabase)
