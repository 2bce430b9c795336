"""Folds over streams in event-time order: rows wait in state until the watermark has passed them, whatever order they arrive in.

A row is ready when the watermark has reached its stamp; an event-time timer wakes its key then. The ready rows of a key
are folded in the order of (stamp, type, id), so the result depends on the rows alone, not on their arrival or on how they
fall into batches. Rows later than the watermark are dropped by Spark before. What has not been passed when a stream ends stays in the
checkpoint and is folded when the stream goes on. Needs the RocksDB state store, as all of ``transformWithState`` does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Columns that wait: time in microseconds, type, id, and three numbers.
ROW = "us bigint, type int, id bigint, a double, b double, c double"


class Ordered(StatefulProcessor):
    """The waiting and waking; a subclass folds ready rows and keeps ``memory``, a text of its own."""

    key, memory, output = "track_id", "text string", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.kept = handle.getValueState("kept", self.memory)

    def fold(self, key: tuple, rows: list[tuple], kept: tuple | None) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for pdf in rows for r in pdf[[c.split()[0] for c in ROW.split(", ")]].astype(object).itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList([(int(r[0]), int(r[1]), int(r[2]), *(None if x is None else float(x) for x in r[3:])) for r in new])
            self._wake(min(r[0] for r in new), timerValues)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        out = []
        if ready:
            out, kept = self.fold(key, ready, tuple(self.kept.get()) if self.kept.exists() else None)
            if kept is not None:
                self.kept.update(kept)
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if rest:
            self._wake(rest[0][0], timerValues)
        yield self._frame(key, out)

    def _wake(self, us: int, timer_values) -> None:
        # a timer in whole milliseconds, behind the row and ahead of the watermark
        at = max(-(-us // 1000), timer_values.getCurrentWatermarkInMs() + 1)
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [n for n, _ in self.output]
        pdf = pd.DataFrame([(key[0], *r) for r in rows], columns=[self.key, *names])
        return pdf.astype({self.key: "int64", **{n: {"bigint": "int64", "int": "int32", "double": "float64"}[t] for n, t in self.output}})

    def close(self) -> None:
        pass


class Keyframes(Ordered):
    """A track's first row, and each that lies ``spacing`` or turns ``turn`` (radians) from the last kept: a, b, c are x, y, yaw."""

    memory, output = "x double, y double, yaw double", (("event_id", "bigint"), ("x", "double"), ("y", "double"), ("yaw", "double"))

    def __init__(self, spacing: float, turn: float):
        self.spacing, self.turn = spacing, turn

    def fold(self, key, rows, kept):
        out = []
        for _, _, i, x, y, yaw in rows:
            if kept is None or math.hypot(x - kept[0], y - kept[1]) >= self.spacing or abs(math.remainder(yaw - kept[2], 2 * math.pi)) >= self.turn:
                kept = (x, y, yaw)
                out.append((i, x, y, yaw))
        return out, kept


class History(Ordered):
    """At each target (type 1) of a track its n latest rows of type 0 up to then; targets with fewer emit nothing."""

    memory, output = "ids array<bigint>", (("target_id", "bigint"), ("scan_id", "bigint"))

    def __init__(self, n: int):
        self.n = n

    def fold(self, key, rows, kept):
        held, out = list(kept[0]) if kept else [], []
        for _, kind, i, *_ in rows:
            if kind == 0:
                held = [*held, i][-self.n :]
            elif len(held) == self.n:
                out += [(i, x) for x in held]
        return out, (held,)


class Replay(Ordered):
    """Two recordings of a session as one: samples (type 0) and scans (type 1) by (stamp, type, id), numbered, with the time since the first.

    The span begins ``offset`` behind the session's first scan and lasts ``duration``; samples are taken from ``before`` ahead of it
    to ``after`` behind it; those ahead of the first scan are remembered as far back as that. Seconds; ``due`` is when a row is
    played at ``rate``.
    """

    memory = "first bigint, start bigint, n bigint, early array<struct<us:bigint,id:bigint>>"
    output = (("n", "bigint"), ("us", "bigint"), ("type", "int"), ("id", "bigint"), ("due", "double"))

    def __init__(self, offset: float, duration: float, before: float = 0.5, after: float = 0.2, rate: float = 1.0):
        if offset < 0 or duration <= 0 or rate <= 0:
            raise ValueError("duration and rate must be positive, the offset not negative")
        us = lambda s: round(s * 1_000_000)
        self.offset, self.duration, self.before, self.after, self.rate = us(offset), us(duration), us(before), us(after), rate

    def fold(self, key, rows, kept):
        first, start, n, early = kept if kept else (None, None, 0, [])
        # samples that came before the first scan: only those can be in the span that lie little ahead of it
        early, out = [tuple(e) for e in early or []], []
        for us, kind, i, *_ in rows:
            if first is None:
                if kind == 0:
                    early = [e for e in early if e[0] >= us - self.before] + [(us, i)]
                    continue
                first = us
                for e, j in early:
                    start, n = self._play(out, first, start, n, e, 0, j)
                early = []
            start, n = self._play(out, first, start, n, us, kind, i)
        return out, (first, start, n, early)

    def _play(self, out, first, start, n, us, kind, i):
        begin = first + self.offset
        low, high = (begin - self.before, begin + self.duration + self.after) if kind == 0 else (begin, begin + self.duration)
        if low <= us <= high:
            start = us if start is None else start
            out.append((n, us, kind, i, (us - start) / 1e6 / self.rate))
            n += 1
        return start, n


def run(stream: DataFrame, processor: Ordered, late: str, key: str = "track_id") -> DataFrame:
    """A stream of (key, ts, type, id, a, b, c) folded by a processor."""
    processor.key = key
    schema = f"{key} bigint, " + ", ".join(f"{n} {t}" for n, t in processor.output)
    rows = stream.select(key, "ts", F.unix_micros("ts").alias("us"), F.col("type").cast("int").alias("type"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "abc"])
    return rows.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


def plain(rows: DataFrame, processor: Ordered, key: str = "track_id") -> list[tuple]:
    """The same fold of rows at rest, a key at a time, for comparison."""
    import itertools

    got = sorted((r[key], r.us, r.type, r.id, r.a, r.b, r.c) for r in rows.select(key, F.unix_micros("ts").alias("us"), "type", "id", "a", "b", "c").collect())
    return [(k, *x) for k, g in itertools.groupby(got, lambda r: r[0]) for x in processor.fold((k,), [r[1:] for r in g], None)[0]]
