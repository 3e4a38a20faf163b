"""Usable and unusable stretches of live signals, by the rules of ``segments``.

Packets ``(sensor_id, start, x array<double>, event_time)`` carry the corrected clock of their recording; a watermark on it says
when a sensor has gone quiet. The state of a sensor is what is open: samples of half a second that is not full, the run of good or
bad samples at the end, and the segment that the next run may still belong to. A segment is given out when a different one begins,
and the last one when the watermark passes ``idle_s`` after the sensor's last packet: then the session ends, and later packets open
a new one.

Defined results: samples that are known already are dropped from a late packet, and packets behind the watermark are dropped as
a whole; a hole between packets counts as samples that are not finite; ``scale``, the sensor's usual step, is given with
the packets, since a stream never knows the median over all of itself; a null scale makes everything flat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.segments import bad_places, block_steps

SEGMENTS = "sensor_id long, start long, end long, usable boolean, reason string"
STATE = "at long, before double, rest array<double>, bad boolean, first long, gap boolean, usable boolean, reason string, opened long, until long, latest long"


class Session:
    """``at``: the first sample that is not judged yet, of which ``rest`` are known; ``before``: the one before it. ``bad``, ``first``, ``gap``: the
    run at the end. ``usable``, ``reason``, ``opened``, ``until``: the segment that is open."""

    def __init__(self, fs: float, min_dropout_s: float = 1.0):
        self.n_win, self.shortest = max(1, round(0.5 * fs)), round(min_dropout_s * fs)
        self.at, self.before, self.rest = 0, None, np.zeros(0)
        self.bad, self.first, self.gap = None, 0, False
        self.usable, self.reason, self.opened, self.until = None, None, 0, 0
        self.latest = 0

    def state(self) -> tuple:
        return (self.at, self.before, self.rest.tolist(), self.bad, self.first, self.gap, self.usable, self.reason, self.opened, self.until, self.latest)

    def resume(self, state: tuple) -> Session:
        self.at, self.before, rest, self.bad, self.first, self.gap, self.usable, self.reason, self.opened, self.until, self.latest = state
        self.rest = np.array(rest, float)
        return self

    def push(self, start: int, x: np.ndarray, scale: float | None) -> list[tuple]:
        """Segments that end before these samples are judged."""
        known = self.at + len(self.rest)
        x = np.asarray(x, float)[max(0, known - start) :]
        if len(x) and start > known:
            x = np.concatenate([np.full(start - known, np.nan), x])
        self.rest = np.concatenate([self.rest, x])
        whole = len(self.rest) - len(self.rest) % self.n_win
        return self._judge(whole, scale)

    def close(self, scale: float | None) -> list[tuple]:
        """What is left when the session ends."""
        out = self._judge(len(self.rest), scale)
        if self.bad is not None:
            out += self._run(self.at)
            out.append((self.opened, self.until, self.usable, self.reason))
        return out

    def _judge(self, n: int, scale: float | None) -> list[tuple]:
        x, self.rest = self.rest[:n], self.rest[n:]
        out: list[tuple] = []
        if not n:
            return out
        ok, step = block_steps(x, None if self.at == 0 else self.before)
        bad = bad_places(ok, step, scale, self.n_win)
        cuts = np.flatnonzero(np.append(True, bad[1:] != bad[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], n), strict=True):
            if self.bad is not None and self.bad != bad[a]:
                out += self._run(self.at + int(a))
                self.bad = None
            if self.bad is None:
                self.bad, self.first, self.gap = bool(bad[a]), self.at + int(a), False
            self.gap = bool(self.gap or not ok[a:b].all())
        self.at, self.before = self.at + n, float(x[-1])
        return out

    def _run(self, end: int) -> list[tuple]:
        """The run at the end is over: it carries the open segment on, or ends it and opens its own."""
        usable = not self.bad or end - self.first < self.shortest
        reason = None if usable else "nan" if self.gap else "flatline"
        done = []
        if self.usable is not None and (self.usable, self.reason) != (usable, reason):
            done = [(self.opened, self.until, self.usable, self.reason)]
            self.usable = None
        if self.usable is None:
            self.usable, self.reason, self.opened = usable, reason, self.first
        self.until = end
        return done


def dropout_sessions(packets: DataFrame, fs: float, late: str = "10 seconds", idle_s: float = 60.0) -> DataFrame:
    """``SEGMENTS`` of a stream of packets ``(sensor_id, start, x, event_time, scale)``."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session(fs)
        if state.exists:
            *known, scale = state.get
            session.resume(tuple(known))
        found: list[tuple] = []
        if state.hasTimedOut:
            found = session.close(scale)
            state.remove()
        else:
            rows = sorted(((int(s), np.asarray(x, float), t, c) for b in batches for s, x, t, c in zip(b["start"], b["x"], b["event_time"], b["scale"], strict=True)), key=lambda r: r[0])
            for start, x, when, given in rows:
                scale = None if pd.isna(given) else float(given)
                found += session.push(start, x, scale)
                session.latest = max(session.latest, int(pd.Timestamp(when).timestamp() * 1000))
            state.update((*session.state(), scale))
            state.setTimeoutTimestamp(max(session.latest + int(idle_s * 1000), state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(found, columns=["start", "end", "usable", "reason"]).astype({"start": "int64", "end": "int64", "usable": "bool"})
        out.insert(0, "sensor_id", pd.Series([key[0]] * len(found), dtype="int64"))
        yield out

    rows = packets.withWatermark("event_time", late).select("sensor_id", "start", "x", "event_time", "scale")
    return rows.groupBy("sensor_id").applyInPandasWithState(run, SEGMENTS, f"{STATE}, scale double", "append", GroupStateTimeout.EventTimeTimeout)
