"""Beats of a live signal: a detector whose state lives between micro-batches.

Samples arrive in packets ``(sensor_id, start, x array<double>)``. Work is done in hops of two seconds on a fixed grid: a hop
is filtered once the two seconds after it are known, its candidates are chosen once the next hop is filtered, and then
they pass an adaptive threshold whose levels, intervals and last beat go on from hop to hop. How the samples were cut into
packets and micro-batches therefore changes nothing, and a restart from a checkpoint goes on where the stream was.

State of a sensor: the raw samples that some hop still needs, the filtered ones since the last beat (``SEARCH_S`` seconds at
most, which is how far back a gap is searched), the two levels, the last intervals and the last beats: bounded, whatever the
length of the stream. Defined results: samples that are known already are dropped from a late packet; a hole of up to a
second is bridged by the last sample, after a longer one the detector starts anew; non-finite samples count as the last
finite one; what arrives in one micro-batch is put in order first; the last two hops of a stream stay open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import REFRACTORY_S, Adaptive, local_maxima
from ..operators.dsp import preprocess, stages

HOP_S, BRIDGE_S, SEARCH_S = 2.0, 1.0, 30.0
STATE = "origin long, raw_at long, raw array<double>, hop long, wave_at long, integrated array<double>, banded array<double>, signal double, noise double, intervals array<long>, last long, told long"


@dataclass
class Live:
    """``origin``: where hop 0 begins; ``hop``: the next hop to filter; ``last``: the last beat before refinement (-1: none), and ``told``
    the last one that was given out. Places are counted from ``origin`` but for that."""

    fs: float
    origin: int = 0
    raw_at: int = 0
    raw: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hop: int = 0
    wave_at: int = 0
    integrated: np.ndarray = field(default_factory=lambda: np.zeros(0))
    banded: np.ndarray = field(default_factory=lambda: np.zeros(0))
    signal: float = 0.0
    noise: float = 0.0
    intervals: list[int] = field(default_factory=list)
    last: int = -1
    told: int = -1

    @property
    def size(self) -> int:
        return max(2, round(HOP_S * self.fs))

    def state(self) -> tuple:
        return (self.origin, self.raw_at, self.raw.tolist(), self.hop, self.wave_at, self.integrated.tolist(), self.banded.tolist(), self.signal, self.noise, list(self.intervals), self.last, self.told)

    @classmethod
    def of(cls, fs: float, state: tuple) -> Live:
        origin, raw_at, raw, hop, wave_at, integrated, banded, signal, noise, intervals, last, told = state
        arrays = (np.array(a, float) for a in (raw, integrated, banded))
        raw, integrated, banded = arrays
        return cls(fs, origin, raw_at, raw, hop, wave_at, integrated, banded, signal, noise, [int(v) for v in intervals], last, told)

    def push(self, start: int, x: np.ndarray) -> list[int]:
        """Beats that the samples ``x`` from ``start`` on settle."""
        known = self.origin + self.raw_at + len(self.raw)
        if not len(self.raw) and self.hop == 0:
            self.origin = known = start
        if start > known + BRIDGE_S * self.fs:
            self.__dict__.update(Live(self.fs, origin=start, told=self.told).__dict__)
            known = start
        x = np.asarray(x, float)[max(0, known - start) :]
        if start > known:
            x = np.concatenate([np.full(start - known, np.nan), x])
        if not len(x):
            return []
        joined = np.concatenate([self.raw[-1:], x])
        good = np.maximum.accumulate(np.where(np.isfinite(joined), np.arange(len(joined)), -1))
        filled = np.where(good >= 0, joined[np.maximum(good, 0)], 0.0)
        self.raw = np.concatenate([self.raw, filled[len(self.raw[-1:]) :]])
        out: list[int] = []
        while self.raw_at + len(self.raw) >= (self.hop + 2) * self.size:
            self._filter()
            if self.hop >= 2:
                out += self._judge(self.hop - 2)
        return out

    def _filter(self) -> None:
        """Filter the next hop with two seconds to each side."""
        low = max(0, (self.hop - 1) * self.size)
        part = self.raw[low - self.raw_at : (self.hop + 2) * self.size - self.raw_at]
        s = stages(preprocess(part, self.fs), self.fs)
        own = slice(self.hop * self.size - low, (self.hop + 1) * self.size - low)
        self.integrated, self.banded = np.concatenate([self.integrated, s["integrated"][own]]), np.concatenate([self.banded, s["bandpassed"][own]])
        if self.hop == 0:
            self.signal, self.noise = 0.25 * float(self.integrated.max()), 0.5 * float(self.integrated.mean())
        self.hop += 1
        drop = max(0, (self.hop - 1) * self.size - self.raw_at)
        self.raw, self.raw_at = self.raw[drop:], self.raw_at + drop

    def _judge(self, hop: int) -> list[int]:
        """Candidates of a hop, chosen beside those of its neighbours, against the threshold that the hops before have left."""
        distance, level, out = max(1, round(REFRACTORY_S * self.fs)), Adaptive(self.signal, self.noise), []
        low, high = max((hop - 1) * self.size, self.wave_at), (hop + 2) * self.size
        wave = self.integrated
        found = low + local_maxima(wave[low - self.wave_at : high - self.wave_at], distance)
        for at in found[(found >= hop * self.size) & (found < (hop + 1) * self.size)].tolist():
            height, threshold = float(wave[at - self.wave_at]), level.threshold
            recent = self.intervals[-8:]
            if len(recent) >= 2 and at - self.last > max(distance, 1.66 * sum(recent) / len(recent)):
                a = max(self.last + distance, self.wave_at)
                if a < at:
                    best = a + int(np.argmax(wave[a - self.wave_at : at - self.wave_at]))
                    if wave[best - self.wave_at] > 0.5 * threshold:
                        out += self._beat(best)
                        level.beat(float(wave[best - self.wave_at]), 0.25)
            if height > threshold and (self.last < 0 or at - self.last >= distance):
                out += self._beat(at)
                level.beat(height)
            else:
                level.other(height)
        self.signal, self.noise = level.signal, level.noise
        keep = max(self.last if self.last >= 0 else 0, (hop + 1) * self.size - round(SEARCH_S * self.fs), 0)
        drop = max(0, min(keep, hop * self.size) - distance - self.wave_at)
        self.integrated, self.banded, self.wave_at = self.integrated[drop:], self.banded[drop:], self.wave_at + drop
        return out

    def _beat(self, at: int) -> list[int]:
        """Take a beat, and give out where the filtered signal is largest within 50 ms of it, unless that is too close to the one before."""
        if self.last >= 0:
            self.intervals = [*self.intervals, at - self.last][-8:]
        self.last = at
        half = max(1, round(0.05 * self.fs))
        a = max(self.wave_at, at - half)
        place = self.origin + a + int(np.argmax(np.abs(self.banded[a - self.wave_at : at + half + 1 - self.wave_at])))
        if self.told >= 0 and place - self.told < round(REFRACTORY_S * self.fs):
            return []
        self.told = place
        return [place]


def live_beats(packets: DataFrame, fs: float) -> DataFrame:
    """``(sensor_id, sample)`` of a stream of packets ``(sensor_id, start, x)``."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = Live.of(fs, state.get) if state.exists else Live(fs)
        rows = sorted(((int(s), np.asarray(x, float)) for b in batches for s, x in zip(b["start"], b["x"], strict=True)), key=lambda r: r[0])
        found = [p for start, x in rows for p in live.push(start, x)]
        state.update(live.state())
        yield pd.DataFrame({"sensor_id": pd.Series([key[0]] * len(found), dtype="int64"), "sample": pd.Series(found, dtype="int64")})

    return packets.groupBy("sensor_id").applyInPandasWithState(run, "sensor_id long, sample long", STATE, "append", GroupStateTimeout.NoTimeout)
