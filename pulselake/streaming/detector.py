"""Live heart-rate metrics with Structured Streaming: event-time windows with a watermark, and a stateful interval
operator that carries each sensor's last beat between micro-batches. An extension: the batch operators above are what
the reference numbers are about."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RR_SCHEMA = "sensor_id long, sample long, rr_s double, valid boolean"


def windowed_rate(beats: DataFrame, window: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Beats per sensor and window of a stream ``(sensor_id, event_time)``; events later than ``late`` are dropped."""
    return beats.withWatermark("event_time", late).groupBy(F.window("event_time", window), "sensor_id").agg(F.count("*").alias("n_beats"))


def streaming_rr(beats: DataFrame, fs: float) -> DataFrame:
    """Intervals of a stream ``(sensor_id, sample)``; beats that arrive behind the last one of their sensor are dropped."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        samples = sorted({int(s) for b in batches for s in b["sample"]})
        rows = []
        for s in samples:
            if last is not None and s <= last:
                continue
            if last is not None:
                rr = (s - last) / fs
                rows.append((key[0], s, rr, 0.2 <= rr <= 2.5))
            last = s
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["sensor_id", "sample", "rr_s", "valid"])

    return beats.groupBy("sensor_id").applyInPandasWithState(run, RR_SCHEMA, "last long", "append", GroupStateTimeout.NoTimeout)
