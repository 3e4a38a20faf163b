"""Intervals between beats: series, variability, trends, ectopic candidates, irregular-rhythm windows.

Beats are ``(sensor_id, beat_idx, sample)``; every window partitions by sensor and orders by beat, so all of them
share one exchange and one sort.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import hr_bpm, median_of, ratio, unit

SHORTEST, LONGEST = 0.20, 2.50


def by_beat() -> WindowSpec:
    return Window.partitionBy("sensor_id").orderBy("beat_idx")


def by_rr() -> WindowSpec:
    return Window.partitionBy("sensor_id").orderBy("rr_idx")


def rr_series(beats: DataFrame, fs: float) -> DataFrame:
    """``(sensor_id, rr_idx, t_s, rr_s, valid)``: time and interval of each beat but the first."""
    rr = (F.col("sample") - F.lag("sample").over(by_beat())) / float(fs)
    out = beats.select("sensor_id", (F.col("beat_idx") - 1).alias("rr_idx"), (F.col("sample") / float(fs)).alias("t_s"), rr.alias("rr_s"))
    return out.where("rr_s is not null").withColumn("valid", F.col("rr_s").between(SHORTEST, LONGEST))


def hrv(rr: DataFrame) -> DataFrame:
    """Variability of valid intervals; successive differences only between intervals that really adjoin."""
    clean = rr.where("valid").withColumn("ms", F.col("rr_s") * 1000)
    adjoins = F.col("rr_idx") - F.lag("rr_idx").over(by_rr()) == 1
    clean = clean.withColumn("d", F.when(adjoins, F.col("ms") - F.lag("ms").over(by_rr())))
    hr = hr_bpm(F.col("rr_s"))
    return clean.groupBy("sensor_id").agg(
        F.count("*").alias("n_valid"), F.avg(hr).alias("mean_hr"), F.min(hr).alias("min_hr"), F.max(hr).alias("max_hr"), F.avg("ms").alias("mean_rr_ms"),
        F.stddev_samp("ms").alias("sdnn_ms"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd_ms"),
        (100 * F.avg((F.abs("d") > 50).cast("double"))).alias("pnn50"), ratio(F.stddev_samp("ms"), F.avg("ms")).alias("cv"),
    )


def heart_rate_trend(rr: DataFrame, window_s: float = 60.0) -> DataFrame:
    """Mean rate of each window, empty ones included; an interval on the last edge belongs to none."""
    ends = rr.groupBy("sensor_id").agg(F.ceil(F.max("t_s") / window_s).alias("n"))
    every = ends.where("n > 0").select("sensor_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w"))
    means = rr.where("valid").groupBy("sensor_id", F.floor(F.col("t_s") / window_s).alias("w")).agg(F.avg(hr_bpm(F.col("rr_s"))).alias("mean_hr"))
    return every.join(means, ["sensor_id", "w"], "left")


def local_median(rr: DataFrame, k: int = 11) -> DataFrame:
    """``rr`` with the median of the k intervals around each, ends replicated; k shrinks to the longest odd series."""
    most = k // 2
    n, at = F.count("*").over(Window.partitionBy("sensor_id")), F.row_number().over(by_rr()) - 1
    near = F.collect_list("rr_s").over(by_rr().rowsBetween(-most, most))
    rows = rr.withColumns({"n": n, "at": at, "near": near})
    n, at, near = F.col("n"), F.col("at"), F.col("near")
    half = F.floor((F.least(F.lit(k), n - (1 - n % 2)) - 1) / 2).cast("int")
    skip = F.greatest(F.lit(0), at - half) - F.greatest(F.lit(0), at - most)  # what the frame holds beyond the window
    before, after = F.greatest(F.lit(0), half - at), F.greatest(F.lit(0), at + half - (n - 1)).cast("int")
    inside = F.slice(near, (skip + 1).cast("int"), (2 * half + 1 - before - after).cast("int"))
    window = F.concat(F.array_repeat(F.get(inside, F.lit(0)), before), inside, F.array_repeat(F.element_at(inside, -1), after))
    return rows.withColumn("local_median", median_of(window)).drop("n", "at", "near")


def ectopic_candidates(rr: DataFrame, prematurity: float = 0.80, compensation: float = 1.15) -> DataFrame:
    """Short intervals that a long one follows; series of fewer than five intervals have none."""
    rows = local_median(rr).withColumn("r", ratio(F.col("rr_s"), F.col("local_median")))
    rows = rows.withColumn("next_r", F.lead("r").over(by_rr())).withColumn("n", F.count("*").over(Window.partitionBy("sensor_id")))
    return rows.where((F.col("n") >= 5) & F.col("valid") & (F.col("r") < prematurity) & (F.col("next_r") > compensation)).select("sensor_id", "rr_idx", "t_s", "r", "next_r")


def pre_post_ratio(rr: DataFrame) -> DataFrame:
    """Each beat's interval before and after it against the local median before it."""
    rows = local_median(rr)
    return rows.select("sensor_id", (F.col("rr_idx") + 1).alias("beat_idx"), ratio(F.col("rr_s"), F.col("local_median")).alias("pre"), ratio(F.lead("rr_s").over(by_rr()), F.col("local_median")).alias("post"))


def af_windows(beats: DataFrame, fs: float, window_s: float = 30.0, excluded: DataFrame | None = None, least_beats: int = 9, least_rr: int = 8) -> DataFrame:
    """Irregularity of each window: normalised successive differences, Shannon entropy over 16 bins and share of
    turning points, weighed into a score. ``excluded (sensor_id, beat_idx)`` takes out both intervals of a beat."""
    rr = rr_series(beats, fs)
    if excluded is not None:
        out = excluded.select("sensor_id", F.col("beat_idx").alias("b")).distinct()
        for shift in (1, 0):  # the interval's last and its first beat
            gone = out.select("sensor_id", (F.col("b") - shift).alias("rr_idx"))
            rr = rr.join(gone, ["sensor_id", "rr_idx"], "left_anti")
    size = beats.groupBy("sensor_id").agg(F.count("*").alias("n_beats"), F.ceil(F.max("sample") / float(fs) / window_s).alias("n_windows"))
    rows = rr.join(size, "sensor_id").where(F.col("n_beats") >= least_beats).withColumn("w", F.floor(F.col("t_s") / window_s)).where("w < n_windows")
    inside = Window.partitionBy("sensor_id", "w").orderBy("rr_idx")
    whole = Window.partitionBy("sensor_id", "w")
    before, after = F.lag("rr_s").over(inside), F.lead("rr_s").over(inside)
    low, high = F.min("rr_s").over(whole), F.max("rr_s").over(whole)
    inner = before.isNotNull() & after.isNotNull()
    turns = ((F.col("rr_s") > before) & (F.col("rr_s") > after)) | ((F.col("rr_s") < before) & (F.col("rr_s") < after))
    rows = rows.select(
        "sensor_id", "w", "rr_s", (F.col("rr_s") - before).alias("d"), F.when(inner, turns.cast("double")).alias("turn"),
        F.when(high > low, F.least(F.lit(15), F.floor(ratio(F.col("rr_s") - low, high - low) * 16))).otherwise(0).alias("bin"),
    )
    bins = rows.groupBy("sensor_id", "w", "bin").agg(F.count("*").alias("c"), F.sum("rr_s").alias("s"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.count("d").alias("nd"), F.sum("turn").alias("turns"), F.count("turn").alias("nt"))
    windows = bins.groupBy("sensor_id", "w").agg(
        F.sum("c").alias("n_rr"), F.sum("s").alias("s"), F.sum("dd").alias("dd"), F.sum("nd").alias("nd"), F.sum("turns").alias("turns"), F.sum("nt").alias("nt"), F.sum(F.col("c") * F.ln("c")).alias("clogc")
    ).where(F.col("n_rr") >= least_rr)
    entropy = (F.ln("n_rr") - F.col("clogc") / F.col("n_rr")) / F.ln(F.lit(16.0))
    windows = windows.select(
        "sensor_id", "w", "n_rr", (F.sqrt(F.col("dd") / F.col("nd")) / (F.col("s") / F.col("n_rr"))).alias("nrmssd"), entropy.alias("entropy"), ratio(F.col("turns"), F.col("nt")).alias("turning")
    )
    # fixed values: weights and bounds of the three measures
    score = 0.45 * unit((F.col("nrmssd") - 0.05) / 0.20) + 0.30 * unit((F.col("entropy") - 0.55) / 0.35) + 0.25 * unit((F.col("turning") - 0.40) / 0.25)
    return windows.withColumn("score", score).withColumn("is_af", F.col("score") >= 0.5)


def af_burden(windows: DataFrame) -> DataFrame:
    return windows.groupBy("sensor_id").agg(F.count("*").alias("n_windows"), F.avg(F.col("is_af").cast("double")).alias("burden"))


def af_episodes(windows: DataFrame, window_s: float = 30.0, least_s: float = 30.0) -> DataFrame:
    """Runs of irregular windows in the order in which they were assessed; windows left out are bridged."""
    order = Window.partitionBy("sensor_id").orderBy("w")
    changed = F.when(F.col("is_af").eqNullSafe(F.lag("is_af").over(order)), 0).otherwise(1)
    runs = windows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order)).where("is_af")
    runs = runs.groupBy("sensor_id", "run").agg((F.min("w") * window_s).alias("start_s"), ((F.max("w") + 1) * window_s).alias("end_s"), F.count("*").alias("n_windows"))
    return runs.where(F.col("end_s") - F.col("start_s") >= least_s).select("sensor_id", "start_s", "end_s", "n_windows")


def _kept(samples: list[int], last: int | None, refractory: int) -> list[int]:
    """Of ordered samples those that stay after a kept one at ``last``: each jump goes to the first that is far enough."""
    out, at = [], 0 if last is None else bisect_left(samples, last + refractory)
    while at < len(samples):
        out.append(samples[at])
        at = bisect_left(samples, samples[at] + refractory, at + 1)
    return out


def dedupe_peaks(peaks: DataFrame, refractory: int, slot: int = 1 << 18) -> DataFrame:
    """Per sensor, peaks in order; one closer than ``refractory`` to the last kept one goes. A sensor is cut into slots, and each slot
    is a function: from the peak that was kept last before it to the one kept last in it, given for the few peaks that are near
    enough to matter. Only these functions are composed in order, over a sensor's slots; then each slot, its own task if
    need be, is gone through once, from where the one before left it."""
    slot = max(slot, refractory, 1)
    kind = peaks.schema["sensor_id"].dataType.simpleString()
    rows = peaks.groupBy("sensor_id", F.floor(F.col("sample") / slot).alias("slot")).agg(F.array_sort(F.collect_set(F.col("sample").cast("long"))).alias("samples"))
    tails = rows.select("sensor_id", "slot", F.filter("samples", lambda x: (F.col("slot") + 1) * slot - x < refractory).alias("tail")).withColumn("slot", F.col("slot") + 1)
    rows = rows.join(tails, ["sensor_id", "slot"], "left").select("sensor_id", "slot", "samples", F.coalesce("tail", F.array().cast("array<bigint>")).alias("tail"))

    def ends(batches):
        for batch in batches:
            keys, values = [], []
            for samples, tail in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keys.append([None, *tail])
                values.append([(_kept(samples, last, refractory) or [last])[-1] for last in keys[-1]])
            steps = [[{"after": k, "last": v} for k, v in zip(*pair, strict=True)] for pair in zip(keys, values, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(steps, pa.list_(pa.struct([("after", pa.int64()), ("last", pa.int64())])))], names=["sensor_id", "slot", "steps"])

    step = rows.mapInArrow(ends, f"sensor_id {kind}, slot long, steps array<struct<after:bigint,last:bigint>>")

    def compose(batches):
        for batch in batches:
            for row, slots in enumerate(batch.column(1).to_pylist()):
                last, out = None, []
                for s in slots:
                    known = {x["after"]: x["last"] for x in s["steps"]}
                    last = known.get(last, known[None])  # what was kept last does not matter if it is no peak near this slot
                    out.append((s["slot"] + 1, last))
                at, before = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(out), row))), pa.array(at, pa.int64()), pa.array(before, pa.int64())], names=["sensor_id", "slot", "before"])

    functions = step.groupBy("sensor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "steps"))).alias("slots"))  # a few numbers a slot
    before = functions.mapInArrow(compose, f"sensor_id {kind}, slot long, before long")
    rows = rows.join(before, ["sensor_id", "slot"], "left").select("sensor_id", "samples", "before")

    def run(batches):
        for batch in batches:
            kept = [_kept(s, last, refractory) for s, last in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n = [len(k) for k in kept]
            sensor = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([sensor, pa.array([x for k in kept for x in k], pa.int64())], names=["sensor_id", "sample"])

    return rows.mapInArrow(run, f"sensor_id {kind}, sample long")


def thin(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """Every ``max(1, n // most)``-th row of each sensor."""
    whole = Window.partitionBy("sensor_id")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(whole) / most))
    return rows.withColumn("step", step).withColumn("at", F.row_number().over(whole.orderBy(order)) - 1).where("at % step = 0").drop("at", "step")
