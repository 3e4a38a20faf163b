"""Matching of events in time: one-to-one within a tolerance, any within a tolerance, intervals and as-of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def greedy_pairs(detected: np.ndarray, reference: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Each detection in order takes the closest reference that is still free and within the tolerance, the earlier of
    two equally close ones. Indices into the sorted inputs."""
    used = np.zeros(len(reference), bool)
    low = np.searchsorted(reference, detected - tolerance, "left")
    high = np.searchsorted(reference, detected + tolerance, "right")
    pairs = []
    for d, (a, b) in enumerate(zip(low, high, strict=True)):
        free = np.flatnonzero(~used[a:b]) + a
        if len(free):
            r = int(free[np.argmin(np.abs(reference[free] - detected[d]))])
            used[r] = True
            pairs.append((d, r))
    return pairs


def blocks(detected: DataFrame, reference: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Both sides together with a ``block``: events farther apart than the tolerance cannot compete, so a gap in the union of
    both sides cuts a key into blocks that are matched apart, and a long recording is no single task."""
    every = detected.select(*keys, "sample", F.lit(True).alias("is_det")).unionByName(reference.select(*keys, "sample", F.lit(False).alias("is_det")))
    order = Window.partitionBy(*keys).orderBy("sample", "is_det")
    gap = F.coalesce(F.col("sample") - F.lag("sample").over(order) > tolerance, F.lit(True))
    return every.withColumn("block", F.sum(gap.cast("long")).over(order))


def greedy_match(detected: DataFrame, reference: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """``(keys, det_sample, ref_sample)``: matched pairs, and each side alone where nothing fits. The events of some hundred blocks
    travel as two arrays a row."""
    side = lambda is_det: F.array_sort(F.collect_list(F.when(F.col("is_det") == is_det, F.col("sample"))))
    rows = blocks(detected, reference, keys, tolerance).groupBy(*keys, F.floor(F.col("block") / 512).alias("part")).agg(side(True).alias("det"), side(False).alias("ref"))
    rows = rows.select(F.struct(*keys).alias("key"), "det", "ref")
    pair = pa.list_(pa.struct([("det_sample", pa.int64()), ("ref_sample", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for det, ref in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs = dict(greedy_pairs(np.array(det, np.int64), np.array(ref, np.int64), tolerance))
                used = set(pairs.values())
                own = [(d, ref[pairs[i]] if i in pairs else None) for i, d in enumerate(det)]
                own += [(None, r) for j, r in enumerate(ref) if j not in used]
                out.append([{"det_sample": d, "ref_sample": r} for d, r in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pair)], names=["key", "pairs"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, pairs array<struct<det_sample:bigint,ref_sample:bigint>>")
    return found.select(*[F.col(f"key.{k}") for k in keys], F.inline("pairs"))


def detection_scores(matches: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Counts and errors of ``greedy_match``. The mean error is a sum of whole samples divided once, so it is the nearest double to the
    exact mean in every order of the rows, and ties of a later rounding are met."""
    samples = F.abs(F.col("det_sample") - F.col("ref_sample"))
    return matches.groupBy(*keys).agg(
        F.count(samples).alias("tp"), F.count_if(F.col("ref_sample").isNull()).alias("fp"), F.count_if(F.col("det_sample").isNull()).alias("fn"),
        ratio(1000.0 * F.sum(samples), fs * F.count(samples)).alias("mean_error_ms"), F.stddev_pop(samples / (fs / 1000.0)).alias("std_error_ms"),
    )


def bsqi(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement of two detectors: matched beats over all beats of either."""
    return matches.groupBy(*keys).agg((F.count_if(F.col("det_sample").isNotNull() & F.col("ref_sample").isNotNull()) / F.count("*")).alias("bsqi"))


def gross(scores: DataFrame) -> DataFrame:
    """Counts summed over records; errors as the plain mean of the records' own."""
    return scores.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("mean_error_ms").alias("mean_error_ms"), F.avg("std_error_ms").alias("std_error_ms"))


def sensor_agreement(events: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """For each event of the first sensor (``source``) of a key, how many sensors have one within the tolerance, as a
    histogram; keys with one sensor have none. An equi-join on time slots of the tolerance's width."""
    first = events.groupBy(*keys).agg(F.min("source").alias("first"), F.max("source").alias("last")).where("first < last").select(*keys, "first")
    rows = events.join(first, keys)
    slot = F.floor(F.col("sample") / max(tolerance, 1))
    anchors = rows.where("source = first").select(*keys, "sample", F.monotonically_increasing_id().alias("anchor"))
    near = anchors.withColumn("slot", F.explode(F.array(*[F.floor(F.col("sample") / max(tolerance, 1)) + d for d in (-1, 0, 1)])))
    others = rows.where("source <> first").select(*keys, slot.alias("slot"), F.col("sample").alias("o"), "source")
    hits = near.join(others, [*keys, "slot"]).where(F.abs(F.col("o") - F.col("sample")) <= tolerance)
    seen = hits.groupBy(*keys, "sample").agg(F.countDistinct("source").alias("more"))
    counted = anchors.join(seen, [*keys, "sample"], "left").select(*keys, (1 + F.coalesce("more", F.lit(0))).alias("n_sensors"))
    return counted.groupBy(*keys, "n_sensors").agg(F.count("*").alias("n_events"))


def rhythm_transitions(notes: DataFrame) -> DataFrame:
    """Annotations ``(sensor_id, sample, aux)`` whose note, without null characters and outer spaces, opens with a bracket."""
    clean = F.trim(F.translate("aux", "\0", ""))
    return notes.select("sensor_id", "sample", clean.alias("label")).where(F.col("label").startswith("("))


def rhythm_intervals(transitions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Transitions ``(sensor_id, sample, label)`` as intervals up to the next one, the last up to the recording's length, of
    ``lengths (sensor_id, n_samples)``."""
    order = Window.partitionBy("sensor_id").orderBy("sample", "label")
    rows = transitions.withColumn("next", F.lead("sample").over(order)).join(lengths, "sensor_id")
    return rows.select("sensor_id", F.col("sample").alias("start"), F.coalesce("next", "n_samples").alias("end"), "label")


def rhythm_mask(samples: DataFrame, transitions: DataFrame, label: str) -> DataFrame:
    """``(sensor_id, sample, inside)``: whether a sample lies in an interval of the label."""
    return label_as_of(samples, transitions).select("sensor_id", "sample", F.coalesce(F.col("label") == label, F.lit(False)).alias("inside"))


def label_as_of(samples: DataFrame, transitions: DataFrame) -> DataFrame:
    """Each sample with the label of the last transition at or before it."""
    every = transitions.select("sensor_id", "sample", "label", F.lit(0).alias("is_sample")).unionByName(samples.select("sensor_id", "sample", F.lit(None).cast("string").alias("label"), F.lit(1).alias("is_sample")))
    order = Window.partitionBy("sensor_id").orderBy("sample", "is_sample", "label")
    return every.withColumn("label", F.last("label", ignorenulls=True).over(order)).where("is_sample = 1").drop("is_sample")
