"""Record sets, labels through a match, halves, protocols; examples, slices, masks, resampling and the analysis on known input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import detect, dsp, matching, protocol, quality, segments, summary
from pulselake.plans.analyse import analyse
from pulselake.sources.tables import synthetic_ecg

from .test_models import clusters

FS = 360


def test_sets_do_not_overlap(spark):
    assert (len(protocol.TRAIN), len(protocol.TEST), len(protocol.PACED)) == (22, 22, 4)
    assert len({*protocol.TRAIN, *protocol.TEST, *protocol.PACED}) == 48
    rows = spark.createDataFrame([("101",), ("100",), ("102",), ("999",)], "r string").select(protocol.record_set(F.col("r")).alias("s")).collect()
    assert [r.s for r in rows] == ["train", "test", "paced", None]


def test_labels_go_through_the_match(spark):
    det = spark.createDataFrame([(1, 100), (1, 500), (1, 900)], "sensor_id long, sample long")
    ref = spark.createDataFrame([(1, 105, 1), (1, 505, 0), (1, 2000, 1)], "sensor_id long, sample long, y int")
    got = protocol.transfer_labels(matching.greedy_match(det, ref.drop("y"), ["sensor_id"], 50), ref, ["sensor_id"])
    assert sorted((r["sample"], r.y) for r in got.collect()) == [(100, 1), (500, 0), (900, 0)]
    assert [(r.sensor_id, r.n_missed) for r in protocol.missed(got, ref, ["sensor_id"]).collect()] == [(1, 1)]


def test_halves_are_exact_and_seeded(spark):
    rows = spark.range(1001).select((F.col("id") % 2).alias("s"), F.col("id").alias("b"))
    once, again, other = (protocol.halves(rows, "s", "b", seed).where("first_half").select("b") for seed in (0, 0, 1))
    assert once.count() == 500 and once.exceptAll(again).count() == 0 and once.exceptAll(other).count() > 0


def test_protocols_share_their_test_beats_and_refuse_too_few(spark):
    rows = clusters(spark, [(0, 0), (4, 0.5)]).where("y is not null").withColumn("beat", F.monotonically_increasing_id())
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    parts = rows.where("subject % 2 = 0"), rows.where("subject % 2 = 1")
    got = {r.protocol: r for r in protocol.compare_protocols(*parts, ["a", "b"], "subject", "beat", threshold=0.5).collect()}
    assert set(got) == {"inter", "intra"} and min(r.f1 for r in got.values()) > 0.95
    assert len({r.tp + r.fp + r.fn + r.tn for r in got.values()}) == 1
    with pytest.raises(ValueError):
        protocol.trained(rows, ["a", "b"], "subject", least_subjects=6, without=0, threshold=0.5)


def test_examples_by_bin(spark):
    signal = spark.range(100).select(F.lit(1).alias("sensor_id"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    events = spark.createDataFrame([(1, s) for s in (1, 20, 21, 22, 23, 40, 97)], "sensor_id long, sample long")
    got = sorted((r.bin, r.t, r.y) for r in summary.examples_by_bin(signal, events, 10, 2.0).collect())
    assert [g[:2] for g in got] == [(1, 2.0), (1, 2.1), (1, 2.3), (2, 4.0)]
    assert got[0][2] == [float(v) for v in range(16, 24)]


def test_slices_move_the_start_and_empty_ones_fail(spark):
    signal = spark.range(100).select(F.lit(1).alias("sensor_id"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    channels = spark.createDataFrame([(1, 10.0, 100, 5_000_000)], "sensor_id long, fs double, n_samples long, start_us long")
    rows, moved = segments.slice_seconds(signal, channels, 2.0, 99.0)
    assert rows.agg(F.min("i"), F.max("i"), F.min("x")).first() == (0, 79, 20.0)
    assert moved.first().asDict() == {"sensor_id": 1, "fs": 10.0, "n_samples": 80, "start_us": 7_000_000}
    with pytest.raises(Exception, match="empty"):
        segments.slice_seconds(signal, channels, 20.0, 30.0)[1].collect()


def test_rhythm_notes(spark):
    notes = spark.createDataFrame([(1, 5, "(AFIB\0"), (1, 50, " (N "), (1, 60, "MISSB"), (1, 70, ""), (1, 80, None)], "sensor_id long, sample long, aux string")
    got = matching.rhythm_transitions(notes)
    assert sorted((r["sample"], r.label) for r in got.collect()) == [(5, "(AFIB"), (50, "(N")]
    ends = matching.rhythm_intervals(got, spark.createDataFrame([(1, 90)], "sensor_id long, n_samples long"))
    assert sorted((r.start, r.end) for r in ends.collect()) == [(5, 50), (50, 90)]
    inside = matching.rhythm_mask(spark.createDataFrame([(1, s) for s in (0, 5, 49, 50)], "sensor_id long, sample long"), got, "(AFIB")
    assert sorted((r["sample"], r.inside) for r in inside.collect()) == [(0, False), (5, True), (49, True), (50, False)]


def test_missing_beats_are_found_and_short_gaps_left():
    y = np.zeros(4000)
    for p in (300, 660, 1020, 1380, 1740, 2100, 2460):
        y[p - 20 : p + 21] = np.maximum(y[p - 20 : p + 21], 1 - np.abs(np.arange(-20, 21)) / 21)
    have = np.array([300, 660, 1020, 2100, 2460])
    assert detect.missing_beats(have, y, FS).tolist() == [1380, 1740]
    assert len(detect.missing_beats(have[:3], y, FS)) == 0 and len(detect.missing_beats(have[:2], y, FS)) == 0


def test_refined_peaks_keep_their_distance():
    x = np.zeros(1000)
    x[[100, 150, 400]] = 1.0, -3.0, 2.0
    assert detect.refine(np.array([95, 160, 410]), x, FS).tolist() == [150, 400]
    assert len(detect.refine(np.zeros(0, np.int64), x, FS)) == 0


def test_chunks_resample_and_filter_as_one_stretch(spark):
    signal = synthetic_ecg(spark, seconds=60, sensors=1)
    x = np.array([r.x for r in signal.orderBy("i").collect()])
    parts = detect.resample_signal(signal, FS, 250, chunk_s=20.0).orderBy("i").collect()
    assert [r.i for r in parts] == list(range(15000))
    assert np.abs(np.array([r.x for r in parts]) - dsp.resample(x, FS, 250)).max() < 1e-12
    clean = detect.filter_signal(signal, FS, chunk_s=40.0).orderBy("i").collect()
    assert [r.i for r in clean] == list(range(len(x)))
    assert np.abs(np.array([r.x for r in clean]) - dsp.preprocess(x, FS))[FS:-FS].max() < 5e-3  # a beat is 1; the slow part depends on a stretch's own ends


def test_mask_leaves_uncovered_samples(spark):
    signal = spark.range(10).select(F.lit(1).alias("sensor_id"), F.col("id").alias("i"), F.lit(0.0).alias("x"))
    windows = spark.createDataFrame([(1, 0, True)], "sensor_id long, w long, is_artifact boolean")
    assert [r.masked for r in quality.artefact_mask(signal, windows, 1, 4).orderBy("i").collect()] == [True] * 4 + [False] * 6


def test_analysis_has_a_row_a_sensor(spark):
    got = {r.sensor_id: r for r in analyse(synthetic_ecg(spark, seconds=40, sensors=2), FS).collect()}
    assert set(got) == {0, 1}
    for sensor, r in got.items():
        assert abs(r.mean_hr - (60 + 5 * sensor)) < 1 and r.coverage == 1 and r.n_events == 0 and r.burden_pct == 0 and r.busiest_bin is None and r.examples is None
