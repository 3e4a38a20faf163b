"""Numpy kernels and the detection pass against known signals and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import detect, dsp, matching, rhythm, segments
from pulselake.operators.quality import band_power_ratio
from pulselake.sources.tables import parse_uploads, synthetic_ecg
from pulselake.streaming.detector import streaming_rr

FS = 360


def truth(seconds, rate):
    period = 60 / rate
    return np.array([k * period for k in range(1, int(seconds / period) + 1) if k * period < seconds - period / 2]) * FS


def pulse_train(seconds=30, rate=60, noise=0.02, seed=0):
    t = np.arange(seconds * FS) / FS
    x = np.random.default_rng(seed).normal(0, noise, len(t))
    for p in truth(seconds, rate) / FS:
        x += np.exp(-0.5 * ((t - p) / 0.012) ** 2)
    return x


@pytest.mark.parametrize("rate", [50, 60, 90, 120])
def test_detects_nearly_all_beats(rate):
    x, want = pulse_train(rate=rate), truth(30, rate)
    for find in detect.METHODS.values():
        got = find(dsp.preprocess(x, FS), FS)
        pairs = matching.greedy_pairs(np.sort(got).astype(float), want, 0.15 * FS)
        assert len(pairs) >= 0.95 * len(want) and len(pairs) >= 0.95 * len(got)


def test_polarity_does_not_matter():
    x = dsp.preprocess(pulse_train(), FS)
    assert abs(len(detect.detect(x, FS)) - len(detect.detect(-x, FS))) <= 1


def test_short_or_empty_stretch_has_no_beats():
    assert len(detect.detect(np.zeros(10), FS)) == 0 and len(detect.detect(np.zeros(0), FS)) == 0


def test_filters_pass_and_stop():
    t = np.arange(10 * FS) / FS
    slow, kept, mains = np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 60 * t)
    y = dsp.preprocess(slow + kept + mains, FS)
    assert len(y) == len(t)
    middle = slice(2 * FS, -2 * FS)
    assert np.abs(y - kept)[middle].max() < 0.15
    with pytest.raises(ValueError):
        dsp.bandpass(kept, FS, 20, 10)
    with pytest.raises(ValueError):
        dsp.preprocess(kept, FS, baseline="other")


def test_resampling_keeps_the_wave():
    t = np.arange(5 * FS) / FS
    y = dsp.resample(np.sin(2 * np.pi * 2 * t), FS, 250)
    assert len(y) == 1250 and np.abs(y - np.sin(2 * np.pi * 2 * np.arange(1250) / 250))[50:-50].max() < 0.02


def test_band_power():
    t = np.arange(10 * FS) / FS
    assert band_power_ratio(np.sin(2 * np.pi * 10 * t), FS) > 0.99
    assert band_power_ratio(np.sin(2 * np.pi * 100 * t), FS) < 0.05
    assert band_power_ratio(np.zeros(5), FS) == 0.0


def test_greedy_pairs_are_one_to_one_and_prefer_the_earlier():
    assert matching.greedy_pairs(np.array([10, 12]), np.array([11]), 5) == [(0, 0)]
    assert matching.greedy_pairs(np.array([10]), np.array([8, 12]), 5) == [(0, 0)]
    assert matching.greedy_pairs(np.array([]), np.array([1.0]), 5) == []


def test_blocks_do_not_change_matches(spark):
    rng = np.random.default_rng(1)
    det, ref = np.sort(rng.integers(0, 4000, 120)), np.sort(rng.integers(0, 4000, 120))
    want = {(int(det[i]), int(ref[j])) for i, j in matching.greedy_pairs(det, ref, 20)}
    frames = [spark.createDataFrame([(1, int(s)) for s in a], "sensor_id long, sample long") for a in (det, ref)]
    rows = matching.greedy_match(*frames, ["sensor_id"], 20).collect()
    assert {(r.det_sample, r.ref_sample) for r in rows if r.det_sample is not None and r.ref_sample is not None} == want
    assert sum(r.det_sample is not None for r in rows) == 120 and sum(r.ref_sample is not None for r in rows) == 120


def test_chunks_find_the_same_beats(spark):
    signal = synthetic_ecg(spark, seconds=60, sensors=1).withColumn("segment", F.lit(0))
    whole = {r.sample for r in detect.detect_beats(signal, FS).collect()}
    parts = {r.sample for r in detect.detect_beats(signal.repartition(5), FS, chunk_s=20.0, overlap_s=5.0).collect()}
    assert len(whole ^ parts) <= 2


def test_metronome_has_no_variability(spark):
    rows = spark.range(20).select(F.lit(1).alias("sensor_id"), F.col("id").alias("beat_idx"), (F.col("id") * FS).alias("sample"))
    r = rhythm.hrv(rhythm.rr_series(rows, FS)).first()
    assert (r.mean_hr, r.sdnn_ms, r.rmssd_ms) == (60.0, 0.0, 0.0)
    w = rhythm.af_windows(rows, FS, window_s=15.0).collect()
    assert all(x.score == 0.0 for x in w)


def test_gaps_and_flat_stretches(spark):
    x = np.sin(np.arange(600) / 3.0)
    x[100:160] = np.nan
    x[300:400] = 0.5
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "sensor_id long, i long, x double")
    got = sorted((r.start, r.end, r.usable, r.reason) for r in segments.segments(rows, 20).collect())
    assert [g[2:] for g in got] == [(True, None), (False, "nan"), (True, None), (False, "flatline"), (True, None)]
    assert got[1][:2] == (100, 160)


def test_slots_do_not_change_segments(spark):
    rng = np.random.default_rng(3)
    rows = []
    for sensor in range(4):
        x = rng.normal(size=900)
        for _ in range(6):
            a = int(rng.integers(0, 880))
            x[a : a + int(rng.integers(1, 70))] = rng.choice([np.nan, 0.25])
        x[850:] = np.nan
        rows += [(sensor, i, float(v)) for i, v in enumerate(x)]
    signal = spark.createDataFrame([*rows, *[(9, i, float("nan")) for i in range(40)], *[(10, i, 1.0) for i in range(40)]], "sensor_id long, i long, x double")
    whole, parts = (sorted(tuple(r) for r in segments.segments(signal, 20, slot_blocks=n).collect()) for n in (1200, 3))
    assert len(whole) > 20 and parts == whole
    steps = segments.sample_steps(signal, 10, 3)
    got = {(r.sensor_id, r.scale) for r in segments.median_steps(steps).collect()}
    want = {s: np.nanmedian(np.abs(np.diff([x for k, _, x in rows if k == s]))) for s in range(4)}
    assert got == {*want.items(), (9, None), (10, 0.0)}


def test_uploads_are_judged(spark):
    bodies = [
        '{"record_id":"a","channels":[{"sensor_id":"x","fs":360,"samples":[1,null,3],"t_start":"2026-01-01T12:00:00Z"}]}',
        '{"record_id":"b","channels":[]}',
        '{"record_id":"c","channels":[{"sensor_id":"x","fs":0,"samples":[1]}]}',
        '{"record_id":"d","channels":[{"sensor_id":"x","fs":1,"samples":[1]},{"sensor_id":"x","fs":1,"samples":[1]}]}',
    ]
    channels, samples = parse_uploads(spark.createDataFrame([(b,) for b in bodies], "body string"))
    got = {(r.record_id, r.problem) for r in channels.collect()}
    assert got == {("a", None), ("b", "no channels"), ("c", "bad sampling rate"), ("d", "sensor_id repeated")}
    assert [r.i for r in samples.where("isnan(x)").collect()] == [1]


def test_stream_equals_batch(spark, tmp_path):
    beats = [(s, i, 300 * i + 7 * s * (i % 3)) for s in (1, 2) for i in range(12)]
    frame = spark.createDataFrame(beats, "sensor_id long, beat_idx long, sample long")
    want = {(r.sensor_id, round(r.rr_s, 9)) for r in rhythm.rr_series(frame, FS).collect()}
    for part in range(3):
        frame.where((F.col("beat_idx") >= 4 * part) & (F.col("beat_idx") < 4 * part + 4)).select("sensor_id", "sample").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sensor_id long, sample long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming_rr(stream, FS).writeStream.format("memory").queryName("rr_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.sensor_id, round(r.rr_s, 9)) for r in spark.table("rr_out").collect()} == want
