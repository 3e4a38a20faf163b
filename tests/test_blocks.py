"""Packed blocks against the same work on a row a sample and on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import blocks, detect, dsp, matching, morphology, quality, rhythm, segments
from pulselake.sources.tables import ecg, ecg_blocks, ecg_source, synthetic_ecg

FS = 50


def noisy(spark, seconds=1500):
    """Three sensors: beats with a flat stretch and a gap, one of zeros, one shorter than a block."""
    n = seconds * FS
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.05, n)
    for p in range(40, n - 40, 43):
        x[p - 2 : p + 3] += [0.3, 0.8, 1.0, 0.8, 0.3]
    x[29_000:31_500] = 0.2
    x[60_010:60_400] = np.nan
    x[60_500:60_520] = np.nan
    parts = {1: x, 2: np.zeros(700), 3: x[:900]}
    frame = spark.createDataFrame([(s, v.tolist()) for s, v in parts.items()], "sensor_id long, x array<double>")
    return parts, frame.select("sensor_id", F.posexplode("x").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def test_packing_and_unpacking(spark):
    parts, signal = noisy(spark)
    packed = blocks.pack(signal, FS)
    assert {(r.sensor_id, r.block, len(r.x)) for r in packed.collect()} == {(1, 0, 30_000), (1, 1, 30_000), (1, 2, 15_000), (2, 0, 700), (3, 0, 900)}
    rows = blocks.unpack(packed, FS).where("sensor_id = 1").orderBy("i").collect()
    assert [r.i for r in rows] == list(range(75_000)) and np.array_equal([r.x for r in rows], parts[1], equal_nan=True)
    again = blocks.repack(packed.select("sensor_id", (F.col("block") * blocks.size_of(FS) + 7).alias("start"), F.slice("x", 8, 1 << 20).alias("x")), FS)
    got = {(r.sensor_id, r.block): r.x for r in again.collect()}
    assert np.isnan(got[1, 1][:7]).all() and len(got[1, 2]) == 15_000 and got[3, 0][7:] == parts[3][7:].tolist()


def test_segments_equal_those_of_rows(spark):
    _, signal = noisy(spark)
    want = sorted(tuple(r) for r in segments.segments(signal, FS).select("sensor_id", "start", "end", "usable", "reason").collect())
    for windows in (1200, 7):
        got = segments.segments_of(blocks.pack(signal, FS, windows), FS, windows=windows).select("sensor_id", "start", "end", "usable", "reason")
        assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) >= 6


def whole_chunks(x, stretches, fs, chunk_s, overlap_s, kernel):
    chunk, overlap = round(chunk_s * fs), round(overlap_s * fs)
    out = []
    for start, end in stretches:
        c = 0
        while True:
            at = start + c * (chunk - overlap)
            stop = min(at + chunk, end)
            low, high = at if c == 0 else at + overlap // 2, end if stop == end else stop - (overlap - overlap // 2)
            part = np.where(np.isfinite(x[at:stop]), x[at:stop], np.nanmedian(x[at:stop]))
            found = at + kernel(part)
            out += found[(found >= low) & (found < high)].tolist()
            if stop == end:
                break
            c += 1
    kept = []
    for p in sorted(set(out)):
        if not kept or p - kept[-1] >= round(0.2 * fs):
            kept.append(p)
    return kept


@pytest.mark.parametrize(("chunk_s", "overlap_s"), [(300.0, 5.0), (40.0, 4.0)])
def test_detection_equals_one_array(spark, chunk_s, overlap_s):
    parts, signal = noisy(spark)
    packed = blocks.pack(signal, FS)
    kernel = lambda x: detect.detect(dsp.preprocess(x, FS), FS)
    for stretches in (detect.whole(packed, FS), detect.usable(packed, FS)):
        spans = {s: [] for s in parts}
        for r in stretches.collect():
            spans[r.sensor_id].append((r.start, r.end))
        got = {s: [] for s in parts}
        for r in detect.detect_in_blocks(packed, stretches, FS, chunk_s=chunk_s, overlap_s=overlap_s).collect():
            got[r.sensor_id].append(r["sample"])
        assert len(got[1]) > 1500
        for s in parts:
            assert sorted(got[s]) == whole_chunks(parts[s], sorted(spans[s]), FS, chunk_s, overlap_s, kernel)


def test_a_chunk_longer_than_a_block_is_an_error(spark):
    _, signal = noisy(spark)
    packed = blocks.pack(signal, FS)
    with pytest.raises(ValueError, match="fit"):
        detect.detect_in_blocks(packed, detect.whole(packed, FS), FS, chunk_s=700.0)


def test_windows_of_blocks_equal_those_of_rows(spark):
    parts, signal = noisy(spark)
    n = len(parts[1])
    beats = spark.createDataFrame([(1, s) for s in (0, 9, 10, 11, 29_995, 30_000, 30_004, n - 16, n - 15, n - 14, n - 1)] + [(3, 450), (3, 885)], "sensor_id long, sample long")
    want = sorted((r.sensor_id, r["sample"], r.w) for r in morphology.extract_beats(signal, beats, 10, 15).collect())
    got = sorted((r.sensor_id, r["sample"], r.w) for r in morphology.windows_in_blocks(blocks.pack(signal, FS), beats, FS, 10, 15).collect())
    assert got == want
    assert [w[:2] for w in want] == [(1, s) for s in (10, 11, 29_995, 30_000, 30_004, n - 16)] + [(3, 450)]


def test_blocks_of_the_tables_hold_the_same_samples(spark):
    sf = "/root/testdata/sf0.001"
    rows = blocks.unpack(ecg_blocks(spark, sf), 100).withColumnRenamed("x", "y").join(ecg(spark, sf), ["sensor_id", "i"], "full")
    assert rows.where("x is null or y is null or abs(x - y) > 1e-9").count() == 0 and rows.count() > 100_000


def test_no_sample_is_a_row_in_a_shuffle(spark):
    packed = ecg_blocks(spark, "/root/testdata/sf0.001")
    plan = detect.detect_in_blocks(packed, detect.whole(packed, 100), 100)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "posexplode" not in plan


def test_beats_over_a_seam_are_found_once(spark):
    signal = synthetic_ecg(spark, seconds=1300, fs=FS, sensors=1)
    found = sorted(r["sample"] for r in detect.process_long(signal, FS).collect())
    truth = np.arange(1, 1300) * FS
    assert len(matching.greedy_pairs(np.array(found, float), truth.astype(float), 3)) >= 0.99 * len(truth) and len(found) <= 1.01 * len(truth)


def test_suppression_equals_the_sequential_rule():
    rng = np.random.default_rng(8)
    for case in range(60):
        at = np.sort(rng.choice(400, rng.integers(0, 120), replace=False)).astype(np.int64)
        height = rng.integers(0, 6 if case % 2 else 1000, len(at)).astype(float)
        if case % 5 == 0:
            height = np.arange(len(at), dtype=float)  # a rising chain: every round settles one
        distance = int(rng.integers(1, 25))
        kept = []
        for k in sorted(range(len(at)), key=lambda k: (-height[k], at[k])):
            if all(abs(at[k] - at[j]) >= distance for j in kept):
                kept.append(k)
        assert detect.apart(at, height, distance).tolist() == at[sorted(kept)].tolist()


@pytest.mark.parametrize("slot", [1 << 18, 64, 20])
def test_deduplication_of_an_unbroken_chain(spark, slot):
    rng = np.random.default_rng(5)
    chain = np.cumsum(rng.integers(1, 15, 3000))
    peaks = {1: chain.tolist(), 2: [5], 3: [0, 0, 19, 20, 39, 1000, 1010, 1020, 1021], 4: (np.cumsum(rng.integers(1, 60, 500)) + 10_000).tolist()}
    frame = spark.createDataFrame([(s, int(p)) for s, v in peaks.items() for p in v], "sensor_id long, sample long")
    got = {s: [] for s in peaks}
    for r in rhythm.dedupe_peaks(frame, 20, slot).collect():
        got[r.sensor_id].append(r["sample"])
    for s, v in peaks.items():
        want = []
        for p in sorted(v):
            if not want or p - want[-1] >= 20:
                want.append(p)
        assert sorted(got[s]) == want
    assert rhythm.dedupe_peaks(frame.where("false"), 20).count() == 0


def test_running_median_equals_sorted_windows():
    rng = np.random.default_rng(6)
    for n, size in ((0, 3), (1, 5), (4, 9), (200, 21), (500, 73)):
        x = rng.integers(-5, 5, n) + rng.normal(size=n) * (size % 2 == 1 and n > 300)
        wide = np.concatenate([np.zeros(size // 2), x, np.zeros(size // 2)])
        assert dsp.running_median(x, size).tolist() == [sorted(wide[i : i + size])[size // 2] for i in range(n)]


def test_window_quality_of_blocks_equals_that_of_rows(spark):
    _, signal = noisy(spark, 1300)
    packed = blocks.pack(signal, FS)
    near = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) <= 1e-6 * max(1, abs(a)))
    for window_s in (10.0, 7.0):
        pairs = (
            (quality.artefact_windows(signal, FS, window_s), quality.artefacts_in_blocks(packed, FS, window_s), ("kurtosis", "instability", "score", "is_artifact")),
            (quality.quality_windows(signal, FS, window_s), quality.quality_in_blocks(packed, FS, window_s), ("n", "amplitude", "flat", "saturated", "power", "sqi", "is_usable")),
        )
        for rows, arrays, columns in pairs:
            want, got = ({(r.sensor_id, r.w): [r[c] for c in columns] for r in d.collect()} for d in (rows, arrays))
            assert set(want) == set(got) and len(want) > 120
            assert [k for k in want if not all(map(near, map(float, want[k]), map(float, got[k])))] == []


def events_at(spark, path, seconds):
    """A folder with ``events`` of one user, at these seconds of its recording."""
    rows = spark.createDataFrame([(k, 7, s) for k, s in enumerate(seconds)], "event_id long, user_id long, s double")
    ts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s * 30000)")
    rows.select("event_id", "user_id", ts.alias("ts")).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_blocks_made_where_they_are_read_give_what_stored_ones_give(spark, tmp_path):
    """Three blocks: seams within and between them, beats on both sides of an edge, a silent stretch."""
    fs, sf = 50, events_at(spark, tmp_path, [s + 0.03 * (s % 7) for s in range(1, 1500) if not 900 < s < 960] + [599.99])
    source, stored = ecg_source(spark, sf, fs), ecg_blocks(spark, sf, fs)
    assert isinstance(source, blocks.Source) and stored.count() == 3
    assert sorted(map(tuple, segments.segments_of(source, fs).collect())) == sorted(map(tuple, segments.segments_of(stored, fs).collect()))
    spans = spark.createDataFrame([(7, 0, 640 * fs), (7, 650 * fs, 1490 * fs)], "sensor_id long, start long, end long")
    found = [sorted(map(tuple, detect.detect_in_blocks(b, spans, fs).collect())) for b in (source, stored)]
    assert found[0] == found[1] and len(found[0]) > 1000
    clean = detect.filter_blocks(source, spans, fs), detect.filter_blocks(stored, spans, fs)
    x = [{r.block: np.array(r.x) for r in blocks.packed_of(c, fs).collect()} for c in clean]
    assert sorted(x[0]) == sorted(x[1]) == [0, 1, 2] and all(np.array_equal(x[0][k], x[1][k], equal_nan=True) for k in x[0])
    beats = spark.createDataFrame([(7, s * fs) for s in (1, 599, 600, 601, 1200, 1489)], "sensor_id long, sample long")
    cut = [sorted((r["sample"], tuple(r.w)) for r in morphology.windows_in_blocks(c, beats, fs, 10, 15).collect()) for c in clean]
    assert cut[0] == cut[1] and len(cut[0]) == 6
    again = [sorted((r.block, tuple(r.x)) for r in d.collect()) for d in (detect.resampled_block_by_block(source, fs, 120), detect.resample_blocks(stored, fs, 120))]
    assert again[0] == again[1]


def test_arrays_of_samples_are_neither_broadcast_nor_written(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored = blocks.pack(synthetic_ecg(spark, seconds=30, fs=FS, sensors=2), FS)
    assert "Broadcast" not in plan(blocks.with_next(stored, 10)) + plan(segments.segments_of(stored, FS).where("usable"))
    source = ecg_source(spark, "/root/testdata/sf0.001")
    text = plan(blocks.packed_of(source, 100))
    assert text.index("MapInArrow") < text.index("Exchange")  # every shuffle is below, of what the samples are made from
