"""Labelled sets over detected beats, analyses with a trained model, result trees, and windows of samples."""

from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulselake.functions import exprs
from pulselake.operators import blocks, detect, matching, models, morphology, protocol, scoring, summary
from pulselake.operators.kept import kept
from pulselake.plans.analyse import analyse_blocks, classified, features_of, labelled_beats
from pulselake.plans.oracles import ORACLES
from pulselake.sources import tables

FS = 100


def recording(seed, seconds=120):
    """Narrow beats a second apart, every eighth one early, wide and tall; where all and the wide ones are."""
    rng = np.random.default_rng(seed)
    t, x, beats, wide = np.arange(seconds * FS) / FS, rng.normal(0, 0.01, seconds * FS), [], []
    at = 1.0
    while at < seconds - 2:
        odd = len(beats) % 8 == 7
        at += -0.25 if odd else 0.25 if wide and wide[-1] == beats[-1] else 0
        width = 0.035 if odd else 0.012
        x += (1.6 if odd else 1.0) * np.exp(-0.5 * ((t - at) / width) ** 2)
        beats.append(round(at * FS))
        if odd:
            wide.append(beats[-1])
        at += 1.0
    return x, beats, wide


@pytest.fixture(scope="module")
def data(spark):
    parts = {s: recording(s) for s in range(8)}
    packed = spark.createDataFrame([(s, 0, x.tolist()) for s, (x, _, _) in parts.items()], "sensor_id long, block long, x array<double>")
    reference = spark.createDataFrame([(s, int(p), int(p in w)) for s, (_, b, w) in parts.items() for p in b], "sensor_id long, sample long, y int")
    return parts, packed, reference


def test_labelled_set_over_detected_and_over_reference_beats(spark, data):
    parts, packed, reference = data
    for detected in (True, False):
        rows, missed = labelled_beats(packed, reference, FS, detected)
        got = rows.collect()
        assert set(morphology.FEATURES) <= set(rows.columns)
        for s, (_, beats, wide) in parts.items():
            own = {r["sample"]: r.y for r in got if r.sensor_id == s}
            hits = {min(own, key=lambda p: abs(p - b)) for b in wide}
            assert len(own) >= 0.9 * len(beats) and sum(own.values()) >= 0.8 * len(wide) and {p for p, y in own.items() if y} <= hits
        n = {r.sensor_id: r.n_missed for r in missed.collect()}
        assert all(n[s] == 0 or detected and n[s] <= 0.2 * len(parts[s][2]) for s in parts)


def test_analysis_with_a_trained_model(spark, data):
    parts, packed, reference = data
    rows, _ = labelled_beats(packed.where("sensor_id < 6"), reference.where("sensor_id < 6"), FS)
    model = protocol.trained(rows, list(morphology.BINARY_FEATURES), "sensor_id")
    assert isinstance(model, models.BeatClassifier) and 0 < model.threshold < 1
    got = {r.sensor_id: r for r in analyse_blocks(packed.where("sensor_id >= 6"), FS, model).collect()}
    assert set(got) == {6, 7}
    for s, r in got.items():
        _, beats, wide = parts[s]
        assert abs(r.n_events - len(wide)) <= 0.2 * len(wide) and r.n_beats >= 0.9 * len(beats) and r.coverage == 1
        found = [min(abs(e["sample"] - w) for w in wide) for e in r.examples]
        assert len(found) >= 4 and sorted(found)[len(found) // 2] <= 5


def test_result_tree_nests_channels_in_order(spark):
    channels = spark.createDataFrame([(1, 7, 0, "chest", 10.0), (1, 5, 1, "wrist", 12.0), (2, 9, 0, None, 1.0)], "record_id long, sensor_id long, ordinal int, position string, duration_s double")
    results = spark.createDataFrame([(5, 70.0, ["a"]), (7, 60.0, None), (8, 1.0, None)], "sensor_id long, mean_hr double, notes array<string>")
    got = {r.record_id: r for r in summary.result_tree(results, channels).collect()}
    assert [c["sensor_id"] for c in got[1].channels] == [7, 5] and got[1].channels[1]["notes"] == ["a"] and got[1].duration_s == 12 and got[1].n_channels == 2
    assert got[2].channels[0]["mean_hr"] is None and got[2].channels[0]["position"] is None


def test_samples_in_a_clock_window_over_blocks(spark):
    n = 70_000
    signal = spark.range(n).select(F.lit(1).cast("long").alias("sensor_id"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    clocks = spark.createDataFrame([(3, 1, 10.0), (3, 2, 0.0)], "record_id long, sensor_id long, elapsed_s double")
    packed = blocks.pack(signal, FS)
    got = sorted((r.start, r.x[0], len(r.x)) for r in summary.samples_in_clock_window(packed, clocks, FS, 600.0, 620.0).collect())
    assert got == [(59_000, 59_000.0, 1000), (60_000, 60_000.0, 1001)]
    assert summary.samples_in_clock_window(packed, clocks, FS, 0.0, 9.9).count() == 0 and [len(r.x) for r in summary.samples_in_clock_window(packed, clocks, FS, 705.0, 800.0).collect()] == [500]


def test_score_lines(spark):
    rows = spark.createDataFrame([("a", 3, 1, 0, 4.25), ("b", 0, 0, 0, None)], "r string, tp long, fp long, fn long, mean_error_ms double")
    assert sorted(r.line for r in scoring.score_lines(rows, "r").collect()) == ["a: tp 3 fp 1 fn 0 se 100.00% ppv 75.00% f1 85.71% ms 4.2", "b: tp 0 fp 0 fn 0 se - ppv - f1 - ms -"]
    cells = scoring.confusion(spark.createDataFrame([(0, 0), (0, 2), (2, 2)], "y_true int, y_pred int"))
    assert sorted(r.line for r in scoring.confusion_lines(cells).collect()) == ["N          1       0       1       0       0", "V          0       0       1       0       0"]


def test_score_lines_meet_ties_as_their_sql_does(spark):
    """Four errors whose mean is 943.75 ms, and 23 of 160 beats found, which is 14.375 %."""
    errors, at = (407, 169, 334, 449), 1000
    rows = [("a", at * k, at * k + e) for k, e in enumerate(errors, 1)] + [("a", at * k, at * k) for k in range(5, 24)] + [("a", None, at * k) for k in range(24, 161)]
    found = spark.createDataFrame([r for r in rows if r[1] is not None or r[2] is not None], "r string, det_sample long, ref_sample long")
    assert "se 14.38% " in scoring.score_lines(matching.detection_scores(found, ["r"], 360), "r").first().line
    assert scoring.score_lines(matching.detection_scores(found.where("det_sample <> ref_sample").coalesce(1), ["r"], 360), "r").first().line.endswith(" ms 943.8")


def test_widths_of_a_batch_are_those_of_the_expression(spark):
    """Odd windows too: none, short ones, level ones, with nulls and NaN."""
    odd = [None, [], [1.0] * 64, [float("nan")] * 64, [0.0, None, 1.0, float("nan")] * 16, [float(k % 5) for k in range(20)]]
    rows = [(0, k, w) for k, w in enumerate([*odd[:1], *odd[2:]] + [list(map(float, np.sin(np.arange(64) * (0.1 + 0.01 * k)) * (np.arange(64) % (k + 2) > 0))) for k in range(40)])]
    both = morphology.with_width(spark.createDataFrame(rows, "group int, beat_id int, w array<double>"), 96, 31, 12, 2).withColumn("v", morphology.width_of(96, 31, 12, 2)("w"))
    assert both.count() == len(rows) and both.where("not (v <=> width_s)").count() == 0 and both.where("v > 0").count() > 10


def test_mean_error_is_exact_in_every_order_of_rows(spark):
    """Errors of sensors of the tables, whose means are 756.25, 818.75 and 881.25 ms; sums of rounded quotients fall beside these ties."""
    orders = [(e, "756.2") for e in permutations((100, 435, 197, 357))] + [(e, "818.8") for e in permutations((503, 276, 221, 179))] + [((122, 166, 352, 268, 374, 471, 535, 250), "881.2")]
    rows = [(k, i * 1000, i * 1000 + e) for k, (errors, _) in enumerate(orders) for i, e in enumerate(errors)]
    for n in (1, 7):
        found = spark.createDataFrame(rows, "r int, det_sample long, ref_sample long").coalesce(1).repartition(n)
        got = dict(scoring.score_lines(matching.detection_scores(found, ["r"], 360), "r").collect())
        assert [got[k].split(" ms ")[1] for k in range(len(orders))] == [ms for _, ms in orders]
    alone = matching.detection_scores(spark.createDataFrame([("a", 5, None), ("a", None, 7)], "r string, det_sample long, ref_sample long"), ["r"], 360.0).first()
    assert (alone.tp, alone.fp, alone.fn, alone.mean_error_ms) == (0, 1, 1, None)


def test_percentages_of_long_recordings_round_as_in_their_sql(spark):
    """An hour or more of beats: percentages of 4 000 and its multiples lie on decimal ties that no double meets (0.575, 1.225)."""
    counts = [(k * 10_000 + tp, tp, k * 4000 - tp, k * 4000 - tp, tp * 0.05) for k in (1, 2) for tp in range(0, k * 4000 + 1, k)]
    got = dict(scoring.score_lines(spark.createDataFrame(counts, "sensor_id long, tp long, fp long, fn long, mean_error_ms double"), "sensor_id").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE sc AS SELECT k * 10000 + tp AS sensor_id, tp, k * 4000 - tp AS fp, k * 4000 - tp AS fn, tp * 0.05::DOUBLE AS mean_error_ms FROM range(1, 3) a(k), range(0, 8001) b(tp) WHERE tp % k = 0 AND tp <= k * 4000")
    want = dict(con.execute("WITH p AS (" + ORACLES["score_table"].rsplit(" p AS (", 1)[1]).fetchall())
    assert len(want) == 8002 and {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    near = [float(v) for n in range(400) for t in ((10 * n + 5) / 100, (10 * n + 5) / 1000) for v in (np.nextafter(t, 0), t, np.nextafter(t, 9e9))]
    rounded = spark.createDataFrame([(v,) for v in near], "x double").select("x", exprs.round_even(F.col("x"), 1), exprs.round_even(F.col("x"), 2)).collect()
    con.execute("CREATE TABLE near AS SELECT unnest(?) AS x", [near])
    assert sorted(map(tuple, rounded)) == sorted(con.execute("SELECT x, round_even(x, 1), round_even(x, 2) FROM near").fetchall())


def test_features_stay_in_the_task_that_makes_the_windows(spark):
    """Every digit is that of windows that are rows, over blocks, gaps, beats at the ends, odd sensors, and sensors too long for one task; no window is shuffled."""
    rng, rows, places = np.random.default_rng(5), [], []
    for s, n in ((1, 150_000), (2, 70_000), (3, 60_000), (4, 900), (5, 400)):
        x = rng.normal(0, 0.05, n) + np.sin(np.arange(n) / 9)
        own = np.unique(np.concatenate([np.cumsum(rng.integers(25, 160, n // 90)), [10, n - 36, n - 35, n - 1]]))
        own = own[own < n]
        if s == 2:
            x[30_000:30_500] = np.nan
            x[60_001] = np.nan
        x[own] += 1.5 if s != 3 else np.nan
        x = np.zeros(n) if s == 4 else x
        rows += [(s, k, x[k * 60_000 : (k + 1) * 60_000].tolist()) for k in range(-(-n // 60_000))]
        places += [(s, k, int(p), k % 2) for k, p in enumerate(own if s != 5 else own[:1])]
    packed = blocks.source_of(spark.createDataFrame(rows, "sensor_id int, block long, x array<double>"), FS)
    beats = spark.createDataFrame(places, "sensor_id int, beat_idx long, sample long, y int")
    columns = ["sensor_id", "beat_idx", "sample", "y", *morphology.FEATURES]
    got = [features_of(packed, beats, FS, *longest) for longest in ((), (0,), (100_000,))]
    assert all(sorted(d.dtypes) == sorted(got[0].dtypes) for d in got)
    held, by_row, both = (sorted(map(repr, d.select(*columns).collect())) for d in got)
    assert len(held) > 2500 and any("nan" in r for r in held) and held == by_row == both

    shuffled = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(), spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite())[1]
    source = tables.ecg_source(spark, "/root/testdata/sf0.001")
    stretches = detect.whole(source, FS)
    known = tables.beats_at(spark, "/root/testdata/sf0.001", FS).select("sensor_id", "sample").distinct()
    numbered = kept(known.withColumn("beat_idx", F.row_number().over(Window.partitionBy("sensor_id").orderBy("sample")).cast("long") - 1))
    before = shuffled()
    n = len(features_of(detect.filter_blocks(source, stretches, FS), numbered, FS).collect())
    assert n > 900 and shuffled() - before < 250 * n  # a window is 536 bytes


def test_a_model_reads_features_of_the_tables_without_shuffling_windows(spark):
    shuffled = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(), spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite())[1]
    source = tables.ecg_source(spark, "/root/testdata/sf0.001")
    stretches = detect.whole(source, FS)
    known = tables.beats_at(spark, "/root/testdata/sf0.001", FS).select("sensor_id", "sample").distinct()
    numbered = kept(known.withColumn("beat_idx", F.row_number().over(Window.partitionBy("sensor_id").orderBy("sample")).cast("long") - 1))
    model = models.BeatClassifier(list(morphology.BINARY_FEATURES))
    model.classes, model.mean, model.deviation, model.lines, model.threshold = [0, 1], np.zeros(4), np.ones(4), np.array([[0.0, 0.0, 1.0, 0.0, -1.0]]), 0.5
    before = shuffled()
    found = classified(detect.filter_blocks(source, stretches, FS), numbered, FS, model).collect()
    assert 100 < len(found) < 900 and shuffled() - before < 350 * numbered.count()
    beats = {(r.sensor_id, r.beat_idx, r["sample"]) for r in numbered.collect()}
    assert len({tuple(r) for r in found} & beats) == len(found)
