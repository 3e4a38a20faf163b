"""Live detection and dropouts: any cut into packets gives the same result, also over micro-batches and a restart."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pulselake.operators import matching, segments
from pulselake.streaming.dropouts import SEGMENTS, Session, dropout_sessions
from pulselake.streaming.live import Live, live_beats

FS = 100


def signal(seconds, rate, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(seconds * FS) / FS
    beats = np.cumsum(60 / rate + rng.uniform(-0.08, 0.08, int(seconds * rate / 60)))
    beats = beats[beats < seconds - 1]
    x = rng.normal(0, 0.02, len(t)) + 0.1 * np.sin(t)
    for b in beats:
        x += np.exp(-0.5 * ((t - b) / 0.012) ** 2)
    return x, np.round(beats * FS)


def in_packets(x, sizes, origin=0):
    live, out, at = Live(FS), [], 0
    while at < len(x):
        n = int(sizes())
        live = Live.of(FS, live.state())
        out += live.push(origin + at, x[at : at + n])
        at += n
    return out, live


def test_packets_do_not_matter_and_beats_are_found():
    for seed, rate in ((1, 60), (2, 95), (3, 140)):
        x, truth = signal(120, rate, seed)
        whole = Live(FS).push(0, x)
        rng = np.random.default_rng(seed)
        assert in_packets(x, lambda: 1)[0] == whole and in_packets(x, lambda: rng.integers(1, 900))[0] == whole
        assert [p - 5000 for p in in_packets(x, lambda: 333, 5000)[0]] == whole
        truth = truth[truth < 114 * FS]
        found = np.array([p for p in whole if p < 114 * FS], float)
        pairs = matching.greedy_pairs(found, truth, 5)
        assert len(pairs) >= 0.97 * len(truth) and len(pairs) >= 0.97 * len(found)


def test_state_stays_small_over_a_long_pause():
    x, _ = signal(60, 70, 4)
    live = Live(FS)
    live.push(0, np.concatenate([x, np.zeros(600 * FS)]))
    assert len(live.integrated) <= 36 * FS and len(live.raw) <= 6 * FS and len(live.intervals) <= 8


def test_late_packets_holes_and_gaps():
    x, _ = signal(60, 70, 5)
    want = Live(FS).push(0, x)
    live = Live(FS)
    got = live.push(0, x[:2000]) + live.push(1000, x[1000:3000]) + live.push(500, x[500:900]) + live.push(3000, x[3000:])
    assert got == want
    live = Live(FS)
    got = live.push(0, x[:2000]) + live.push(2050, x[2050:])
    assert len(set(got) ^ set(want)) <= 4
    live = Live(FS)
    first, second = live.push(0, x[:2000]), live.push(9000, x)
    assert first == Live(FS).push(0, x[:2000]) and [p - 9000 for p in second] == want
    assert Live(FS).push(0, np.zeros(0)) == [] and Live(FS).push(0, np.full(3000, np.nan)) == []


def test_stream_with_a_restart_equals_one_pass(spark, tmp_path):
    signals = {s: signal(40, 60 + 20 * s, 10 + s)[0] for s in range(3)}
    want = {(s, p) for s, x in signals.items() for p in Live(FS).push(0, x)}
    rng = np.random.default_rng(0)
    packets = [(s, int(a), x[a : a + 130].tolist()) for s, x in signals.items() for a in range(0, len(x), 130)]
    packets.sort(key=lambda p: (p[1] // 700, rng.random()))  # in any order within a micro-batch
    schema, folder = "sensor_id long, start long, x array<double>", tmp_path / "in"
    parts = [[p for p in packets if p[1] // 700 == k] for k in range(max(p[1] for p in packets) // 700 + 1)]

    def write(some):
        for k in some:
            spark.createDataFrame(parts[k], schema).coalesce(1).write.parquet(f"file://{folder}/{k:03d}")

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"file://{folder}")
        query = live_beats(stream, FS).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").start()
        query.processAllAvailable()
        query.stop()

    write(range(3))
    go()
    write(range(3, len(parts)))
    go()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(r.sensor_id, r["sample"]) for r in got.collect()} == want and got.count() == len(want)
    assert got.groupBy("sensor_id").agg(F.count("*")).count() == 3


def damaged(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, n)
    x[300:520] = 0.4
    x[900:905] = 0.1
    x[1200:1260] = np.nan
    x[1262:1266] = np.nan
    x[1500:1800] = np.nan
    x[1650:1700] = 2.0
    x[n - 40 :] = x[n - 40]
    return x


def test_dropout_sessions_equal_segments(spark, tmp_path):
    fs, signals = 20, {s: damaged(2000 + 7 * s, s) for s in range(3)}
    frame = spark.createDataFrame([(s, i, float(v)) for s, x in signals.items() for i, v in enumerate(x)], "sensor_id long, i long, x double")
    want = sorted(tuple(r) for r in segments.segments(frame, fs).select("sensor_id", "start", "end", "usable", "reason").collect())
    scale = {r.sensor_id: r.scale for r in segments.median_steps(segments.sample_steps(frame, 10)).collect()}
    rng = np.random.default_rng(1)
    for s, x in signals.items():
        session, out, at = Session(fs), [], 0
        while at < len(x):
            n = int(rng.integers(1, 90))
            session = Session(fs).resume(session.state())
            out += session.push(at, x[at : at + n], scale[s])
            at += n
        assert [(s, *r) for r in out + session.close(scale[s])] == [w for w in want if w[0] == s]
    zero = dt.datetime(2026, 1, 1)
    packets = [(s, a, x[a : a + 60].tolist(), zero + dt.timedelta(seconds=a / fs), scale[s]) for s, x in signals.items() for a in range(0, len(x), 60)]
    late = (9, 0, [0.0] * 60, zero - dt.timedelta(hours=1), 1.0)  # far behind the watermark
    last = (8, 0, [0.0] * 60, zero + dt.timedelta(hours=1), 1.0)  # moves it, so that the others end
    schema, folder = "sensor_id long, start long, x array<double>, event_time timestamp, scale double", tmp_path / "in"
    parts = [[p for p in packets if p[1] // 700 == k] for k in range(3)] + [[late], [last], [last]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{folder}/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{folder}")
    query = dropout_sessions(stream, fs).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((tuple(r) for r in spark.read.schema(SEGMENTS).parquet(f"file://{tmp_path}/out").collect()), key=lambda r: r[:2])
    assert got == want
