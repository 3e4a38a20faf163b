"""Samples moved to the largest one near them, against brute force on odd rows."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulselake.functions import exprs
from pulselake.operators import peaks
from pulselake.plans.queries import refine_extremum
from pulselake.sources import tables


def moved(heights, reach):
    """Of ``{(sensor, sample): height}``."""
    near = lambda s, p: [(-heights[s, i], i) for i in range(p - reach, p + reach + 1) if (s, i) in heights]
    return sorted((s, min(near(s, p))[1]) for s, p in heights)


@pytest.mark.parametrize("slot", [1, 8, 1 << 10])
@pytest.mark.parametrize("reach", [0, 1, 3])
def test_largest_near(spark, reach, slot):
    rng = random.Random(reach)
    heights = {(s, i): float(rng.randrange(4)) for s in range(3) for i in range(2100 if s == 0 else 40) if rng.random() < 0.8}
    heights |= {(3, i): 1.0 for i in range(30)} | {(4, i): float(i) for i in range(30)} | {(5, i): float(-i) for i in range(30)} | {(6, 9): 0.0}
    rows = spark.createDataFrame([(*k, h) for k, h in heights.items()], "sensor_id long, sample long, height double")
    want = sorted(set(moved(heights, reach)))
    for given in (rows, rows.union(rows.where("sensor_id % 2 = 0"))):
        assert sorted(map(tuple, peaks.largest_near(given, reach, slot).collect())) == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Events of a long sensor and short ones; null, NaN and infinite values, null users, null times and kinds, rows that come twice."""
    rng = random.Random(7)
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(900_000)), 8 if k % 2 else rng.randrange(30), "view", rng.randrange(-6, 7) / 2) for k in range(5000)]
    rows = [(*r[:4], rng.choice([None, float("nan"), float("inf"), float("-inf"), -0.0])) if r[0] % 11 == 0 else r for r in rows]
    rows = [(k, None if k % 17 == 0 else t, None if k % 19 == 0 else u, None if k % 23 == 0 else kind, v) for k, t, u, kind, v in rows]
    rows += [(9001, datetime(2024, 1, 2), 100, "view", None), (9002, datetime(2024, 1, 2), 101, "view", 2.0), *rows[::13]]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    return at


def test_refine_extremum_on_odd_rows(spark, odd):
    rows = tables.signal(spark, odd).where(exprs.finite(F.col("x"))).collect()
    heights = {(r.sensor_id, r.i): abs(r.x) for r in rows if r.sensor_id is not None}
    assert len(heights) < len(rows) and max(i for _, i in heights) > 2048 and not {s for s, _ in heights} & {100}
    got = refine_extremum(spark, odd)
    assert got.dtypes == [("sensor_id", "bigint"), ("sample", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(set(moved(heights, 3)))


def test_refine_extremum_shuffles_a_sample_once_and_cuts_long_sensors(spark, odd):
    plan = refine_extremum(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)] == [["sensor_id", "slot"], ["sensor_id"]]


def test_refine_extremum_without_rows(spark, odd, tmp_path):
    spark.read.parquet(f"{odd}/events.parquet").where("user_id is null").write.parquet(f"{tmp_path}/events.parquet")
    assert refine_extremum(spark, str(tmp_path)).collect() == []
