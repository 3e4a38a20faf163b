"""Usable and unusable stretches of a signal ``(sensor_id, i, x)``: gaps and islands.

Samples are ordered within slots of ten minutes, so a long recording is many tasks; the last sample of a slot is copied to the
next one for the step between them. Only runs, a few a slot, are ordered over whole sensors. ``i`` counts without holes.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite
from .blocks import Blocks, read, source_of
from .kept import kept

#: Blocks of the flatness rule in a slot: ten minutes of blocks of half a second.
SLOT_BLOCKS = 1200


def sample_steps(signal: DataFrame, n_win: int, slot_blocks: int = SLOT_BLOCKS) -> DataFrame:
    """``signal`` with its ``slot``, ``ok`` (finite) and ``step``, the distance from the sample before; null beside a gap."""
    size = slot_blocks * n_win
    home = F.floor(F.col("i") / size)
    rows = signal.withColumn("slot", F.explode(F.when(F.col("i") % size == size - 1, F.array(home, home + 1)).otherwise(F.array(home))))
    ok = finite(F.col("x"))
    before = F.lag("x").over(Window.partitionBy("sensor_id", "slot").orderBy("i"))
    step = F.when(F.col("i") == 0, F.when(ok, 0.0)).when(ok & finite(before), F.abs(F.col("x") - before))
    return rows.withColumn("ok", ok).withColumn("step", step).where(home == F.col("slot"))


def median_steps(rows: DataFrame) -> DataFrame:
    """``(sensor_id, slot, scale)``: each sensor's exact median step, for every slot up to its last. Steps are counted by
    32nds of an octave, and only those of the one or two bins that hold the middle are ordered."""
    step = F.when(F.col("i") > 0, F.col("step"))
    steps = rows.select("sensor_id", step.alias("step")).withColumn("bin", F.when(F.col("step") > 0, F.floor(32 * F.log2("step"))).when(F.col("step") == 0, -(1 << 20)))
    bins = steps.where(F.col("step").isNotNull()).groupBy("sensor_id", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("sensor_id")
    total = F.sum("n").over(whole)
    bins = bins.withColumn("low", F.floor((total - 1) / 2)).withColumn("high", F.floor(total / 2)).withColumn("before", F.sum("n").over(whole.orderBy("bin")) - F.col("n"))
    middle = bins.where((F.col("before") <= F.col("high")) & (F.col("before") + F.col("n") > F.col("low"))).drop("n")
    values = steps.join(middle, ["sensor_id", "bin"]).groupBy("sensor_id", "bin", "before", "low", "high", "step").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("sensor_id", "bin").orderBy("step")) + F.col("before")
    at = lambda rank: F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), F.col("step")))
    scale = values.withColumn("upto", upto).groupBy("sensor_id").agg(((at("low") + at("high")) / 2).alias("scale"))
    ends = rows.groupBy("sensor_id").agg(F.max("slot").alias("top"))
    return ends.join(scale, "sensor_id", "left").select("sensor_id", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("slot"), "scale")


def bad_samples(signal: DataFrame, fs: float, window_s: float = 0.5, quiet_share: float = 0.02, least_share: float = 0.9, slot_blocks: int = SLOT_BLOCKS) -> DataFrame:
    """``signal`` with ``ok`` (finite) and ``bad`` (not finite, or in a flat block). A block is flat if more than 90 % of
    it is quiet: its steps are below 2 % of the sensor's median step. Without any step everything is flat."""
    n_win = max(1, round(window_s * fs))
    rows = sample_steps(signal, n_win, slot_blocks)
    rows = rows.join(median_steps(rows), ["sensor_id", "slot"], "left").withColumn("block", F.floor(F.col("i") / n_win))
    quiet = ~F.col("ok") | F.coalesce(F.col("step") < quiet_share * F.col("scale"), ~F.col("ok"))
    flat = F.avg(quiet.cast("double")).over(Window.partitionBy("sensor_id", "slot", "block")) > least_share
    return rows.withColumn("bad", ~F.col("ok") | flat | F.coalesce(F.col("scale") <= 0, F.lit(True)))


def segments(signal: DataFrame, fs: float, min_dropout_s: float = 1.0, slot_blocks: int = SLOT_BLOCKS) -> DataFrame:
    """``(sensor_id, start, end, usable, reason)`` with [start, end) in samples. Bad runs shorter than the minimum count
    as usable; equal neighbours are merged."""
    rows = bad_samples(signal, fs, slot_blocks=slot_blocks)
    inside = Window.partitionBy("sensor_id", "slot").orderBy("i")
    rows = rows.withColumn("run", F.sum(F.when(F.col("bad").eqNullSafe(F.lag("bad").over(inside)), 0).otherwise(1)).over(inside))
    runs = rows.groupBy("sensor_id", "slot", "run", "bad").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.bool_or(~F.col("ok")).alias("gap"))
    return _merged(runs, fs, min_dropout_s)


def _merged(runs: DataFrame, fs: float, min_dropout_s: float) -> DataFrame:
    """Segments of the runs ``(sensor_id, bad, start, end, gap)``: a few a slot, ordered over whole sensors."""
    order = Window.partitionBy("sensor_id").orderBy("start")
    runs = runs.withColumn("part", F.sum(F.when(F.col("bad").eqNullSafe(F.lag("bad").over(order)), 0).otherwise(1)).over(order))
    runs = runs.groupBy("sensor_id", "part", "bad").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("gap").alias("gap"))
    usable = ~F.col("bad") | (F.col("end") - F.col("start") < round(min_dropout_s * fs))
    runs = runs.withColumn("usable", usable).withColumn("reason", F.when(~usable, F.when(F.col("gap"), "nan").otherwise("flatline")))
    same = F.col("usable").eqNullSafe(F.lag("usable").over(order)) & F.col("reason").eqNullSafe(F.lag("reason").over(order))
    runs = runs.withColumn("part", F.sum(F.when(same, 0).otherwise(1)).over(order))
    return runs.groupBy("sensor_id", "part", "usable", "reason").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def block_steps(x: np.ndarray, before: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Which samples are finite, and each sample's distance from the one before it; NaN beside a gap, 0 for a sensor's first."""
    ok = np.isfinite(x)
    with np.errstate(invalid="ignore"):
        step = np.abs(np.diff(x, prepend=np.nan if before is None else before))
    step[~np.isfinite(step)] = np.nan
    if before is None and len(x) and ok[0]:
        step[0] = 0.0
    return ok, step


def _bins(step: np.ndarray) -> np.ndarray:
    """32nds of an octave, and one for zero."""
    with np.errstate(divide="ignore"):
        return np.where(step > 0, np.floor(32 * np.log2(step)), -(1 << 20)).astype(np.int64)


def _steps_in(block: int, own: int, first: int, x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``block_steps`` of a block's samples, which the one ahead of them may precede."""
    ahead = block * size - first
    return block_steps(x[ahead:], float(x[0]) if ahead else None)


def _counted(size: int, values: bool):
    """Steps of each block by bin, or, of the bins from ``low`` to ``high``, by value."""

    def work(block, own, first, x, low=None, high=None):
        _, step = _steps_in(block, own, first, x, size)
        step = step[1:] if block == 0 else step  # a sensor's first sample has none
        step = step[~np.isnan(step)]
        keys = _bins(step)
        found, n = np.unique(step[(keys >= low) & (keys <= high)] if values else keys, return_counts=True)
        yield {"key": found, "n": n}

    return work


def _middle(counted: DataFrame, order: str, total: DataFrame | None = None) -> DataFrame:
    """The rows of ``(sensor_id, key, n)`` that hold the two middle ranks of each sensor's steps, counting ``before`` of ``total``."""
    whole = Window.partitionBy("sensor_id")
    rows = counted.groupBy("sensor_id", "key").agg(F.sum("n").alias("n"))
    if total is None:
        n, before = F.sum("n").over(whole), F.lit(0)
        rows = rows.withColumn("low", F.floor((n - 1) / 2)).withColumn("high", F.floor(n / 2)).withColumn("before", before)
    else:
        rows = rows.join(total.hint("merge"), "sensor_id")
    upto = F.sum("n").over(whole.orderBy(order)) + F.col("before")
    rows = rows.withColumn("upto", upto)
    return rows.where((F.col("upto") - F.col("n") <= F.col("high")) & (F.col("upto") > F.col("low")))


def bad_places(ok: np.ndarray, step: np.ndarray, scale: float | None, n_win: int, quiet_share: float = 0.02, least_share: float = 0.9) -> np.ndarray:
    """Which samples are not finite or in a flat window of ``n_win``; without any step everything is flat."""
    if scale is None or not scale > 0:
        return np.ones(len(ok), bool)
    with np.errstate(invalid="ignore"):
        quiet = ~ok | (step < quiet_share * scale)
    start = np.arange(0, len(ok), n_win)
    flat = np.add.reduceat(quiet, start) / np.diff(np.append(start, len(ok))) > least_share
    return ~ok | np.repeat(flat, n_win)[: len(ok)]


def _block_runs(n_win: int, size: int, quiet_share: float, least_share: float):
    """Stretches of good and of bad samples of each block; a block of half a second is flat if more than 90 % of it is quiet."""

    def work(block, own, first, x, scale):
        ok, step = _steps_in(block, own, first, x, size)
        bad = bad_places(ok, step, scale, n_win, quiet_share, least_share)
        at = np.flatnonzero(np.append(True, bad[1:] != bad[:-1]))
        begin = block * size
        yield {"bad": bad[at], "start": begin + at, "end": begin + np.append(at[1:], len(ok)), "gap": np.logical_or.reduceat(~ok, at)}

    return work


def segments_of(packed: Blocks, fs: float, min_dropout_s: float = 1.0, window_s: float = 0.5, quiet_share: float = 0.02, least_share: float = 0.9, windows: int = SLOT_BLOCKS) -> DataFrame:
    """The same as ``segments`` for packed blocks: three passes over their arrays, of which the first counts steps by bin, the second
    those of the bins that hold the median by value, and the third finds runs. Only counts and runs are shuffled, and each stored block's
    last sample, which the next block's first step needs."""
    n_win, size = max(1, round(window_s * fs)), windows * max(1, round(0.5 * fs))
    source = source_of(packed, fs, windows)
    if source.stored:
        rows = kept(source.rows(1, 0))  # three passes read it
        source = replace(source, rows=lambda before, after: rows)
    look = lambda work, schema, *known: read(source, fs, 1, 0, work, schema, *known, windows=windows)
    counts = look(_counted(size, False), "key long, n long")
    bins = kept(_middle(counts, "key").groupBy("sensor_id").agg(F.min("key").alias("from"), F.max("key").alias("to"), F.min(F.col("upto") - F.col("n")).alias("before"), F.min("low").alias("low"), F.max("high").alias("high")))
    values = _middle(look(_counted(size, True), "key double, n long", bins.select("sensor_id", "from", "to"), ("from", "to")), "key", bins.select("sensor_id", "before", "low", "high"))
    holds = lambda rank: F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), F.col("key")))
    scale = values.groupBy("sensor_id").agg(((holds("low") + holds("high")) / 2).alias("scale"))
    runs = look(_block_runs(n_win, size, quiet_share, least_share), "bad boolean, start long, end long, gap boolean", scale, ("scale",), ("sensor_id",), "left")
    return _merged(runs, fs, min_dropout_s)


def usable_segments(found: DataFrame, fs: float, min_duration_s: float = 10.0) -> DataFrame:
    return found.where(F.col("usable") & (F.col("end") - F.col("start") >= round(min_duration_s * fs)))


def coverage(found: DataFrame) -> DataFrame:
    length = F.col("end") - F.col("start")
    return found.groupBy("sensor_id").agg(
        F.sum(length).alias("total"), F.coalesce(F.sum(F.when(F.col("usable"), length)), F.lit(0)).alias("usable"), F.count_if(~F.col("usable")).alias("n_gaps")
    ).withColumn("fraction", F.col("usable") / F.col("total"))


def slice_seconds(signal: DataFrame, channels: DataFrame, low_s: float, high_s: float) -> tuple[DataFrame, DataFrame]:
    """Samples of ``[round(low_s * fs), round(high_s * fs))``, halves to even and clamped to the channel, re-indexed from the
    slice's start; and the ``channels (sensor_id, fs, n_samples, start_us)`` with start and length of their slice. A channel of
    which nothing is left is an error."""
    cut = lambda s: F.least(F.col("n_samples"), F.greatest(F.lit(0), F.bround(s * F.col("fs"), 0).cast("long")))
    spans = channels.withColumn("a", cut(F.lit(low_s))).withColumn("b", cut(F.lit(high_s)))
    held = F.assert_true(F.col("b") > F.col("a"), F.lit("the slice is empty"))
    spans = spans.where(held.isNull())
    rows = signal.join(spans.select("sensor_id", "a", "b"), "sensor_id").where((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))
    moved = spans.select("sensor_id", "fs", (F.col("b") - F.col("a")).alias("n_samples"), (F.col("start_us") + F.round(F.col("a") / F.col("fs") * 1e6).cast("long")).alias("start_us"))
    return rows.select("sensor_id", (F.col("i") - F.col("a")).alias("i"), "x"), moved
