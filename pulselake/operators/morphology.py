"""Shapes of beats ``(group, beat_id, w array<double>)``: templates, correlation, widths, features, imputation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, ratio
from . import blocks


def extract_beats(signal: DataFrame, beats: DataFrame, before: int, after: int) -> DataFrame:
    """Windows ``[sample - before, sample + after)`` of complete beats only: the signal has to go on for one sample after the
    window. Each sample goes to the slots that its beats can look into, so the join is an equi-join on (sensor, slot)."""
    size = before + after
    ends = signal.groupBy("sensor_id").agg(F.max("i").alias("last"))
    inside = beats.join(ends, "sensor_id").where((F.col("sample") - before >= 0) & (F.col("sample") + after <= F.col("last"))).select("sensor_id", "sample")
    slots = inside.withColumn("slot", F.explode(F.sequence(F.floor((F.col("sample") - before) / size), F.floor((F.col("sample") + after - 1) / size))))
    rows = slots.join(signal.withColumn("slot", F.floor(F.col("i") / size)), ["sensor_id", "slot"]).where((F.col("i") >= F.col("sample") - before) & (F.col("i") < F.col("sample") + after))
    packed = rows.groupBy("sensor_id", "sample").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return packed.select("sensor_id", "sample", F.transform("s", lambda v: v["x"]).alias("w"))


def windows_in_blocks(packed: blocks.Blocks, beats: DataFrame, fs: float, before: int, after: int) -> DataFrame:
    """The same for packed blocks: the beats of a block are cut out of its array, which carries the head of the next one."""
    size = blocks.size_of(fs)
    start = F.col("sample") - before
    inside = beats.join(blocks.lengths(packed, fs), "sensor_id").where((start >= 0) & (F.col("sample") + after < F.col("n")))
    own = inside.groupBy("sensor_id", F.floor(start / size).alias("block")).agg(F.collect_set("sample").alias("samples"))  # those of ten minutes

    def cut(block, own, first, x, samples):
        at = np.array(samples, np.int64)
        yield {"sample": at, "w": list(x[(at - before - first)[:, None] + np.arange(before + after)])}

    return blocks.read(packed, fs, 0, before + after, cut, "sample long, w array<double>", own, ("samples",), ("sensor_id", "block"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of equal length, 0 where one of them does not vary."""
    # sums first: nothing within a lambda depends on a whole array, so each array is walked a fixed number of times
    n = F.size(a).cast("double")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    sa, sb, qa, qb = add(a), add(b), square(a), square(b)
    cov, va, vb = add(F.zip_with(a, b, lambda x, y: x * y)) - sa * sb / n, qa - sa * sa / n, qb - sb * sb / n
    varies = (va > 1e-12 * qa) & (vb > 1e-12 * qb)
    return F.coalesce(F.when(varies, cov / F.sqrt(va * vb)), F.lit(0.0))


#: Seconds of a beat's window, of its P wave and of its QRS complex around the peak, half the longest
#: QRS complex, and the smoothing of the slope; the ten features in order, and those that the classifiers use.
BEFORE_S, AFTER_S = 0.32, 0.35
P_WAVE_S, QRS_S = (-0.28, -0.09), (-0.06, 0.10)
LONGEST_HALF_S, SMOOTH_S = 0.12, 0.02
FEATURES = ("template_corr", "qrs_width_ms", "r_amplitude", "qrs_energy", "pre_rr_ratio", "post_rr_ratio", "r_amp_ratio", "width_ratio", "p_energy_ratio", "p_corr")
BINARY_FEATURES = ("template_corr", "qrs_energy", "r_amp_ratio", "width_ratio")
MULTICLASS_FEATURES = ("template_corr", "qrs_energy", "r_amp_ratio", "width_ratio", "pre_rr_ratio", "post_rr_ratio", "p_energy_ratio", "p_corr")


def beat_features(windows: DataFrame, rr: DataFrame, fs: float, before: int) -> DataFrame:
    """``(sensor_id, beat_idx)`` and the ten ``FEATURES`` of each beat of ``windows (sensor_id, beat_idx, w)``, whose peak is
    at ``before``; ``rr`` has ``local_median``. Shapes and sizes are relative to the sensor's own medians and templates,
    intervals to the local median; what is undefined is null."""
    place = lambda s: before + int(round(s * fs))
    part = lambda span: F.slice("w", max(0, place(span[0])) + 1, place(span[1]) - max(0, place(span[0])))
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    beats = windows.select(F.col("sensor_id").alias("group"), F.col("beat_idx").alias("beat_id"), "w")
    rows = beats.withColumn("width_s", width_of(fs, before, max(1, int(round(LONGEST_HALF_S * fs))), max(1, int(round(SMOOTH_S * fs))))("w"))
    rows = rows.withColumns({"p": part(P_WAVE_S), "qrs": part(QRS_S), "r": F.abs(F.get("w", F.lit(before)))}).drop("w")
    rows = rows.withColumns({"p_energy": square("p"), "q_energy": square("qrs")})
    mids = rows.groupBy("group").agg(*[F.percentile(c, 0.5).alias(f"m_{c}") for c in ("p_energy", "q_energy", "r", "width_s")])
    for part_of in ("qrs", "p"):
        mids = mids.join(templates(rows.select("group", "beat_id", F.col(part_of).alias("w"))).select("group", F.col("template").alias(f"t_{part_of}")), "group")
    over = lambda c: F.when(F.col(f"m_{c}") > 0, F.col(c) / F.col(f"m_{c}"))
    out = rows.join(mids, "group").select(
        F.col("group").alias("sensor_id"), F.col("beat_id").alias("beat_idx"), pearson(F.col("qrs"), F.col("t_qrs")).alias("template_corr"), (F.col("width_s") * 1000).alias("qrs_width_ms"),
        F.col("r").alias("r_amplitude"), F.coalesce(over("q_energy"), F.col("q_energy")).alias("qrs_energy"), over("r").alias("r_amp_ratio"), over("width_s").alias("width_ratio"),
        F.coalesce(over("p_energy"), F.lit(0.0)).alias("p_energy_ratio"), pearson(F.col("p"), F.col("t_p")).alias("p_corr"),
    )
    relative = rr.select("sensor_id", "rr_idx", F.when(F.col("local_median") > 0, F.col("rr_s") / F.col("local_median")).alias("r"))
    for name, shift in (("pre_rr_ratio", 1), ("post_rr_ratio", 0)):  # the interval that ends with the beat, and the one that starts with it
        out = out.join(relative.select("sensor_id", (F.col("rr_idx") + shift).alias("beat_idx"), F.col("r").alias(name)), ["sensor_id", "beat_idx"], "left")
    return out.select("sensor_id", "beat_idx", *FEATURES)


#: Fixed value: samples of the longest sensor whose windows one task holds, a day at 100 Hz; of longer ones the windows are rows.
LONGEST_HELD = 100 * 86_400


def features_in_blocks(source: blocks.Source, beats: DataFrame, fs: float, before: int, after: int) -> DataFrame:
    """``beats (sensor_id, beat_idx, sample, whole numbers)``, numbered in order, with the ``FEATURES`` of ``beat_features``, equal to them: of
    ``windows_in_blocks``, with the intervals of the beats. A sensor's blocks are made in one task, which keeps of a beat's window
    what the templates need, so no window is written or shuffled."""
    size, others = blocks.size_of(fs), [c for c in beats.columns if c not in ("sensor_id", "sample", "beat_idx")]
    carried = ("sample", "beat_idx", *others)
    place = lambda s: before + int(round(s * fs))
    spans = [slice(max(0, place(a)), place(b)) for a, b in (P_WAVE_S, QRS_S)]
    width = _width_in(fs, before, max(1, int(round(LONGEST_HALF_S * fs))), max(1, int(round(SMOOTH_S * fs))))
    block = F.greatest(F.lit(0), F.floor((F.col("sample") - before) / size))
    rows = beats.join(blocks.lengths(source, fs), "sensor_id").groupBy("sensor_id", block.alias("block"))
    rows = rows.agg(F.max("n").alias("last"), F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in carried]))).alias("s"))  # those of ten minutes
    rows = rows.select("sensor_id", "block", "last", *[F.col(f"s.{c}").alias(f"b_{c}") for c in carried])

    def work(made) -> dict:
        known, at, parts = [], [], []
        for _, own, first, x, last, *columns in made:
            known.append(np.array(columns, np.int64))
            sample = known[-1][0]
            whole = (sample >= before) & (sample + after < last) & (own > 0)
            at.append(whole)
            if whole.any():
                inside = (sample[whole] - before - first)[:, None] + np.arange(before + after)
                w = np.append(x, np.full(max(0, int(inside.max()) + 1 - len(x)), np.nan))[inside]  # NaN beyond the last stretch
                parts.append((*(w[:, s].copy() for s in spans), np.abs(w[:, before]), width(w, np.ones(w.shape, bool))))
        if not parts:
            return {"sample": []}
        known, at = np.concatenate(known, axis=1), np.concatenate(at)
        p, qrs, r, wide = (np.concatenate(c) for c in zip(*parts, strict=True))
        relative = _relative_intervals(known[0], fs)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            found = _features_of_windows(p, qrs, r, wide) | {"pre_rr_ratio": np.append(np.nan, relative)[at], "post_rr_ratio": np.append(relative, np.nan)[at]}
        nulls = ("qrs_width_ms", "width_ratio", "pre_rr_ratio", "post_rr_ratio")  # which say so by NaN
        return dict(zip(carried, known[:, at], strict=True)) | {c: pa.nulls(len(r), pa.float64()) if found[c] is None else pa.array(found[c], pa.float64(), from_pandas=c in nulls) for c in FEATURES}

    schema = ", ".join([*(f"{c} long" for c in carried), *(f"{c} double" for c in FEATURES)])
    out = blocks.over_sensors(source, 0, before + after, work, schema, rows, ("last", *(f"b_{c}" for c in carried)))
    return out.select("sensor_id", "beat_idx", "sample", *[F.col(c).cast(beats.schema[c].dataType).alias(c) for c in others], *FEATURES)


def _above(a, b):
    """a > b where NaN is larger than any number, as in Spark."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _relative_intervals(sample: np.ndarray, fs: float, k: int = 11) -> np.ndarray:
    """Intervals between beats over the local median of ``rhythm.local_median``; NaN where that is not positive."""
    rr = np.diff(sample) / float(fs)
    n = len(rr)
    if not n:
        return rr
    half = (min(k, n - (1 - n % 2)) - 1) // 2
    near = np.lib.stride_tricks.sliding_window_view(np.pad(rr, half, "edge"), 2 * half + 1)
    median = np.sort(near, axis=1)[:, half]
    return np.divide(rr, median, out=np.full(n, np.nan), where=median > 0)


def _middle(v: np.ndarray) -> np.ndarray:
    """Median over rows; NaN counts as larger than any number, as in Spark."""
    n, v = len(v), np.sort(v, axis=0)
    return v[n // 2] if n % 2 else 0.5 * v[n // 2 - 1] + 0.5 * v[n // 2]


def _summed(terms) -> np.ndarray:
    """One after the other, as expressions add them."""
    return sum(terms, 0.0)


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``pearson`` of each row of ``a`` and ``b``."""
    n = float(len(b))
    sa, sb, qa, qb = _summed(a.T), _summed(b), _summed(a.T * a.T), _summed(b * b)
    cov, va, vb = _summed(a.T * b[:, None]) - sa * sb / n, qa - sa * sa / n, qb - sb * sb / n
    return np.where(_above(va, 1e-12 * qa) & _above(vb, 1e-12 * qb), cov / np.sqrt(va * vb), 0.0)


def _template(w: np.ndarray, least_correlation: float = 0.8, least_beats: int = 5, least_share: float = 0.2) -> np.ndarray:
    """That of ``templates``."""
    first = _middle(w)
    near = ~(_pearson(w, first) < least_correlation)
    return _middle(w[near]) if near.sum() >= max(float(least_beats), least_share * len(w)) else first


def _features_of_windows(p: np.ndarray, qrs: np.ndarray, r: np.ndarray, width: np.ndarray) -> dict[str, np.ndarray]:
    """The ``FEATURES`` but the intervals, of the P waves, QRS complexes, sizes and widths of a sensor's beats; an undefined width is NaN and
    undefined ratios are None."""
    p_energy, q_energy = _summed(p.T * p.T), _summed(qrs.T * qrs.T)
    known = width[~np.isnan(width)]
    middle = {"p": _middle(p_energy), "q": _middle(q_energy), "r": _middle(r), "width": _middle(known) if len(known) else np.float64(0)}
    over = lambda c, v, other: v / middle[c] if _above(middle[c], 0.0) else other
    return {
        "template_corr": _pearson(qrs, _template(qrs)), "qrs_width_ms": width * 1000, "r_amplitude": r, "qrs_energy": over("q", q_energy, q_energy), "r_amp_ratio": over("r", r, None),
        "width_ratio": over("width", width, None), "p_energy_ratio": over("p", p_energy, np.zeros(len(r))), "p_corr": _pearson(p, _template(p)),
    }


def _median_shape(beats: DataFrame, name: str) -> DataFrame:
    points = beats.select("group", F.posexplode("w").alias("pos", "v")).groupBy("group", "pos").agg(F.percentile("v", 0.5).alias("v"))
    return points.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias(name))


def templates(beats: DataFrame, least_correlation: float = 0.8, least_beats: int = 5, least_share: float = 0.2) -> DataFrame:
    """``(group, template, n_used)``: element-wise median of the beats that follow the median of all, or of all where
    those are too few."""
    first = _median_shape(beats, "t0")
    near = beats.join(first, "group").withColumn("near", pearson(F.col("w"), F.col("t0")) >= least_correlation)
    counts = near.groupBy("group").agg(F.count("*").alias("n"), F.count_if("near").alias("k"))
    second = _median_shape(near.where("near"), "t1")
    out = counts.join(first, "group").join(second, "group", "left")
    enough = F.col("k") >= F.greatest(F.lit(float(least_beats)), least_share * F.col("n"))
    return out.select("group", F.when(enough, F.col("t1")).otherwise(F.col("t0")).alias("template"), F.when(enough, F.col("k")).otherwise(F.col("n")).alias("n_used"))


def correlations(beats: DataFrame, shapes: DataFrame) -> DataFrame:
    return beats.join(shapes.select("group", "template"), "group").select("group", "beat_id", pearson(F.col("w"), F.col("template")).alias("corr"))


def widths(beats: DataFrame, fs: float, centre: int, bound: int, smooth: int, share: float = 0.15) -> DataFrame:
    return with_width(beats, fs, centre, bound, smooth, share).select("group", "beat_id", "width_s")


def with_width(beats: DataFrame, fs: float, centre: int, bound: int, smooth: int, share: float = 0.15) -> DataFrame:
    """``beats`` with ``width_s``: seconds around ``centre`` in which the smoothed squared slope stays over a share of its
    value there, or of its largest where it is zero there; null if it is zero throughout. Both edges are conditional extrema, no walk."""
    w, left, right = F.col("w"), smooth // 2, (smooth - 1) // 2
    slope = lambda j: F.when(j > 0, F.coalesce(F.get(w, j) - F.get(w, F.greatest(j - 1, F.lit(0))), F.lit(0.0))).otherwise(0.0)
    around = lambda i: sum((slope(i + d) * slope(i + d) for d in range(-left, right + 1)), F.lit(0.0))
    env = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: around(i) / smooth)
    # generated, so that the envelope is an array of the row and not an expression that each use below evaluates anew
    rows = beats.select("*", F.inline(F.array(F.struct(env.alias("env")))))
    top = F.get(F.col("env"), F.lit(centre))
    rows = rows.select("*", F.inline(F.array(F.struct(F.when(top > 0, top).otherwise(F.array_max("env")).alias("top")))))
    top = F.col("top")
    low, high = max(0, centre - bound), F.least(F.size("w") - 1, F.lit(centre + bound))
    below = lambda a, b: F.filter(F.sequence(a, b), lambda i: F.get(F.col("env"), i) <= share * top)
    start = F.coalesce(F.array_max(below(F.lit(low), F.lit(centre))), F.lit(low))
    end = F.coalesce(F.array_min(below(F.lit(centre), high)), high)
    return rows.withColumn("width_s", F.when(top > 0, (end - start) / float(fs))).drop("env", "top")


def width_of(fs: float, centre: int, bound: int, smooth: int, share: float = 0.15):
    """``with_width`` as a function of a column of windows, all windows of one size in a batch at once. NaN counts as larger than any
    number and null as no slope, as there."""
    of = _width_in(fs, centre, bound, smooth, share)

    def widths_in(w: pa.Array) -> pa.Array:
        out, size = np.full(len(w), np.nan), w.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for n in np.unique(size[size > 0]):
            at = np.flatnonzero(size == n)
            values = w.take(pa.array(at)).flatten()
            out[at] = of(values.fill_null(0.0).to_numpy().reshape(-1, n), values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n))
        return pa.array(out, pa.float64(), from_pandas=True)

    widths_in.__annotations__ = {"w": pa.Array, "return": pa.Array}  # read as types, not as text
    return F.arrow_udf(widths_in, "double")


def _width_in(fs: float, centre: int, bound: int, smooth: int, share: float = 0.15):
    """The function of ``width_of``, of windows of one size and of which of their values are not null; NaN where the width is null."""
    left, right = smooth // 2, (smooth - 1) // 2

    def of(w: np.ndarray, known: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            return within(w, known)

    def within(w: np.ndarray, known: np.ndarray) -> np.ndarray:
        n = w.shape[1]
        slope = np.zeros((len(w), left + n + right))
        slope[:, left + 1 : left + n] = np.where(known[:, 1:] & known[:, :-1], w[:, 1:] - w[:, :-1], 0.0)
        env = np.zeros(w.shape)
        for d in range(smooth):
            env += slope[:, d : d + n] * slope[:, d : d + n]
        env /= smooth
        top = env[:, centre] if centre < n else np.zeros(len(w))
        top = np.where(_above(top, np.zeros(1)), top, env.max(axis=1))
        low, high = max(0, centre - bound), min(n - 1, centre + bound)
        below = ~_above(env, (share * top)[:, None])
        before, after = below[:, low : centre + 1], below[:, min(centre, high) : max(centre, high) + 1]
        never = np.zeros((len(w), 1), bool)
        start = np.where(before.any(axis=1), low + before.shape[1] - 1 - np.hstack([before[:, ::-1], never]).argmax(axis=1), low)
        end = np.where(after.any(axis=1), min(centre, high) + np.hstack([after, never]).argmax(axis=1), high)
        return np.where(_above(top, np.zeros(1)), (end - start) / float(fs), np.nan)

    return of


def energy(w: Column, a: int, b: int) -> Column:
    return F.aggregate(F.slice(w, a + 1, b - a), F.lit(0.0), lambda s, v: s + v * v)


def feature_ratios(beats: DataFrame, early: tuple[int, int], middle: tuple[int, int]) -> DataFrame:
    """Amplitude and the energies of two stretches of each beat against the medians of its group."""
    w = F.col("w")
    rows = beats.select("group", "beat_id", (F.array_max(w) - F.array_min(w)).alias("amp"), energy(w, *early).alias("p"), energy(w, *middle).alias("q"))
    mids = rows.groupBy("group").agg(*[F.percentile(c, 0.5).alias(f"m_{c}") for c in ("amp", "p", "q")])
    rows = rows.join(mids, "group")
    return rows.select("group", "beat_id", *[ratio(F.col(c), F.col(f"m_{c}")).alias(f"{c}_ratio") for c in ("amp", "p", "q")])


def impute(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Non-finite values become the median of the finite ones of the same group, 0 where there are none."""
    mids = rows.groupBy(*by).agg(*[F.percentile(F.when(finite(F.col(c)), F.col(c)), 0.5).alias(f"m_{c}") for c in columns])
    out = rows.join(mids, by)
    return out.select(*[c for c in rows.columns if c not in columns], *[F.when(finite(F.col(c)), F.col(c)).otherwise(F.coalesce(f"m_{c}", F.lit(0.0))).alias(c) for c in columns])
