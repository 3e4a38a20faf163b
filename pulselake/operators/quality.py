"""Signal quality and artefacts over tumbling windows of ``(sensor_id, i, x)``, anchored at sample 0."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import finite, ratio, unit
from . import blocks


def by_sample() -> WindowSpec:
    return Window.partitionBy("sensor_id").orderBy("i")


def windowed(signal: DataFrame, fs: float, window_s: float) -> DataFrame:
    """Samples with their window ``w``; a last window of less than half the length is left out."""
    n_win = max(1, round(window_s * fs))
    rows = signal.withColumn("w", F.floor(F.col("i") / n_win))
    return rows.withColumn("n_in_window", F.count("*").over(Window.partitionBy("sensor_id", "w"))).where(F.col("n_in_window") >= n_win // 2)


def window_statistics(signal: DataFrame, fs: float, window_s: float) -> DataFrame:
    """Robust amplitude (p99 - p1), share of flat steps and share of saturated samples of each window."""
    inside = Window.partitionBy("sensor_id", "w").orderBy("i")
    whole = Window.partitionBy("sensor_id", "w")
    rows = windowed(signal.where(finite(F.col("x"))), fs, window_s)
    rows = rows.withColumn("step", F.abs(F.col("x") - F.lag("x").over(inside))).withColumn("low", F.min("x").over(whole)).withColumn("high", F.max("x").over(whole))
    scale = rows.groupBy("sensor_id", "w").agg(F.percentile("step", 0.5).alias("scale"))
    rows = rows.join(scale, ["sensor_id", "w"])
    span = F.col("high") - F.col("low")
    rail = (F.col("x") - F.col("low") <= 1e-6 * span) | (F.col("high") - F.col("x") <= 1e-6 * span)
    out = rows.groupBy("sensor_id", "w").agg(
        F.count("*").alias("n"), (F.percentile("x", 0.99) - F.percentile("x", 0.01)).alias("amplitude"),
        F.when(F.first("scale") > 0, F.avg((F.col("step") < 0.05 * F.col("scale")).cast("double"))).otherwise(1.0).alias("flat"),
        F.avg(rail.cast("double")).alias("saturated"),
    )
    return out


def excess_kurtosis(x: F.Column) -> F.Column:
    """Bias-corrected excess kurtosis of finite values; 0 for fewer than eight or constant ones."""
    n = F.count(x).cast("double")
    usual = (F.count(x) >= 8) & (F.stddev_pop(x) > 0)
    g = F.when(usual, F.kurtosis(x))
    corrected = ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.coalesce(F.when(usual, corrected), F.lit(0.0))


def instability(signal: DataFrame, fs: float, window_s: float, sub_s: float = 1.0) -> DataFrame:
    """How much the amplitude (p97.5 - p2.5) of whole sub-windows varies: median deviation over median, 0..1."""
    n_sub, n_win = max(1, round(sub_s * fs)), max(1, round(window_s * fs))
    rows = windowed(signal, fs, window_s).withColumn("s", F.floor((F.col("i") % n_win) / n_sub))
    value = F.when(finite(F.col("x")), F.col("x"))
    subs = rows.groupBy("sensor_id", "w", "s").agg(F.count("*").alias("n"), (F.percentile(value, 0.975) - F.percentile(value, 0.025)).alias("a")).where(F.col("n") == n_sub)
    mid = subs.groupBy("sensor_id", "w").agg(F.percentile("a", 0.5).alias("m"), F.count("a").alias("k"))
    spread = subs.join(mid, ["sensor_id", "w"]).groupBy("sensor_id", "w", "m", "k").agg(F.percentile(F.abs(F.col("a") - F.col("m")), 0.5).alias("mad"))
    value = F.when(F.col("k") < 2, 0.0).when(F.col("m") <= 0, 1.0).otherwise(unit(ratio(F.col("mad"), F.col("m"))))
    return spread.select("sensor_id", "w", value.alias("instability"))


def artefact_windows(signal: DataFrame, fs: float, window_s: float = 10.0, agreement: DataFrame | None = None) -> DataFrame:
    """Artefact score of each window from kurtosis and instability, and from ``agreement (sensor_id, w, bsqi)`` of two
    detectors where that is given."""
    value = F.when(finite(F.col("x")), F.col("x"))
    shape = windowed(signal, fs, window_s).groupBy("sensor_id", "w").agg(excess_kurtosis(value).alias("kurtosis"))
    rows = shape.join(instability(signal, fs, window_s), ["sensor_id", "w"], "left").withColumn("instability", F.coalesce("instability", F.lit(0.0)))
    return artefact_scores(rows, agreement)


def artefact_scores(rows: DataFrame, agreement: DataFrame | None = None) -> DataFrame:
    """Windows with ``kurtosis`` and ``instability`` scored as above."""
    peaky, shaky = unit(1 - F.col("kurtosis") / 5), unit(F.col("instability") / 0.5)
    if agreement is None:
        rows = rows.withColumn("bsqi", F.lit(None).cast("double"))
    else:
        rows = rows.join(agreement.select("sensor_id", "w", "bsqi"), ["sensor_id", "w"], "left")
    score = F.when(F.col("bsqi").isNull(), 0.55 * peaky + 0.45 * shaky).otherwise(0.45 * unit(1 - F.col("bsqi")) + 0.30 * peaky + 0.25 * shaky)
    rows = rows.withColumn("score", score).withColumn("bsqi_used", F.col("bsqi").isNotNull())
    return rows.withColumn("is_artifact", F.col("score") >= 0.5)


def beats_in_artifact(beats: DataFrame, windows: DataFrame, fs: float, window_s: float = 10.0) -> DataFrame:
    """Beats with ``in_artifact``; a beat beyond the assessed windows is in none."""
    n_win = max(1, round(window_s * fs))
    keyed = beats.withColumn("w", F.floor(F.col("sample") / n_win))
    return keyed.join(windows.select("sensor_id", "w", "is_artifact"), ["sensor_id", "w"], "left").select("sensor_id", "sample", F.coalesce("is_artifact", F.lit(False)).alias("in_artifact"))


def artefact_mask(signal: DataFrame, windows: DataFrame, fs: float, window_s: float = 10.0) -> DataFrame:
    """``(sensor_id, i, masked)`` for every sample; samples that no window covers are not masked."""
    marked = beats_in_artifact(signal.select("sensor_id", F.col("i").alias("sample")), windows, fs, window_s)
    return marked.select("sensor_id", F.col("sample").alias("i"), F.col("in_artifact").alias("masked"))


def band_power_ratio(x: np.ndarray, fs: float, low: float = 0.5, high: float = 40.0) -> float:
    """Share of the power between two frequencies, from averaged periodograms of half-overlapping Hann windows."""
    n = len(x)
    if n < 16:
        return 0.0
    size = min(n, max(64, round(2 * fs)))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    cut = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(1, size - size // 2)]
    power = (np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2).mean(axis=0)
    power[1 : -1 if size % 2 == 0 else None] *= 2
    f = np.fft.rfftfreq(size, 1 / fs)
    total = np.trapezoid(power, f)
    inside = (f >= low) & (f <= high)
    return float(np.clip(np.trapezoid(power[inside], f[inside]) / total, 0, 1)) if total > 0 and inside.sum() > 1 else 0.0


def quality_windows(signal: DataFrame, fs: float, window_s: float = 10.0) -> DataFrame:
    """``sqi`` of each window: band power share, less what is flat or saturated."""
    packed = windowed(signal.where(finite(F.col("x"))), fs, window_s).groupBy("sensor_id", "w").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    share = F.pandas_udf(lambda s: s.map(lambda x: band_power_ratio(np.asarray(x, float), fs)), "double")
    power = packed.select("sensor_id", "w", share(F.transform("s", lambda v: v["x"])).alias("power"))
    return quality_scores(window_statistics(signal, fs, window_s).join(power, ["sensor_id", "w"]))


def quality_scores(rows: DataFrame) -> DataFrame:
    """Windows with amplitude, flat and saturated share and band power scored as above."""
    sqi = F.when(F.col("amplitude") > 0, F.col("power") * (1 - F.col("flat")) * (1 - F.least(F.lit(1.0), 5 * F.col("saturated")))).otherwise(0.0)
    return rows.withColumn("sqi", unit(sqi)).withColumn("is_usable", F.col("sqi") >= 0.5)


def _kurtosis(v: np.ndarray) -> np.ndarray:
    """Bias-corrected excess kurtosis of each row; 0 for fewer than eight values or constant ones."""
    n = v.shape[1]
    off = v - v.mean(axis=1, keepdims=True) if n else v
    square = np.where(v.max(axis=1) > v.min(axis=1), (off * off).mean(axis=1), 0.0) if n else np.zeros(len(v))
    with np.errstate(invalid="ignore", divide="ignore"):
        g = (off**4).mean(axis=1) / square**2 - 3 if n else square
        return np.where((square > 0) & (n >= 8), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6) if n > 3 else 0.0, 0.0)


def _instability(amplitudes: np.ndarray) -> float:
    """Median deviation over median of the amplitudes of a window's parts."""
    if len(amplitudes) < 2:
        return 0.0
    mid = np.median(amplitudes)
    return float(np.clip(np.median(np.abs(amplitudes - mid)) / mid, 0, 1)) if mid > 0 else 1.0


def _spread(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Amplitude, share of flat steps and share of samples at either rail of each row of finite values."""
    low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
    edge = 1e-6 * (high - low)
    top, bottom = np.percentile(v, [99, 1], axis=1)
    step = np.abs(np.diff(v, axis=1))
    scale = np.median(step, axis=1) if step.shape[1] else np.zeros(len(v))
    flat = np.where(scale > 0, (step < 0.05 * scale[:, None]).mean(axis=1) if step.shape[1] else 1.0, 1.0)
    return top - bottom, flat, ((v - low <= edge) | (high - v <= edge)).mean(axis=1)


WINDOWS = "w long, n long, n_finite long, kurtosis double, instability double, amplitude double, flat double, saturated double, power double"


def _features(x: np.ndarray, fs: float, n_sub: int) -> list[tuple]:
    """``WINDOWS`` but the number of each row of ``x``, windows of one length: rows without a gap together, others alone."""
    ok = np.isfinite(x)
    out: list[tuple] = [()] * len(x)
    parts = x.shape[1] // n_sub
    clean = np.flatnonzero(ok.all(axis=1))
    groups = [clean] if len(clean) else []
    groups += [np.array([r]) for r in np.flatnonzero(~ok.all(axis=1))]
    for rows in groups:
        whole = ok[rows[0]].all()
        v = x[rows] if whole else x[rows[0]][ok[rows[0]]][None, :]
        sub = x[rows][:, : parts * n_sub].reshape(len(rows), parts, n_sub)
        if whole:
            sides = np.percentile(sub, [97.5, 2.5], axis=2) if parts else np.zeros((2, len(rows), 0))
            amplitudes = list(sides[0] - sides[1])
        else:
            own = [p[np.isfinite(p)] for p in sub[0]]
            amplitudes = [np.array([np.subtract(*np.percentile(p, [97.5, 2.5])) for p in own if len(p)])]
        kurtosis = _kurtosis(v)
        spread = _spread(v) if v.shape[1] else (np.zeros(1), np.ones(1), np.zeros(1))
        for k, r in enumerate(rows):
            out[r] = (x.shape[1], v.shape[1], float(kurtosis[k]), _instability(amplitudes[k]), *(float(c[k]) for c in spread), band_power_ratio(v[k], fs))
    return out


def windows_in_blocks(packed: blocks.Blocks, fs: float, window_s: float = 10.0, sub_s: float = 1.0) -> DataFrame:
    """``(sensor_id, WINDOWS)`` of packed blocks: everything that is asked of a window, from one look at its samples. A window
    belongs to the block in which it starts, which carries the head of the next one."""
    size, n_win, n_sub = blocks.size_of(fs), max(1, round(window_s * fs)), max(1, round(sub_s * fs))
    names = [f.strip().split(" ")[0] for f in WINDOWS.split(",")]

    def work(block, own, begin, x):
        first = -(-begin // n_win)
        past = max(first, -(-(begin + min(size, len(x))) // n_win))
        if past == first:
            return
        at = first * n_win - begin
        full = min(past - first, (len(x) - at) // n_win)
        found = _features(x[at : at + full * n_win].reshape(full, n_win), fs, n_sub) if full else []
        if full < past - first:
            found += _features(x[at + full * n_win :][None, :], fs, n_sub)
        yield dict(zip(names, zip(*[(first + k, *f) for k, f in enumerate(found)], strict=True), strict=True))

    return blocks.read(packed, fs, 0, n_win, work, WINDOWS).withColumn("half", F.lit(n_win // 2))


def artefacts_in_blocks(packed: blocks.Blocks, fs: float, window_s: float = 10.0, agreement: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """``artefact_windows`` of packed blocks, or of their ``windows`` where these are known."""
    rows = windows_in_blocks(packed, fs, window_s) if windows is None else windows
    return artefact_scores(rows.where("n >= half").select("sensor_id", "w", "kurtosis", "instability"), agreement)


def quality_in_blocks(packed: blocks.Blocks, fs: float, window_s: float = 10.0, windows: DataFrame | None = None) -> DataFrame:
    """``quality_windows`` of packed blocks, as above."""
    rows = windows_in_blocks(packed, fs, window_s) if windows is None else windows
    rows = rows.where("n_finite >= half and n_finite > 0").select("sensor_id", "w", F.col("n_finite").alias("n"), "amplitude", "flat", "saturated", "power")
    return quality_scores(rows)


def rank_sensors(sqi: DataFrame) -> DataFrame:
    """Median quality of each sensor (0 without a window), best first; equals in the order of their ids."""
    out = sqi.groupBy("sensor_id").agg(F.coalesce(F.percentile("sqi", 0.5), F.lit(0.0)).alias("sqi"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sqi"), "sensor_id")))


