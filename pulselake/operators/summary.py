"""Event burden, histograms, picks and per-sensor summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, script_safe
from . import blocks
from .morphology import extract_beats, windows_in_blocks


def event_histogram(events: DataFrame, durations: DataFrame, fs: float, bin_s: F.Column | float) -> DataFrame:
    """Events per bin, empty bins included: ``durations (sensor_id, duration_s)``; the last edge belongs to the last bin,
    events beyond it to none."""
    sizes = durations.withColumn("bin_s", F.lit(bin_s) if isinstance(bin_s, (int, float)) else bin_s)
    sizes = sizes.withColumn("n_bins", F.greatest(F.lit(1), F.ceil(F.col("duration_s") / F.col("bin_s"))).cast("int"))
    every = sizes.select("sensor_id", "bin_s", "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    t = F.col("sample") / float(fs)
    placed = events.join(sizes, "sensor_id").withColumn("t", t).where((F.col("t") >= 0) & (F.col("t") <= F.col("n_bins") * F.col("bin_s")))
    counts = placed.groupBy("sensor_id", F.least(F.floor(F.col("t") / F.col("bin_s")), F.col("n_bins") - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return every.join(counts, ["sensor_id", "bin"], "left").select("sensor_id", "bin", "bin_s", F.coalesce("n", F.lit(0)).alias("n"))


def bars(histogram: DataFrame) -> DataFrame:
    """Each bin's centre and the width of its bar in minutes."""
    return histogram.select("sensor_id", "bin", ((F.col("bin") + 0.5) * F.col("bin_s") / 60).alias("centre_min"), (0.86 * F.col("bin_s") / 60).alias("width_min"), "n")


def on_recording_clock(channels: DataFrame) -> DataFrame:
    """``channels (record_id, sensor_id, start_us, n_samples, fs, clock_offset_s)`` with corrected start and end, the seconds
    from the recording's origin (its earliest corrected start) to the start, and ``uniform_rate``."""
    shift = lambda s: F.round(s * 1e6).cast("long")
    rows = channels.withColumn("start", F.col("start_us") + shift(F.col("clock_offset_s"))).withColumn("end", F.col("start") + shift(F.col("n_samples") / F.col("fs")))
    whole = rows.groupBy("record_id").agg(F.min("start").alias("origin"), (F.min("fs") == F.max("fs")).alias("uniform_rate"))
    return rows.join(whole, "record_id").select("record_id", "sensor_id", "start", "end", ((F.col("start") - F.col("origin")) / 1e6).alias("elapsed_s"), "uniform_rate")


def busiest_bin(histogram: DataFrame) -> DataFrame:
    """The bin with most events, the last of equals."""
    return histogram.groupBy("sensor_id").agg(F.max(F.struct("n", "bin")).alias("b")).select("sensor_id", F.col("b.bin").alias("bin"), F.col("b.n").alias("n"))


def events_summary(events: DataFrame, beats: DataFrame, hours: DataFrame) -> DataFrame:
    """Count, share of all beats and rate per analysed hour (null without any)."""
    n = events.groupBy("sensor_id").agg(F.count("*").alias("n_events"))
    all_beats = beats.groupBy("sensor_id").agg(F.count("*").alias("n_beats"))
    rows = all_beats.join(n, "sensor_id", "left").join(hours, "sensor_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return rows.select("sensor_id", "n_events", "n_beats", F.coalesce(ratio(100.0 * F.col("n_events"), F.col("n_beats")), F.lit(0.0)).alias("burden_pct"), ratio(F.col("n_events").cast("double"), F.col("hours")).alias("per_hour"), (F.col("hours") < 1).alias("is_extrapolated"))


def evenly_spaced(events: DataFrame, k: int) -> DataFrame:
    """At most ``k`` (two or more) events of each sensor, evenly over their order, the first and the last among them."""
    order = Window.partitionBy("sensor_id").orderBy("sample")
    rows = events.withColumn("at", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("sensor_id")))
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("n") - 1) / (k - 1)))
    picked = (F.col("n") <= k) | F.array_contains(spots, F.col("at").cast("long"))
    return rows.where(picked).select("sensor_id", "sample", "at")


def examples_by_bin(signal: DataFrame, events: DataFrame, fs: float, bin_s: float, per_bin: int = 3, before_s: float = 0.4, after_s: float = 0.4, decimals: int = 3) -> DataFrame:
    """``(sensor_id, bin, t, y)``: at most ``per_bin`` waveforms of each half-open bin's events, evenly over their order; those
    that reach beyond the signal are left out after the choice."""
    placed = events.withColumn("bin", F.floor(F.col("sample") / float(fs) / bin_s)).select(F.struct("sensor_id", "bin").alias("sensor_id"), "sample")
    picked = evenly_spaced(placed, per_bin).select("sensor_id.sensor_id", "sensor_id.bin", "sample")
    found = extract_beats(signal, picked.select("sensor_id", "sample").distinct(), round(before_s * fs), round(after_s * fs))
    shape = F.transform("w", lambda v: F.round(v, decimals))
    return picked.join(found, ["sensor_id", "sample"]).select("sensor_id", "bin", F.round(F.col("sample") / float(fs), 2).alias("t"), shape.alias("y"))


def representative_beats(packed: blocks.Blocks, events: DataFrame, fs: float, n: int = 5, before_s: float = 0.6, after_s: float = 0.6) -> DataFrame:
    """``(sensor_id, sample, w)``: complete waveforms, out of packed blocks, of at most ``n`` events of each sensor, evenly over their
    order; those that reach beyond the signal are left out after the choice."""
    return windows_in_blocks(packed, evenly_spaced(events, n).select("sensor_id", "sample"), fs, round(before_s * fs), round(after_s * fs))


def in_clock_window(peaks: DataFrame, clocks: DataFrame, fs: float, low_s: float, high_s: float) -> DataFrame:
    """``peaks (sensor_id, sample)`` between two times of the recording's clock, both included; ``clocks`` as of
    ``on_recording_clock``, a row a channel."""
    t = F.col("elapsed_s") + F.col("sample") / float(fs)
    return peaks.join(clocks.select("record_id", "sensor_id", "elapsed_s"), "sensor_id").withColumn("t_s", t).where(F.col("t_s").between(low_s, high_s)).select("record_id", "sensor_id", "sample", "t_s")


def channel_of(channels: DataFrame, sensor_id: object = None, position: str | None = None) -> DataFrame:
    """The channel of each recording with that id, or the first one at that position; recordings without one have no row."""
    same = F.lit(True) if sensor_id is None else F.col("sensor_id") == F.lit(sensor_id)
    same = same if position is None else same & (F.col("position") == position)
    first = F.row_number().over(Window.partitionBy("record_id").orderBy("ordinal"))  # some channels a recording
    return channels.where(same).withColumn("at", first).where("at = 1").drop("at")


def recording_overview(channels: DataFrame) -> DataFrame:
    """One row a recording of ``channels (record_id, ordinal, sensor_id, fs, position, n_beats)``: its primary sensor (the first),
    beats of all channels, rates, positions by sensor, and a line of text."""
    out = channels.groupBy("record_id").agg(
        F.count("*").alias("n_channels"), F.min_by("sensor_id", "ordinal").alias("primary_sensor"), F.sum("n_beats").alias("n_beats"),
        F.sort_array(F.collect_set("fs")).alias("rates"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("sensor_id").cast("string"), "position")))).alias("positions"),
    )
    rates = F.array_join(F.transform("rates", lambda r: F.format_string("%.1f", r)), "/")
    line = F.format_string("recording %s: %d channel(s), %s Hz, %d beats, primary sensor %s", F.col("record_id").cast("string"), "n_channels", rates, "n_beats", F.col("primary_sensor").cast("string"))
    return out.withColumns({"uniform_rate": F.size("rates") == 1, "line": line})


def summary_json(rows: DataFrame) -> DataFrame:
    """One compact JSON text a sensor, safe to stand inside a page's script."""
    return rows.select("sensor_id", script_safe(F.to_json(F.struct(*[c for c in rows.columns]))).alias("json"))


def result_tree(results: DataFrame, channels: DataFrame) -> DataFrame:
    """``(record_id, n_channels, duration_s, channels)``: the ``results`` of an analysis, a row a sensor, nested as an array of one
    struct a channel in the order of ``channels (record_id, sensor_id, ordinal, position, duration_s)``. A channel without a result
    has one of nulls; the recording is as long as its longest channel."""
    rows = channels.join(results, "sensor_id", "left")
    inner = [c for c in rows.columns if c not in ("record_id", "ordinal")]
    out = rows.groupBy("record_id").agg(F.count("*").alias("n_channels"), F.max("duration_s").alias("duration_s"), F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*inner).alias("channel")))).alias("c"))
    return out.select("record_id", "n_channels", "duration_s", F.transform("c", lambda x: x["channel"]).alias("channels"))


def samples_in_clock_window(packed: DataFrame, clocks: DataFrame, fs: float, low_s: float, high_s: float) -> DataFrame:
    """``(record_id, sensor_id, start, x)``: the samples of packed blocks between two times of the recording's clock, both included,
    as one array a block and channel; only blocks that reach into the window are read on. ``clocks`` as of ``on_recording_clock``."""
    size = blocks.size_of(fs)
    first = F.greatest(F.lit(0), F.ceil((low_s - F.col("elapsed_s")) * fs - 1e-6)).cast("long")
    last = F.floor((high_s - F.col("elapsed_s")) * fs + 1e-6).cast("long")
    spans = clocks.select("record_id", "sensor_id", first.alias("first"), last.alias("last")).where("first <= last")
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))))
    rows = packed.join(spans.hint("merge"), ["sensor_id", "block"])
    a, b = F.greatest(F.col("first"), F.col("block") * size), F.least(F.col("last") + 1, F.col("block") * size + F.size("x"))
    rows = rows.where(a < b)
    return rows.select("record_id", "sensor_id", a.alias("start"), F.slice("x", (a - F.col("block") * size + 1).cast("int"), (b - a).cast("int")).alias("x"))
