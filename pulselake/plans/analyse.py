"""The whole analysis of recordings as one Spark job: one row a sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bin_seconds
from ..operators.kept import kept
from ..operators import blocks, detect, matching, models, morphology, protocol, quality, rhythm, segments, summary


def beats_of(packed: blocks.Blocks, usable: DataFrame, fs: float) -> tuple[DataFrame, DataFrame]:
    """``(sensor_id, beat_idx, sample)`` of the detector and ``(sensor_id, sample)`` of the second one, from one pass over the
    filtered chunks of the ``usable`` stretches that is kept in the shared folder, since all that follows reads it."""
    found = kept(detect.detect_in_blocks(packed, usable, fs, ("adaptive", "slope")))
    order = F.row_number().over(rhythm.Window.partitionBy("sensor_id").orderBy("sample")) - 1
    beats = found.where("method = 'adaptive'").select("sensor_id", order.cast("long").alias("beat_idx"), "sample")
    return beats, found.where("method = 'slope'").select("sensor_id", "sample")


def features_of(clean: blocks.Blocks, beats: DataFrame, fs: float, longest: int = morphology.LONGEST_HELD) -> DataFrame:
    """``beats (sensor_id, beat_idx, sample, whole numbers)`` with the features of every beat with a complete window of the filtered signal. Windows of
    stored blocks, and of sensors too long for one task, are rows; others stay in the task that makes them."""
    before, after = round(morphology.BEFORE_S * fs), round(morphology.AFTER_S * fs)
    if isinstance(clean, blocks.Source):
        long = kept(blocks.lengths(clean, fs).where(F.col("n") > longest).select("sensor_id"))
        if long.isEmpty():
            return morphology.features_in_blocks(clean, beats, fs, before, after)
        short = morphology.features_in_blocks(clean, beats.join(long, "sensor_id", "left_anti"), fs, before, after)
        return short.unionByName(_features_by_row(clean, beats.join(long, "sensor_id", "left_semi"), fs, before, after))
    return _features_by_row(clean, beats, fs, before, after)


def _features_by_row(clean: blocks.Blocks, beats: DataFrame, fs: float, before: int, after: int) -> DataFrame:
    windows = morphology.windows_in_blocks(clean, beats, fs, before, after).join(beats.select("sensor_id", "beat_idx", "sample"), ["sensor_id", "sample"])
    found = morphology.beat_features(windows.select("sensor_id", "beat_idx", "w"), rhythm.local_median(rhythm.rr_series(beats, fs)), fs, before)
    return found.join(beats, ["sensor_id", "beat_idx"])


def labelled_beats(packed: blocks.Blocks, reference: DataFrame, fs: float, detected: bool = True, tolerance_s: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Beats to learn from: ``(sensor_id, beat_idx, sample, y)`` and the features, of the beats of packed blocks that the detector
    finds, labelled by the ``reference (sensor_id, sample, y)`` beats that they match, or of the reference beats themselves; and
    ``(sensor_id, n_missed)``, the positive reference beats that no detection carries. Beats without a complete window are left out."""
    usable = kept(detect.usable(packed, fs))
    if detected:
        found = detect.detect_in_blocks(packed, usable, fs).select("sensor_id", "sample")
        matches = matching.greedy_match(found, reference.select("sensor_id", "sample"), ["sensor_id"], round(tolerance_s * fs))
        beats = kept(protocol.transfer_labels(matches, reference, ["sensor_id"]))
    else:
        beats = reference.groupBy("sensor_id", "sample").agg(F.max("y").alias("y"))
    order = F.row_number().over(rhythm.Window.partitionBy("sensor_id").orderBy("sample")) - 1
    rows = features_of(detect.filter_blocks(packed, usable, fs), beats.select("sensor_id", order.cast("long").alias("beat_idx"), "sample", "y"), fs)
    return rows, protocol.missed(beats, reference, ["sensor_id"])


def classified(clean: blocks.Blocks, beats: DataFrame, fs: float, model: models.BeatClassifier | None) -> DataFrame:
    """``(sensor_id, beat_idx, sample)`` of the ventricular beats: those that a model of two classes says so of, or, without one,
    those between a short interval and a long one."""
    if model is None:
        found = rhythm.ectopic_candidates(rhythm.rr_series(beats, fs)).select("sensor_id", (F.col("rr_idx") + 1).alias("beat_idx"))
        return beats.join(found, ["sensor_id", "beat_idx"], "left_semi").select("sensor_id", "beat_idx", "sample")
    rows = kept(features_of(clean, beats, fs).select("sensor_id", "beat_idx", "sample", *model.columns))  # the medians of missing values read it too
    return model.predict(rows, ["sensor_id"]).where("y_pred = 1").select("sensor_id", "beat_idx", "sample")


def analyse(signal: DataFrame, fs: float, model: models.BeatClassifier | None = None, n_examples: int = 6) -> DataFrame:
    """``analyse_blocks`` of ``signal (sensor_id, i, x)``, a row a sample."""
    return analyse_blocks(blocks.pack(signal, fs), fs, model, n_examples)


def analyse_blocks(packed: blocks.Blocks, fs: float, model: models.BeatClassifier | None = None, n_examples: int = 6) -> DataFrame:
    """Coverage, quality, beats, variability, artefacts, rhythm and ventricular events of packed blocks, with the events' busiest
    bin and at most ``n_examples`` of their waveforms. Without a ``model`` of beats, ventricular ones are told by their intervals.
    Rhythm is judged without ventricular beats, whose irregularity would look like fibrillation."""
    packed = packed if isinstance(packed, blocks.Source) else kept(packed)
    windows = kept(quality.windows_in_blocks(packed, fs))
    found = kept(segments.segments_of(packed, fs))
    usable = segments.usable_segments(found, fs, 1.0).select("sensor_id", "start", "end")
    beats, second = beats_of(packed, usable, fs)
    rr = rhythm.rr_series(beats, fs)
    n_win = round(10 * fs)
    keyed = [d.select("sensor_id", "sample", F.floor(F.col("sample") / n_win).alias("w")) for d in (beats, second)]
    agreement = matching.bsqi(matching.greedy_match(*keyed, ["sensor_id", "w"], round(0.15 * fs)), ["sensor_id", "w"])
    artefacts = quality.artefacts_in_blocks(packed, fs, agreement=agreement, windows=windows)
    inside = quality.beats_in_artifact(beats, artefacts, fs).groupBy("sensor_id").agg(F.count_if("in_artifact").alias("beats_in_artifact"))
    covered = segments.coverage(found)
    clean = detect.filter_blocks(packed, usable, fs)  # features and examples read it
    clean = clean if isinstance(clean, blocks.Source) else kept(clean)
    events = kept(classified(clean, beats, fs, model))
    irregular = rhythm.af_windows(beats, fs, excluded=events.select("sensor_id", "beat_idx"))
    episodes = rhythm.af_episodes(irregular).groupBy("sensor_id").agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s"))).alias("af_episodes"))  # runs of windows
    durations = covered.select("sensor_id", (F.col("total") / float(fs)).alias("duration_s"))
    hours = covered.select("sensor_id", (F.col("usable") / float(fs) / 3600).alias("hours"))
    histogram = summary.event_histogram(events, durations, fs, bin_seconds(F.col("duration_s")))
    busiest = summary.busiest_bin(histogram).select("sensor_id", F.when(F.col("n") > 0, F.col("bin")).alias("busiest_bin"))
    burden = summary.events_summary(events, beats, hours).select("sensor_id", "n_events", "burden_pct", "per_hour", "is_extrapolated")
    shapes = summary.representative_beats(clean, events, fs, n_examples)
    examples = shapes.groupBy("sensor_id").agg(F.sort_array(F.collect_list(F.struct("sample", F.transform("w", lambda v: F.round(v, 4)).alias("w")))).alias("examples"))  # n_examples rows
    out = covered.select("sensor_id", F.col("fraction").alias("coverage"), "n_gaps")
    parts = (
        beats.groupBy("sensor_id").agg(F.count("*").alias("n_beats")), rhythm.hrv(rr), rhythm.af_burden(irregular).select("sensor_id", F.col("burden").alias("af_burden")), episodes,
        inside, quality.rank_sensors(quality.quality_in_blocks(packed, fs, windows=windows)), burden, busiest, examples,
    )
    for part in parts:
        out = out.join(part, "sensor_id", "left")
    return out
