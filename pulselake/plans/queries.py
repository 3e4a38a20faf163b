"""Registered queries: each operator on the driver's tables, results rounded to six digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators.kept import kept
from ..operators import blocks, detect, matching, models, morphology, peaks, protocol, quality, rhythm, scoring, segments, summary
from ..sources import tables
from ..sources.tables import ECG_FS, FS, SIGNAL_FS, beats, beats_at, ecg_source, signal, table
from .analyse import analyse_blocks, labelled_beats

R = lambda c: F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[R(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rr(spark, sf):
    return rhythm.rr_series(beats(spark, sf).select("sensor_id", "beat_idx", "sample"), FS)


def events_of(spark, sf, symbol: str) -> DataFrame:
    return beats(spark, sf).where(F.col("symbol") == symbol).select("sensor_id", "sample")


def durations(spark, sf) -> DataFrame:
    return beats(spark, sf).groupBy("sensor_id").agg((F.max("sample") / float(FS) + 0.0).alias("duration_s"))


def labelled(spark, sf) -> DataFrame:
    return beats(spark, sf).select(exprs.aami_class(F.col("symbol")).alias("y_true"), (F.col("event_id") % 5).cast("int").alias("y_pred"))


def shapes(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("beat_id"), F.col("embedding").cast("array<double>").alias("w"))


def rr_intervals(spark, sf):
    return rounded(rr(spark, sf))


def hrv_metrics(spark, sf):
    return rounded(rhythm.hrv(rr(spark, sf)))


def heart_rate_trend(spark, sf):
    return rounded(rhythm.heart_rate_trend(rr(spark, sf)))


def local_median_rr(spark, sf):
    return rounded(rhythm.local_median(rr(spark, sf)).select("sensor_id", "rr_idx", "local_median"))


def ectopic_candidates(spark, sf):
    return rounded(rhythm.ectopic_candidates(rr(spark, sf)))


def pre_post_ratio(spark, sf):
    return rounded(rhythm.pre_post_ratio(rr(spark, sf)))


def af_windows(spark, sf):
    return rounded(rhythm.af_windows(beats(spark, sf), FS).drop("is_af"))


def ectopic_exclusion(spark, sf):
    out = beats(spark, sf).where("symbol = 'V'").select("sensor_id", "beat_idx")
    return rounded(rhythm.af_windows(beats(spark, sf), FS, excluded=out).select("sensor_id", "w", "n_rr", "nrmssd"))


def af_burden(spark, sf):
    return rounded(rhythm.af_burden(rhythm.af_windows(beats(spark, sf), FS)))


def af_episodes(spark, sf):
    return rhythm.af_episodes(rhythm.af_windows(beats(spark, sf), FS))


def dedupe_peaks(spark, sf):
    return rhythm.dedupe_peaks(beats(spark, sf), 72)


def rr_thinning(spark, sf):
    return rounded(rhythm.thin(rr(spark, sf), F.col("rr_idx"), 20).select("sensor_id", "rr_idx", (F.col("rr_s") * 1000).alias("rr_ms")))


def dropout_segments(spark, sf):
    return segments.segments(signal(spark, sf), SIGNAL_FS)


def usable_segments(spark, sf):
    return segments.usable_segments(segments.segments(signal(spark, sf), SIGNAL_FS), SIGNAL_FS, 1.0).select("sensor_id", "start", "end")


def coverage(spark, sf):
    return rounded(segments.coverage(segments.segments(signal(spark, sf), SIGNAL_FS)))


def kurtosis_windows(spark, sf):
    value = F.when(exprs.finite(F.col("x")), F.col("x"))
    return rounded(quality.windowed(signal(spark, sf), SIGNAL_FS, 2.0).groupBy("sensor_id", "w").agg(quality.excess_kurtosis(value).alias("kurtosis")))


def window_quality_stats(spark, sf):
    return rounded(quality.window_statistics(signal(spark, sf), SIGNAL_FS, 2.0))


def amplitude_instability(spark, sf):
    return rounded(quality.instability(signal(spark, sf), SIGNAL_FS, 3.0))


def artifact_windows(spark, sf):
    return rounded(quality.artefact_windows(signal(spark, sf), SIGNAL_FS, 3.0).select("sensor_id", "w", "score"))


def beats_in_artifact(spark, sf):
    windows = quality.artefact_windows(signal(spark, sf), SIGNAL_FS, 3.0)
    return quality.beats_in_artifact(signal(spark, sf).select("sensor_id", F.col("i").alias("sample")), windows, SIGNAL_FS, 3.0)


def rank_sensors(spark, sf):
    windows = quality.window_statistics(signal(spark, sf), SIGNAL_FS, 2.0).select("sensor_id", (1 - F.col("flat")).alias("sqi"))
    return rounded(quality.rank_sensors(windows))


def welch_quality(spark, sf):
    return rounded(quality.quality_windows(signal(spark, sf), SIGNAL_FS, 3.0))


def overlap_window(spark, sf):
    """Recordings of ten users: origin, end and the stretch that all channels share."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("sensor_id"), tables.micros().alias("us"))
    channels = rows.groupBy("sensor_id").agg(F.min("us").alias("start"), F.max("us").alias("end")).withColumn("record_id", F.col("sensor_id") % 10)
    out = channels.groupBy("record_id").agg(F.count("*").alias("n_channels"), F.min("start").alias("origin_us"), F.max("end").alias("end_us"), F.max("start").alias("a"), F.min("end").alias("b"))
    joint = F.col("b") > F.col("a")
    return out.select("record_id", "n_channels", "origin_us", "end_us", F.when(joint, F.col("a")).otherwise(0).alias("overlap_start"), F.when(joint, F.col("b")).otherwise(0).alias("overlap_end"))


def channel_slice(spark, sf):
    """Samples of seconds [1.25, 4.75), re-indexed from the slice's start, for channels that reach into it."""
    channels = signal(spark, sf).groupBy("sensor_id").agg(F.lit(float(SIGNAL_FS)).alias("fs"), (F.max("i") + 1).alias("n_samples"), F.lit(0).cast("long").alias("start_us"))
    rows, moved = segments.slice_seconds(signal(spark, sf), channels.where("n_samples > 12"), 1.25, 4.75)
    return rounded(rows.where(exprs.finite(F.col("x"))).join(moved.select("sensor_id", "start_us"), "sensor_id"))


def rhythm_intervals(spark, sf):
    transitions = beats(spark, sf).where("symbol in ('N', 'V')").select("sensor_id", "sample", F.col("symbol").alias("label"))
    return matching.rhythm_intervals(transitions, beats(spark, sf).groupBy("sensor_id").agg((F.max("sample") + 1).alias("n_samples")))


def rhythm_asof_label(spark, sf):
    b = beats(spark, sf)
    transitions = b.where("symbol in ('N', 'V')").select("sensor_id", "sample", F.col("symbol").alias("label"))
    return matching.label_as_of(b.where("symbol not in ('N', 'V')").select("sensor_id", "sample"), transitions)


def cross_sensor_agreement(spark, sf):
    rows = beats(spark, sf).select("sensor_id", F.col("symbol").alias("source"), "sample")
    return matching.sensor_agreement(rows, ["sensor_id"], 540)


def ectopic_semi_join(spark, sf):
    out = events_of(spark, sf, "V").distinct()
    return beats(spark, sf).join(out, ["sensor_id", "sample"], "left_semi").groupBy("sensor_id").agg(F.count("*").alias("n"))


def peak_sets(spark, sf):
    """Union, difference and intersection of two annotators' beats: one marks normal and ventricular ones, the other ectopic ones."""
    b = beats(spark, sf)
    one, two = b.where("symbol in ('N', 'V')").select("sensor_id", "sample"), b.where("symbol in ('S', 'V')").select("sensor_id", "sample")
    parts = [d.groupBy("sensor_id").agg(F.count("*").alias("n")).withColumn("op", F.lit(n)) for n, d in (("union", one.union(two).distinct()), ("except", one.subtract(two)), ("intersect", one.intersect(two)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def greedy_match(spark, sf):
    return matching.greedy_match(events_of(spark, sf, "N"), events_of(spark, sf, "S"), ["sensor_id"], 540)


def detection_scores(spark, sf):
    return rounded(matching.detection_scores(greedy_match(spark, sf), ["sensor_id"], FS))


def detection_gross(spark, sf):
    return rounded(matching.gross(matching.detection_scores(greedy_match(spark, sf), ["sensor_id"], FS)))


def bsqi(spark, sf):
    return rounded(matching.bsqi(greedy_match(spark, sf), ["sensor_id"]))


def aami_mapping(spark, sf):
    rows = beats(spark, sf).select("symbol", exprs.aami_class(F.col("symbol")).alias("class_id"))
    return rows.groupBy("symbol", "class_id").agg(F.count("*").alias("n"))


def lead_positions(spark, sf):
    """Lead names made of region names and numbers, and where they sit."""
    rows = table(spark, sf, "nation").select(F.concat(F.lit(" "), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("v"), F.col("n_nationkey").cast("string"))).when(F.col("n_nationkey") % 3 == 1, "ii").otherwise(F.col("n_name")), F.lit(" ")).alias("lead"))
    return rows.select("lead", exprs.lead_position(F.col("lead")).alias("position")).distinct()


def classification_score(spark, sf):
    return rounded(scoring.binary_score(table(spark, sf, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))))


def confusion_matrix(spark, sf):
    return scoring.confusion(labelled(spark, sf))


def multiclass_scores(spark, sf):
    return rounded(scoring.multiclass_scores(labelled(spark, sf)))


def gross_aggregate(spark, sf):
    """Beats and ectopic beats by sensor, and over all (null sensor)."""
    return beats(spark, sf).rollup("sensor_id").agg(F.count("*").alias("n_beats"), F.count_if(F.col("symbol") == "V").alias("n_ectopic"))


def threshold_selection(spark, sf):
    rows = beats(spark, sf).select((F.col("sensor_id") % 4).alias("fold"), (F.col("symbol") == "V").cast("int").alias("y_true"), (F.col("event_id") % 101 / 100.0).alias("score"))
    return rounded(scoring.best_threshold(rows))


def event_histogram(spark, sf):
    return summary.event_histogram(events_of(spark, sf, "V"), durations(spark, sf), FS, 10)


def hourly_histogram(spark, sf):
    scaled = events_of(spark, sf, "V").select("sensor_id", (F.col("sample") * 100).alias("sample"))
    return summary.event_histogram(scaled, durations(spark, sf).select("sensor_id", (F.col("duration_s") * 100).alias("duration_s")), FS, 3600)


def busiest_bin(spark, sf):
    return summary.busiest_bin(event_histogram(spark, sf))


def bin_choice(spark, sf):
    rows = table(spark, sf, "nation").select((F.col("n_nationkey") * 5000).alias("duration_s"))
    width = exprs.bin_seconds(F.col("duration_s"))
    return rows.select("duration_s", width.alias("bin_s"), exprs.bin_label(width).alias("label"))


def events_summary(spark, sf):
    hours = durations(spark, sf).select("sensor_id", (F.col("duration_s") / 3600).alias("hours"))
    return rounded(summary.events_summary(events_of(spark, sf, "V"), beats(spark, sf), hours))


def representative_events(spark, sf):
    return summary.evenly_spaced(events_of(spark, sf, "V"), 5)


def summary_json(spark, sf):
    rows = rhythm.hrv(rr(spark, sf)).select("sensor_id", F.concat(F.lit("<s&"), F.col("sensor_id").cast("string"), F.lit(">")).alias("name"), "n_valid", exprs.round_even(F.col("mean_hr"), 1).alias("mean_hr"))
    return summary.summary_json(rows)


def beat_template(spark, sf):
    out = morphology.templates(shapes(spark, sf))
    return out.select("group", "n_used", F.posexplode("template").alias("pos", "v")).select("group", "n_used", "pos", R("v").alias("v"))


def template_correlation(spark, sf):
    return rounded(morphology.correlations(shapes(spark, sf), morphology.templates(shapes(spark, sf))))


def qrs_width(spark, sf):
    return rounded(morphology.widths(shapes(spark, sf), 64, 32, 12, 3))


def feature_ratios(spark, sf):
    return rounded(morphology.feature_ratios(shapes(spark, sf), (2, 16), (24, 40)))


def median_imputation(spark, sf):
    return rounded(morphology.impute(signal(spark, sf), ["x"], ["sensor_id"]))


def beat_windows(spark, sf):
    """Complete windows of 8 samples around every sample."""
    out = morphology.extract_beats(signal(spark, sf).withColumn("x", F.when(exprs.finite(F.col("x")), F.col("x")).otherwise(-1.0)), signal(spark, sf).select("sensor_id", F.col("i").alias("sample")), 5, 3)
    return out.select("sensor_id", "sample", R(F.get("w", F.lit(0))).alias("first"), R(F.get("w", F.lit(7))).alias("last"), R(F.aggregate("w", F.lit(0.0), lambda s, v: s + v)).alias("total"))


def moving_integration(spark, sf):
    """Slope, square and a moving sum over five samples, zeros beyond the ends."""
    order = quality.by_sample()
    x = exprs.finite(F.col("x"))
    rows = signal(spark, sf).where(x)
    rows = rows.withColumn("i", F.row_number().over(order) - 1)
    before, after = F.lag("x").over(order), F.lead("x").over(order)
    slope = F.when(before.isNull(), after - F.col("x")).when(after.isNull(), F.col("x") - before).otherwise((after - before) / 2) * float(SIGNAL_FS)
    rows = rows.withColumn("slope", slope).withColumn("squared", F.col("slope") * F.col("slope"))
    return rounded(rows.select("sensor_id", "i", "slope", (F.sum("squared").over(order.rowsBetween(-2, 2)) / 5).alias("integrated")))


def refine_extremum(spark, sf):
    """Every sample moved to the largest absolute value within three samples, the first of equals."""
    rows = signal(spark, sf).where(exprs.finite(F.col("x"))).where("sensor_id is not null")
    return peaks.largest_near(rows.select("sensor_id", F.col("i").alias("sample"), F.abs("x").alias("height")), 3)


def upload_ingest(spark, sf):
    """Uploads built from the events, some of them bad, parsed and judged."""
    rows = signal(spark, sf).groupBy("sensor_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    values = F.transform("s", lambda v: F.when(F.isnan(v["x"]), F.lit(None).cast("double")).otherwise(v["x"]))
    channel = F.struct(
        F.concat(F.lit("s"), F.col("sensor_id").cast("string")).alias("sensor_id"), F.when(F.col("sensor_id") % 5 == 1, 0.0).otherwise(float(SIGNAL_FS)).alias("fs"), values.alias("samples"),
        F.lit("chest").alias("position"), F.when(F.col("sensor_id") % 7 == 2, "soon").otherwise("2026-01-01T12:00:00Z").alias("t_start"),
    )
    body = F.to_json(F.struct(F.concat(F.lit("r"), F.col("sensor_id").cast("string")).alias("record_id"), F.array(channel).alias("channels")))
    channels, _ = tables.parse_uploads(rows.select(body.alias("body")))
    return channels.select("record_id", "sensor_id", "n_samples", "problem")


def _found(spark, sf, **how) -> DataFrame:
    packed = ecg_source(spark, sf)
    return detect.detect_in_blocks(packed, detect.whole(packed, ECG_FS), ECG_FS, **how).select("sensor_id", "sample")


def detect_rpeaks(spark, sf):
    return _found(spark, sf)


def chunked_detection(spark, sf):
    return _found(spark, sf, chunk_s=40.0, overlap_s=5.0)


def recovered_beats(spark, sf):
    return _found(spark, sf, recover_missed=True)


def detection_accuracy(spark, sf):
    """Detected beats against the events they were drawn from."""
    truth = table(spark, sf, "events").select(F.col("user_id").alias("sensor_id"), F.round(tables.micros() / 3e10 * ECG_FS).cast("long").alias("sample"))
    found = matching.greedy_match(detect.process_blocks(ecg_source(spark, sf), ECG_FS), truth, ["sensor_id"], round(0.15 * ECG_FS))
    return rounded(matching.detection_scores(found, ["sensor_id"], ECG_FS))


def filtered_signal(spark, sf):
    """Packed blocks of the filtered signal, each with its sum and its largest sample."""
    packed = ecg_source(spark, sf)
    clean = detect.filter_blocks(packed, kept(detect.usable(packed, ECG_FS)), ECG_FS)
    return _block_summary(blocks.packed_of(clean, ECG_FS))


def resampled_signal(spark, sf):
    """Packed blocks of the signal at 250 Hz, as above."""
    return _block_summary(detect.resampled_block_by_block(ecg_source(spark, sf), ECG_FS, 250))


def _block_summary(packed: DataFrame) -> DataFrame:
    good = F.filter("x", lambda v: ~F.isnan(v))
    total = F.aggregate(good, F.lit(0.0), lambda s, v: s + F.abs(v))
    return rounded(packed.select("sensor_id", "block", F.size("x").alias("n"), F.size(good).alias("n_usable"), total.alias("total"), F.array_max(good).alias("highest")))


def analysis(spark, sf):
    return rounded(analyse_blocks(ecg_source(spark, sf), ECG_FS))


def record_sets(spark, sf):
    """Sensors named as records from 100 on, with the set that each record belongs to."""
    record = (F.col("sensor_id") + 99).cast("string")
    named = beats(spark, sf).select("sensor_id", record.alias("record"), protocol.record_set(record).alias("record_set"))
    return named.groupBy("sensor_id", "record", "record_set").agg(F.count("*").alias("n_beats"))


def _reference(spark, sf) -> DataFrame:
    return beats(spark, sf).where("symbol in ('S', 'V')").select("sensor_id", "sample", (F.col("symbol") == "V").cast("int").alias("y"))


def _transferred(spark, sf) -> DataFrame:
    matches = matching.greedy_match(events_of(spark, sf, "N"), _reference(spark, sf).select("sensor_id", "sample"), ["sensor_id"], 540)
    return protocol.transfer_labels(matches, _reference(spark, sf), ["sensor_id"])


def label_transfer(spark, sf):
    """Normal beats as detections, labelled by the ectopic beats that they match."""
    return _transferred(spark, sf)


def missed_beats(spark, sf):
    return protocol.missed(_transferred(spark, sf), _reference(spark, sf), ["sensor_id"])


def subject_halves(spark, sf):
    return protocol.halves(beats(spark, sf).select("sensor_id", "beat_idx"), "sensor_id", "beat_idx")


def protocol_study(spark, sf):
    """Classifiers that have and that have not seen beats of the sensors they are tested on."""
    rows = _labelled_features(spark, sf, (F.col("symbol") == "V").cast("int")).select("sensor_id", "beat_idx", "y", *morphology.BINARY_FEATURES)
    parts = rows.where("sensor_id % 2 = 0"), rows.where("sensor_id % 2 = 1")
    return rounded(protocol.compare_protocols(*parts, list(morphology.BINARY_FEATURES), "sensor_id", "beat_idx"))


def classifiable_beats(spark, sf):
    """Beats of the four classes that are learned, and how many are left out."""
    rows = beats(spark, sf).select("sensor_id", exprs.aami_class(F.col("symbol")).alias("y"))
    return rows.groupBy("sensor_id").agg(F.count_if(F.col("y") < 4).alias("n_kept"), F.count_if(F.col("y") == 4).alias("n_dropped"))


def _maxima(spark, sf) -> DataFrame:
    """Samples higher than both neighbours."""
    x, order = F.col("x"), quality.by_sample()
    rows = signal(spark, sf).where(exprs.finite(x)).withColumns({"a": F.lag("x").over(order), "b": F.lead("x").over(order)})
    return rows.where((x > F.col("a")) & (x > F.col("b"))).select("sensor_id", F.col("i").alias("sample"))


def dominant_peaks(spark, sf):
    """Of the maxima those that stay if the highest goes first and none may be within half a second of a kept one."""
    high = _maxima(spark, sf).join(signal(spark, sf).withColumnRenamed("i", "sample"), ["sensor_id", "sample"])
    return rounded(peaks.dominant(high.select("sensor_id", "sample", F.col("x").alias("height")), 5))


def refractory_pass(spark, sf):
    """Of maxima closer than half a second to the last kept one the higher, in one pass over each sensor."""
    high = _maxima(spark, sf).join(signal(spark, sf).withColumnRenamed("i", "sample"), ["sensor_id", "sample"])
    return rounded(peaks.strongest_of_close(high.select("sensor_id", "sample", F.col("x").alias("height")), 5))


def channel_lookup(spark, sf):
    """The first channel at the wrist of each recording."""
    channels = _channels(spark, sf).select("record_id", "sensor_id", F.col("sensor_id").alias("ordinal"), F.when(F.col("sensor_id") % 4 == 1, "wrist").otherwise("chest").alias("position"), "n_samples")
    return summary.channel_of(channels, position="wrist").select("record_id", "sensor_id", "n_samples")


def baseline_removal(spark, sf):
    """The signal less two running medians, of 200 and 600 ms, with zeros beyond its ends; gaps count as zero."""
    rows = signal(spark, sf).withColumn("x", F.when(exprs.finite(F.col("x")), F.col("x")).otherwise(0.0))
    return rounded(detect.baseline_removed(rows, SIGNAL_FS))


def result_tree(spark, sf):
    """Variability, rhythm and ventricular events of every sensor, nested by recording; what a reader of the tree adds up."""
    hours = durations(spark, sf).select("sensor_id", (F.col("duration_s") / 3600).alias("hours"))
    results = rhythm.hrv(rr(spark, sf)).select("sensor_id", F.struct("n_valid", exprs.round_even(F.col("mean_hr"), 1).alias("mean_hr")).alias("variability"))
    results = results.join(rhythm.af_burden(rhythm.af_windows(beats(spark, sf), FS)).select("sensor_id", F.struct("n_windows", R("burden").alias("burden")).alias("rhythm")), "sensor_id", "full")
    results = results.join(summary.events_summary(events_of(spark, sf, "V"), beats(spark, sf), hours).select("sensor_id", F.struct("n_events", R("burden_pct").alias("burden_pct")).alias("events")), "sensor_id", "full")
    channels = _channels(spark, sf).join(durations(spark, sf), "sensor_id").select("record_id", "sensor_id", F.col("sensor_id").alias("ordinal"), F.lit("chest").alias("position"), "duration_s")
    tree = summary.result_tree(results, channels)
    total = lambda f: F.aggregate("channels", F.lit(0).cast("long"), lambda a, c: a + F.coalesce(f(c), F.lit(0)))
    first = F.get("channels", F.lit(0))
    out = tree.select(
        "record_id", "n_channels", "duration_s", first["sensor_id"].alias("first_sensor"), first["variability"]["mean_hr"].alias("first_hr"), total(lambda c: c["variability"]["n_valid"]).alias("n_valid"),
        total(lambda c: c["rhythm"]["n_windows"]).alias("n_windows"), total(lambda c: c["events"]["n_events"]).alias("n_events"), F.array_join(F.transform("channels", lambda c: c["sensor_id"].cast("string")), ",").alias("sensors"),
    )
    return rounded(out)


def clock_window_samples(spark, sf):
    """Samples between two times of their recording's clock, on which channels start up to a second apart."""
    channels = _channels(spark, sf).withColumn("start_us", F.lit(0).cast("long")).withColumn("fs", F.lit(float(SIGNAL_FS)))
    cut = summary.samples_in_clock_window(blocks.pack(signal(spark, sf), SIGNAL_FS), summary.on_recording_clock(channels), SIGNAL_FS, 1.25, 4.75)
    good = F.filter("x", lambda v: ~F.isnan(v))
    return rounded(cut.select("record_id", "sensor_id", "start", F.size("x").alias("n"), F.size(good).alias("n_finite"), F.aggregate(good, F.lit(0.0), lambda a, v: a + v).alias("total")))


def score_table(spark, sf):
    """Scores of every sensor as a line of text."""
    return scoring.score_lines(matching.detection_scores(greedy_match(spark, sf), ["sensor_id"], FS), "sensor_id")


def confusion_table(spark, sf):
    return scoring.confusion_lines(scoring.confusion(labelled(spark, sf)))


def labelled_detections(spark, sf):
    """Detected beats of the drawn signals with the labels of the events that they match, and their features."""
    reference = beats_at(spark, sf, ECG_FS).select("sensor_id", "sample", (F.col("symbol") == "V").cast("int").alias("y"))
    rows, _ = labelled_beats(ecg_source(spark, sf), reference, ECG_FS)
    return rounded(rows.select("sensor_id", "beat_idx", "sample", "y", *morphology.FEATURES))


def analysis_with_model(spark, sf):
    """The analysis of odd sensors with a classifier that has learned from the detected beats of even ones."""
    packed = ecg_source(spark, sf)
    reference = beats_at(spark, sf, ECG_FS).select("sensor_id", "sample", (F.col("symbol") == "V").cast("int").alias("y"))
    rows, _ = labelled_beats(packed.where("sensor_id % 2 = 0"), reference.where("sensor_id % 2 = 0"), ECG_FS)
    model = protocol.trained(kept(rows.select("sensor_id", "y", *morphology.BINARY_FEATURES)), list(morphology.BINARY_FEATURES), "sensor_id")
    return rounded(analyse_blocks(packed.where("sensor_id % 2 = 1"), ECG_FS, model))


def bin_examples(spark, sf):
    """At most three waveforms of the maxima of each two seconds."""
    shown = signal(spark, sf).withColumn("x", F.when(exprs.finite(F.col("x")), F.col("x")).otherwise(-1.0))
    out = summary.examples_by_bin(shown, _maxima(spark, sf), SIGNAL_FS, 2.0)
    return rounded(out.select("sensor_id", "bin", "t", F.get("y", F.lit(0)).alias("first"), F.get("y", F.lit(7)).alias("last"), F.size("y").alias("n")))


def artifact_mask(spark, sf):
    return quality.artefact_mask(signal(spark, sf), quality.artefact_windows(signal(spark, sf), SIGNAL_FS, 3.0), SIGNAL_FS, 3.0)


def rhythm_mask(spark, sf):
    """Whether each beat lies in a stretch that a ventricular beat opens and the next normal one ends."""
    b = beats(spark, sf)
    transitions = b.where("symbol in ('N', 'V')").select("sensor_id", "sample", F.col("symbol").alias("label"))
    return matching.rhythm_mask(b.select("sensor_id", "sample"), transitions, "V")


def _channels(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("sensor_id"), tables.micros().alias("us"))
    channels = rows.groupBy("sensor_id").agg(F.min("us").alias("start_us"), F.count("*").alias("n_samples"))
    rate = F.when(F.col("sensor_id") % 7 == 2, 250.0).otherwise(360.0)
    return channels.select((F.col("sensor_id") % 10).alias("record_id"), "sensor_id", "start_us", "n_samples", rate.alias("fs"), ((F.col("sensor_id") % 5 - 2) * 0.25).alias("clock_offset_s"))


def clock_window(spark, sf):
    """Beats between two times of their recording's clock, on which channels start up to a second apart."""
    channels = _channels(spark, sf).withColumn("start_us", F.lit(0).cast("long"))
    return rounded(summary.in_clock_window(beats(spark, sf).select("sensor_id", "sample"), summary.on_recording_clock(channels), FS, 20.0, 40.0))


def recordings_overview(spark, sf):
    channels = _channels(spark, sf).select("record_id", F.col("sensor_id").alias("ordinal"), "sensor_id", "fs", F.lit("chest").alias("position"), F.col("n_samples").alias("n_beats"))
    return summary.recording_overview(channels).select("record_id", "n_channels", "primary_sensor", "n_beats", "uniform_rate", "line")


def _windows(spark, sf) -> DataFrame:
    """Each beat with a window of 64 samples at 96 Hz, its peak at 31: the vectors of the embeddings in turn."""
    shapes_of = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    n = shapes_of.agg(F.max("vec_id") + 1).first()[0]
    return beats(spark, sf).withColumn("vec_id", F.col("event_id") % n).join(shapes_of, "vec_id")


def beat_features(spark, sf):
    """The ten features of every beat."""
    return rounded(morphology.beat_features(_windows(spark, sf).select("sensor_id", "beat_idx", "w"), rhythm.local_median(rr(spark, sf)), 96, 31))


def _labelled_features(spark, sf, label) -> DataFrame:
    """Kept in the shared folder, since fitting and predicting read them several times."""
    return kept(_unkept_features(spark, sf, label))


def _unkept_features(spark, sf, label) -> DataFrame:
    return beats(spark, sf).select("sensor_id", "beat_idx", label.alias("y")).join(beat_features(spark, sf), ["sensor_id", "beat_idx"])


def ventricular_classifier(spark, sf):
    """Trained on the beats of even sensors, applied to those of odd ones."""
    rows = _labelled_features(spark, sf, (F.col("symbol") == "V").cast("int")).select("sensor_id", "beat_idx", "y", *morphology.BINARY_FEATURES)
    model = models.BeatClassifier(list(morphology.BINARY_FEATURES)).fit(rows.where("sensor_id % 2 = 0"), ["sensor_id"])
    return model.predict(rows.where("sensor_id % 2 = 1"), ["sensor_id"], 0.5).select("sensor_id", "beat_idx", "y", "y_pred")


def multiclass_classifier(spark, sf):
    """As above for four classes; beats of the fifth are not learned."""
    rows = _labelled_features(spark, sf, exprs.aami_class(F.col("symbol"))).select("sensor_id", "beat_idx", "y", *morphology.MULTICLASS_FEATURES)
    model = models.BeatClassifier(list(morphology.MULTICLASS_FEATURES), {0: 1.0, 1: 8.0, 2: 4.0, 3: 8.0}).fit(rows.where("sensor_id % 2 = 0 and y < 4"), ["sensor_id"])
    return model.predict(rows.where("sensor_id % 2 = 1"), ["sensor_id"]).select("sensor_id", "beat_idx", "y", "y_pred")


def subject_threshold(spark, sf):
    """The threshold that out-of-fold scores of whole sensors choose."""
    rows = _labelled_features(spark, sf, (F.col("symbol") == "V").cast("int")).select("sensor_id", "beat_idx", "y", *morphology.BINARY_FEATURES)
    return rounded(scoring.best_threshold(models.out_of_fold(models.subject_folds(rows, "sensor_id"), list(morphology.BINARY_FEATURES), ["sensor_id"])))


def beat_codes(spark, sf):
    """Annotations that stand for beats, and those that do not."""
    marks = beats(spark, sf).select("sensor_id", F.when(F.col("event_id") % 7 == 3, "+").when(F.col("event_id") % 7 == 5, "~").otherwise(F.col("symbol")).alias("symbol"))
    return marks.groupBy("sensor_id", exprs.is_beat(F.col("symbol")).alias("is_beat")).agg(F.count("*").alias("n"))


def histogram_bars(spark, sf):
    """Centres and widths of the histogram's bars, in minutes."""
    return rounded(summary.bars(event_histogram(spark, sf)))


def channel_clocks(spark, sf):
    """Corrected start and end of each channel, its offset from the recording's origin, and whether all channels of the
    recording have one rate: recordings of ten users, clocks that are up to half a second off."""
    return rounded(summary.on_recording_clock(_channels(spark, sf)))


def sensor_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Beats, share of valid intervals, variability and irregular-rhythm burden of every sensor."""
    series = rr(spark, sf)
    valid = series.groupBy("sensor_id").agg((F.count("*") + 1).alias("n_beats"), F.avg(F.col("valid").cast("double")).alias("valid_share"))
    out = valid.join(rhythm.hrv(series).select("sensor_id", "mean_hr", "sdnn_ms", "rmssd_ms", "pnn50"), "sensor_id", "left")
    return rounded(out.join(rhythm.af_burden(rhythm.af_windows(beats(spark, sf), FS)).select("sensor_id", "burden"), "sensor_id", "left"))


QUERIES = {
    f.__name__: f
    for f in (
        sensor_overview, rr_intervals, hrv_metrics, heart_rate_trend, local_median_rr, ectopic_candidates, pre_post_ratio, af_windows, ectopic_exclusion, af_burden, af_episodes,
        dedupe_peaks, rr_thinning, dropout_segments, usable_segments, coverage, kurtosis_windows, window_quality_stats, amplitude_instability, artifact_windows, beats_in_artifact, rank_sensors,
        welch_quality, overlap_window, channel_slice, rhythm_intervals, rhythm_asof_label, cross_sensor_agreement, ectopic_semi_join, peak_sets, greedy_match, detection_scores, detection_gross,
        bsqi, aami_mapping, lead_positions, classification_score, confusion_matrix, multiclass_scores, gross_aggregate, threshold_selection, event_histogram, hourly_histogram, busiest_bin,
        bin_choice, events_summary, representative_events, summary_json, beat_template, template_correlation, qrs_width, feature_ratios, median_imputation, beat_windows, moving_integration,
        refine_extremum, upload_ingest, detect_rpeaks, chunked_detection, recovered_beats, filtered_signal, resampled_signal, analysis, beat_features, ventricular_classifier, multiclass_classifier,
        subject_threshold, beat_codes, histogram_bars, channel_clocks, detection_accuracy, record_sets, label_transfer, missed_beats, subject_halves, protocol_study, classifiable_beats, bin_examples,
        artifact_mask, rhythm_mask, clock_window, recordings_overview, dominant_peaks, refractory_pass, channel_lookup, baseline_removal, result_tree,
        clock_window_samples, score_table, confusion_table, labelled_detections, analysis_with_model,
    )
}
