"""Labelled beat sets and the study of a classifier: record sets, labels through a match, halves of subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept
from .models import BeatClassifier, scored_out_of_fold, subject_folds
from .scoring import best_threshold, binary_score

#: Names of the records to learn from, of those to test on, and of those with a pacemaker, left out of both.
TRAIN = (
    "101", "106", "108", "109", "112", "114", "115", "116", "118", "119", "122", "124", "201", "203", "205", "207", "208", "209", "215", "220", "223", "230",
)
TEST = (
    "100", "103", "105", "111", "113", "117", "121", "123", "200", "202", "210", "212", "213", "214", "219", "221", "222", "228", "231", "232", "233", "234",
)
PACED = ("102", "104", "107", "217")


def record_set(record: Column) -> Column:
    """``train``, ``test`` or ``paced``; null for a record of none."""
    return F.when(record.isin(*TRAIN), "train").when(record.isin(*TEST), "test").when(record.isin(*PACED), "paced")


def transfer_labels(matches: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, sample, y)``: each detected beat of ``matches`` with the label ``y`` of the reference beat it was matched to, 0
    where there is none. Of several reference beats at one sample the largest label counts."""
    labels = reference.groupBy(*keys, F.col("sample").alias("ref_sample")).agg(F.max("y").alias("y"))
    found = matches.where("det_sample is not null").join(labels, [*keys, "ref_sample"], "left")
    return found.select(*keys, F.col("det_sample").alias("sample"), F.coalesce("y", F.lit(0)).alias("y"))


def missed(labelled: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_missed)``: positive reference beats that no detection carries; a classifier never sees them."""
    got = labelled.groupBy(*keys).agg(F.sum("y").alias("got"))
    want = reference.groupBy(*keys).agg(F.sum("y").alias("want"))
    return want.join(got, keys, "left").select(*keys, F.greatest(F.lit(0), F.col("want") - F.coalesce("got", F.lit(0))).cast("long").alias("n_missed"))


def halves(rows: DataFrame, subject: str, beat: str, seed: int = 0) -> DataFrame:
    """``rows`` with ``first_half``: of each subject's n beats, the n // 2 that come first by a seeded digest. Rows are counted
    by the digest's first byte, and only the rows of the byte where the half ends are ordered, so no task orders a subject."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(subject).cast("string"), F.col(beat).cast("string")))
    rows = rows.withColumn("digest", digest).withColumn("byte", F.substring("digest", 1, 2))
    counts = rows.groupBy(subject, "byte").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(subject).orderBy("byte")  # 256 rows a subject
    counts = counts.withColumn("before", F.sum("c").over(upto) - F.col("c")).withColumn("half", F.floor(F.sum("c").over(Window.partitionBy(subject)) / 2))
    counts = counts.select(subject, "byte", (F.col("half") - F.col("before")).alias("room"), (F.col("before") + F.col("c") <= F.col("half")).alias("whole"))
    at = F.row_number().over(Window.partitionBy(subject, "byte").orderBy("digest", beat))
    return rows.join(counts, [subject, "byte"]).withColumn("first_half", F.col("whole") | (at <= F.col("room"))).drop("digest", "byte", "room", "whole")


def trained(rows: DataFrame, columns: list[str], subject: str, least_subjects: int = 5, without: object = None, threshold: float | None = None, folds: int = 4) -> BeatClassifier:
    """A classifier with its operating point, learned from all subjects but ``without``; fewer than ``least_subjects`` are refused.
    The threshold, where none is given, is the one with the best sum of F1 over folds of whole subjects, 0.5 where no fold has
    enough positives; the model and those of its folds are fitted in the same passes."""
    rows = rows if without is None else rows.where(F.col(subject) != F.lit(without))
    n = rows.select(subject).distinct().count()
    if n < least_subjects:
        raise ValueError(f"{n} subjects to learn from, {least_subjects} are needed")
    rows = subject_folds(rows, subject, folds)
    model, *others = BeatClassifier(columns).fit_each(rows, [subject], [-1] if threshold is not None else [-1, *range(folds)])
    best = best_threshold(scored_out_of_fold(rows, others, [subject])).first() if others else None
    model.threshold = threshold if threshold is not None else 0.5 if best is None or best.threshold is None else best.threshold
    return model


def compare_protocols(train: DataFrame, test: DataFrame, columns: list[str], subject: str, beat: str, threshold: float | None = None) -> DataFrame:
    """One row a protocol: ``inter`` has seen no beat of the tested subjects, ``intra`` the first half of them; both are scored on
    the second half, so only that differs."""
    dealt = kept(halves(test, subject, beat))  # both models read it
    known, held = dealt.where("first_half").drop("first_half"), dealt.where("not first_half").drop("first_half")
    out = None
    for name, rows in (("inter", train), ("intra", train.unionByName(known))):
        model = trained(rows, columns, subject, least_subjects=1, threshold=threshold)
        got = model.predict(held, [subject]).select(F.col("y").alias("y_true"), "y_pred")
        part = binary_score(got).select(F.lit(name).alias("protocol"), F.lit(float(model.threshold)).alias("threshold"), "*")
        out = part if out is None else out.unionByName(part)
    return out
