"""Classifiers on separable clusters, folds of whole subjects, features of known beats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import models, morphology, rhythm


def clusters(spark, centres, n=60):
    rng = np.random.default_rng(7)
    rows = [(int(s), int(k), *map(float, np.array(c) + 0.3 * rng.normal(size=2))) for k, c in enumerate(centres) for s in range(6) for _ in range(n // 6)]
    rows += [(0, 0, float("nan"), 0.1), (0, None, 0.0, 0.0)]
    return spark.createDataFrame(rows, "subject long, y int, a double, b double")


def test_binary_classifier_separates_and_ranks_its_coefficients(spark):
    rows = clusters(spark, [(0, 0), (4, 0.5)])
    model = models.BeatClassifier(["a", "b"]).fit(rows, ["subject"])
    got = model.predict(rows, ["subject"], 0.5).where("y is not null").collect()
    assert np.mean([r.y == r.y_pred for r in got]) >= 0.98 and len(got) == 121
    (_, first, weight), (_, second, _) = model.coefficients()
    assert (first, second) == ("a", "b") and weight > 0
    with pytest.raises(RuntimeError):
        models.BeatClassifier(["a"]).predict(rows, ["subject"])


def test_multiclass_classifier_separates(spark):
    rows = clusters(spark, [(0, 0), (4, 0), (0, 4)])
    got = models.BeatClassifier(["a", "b"], {0: 1.0, 1: 8.0, 2: 4.0}).fit(rows, ["subject"]).predict(rows, ["subject"]).where("y is not null").collect()
    assert np.mean([r.y == r.y_pred for r in got]) >= 0.98
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in got)


def test_folds_hold_whole_subjects_out(spark):
    rows = models.subject_folds(clusters(spark, [(0, 0), (4, 0.5)]).where("y is not null"), "subject", folds=2)
    assert rows.groupBy("subject").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    got = models.out_of_fold(rows, ["a", "b"], ["subject"], folds=2).collect()
    assert len(got) == 121 and np.mean([(r.score >= 0.5) == bool(r.y_true) for r in got]) >= 0.95


def test_features_of_equal_beats_and_one_that_differs(spark):
    wave = np.exp(-0.5 * ((np.arange(64) - 31) / 2.0) ** 2) + 0.2 * np.exp(-0.5 * ((np.arange(64) - 13) / 3.0) ** 2)
    wide = 2 * np.exp(-0.5 * ((np.arange(64) - 31) / 5.0) ** 2)
    beats = [(1, k, (wide if k == 7 else wave).tolist()) for k in range(12)]
    rr = spark.createDataFrame([(1, k, 0.5 if k == 6 else 1.5 if k == 7 else 1.0) for k in range(11)], "sensor_id long, rr_idx long, rr_s double").withColumn("t_s", F.col("rr_idx") * 1.0).withColumn("valid", F.lit(True))
    got = {r.beat_idx: r for r in morphology.beat_features(spark.createDataFrame(beats, "sensor_id long, beat_idx long, w array<double>"), rhythm.local_median(rr), 96, 31).collect()}
    usual, odd = got[3], got[7]
    assert usual.template_corr == pytest.approx(1) and usual.p_corr == pytest.approx(1)
    assert [usual[c] for c in ("qrs_energy", "r_amp_ratio", "width_ratio", "p_energy_ratio", "pre_rr_ratio", "post_rr_ratio")] == pytest.approx([1] * 6)
    assert odd.width_ratio > 1.2 and odd.r_amp_ratio == pytest.approx(2, rel=0.01) and odd.qrs_energy > 4 and odd.template_corr < 0.95 and odd.p_energy_ratio < 1
    assert (odd.pre_rr_ratio, odd.post_rr_ratio) == (0.5, 1.5)
    assert got[0].pre_rr_ratio is None and got[11].post_rr_ratio is None


def objective_gradient(rows, model, classes):
    """Gradient of the penalised, weighted loss at a model's coefficients, straight from the definition."""
    y = np.array([r.y for r in rows])
    x = np.array([[r.a, r.b] for r in rows])
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
    weight = np.array([len(y) / (len(classes) * (y == k).sum()) for k in classes])[np.searchsorted(classes, y)]
    score = z @ model.lines.T
    if len(classes) == 2:
        off = 1 / (1 + np.exp(-score[:, 0])) - (y == classes[1])
        return (weight * off) @ z + np.append(model.lines[0, :-1], 0)
    p = np.exp(score - score.max(axis=1, keepdims=True))
    off = p / p.sum(axis=1, keepdims=True) - (y[:, None] == np.array(classes))
    return (weight[:, None] * off).T @ z + np.column_stack([model.lines[:, :-1], np.zeros(len(classes))])


@pytest.mark.parametrize("centres", [[(0, 0), (1, 0.5)], [(0, 0), (1, 0), (0, 1)]])
def test_coefficients_are_the_minimum(spark, centres):
    rows = clusters(spark, centres).where("y is not null and not isnan(a)")
    model = models.BeatClassifier(["a", "b"]).fit(rows, ["subject"])
    assert np.abs(objective_gradient(rows.collect(), model, list(range(len(centres))))).max() < 1e-7
    again = models.BeatClassifier(["a", "b"]).fit(rows.repartition(7), ["subject"])
    assert np.abs(again.lines - model.lines).max() < 1e-9


def test_folds_fitted_together_equal_models_fitted_alone(spark):
    rows = models.subject_folds(clusters(spark, [(0, 0), (1, 0.5)]).where("y is not null"), "subject", folds=3)
    together = models.BeatClassifier(["a", "b"]).fit_each(rows, ["subject"], [-1, 0, 1, 2])
    for skip, model in zip((-1, 0, 1, 2), together, strict=True):
        alone = models.BeatClassifier(["a", "b"]).fit(rows.where(F.col("fold") != skip).drop("fold"), ["subject"])
        assert np.abs(alone.lines - model.lines).max() < 1e-8


@pytest.mark.parametrize("centres", [[(0, 0), (4, 0.5)], [(0, 0), (4, 0), (0, 4)]])
def test_saved_model_predicts_alike_in_a_new_session(spark, centres, tmp_path):
    rows = clusters(spark, centres)
    model = models.BeatClassifier(["a", "b"]).fit(rows, ["subject"])
    model.threshold = 0.3 if len(centres) == 2 else None
    model.save(spark, f"file://{tmp_path}/model")
    other = spark.newSession()
    loaded = models.BeatClassifier.load(other, f"file://{tmp_path}/model")
    assert loaded.threshold == model.threshold and loaded.classes == model.classes
    key = lambda r: repr(r)
    got = sorted((tuple(r) for r in loaded.predict(rows, ["subject"]).drop("a", "b").collect()), key=key)
    assert got == sorted((tuple(r) for r in model.predict(rows, ["subject"]).drop("a", "b").collect()), key=key)


def test_one_class_is_certain_and_no_rows_are_refused(spark):
    rows = clusters(spark, [(0, 0), (4, 0.5)]).where("y is not null")
    first, second = models.BeatClassifier(["a", "b"]).fit_each(rows.withColumn("fold", F.col("y")), ["subject"], [0, 1])
    assert rows.select(F.get(first.probabilities(), F.lit(1)).alias("p")).agg(F.min("p")).first()[0] > 0.999
    assert rows.where("not isnan(a)").select(F.get(second.probabilities(), F.lit(1)).alias("p")).agg(F.max("p")).first()[0] < 0.001
