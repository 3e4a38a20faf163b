"""Weighted beat classifiers: imputation, scaling with the population deviation, L2 logistic regression by Newton's method.

Rows are never moved to fit a model: a pass sums gradient and Hessian of the loss in every partition, as numpy matrices of
its batches, and Spark adds these sums up; the driver solves a system of (columns + 1) a class. Any number of models that
leave out one fold each is fitted in the same passes. A model is a table of numbers, a row a class and column, and scores
rows by a column expression, so nothing but numbers enters a plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import kept
from .morphology import impute

TABLE = "class int, column string, mean double, deviation double, coefficient double, threshold double"
INTERCEPT = "(intercept)"
#: The log odds of a class that is the only one in the training rows.
CERTAIN = 36.0


def _partial_sums(columns: int, skip: list[int], mean, deviation, weight, beta, classes: list[int]):
    """Sums of a partition for each model: loss, gradient and Hessian, one after the other. ``beta`` is (model, rows of
    coefficients, columns + 1): one row of coefficients for two classes, one a class for more."""
    schema = pa.schema([("model", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches):
        models, lines, wide = beta.shape
        loss, gradient = np.zeros(models), np.zeros((models, lines, wide))
        hessian = np.zeros((models, lines, wide, lines, wide))
        for batch in batches:
            fold, y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            label, x = np.searchsorted(classes, y), np.stack(x, axis=1).reshape(-1, columns)
            for m in range(models):
                own = fold != skip[m]
                z = np.column_stack([(x[own] - mean[m]) / deviation[m], np.ones(own.sum())])
                at, w = label[own], weight[m][label[own]]
                score = z @ beta[m].T
                if lines == 1:
                    score = np.column_stack([np.zeros(len(score)), score[:, 0]])
                top = score.max(axis=1, initial=0.0, keepdims=True)
                e = np.exp(score - top)
                p = e / e.sum(axis=1, keepdims=True)
                loss[m] += (w * (np.log(e.sum(axis=1)) + top[:, 0] - score[np.arange(len(at)), at])).sum()
                off = p - (at[:, None] == np.arange(p.shape[1]))
                p, off = (p[:, 1:], off[:, 1:]) if lines == 1 else (p, off)
                gradient[m] += (w[:, None] * off).T @ z
                for a in range(lines):
                    for b in range(lines):
                        hessian[m, a, :, b] += (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
        flat = np.concatenate([loss[:, None], gradient.reshape(models, -1), hessian.reshape(models, -1)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(models), pa.int32()), pa.array(flat.tolist(), pa.list_(pa.float64()))], schema=schema)

    return run


def _added(sums: DataFrame, models: int, cells: int) -> np.ndarray:
    """Sums over partitions, (model, cell): as many rows reach the driver as all models have cells."""
    rows = sums.select("model", F.posexplode("sums").alias("cell", "v")).groupBy("model", "cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((models, cells))
    for r in rows:
        out[r.model, r.cell] = r.v
    return out


def _statistics(clean: DataFrame, columns: list[str], skip: list[int], classes: list[int], by_fold: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and population deviation of each column and the number of rows a class, for each model."""
    mean, deviation, counts = [], [], []
    for out in skip:
        own = [r for r in by_fold if r.fold != out]
        n = np.array([r.n for r in own], float)
        mid = np.array([[r[f"m_{c}"] for c in columns] for r in own]).reshape(-1, len(columns))
        square = np.array([[r[f"v_{c}"] for c in columns] for r in own]).reshape(-1, len(columns))
        total = max(n.sum(), 1)
        m = n @ mid / total
        d = np.sqrt(n @ (square + (mid - m) ** 2) / total)
        mean.append(m)
        deviation.append(np.where(d > 0, d, 1.0))
        counts.append([n[[r.y == k for r in own]].sum() for k in classes])
    return np.array(mean), np.array(deviation), np.array(counts)


class BeatClassifier:
    """``weights``: a weight a class, or ``balanced`` (n / (classes * n of the class)). ``c`` is the inverse strength of the penalty on
    the weighted sum of losses; the intercept has none. ``lines`` are the coefficients: one line for two classes, else one a class."""

    def __init__(self, columns: list[str], weights: dict[int, float] | str = "balanced", c: float = 1.0, most_iterations: int = 50):
        self.columns, self.weights, self.c, self.most_iterations = columns, weights, c, most_iterations
        self.classes: list[int] = []
        self.lines = self.mean = self.deviation = None
        self.threshold: float | None = None  # the operating point that ``predict`` takes where it is given none

    def fit(self, rows: DataFrame, by: list[str]) -> BeatClassifier:
        (model,) = self.fit_each(rows.withColumn("fold", F.lit(0)), by, [-1])
        self.__dict__.update(model.__dict__)
        return self

    def fit_each(self, rows: DataFrame, by: list[str], skip: list[int]) -> list[BeatClassifier]:
        """A model for each of ``skip``, without the rows of that ``fold`` (-1: with all), all in the same passes."""
        labelled = rows.where(F.col("y").isNotNull())
        clean = kept(impute(labelled, self.columns, by).select(F.col("fold").cast("int").alias("fold"), F.col("y").cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in self.columns]))
        moments = [f(c).alias(f"{n}_{c}") for c in self.columns for n, f in (("m", F.avg), ("v", F.var_pop))]
        by_fold = clean.groupBy("fold", "y").agg(F.count("*").alias("n"), *moments).collect()  # a row a fold and class
        classes = sorted({r.y for r in by_fold})
        mean, deviation, counts = _statistics(clean, self.columns, skip, classes, by_fold)
        present = counts > 0
        if self.weights == "balanced":
            weight = counts.sum(axis=1, keepdims=True) / np.maximum(present.sum(axis=1, keepdims=True) * np.maximum(counts, 1), 1)
        else:
            weight = np.tile([float(self.weights.get(k, 1.0)) for k in classes], (len(skip), 1))
        lines, wide = (1 if len(classes) <= 2 else len(classes)), len(self.columns) + 1
        solved = self._newton(clean, skip, mean, deviation, weight, classes, lines, wide)
        out = []
        for m in range(len(skip)):
            model = BeatClassifier(self.columns, self.weights, self.c, self.most_iterations)
            model.classes, model.mean, model.deviation, model.lines = classes, mean[m], deviation[m], solved[m]
            if present[m].sum() == 1:  # no loss to weigh: the only class is certain
                model.lines = np.zeros((lines, wide))
                only = int(np.flatnonzero(present[m])[0])
                model.lines[only if lines > 1 else 0, -1] = CERTAIN if lines > 1 or only == 1 or len(classes) == 1 else -CERTAIN
            out.append(model)
        return out

    def _newton(self, clean, skip, mean, deviation, weight, classes, lines, wide) -> np.ndarray:
        """Coefficients of all models; a step that makes the loss larger is halved."""
        models, size = len(skip), lines * wide
        beta, step, last = np.zeros((models, lines, wide)), np.zeros((models, size)), np.full(models, np.inf)
        penalty = np.tile(np.append(np.full(wide - 1, 1 / self.c), 0.0), lines)
        if len(classes) < 2:
            return beta
        for _ in range(self.most_iterations):
            sums = clean.mapInArrow(_partial_sums(len(self.columns), skip, mean, deviation, weight, beta, classes), "model int, sums array<double>")
            cells = _added(sums, models, 1 + size + size * size)
            moved = False
            for m in range(models):
                flat = beta[m].reshape(-1)
                loss = cells[m, 0] + 0.5 * (penalty * flat * flat).sum()
                if loss > last[m] * (1 + 1e-12):
                    step[m] /= 2
                    beta[m] = (flat - step[m]).reshape(lines, wide)
                    moved |= bool(np.abs(step[m]).max() > 1e-10)
                    continue
                last[m] = loss
                gradient = cells[m, 1 : 1 + size] + penalty * flat
                hessian = cells[m, 1 + size :].reshape(size, size) + np.diag(penalty)
                step[m] = -np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]  # with a line a class, a shift of all intercepts changes nothing
                beta[m] = (flat + step[m]).reshape(lines, wide)
                moved |= bool(np.abs(step[m]).max() > 1e-10)
            if not moved:
                break
        return beta

    def probabilities(self) -> Column:
        """An array with the probability of each class from 0 to the largest one learned, of rows that hold ``columns``."""
        if self.lines is None:
            raise RuntimeError("the classifier is not fitted")
        scaled = [(F.col(c) - float(m)) / float(d) for c, m, d in zip(self.columns, self.mean, self.deviation, strict=True)]
        score = [sum((z * float(v) for z, v in zip(scaled, line, strict=False)), F.lit(float(line[-1]))) for line in self.lines]
        if len(score) == 1:
            p = [1 / (1 + F.exp(score[0])), 1 / (1 + F.exp(-score[0]))] if len(self.classes) == 2 else [F.lit(1.0)]
        else:
            p = [1 / sum((F.exp(other - own) for other in score), F.lit(0.0)) for own in score]
        at = dict(zip(self.classes, p, strict=True))
        return F.array(*[at.get(k, F.lit(0.0)) for k in range(self.classes[-1] + 1)])

    def predict(self, rows: DataFrame, by: list[str], threshold: float | None = None) -> DataFrame:
        """``rows`` with ``probabilities`` and ``y_pred``; missing values come from the predicted batch's own medians."""
        out = impute(rows, self.columns, by).withColumn("probabilities", self.probabilities())
        threshold = self.threshold if threshold is None else threshold
        likeliest = (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")
        return out.withColumn("y_pred", likeliest if threshold is None else (F.get("probabilities", F.lit(1)) >= threshold).cast("int"))

    def coefficients(self) -> list[tuple[int, str, float]]:
        """(class, column, coefficient), largest absolute value first within a class; of two classes the second one's."""
        named = self.classes if len(self.lines) > 1 else [0]
        rows = [(k, c, float(v)) for k, line in zip(named, self.lines, strict=True) for c, v in zip(self.columns, line, strict=False)]
        return sorted(rows, key=lambda r: (r[0], -abs(r[2])))

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as ``TABLE``: a row a line of coefficients and column, and one for each line's intercept."""
        named = self.classes if len(self.lines) > 1 else self.classes[-1:]
        at = self.threshold
        rows = [(k, c, float(m), float(d), float(v), at) for k, line in zip(named, self.lines, strict=True) for c, m, d, v in zip(self.columns, self.mean, self.deviation, line, strict=False)]
        rows += [(k, INTERCEPT, 0.0, 1.0, float(line[-1]), at) for k, line in zip(named, self.lines, strict=True)]
        if len(self.lines) == 1 and len(self.classes) == 2:
            rows.append((self.classes[0], INTERCEPT, 0.0, 1.0, 0.0, at))  # says which class the other one is
        return spark.createDataFrame(rows, TABLE)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BeatClassifier:
        """The model that ``save`` wrote: its operating point and every number of it."""
        rows = spark.read.parquet(path).collect()  # a row a coefficient
        columns = list(dict.fromkeys(r.column for r in rows if r.column != INTERCEPT))
        model = cls(columns)
        model.classes = sorted({r["class"] for r in rows})
        value = {(r["class"], r.column): r for r in rows}
        named = [k for k in model.classes if columns and (k, columns[0]) in value]
        model.mean, model.deviation = (np.array([value[named[0], c][f] for c in columns]) for f in ("mean", "deviation"))
        model.lines = np.array([[value[k, c].coefficient for c in [*columns, INTERCEPT]] for k in named])
        model.threshold = rows[0].threshold
        return model


def subject_folds(rows: DataFrame, subject: str, folds: int = 4, seed: int = 0) -> DataFrame:
    """``rows`` with ``fold``: subjects dealt out by a seeded hash, whole subjects together."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(subject)), F.lit(folds)).cast("int"))


def out_of_fold(rows: DataFrame, columns: list[str], by: list[str], folds: int = 4) -> DataFrame:
    """``(fold, y_true, score)``: every subject scored by a model of the other folds; all models are fitted in the same passes."""
    return scored_out_of_fold(rows, BeatClassifier(columns).fit_each(rows, by, list(range(folds))), by)


def scored_out_of_fold(rows: DataFrame, models: list[BeatClassifier], by: list[str]) -> DataFrame:
    """As above, by models of which number k has not seen fold k."""
    score = F.lit(None).cast("double")
    for k, model in enumerate(models):
        score = F.when(F.col("fold") == k, F.get(model.probabilities(), F.lit(1))).otherwise(score)
    return impute(rows, models[0].columns, by).select("fold", F.col("y").alias("y_true"), score.alias("score"))
