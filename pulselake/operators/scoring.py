"""Classification scores from labels and predictions ``(y_true, y_pred)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import CLASS_NAMES, ratio, round_even, scores


def binary_score(rows: DataFrame) -> DataFrame:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    out = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return out.select("*", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(rows: DataFrame) -> DataFrame:
    """All 25 cells, rows by truth; other class numbers are left out."""
    classes = rows.sparkSession.range(5)
    cells = classes.select(F.col("id").cast("int").alias("y_true")).crossJoin(classes.select(F.col("id").cast("int").alias("y_pred")))  # 25 rows
    counted = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return cells.join(counted, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def multiclass_scores(rows: DataFrame) -> DataFrame:
    """One class against the rest, for the classes that occur in the truth; from the 25 cells alone."""
    cells = confusion(rows)
    sides = cells.select(F.explode(F.array(F.struct(F.col("y_true").alias("k"), "n", F.lit("t").alias("s")), F.struct(F.col("y_pred").alias("k"), "n", F.lit("p").alias("s")))).alias("c"), (F.col("y_true") == F.col("y_pred")).alias("same"))
    n, side = F.col("c.n"), F.col("c.s")
    out = sides.groupBy(F.col("c.k").alias("class_id")).agg(
        F.sum(F.when((side == "t") & F.col("same"), n).otherwise(0)).alias("tp"), F.sum(F.when((side == "p") & ~F.col("same"), n).otherwise(0)).alias("fp"), F.sum(F.when((side == "t") & ~F.col("same"), n).otherwise(0)).alias("fn")
    )
    name = F.get(F.array(*[F.lit(c) for c in CLASS_NAMES]), F.col("class_id"))
    return out.where(F.col("tp") + F.col("fn") > 0).select("class_id", name.alias("class"), "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(rows: DataFrame, low: float = 0.30, step: float = 0.02, count: int = 33, least_positives: int = 5) -> DataFrame:
    """The threshold of a grid with the largest sum of F1 over folds ``(fold, y_true, score)``, the first of equals; folds
    with too few positives are left out. A score is counted once, in its grid cell, and summed from above."""
    cell = F.least(F.lit(count - 1), F.floor((F.col("score") - low) / step + 1e-9)).cast("int")
    cells = rows.groupBy("fold", cell.alias("cell")).agg(F.sum(F.col("y_true").cast("long")).alias("pos"), F.count("*").alias("n"))
    folds = cells.groupBy("fold").agg(F.sum("pos").alias("all_pos"), F.collect_list(F.struct("cell", "pos", "n")).alias("c")).where(F.col("all_pos") >= least_positives)  # one row a cell
    grid = folds.select("fold", "all_pos", "c", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("g"))
    above = F.filter("c", lambda c: c["cell"] >= F.col("g"))
    tp = F.aggregate(above, F.lit(0).cast("long"), lambda a, c: a + c["pos"])
    taken = F.aggregate(above, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    f1 = F.coalesce(2.0 * tp / F.nullif(taken + F.col("all_pos"), F.lit(0)), F.lit(0.0))
    sums = grid.select("g", f1.alias("f1")).groupBy("g").agg(F.sum("f1").alias("f1"))
    best = sums.agg(F.max(F.struct("f1", (-F.col("g")).alias("g"))).alias("b"))
    return best.select((low + step * -F.col("b.g")).alias("threshold"), F.col("b.f1").alias("f1_sum"))


def score_lines(scores_of: DataFrame, key: str) -> DataFrame:
    """``(key, line)``: counts and percentages of ``detection_scores`` as a line of text; what is undefined is a dash."""
    share = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f%%", round_even(F.col(c), 2))).otherwise("-")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    percent = lambda part, whole, name: ratio(100.0 * part, whole).alias(name)  # noqa: E731  one division, as in the SQL
    rows = scores_of.select(key, "tp", "fp", "fn", "mean_error_ms", percent(tp, tp + fn, "se"), percent(tp, tp + fp, "ppv"), percent(2 * tp, 2 * tp + fp + fn, "f1"))
    error = F.when(F.col("mean_error_ms").isNotNull(), F.format_string("%.1f", round_even(F.col("mean_error_ms"), 1))).otherwise("-")
    text = F.concat_ws(" ", F.format_string("%s: tp %d fp %d fn %d", F.col(key).cast("string"), "tp", "fp", "fn"), F.lit("se"), share("se"), F.lit("ppv"), share("ppv"), F.lit("f1"), share("f1"), F.lit("ms"), error)
    return rows.select(key, text.alias("line"))


def confusion_lines(cells: DataFrame) -> DataFrame:
    """``(y_true, line)``: a line of text for each class that occurs in the truth, predicted classes from left to right."""
    rows = cells.groupBy("y_true").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("y_pred", "n"))).alias("c"))  # 25 cells
    name = F.get(F.array(*[F.lit(c) for c in CLASS_NAMES]), F.col("y_true"))
    return rows.where("total > 0").select("y_true", F.concat(F.rpad(name, 4, " "), F.array_join(F.transform("c", lambda x: F.lpad(x["n"].cast("string"), 8, " ")), "")).alias("line"))
