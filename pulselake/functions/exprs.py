"""Scalar column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beat symbols by class (N, S, V, F, Q), in class order.
AAMI = {0: ("N", "L", "R", "e", "j"), 1: ("A", "a", "J", "S"), 2: ("V", "E"), 3: ("F",)}
CLASS_NAMES = ("N", "S", "V", "F", "Q")
BEAT_SYMBOLS = ("N", "L", "R", "e", "j", "A", "a", "J", "S", "V", "E", "F", "/", "f", "Q")
#: Histogram bins, as (longest recording in seconds, bin in seconds).
BINS = ((1200, 60), (3600, 120), (7200, 300), (28800, 900), (108000, 3600))


def is_beat(symbol: Column) -> Column:
    """Whether an annotation's symbol stands for a beat; false for null."""
    return F.coalesce(symbol.isin(*BEAT_SYMBOLS), F.lit(False))


def finite(x: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def unit(x: Column) -> Column:
    """Clipped to 0..1; null and NaN give null."""
    return F.when(finite(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0)))


def round_even(x: Column, digits: int) -> Column:
    """``round_even`` of the SQL: the product with the power of ten goes to the nearest whole number, ties to the even one. ``bround`` looks
    at the shortest decimal instead and differs where that lies on a tie and the product does not (1.015), or the other way round."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def hr_bpm(rr: Column) -> Column:
    return F.when(rr > 0, 60.0 / rr)


def aami_class(symbol: Column) -> Column:
    out = F.lit(4)
    for k, symbols in AAMI.items():
        out = F.when(symbol.isin(*symbols), k).otherwise(out)
    return out


def lead_position(name: Column) -> Column:
    """Where a lead sits: chest and limb leads by name, anything else ``unknown``."""
    clean = F.upper(F.trim(name))
    known = clean.isin("I", "II", "III", "AVR", "AVL", "AVF") | clean.startswith("ML") | clean.startswith("V")
    return F.when(clean == "", "unknown").when(known, F.concat(F.lit("lead_"), clean)).otherwise("unknown")


def bin_seconds(duration_s: Column) -> Column:
    out = F.lit(7200)
    for longest, width in reversed(BINS):
        out = F.when(duration_s <= longest, width).otherwise(out)
    return out


def bin_label(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    hours = F.floor(seconds / 3600)
    return F.when(seconds % 3600 == 0, F.concat(hours.cast("string"), F.lit(" h"))).when(seconds % 60 == 0, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(seconds.cast("string"), F.lit(" s")))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Sensitivity, positive predictive value and F1, null where undefined."""
    return [ratio(tp.cast("double"), tp + fn).alias("se"), ratio(tp.cast("double"), tp + fp).alias("ppv"), ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1")]


def median_of(a: Column) -> Column:
    """The middle of an array with an odd number of values."""
    return F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))


def script_safe(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    for bad, good in (("<", "\\\\u003c"), (">", "\\\\u003e"), ("&", "\\\\u0026")):
        json = F.regexp_replace(json, bad, good)
    return json
