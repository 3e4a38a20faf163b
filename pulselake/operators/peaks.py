"""Selection among peaks ``(sensor_id, sample, height)`` that are too close to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept


def _dealt(peaks: DataFrame, distance: int, slot: int) -> DataFrame:
    """Each peak in its slot of time (``home``) and in the neighbouring one if that begins or ends within the distance."""
    reach = [F.floor((F.col("sample") + d) / slot) for d in (0, -(distance - 1), distance - 1)]
    rows = peaks.withColumn("own", reach[0])
    return rows.withColumn("slot", F.explode(F.array_distinct(F.array(*reach)))).withColumn("home", F.col("slot") == F.col("own")).drop("own")


def dominant(peaks: DataFrame, distance: int, slot: int = 1 << 16) -> DataFrame:
    """The peaks that stay if the highest goes first (of equals the earliest) and none may be closer than ``distance`` to a kept
    one. In rounds: an undecided peak stays if it is the highest one within its distance, and those close to it go. Peaks meet in
    slots of time that overlap by the distance, so a sensor is many tasks. A round settles the highest undecided peak of every
    neighbourhood; how many rounds there are follows the longest chain of ever higher neighbours, not the number of peaks. Repeated
    peaks count once, by their largest height."""
    slot = max(slot, distance)
    left = kept(peaks.groupBy("sensor_id", "sample").agg(F.max("height").alias("height")))
    near = Window.partitionBy("sensor_id", "slot").orderBy("sample").rangeBetween(-(distance - 1), distance - 1)
    rank = F.struct("height", (-F.col("sample")).alias("first"))
    out = left.where("false").select("sensor_id", "sample", "height")
    while not left.isEmpty():
        top = _dealt(left, distance, slot).withColumn("top", F.max(rank).over(near))
        marked = kept(top.where("home").select("sensor_id", "sample", "height", (F.col("top.first") == -F.col("sample")).alias("stays")))
        out = out.unionByName(marked.where("stays").select("sensor_id", "sample", "height"))
        close = _dealt(marked, distance, slot).withColumn("close", F.max("stays").over(near))
        left = kept(close.where("home and not close").select("sensor_id", "sample", "height"))
    return out


def largest_near(samples: DataFrame, reach: int, slot: int = 1 << 10) -> DataFrame:
    """``(sensor_id, sample)``: where the samples go that each move to the largest height within ``reach``, the first of equals. Slots
    overlap by twice the reach, since a sample is chosen from ``reach`` beyond its slot by what looks as far again. Slots are dealt out
    before the window sorts them: Spark would take the rows as a sensor's task made them, and a long sensor would be one sort."""
    slot = max(slot, 2 * reach + 1)
    near = Window.partitionBy("sensor_id", "slot").orderBy("sample").rangeBetween(-reach, reach)
    top = F.max(F.struct("height", (-F.col("sample")).alias("first"))).over(near)
    moved = _dealt(samples, 2 * reach + 1, slot).repartition("sensor_id", "slot").select("sensor_id", "slot", (-top["first"]).alias("sample"))
    return moved.where(F.floor(F.col("sample") / slot) == F.col("slot")).distinct().select("sensor_id", "sample")


def strongest_of_close(peaks: DataFrame, distance: int) -> DataFrame:
    """The peaks in one pass over each sensor: of one that is closer than ``distance`` to the last kept one and that one the higher
    stays, the earlier of equals. A gap of the distance ends a run that later peaks cannot touch, so runs are folded one by one."""
    order = Window.partitionBy("sensor_id").orderBy("sample")
    each = peaks.groupBy("sensor_id", "sample").agg(F.max("height").alias("height"))
    opens = F.coalesce(F.col("sample") - F.lag("sample").over(order) >= distance, F.lit(True))
    runs = each.withColumn("run", F.sum(opens.cast("long")).over(order)).groupBy("sensor_id", "run").agg(F.array_sort(F.collect_list(F.struct("sample", "height"))).alias("own"))

    def step(kept_so_far, peak):
        last = F.element_at(kept_so_far, -1)
        close = peak["sample"] - last["sample"] < distance
        before = F.slice(kept_so_far, 1, F.size(kept_so_far) - 1)
        return F.when(~close, F.concat(kept_so_far, F.array(peak))).when(peak["height"] > last["height"], F.concat(before, F.array(peak))).otherwise(kept_so_far)

    kept_of = F.aggregate(F.slice("own", 2, F.size("own")), F.slice("own", 1, 1), step)
    return runs.select("sensor_id", F.inline(kept_of))
