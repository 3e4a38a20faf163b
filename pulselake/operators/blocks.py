"""Signals as packed blocks: ``(sensor_id, block, x array<double>)``, ten minutes a row.

A block holds the samples ``[block * size, (block + 1) * size)`` of a sensor, the last one of a sensor fewer. What needs
samples beyond a block's end gets the head of the next block by a join on (sensor, block), so a signal crosses a shuffle as
arrays, never as a row a sample, and the halo is all that moves besides. A long sensor is many rows and so many tasks.

Blocks come stored, as a DataFrame, or as a ``Source``, whose samples are made by the task that reads them: then only what
they are made from is joined and shuffled, and no array of samples is written anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows of half a second, the unit of the flatness rule, in a block.
WINDOWS = 1200


@dataclass(frozen=True)
class Source:
    """Blocks that are made where they are read. ``rows(before, after)`` is ``(sensor_id, block, own, *columns)``: the number of a
    block's own samples and, as arrays, what they, ``before`` samples ahead of them and ``after`` behind them are made from.
    ``make(block, *arrays, before, after)`` is the place of the first of these samples, and the samples. ``ends`` is ``(sensor_id, n)``, the
    samples of each sensor, where that is known without the blocks."""

    rows: Callable[[int, int], DataFrame]
    make: Callable[..., tuple[int, np.ndarray]]
    columns: tuple[str, ...]
    stored: bool = False
    ends: DataFrame | None = None

    def where(self, condition: str) -> Source:
        return replace(self, rows=lambda before, after: self.rows(before, after).where(condition), ends=None if self.ends is None else self.ends.where(condition))


Blocks = DataFrame | Source


def source_of(blocks: Blocks, fs: float, windows: int | None = None) -> Source:
    """``blocks`` as a source; stored ones meet what precedes and follows them by joins. These never broadcast: what Spark takes the
    size of arrays to be may be thousands of times too small."""
    if isinstance(blocks, Source):
        return blocks
    size = size_of(fs, WINDOWS if windows is None else windows)

    def rows(before: int, after: int) -> DataFrame:
        out = (with_next(blocks.withColumn("own", F.size("x")), after) if after else blocks.select("sensor_id", "block", "x", F.size("x").alias("own"))).select("sensor_id", "block", "own", "x")
        if not before:
            return out.select("*", F.array(F.lit(0)).alias("at"))
        tails = blocks.select("sensor_id", (F.col("block") + 1).alias("block"), F.slice("x", F.greatest(F.lit(1), F.size("x") - before + 1), before).alias("tail"))
        out = out.join(tails.hint("merge"), ["sensor_id", "block"], "left")
        return out.select("sensor_id", "block", "own", F.concat(F.coalesce("tail", F.array().cast("array<double>")), "x").alias("x"), F.array(F.coalesce(F.size("tail"), F.lit(0))).alias("at"))

    return Source(rows, lambda block, x, at, before, after: (block * size - max(int(at[0]), 0), x), ("x", "at"), stored=True)


def spread(rows: DataFrame) -> DataFrame:
    """A few bytes become a long array each, so rows must not be put together by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sensor_id", "block")


def read(blocks: Blocks, fs: float, before: int, after: int, work: Callable, schema: str, extra: DataFrame | None = None, columns: tuple[str, ...] = (), keys: tuple[str, ...] = ("sensor_id",), how: str = "inner", windows: int | None = None) -> DataFrame:
    """``(sensor_id, schema)``: the columns, of equal length, that each of ``work(block, own, first, x, *columns)`` yields, of blocks joined with
    ``extra (keys, columns)``; ``x`` are the block's samples with ``before`` ahead and ``after`` behind, from ``first`` on."""
    source = source_of(blocks, fs, windows)
    rows = source.rows(before, after)
    kind, width, make = rows.schema["sensor_id"].dataType.simpleString(), len(source.columns), source.make
    if extra is not None:
        rows = rows.join(extra.hint("merge"), list(keys), how)
    rows = rows.select("sensor_id", "block", "own", *source.columns, *columns)
    if not source.stored:
        rows = spread(rows)

    def run(batches):
        for batch in batches:
            block, own = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made_from = zip(*(arrays(batch.column(3 + k)) for k in range(width)), strict=True)
            for row, values in enumerate(made_from):
                first, x = make(block[row], *values, before, after)
                for made in work(block[row], own[row], first, x, *(batch.column(3 + width + k)[row].as_py() for k in range(len(columns)))):
                    n = len(next(iter(made.values())))
                    if n:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, row))), *map(pa.array, made.values())], names=["sensor_id", *made])

    return rows.mapInArrow(run, f"sensor_id {kind}, {schema}")


def over_sensors(source: Source, before: int, after: int, work: Callable, schema: str, extra: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``(sensor_id, schema)``: the columns, of equal length, that ``work(rows)`` makes of a sensor, whose blocks are in one task, one after the
    other; ``rows`` yields ``(block, own, first, x, *columns)`` as in ``read`` for each row of ``extra (sensor_id, block, columns)``, ``own``
    0 and ``x`` empty where the source has no such block."""
    rows = source.rows(before, after)
    kind, width, make = rows.schema["sensor_id"].dataType.simpleString(), len(source.columns), source.make
    rows = rows.join(extra.hint("merge"), ["sensor_id", "block"], "right").select("sensor_id", "block", F.coalesce("own", F.lit(0)).alias("own"), *source.columns, *columns)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "sensor_id").sortWithinPartitions("sensor_id", "block")

    def each(batches, types):
        for batch in batches:
            types.append(batch.column(0).type)
            sensor, block, own = (batch.column(k).to_pylist() for k in range(3))
            made_from = zip(*(arrays(batch.column(3 + k)) for k in range(width)), strict=True)
            for row, values in enumerate(made_from):
                yield sensor[row], block[row], own[row], values, [batch.column(3 + width + k)[row].as_py() for k in range(len(columns))]

    def run(batches):
        types: list[pa.DataType] = []
        for sensor, own_rows in groupby(each(batches, types), lambda r: r[0]):
            made = work((block, own, *(make(block, *values, before, after) if own else (0, np.zeros(0))), *more) for _, block, own, values, more in own_rows)
            n = len(next(iter(made.values())))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([sensor] * n, types[0]), *map(pa.array, made.values())], names=["sensor_id", *made])

    return rows.mapInArrow(run, f"sensor_id {kind}, {schema}")


def packed_of(blocks: Blocks, fs: float) -> DataFrame:
    """Stored blocks."""
    if not isinstance(blocks, Source):
        return blocks
    return read(blocks, fs, 0, 0, lambda block, own, first, x: [{"block": [block], "x": [x]}], "block long, x array<double>")


def size_of(fs: float, windows: int = WINDOWS) -> int:
    """Samples of a whole block."""
    return windows * max(1, round(0.5 * fs))


def pack(signal: DataFrame, fs: float, windows: int = WINDOWS) -> DataFrame:
    """Blocks of ``signal (sensor_id, i, x)``, whose ``i`` counts from 0 without holes; a null sample becomes NaN."""
    sample = F.struct("i", F.coalesce(F.col("x").cast("double"), F.lit(float("nan"))).alias("x"))
    rows = signal.groupBy("sensor_id", F.floor(F.col("i") / size_of(fs, windows)).alias("block")).agg(F.sort_array(F.collect_list(sample)).alias("s"))
    return rows.select("sensor_id", "block", F.transform("s", lambda v: v["x"]).alias("x"))


def unpack(blocks: DataFrame, fs: float, windows: int = WINDOWS) -> DataFrame:
    """A row a sample again: ``(sensor_id, i, x)``."""
    return blocks.select("sensor_id", "block", F.posexplode("x").alias("at", "x")).select("sensor_id", (F.col("block") * size_of(fs, windows) + F.col("at")).alias("i"), "x")


def lengths(blocks: Blocks, fs: float, windows: int = WINDOWS) -> DataFrame:
    """``(sensor_id, n)``: samples of each sensor."""
    if isinstance(blocks, Source) and blocks.ends is not None:
        return blocks.ends
    if isinstance(blocks, Source):
        return blocks.rows(0, 0).groupBy("sensor_id").agg(F.max(F.col("block") * size_of(fs, windows) + F.col("own")).alias("n"))
    return blocks.groupBy("sensor_id").agg(F.max(F.col("block") * size_of(fs, windows) + F.size("x")).alias("n"))


def with_next(blocks: DataFrame, after: int) -> DataFrame:
    """``blocks`` with ``x`` carried on by the first ``after`` samples of the next block."""
    heads = blocks.where("block > 0").select("sensor_id", (F.col("block") - 1).alias("block"), F.slice("x", 1, after).alias("head"))
    others = [c for c in blocks.columns if c not in ("sensor_id", "block", "x")]
    return blocks.join(heads.hint("merge"), ["sensor_id", "block"], "left").select("sensor_id", "block", F.concat("x", F.coalesce("head", F.array().cast("array<double>"))).alias("x"), *others)


def stretches_by_block(stretches: DataFrame, fs: float, before: int = 0, after: int = 0, windows: int = WINDOWS) -> DataFrame:
    """``(sensor_id, block, starts, ends)``: the ``stretches (sensor_id, start, end)`` that reach into each block, or come within ``before``
    samples ahead of it or ``after`` behind it; blocks without one are left out."""
    size = size_of(fs, windows)
    every = F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - after) / size)), F.floor((F.col("end") - 1 + before) / size))
    found = stretches.where("end > start").select("sensor_id", "start", "end", F.explode(every).alias("block"))
    found = found.groupBy("sensor_id", "block").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))  # each is a second long or the only one
    return found.select("sensor_id", "block", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))


def arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column as views of its values."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def chunks(stretch: tuple[int, int], begin: int, size: int, chunk: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first, last, low, high)`` of the overlapping chunks of a stretch that start in ``[begin, begin + size)``: their samples
    and, of those, the part that each owns."""
    start, end = stretch
    step = chunk - overlap
    top = max(0, math.ceil((end - start - chunk) / step))
    for c in range(max(0, math.ceil((begin - start) / step)), min(top, (begin + size - 1 - start) // step) + 1):
        at = start + c * step
        yield at, min(at + chunk, end), at if c == 0 else at + overlap // 2, end if c == top else at + chunk - (overlap - overlap // 2)


Work = Callable[[np.ndarray, int, int, int, int], dict[str, object]]


def over_chunks(blocks: Blocks, stretches: DataFrame, fs: float, chunk_s: float, overlap_s: float, work: Work, columns: str, windows: int = WINDOWS) -> DataFrame:
    """``(sensor_id, columns)``: what ``work(x, first, last, low, high)`` makes of each chunk of each stretch ``(sensor_id, start,
    end)``, as columns of equal length; ``x`` are the samples [first, last), of which the chunk owns [low, high). A chunk belongs to
    the block in which it starts, and a block sees as much of the next one as a chunk is long."""
    size, chunk, overlap = size_of(fs, windows), int(round(chunk_s * fs)), int(round(overlap_s * fs))
    if not overlap < chunk <= size:
        raise ValueError(f"chunks of {chunk} samples that overlap by {overlap} do not fit blocks of {size}")

    def run(block, own, begin, x, starts, ends):
        for stretch in zip(starts, ends, strict=True):
            for first, last, low, high in chunks(stretch, block * size, size, chunk, overlap):
                yield work(x[first - begin : last - begin], first, last, low, high)

    return read(blocks, fs, 0, chunk, run, columns, stretches_by_block(stretches, fs, windows=windows), ("starts", "ends"), ("sensor_id", "block"), windows=windows)


def repack(parts: DataFrame, fs: float, windows: int = WINDOWS) -> DataFrame:
    """Blocks of ``parts (sensor_id, start, x array<double>)``, stretches of samples that do not overlap, cut at the blocks' edges
    and joined; samples that no part holds are NaN."""
    size = size_of(fs, windows)
    every = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.size("x") - 1) / size)))
    cut = parts.where(F.size("x") > 0).select("sensor_id", "start", "x", every.alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * size)
    high = F.least(F.col("start") + F.size("x"), (F.col("block") + 1) * size)
    cut = cut.select("sensor_id", "block", (low - F.col("block") * size).cast("int").alias("at"), F.slice("x", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("x"))
    packed = cut.groupBy("sensor_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s"))

    def run(batches):
        for batch in batches:
            for k, row in enumerate(batch.column(2)):
                own = [(p["at"].as_py(), p["x"].values.to_numpy()) for p in row]
                x = np.full(max(a + len(v) for a, v in own), np.nan)
                for a, v in own:
                    x[a : a + len(v)] = v
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([x], pa.list_(pa.float64()))], names=["sensor_id", "block", "x"])

    kind = parts.schema["sensor_id"].dataType.simpleString()
    return packed.mapInArrow(run, f"sensor_id {kind}, block long, x array<double>")
