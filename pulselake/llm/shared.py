"""Helpers that the training-data operators share: written intermediate tables, words and
fingerprints of whole Arrow batches, and connected components of a link table."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Spark SQL's spelling of a word: anything between the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: crc32 of a column's decimal text, bit by bit, since the dialect has no such function.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(CAST({0} AS VARCHAR), '')]),
    lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT FOR i IN range(8)]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""

_COUNTER = itertools.count()
_OWN: dict[str, str] = {}
_SEEN: set[str] = set()
_WRITTEN: list[str] | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Where the setting is missing, a local session
    gets a folder of its own; on a cluster that is an error, since executors would not see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="pulselake-")
    folder = f"{(where or _OWN[app]).rstrip('/')}/pulselake-{app}"
    if folder not in _SEEN:
        _SEEN.add(folder)
        atexit.register(_forget, spark, folder)
    return folder


def _forget(spark: SparkSession, folder: str) -> None:
    """Results are lazy and read these tables, so they stay as long as the program runs and its session lives."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, folder)


def new_path(spark: SparkSession) -> str:
    """A folder in the shared one that nobody has used yet."""
    path = f"{shared_dir(spark)}/{next(_COUNTER):06d}"
    if _WRITTEN is not None:
        _WRITTEN.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor
    costs nothing that was already written."""
    path = new_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written_tables():
    """Collects the paths of all tables that ``materialize`` writes in the block, for ``drop_tables``."""
    global _WRITTEN
    outer, _WRITTEN = _WRITTEN, []
    try:
        yield _WRITTEN
    finally:
        _WRITTEN = outer


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more, and forget them."""
    while paths:
        _delete(spark, paths.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def observed(df: DataFrame, *metrics) -> tuple[DataFrame, dict]:
    """``materialize`` with aggregates that the write itself yields, so no second query is needed."""
    seen = Observation()
    out = materialize(df.observe(seen, *metrics))
    return out, seen.get


# --- fingerprints -------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the result."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 1 << 16)
        for name, b in (("up", self.base), ("down", self.inverse)):
            out = np.full(n, b, np.uint64)
            out[0] = 1
            setattr(self, name, np.multiply.accumulate(out))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.need(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of [start, end): equal contents give equal values wherever they stand."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * _M1)


BYTES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_POWERS = Powers(0x9E3779B97F4A7C1B)
WORD_POWERS = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642B)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(batches, column: str = "text", limit: int = 4 << 20):
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        group = (np.cumsum(sizes.to_numpy(zero_copy_only=False)) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[data]
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return starts, np.flatnonzero(ink & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return BYTE_POWERS.ranges(BYTE_POWERS.prefix(BYTES[data]), starts, ends)


def slices(column_arrays: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column_arrays[f.name], f.type) for f in schema], schema=schema)


def groups(batches, key: str):
    """The rows of each run of equal ``key`` in a stream sorted by it, as one table at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if held and held[-1].column(batch.schema.get_field_index(key))[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


# --- components ---------------------------------------------------------------------------------


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id of ``edges (a, b)``: the smallest id it can reach.

    Alternates the large-star and the small-star step, which only ever replace links by links to
    smaller ids, until nothing changes. A hub is one row of a pre-aggregated minimum, joined back
    with a plain equi-join that adaptive execution may split. An empty table gives an empty one.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e)
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # each id also keeps its own link, or ids whose links all moved away would be cut off
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e, state = observed(small, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hashed_id(distinct: DataFrame, *columns: str) -> Column:
    """An id in 64 bits of the values of ``columns``: salted anew in the unlikely case that two of the ``distinct`` rows share one."""
    for salt in range(20):
        out = F.xxhash64(F.lit(salt), *columns)
        if distinct.groupBy(out.alias("id")).count().where("count > 1").isEmpty():
            return out
    raise RuntimeError("no ids without a collision")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
