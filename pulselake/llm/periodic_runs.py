"""Runs of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``least`` words and ``exponent`` periods that no neighbouring word extends. The words of a text are numbered by their
distinct values, and the array is compared with itself shifted by every lag q up to n / exponent; stretches of equal places
are the runs of that lag. A stretch that a smaller lag finds too has that smaller period, so of equal stretches the smallest lag counts.

All lags of a text of n words compare about n * n / exponent places. That work is cut into ranges of lags of at most
``cells`` places each: a text of one range is scanned where it is read, the ranges of longer ones are dealt over the
cluster, their runs meet again by the text's digest, and equal long texts are scanned once.

Defined results: a null or empty text has no words and no runs; repeated rows have equal results, and so have rows without
an id, since a text alone decides; extra columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CRC32, WORD, documents, fresh, small_batches

#: Places that one range of lags compares at most, beyond a single lag: some tens of milliseconds.
CELLS = 1 << 26
#: Places that one numpy operation compares, so that it stays in the cache.
_AT_ONCE = 1 << 18

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_list(text: str | None) -> list[bytes]:
    """Words between ASCII white space, which is what ``bytes.split`` takes for white space."""
    return (text or "").encode().split()


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, in as few bytes as all of them need."""
    code: dict[bytes, int] = {}
    out = [code.setdefault(w, len(code)) for w in words]
    return np.array(out, np.int16 if len(code) < 1 << 15 else np.int32)


def scan(ids: np.ndarray, low: int, high: int, least: int, exponent: int) -> np.ndarray:
    """``(start, length, period)`` of the stretches that the lags in [low, high) find, a row each."""
    n, found = len(ids), []
    wide = max(1, _AT_ONCE // max(n, 1))
    for a in range(low, high, wide):
        lags = np.arange(a, min(a + wide, high))
        need = np.maximum(least, exponent * lags) - lags
        # a row a lag: is the word that many places on the same? Beyond the end stands a number that no word has
        ahead = np.concatenate([ids[a:], np.full(len(lags) - 1 + a, -1, ids.dtype)])
        same = np.lib.stride_tricks.sliding_window_view(ahead, n)[: len(lags)] == ids
        for k in np.flatnonzero(np.count_nonzero(same, axis=1) >= need):
            at = np.flatnonzero(same[k])
            cut = np.flatnonzero(np.diff(at) != 1)
            start, end = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1
            long = end - start >= need[k]
            if long.any():
                q = int(lags[k])
                found.append(np.stack([start[long], end[long] - start[long] + q, np.full(long.sum(), q)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """Of stretches that are equal the one with the smallest period, in order of start and period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[bytes], runs) -> str:
    """The words but those that a run holds after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()


def _with_runs(batch: pa.RecordBatch, keep: int, texts: list[list[bytes]], runs: list) -> list[pa.Array]:
    named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
    return [*batch.columns[:keep], pa.array(named, pa.list_(_RUN)), pa.array([collapse(w, r) for w, r in zip(texts, runs, strict=True)], pa.string())]


def _scan_whole(at: int, keep: int, names: list[str], least: int, exponent: int):
    """Every lag of each text in one go."""

    def run(batches):
        for batch in small_batches(batches, names[at]):
            texts = [word_list(t) for t in batch.column(at).to_pylist()]
            runs = [smallest_periods(scan(numbers(w), 1, len(w) // exponent + 1, least, exponent)).tolist() for w in texts]
            yield pa.RecordBatch.from_arrays(_with_runs(batch, keep, texts, runs), names=names)

    return run


def _scan_ranges(least: int, exponent: int):
    """Range ``part`` of the ``parts`` ranges of a text's lags."""
    schema = pa.schema([("key", pa.string()), *_RUN])

    def run(batches):
        for batch in small_batches(batches):
            for row in batch.to_pylist():
                ids = numbers(word_list(row["text"]))
                lags = len(ids) // exponent
                low, high = (1 + (row["part"] + d) * lags // row["parts"] for d in (0, 1))
                found = scan(ids, low, high, least, exponent)
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(found), pa.string()), *[pa.array(c, pa.int64()) for c in found.T]], schema=schema)

    return run


def _collapse(at: int, keep: int, names: list[str]):
    """Texts whose runs are known, in the column after the kept ones."""

    def run(batches):
        for batch in small_batches(batches, names[at]):
            texts = [word_list(t) for t in batch.column(at).to_pylist()]
            runs = [[(r["start"], r["length"], r["period"]) for r in own or ()] for own in batch.column(keep).to_pylist()]
            yield pa.RecordBatch.from_arrays(_with_runs(batch, keep, texts, runs), names=names)

    return run


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, exponent: int = 4, cells: int = CELLS) -> DataFrame:
    """``docs`` with ``runs`` (array of ``start, length, period``, by start, then period) and ``collapsed``, the words that no run
    repeats; where ``docs`` has such columns already, the new ones get an underscore more."""
    spark, columns = docs.sparkSession, docs.columns
    names = [*columns, fresh(docs, "runs"), fresh(docs, "collapsed")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{names[-2]}` array<{RUN}>", f"`{names[-1]}` string"])
    at, keep, parts, key = columns.index(text), len(columns), fresh(docs, "parts"), fresh(docs, "key")
    places = lambda n: n * n / float(exponent)
    most = (F.length(text) + 1) / 2  # words, so that only long texts are counted beforehand
    ranges = F.when(places(most) <= cells, 1).otherwise(F.greatest(F.lit(1), F.ceil(places(F.regexp_count(text, F.lit(WORD)).cast("double")) / cells)))
    ranges = F.coalesce(ranges, F.lit(1)).cast("int")
    short = docs.where(ranges == 1).mapInArrow(_scan_whole(at, keep, names, least, exponent), schema)
    long = docs.where(ranges > 1).withColumn(key, F.sha2(text, 256))
    dealt = long.select(F.col(key).alias("key"), F.col(text).alias("text"), ranges.alias("parts")).dropDuplicates(["key"])
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a range is much work and few bytes, so adaptive execution must not put many into one task
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "part")
    found = dealt.mapInArrow(_scan_ranges(least, exponent), "key string, start long, length long, period long")
    found = found.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    found = found.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias(parts))
    known = long.join(found, key, "left").select(*columns, parts)
    return short.unionByName(known.mapInArrow(_collapse(at, keep, names), schema))


def with_repeats(docs: DataFrame, h: Column) -> DataFrame:
    """``docs (doc_id, text)``; where ``h % 10`` is 0, the n words from ``g % n`` on repeat the next ``1 + (n - g % n) // (3 + g % 8)`` of
    them, for ``g = h // 10``. Words and texts are generated, so that no later expression makes them anew."""
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.inline(F.array(F.struct(words.alias("words")))))
    n, g = F.size("words"), F.col("g")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.when(n > 0, F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", F.inline(F.array(F.struct(text.alias("text")))))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = with_repeats(documents(spark, sf_dir).select("doc_id", "text"), h)
    found = periodic_runs(docs)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Of a run with period q, at least one place that is a multiple of max(least, 4 q) - q equals the one q further on, so only
#: lags with such a place are compared in full.
OP11_SQL = rf"""
WITH h AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, {CRC32.format("doc_id")} AS h FROM documents
), g AS (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM h
), d AS (
  SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] FOR i IN range(n)] ELSE w END AS w FROM g
), q AS (
  SELECT k, n, w, q, greatest(6, 4 * q) - q AS need FROM d, LATERAL (SELECT unnest(range(1, n // 4 + 1)) AS q)
), c AS (
  SELECT k, n, w, q, need FROM q WHERE len(list_filter(range(0, n - q, need), lambda i: w[i + 1] = w[i + 1 + q])) > 0
), e AS (
  SELECT k, q, need, unnest(list_filter(range(0, n - q), lambda i: w[i + 1] = w[i + 1 + q])) AS i FROM c
), s AS (
  SELECT k, q, need, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e
), t AS (
  SELECT k, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY k, q, need, island HAVING count(*) >= need
), r AS (
  SELECT k, start, length, min(q) AS period FROM t GROUP BY k, start, length
), b AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS at FROM r
), u AS (
  SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY k
), gone AS (
  SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r
), x AS (
  SELECT k, unnest(range(n)) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (k, i) GROUP BY k
)
SELECT d.doc_id, coalesce(u.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(u.runs, '')) AS runs_sha256, sha256(coalesce(kept.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN u USING (k) LEFT JOIN b ON b.k = d.k AND b.at = 1 LEFT JOIN kept ON kept.k = d.k
"""
