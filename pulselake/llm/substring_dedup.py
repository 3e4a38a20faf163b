"""Substring dedup by recompression.

A text's words are named by fingerprints and then renamed in rounds: a round names runs of one symbol, and pairs
of symbols of which the first lies on the left and the second on the right side of a seeded split of all names. A
name is computed from the names it stands for alone, so it is the same in every task and every round is global
without a dictionary. Equal stretches of words get equal symbols but for a few at their ends.

For every window of ``window`` words the symbols are found that its own words determine (whatever stands around
it), and of these, at the highest level that has two, the neighbours whose common name is smallest: the window's
anchor. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so one row stands for all
windows in a row that have the same anchor: some thirty words, and a whole stretch of text that repeats itself.
Of texts that are equal as a whole only the first goes further; the others go. Anchors that occur in one document only are done with: no window of theirs is repeated.
Where an anchor occurs in several documents, its windows are compared by two full fingerprints (128 bits) among the
anchor's occurrences, and a window is marked if the smallest document with it is another, smaller one.

Hot anchors (more than ``hot`` windows) are compared in salted parts first; what is the smallest of its part then goes
on by single window, so a passage in a third of all documents is reduced before it meets in one place.

Defined results: null and empty texts have no words; windows are judged on the input; a row is identified by doc_id
and text, so repeated rows are treated alike and rows of one doc_id never remove each other; rows with a null doc_id
are left whole and remove nothing; extra columns pass through ``remove_repeats``; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_POWERS, documents, fresh, groups, materialize, mix, mix_int, slices, small_batches, utf8, word_hashes, words

ROUNDS = 3
WHOLE = 1 << 30


def _name_runs(symbols, breaks, a, b):
    """One symbol for each run of equal symbols; the outer runs of a window may go on outside it."""
    new = np.append(True, symbols[1:] != symbols[:-1])
    new[breaks[breaks < len(symbols)]] = True
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(symbols)))
    named = np.where(length > 1, mix(symbols[at] + mix(length.astype(np.uint64))), symbols[at])
    run = np.cumsum(new) - 1
    low = run[np.minimum(a, len(symbols) - 1)] + 1
    high = np.where(b > 0, run[np.maximum(b - 1, 0)], 0)
    return named, np.append(run, len(at))[breaks], low, np.maximum(high, low)


def _name_pairs(symbols, breaks, a, b, seed):
    """Pairs across the split become one symbol; a window's outer symbols may pair with one outside."""
    right = (mix(symbols ^ seed) & np.uint64(1)).astype(bool)
    into = np.zeros(len(symbols) + 1, bool)
    into[1:-1] = ~right[:-1] & right[1:]
    into[breaks] = False
    into = into[:-1]  # symbols that close a pair
    at = np.flatnonzero(~into)
    follows = np.append(into[1:], False)[at]
    named = np.where(follows, mix(mix(symbols[at] + np.uint64(0x5BD1E995)) ^ symbols[np.minimum(at + 1, len(symbols) - 1)]), symbols[at])
    before = np.concatenate([[0], np.cumsum(~into)])
    last = len(symbols) - 1
    low = a + right[np.minimum(a, last)]
    high = b - ~right[np.clip(b - 1, 0, last)]
    low = before[np.minimum(low, len(symbols))]
    return named, before[breaks], low, np.maximum(before[np.clip(high, 0, len(symbols))], low)


def _smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the smallest value in each [low, high), the first of equals; all are not empty."""
    size = (high - low).astype(np.int64)
    level = np.frexp(size)[1] - 1
    best = np.arange(len(values))
    out = np.empty(len(low), np.int64)
    for k in range(int(level.max(initial=0)) + 1):
        own = level == k
        x, y = best[low[own]], best[high[own] - (1 << k)]
        out[own] = np.where(values[y] < values[x], y, x)
        step = 1 << k
        if len(best) > step:
            x, y = best[:-step], best[step:]
            best = np.where(values[y] < values[x], y, x)
        else:
            best = best[:0]
    return out


def anchors(hashed: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all rows: first word and anchor name."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    total = int(count.sum())
    place = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
    if not total:
        return place, np.zeros(0, np.uint64)
    symbols, breaks = hashed, first
    a, b = place, place + window
    key = np.zeros(total, np.uint64)
    levels = [(symbols, a, b)]
    for i in range(ROUNDS):
        symbols, breaks, a, b = _name_runs(symbols, breaks, a, b)
        symbols, breaks, a, b = _name_pairs(symbols, breaks, a, b, np.uint64(mix_int(i + 77)))
        levels.append((symbols, a, b))
    left = np.arange(total)
    for i in range(ROUNDS, -1, -1):  # a window without two symbols of its own at one level has them further down
        symbols, a, b = levels[i]
        both = mix(mix(symbols[:-1] + np.uint64(i)) ^ symbols[1:])
        has = b[left] > a[left] + 1
        own = left[has]
        if len(own):
            key[own] = both[_smallest(both, a[own], b[own] - 1)]
        left = left[~has]
        if not len(left):
            break
    return place, key


def _parse(column: pa.Array):
    data, offsets = utf8(column)
    starts, ends, first = words(data, offsets)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def _anchor_rows(window: int):
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_id", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])

    def run(batches):
        for batch in small_batches(batches):
            *_, first, hashed = _parse(batch.column(2))
            place, key = anchors(hashed, first, window)
            if not len(place):
                continue
            row = np.searchsorted(first, place, side="right") - 1
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
            row = row[new]
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield slices({"anchor": key[new].view(np.int64), "doc_id": ids[row], "text_id": texts[row], "first": place[new] - first[row], "n": np.diff(np.append(new, len(place)))}, schema)

    return run


def _fingerprints(window: int):
    """Fingerprints of the windows of each shared anchor, 128 bits a window: ``(part, doc_id, text_id, first, prints)``."""
    schema = pa.schema([("part", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("text_id", pa.int64()), ("first", pa.int32()), ("prints", pa.binary())])

    def run(batches):
        for batch in small_batches(batches):
            *_, first, hashed = _parse(batch.column(2))
            if not len(hashed):
                continue
            prefixes = [p.prefix(hashed) for p in WORD_POWERS]
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ranges = batch.column(3)
            flat = ranges.flatten()
            count = pc.list_value_length(ranges).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(count)), count)
            begin, n, part, hot = (pc.struct_field(flat, f).to_numpy(zero_copy_only=False) for f in ("first", "n", "part", "hot"))
            n = np.minimum(n, first[row + 1] - first[row] - window + 1 - begin).clip(0)
            total = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(first[row] + begin - total[:-1], n) + np.arange(total[-1])
            prints = np.stack([p.ranges(prefix, at, at + window) for p, prefix in zip(WORD_POWERS, prefixes, strict=True)], axis=1)
            some = np.flatnonzero(n)
            raw = prints.tobytes()
            yield slices({"part": part[some], "hot": hot[some].astype(bool), "doc_id": ids[row[some]], "text_id": texts[row[some]], "first": begin[some], "prints": [raw[16 * total[i] : 16 * total[i + 1]] for i in some]}, schema)

    return run


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of set flags that belongs to one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
    return at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1


_RANGES = "array<struct<first:int,n:int>>"


def _ranges(first: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.Array:
    """Lists of ``(first, n)``, the next ``size`` of them in each."""
    flat = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["first", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)


def _compare():
    """Rows of one part (all its occurrences) in; stretches of repeated windows out, and for hot parts the windows that
    are the smallest of theirs, one row for each text and fingerprint (``print`` not null)."""
    ranges = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("ranges", ranges), ("print", pa.int64()), ("other", pa.int64())])

    def run(batches):
        for table in groups(batches, "part"):
            prints = [np.frombuffer(p, np.uint64).reshape(-1, 2) for p in table.column("prints").to_pylist()]
            count = np.array([len(p) for p in prints])
            owner = np.repeat(np.arange(len(prints)), count)
            value = np.concatenate(prints)
            ids, texts, first = (table.column(c).to_numpy() for c in ("doc_id", "text_id", "first"))
            order = np.lexsort((value[:, 1], value[:, 0]))
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(np.append(0, (value[order[1:]] != value[order[:-1]]).any(axis=1)))
            low = np.full(int(inverse.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, inverse, ids[owner])
            repeated = low[inverse] < ids[owner]
            place = first[owner] + np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
            a, b = _runs(repeated, owner)
            if len(a):
                new = np.flatnonzero(np.append(True, owner[a[1:]] != owner[a[:-1]]))
                o = owner[a[new]]
                found = _ranges(place[a], b - a, np.diff(np.append(new, len(a))))
                yield slices({"doc_id": ids[o], "text_id": texts[o], "ranges": found, "print": [None] * len(o), "other": [None] * len(o)}, schema)
            rest = np.flatnonzero(~repeated) if table.column("hot")[0].as_py() else a[:0]
            if len(rest):
                text = np.unique(texts, return_inverse=True)[1]
                rest = rest[np.lexsort((place[rest], text[owner[rest]], inverse[rest]))]
                key = np.stack([inverse[rest], text[owner[rest]]])
                new = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
                o, v = owner[rest[new]], value[rest[new]].view(np.int64)
                found = _ranges(place[rest], np.ones(len(rest), np.int32), np.diff(np.append(new, len(rest))))
                yield slices({"doc_id": ids[o], "text_id": texts[o], "ranges": found, "print": v[:, 0], "other": v[:, 1]}, schema)

    return run


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text").where("doc_id is not null")


def _each_once(rows: DataFrame) -> DataFrame:
    """One row a (doc_id, text_id). Only rows that are repeated travel with their texts; which those are is a written table, so
    that its size is known where the joins are planned."""
    repeated = materialize(rows.groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_id"))
    alone = rows.join(repeated, ["doc_id", "text_id"], "left_anti")
    return alone.unionByName(rows.join(repeated, ["doc_id", "text_id"], "left_semi").groupBy("doc_id", "text_id").agg(F.first("text").alias("text")))


def repeated_windows(docs: DataFrame, window: int = 50, hot: int = 1 << 16) -> DataFrame:
    """``(doc_id, text_id, ranges)``: stretches ``(first, n)`` of windows that a smaller document has too."""
    rows = _each_once(identified(docs))
    found = materialize(rows.mapInArrow(_anchor_rows(window), "anchor long, doc_id long, text_id long, first int, n int"))
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("windows")).where("low < high")
    hits = found.join(materialize(shared.select("anchor", "windows")), "anchor")
    parts = F.ceil(F.col("windows") / hot)
    part = F.xxhash64("anchor", F.pmod(F.xxhash64("doc_id", F.floor(F.col("first") / hot)), parts))  # a text that repeats itself is many parts too
    hits = hits.select("doc_id", "text_id", F.struct("first", "n", part.alias("part"), (F.col("windows") > hot).alias("hot")).alias("r"))
    hits = hits.groupBy("doc_id", "text_id").agg(F.collect_list("r").alias("ranges"))
    equal = rows.select("doc_id", "text_id", F.hash("text").alias("h"), F.length("text").alias("n"))
    first = equal.groupBy("text_id", "h", "n").agg(F.min("doc_id").alias("low"))
    firsts = first.select(F.col("low").alias("doc_id"), "text_id").distinct()
    hits = hits.join(firsts, ["doc_id", "text_id"], "left_semi")
    prints = rows.join(hits, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "ranges")
    prints = prints.mapInArrow(_fingerprints(window), "part long, hot boolean, doc_id long, text_id long, first int, prints binary")
    compared = prints.repartition("part").sortWithinPartitions("part").mapInArrow(_compare(), f"doc_id long, text_id long, ranges {_RANGES}, print long, other long")
    compared = materialize(compared)
    smallest = compared.where("print is not null")
    low = smallest.groupBy("print", "other").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("print", "other", "low")
    again = smallest.join(low, ["print", "other"]).where("low < doc_id").select("doc_id", "text_id", "ranges")
    marked = compared.where("print is null").select("doc_id", "text_id", "ranges").unionByName(again)
    marked = marked.groupBy("doc_id", "text_id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(WHOLE).alias("n")))
    again = equal.join(first, ["text_id", "h", "n"]).where("low < doc_id").select("doc_id", "text_id").distinct()
    return marked.unionByName(again.withColumn("ranges", whole))


def covered(n_words: int, ranges, window: int) -> np.ndarray:
    """Words of one text that lie in a repeated window; a range of ``WHOLE`` windows is all of them."""
    change = np.zeros(n_words + 1, np.int64)
    for r in ranges if ranges and n_words >= window else ():
        change[r["first"]] += 1
        change[min(r["first"] + r["n"] + window - 1, n_words)] -= 1
    return np.cumsum(change[:-1]) > 0


def _kept(column: pa.Array, ranges: pa.Array, window: int):
    """For each text its words, which of them are removed, and the kept words joined by one space."""
    for text, own in zip(column.to_pylist(), ranges.to_pylist(), strict=True):
        raw = (text or "").encode().split()
        gone = covered(len(raw), own, window)
        yield len(raw), int(gone.sum()), b" ".join(raw if not own else [w for w, g in zip(raw, gone.tolist(), strict=True) if not g])


def _with_ranges(docs: DataFrame, window: int, name: str, **how) -> DataFrame:
    found = repeated_windows(docs, window, **how)
    same: Column = (docs["doc_id"].cast("long") == found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_id"])
    return docs.join(found, same, "left").select(*[docs[c] for c in docs.columns], found["ranges"].alias(name))


def remove_repeats(docs: DataFrame, window: int = 50, **how) -> DataFrame:
    """The rows of ``docs`` without the words that an earlier document's windows cover; where nothing is removed the
    text stays as it is, and n_chars (if there) follows the text."""
    name = fresh(docs, "ranges")
    at, columns = docs.columns.index("text"), docs.columns
    sizes = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        for batch in small_batches(batches):
            texts = [t if not gone else kept.decode() for t, (_, gone, kept) in zip(batch.column(at).to_pylist(), _kept(batch.column(at), batch.column(len(columns)), window), strict=True)]
            arrays = batch.columns[:-1]
            arrays[at] = pa.array(texts, pa.string())
            if sizes is not None:
                arrays[sizes] = pa.array([None if t is None else len(t) for t in texts], arrays[sizes].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(batch.schema, arrays)]))

    return _with_ranges(docs, window, name, **how).mapInArrow(run, docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches):
        for batch in small_batches(batches):
            n, gone, kept = zip(*_kept(batch.column(1), batch.column(2), 50), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], schema=schema)

    rows = _with_ranges(documents(spark, sf_dir).select("doc_id", "text"), 50, "ranges")
    return rows.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i + 1, i + 50), ' ')) AS key
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 49, 0))) AS i FROM w)
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) < doc_id AS repeated FROM p
), t AS (
  SELECT doc_id, unnest(range(0, len(words))) AS i, unnest(words) AS word FROM w
), c AS (
  SELECT t.doc_id, t.i, word, coalesce(max(CAST(repeated AS INT)) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM t LEFT JOIN m ON m.doc_id = t.doc_id AND m.i = t.i
), s AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""
