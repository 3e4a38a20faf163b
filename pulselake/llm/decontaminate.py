"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised (lower case, white space as one space). An item of m characters
that occurs in a text with at most k edits shares at least m - q + 1 - k*q of its q-grams with it, and
these lie on diagonals (place in the text minus place in the item) that differ by at most k. So shared
q-grams are counted in diagonal bands of width 2(k + 1) that overlap by half, which holds any such set
whole; bands with fewer shared q-grams than the bound are dropped without loss, the others are aligned
exactly by a banded dynamic programme with free ends in the text. k is 10 % of m, or less for short items,
so that the bound stays at least one.

The benchmark is small beside the corpus: its items go to the tasks in blocks of at most ``block_chars``
characters (documented bound), one pass over the texts for each block. Nothing is shuffled. Alignment takes as many regions
at a time as about a million characters and costs hold, so its memory follows the longest item alone: some 25 bytes for each
character of it. Its time for an item of m characters is that of m * 0.4 m cells, unless the costs of a region pass the budget earlier.

A benchmark of B characters is one pass over the texts for each 4 MB of it: a thousand items of a few hundred characters
are one pass, 4 GB would be a thousand.

Defined results: null and empty texts match nothing; items that are null or shorter than q characters
when normalised are ignored; repeated rows are reported one by one, also those with a null doc_id; the smallest distance, then the first
end, stands for a text and an item; extra columns pass through ``remove_contaminated``; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, slices, small_batches

Q = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def normalise(text: str | None) -> np.ndarray:
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(chars: np.ndarray) -> np.ndarray:
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(Q):
        out *= _BASE
        out += chars[j : j + n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Benchmark:
    """Items, their edit budgets and bounds, and where each q-gram occurs in them."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        kept = [(i, n) for i, n in ((i, normalise(t)) for i, t in items) if len(n) >= Q]
        self.ids = [i for i, _ in kept]
        self.items = [n for _, n in kept]
        size = np.array([len(n) for n in self.items], np.int64)
        self.size = size
        self.budget = np.minimum((size * rate).astype(np.int64), (size - Q) // Q)
        self.bound = size - Q + 1 - self.budget * Q
        grams = [qgrams(n) for n in self.items]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])[order]
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.grams >> np.uint64(64 - _BITS)] = True

    def regions(self, rows: list[np.ndarray]) -> np.ndarray:
        """Columns (row, item, band) of all bands that reach their item's bound."""
        found = []
        for row, chars in enumerate(rows):
            grams = qgrams(chars)
            at = np.flatnonzero(self.seen[grams >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            slot = np.searchsorted(self.grams, grams[at])
            slot[slot == len(self.grams)] = 0
            same = self.grams[slot] == grams[at]
            at, slot = at[same], slot[same]
            if not len(at):
                continue
            shift = len(chars) + int(self.size.max())  # keeps bands above zero
            for key in self._reached(at, slot, shift):
                found.append(np.stack([np.full(len(key), row), key // (shift * 2), key % (shift * 2)]))
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)

    def _reached(self, at: np.ndarray, slot: np.ndarray, shift: int, most: int = 1 << 18):
        """Keys ``item * 2 * shift + band`` of the bands that reach their item's bound, for one text whose places ``at`` hold
        the known q-grams ``slot``. The text is counted in slices of about ``most`` shared q-grams; a band is judged once
        the text is past it, so a text that repeats itself needs no more memory than any other."""
        times = self.first[slot + 1] - self.first[slot]
        before = np.concatenate([[0], np.cumsum(times)])
        largest = int(self.size.max())
        open_key, open_count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = 0
        while a < len(at):
            b = max(int(np.searchsorted(before, before[a] + most, "right")) - 1, a + 1)
            n = times[a:b]
            entry = np.repeat(self.first[slot[a:b]] - (before[a:b] - before[a]), n) + np.arange(before[b] - before[a])
            item = self.item[entry]
            band = (np.repeat(at[a:b], n) - self.place[entry] + largest) // (self.budget[item] + 1) + 1
            key, where = np.unique(np.concatenate([open_key, item * shift * 2 + band, item * shift * 2 + band - 1]), return_inverse=True)
            count = np.bincount(where, np.concatenate([open_count, np.ones(2 * len(item), np.int64)]), len(key)).astype(np.int64)
            item, band = key // (shift * 2), key % (shift * 2)
            last = (band + 1) * (self.budget[item] + 1) - largest + self.size[item]  # beyond any place in the text that counts for the band
            done = last < at[b] if b < len(at) else np.ones(len(key), bool)
            good = key[done & (count >= self.bound[item])]
            if len(good):
                yield good
            open_key, open_count = key[~done], count[~done]
            a = b

    def _together(self, item: np.ndarray, places: int):
        """Regions in order of their items' lengths, as many at a time as hold about ``places`` characters and costs."""
        order = np.argsort(self.size[item], kind="stable")
        wide = (2 * self.size + 8 * self.budget)[item[order]]
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * wide[b] <= places:
                b += 1
            yield order[a:b]
            a = b

    def align(self, rows: list[np.ndarray], regions: np.ndarray, places: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Smallest edit distance of each region's item within its band and where it ends in the text. A region whose costs are
        all beyond the budget is given up, with a distance beyond it: costs never fall from one character to the next."""
        distance, ends = np.zeros(regions.shape[1], np.int64), np.zeros(regions.shape[1], np.int64)
        for part in self._together(regions[1], places):
            row, item, band = regions[:, part]
            size, budget = self.size[item], self.budget[item]
            low = (band - 1) * (budget + 1) - int(self.size.max()) - budget  # lowest diagonal
            width = int((4 * budget + 2).max()) + 1
            longest = int(size.max())
            text = np.full((len(part), longest + width), 0xFFFFFFFF, np.uint32)
            want = np.zeros((len(part), longest), np.uint32)
            for n in range(len(part)):
                chars = rows[row[n]]
                a, b = max(int(low[n]), 0), min(int(low[n]) + longest + width, len(chars))
                if b > a:
                    text[n, a - low[n] : b - low[n]] = chars[a:b]
                want[n, : size[n]] = self.items[item[n]]
            step = np.arange(width, dtype=np.int32)
            cost = np.zeros((len(part), width), np.int32)
            for i in range(longest):
                if i % 64 == 63:
                    alive = cost.min(axis=1) <= budget
                    if not alive.all():
                        distance[part[~alive & (size > i)]] = 1 << 40
                        part, size, budget, low, text, want, cost = (x[alive] for x in (part, size, budget, low, text, want, cost))
                        if not len(part):
                            break
                new = cost + (text[:, i : i + width] != want[:, i : i + 1])
                new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(new - step, axis=1) + step
                done = np.flatnonzero(size == i + 1)
                if len(done):
                    best = cost[done].argmin(axis=1)
                    distance[part[done]] = cost[done, best]
                    ends[part[done]] = low[done] + i + 1 + best
        return distance, ends

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """``(row, item id, distance, end)`` of every item that occurs within its budget."""
        rows = [normalise(t) for t in texts]
        if not self.items:
            return []
        regions = self.regions(rows)
        distance, ends = self.align(rows, regions)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for r, i, d, e in zip(*regions[:2].tolist(), distance.tolist(), ends.tolist(), strict=True):
            if d <= self.budget[i] and (d, e) < best.get((r, i), (1 << 60, 0)):
                best[r, i] = (d, e)
        return [(r, self.ids[i], d, e) for (r, i), (d, e) in sorted(best.items())]


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[Broadcast]:
    """The items in blocks of about ``block_chars`` characters, one after the other: the driver holds one block at a time and
    tasks fetch the blocks from each other."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_chars) + 1
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in rows])


def find_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4 << 20) -> DataFrame:
    """``(doc_id, item_id, distance, end_char)``: benchmark items in ``docs (doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("end_char", pa.int64())])

    def scan(items):
        def run(batches):
            known = Benchmark(items.value, rate)
            for batch in small_batches(batches):
                ids = batch.column(0).to_pylist()
                found = known.hits(batch.column(1).to_pylist())
                if found:
                    r, i, d, e = zip(*found, strict=True)
                    yield slices({"doc_id": [ids[x] for x in r], "item_id": i, "distance": d, "end_char": e}, schema)

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark, block_chars):
        part = texts.mapInArrow(scan(items), "doc_id long, item_id long, distance long, end_char long")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns unchanged."""
    at = docs.columns.index("text")

    def keep(items):
        def run(batches):
            known = Benchmark(items.value, rate)
            for batch in small_batches(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in known.hits(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        return run

    for items in blocks(benchmark, block_chars):
        docs = docs.mapInArrow(keep(items), docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
