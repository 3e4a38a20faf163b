"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct ``k``-word shingles (A-Z lower-cased; a text with fewer words is
one shingle; a text without words has an empty set and is linked with nothing). Sets that are equal
collapse to one representative, so a group of exact copies of any size is one row from here on.

Every tree draws, at each of its nodes, one minwise position and with probability ``second`` another
one, and sends each document to the children named by its minimum there: a pair of similarity s stays
together in (1 + second) * s children on average, which is 1 at the threshold. A level takes ``STEPS`` such
steps at once. Two trees share the positions they draw from, the next two have others (``BANKS`` times), and there are
as many trees as ``tree_recall`` asks for at full depth. A node with one
document ends; a node with at most ``leaf`` documents is compared exhaustively; a larger one branches again.
Nodes that are still large after ``depth`` levels get an exact way: only documents that are not yet
known to be connected matter, and these are compared with the whole node, in blocks of ``block`` documents.

The first two trees come first, and in them the large nodes too, in parts of ``leaf`` documents with one hub that all
parts share: that connects most of a group of near copies before any other node is looked at. In the trees
after them the large nodes only branch: the recall is that of leaves alone.

A node's documents are first compared exhaustively by their minima, which travel with them as 16 bits a
position: the number of equal ones is binomial, so a pair at the threshold falls below ``least_equal``
with a probability of at most one in a million. Documents that have a partner left in their node are
compared again by ``WIDE`` further minima of 8 bits, which leave far fewer pairs below the threshold
(chance values only ever make minima equal, so the bound on a lost pair holds again). Texts move only
for documents that still have a partner; links are decided on full shingle sets. A node whose texts have more than
``most_shingles`` shingles is cut into parts that meet in pairs, so no task holds more than two of them.

Documents that are known to be connected are never compared with each other, so a group of n near
copies costs about n comparisons and never n * n rows.

Defined results: null text = no words; repeated and tied rows each keep their own row; an empty
table gives an empty table; extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
Exactly one row of each group is kept: that of the smallest doc_id (null comes after all others, and names
a group only if the group has no other id), of equal doc_ids that of the smallest fingerprint of the text, of
rows that agree in both any one. Rows without words are all kept. A doc_id with several texts may be in several groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, connected_components, documents, groups, hashed_id, materialize, mix, mix_int, observed, slices, small_batches, utf8, word_hashes, words

POSITIONS = 32
WIDE = 128
BANKS = (POSITIONS + WIDE) // POSITIONS
STEPS = 2
_SEEDS = np.random.default_rng(9).integers(1, 1 << 63, POSITIONS + WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCHEMA = "doc_id long, print long, n_shingles long, set_a long, set_b long, minima binary, wide binary"


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles, row after row, and where each row's begin (one more at the end)."""
    lower = LOWER[data]
    starts, ends, first = words(lower, offsets)
    hashed = word_hashes(lower, starts, ends)
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first[:-1], made) + np.arange(begin[-1]) - np.repeat(begin[:-1], made)
    length = np.repeat(np.minimum(count, k), made)
    out = length.astype(np.uint64)
    for j in range(k):
        inside = j < length
        out = np.where(inside, mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[np.minimum(at + j, max(len(hashed) - 1, 0))]), out) if len(hashed) else out
    return out, begin


def distinct_sets(hashes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _bank(tree: int) -> int:
    """Which ``POSITIONS`` of the seeds a tree draws from."""
    return tree // 2 % BANKS


def _signatures(k: int, banks: int):
    """Sizes, fingerprints and minima of each row: 16 bits a position of the first ``banks`` banks, and ``WIDE`` of 8 bits."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("minima", pa.binary()), ("wide", pa.binary())])
        for batch in small_batches(batches):
            data, offsets = utf8(batch.column(2))
            hashes, begin = shingle_hashes(data, offsets, k)
            n = len(begin) - 1
            size, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            minima, wide = np.zeros((n, POSITIONS * banks), np.uint16), np.zeros((n, WIDE), np.uint8)
            full = np.flatnonzero(np.diff(begin))
            if len(full):
                at = begin[:-1][full]
                for j, seed in enumerate(_SEEDS):
                    low = mix(np.minimum.reduceat(hashes * seed, at))
                    if j < POSITIONS * banks:
                        minima[full, j] = low >> np.uint64(48)
                    if j >= POSITIONS:
                        wide[full, j - POSITIONS] = low >> np.uint64(56)
                for i in full:
                    own = np.unique(hashes[begin[i] : begin[i + 1]])
                    size[i], a[i], b[i] = len(own), own.sum(), (own * (own >> np.uint64(7) | np.uint64(1))).sum()
            yield slices({"doc_id": batch.column(0), "print": batch.column(1), "n_shingles": size, "set_a": mix(a).view(np.int64), "set_b": mix(b).view(np.int64), "minima": [x.tobytes() for x in minima], "wide": [x.tobytes() for x in wide]}, schema)

    return run


def _unpack(column: pa.Array, kind: type = np.uint16, positions: int = POSITIONS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, positions)


def _children(level: int, second: float):
    """The children of each (node, document) after ``STEPS`` steps, each with one position always and another with chance ``second``."""
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("minima", pa.binary()), ("early", pa.bool_())])

    def run(batches):
        for batch in batches:
            minima = _unpack(batch.column(2))
            row, node = np.arange(batch.num_rows), batch.column(0).to_numpy().view(np.uint64)
            for step in range(STEPS):
                draw = mix(node + np.uint64(mix_int(level * STEPS + step)))
                one, other = ((mix(draw + np.uint64(turn)) % np.uint64(POSITIONS)).astype(np.int64) for turn in (1, 2))
                twice = ((draw >> np.uint64(40)).astype(float) / (1 << 24) < second) & (one != other)
                row, at = np.concatenate([row, row[twice]]), np.concatenate([one, other[twice]])
                node = np.concatenate([node, node[twice]])
                node = mix(mix(node * np.uint64(31) + at.astype(np.uint64)) + minima[row, at].astype(np.uint64))
            rest = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *rest.columns[1:]], schema=schema)

    return run


def least_equal(percent: int, positions: int = POSITIONS, miss: float = 1e-6) -> int:
    """The largest number of equal minima that a pair of similarity ``percent`` / 100 falls short of with a chance of at most ``miss``."""
    s, below = percent / 100, 0.0
    for equal in range(positions + 1):
        below += math.comb(positions, equal) * s**equal * (1 - s) ** (positions - equal)
        if below > miss:
            return equal
    return positions


def tree_recall(percent: int, trees: int, depth: int, second: float) -> float:
    """The chance that a pair of similarity ``percent`` / 100 meets in a node of some tree after ``depth`` levels. Trees of a
    bank see the same number of equal minima, which is binomial; chance values and hubs, which only add, are left out."""

    def meets(s: float) -> float:
        out = 1.0
        for _ in range(depth * STEPS):
            out = 1 - (1 - s * out) * (1 - second * (1 - 1 / POSITIONS) * s * out)
        return out

    s, miss = percent / 100, 1.0
    for bank in range(BANKS):
        own = sum(_bank(t) == bank for t in range(trees))
        miss *= sum(math.comb(POSITIONS, e) * s**e * (1 - s) ** (POSITIONS - e) * (1 - meets(e / POSITIONS)) ** own for e in range(POSITIONS + 1))
    return 1 - miss


def trees_for(percent: int, recall: float, depth: int, second: float) -> int:
    """The smallest even number of trees with that recall; where 200 do not have it, no number in reach does, and that is an error."""
    found = next((t for t in range(2, 202, 2) if tree_recall(percent, t, depth, second) >= recall), None)
    if found is None:
        raise ValueError(f"no 200 trees find pairs of similarity {percent} % with a chance of {recall}")
    return found


def _partners(least: int, column: str = "minima", kind: type = np.uint16, positions: int = POSITIONS, more: tuple[str, ...] = ()):
    """By the minima in ``column``, the documents of each node that may be linked with another one of it to which they are not
    yet connected. ``more`` columns travel along."""
    schema = pa.schema([(c, pa.int64()) for c in ("node", "doc_id", "component", *more)])

    def run(batches):
        for table in groups(batches, "node"):
            minima = _unpack(table.column(column).combine_chunks(), kind, positions)
            known = table.column("component").to_numpy()
            keep = np.zeros(len(known), bool)
            for a in range(0, len(known), 256):
                part = slice(a, a + 256)
                near = known[part, None] != known
                equal = np.zeros(near.shape, np.uint8)
                for j in range(positions):
                    equal += minima[part, j, None] == minima[:, j]
                keep[part] = (near & (equal >= least)).any(axis=1)
            if keep.any():
                chosen = table.select(schema.names).filter(pa.array(keep)).combine_chunks()
                yield from (pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in chosen.to_batches())

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(k: int, percent: int):
    """Exhaustive comparison of each leaf on full sets, but for pairs that are known to be connected."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table in groups(batches, "node"):
            ids = table.column("doc_id").to_numpy()
            known = table.column("component").to_numpy()
            sets: list[np.ndarray] = []
            for batch in small_batches(table.to_batches()):
                data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
                sets += distinct_sets(*shingle_hashes(data, offsets, k))
            size = np.array([len(s) for s in sets])
            label = np.unique(known, return_inverse=True)[1]
            side = table.column("side").to_numpy()
            one_part = side.min() == side.max()  # of two parts only pairs across: those within a part meet in its own cell
            found: list[tuple[int, int]] = []
            for i in range(len(ids)):
                after = slice(i + 1, None)
                near = (label[after] != label[i]) & (100 * np.minimum(size[after], size[i]) >= percent * np.maximum(size[after], size[i])) & (one_part | (side[after] != side[i]))
                near = np.flatnonzero(near) + i + 1
                for j in near:
                    if label[i] != label[j] and _linked(sets[i], sets[j], percent):
                        found.append((i, int(j)))
                        label[label == label[j]] = label[i]
            if found:
                x = np.array(found)
                yield slices({"a": ids[x[:, 0]], "b": ids[x[:, 1]]}, schema)

    return run


def _label(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """``rows`` with the component that each document is known to be in, itself if none."""
    if known is None:
        return rows.withColumn("component", F.col("doc_id"))
    rows = rows.join(known.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return rows.withColumn("component", F.coalesce("component", "doc_id"))


def _only(rows: DataFrame, ids: DataFrame, on: str = "doc_id", most_bits: int = 1 << 28) -> DataFrame:
    """The rows whose value of ``on`` may be in ``ids``, before they are shuffled for the join with it. A bitmap with eight
    hashed places for each of ``ids`` is broadcast, ``most_bits`` / 8 bytes (32 MB) at most. If it fills up, more rows pass and none is lost."""
    bits = min(most_bits, 1 << max(21, (8 * ids.count()).bit_length()))

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("place", F.pmod(F.xxhash64(on), F.lit(bits)))

    maps = place(ids).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    near = place(rows).withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(maps), "bucket")
    byte = "cast(conv(hex(substring(map, cast(bitmap_bit_position(place) div 8 as int) + 1, 1)), 16, 10) as int)"
    return near.where(f"bit_get({byte}, cast(bitmap_bit_position(place) % 8 as int)) = 1").select(rows.columns)


def _needed(rows: DataFrame) -> DataFrame:
    """The nodes of ``rows (node, doc_id, component)`` whose documents are not all connected already; of nodes with
    the same documents, as different trees often make them, only one."""
    nodes = rows.groupBy("node").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(F.col("doc_id") + 1)).alias("y"),
    )
    return nodes.where("n > 1 and low < high").groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node")


def _in_cells(rows: DataFrame, most_shingles: int) -> DataFrame:
    """``rows (node, doc_id, size, ...)`` dealt to cells (``node``, ``side``): a node is one cell, or where its sizes sum to more
    than ``most_shingles``, one for each two of its parts."""
    sizes = rows.groupBy("node").agg(F.ceil(F.sum("size") / most_shingles).cast("int").alias("parts"))
    side = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("parts")).cast("int")
    rows = rows.join(sizes, "node").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.when(F.col("parts") > 1, F.xxhash64("node", F.least("side", "other"), F.greatest("side", "other"))).otherwise(F.col("node"))
    return rows.withColumn("node", cell).drop("parts", "other", "size")


def _edges(leaves: DataFrame, texts: DataFrame, wide: DataFrame, k: int, percent: int, most_shingles: int) -> DataFrame:
    """Links found in ``leaves (node, doc_id, minima, component)``. Nodes that are not needed
    and documents without a partner are left out before any text moves."""
    leaves = materialize(leaves.dropDuplicates(["node", "doc_id", "minima"]))
    rows = leaves.join(_needed(leaves), "node").select("node", "doc_id", "minima", "component").repartition("node").sortWithinPartitions("node", "doc_id")
    rows = materialize(rows.mapInArrow(_partners(least_equal(percent)), "node long, doc_id long, component long").distinct())
    rows = rows.join(_only(wide, rows), "doc_id").select("node", "doc_id", "component", "name", "print", "size", "wide").repartition("node").sortWithinPartitions("node", "doc_id")
    by_wide = _partners(least_equal(percent, WIDE), "wide", np.uint8, WIDE, ("name", "print", "size"))
    rows = materialize(rows.mapInArrow(by_wide, "node long, doc_id long, component long, name long, print long, size long").distinct())
    rows = materialize(_in_cells(rows.join(_needed(rows), "node").select(rows.columns), most_shingles))
    # rows that agree in doc_id and text are combined before they move, so a row that stands m times comes once
    once = _only(texts, rows, "print").groupBy("name", "print").agg(F.any_value("text").alias("text"))
    rows = rows.join(once, ["name", "print"]).select("node", "side", "doc_id", "component", "text").repartition("node").sortWithinPartitions("node", "doc_id")
    return rows.mapInArrow(_compare(k, percent), "a long, b long")


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with the identity of a row, ``(name, print)``: doc_id, and a fingerprint of the text and of a missing doc_id."""
    name = F.col("doc_id").cast("long")
    return docs.withColumns({"name": F.coalesce(name, F.lit(0).cast("long")), "print": F.xxhash64(name.isNull(), "text")})


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs (doc_id, text)``.

    Documents are linked when 100 * |intersection| >= ``percent`` * |union|, confirmed on full sets.
    """
    return _judged(docs, **how).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, k: int = 3, percent: int = 85, trees: int | None = None, leaf: int = 64, depth: int = 3, second: float | None = None, seed: int = 17, recall: float = 0.995, block: int = 1024, most_shingles: int = 1 << 21) -> DataFrame:
    """``near_duplicates`` with the ``print`` of each row. ``second`` and ``trees`` follow from ``percent`` and ``recall`` unless given."""
    second = min(100 / percent - 1, 1.0) if second is None else second
    trees = trees_for(percent, recall, depth, second) if trees is None else trees
    banks = max(map(_bank, range(trees))) + 1
    texts = _identified(docs.select("doc_id", "text"))
    signed = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "print", "text").mapInArrow(_signatures(k, banks), _SCHEMA)
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print", "row")).alias("first")
    sets = materialize(signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(first, F.first("n_shingles").alias("size"), F.any_value("minima").alias("minima"), F.any_value("wide").alias("wide")))
    set_id = hashed_id(sets, "set_a", "set_b")
    # from here to the components, doc_id is the id of a set: one row for all rows of equal sets
    unique = sets.select(set_id.alias("doc_id"), "minima")
    wide = sets.select(set_id.alias("doc_id"), "wide", F.coalesce("first.doc_id", F.lit(0).cast("long")).alias("name"), "first.print", "size")
    texts = texts.select("name", "print", "text")

    first = range(min(2, trees))
    early, late, never_small = _grow(unique, range(trees), first, leaf, depth, second, seed)
    known, edges = None, []
    for leaves, large in ((early, None), (late, never_small)):
        rows = _label(leaves, known)
        if large is not None:
            rows = rows.unionByName(_blocks(_label(large, known), block))
        edges.append(materialize(_edges(rows, texts, wide, k, percent, most_shingles)))
        if known is None:
            known = connected_components(edges[0])
    joined = edges[1].select(F.col("a").alias("id"), "b").join(known.withColumnRenamed("component", "ca"), "id", "left").select(F.coalesce("ca", "id").alias("a"), F.col("b").alias("id"))
    joined = joined.join(known.withColumnRenamed("component", "cb"), "id", "left").select("a", F.coalesce("cb", "id").alias("b"))
    known = _merge(known, connected_components(joined))

    found = sets.select(set_id.alias("id"), "first").join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "first")
    found = found.select("id", "component").join(found.groupBy("component").agg(F.min("first").alias("first")), "component").select("id", "first")
    out = signed.select("doc_id", "print", "n_shingles", "row", F.when(F.col("n_shingles") > 0, set_id).alias("id")).join(found, "id", "left")
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", "print", "n_shingles", component.alias("component_id"), F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"))


def _grow(unique: DataFrame, trees: range, first: range, leaf: int, depth: int, second: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All trees at once, level by level: the leaves of the ``first`` trees and the parts of their large nodes, the leaves of
    the other trees, and the nodes that are still large at the end."""
    size = 2 * POSITIONS
    roots = [F.struct(F.lit(mix_int(seed * 1000 + t) - (1 << 63)).alias("node"), F.substring("minima", 1 + size * _bank(t), size).alias("minima"), F.lit(t in first).alias("early")) for t in trees]
    level = unique.select("doc_id", F.explode(F.array(*roots)).alias("root")).select("root.node", "doc_id", "root.minima", "root.early")
    grown, large = [], level
    for at in range(depth):
        level = materialize(large.select("node", "doc_id", "minima", "early").mapInArrow(_children(at, second), "node long, doc_id long, minima binary, early boolean"))
        sizes = level.groupBy("node").agg(F.count("*").alias("n"), F.min_by("doc_id", F.xxhash64("doc_id", "node")).alias("hub")).where("n > 1")
        sized, state = observed(level.join(sizes, "node"), F.count_if(F.col("n") > leaf).alias("large"))
        grown.append(sized.where(F.col("n") <= leaf).select("node", "doc_id", "minima", "early"))
        large = sized.where(F.col("n") > leaf)
        if not state["large"]:
            break
        grown.append(_with_hub(large.where("early"), leaf))
    every = grown[0]
    for more in grown[1:]:
        every = every.unionByName(more)
    return every.where("early").drop("early"), every.where("not early").drop("early"), large.select("node", "doc_id", "minima", "n")


def _merge(known: DataFrame, more: DataFrame) -> DataFrame:
    """Components of components: ``more`` joins ids that are roots in ``known`` or not in it at all."""
    over = known.join(more.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return over.unionByName(more.join(known, "id", "left_anti").select("id", "component"))


def _with_hub(large: DataFrame, leaf: int) -> DataFrame:
    """A large node's documents in parts of about ``leaf``, each beside the node's hub."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.ceil(F.col("n") / leaf))
    rows = large.select("doc_id", "minima", "early", "n", F.xxhash64("node", part).alias("part"), F.col("node").alias("whole"), "hub")
    hubs = rows.where("doc_id = hub").select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / leaf) - 1), lambda p: F.xxhash64("whole", p))).alias("node"), "doc_id", "minima", "early")
    return rows.select(F.col("part").alias("node"), "doc_id", "minima", "early").unionByName(hubs)


def _blocks(large: DataFrame, block: int) -> DataFrame:
    """The exact way for nodes that never got small: documents outside the node's largest known component, in blocks of
    ``block``, against all blocks of the node. Minima alone travel, so a block of a thousand is some 64 KB."""
    counts = large.groupBy("node", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("node").agg(F.max_by("component", F.struct("c", "component")).alias("main"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0")
    rows = large.join(main, "node")
    blocks, outside = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("others") / block).cast("int")
    own, odd = F.pmod(F.xxhash64("doc_id", F.lit(5)), blocks), F.pmod(F.xxhash64("doc_id", F.lit(7)), outside)
    every = rows.select("node", own.alias("block"), F.explode(F.sequence(F.lit(0), outside - 1)).alias("odd"), "doc_id", "minima", "component")
    others = rows.where("component <> main").select("node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), odd.alias("odd"), "doc_id", "minima", "component")
    return every.unionByName(others).select(F.xxhash64("node", "block", "odd").alias("node"), "doc_id", "minima", "component")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The one row of each group of ``docs`` that is kept, columns unchanged."""
    judged = _judged(docs, **how)
    keys = judged.groupBy(F.coalesce("doc_id", F.lit(0).cast("long")).alias("name"), "print").agg(F.max("kept").alias("kept"), ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("repeated"))
    keys, state = observed(keys.where("kept").select("name", "print", "repeated"), F.count_if("repeated").alias("repeated"))
    packed = _identified(docs.select("doc_id", "text", F.struct("*").alias("whole"))).select("name", "print", "whole")
    out = packed.join(keys.where("not repeated"), ["name", "print"], "left_semi")
    if state["repeated"]:
        more = keys.where("repeated")
        one = _only(packed, more, "print").join(more, ["name", "print"], "left_semi").groupBy("name", "print").agg(F.first("whole").alias("whole"))
        out = out.unionByName(one)
    return out.select("whole.*")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i + 1, i + 3), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(0, CASE WHEN len(words) = 0 THEN 0 ELSE greatest(len(words) - 2, 1) END)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (
  SELECT doc_id, hash(shingle) AS h, n FROM s JOIN n USING (doc_id)
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(id, c) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id
), c AS (
  SELECT id, min(c) AS component_id FROM r GROUP BY id
)
SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.id
"""
