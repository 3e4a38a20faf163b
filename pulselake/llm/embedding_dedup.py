"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Every vector is turned by a few random rotations. Its code is the signs of the turned components; with each code
goes its factor, the inner product of the unit vector with its code, so that <code, turned query> / factor is an
unbiased estimate of the cosine with an error bound that follows from the factor alone. Groups of k code bits are
the keys of tables; two vectors meet where they agree in one table. k grows with the logarithm of the number of
vectors, so keys stay selective, and tables are added until a pair at the threshold meets with probability
``recall`` (0.995 at cosine 0.9; closer pairs practically always).

Where two vectors meet, the estimate decides: a pair whose upper confidence bound is below the threshold is
dropped, all others are recomputed exactly in double precision. A pair counts in the first table in which it meets.
Keys with many vectors are cut into blocks that meet pairwise in cells of their own, so no task holds a hot key,
and only counts and a spanning forest leave a cell, never its pairs. A key of n vectors moves each n / ``block`` times.

Equal vectors are one class from the start and are linked with each other.

Defined results: null, empty and zero vectors and those with null or non-finite components have no links and are
their own component; vectors of different lengths have no cosine and are not linked; rows with the same vec_id are
vectors of their own, linked by what they hold, and may be in several components, each named by its smallest vec_id;
a null vec_id is never linked; a cosine just at the threshold is decided as double precision rounds it; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, groups, hashed_id, materialize, mix, mix_int, slices

SEED = 64


@functools.cache
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthonormal matrices, one below the other."""
    rng = np.random.default_rng([SEED, dim])
    made = [np.linalg.qr(rng.normal(size=(dim, dim))) for _ in range(count)]
    return np.concatenate([q * np.where(np.diag(r) < 0, -1.0, 1.0) for q, r in made])  # without the signs not uniform


class Layout:
    """How many bits make a key and how many keys there are, for ``n`` vectors."""

    def __init__(self, n: int, threshold: float, recall: float, mean_bucket: int = 48):
        self.bits = int(np.clip(round(math.log2(max(n, 1) / mean_bucket)), 4, 30))
        self.agree = 1 - math.acos(threshold) / math.pi
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - self.agree**self.bits))
        self.threshold = threshold

    def turns(self, dim: int) -> int:
        return -(-self.bits * self.tables // dim)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """The keys (n, tables) of codes given as booleans (n, bits of all rotations)."""
        need = self.bits * self.tables
        chosen = signs[:, :need].reshape(len(signs), self.tables, self.bits)
        return (chosen * (1 << np.arange(self.bits, dtype=np.int64))).sum(axis=2)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components would be lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, rotations * dim) as booleans and the factors (n, rotations) of unit vectors."""
    dim = unit.shape[1]
    turned = unit @ turn.T
    return turned >= 0, np.abs(turned).reshape(len(unit), -1, dim).sum(axis=2) / math.sqrt(dim)


def estimate(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray, dim: int, sure: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of every code with every turned query, and how far each code's may be off.

    One rotation errs by about sqrt((1 - f^2) / f^2 / (dim - 1)); the mean over rotations by less. ``sure`` is the
    number of such deviations that the bound allows.
    """
    count = factors.shape[1]
    scale = np.repeat(1 / (factors * math.sqrt(dim) * count), dim, axis=1)
    guess = (np.where(signs, scale, -scale).astype(np.float32)) @ turned.T.astype(np.float32)
    spread = np.sqrt(((1 - factors**2).clip(0) / factors**2).mean(axis=1) / max(dim - 1, 1) / count)
    return guess, sure * spread[:, None] + 1e-4


def _encode_rows(layout: Layout):
    schema = pa.schema([("id", pa.int64()), ("bucket", pa.list_(pa.int64())), ("code", pa.binary()), ("factors", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(length).tolist():
                own = batch.filter(pa.array(length == dim))
                x = unit_rows(own.column(1), dim)
                signs, factors = encode(x, rotations(dim, layout.turns(dim)))
                keys = layout.keys(signs).astype(np.uint64)
                table = np.array([mix_int(dim * 1_000_003 + t) for t in range(layout.tables)], np.uint64)
                bucket = mix(mix(keys + np.uint64(1)) ^ table).view(np.int64)
                yield slices({"id": own.column(0), "bucket": bucket.tolist(), "code": [c.tobytes() for c in np.packbits(signs, axis=1)], "factors": factors.astype(np.float32).tolist()}, schema)

    return run


def _meet(layout: Layout):
    """Links within cells: rows ``(a, a, n)`` count a's links, rows ``(a, b, 0)`` are a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for cell in groups(batches, "cell"):
            ids = cell.column("id").to_numpy()
            if len(ids) < 2:
                continue
            side, table, copies = (cell.column(c).to_numpy() for c in ("side", "tbl", "copies"))
            vectors = cell.column("embedding").combine_chunks()
            dim = len(vectors[0])
            x = unit_rows(vectors, dim)
            turn = rotations(dim, layout.turns(dim))
            codes = np.frombuffer(b"".join(cell.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            signs = np.unpackbits(codes, axis=1)[:, : len(turn)].astype(bool)
            factors = cell.column("factors").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
            keys = layout.keys(signs)
            two = side.max() != side.min()  # two blocks: only pairs across; one block: pairs within
            left = np.flatnonzero(side == side.min())
            right = np.flatnonzero(side == side.max()) if two else left
            turned = x[right] @ turn.T
            links = np.zeros(len(ids), np.int64)
            label = np.arange(len(ids))
            forest: list[tuple[int, int]] = []
            for part in np.array_split(left, -(-len(left) // 256)):
                guess, error = estimate(signs[part], factors[part], turned, dim)
                i, j = np.nonzero(guess + error >= layout.threshold)
                a, b = part[i], right[j]
                if not two:
                    a, b = a[a < b], b[a < b]
                t = int(table[0])
                if t and len(a):
                    new = ~(keys[a][:, :t] == keys[b][:, :t]).any(axis=1)
                    a, b = a[new], b[new]
                for at in range(0, len(a), 1 << 16):
                    p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                    near = np.einsum("ij,ij->i", x[p], x[q]) >= layout.threshold
                    p, q = p[near], q[near]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    while len(p):  # joins as many components at a time as do not touch each other
                        apart = label[p] != label[q]
                        p, q = p[apart], q[apart]
                        if len(p):
                            one, other = int(p[0]), int(q[0])
                            forest.append((one, other))
                            label[label == label[other]] = label[one]
            some = np.flatnonzero(links)
            if len(some):
                f = np.array(forest, np.int64).reshape(-1, 2)
                yield slices({"a": np.concatenate([ids[some], ids[f[:, 0]]]), "b": np.concatenate([ids[some], ids[f[:, 1]]]), "n": np.concatenate([links[some], np.zeros(len(f), np.int64)])}, schema)

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.9, recall: float = 0.995, block: int = 2048) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``rows (vec_id, embedding)``."""
    kind = rows.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    classes = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    class_id = hashed_id(classes, "embedding")
    classes = classes.withColumn("id", class_id)
    layout = Layout(classes.count(), threshold, recall)

    coded = materialize(classes.select("id", "embedding").mapInArrow(_encode_rows(layout), "id long, bucket array<long>, code binary, factors array<float>"))
    members = coded.select("id", F.posexplode("bucket").alias("tbl", "bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    members = members.select("id", "tbl", cell.alias("cell"), F.when(F.col("blocks") > 1, F.col("own")).otherwise(0).alias("side"))
    full = members.join(coded.drop("bucket"), "id").join(classes, "id").select("cell", "id", "side", "tbl", "copies", "embedding", "code", "factors")
    met = full.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_meet(layout), "a long, b long, n long")
    met = materialize(met)

    links = met.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    parts = connected_components(met.where("a <> b").select("a", "b"))
    found = classes.select("id", "vec_id", "copies").join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = found.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    found = found.join(named, "component").select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.select("vec_id", class_id.alias("id")).join(found, "id").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9 * a.norm * b.norm
), r(id, c) AS (
  SELECT vec_id, vec_id FROM u UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), c AS (
  SELECT id, min(c) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT c.id AS vec_id, coalesce(n.n_links, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""
