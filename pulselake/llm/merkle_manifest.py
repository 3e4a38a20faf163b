"""Merkle manifest of a dataset: a hash tree over all rows, with an inclusion proof for each.

A leaf is the hash of a row's fields; leaves of a group ascend by their id, two consecutive nodes become their parent's
hash (a last one without a partner is hashed alone) until one is left, the group's subroot; subroots, ordered by group,
become the root in the same way.

The tree is built as large blocks under a small top. Rows are put in order by range partitions and numbered by the counts
of the partitions, so no task orders a group. ``2 ** levels`` consecutive leaves are one row of a written table; tasks
reduce each such block to one node. Only those nodes, ``MOST_TOP`` and one a group at most, go to the driver, which builds
the top and broadcasts it; a task reads the suffix path of a block from it, makes the block's own part of each proof, and
folds every row. ``levels`` grows with the number of leaves, so that the top stays within its bound.

Defined results: a null field is ``-``; a null group comes first, a null id comes first in its group; rows with one id are
ordered by their hashes, so repeated rows are leaves of their own; an empty table gives an empty manifest; extra columns are
ignored, and so are their names. More than ``MOST_GROUPS`` groups are an error, since the top would not be small.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import CRC32, documents, materialize

#: Nodes of the top besides one for each group: some 4 MB of text, and twice that with all levels above.
MOST_TOP = 1 << 16
MOST_GROUPS = 1 << 16
#: Levels of a block at least: 4096 leaves, about half a MB.
LEAST_LEVELS = 12

Step = tuple[str, str]  # what stands before a node and after it where its parent is hashed


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as text that no other fields can look like: its length in bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def parents(nodes: list[str]) -> list[str]:
    return [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def tree(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """All levels from ``nodes`` up to a single one, or exactly ``levels`` more, where a single node goes on alone."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append(parents(out[-1]))
    return out


def steps(levels: list[list[str]], at: int) -> list[Step]:
    """The path of node ``at`` from the lowest level to the highest."""
    out = []
    for nodes in levels[:-1]:
        other = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
        out.append((other, "") if at & 1 else ("", other))
        at >>= 1
    return out


def fold(node: str, path: list[Step]) -> str:
    for before, after in path:
        node = digest(before, node, after)
    return node


class Top:
    """Everything above the blocks: their nodes by group up to the subroots, and the subroots up to the root."""

    def __init__(self, nodes: dict[str, list[str]]):
        self.groups = {g: tree(nodes[g]) for g in sorted(nodes, key=str.encode)}
        self.place = {g: i for i, g in enumerate(self.groups)}
        self.crown = tree([levels[-1][0] for levels in self.groups.values()])

    @property
    def root(self) -> str:
        return self.crown[-1][0]

    def subroot(self, group: str) -> str:
        return self.groups[group][-1][0]

    def suffix(self, group: str, block: int) -> list[Step]:
        return steps(self.groups[group], block) + steps(self.crown, self.place[group])


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``pos``, the place within the group by (id, leaf, other), and ``n``, the group's size. Equal rows are told
    apart by where they are read, so a row that repeats a third of the table fills many partitions."""
    order = ["group", "id", "leaf", "other", "read"]
    rows = leaves.withColumn("read", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("read").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    rows = materialize(rows)
    # a row a group in each partition that holds some of it: partitions and groups together bound it
    counts = rows.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy("group")  # a row a partition
    counts = counts.withColumns({"n": F.sum("c").over(whole), "before": F.sum("c").over(whole.orderBy("part")) - F.col("c")})
    return rows.join(counts, ["group", "part"]).select("group", "id", "leaf", "other", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def levels_for(sizes: list[int], least: int = LEAST_LEVELS, most_top: int = MOST_TOP) -> int:
    """Levels of a block with which the blocks of groups of these sizes are ``most_top`` and one a group at most."""
    return next(k for k in itertools.count(least) if sum(n >> k for n in sizes) <= most_top)


def _block(leaves: list[str], n: int, levels: int) -> list[list[str]]:
    return tree(leaves, levels if n > 1 << levels else None)


def _block_nodes(levels: int):
    schema = pa.schema([("group", pa.string()), ("block", pa.int64()), ("node", pa.string())])

    def run(batches):
        for batch in batches:
            nodes = [_block(leaves, n, levels)[-1][0] for n, leaves in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.string())], schema=schema)

    return run


PROVEN = "group string, id long, leaf string, subroot string, root string, siblings array<string>, folded_root string"


def _prove(levels: int, shared):
    """Rows of each block with their siblings and the root that ``other`` (or the leaf, where it is null) folds to."""
    names = [f.strip().split(" ")[0] for f in PROVEN.split(",")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        top = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                own = _block([r["leaf"] for r in row["rows"]], row["n"], levels)
                subroot, suffix = top.subroot(row["group"]), top.suffix(row["group"], row["block"])
                for start in range(0, len(row["rows"]), 4096):
                    out = []
                    for at, r in enumerate(row["rows"][start : start + 4096], start):
                        path = steps(own, at) + suffix
                        out.append((row["group"], r["id"], r["leaf"], subroot, top.root, [s for step in path for s in step if s], fold(r["other"] or r["leaf"], path)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

    return run


def manifest(leaves: DataFrame, least_levels: int = LEAST_LEVELS, most_top: int = MOST_TOP) -> DataFrame:
    """``PROVEN`` for each row of ``leaves (group string, id long, leaf string, other string)``: ``siblings`` from the lowest level
    up to the root, and ``folded_root``, which equals ``root`` if ``other`` is null or the leaf itself. ``group`` is never null."""
    spark = leaves.sparkSession
    rows = numbered(leaves)
    sizes = [r.n for r in rows.where("pos = 0").select("n").limit(MOST_GROUPS + 1).collect()]
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    if not sizes:
        return spark.createDataFrame([], PROVEN)
    levels = levels_for(sizes, least_levels, most_top)
    packed = rows.groupBy("group", F.shiftright("pos", levels).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", "other"))).alias("rows"))
    packed = materialize(packed)
    nodes: dict[str, list[str]] = {}
    found = packed.select("group", "block", "n", F.col("rows.leaf").alias("leaves")).mapInArrow(_block_nodes(levels), "group string, block long, node string")
    for r in sorted(found.collect()):  # most_top and one a group
        nodes.setdefault(r.group, []).append(r.node)
    return packed.select("group", "block", "n", "rows").mapInArrow(_prove(levels, spark.sparkContext.broadcast(Top(nodes))), PROVEN)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("group"), F.col("doc_id").cast("long").alias("id"), leaf(*fields).alias("leaf"), F.when(tampered, leaf(*changed)).alias("other"),
    )
    return manifest(leaves).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


OP12_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce({CRC32.format("doc_id")} % 7 = 0, false) AS tampered
  FROM documents
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS other
  FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l
), t AS (
  SELECT 0 AS level, g, pos, n, leaf AS node FROM p
  UNION ALL
  SELECT level + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, g, pos // 2, n
), u AS (
  SELECT 0 AS level, g AS pos, (SELECT max(g) + 1 FROM p) AS n, node FROM t WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2, n
), a AS (
  SELECT level, g, pos, max(n) OVER (PARTITION BY g, level) AS n, node, (SELECT max(level) FROM t AS s WHERE s.g = t.g) AS top FROM t
), s AS (
  SELECT p.g, p.pos AS leaf_pos, x.level AS step, CASE WHEN (p.pos >> x.level) & 1 = 1 THEN x.node ELSE '' END AS before, CASE WHEN (p.pos >> x.level) & 1 = 1 THEN '' ELSE x.node END AS after
  FROM p JOIN a AS x ON x.g = p.g AND x.level < x.top AND x.pos = xor(p.pos >> x.level, 1)
  UNION ALL
  SELECT p.g, p.pos, 1000 + u.level, CASE WHEN (p.g >> u.level) & 1 = 1 THEN u.node ELSE '' END, CASE WHEN (p.g >> u.level) & 1 = 1 THEN '' ELSE u.node END
  FROM p JOIN u ON u.n > 1 AND u.pos = xor(p.g >> u.level, 1)
), path AS (
  SELECT g, leaf_pos, string_agg(before || after, '' ORDER BY step) AS siblings FROM s GROUP BY g, leaf_pos
), every AS (
  SELECT DISTINCT g, level AS step FROM t WHERE n > 1
  UNION ALL SELECT DISTINCT p.g, 1000 + u.level FROM (SELECT DISTINCT g FROM p) p, u WHERE u.n > 1
), todo AS (
  SELECT p.g, p.pos, row_number() OVER (PARTITION BY p.g, p.pos ORDER BY e.step) AS k, coalesce(s.before, '') AS before, coalesce(s.after, '') AS after
  FROM p JOIN every e ON e.g = p.g LEFT JOIN s ON s.g = p.g AND s.leaf_pos = p.pos AND s.step = e.step
), folded AS (
  SELECT g, pos, 0 AS k, coalesce(other, leaf) AS node FROM p
  UNION ALL
  SELECT f.g, f.pos, f.k + 1, sha256(t.before || f.node || t.after) FROM folded f JOIN todo t ON t.g = f.g AND t.pos = f.pos AND t.k = f.k + 1
)
SELECT p.doc_id, p.leaf, t.node AS subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(coalesce(path.siblings, '')) AS proof_sha256, d.node AS folded_root,
  d.node = (SELECT node FROM u WHERE n = 1) AS verified
FROM p JOIN t ON t.g = p.g AND t.n = 1 LEFT JOIN path ON path.g = p.g AND path.leaf_pos = p.pos
JOIN (SELECT g, pos, arg_max(node, k) AS node FROM folded GROUP BY g, pos) d ON d.g = p.g AND d.pos = p.pos
"""
