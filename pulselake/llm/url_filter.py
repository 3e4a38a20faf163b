"""URL filters over a sorted digest array.

The index holds, in ascending order, the 64-bit xxhash digests of all keys, then the ends of the keys' bytes and the
bytes. It is a file that tasks memory-map; they probe it with a vectorised binary search for all
candidates of a batch, and compare the stored full strings, so an equal digest of another string is
no hit. Every key is ``host + path prefix``; a URL's candidates are its host and parent domains, alone
and with each prefix of its path of a length that occurs among the keys of the index.

The longest fitting rule decides; without one, the host is looked up among the blocked hosts.

Lists are tables. ``shards`` says how many arrays their keys make; it is the caller's choice, and an array of more than
``MOST_BYTES`` is an error that names the number needed. One array is a file that every task holds, and nothing is shuffled.
Of several, cut by digest, each task maps those it meets one after the other: the distinct candidates of all URLs are dealt to
them, and the few candidates that are stored go back to their URLs. Both ways probe and confirm alike.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed; repeated rows and rows with a null page_id are judged alike and all returned; a rule that is listed twice, or with
two verdicts, counts once and then blocks; null rules, hosts and verdicts are ignored; extra columns are ignored; empty tables
give empty results, and an empty list allows everything.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

#: Fixed values: (host, path, verdict). A rule fits the host and all its subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hosts whose pages are blocked where no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
SEED = 71
#: Bytes of one digest array.
MOST_BYTES = 16 << 20


def _digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode(), SEED)


def write_index(keys: list[tuple[str, str, str]], path: str) -> None:
    """Keys ``(host + path, rule, verdict)``, sorted by digest, into one file."""
    rows = sorted((_digest(k), k, rule, verdict) for k, rule, verdict in keys)
    texts = ["\0".join(r[1:]).encode() for r in rows]
    with open(path, "wb") as f:
        f.write(np.array([len(rows)], np.uint64).tobytes())
        f.write(np.array([r[0] for r in rows], np.uint64).tobytes())
        f.write(np.cumsum([len(t) for t in texts], dtype=np.uint64).tobytes())
        f.writelines(texts)


class Index:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self.map, np.uint64, 1)[0])
        self.digests = np.frombuffer(self.map, np.uint64, n, 8)
        self.ends = np.frombuffer(self.map, np.uint64, n, 8 + 8 * n)
        self.base = 8 + 16 * n

    def _entry(self, at: int) -> list[str]:
        start = int(self.ends[at - 1]) if at else 0
        return self.map[self.base + start : self.base + int(self.ends[at])].decode().split("\0")

    def find(self, keys: list[str]) -> list[tuple[str, str] | None]:
        """``(rule, verdict)`` of each key that is stored, compared as a full string."""
        wanted = np.fromiter(map(_digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        out: list[tuple[str, str] | None] = [None] * len(keys)
        hits = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted)) if len(self.digests) else []
        for i in hits:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:  # several strings may share a digest
                key, rule, verdict = self._entry(j)
                if key == keys[i]:
                    out[i] = rule, verdict
                    break
                j += 1
        return out


def _candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys from the most to the least specific: longer hosts first, then longer path prefixes."""
    parts = host.split(".")
    names = [".".join(parts[i:]) for i in range(len(parts))] if host else []
    return [f"{name}{path[:n]}" for name in names for n in lengths if n <= len(path)]


def _keys(rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """``(key, rule, verdict)`` of all rules ``(host, path, verdict)`` and blocked hosts ``(host)``, each key once."""
    one = rules.where("host is not null and path is not null and verdict is not null").select(F.concat("host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    every = one.unionByName(blocked.where("host is not null").select(F.concat(F.lit("!"), "host").alias("key"), F.lit("").alias("rule"), F.lit("block").alias("verdict")))
    return every.groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"))


def _judge(name: str, lengths: list[int]):
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        index = Index(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys, owner, is_rule = [], [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                own = _candidates(host, path, lengths)
                blocked = [f"!{k}" for k in _candidates(host, "", [0])]
                keys += own + blocked
                owner += [i] * (len(own) + len(blocked))
                is_rule += [True] * len(own) + [False] * len(blocked)
            rule: list[str | None] = [None] * len(hosts)
            verdict = ["allow"] * len(hosts)
            for key, i, real, hit in zip(keys, owner, is_rule, index.find(keys), strict=True):
                if hit is None:
                    continue
                if real and (rule[i] is None or len(key) > len(rule[i])):
                    rule[i], verdict[i] = hit
                elif not real and rule[i] is None:
                    verdict[i] = hit[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    return run


def split_urls(pages: DataFrame) -> DataFrame:
    """``(page_id, host, path)``: A-Z of the host lower-cased, both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def _table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return rows if isinstance(rows, DataFrame) else spark.createDataFrame(list(rows), schema)


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED_HOSTS, shards: int = 1) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages (page_id, url)``. Lists are tables ``rules (host,
    path, verdict)`` and ``blocked (host)``, or short Python lists of the same."""
    spark = pages.sparkSession
    rules = _table(spark, rules, "host string, path string, verdict string")
    blocked = _table(spark, blocked if isinstance(blocked, DataFrame) else [(h,) for h in blocked], "host string")
    keys = _keys(rules, blocked)
    size = keys.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("rule") + 32), F.lit(0))).first()[0]
    if size > shards * MOST_BYTES:
        raise ValueError(f"lists of {size} bytes need {-(-size // MOST_BYTES)} shards")
    lengths = [r.n for r in rules.select(F.length("path").alias("n")).where("n is not null").distinct().orderBy(F.desc("n")).collect()]  # a URL's path has no more prefixes
    if shards > 1:
        return judge_by_shards(pages, materialize(keys), lengths, shards)
    folder = tempfile.mkdtemp(prefix="urls-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{os.path.basename(folder)}.idx")
    write_index([tuple(r) for r in keys.collect()], path)  # at most ``MOST_BYTES``
    spark.sparkContext.addFile(path)  # Spark serves it to every executor's own folder, replacements included
    return split_urls(pages).mapInArrow(_judge(os.path.basename(path), lengths), "page_id long, host string, path string, rule string, verdict string")


def _digests(shards: int):
    """Each row of ``(key, rule, verdict)`` with the shard of its digest."""
    schema = pa.schema([("shard", pa.int64()), ("is_index", pa.bool_()), ("key", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        for batch in batches:
            digests = [_digest(k) * shards >> 64 for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), *batch.columns], schema=schema)

    return run


def _probe():
    """In each shard the stored keys come first: they become its index, which the candidates after them are probed with."""
    schema = pa.schema([("key", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        shard, stored, index = None, [], None
        folder = tempfile.TemporaryDirectory(prefix="urls-")  # the task's own; gone with it
        path = os.path.join(folder.name, "shard.idx")
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            wanted: list[str] = []

            def found():
                nonlocal index, stored
                if index is None and stored:
                    if os.path.exists(path):
                        os.remove(path)  # what is mapped of the shard before stays readable until it is let go
                    write_index(stored, path)
                    index, stored = Index(path), []
                hits = [(k, *h) for k, h in zip(wanted, index.find(wanted) if index and wanted else [], strict=False) if h]
                wanted.clear()
                return hits

            hits: list[tuple[str, str, str]] = []
            for at, is_index, key, rule, verdict in rows:
                if at != shard:
                    hits += found()
                    shard, stored, index = at, [], None
                if is_index:
                    stored.append((key, rule, verdict))
                else:
                    wanted.append(key)
            hits += found() if wanted else []
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*hits, strict=True)], schema=schema)

    return run


def judge_by_shards(pages: DataFrame, keys: DataFrame, lengths: list[int], shards: int) -> DataFrame:
    """The same for lists of more than one shard. Hosts and paths are judged once, however many rows have them."""
    urls = split_urls(pages)
    places = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    names = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))
    prefixes = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>"), lambda x: x.isNotNull()))
    every = F.concat(F.flatten(F.transform(names, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))), F.transform(names, lambda h: F.concat(F.lit("!"), h)))
    candidates = places.select("host", "path", F.explode(every).alias("key"))
    asked = candidates.select(F.lit(False).alias("is_index"), "key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).distinct()
    dealt = keys.select(F.lit(True).alias("is_index"), "key", "rule", "verdict").unionByName(asked).mapInArrow(_digests(shards), "shard long, is_index boolean, key string, rule string, verdict string")
    hits = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("is_index")).mapInArrow(_probe(), "key string, rule string, verdict string")
    best = candidates.join(hits, "key").groupBy("host", "path").agg(
        F.max(F.struct((~F.col("key").startswith("!")).alias("real"), F.length("key").alias("n"), F.when(F.col("rule") != "", F.col("rule")).alias("rule"), "verdict")).alias("b"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b(h) AS (VALUES """ + ", ".join(f"('{h}')" for h in BLOCKED_HOSTS) + r"""),
m AS (
  SELECT s.page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY s.page_id
)
SELECT s.page_id, host, path, m.rule, coalesce(m.verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE s.host = b.h OR ends_with(s.host, '.' || b.h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m ON s.page_id = m.page_id
"""
