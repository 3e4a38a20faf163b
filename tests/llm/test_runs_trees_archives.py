"""Periodic runs, Merkle manifest and archive conversion against brute force, and their edge cases."""

import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from pulselake.llm import merkle_manifest, periodic_runs, warc_convert

# --- periodic runs --------------------------------------------------------------------------------


def brute_runs(words, least=6, exponent=4):
    """Every maximal stretch with a period, smallest periods only, straight from the definition."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, exponent * q):
                out.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


TEXTS = [
    None, "", " \t\n ", "one", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "a y", "a b c " * 40, "a " * 9 + "b " * 7 + "a " * 12, "ab ab ab " * 6,
    " ".join(str((i * i) % 7) for i in range(300)), "q " + " ".join("the cat sat on".split() * 5) + " " + "z z z z z z z w", "  " * 8, " ".join(("u v " * 8 + "w ") * 6 for _ in range(2)),
]


@pytest.mark.parametrize("cells", [1 << 26, 200])
def test_runs_equal_brute_force_in_one_range_and_in_many(spark, cells):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(None, "a a a a a a a", 1), (3, TEXTS[7], 2), (3, TEXTS[7], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs long")
    got = periodic_runs.periodic_runs(docs, cells=cells)
    assert got.columns == ["doc_id", "text", "Runs", "runs_", "collapsed"]
    got = got.collect()
    assert sorted(repr((r[0], r[1], r[2])) for r in got) == sorted(map(repr, rows))
    for r in got:
        words = [w.decode() for w in (r.text or "").encode().split()]
        want = brute_runs(words)
        assert [(x.start, x.length, x.period) for x in r.runs_] == want and r.collapsed == brute_collapse(words, want)


def test_runs_of_no_rows(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_in_many_ranges(spark):
    words = [str((7 * i * i + i // 3) % 101) for i in range(6000)]
    words[1000:3000] = [words[1000 + i % 400] for i in range(2000)]
    words[5000:5300] = ["x", "y", "z"] * 100
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (got,) = periodic_runs.periodic_runs(docs, cells=1 << 18).collect()
    assert [(r.start, r.length, r.period) for r in got.runs] == brute_runs(words)
    assert any(r.period == 400 for r in got.runs) and any(r.period == 3 for r in got.runs)


def test_repeated_text_matches_its_rule(spark):
    words = [f"w{i}" for i in range(37)]
    h = 123450
    g = h // 10
    a = g % 37
    p = 1 + (37 - a) // (3 + g % 8)
    want = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(37))
    rows = spark.createDataFrame([(1, " ".join(words), h), (2, " ", h), (3, None, h), (4, "a b", h + 1), (5, "a b", None)], "doc_id long, text string, h long")
    got = periodic_runs.with_repeats(rows.select("doc_id", "text", "h"), F.col("h")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, want), (2, " "), (3, None), (4, "a b"), (5, "a b")]


# --- Merkle manifest ------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_reduce(nodes):
    """Root, and for each node what stands before and after it on its way up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            up.append(sha(*run))
            up_owners.append([o for k in range(i, i + len(run)) for o in owners[k]])
            for k, side in enumerate(run):
                other = run[1 - k] if len(run) == 2 else ""
                for o in owners[i + k]:
                    paths[o].append((other, "") if k else ("", other))
        nodes, owners = up, up_owners
    return nodes[0], paths


def brute_manifest(leaves):
    groups = {}
    for group, i, leaf, other in sorted(leaves, key=lambda r: (r[0].encode(), r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or "")):
        groups.setdefault(group, []).append((i, leaf, other))
    parts = {g: brute_reduce([leaf for _, leaf, _ in rows]) for g, rows in groups.items()}
    root, crown = brute_reduce([parts[g][0] for g in groups])
    out = []
    for k, (g, rows) in enumerate(groups.items()):
        for (i, leaf, other), path in zip(rows, parts[g][1], strict=True):
            path, node = path + crown[k], other or leaf
            for before, after in path:
                node = sha(before, node, after)
            out.append((g, i, leaf, parts[g][0], root, [s for step in path for s in step if s], node))
    return out


@pytest.mark.parametrize(("least", "top"), [(12, 1 << 16), (1, 4), (2, 1 << 16), (0, 1 << 16)])
def test_manifest_equals_brute_force(spark, least, top):
    rows = [(g, i, sha(g, str(i)), sha("other", str(i)) if i % 7 == 0 else None) for g, n in (("", 1), ("=de", 37), ("=en", 64), ("=é", 2), ("=zz", 5)) for i in range(n)]
    rows += [("=en", None, sha("null"), None), ("=en", 5, sha("twin"), None), ("=en", 5, sha("twin"), None)]
    leaves = spark.createDataFrame(rows, "group string, id long, leaf string, other string").repartition(7)
    got = [tuple(r) for r in merkle_manifest.manifest(leaves, least, top).collect()]
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[5])
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)
    assert {r[6] == r[4] for r in got if r[1] is not None and r[1] % 7} == {True}


def test_manifest_of_no_rows_and_of_one(spark):
    kinds = "group string, id long, leaf string, other string"
    assert merkle_manifest.manifest(spark.createDataFrame([], kinds)).collect() == []
    (one,) = merkle_manifest.manifest(spark.createDataFrame([("", 1, sha("x"), None)], kinds)).collect()
    assert one.subroot == one.root == one.folded_root == sha("x") and one.siblings == []


def test_too_many_groups_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "MOST_GROUPS", 3)
    leaves = spark.range(4).select(F.col("id").cast("string").alias("group"), "id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("other"))
    with pytest.raises(ValueError, match="groups"):
        merkle_manifest.manifest(leaves)


def test_leaves_tell_fields_apart(spark):
    row = spark.createDataFrame([(12, "é", None)], "a long, b string, c string").select(merkle_manifest.leaf(F.col("a"), F.col("b"), F.col("c")).alias("h")).first()
    assert row.h == sha("2:12", "2:é", "-")


def test_levels_keep_the_top_within_its_bound():
    assert merkle_manifest.levels_for([10]) == 12
    k = merkle_manifest.levels_for([10**10, 3, 7], 12, 1 << 16)
    assert (10**10 >> k) <= 1 << 16 < (10**10 >> (k - 1))


# --- archives -------------------------------------------------------------------------------------

BIG = "<p>" + "é\r\n\r\nWARC/1.1\r\nx " * 90


def pages(spark):
    rows = [
        (1, "http://a.example/one two", BIG), (2, "http://a.example/2", BIG), (9, "https://b.example/9?q=ü", BIG), (9, "https://b.example/9b", BIG), (3, None, None), (4, "http://a.example/4", ""),
        (5, "http://a.example/5", "short"), (6, "http://a.example/6", "short"), (None, "http://a.example/n", BIG), (None, "http://a.example/n", "z" * 2000), (None, "http://a.example/m", "z" * 2000),
        (7, "http://a.example/7", "y" * 1000), (8, "http://a.example/8", "y" * 1000), (10, "http://a.example/10", "w" * 999), (11, "http://a.example/11", "w" * 999),
    ]
    return rows, spark.createDataFrame([(*r, "20240229235959", "x") for r in rows], "page_id long, url string, html string, when string, path string")


@pytest.mark.parametrize("segment", [1 << 24, 1500])
def test_archives_come_back_as_they_were(spark, segment):
    rows, table = pages(spark)
    even = F.coalesce(F.col("page_id") % 2 == 0, F.lit(True))
    folder = warc_convert.convert(spark, [warc_convert.write_arc(table.where(even), 1, segment), warc_convert.write_arc(table.where(~even), 2, segment)])
    got = warc_convert.records(spark, folder).collect()
    assert len(got) == len(rows) and len({r.record for r in got}) == len(rows)
    at = {r.record: r for r in got}
    last = {}
    for page, _, html in rows:
        if html and len(html.encode()) >= 1000 and page is not None:
            last[html] = max(page, last.get(html, page))
    want = []
    for page, _, html in rows:
        raw, top = (html or "").encode(), last.get(html)
        revisit = top is not None and (page is None or page < top)
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, at[r.refers].page_id if r.refers else None) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    text = b"".join(warc_convert.opened(bytes(r.content)) for r in warc_convert._files(spark, [folder]).collect())
    kinds = [h["warc-type"] for h, _ in warc_convert.read_warc(text)]
    assert kinds.count("warcinfo") >= 2 and b"WARC-Date: 2024-02-29T23:59:59Z\r\n" in text and b"WARC-Target-URI: http://a.example/one%20two\r\n" in text


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, when string")
    assert warc_convert.records(spark, warc_convert.convert(spark, [warc_convert.write_arc(empty, 1)])).collect() == []


ARC1 = (
    b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://x.example/a b 10.1.2.3 19970203040506 text/html 42\nHTTP/1.0 200 OK\r\nX: 1\r\n\r\n<p>one\n\ntwo</p>\n\n\n"
    b"dns:x.example 10.0.0.1 199702030405 text/dns 5\n1 2 3\n"
)


def test_version_one_by_hand():
    data = ARC1.replace(b"plain 76", b"plain %d" % len(b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n")).replace(b"html 42", b"html %d" % len(b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\n<p>one\n\ntwo</p>\n"))
    info, page, dns = warc_convert.read_arc(data)
    assert info.offset == 0 and page.fields["URL"] == "http://x.example/a b" and bytes(page.body).endswith(b"two</p>\n") and bytes(dns.body) == b"1 2 3"
    (headers, block), = warc_convert.read_warc(warc_convert.converted(page, "old.arc", None))
    assert headers["warc-type"] == "response" and headers["warc-date"] == "1997-02-03T04:05:06Z" and headers["warc-ip-address"] == "10.1.2.3"
    assert headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>one\n\ntwo</p>\n").digest()).decode() and bytes(block) == bytes(page.body)
    assert uuid.UUID(headers["warc-record-id"][10:-1]).version == 5
    (headers, _), = warc_convert.read_warc(warc_convert.converted(dns, "old.arc", None))
    assert (headers["warc-type"], headers["content-type"], headers["warc-date"]) == ("resource", "text/dns", "1997-02-03T04:05:00Z")


@pytest.mark.parametrize("bad", [b"http://x 1.1.1.1 1997 text/html 3\nabc", b"filedesc://x 0 1997 text/plain 9999\n1 0 x\n", b"filedesc://x 0 1997 text/plain 10\n3 0 x\nURL\n", b"filedesc://x 0 1997 text/plain none\n"])
def test_bad_archives_are_errors(bad):
    with pytest.raises(ValueError):
        list(warc_convert.read_arc(bad))
