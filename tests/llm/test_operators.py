"""The training-data operators against brute force, round trips and edge cases."""

import html
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulselake.llm import chat_format, decontaminate, embedding_dedup, html_extract, license_scan, minhash_dedup, mixing, quality, substring_dedup, url_filter
from pulselake.llm.shared import connected_components, materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(3)
VOCABULARY = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 8, 300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("ranges", "copy", "whole", "cut", "node", "component", "rows", "low"):
            df = df.withColumn(name, F.lit(name))
    return df


EDGES = [None, "", " \t\n", "one", "one two", "a b c d", prose(4000, 9), prose(4000, 9), "é" * 300]


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_network_scores_whole_texts_and_learns(spark):
    good, bad = [prose(80, i) for i in range(60)], [" ".join(w.upper() + "!!" for w in prose(80, i).split()) for i in range(60)]
    frame = docs(spark, good + bad + EDGES, extra=True)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    model = quality.fit_on(frame, labels, epochs=6)
    rows = {r.doc_id: r for r in quality.score_quality(frame, model).collect()}
    assert len(rows) == 120 + len(EDGES)
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in held) for i in range(120))
    assert np.mean([rows[i].predicted == (i < 60) for i in held]) >= 0.9
    assert rows[120].score == rows[121].score and rows[126].score == rows[127].score and 0 <= rows[122].score <= 1
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    assert quality.score_quality(docs(spark, []), model).count() == 0
    assert quality.fit_on(frame, labels.where("false")) == 0.5


def test_quality_fit_keeps_the_rows_beside_a_very_long_text(spark):
    texts = ["word " * (10 << 20), *[prose(20, i) for i in range(20)], *[prose(20, i).upper() for i in range(20)]]
    rows = spark.createDataFrame([(1, texts[0])] * 1 + [(i + 2, t) for i, t in enumerate(texts[1:])], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 1, int(i < 21)) for i in range(41)], "doc_id long, quality int").where("doc_id > 0")
    first = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).orderBy(F.xxhash64("doc_id")).first().doc_id
    rows = rows.withColumn("doc_id", F.when(F.col("doc_id") == 1, first).when(F.col("doc_id") == first, 1).otherwise(F.col("doc_id")))
    assert isinstance(quality.fit_on(rows, labels, epochs=1), dict)


def test_quality_scan_equals_place_by_place():
    model = quality.fit([b"abc" * 200, b"xyz" * 90], np.array([1, 0], np.float32), epochs=2)
    for size in (0, 1, 4, 127, 128, 129, 512, 513, 1500):
        text = bytes(np.random.default_rng(size).integers(1, 255, size, dtype=np.uint8))
        data = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(600, np.uint8)])
        tops = []
        for start in quality.chunk_starts(size):
            places = range(start, min(start + quality.CHUNK, max(size, 1)))
            tops.append(np.maximum(np.max([sum(model["filters"][j][data[p + j]] for j in range(5)) for p in places], axis=0) + model["bias"], 0))
        want = quality.head(model, quality.describe(np.array(tops, np.float32), np.array([0]), np.array([size], np.float32)))[1][0]
        got = quality.score(model, np.frombuffer(text, np.uint8), np.array([0, size]))[0]
        assert got == pytest.approx(want, abs=1e-5)


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\/s>", "[TURN][\\TURN]", "<<s>", "[[OUT]", "", None, "a\nb", "<", "[", "</", "\\", "é[ROLE]x[/ROLE]"]
    roles = ["user", "assistant", "assistant", "system", "tool", None, "[ROLE]odd</s>"]
    turns = [(c, t, roles[(c + t * 3) % len(roles)], hard[(c * 5 + t) % len(hard)]) for c in range(20) for t in range(9)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(frame)).collect()}
    for c in range(20):
        own = [(r, x or "") for k, _, r, x in turns if k == c]
        assert [(t.role, t.text) for t in back[c].turns] == own
        assert back[c].loss_text == "".join(x for r, x in own if r == "assistant")
    assert chat_format.read_back(chat_format.format_conversations(frame.where("false"))).count() == 0


def test_mixing_targets_and_ties(spark):
    texts = [prose(20 + 13 * (i % 7), i) for i in range(300)] + EDGES
    frame = docs(spark, texts, extra=True).withColumn("source", F.when(F.col("doc_id") % 10 < 7, "big").when(F.col("doc_id") % 10 < 9, "mid").otherwise(None))
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in frame.collect()}
    total = sum(sizes.values())
    plan = {r.source: r for r in mixing.plan(mixing.sized(frame, 1)).collect()}
    weights, caps = {"big": 3.0, "mid": 1.0, None: 2.0}, {k: 2 * r.source_size for k, r in plan.items()}
    want, free, rest = {}, set(weights), 1.5 * total
    while free:  # clamp what is over its cap, share the rest again
        share = {k: rest * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k for k in free if share[k] > caps[k]}
        want |= {k: caps[k] for k in over} if over else share
        rest -= sum(caps[k] for k in over)
        free = free - over if over else set()
    assert {k: r.target for k, r in plan.items()} == pytest.approx(want)
    mixed = mixing.mix(frame, seed=1)
    assert mixed.columns == frame.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 2
    source = {r.doc_id: r.source for r in frame.collect()}
    for k, r in plan.items():
        taken = sum(sizes[d] * n for d, n in times.items() if source[d] == k)
        assert abs(taken - r.target) <= max(n for d, n in sizes.items() if source[d] == k)
    assert mixing.mix(frame.where("false")).count() == 0


def test_licenses_are_found_wherever_they_stand(spark):
    names = list(license_scan.TEMPLATES)
    texts = [f"{prose(37 + 11 * i, i)} {t} {prose(50, i + 99)}" for i, t in enumerate(license_scan.TEMPLATES.values())] + EDGES + [prose(500, 77)]
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs(spark, texts, extra=True)).collect()}
    assert {(i, n) for i, n in enumerate(names)} <= got
    assert all(d < len(names) for d, _ in got)
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.load({"x": "only four words here"}, 0.8, 0.001)


def plain_words(text):
    """Words as the scan sees them, one by one."""
    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w.strip("\"'()[]{}.,;:!?*") or w for w in WORD.findall(lower)]


def five(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_licenses_against_brute_force(spark):
    r = np.random.default_rng(31)
    texts = list(EDGES)
    for i in range(400):
        words = list(license_scan.TEMPLATES.values())[i % len(license_scan.TEMPLATES)].split()
        for _ in range(int(r.integers(0, max(2, len(words) // 12)))):
            words[int(r.integers(0, len(words)))] = f"edit{int(r.integers(0, 9))}"
        if i % 3 == 0:
            words = words[int(r.integers(0, 1 + len(words) // 5)) :]
        if i % 5 == 0:
            words[-1] += "." * 12
        texts.append(f"{prose(int(r.integers(0, 90)), i)} {'((' if i % 7 == 0 else ''}{' '.join(words)} {prose(int(r.integers(0, 60)), i + 900)}")
    wanted = {n: five(t) for n, t in license_scan.TEMPLATES.items()}
    want = {(d, n) for d, t in enumerate(texts) for n, w in wanted.items() if 10 * len(five(t or "") & w) >= 8 * len(w)}
    got = {(q.doc_id, q.license) for q in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert got == want and 150 < len({d for d, _ in want}) < 400
    twice = spark.createDataFrame([(None, texts[-1]), (None, texts[-1]), (7, texts[-1]), (7, texts[-1])], "doc_id long, text string")
    assert len(license_scan.scan_licenses(twice).collect()) == 2 * len({n for d, n in got if d == len(texts) - 1})


def brute_links(vectors, threshold):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if x[i] @ x[j] >= threshold}


def components(n, links):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return label


@pytest.mark.parametrize("block", [16, 512])
def test_vectors_against_brute_force(spark, block):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 32))
    x = np.concatenate([centres[r.integers(0, 12, 150)] + 0.05 * r.normal(size=(150, 32)), np.repeat(r.normal(size=(1, 32)), 60, axis=0) + 0.01 * r.normal(size=(60, 32)), r.normal(size=(100, 32))])
    x[5] = x[6]
    links = brute_links(x, 0.9)
    want = components(len(x), links)
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [1.0, None]), (None, [1.0] * 32)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1))
    rows = embedding_dedup.near_vectors(frame, block=block).collect()
    assert len(rows) == len(x) + len(odd)
    got = {q.vec_id: q for q in rows}
    count = np.zeros(len(x), int)
    for i, j in links:
        count[[i, j]] += 1
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= count.sum() and found >= 0.99 * count.sum()
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) >= 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904))
    assert embedding_dedup.near_vectors(frame.where("false")).count() == 0


def test_vectors_with_one_id_and_of_any_size(spark):
    r = np.random.default_rng(12)
    base = r.normal(size=16)
    near = [(base + 0.01 * r.normal(size=16)).tolist() for _ in range(50)]
    rows = [(i + 10, v) for i, v in enumerate(near)] + [(1, near[0]), (1, near[7]), (1, (-base).tolist()), (3, (-base).tolist())]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((q.vec_id, q.n_links, q.component_id) for q in got) == sorted([(i + 10, 51, 1) for i in range(50)] + [(1, 51, 1), (1, 51, 1), (1, 1, 1), (3, 1, 1)])
    odd = [(1, [1e-200, 0.0]), (2, [1e200, 1e180]), (3, [-1.0, 0.0]), (4, [0.9, math.sqrt(1 - 0.81)])]
    got = {q.vec_id: (q.n_links, q.component_id) for q in embedding_dedup.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), block=2).collect()}
    assert got[1][1] == got[2][1] == 1 and got[3] == (0, 3)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = embedding_dedup.rotations(64, 4)
    signs, factors = embedding_dedup.encode(x[:200], turn)
    guess, error = embedding_dedup.estimate(signs, factors, x[200:] @ turn.T, 64)
    off = guess - x[:200] @ x[200:].T
    assert abs(off.mean()) < 0.005 and (np.abs(off) <= error).all()


def brute_repeats(texts, window):
    first = {}
    words = [WORD.findall(t or "") for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in enumerate(words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = True
        out.append((len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [4, 32768])
def test_repeats_against_brute_force(spark, hot):
    common, runs = prose(70, 1), "la " * 120
    texts = [prose(90, 10 + i) + " " + common + " " + prose(40, 40 + i) for i in range(12)] + [prose(200, 10), common, common, runs, "x " + runs + "y", prose(49, 10), prose(50, 10)] + EDGES
    want = brute_repeats(texts, 50)
    frame = docs(spark, texts, extra=True)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame, hot=hot).collect()}
    for d, (_, gone, kept) in enumerate(want):
        assert got[d].text == (texts[d] if not gone else kept)
        assert got[d].n_chars == (None if texts[d] is None else len(got[d].text))
    assert substring_dedup.remove_repeats(frame.where("false")).count() == 0


def test_urls(spark, monkeypatch):
    urls = [None, "nothing", "http://A.Example.ORG/es/x", "https://example.org/en/123?q", "https://sub.x.org/", "http://x.com/fr/1", "http://x.com/de/", "http://www.cheap-pills.example.net/en/", "ftp://x.com", "http://notexample.org/es/", "x://y://z/w#f"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    one = sorted(map(tuple, url_filter.judge_urls(frame).collect()))
    assert one == sorted(map(tuple, url_filter.judge_urls(frame, shards=5).collect()))
    rules = spark.createDataFrame([*url_filter.RULES, ("org", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    hosts = spark.createDataFrame([(h,) for h in (*url_filter.BLOCKED_HOSTS, None)], "host string")
    for size in (200, 1 << 20):
        assert one == sorted(map(tuple, url_filter.judge_urls(frame.withColumn("host", F.lit("x")), rules, hosts, size).collect()))
        assert {r.verdict for r in url_filter.judge_urls(frame, [], [], size).collect()} == {"allow"}

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        bad = any(host == h or host.endswith("." + h) for h in url_filter.BLOCKED_HOSTS)
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if bad else "allow"

    assert one == sorted((i, *judged(u)) for i, u in enumerate(urls))
    repeated = spark.createDataFrame([(1, urls[2])] * 3 + [(None, urls[2]), (None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.judge_urls(repeated, shards=5).collect()) == ["allow", *["block"] * 4]
    verdict = {r[0]: (r[3], r[4]) for r in one}
    assert verdict[0] == (None, "allow") and verdict[2] == ("example.org/es/", "block") and verdict[3] == ("example.org/en/1", "block")
    assert verdict[4] == ("org/", "allow") and verdict[6] == ("com/de/", "block") and verdict[7] == (None, "block") and verdict[9] == ("org/", "allow")
    assert url_filter.judge_urls(frame.where("false")).count() == 0


def test_url_digests_that_collide_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_digest", lambda key: len(key))
    url_filter.write_index([("aa", "aa", "block"), ("bb", "bb", "allow")], str(tmp_path / "i"))
    assert url_filter.Index(str(tmp_path / "i")).find(["bb", "cc", "aa", "a"]) == [("bb", "allow"), None, ("aa", "block"), None]


def test_pages(spark):
    body = "<h1>Big  title</h1><p>First <b>bold</b>word &amp; more text here.<br>Second line of it.</p><ul><li>an item</li></ul><p>Last paragraph of the article.</p>"
    noise = "<form>name <input></form><div class='comments'><p>reader says hello there</p></div><aside>side things</aside>"
    page = f"<html><head><title>t</title><script>var t='</p>'</script></head><body><header>site name</header><nav><a href='/'>home</a><a href='/b'>more</a></nav><div class=\"cookie-notice\">we use cookies on this page</div><article>{body}</article>{noise}<footer>&copy; someone</footer></body>"
    want = "Big title First boldword & more text here. Second line of it. an item Last paragraph of the article."
    plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
    frame = spark.createDataFrame([(1, "u", page), (2, "u", plain), (3, None, None), (4, "u", ""), (5, "u", "just words"), (6, "u", "<p>cut <b>off & <a hre")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(frame, html_extract.fit_on(frame)).collect()}
    assert got == {1: want, 2: want, 3: "", 4: "", 5: "just words", 6: "cut off &"}
    assert html.unescape("&amp;") in got[1] and html_extract.main_text(frame.where("false"), dict(html_extract.DEFAULT)).count() == 0


def test_pages_give_their_own_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in html_extract.main_text(pages, html_extract.fit_on(pages)).collect()}
    assert len(got) == len(rows) > 20
    for i, page in rows.items():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert got[i] == " ".join(html.unescape(plain).split())


@pytest.mark.parametrize("labelled", [True, False])
def test_articles_keep_all_their_blocks(spark, labelled):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] if labelled else []
    weights = html_extract.fit(pages) if pages else dict(html_extract.DEFAULT)
    blocks = "<p>First one here.</p><ul><li>a b</li><li>c d</li></ul><blockquote>said so</blockquote><pre>x = 1\n  y</pre><table><tr><td>m</td><td>n</td></tr></table><figure><img src=x><figcaption>a caption</figcaption></figure><p>Last words.</p>"
    text = "First one here. a b c d said so x = 1 y m n a caption Last words."
    advert = f"<div class='ad-slot'>{'buy now ' * 60}</div>"
    for page, want in (
        (f"<body><article>{blocks}</article></body>", text),
        (f"<body><article><p>An introduction.</p>{advert}{blocks}</article></body>", "An introduction. " + text),
        (f"<div class='comment-free'>{blocks}</div>", text),
        (f"<div class='page-header-wrap'><article>{blocks}</article></div>", text),
        (f"<html><head><title>t</title><body>{blocks}", text),
        (f"<body>{blocks}<button>never closed <p>More.</p>", text + " never closed More."),
        (f"<article>{blocks}</article><div id=post-comments><p>{'a reader says so ' * 20}</p></div>", text),
        (f"<article><header><h1>Head</h1></header>{blocks}</article>", "Head " + text),
        (f"<p>{'long ' * 200000}</p>", " ".join(["long"] * 200000)),
    ):
        assert html_extract.extract(page, weights) == want


def test_best_region_is_the_best():
    for seed in range(30):
        s = np.random.default_rng(seed).normal(size=12)
        a, b = html_extract.best_region(s)
        best = max([0.0] + [s[i:j].sum() for i in range(12) for j in range(i + 1, 13)])
        assert s[a:b].sum() == pytest.approx(best)


def shingles(text, k):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_duplicates_against_brute_force(spark):
    base = [prose(120, i) for i in range(25)]
    texts = list(EDGES) + base
    for i in range(60):
        w = base[i % 8].split()
        w[(7 * i) % 120] = f"edit{i % 5}"
        texts.append(" ".join(w))
    texts += [base[0].upper(), "One", "one two"]
    sets = [shingles(t, 3) for t in texts]
    links = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    want = components(len(texts), links)
    for leaf in (4, 64):
        got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, texts, extra=True), leaf=leaf).collect()}
        assert [got[i].component_id for i in range(len(texts))] == want
        assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_repeated_and_null_ids_keep_one_row_a_group(spark):
    one, other, third, alone = prose(60, 900), prose(60, 901), prose(60, 902), prose(60, 903)
    near = " ".join([*one.split()[:-1], "end"])
    rows = [(5, one, "a")] * 4 + [(5, other, "b"), (2, other, "c"), (5, third, "d"), (9, near, "e"), (None, one, "f"), (None, alone, "g"), (None, alone, "g"), (7, None, "h"), (7, "", "i"), (7, "", "i"), (0, alone + " more", "j")]
    table = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = minhash_dedup.near_duplicates(table).collect()
    assert len(got) == len(rows)
    pairs = sorted(((r.doc_id, r.component_id) for r in got), key=repr)
    assert pairs == sorted([(5, 5)] * 4 + [(5, 2), (2, 2), (5, 5), (9, 5), (None, 5), (None, 0), (None, 0), (7, 7), (7, 7), (7, 7), (0, 0)], key=repr)
    kept = minhash_dedup.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(kept.collect(), key=repr) == sorted([(5, one, "a"), (2, other, "c"), (5, third, "d"), (7, None, "h"), (7, "", "i"), (7, "", "i"), (0, alone + " more", "j")], key=repr)
    assert sum(r.kept for r in got) == kept.count()
    nulls = spark.createDataFrame([(None, alone), (None, alone), (None, other)], "doc_id long, text string")
    assert sorted(r.text for r in minhash_dedup.keep_one(nulls).collect()) == sorted([alone, other])
    many = spark.createDataFrame([(1, one)] * 300 + [(1, near)] * 300 + [(2, other)], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(many).count() == 601
    assert sorted(r.doc_id for r in minhash_dedup.keep_one(many).collect()) == [1, 2]


def test_trees_follow_from_threshold_and_recall():
    for percent in (80, 85, 90):
        second = 100 / percent - 1
        trees = minhash_dedup.trees_for(percent, 0.995, 3, second)
        assert minhash_dedup.tree_recall(percent, trees, 3, second) >= 0.995 > minhash_dedup.tree_recall(percent, trees - 2, 3, second)


def test_recall_of_pairs_in_large_groups(spark):
    shared, texts = prose(240, 7000), []
    for i in range(120):
        private = prose(30, 8000 + i)
        texts += [f"{shared} {private} {prose(33, 9000 + 2 * i + j)}" for j in (0, 1)]
    sets = [shingles(t, 5) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs(spark, texts), k=5, percent=80, leaf=16).collect()}
    assert len(links) == 120 and sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_contamination_against_full_alignment(spark):
    items = [prose(18 + 3 * i, 500 + i) for i in range(6)] + [None, "tiny", "just enough"]
    r = np.random.default_rng(8)
    texts = list(EDGES)
    for i in range(30):
        c = list(items[i % 6])
        for _ in range(int(len(c) * (i % 5) * 0.04)):
            p = int(r.integers(0, len(c)))
            c[p : p + 1] = [["q"], [], ["q", c[p]]][int(r.integers(0, 3))]
        texts.append(f"{prose(30, i)}  {''.join(c).upper() if i % 2 else ''.join(c)}\n{prose(20, i + 60)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    norm = lambda t: " ".join((t or "").lower().split())
    want = set()
    for d, t in enumerate(texts[len(EDGES) :], len(EDGES)):
        for i, item in enumerate(items):
            m = len(norm(item))
            if m >= 8 and edit_distance(norm(item), norm(t)) <= min(int(m * 0.1), (m - 8) // 8):
                want.add((d, i))
    frame = docs(spark, texts, extra=True)
    assert decontaminate.find_contaminated(frame.withColumn("item_id", F.lit("x")), bench.withColumn("doc_id", F.lit(1)).withColumn("distance", F.lit("y"))).count() == len(want)
    for size in (4 << 20, 200):
        assert {(q.doc_id, q.item_id) for q in decontaminate.find_contaminated(frame, bench, block_chars=size).collect()} == want
    clean = decontaminate.remove_contaminated(frame, bench)
    assert clean.columns == frame.columns and {q.doc_id for q in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.find_contaminated(docs(spark, []), bench).count() == 0


def test_contamination_in_repetitive_texts_and_repeated_rows(spark):
    item = "ab" * 100
    known = decontaminate.Benchmark([(1, item)], 0.1)
    assert known.hits(["ab" * 20000]) == [(0, 1, 0, 200)]
    whole = decontaminate.Benchmark._reached
    r = np.random.default_rng(4)
    items = [(i, "".join(r.choice(list("abc "), int(n)))) for i, n in enumerate(r.integers(10, 90, 20))]
    known = decontaminate.Benchmark(items, 0.1)
    rows = [decontaminate.normalise("".join(r.choice(list("abc "), 400)) + items[int(k)][1] + "ab" * 50) for k in r.integers(0, 20, 20)]
    at = [sorted(map(tuple, known.regions(rows).T.tolist()))]
    for most in (5, 100):
        known._reached = lambda *a, most=most: whole(known, *a, most=most)
        at.append(sorted(map(tuple, known.regions(rows).T.tolist())))
    assert at[0] == at[1] == at[2] and len(at[0]) >= 20
    bench = spark.createDataFrame([(1, "a benchmark passage of some length")], "item_id long, text string")
    text = prose(50, 1) + " a benchmark passage of some length " + prose(2000, 2)
    table = spark.createDataFrame([(None, text), (5, text), (5, text), (6, None), (None, "clean")], "doc_id long, text string")
    assert sorted((q.doc_id for q in decontaminate.find_contaminated(table, bench).collect()), key=repr) == [5, 5, None]
    assert sorted(q.text or "" for q in decontaminate.remove_contaminated(table, bench).collect()) == ["", "clean"]


def test_stages_with_nulls_repeats_clashing_names_and_nothing(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    good = [t for t in (r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 1500 and 4000").orderBy("doc_id").limit(3).collect())]
    rows = [(None, good[0], "en", "s", 1), (None, None, "en", None, None), (4, good[1], "en", "s", 1), (4, good[1], "en", "s", 1), (5, None, "en", "s", 0), (6, "", None, "s", 0), (7, good[2] + " " + prose(20000, 5), "en", "t", 1)]
    table = spark.createDataFrame(rows, DOCS)
    for name in ("ranges", "copy", "node", "component", "print", "size", "side", "row", "first"):
        table = table.withColumn(name, F.lit(name))
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, table, sf)
        got = out.collect()
        assert out.columns == table.columns and 0 < len(got) <= 2 * len(rows)
        assert {r.text for r in got} - {None, ""}
        if work is corpus_pipeline.near_duplicate_stage:
            assert sorted((r.doc_id for r in got), key=repr) == [4, 5, 6, 7, None, None]
        else:  # empty tables of that operator have a test of their own
            assert work(spark, table.where("false"), sf).count() == 0


def test_a_stage_that_fails_leaves_nothing_behind(spark):
    table = docs(spark, [prose(60, i) for i in range(5)])

    @corpus_pipeline.stage
    def broken(spark, docs, sf_dir):
        materialize(docs)
        raise KeyError("no")

    with pytest.raises(KeyError):
        broken(spark, table, "")
    alive = materialize(table)  # outside of any stage: the next one must not delete it
    first = corpus_pipeline.mixing_stage(spark, table, "")
    again = corpus_pipeline.mixing_stage(spark, first, "")  # reads what the first one wrote on its way
    assert again.count() > 0 and alive.count() == 5


def test_pipeline_keeps_its_columns_and_reruns_agree(spark):
    sf = "/root/testdata/sf0.001"
    one, two = ([tuple(r) for r in corpus_pipeline.run(spark, sf).collect()] for _ in range(2))
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and one
    assert corpus_pipeline.run(spark, sf).columns == spark.read.parquet(f"{sf}/documents.parquet").columns


def test_repeated_rows_of_one_document_stay_linear(spark):
    passage = prose(80, 41)
    one, two = f"{prose(30, 42)} {passage}", f"{passage} {prose(30, 43)}"
    frame = spark.createDataFrame([(1, one)] + [(2, two)] * 1000 + [(3, passage)] * 3, "doc_id long, text string").repartition(8)
    found = substring_dedup.repeated_windows(frame).collect()
    assert sorted((r.doc_id, sorted((x["first"], x["n"]) for x in r.ranges)) for r in found if r.doc_id == 2)[0][1] is not None
    assert max(len(r.ranges) for r in found) <= 30 and len(found) <= 3
    got = substring_dedup.remove_repeats(frame).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text, r["count"]) for r in got} == {(1, one, 1), (2, prose(30, 43), 1000), (3, "", 3)}


def test_periodic_documents_in_salted_parts(spark):
    loop = " ".join([prose(40, 51)] * 60)
    frame = spark.createDataFrame([(1, loop), (2, loop + " " + prose(20, 52)), (3, prose(20, 53) + " " + loop)], "doc_id long, text string")
    whole = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame).collect()}
    parts = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame, hot=64).collect()}
    assert whole == parts and whole[1] == loop and len(whole[2].split()) < 80


def test_recall_out_of_reach_is_an_error():
    with pytest.raises(ValueError, match="trees"):
        minhash_dedup.trees_for(20, 0.999999, 3, 0.1)


def test_lists_beyond_one_array_ask_for_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BYTES", 200)
    with pytest.raises(ValueError, match="shards"):
        url_filter.judge_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"))


def test_very_long_benchmark_item(spark):
    item = prose(16_000, 61)
    assert len(item) > 70_000
    edited = " ".join("x" if i % 40 == 7 else w for i, w in enumerate(item.split()))
    frame = spark.createDataFrame([(1, f"{prose(50, 62)} {edited} {prose(50, 63)}"), (2, prose(3000, 64)), (3, prose(16_000, 61)[: 30_000])], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, prose(30, 65))], "item_id long, text string")
    (hit,) = decontaminate.find_contaminated(frame, bench).collect()
    assert (hit.doc_id, hit.item_id) == (1, 9) and 300 < hit.distance < 3000


def test_two_texts_under_one_id_are_two_places(spark):
    notice = license_scan.TEMPLATES[next(iter(license_scan.TEMPLATES))]
    rows = [(None, f"alpha {notice}"), (None, f"beta {notice}"), (None, f"beta {notice}"), (1, f"gamma {notice}")]
    got = {r.doc_id: r.n_places for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 1").groupBy("doc_id").agg(F.max("n_places").alias("n_places")).collect()}
    assert got == {None: 2, 1: 1}
