"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page becomes a sequence of tags and stretches of text. Words score by where they stand (positive in
plain text, less in links, headings or lists), tags by their name (negative); both weights are log odds
learned from labelled pages, which are pages that mark their own article. One linear scan finds the
contiguous region with the largest sum. Menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are asides: known by element, or by the sum of what their class, id and role words weigh. A word
weighs its log odds of standing within labelled articles on top of what the prior of ``ASIDE_WORDS`` says; the labelled
pages can outweigh that. An aside costs its opening tag once, and nothing in an article that its page marks; its words cost nothing and are
never text, so one in the middle of an article does not cut it. Tags that the labelled pages do not show cost next to nothing.

Defined results: null html is an empty page; a page without words has an empty text; character
references are decoded; white space within a block becomes one space and blocks are joined by one;
an element that its page never closes ends with the page, but head, button, select, object and canvas swallow nothing
then; repeated rows and rows with a null page_id each give their own row; of two regions with the same sum the first is
taken; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|title|noscript|template|textarea|iframe|svg)\b.*?(?:</\1\s*>|\Z)"
    r"|<(head)\b.*?(?:</head\s*>|(?=<body\b))|<(object|canvas|select|button)\b.*?</\3\s*>"
    r"|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAME = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that stand for something else than the article, words of class, id or role that do so where
#: labelled pages say nothing about them, and words that turn such a word's meaning round.
ASIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar aside header masthead footer comment comments reply replies respond disqus discussion notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended widget toolbar pagination pager copyright disclaimer alert "
    "complementary contentinfo dialog".split()
)
NEGATIONS = {"no", "not", "non", "has", "have", "with", "without", "free", "less", "none", "off"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKS = {"article", "main"}

#: Weights where nothing is labelled: words by place, then tags by name.
DEFAULT = {"text": 1.0, "link": -0.5, "heading": 0.6, "list": 0.4, "aside": 0.0, "tag": -0.1, "tag:inline": -0.05, "tag:aside": -2.0, "tag:inside": 0.0}
#: An element is an aside if its class, id and role words weigh this much together; a word of the prior weighs -2.
ASIDE_AT = -1.5


def attributes(tag: str) -> list[str]:
    """The words of a tag's class, id, role and label, as they stand between white space."""
    return " ".join("".join(g) for g in ATTRIBUTE.findall(tag)).lower().split()


def prior(word: str, marked: bool) -> float:
    """What a class, id or role word weighs before any page is seen: its parts between hyphens and the like decide."""
    parts = set(re.findall(r"[a-z]+", word))
    if marked:
        parts -= {"header", "masthead"}  # an article may have a head of its own
    return -2.0 if parts & ASIDE_WORDS and not parts & NEGATIONS else 0.0


def tokens(page: str, weights: dict[str, float]) -> list[tuple[str, str, bool]]:
    """``(kind, text, in the page's own article)``: kinds are places of words and names of tags. The
    text of a tag is a space if it ends a block and empty otherwise."""
    out: list[tuple[str, str, bool]] = []
    open_tags: list[tuple[str, str]] = []  # with how it is known as an aside: by name, by word or not at all
    aside = link = heading = listed = marked = 0
    end = 0

    def text(raw: str) -> None:
        if raw:
            kind = "aside" if aside else "link" if link else "heading" if heading else "list" if listed else "text"
            out.append((kind, entities.unescape(raw), marked > 0 and not aside))

    for m in TOKEN.finditer(page):
        text(page[end : m.start()])
        end = m.end()
        tag = m.group()
        named = NAME.match(tag)
        if not named or any(m.groups()):
            if not tag.startswith("<!--"):
                out.append(("tag:inside", " ", False))
            continue
        name = named[1].lower()
        space = "" if name in INLINE else " "
        if tag[1] == "/":
            at = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == name), None)
            closed = [] if at is None else open_tags[at:]
            del open_tags[len(open_tags) - len(closed) :]
            was = bool(aside)
            for other, off in closed:
                aside -= bool(off)
                link -= other == "a"
                heading -= other in HEADINGS
                listed -= other in ("ul", "ol", "table", "dl")
                marked -= other in MARKS
            kind = "tag:inside" if was else f"tag:/{name}" if name in MARKS else "tag:inline" if name in INLINE else f"tag:{name}"
            out.append((kind, space, marked > 0 and not aside))
            continue
        by_word = False
        if name in MARKS and not marked:  # what holds the article is no aside, whatever it is called
            for i, (other, off) in enumerate(open_tags):
                if off == "word":
                    open_tags[i] = (other, "")
                    aside -= 1
        elif name not in ("body", "html"):
            by_word = sum(weights.get(f"attr:{w}", 0.0) + prior(w, marked > 0) for w in attributes(tag)) <= ASIDE_AT
        by_name = name in ASIDE_TAGS or (name == "header" and not marked) or (name == "article" and any(t == "article" for t, _ in open_tags))
        off = "name" if by_name else "word" if by_word else ""
        kind = "tag:inside" if aside or off and marked else "tag:aside" if off else "tag:inline" if name in INLINE else f"tag:{name}"
        out.append((kind, space, marked > 0 and not aside))
        if name in VOID or tag.endswith("/>"):
            continue
        if name in ("p", "li", "td", "tr", "option") and open_tags and open_tags[-1] == (name, ""):
            open_tags.pop()  # these end where the next begins
        open_tags.append((name, off))
        aside += bool(off)
        link += name == "a"
        heading += name in HEADINGS
        listed += name in ("ul", "ol", "table", "dl")
        marked += name in MARKS
    text(page[end:])
    return out


def _score(found: list[tuple[str, str, bool]], weights: dict[str, float]) -> np.ndarray:
    other = weights["tag"]
    return np.array([weights.get(kind, other) * (1 if kind.startswith("tag") else len(text.split())) for kind, text, _ in found] or [0.0])


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest positive sum, the first of equals."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    if total[end] - low[end] <= 0:
        return 0, 0
    return int(np.argmin(total[:end])), end


def extract(page: str, weights: dict[str, float]) -> str:
    found = tokens(page, weights)
    start, end = best_region(_score(found, weights))
    return " ".join("".join(text if kind != "aside" else " " for kind, text, _ in found[start:end]).split())


def _log_odds(inside: int, outside: int) -> float:
    return float(np.log((inside + 0.5) / (outside + 0.5)))


def word_weights(pages: list[str]) -> dict[str, float]:
    """Log odds of each class, id or role word: elements within a labelled article against elements beside it. Elements that
    hold an article say nothing."""
    counts: dict[str, list[int]] = {}
    for page in pages:
        stack: list[list] = []  # name, words, holds an article, stands within one
        marked = 0

        def leave(closed: list[list]) -> None:
            for _, found, holds, within in closed:
                for w in () if holds else found:
                    counts.setdefault(w, [0, 0])[0 if within else 1] += 1

        for m in TOKEN.finditer(page):
            named = NAME.match(m.group())
            if not named or any(m.groups()):
                continue
            name = named[1].lower()
            if m.group()[1] == "/":
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), len(stack))
                marked -= sum(x[0] in MARKS for x in stack[at:])
                leave(stack[at:])
                del stack[at:]
                continue
            if name in MARKS:
                for x in stack:
                    x[2] = True
            entry = [name, set(attributes(m.group())), name in MARKS, marked > 0]
            if name in VOID or m.group().endswith("/>"):
                leave([entry])
            else:
                stack.append(entry)
                marked += name in MARKS
        leave(stack)
    return {f"attr:{w}": float(np.clip(_log_odds(*c), -4.0, 4.0)) for w, c in counts.items()}


def fit(pages: list[str]) -> dict[str, float]:
    """Log odds of each class or id word, then of each kind within the labelled article against elsewhere, asides left
    out: words of plain text score at least 0.2, tags at most -0.05."""
    weights = DEFAULT | word_weights(pages)
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for page in pages:
        for kind, text, label in tokens(page, weights):
            side = inside if label else outside
            side[kind] = side.get(kind, 0) + (1 if kind.startswith("tag") else len(text.split()))
    least = {"text": 0.2, "heading": 0.1, "list": 0.1, "link": -2.0}
    for kind in {*inside, *outside} - {"aside", "tag", "tag:aside", "tag:inside", "tag:inline"}:
        odds = _log_odds(inside.get(kind, 0), outside.get(kind, 0))
        if kind in least:
            weights[kind] = float(np.clip(odds, least[kind], 1.0 if kind != "link" else -0.1))
        else:
            weights[kind] = float(np.clip(odds, -4.0 if kind.split(":")[1].strip("/") in MARKS else -0.5, -0.05))
    return weights


def fit_on(pages: DataFrame, rows: int = 300, most_chars: int = 200_000) -> dict[str, float]:
    """Weights from at most ``rows`` labelled pages of at most ``most_chars`` (both bounds documented): those with the
    smallest hashes. The hashes are chosen first, so each task sends ``rows`` of them and only chosen pages travel."""
    labelled = pages.where(F.lower("html").contains("<article") & (F.length("html") <= most_chars)).select(F.xxhash64("html").alias("hash"), "html")
    chosen = labelled.select("hash").distinct().orderBy("hash").limit(rows)
    found = labelled.join(F.broadcast(chosen), "hash").groupBy("hash").agg(F.min("html").alias("html"))  # at most ``rows`` hashes
    sample = [r.html for r in found.orderBy("hash").collect()]
    return fit(sample) if sample else dict(DEFAULT)


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages (page_id, url, html)``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in small_batches(batches, "html"):
            texts = [extract(page or "", weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, fit_on(pages))
