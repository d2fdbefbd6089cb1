"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  A word scores between -1 and 1 by the
elements around it (their names, classes and ids, and whether it is in a link;
of html, body and the page's wrappers only names that speak for content count);
a tag costs up to 0.3, more for kinds of tags that stand outside content.
The weights are fitted on labelled pages: those with exactly one <article> or
<main>, whose words are content unless an element inside is named as something
else.  One linear scan finds the contiguous region of the largest sum; blocks
inside it that score below zero (an advert or comments in an article) are left
out."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .logistic import fit_softmax

FIT_ROWS = 5_000
FIT_DEPTH = 200  # pages of deeper nesting are not taken for the fit
SIGNATURES = 5_000
DECAY = 1e-4
TAG = 0.3  # the most that a tag costs, in words

# HTML elements whose text is never shown as text, elements that hold
# others, and elements that begin a new block.
HIDDEN = "script style title noscript template svg iframe select textarea button"
CONTAINERS = ("html body div article main section aside nav header footer form ul ol li dl dd dt table thead tbody tfoot tr td th "
              "figure figcaption blockquote details summary fieldset menu dialog address center head a")
BLOCKS = CONTAINERS.removesuffix(" a") + " p h1 h2 h3 h4 h5 h6 pre hr caption legend option"
# Words in element names, classes and ids that tell what an element is
# for, with the prior log odds that its words are content.
PRIOR = {
    5.0: "article main",
    1.5: "content post entry story text body articlebody maincontent",
    -1.5: "header a",
    -12.0: ("nav footer aside menu sidebar ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
           "cookie cookies consent notice notices comment comments reply replies respond disqus newsletter subscribe signup login "
           "breadcrumb breadcrumbs pagination pager share sharing social related recommended popup modal copyright widget toolbar masthead "
           "topbar navbar navigation skip search form dialog"),
}
# Words that leave a class such as "ad-box" or "post-comments" what its other
# part says; beside any other word ("social-history") that part tells of the content.
BESIDE = ("area banner bar block bottom box btn button buttons col column container content desktop fixed form global group heading icon icons id inner "
          "inline item items js left link links list main mobile modal module new outer page panel post primary results right row secondary section site "
          "slot sticky tab text title top unit user widget wrap wrapper")
MOST, ALL = 0.5, 0.9  # the share of a page's words that makes an element a wrapper: if a part of a longer class word speaks against it; in any case
_PRIOR = {word: value for value, names in PRIOR.items() for word in names.split()}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(HIDDEN.split())})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>"
    r"|<[/!?][^>]*>|<[a-zA-Z][^>]*\Z|([^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CONTAINERS, _BLOCKS, _BESIDE = set(CONTAINERS.split()), set(BLOCKS.split()), set(BESIDE.split())
_UNCLOSED = {"li", "a", "td", "th", "tr", "dt", "dd"}


class _Element:
    __slots__ = ("depth", "name", "names", "score", "up", "whole", "words")

    def __init__(self, name: str, attributes: str, up: _Element | None):
        values = " ".join(" ".join(x) for x in _NAMES.findall(attributes)).lower()
        parts = {name}
        for value in values.split():
            found = _PART.findall(value)
            told = {x for x in found if _against((x,))}
            parts.update(found if told.issuperset(x for x in found if x not in _BESIDE) else (x for x in found if x not in told))
        self.name, self.up, self.words, self.score, self.depth = name, up, 0, 0.0, up.depth + 1 if up else 1
        self.names = frozenset() if name in ("html", "body", "head") else frozenset(
            parts - {"html", "body", "head", "div"} | ({"body"} & parts - {name}))
        self.whole = {name, *values.split()}  # names that stand alone


def _against(names) -> bool:
    return any(_PRIOR.get(x, 0) < -5 for x in names)


def _settle(elements: list[_Element], total: int) -> None:
    """Sets the names of each element that count around its words and those of the elements
    in it.  Names that speak against content do not count for the
    largest main element, for the largest article (at least half of that main, and not
    itself named as comment, advert or the like), for what holds either, and for
    elements with nearly ALL of the page's words, or with MOST of them if such names
    are but parts of their classes and ids."""
    for e in reversed(elements):
        if e.up:
            e.up.words += e.words
    main = max((e for e in elements if e.name == "main"), key=lambda e: e.words, default=None)
    article = max((e for e in elements if e.name == "article" and not _against(e.whole)), key=lambda e: e.words, default=None)
    if main and article and 2 * article.words < main.words:
        article = None
    wrappers = set()
    for e in (main, article):
        while e and id(e) not in wrappers:
            wrappers.add(id(e))
            e = e.up
    for e in elements:
        named = e.whole - {"form", "dialog"}
        if id(e) in wrappers or e.words > total * (ALL if _against(named) else MOST):
            e.names = frozenset(x for x in e.names if _PRIOR.get(x, 0) >= 0)


def _walk(elements: list[_Element], enter, leave) -> None:
    """Calls ``enter(name)`` for the first of the open elements that bears a name, ``leave(name)``
    when the last one ends, and sets each element's ``score`` to what ``enter`` and ``leave``
    have summed up to: work in proportion to the names, whatever the nesting."""
    total, path, borne = 0.0, [], Counter()
    for e in elements:  # in the order of their beginning
        while path and path[-1] is not e.up:
            for x in path.pop().names:
                borne[x] -= 1
                if not borne[x]:
                    total += leave(x)
        path.append(e)
        for x in e.names:
            borne[x] += 1
            if borne[x] == 1:
                total += enter(x)
        e.score = total


def tokens(page: str | None) -> tuple[list[tuple], list[_Element]]:
    """The tokens of a page, (words, raw text, element or None) of a text and (name,
    whether a block begins) of a tag, and its elements in the order of their beginning."""
    found: list[tuple] = []
    elements: list[_Element] = []
    open_: list[_Element] = []
    places: dict[str, list[int]] = {}  # of the open elements by name

    def close(at: int) -> None:
        while len(open_) > at:
            places[open_.pop().name].pop()

    total = 0
    for m in _TOKEN.finditer(page or ""):
        if (text := m[5]) is not None:
            n = len(text.split())
            total += n
            if open_:
                open_[-1].words += n
            found.append((n, text, open_[-1] if open_ else None))
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        found.append((name, name in _BLOCKS))
        if name not in _CONTAINERS:
            continue
        if not m[2]:
            if name in _UNCLOSED and open_ and open_[-1].name == name:
                close(len(open_) - 1)  # an unclosed one before
            if not m[0].endswith("/>"):
                elements.append(_Element(name, m[4] or "", open_[-1] if open_ else None))
                places.setdefault(name, []).append(len(open_))
                open_.append(elements[-1])
        elif places.get(name):
            close(places[name][-1])
    _settle(elements, total)
    return found, elements


def labelled(page: str | None) -> list[tuple[str, str, bool, int]] | None:
    """(kind, key, inside, number) of the words by the names around them and of the tags
    of a page with exactly one article or main element that holds content, of at most
    ``FIT_DEPTH`` nested elements; else None."""
    if len(re.findall(r"<(?:article|main)\b", page or "", re.I)) != 1:
        return None
    all_, elements = tokens(page)
    if max((e.depth for e in elements), default=0) > FIT_DEPTH:
        return None
    around: dict[int, frozenset] = {}
    for e in elements:
        around[id(e)] = around[id(e.up)] | e.names if e.up else e.names
    found: Counter = Counter()
    depth = False
    for t in all_:
        if len(t) == 2:
            found["tag", t[0], depth] += 1
        elif t[0]:
            names = around[id(t[2])] if t[2] else frozenset()
            depth = bool(names & {"article", "main"}) and not _against(names)
            found["word", " ".join(sorted(names)), depth] += t[0]
    if not any(kind == "word" and inside for kind, _, inside in found):
        return None  # its one article is a comment or the like
    return [(*k, n) for k, n in found.items()]


class Scorer:
    def __init__(self, rows: list[tuple[str, str, bool, int]]):
        words: dict[str, list[int]] = {}
        tags: dict[str, list[int]] = {}
        for kind, key, inside, n in rows:
            (words if kind == "word" else tags).setdefault(key, [0, 0])[bool(inside)] += n
        names = sorted({x for k in words for x in k.split()} | set(_PRIOR))
        at = {x: i for i, x in enumerate(names)}
        prior = np.array([_PRIOR.get(x, 0.0) for x in names] + [0.5])
        self.weights = dict(zip(names, prior[:-1].tolist(), strict=True)) | {"": 0.5}
        if words:
            x, y, n = [], [], []
            for k, (out, inside) in words.items():
                row = np.zeros(len(names) + 1)
                row[[at[w] for w in k.split()] + [-1]] = 1
                for label, count in ((0, out), (1, inside)):
                    if count:
                        x.append(row)
                        y.append(label)
                        n.append(count)
            w = fit_softmax(np.array(x), np.array(y), 2, np.sqrt(np.array(n)), np.stack([-prior / 2, prior / 2], 1), DECAY)
            w = w[:, 1] - w[:, 0]
            self.weights = dict(zip(names, w[:-1].tolist(), strict=True)) | {"": float(w[-1])}
        self.cost = {t: TAG * (out + 1) / (out + inside + 2) for t, (out, inside) in tags.items()}

    def extract(self, page: str | None) -> str:
        # blocks: [score, pieces]; sums between them decide the region
        blocks: list[tuple[float, str]] = []
        scores: list[float] = []
        pieces: list[str] = []
        score = cost = 0.0

        def flush():
            nonlocal score, cost
            text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
            if text:
                blocks.append((score, text))
                scores.append(score - cost)
                score = cost = 0.0
            pieces.clear()

        found, elements = tokens(page)
        weight, bias = self.weights, self.weights[""]
        _walk(elements, lambda x: weight.get(x, 0.0), lambda x: -weight.get(x, 0.0))
        for t in found:
            if len(t) == 3:
                score += t[0] * math.tanh((bias + (t[2].score if t[2] else 0.0)) / 2)
                pieces.append(t[1])
            else:
                if t[1]:
                    flush()
                elif t[0] == "br":
                    pieces.append(" ")
                cost += self.cost.get(t[0], TAG / 2)
        flush()
        best, region, total, first = 0.0, (0, 0), 0.0, 0
        for i, s in enumerate(scores):
            # a tag's cost lies before its block: the region may begin behind it
            if total - (blocks[i][0] - s) <= 0:
                total, first = blocks[i][0], i
            else:
                total += s
            if total > best:
                best, region = total, (first, i + 1)
        return "\n".join(t for s, t in blocks[region[0]:region[1]] if s > 0)


def fit(pages: DataFrame, rows: int = FIT_ROWS) -> list[tuple[str, str, bool, int]]:
    """Counts of words and tags inside and outside of content over about ``rows`` labelled
    pages (all if there are no more): at most ``SIGNATURES`` most frequent keys."""
    def count(b: pa.RecordBatch):
        found: Counter = Counter()
        for p in b.column("html").to_pylist():
            for kind, key, inside, n in labelled(p) or ():
                found[kind, key, inside] += n
        yield {"kind": [k[0] for k in found], "key": [k[1] for k in found], "inside": [k[2] for k in found], "n": list(found.values())}

    marked = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)\\b"))
    counts = C.map_rows(C.fit_sample(marked, "html", rows), count, "kind string, key string, inside boolean, n long")
    counts = counts.groupBy("kind", "key", "inside").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind", "key", "inside").limit(SIGNATURES)
    return [tuple(r) for r in counts.collect()]


def extract(pages: DataFrame, weights: list[tuple[str, str, bool, int]]) -> DataFrame:
    """``page_id, url, html`` to ``page_id, url, text, n_chars``: one row per input row.

    Null, empty and wordless pages give the empty text; a page without markup is one
    block; repeated rows give equal rows; of regions with equal sums the first is taken; other
    columns are ignored; an empty table stays empty.  Very long and deeply nested pages take
    time in proportion to their length.  Without any labelled page the prior weights score."""
    scorer = C.shared_model(pages.sparkSession, weights, Scorer)

    def rows(b: pa.RecordBatch):
        s = scorer()
        texts = [s.extract(p) for p in b.column("html").to_pylist()]
        yield {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return C.map_rows(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), rows,
                      f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
