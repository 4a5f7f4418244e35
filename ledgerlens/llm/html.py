"""Main text of web pages by a maximum-scoring subsequence (operator 7).

A page is a sequence of words and tags. Words score positive, tags negative,
and a linear scan over the whole page finds the contiguous region with the
largest score. Weights are the log odds of lying inside, from labelled pages:
pages of the table that mark their content with exactly one ``article`` (or
``main``) element are labels, on a bounded sample of them (``LABELLED_PAGES``).
They are learned of words and of tags, by name and by the words of their class
and id; a word under elements whose words mostly lie outside weighs next to
nothing. So menus, footers, lists of comments and the like end the region
because pages have them outside of their content, whatever they are called.

Labels say nothing on what is put into an article (adverts, forms, notices,
share buttons). Within the region, and only there, elements told by tag, role,
class or id to be never content are left out of the text.

The region's text: character references are decoded, white space within a
block becomes one space, blocks are joined by one space in page order.

Defined cases: a null or empty page, or one without words, has an empty text;
unclosed and stray tags are tolerated; of regions that score alike the one that
ends first counts, and of those with one end the longest that no prefix lowers;
repeated rows are pages each; extra columns pass through and output columns
replace input columns of the same name; whole pages are read, of any length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, check_columns, schema_with, slices, texts, with_columns

LABELLED_PAGES = 500
MAX_KINDS = 600

# FIXED VALUES: names of elements and of class, id and role words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "iframe", "textarea", "title")
FOREIGN = frozenset(["svg", "math"])
EMBEDDED = FOREIGN | {"object", "canvas"}
NEVER = EMBEDDED | frozenset("nav menu footer aside form button select dialog head fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo "
    "promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments disqus respond replies cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended widget pagination pager skip".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu "
                      "menubar toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|(?P<start><(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*(?:>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)", re.S | re.I)
# A name, then its value if it has one; each is consumed whole, so nothing inside a value is taken for a name.
ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")
SPLIT = re.compile(r"[^a-z0-9]+")

#: Before a kind: the words under elements of this kind.
WITHIN = "#word<"
#: Weight of an inline tag that no label has.
LIGHT = -0.05
#: Weights for a table without labelled pages.
DEFAULT = {"#word": 0.7, "#tag": -3.0, "#cut": -0.3, "br": LIGHT} | {
    end + name: LIGHT for name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") for end in ("", "/")}


def _bad(name: str, attrs: str) -> bool:
    """Is an element with this start tag never content?"""
    if name in NEVER:
        return True
    if name in ("html", "body", "article", "main") or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in BAD_ROLES:
            return True
        if key in ("class", "id") and not BAD_WORDS.isdisjoint(SPLIT.split(value)):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str]]:
    """The page as (kind, text): '#text' runs, '#raw' elements whose content
    is no text or that are closed at once, and tags by lower-case name ('/name'
    for an end)."""
    out, at, foreign = [], 0, 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            out.append(("#text", page[at:m.start()]))
        at = m.end()
        if m["name"]:
            name = m["name"].lower()
            if m["end"]:
                foreign = max(0, foreign - (name in FOREIGN))
                out.append(("/" + name, ""))
            elif name in EMBEDDED and m["attrs"].endswith("/>"):
                out.append(("#raw", ""))
            else:
                foreign += name in FOREIGN
                out.append((name, m["attrs"]))
        elif m["raw"]:
            if foreign and m["start"].endswith("/>"):   # only drawings and formulas close such elements at once
                at = m.end("start")
            out.append(("#raw", ""))
    if at < len(page):
        out.append(("#text", page[at:]))
    return out


def boilerplate(items: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """[start, end) of the outermost elements that are never content, in order.
    An element that holds an article, or is never closed, is none of them."""
    closes = _closes(items)
    # how many starts of content there are before each token
    starts, content = [0], 0
    for kind, _ in items:
        content += kind in ("article", "main", "h1")
        starts.append(content)
    out, i, depth = [], 0, 0
    while i < len(items):
        kind, text = items[i]
        if kind in ("article", "main"):
            depth += 1
        elif kind in ("/article", "/main"):
            depth = max(0, depth - 1)
        if not kind.startswith(("#", "/")) and kind not in VOID:
            header = kind == "header" and not depth
            end = closes.get(i)
            if end is not None and (header or _bad(kind, text)) and \
                    (kind in NEVER or starts[end] == starts[i + 1] or (depth and kind != "header")):
                out.append((i, end + 1))
                i = end
        i += 1
    return out


def without_drawings(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The tokens with each drawing, formula or embedded object that is closed
    as one '#raw': its content is no text of the page and no structure of it."""
    closes = _closes(items)
    out, i = [], 0
    while i < len(items):
        end = closes.get(i) if items[i][0] in EMBEDDED else None
        out.append(items[i] if end is None else ("#raw", ""))
        i = i + 1 if end is None else end + 1
    return out


def _closes(items: list[tuple[str, str]]) -> dict[int, int]:
    """Place of the end tag of each start tag that has one (same-name nesting)."""
    open_: dict[str, list[int]] = {}
    out = {}
    for i, (kind, _) in enumerate(items):
        if kind.startswith("/"):
            if stack := open_.get(kind[1:]):
                out[stack.pop()] = i
        elif not kind.startswith("#") and kind not in VOID:
            open_.setdefault(kind, []).append(i)
    return out


@lru_cache(1 << 14)
def named(kind: str, attrs: str) -> tuple[str, ...]:
    """The kinds of a tag: its name and the words of its class and id ('.word';
    words with digits are names of single things)."""
    words = {w for key, *values in ATTR.findall(attrs) if key.lower() in ("class", "id")
             for w in SPLIT.split("".join(values).lower()) if w and w.isalpha()} if "=" in attrs else ()
    return (kind, *sorted("." + w for w in words))


def scores(items: list[tuple[str, str]], weights: dict[str, float]) -> list[float]:
    """Score of each token. Of a tag's kinds the least likely one counts, of a
    word's enclosing elements the one that makes it least likely."""
    closes = _closes(items)
    opener = {end: start for start, end in closes.items()}
    around: Counter = Counter()
    out, word = [], weights["#word"]
    for i, (kind, text) in enumerate(items):
        if kind == "#text":
            out.append(word * len(text.split()))
            continue
        if kind == "#raw":
            out.append(weights["#cut"])
            continue
        known = [weights[k] for k in named(kind, text) if k in weights]
        out.append(min(known) if known else LIGHT if kind.lstrip("/") in INLINE else weights["#tag"])
        if i in closes or i in opener:
            told = [k for k in named(*items[opener.get(i, i)]) if WITHIN + k in weights]
            around.update(dict.fromkeys(told, 1 if i in closes else -1))
            if told:
                word = min([weights["#word"], *(weights[WITHIN + k] for k, n in around.items() if n > 0)])
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """[start, end) of the run with the largest sum, by one scan."""
    best, where, total, begin = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(values):
        total += value
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best + 1e-12:
            best, where = total, (begin, i + 1)
    return where


def best_region(items: list[tuple[str, str]], weights: dict[str, float]) -> tuple[int, int]:
    """[start, end) of the run of tokens with the largest score."""
    return best_run(scores(items, weights))


def region_text(items: list[tuple[str, str]]) -> str:
    """Decoded text: inline tags join, all other tags part blocks."""
    parts = []
    for kind, text in items:
        if kind == "#text":
            parts.append(text)
        elif kind.lstrip("/") not in INLINE:
            parts.append("\n")
    return " ".join(html.unescape("".join(parts)).split())


def main_text(page: str, weights: dict[str, float]) -> str:
    items = without_drawings(tokens(page))
    a, b = best_region(items, weights)
    kept = []
    for start, end in boilerplate(items):
        if end > a and start < b:   # only what lies in the region is cut
            kept += [*items[a:start], ("#cut", "")]
            a = max(a, end)
    return region_text(kept + items[a:b])


def _labels(page: str):
    """(kind, inside?, count) of a labelled page; nothing for other pages."""
    items = without_drawings(tokens(page))
    cut = np.zeros(len(items) + 1, bool)        # cards in menus and asides are no content
    for start, end in boilerplate(items):
        cut[start:end] = True
    kinds = [k if not gone else "" for (k, _), gone in zip(items, cut)]
    name = "article" if kinds.count("article") else "main"
    if kinds.count(name) != 1 or kinds.count("/" + name) != 1 or kinds.index(name) > kinds.index("/" + name):
        return
    a, b = kinds.index(name), kinds.index("/" + name)
    closes = _closes(items)
    opener = {end: start for start, end in closes.items()}
    words, around, since = [0, 0], Counter(), {}
    for i, (kind, text) in enumerate(items):
        inside = a < i < b
        if kind == "#text":
            if n := len(text.split()):
                words[inside] += n
                yield "#word", inside, n
            continue
        for k in ("#cut",) if kind == "#raw" else named(kind, text):
            yield k, inside, 1
        if i in closes or i in opener:
            for k in named(*items[opener.get(i, i)]):
                # words under elements of a kind, those of nested ones once
                around[k] += 1 if i in closes else -1
                if i in closes and around[k] == 1:
                    since[k] = tuple(words)
                elif i in opener and around[k] == 0:
                    for side in (0, 1):
                        if words[side] > since[k][side]:
                            yield WITHIN + k, bool(side), words[side] - since[k][side]


def fit_weights(df: DataFrame, html_col: str = "html", labelled_pages: int = LABELLED_PAGES,
                seed: int = 23) -> dict[str, float]:
    """Weights from a seeded sample of about ``labelled_pages`` pages that may
    be labels: pages with exactly one article or main, and, while those are
    fewer, pages with several (all but one may be cards, comments or scripts). The
    driver receives one row for each of the ``MAX_KINDS`` commonest kinds."""
    article, main = (F.regexp_count(html_col, F.lit(rf"(?i)<{name}[\s/>]")) for name in ("article", "main"))
    tier = F.when(F.when(article > 0, article).otherwise(main) == 1, 1).when((article > 0) | (main > 0), 2)
    found = df.select(F.col(html_col), tier.alias("__tier"))
    one, several = found.agg(F.count_if(F.col("__tier") == 1), F.count_if(F.col("__tier") == 2)).first()
    shares = {1: min(1.0, labelled_pages / max(one, 1)), 2: min(1.0, max(0, labelled_pages - one) / max(several, 1))}
    if not shares[2]:
        shares, found = {1: shares[1]}, found.where("__tier = 1")
    sample = found.where("__tier IS NOT NULL").sampleBy("__tier", shares, seed).select(html_col)

    def run(batches):
        inside: dict[str, list[int]] = {}
        for batch in batches:
            for page in texts(batch.column(html_col)):
                for kind, within, n in _labels(page):
                    inside.setdefault(kind, [0, 0])[within] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(inside), pa.string()), pa.array([v[1] for v in inside.values()], pa.int64()),
             pa.array([v[0] for v in inside.values()], pa.int64())], names=["kind", "within", "outside"])

    got = (sample.mapInArrow(run, "kind string, within long, outside long").groupBy("kind")
           .agg(F.sum("within").alias("within"), F.sum("outside").alias("outside"))
           .orderBy(F.desc(F.col("within") + F.col("outside")), "kind").limit(MAX_KINDS).collect())
    if not any(r[1] for r in got) or not any(r[2] for r in got):
        return dict(DEFAULT)
    odds = {r[0]: math.log((r[1] + 0.5) / (r[2] + 0.5)) for r in got}
    # words score positive, tags negative, whatever the sample says
    weights = {k: min(LIGHT, v) for k, v in odds.items()}
    weights["#word"] = min(max(0.2, odds.get("#word", DEFAULT["#word"])), 2.0)
    weights |= {k: min(max(0.01, v), weights["#word"]) for k, v in odds.items() if k.startswith(WITHIN)}
    weights["#tag"], weights["#cut"] = DEFAULT["#tag"], DEFAULT["#cut"]
    return weights


def extract(df: DataFrame, html_col: str = "html", out_col: str = "text",
            weights: dict[str, float] | None = None) -> DataFrame:
    """Replaces the page by its main text."""
    check_columns(df, html_col)
    bounded_batches(df.sparkSession)
    weights = weights or fit_weights(df, html_col)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html_col):
                made = [main_text(p, weights) for p in texts(batch.column(html_col))]
                yield with_columns(batch.drop_columns([html_col]), {out_col: pa.array(made, pa.string())})

    return df.mapInArrow(run, schema_with(df, f"`{out_col}` string", (html_col,)))
