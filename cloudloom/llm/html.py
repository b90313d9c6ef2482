"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat sequence of text blocks. Each block is described by its words and link density,
those of the blocks before and after it, and a hint of three values: what its open elements say (an article or main
element; a menu, header, footer, sidebar, notice, advert, form or comment element, by tag, class, id or
role). A decision tree, fitted to the small labelled table LABELLED, keeps or drops the block. Linked lists go
by their link density and that of their neighbours, inside an article too; prose of short blocks stays by its neighbours.

Defined cases: null, empty or blank html has the empty text; pages of any length are read whole;
an opening p, li, dt, dd, tr, td, th or option ends an open like element, any block element an open p; other
unclosed and misnested tags close with the element around them, an unclosed script, style, textarea or
title runs to the end, a self-closed svg or math is empty; repeated rows give repeated results; columns besides those asked for are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_steps

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "hint")
#: The labelled table: a page on each line, its blocks in page order as hint, words and linked words; a star marks main text.
#: The hint is + inside an article element, - inside an element that calls itself boilerplate, 0 elsewhere.
LABELLED = """
-1/1 -1/1 -2/2 -1/1 -9/0 +9/0* +45/0* +120/3* +60/0* -15/0
-1/1 -3/3 -2/2 -8/0 +11/0* +23/0* +58/0* +12/0* -14/0
-2/2 -1/1 -12/0 +6/0* +90/6* +4/0* +70/0* +3/0* -10/2 -30/0 -26/0
-4/4 -2/2 +7/0* +35/0* +18/9* +80/0* +5/5* +64/0* -9/9 -7/0
-1/1 -2/2 +5/0* +40/2* +6/6* +55/0* +1/0* +48/0* -60/0 -45/0 -12/0
-3/3 -2/2 +2/0* +4/0* +3/0* -20/0
-6/2 -8/0 +8/0* +2/0* +2/0* +30/0* +2/0* +7/0* -5/1
+4/0* +66/0* +3/3 +4/4 +3/3 +5/5 -8/0
+9/0* +110/4* +50/0* +2/2 +4/4 +6/6 +5/5 -3/3 -40/0
+7/0* +2/2 +3/3 +2/2 +4/4 +60/0* +75/2* +22/0* -9/0
+5/0* +1/1 +1/1 +2/2 +1/1 +33/0* +41/8* +3/0* -11/3
0/0 01/1 02/2 01/1 03/3 07/0* 060/0* 085/4* 040/0* 04/4 03/3 05/5 06/0
02/2 03/3 01/1 02/2 09/0* 0120/0* 033/2* 018/0* 070/0* 02/2 03/3 08/0
01/1 01/1 03/3 05/0* 045/1* 030/0* 08/0* 064/0* 026/1* 06/3 07/5 04/0
04/4 05/5 04/4 05/5 010/10 011/9 08/7 06/6
03/3 02/2 04/0 02/2 03/3 05/4 06/0 04/4
02/1 05/2 08/5 03/3 04/0 02/2 06/6
-2/2 -9/0 06/0* 055/0* 072/3* 028/0* -5/2 -44/0
-1/1 -1/1 012/0* 038/0* 04/0* 090/2* 05/0* 060/0* -12/4 -70/0
04/4 06/6 -80/0 08/0* 044/0* 035/0* -25/0 -6/6 05/2
-22/0 -3/3 +10/0* +16/0* +14/0* -18/0 -25/2 -33/0
-5/5 -4/4 -3/3 +6/0* +52/0* -11/0 +47/3* +20/0* -6/4 -9/9
+60/0*
+8/3* +12/5* +4/2* +30/12* +6/2* +9/4* +3/1*
-2/2 -3/3 +7/2* +25/9* +2/1* +14/5* +40/10* +10/4* -8/4 -6/3
-1/1 -4/4 +5/0* +50/0* +4/4* +35/0* +12/12* +28/3* +7/7*
+6/0* +3/3* +2/0* +5/5* +9/1*
060/0*
080/2* 045/15* 060/20* 030/9* 055/0*
02/2 03/3 012/0* 050/0* 040/0* 022/8* 070/0*
01/1 02/2 02/2 040/13* 025/6* 033/0* 048/16*
-9/0 +11/0* +2/0* +45/0*
-2/2 +9/0* +20/0* +8/0*
+7/0* +7/0*
"""
#: Elements whose text runs to their end tag, or to the end of the page.
RAW = ("script", "style", "textarea", "title")
#: Other elements whose text is never shown as text; unclosed ones close with the element around them.
SILENT = frozenset("noscript template select svg math iframe object canvas audio video button datalist".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar side aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " comment comments commentlist reply replies respond disqus discussion social share sharing related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login search widget toolbar toc copyright legal disclaimer complementary contentinfo".split()
)
#: Those of them that name a part of a text as often; inside an article they say nothing.
EITHER_WORDS = frozenset("header alert banner copyright disclaimer discussion legal login menu menus notice notices overlay popup promo promotion search side signup social sponsor toc widget".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article articlebody main content post entry story".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: The open elements that an opening one ends, innermost first; every other block element ends an open p.
ENDS = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}

_TOKEN = re.compile(
    # an attribute outside quotes holds no "<": an unclosed tag is given up at the next one, so that a page is read in linear time
    r"<!--.*?(?:-->|\Z)|<(?!title\s*/>)(" + "|".join(RAW) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<[!?][^<>]*+>|([^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HAS = re.compile(r"\b(?:no|has|with|without)[-_][a-z0-9]+")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _says(tag: str, attrs: str, in_article: bool) -> tuple[int, int]:
    """(article, boilerplate) that one element adds to its contents."""
    article, boiler = int(tag in ARTICLE_TAGS), int(tag in BOILER_TAGS and not (tag == "header" and in_article))
    if attrs.strip() and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                boiler = 1
            elif name in ("class", "id", "role"):
                words = {*_SPLIT.split(_HAS.sub(" ", value))}
                if words & (BOILER_WORDS - EITHER_WORDS if in_article else BOILER_WORDS) and tag not in ARTICLE_TAGS:
                    boiler = 1
                elif words & ARTICLE_WORDS and tag not in INLINE:
                    article = 1
    return article, boiler


def blocks(html: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, linked words, inside an article, inside boilerplate) of each text block, in page order."""
    out: list[tuple[str, int, int, int, int]] = []
    open_tags: list[tuple[str, int, int]] = []
    parts: list[str] = []
    silent: list[str] = []  # an open silent element and what is open inside
    links = article = boiler = 0
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, text.count(" ") + 1, linked, int(article > 0), int(boiler > 0)))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        text = m[5]
        if text is not None:
            if silent:
                continue
            parts.append(text)
            if links:
                linked += len(text.split())
            continue
        tag = m[3]
        if tag is None:
            if m[1]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if silent:
            if tag in VOID:
                continue
            if not m[2]:
                if not m[4].endswith("/"):
                    silent.append(tag)
                continue
            if tag in silent:
                while silent.pop() != tag:  # the innermost of that name, and what is open in it
                    pass
                continue
            silent.clear()  # the end of an element around it
        elif tag in SILENT and not m[2]:
            parts.append(" ")
            if not (tag in ("svg", "math") and m[4].endswith("/")):
                silent.append(tag)
            continue
        if tag in SILENT:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[2] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        while not m[2] and open_tags and open_tags[-1][0] in ENDS.get(tag, ("p",)):
            _, a, b = open_tags.pop()  # its end tag is left out
            article -= a
            boiler -= b
        if tag in VOID:
            continue
        if m[2]:
            for at in range(len(open_tags) - 1, -1, -1):
                if open_tags[at][0] == tag:
                    for _, a, b in open_tags[at:]:
                        article -= a
                        boiler -= b
                    del open_tags[at:]
                    break
        elif tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and not m[4].endswith("/"):
            a, b = _says(tag, m[4], article > 0)
            article += a
            boiler += b
            open_tags.append((tag, a, b))
        elif m[4].strip() and tag in ("p", "li", "td", "dd"):
            a, b = _says(tag, m[4], article > 0)
            if b:  # up to its end tag, or to the element that implies it
                boiler += b
                open_tags.append((tag, a, b))
                article += a
    flush()
    return out


def features(found: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    own = np.array([b[1:] for b in found], np.float64).reshape(-1, 4)
    return _measured(own[:, 0], own[:, 1], np.where(own[:, 3] > 0, -1.0, own[:, 2]))


def _measured(words: np.ndarray, linked: np.ndarray, hint: np.ndarray) -> np.ndarray:
    """FEATURES of the blocks of a page; there are empty blocks before and after it."""
    links = linked / np.maximum(words, 1)
    before, after = (lambda x: np.concatenate([[0.0], x[:-1]])), (lambda x: np.concatenate([x[1:], [0.0]]))
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), hint])


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A classification tree by least Gini impurity: (feature, threshold, low, high), or the share of ones of a leaf."""
    if not depth or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            gini = sum(s.sum() * p * (1 - p) for s in (low, ~low) for p in [y[s].mean()])
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut), low)
    if best is None:
        return (float(y.mean()),)
    _, f, cut, low = best
    return (f, cut, fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1))


def apply_tree(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = apply_tree(tree[2], x[low]), apply_tree(tree[3], x[~low])
    return out


@lru_cache(maxsize=4)
def default_tree(labelled: str = LABELLED) -> tuple:
    return fit_tree(*labelled_blocks(labelled))


def labelled_blocks(labelled: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """The features of all blocks of the labelled table, and 1 for those of the main text."""
    x, y = [], []
    for page in labelled.strip().splitlines():
        blocks = re.findall(r"([-+0])(\d+)/(\d+)(\*?)", page)
        words, linked = (np.array([int(b[k]) for b in blocks], np.float64) for k in (1, 2))
        x.append(_measured(words, linked, np.array([{"+": 1.0, "-": -1.0, "0": 0.0}[b[0]] for b in blocks])))
        y += [float(b[3] == "*") for b in blocks]
    return np.concatenate(x), np.array(y)


def main_text(html: str | None, labelled: str = LABELLED) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    keep = apply_tree(default_tree(labelled), features(found)) > 0.5
    return "\n".join(b[0] for b, k in zip(found, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html", labelled: str = LABELLED) -> DataFrame:
    """The key columns, text and n_chars (code points) of each page; one pass, nothing is shuffled."""
    pages = pages.select(*keys, html)
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches, html):
            texts = [main_text(h, labelled) for h in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.mapInArrow(run, schema)
