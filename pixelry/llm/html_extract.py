"""Main-text extraction: gradient-boosted trees over DOM-node features, with hierarchical decoding.

A page is parsed leniently into elements (missing end tags are implied, unclosed comments and tags run
to the end).  Containers, and block elements that carry a class, id or role, are scored by boosted
trees over their tag, attribute tokens, ancestors, depth, siblings, and the text, link and punctuation
density of their subtree.  The decisions of a page are taken together: a kept node needs kept ancestors,
and a dropped node drops its descendants, so the assignment with the greatest sum of log-odds under
this rule is found from the leaves up.  Elements that are not scored follow their parent.

The trees are trained at first use, on the driver, on TRAINING_PAGES labelled pages from the generator in
`page_samples` and handed to the tasks.

Defined cases: null, empty or text-free html gives the empty text; plain text without tags is one block;
repeated pages are all returned; result columns replace columns of that name.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelry.llm.boosting import BoostedTrees
from pixelry.llm.textbuf import with_columns

TRAINING_PAGES = 800

# Element names of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg math object canvas head title select option button textarea datalist audio video map dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article aside body div dl fieldset figure footer form header main menu nav ol section table ul details center search address".split())
RAW = "script|style|noscript|template|iframe|textarea|title|svg|math"
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend summary".split())
#: An element of the first kind ends an open one of the second within the third.
IMPLIED = {name: (tuple(ended.split()), tuple(within.split())) for name, (ended, within) in {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead", "table")}.items()}
#: What a paragraph may be open outside of, and so is not ended from within.
HOLDS_P = (*sorted(CONTAINER), "td", "th", "li")
#: Attribute tokens by what they hint at.
HINTS = {
    "menu": "nav navigation navbar menu topnav mainnav menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "header": "header masthead siteheader topbar top head logo branding hero",
    "footer": "footer sitefooter bottom colophon copyright legal credits foot",
    "side": "sidebar side aside secondary widget widgets rail related recommended popular trending more readmore teaser",
    "notice": "notice cookie cookies consent gdpr banner alert popup modal overlay disclaimer announcement warning paywall message notification",
    "advert": "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion promoted adbox adslot dfp outbrain taboola affiliate",
    "form": "form search login signin signup newsletter subscribe subscription register contact feedback poll",
    "comments": "comment comments commentlist discussion respond reply replies disqus responses reader readers",
    "share": "share sharing social follow tags tag likes rating print tools toolbar",
    "main": "article main content post entry story body text page maincontent articlebody postcontent entrycontent primary blog news single hentry prose markdown",
}
_GROUP = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
_TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "ol", "table", "figure", "body", "h1", "h2", "li"]
_TAG_NO = {t: i for i, t in enumerate(_TAGS)}
_N_HINTS = len(HINTS)

_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[/a-zA-Z][^>]*\Z""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Page:
    """Elements of a page in arrays, and its text chunks in order.

    parent, tag, hints and scored describe elements; chunks are (element, block number, text, in a link).
    """

    __slots__ = ("parent", "tag", "hints", "scored", "chunks", "attributes")

    def __init__(self, source: str):
        self.parent, self.tag, self.hints, self.scored, self.attributes = [-1], ["body"], [frozenset()], [True], [""]
        self.chunks: list[tuple[int, int, str, bool]] = []
        stack: list[tuple[str, int]] = [("body", 0)]  # open elements; inline ones stand for their block
        open_: defaultdict[str, list[int]] = defaultdict(list)  # places of each name on the stack
        block, at, links, hidden = 0, 0, 0, 0

        def text(part: str) -> None:
            if part and not hidden:
                self.chunks.append((stack[-1][1], block, part, links > 0))

        def nearest(names: tuple[str, ...]) -> int:
            """Place on the stack of the innermost open element of these names, 0 without one."""
            return max((open_[n][-1] for n in names if open_[n]), default=0)

        def close(down_to: int) -> None:
            nonlocal block, links, hidden
            while len(stack) > down_to:
                name, _ = stack.pop()
                open_[name].pop()
                links -= name == "a"
                hidden -= name in HIDDEN
                block += name in BLOCK

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name, end, attributes = name.lower(), m[2] or m[5], m[4] or m[7] or ""
            if end:
                if name not in ("body", "html") and open_[name]:
                    close(open_[name][-1])
                continue
            if name == "br":
                text(" ")
                continue
            if name in VOID:
                block += name == "hr"
                continue
            if name in ("html", "body"):
                continue
            if name in ENDS_P and open_["p"] and nearest(("p",)) > nearest(HOLDS_P):
                close(open_["p"][-1])
            if name in IMPLIED:
                ended, within = IMPLIED[name]
                while (i := nearest(ended)) > nearest(within):
                    close(i)
            element = stack[-1][1]
            if name in BLOCK:
                block += 1
                hints = set()
                plain = ""
                for a in _ATTRIBUTE.finditer(attributes) if attributes else ():
                    value = a[2] or a[3] or a[4] or ""
                    plain += " " + value
                    whole = {w.lower() for w in _WORD.findall(value)} | {re.sub(r"[^a-z]", "", w.lower()) for w in value.split()}
                    hints.update(_GROUP[w] for w in whole if w in _GROUP)
                self.parent.append(element)
                self.tag.append(name)
                self.hints.append(frozenset(hints))
                self.scored.append(name in CONTAINER or bool(plain))
                self.attributes.append(plain)
                element = len(self.parent) - 1
            links += name == "a"
            hidden += name in HIDDEN
            stack.append((name, element))
            open_[name].append(len(stack) - 1)
        if at < len(source):
            text(source[at:])

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the scored elements and their feature matrix."""
        n = len(self.parent)
        chars, words, linked, stops, paragraphs, tags, start = (np.zeros(n) for _ in range(7))
        seen, total = np.full(n, -1.0), 0
        for element, _, part, link in self.chunks:
            size = len(part)
            chars[element] += size
            words[element] += part.count(" ") + 1
            linked[element] += size if link else 0
            stops[element] += part.count(".") + part.count(",")
            if seen[element] < 0:
                seen[element] = total
            total += size
        for i in range(n):
            tags[i] = 1
            paragraphs[i] = self.tag[i] in ("p", "h1", "h2", "h3") and chars[i] > 0
        start = np.where(seen < 0, total, seen)
        parent = self.parent
        children = [0] * n
        index = [0] * n
        for i in range(1, n):
            index[i] = children[parent[i]]
            children[parent[i]] += 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            words[p] += words[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            paragraphs[p] += paragraphs[i]
            tags[p] += tags[i]
            start[p] = min(start[p], start[i])
        depth, above, within = [0] * n, [frozenset()] * n, [frozenset()] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | self.hints[p]
            within[i] = within[p] | {self.tag[p]}
        own = [i for i in range(n) if self.scored[i]]
        out = np.zeros((len(own), len(_TAGS) + 2 * _N_HINTS + 22))
        for row, i in enumerate(own):
            if self.tag[i] in _TAG_NO:
                out[row, _TAG_NO[self.tag[i]]] = 1
            at = len(_TAGS)
            for g in self.hints[i]:
                out[row, at + g] = 1
            at += _N_HINTS
            for g in above[i]:
                out[row, at + g] = 1
            at += _N_HINTS
            c, p = max(chars[i], 1), max(parent[i], 0)
            out[row, at:] = (
                depth[i], index[i], children[p] if i else 1, index[i] / max(children[p], 1) if i else 0, np.log1p(chars[i]), np.log1p(words[i]), linked[i] / c, stops[i] / max(words[i], 1),
                paragraphs[i], np.log1p(tags[i]), chars[i] / tags[i], chars[i] / max(total, 1), chars[i] / max(chars[p], 1), start[i] / max(total, 1), words[i] / max(paragraphs[i], 1),
                "article" in within[i], "main" in within[i], "nav" in within[i] or "aside" in within[i], "footer" in within[i], "header" in within[i], "form" in within[i], len(self.hints[i]),
            )
        return np.array(own, np.int64), out

    def decode(self, own: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Whether each element is kept: the best consistent choice that keeps the page's root."""
        n = len(self.parent)
        keep, drop = np.zeros(n), np.zeros(n)
        score = np.zeros(n)
        score[own] = odds
        for i in range(n - 1, -1, -1):
            keep[i] += score[i] / 2
            drop[i] -= score[i] / 2
            if i:
                p = self.parent[i]
                keep[p] += max(keep[i], drop[i]) if self.scored[i] else keep[i]
                drop[p] += drop[i]
        kept = np.zeros(n, bool)
        for i in range(n):
            kept[i] = not i or (kept[self.parent[i]] and (not self.scored[i] or keep[i] >= drop[i]))
        return kept

    def text(self, kept: np.ndarray) -> str:
        blocks: list[str] = []
        last, parts = -1, []
        for element, block, part, _ in self.chunks:
            if not kept[element]:
                continue
            if block != last:
                blocks.append("".join(parts))
                last, parts = block, []
            parts.append(html_lib.unescape(part) if "&" in part else part)
        blocks.append("".join(parts))
        return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


@functools.lru_cache(maxsize=2)
def train(pages: int = TRAINING_PAGES) -> BoostedTrees:
    from pixelry.llm.page_samples import labelled_pages

    xs, ys = [], []
    for source, is_main in labelled_pages(pages):
        page = Page(source)
        own, x = page.features()
        good = np.zeros(len(page.parent), bool)
        for element, _, part, _ in page.chunks:
            if is_main(part):
                while element >= 0 and not good[element]:
                    good[element] = True
                    element = page.parent[element]
        xs.append(x)
        ys.append(good[own])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(source: str | None, model: BoostedTrees) -> str:
    if not source:
        return ""
    page = Page(source)
    if not page.chunks:
        return ""
    own, x = page.features()
    return page.text(page.decode(own, model.log_odds(x)))


def extract(pages: DataFrame, html: str = "html", out: str = "text", model: BoostedTrees | None = None) -> DataFrame:
    """pages and the column `out` with the main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def make():
        model = shared.value

        def f(part: pa.RecordBatch) -> list[pa.Array]:
            sources = [Page(x) if x else None for x in part.column(part.schema.get_field_index(html)).to_pylist()]
            found = [p.features() if p and p.chunks else None for p in sources]
            odds = model.log_odds(np.concatenate([f[1] for f in found if f])) if any(f is not None for f in found) else np.zeros(0)
            texts, at = [], 0
            for page, f in zip(sources, found, strict=True):
                if f is None:
                    texts.append("")
                    continue
                texts.append(page.text(page.decode(f[0], odds[at : at + len(f[0])])))
                at += len(f[0])
            return [pa.array(texts, pa.string())]

        return f

    return with_columns(pages, html, [T.StructField(out, T.StringType())], make)
