"""Main-text extraction on pages that the trees have not seen, and the treatment of the text itself."""

from __future__ import annotations

import html
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from pixelry.llm import html_extract as H
from pixelry.llm.boosting import BoostedTrees
from pixelry.llm.page_samples import labelled_pages

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model():
    return H.train()


def test_held_out_pages(model):
    right = wrong = missed = 0
    for source, is_main in labelled_pages(150, seed=991):
        page = H.Page(source)
        want = Counter(w for _, _, part, _ in page.chunks if is_main(part) for w in part.split())
        got = Counter(H.main_text(source, model).replace("&", "&amp;").split())
        right += (want & got).total()
        wrong += (got - want).total()
        missed += (want - got).total()
    assert right / (right + wrong) > 0.98
    assert right / (right + missed) > 0.98


def test_text_of_blocks(model):
    source = "<body><nav><a href=/>Home</a> <a href=/x>More</a></nav><article><h1>A  title &amp;\n more</h1><p>One &lt;b&gt; <b>bold</b>, and\ttwo.<p>Next&nbsp;one &#8364;5, a sentence, with stops.<script>var x = '<p>no</p>';</script><!-- gone --><ul><li>item, first<li>item, second</ul></article><footer>(c) nobody</footer>"
    assert H.main_text(source, model) == "A title & more\n\nOne <b> bold, and two.\n\nNext one €5, a sentence, with stops.\n\nitem, first\n\nitem, second"


def test_hierarchical_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    source = "<div class=a><div class=b><p class=c>x<p class=d>y</div><div class=e>z</div></div><div class=f><section>q</section></div>"
    page = H.Page(source)
    n = len(page.parent)
    own = np.array([i for i in range(n) if page.scored[i]])
    for _ in range(60):
        odds = rng.normal(size=len(own)) * 3
        got = page.decode(own, odds)
        score = np.zeros(n)
        score[own] = odds
        best = -1e9
        for mask in range(1 << n):
            kept = [bool(mask >> i & 1) for i in range(n)]
            if not kept[0] or any(kept[i] and i and not kept[page.parent[i]] for i in range(n)) or any(not page.scored[i] and i and kept[i] != kept[page.parent[i]] for i in range(n)):
                continue
            best = max(best, sum(s / 2 if k else -s / 2 for k, s in zip(kept, score, strict=True)))
        assert sum(s / 2 if k else -s / 2 for k, s in zip(got, score, strict=True)) == pytest.approx(best)


def test_rows(spark, model):
    rng = random.Random(5)
    long = "<article>" + "".join(f"<p>{' '.join(rng.choice('lorem ipsum dolor sit'.split()) for _ in range(60))}.</p>" for _ in range(800)) + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain text, without tags"), (4, "u", long), (4, "u", long), (5, "u", "<<<>>><p"), (6, "u", "<div" * 3000), (None, "u", "<p>ok, a paragraph of text.</p>"), (7, "u", "<!-- never closed <p>x</p>")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = H.extract(df, model=model).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == text[7] == ""
    assert text[3] == "plain text, without tags"
    assert text[4].count("\n\n") == 799
    assert len(text[4]) > 200_000
    assert H.extract(spark.createDataFrame([], SCHEMA), model=model).collect() == []


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    fitted = BoostedTrees(n_trees=30, depth=3).fit(x[:1500], y[:1500])
    assert ((fitted.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97


@pytest.mark.parametrize("page", [lambda n: "<b>" * n + "<li>x" * n, lambda n: "<p>" * n + "<span>" * n + "<p>y" * n, lambda n: "<ul>" * n + "<li><b>x" * n, lambda n: "<table><tr><td>" * n + "z" + "<td>" * n, lambda n: "<i>" * n + "</b>" * n])
def test_unclosed_tags_take_linear_time(page):
    seconds = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        H.Page(page(n))
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 10 * max(seconds[0], 0.05)
    assert seconds[1] < 5


_BREAKS = "address|article|aside|blockquote|center|dd|details|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"


def article_text(source: str) -> str:
    """The text of the article element of a well-marked page, by patterns alone."""
    inner = re.search(r"(?is)<article\b[^>]*>(.*?)</article>", source)[1]
    inner = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template|iframe)\b.*?</\1\s*>", "", inner)
    inner = re.sub(r"(?is)<(nav|aside|form|footer|header)\b.*?</\1\s*>|<div class=\"(?:ad|ads|share|comments|related|cookie)[^\"]*\".*?</div>", "\0", inner)
    inner = re.sub(rf"(?i)</?(?:{_BREAKS})\b[^>]*>", "\0", re.sub(r"(?i)<br\b[^>]*>", " ", inner))
    blocks = [" ".join(html.unescape(re.sub(r"(?s)<[^>]*>", "", b)).split()) for b in inner.split("\0")]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_table_against_their_article_element(spark):
    """The trees have seen none of these pages; every page of the table holds its main text in one article element."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages.select("page_id", "url", "html")).collect()}
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    assert got.keys() == want.keys()
    assert [k for k in want if got[k] != want[k]] == []
