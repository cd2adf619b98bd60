"""Generator of labelled web pages in varied layouts, to train and test the main-text extractor.

Every text of a page starts with a letter that tells what it is: words of the main text begin with m,
all others with b.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za".split()


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, kind: str, low: int, high: int, stop: str = ".") -> str:
        r = self.rng
        out = []
        for i in range(r.randint(low, high)):
            w = kind + "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))
            out.append(w + ("," if r.random() < 0.08 else stop if r.random() < 0.1 else ""))
            if i % 40 == 39 and r.random() < 0.3:
                out.append("&amp;")
        return " ".join(out) + stop

    def named(self, choices: str) -> str:
        """An element start from "tag.class", "tag#id" or "tag" choices; returns start and end tags joined by a bar."""
        pick = self.rng.choice(choices.split())
        for mark, key in ((".", "class"), ("#", "id"), ("@", "role")):
            if mark in pick:
                tag, value = pick.split(mark, 1)
                if key == "class" and self.rng.random() < 0.3:
                    value += " " + self.rng.choice(["clearfix", "row", "col-md-8", "x1", "block", "wide"])
                return f'<{tag} {key}="{value}">|</{tag}>'
        return f"<{pick}>|</{pick}>"

    def wrap(self, choices: str, inner: str) -> str:
        a, b = self.named(choices).split("|")
        return a + inner + b

    def links(self, low: int, high: int) -> str:
        r = self.rng
        items = [f'<a href="/{i}">{self.words("b", 1, 3, "")}</a>' for i in range(r.randint(low, high))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" if r.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
        return " | ".join(items)

    def paragraphs(self, kind: str, low: int, high: int, short: bool = False) -> str:
        r = self.rng
        out = []
        for _ in range(r.randint(low, high)):
            text = self.words(kind, 3 if r.random() < 0.2 else 8, 25 if short else 90)
            if r.random() < 0.2:
                text = f"<b>{text}</b>" if r.random() < 0.6 else f"<b>{text}<br>"
            if r.random() < 0.15:
                text += f' <a href="#">{self.words(kind, 1, 4, "")}</a>'
            out.append(f"<p>{text}</p>" if r.random() < 0.9 else f"<p>{text}")
        return "".join(out)

    def main(self) -> str:
        r = self.rng
        title = f"<h1>{self.words('m', 3, 12, '')}</h1>"
        if r.random() < 0.2:
            title = self.wrap("header header.entry-header div.post-header header.article-header", title)
        parts = [self.paragraphs("m", 1, 14)]
        if r.random() < 0.15:
            parts = [self.paragraphs("m", 0, 1, True) + f"<p><b>{self.words('m', 1, 6)}<br>" * (r.random() < 0.5)]
        for _ in range(r.choice([0, 0, 1, 2])):
            kind = r.random()
            if kind < 0.3:
                parts.append(f"<h2>{self.words('m', 2, 6, '')}</h2>" + self.paragraphs("m", 1, 4))
            elif kind < 0.55:
                parts.append(r.choice(["<ul>", "<ol>"]) + "".join(f"<li>{self.words('m', 4, 20)}</li>" for _ in range(r.randint(2, 6))) + r.choice(["</ul>", "</ol>"]))
            elif kind < 0.75:
                parts.append(f"<blockquote>{self.paragraphs('m', 1, 2)}</blockquote>")
            elif kind < 0.9:
                parts.append(f"<figure><img src=x><figcaption>{self.words('m', 4, 15)}</figcaption></figure>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{self.words('m', 1, 6, '')}</td><td>{self.words('m', 1, 6, '')}</td></tr>" for _ in range(3)) + "</table>")
        if r.random() < 0.35:
            parts.insert(r.randint(0, len(parts)), self.inside())
        body = "".join(parts)
        if r.random() < 0.3:
            body = self.wrap("div.entry-content div.article-body div.content div.text div.story-body div.post-content section div", body)
        inner = title + body
        if r.random() < 0.2:
            inner += self.wrap("footer div.share-buttons div.post-tags div.entry-footer", self.links(2, 5))
        return self.wrap("article article article article.post article#main div.article div#content div.post main div.main-content div.entry section.article div.story div#main-text", inner)

    def inside(self) -> str:
        """Boilerplate that stands within an article."""
        r = self.rng
        return r.choice([self.advert, self.notice, self.form, self.related])()

    def menu(self) -> str:
        return self.wrap("nav nav nav.menu div.navbar div#navigation ul.menu div.main-menu div@navigation div.breadcrumbs div#menu div.nav", self.links(3, 12))

    def header(self) -> str:
        return self.wrap("header header.site-header div#header div.masthead div.header div.top-bar", f"<div>{self.words('b', 1, 6, '')}</div>" if self.rng.random() < 0.5 else self.paragraphs("b", 1, 1, True) + self.links(0, 4))

    def footer(self) -> str:
        return self.wrap("footer footer footer.site-footer div#footer div.footer div.copyright div.bottom", f"&copy; {self.words('b', 2, 20)} &middot; {self.words('b', 2, 12)}" if self.rng.random() < 0.6 else self.paragraphs("b", 1, 2, True) + self.links(1, 6))

    def side(self) -> str:
        return self.wrap("aside aside.sidebar div.sidebar div#sidebar div.widget div#secondary section.widget div.side", f"<h3>{self.words('b', 1, 4, '')}</h3>" + (self.links(2, 8) if self.rng.random() < 0.6 else self.paragraphs("b", 1, 3, True)))

    def related(self) -> str:
        return self.wrap("div.related div.recommended aside div.read-more section.related-posts div.teaser aside.related", f"<h3>{self.words('b', 1, 4, '')}</h3>" + self.links(2, 6))

    def notice(self) -> str:
        r = self.rng
        if r.random() < 0.15:
            return self.wrap("p.notice p.alert p.cookie", self.words("b", 4, 40))
        return self.wrap("div.cookie-notice div.notice div#cookie-banner div.alert div.banner div.consent div.disclaimer div.popup section.notice div#gdpr", self.paragraphs("b", 1, 2, True) if self.rng.random() < 0.6 else self.words("b", 4, 40))

    def advert(self) -> str:
        if self.rng.random() < 0.1:
            return self.wrap("p.ad p.sponsored", self.words("b", 2, 30))
        return self.wrap("div.ad div.ads div.advert div.advertisement div#ad-top div.sponsored div.promo aside.ad section.ad div.ad-slot", self.words("b", 2, 40) if self.rng.random() < 0.7 else self.paragraphs("b", 1, 2, True))

    def form(self) -> str:
        return self.wrap("form form.search form#login div.newsletter div.subscribe form.contact", f"<label>{self.words('b', 1, 4, '')}</label><input name=q><p>{self.words('b', 2, 16)}</p><button>{self.words('b', 1, 2, '')}</button>")

    def comments(self) -> str:
        each = "".join(self.wrap("div.comment li.comment article.comment div.comment-body", f"<b>{self.words('b', 1, 2, '')}</b>" + self.paragraphs("b", 1, 3)) for _ in range(self.rng.randint(1, 6)))
        return self.wrap("section#comments div#comments div.comments ol.comment-list section.comments div.discussion div.reader-comments", f"<h2>{self.words('b', 1, 3, '')}</h2>" + each)

    def page(self) -> str:
        r = self.rng
        some = lambda p, f: [f()] if r.random() < p else []
        before = some(0.5, self.header) + some(0.85, self.menu) + some(0.35, self.notice) + some(0.45, self.advert)
        r.shuffle(before)
        after = some(0.4, self.side) + some(0.3, self.related) + some(0.4, self.comments) + some(0.25, self.form) + some(0.2, self.advert) + some(0.2, self.notice)
        r.shuffle(after)
        if r.random() < 0.15:
            before += some(0.7, self.side)
        body = "".join(before)
        centre = self.main()
        cut = r.randint(0, len(after))
        if r.random() < 0.35:
            centre = self.wrap("div div.container div#wrapper main div.page section div#main", centre + "".join(after[:cut]))
            after = after[cut:]
        body += centre + "".join(after) + "".join(some(0.85, self.footer))
        if r.random() < 0.3:
            body = self.wrap("div div#wrap div.container div#page", body)
        return f"<!DOCTYPE html><html><head><title>{self.words('b', 2, 8, '')}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 5) -> Iterator[tuple[str, Callable[[str], bool]]]:
    """n pages and, for each, whether a piece of its text belongs to the main text."""
    rng = random.Random(seed)

    def is_main(part: str) -> bool:
        return part.lstrip()[:1] == "m"

    for _ in range(n):
        yield _Maker(rng).page(), is_main
