"""URL rules and alias classes."""

from __future__ import annotations

import random
import re

import pytest

from pixelry.llm import url_filter as U
from pixelry.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string"


def parts(url: str | None) -> tuple[str, str, str]:
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, re.match(r"[^?#]*", tail)[0], host + re.match(r"[^#]*", tail)[0]


def decide(host: str, path: str, rules) -> tuple[str | None, str | None]:
    best = None
    for what, rule in rules:
        h, slash, rest = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + rest):
            best = max(best or (-1, False, "", ""), (len(rule), what == "allow", rule, what))
    return best[2:] if best else (None, None)


def brute(pages, edges, rules) -> list[tuple]:
    up: dict[str, str] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    verdicts: dict[str, set] = {}
    for x in list(up):
        host, path, _ = parts("x://" + x)
        verdicts.setdefault(top(x), set()).add(decide(host, path, rules)[1])
    out = []
    for page_id, url, _ in pages:
        host, path, address = parts(url)
        rule, what = decide(host, path, rules)
        seen = verdicts.get(top(address), set()) if address in up else set()
        inherited = what is None and "block" in seen and "allow" not in seen
        out.append((page_id, host, path, rule or "", what or ("block" if inherited else "allow"), inherited))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted(((r.page_id, r.host, r.path, r.rule or "", r.verdict, r.inherited) for r in df.collect()), key=repr)


def pages_and_edges(seed: int) -> tuple[list[tuple], list[tuple[str, str]]]:
    rng = random.Random(seed)
    hosts = ["example.net", "www.example.net", "a.net", "Example.COM", "shop.example.com", "b.org", "x.b.org", "notnet", "c.io", "d.io", "e.io"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/a", "/de/x?q=1#top", "/fr/", "?only=query")]
    pages, edges = [], []
    for i in range(140):
        url, target = rng.choice(urls), rng.choice(urls)
        tag = rng.choice([f'<link rel="canonical" href="{target}">', f"<LINK href='{target}' rel=canonical>", f'<meta http-equiv="refresh" content="0; url={target}">', f'<link rel="icon" href="{target}">', "", "<p>none"])
        pages.append((i, url, f"<html><head>{tag}</head><body>x"))
        if "canonical" in tag or "refresh" in tag:
            edges.append((parts(url)[2], parts(target)[2]))
    pages += [(200, None, "<p>"), (201, "", None), (202, "no scheme at all", '<link rel="canonical" href="http://a.net/">'), (203, "http://", None), (204, "http://c.io/en/a", None), (None, "http://a.net/q", None), pages[0]]
    return pages, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    pages, edges = pages_and_edges(seed)
    df = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "1 AS host", "'x' AS rule", "2 AS address", "3 AS alias")
    assert found(U.filter_urls(df, URL_RULES)) == brute(pages, edges, URL_RULES)


@pytest.mark.parametrize("most", [U.BROADCAST_ROWS, -1])
def test_rules_as_a_table(spark, monkeypatch, most):
    """With and without broadcasts of the rules and of the blocked addresses."""
    monkeypatch.setattr(U, "BROADCAST_ROWS", most)
    pages, edges = pages_and_edges(3)
    df = spark.createDataFrame(pages, SCHEMA)
    rules = spark.createDataFrame(URL_RULES, "decision string, rule string")
    assert found(U.filter_urls(df, rules)) == brute(pages, edges, URL_RULES)


def test_chains_of_redirects_and_allow_precedence(spark):
    chain = [f"h{i}.io/p" for i in range(30)]
    pages = [(i, f"http://{a}", None) for i, a in enumerate(chain)] + [(100, "http://bad.net/x", None), (101, "http://other.io/", None)]
    table = [(f"http://{a}", f"http://{b}") for a, b in zip(chain, chain[1:], strict=False)] + [("http://h29.io/p", "http://bad.net/x")]
    redirects = spark.createDataFrame(table, "source_url string, target_url string")
    df = spark.createDataFrame(pages, SCHEMA)
    got = {r.page_id: (r.verdict, r.inherited) for r in U.filter_urls(df, URL_RULES, redirects=redirects).collect()}
    assert all(got[i] == ("block", True) for i in range(30))
    assert got[100] == ("block", False)
    assert got[101] == ("allow", False)
    allowed = redirects.union(spark.createDataFrame([("http://h3.io/p", "http://good.org/fr/1")], redirects.schema))
    got = {r.page_id: r.verdict for r in U.filter_urls(df, URL_RULES, redirects=allowed).collect()}
    assert all(got[i] == "allow" for i in range(30))
    assert got[100] == "block"  # an explicit rule holds


def test_relative_targets(spark):
    pages = [(1, "http://Host.io/a/b", '<link rel="canonical" href="/c">'), (2, "http://host.io/c", None), (3, "http://host.io/a/b2", '<link rel="canonical" href="c2">'), (4, "http://host.io/a/c2", None), (5, "http://q.io", '<link rel=canonical href="//bad.net/">')]
    edges = {(r.a, r.b) for r in U.link_edges(spark.createDataFrame(pages, SCHEMA), "url", "html").collect()}
    assert edges == {("host.io/a/b", "host.io/c"), ("host.io/a/b2", "host.io/a/c2"), ("q.io", "bad.net/")}
    assert {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame(pages, SCHEMA), URL_RULES).collect()}[5] == "block"


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], SCHEMA), URL_RULES).collect() == []
