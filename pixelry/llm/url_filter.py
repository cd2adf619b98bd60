"""URL block and allow rules with redirect equivalence, in DataFrame functions only.

A rule names a host and a path prefix; it fits the host and its subdomains.  The longest fitting rule
decides (of equal ones the allowing).  Pages that no rule fits take the decision of their alias class:
canonical links and refresh redirects in the pages (and any given redirect table) are edges between
addresses (host, path and query, without scheme and fragment), connected components are the classes,
and a class passes "block" to its members if a rule blocks one of them and none of them is explicitly
allowed.  Otherwise the verdict is "allow".

Defined cases: a null url or one without "://" has empty host and path, no rule and no aliases; pages
with equal urls are judged alike and all returned; null html has no links; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelry.llm.components import connected_components
from pixelry.llm.textbuf import saved

#: Rules up to which matching is one expression in the scan; more are joined on host suffixes.
RULES_IN_EXPRESSION = 200
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")), F.lit(""))


def url_parts(df: DataFrame, url: str) -> DataFrame:
    """df with host, path and address (host, path and query)."""
    rest = _rest(F.col("u"))
    df = df.drop("host", "path", "address").withColumn("u", F.col(url).cast("string")).withColumn("rest", rest)
    df = df.withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
    df = df.withColumn("tail", F.expr("substring(rest, length(raw) + 1)"))
    df = df.withColumn("host", F.translate("raw", _UPPER, _LOWER)).withColumn("path", F.regexp_extract("tail", r"^[^?#]*", 0))
    return df.withColumn("address", F.concat("host", F.regexp_extract("tail", r"^[^#]*", 0))).drop("u", "rest", "raw", "tail")


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def match_rules(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, key: str) -> DataFrame:
    """df (with host and path) and the columns rule and decision of the longest fitting rule.

    rules: (decision, rule) pairs, a rule being host and path in one string; or a DataFrame of these two
    columns for long lists, which is joined on the host's suffixes.  key: a column that tells rows apart.
    """
    if not isinstance(rules, DataFrame) and len(rules) > RULES_IN_EXPRESSION:
        rules = df.sparkSession.createDataFrame(rules, "decision string, rule string")
    if not isinstance(rules, DataFrame):
        rule, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
        # the last test to be added is the first to be made: longest rules last
        for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
            rule_host, slash, rest = text.partition("/")
            fits = _fits(F.col("host"), F.col("path"), rule_host.lower(), slash + rest)
            rule, decision = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(decision)
        return df.withColumn("rule", rule).withColumn("decision", decision)
    listed = rules.select("decision", "rule", F.translate(F.regexp_extract("rule", "^[^/]*", 0), _UPPER, _LOWER).alias("suffix"), F.regexp_extract("rule", "/.*", 0).alias("prefix"))
    if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = df.select(key, "path", F.explode(suffixes).alias("suffix")).join(listed, "suffix").where(F.col("path").startswith(F.col("prefix")))
    best = found.groupBy(key).agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("decision") == "allow").alias("allow"), "rule", "decision")).alias("best"))
    return df.join(best.select(key, "best.rule", "best.decision"), key, "left")


def link_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """a, b: address of a page and of the target of its canonical link or refresh redirect."""
    tags = F.regexp_extract_all(F.col(html).cast("string"), F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), 0)
    tags = F.filter(tags, lambda t: t.rlike(r"""(?i)rel\s*=\s*["']?canonical|http-equiv\s*=\s*["']?refresh"""))
    with_tags = url_parts(pages.select(F.col(url).alias("url"), tags.alias("tags")).where("size(tags) > 0"), "url").where("host <> ''")
    links = with_tags.select("host", "path", F.col("address").alias("a"), F.explode("tags").alias("tag"))
    href = F.regexp_extract("tag", r"""(?i)(?:href\s*=\s*|url\s*=\s*)["']?\s*([^"'\s>]+)""", 1)
    links = links.withColumn("to", F.replace(href, F.lit("&amp;"), F.lit("&"))).where("to <> ''")
    folder = F.regexp_extract("path", r"^.*/", 0)
    full = (
        F.when(F.instr("to", "://") > 0, F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(F.lit("x://"), "host", "to"))
        .otherwise(F.concat(F.lit("x://"), "host", F.when(folder == "", F.lit("/")).otherwise(folder), "to"))
    )
    return url_parts(links.select("a", full.alias("to")), "to").where("host <> ''").select("a", F.col("address").alias("b"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, page_id: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict and inherited (decided by the class) of every page.

    redirects: further edges with columns source_url and target_url.
    """
    edges = []
    if html is not None:
        edges.append(link_edges(pages, url, html))
    if redirects is not None:
        ends = url_parts(redirects, "source_url").select(F.col("address").alias("a"), "target_url")
        edges.append(url_parts(ends, "target_url").where("a <> '' and address <> ''").select("a", F.col("address").alias("b")))
    judged = match_rules(url_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")), "url"), rules, "url" if isinstance(rules, DataFrame) else "page_id")
    blocked = None
    if edges:
        all_edges = edges[0]
        for e in edges[1:]:
            all_edges = all_edges.unionByName(e)
        all_edges = saved(all_edges.distinct(), "url-edges")
        if all_edges.take(1):
            classes = connected_components(all_edges)
            named = url_parts(classes.withColumn("full", F.concat(F.lit("x://"), "node")), "full")
            decided = match_rules(named.select("node", "component", "host", "path"), rules, "node")
            verdicts = decided.groupBy("component").agg(F.max((F.col("decision") == "block").cast("int")).alias("block"), F.max((F.col("decision") == "allow").cast("int")).alias("allow"))
            verdicts = verdicts.where("block = 1 and coalesce(allow, 0) = 0")
            blocked = saved(classes.join(verdicts, "component", "left_semi").select(F.col("node").alias("address"), F.lit(True).alias("alias")).distinct(), "blocked-aliases")
    if blocked is None:
        out = judged.withColumn("alias", F.lit(None).cast("boolean"))
    else:
        out = judged.join(F.broadcast(blocked) if blocked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else blocked, "address", "left")
    inherited = F.col("rule").isNull() & F.coalesce("alias", F.lit(False))
    verdict = F.when(F.col("decision").isNotNull(), F.col("decision")).when(inherited, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), inherited.alias("inherited"))
