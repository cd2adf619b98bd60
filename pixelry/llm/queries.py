"""One query for each operator, with production parameters, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pixelry.llm import token_shards
    from pixelry.llm.textbuf import shared_path

    path = shared_path(spark, "token-shards")
    token_shards.write(_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_shards.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import kneser_ney

    judged = kneser_ney.classify(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import quality_rules

    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


_OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, host, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM raw),
full_lines AS (SELECT * FROM lines WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
often AS (SELECT f.host, f.ws, count(DISTINCT f.text) AS n FROM full_lines f GROUP BY f.host, f.ws),
gone AS (SELECT host, ws FROM often WHERE n > 10),
lost AS (SELECT f.doc_id, count(*) AS n_lines, sum(len(f.ws)) AS n_words FROM full_lines f JOIN gone g ON f.host = g.host AND f.ws = g.ws GROUP BY f.doc_id),
f AS (SELECT w.doc_id, len(w.ws) AS n_words, length(array_to_string(w.ws, '')) AS word_chars,
  length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(lost.n_lines, 0) AS n_removed_lines, coalesce(lost.n_words, 0) AS n_removed_words
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN lost ON w.doc_id = lost.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept,
  CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(n_removed_words AS BIGINT) AS n_removed_words
FROM f
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import jaccard_join

    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


_OP4_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM s GROUP BY doc_id),
copies AS (SELECT digest, count(*) AS c FROM n GROUP BY digest),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 75 * (x.n + y.n - o.c)),
ends AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT x, y FROM ends UNION SELECT r.x, e.y FROM reach r JOIN ends e ON e.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id, coalesce(copies.c, 1) AS n_copies, coalesce(k.c, 0) AS n_links
FROM w LEFT JOIN (SELECT x, count(*) AS c FROM ends GROUP BY x) k ON k.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN copies ON copies.digest = n.digest LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = w.doc_id
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pixelry.llm import byte_bpe

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), "text", ranks, public_tokenizers.PATTERN).drop("text")
    return byte_bpe.decode(ids, "ids", ranks).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import fingerprints

    docs = fingerprints.with_next(_table(spark, sf_dir, "documents", "doc_id", "text"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(next_text, cast(n_chars div 3 as int)))")
    docs = fingerprints.fingerprint(docs.withColumn("edited", edited), "edited", "edited_fingerprint")
    docs = docs.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("text", "next_text", "edited")
    docs = fingerprints.compare(docs, "fingerprint", "edited_fingerprint", "near_edited")
    docs = fingerprints.compare(docs, "fingerprint", "next_fingerprint", "near_next")
    return docs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import url_filter

    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages", "page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "inherited")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import html_extract

    found = html_extract.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("html")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import license_scan

    return license_scan.scan(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "license", "coverage", "n_matched", "start_char", "end_char")


def op10_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import mixing

    return mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")).drop("text")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import filter_audit

    return filter_audit.audit(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
copies AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text HAVING count(*) > 1),
fails AS (SELECT d.doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) AS c,
  regexp_matches(d.text, '[#$%&*|]') AS d, coalesce(d.doc_id > copies.first, false) AS e,
  d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM d LEFT JOIN copies ON d.text = copies.text),
kinds AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad,
  concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS failed FROM fails GROUP BY part, a, b, c, d, e),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.f NOT IN (w.f, x.f, y.f, z.f) AND w.f NOT IN (x.f, y.f, z.f) AND x.f NOT IN (y.f, z.f) AND y.f <> z.f),
steps AS (SELECT filter_order, step, filter_order[step] AS own, substr(filter_order, 1, step - 1) AS before FROM orders, range(1, 6) AS s(step)),
met AS (SELECT part, filter_order, step, own, n, n_good, n_bad, contains(failed, own) AS fails_own, failed = own AS only_own, length(translate(failed, before, '')) < length(failed) AS gone FROM kinds, steps),
counts AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails_own AND NOT gone) AS kept, sum(n) FILTER (fails_own AND NOT gone) AS removed, sum(n) FILTER (fails_own AND gone) AS redundant,
  sum(n) FILTER (only_own) AS unique_fails, sum(n_good) FILTER (fails_own AND NOT gone) AS good_lost, sum(n_bad) FILTER (fails_own AND NOT gone) AS toxic_lost FROM met GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import fill_in_middle

    made = fill_in_middle.transform(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
cut AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q, units,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT doc_id, text, n, form, array_to_string(units[1:p], '') AS prefix, array_to_string(units[p + 1:q], '') AS middle, array_to_string(units[q + 1:], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelry.llm import cross_polytope

    return cross_polytope.search(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


_OP8_SQL = r"""
WITH RECURSIVE
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM pages),
links AS (SELECT url, replace(regexp_extract(tag, '(?i)(?:href\s*=\s*|url\s*=\s*)["'']?\s*([^"''\s>]+)', 1), '&amp;', '&') AS target FROM tags
  WHERE regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical|http-equiv\s*=\s*["'']?refresh')),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT DISTINCT target FROM links WHERE contains(target, '://')),
rest AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM urls),
cut AS (SELECT url, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path,
  translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(r, length(h) + 1), '^[^#]*') AS address FROM cut),
rules(decision, rule, rule_host, rule_path) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
ruled AS (SELECT p.url, p.host, p.path, p.address, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.decision, length(r.rule)) AS decision
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path) GROUP BY ALL),
edges AS (SELECT DISTINCT s.address AS a, t.address AS b FROM links l JOIN parts s ON s.url = l.url JOIN parts t ON t.url = l.target WHERE s.host <> '' AND t.host <> ''),
reach AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges UNION SELECT r.x, CASE WHEN e.a = r.y THEN e.b ELSE e.a END FROM reach r JOIN edges e ON e.a = r.y OR e.b = r.y),
class AS (SELECT x, bool_or(decision = 'block') AND NOT coalesce(bool_or(decision = 'allow'), false) AS blocked FROM (SELECT x, y FROM reach UNION SELECT x, x FROM reach) q JOIN ruled ON ruled.address = q.y GROUP BY x)
SELECT page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule, coalesce(r.decision, CASE WHEN c.blocked THEN 'block' ELSE 'allow' END) AS verdict,
  (r.rule IS NULL AND coalesce(c.blocked, false)) AS inherited
FROM pages p LEFT JOIN ruled r ON r.url = p.url LEFT JOIN class c ON c.x = r.address
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_phrase_fingerprints": op7_phrase_fingerprints,
    "op8_url_filter": op8_url_filter,
    "op9_html_extract": op9_html_extract,
    "op10_raked_mix": op10_raked_mix,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_cross_polytope": op13_cross_polytope,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _OP3_SQL,
    "op4_jaccard_join": _OP4_SQL,
    "op8_url_filter": _OP8_SQL,
    "op11_filter_audit": _OP11_SQL,
    "op12_fill_in_middle": _OP12_SQL,
}
