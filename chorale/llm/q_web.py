"""Queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.llm import urlfilter, warc
from chorale.llm.registry import query
from chorale.llm.store import Scratch, table

#: Block and allow rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

URL_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
r(rh, rp, rv, rule) AS (VALUES ('net', '/', 'block', 'net/'), ('example.net', '/en/', 'allow', 'example.net/en/'),
  ('example.com', '/de/', 'block', 'example.com/de/'), ('org', '/fr/', 'allow', 'org/fr/')),
j AS (SELECT s.page_id, s.url, max_by(struct_pack(rule := rule, verdict := rv), length(rule)) AS best
  FROM s JOIN r ON (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp) GROUP BY ALL)
SELECT DISTINCT ON (s.page_id, s.url) s.page_id, s.host, s.path, j.best.rule AS rule, coalesce(j.best.verdict, 'allow') AS verdict
FROM s LEFT JOIN j ON s.page_id = j.page_id AND s.url IS NOT DISTINCT FROM j.url
WHERE (SELECT count(*) FROM pages WHERE regexp_matches(html, '(?i)<link[^>]*canonical|<meta[^>]*refresh')) = 0
"""


@query("op3_url_verdicts", sql=URL_SQL)
def op3_url_verdicts(spark, d):
    """The SQL covers tables whose pages declare no aliases, as the given ones; the others are tested by brute force."""
    scratch = Scratch(spark)
    pages = table(spark, d, "pages")
    judged = urlfilter.filter_urls(pages.select("page_id", "url"), urlfilter.page_links(pages, scratch), urlfilter.rule_table(spark, RULES), scratch)
    return scratch.keep(judged.select("page_id", "host", "path", "rule", "verdict"))


@query("op6_warc_round_trip", sql=r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first_id FROM p GROUP BY sha),
h AS (SELECT p.page_id, strlen(html)::bigint AS payload_bytes, p.sha, first_id FROM p JOIN f ON p.sha = f.sha),
b AS (SELECT *, list_reduce(list_transform(range(4), lambda k: list_reduce(list_transform(range(8), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, 10 * k + 1, 10))::bigint >> (35 - 5 * i)::bigint) & 31) + 1)::bigint, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to FROM b
""")
def op6_warc_round_trip(spark, d):
    scratch = Scratch(spark)
    warc.register(spark)
    folder = scratch.path()
    warc.records(table(spark, d, "pages")).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    out = back.select(  # of a response what its own payload gives, not what its header says
        page("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), warc.base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))
    scratch.made.append(folder)
    return scratch.keep(out)
