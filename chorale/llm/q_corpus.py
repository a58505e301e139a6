"""Queries over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.llm import decontaminate, lines, mixing, neardup, negatives, quality, secrets, topk, toxicity
from chorale.llm.registry import query
from chorale.llm.store import Scratch, table


@query("op1_exact_top_k", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS w
  FROM (SELECT vec_id, min(embedding) AS embedding FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::integer AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op1_exact_top_k(spark, d):
    """Vectors that are null or hold a null or a non-finite component take no part; an id that is null neither."""
    whole = table(spark, d, "embeddings").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    ints = whole.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("w"))
    scratch = Scratch(spark)
    rows = scratch.cut(topk.sparse_rows(ints, "vec_id", "w"))
    return scratch.keep(topk.top_k(rows.where(F.col("id") % 50 == 0), rows, 5))


MIX_SQL = """
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents),
k AS (SELECT *, md5('1:' || coalesce(doc_id::varchar, '') || ':' || size::varchar) AS h FROM r),
s AS (
  SELECT source, sum(size)::bigint AS source_size,
    [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::integer] AS w FROM k GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS capped, coalesce(sum(w) OVER b, 0) AS taken_w, sum(w) OVER () AS all_w, sum(source_size) OVER () AS total
  FROM c WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped)::double / (all_w - taken_w)::double AS level FROM o),
f AS (SELECT first(level ORDER BY cap / w, source IS NULL, source) FILTER (level * w <= cap) AS share FROM l),
g AS (SELECT source, source_size, CASE WHEN share IS NULL THEN cap::double ELSE least(cap::double, share * w) END AS target FROM l, f),
p AS (
  SELECT k.*, g.source_size, g.target, sum(size) OVER (PARTITION BY k.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
t AS (
  SELECT p.*, turn, (turn * source_size + cum)::double / target AS finish FROM p, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0),
z AS (SELECT *, sum(size) OVER (ORDER BY finish, h, turn ROWS UNBOUNDED PRECEDING) AS upto FROM t),
n AS (SELECT h, doc_id, source, sum(size) AS taken FROM z WHERE upto <= (SELECT sum(size) FROM k) GROUP BY ALL)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, coalesce(n.taken, 0)::bigint AS taken
FROM p LEFT JOIN n ON p.h = n.h AND p.source IS NOT DISTINCT FROM n.source
"""


@query("op2_mix_sources", sql=MIX_SQL)
def op2_mix_sources(spark, d):
    scratch = Scratch(spark)
    return scratch.keep(mixing.mix(table(spark, d, "documents"), scratch))


@query("op7_secret_scan")
def op7_secret_scan(spark, d):
    found = secrets.scan(table(spark, d, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@query("op8_near_duplicates", sql=r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
z AS (SELECT r, count(*)::bigint AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN z x ON x.r = a JOIN z y ON y.r = b WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(r, o) AS (SELECT r, r FROM w UNION SELECT c.r, t.b FROM c JOIN t ON c.o = t.a),
m AS (SELECT c.r, min(w.doc_id) AS component_id FROM c JOIN w ON w.r = c.o GROUP BY c.r)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id, w.doc_id IS NOT DISTINCT FROM m.component_id AS kept FROM w JOIN m ON w.r = m.r LEFT JOIN z ON z.r = w.r
""")
def op8_near_duplicates(spark, d):
    scratch = Scratch(spark)
    found = neardup.near_duplicates(table(spark, d, "documents"), scratch, percent=85)
    return scratch.keep(found.select("doc_id", "n_shingles", "component_id", "kept"))


@query("op9_repeated_lines")
def op9_repeated_lines(spark, d):
    scratch = Scratch(spark)
    docs = table(spark, d, "documents")
    return scratch.keep(lines.repeated_units(docs, scratch, least_line=1, across=True).union(lines.repeated_passages(docs, scratch)))


@query("op10_benchmark_leaks")
def op10_benchmark_leaks(spark, d):
    scratch = Scratch(spark)
    return scratch.keep(decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), scratch).drop("th"))


@query("op5_toxicity")
def op5_toxicity(spark, d):
    scratch = Scratch(spark)
    return scratch.keep(toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels"), scratch))


@query("op4_quality")
def op4_quality(spark, d):
    scratch = Scratch(spark)
    return scratch.keep(quality.scored(table(spark, d, "documents"), table(spark, d, "labels"), scratch))


@query("op11_hard_negatives", sql="""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS w
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_dot_product(a.w, c.w)::bigint AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM a.vec_id),
p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS w FROM s WHERE same QUALIFY w <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.r, p.w ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::integer AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op11_hard_negatives(spark, d):
    """Anchors are rows whose id is divisible by 50; labels of ids divisible by 7 move on by one."""
    whole = table(spark, d, "embeddings").where("label is not null").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ints = whole.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("w"))
    scratch = Scratch(spark)
    rows = scratch.cut(negatives.vectors(ints, "vec_id", "label", "w"))
    return scratch.keep(negatives.hard_negatives(rows.where("id % 50 = 0"), rows, scratch))
