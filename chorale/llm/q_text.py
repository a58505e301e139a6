"""Queries over documents: repeated lines and periodic runs."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from chorale.llm import linededup, periodic
from chorale.llm.registry import query
from chorale.llm.shingles import slices
from chorale.llm.store import Scratch, table


@query("op13_line_dedup", sql=r"""
WITH r AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM r),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 10) GROUP BY key HAVING count(*) >= 2),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.first AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*)::bigint AS n_lines, count(*) FILTER (gone)::bigint AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
""")
def op13_line_dedup(spark, d):
    scratch = Scratch(spark)
    found = linededup.without_repeated_lines(table(spark, d, "documents"), scratch)
    return scratch.keep(found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))


RUNS_SQL = r"""
WITH r AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS h FROM documents),
g AS (SELECT *, len(w)::bigint AS n, h // 10 AS g FROM r),
e AS (SELECT *, g % n AS a FROM g WHERE h % 10 = 0 AND n > 0),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (
  SELECT r, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])) AS word FROM p
  UNION ALL
  SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM g WHERE r NOT IN (SELECT r FROM p)),
m AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i JOIN g ON g.r = x.r WHERE 3 * (y.i - x.i) <= g.n),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island),
f AS (SELECT * FROM s WHERE length >= greatest(24, 3 * q)),
u AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.r = f.r AND o.q < f.q AND f.q % o.q = 0 AND o.start <= f.start AND o.start + o.length >= f.start + f.length)),
b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS said,
  list({'s': start, 'l': length, 'q': q} ORDER BY length::double / q DESC, start, q)[1] AS top FROM u GROUP BY r),
d AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM u),
k AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN d ON t.r = d.r AND t.i = d.i GROUP BY t.r)
SELECT g.doc_id, coalesce(b.n_runs, 0)::bigint AS n_runs, b.top.s::bigint AS start, b.top.l::bigint AS length, b.top.q::bigint AS period,
  (1000 * b.top.l // b.top.q)::bigint AS exponent_milli, sha256(coalesce(b.said, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM g LEFT JOIN b ON g.r = b.r LEFT JOIN k ON g.r = k.r
"""


def repeating(docs):
    """(doc_id, text) where about one text in ten repeats itself: with h the crc32 of the decimal id and g its tenth, the
    n words of a text with h % 10 = 0 go on from word a = g % n as copies of the p = 1 + (n - a) // (3 + g % 8) words there."""

    def job(batches):
        for b in slices(batches):
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = None if d is None or t is None else zlib.crc32(str(d).encode())
                w = periodic.words(t) if h is not None and h % 10 == 0 else ()
                if w:
                    a = h // 10 % len(w)
                    p = 1 + (len(w) - a) // (3 + h // 10 % 8)
                    t = b" ".join(w[:a] + (w[a:a + p] * ((len(w) - a) // p + 1))[:len(w) - a]).decode("utf-8", "surrogatepass")
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(job, "doc_id long, text string")


@query("op12_periodic_runs", sql=RUNS_SQL)
def op12_periodic_runs(spark, d):
    scratch = Scratch(spark)
    found = periodic.with_runs(repeating(table(spark, d, "documents")))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = F.col("strongest")
    return scratch.keep(found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
