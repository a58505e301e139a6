"""URL filters that see through redirects.

Rules block or allow a host with all its subdomains, from a path on. An address without a rule of its own shares the
fate of its aliases: addresses joined by redirects or canonical links form connected components, in which one explicit
allow outweighs any block. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.components import components
from chorale.llm.store import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url) -> tuple[F.Column, F.Column, F.Column]:
    """Host, path and address of a url. Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path:
    then up to ``? #`` or the end; both empty for null and without ``://``. The address adds the query; it has neither
    scheme nor fragment, which name no other page, and is null where there is no host."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    address = F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))
    return host, path, address


def rule_table(spark, rules) -> DataFrame:
    """(host, path, verdict, rule) from (verdict, "host/path") pairs."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], v, r) for v, r in rules]
    return spark.createDataFrame(rows, "r_host string, r_path string, r_verdict string, rule string")


def judged(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``addresses`` (host, path, ...) with the longest rule that fits, and its verdict; null where none fits.

    Rules meet the distinct hosts, each with its own parent domains, and a host takes its rules along as a short array:
    a host with most of the addresses is one row here, and its addresses are split over tasks in the join back.
    Of rules of equal length an allow wins, then the smaller text.
    """
    hosts = addresses.select("host").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    parents = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("r_host"))
    fit = parents.join(rules, "r_host").groupBy("host").agg(F.sort_array(F.collect_set(F.struct(
        (-F.length("rule")).alias("n"), F.when(F.col("r_verdict") == "allow", 0).otherwise(1).alias("o"), "rule", "r_path", "r_verdict"))).alias("fit"))
    best = F.filter("fit", lambda r: F.startswith(F.col("path"), r["r_path"]))
    return addresses.join(fit, "host", "left").withColumn("best", F.get(best, F.lit(0))).withColumn("rule", F.col("best.rule")).withColumn(
        "ruled", F.col("best.r_verdict")).drop("fit", "best")


def page_links(pages: DataFrame, scratch: Scratch, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): canonical links and immediate refreshes that pages declare, targets made absolute.

    Only pages whose markup mentions either are searched. Targets relative to the host or to the page's folder are
    resolved; ``..`` is left as it is. Null urls and markup give no row.
    """
    low = F.lower(F.col(html))
    some = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").isNotNull() & (F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))))
    tags = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)).alias("tag"))
    canonical = F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")
    refresh = F.col("tag").rlike(r"(?is)^<meta\b.*http-equiv\s*=\s*[\"']?\s*refresh")
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    turn = F.regexp_extract("tag", r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"'\s>]+)", 1)
    to = F.replace(F.when(canonical, href).when(refresh, turn), F.lit("&amp;"), F.lit("&"))
    links = scratch.cut(tags.where(canonical | refresh).select("url", to.alias("to")).where("to <> ''"))
    scheme, site = F.regexp_extract("url", r"^([^:/?#]*):", 1), F.regexp_extract("url", r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    whole = (F.when(F.contains("to", F.lit("://")), F.col("to")).when(F.startswith("to", F.lit("//")), F.concat(scheme, F.lit(":"), F.col("to")))
             .when(F.startswith("to", F.lit("/")), F.concat(site, F.col("to"))).when(F.col("to").rlike("^[?#]"), F.concat(F.regexp_extract("url", r"(?s)^([^?#]*)", 1), F.col("to")))
             .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), F.col("to"))))
    return links.select("url", whole.alias("target"))


def filter_urls(pages: DataFrame, links: DataFrame, rules: DataFrame, scratch: Scratch, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``links`` has (url, target) pairs: redirects and canonical links.

    The verdict is the rule's where one fits; else allow if an alias has an explicit allow, block if an alias is
    blocked, and allow without either. Aliases may be addresses that are no page themselves. Null urls and urls without
    a host have empty parts and are allowed. Columns of ``pages`` named host, path, rule or verdict are replaced.
    """
    host, path, address = parts(F.col(url))
    # the page's own columns travel as one, so that no name of theirs meets one of these
    own = judged(pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"), address.alias("address")), rules)
    ends = scratch.cut(links.select("url", "target")).select(parts(F.col("url"))[2].alias("a"), parts(F.col("target"))[2].alias("b")).where("a <> b")
    ends = scratch.cut(ends.distinct())
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": F.coalesce("ruled", F.lit("allow"))}
    if not ends.isEmpty():
        roots = components(ends, scratch)
        h, p, _ = parts(F.concat(F.lit("x://"), F.col("node")))
        members = judged(roots.withColumns({"host": h, "path": p}), rules)
        fate = members.groupBy("root").agg(F.min("ruled").alias("fate"))  # allow sorts before block
        fate = roots.join(fate, "root").where("fate is not null").select(F.col("node").alias("address"), "fate")
        own = own.join(fate, "address", "left")
        made["verdict"] = F.coalesce("ruled", "fate", F.lit("allow"))
    return own.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c not in made], *[c.alias(n) for n, c in made.items()])
