import random

from chorale.llm.components import components
from chorale.llm.store import Scratch
from chorale.llm.urlfilter import filter_urls, page_links, rule_table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    i = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:i])
    tail = rest[i:]
    j = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return host, tail[:j]


def rule(host, path):
    fit = [(len(r), v, r) for v, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://example.net", "http://example.net?x", "http://net/", "http://xnet/", "https://b.org/fr/1", "https://b.org/de/1",
        "http://www.example.com/de/", "http://www.example.com/fr/", "http://sub.example.net/en/", "http://a.net//en/", "x://É.net/", "http://u:p@q.org/fr/a#/b", "http://example.net/en"]


def test_rules_and_parts_against_plain_code(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in filter_urls(pages, spark.createDataFrame([], "url string, target string"), rule_table(spark, RULES), Scratch(spark)).collect()}
    for i, u in enumerate(URLS):
        host, path = split(u)
        v, r = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, r, v or "allow"), u


def test_aliases_share_fate_and_allow_wins(spark):
    html = lambda href: f'<html><head><LINK href="{href}" rel=\'canonical\'></head>'
    pages = spark.createDataFrame([
        (1, "http://plain.io/a", html("https://bad.net/x?y=1&amp;z=2")), (2, "http://plain.io/b", '<meta http-equiv=refresh content="0; url=http://plain.io/a#top">'),
        (3, "http://mix.io/a", html("http://bad.net/q")), (4, "http://mix.io/b", html("/a")), (5, "http://mix.io/c/d", html("../b")), (6, "http://mix.io/a2", html("//mix.io/a")),
        (7, "http://ok.org/fr/1", html("http://mix.io/a")), (8, "http://alone.io/", html("http://alone.io/#self")), (9, "http://bad.net/x?y=1&z=2", "<p>canonical</p>"), (10, None, html("http://a.b/"))],
        "page_id long, url string, html string")
    scratch = Scratch(spark)
    got = {r["page_id"]: r["verdict"] for r in filter_urls(pages, page_links(pages, scratch), rule_table(spark, RULES), scratch).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    low = {}
    for x in parent:
        low[find(x)] = min(low.get(find(x), x), x)
    assert got == {x: low[find(x)] for x in parent if any(x in e and e[0] != e[1] for e in edges if None not in e)}


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    s = Scratch(spark)
    assert filter_urls(none, page_links(none, s), rule_table(spark, RULES), s).count() == 0


def test_random_link_graphs_against_union_find_and_any_column_names(spark):
    import random

    from chorale.llm.store import Scratch
    from chorale.llm.urlfilter import filter_urls, rule_table
    r = random.Random(12)
    hosts = ["a.net", "b.a.net", "c.com", "www.c.com", "d.org", "e.org", "f.io", "g.io"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr', 'x'])}/p{i % 120}" for i in range(400)] + [None, "no scheme", "http://"]
    links = [(f"http://h{i}.io/s", f"http://h{i + 1}.io/s") for i in range(40)] + [("http://h40.io/s", "http://h0.io/s")]  # a long cycle
    links += [(r.choice(urls[:400]), r.choice(urls[:400])) for _ in range(60)] + [(urls[i], "http://hub.io/all") for i in range(0, 60, 3)]  # a hot target
    links += [("http://hub.io/all", "http://c.com/de/p1"), (None, urls[0]), (urls[1], None), ("http://h7.io/s", "http://b.a.net/en/own")]
    rules = [("block", "a.net/"), ("allow", "b.a.net/en/"), ("block", "c.com/de/"), ("allow", "d.org/fr/")]

    def cut(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        return host, rest[len(host):].split("?")[0].split("#")[0]

    def ruled(host, path):
        fits = [(len(x), v, x) for v, x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        return max(fits)[1:] if fits else (None, None)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a and b:
            parent[find(cut(a))] = find(cut(b))
    fate = {}
    for x in list(parent):
        v = ruled(*x)[0]
        if v:
            fate[find(x)] = "allow" if "allow" in (v, fate.get(find(x))) else "block"
    want = sorted((str(i), *cut(u), ruled(*cut(u))[1], ruled(*cut(u))[0] or (fate.get(find(cut(u))) if cut(u) in parent else None) or "allow") for i, u in enumerate(urls))
    pages = spark.createDataFrame([(str(i), u, 1, 2, 3, 4, 5, "x") for i, u in enumerate(urls)], "id string, url string, fit int, fate int, best int, node int, row int, host string")
    out = filter_urls(pages, spark.createDataFrame(links, "url string, target string"), rule_table(spark, rules), Scratch(spark))
    got = sorted((x.id, x.host, x.path, x.rule, x.verdict) for x in out.collect())
    assert got == want and {x[-1] for x in want} == {"allow", "block"} and sum(x[3] is None and x[4] == "block" for x in want) > 3
    assert out.where("fit = 1 and fate = 2 and best = 3 and node = 4 and row = 5").count() == len(urls)
