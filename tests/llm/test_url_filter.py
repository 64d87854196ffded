import re

from quire.llm.queries import QUERIES
from quire.llm.url_filter import RULES, url_verdicts


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = []
    for text, verdict in RULES:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x=/y", "https://x.org", "https://x.org/", "a://b://c/d", "http://com/fr/",
    "http://evilorg/x", "http://a.com/fr", "http://a.com/fr/#z", "http://a.com/de/q", "http://Example.org/en/15", "http://ÄB.net/É/1", "x://h?/p",
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "t", 1) for i, u in enumerate(URLS)], "page_id long, url string, template string, n int")
    for r in url_verdicts(pages).collect():
        host, path = split(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        text, verdict = rule(host, path)
        assert r.rule == text and (verdict is None or r.verdict == verdict)


def test_query(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op8_url_filter"](spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == split(urls[r.page_id]) and r.verdict in ("allow", "block")
        text, verdict = rule(r.host, r.path)
        assert r.rule == text and (verdict is None or r.verdict == verdict)


def labelled(spark, rows):
    return spark.createDataFrame([(i, f"http://{h}{p}", bad) for i, (h, p, bad) in enumerate(rows)], "page_id long, url string, bad boolean")


def test_tree_blocks_bad_templates(spark):
    rows = [("h.net", f"/spam/{i}.html", True) for i in range(30)] + [("h.net", f"/news/{i}.html", False) for i in range(30)]
    rows += [("h.net", "/spam/999.html", None), ("h.net", "/news/999.html", None), ("h.net", "/spam/words", None), ("g.net", "/x", None)]
    got = {(r.host, r.path): r for r in url_verdicts(labelled(spark, rows), bad="bad").collect()}
    assert got["h.net", "/spam/999.html"].verdict == "block" and got["h.net", "/spam/999.html"].template == "/spam/*"
    assert got["h.net", "/news/999.html"].verdict == "allow"


def test_similar_branches_merge(spark):
    rows = [("h.net", f"/{a}/{i}", i % 2 == 0) for a in ("a", "b", "c") for i in range(20)]
    got = url_verdicts(labelled(spark, rows), bad="bad").collect()
    assert {r.template for r in got} == {"/*/*"}


def test_deep_long_and_empty(spark):
    rows = [("h.net", "/a" * 5000, None), ("h.net", "/" + "x" * 200_000, None), ("h.net", "//", None), ("h.net", "", None)]
    assert url_verdicts(labelled(spark, rows), bad="bad").count() == 4
    assert url_verdicts(labelled(spark, []), bad="bad").count() == 0
