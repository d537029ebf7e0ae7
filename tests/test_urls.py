from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import functions as F

from newsloom.functions import urls

VECTORS = [
    ("HTTPS://Ex.COM:8080/A/?q=1#f", "https://ex.com:8080/A"),
    ("https://ex.com", "https://ex.com/"),
    ("https://ex.com//", "https://ex.com/"),
    ("https://ex.com/a//", "https://ex.com/a/"),
    ("/rel/x/", "/rel/x"),
    ("//Ex.com/p", "//ex.com/p"),
    ("?q=1", "/"),
    ("u://ex.com", "u://ex.com/"),
    ("mailto:a@B.c", "mailto:a@B.c"),
    ("https:///p", "https:///p"),
    ("ex.com/p", "ex.com/p"),
    ("http://[bad/", "http://[bad/"),
    (" https://ex.com/a b/", "https://ex.com/a b"),
    ("https:/p", "https:///p"),
    ("http://[::1]:80/x/", "http://[::1]:80/x"),
    ("", "/"),
]


def test_normalize_url(evaluate):
    got = evaluate([(u,) for u, _ in VECTORS], "u string", urls.normalize_url(F.col("u")))
    assert got == [want for _, want in VECTORS]


def by_standard_library(url):
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    path = parts.path or "/"
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), path, "", ""))


def test_normalize_url_agrees_with_the_standard_library(evaluate):
    schemes = ["http://", "HTTPS://", "//", "", "mailto:", "x+y://", "file:", "http:"]
    hosts = ["", "Ex.com", "u:P@ex.COM:8080", "[::1]"]
    paths = ["", "/", "//", "/a", "/a/", "/a//", "a/b/", "/A?x=/y/", "/a#f/", "?q", "#f", "/a b/;p=1/"]
    cases = [s + h + p for s in schemes for h in hosts for p in paths]
    got = evaluate([(u,) for u in cases], "u string", urls.normalize_url(F.col("u")))
    assert dict(zip(cases, got)) == {u: by_standard_library(u) for u in cases}


def test_join_url_agrees_with_the_standard_library(evaluate):
    bases = ["http://a.b/c/d;p?q#f", "https://a.b", "https://a.b/", "http://a.b/c/d/", "http://a.b/c//d/e", "HTTP://A.b/x.html"]
    hrefs = [
        "", "g", "./g", "g/", "/g", "//g", "//g/x/../y", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", ".", "./", "..", "../",
        "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.",
        "g/./h", "g/../h", "http:g", "https:g", "http://x/y/../z", "https://x/y?", "mailto:a@b", "javascript:void(0)",
        "a//b", "/a//b", "g/.", "g/..", "x:y", "a:80/b", "?", "#", "HTTPS://Q/z", " /lead", "/tab\there", "g//", "//g//",
    ]
    cases = [(b, h) for b in bases for h in hrefs]
    got = evaluate(cases, "b string, h string", urls.join_url(F.col("b"), F.col("h")))
    assert dict(zip(cases, got)) == {(b, h): urljoin(b, h) for b, h in cases}


def test_site_name_and_same_url(evaluate):
    rows = [("https://www.x.org/feed/",), ("http://x.org",), ("x.org//",), ("https://a/http://b/",)]
    assert evaluate(rows, "u string", urls.site_name(F.col("u"))) == ["www.x.org/feed", "x.org", "x.org", "a/b"]
    same = urls.is_same_url(F.col("u"), F.lit("https://ex.com/a"))
    assert evaluate([("HTTPS://EX.com/a/#top",), ("https://ex.com/A",)], "u string", same) == [True, False]
