from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.operators import profiling
from newsloom.schemas import CAPTURES, SOURCES
from newsloom.sources.registry import run_errors, validate

NOW = datetime(2026, 2, 6, tzinfo=timezone.utc)


def selectors(spark, *bodies):
    pages = spark.createDataFrame([(f"u{n}", body) for n, body in enumerate(bodies)], "url string, body string")
    rows = profiling.page_selectors(profiling.page_profiles(pages)).collect()
    return {int(r.url[1:]): (r.list_selector, r.title_selector, r.date_selector, r.content_selector) for r in rows}


def link(href, text, css=None):
    return f'<a href="{href}"' + (f' class="{css}"' if css else "") + f">{text}</a>"


def test_selectors_of_pages(spark):
    long = "a text of length"
    got = selectors(
        spark,
        link("1", long, "x y") + link("2", long, "z") + link("2", long, "z") + link("3", "short", "z"),  # a tie: first seen
        link("1", long, "a") + link("1", long, "a") + link("1", long, "b") + link("2", long, "b"),  # repeated targets count once
        link("1", long) + link("2", "short", "a") + "<h1>t</h1><span class='date'>1</span><article></article>",
        "<a>no target</a><h1>t</h1>",
        link("1", "  ten    char ", "c") + "<time>1</time><b class=date></b><main></main>",
        link("", "0123456789", "e") + "<i class='timestamp published'></i>",
        link("1", "0123&amp;5678", "short"),
    )
    assert got == {
        0: ("a.x.y", "title", "time", "body"),
        1: ("a.b", "title", "time", "body"),
        2: ("a[href]", "h1", ".date", "article"),
        4: ("a[href]", "title", "time", "main"),
        5: ("a.e", "title", ".published", "body"),
        6: ("a[href]", "title", "time", "body"),
    }


@pytest.mark.parametrize(
    "body,path",
    [
        ('[{"url":1}]', "$"),
        ("[]", "$"),
        ('{"news":[{"a":1}],"data":[{"b":1}]}', "data"),
        ('{"items":[],"posts":[1],"z":{"y":{"results":[{"a":1}]}}}', "z.y.results"),
        ('{"z":{"q":{"news":[{"a":1}]}},"a":{"items":[{"a":1}]}}', "z.q.news"),
        ('{"z":{"q":1},"a":{"items":[{"a":1}]}}', "a.items"),
        ('{"a":{"b":{"items":[{"a":1}]},"data":[{"a":1}]}}', "a.data"),
        ('{"list":[{"a":1}]}', None),
        ('{"a":"{\\"items\\":[{}]}"}', None),
        ("<html>", None),
    ],
)
def test_item_lists(spark, body, path):
    found = profiling.item_lists(spark.createDataFrame([("u", body)], "url string, body string")).collect()
    assert [r.items_path for r in found] == ([path] if path else [])


def test_proposals_by_kind(spark):
    feed = "<rss><channel><item><title>t</title></item></channel></rss>"
    payload = '{"data":[{"link":"l","name":"n","createdAt":1}]}'
    page = link("1", "a text of length", "k")
    captures = [
        ("https://f.org/", NOW, True, False, feed), ("https://f.org/", NOW, True, True, page),
        ("https://p.org/x/", NOW, True, False, payload), ("https://h.org/", NOW, True, False, page + "a.k"),
        ("https://h.org/", NOW, True, True, page), ("https://j.org/", NOW, True, False, "<div></div>"),
        ("https://j.org/", NOW, True, True, page), ("https://n.org/", NOW, True, True, page), ("https://n.org/", NOW, False, False, "a.k"),
        ("https://none.org/", NOW, True, True, "<p>nothing</p>"),
    ]
    captures = spark.createDataFrame(captures, CAPTURES)
    rows = {r.url: r for r in profiling.propose(captures.select("url"), captures).collect()}
    assert {url[8:9]: r.type for url, r in rows.items()} == {"f": "rss", "p": "api", "h": "html", "j": "js", "n": "js"}
    api = rows["https://p.org/x/"]
    assert api.name == "p.org/x"
    assert (api.howto.api.items_path, api.howto.api.url_field, api.howto.api.date_field, api.howto.api.content_field) == ("data", "link", "createdAt", None)
    assert rows["https://f.org/"].howto.rss.item_limit == 50
    assert (rows["https://j.org/"].howto.js.wait_for, rows["https://j.org/"].howto.js.wait_ms) == ("a.k", 1000)
    valid = validate(spark.createDataFrame([(1, r.name, r.url, r.type, r.howto.asDict(True)) for r in rows.values()], SOURCES))
    assert [r.url for r in valid.where("NOT valid").collect()] == []


def test_violations(spark):
    rows = [
        (1, "n", "u", "rss", {"rss": {"item_limit": 5}}),
        (2, None, None, "x", None),
        (3, "n", "u", "api", {"html": {}}),
        (4, "n", "u", "api", {"api": {"items_path": "$", "url_field": "u", "title_field": "t"}}),
        (5, "n", "u", None, {}),
    ]
    got = validate(spark.createDataFrame(rows, SOURCES)).orderBy("source_id").collect()
    assert [r.violations for r in got] == [["howto.rss.date_field"], ["name", "url", "howto", "type"], ["howto.api"], [], ["type"]]
    assert [r.valid for r in got] == [False, False, False, True, False]


def test_run_errors(spark):
    rows = [(1, "n", "u", "rss", None), (2, "n", "u", "js", {"js": {"list_selector": ""}}), (3, "n", "u", None, None)]
    df = spark.createDataFrame(rows, SOURCES).select("source_id", run_errors().alias("error")).orderBy("source_id")
    assert [r.error for r in df.collect()] == [None, "js needs howto.js.list_selector", "none is none of the types rss, html, js, api"]


def test_likely_rendered(evaluate):
    rows = [("<a.b>", "a.b"), ("x", "a.b"), (None, "a.b")]
    assert evaluate(rows, "raw string, s string", profiling.is_likely_rendered(F.col("raw"), F.col("s"))) == [False, True, True]


def test_sketches_of_days_are_united(spark):
    """30 days with 2,000 targets each, 400 of them new: the whole is within five percent, and small groups are exact."""
    links = spark.range(60_000).selectExpr(
        "id div 2000 AS day", "int(id % 2000) AS pos", "string((id div 2000) * 400 + id % 2000) AS href", "'a text of length' AS text", "array('x') AS classes"
    )
    sketches = profiling.selector_sketches(links, "day")
    whole = profiling.united_counts(sketches.withColumn("all", F.lit(1)), "all").first()
    assert (whole.selector, whole.first_pos) == ("a.x", 0) and abs(whole.targets - 13_600) < 0.05 * 13_600
    small = profiling.united_counts(profiling.selector_sketches(links.where("pos < 100"), "day"), "day").collect()
    assert {r.targets for r in small} == {100}
