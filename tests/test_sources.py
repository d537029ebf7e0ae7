from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.schemas import CAPTURES, SOURCES
from newsloom.sources import apis, dispatch, feeds, registry

NOW = datetime(2026, 2, 10, tzinfo=timezone.utc)


def at():
    return F.lit("2026-02-10 00:00:00").cast("timestamp")


def capture(url, body, ok=True, rendered=False, fetched=NOW):
    return (url, fetched, ok, rendered, body)


def article(title, text, extra=""):
    return f"<html><head><title>x</title></head><body><h1>{title}</h1>{extra}<article>{text}</article></body></html>"


def source(number, url, kind, **section):
    return (number, None, url, kind, {kind: section} if section else None)


@pytest.fixture(scope="module")
def frames(spark):
    def make(sources, captures):
        return spark.createDataFrame(sources, SOURCES), spark.createDataFrame(captures, CAPTURES)

    return make


RSS = """<?xml version="1.0"?>
<rss version="2.0" xmlns:content="c" xmlns:dc="d"><channel><title>F</title><link>https://f.org/</link>
<item><title> One &amp; all </title><link>https://f.org/1</link><pubDate>Fri, 06 Feb 2026 10:00:00 EST</pubDate>
  <description>short</description><content:encoded><![CDATA[<p>Long <b>text</b></p>]]></content:encoded></item>
<item><title>Old</title><link>https://f.org/2</link><pubDate>Thu, 01 Jan 2026 00:00:00 GMT</pubDate></item>
<item><title>Self</title><link>https://F.org/feed/#x</link></item>
<item><link>https://f.org/untitled</link><description>d</description></item>
<item><title>By guid</title><guid>https://f.org/3</guid><dc:date>2026-02-01T00:00:00Z</dc:date><description>&lt;i&gt;from&lt;/i&gt; feed</description></item>
<item><title>No link</title><guid isPermaLink="false">7</guid></item>
<item><title>Last</title><link>https://f.org/4</link><description>not fetched</description></item>
</channel></rss>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>
<entry><title type="html">Entry</title><link rel="self" href="https://a.org/self"/><link href="https://a.org/1"/>
  <updated>2020-01-01T00:00:00Z</updated><summary>sum</summary></entry></feed>"""

FEED_CAPTURES = [
    capture("https://f.org/feed", RSS),
    capture("https://a.org/feed", ATOM),
    capture("https://bad.org/feed", "<rss><channel><item></rss>"),
    capture("https://f.org/3", "<html><title>t</title><p>whole page</p></html>"),
    capture("https://f.org/4", article("x", "never"), ok=False),
    capture("https://a.org/1", article("x", "<p>full</p>text")),
]
FEEDS = [source(1, "https://f.org/feed", "rss", item_limit=1), source(2, "https://a.org/feed", "rss", item_limit=1), source(3, "https://bad.org/feed", "rss")]


def test_feeds(frames):
    sources, captures = frames(FEEDS, FEED_CAPTURES)
    rows = dispatch.fetch(sources, captures, at(), 30, 50, ("rss",)).orderBy("source_id", "pos").collect()
    assert [(r.source_id, r.pos, r.url, r.title, r.published_date, r.content) for r in rows] == [
        (1, 0, "https://f.org/1", "One & all", "2026-02-06T15:00:00+00:00", "Long text"),
        (1, 4, "https://f.org/3", "By guid", None, "t whole page"),
        (1, 6, "https://f.org/4", "Last", None, "not fetched"),
        (2, 0, "https://a.org/1", "Entry", None, "full text"),
    ]


def test_feed_caps_and_listing(frames):
    sources, captures = frames(FEEDS, FEED_CAPTURES)
    capped = dispatch.fetch(sources, captures, at(), 30, 2, ("rss",))
    assert sorted(r.url for r in capped.collect()) == ["https://a.org/1", "https://f.org/1", "https://f.org/3"]
    listed = dispatch.list_urls(sources, captures, at(), 30, 50, ("rss",)).collect()
    assert [r.url for r in listed] == ["https://f.org/1", "https://f.org/untitled", "https://f.org/3", "https://f.org/4", "https://a.org/1"]
    assert [r.source_id for r in feeds.unreadable_feeds(dispatch.open_sources(sources, captures)).collect()] == [3]


LISTING = '<body><a href="/self/">x</a><a href="">no</a><a class="n" href="a">A</a><a class="n" href="/b">B</a><a class="n" href="c#x">C</a></body>'


def pages(kind):
    url = "https://h.org/self"
    return [source(1, url, kind, list_selector="a")], [
        capture(url, LISTING, rendered=kind == "js"),
        capture("https://h.org/a", article("gone", "gone"), ok=False, rendered=kind == "js"),
        capture("https://h.org/b", article(" B <i>b</i>", "<p>b</p>ody", "<time> 1 May </time>"), rendered=kind == "js"),
        capture("https://h.org/c#x", article("C", "", "tail"), rendered=kind == "js"),
    ]


def test_plain_listings_make_up_for_failures(frames):
    howto = dict(list_selector="a", date_selector="time")
    sources, captures = pages("html")
    sources, captures = frames([source(1, "https://h.org/self", "html", **howto)], captures)
    rows = dispatch.fetch(sources, captures, at(), limit=1, kinds=("html",)).collect()
    assert [(r.url, r.title, r.published_date, r.content) for r in rows] == [("https://h.org/b", "B b", "1 May", "b ody")]
    # An article element without text counts as no content.
    assert [r.url for r in dispatch.fetch(sources, captures, at(), limit=2, kinds=("html",)).collect()] == ["https://h.org/b"]


def test_caps_differ_by_kind(frames):
    links = [capture(f"https://h.org/{n}", article(n, f"text {n}"), rendered=drawn) for n in "bc" for drawn in (False, True)]
    listing = '<a href="a">a</a><a href="b">b</a><a href="c">c</a>'
    for kind, want in (("html", ["b", "c"]), ("js", ["b"])):
        sources, captures = frames(
            [source(1, "https://h.org/", kind, list_selector="a")], [capture("https://h.org/", listing, rendered=kind == "js"), *links]
        )
        assert sorted(r.title for r in dispatch.fetch(sources, captures, at(), limit=2, kinds=(kind,)).collect()) == want
        assert [r.url[-1] for r in dispatch.list_urls(sources, captures, at(), limit=2, kinds=(kind,)).collect()] == ["a", "b"]


def test_rendered_articles_fall_back_to_the_body(frames):
    body = "<html><head><title>t</title></head><body><h1>T<b>i</b>tle</h1><div>one<br>two</div></body></html>"
    sources, captures = frames(
        [source(1, "https://h.org/", "js", list_selector="a")],
        [capture("https://h.org/", '<a href="x">x</a>', rendered=True), capture("https://h.org/x", body, rendered=True)],
    )
    row = dispatch.fetch(sources, captures, at(), kinds=("js",)).first()
    assert (row.title, row.content) == ("Title", "Title one two")


def test_long_listings_are_read_in_steps(frames):
    links = "".join(f'<a href="{n}">{n}</a>' for n in range(40))
    good = [capture(f"https://h.org/{n}", article(f"t{n}", "text")) for n in range(40) if n % 5 == 4]
    sources, captures = frames(
        [source(1, "https://h.org/", "html", list_selector="a"), source(2, "https://e.org/", "html", list_selector="a")],
        [capture("https://h.org/", links), capture("https://e.org/", "none"), *good],
    )
    rows = dispatch.fetch(sources, captures, at(), limit=3, kinds=("html",)).orderBy("pos").collect()
    assert [r.pos for r in rows] == [4, 9, 14]
    assert dispatch.fetch(sources, captures.where("url = 'https://e.org/'"), at(), limit=3, kinds=("html",)).count() == 0


PAYLOAD = """{"d":{"l":[{"u":"https://p.org/1","t":" One ","w":5,"c":{"k":1}},"no",{"u":"","t":"x"},{"u":"https://P.org/api/","t":"self"},
 {"u":"https://p.org/2","t":7,"c":null},{"t":"no url"},{"u":"https://p.org/3","t":"Three","c":" text "}]}}"""


def test_payloads(frames):
    api = dict(items_path="d.l", url_field="u", title_field="t", date_field="w", content_field="c")
    sources, captures = frames(
        [source(1, "https://p.org/api", "api", **api), source(2, "https://q.org/api", "api", items_path="d", url_field="u", title_field="t")],
        [capture("https://p.org/api", PAYLOAD), capture("https://q.org/api", PAYLOAD)],
    )
    rows = dispatch.fetch(sources, captures, at(), kinds=("api",)).orderBy("pos").collect()
    assert [(r.pos, r.url, r.title, r.published_date, r.content) for r in rows] == [
        (0, "https://p.org/1", "One", "5", '{"k":1}'),
        (4, "https://p.org/2", "7", None, ""),
        (6, "https://p.org/3", "Three", None, "text"),
    ]
    assert [r.source_id for r in apis.unreadable_payloads(dispatch.open_sources(sources, captures)).collect()] == [2]


def test_api_listing_guesses_the_url_field(frames):
    sources, captures = frames(
        [source(1, "https://p.org/api", "api", title_field="t")],
        [capture("https://p.org/api", '[{"href":"https://p.org/h","link":"https://p.org/l"},{"link":"https://p.org/m","title":null},{"href":"x"}]')],
    )
    assert [r.url for r in dispatch.list_urls(sources, captures, at(), kinds=("api",)).collect()] == ["https://p.org/l", "https://p.org/m"]
    bare = captures.withColumn("body", F.lit('[{"id":7}]'))
    with pytest.raises(ValueError, match="source 1: no howto.api.url_field"):
        dispatch.list_urls(sources, bare, at(), kinds=("api",))


def test_newest_successful_capture_counts(frames):
    old = datetime(2026, 2, 9, tzinfo=timezone.utc)
    item = '[{{"url":"https://p.org/{0}","title":"{0}"}}]'
    sources, captures = frames(
        [source(1, "https://p.org/api", "api", url_field="url", title_field="title")],
        [
            capture("https://p.org/api", item.format("old"), fetched=datetime(2026, 2, 8, tzinfo=timezone.utc)),
            capture("https://p.org/api", item.format("newer"), fetched=old),
            capture("https://p.org/api", item.format("failed"), ok=False),
            capture("https://p.org/api", item.format("drawn"), rendered=True),
        ],
    )
    assert [r.title for r in dispatch.fetch(sources, captures, at(), kinds=("api",)).collect()] == ["newer"]


def test_unknown_types_fail_the_run(frames):
    sources, captures = frames([source(1, "https://p.org/", "ftp")], [])
    with pytest.raises(ValueError, match="source 1: ftp is none of the types"):
        dispatch.fetch(sources, captures, at()).collect()
    sources, _ = frames([source(1, "https://p.org/", "html", title_selector="h1")], [])
    with pytest.raises(ValueError, match="list_selector"):
        registry.check_sources(sources)


def test_bad_selectors_and_shared_ids_are_named_before_a_run(frames):
    page = {"list_selector": "li a", "title_selector": "h1"}
    sources, captures = frames([source(1, "u", "html", **page), source(2, "v", "html", **page | {"list_selector": "li:first-child a"})], [])
    with pytest.raises(ValueError, match="^source 2: unsupported selector li:first-child a$"):
        dispatch.fetch(sources, captures, at())
    sources, _ = frames([source(3, "u", "rss"), source(3, "v", "rss"), source(4, "w", "rss")], [])
    with pytest.raises(ValueError, match="^source 3: an id of 2 sources$"):
        registry.check_sources(sources)
    sources, _ = frames([source(n, "u", "ftp") for n in range(12)], [])
    with pytest.raises(ValueError, match="; 2 more$"):
        registry.check_sources(sources)


def test_registry_file(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text('{"collector": {"sources": [{"name": "n", "url": "u", "type": "rss", "howto": {"rss": {"item_limit": 5}}}, {"url": "v"}]}}')
    rows = registry.read_registry(spark, str(path)).orderBy("source_id").collect()
    assert [(r.source_id, r.name, r.url) for r in rows] == [(0, "n", "u"), (1, None, "v")]
    assert rows[0].howto.rss.item_limit == 5
    path.write_text('{"collector": {"sources": [{"source_id": 1, "url": "a"}, {"url": "b"}, {"url": "c"}]}}')
    assert sorted((r.source_id, r.url) for r in registry.read_registry(spark, str(path)).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    texts = spark.createDataFrame([(f'{{"collector": {{"sources": [{{"url": "{u}"}}, {{"url": "z"}}]}}}}',) for u in "bab"], "value string")
    assert sorted((r.source_id, r.url) for r in registry.parse_registry(texts).collect()) == list(enumerate("abbzzz"))
    path.write_text('{"collector": {}}')
    assert registry.read_registry(spark, str(path)).count() == 0


def test_a_capture_that_comes_twice_counts_once(spark):
    from newsloom.operators.merge import with_body

    rows = spark.createDataFrame([(1, "u", False), (2, "v", False)], "source_id long, url string, rendered boolean")
    log = [("u", False, 1, True, "old"), ("u", False, 2, True, "new"), ("u", False, 2, True, "new"), ("u", False, 2, True, "other"), ("w", False, 3, True, "x")]
    captures = spark.createDataFrame(log, "url string, rendered boolean, fetched_at long, ok boolean, body string")
    found = with_body(rows, captures).collect()
    assert [(r.source_id, r.url) for r in found] == [(1, "u")] and found[0].body in ("new", "other")
    assert with_body(rows, captures.repartition(5)).first().body == found[0].body


def test_feeds_that_are_not_quite_well_formed(evaluate):
    feed = "<rss><channel><item><title>A&nbsp;B &amp; C & D &copy;x &nosuch; &#65; &</title><link>https://f.org/?a=1&b=2</link><description><![CDATA[x &nbsp; & y]]></description></item></channel></rss>"
    (found,) = evaluate([(feed,)], "body string", feeds.feed_entries(F.col("body")))
    assert [(e.title, e.link, e.html) for e in found] == [("A\xa0B & C & D ©x &nosuch; A &", "https://f.org/?a=1&b=2", "x &nbsp; & y")]
    assert evaluate([(None,), ("",), ("& no feed",)], "body string", feeds.well_formed(F.col("body"))) == [None, "", "&amp; no feed"]
