import time

import pytest
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.html import bad_selector, html_text, matching, page_of, profile_page, read_article, read_page, select_links
from newsloom.sources.articles import SELECTORS, read_articles

PAGE = (
    '<!DOCTYPE html><html><head><title>Site &amp; more</title><style>p > a{}</style><script>var t="<p>";</script></head>'
    '<body><nav><ul><li><a class="lead big" href="/a">Read <b>al</b>l<li><a href=\'/b\'>B</a></ul></nav><!-- <p>no</p> -->'
    '<article id="main"><h1>Head &copy; 1</h1><p><b>bold<br><p>par<!-- cut -->agraph</article>'
    '<div data-x="a > b" class="date">today</div><footer>end'
)


@pytest.fixture(scope="module")
def texts(evaluate):
    """Texts of the elements that match each selector, one list for each (selector, body)."""

    def run(*cases):
        rows = [(css, PAGE if body is None else body) for css, body in ((case, None) if isinstance(case, str) else case for case in cases)]
        return [[link.text for link in links] for links in evaluate(rows, "css string, body string", select_links(F.col("body"), F.col("css")))]

    return run


def whole(body, rendered=False):
    return read_page(body, rendered)[0].strip()


def test_whole_text_skips_code_and_comments():
    assert whole(PAGE) == "Site & more Read al l B Head © 1 bold par agraph today end"
    assert whole("") == ""
    assert whole("no markup &lt;b&gt; at all < 3") == "no markup <b> at all < 3"


def test_rendered_text_breaks_at_blocks_only():
    assert whole(PAGE, rendered=True) == "Read all B Head © 1 bold paragraph today end"


def test_white_space_collapses_wherever_pieces_meet(evaluate):
    body = " \n a<i> b</i>\u3000c <p></p> <p>\x85d\xa0 </p>"
    assert whole(body) == "a b c d" and whole(body, rendered=True) == "a b c d"
    assert evaluate([(body,), (None,), ("",)], "body string", html_text(F.col("body"))) == ["a b c d", None, ""]


def test_selectors(texts):
    found = {
        "h1": ["Head © 1"], "article": ["Head © 1 bold par agraph"], "nav a": ["Read al l", "B"], "ul > li > a.lead.big": ["Read al l"], "body > a": [],
        "#main": ["Head © 1 bold par agraph"], "article[id=main]": ["Head © 1 bold par agraph"], '[id="main"]': ["Head © 1 bold par agraph"],
        ".date, time": ["today"], "[data-x*=\"> b\"]": ["today"], "a[href]": ["Read al l", "B"], "article p": ["bold", "par agraph"], " NAV  A ": ["Read al l", "B"],
        "[data-x='a > b'],h1": ["Head © 1", "today"], "li>a , li": ["Read al l", "Read al l", "B", "B"], "[ class ~= big ]": ["Read al l"], "[class^=le]": ["Read al l"],
        "[href$='b']": ["B"], "[class|=lead]": [], "[id|=main]": ["Head © 1 bold par agraph"], "[id*='']": [], "* > b": ["al", "bold"],
    }
    assert dict(zip(found, texts(*found))) == found


def test_selectors_that_are_not_supported(evaluate):
    cases = ["a:hover", "a >", "> a", ", a", "a,,b", "a + b", "[x=]", "a[", "", "a", "[a='],>']", "é-1.x #y"]
    got = evaluate([([None, case],) for case in cases], "css array<string>", bad_selector(F.col("css")))
    assert got == [*cases[:8], None, None, None, "é-1.x #y"]
    with pytest.raises(Exception, match="unsupported selector: a:hover"):
        evaluate([("a:hover", "<a>")], "css string, body string", select_links(F.col("body"), F.col("css")))


def test_unclosed_and_stray_tags(texts):
    cases = {
        ("p", "<p>one<p>two</p>three"): ["one", "two"], ("div", "<div>a</b>b</div>c"): ["a b"], ("article", "<article>a<div>b</article>c"): ["a b"],
        ("td", "<table><tr><td>1<td>2<tr><td>3</table>"): ["1", "2", "3"], ("li", "<ul><li>a<ul><li>b</ul><li>c</ul>"): ["a b", "b", "c"],
    }
    assert dict(zip(cases, texts(*cases))) == cases


def test_an_element_that_fits_two_alternatives_counts_once(texts):
    assert texts("a, .lead, a[href]", ("div, div div", "<div>a<div>b</div></div>")) == [["Read al l", "B"], ["a b", "b"]]


def test_articles_and_profiles(evaluate):
    rows = [(PAGE, "h1", ".date", "article"), (PAGE, "h2", None, ""), ("plain", "h1", "time", "main"), (None, "h1", "h1", "h1")]
    article = read_article(*(F.col(name) for name in ("body", "t", "d", "c")), F.lit(False))
    got = evaluate(rows, "body string, t string, d string, c string", article)
    text = "Site & more Read al l B Head © 1 bold par agraph today end"
    assert [a and tuple(a) for a in got] == [("Head © 1", "today", "Head © 1 bold par agraph"), (None, None, text), (None, None, "plain"), None]
    (page, nothing) = evaluate([(PAGE,), (None,)], "body string", profile_page(F.col("body")))
    assert nothing is None and page.marks == ["h1", ".date", "article"]
    assert [tuple(link) for link in page.links] == [(0, "/a", "Read al l", ["lead", "big"]), (1, "/b", "B", [])]


def test_hostile_markup_is_read_in_linear_time():
    for body in ("<" * 200_000, "<a " * 100_000, '<a href="' * 50_000, "<div>" * 20_000, "<!--" * 50_000, "<i>" * 20_000 + "</b>" * 20_000, "<!" * 200_000):
        start = time.perf_counter()
        read_page(body)
        assert time.perf_counter() - start < 5


def test_a_predicate_does_not_parse_pages_again(spark):
    pages = spark.createDataFrame([("u", False, PAGE)], "url string, rendered boolean, body string")
    wanted = pages.select("url", "rendered", *(F.lit(css).alias(name) for name, css in zip(SELECTORS, ("h1", ".date", "article"))))
    captures = pages.withColumns({"ok": F.lit(True), "fetched_at": F.lit("2026-02-06").cast("timestamp")})
    good = read_articles(wanted, captures).where("article.title <> '' AND article.content <> ''")
    assert good.select("article.*").collect() == [("Head © 1", "today", "Head © 1 bold par agraph")]
    assert good._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 1


def test_deep_pages_are_searched(spark):
    rows = [("<div>" * 1_500 + "<p>x", "div div p"), ("<main>" + "<div>" * 1_500 + "<p>x", "main > div div > div p, div div p"), ("<ul>" + "<li><a>x" * 3_000, "ul a")]
    pages = spark.createDataFrame(rows, "body string, css string").select(F.size(let(page_of(F.col("body"), F.lit(False)), lambda page: matching(page, F.col("css")))).alias("n"))
    start = time.perf_counter()
    assert [r.n for r in pages.collect()] == [1, 1, 3_000]
    assert time.perf_counter() - start < 20


def test_ancestors_may_be_skipped(texts):
    body = "<main><div class=a><p>1</p><div class=b><div><p>2</p></div></div></div></main><div class=b><p>3</p></div>"
    cases = {".a p": ["1", "2"], ".a > p": ["1"], "main .b > div p": ["2"], "main > .b p": [], "div > div p": ["2"], ".b p": ["2", "3"]}
    assert dict(zip(cases, texts(*((css, body) for css in cases)))) == cases


def test_pages_are_taken_apart_in_steps_of_bounded_size():
    import tracemalloc

    import pyarrow as pa

    page = "<ul>" + "".join(f'<li><a href="/{i}">x</a>' for i in range(2_000))
    bodies = pa.array([None, *[page] * 60, "", "<p>a</p>", page * 30, None])
    tracemalloc.start()
    out = page_of.func(bodies, pa.array([False] * len(bodies)))
    texts = html_text.func(bodies)
    before, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 110_000_000
    assert [len(p["elements"]) if p else None for p in out.to_pylist()] == [None, *[4_001] * 60, 0, 1, 120_030, None]
    assert texts.to_pylist() == [None, *[" ".join(["x"] * 2_000)] * 60, "", "a", " ".join(["x"] * 60_000), None]
    assert len(page_of.func(bodies[:0], pa.array([], pa.bool_()))) == len(html_text.func(bodies[:0])) == 0
