"""Main text of pages: hand-made markup, and runs of hosts against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from newsloom.llm import extraction
from newsloom.llm.extraction import ARTICLE, FURNISHED, MAIN, OPEN, read_page

PAGE = """<!DOCTYPE html><html lang=en class="has-sidebar"><head><meta charset=utf-8><title>T &amp; T</title><style>p{}</style><script>var t="</p><article>no</article>";</script>
<body><nav><ul><li><a href="/a">Home</a><li>News</ul></nav><!-- ad <p>no</p> --><div class="ad top">Buy &lt;now&gt;</div><div id="cookieNotice">We use cookies</div>
<article class="no-ads"><header><h1>Head&shy;line &amp;amp; more</h1></header><p><b>First
  para <i>with</i> in<i>line</i>.<br><p>Second 3 < 4 &copy&nbsp;x</p><aside>Side</aside><script>x()</script><form><p>Mail<input></form><div>Third<ul><li>one<li>two</ul>
<table><tr><td>c1<td>c2<tr><td>c3</table></div><div class=comments><article><p>Nice!</article></div><footer>by me</footer><p hidden>no</article><p>after</p><footer>&copy; host</foot"""


def joined(blocks, kind):
    return " ".join(" ".join(tokens) for k, tokens in blocks if k == kind)


def test_blocks_of_a_page():
    blocks = read_page(PAGE)
    assert joined(blocks, ARTICLE) == "Head\xadline &amp; more First para with inline. Second 3 < 4 © x Third one two c1 c2 c3"
    assert joined(blocks, OPEN) == "after"
    assert joined(blocks, FURNISHED) == "Home News Buy <now> We use cookies Side Mail Nice! by me © host"


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("", []), ("  \n ", []), ("plain  text", [(OPEN, "plain text")]), ("a<br>b<hr/>c", [(OPEN, "a"), (OPEN, "b"), (OPEN, "c")]),
        ("<script>never closed <p>x", []), ("<!-- never closed <p>x", []), ("x<!--->y", [(OPEN, "xy")]), ("<main>m<div class=menu>no</div></main>o", [(MAIN, "m"), (FURNISHED, "no"), (OPEN, "o")]),
        ("<div role='main'>m", [(MAIN, "m")]), ("</div></p>x</b>", [(OPEN, "x")]), ("<p>a<p title='1 > 0'>b</p", [(OPEN, "a"), (OPEN, "b")]), ("a <b title=\"x>y</b> z", [(OPEN, "a y z")]),
        ("<title>t</title>x &unknown; &#65;&#x42;", [(OPEN, "x &unknown; AB")]), ("<head>early", [(OPEN, "early")]), ("<3 </3> ok", [(OPEN, "<3 ok")]),
        ("<header>h</header><article><header>t</header></article>", [(FURNISHED, "h"), (ARTICLE, "t")]), ("<span class='share-it'>s</span>t", [(FURNISHED, "s"), (OPEN, "t")]),
        ("<ARTICLE>A<NAV>n</NAV>B</ARTICLE>", [(ARTICLE, "A"), (FURNISHED, "n"), (ARTICLE, "B")]), ("<p style='display: none'>x</p>y", [(OPEN, "y")]),
    ],
)
def test_odd_markup(text, wanted):
    assert [(kind, " ".join(tokens)) for kind, tokens in read_page(text)] == wanted


def test_suffixes_with_equal_prefixes_are_neighbours():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 400)
    order, like_last = extraction.suffix_array(codes, 8)
    prefixes = [tuple(codes[i : i + 8]) for i in order]
    assert sorted(order) == list(range(400)) and prefixes == sorted(prefixes)
    assert list(like_last[1:]) == [a == b for a, b in zip(prefixes, prefixes[1:])]


def brute_force(pages):
    """Text of pages without article or main element, from their blocks."""
    hosts = defaultdict(lambda: defaultdict(set))
    streams = {}
    for key, (host, blocks) in pages.items():
        stream = [token for block in blocks for token in block.split()]
        longest = max((block.split() for block in blocks), key=len, default=[])
        streams[key] = host, stream
        for i in range(len(stream) - extraction.LONG + 1):
            hosts[host][tuple(stream[i : i + extraction.LONG])].add(tuple(longest))
    out = {}
    for key, (host, stream) in streams.items():
        gone = set()
        for i in range(len(stream) - extraction.LONG + 1):
            if len(hosts[host][tuple(stream[i : i + extraction.LONG])]) > 1:
                gone.update(range(i, i + extraction.LONG))
        out[key] = " ".join(token for i, token in enumerate(stream) if i not in gone)
    return out


@pytest.mark.parametrize("chunk, min_rows", [(1_000_000, 500_000), (60, 3)])
def test_repeated_runs_of_a_host_are_removed(spark, monkeypatch, chunk, min_rows):
    monkeypatch.setattr(extraction, "CHUNK_TOKENS", chunk)
    spread = extraction.spread_join
    monkeypatch.setattr(extraction, "spread_join", lambda *args: spread(*args, min_rows=min_rows))
    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 2) for _ in range(n))
    notice = ["we and our partners use cookies to give you the best time here", "subscribe to our letter and never miss any of our best stories again"]
    pages, rows = {}, []
    for key in range(120):
        blocks = [say(rnd.randint(0, 4)), notice[0], say(rnd.randint(0, 60)), say(rnd.randint(0, 30)), notice[1] + " " + say(2)]
        blocks = [block for block in blocks if block and rnd.random() < 0.9]
        if key % 10 == 9:
            blocks = pages[key - 1][1] + ["extra"]
        host = rnd.choice(["a.example", "b.example", "b.example", "b.example"])
        pages[key] = host, blocks
        rows.append((key, f"http://{host}/{key}", "<html><body>" + "".join(rnd.choice(["<div>{}</div>", "<p>{}"]).format(b) for b in blocks)))
    rows += [(200, None, None), (201, "http://[bad", ""), (202, "http://a.example/x", f"<article>{notice[0]} <p>and more</article>{notice[1]}"), (203, "http://a.example/x", "<main>" + notice[0] + " own words</main>")]
    df = spark.createDataFrame([(*row, "clash", 1) for row in rows], "page_id long, url string, html string, text string, row int").repartition(5)
    got = {r.page_id: r for r in extraction.extract(df).collect()}
    want = brute_force(pages)
    assert len(got) == len(rows) and sum(len(" ".join(b).split()) for _, b in pages.values()) - sum(len(t.split()) for t in want.values()) > 1500
    assert {key: got[key].text for key in pages} == want
    assert [got[k].text for k in (200, 201, 202, 203)] == ["", "", notice[0] + " and more", "own words"]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_repeated_rows_long_pages_and_nothing(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "http://h/1", f"<article><p>{words}</article>")] * 2 + [(3, "http://h/3", f"<p>{words}")] * 2 + [(None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extraction.extract(df).collect()
    assert sorted(r.text for r in got) == sorted([words] * 4 + ["x"])
    assert extraction.extract(df.limit(0)).count() == 0


def test_notices_that_articles_forget_to_mark_go_by_the_furniture_of_the_host(spark):
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(n))
    notice, teaser, quote, early, far, line = say(21), say(10), say(12), say(9), say(9), say(11)
    unmarked = [f"<article><h1>{say(9)}</h1><p>{say(30)}<div>{notice}</div><p>{say(4)} {notice} {say(4)}<p>{quote}<p>short one</article><aside>{teaser}</aside>" for _ in range(12)]
    own = [f"<article><h1>{teaser}</h1><p>{say(30)}</article><footer>{far}</footer>", f"<article><p>{say(30)}</article><aside>{early}</aside><div class=ad>{teaser}</div>"]
    marked = [f"<div class=newsletter><p>{notice}</div><aside>{line}</aside><article><p>{say(30)}<p>{quote}<p>{far}</article>" for _ in range(3)]
    html = [*unmarked, *own, *marked, *(f"<article><p>{line}<p>{say(30)}</article>" for _ in range(2))]
    rows = [(i, f"http://h/{i}", text) for i, text in enumerate(html)] + [(20 + i, f"http://other/{i}", f"<article><p>{say(20)}<p>{notice}<p>{early}</article>") for i in range(11)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for key, _, text in rows:
        blocks = [" ".join(tokens) for kind, tokens in read_page(text) if kind == ARTICLE]
        assert got[key] == " ".join(block for block in blocks if not (key < 20 and block == notice))
    assert all(got[i].count(notice) == 1 and quote in got[i] for i in range(12)) and got[12].startswith(teaser) and line in got[18] and all(notice in got[20 + i] for i in range(11))
