"""Reading HTML captures: an Arrow UDF takes markup apart, Spark expressions find and pick elements.

Taking markup apart is the one step that Spark expressions cannot express (entities, unclosed elements). The UDF is scalar, so that Catalyst moves
filters and column pruning below it, and gives the text of a page with the elements that lie in it. Selectors are parsed and matched, and links, titles,
dates, contents and marks picked, by higher-order functions over those elements.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from newsloom.functions.binding import let

# Executors get this module with the UDFs, so that they need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element classes of HTML that decide where text and elements end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template rt rp".split())
UNSEEN = frozenset("script style template head noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav"
    " ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}}
PARAGRAPH = {"p"}
BARRIERS = frozenset("article body div dl html main nav ol section select table td th ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'][^\s=/]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?")


def events(body: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """``(kind, value, attributes)`` in document order; kind is ``open``, ``close``, ``text`` or ``gap`` (a comment)."""
    at = 0
    while True:
        token = TOKEN.search(body, at)
        if token is None:
            break
        if token.start() > at:
            yield "text", unescape(body[at : token.start()]), {}
        at = token.end()
        slash, name, rest = token.groups()
        if name is None:
            yield "gap", "", {}
            continue
        name = name.lower()
        if slash:
            yield "close", name, {}
            continue
        attributes: dict[str, str] = {}
        if rest:
            for key, value in ATTRIBUTE.findall(rest):
                quoted = value[:1] in "\"'" and len(value) > 1
                attributes.setdefault(key.lower(), unescape(value[1:-1] if quoted else value))
        yield "open", name, attributes
        if name in ("script", "style"):
            end = re.compile(f"</{name}", re.I).search(body, at)
            at = end.start() if end else len(body)
    if at < len(body):
        yield "text", unescape(body[at:]), {}


class Text:
    """Text with its white space collapsed as it comes."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spaced = True

    def add(self, piece: str) -> None:
        words = " ".join(piece.split())
        if words and not self.spaced and piece[0].isspace():
            words = f" {words}"
        if (piece[-1:].isspace() if words else piece and not self.spaced):
            words += " "
        if words:
            self.parts.append(words)
            self.length += len(words)
            self.spaced = words[-1] == " "


#: An open element: where it is in the list of all, its name, and whether its text is read.
Elements = list[list]


def read_page(body: str, rendered: bool = False) -> tuple[str, Elements]:
    """The text of a page, and its elements in document order: name, attributes, parent, last element inside, and where its text begins and ends.

    A captured document separates text at every tag; a rendered one only where a block or line begins, and it shows
    no text of its head.
    """
    unread = UNSEEN if rendered else HIDDEN
    text, elements = Text(), []
    path: list[int] = []
    names: dict[str, int] = {}
    muted = 0

    def leave(depth: int) -> None:
        nonlocal muted
        while len(path) > depth:
            element = elements[path.pop()]
            names[element[0]] -= 1
            muted -= element[0] in unread
            element[3], element[5] = len(elements) - 1, text.length

    for kind, value, attributes in events(body):
        if kind == "text":
            if not muted:
                text.add(value)
            continue
        if not rendered or (kind != "gap" and value not in INLINE):
            text.add(" ")
        if kind == "open":
            if value in CLOSES_PARAGRAPH or value in SIBLINGS:
                ends = SIBLINGS.get(value, PARAGRAPH)
                for depth in range(len(path) - 1, -1, -1) if any(names.get(name) for name in ends) else ():
                    name = elements[path[depth]][0]
                    if name in ends:
                        leave(depth)
                        break
                    if name in BARRIERS:
                        break
            elements.append([value, attributes, path[-1] if path else -1, 0, text.length, 0])
            path.append(len(elements) - 1)
            names[value] = names.get(value, 0) + 1
            muted += value in unread
            if value in VOID:
                leave(len(path) - 1)
        elif kind == "close" and names.get(value):
            for depth in range(len(path) - 1, -1, -1):
                name = elements[path[depth]][0]
                if name == value:
                    leave(depth)
                    break
                # An inline end tag does not close the blocks around it.
                if value in INLINE and name in BARRIERS:
                    break
    leave(0)
    return "".join(text.parts), elements


_INTS = ("parent", "last", "start", "end")
ELEMENT = T.StructType().add("tag", T.StringType()).add("attributes", T.MapType(T.StringType(), T.StringType()))
for _name in _INTS:
    ELEMENT = ELEMENT.add(_name, T.IntegerType())
PAGE = T.StructType().add("text", T.StringType()).add("elements", T.ArrayType(ELEMENT))


def _page_array(pages: list[tuple[str, Elements] | None]) -> pa.Array:
    """Pages as one Arrow array, put together by column."""
    flat = [element for page in pages if page for element in page[1]]
    attributes = [element[1] for element in flat]
    bounds, total = [0], 0
    for given in attributes:
        total += len(given)
        bounds.append(total)
    pairs = [pair for given in attributes for pair in given.items()]
    maps = pa.MapArray.from_arrays(pa.array(bounds, pa.int32()), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    columns = [pa.array([element[0] for element in flat], pa.string()), maps, *(pa.array([element[i] for element in flat], pa.int32()) for i in range(2, 6))]
    struct = pa.StructArray.from_arrays(columns, names=["tag", "attributes", *_INTS])
    bounds, total = [0], 0
    for page in pages:
        total += len(page[1]) if page else 0
        bounds.append(total)
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct)
    texts = pa.array([page[0] if page else None for page in pages], pa.string())
    return pa.StructArray.from_arrays([texts, lists], names=["text", "elements"], mask=pa.array([page is None for page in pages], pa.bool_()))


#: Bytes of markup that are taken apart at a time: a task holds the elements of so much as Python objects. A longer page is a step of its own.
STEP_BYTES = 1_000_000


def page_steps(body: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with about ``STEP_BYTES`` of markup; an empty one for an empty array."""
    sizes = pc.binary_length(body).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = min(int(sizes.searchsorted(before + STEP_BYTES)) + 1, len(sizes))
        yield start, end
        start = end
    if not len(sizes):
        yield 0, 0


@arrow_udf(PAGE)
def page_of(body: pa.Array, rendered: pa.Array) -> pa.Array:
    """A page as ``struct<text, elements>``; null for a null body."""

    def some(start: int, end: int) -> pa.Array:
        rows = zip(body[start:end].to_pylist(), rendered[start:end].to_pylist())
        return _page_array([None if text is None else read_page(text, bool(drawn)) for text, drawn in rows])

    return pa.concat_arrays([some(*step) for step in page_steps(body)])


@arrow_udf(T.StringType())
def html_text(body: pa.Array) -> pa.Array:
    """Text of a fragment or document, collapsed."""

    def some(start: int, end: int) -> pa.Array:
        return pa.array([None if text is None else read_page(text)[0].strip() for text in body[start:end].to_pylist()], type=pa.string())

    return pa.concat_arrays([some(*step) for step in page_steps(body)])


# Selectors: types, classes, ids and attributes of an element, and of its parent or those around it; alternatives.
_VALUE = """(?:"([^"]*)"|'([^']*)'|([^\\]\\s]+))"""
_ATTRIBUTE = f"\\[\\s*([\\w-]+)\\s*(?:([~^$*|]?=)\\s*{_VALUE}\\s*)?\\]"
_SELECTOR = f"(?U)\\s*[>,]\\s*|\\s+|[A-Za-z][\\w-]*|\\*|[.#][\\w-]+|{_ATTRIBUTE}"

TEST = "struct<relation: string, key: string, value: string>"
STEP = f"struct<alternative: int, sign: string, tests: array<{TEST}>>"


def _test(token: Column) -> Column:
    """One test of an element: how the value of an attribute, or its name, relates to a value."""
    parts = [F.regexp_extract(token, f"(?U)^{_ATTRIBUTE}$", group) for group in range(1, 6)]

    def test(relation: Column, key: Column, value: Column) -> Column:
        return F.struct(relation.alias("relation"), key.alias("key"), value.alias("value"))

    return (
        F.when(token.startswith("."), test(F.lit("~="), F.lit("class"), F.substring(token, 2, 2**31 - 1)))
        .when(token.startswith("#"), test(F.lit("="), F.lit("id"), F.substring(token, 2, 2**31 - 1)))
        .when(token.startswith("["), test(parts[1], F.lower(parts[0]), F.concat(*parts[2:])))
        .otherwise(test(F.lit("tag"), F.lit(""), F.lower(token)))
    )


def selector_steps(selector: Column) -> Column:
    """A selector as its steps from the outermost one on, with the number of the alternative that each is of; null if it is not supported."""
    nothing = F.array().cast(f"array<{TEST}>")

    def step(alternative: Column, sign: Column, tests: Column) -> Column:
        return F.struct(alternative.cast("int").alias("alternative"), sign.alias("sign"), tests.alias("tests"))

    def take(steps: Column, token: Column) -> Column:
        last, sign = F.element_at(steps, -1), F.trim(F.regexp_replace(token, r"(?U)\s+", " "))
        further = step(last["alternative"] + (sign == ",").cast("int"), F.when(sign == ">", ">").otherwise(" "), nothing)
        same = step(last["alternative"], last["sign"], F.concat(last["tests"], F.array(_test(token))))
        return F.when(sign.isin("", ">", ","), F.concat(steps, F.array(further))).otherwise(F.concat(F.slice(steps, 1, F.size(steps) - 1), F.array(same)))

    def whole(tokens: Column, bare: Column) -> Column:
        steps = F.aggregate(tokens, F.array(step(F.lit(0), F.lit(" "), nothing)), take)
        return F.when(F.array_join(tokens, "") == bare, let(steps, lambda made: F.when(F.forall(made, lambda s: F.size(s["tests"]) > 0), made)))

    bare = F.regexp_replace(selector, r"(?U)^\s+|\s+$", "")
    parsed = let(bare, lambda text: let(F.regexp_extract_all(text, F.lit(_SELECTOR), F.lit(0)), lambda tokens: whole(tokens, text)))
    # Most selectors are the name of an element.
    return F.when(selector.rlike("^[A-Za-z][A-Za-z0-9]*$"), F.array(step(F.lit(0), F.lit(" "), F.array(_test(selector))))).otherwise(parsed)


def _passes(element: Column, test: Column) -> Column:
    have, value, relation = F.try_element_at(element["attributes"], test["key"]), test["value"], test["relation"]
    related = (
        F.when(relation == "", True)
        .when(relation == "=", have == value)
        .when(relation == "~=", F.array_contains(F.split(have, r"(?U)\s+"), value) & (value != ""))
        .when(relation == "|=", (have == value) | have.startswith(F.concat(value, F.lit("-"))))
        .when(value == "", False)
        .when(relation == "^=", have.startswith(value))
        .when(relation == "$=", have.endswith(value))
        .otherwise(F.contains(have, value))
    )
    return F.when(relation == "tag", (value == "*") | (element["tag"] == value)).otherwise(have.isNotNull() & related)


def _matched(elements: Column, steps: Column) -> Column:
    """Places of the elements that match the steps of one alternative.

    What a step has found are stretches of the page: an element and what lies in it. The next one looks in them, for children of their first element or
    for anything. Stretches in others say nothing new for the latter, so they are left out: the search ends at the first one that begins
    behind the element.
    """
    everything = F.array(F.struct(F.lit(-1).alias("first"), F.lit(2**31 - 1).alias("last")))

    def within(found: Column, place: Column, element: Column, sign: Column) -> Column:
        parent = F.exists(found, lambda f: f["first"] == element["parent"])
        around = F.exists(found, lambda f: (f["first"] < place) & (place <= f["last"]))
        return F.when(sign == ">", parent).otherwise(around)

    def take(found: Column, step: Column) -> Column:
        def stretch(element: Column, place: Column) -> Column:
            fits = F.forall(step["tests"], lambda test: _passes(element, test)) & within(found, place, element, step["sign"])
            return F.when(fits, F.struct(place.alias("first"), element["last"].alias("last")))

        return F.array_compact(F.transform(elements, stretch))

    return F.transform(F.aggregate(steps, everything, take), lambda f: f["first"])


def matching(page: Column, selector: Column) -> Column:
    """Places (from 0) of the elements of a page that match a selector, in document order; null without a page or selector."""

    def places(steps: Column) -> Column:
        alternatives = F.array_distinct(F.transform(steps, lambda s: s["alternative"]))
        found = F.transform(alternatives, lambda a: _matched(page["elements"], F.filter(steps, lambda s: s["alternative"] == a)))
        return F.array_sort(F.array_distinct(F.flatten(found)))

    refused = F.raise_error(F.concat(F.lit("unsupported selector: "), selector)).cast("array<int>")
    known = let(selector_steps(selector), lambda steps: F.when(steps.isNull(), refused).otherwise(places(steps)))
    return F.when(page.isNotNull() & (selector != ""), known)


def element_text(page: Column, place: Column) -> Column:
    """The text of an element, without the text around it."""
    element = F.get(page["elements"], place)
    return F.trim(F.substring(page["text"], element["start"] + 1, element["end"] - element["start"]))


def first_text(page: Column, selector: Column) -> Column:
    """The text of the first element that matches; null if none does."""
    return element_text(page, F.get(matching(page, selector), F.lit(0)))


def _links(page: Column, places: Column) -> Column:
    def link(place: Column, pos: Column) -> Column:
        given = F.get(page["elements"], place)["attributes"]
        classes = F.filter(F.split(F.coalesce(F.try_element_at(given, F.lit("class")), F.lit("")), r"(?U)\s+"), lambda name: name != "")
        return F.struct(pos.alias("pos"), F.try_element_at(given, F.lit("href")).alias("href"), element_text(page, place).alias("text"), classes.alias("classes"))

    return F.transform(places, link)


def select_links(body: Column, selector: Column) -> Column:
    """Elements of a page that match a selector, in document order: ``array<struct<pos, href, text, classes>>``."""
    return let(page_of(body, F.lit(False)), lambda page: _links(page, matching(page, selector)))


def read_article(body: Column, title_selector: Column, date_selector: Column, content_selector: Column, rendered: Column) -> Column:
    """Title, date text and content of an article page; the content falls back to the whole document."""

    def picked(page: Column) -> Column:
        content = F.coalesce(first_text(page, content_selector), F.trim(page["text"]))
        article = F.struct(first_text(page, title_selector).alias("title"), first_text(page, date_selector).alias("date_text"), content.alias("content"))
        return F.when(page.isNotNull(), article)

    return let(page_of(body, rendered), picked)


def bad_selector(selectors: Column) -> Column:
    """The first of an array of selectors that is not supported; null when all are."""
    return F.get(F.filter(selectors, lambda s: (s != "") & selector_steps(s).isNull()), F.lit(0))


# What marks the date of a page, in order of preference.
DATE_MARKS = ("time", ".date", ".published", ".timestamp")
MARKS = ("h1", *DATE_MARKS, "article", "main")


def profile_page(body: Column) -> Column:
    """Anchors of a page, and which of the telling elements it has: ``struct<links, marks>``."""

    def profile(page: Column) -> Column:
        marks = F.filter(F.array(*map(F.lit, MARKS)), lambda mark: F.size(matching(page, mark)) > 0)
        return F.when(page.isNotNull(), F.struct(_links(page, matching(page, F.lit("a[href]"))).alias("links"), marks.alias("marks")))

    return let(page_of(body, F.lit(False)), profile)
