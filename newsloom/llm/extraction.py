"""Main text of pages: what a page declares about its parts, and a suffix array over the pages of its host.

A page is read once into blocks of text. A block is invisible (scripts, styles, head, hidden elements), furniture (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, by element, role or words of its class and id), part of an article, part of the main element, or open. The candidates are the blocks
of the article, where there is none those of the main element, else the open ones, and the pages of the host decide which parts of them are boilerplate.

For that, the token streams of pages (all visible blocks outside of articles, furniture included) are concatenated, a separator after each page, tokens being told apart by host; so are,
by themselves, the blocks of articles and those of furniture, a separator after each block. A suffix array by prefix doubling, up
to prefixes of ``LONG`` tokens, brings equal prefixes together: an interval of it whose longest common prefix is ``LONG`` or more is one repeated string. Every task does so for
about ``CHUNK_TOKENS`` tokens at a time and hands on one row for each interval; intervals of all chunks meet by a hash of the prefix and the host, combined on the map side. A string
is boilerplate if it is on pages that differ in their longest block: near copies of a page have the same, so they count as one page. All places of
candidate blocks that such a string covers are removed; the runs between them are kept, in order. The places of a string that very many pages have are shared out over tasks.

Passages that articles share may be quotations or copies, so repetition alone says little about them: strings count in articles if they are boilerplate among the articles and, by
themselves, among the furniture of the host. A block goes if such strings cover it whole and most of the host's pages have it, ``PAGES`` at least, near copies counting as one:
a notice that these pages forgot to mark. Lines that some articles share, quotations within a block and headlines that sidebars repeat stay.

Text is decoded, white space becomes one space, blocks are joined by one space. A null or empty page has an empty text. Rows that come twice give two rows; page_id and url may be null (pages
without a host belong together). Elements that are not closed end where their parent ends, an unfinished tag at the end is dropped. Other columns are not read. No bound cuts a page, a host or a string.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import staged, text_steps
from newsloom.operators.skew import spread_join

#: Tokens from which on a repeated string is long; a power of two.
LONG = 8
#: Tokens of one suffix array, about.
CHUNK_TOKENS = 1_000_000
#: Pages that have a block of an article at least where it is taken for a notice.
PAGES = 10
#: Bits of the filter by which blocks of articles are compared with furniture before their strings are; a power of two.
SLOTS = 1 << 24

#: HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INVISIBLE = frozenset("script style head title template noscript iframe object svg math canvas audio video textarea select noembed noframes".split())
IN_HEAD = frozenset("base link meta title style script template noscript".split())
FURNITURE = frozenset("nav footer aside form menu dialog button".split())
BREAKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements that a like one ends.
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Roles, and words of classes and ids, that say the same as those elements.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENTS = frozenset("comment comments disqus replies reply respond".split())

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|(?P<loose>[^>]*+)(?:>|\Z))""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: What a block is.
FURNISHED, OPEN, MAIN, ARTICLE = -1, 0, 1, 2


@dataclass
class Page:
    """Reads a page: ``blocks`` has (what it is, tokens) in page order."""

    blocks: list[tuple[int, list[str]]] = field(default_factory=list)
    #: Open elements: name, whether it is visible, what its text is.
    stack: list[tuple[str, bool, int]] = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)

    def state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (True, OPEN)

    def flush(self) -> None:
        tokens = "".join(self.pieces).split()
        self.pieces.clear()
        if tokens:
            self.blocks.append((self.state()[1], tokens))

    def pop_to(self, index: int) -> None:
        """Close the elements from ``index`` on."""
        self.flush()
        for name, *_ in self.stack[index:]:
            self.opened[name] -= 1
        del self.stack[index:]

    def nearest(self, names: tuple[str, ...], within: frozenset[str] = frozenset()) -> int | None:
        """Where the innermost open element of these names is, unless one of ``within`` is nearer."""
        if not any(self.opened[name] for name in names):
            return None
        for index in range(len(self.stack) - 1, -1, -1):
            if self.stack[index][0] in names:
                return index
            if self.stack[index][0] in within:
                return None
        return None

    def text(self, text: str) -> None:
        if not text:
            return
        if self.stack and self.stack[-1][0] == "head" and not text.isspace():
            self.pop_to(len(self.stack) - 1)
        if self.state()[0]:
            self.pieces.append(html.unescape(text) if "&" in text else text)

    def start(self, name: str, more: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and name not in IN_HEAD:
            self.pop_to(len(self.stack) - 1)
        if name in BREAKS:
            self.flush()
            if name not in ("br", "button", "option", "select", "textarea") and (open_p := self.nearest(("p",), BREAKS - {"p"})) is not None:
                self.pop_to(open_p)
            ended = ENDS_LIKE.get(name)
            if ended and (like := self.nearest(ended, frozenset(("ul", "ol", "dl", "table", "select")))) is not None:
                self.pop_to(like)
        if name in VOID:
            return
        visible, kind = self.state()
        entry = name, *self.meaning(name, more, visible, kind)
        if entry[1:] != (visible, kind):
            self.flush()
        self.stack.append(entry)
        self.opened[name] += 1

    def meaning(self, name: str, more: str, visible: bool, kind: int) -> tuple[bool, int]:
        if not visible or name in INVISIBLE:
            return False, kind
        given = {}
        if more and "=" in more or "hidden" in more:
            given = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(more)}
            if "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower():
                return False, kind
        if kind == FURNISHED or name in FURNITURE or name == "header" and kind != ARTICLE:
            return True, FURNISHED
        role = given.get("role", "").lower()
        words = {word.lower() for word in WORD.findall(f"{given.get('class', '')} {given.get('id', '')}")}
        if role in ROLES or words & (COMMENTS if name in ("article", "main") else NAMES) and name not in ("html", "body"):
            return True, FURNISHED
        if name == "article" or role == "article" or "articlebody" in given.get("itemprop", "").lower():
            return True, ARTICLE
        if name == "main" or role == "main":
            return True, max(kind, MAIN)
        return True, kind

    def end(self, name: str) -> None:
        if name in BREAKS:
            self.flush()
        found = self.nearest((name,), frozenset() if name in BREAKS else BREAKS)
        if found is not None:
            if self.stack[found][1:] != (self.stack[found - 1][1:] if found else (True, OPEN)):
                self.flush()
            pieces, self.pieces = self.pieces, []
            self.pop_to(found)
            self.pieces = pieces


def read_page(text: str) -> list[tuple[int, list[str]]]:
    """The visible blocks of a page: what each is, and its tokens."""
    page, at = Page(), 0
    while (tag := TAG.search(text, at)) is not None:
        page.text(text[at : tag.start()])
        at = tag.end()
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        if tag["end"]:
            page.end(name)
            continue
        page.start(name, tag["more"] or tag["loose"] or "")
        if name in RAW:
            closing = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(text, at)
            at = closing.start() if closing else len(text)
    page.text(text[at:])
    page.flush()
    return page.blocks


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def read_pages(pages: DataFrame) -> DataFrame:
    """Pages with the blocks of their ``article`` (null if they have none) and of ``furniture`` that can hold a long string, the tokens of all blocks but the article's, and those that are candidates."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in text_steps(batch, "html"):
                out: dict[str, list] = {"row": [], "host": [], "article": [], "furniture": [], "stream": [], "candidate": [], "longest": []}
                for url, text in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                    blocks = read_page(text or "")
                    kinds = {kind for kind, _ in blocks}
                    article = [tokens for kind, tokens in blocks if kind == ARTICLE]
                    others = [(kind, tokens) for kind, tokens in blocks if kind != ARTICLE]
                    wanted = None if ARTICLE in kinds else MAIN if MAIN in kinds else OPEN
                    out["row"].append(row)
                    out["host"].append(host_of(url))
                    out["article"].append([" ".join(tokens) for tokens in article] or None)
                    out["furniture"].append([" ".join(tokens) for kind, tokens in others if kind == FURNISHED and len(tokens) >= LONG])
                    out["stream"].append([token for _, tokens in others for token in tokens])
                    out["candidate"].append([kind == wanted for kind, tokens in others for _ in tokens] if wanted is not None else [])
                    # What tells pages apart: the article, or the longest candidate block.
                    out["longest"].append(" ".join(chain.from_iterable(article) if article else max((tokens for kind, tokens in others if kind == wanted), key=len, default=[])))
                    row += 1
                arrays = [part.column("page_id"), part.column("url"), *(pa.array(out[name], kind) for name, kind in _READ)]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", *out])

    read = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    read = read.mapInArrow(task, "page_id long, url string, row long, host string, article array<string>, furniture array<string>, stream array<string>, candidate array<boolean>, longest string")
    return read.withColumn("host", F.xxhash64("host")).withColumn("longest", F.xxhash64("longest"))


_READ = [("row", pa.int64()), ("host", pa.string()), ("article", pa.list_(pa.string())), ("furniture", pa.list_(pa.string())), ("stream", pa.list_(pa.string())), ("candidate", pa.list_(pa.bool_())), ("longest", pa.string())]


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first ``depth`` codes (a power of two), and which of them begin like the one before."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        following = np.append(rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64))
        rank = np.unique(rank * (len(rank) + 1) + following, return_inverse=True)[1].astype(np.int64)
        width *= 2
    order = np.argsort(rank, kind="stable")
    sorted_ranks = rank[order]
    return order, np.append(False, sorted_ranks[1:] == sorted_ranks[:-1])[: len(order)]


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all streams, each with its host, the page of each, and how many tokens of its page follow it."""
    streams = batch.column("stream")
    lengths = np.diff(streams.offsets.to_numpy())
    coded = streams.flatten().dictionary_encode()
    words = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    page = np.repeat(np.arange(len(lengths)), lengths)
    hosts = batch.column("host").to_numpy(zero_copy_only=False).astype(np.uint64)
    hashes = words[coded.indices.to_numpy(zero_copy_only=False)] ^ (hosts[page] * np.uint64(0x9E3779B97F4A7C15))
    left = np.cumsum(lengths)[page] - np.arange(len(page)) if len(page) else page
    return hashes, page, left


def _prefix_keys(hashes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a prefix of ``LONG`` tokens begins, and its hash."""
    places = np.flatnonzero(left >= LONG)
    keys = np.zeros(len(places), np.uint64)
    for i in range(LONG):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[places + i]
    return places, keys.astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    tokens = 0
    for batch in batches:
        start = 0
        for end, length in enumerate(np.diff(batch.column("stream").offsets.to_numpy()), 1):
            tokens += int(length)
            if tokens >= CHUNK_TOKENS:
                yield pa.concat_batches([*held, batch.slice(start, end - start)])
                held, start, tokens = [], end, 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)


def blocks_of(read: DataFrame, name: str) -> DataFrame:
    """The blocks of the column ``name``, each a stream of its own; those that hold no long string are left out."""
    blocks = read.select("row", "host", "longest", F.posexplode(name).alias("block", "text"))
    return blocks.select("row", "host", "longest", "block", F.split("text", " ").alias("stream")).where(F.size("stream") >= LONG)


def near_furniture(blocks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The blocks with a string whose key is among ``prefixes``, and a few others: every key has two places in a filter of ``SLOTS`` bits."""
    ways = F.explode(F.array(F.col("key").bitwiseAND(SLOTS - 1), F.shiftright("key", 32).bitwiseAND(SLOTS - 1)))
    taken = np.zeros(SLOTS, bool)
    taken[prefixes.select(ways.alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    bits = prefixes.sparkSession.sparkContext.broadcast(np.packbits(taken, bitorder="little"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, page, left = _coded(batch)
            places, keys = _prefix_keys(hashes, left)
            near = np.ones(len(keys), bool)
            for slot in (keys & (SLOTS - 1), keys >> 32 & (SLOTS - 1)):
                near &= (bits.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).view(bool)
            yield batch.filter(pa.array(np.bincount(page[places[near]], minlength=batch.num_rows) > 0))

    return blocks.mapInArrow(task, blocks.schema)


def repeated_prefixes(read: DataFrame) -> DataFrame:
    """Hashes of host and prefix (``key``) for the strings that pages with different longest blocks have."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, page, left = _coded(chunk)
            if not len(hashes):
                continue
            # A separator of its own after each page, so that no prefix goes on into the next one.
            ends = np.flatnonzero(left == 1) + 1
            codes = np.insert(np.unique(hashes, return_inverse=True)[1].astype(np.int64), ends, -1 - np.arange(len(ends)))
            order, like_last = suffix_array(codes, LONG)
            place = np.insert(np.arange(len(hashes)), ends, -1)[order]
            ok = (place >= 0) & (left[place] >= LONG)
            if not ok.any():
                continue
            interval = np.cumsum(~like_last)[ok]
            place = place[ok]
            starts = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
            told = chunk.column("longest").to_numpy()[page[place]]
            begin, keys = _prefix_keys(hashes, left)
            by_place = np.zeros(len(hashes), np.int64)
            by_place[begin] = keys
            values = by_place[place[starts]], np.minimum.reduceat(told, starts), np.maximum.reduceat(told, starts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["key", "low", "high"])

    intervals = read.select("host", "stream", "longest").mapInArrow(task, "key long, low long, high long")
    return intervals.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("key")


def places_of(streams: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, block, size, start): where prefixes begin in streams (row, block, host, stream), and how long these are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, page, left = _coded(batch)
            places, keys = _prefix_keys(hashes, left)
            pages = page[places]
            first = np.searchsorted(page, pages) if len(pages) else pages
            rows, blocks = (batch.column(name).to_numpy()[pages] for name in ("row", "block"))
            starts, sizes = places - first, left[first]
            columns = [pa.array(keys), pa.array(rows, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (blocks, sizes, starts))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "row", "block", "size", "start"])

    places = streams.select("row", "block", "host", "stream").mapInArrow(task, "key long, row long, block int, size int, start int")
    return spread_join(places, prefixes, ["key"], "left_semi", ["row", "block", "start"]).select("row", "block", "size", "start")


def covered(read: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, starts): where prefixes begin in the pages that have no article."""
    streams = read.where(F.col("article").isNull()).select("row", F.lit(0).alias("block"), "host", "stream")
    return places_of(streams, prefixes).groupBy("row").agg(F.collect_list("start").alias("starts"))


def unmarked(read: DataFrame) -> DataFrame:
    """(row, blocks): blocks of articles that most pages of their host have, covered whole by strings that are boilerplate among the articles and among the furniture."""
    furniture = staged(repeated_prefixes(blocks_of(read, "furniture")), "furniture-prefixes")
    articles = staged(near_furniture(blocks_of(read, "article"), furniture), "article-blocks")
    both = staged(repeated_prefixes(articles).join(furniture, "key", "left_semi"), "article-prefixes")
    places = places_of(articles, both).groupBy("row", "block", "size").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    starts = F.col("starts")
    steps = F.transform(starts, lambda start, i: F.when(i > 0, start - F.get(starts, i - 1)).otherwise(start))
    whole = (F.get(starts, F.lit(0)) == 0) & F.forall(steps, lambda step: step <= LONG) & (F.element_at(starts, -1) + LONG == F.col("size"))
    told = articles.select("row", "block", "host", "longest", F.xxhash64("stream").alias("text"))
    found = staged(places.where(whole).select("row", "block").join(told, ["row", "block"]), "article-notices")
    having = found.groupBy("host", "text").agg(F.count_distinct("longest").alias("n")).where(F.col("n") >= PAGES)
    hosts = read.where(F.col("article").isNotNull()).groupBy("host").agg(F.count_distinct("longest").alias("all"))
    most = having.join(hosts, "host").where(F.col("n") * 2 > F.col("all")).select("host", "text")
    return found.join(most, ["host", "text"], "left_semi").groupBy("row").agg(F.collect_set("block").alias("blocks"))


def _kept(stream: list[str], candidate: list[bool], starts: list[int] | None) -> str:
    keep = np.array(candidate, bool)
    if starts:
        marks = np.zeros(len(keep) + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, np.array(starts) + LONG, -1)
        keep &= np.cumsum(marks)[:-1] == 0
    return " ".join(stream[i] for i in np.flatnonzero(keep))


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page (page_id, url, html): page_id, url, text, n_chars."""
    read = staged(read_pages(pages), "read-pages")
    starts = covered(read, staged(repeated_prefixes(read), "prefixes"))
    # Hardly ever more than a few rows: once written, their size is known, and no text is shuffled to meet them.
    gone = staged(unmarked(read), "unmarked")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_kept(*row) for row in zip(*(batch.column(name).to_pylist() for name in ("stream", "candidate", "starts")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    blocks = F.filter("article", lambda _, i: ~F.array_contains(F.coalesce("blocks", F.array().cast("array<int>")), i))
    articles = read.where(F.col("article").isNotNull()).select("row", "page_id", "url", "article").join(gone, "row", "left")
    with_article = articles.select("page_id", "url", F.array_join(blocks, " ").alias("text"))
    without = read.where(F.col("article").isNull()).select("row", "page_id", "url", "stream", "candidate").join(starts, "row", "left")
    texts = with_article.unionAll(without.select("page_id", "url", "stream", "candidate", "starts").mapInArrow(task, "page_id long, url string, text string"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
