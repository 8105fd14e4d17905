"""Main text of web pages by site template removal (operator 1).

Templates are what a site repeats.  A page is read once into its element subtrees; the
subtrees that could be template (navigation, boxes and notices, never the running text of
an article) are hashed, and Spark counts on how many different pages of its host each hash
occurs.  A subtree on at least ``MIN_PAGES`` and a share of the host's different pages is
template and is deleted: ``SITE_SHARE`` for boxes beside the article (a site rotates its
adverts and menus), ``TEXT_SHARE`` for boxes in an article and, on pages without one, for
running text.  Templates are arrays joined to the pages by host.

Pages count as different for a subtree if the longest blocks of their main text outside it
differ.  So copies of a page count once, also near copies with another advert, menu or
title, and a page published a thousand times is not its own template.  A page does not
count for a subtree with more than half of its main text, nor is the subtree deleted
there, unless it recurs on ``MOST_PAGES`` of the host's different pages; for that, pages
count up to ``MOST_TEXT`` of the text.

Templates are deleted from the whole page first.  What is left is read by the meaning of
the markup: its articles that are no teasers (mostly links; else main, else body) without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments.  A class or id that only names such a part does not drop the page's
content: see ``_without_named``.  Character references are decoded, white space inside a block becomes
one space, blocks are joined by one line feed.

Defined results: null or empty html gives empty text; broken markup never fails (an element
that is never closed ends with its parent); a null or odd url belongs to the host ''; repeated
rows stay; an empty table gives an empty result; columns named text, n_chars or n_template are
replaced.  A very long page takes time in proportion to its length, however it is nested.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterable
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize

MIN_PAGES = 4
SITE_SHARE = 0.01
TEXT_SHARE = 0.3
#: Share of a host's pages from which a subtree may be the larger part of a page's text, and
#: the share of text up to which a page speaks for that.
MOST_PAGES = 0.5
MOST_TEXT = 2 / 3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*)>?|<[!?][^>]*>?""",
                    re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_TOKENS = re.compile(r"[a-z]+|[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is not markup
_RAW = frozenset("script style textarea title noscript template iframe xmp noframes noembed".split())
#: elements that begin and end a block of text
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav
    ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: elements without running text of the page
_DROP = frozenset("""head nav footer aside form menu dialog button select option datalist script style
    textarea title noscript template iframe object embed svg math canvas audio video map xmp noframes
    noembed""".split())
_DROP_ROLES = frozenset("""navigation banner contentinfo complementary search form alert alertdialog dialog menu
    menubar toolbar""".split())
#: words of a class or id that name such a part
_DROP_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo
    promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription
    signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments
    disqus respond replies related recommended share sharing social widget toolbar pagination pager paywall""".split())
_REPLY_WORDS = frozenset("comment comments disqus respond replies".split())
#: an element that closes an open one of these when it begins
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div dl main nav ol section table td th tr ul blockquote form".split())
#: inside an article these may be template; running text may not
_BOXES = frozenset("div section aside header footer nav ul ol dl form table figure details".split())


class Element:
    __slots__ = ("tag", "drop", "candidate", "start", "main", "head", "named", "outer", "seen")

    def __init__(self, tag: str, drop: bool, start: int, main: int, outer: int):
        self.tag, self.drop, self.start, self.main, self.outer = tag, drop, start, main, outer
        self.candidate = self.named = -1  # its number among the candidate subtrees, the named ones
        self.head, self.seen = "", 0


class Named:
    """An element that its class or id names as no content, and what tells whether it is."""

    __slots__ = ("reply", "exact", "outer", "begin", "end", "first", "last")

    def __init__(self, words: set[str], attrs: str, outer: int, begin: int, first: int):
        self.reply, self.outer = bool(words & _REPLY_WORDS), outer
        self.exact = any(x in _REPLY_WORDS for name, value in _ATTR.findall(attrs) if name.lower() != "role"
                         for x in value.lower().strip("\"'").split())
        self.begin = self.end = begin   # its blocks
        self.first = self.last = first  # the containers that begin in it


class Page(NamedTuple):
    #: (text, container): the number of the outermost article or main around, or 0
    blocks: list[tuple[str, int]]
    #: by container: its kind, the container around it, characters read, those of them in links
    kinds: list[str]
    parents: list[int]
    read: list[int]
    linked: list[int]
    #: by candidate subtree: its hash (the lowest bit tells boxes beside an article), the range
    #: of its blocks, and the range of its characters, also those that are no running text
    hashes: list[int]
    spans: list[tuple[int, int]]
    seen: list[tuple[int, int]]
    named: list[Named]
    #: containers that are named elements themselves
    own: set[int]


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _DROP or (tag == "header" and not inside):
        return True
    if not attrs:
        return False
    if _HIDDEN.search(_ATTR.sub("", attrs)):
        return True
    return any(name.lower() == "role" and not _DROP_ROLES.isdisjoint(_TOKENS.findall(value.lower()))
               for name, value in _ATTR.findall(attrs))


def _named(tag: str, attrs: str, inside: bool) -> set[str]:
    """The words of a class or id that name a part without running text."""
    if not attrs or tag in ("html", "body", "main"):
        return set()
    found = {x for name, value in _ATTR.findall(attrs) if name.lower() != "role"
             for x in _TOKENS.findall(value.lower())}
    if tag == "article":
        return found & {"comment", "comments", "related", "teaser", "promo", "ad"}
    return found & (_DROP_WORDS if inside else _DROP_WORDS | {"header"})


def _outside(spans: Iterable[tuple[int, int]], n: int) -> list[bool]:
    """For each of ``n`` places whether no span covers it."""
    change = [0] * (n + 1)
    for begin, end in spans:
        change[begin] += 1
        change[end] -= 1
    return [not x for x in accumulate(change[:n])]


def _range_max(values: list[int]) -> Callable[[int, int], int]:
    """The largest of ``values[begin:end]`` (0 for none) in constant time, after n log n."""
    levels = [values]
    while 1 << len(levels) <= len(values):
        below = levels[-1]
        levels.append(list(map(max, below, below[1 << (len(levels) - 1):])))

    def largest(begin: int, end: int) -> int:
        if begin >= end:
            return 0
        k = (end - begin).bit_length() - 1
        return max(levels[k][begin], levels[k][end - (1 << k)])

    return largest


def _without_named(page: Page, alive: list[bool]) -> list[bool]:
    """Which of the blocks left are not in elements that a class or id names as no content.

    A name is only a hint (``content-sidebar-wrap``, ``post share-enabled``): an element stays
    if it holds more than half of the text of the page (or of the article or main around
    it), or a larger article or main than there is outside of such elements.  One that names
    reader comments stays only on a page without an article or main outside; if a whole
    class or id is the word, it must also leave no text outside.
    """
    if not page.named:
        return alive
    sizes = [len(text) if left else 0 for (text, _), left in zip(page.blocks, alive)]
    upto = [0, *accumulate(sizes)]
    free = _outside(((e.begin, e.end) for e in page.named), len(sizes))
    own_size = [0] * len(page.kinds)     # by container, without what is nested in it
    outside = [0] * len(page.kinds)      # by container, outside all named elements
    for (_, container), size, is_free in zip(page.blocks, sizes, free):
        if container:
            own_size[container] += size
            if is_free:
                outside[container] += size
    whole = list(own_size)
    for c in range(len(whole) - 1, 0, -1):  # containers are numbered from the outside
        whole[page.parents[c]] += whole[c]
    for c in page.own:
        own_size[c] = 0                  # what follows asks for containers inside named elements
    largest, within = max(outside), _range_max(own_size)
    gone = []
    for e in page.named:
        inside = upto[e.end] - upto[e.begin]
        most = 2 * inside > (whole[e.outer] if e.outer else upto[-1])
        content = within(e.first, e.last)
        stays = most or content > 0 and content >= largest
        if e.reply and (largest or e.exact and inside < upto[-1]):
            stays = False
        if not stays:
            gone.append((e.begin, e.end))
    return [a and b for a, b in zip(alive, _outside(gone, len(sizes)))]


def parse(page: str) -> Page:
    """Blocks, containers, candidate subtrees and named elements of a page, in linear time."""
    blocks: list[tuple[str, int]] = []
    hashes: list[int] = []
    spans: list[tuple[int, int]] = []
    seen: list[tuple[int, int]] = []
    kinds, parents, read, linked = [""], [0], [0], [0]
    named: list[Named] = []
    own: set[int] = set()
    stack: list[Element] = []
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    scopes: list[int] = [-1]            # places in the stack of elements that end a search
    pieces: list[str] = []      # of the current block
    stream: list[str] = []      # tags, texts and hashes of subtrees so far, what subtrees are hashed from
    dropped = container = links = chars = 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                blocks.append((text, container))
            pieces.clear()

    def close(depth: int) -> None:
        nonlocal dropped, container, links
        while len(stack) > depth:
            e = stack.pop()
            open_at[e.tag].pop()
            if e.tag in _SCOPE:
                scopes.pop()
            if e.tag in _BLOCK or e.drop or e.named >= 0:
                flush()
            dropped -= e.drop
            links -= e.tag == "a"
            if e.candidate >= 0:
                inner = xxhash.xxh64_hexdigest(" ".join(stream[e.start:]).encode("utf-8", "replace"))
                del stream[e.start:]
                stream.append(inner)
                known = xxhash.xxh64_intdigest(f"{e.head} {inner}".encode("utf-8", "replace"))
                beside = not container and e.tag in _BOXES
                hashes[e.candidate] = (known & ~1 | beside) - (1 << 63)
                spans[e.candidate] = (spans[e.candidate][0], len(blocks))
                seen[e.candidate] = (e.seen, chars)
            if e.named >= 0:
                named[e.named].end, named[e.named].last = len(blocks), len(kinds)
            if e.main:
                container = e.outer

    def last_open(tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags that no scope hides, or -1."""
        at = max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)
        return at if at >= scopes[-1] else -1

    def text(data: str) -> None:
        nonlocal chars
        if data:
            stream.append(data)
            size = len(data.strip())
            chars += size
            if not dropped:
                pieces.append(data)
                read[container] += size
                if links:
                    linked[container] += size

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag, attrs = m.group(2).lower(), m.group(3)
        if m.group(1):
            # a stray end of an inline element does not leave its block
            depth = open_at[tag][-1] if open_at.get(tag) else -1
            if depth > (-1 if tag in _BLOCK else scopes[-1]):
                close(depth)
                stream.append("/" + tag)
            elif tag == "p" and depth < 0:
                flush()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _BLOCK:
            if not dropped:
                flush()
            depth = last_open(("p",))  # a paragraph ends where a block begins
            if depth >= 0:
                close(depth)
        if tag in _CLOSES:
            depth = last_open(_CLOSES[tag])
            while depth >= 0:
                close(depth)
                depth = last_open(_CLOSES[tag]) if tag == "tr" else -1
        if tag in _VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        drop = _boilerplate(tag, attrs, bool(container))
        words = set() if drop or dropped else _named(tag, attrs, bool(container))
        outer = container
        main = 0
        if tag in ("article", "main") and not drop and not dropped:
            flush()
            if not container or kinds[container] == "main" and tag == "article":
                kinds.append(tag)
                parents.append(outer)
                read.append(0)
                linked.append(0)
                main = container = len(kinds) - 1
                if words:
                    own.add(main)
        box = tag in _BLOCK and tag not in ("html", "body", "article", "main") and not main
        candidate = box and (tag in _BOXES if container else True)
        if candidate or words or drop and not dropped:
            flush()
        e = Element(tag, drop, len(stream), main, outer)
        if words:
            e.named = len(named)
            named.append(Named(words, attrs, outer, len(blocks), len(kinds)))
        if candidate:
            e.head, e.candidate, e.seen = tag + attrs, len(hashes), chars
            hashes.append(0)
            spans.append((len(blocks), len(blocks)))
            seen.append((chars, chars))
        else:
            stream.append(tag)
        dropped += drop
        links += tag == "a"
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(e)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            before = chars
            text(page[at:end.start() if end else size])
            chars = before  # no text of the page
            at = end.start() if end else size
    close(0)
    flush()
    return Page(blocks, kinds, parents, read, linked, hashes, spans, seen, named, own)


def _main_blocks(page: Page, alive: list[bool]) -> list[bool]:
    """Which of the blocks left are in articles, else in a main; all without either.

    Articles whose text is mostly links are teasers, and only count where there is no other.
    """
    having = {container for (_, container), left in zip(page.blocks, alive) if left and container}
    for kind in ("article", "main"):
        of = {c for c in having if page.kinds[c] == kind}
        if of:
            of = {c for c in of if 2 * page.linked[c] <= page.read[c]} or of
            return [left and b[1] in of for b, left in zip(page.blocks, alive)]
    return alive


def _judged(page: Page) -> list[bool]:
    """The main text as it is without any template."""
    return _main_blocks(page, _without_named(page, [True] * len(page.blocks)))


def _held(page: Page, main: list[bool]) -> tuple[int, list[int]]:
    """Characters of the main text, and those inside each candidate subtree."""
    upto = [0, *accumulate(len(b[0]) if x else 0 for b, x in zip(page.blocks, main))]
    return upto[-1], [upto[end] - upto[begin] for begin, end in page.spans]


def recurrence(page: str) -> tuple[list[int], list[int]]:
    """Hashes of the subtrees of a page that could be template, and for each a hash of the
    page's longest block outside it, whose lowest bit tells subtrees with at most half of the text.

    Each pair comes once.  The hash 0 stands for no subtree.
    """
    read = parse(page)
    main, hashes = _judged(read), read.hashes
    total, held = _held(read, main)
    speaks = [i for i, h in enumerate(held) if h <= MOST_TEXT * total]
    # the longest block (of equally long ones the first in order) before and from each place
    ranked = [(-len(b[0]), b[0]) if x else (1, "") for b, x in zip(read.blocks, main)]
    before = list(accumulate(ranked, min, initial=(1, "")))
    after = list(accumulate(reversed(ranked), min, initial=(1, "")))[::-1]
    rest = {i: min(before[read.spans[i][0]], after[read.spans[i][1]])[1] for i in speaks}
    known: dict[str, int] = {}

    def key(text: str, small: bool) -> int:
        if text not in known:
            known[text] = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) & ~1
        return (known[text] | small) - (1 << 63)

    pairs = {(hashes[i], key(rest[i], 2 * held[i] <= total)) for i in speaks}
    pairs.add((0, key(after[0][1], True)))
    ordered = sorted(pairs)
    return [h for h, _ in ordered], [r for _, r in ordered]


def read_page(page: str, templates: frozenset[int] = frozenset(),
              everywhere: frozenset[int] = frozenset()) -> tuple[str, int]:
    """The main text of a page without the given template subtrees, and the number of
    characters of the whole page (menus, footers and adverts included) that they held.

    One with more than half of the main text goes only if it is also among ``everywhere``.
    Templates go first; names and containers are judged on what is left.
    """
    read = parse(page)
    alive, removed = [True] * len(read.blocks), 0
    found = [i for i, h in enumerate(read.hashes) if h in templates]
    if found:
        total, held = _held(read, _judged(read))
        gone = [i for i in found if 2 * held[i] <= total or read.hashes[i] in everywhere]
        alive = _outside((read.spans[i] for i in gone), len(read.blocks))
        upto = 0
        for begin, end in sorted(read.seen[i] for i in gone):
            removed += max(0, end - max(begin, upto))
            upto = max(upto, end)
    main = _main_blocks(read, _without_named(read, alive))
    return "\n".join(b[0] for b, x in zip(read.blocks, main) if x), removed


def main_text(page: str, templates: frozenset[int] = frozenset(),
              everywhere: frozenset[int] = frozenset()) -> str:
    """The main text of a page without the given template subtrees."""
    return read_page(page, templates, everywhere)[0]


def host(url):
    """Lower-case host of a url, '' for none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))),
                            r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)", 1)


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                   min_pages: int = MIN_PAGES, site_share: float = SITE_SHARE,
                   text_share: float = TEXT_SHARE) -> DataFrame:
    """(host, templates, everywhere): hashes of the subtrees that recur on each host's pages,
    and those of them that recur on most."""
    work = pages.select(host(C.col(url_col)).alias("host"), C.text_bytes(html_col).alias("raw"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(1).to_pylist()
        found = [recurrence(C.decode(x)) for x in raw]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in raw], pa.int64()),
             pa.array([x[0] for x in found], pa.list_(pa.int64())),
             pa.array([x[1] for x in found], pa.list_(pa.int64()))],
            names=["host", "page", "hashes", "rests"])

    read = C.map_arrow(work, run, "host string, page long, hashes array<long>, rests array<long>")
    # copies of a page count once; what is stored is a few numbers per different page
    different = materialize(read.groupBy("host", "page").agg(F.first(F.struct("hashes", "rests")).alias("f")),
                            "page-subtrees")
    pairs = (different.select("host", F.explode(F.arrays_zip("f.hashes", "f.rests")).alias("p"))
             .groupBy("host", F.col("p.hashes").alias("hash"), F.shiftright("p.rests", 1).alias("rest"))
             .agg(F.max(F.col("p.rests").bitwiseAND(F.lit(1))).alias("small")))
    seen = (pairs.groupBy("host", "hash").agg(F.count("*").alias("pages"), F.sum("small").alias("small"))
            .where(F.col("pages") >= min_pages))
    # a host has as many different pages as differ outside some subtree, or outside none
    sizes = seen.groupBy("host").agg(F.max("pages").alias("n"))
    share = F.when(F.col("hash").bitwiseAND(F.lit(1)) == 1, site_share).otherwise(text_share)
    most = F.col("pages") >= F.greatest(share, F.lit(MOST_PAGES)) * F.col("n")
    some = (F.col("small") >= min_pages) & (F.col("small") >= share * F.col("n"))
    common = seen.where(F.col("hash") != 0).join(sizes, "host").where(most | some)
    return common.groupBy("host").agg(F.collect_list("hash").alias("templates"),
                                      F.collect_list(F.when(most, F.col("hash"))).alias("everywhere"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html",
            carry: tuple[str, ...] = ("page_id", "url"), **limits: float) -> DataFrame:
    """The carried columns, text and n_chars of every page, and n_template: the characters
    of the page that its site's templates held."""
    keep = [c for c in carry if c.lower() not in ("text", "n_chars", "n_template")]
    templates = materialize(site_templates(pages, url_col, html_col, **limits)
                            .select(F.col("host").alias("__host"), "templates", "everywhere"), "templates")
    work = (pages.select(*[C.col(c) for c in keep], host(C.col(url_col)).alias("__of"),
                         C.text_bytes(html_col).alias("__raw"))
            .join(templates, F.col("__of") == F.col("__host"), "left")
            .select(*[C.col(c) for c in keep], "templates", "everywhere", "__raw"))
    schema = C.schema(pages, keep, "text string, n_chars long, n_template long")
    names = [f.name for f in schema.fields]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_columns
        known: dict[tuple, frozenset[int]] = {}
        out = []
        for *lists, raw in zip(*(batch.column(n - k).to_pylist() for k in (3, 2, 1))):
            keys = [tuple(x or ()) for x in lists]
            out.append(read_page(C.decode(raw), *(known.setdefault(k, frozenset(k)) for k in keys)))
        return pa.RecordBatch.from_arrays(
            list(batch.columns[:-3]) + [pa.array([x for x, _ in out], pa.string()),
                                        pa.array([len(x) for x, _ in out], pa.int64()),
                                        pa.array([n for _, n in out], pa.int64())], names=names)

    return C.map_arrow(work, run, schema)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(C.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
