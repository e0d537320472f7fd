"""Main text of web pages by equivalence classes of template tokens.

A token is an element with its path of enclosing elements, or a block of text at
its path. Over the different pages of a host each token has an occurrence vector.
Tokens that share a vector form a class: what a template prints together. Classes
nest by the paths of their tokens. Elements printed once a page are the template's
slots; the deepest one that holds most of the pages' running text is the article
slot, and blocks printed alike on nearly all pages are the template's own words.

Vectors are never gathered: a class is told by sums over the pages that do not
depend on their order, made with map-side aggregates. A host may have any share of
all pages. A host's template is short, since its tokens are those that a share of
its pages have.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import col, free_names, without
from gradewright.session import cut_lineage

SUPPORT = 0.05  # share of a host's different pages that have a template token
CONSTANT = 0.90  # share of them that have a block of the template's own words
CONSTANT_PAGES = 10  # fewer different pages tell nothing about repeated blocks
SLOT_SHARE = 0.60  # of the running text that the article slot holds

# Elements and names of HTML.
RAW = "script style noscript template svg iframe math object textarea select title".split()
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SLOTS = set("article body center div main section table tbody td tr".split())
ASIDE = set("nav footer aside form menu dialog head button".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget widgets footer cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup social share sharing related recommended comment comments commentlist disqus replies respond "
    "form login search pagination pager toolbar skip".split()
)
HEAD_NAMES = set("header masthead topbar".split())
# After these a name tells a state of the page, as in `with-sidebar`, and not what the element is.
STATES = set("no not has with without hide hidden show".split())
CLOSES_P = BLOCKS - {"html", "head", "body"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table body html article section div main nav".split())

RAW_START = re.compile(r"<(" + "|".join(RAW) + r")\b", re.I)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)", re.I)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def scan(html: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """Where comments, raw elements, declarations and tags begin and end, and the match of a tag.

    Linear in the page, however malformed. A raw element or comment that is not closed
    goes to the end. A tag that is not closed is text; the search for its end stopped
    at a quote without its twin, and as quoted values hold no `<`, so would the search
    from any `<` before that quote.
    """
    last, failed, at = html.rfind(">"), -1, html.find("<")
    while 0 <= at:
        stop, tag = -1, None
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            stop = len(html) if stop < 0 else stop + 3
        elif at < last:
            raw = RAW_START.match(html, at)
            if raw:
                end = RAW_END[raw[1].lower()].search(html, html.index(">", raw.end()) + 1) if raw.end() <= last else None
                stop = end.end() if end else len(html) if raw.end() <= last else -1
            elif html[at + 1] in "!?":
                stop = html.find(">", at + 2) + 1 or -1
            elif at >= failed:
                tag = TAG.match(html, at)
                if tag:
                    if html.startswith(">", tag.end()):
                        stop = tag.end() + 1
                    else:
                        failed, tag = tag.end(), None
        if stop > 0:
            yield at, stop, tag
            at = html.find("<", stop)
        else:
            at = html.find("<", at + 1)


def _hash(parent: int, value: str) -> int:
    return xxhash.xxh64_intdigest(parent.to_bytes(8, "little") + value.encode("utf-8", "surrogatepass"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Element:
    """An element; `path` is a hash of the labels from the root down to it."""

    __slots__ = ("aside", "block", "chars", "depth", "hidden", "inside", "main", "marked", "name", "outer", "parent", "path", "within")

    def __init__(self, name: str, label: str, parent: Element | None, marked: bool, within: bool):
        self.name, self.parent, self.marked, self.within = name, parent, marked, within
        self.path = _hash(parent.path, label) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        # The outermost article or main element around it, itself included.
        self.outer: Element | None = (parent.outer if parent else None) or (self if name in ("article", "main") else None)
        self.aside = marked or (parent is not None and parent.aside)
        self.block = False
        self.chars = self.main = 0  # running text below, and the most of it in an article or main element


def _opened(name: str, rest: str, parent: Element) -> Element:
    label, aside = name, name in ASIDE
    within = parent.within or name in ("article", "main")
    if "=" in rest:
        for m in NAMED.finditer(rest):
            value = (m[2] or m[3] or m[4] or "").lower()
            words = re.split(r"[^a-z]+", value)
            kind = m[1].lower()
            if kind == "role":
                aside = aside or value in ASIDE_ROLES
                within = within or value == "main"
            else:
                if name not in ("html", "body", "article", "main"):
                    own = {w for v in value.split() for w in _names(v)}
                    aside = aside or not ASIDE_NAMES.isdisjoint(own) or (not within and not HEAD_NAMES.isdisjoint(own))
                label += ("." if kind == "class" else "#") + "-".join(w for w in words if w)
    aside = aside or (name == "header" and not within)
    return Element(name, label, parent, aside, within)


def _names(value: str) -> list[str]:
    """Words of one class or id that name the element."""
    words = [w for w in re.split(r"[^a-z]+", value) if w]
    return [w for i, w in enumerate(words) if not STATES.intersection(words[:i])]


def _settle(elements: list[Element], blocks: list[tuple[Element, str]]) -> None:
    """Take marks from elements that hold the article, so that `hidden` is whether a block lies beside it.

    Such an element has most of the page's running text, no marked element around
    it, and it is a form, or has most of that text in an article or main element, or
    no text would be left. Elements with most of the text lie within each other, so
    this goes inwards once. elements: parents come first.
    """
    total = sum(len(text) for _, text in blocks)
    for owner, text in blocks:
        owner.chars += len(text)
    for e in reversed(elements):
        if e.name in ("article", "main"):
            e.main = e.chars
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.main = max(e.parent.main, e.main)
    large = [e for e in elements if e.marked and 2 * e.chars > total]
    # Of each element the number of marks of such elements from the root on, or None below other marks.
    after: dict[int, int | None] = {}
    for e in elements:
        above = after[id(e.parent)] if e.parent is not None else 0
        after[id(e)] = above if above is None or not e.marked else above + 1 if 2 * e.chars > total else None
    least = min((n for n in (after[id(owner)] for owner, _ in blocks) if n is not None), default=None)
    for n, e in enumerate(large):
        clear = least is not None and least <= n
        if after[id(e)] != n + 1 or not (e.name == "form" or 2 * e.main > total or not clear):
            break
        e.marked = False
    for e in elements:
        e.hidden = e.marked or (e.parent is not None and e.parent.hidden)


def read_page(html: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Elements, those around others first, and blocks of text with their element.

    Time and memory are linear in the page, whatever its nesting.
    """
    root = Element("", "", None, False, False)
    stack, elements = [root], [root]
    places: dict[str, list[int]] = {}  # of each name, where it is open in the stack
    walls: list[int] = [0]  # where elements of BLOCKS are open
    blocks: list[tuple[Element, str]] = []
    parts: list[str] = []
    owner = root

    def close_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((owner, text))

    def add(text: str) -> None:
        nonlocal owner
        if not parts:
            owner = stack[-1]
        parts.append(text)

    def pop_to(k: int) -> None:
        while len(stack) > k:
            name = stack.pop().name
            places[name].pop()
            if name in BLOCKS:
                walls.pop()

    at = 0
    for start, stop, tag in scan(html):
        if start > at:
            # Text beside the article does not run on into text of the article.
            if parts and stack[-1].aside != owner.aside:
                close_block()
            add(html[at:start])
        at = stop
        if tag is None:
            continue
        name = tag["name"].lower()
        if name == "br":
            add(" ")
            continue
        block = name in BLOCKS
        if block:
            close_block()
        if tag["end"]:
            # An inline end tag closes nothing around a block.
            if places.get(name) and (block or places[name][-1] > walls[-1]):
                pop_to(places[name][-1])
            continue
        if name in CLOSES_P or name in SAME_LEVEL:
            scope = max((places[n][-1] for n in SCOPE if places.get(n)), default=0)
            closed = [*SAME_LEVEL.get(name, ()), *["p"] * (name in CLOSES_P)]
            # Names of one scope and above it: few of a name are open, since each start closes the last.
            inner = [k for n in closed for k in places.get(n, ())[bisect.bisect_right(places.get(n, ()), scope):][:1]]
            if inner:
                pop_to(min(inner))
        made = _opened(name, tag["rest"], stack[-1])
        made.block = block
        elements.append(made)
        if name not in VOID and not tag["rest"].endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if block:
                walls.append(len(stack))
            stack.append(made)
    add(html[at:])
    close_block()
    _settle(elements, blocks)
    return elements, blocks


def block_hash(owner: Element, text: str) -> int:
    return _signed(_hash(owner.path, "\n" + text))


def host_of(url: Column | str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def tokens(html: Column) -> Column:
    """Tokens of a page: path (a hash), its depth, name and the path of the article
    around it, block (its hash, or NULL for an element), times, and characters of
    running text below it."""
    fields = [("path", pa.int64()), ("depth", pa.int32()), ("name", pa.string()), ("outer", pa.int64()),
              ("block", pa.int64()), ("times", pa.int32()), ("chars", pa.int64())]

    @F.arrow_udf("array<struct<path:long,depth:int,name:string,outer:long,block:long,times:int,chars:long>>")
    def run(pages: pa.Array) -> pa.Array:
        offsets: list[int] = [0]
        columns: list[list] = [[] for _ in fields]
        for page in pages:
            elements, blocks = read_page(page.as_py() or "")
            for e in elements:
                e.chars = 0
            same: dict[tuple[int, int], list] = {}
            for owner, text in blocks:
                if owner.hidden:
                    continue
                owner.chars += len(text)
                same.setdefault((owner.path, block_hash(owner, text)), [owner, 0])[1] += 1
            count: dict[int, list] = {}
            for e in reversed(elements):
                if e.parent is not None:
                    e.parent.chars += e.chars
                if e.block or e.parent is None:
                    held = count.setdefault(e.path, [e, 0, 0])
                    held[1] += 1
                    held[2] += e.chars
            made = [(e, None, n, chars) for e, n, chars in count.values()] + [(e, h, n, 0) for (_, h), (e, n) in same.items()]
            for e, h, n, chars in made:
                row = (_signed(e.path), e.depth, e.name, _signed(e.outer.path) if e.outer else None, h, n, chars)
                for column, value in zip(columns, row):
                    column.append(value)
            offsets.append(len(columns[0]))
        rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return run(html)


def classes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Equivalence classes of each host's tokens.

    One row per host and class: `pages` and `times` (in how many different pages,
    and how often in all, each of its tokens occurs), `host_pages`, and `tokens`
    (depth, path, block, share of the running text, name, outer), outermost first. A page
    that repeats another of its host counts once.
    """
    whole = F.coalesce(col(html), F.lit(""))
    found = pages.select(host_of(url).alias("host"), F.xxhash64(whole).alias("page"), F.inline(tokens(whole)))
    once = found.groupBy("host", "path", "block", "page").agg(
        *[F.max(c).alias(c) for c in ("depth", "name", "outer", "times", "chars")])
    # Order-free sums over pages stand for the vector.
    mixed = F.xxhash64("page", "times")
    token = once.groupBy("host", "path", "block").agg(
        *[F.max(c).alias(c) for c in ("depth", "name", "outer")],
        F.count("*").alias("pages"), F.sum("times").alias("times"), F.sum("chars").alias("chars"),
        F.sum(mixed.bitwiseAND(F.lit((1 << 31) - 1))).alias("low"), F.sum(F.shiftrightunsigned(mixed, 32)).alias("high"))
    token = cut_lineage(token)
    # Written by itself: by its size it is broadcast, or the join may split a host's many tokens.
    host = cut_lineage(token.where("depth = 0 and block is null").select(
        col("host").alias("of"), col("pages").alias("host_pages"), col("chars").alias("host_chars")))
    kept = token.join(host, col("host") == col("of")).where(
        (col("pages") >= SUPPORT * col("host_pages")) & (col("block").isNull() | (col("pages") >= CONSTANT * col("host_pages"))))
    share = F.when(col("host_chars") > 0, col("chars") / col("host_chars")).otherwise(0.0)
    row = F.struct("depth", "path", "block", share.alias("share"), "name", "outer")
    return kept.groupBy("host", "host_pages", "pages", "times", "low", "high").agg(F.sort_array(F.collect_list(row)).alias("tokens")).drop("low", "high")


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Of each host: `slots`, article slots (depth, path and the path of the article
    element around), outermost first, and `words`, hashes of the template's own blocks."""
    made = classes(pages, url, html).select("host", "host_pages", "pages", "times", F.inline("tokens"))
    # Printed once a page; text shares are told over the pages that have the element.
    over = col("share") * col("host_pages") / col("pages")
    slot = col("block").isNull() & (col("times") == col("pages")) & col("name").isin(*sorted(SLOTS)) & (over >= SLOT_SHARE)
    own = col("block").isNotNull() & (col("host_pages") >= CONSTANT_PAGES)
    return made.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(slot, F.struct("depth", "path", "outer")))).alias("slots"),
        F.collect_list(F.when(own, col("block"))).alias("words"),
    )


def text_of(html: str, slots: list[tuple[int, int | None]], words: set[int]) -> str:
    """Blocks of the page's deepest slot (path, path of the article around it), in order, without the template's own."""
    elements, blocks = read_page(html)
    there = {_signed(e.path) for e in elements if e.block}
    # A slot inside an article element is no better than the article itself.
    slot = next((path if outer is None else outer for path, outer in reversed(slots) if path in there), 0)
    for e in elements:
        e.inside = slot == _signed(e.path) or (e.parent is not None and e.parent.inside)
    return "\n".join(
        text for owner, text in blocks
        if not owner.hidden and owner.inside and not (words and block_hash(owner, text) in words))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add `main_text`: the article's blocks, joined by line feeds, '' if there is none.

    NULL and empty pages have none; a NULL or odd url is a host of its own kind ('').
    Repeated rows are treated alike. An input column `main_text` gives way.
    """
    docs = without(pages, "main_text")
    host, name, slot, word = free_names(docs, "_host", "_of", "_slots", "_words")
    template = cut_lineage(templates(docs, url, html).toDF(name, slot, word))

    @F.arrow_udf("string")
    def run(htmls: pa.Array, slots: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([
            text_of(h.as_py() or "", [(x["path"], x["outer"]) for x in s.as_py() or []], set(w.as_py() or [])) for h, s, w in zip(htmls, slots, words)], pa.string())

    # The table's size on disk decides whether it is broadcast.
    joined = docs.withColumn(host, host_of(url)).join(template, col(host) == col(name), "left")
    return joined.select(*[col(c) for c in docs.columns], run(F.coalesce(col(html), F.lit("")), col(slot), col(word)).alias("main_text"))
