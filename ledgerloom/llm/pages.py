"""Main text of web pages by consensus: pages of a host vote on where their article stands.

Each page scores its containers and votes for the generalised tag-class path of the best one;
Spark sums the votes by host; every page is then read again along its host's winning path, so a
page whose own best container is misleading is read as its siblings are. Pages without the
winning path, or without a host, keep their own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, bounded, rows_out, scratch, type_of

#: Share of a page's running text that its article holds at least.
MAIN_SHARE = 0.7
#: Characters from which a block counts as running text even without a sentence's end.
RUNNING_CHARS = 80
#: Hosts, and bytes of their paths, up to which all winners are broadcast.
MOST_BROADCAST, MOST_BYTES = 100_000, 32_000_000
#: Pages from which a host's winner is broadcast in any case, so no host's pages meet in one task; there is at most
#: one such host for every so many pages.
HOT_PAGES = 50_000

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var picture".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: An open element of the key's kind ends where one of these starts, unless one of its scope lies between.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tfoot": ("tr", "td", "th", "thead", "tbody", "tfoot")}
SCOPE = frozenset("ul ol dl table template html button object select".split())

# What isn't part of an article, by element, role, and word of a class or id.
DROPPED_TAGS = frozenset("head script style title noscript template svg canvas iframe object embed audio video nav footer aside header menu button select option textarea input dialog noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices disclaimer popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar header masthead footer comment comments "
    "disqus reply replies respond share sharing social related recommended recommendations widget widgets copyright".split()
)
ARTICLE_WORDS = frozenset("article post entry story articlebody".split())
#: Class words that differ between pages of one template.
OWN_WORDS = re.compile(r"^(?:category|cat|tag|author|format|lang|item|postid|page-id)-|^(?:active|current|first|last|odd|even)$")

_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?…。！？]['\"”’»)]*$")


@dataclass
class Page:
    """Elements in page order by number (``parent``, ``step``, ...), and blocks as (element, text, in a link) pieces."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    step: list[str] = field(default_factory=lambda: ["html"])
    dropped: list[int] = field(default_factory=lambda: [0])  # 1: by class, role or form, 2: by element
    rank: list[int] = field(default_factory=lambda: [0])
    blocks: list[list[tuple[int, str, bool]]] = field(default_factory=list)

    def path(self, e: int) -> str:
        steps = []
        while e >= 0:
            steps.append(self.step[e])
            e = self.parent[e]
        return "/".join(reversed(steps))

    def along(self, path: str) -> list[int]:
        """Elements that stand at ``path``."""
        steps, depth, found = path.split("/"), [-1] * len(self.tag), []
        for e, p in enumerate(self.parent):
            d = depth[p] + 1 if p >= 0 else 0
            if (p < 0 or depth[p] >= 0) and d < len(steps) and self.step[e] == steps[d]:
                depth[e] = d
                if d == len(steps) - 1:
                    found.append(e)
        return found


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """A tag's attributes and the place behind its ``>``; -1 if the page ends within the tag."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(text, at)
        if m is None:
            end = text.find(">", at)
            return found, end + 1 if end >= 0 else -1
        name, value = m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), "")
        found.setdefault(name, value)
        at = m.end()
        if text[at : at + 1] in ('"', "'") and text[at - 1] == "=":  # a quote that never ends
            return found, -1


def _step(tag: str, classes: str) -> str:
    words = {_DIGITS.sub("#", w.lower()).replace("/", "_") for w in classes.split()}
    return ".".join([tag, *sorted(w for w in words if not OWN_WORDS.search(w))])


def parse(text: str) -> Page:
    """Elements and blocks of a whole page; time grows with its length whatever it holds."""
    page, open_, counts, inline = Page(), [0], {"html": 1}, [{}]
    block: list[tuple[int, str, bool]] = []
    links = 0
    inner: list[list[tuple[str, int]]] = [[]]  # open inline elements of each open block element: tag, element

    def flush() -> None:
        nonlocal block
        if block:
            page.blocks.append(block)
            block = []

    def add(tag: str, attributes: dict[str, str], parent: int) -> int:
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        words = {w.lower() for w in _WORDS.findall(named)} if len(named) > 1 else set()
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", ""))
        soft = tag == "form" or attributes.get("role", "").lower() in DROPPED_ROLES or (tag not in ("html", "body") and words & DROPPED_WORDS)
        page.parent.append(parent)
        page.tag.append(tag)
        page.step.append(_step(tag, attributes.get("class", "")))
        page.dropped.append(2 if tag in DROPPED_TAGS or hidden else 1 if soft else 0)
        article = tag == "article" or "articlebody" in attributes.get("itemprop", "").lower()
        page.rank.append(0 if tag in ("html", "body") else 3 if article else 2 if words & ARTICLE_WORDS else 1 if tag == "main" or attributes.get("role") == "main" else 0)
        return len(page.tag) - 1

    def end_block() -> None:
        nonlocal links
        flush()
        tag = page.tag[open_.pop()]
        counts[tag] -= 1
        inline.pop()
        links -= sum(t == "a" for t, _ in inner.pop())

    def end_open(kinds: tuple[str, ...]) -> None:
        """End the nearest open element of these kinds unless a scope lies between."""
        if any(counts.get(k) for k in kinds):
            for k in range(len(open_) - 1, 0, -1):
                tag = page.tag[open_[k]]
                if tag in kinds:
                    while len(open_) > k:
                        end_block()
                    return
                if tag in SCOPE:
                    return

    def say(part: str) -> None:
        if part:
            block.append((inner[-1][-1][1] if inner[-1] else open_[-1], html.unescape(part) if "&" in part else part, links > 0))

    at, n = 0, len(text)
    while at < n:
        begun = text.find("<", at)
        if begun < 0:
            say(text[at:])
            break
        nxt = text[begun + 1 : begun + 2]
        if nxt == "!" or nxt == "?":
            say(text[at:begun])
            if text.startswith("<!--", begun):
                if text.startswith((">", "->"), begun + 4):
                    at = text.index(">", begun + 4) + 1
                    continue
                m = _COMMENT_END.search(text, begun + 4)
                at = m.end() if m else n
            else:
                end = text.find(">", begun)
                at = end + 1 if end >= 0 else n
            continue
        closing = nxt == "/"
        m = _NAME.match(text, begun + 1 + closing)
        if m is None:
            if closing:  # no name: up to the next > it is a comment
                say(text[at:begun])
                end = text.find(">", begun)
                at = end + 1 if end >= 0 else n
            else:
                say(text[at : begun + 1])
                at = begun + 1
            continue
        say(text[at:begun])
        tag = m.group().lower()
        attributes, at = _attributes(text, m.end())
        if at < 0:
            break
        block_tag = tag not in INLINE and (tag not in VOID or tag == "hr")
        if closing:
            if tag == "br":
                say(" ")
            elif tag in INLINE:
                if inline[-1].get(tag):
                    while True:
                        ended, _ = inner[-1].pop()
                        inline[-1][ended] -= 1
                        links -= ended == "a"
                        if ended == tag:
                            break
            elif counts.get(tag) and tag != "html":
                if tag in ("p", "li", "dt", "dd"):
                    end_open((tag,))
                else:
                    while page.tag[open_[-1]] != tag:
                        end_block()
                    end_block()
            elif block_tag:
                flush()
            continue
        if tag in ("html", "body") and counts.get(tag):
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                end_open(("p",))
                flush()
            continue
        if tag in RAW:  # holds no elements, and nothing of an article
            m = _RAW_END[tag].search(text, at)
            end = text.find(">", m.end()) if m else -1
            at = end + 1 if end >= 0 else n
            continue
        if tag in INLINE:
            if tag == "a" and inline[-1].get("a"):
                while inner[-1]:
                    ended, _ = inner[-1].pop()
                    inline[-1][ended] -= 1
                    links -= ended == "a"
                    if ended == "a":
                        break
            plain = not (attributes.keys() & {"class", "id", "role", "hidden", "style", "aria-hidden"})
            over = inner[-1][-1][1] if inner[-1] else open_[-1]
            inner[-1].append((tag, over if plain else add(tag, attributes, over)))
            inline[-1][tag] = inline[-1].get(tag, 0) + 1
            links += tag == "a"
            continue
        if tag in CLOSES_P:
            end_open(("p",))
        if tag in ENDED_BY:
            end_open(ENDED_BY[tag])
            if tag == "tr":
                end_open(("tr",))
        flush()
        e = add(tag, attributes, inner[-1][-1][1] if inner[-1] else open_[-1])
        open_.append(e)
        counts[tag] = counts.get(tag, 0) + 1
        inline.append({})
        inner.append([])
    flush()
    return page


class Reader:
    """One page, read: which blocks count, and what each container holds."""

    def __init__(self, text: str):
        self.page = page = parse(text)
        size, over = len(page.tag), page.parent
        everything, titles = [0] * size, [0] * size
        for pieces in page.blocks:
            for e, part, _ in pieces:
                everything[e] += len(part)
        for e in range(size - 1, -1, -1):
            titles[e] += page.tag[e] in ("h1", "article", "main")
            if over[e] >= 0:
                everything[over[e]] += everything[e]
                titles[over[e]] += titles[e]
        # a form or a box with a telling class that wraps the article itself isn't left out
        self.out = [False] * size
        for e in range(size):
            wraps = titles[e] and 2 * everything[e] > everything[0]
            self.out[e] = (over[e] >= 0 and self.out[over[e]]) or page.dropped[e] == 2 or (page.dropped[e] == 1 and not wraps)
        #: (owner, text) of each block that isn't left out, in page order
        self.blocks: list[tuple[int, str]] = []
        self.first, self.end = [1 << 60] * size, [-1] * size
        self.running, self.all, self.h1 = [0] * size, [0] * size, [0] * size
        for pieces in page.blocks:
            kept = [p for p in pieces if not self.out[p[0]]]
            text = " ".join("".join([p[1] for p in kept]).split())
            if text:
                e, k = kept[0][0], len(self.blocks)
                for other, _, _ in kept[1:]:
                    e = self._common(e, other)
                self.blocks.append((e, text))
                linked = sum(len(p[1]) for p in kept if p[2])
                self.first[e], self.end[e] = min(self.first[e], k), k + 1
                self.all[e] += len(text)
                if 2 * linked <= len(text) and (len(text) >= RUNNING_CHARS or _SENTENCE_END.search(text)):
                    self.running[e] += len(text)
        for e in range(size - 1, -1, -1):
            self.h1[e] += page.tag[e] == "h1" and not self.out[e]
            if (p := over[e]) >= 0:
                self.first[p], self.end[p] = min(self.first[p], self.first[e]), max(self.end[p], self.end[e])
                self.running[p] += self.running[e]
                self.all[p] += self.all[e]
                self.h1[p] += self.h1[e]
        self.weigh = self.running if self.running[0] else self.all

    def _common(self, a: int, b: int) -> int:
        while a != b:
            if a < b:
                b = self.page.parent[b]
            else:
                a = self.page.parent[a]
        return a

    def best(self) -> tuple[int, int]:
        """The best container and its score in thousandths, 0 if the page has no text.

        Containers with most of the page's running text lie within each other; an article goes
        before a box named as one, before the page's main part, and the deepest before those
        around it, unless it leaves out the title that the others have.
        """
        if not self.weigh[0]:
            return 0, 0
        chain = [e for e in range(len(self.page.tag)) if not self.out[e] and self.weigh[e] >= MAIN_SHARE * self.weigh[0] and self.page.tag[e] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre") and self.page.tag[e] not in INLINE]
        rank = max(self.page.rank[e] for e in chain)
        alike = [e for e in chain if self.page.rank[e] == rank]
        inside = [e for e in alike if self.page.tag[e] not in ("html", "body", "main")] or alike
        titled = max(self.h1[e] for e in inside)
        found = max(e for e in inside if self.h1[e] == titled)
        return found, max(1, 1000 * self.weigh[found] * self.weigh[found] // (self.weigh[0] * max(1, self.all[found])))

    def vote(self) -> tuple[str, int]:
        e, score = self.best()
        return self.page.path(e), score

    def text(self, path: str | None) -> str:
        """Text along ``path``, or of the page's own best container where there is nothing along it."""
        found = [e for e in self.page.along(path) if self.all[e]] if path else []
        most = max((self.weigh[e] for e in found), default=0)
        chosen = [e for e in found if 4 * self.weigh[e] >= most] or [self.best()[0]]
        return "\n".join(t for e in chosen for _, t in self.blocks[self.first[e] : max(self.first[e], self.end[e])]) if self.blocks else ""


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null if it has none."""
    found = F.lower(F.regexp_extract(url.cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(found, F.lit(""))


def winning_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages) of every host: the path with most votes, ties to the path with more pages, then by name.

    One narrow row a page is shuffled, summed before and after, so a host of any size is cheap.
    """
    schema = arrow_of("host string, path string, score long")

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            hosts, cast = batch.column("host").to_pylist(), [Reader(t).vote() for t in batch.column("html").to_pylist()]
            yield rows_out(schema, [hosts, [p for p, _ in cast], [s for _, s in cast]])

    known = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).filter("host IS NOT NULL AND html IS NOT NULL")
    summed = known.mapInArrow(votes, "host string, path string, score long").filter("score > 0").groupBy("host", "path").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    best = summed.groupBy("host").agg(F.max(F.struct("score", "n", "path")).alias("best"), F.sum("n").alias("pages"))
    return best.select("host", "best.path", "pages")


def _with_paths(pages: DataFrame, winners: DataFrame, most_broadcast: int, hot_pages: int) -> DataFrame:
    """``pages`` with their host's ``path``: all winners broadcast where their size allows, else those of hot hosts alone."""
    size = winners.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("path") + F.octet_length("host")), F.lit(0)).alias("bytes")).first()
    if size.n <= most_broadcast and size.bytes <= MOST_BYTES:
        return pages.join(F.broadcast(winners.select("host", "path")), "host", "left")
    hot = F.col("pages") > hot_pages
    marked = pages.join(F.broadcast(winners.filter(hot).select("host", "path")), "host", "left")
    return marked.filter("path IS NOT NULL").unionByName(marked.filter("path IS NULL").drop("path").join(winners.filter(~hot).select("host", "path"), "host", "left"))


def extract(pages: DataFrame, *, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST, hot_pages: int = HOT_PAGES) -> DataFrame:
    """(page_id, url, path, text, n_chars) of every page; ``path`` is the winning path of its host.

    Null and empty html give an empty text; a page without a host has no vote and a null path;
    repeated rows vote as often as they occur; other columns, whatever their names, are left out.
    Character references are decoded, white space inside a block becomes one space, blocks stand
    in page order, one a line. An empty table gives no rows.
    """
    winners = scratch(winning_paths(pages, url_col=url_col, html_col=html_col), "paths")
    source = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    given = _with_paths(source, winners, most_broadcast, hot_pages).select("page_id", "url", "html", "path")
    ddl = f"page_id {type_of(given, 'page_id')}, url {type_of(given, 'url')}, path string, text string, n_chars long"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            texts = [Reader(t).text(p) for t, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield rows_out(schema, [batch.column("page_id"), batch.column("url"), batch.column("path"), texts, [len(t) for t in texts]])

    return given.mapInArrow(run, ddl)
