"""Main text of web pages with a suffix array over each host's pages.

Every page becomes a stream of blocks of words. Blocks have a zone: main (inside article or main, not inside a
menu, header, footer, sidebar, notice, advert, form or comments), shell (any other place of a page that marks
its main part, and those containers everywhere) or open (the rest of a page without such a mark).

The streams of a host's pages are one text. Its suffixes begin at every word and are put into groups with equal
beginnings of ``least`` words, which a sorted suffix array would show side by side. A group with several distinct
pages is a repeated substring, and a repeated run of any length is the union of the beginnings inside it, so runs
are covered to their last word. Where a beginning stands outside main on most of its pages, it is boilerplate, and
the words of open blocks that it covers go; what is left are the unique runs. A covered stretch of fewer than
``least`` words stays unless it is its whole block, for blocks of unique text often begin alike.

Blocks in main stay whatever repeats: articles that a host shows under several addresses, passages that articles
share and sentences that adverts quote from them repeat too. So on a page that marks its article the markup decides.
Suffixes are taken only of hosts with open blocks, since no others can lose words by them.

Groups are formed by hash aggregation on (host, beginning), which combines before the shuffle, so a host with a
third of all pages or a notice on all of them is no hot spot. Shuffled are hashes, not texts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import SPACE, map_batches, prefix_hash, runs, span_hashes, stored

LEAST = 8
PAGES = 3
BROADCAST_PAGES = 200_000
BROADCAST_HOSTS = 1_000_000
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

MAIN, OPEN, SHELL = 0, 1, 2

STOP = re.compile("[>\"']")
OPENS = re.compile("/?[a-zA-Z]")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
HUMP = re.compile(r"([a-z0-9])([A-Z])")
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
PART = re.compile(r"[a-z0-9]+")
KEPT, NAMED_OUT, OUT = 0, 1, 2

CODE = {"script", "style"}
"""Without an end tag these take the rest of the page; other raw elements without one are empty."""
RAW = CODE | {"noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "title", "select", "audio", "video", "noembed", "noframes", "xmp"}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = {"hr"}
NEVER = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "head", "search", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = set(
    "ad ads adbox adslot adsbygoogle advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar aside footer cookie cookies cookiebar cookiebanner consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist disqus reply replies respond share sharing social related recommended pagination "
    "pager toolbar skip widget".split()
)
PAGE_HEADER = {"header", "masthead", "topbar"}
NEUTRAL = {"site", "page", "main", "top", "bottom", "left", "right", "box", "bar", "container", "wrapper", "block", "list", "area", "link", "links", "form", "user", "thread", "article", "content", "google", "section", "slot", "unit", "button", "buttons", "icons", "posts", "item", "items"}
"""Words that may stand beside a name in a compound: site-footer, but not has-sidebar or notice-period."""
TEXTS = set("h1 h2 h3 h4 h5 h6 p pre blockquote li dl dt dd table caption thead tbody tfoot tr td th figure figcaption".split())
"""Within main, ids of these are places to link to."""


@dataclass
class _Open:
    tag: str
    out: bool
    named: bool
    """Out by a class or id."""
    main: bool
    lent: bool
    """Main below a named element."""


def _is(value: str, names: set[str]) -> bool:
    """Whether a white-space separated token of ``value`` is a name, or a compound of names and neutral words."""
    parts = (PART.findall(token) for token in value.split())
    return any(any(p in names for p in own) and all(p in names or p in NEUTRAL for p in own) for own in parts)


def _aside(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element is out: by what it is (OUT), by its class or id (NAMED_OUT) or not (KEPT)."""
    if tag in NEVER or (tag == "header" and not in_main):
        return OUT
    if not attributes or tag in ("html", "body"):
        return KEPT
    kind = KEPT
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), HUMP.sub(r"\1-\2", m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return OUT
        if name == "role" and value in ROLES:
            return OUT
        if name in ("class", "id") and not (name == "id" and in_main and tag in TEXTS):
            if tag in ("article", "main"):
                names = {"comment", "comments", "reply", "ad", "advert", "sponsored"}
            else:
                names = NAMES if in_main else NAMES | PAGE_HEADER
            if _is(value, names):
                kind = NAMED_OUT
    return kind


class _Tags:
    """The tags of a page in order, in time linear in its length.

    A tag ends at the first ``>`` outside quotes. A scan that meets no such end is the same from each quote on that it
    opened, so these are remembered, and later scans that open one of them stop there.
    """

    def __init__(self, source: str):
        self.source, self.dead = source, set()
        self.gap = (0, -1)
        """The last stretch searched, and the stop at its end."""
        self.last = {c: source.rfind(c) for c in "\"'>"}
        self.missing: set[str] = set()

    def _stop(self, at: int) -> int:
        if not self.gap[0] <= at <= self.gap[1]:
            m = STOP.search(self.source, at)
            self.gap = (at, m.start() if m else len(self.source))
        return self.gap[1]

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose inner text begins at ``at``, or -1."""
        opened = []
        while (stop := self._stop(at)) <= self.last[">"]:
            quote = self.source[stop]
            if quote == ">":
                return stop
            if stop in self.dead:
                break
            opened.append(stop)
            if self.last[quote] <= stop:
                break
            at = self.source.index(quote, stop + 1) + 1
        self.dead.update(opened)
        return -1

    def _after(self, at: int, mark: str) -> int:
        found = self.source.find(mark, at)
        return len(self.source) if found < 0 else found + len(mark)

    def __iter__(self):
        """(start, end, closing, name, attributes); comments and declarations have no name, raw elements end with their content."""
        source, at = self.source, 0
        while (start := source.find("<", at)) >= 0:
            at = start + 1
            if source.startswith("<!--", start):
                at = self._after(start + 4, "-->")
                yield start, at, "", "", ""
            elif source.startswith("<![CDATA[", start):
                at = self._after(start + 9, "]]>")
                yield start, at, "", "", ""
            elif source.startswith(("<!", "<?"), start):
                if at <= self.last[">"]:
                    at = self._after(at, ">")
                    yield start, at, "", "", ""
            elif OPENS.match(source, at) and (end := self._end(at)) >= 0:
                name = NAME.match(source, at, end)
                at, tag = end + 1, name[2].lower()
                if tag in RAW and not name[1] and not source.endswith("/", name.end(), end):
                    at = self._raw_end(tag, at)
                yield start, at, name[1], tag, source[name.end() : end]

    def _raw_end(self, tag: str, at: int) -> int:
        """Where the end tag of a raw element begins that opened before ``at``."""
        if tag not in self.missing:
            m = re.compile(rf"</{tag}(?![^\s/>])", re.IGNORECASE).search(self.source, at)
            if m:
                return m.start()
            self.missing.add(tag)
        return len(self.source) if tag in CODE else at


def page_blocks(source: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order: references decoded, white space made one space, no empty ones.

    Classes and ids count by whole tokens. An article or main below an element that is out by its name alone is main,
    unless the page has another that is below none (teasers, comments). Unclosed and stray tags are tolerated: a closing tag closes its nearest opening one, or nothing. ``br`` is
    white space. Null counts as empty.
    """
    source = source or ""
    stack: list[_Open] = []
    opened = Counter()
    found: list[tuple[bool, bool, bool, str]] = []
    text: list[str] = []
    nothing = _Open("", False, False, False, False)
    at = 0

    def close_block() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                top = stack[-1] if stack else nothing
                found.append((top.out or top.named, top.main, top.lent, words))

    for start, end, closing, tag, attributes in _Tags(source):
        if start > at:
            text.append(html.unescape(source[at:start]))
        at = end
        if not tag:
            continue
        if tag in RAW:
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            close_block()
            if closing:
                while opened[tag]:
                    last = stack.pop().tag
                    opened[last] -= 1
                    if last == tag:
                        break
            elif tag not in VOID:
                while stack and (stack[-1].tag == "p" or tag == "body" and stack[-1].tag == "head" or tag == "li" and stack[-1].tag == "li"):
                    opened[stack.pop().tag] -= 1
                above = stack[-1] if stack else nothing
                kind, begins = _aside(tag, attributes, above.main), tag in ("article", "main") or 'role="main"' in attributes
                lent = above.lent or begins and above.named and not above.main
                named = kind == NAMED_OUT or above.named and not (begins and not above.main)
                opened[tag] += 1
                stack.append(_Open(tag, above.out or kind == OUT, named, above.main or begins, lent))
    if at < len(source):
        rest = source[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that never ends
        text.append(html.unescape(rest[: cut.start()] if cut else rest))
    close_block()
    marked = any(main and not out for out, main, _, _ in found)
    free = any(main and not out and not lent for out, main, lent, _ in found)
    found = [(out or lent and free, main, words) for out, main, lent, words in found]
    return [(SHELL if out or marked and not main else MAIN if main else OPEN, words) for out, main, words in found]


def beginnings(blocks: list[tuple[int, str]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``least`` words from each word of the page on, while so many follow, and the zone of that word."""
    data = np.frombuffer(" ".join(words for _, words in blocks).encode("utf-8", "replace"), np.uint8)
    starts, ends = runs(~SPACE[data])
    zone = np.repeat(np.array([z for z, _ in blocks], np.int64), [words.count(" ") + 1 for _, words in blocks])
    most = max(0, len(starts) - least + 1)
    return span_hashes(prefix_hash(data), starts[:most], ends[least - 1 :][:most]), zone[:most]


def without_runs(blocks: list[tuple[int, str]], at: list[int], least: int) -> list[str]:
    """Main and open blocks without the open words that lie in the ``least`` words from a place in ``at`` on."""
    words = [text.split(" ") for _, text in blocks]
    covered = np.zeros(sum(map(len, words)) + least, bool)
    for a in at:
        covered[a : a + least] = True
    texts, first = [], 0
    for (zone, _), own in zip(blocks, words, strict=True):
        here, first = covered[first : first + len(own)], first + len(own)
        if zone == OPEN:
            gone = {i for a, b in zip(*runs(here), strict=True) if b - a >= min(least, len(own)) for i in range(a, b)}
            own = [w for i, w in enumerate(own) if i not in gone]
        if zone <= OPEN and own:
            texts.append(" ".join(own))
    return texts


def _open_hosts(pages: DataFrame) -> DataFrame:
    """(host) of the pages with open blocks."""

    def run(batches):
        for batch in batches:
            is_open = [any(zone == OPEN for zone, _ in page_blocks(source)) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host").filter(pa.array(is_open, pa.bool_()))], names=["host"])

    return map_batches(pages.select("host", "html"), run, "host long").distinct()


def _suffixes(pages: DataFrame, least: int) -> DataFrame:
    """(host, page, start, at, zone): hash of the beginning of each suffix, the place of its first word, that word's zone."""

    def run(batches):
        for batch in batches:
            for host, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                start, zone = beginnings(page_blocks(source), least)
                both = [pa.array(np.full(len(start), x, np.int64)) for x in (host, page)]
                place = pa.array(np.arange(len(start), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*both, pa.array(start.view(np.int64)), place, pa.array(zone.astype(np.int32))], names=["host", "page", "start", "at", "zone"])

    return map_batches(pages.select("host", "page", "html"), run, "host long, page long, start long, at int, zone int")


def main_texts(pages: DataFrame, least: int = LEAST, at_least_pages: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html, anything else).

    ``text`` joins what no boilerplate covers of the page's main and open blocks by line feeds; it is empty where
    there is nothing. Repeated rows count as one page of their host, pages without a host are of the host ''.
    """
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    hosts = stored(_open_hosts(keyed), "open-hosts")
    small = hosts.count() <= BROADCAST_HOSTS
    rows = stored(_suffixes(keyed.join(F.broadcast(hosts) if small else hosts, "host", "left_semi"), least), "suffixes")
    groups = rows.groupBy("host", "start", "page").agg(F.max("zone").alias("zone")).groupBy("host", "start")
    repeated = groups.agg(F.count("*").alias("pages"), F.count_if(F.col("zone") >= OPEN).alias("outside"))
    repeated = repeated.where(f"pages >= {int(at_least_pages)} and 2 * outside > pages")
    covered = rows.where(F.col("zone") == OPEN).join(stored(repeated.select("host", "start"), "boilerplate"), ["host", "start"])
    covered = stored(covered.groupBy("page").agg(F.sort_array(F.collect_set("at")).alias("covered")), "covered-words")
    if covered.count() <= BROADCAST_PAGES:
        covered = F.broadcast(covered)
    with_cover = keyed.join(covered, "page", "left").select("page_id", "url", "html", "covered")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = []
            for source, gone in zip(batch.column("html").to_pylist(), batch.column("covered").to_pylist(), strict=True):
                texts.append("\n".join(without_runs(page_blocks(source), gone or [], least)))
            size = pa.array(np.array([len(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), size], names=schema.names)

    return map_batches(with_cover, run, schema)
