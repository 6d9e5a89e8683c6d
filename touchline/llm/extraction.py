"""Main text of web pages by the distribution of text over lines.

Markup is read once into lines, one per block element, in page order. Lines inside
elements that are no article text by their kind or by their class, id or role (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments) count as empty,
and so do lines that are mostly links. Over these lengths a window of a few
lines is moved. Where its sum surges over a threshold the text begins, and where it
dives to nothing it ends; both points are moved out to the last line with text. What lies
between is kept. If no window surges, the run of lines with the most text is. An
article or main element that holds most of what is kept bounds it: its other lines
belong to it, lines outside do not.

Rows: null or empty html gives an empty text; unclosed and stray tags are tolerated;
repeated rows give repeated results; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import map_chunks, table

RAW = "script|style|noscript|template|svg|math|textarea|select|iframe|object|canvas|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/A-Za-z][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos "
    "promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup signin login register search sidebar rail menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot colophon copyright legal "
    "disclaimer comment comments commentlist disqus discussion respond reply replies share sharing social related "
    "recommended recommendations trending popular widget widgets skip complementary contentinfo form "
    "paywall tags".split()
)
OWN_HEADER = frozenset("header masthead".split())
MAIN = frozenset(("article", "main"))


@dataclass(frozen=True)
class Settings:
    window: int = 3  # lines
    surge: int = 80  # characters in a window
    link_share: float = 0.6  # a line with more of its characters in links counts as empty


@dataclass
class Line:
    text: str
    length: int
    mains: tuple[int, ...]


@dataclass
class Reader:
    """Turns markup into lines."""

    s: Settings
    lines: list[Line] = field(default_factory=list)
    open_: list[tuple[str, bool, bool]] = field(default_factory=list)  # tag, aside, main
    asides: int = 0
    links: int = 0
    mains: list[int] = field(default_factory=list)
    n_mains: int = 0
    held: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            empty = self.asides > 0 or self.linked > self.s.link_share * len(text)
            self.lines.append(Line(text if not self.asides else "", 0 if empty else len(text), tuple(self.mains)))
        self.held, self.linked = [], 0

    def is_aside(self, tag: str, attrs: str) -> bool:
        words: set[str] = set()
        for _, *values in NAMES.findall(attrs):
            words.update(w.lower() for v in values for w in PART.findall(v))
        if tag in MAIN or tag in ("body", "html"):
            return bool(words & {"comment", "comments", "reply"})
        if self.mains and (tag in OWN_HEADER or words & OWN_HEADER) and not words & (ASIDE_WORDS - OWN_HEADER):
            return False  # the header of the article itself
        return tag in ASIDE or bool(words & ASIDE_WORDS) or bool(HIDDEN.search(attrs))

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID or attrs.rstrip().endswith("/"):
            return
        aside, main = self.is_aside(tag, attrs), tag in MAIN
        if aside and not self.asides:
            self.flush()
        self.open_.append((tag, aside, main))
        self.asides += aside
        self.links += tag == "a"
        if main:
            self.n_mains += 1
            self.mains.append(self.n_mains)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if not any(t == tag for t, _, _ in self.open_):
            return
        # An inline end tag does not close the blocks around it.
        if tag not in BLOCKS:
            for t, _, _ in reversed(self.open_):
                if t == tag:
                    break
                if t in BLOCKS:
                    return
        while self.open_:
            t, aside, main = self.open_[-1]
            if aside:
                self.flush()
            self.open_.pop()
            self.asides -= aside
            self.links -= t == "a"
            if main:
                self.mains.pop()
            if t == tag:
                return

    def read(self, page: str) -> list[Line]:
        for token in TOKEN.finditer(page):
            text = token["text"]
            if text is not None:
                text = html.unescape(text)
                self.held.append(text)
                if self.links:
                    self.linked += len(text.strip())
            elif token["tag"]:
                tag = token["tag"].lower()
                if token["close"]:
                    self.end(tag)
                else:
                    self.start(tag, token["attrs"] or "")
        self.flush()
        return self.lines


def runs_of_text(lengths: list[int], s: Settings) -> list[tuple[int, int, bool]]:
    """Ranges between a dive and the next, and whether a window surges in them."""
    n, k = len(lengths), s.window
    runs, start, last = [], None, None
    for i, length in enumerate(lengths):
        if not length:
            continue
        if start is not None and i - last > k:  # a whole window in between is empty: a dive
            runs.append((start, last + 1))
            start = None
        start, last = i if start is None else start, i
    if start is not None:
        runs.append((start, last + 1))
    sums = [sum(lengths[i : i + k]) for i in range(n)]
    return [(a, b, max(sums[a:b]) > s.surge) for a, b in runs]


def main_text(page: str | None, s: Settings | None = None) -> str:
    s = s or Settings()
    lines = Reader(s).read(page or "")
    lengths = [line.length for line in lines]
    runs = runs_of_text(lengths, s)
    if not runs:
        return ""
    kept = [(a, b) for a, b, surges in runs if surges] or [
        max(((a, b) for a, b, _ in runs), key=lambda r: (sum(lengths[r[0] : r[1]]), -r[0]))
    ]
    chosen = {i for a, b in kept for i in range(a, b)}
    inside: dict[int, int] = {}
    for i in chosen:
        for m in lines[i].mains[:1]:
            inside[m] = inside.get(m, 0) + lengths[i]
    total = sum(lengths[i] for i in chosen)
    holds = {m for m, n in inside.items() if 2 * sum(inside.values()) >= total and 4 * n >= max(inside.values())}
    if holds:
        chosen = {i for i, line in enumerate(lines) if holds & set(line.mains[:1])}
    return "\n\n".join(lines[i].text for i in sorted(chosen) if lines[i].text)


def extract(pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    s = settings or Settings()
    rows = pages.select(
        F.struct(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")).alias("key"),
        pages["html"].alias("html"),
    )
    make = lambda: lambda keys, htmls: {"key": keys, "text": [main_text(h, s) for h in htmls]}
    out = map_chunks(rows, make, "key struct<page_id: bigint, url: string>, text string")
    return out.select("key.page_id", "key.url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
