"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing, threshold clustering.

``html.parser`` events cut the page into lines: a line ends where a block element starts or ends. Each line has its text
length, the number of tags met in it, the container it stands in and the innermost *aside* it stands in: an element that by its
name, role or class says that it is no part of an article. Text of elements that show none (scripts, styles, head, form controls) is
never read.

The ratio of text to tags of the lines is smoothed with a Gaussian kernel; lines above the threshold (a share of the ratios' standard
deviation) are the content cluster, and their lengths are the mass of their containers. The mass decides what an aside means: one
that holds an article, or that holds most of the mass of a page without an article elsewhere, is a wrapper and stays, all others
go with all their lines. So does a header, but for one in an article, or one around a title that stands beside the text instead
of around the page. What a class says is taken from whole words, and only if all its words name such a part (``related-posts``,
``cookie-notice``); ``no-sidebar``, ``content-with-sidebar`` or ``related-work`` say nothing.

The content region is made of the outermost articles that hold content lines and at least ``ARTICLE_SHARE`` of the mass of the
largest; else of the main element that holds most; else it is the innermost container with nearly all the mass. Every line of
the region that is in no aside is returned, however short.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by two
line feeds; empty blocks vanish. Null or empty html, and html without text, gives the empty text. Broken html never fails:
unclosed and stray tags are tolerated. Very long and deeply nested pages cost time and memory in proportion to their length. Of equal
containers the innermost counts. Repeated rows and null ids stay; extra columns, also such as are named text or n_chars, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td template "
    "textarea tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article main section div td body form".split())
#: Elements whose text is never read.
SILENT = frozenset(
    "script style noscript template head title button select option textarea svg math iframe object canvas audio video datalist map".split()
)
#: Elements that are asides by name.
ASIDE = frozenset("nav footer aside form menu dialog label fieldset search header".split())
ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
ASIDE_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist "
    "respond replies disqus pagination pager toolbar widget widgets skip".split()
)
#: Words that say nothing about a part, beside one of the above.
FILLER = frozenset(
    "area article articles bar block body bottom box buttons card center column container content feed footer form global google group "
    "header holder icons inner item items left link links list main message outer panel placeholder policy post posts primary reader right "
    "row secondary section site slot small stories text thread top unit user wrap wrapper".split()
)
READERS = frozenset("comment comments commentlist respond replies disqus".split())
CLOSES_P = BLOCK - {"option"}
SIGMA = 1.0
RATIO_SHARE = 0.5
ARTICLE_SHARE = 0.2
WORD = re.compile(r"[a-z]+")


def _says_aside(name: str) -> frozenset[str]:
    """The words of a class or id that make it an aside; none if other words stand beside them."""
    for token in name.lower().split():
        found = frozenset(WORD.findall(token))
        if found & ASIDE_WORD and found <= ASIDE_WORD | FILLER:
            return found & ASIDE_WORD
    return frozenset()


class Lines(HTMLParser):
    """Cuts a page into lines: text, tags, container and aside of each. Containers and asides are numbered as they open, 0 being the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags_of: list[int] = []
        self.container_of: list[int] = []
        self.aside_of: list[int] = []
        self.kinds, self.parents, self.in_aside = ["root"], [0], [0]  # of containers
        #: Of asides: the aside around, whether readers' comments, whether a header that may hold a title, its container.
        self.around, self.readers, self.header, self.aside_at, self.titled = [0], [False], [False], [0], [False]
        self.stack: list[tuple[str, int, int]] = []  # open elements: name, container, aside
        self.open: Counter[str] = Counter()
        self.silent_at = -1  # depth of the outermost element whose text isn't read
        self.buffer: list[str] = []
        self.tags = 0

    def _now(self) -> tuple[int, int]:
        return self.stack[-1][1:] if self.stack else (0, 0)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                container, aside = self._now()
                self.texts.append(text)
                self.tags_of.append(self.tags)
                self.container_of.append(container)
                self.aside_of.append(aside)
                self.tags = 0
            self.buffer = []

    def _pop_to(self, depth: int) -> None:
        for name, _, _ in self.stack[depth:]:
            self.open[name] -= 1
        del self.stack[depth:]
        if self.silent_at >= depth:
            self.silent_at = -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent_at < 0:
            self.tags += 1
        if tag in BLOCK:
            if self.silent_at < 0:
                self.flush()
            if tag in CLOSES_P:
                self._close_implied("p")
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                self._close_implied(tag)
            if tag == "body":
                self._close_implied("head")
        elif tag == "br" and self.silent_at < 0:
            self.buffer.append(" ")
        if tag in VOID:
            return
        container, aside = self._now()
        if self.silent_at < 0:
            if tag in SILENT:
                self.silent_at = len(self.stack)
            else:
                if tag == "h1" and aside and self.header[aside]:
                    self.titled[aside] = True
                elif tag == "nav" and aside and self.header[aside]:
                    self.header[aside] = False
                kind = self._aside(tag, attrs)
                if kind is not None:
                    self.around.append(aside)
                    self.readers.append(bool(kind & READERS) or self.readers[aside])
                    self.header.append(tag == "header" and bool(self.stack) and self.stack[-1][0] not in ("html", "body"))
                    self.titled.append(False)
                    self.aside_at.append(container)
                    aside = len(self.around) - 1
                if tag in CONTAINER:
                    self.kinds.append(tag)
                    self.parents.append(container)
                    self.in_aside.append(aside)
                    container = len(self.kinds) - 1
        self.stack.append((tag, container, aside))
        self.open[tag] += 1

    def _aside(self, tag: str, attrs: list) -> frozenset[str] | None:
        """Words that make the element an aside (none, if its name does), or None."""
        if tag == "header":
            return None if self.open["article"] or self.open["main"] else frozenset()
        if tag in ("html", "body", "main"):
            return None
        own: frozenset[str] | None = frozenset() if tag in ASIDE else None
        for name, value in attrs:
            if name in ("class", "id"):
                found = _says_aside(value or "")
                if tag == "article":
                    found &= READERS
                if found:
                    own = (own or frozenset()) | found
            elif tag != "article" and (
                name == "role" and (value or "").lower() in ASIDE_ROLE or name == "hidden" or name == "aria-hidden" and value == "true"
            ):
                own = own or frozenset()
        return own

    def _close_implied(self, tag: str) -> None:
        """Closes an open ``tag`` of the innermost container or list."""
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[depth][0]
            if open_tag == tag:
                self._pop_to(depth)
                return
            if open_tag in BLOCK or open_tag in SILENT:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent_at < 0:
            self.tags += 1
            if tag in BLOCK:
                self.flush()
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._pop_to(depth)
                return
            if tag not in BLOCK and self.stack[depth][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if self.silent_at < 0:
            self.buffer.append(data)

    def finish(self) -> None:
        self.close()
        if self.silent_at < 0:
            self.flush()


def content_lines(lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines are content: smoothed text-to-tag ratio above the threshold."""
    ratio = lengths / np.maximum(tags, 1)
    if len(ratio) < 3:
        return np.ones(len(ratio), bool)
    reach = min(3, len(ratio) - 1)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
    return smooth >= RATIO_SHARE * ratio.std()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    try:
        page.feed(html)
        page.finish()
    except AssertionError:  # declarations the parser gives up on
        page.finish()
    if not page.texts:
        return ""
    lengths = np.fromiter(map(len, page.texts), np.float64, len(page.texts))
    chosen = content_lines(lengths, np.array(page.tags_of, np.float64))
    weight = np.where(chosen, lengths, 0.0) if chosen.any() else lengths
    kept = _kept(page, weight)
    inside = np.array(kept)[page.aside_of]
    if not inside.any():
        return ""
    weight = np.where(inside, weight, 0.0) if (weight * inside).any() else lengths * inside
    mass = _mass(page.parents, page.container_of, weight)
    region = _region(page, mass, kept)
    taken = np.zeros(len(page.kinds), bool)
    for c, parent in enumerate(page.parents):  # parents come before their children
        taken[c] = c in region or c > 0 and taken[parent]
    return "\n\n".join(t for t, c, ok in zip(page.texts, page.container_of, inside.tolist(), strict=True) if ok and taken[c])


def _mass(parents: list[int], at: list[int], weight: np.ndarray) -> np.ndarray:
    """Weight of the lines in each container, those of its children included."""
    mass = np.bincount(at, weights=weight, minlength=len(parents))
    for c in range(len(parents) - 1, 0, -1):
        mass[parents[c]] += mass[c]
    return mass


def _kept(page: Lines, weight: np.ndarray) -> list[bool]:
    """By aside: whether its lines stay, as it is but a wrapper (and so are the asides around it)."""
    n = len(page.around)
    mass = np.bincount(page.aside_of, weights=weight, minlength=n)
    holds, beside = np.zeros(n, bool), False
    for kind, aside in zip(page.kinds, page.in_aside, strict=True):
        if kind in ("article", "main") and not page.readers[aside]:
            holds[aside] = True
            beside |= aside == 0
    total = mass.sum()
    for a in range(n - 1, 0, -1):
        mass[page.around[a]] += mass[a]
        holds[page.around[a]] |= holds[a] and not page.readers[a]
    kept = [True]
    for a in range(1, n):
        wraps = holds[a] or not holds.any() and not page.readers[a] and mass[a] > 0.5 * total
        title = page.header[a] and page.titled[a] and page.kinds[page.aside_at[a]] not in ("root", "body")
        kept.append(kept[page.around[a]] and bool(wraps or title))
    return kept


def _region(page: Lines, mass: np.ndarray, kept: list[bool]) -> set[int]:
    inside = [kept[a] for a in page.in_aside]
    in_article = [False]
    for c in range(1, len(page.kinds)):
        in_article.append(in_article[page.parents[c]] or page.kinds[page.parents[c]] == "article" and inside[page.parents[c]])
    articles = {c for c, kind in enumerate(page.kinds) if kind == "article" and inside[c] and not in_article[c] and mass[c] > 0}
    if articles:
        best = max(mass[c] for c in articles)
        return {c for c in articles if mass[c] >= ARTICLE_SHARE * best}
    mains = [c for c, kind in enumerate(page.kinds) if kind == "main" and inside[c] and mass[c] >= 0.5 * mass[0]]
    if mains:
        return {max(mains, key=lambda c: mass[c])}
    return {max((c for c in range(1, len(page.kinds)) if inside[c] and mass[c] >= 0.95 * mass[0]), default=0)}


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("h")
    )
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
