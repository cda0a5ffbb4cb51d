"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels what it can: blocks in menus, headers, footers,
sidebars, forms, notices, adverts or comments, and blocks mostly of links, are boilerplate; long blocks with the density
of stop words that prose has, and long blocks inside the page's article, are text. Where no block is as dense, as in other
languages, long blocks with ends of sentences and few links are. In the second pass each block left open, short or thin,
inherits the label of its nearest decided neighbour of the same article, a heading that of the next; between two as near,
and without any, the article decides. If articles have most of the long text, nothing outside an article is text.

A form, and a word of class or id that names boilerplate, count for an element that holds boilerplate, not for one that holds
the story: where the longest article, or without articles the most long text, stands inside such an element and more
than all unmarked prose, the marks around it are undone. Words after ``with``, ``has`` or ``no`` are no marks.

Defined cases: a null or empty page has empty text. Unclosed comments and tags end with the page and are dropped; unclosed
elements end with their parents. Character references are decoded once. Blocks are kept whole whatever their number
or length. Repeated rows get the same text. Columns named like an output are replaced; all others are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.llm.common import table

#: A block of so many characters is long enough to be judged alone.
LONG = 70
#: Least share of stop words in prose.
PROSE = 0.2
#: A block with a larger share of characters in links is boilerplate.
LINKS = 0.5

#: Common function words of the languages read: fixed values.
STOP_WORDS = {
    "en": "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you",
    "de": "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "es": "a al como con de del el ella en entre era es esta este fue ha la las le lo los más me no o para pero por que se sin sobre su sus también un una y ya yo",
}

#: Elements whose content is never text.
HIDDEN = frozenset("head script style noscript template svg math iframe object select button textarea canvas audio video title".split())
RAW = frozenset("script style textarea title".split())
#: Elements that stand outside the article.
OUTSIDE = frozenset("nav footer aside menu dialog".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that hold blocks, and are followed until they close.
HOLDERS = HIDDEN | OUTSIDE | ARTICLE | frozenset("form header div section ul ol dl table figure details fieldset".split())
BLOCKS = HOLDERS | frozenset(
    "address blockquote body caption center dd dt figcaption h1 h2 h3 h4 h5 h6 hr html legend li optgroup option p pre summary tbody td tfoot th thead tr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class or id that mark boilerplate.
MARKS = frozenset(
    (
        "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr banner notice notification alert "
        "sidebar widget comment comments commentlist respond reply replies disqus menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
        "share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager "
        "toolbar skip copyright disclaimer"
    ).split()
)
#: Marks of readers' comments, which stay marked beside any story.
REMARKS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Marks of what stands beside a story, which no size makes the story.
BESIDE = frozenset(
    (
        "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr banner notice notification alert "
        "newsletter subscribe subscription related recommended recommendations"
    ).split()
)
#: A mark after one of these words says what the page has or lacks.
ABOUT = frozenset("with without has have no non not hide".split())
#: Beside these words, "header" marks the head of an article.
OWN = frozenset("article content entry post story main".split())

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
PART = re.compile(r"[a-z0-9]+")
WORD = re.compile(r"[^\W\d_]+")
END = re.compile(r"[.!?\u2026][\s\"'\u00bb\u201d\u2019)]|[.!?\u2026]\Z|[\u3002\uff01\uff1f\u0964\u061f]")


def marks(rest: str) -> set[str]:
    """The words of class, id or role that name boilerplate."""
    found: set[str] = set()
    if "=" not in rest:
        return found
    for value in NAMED.findall(rest):
        parts = [PART.findall(name) for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split()]
        words = {w for name in parts for n, w in enumerate(name) if w in MARKS and ABOUT.isdisjoint(name[:n])}
        if words == {"header"} and any(w in OWN for name in parts for w in name):
            continue
        found |= words
    return found


class Block:
    __slots__ = ("pieces", "linked", "bad", "article", "heading", "mark")

    def __init__(self, bad: bool, article: int, heading: bool = False, mark: int = 0):
        self.heading = heading
        self.pieces: list[str] = []
        self.linked = 0
        self.bad = bad
        self.article = article
        self.mark = mark

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Element:
    """An open element: what it is itself, and what holds inside it with all around it."""

    __slots__ = ("name", "hides", "outside", "marked", "opens", "hidden", "bad", "mark", "article")

    def __init__(self, name: str, hides: bool, outside: bool, marked: int, opens: int):
        self.name, self.hides, self.outside, self.marked, self.opens = name, hides, outside, marked, opens

    def inside(self, around: Element | None) -> None:
        self.hidden = self.hides or bool(around and around.hidden)
        self.bad = self.outside or bool(around and around.bad)
        self.mark = self.marked or (around.mark if around else 0)
        self.article = (around.article if around else 0) or self.opens


class Page:
    """The blocks of a page, and the marked elements around them by number; 0 is none."""

    def __init__(self, page: str):
        self.found: list[Block] = []
        self.around = [0]  # the marked element around each
        self.remarks = [False]
        self.beside = [False]
        self.articles = [0]  # the marked element each article stands in, or is
        self._open: list[Element] = []
        self._places: dict[str, list[int]] = {}
        self._links = self._breaks = 0
        self._block = Block(False, 0)
        self._read(page)

    @property
    def _top(self) -> Element | None:
        return self._open[-1] if self._open else None

    def _cut(self, bad: bool = False, heading: bool = False) -> None:
        if self._block.pieces:
            self.found.append(self._block)
        top = self._top
        self._block = Block(bad or bool(top and top.bad), top.article if top else 0, heading, top.mark if top else 0)
        self._breaks = 0

    def _write(self, piece: str) -> None:
        top = self._top
        if not piece or (top and top.hidden):
            return
        if "&" in piece:
            piece = html.unescape(piece)
        self._block.pieces.append(piece)
        if piece.strip():
            self._breaks = 0
            if self._links:
                self._block.linked += len(piece.strip())

    def _push(self, element: Element) -> None:
        element.inside(self._top)
        self._places.setdefault(element.name, []).append(len(self._open))
        self._open.append(element)

    def _pop_to(self, place: int) -> list[Element]:
        """Close the elements from a place on; each costs once."""
        closed = self._open[place:]
        for element in reversed(closed):
            self._places[element.name].pop()
        del self._open[place:]
        return closed

    def _enter(self, name: str, rest: str) -> None:
        top = self._top
        article = bool(top and top.article)
        outside = name in OUTSIDE or (name == "header" and not article)
        words = marks(rest)
        if name == "form":
            words.add(name)
        marked = 0
        if words:
            marked = len(self.around)
            self.around.append(top.mark if top else 0)
            self.remarks.append(bool(words & REMARKS))
            self.beside.append(name not in ARTICLE and bool(words & BESIDE))
        opens = 0
        if name in ARTICLE and not article and not (top and top.bad):
            opens = len(self.articles)
            self.articles.append(marked or (top.mark if top else 0))
        self._push(Element(name, name in HIDDEN, outside, marked, opens))
        self._cut()

    def _body(self) -> None:
        """A body ends a head that was not closed."""
        while self._places.get("head"):
            for element in self._pop_to(self._places["head"][-1])[1:]:
                self._push(element)

    def _read(self, page: str) -> None:
        at = 0
        while True:
            tag = TAG.search(page, at)
            if tag is None:
                break
            self._write(page[at : tag.start()])
            at = tag.end()
            name = (tag["name"] or "").lower()
            if not name:
                continue
            if tag["end"]:
                if name == "a":
                    self._links = 0
                elif name in HOLDERS:
                    if self._places.get(name):
                        self._pop_to(self._places[name][-1])
                        self._links = 0
                    self._cut()
                elif name in BLOCKS:
                    self._cut()
            elif name == "br":
                self._breaks += 1
                self._block.pieces.append(" ")
                if self._breaks > 1:
                    self._cut()
            elif name == "a":
                self._links = 1
            elif name in RAW:
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            elif name in HOLDERS:
                if not (tag["rest"].endswith("/") and name in ("svg", "object", "iframe")):
                    self._enter(name, tag["rest"])
            elif name in BLOCKS:
                if name == "body":
                    self._body()
                self._cut(name not in ("body", "html") and bool(marks(tag["rest"])), name in HEADINGS)
        self._write(page[at:])
        self._cut()

    def undone(self, sizes: list[int], prose: list[bool]) -> set[int]:
        """The marked elements that hold the story: those around the longest article, else around the most long text.

        ``sizes`` are the characters of long text of each block, ``prose`` says which read like sentences.
        """
        free = sum(n for n, p, b in zip(sizes, prose, self.found, strict=True) if not b.mark and not b.bad and (p or b.article))
        plain = sum(len(b.text()) for b in self.found if b.article and not b.mark and not b.bad)
        inside = [0] * len(self.articles)
        under = [0] * len(self.around)
        for n, block in zip(sizes, self.found, strict=True):
            if block.bad:
                continue
            if block.article and block.mark == self.articles[block.article]:
                inside[block.article] += n
            under[block.mark] += n
        article = max(range(len(inside)), key=inside.__getitem__)
        if inside[article]:
            mark, size = self.articles[article], inside[article]
        else:
            mark = max(range(len(under)), key=under.__getitem__)
            size = under[mark]
        chain: set[int] = set()
        if size <= max(free, 4 * plain):
            return chain
        while mark:
            if self.beside[mark] or self.remarks[mark] and free:
                return set()
            chain.add(mark)
            mark = self.around[mark]
        return chain


def blocks(page: str, stops: frozenset[str]) -> list[tuple[str, int, bool, int, bool]]:
    """(text, characters in links, in boilerplate, number of the article or 0, heading) of every block with text."""
    read = Page(page)
    read.found = [b for b in read.found if not "".join(b.pieces).isspace()]
    bodies = [b.text() for b in read.found]
    long = [len(t) if len(t) >= LONG and b.linked <= LINKS * len(t) else 0 for t, b in zip(bodies, read.found, strict=True)]
    undone = read.undone(long, [n > 0 and (density(t, stops) >= PROSE or sentences(t, b.linked)) for n, t, b in zip(long, bodies, read.found, strict=True)])
    bad = [False]  # of marked elements, with those around them
    for mark in range(1, len(read.around)):
        bad.append(mark not in undone or bad[read.around[mark]])
    return [(t, b.linked, b.bad or bad[b.mark], b.article, b.heading) for t, b in zip(bodies, read.found, strict=True) if t]


def density(body: str, stops: frozenset[str]) -> float:
    """The share of stop words."""
    words = WORD.findall(body.lower())
    return sum(w in stops for w in words) / max(1, len(words))


def sentences(body: str, linked: int) -> bool:
    """Whether a block of any language reads like prose: a sentence ends in it, and few of it are links."""
    return END.search(body) is not None and linked <= LINKS * len(body) / 2


def labels(found: list[tuple[str, int, bool, int, bool]], stops: frozenset[str]) -> list[bool]:
    """Whether each block is text."""
    open_ = [not bad and linked <= LINKS * len(body) for body, linked, bad, _, _ in found]
    long = [ok and len(f[0]) >= LONG for ok, f in zip(open_, found, strict=True)]
    share = [density(f[0], stops) if is_long else 0.0 for is_long, f in zip(long, found, strict=True)]
    known = any(s >= PROSE for s in share)
    decided: list[bool | None] = []
    for (body, linked, _, article, _), ok, is_long, s in zip(found, open_, long, share, strict=True):
        if not ok:
            decided.append(False)
        elif not is_long:
            decided.append(None)
        elif article or s >= PROSE:
            decided.append(True)
        elif not known or s >= PROSE / 2:
            decided.append(True if sentences(body, linked) else None)
        else:
            decided.append(None if len(body) < 3 * LONG else False)
    in_articles = sum(len(f[0]) for f, d in zip(found, decided, strict=True) if d and f[3])
    marked_up = in_articles > 0 and 2 * in_articles >= sum(len(f[0]) for f, d in zip(found, decided, strict=True) if d)
    if not any(decided):
        marked_up = any(f[3] and d is None for f, d in zip(found, decided, strict=True))
    if marked_up:
        decided = [d if f[3] or d is False else False for d, f in zip(decided, found, strict=True)]
    elif any(decided):  # an article without long text beside the story is a teaser
        telling = {f[3] for f, d in zip(found, decided, strict=True) if d}
        decided = [False if f[3] and f[3] not in telling else d for d, f in zip(decided, found, strict=True)]
    # in an article menus and adverts decide nothing for their neighbours
    votes = [d is not None and not (a and d is False) for d, (_, _, _, a, _) in zip(decided, found, strict=True)]
    n = len(found)
    before, after = [-1] * n, [n] * n
    last = -1
    for i in range(n):
        before[i] = last if last >= 0 and found[last][3] == found[i][3] else -1
        if votes[i]:
            last = i
    last = n
    for i in range(n - 1, -1, -1):
        after[i] = last if last < n and found[last][3] == found[i][3] else n
        if votes[i]:
            last = i
    final = []
    for i in range(n):
        if decided[i] is not None:
            final.append(bool(decided[i]))
            continue
        a, b = before[i], after[i]
        if a < 0 and b == n:
            final.append(bool(found[i][3]) or not marked_up)
        elif a < 0 or (b < n and found[i][4]) or (b < n and b - i < i - a):
            final.append(bool(decided[b]))
        elif b == n or i - a < b - i:
            final.append(bool(decided[a]))
        else:
            final.append(bool(decided[a]) and bool(decided[b]) or bool(found[i][3]))
    return final


def main_text(page: str | None, stops: frozenset[str]) -> str:
    """The text blocks of a page, in order, one to a line."""
    if not page:
        return ""
    found = blocks(page, stops)
    return "\n".join([b[0] for b, good in zip(found, labels(found, stops), strict=True) if good])


def stop_words() -> frozenset[str]:
    return frozenset(w for words in STOP_WORDS.values() for w in words.split())


def extracted(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with ``text`` (main text, empty if none) and ``n_chars`` in place of ``page``."""
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    fields = [*pages.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = stop_words()
        for batch in batches:
            texts = [main_text(p.as_py(), stops) for p in batch.column("__page")]
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__page"]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*kept, F.col(page).alias("__page")).mapInArrow(work, schema)


def op9_html_text(spark: SparkSession, directory: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, directory, "pages")).select("page_id", "url", "text", "n_chars")
