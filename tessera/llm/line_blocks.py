"""Main text of a web page by line-block distribution.

The markup is stripped into lines, one for each block element, and an empty
line for each boundary of a container. The text lengths of the lines, without
link text and without furniture, are summed over a sliding window. Where the
sums leave zero and pass a threshold is a surge, where they fall back to zero a
dive. All stretches between a surge and its dive are body. Structure then only
places the boundaries: the body is widened to the articles (or the main
element) that its stretches lie in, or else to the innermost container around
all of them, so that short first and last paragraphs, which no sum can tell
from furniture, stay. Without either, what lies between the first surge and the
last dive is kept. Runs of nothing but links outside an article have sums of
zero and go.

The markup is read in one pass that never looks back, in time linear in the
page whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.sources.columns import Carried
from tessera.sources.shared import arrow_batches, stage

WINDOW = 3
#: A stretch is body if some window of it holds so many characters, or half of what the fullest window of the page holds.
SURGE = 80
BATCH_ROWS = 1000

# Names of HTML elements and attributes, and common class names.
#: Elements whose content is no markup; only the first two also run to the end of a page that doesn't close them.
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
#: Elements whose content is no text of an article.
FURNITURE = {
    "nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "head", "noscript", "template", "svg", "math", "object", "select", "canvas", "button", "datalist",
    "audio", "video",
}
#: Of these, elements that hold no block: one that follows ends them.
FLAT = {"select", "button", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Furniture by a part of a class or id, whole or by its beginning.
PARTS = {
    "ad", "ads", "adv", "banner", "consent", "copyright", "discussion", "gdpr", "login", "masthead", "modal", "notice", "notices", "notification", "pager",
    "recommended", "related", "replies", "respond", "search", "share", "sharing", "signup", "skip", "toolbar", "topbar",
}
BEGINNINGS = (
    "advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "menu", "nav", "newsletter", "pagination", "popup", "promo", "sidebar", "social", "sponsor",
    "subscri", "widget",
)
CONTENT_PARTS = {"commentary"}
#: Parts by which a class names a state of something that holds more than the thing itself: has-sidebar, comments-open.
STATES = {
    "active", "allowed", "closed", "collapsed", "disabled", "enabled", "fixed", "has", "hidden", "is", "js", "layout", "left", "loaded", "no", "off", "on", "open", "opened", "ready",
    "right", "sticky", "support", "visible", "with", "without",
}
#: A header is furniture outside the article, by class only if it is that of the page.
PAGE_PARTS = {"app", "global", "main", "page", "site", "top", "web"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"article", "aside", "body", "center", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "ul"}
#: Containers that hold an article among other things.
WHOLE = {"html", "body", "article", "main"}
LISTS = {"table", "ul", "ol", "dl"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements of a head; any other one ends it.
OF_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
#: Elements that end an open one of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Attributes without a value.
BARE = {
    "allowfullscreen", "async", "autofocus", "autoplay", "checked", "compact", "controls", "default", "defer", "disabled", "download", "hidden", "inert", "ismap", "itemscope", "loop", "multiple",
    "muted", "nomodule", "noshade", "novalidate", "nowrap", "open", "readonly", "required", "reversed", "selected",
}

NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of the texts, start tags and end tags of a page: ("text", "", text), ("open", name, attributes), ("close", name, "").

    Comments, declarations and the content of RAW elements are left out. A tag ends at the first bracket outside
    quotes that follow an equals sign; a quote that is never closed is a character like any other.
    """
    last = {c: html.rfind(c) for c in ">\"'"}
    missing: set[str] = set()
    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            break
        if start > at:
            yield "text", "", html[at:start]
        m = NAME.match(html, start)
        if m is None:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = size if end < 0 else end + 3
            elif html[start + 1 : start + 2] in ("!", "?", "/"):
                at = size if start > last[">"] else html.index(">", start) + 1
            else:  # a bracket that begins nothing
                yield "text", "", "<"
                at = start + 1
            continue
        if start > last[">"]:
            at = size  # the page ends inside a tag
            break
        end = m.end()
        while True:
            s = STOP.search(html, end)
            if s is None or s[0] == ">":
                break
            quote = s.start()
            opens = html[max(m.end(), quote - 40) : quote].rstrip().endswith("=")
            closing = html.find(s[0], quote + 1) if opens and quote < last[s[0]] else -1
            end = closing + 1 if closing >= 0 else quote + 1
        stop = s.start() if s else html.index(">", m.end())
        name, rest = m[1].lower(), html[m.end() : stop]
        at = stop + 1
        if html[start + 1] == "/":
            yield "close", name, ""
            continue
        words = rest.split()
        if words and "=" not in rest and all(w.isalpha() and w.isascii() and w.lower() not in BARE for w in words):
            yield "text", "", html[start:at]  # less than and greater than around plain words
            continue
        yield "open", name, rest
        if name in CLOSERS and not rest.endswith("/") and name not in missing:
            closer = CLOSERS[name].search(html, at)
            if closer:
                at = html.find(">", closer.end())
                at = size if at < 0 else at + 1
                yield "close", name, ""
            elif name in ("script", "style"):
                at = size
            else:
                missing.add(name)
    if at < size:
        yield "text", "", html[at:]


def class_parts(value: str) -> set[str]:
    """Lower-cased parts of the names in a class or id that name a thing, not a state."""
    out: set[str] = set()
    for name in value.split():
        parts = {p.lower() for p in PART.findall(name)}
        if not parts & STATES:
            out |= parts
    return out


def is_furniture(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element is furniture by itself: by its name, role or class, or because it is not shown."""
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not rest or name in ("html", "body"):
        return False
    found = {}
    for m in ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in found.get("style", "").lower().replace(" ", ""):
        return True
    parts = class_parts(f"{found.get('class', '')} {found.get('id', '')}")
    if name in WHOLE:
        return bool(parts & {"comment", "comments"})
    if parts & PARTS or any(p.startswith(BEGINNINGS) for p in parts - CONTENT_PARTS):
        return True
    return "header" in parts and not in_article and (len(parts) == 1 or bool(parts & PAGE_PARTS))


class Box:
    """A container: the lines it spans, the box around it, and the innermost article or main element it is or lies in."""

    __slots__ = ("name", "parent", "scope", "first", "stop")

    def __init__(self, name: str, parent: Box | None, first: int) -> None:
        self.name, self.parent, self.first, self.stop = name, parent, first, -1
        self.scope = self if name in ("article", "main") else parent.scope if parent else None


class Page:
    """The lines of a page: text, characters outside links, and the box of each; an empty line for each boundary of a box."""

    def __init__(self, html: str) -> None:
        self.lines: list[str] = []
        self.lengths: list[int] = []
        self.boxes: list[Box] = []
        self.pending: list[tuple[str, bool]] = []
        # open elements: name, whether in furniture, whether in a link, box around the content
        root = Box("", None, 0)
        self.stack: list[tuple[str, bool, bool, Box]] = [("", False, False, root)]
        self.places: dict[str, list[int]] = {}
        for kind, name, rest in tokens(html):
            if kind == "text":
                _, furniture, link, _ = self.stack[-1]
                if not furniture:
                    self.pending.append((rest, link))
            elif kind == "open":
                self.open(name, rest)
            else:
                self.close(name)
        self.leave(1)
        self.flush()
        root.stop = len(self.lines)

    def flush(self) -> None:
        if not self.pending:
            return
        text = " ".join(unescape("".join(t for t, _ in self.pending)).split())
        if text:
            linked = any(link for _, link in self.pending)
            plain = " ".join(unescape("".join(t for t, link in self.pending if not link)).split()) if linked else text
            self.add(text, len(plain))
        self.pending = []

    def add(self, text: str, length: int) -> None:
        self.lines.append(text)
        self.lengths.append(length)
        self.boxes.append(self.stack[-1][3])

    def innermost(self, names: set[str]) -> int:
        """Place in the stack of the innermost open element of ``names``, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def leave(self, place: int) -> None:
        """Close the open element at ``place`` and all in it."""
        while len(self.stack) > place:
            name, _, _, box = self.stack[-1]
            if name in BLOCKS:
                self.flush()
            self.stack.pop()
            self.places[name].pop()
            if name in CONTAINERS:
                self.add("", 0)
                box.stop = len(self.lines)

    def open(self, name: str, rest: str) -> None:
        block = name in BLOCKS
        if name not in OF_HEAD and name not in ("head", "html"):
            head = self.innermost({"head"})
            if head:
                self.leave(head)
        if block:
            self.flush()
            flat = self.innermost(FLAT)
            if flat:
                self.leave(flat)
            paragraph = self.innermost({"p"})
            if paragraph > self.innermost(CONTAINERS | {"td", "th", "li", "blockquote"}):
                self.leave(paragraph)
        elif name == "br" and not self.stack[-1][1]:
            self.pending.append((" ", self.stack[-1][2]))
        if name in SIBLINGS:
            sibling = self.innermost(SIBLINGS[name])
            if sibling > self.innermost(LISTS):
                self.leave(sibling)
        if name in VOID or rest.endswith("/") and not block:
            return
        _, furniture, link, box = self.stack[-1]
        own = is_furniture(name, rest, box.scope is not None)
        if name in ("article", "main") and not own:
            furniture = self.innermost(FURNITURE) > 0  # a class on a wrapper says nothing about the article in it
        if name in CONTAINERS:
            self.add("", 0)
            box = Box(name, box, len(self.lines))
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, furniture or own, link or name == "a", box))

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        place = self.innermost({name})
        if place and (name in WHOLE or place > self.innermost({"article", "main", "body"})):
            self.leave(place)


def window_sums(lengths: list[int], window: int = WINDOW) -> list[int]:
    """The sum of each line and those after it in a window."""
    total, sums = sum(lengths[:window]), []
    for i, n in enumerate(lengths):
        sums.append(total)
        total += (lengths[i + window] if i + window < len(lengths) else 0) - n
    return sums


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int, bool]]:
    """(first line, end, whether it surges) of all maximal stretches of sums above zero; none surges on a page without text."""
    sums = window_sums(lengths, window)
    least = min(surge, max(sums, default=0) / 2)
    out, start = [], None
    for i in range(len(sums) + 1):
        if i < len(sums) and sums[i] > 0:
            start = i if start is None else start
        elif start is not None:
            out.append((start, i, max(sums[start:i]) >= least))
            start = None
    return out


def main_text(html: str | None, window: int = WINDOW) -> str:
    """The main text of a page: its blocks joined by newlines; empty for an empty page or one of furniture only."""
    page = Page(html or "")
    runs = stretches(page.lengths, window)
    body = [i for a, b, surges in runs if surges for i in range(a, b) if page.lengths[i]]
    if not body:
        return ""
    articles = {box.scope for i in body if (box := page.boxes[i]).scope is not None and box.scope.name == "article"}
    mains = {box.scope for i in body if (box := page.boxes[i]).scope is not None and box.scope.name == "main" and (not articles or page.lengths[i] >= SURGE)}
    scopes = articles | mains
    inside = sum(page.lengths[i] for i in body if page.boxes[i].scope in scopes)
    if scopes and 2 * inside >= sum(page.lengths[i] for i in body):
        spans = sorted((s.first, s.stop) for s in scopes)
        kept, at = [], 0
        for first, stop in spans:  # scopes nest or lie apart
            kept += [line for line in page.lines[max(first, at) : stop] if line]
            at = max(at, stop)
        return "\n".join(kept)
    first, last = body[0], body[-1]
    box = page.boxes[first]
    while box.parent is not None and (box.stop <= last or box.first > first or box.name in LISTS):
        box = box.parent
    low, high = (box.first, box.stop) if box.name not in ("", "body", "html") else (first, last + 1)
    near = set()
    for a, b, _ in runs:
        near.update(range(a, b))
    return "\n".join(page.lines[i] for i in range(low, high) if page.lines[i] and (page.lengths[i] or i in near))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column(batch.schema.get_field_index("html"))]
        names = [n for n in batch.schema.names if n != "html"]
        columns = [batch.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """All rows of ``pages`` with text and n_chars in place of html; written and reread.

    Pages are independent rows: nothing is shuffled, repeated rows are read
    alike, a long or malformed page takes time linear in its length. A null html
    is an empty page, an empty table stays empty. Columns text and n_chars of the
    input are replaced, all others pass under any name.
    """
    carried = Carried(pages, ["html"], ["text", "n_chars"])
    fields = [T.StructField(f.name, f.dataType, True) for f in carried.df.schema.fields if f.name != "html"]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    with arrow_batches(pages.sparkSession, BATCH_ROWS):
        extracted = stage(carried.df.mapInArrow(_extract, schema), "extracted")
    return carried.back(extracted, "text", "n_chars", without=["html"])
