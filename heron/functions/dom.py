"""A page as flat arrays: one parse, then every question about it is a scan over them.

Elements are numbered in document order, so an element's descendants are the numbers up to its end,
and what comes before or after it is plain comparison. Pieces of text are kept beside, each with the
element that holds it. The parser is the standard library's; broken markup is mended like this: void
tags hold nothing, an end tag closes up to its nearest open start tag or is ignored, and some start
tags close what they can't stand in (a list item the one before, a block the open paragraph).
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose text is no text of the page.
SILENT = {"script", "style", "template"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: A start tag closes an open element of the first set, unless one of the second lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CLOSES |= {tag: ({"p"}, {"td", "th", "li", "div", "section", "article", "main", "body", "button"}) for tag in BLOCKS}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLANK = re.compile(r"\s+")


def squeezed(text: str) -> str:
    return BLANK.sub(" ", text).strip()


class Dom(HTMLParser):
    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = [""]
        self.attrs: list[dict[str, str]] = [{}]
        self.parent: list[int] = [-1]
        self.end: list[int] = [0]
        self.pieces: list[str] = []
        self.holder: list[int] = []
        self.begins: list[int] = [0]
        self.ends: list[int] = [0]
        self.open = [0]
        self.feed(html or "")
        self.close()
        while self.open:
            self._shut()
        self.body = next(self.all(("body",)), 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes, stops = CLOSES.get(tag, ((), ()))
        for place in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[place]]
            if name in closes:
                while len(self.open) > place:
                    self._shut()
                break
            if name in stops:
                break
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.parent.append(self.open[-1])
        self.end.append(0)
        self.begins.append(len(self.pieces))
        self.ends.append(0)
        self.open.append(len(self.tag) - 1)
        if tag in VOID:
            self._shut()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SILENT and self.open and self.tag[self.open[-1]] == tag:
            self._shut()

    def handle_endtag(self, tag: str) -> None:
        if any(self.tag[i] == tag for i in self.open):
            while True:
                done = self.tag[self.open[-1]] == tag
                self._shut()
                if done:
                    return

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        self.holder.append(self.open[-1])

    def _shut(self) -> None:
        i = self.open.pop()
        self.end[i], self.ends[i] = len(self.tag), len(self.pieces)

    def all(self, tags: Collection[str] | None = None, within: int = 0) -> Iterator[int]:
        """Descendants of an element with one of the tags, in document order."""
        return (i for i in range(within + 1, self.end[within]) if tags is None or self.tag[i] in tags)

    def first(self, tags: Collection[str] | None = None, within: int = 0, **matches: re.Pattern) -> int | None:
        """First descendant with one of the tags and with attributes that match the patterns."""
        return next((i for i in self.all(tags, within) if all(self.has(i, k.rstrip("_"), p) for k, p in matches.items())), None)

    def has(self, i: int, name: str, pattern: re.Pattern) -> bool:
        value = self.attrs[i].get(name)
        return value is not None and pattern.search(value) is not None

    def up(self, i: int) -> Iterator[int]:
        """Ancestors, the nearest first."""
        while (i := self.parent[i]) > 0:
            yield i

    def inside(self, i: int, tags: Collection[str]) -> int | None:
        """Nearest ancestor with one of the tags."""
        return next((a for a in self.up(i) if self.tag[a] in tags), None)

    def children(self, i: int) -> Iterator[int]:
        at = i + 1
        while at < self.end[i]:
            yield at
            at = self.end[at]

    def before(self, i: int, tags: Collection[str]) -> Iterator[int]:
        """Elements that begin before i, the nearest first."""
        return (k for k in range(i - 1, 0, -1) if self.tag[k] in tags)

    def after(self, i: int, tags: Collection[str]) -> Iterator[int]:
        return (k for k in range(i + 1, len(self.tag)) if self.tag[k] in tags)

    def strings(self, i: int, without: Collection[str] = (), cut: Collection[int] = ()) -> Iterator[str]:
        """Pieces of text in an element, but for silent elements in it and those named by tag or number."""
        silent = SILENT | set(without)
        hidden = sorted([k for k in self.all(silent, i)] + list(cut))
        at = self.begins[i]
        for k in hidden:
            yield from self.pieces[at : max(at, self.begins[k])]
            at = max(at, self.ends[k])
        yield from self.pieces[at : self.ends[i]]

    def text(self, i: int) -> str:
        return "".join(self.strings(i))

    def clean(self, i: int) -> str:
        return squeezed(self.text(i))

    def joined(self, i: int, by: str = "", without: Collection[str] = (), cut: Collection[int] = ()) -> str:
        """Stripped pieces of text, joined."""
        return by.join(s for piece in self.strings(i, without, cut) if (s := piece.strip()))

    def holders(self, pattern: re.Pattern) -> Iterator[int]:
        """Elements that directly hold a piece of text that matches."""
        return (i for i, piece in zip(self.holder, self.pieces, strict=True) if pattern.search(piece) and self.tag[i] not in SILENT)

    def previous_sibling(self, i: int) -> int | None:
        found = None
        for k in self.children(max(self.parent[i], 0)):
            if k == i:
                return found
            found = k
        return None

    def heading_near(self, i: int) -> str | None:
        """The first heading of the nearest container that has one, else the nearest heading before."""
        for a in self.up(i):
            if self.tag[a] in ("article", "section", "div", "main") and (h := self.first(HEADINGS, a)) is not None:
                return self.joined(h)
        return next((t for h in self.before(i, HEADINGS) if (t := self.joined(h))), None)

    def linked_share(self, i: int, size: int) -> float:
        """Characters of links to those of the element, size."""
        return sum(len(self.joined(a, " ")) for a in self.all(("a",), i)) / (size + 1)
