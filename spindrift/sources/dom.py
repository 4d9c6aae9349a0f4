"""A page as a tree of elements in arrays, and CSS selectors over it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

from spindrift.sources.markup import END, START, VOID, attributes, closes_itself, events

#: Elements that end where the next of the group begins, wherever they were left open: else one would hold all that follows.
_NEXT = {"a": frozenset({"a"}), **{f"h{i}": frozenset(f"h{j}" for j in range(1, 7)) for i in range(1, 7)}, "option": frozenset({"option"})}
#: Elements that end where such a one begins, if nothing inside of them is open.
_IMPLIED = {"p": ("p",), "li": ("li", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Their content is no text of the page.
UNSEEN = frozenset({"script", "style", "template"})
BLANKS = re.compile("[ \t\x0b\f 　]+")


def tidy(text: str) -> str:
    """Lines with runs of blanks folded, trimmed, blank ones dropped."""
    lines = (BLANKS.sub(" ", line).strip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return "\n".join(line for line in lines if line)


class Tree:
    """Elements in page order; number 0 is the page itself.

    Element i holds the elements i + 1 up to end[i] and the texts first[i] up to last[i]; owner is the element right
    around a text. Everything is linear in the page.
    """

    def __init__(self, html: str | None, decode: Callable[[str], str] = unescape):
        self.tag, self.rest, self.parent = [""], [""], [-1]
        self.end, self.first, self.last = [0], [0], [0]
        self.texts: list[str] = []
        self.owner: list[int] = []
        self._attrs: dict[int, dict[str, str]] = {}
        self._decode = decode
        open_now, counts = [0], {}

        def close() -> str:
            i = open_now.pop()
            self.end[i], self.last[i] = len(self.tag), len(self.texts)
            counts[self.tag[i]] -= 1
            return self.tag[i]

        for kind, name, rest in events(html, decode):
            if kind == START:
                group = _NEXT.get(name, ())
                if any(counts.get(g) for g in group):
                    while close() not in group:
                        pass
                for over in _IMPLIED.get(name, ()):
                    if self.tag[open_now[-1]] == over:
                        close()
                self.parent.append(open_now[-1])
                self.tag.append(name)
                self.rest.append(rest)
                self.first.append(len(self.texts))
                self.end.append(len(self.tag))
                self.last.append(len(self.texts))
                if name not in VOID and not closes_itself(rest):
                    open_now.append(len(self.tag) - 1)
                    counts[name] = counts.get(name, 0) + 1
            elif kind == END:
                if counts.get(name):
                    while close() != name:
                        pass
            else:
                self.texts.append(name)
                self.owner.append(open_now[-1])
        while len(open_now) > 1:
            close()
        self.end[0], self.last[0] = len(self.tag), len(self.texts)

    def attrs(self, i: int) -> dict[str, str]:
        if i not in self._attrs:
            self._attrs[i] = attributes(self.rest[i], self._decode) if self.rest[i] else {}
        return self._attrs[i]

    def get(self, i: int, name: str) -> str | None:
        return self.attrs(i).get(name) if self.rest[i] else None

    def classes(self, i: int) -> list[str]:
        return (self.get(i, "class") or "").split()

    def text(self, i: int, between: str = " ", gone: list[bool] | None = None) -> str:
        """The texts inside an element, each trimmed, those without letters left out; none from elements that are gone."""
        parts = (self.texts[k].strip() for k in range(self.first[i], self.last[i]) if self.tag[self.owner[k]] not in UNSEEN and not (gone and gone[self.owner[k]]))
        return between.join(p for p in parts if p)

    def matches(self, i: int, selector: str) -> bool:
        return any(self._fits(i, path) for path in compiled(selector))

    def select(self, selector: str, root: int = 0) -> Iterator[int]:
        """The elements inside `root` that a selector matches, in page order; what a selector names above may lie outside."""
        paths = compiled(selector)
        return (i for i in range(root + 1, self.end[root]) if any(self._fits(i, p) for p in paths))

    def first_of(self, selector: str, root: int = 0) -> int | None:
        return next(self.select(selector, root), None)

    def _fits(self, i: int, path, at: int = 0) -> bool:
        tag, needs, above = path[at]
        if tag and tag != self.tag[i] or needs and not self._has(i, needs):
            return False
        if above is None:
            return True
        i = self.parent[i]
        if above == ">":
            return i > 0 and self._fits(i, path, at + 1)
        while i > 0:
            if self._fits(i, path, at + 1):
                return True
            i = self.parent[i]
        return False

    def _has(self, i: int, needs) -> bool:
        if not self.rest[i]:
            return False
        own = self.attrs(i)
        for name, how, value in needs:
            held = own.get(name)
            if held is None:
                return False
            if how == "~=" and value not in held.split() or how == "=" and held != value:
                return False
            if how in ("*=", "^=", "$=") and not (value and {"*=": value in held, "^=": held.startswith(value), "$=": held.endswith(value)}[how]):
                return False
        return True


_PIECE = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<class>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<how>[*^$~]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""")
_GAP = re.compile(r"\s*([>,])\s*|\s+")


@lru_cache(256)
def compiled(selector: str) -> tuple:
    """Paths of a selector, each from its last element up: (tag, needed attributes, how the next one above is found).

    Tags, classes, ids, attributes with =, ~=, *=, ^= and $=, descendants, children and lists; others are an error.
    """
    paths, path, tag, needs, at = [], [], "", [], 0
    selector = selector.strip()
    while at <= len(selector):
        piece = _PIECE.match(selector, at)
        if piece:
            if piece["tag"]:
                tag = piece["tag"].lower().replace("*", "")
            elif piece["class"]:
                needs.append(("class", "~=", piece["class"]))
            elif piece["id"]:
                needs.append(("id", "=", piece["id"]))
            else:
                value = piece["value"] or ""
                needs.append((piece["name"].lower(), piece["how"] or "", value[1:-1] if value[:1] in ("'", '"') else value))
            at = piece.end()
            continue
        gap = _GAP.match(selector, at)
        if at < len(selector) and not gap or not (tag or needs or selector[at - 1 : at] == "*"):
            raise ValueError(f"cannot read the selector {selector!r} at {at}")
        path.append((tag, tuple(needs)))
        tag, needs = "", []
        how = gap[1] or " " if gap else ","
        at = gap.end() if gap else at + 1
        if how == ",":
            paths.append(tuple((t, n, below) for (t, n), below in _upwards(path)))
            path = []
        else:
            path.append(how)
    return tuple(paths)


def _upwards(path: list) -> Iterator:
    """Compounds from the last to the first, each with the sign between it and the one above."""
    for k in range(len(path) - 1, -1, -2):
        yield path[k], path[k - 1] if k else None
