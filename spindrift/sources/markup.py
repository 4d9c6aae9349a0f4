"""Marks and texts of HTML in one walk: no tree, no state but the place in the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

#: Fixed: elements without an end tag, elements whose content is not mark-up, and those among them whose content has character references.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
ESCAPED = frozenset({"textarea", "title"})

START, END, TEXT = 0, 1, 2
#: A start tag; quotes hold back a `>` only behind an equals sign. The possessive repeat never goes back.
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>`]++))?""")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}


_OWN_SLASH = re.compile(r"=\s*+[^\s\"'>]*+$")


def closes_itself(rest: str) -> bool:
    """Whether a start tag ends with a slash that is not part of an attribute."""
    return rest.endswith("/") and not _OWN_SLASH.search(rest[-200:])


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def ended(text: str) -> str:
    """Decodes the character references that a semicolon ends. `unescape` also takes some for whole that were cut short."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text) if "&" in text else text


def attributes(text: str, decode: Callable[[str], str] = unescape) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; the first of a name counts, one without a value is empty."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), decode(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value) if value else "")
    return out


def events(html: str | None, decode: Callable[[str], str] = unescape) -> Iterator[tuple[int, str, str]]:
    """(START, tag, text of the attributes), (END, tag, '') and (TEXT, text, '') in page order.

    Tags are lower-cased, character references in texts are decoded by `decode`. Comments, declarations and what follows a mark that
    is never closed go; content of script, style and the like comes as one text between its tags.
    """
    html, at = html or "", 0
    while at < len(html):
        mark = html.find("<", at)
        if mark < 0:
            yield TEXT, decode(html[at:]), ""
            return
        if mark > at:
            yield TEXT, decode(html[at:mark]), ""
        follows = html[mark + 1 : mark + 2]
        if follows.isascii() and follows.isalpha():
            found = _TAG.match(html, mark) or _LOOSE.match(html, mark)
            if not found:
                return
            tag, rest, at = found[1].lower(), found[2], found.end()
            yield START, tag, rest
            if tag in RAW and not closes_itself(rest):
                close = _CLOSE[tag].search(html, at)
                end = close.start() if close else len(html)
                if end > at:
                    yield TEXT, decode(html[at:end]) if tag in ESCAPED else html[at:end], ""
                at = end
        elif html.startswith("<!--", mark):
            end = html.find("-->", mark + 2 if html.startswith("<!-->", mark) else mark + 4)
            at = len(html) if end < 0 else end + 3
        elif follows in ("!", "?") or follows == "/":
            end = html.find(">", mark)
            if end < 0:
                return
            name = re.match(r"[a-zA-Z][^\s/>]*", html[mark + 2 : end]) if follows == "/" else None
            at = end + 1
            if name:
                yield END, name[0].lower(), ""
        else:
            yield TEXT, "<", ""
            at = mark + 1
