"""Pages read as a browser reads them: one pass over the markup, no pattern over the whole page.

`tokens` cuts a page into text, start tags, end tags and raw text. Comments, the bodies of
scripts and styles, quoted `>` and tags cut off at the end of the page are no markup and no
text. Every step moves on or ends the page, so the time follows the page's length whatever
is left open. Links and texts are two folds over the same tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

TEXT, START, END, RAW = range(4)
SPACE = "\t\n\f\r "

# Fixed values of the markup language: elements without an end, elements whose body is no markup, elements inside lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# The contract of page texts: what is left out, and what stands on lines of its own.
LEFT_OUT = frozenset("head script style nav header footer aside noscript template".split())
LEFT_OUT_CLASSES = frozenset(("ad", "ads"))
LINES = frozenset("p div h1 h2 h3 h4 h5 h6 li tr article section".split())

_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*+")
_ATTRIBUTE = re.compile(
    r"""[\t\n\f\r /]*+(?:(?P<end>>)|(?P<name>[^\t\n\f\r />][^\t\n\f\r />=]*+)"""
    r"""(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"(?P<double>[^"]*+)"|'(?P<single>[^']*+)'|(?P<bare>(?!["'])[^\t\n\f\r >]*+)))?)""")
_OPEN_QUOTE = re.compile(r"""[\t\n\f\r ]*+=[\t\n\f\r ]*+["']""")
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;?)")
_BODY_END = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.IGNORECASE) for name in RAW_TEXT | ESCAPABLE}
_BREAKS = re.compile(r"[ \t\r]*+\n\s*+")


def attribute_value(value: str) -> str:
    """References decoded as inside attributes: a name without its semicolon stays if it goes on with `=` or a letter."""
    def decoded(m: re.Match) -> str:
        found = m[0]
        if found.startswith("&#") or found.endswith(";"):
            return unescape(found)
        return found if value[m.end():m.end() + 1] == "=" else html5.get(found[1:], found)

    return _REFERENCE.sub(decoded, value) if "&" in value else value


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from `at` on, the first of a name counting, and where the tag ends; -1 if the page ends first."""
    found: dict[str, str] = {}
    while (m := _ATTRIBUTE.match(page, at)) is not None:
        at = m.end()
        if m["end"]:
            return found, at
        value = next((v for v in (m["double"], m["single"], m["bare"]) if v is not None), None)
        if value is None and _OPEN_QUOTE.match(page, at):
            break
        found.setdefault(m["name"].lower(), attribute_value(value or ""))
    return found, -1


def _after(page: str, mark: str, at: int) -> int:
    found = page.find(mark, at)
    return len(page) if found < 0 else found + len(mark)


def tokens(page: str) -> Iterator[tuple[int, str, dict[str, str] | str]]:
    """(TEXT, "", text), (START, name, attributes), (END, name, {}) and (RAW, name, body), in order."""
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            yield TEXT, "", page[at:]
            return
        if mark > at:
            yield TEXT, "", page[at:mark]
        closing = page.startswith("/", mark + 1)
        name = _NAME.match(page, mark + 1 + closing)
        if name:
            kind = name[0].lower()
            attributes, at = _attributes(page, name.end())
            if at < 0:
                return
            if closing:
                yield END, kind, {}
                continue
            yield START, kind, attributes
            if kind in _BODY_END:
                end = _BODY_END[kind].search(page, at)
                stop = end.start() if end else size
                yield RAW, kind, page[at:stop]
                at = stop
        elif page.startswith("<!--", mark):
            if page.startswith(">", mark + 4) or page.startswith("->", mark + 4):
                at = _after(page, ">", mark + 4)
            else:
                end = _COMMENT_END.search(page, mark + 4)
                at = end.end() if end else size
        elif closing or page.startswith(("!", "?"), mark + 1):
            # `</` before the end of the page is text; all else here is a comment up to the next `>`.
            if mark + 2 >= size and closing:
                yield TEXT, "", page[mark:]
                return
            at = _after(page, ">", mark + 1)
        else:
            yield TEXT, "", "<"
            at = mark + 1


def links(page: str) -> tuple[str | None, list[str]]:
    """The page's first `<base href>`, if any, and the targets of its anchors in order."""
    base, found = None, []
    for kind, name, value in tokens(page):
        if kind == START and name in ("a", "base") and "href" in value:
            target = value["href"].strip(SPACE)
            if name == "a":
                found.append(target)
            elif base is None:
                base = target
    return base, found


def text(page: str) -> str:
    """What a page says, by the contract above: furniture left out, one line per block, references decoded."""
    out: list[str] = []
    held: list[str] = []  # open elements that may be closed from outside; those inside lines are not held
    count: dict[str, int] = {}
    hidden = None  # number of open elements outside the one that is left out

    def close(name: str) -> None:
        nonlocal hidden
        while count.get(name):
            last = held.pop()
            count[last] -= 1
            if hidden is not None and len(held) <= hidden:
                hidden = None
            if last == name:
                return

    for kind, name, value in tokens(page):
        if kind == TEXT or (kind == RAW and name in ESCAPABLE):
            if hidden is None:
                out.append(unescape(value))
        elif kind == START:
            if name == "body":
                close("head")
            if hidden is None and (name in LINES or name == "br"):
                out.append("\n")
            if name in VOID:
                continue
            left_out = name in LEFT_OUT or not LEFT_OUT_CLASSES.isdisjoint(value.get("class", "").lower().split())
            if name in INLINE and not left_out and not (hidden is not None and held[hidden] == name):
                continue
            if left_out and hidden is None:
                hidden = len(held)
            held.append(name)
            count[name] = count.get(name, 0) + 1
        elif kind == END:
            close(name)
            if hidden is None and (name in LINES or name == "br"):
                out.append("\n")
    return _BREAKS.sub("\n", "".join(out).replace("\xa0", " ")).strip(" \t\n\r")
