"""Markup as a stream of texts, start tags and end tags, in time linear in the page.

A tag's end, its attributes and quoted values are found from left to right, and no part is looked at again: a page of unclosed tags
or quotes costs no more than any other. Of a repeated attribute the first counts; what looks like an attribute inside a quoted
value is part of the value. A tag, comment or quote that the page does not close reaches to its end, and such a tag is none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

# Elements whose content is text up to their own end tag; that of the second group has character references.
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())

_SPACE = "[ \t\n\f\r]"
_TAG_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*+")
_BETWEEN = re.compile(r"[ \t\n\f\r/]*+")
_NAME = re.compile(r"=?[^ \t\n\f\r/>=]*+")
_EQUALS = re.compile(rf"{_SPACE}*+={_SPACE}*+")
_BARE = re.compile(r"[^ \t\n\f\r>]*+")
_REFERENCE = re.compile(r"&(?:#[0-9a-fA-FxX]++;?|[a-zA-Z][a-zA-Z0-9]*+;?)=?")
#: From the two hyphens of the beginning on, so that ``<!-->`` and ``<!--->`` end at once.
_COMMENT_END = re.compile(r"--!?>|(?<=<!-)->")
_ENDS = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I) for tag in RAW_TEXT | ESCAPABLE}

#: ``("text", text, None, False)``, ``("start", tag, attributes, self-closing)``, ``("end", tag, None, False)``.
Token = tuple[str, str, dict[str, str] | None, bool]


def text_of(written: str) -> str:
    """Text with its character references decoded; an unknown one loses its semicolon."""
    if "&" not in written:
        return written

    def known(found):
        reference = found[0]
        meant = unescape(reference)
        return meant if meant != reference or not reference.endswith(";") else reference[:-1]

    return _REFERENCE.sub(known, written)


def value_of(written: str) -> str:
    """Attribute value decoded; a reference without semicolon is none before a letter, a digit or an equals sign."""
    if "&" not in written:
        return written

    def known(found):
        reference = found[0]
        if reference.startswith("&#"):
            return unescape(reference)
        return html5.get(reference[1:], reference)

    return _REFERENCE.sub(known, written)


def _attributes(page: str, at: int) -> tuple[dict[str, str] | None, int, bool]:
    """Attributes from ``at`` on, the place after the tag, and whether it closes itself; None if the page ends first."""
    found: dict[str, str] = {}
    size = len(page)
    while True:
        before, at = at, _BETWEEN.match(page, at).end()
        if at >= size:
            return None, size, False
        if page[at] == ">":
            return found, at + 1, at > before and page[at - 1] == "/"
        name = _NAME.match(page, at)
        at, value = name.end(), ""
        equals = _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ('"', "'"):
                end = page.find(quote, at + 1)
                if end < 0:
                    return None, size, False
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), value)


def _after_comment(page: str, at: int) -> int:
    """Place after the comment that begins with ``<!--`` at ``at``."""
    end = _COMMENT_END.search(page, at + 2)
    return end.end() if end else len(page)


def tokens(page: str, decode: Callable[[str], str] = text_of, rest: bool = False) -> Iterator[Token]:
    """Texts and tags in page order; comments, declarations and processing instructions are left out.

    ``rest`` gives a tag that the page does not end as text.
    """
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", decode(page[at:]), None, False
            return
        after = page[begin + 1 : begin + 2]
        closing = after == "/"
        letter = page[begin + 2 : begin + 3] if closing else after
        if not (letter.isascii() and letter.isalpha()):
            if after and after in "!?" or closing and letter:
                if begin > at:
                    yield "text", decode(page[at:begin]), None, False
                if page.startswith("<!--", begin):
                    at = _after_comment(page, begin)
                else:
                    end = page.find(">", begin)
                    at = size if end < 0 else end + 1
            else:  # a sign like any other
                end = page.find("<", begin + 1)
                end = size if end < 0 else end
                yield "text", decode(page[at:end]), None, False
                at = end
            continue
        if begin > at:
            yield "text", decode(page[at:begin]), None, False
        name = _TAG_NAME.match(page, begin + 1 + closing)
        tag = name[0].lower()
        attributes, at, closed = _attributes(page, name.end())
        if attributes is None:
            if rest:
                yield "text", decode(page[begin:]), None, False
            return
        if closing:
            yield "end", tag, None, False
            continue
        yield "start", tag, attributes, closed
        if tag in _ENDS:
            end = _ENDS[tag].search(page, at)
            stop = end.start() if end else size
            if stop > at:
                yield "text", decode(page[at:stop]) if tag in ESCAPABLE else page[at:stop], None, False
            at = stop
