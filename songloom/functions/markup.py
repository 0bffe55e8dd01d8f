"""Text of chosen nodes of a page: the one place where rows pass through Python."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from songloom.functions.tokens import RAW_TEXT, tokens, value_of

# Elements without content, and elements whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template rp rt".split())
# Elements whose end tag may be left out: the start tags that end them, and the elements the look-out stops at.
ENDED_BY = {
    "li": ("li", "ul ol menu table"),
    "p": ("p", "a blockquote button div form li section article table td th"),
    "a": ("a", "table td th"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tr": ("tr", "table"),
    "option": ("option", "select datalist"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
}
ENDED_BY = {tag: (frozenset(ends.split()), frozenset(stops.split())) for tag, (ends, stops) in ENDED_BY.items()}


@dataclass(frozen=True)
class Node:
    """A node by tag and class.

    One class name matches any of the node's classes; names with a blank must equal the whole attribute.
    ``exact`` compares the attribute as written. ``within`` names another node this one must lie in;
    ``nth`` counts matches from 0.
    """

    name: str
    tag: str
    css_class: str | None = None
    exact: bool = False
    within: str | None = None
    nth: int = 0

    def matches(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag != self.tag:
            return False
        if self.css_class is None:
            return True
        written = value_of(attrs.get("class", ""))
        if self.exact:
            return written == self.css_class
        names = written.split()
        return self.css_class in names or self.css_class == " ".join(names)


class _Record:
    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.text: dict[str, list[str]] = {}
        #: Names whose text is being gathered.
        self.inside: set[str] = set()


class _Reader:
    """Follows the open elements and gathers the text of the wanted ones, without building a tree."""

    def __init__(self, nodes: tuple[Node, ...], each: Node | None) -> None:
        self.nodes, self.each = nodes, each
        self.records: list[_Record] = [] if each else [_Record()]
        # One entry per open element: tag, records that end with it, texts that end with it.
        self.open: list[tuple[str, list[_Record], list[tuple[_Record, str]]]] = []
        self.open_tags: Counter[str] = Counter()
        self.live: list[_Record] = list(self.records)
        self.gathering: list[tuple[_Record, str]] = []
        self.hidden = 0

    def _end_implied(self, tag: str) -> None:
        """Close an element that this start tag ends."""
        ends, stops = ENDED_BY[tag]
        if not any(self.open_tags[t] for t in ends):
            return
        for other, _, _ in reversed(self.open):
            if other in ends:
                while self._close() != other:
                    pass
                return
            if other in stops:
                return

    def read(self, page: str) -> None:
        for kind, value, attributes, closed in tokens(page):
            if kind == "text":
                self._text(value)
            elif kind == "end":
                self._end(value)
            else:
                self._start(value, attributes)
                if closed and value not in VOID and value not in RAW_TEXT:
                    self._close()

    def _start(self, tag: str, values: dict[str, str]) -> None:
        if tag in ENDED_BY:
            self._end_implied(tag)
        begun: list[tuple[_Record, str]] = []
        for record in self.live:
            for node in self.nodes:
                if (node.within is None or node.within in record.inside) and node.matches(tag, values):
                    count = record.seen.get(node.name, 0)
                    record.seen[node.name] = count + 1
                    if count == node.nth:
                        record.text[node.name] = []
                        begun.append((record, node.name))
        records: list[_Record] = []
        if self.each and self.each.matches(tag, values):
            records.append(_Record())
            self.records += records
            self.live += records
        self.gathering += begun
        for record, name in begun:
            record.inside.add(name)
        self.hidden += tag in HIDDEN
        self.open.append((tag, records, begun))
        self.open_tags[tag] += 1
        if tag in VOID:
            self._close()

    def _end(self, tag: str) -> None:
        if self.open_tags[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, records, begun = self.open.pop()
        self.open_tags[tag] -= 1
        self.hidden -= tag in HIDDEN
        for record, name in begun:
            record.inside.discard(name)
        self.live = [r for r in self.live if r not in records] if records else self.live
        self.gathering = [g for g in self.gathering if g not in begun] if begun else self.gathering
        return tag

    def _text(self, text: str) -> None:
        if not self.hidden:
            for record, name in self.gathering:
                record.text[name].append(text)


def node_texts(html: str | None, nodes: tuple[Node, ...], each: Node | None = None) -> list[dict[str, str]]:
    """Stripped text per node name, one record per page or per ``each`` node; absent nodes are left out."""
    if html is None:
        return []
    reader = _Reader(nodes, each)
    reader.read(html)
    return [{name: "".join(parts).strip() for name, parts in r.text.items()} for r in reader.records]


def anchors(html: str | None, anchor_class: str | None) -> tuple[str | None, list[str]]:
    """Base address the page names, and the different targets of its anchors, of those with that whole class (any if None)."""
    base, found, hidden = None, {}, 0
    for kind, tag, attributes, _ in tokens(html or ""):
        if tag == "template" and kind != "text":
            hidden = max(0, hidden + (1 if kind == "start" else -1))
        if kind != "start" or hidden or "href" not in attributes:
            continue
        if tag == "base" and base is None:
            base = value_of(attributes["href"])
        elif tag == "a" and (anchor_class is None or value_of(attributes.get("class", "")) == anchor_class):
            found[value_of(attributes["href"])] = None
    return base, list(found)
