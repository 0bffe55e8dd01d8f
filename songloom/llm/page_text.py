"""Main text of pages by wrapper induction over the pages of a host.

Each host has a model page. A page's DOM tree is aligned with the model's by simple tree matching: children of
matched nodes are matched in order, as many as can be, weighing whole subtrees. Counted over all pages of the host, a
node of the model whose text is the same in most pages that have it is template; where texts differ, it is a
slot. Counts are combined in tasks, so a host that holds most pages costs one row per node and task.

What a page keeps are its slots and the nodes that only it has, as far as they are content: the elements that
announce an article if there are any, else the body, without parts whose element or class says menu, header, footer,
sidebar, notice, advert, form, script, style or comments. A class says so as a whole, not by a part of a longer name, and
names that would empty a page are not heeded.

Blocks are joined in page order by a line break; white space inside a block is one space; character references are
decoded; ``br`` is white space.

A node is template where at least ``SAME_PAGES`` pages with other content have it and ``SAME_SHARE`` of them show
the same text. Pages that are copies of the model in all texts say nothing about what is constant.

Defined cases: null html is empty and gives an empty text; pages without a host in their url form a host of their own;
any bytes between angle brackets are read in linear time, trees of any depth without recursion; unclosed elements end where their
parents do, or where an element begins that cannot stand inside them; repeated rows count each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Generator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.functions.tokens import tokens, value_of
from songloom.llm.common import rows_per_batch, steps
from songloom.operators.equijoin import splittable_join
from songloom.session import stored

SAME_SHARE = 0.8
SAME_PAGES = 5
#: Pairs of children up to which two lists are matched pair by pair, which is quicker for short ones, and pairs weighed at a time beyond.
CELLS = 10_000
ROW_CELLS = 500_000

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
#: An element of the first kind ends open elements of the second, looking no further than the third.
ENDS = {
    **{t: ({"p"}, {"table", "td", "th", "button"}) for t in BLOCKS - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"table", "td"}),
}
#: Elements that are never main text, and words of classes and ids that say so.
DROPPED = frozenset(
    "head nav aside form script style noscript template iframe svg canvas object button select option input textarea label dialog menu "
    "audio video map title".split()
)
OUTER = frozenset("header footer".split())
NAMED = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer form header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related "
    "replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Words beside such a name that change nothing.
PLACES = frozenset("area bar bottom box container fixed global inner item left link links list outer right section site sticky top wrapper".split())

_WORDS = re.compile(r"[_-]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element of a page, with its texts and children in order."""

    __slots__ = ("tag", "marks", "parts", "parent", "drop")

    def __init__(self, tag: str, marks: frozenset, parent):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.parts: list = []
        self.drop = False

    def children(self) -> list:
        return [p for p in self.parts if isinstance(p, Node)]


def marks_of(attributes: dict[str, str]) -> frozenset:
    """Names of class and id, and the role, of an element."""
    found = set()
    for name in ("class", "id", "role"):
        for word in value_of(attributes.get(name, "")).lower().split():
            found.add(f"role={word}" if name == "role" else word)
    return frozenset(found)


def parsed(html: str) -> Node:
    """The page as a tree; linear in its length."""
    top = here = Node("", frozenset(), None)
    depth: dict[str, int] = {}
    for kind, value, attributes, closed in tokens(html, entities.unescape, rest=True):
        if kind == "text":
            here.parts.append(value)
            continue
        if kind == "end":
            if depth.get(value):
                while here.tag != value:
                    depth[here.tag] -= 1
                    here = here.parent
                depth[value] -= 1
                here = here.parent
            continue
        ended, within = ENDS.get(value, ((), ()))
        ahead = sum(depth.get(e, 0) for e in ended)
        if ahead:
            node, last = here, None
            while ahead and node.parent is not None and node.tag not in within:
                if node.tag in ended:
                    last = node
                    ahead -= 1
                node = node.parent
            if last is not None:
                while here is not last.parent:
                    depth[here.tag] -= 1
                    here = here.parent
        node = Node(value, marks_of(attributes), here)
        here.parts.append(node)
        if value in VOID or closed and value not in BLOCKS and value not in RAW:
            continue
        here = node
        depth[value] = depth.get(value, 0) + 1
    return top


def _named(mark: str) -> bool:
    """A class or id that is such a name, or is made of such names and words that only say where it stands."""
    if mark in NAMED:
        return True
    words = set(_WORDS.split(mark))
    return bool(words & NAMED) and words <= NAMED | PLACES


def _says_boilerplate(node: Node, by_name: bool = True) -> bool:
    if node.tag in DROPPED or any(f"role={r}" in node.marks for r in ROLES):
        return True
    return by_name and any(map(_named, node.marks))


def own_text(node: Node) -> str:
    """Text outside of child blocks."""
    out: list[str] = []
    work = list(reversed(node.parts))
    while work:
        part = work.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.tag == "br":
            out.append(" ")
        elif part.tag not in BLOCKS and part.tag not in RAW:
            work.extend(reversed(part.parts))
    return _SPACE.sub(" ", "".join(out)).strip()


def skeleton(top: Node) -> list[tuple[str, int, str]]:
    """Elements in page order as (signature, parent's place, own text); inline elements belong to their block."""
    rows: list[tuple[str, int, str]] = []
    work = [(child, -1) for child in reversed(top.children())]
    while work:
        node, parent = work.pop()
        place = parent
        if node.tag in BLOCKS:
            place = len(rows)
            rows.append((f"{node.tag}.{'.'.join(sorted(node.marks))}", parent, own_text(node)))
        work.extend((child, place) for child in reversed(node.children()))
    return rows


def _tree(rows: list) -> list[list[int]]:
    below: list[list[int]] = [[] for _ in range(len(rows) + 1)]  # the last has the roots
    for place, row in enumerate(rows):
        below[row[1]].append(place)
    return below


def _same_trees(rows: list, below: list[list[int]], names: dict) -> list[int]:
    """Number of each place's subtree: equal for equal subtrees, texts included."""
    numbers = [0] * len(rows)
    for place in range(len(rows) - 1, -1, -1):  # children stand behind their parents
        key = (rows[place][0], rows[place][2], tuple(numbers[c] for c in below[place]))
        numbers[place] = names.setdefault(key, len(names))
    return numbers


def _sizes(below: list[list[int]]) -> list[int]:
    """Number of places in each place's subtree, itself included."""
    sizes = [1] * (len(below) - 1)
    for place in range(len(sizes) - 1, -1, -1):  # children stand behind their parents
        sizes[place] += sum(sizes[c] for c in below[place])
    return sizes


class _Side:
    """A skeleton with numbers, shared by both sides, for what is compared: kinds, texts, shapes and subtrees."""

    def __init__(self, rows: list, names: dict):
        self.rows, self.below = rows, _tree(rows)
        number = lambda *key: names.setdefault(key, len(names))
        self.same = _same_trees(rows, self.below, names)
        self.size = _sizes(self.below)
        self.kind = np.array([number("kind", r[0]) for r in rows], np.int64)
        self.text = np.array([number("text", r[2]) for r in rows], np.int64)
        self.shape = [0] * len(rows)
        for place in range(len(rows) - 1, -1, -1):
            self.shape[place] = number("shape", rows[place][0], tuple(self.shape[c] for c in self.below[place]))


def _worked(task: Generator) -> np.ndarray:
    """Value of a generator that yields the generators whose values it needs; trees of any depth need no recursion."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _by_shape(side: _Side, places: list[int]) -> dict[int, list[int]]:
    """Positions in ``places`` of the subtrees of each shape, childless ones left out."""
    found: dict[int, list[int]] = {}
    for i, place in enumerate(places):
        if side.below[place]:
            found.setdefault(side.shape[place], []).append(i)
    return found


def _gains(model: _Side, page: _Side, xs: list[int], ys: list[int]) -> Generator:
    """What every pair of places adds to a matching, subtrees included; 0 for different kinds."""
    alike = model.kind[xs][:, None] == page.kind[ys][None, :]
    gains = np.where(alike, 2 + (model.text[xs][:, None] == page.text[ys][None, :]), 0).astype(np.int32)
    shapes = _by_shape(page, ys)
    for mine in _by_shape(model, xs).values():
        for its in shapes.values():
            if model.kind[xs[mine[0]]] == page.kind[ys[its[0]]]:
                gains[np.ix_(mine, its)] += yield _weights(model, page, [xs[i] for i in mine], [ys[j] for j in its])
    return gains


def _weights(model: _Side, page: _Side, xs: list[int], ys: list[int]) -> Generator:
    """Weight of the heaviest matching below every pair of places; those of a side have one shape."""
    n, m = len(model.below[xs[0]]), len(page.below[ys[0]])
    most = max(1, 20 * ROW_CELLS // (m * len(ys)))
    if len(xs) > most:
        parts = []
        for begin in range(0, len(xs), most):
            parts.append((yield _weights(model, page, xs[begin : begin + most], ys)))
        return np.concatenate(parts)
    if m > 2 * len(xs) * len(ys):  # few subtrees with long lists
        out = np.zeros((len(xs), len(ys)), np.int32)
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                last, _ = yield _last_row(model, page, model.below[x], page.below[y])
                out[i, j] = last[-1]
        return out
    mine, its = [[model.below[x][i] for x in xs] for i in range(n)], [[page.below[y][j] for y in ys] for j in range(m)]
    texts_a, texts_b = [model.text[c][:, None] for c in mine], [page.text[c][None, :] for c in its]
    kinds_a, kinds_b = [int(model.kind[c[0]]) for c in mine], [int(page.kind[c[0]]) for c in its]
    inner_a, inner_b = [bool(model.below[c[0]]) for c in mine], [bool(page.below[c[0]]) for c in its]
    above = [np.zeros((len(xs), len(ys)), np.int32)] * (m + 1)
    for i in range(n):
        row = above[:1]
        for j in range(m):
            best = np.maximum(above[j + 1], row[j])
            if kinds_a[i] == kinds_b[j]:
                gain = above[j] + 2
                gain += texts_a[i] == texts_b[j]
                if inner_a[i] and inner_b[j]:
                    gain += yield _weights(model, page, mine[i], its[j])
                np.maximum(best, gain, out=best)
            row.append(best)
        above = row
    return above[m]


def _next_row(above: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Row of the table of ``_best_pairs`` from the row above and the gains of its place."""
    row = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[1:], np.where(gain > 0, above[:-1] + gain, 0)), out=row[1:])
    return row


def _step(left: list[int], right: list[int]) -> int:
    """Rows of the table that are held at a time; one row of each such block is kept."""
    return max(1, ROW_CELLS // len(right), int(len(left) ** 0.5))


def _last_row(model: _Side, page: _Side, left: list[int], right: list[int]) -> Generator:
    """Last row of the table of two lists, and the row above each block of rows."""
    row, kept, step = np.zeros(len(right) + 1, np.int32), [], _step(left, right)
    for begin in range(0, len(left), step):
        kept.append(row)
        for gain in (yield _gains(model, page, left[begin : begin + step], right)):
            row = _next_row(row, gain)
    return row, kept


def _best_pairs_of_rows(model: _Side, page: _Side, left: list[int], right: list[int]) -> tuple[int, list]:
    """What ``_best_pairs`` gives, for long lists: whole rows at once, and only a block of them held at a time."""
    last, kept = _worked(_last_row(model, page, left, right))
    step, j = _step(left, right), len(right)
    pairs = []
    for block in range(len(kept) - 1, -1, -1):
        places = left[block * step : (block + 1) * step]
        gains = _worked(_gains(model, page, places, right))
        table = [kept[block]]
        for gain in gains:
            table.append(_next_row(table[-1], gain))
        i = len(places)
        while i and j:
            g = gains[i - 1][j - 1]
            if g and table[i][j] == table[i - 1][j - 1] + g:
                pairs.append((places[i - 1], right[j - 1]))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return int(last[-1]), pairs[::-1]


def _equal_ends(left: list[int], right: list[int], same_a: list[int], same_b: list[int]) -> tuple[int, int]:
    """Number of equal subtrees that two lists begin with, and of those they end with after that.

    No matching is heavier than one that pairs them: nothing outweighs a subtree matched with its equal.
    """
    head, most = 0, min(len(left), len(right))
    while head < most and same_a[left[head]] == same_b[right[head]]:
        head += 1
    tail = 0
    while tail < most - head and same_a[left[-1 - tail]] == same_b[right[-1 - tail]]:
        tail += 1
    return head, tail


def matched(model: list, page: list) -> list[tuple[int, int]]:
    """Pairs of places of a top-down, order-keeping matching of two skeletons (simple tree matching).

    It is a heaviest one for lists of any length: a pair weighs 2, and 1 more if its texts are equal. Time is the product of what is left
    of the lists when equal heads and tails are off; up to ``CELLS`` of it is done pair by pair, more in whole rows, with the same result.
    """
    names: dict = {}
    a_side, b_side = _Side(model, names), _Side(page, names)
    known: dict[tuple[int, int], tuple[int, list]] = {}
    found, work = [], [(-1, -1)]
    while work:
        key = work.pop()
        if key not in known:
            _weigh(a_side, b_side, key, known)
        pairs = known[key][1]
        found.extend(pairs)
        work.extend((x, y) for x, y in pairs if a_side.below[x] and b_side.below[y])
    return found


def _weigh(model: _Side, page: _Side, wanted: tuple[int, int], known: dict) -> None:
    """Enter the weight below a pair and the pairs of its children."""
    same_a, same_b = model.same, page.same

    def below(x: int, y: int) -> int:
        if not model.below[x] or not page.below[y]:
            return 0
        return 3 * (model.size[x] - 1) if same_a[x] == same_b[y] else known[x, y][0]

    todo = [wanted]
    while todo:  # depth first without recursion: a pair is weighed when all pairs below it are
        a, b = key = todo[-1]
        if key in known:
            todo.pop()
            continue
        left, right = model.below[a], page.below[b]
        head, tail = _equal_ends(left, right, same_a, same_b)
        xs, ys = left[head : len(left) - tail], right[head : len(right) - tail]
        if len(xs) * len(ys) > CELLS:
            score, pairs = _best_pairs_of_rows(model, page, xs, ys)
        else:
            rows_a, rows_b = model.rows, page.rows
            open_pairs = [
                (x, y) for x in xs if model.below[x] for y in ys
                if page.below[y] and rows_a[x][0] == rows_b[y][0] and same_a[x] != same_b[y] and (x, y) not in known
            ]
            if open_pairs:
                todo += open_pairs
                continue
            score, pairs = _best_pairs(xs, ys, rows_a, rows_b, below)
        ends = list(zip(left[:head], right[:head])), list(zip(left[len(left) - tail :], right[len(right) - tail :]))
        known[key] = (score + 3 * sum(model.size[x] for end in ends for x, _ in end), ends[0] + pairs + ends[1])
        todo.pop()


def _best_pairs(left: list[int], right: list[int], model: list, page: list, below: Callable[[int, int], int]) -> tuple[int, list]:
    """Weight and pairs of the heaviest order-keeping matching of two lists of children whose subtrees are weighed."""
    table = [[0] * (len(right) + 1)]
    gains = []
    for x in left:
        row, above, gain = [0], table[-1], []
        for j, y in enumerate(right):
            g = 0
            if model[x][0] == page[y][0]:
                g = 2 + below(x, y) + (model[x][2] == page[y][2])  # equal texts decide between equal trees
            gain.append(g)
            v = above[j] + g if g else 0
            row.append(max(v, above[j + 1], row[j]))
        table.append(row)
        gains.append(gain)
    pairs, i, j = [], len(left), len(right)
    while i and j:
        g = gains[i - 1][j - 1]
        if g and table[i][j] == table[i - 1][j - 1] + g:
            pairs.append((left[i - 1], right[j - 1]))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return table[-1][-1], pairs[::-1]


def content_blocks(top: Node) -> list[tuple[int, str]]:
    """(place in the skeleton, text) of the blocks that may be main text, in page order."""
    blocks = _blocks(top, True)
    # A page that only names would empty is taken without them.
    return blocks if blocks else _blocks(top, False)


def _blocks(top: Node, by_name: bool) -> list[tuple[int, str]]:
    roots = _articles(top, by_name)
    within = bool(roots)
    roots = roots or {id(top)}
    blocks: list[tuple[int, str]] = []
    place = owner = -1
    buffer: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if text:
            blocks.append((owner, text))

    # Walk with explicit ends, so that text after a child block starts a block of its own.
    work: list = [("open", top, not within, -1)]
    while work:
        kind, node, live, mine = work.pop()
        if kind == "text":
            if live:
                if owner != mine:
                    flush()
                    owner = mine
                buffer.append(node)
            continue
        if kind == "close":
            flush()
            continue
        block = node.tag in BLOCKS
        if block:
            place += 1
            mine = place
            flush()
        elif node.tag in RAW:
            continue
        if id(node) in roots:
            live = True
        elif live and (_says_boilerplate(node, by_name) or node.tag == "footer" or node.tag == "header" and not within):
            live = False
        if node.tag == "br" and live:
            buffer.append(" ")
        if block:
            work.append(("close", node, live, mine))
        for part in reversed(node.parts):
            work.append(("text" if isinstance(part, str) else "open", part, live, mine))
    flush()
    return blocks


def _articles(top: Node, by_name: bool) -> set[int]:
    """The elements that announce main text, the outermost ones, as far as there is any text in them.

    They count inside of elements with any name, for a name may stand for the whole page, but not inside of dropped elements.
    """
    found, work = set(), [top]
    while work:
        node = work.pop()
        if node is not top and _says_boilerplate(node, False):
            continue
        announced = node.tag in ("article", "main") or "role=main" in node.marks or "role=article" in node.marks
        if announced and not (by_name and any(map(_named, node.marks))):
            if _has_text(node):
                found.add(id(node))
            continue
        work.extend(node.children())
    return found


def _has_text(node: Node) -> bool:
    work = [node]
    while work:
        for part in work.pop().parts:
            if isinstance(part, Node):
                if part.tag not in RAW and part.tag not in DROPPED:
                    work.append(part)
            elif part.strip():
                return True
    return False


def host_of(url: str) -> Column:
    """Host of an address, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _models(pages: DataFrame) -> DataFrame:
    """``host, model``: skeleton of one page per host, that with the smallest id that has any html."""
    # Combined in tasks first, so one page per host and task is shuffled.
    chosen = pages.where(F.length("html") > 0).groupBy("host").agg(F.min_by("html", F.struct("page_id", F.xxhash64("html"))).alias("html"))

    def run(batches):
        for batch in steps(batches, "html"):
            rows = [[{"s": s, "p": p, "t": t} for s, p, t in skeleton(parsed(h or ""))] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rows, pa.list_(pa.struct([("s", pa.string()), ("p", pa.int32()), ("t", pa.string())])))], ["host", "model"])

    return chosen.select("host", "html").mapInArrow(run, "host string, model array<struct<s:string,p:int,t:string>>")


def _aligned(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, texts, places, nodes, same``: content blocks with their place in the model (-1 for none),
    and which nodes of the model the page has and shows with the same text."""

    def run(batches):
        models: dict[str, list] = {}
        for batch in steps(batches, "html"):
            rows: list[tuple] = []
            hosts = batch.column("host").to_pylist()
            for i, html in enumerate(batch.column("html").to_pylist()):
                top = parsed(html or "")
                if hosts[i] not in models:
                    if len(models) > 100:
                        models.clear()
                    model = batch.column("model")[i].as_py() or []
                    models[hosts[i]] = [(m["s"], m["p"], m["t"]) for m in model]
                model = models[hosts[i]]
                page = skeleton(top)
                pairs = matched(model, page)
                back = {b: a for a, b in pairs}
                blocks = content_blocks(top)
                nodes = [a for a, b in pairs if model[a][2] and page[b][2]]
                same = [a for a, b in pairs if model[a][2] and page[b][2] == model[a][2]]
                if len(same) == len(nodes) and len(page) == len(model):
                    nodes, same = [], []  # the model itself or a copy of it
                rows.append(([t for _, t in blocks], [back.get(p, -1) for p, _ in blocks], nodes, same))
            texts, places, nodes, same = zip(*rows)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.list_(pa.string())), pa.array(places, ints), pa.array(nodes, ints), pa.array(same, ints)],
                ["page_id", "url", "host", "texts", "places", "nodes", "same"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, url string, host string, texts array<string>, places array<int>, nodes array<int>, same array<int>")


def extract_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Id, url, ``text`` and its length ``n_chars`` in code points, one row per page."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    models = stored(_models(rows), "models")
    with rows_per_batch(pages.sparkSession, 500):
        aligned = stored(_aligned(splittable_join(rows, models, ["host"], "left")), "aligned")
    had = aligned.select("host", F.explode("nodes").alias("node")).groupBy("host", "node").agg(F.count("*").alias("n"))
    same = aligned.select("host", F.explode("same").alias("node")).groupBy("host", "node").agg(F.count("*").alias("k"))
    constant = had.join(same, ["host", "node"]).where((F.col("n") >= SAME_PAGES) & (F.col("k") >= SAME_SHARE * F.col("n")))
    # At most the nodes of a page per host; stored, so that Spark knows the size and shuffles no texts if it is small.
    template = stored(constant.groupBy("host").agg(F.collect_list("node").alias("template")), "templates")
    known = splittable_join(aligned, template, ["host"], "left")
    fixed = F.coalesce("template", F.array().cast("array<int>"))
    kept = F.filter(F.arrays_zip("texts", "places"), lambda b: ~F.array_contains(fixed, b["places"]))
    text = F.concat_ws("\n", F.transform(kept, lambda b: b["texts"]))
    out = known.select(F.col("page_id").alias(id_column), F.col("url").alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
