"""Selecting elements of a page and reading from them.

A :class:`Page` stands for the ``nodes`` and ``pieces`` of the current row, and
:class:`Elements` for an ARRAY of selected elements in document order, as SQL text.
All of it is narrow: selection is a filter over the array of the row.  The page
notes what was asked of it, so :meth:`Page.wanted` tells the parser what to emit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from listloom.functions.sql import Make, complete, each, keep, let, some
from listloom.functions.text import strip
from listloom.operators.css import attr_of, css, own_pieces, parse_selector
from listloom.schemas import RAW, TEXT
from listloom.sources.pages import RAW_TAGS, Shape, Wanted


def text_pieces(pieces: str, node: str) -> str:
    """ARRAY<STRING>: the pieces that make up ``text`` of an element."""
    raw = ", ".join(f"'{t}'" for t in sorted(RAW_TAGS))
    mine = keep(own_pieces(pieces, node), lambda p: f"{p}.kind = if({node}.tag IN ({raw}), {RAW}, {TEXT})")
    return each(mine, lambda p: f"{p}.text")


def text_of(pieces: str, node: str) -> str:
    return f"array_join({text_pieces(pieces, node)}, '')"


def string_of(pieces: str, node: str) -> str:
    """The only text of an element that has exactly one, else null."""
    return f"if({node}.single, get({pieces}, {node}.piece_from).text, NULL)"


def all_texts_of(pieces: str, node: str) -> str:
    """Every text below an element, comments and scripts included."""
    return each(own_pieces(pieces, node), lambda p: f"{p}.text")


def lines_of(pieces: str, node: str) -> str:
    """Stripped, non-empty texts below an element."""
    return keep(each(text_pieces(pieces, node), strip), lambda t: f"{t} <> ''")


class Page:
    """The parsed page of the current row."""

    def __init__(self, nodes: str = "nodes", pieces: str = "pieces"):
        self.nodes, self.pieces = nodes, pieces
        self._elements: set[Shape] = set()
        self._subtrees: set[Shape] = set()
        self._texts: set[Shape] = set()
        self._attrs: set[str] = set()

    def all(self, selector: str) -> "Elements":
        """All matches in document order."""
        return Elements(self, keep(self.nodes, self._test(selector)), self._targets(selector))

    def first(self, selector: str) -> "Elements":
        """The first match, as a list of at most one."""
        return self.all(selector).first()

    def wanted(self) -> Wanted:
        """What has been asked so far, for :func:`parse_pages`."""
        return Wanted(
            frozenset(self._elements), frozenset(self._subtrees), frozenset(self._texts), frozenset(self._attrs)
        )

    def _test(self, selector: str) -> Make:
        for chain in parse_selector(selector):
            for _, compound in chain:
                self._elements.add(compound.shape())
                self._attrs |= compound.attr_names()
                if compound.contains:
                    self._texts.add(compound.shape())
        return css(selector, self.nodes, self.pieces)

    @staticmethod
    def _targets(selector: str) -> frozenset[Shape]:
        return frozenset(chain[-1][1].shape() for chain in parse_selector(selector))


class Elements:
    """ARRAY of elements of one page, in document order; ``sql`` is its expression."""

    def __init__(self, page: Page, sql: str, targets: frozenset[Shape]):
        self.page, self.sql, self._targets = page, sql, targets

    def _with(self, sql: str) -> "Elements":
        return Elements(self.page, sql, self._targets)

    def bind(self, make: Callable[["Elements"], str]) -> str:
        """Use the selection several times but make it once."""
        return let(self.sql, lambda found: make(self._with(found)))

    # --- narrowing ------------------------------------------------------
    def first(self) -> "Elements":
        return self._with(f"slice({self.sql}, 1, 1)")

    def nth(self, index: int) -> "Elements":
        """0-based, negative from the end; empty when there is none."""
        if index >= 0:
            return self._with(f"slice({self.sql}, {index + 1}, 1)")
        return self._with(f"slice(reverse({self.sql}), {-index}, 1)")

    def where(self, test) -> "Elements":
        """Keep the elements for which ``test(element)`` holds."""
        return self._with(keep(self.sql, lambda n: test(Element(self, n))))

    def inside(self, selector: str) -> "Elements":
        """Matches below these elements."""
        test, nodes = self.page._test(selector), self.page.nodes

        def below(scope: str) -> str:
            return keep(
                nodes,
                lambda n: f"{test(n)} AND {some(f'{n}.path', lambda i: f'get({nodes}, {i}).node_id = {scope}.node_id')}",
            )

        return Elements(self.page, f"flatten({each(self.sql, below)})", Page._targets(selector))

    def children(self, tag: str | None = None) -> "Elements":
        """Immediate children, all or of one tag."""
        nodes = self.page.nodes
        if tag is None:
            self.page._subtrees |= self._targets
        else:
            self.page._elements.add((tag, None, ()))

        def of(scope: str) -> str:
            named = "" if tag is None else f"{{n}}.tag = '{tag}' AND "
            return keep(
                nodes,
                lambda n: named.replace("{n}", n)
                + f"coalesce(get({nodes}, {n}.parent).node_id = {scope}.node_id, false)",
            )

        return Elements(self.page, f"flatten({each(self.sql, of)})", self._targets)

    # --- reading --------------------------------------------------------
    def read(self, make) -> str:
        """ARRAY of one value per element."""
        return each(self.sql, lambda n: make(Element(self, n)))

    def text(self) -> str:
        return self.read(lambda e: e.text())

    def string(self) -> str:
        return self.read(lambda e: e.string())

    def attr(self, name: str) -> str:
        """Values with null where the attribute is absent."""
        return self.read(lambda e: e.attr(name))

    def need(self, name: str) -> str:
        """Values, or null for the whole list if one element lacks the attribute."""
        return complete(self.attr(name))

    def lines(self) -> str:
        """ARRAY<ARRAY<STRING>> of stripped non-empty texts."""
        return self.read(lambda e: e.lines())

    def all_texts(self) -> str:
        return self.read(lambda e: e.all_texts())

    def count(self) -> str:
        return f"size({self.sql})"


class Element:
    """One element inside a lambda."""

    def __init__(self, owner: Elements, node: str):
        self._owner, self.node = owner, node

    def _pieces(self) -> str:
        self._owner.page._texts |= self._owner._targets
        return self._owner.page.pieces

    def text(self) -> str:
        return text_of(self._pieces(), self.node)

    def string(self) -> str:
        return string_of(self._pieces(), self.node)

    def all_texts(self) -> str:
        return all_texts_of(self._pieces(), self.node)

    def lines(self) -> str:
        return lines_of(self._pieces(), self.node)

    def attr(self, name: str) -> str:
        self._owner.page._attrs.add(name)
        return attr_of(self.node, name)

    def tag(self) -> str:
        return f"{self.node}.tag"


def one(values: str) -> str:
    """The single value of a list of at most one, else null."""
    return f"get({values}, 0)"


def select_nodes(parsed: DataFrame, selector: str, *keys: str) -> DataFrame:
    """Long form of a selection: one row per match with its rank and text."""
    found = Page().all(selector).read(
        lambda e: f"named_struct('node_id', {e.node}.node_id, 'tag', {e.node}.tag, 'id', {e.node}.id, "
        f"'classes', {e.node}.classes, 'attrs', {e.node}.attrs, 'text', {e.text()}, 'string', {e.string()})"
    )
    return parsed.selectExpr(*keys, f"posexplode({found}) AS (pos, node)").select(*keys, "pos", "node.*")
