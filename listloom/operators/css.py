"""CSS selectors as SQL predicates over the ``nodes`` array of a page.

Supported: tag, ``*``, ``#id``, ``.class``, ``[attr]`` with ``= *= ^= $= ~=``,
compounds, descendant and child combinators, comma unions, ``:not(compound)``,
``:first-of-type``, ``:last-of-type`` and ``:-soup-contains("text")``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from listloom.functions.sql import Make, each, keep, q, some
from listloom.schemas import COMMENT
from listloom.sources.pages import Shape

_TOKEN = re.compile(
    r"""\s*(?P<combinator>[>,])\s*|(?P<space>\s+)|(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)(?P<quote>["']?)(?P<value>.*?)(?P=quote))?\]
    |:not\((?P<negated>[^()]*)\)|:(?P<place>first|last)-of-type|:-soup-contains\((?P<q>["'])(?P<has>.*?)(?P=q)\)""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Compound:
    """Conditions on one element."""

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str | None, str | None], ...] = ()
    negated: tuple["Compound", ...] = ()
    place: str | None = None
    contains: tuple[str, ...] = ()

    def shape(self) -> Shape:
        return self.tag, self.id, self.classes

    def attr_names(self) -> set[str]:
        return {a[0] for a in self.attrs}.union(*[n.attr_names() for n in self.negated])


#: (combinator to the left, compound) from left to right.
Chain = tuple[tuple[str, Compound], ...]


def parse_selector(selector: str) -> tuple[Chain, ...]:
    """Chains of a comma list; an unsupported form is an error."""
    chains, chain, parts, combinator, at = [], [], {}, "", 0

    def end_compound() -> None:
        nonlocal parts
        if not parts:
            raise ValueError(f"empty compound in selector {selector!r}")
        lists = {k: tuple(v) for k, v in parts.items() if isinstance(v, list)}
        chain.append((combinator, Compound(**{**parts, **lists})))
        parts = {}

    text = selector.strip()
    while at < len(text):
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"unsupported selector {selector!r} at {text[at:]!r}")
        at, got = token.end(), token.groupdict()
        if got["combinator"] == ",":
            end_compound()
            chains.append(tuple(chain))
            chain, combinator = [], ""
        elif got["combinator"] or got["space"]:
            end_compound()
            combinator = got["combinator"] or " "
        elif got["tag"]:
            parts["tag"] = None if got["tag"] == "*" else got["tag"].lower()
        elif got["id"]:
            parts["id"] = got["id"]
        elif got["cls"]:
            parts.setdefault("classes", []).append(got["cls"])
        elif got["attr"]:
            parts.setdefault("attrs", []).append((got["attr"].lower(), got["op"], got["value"]))
        elif got["negated"] is not None:
            ((_, inner),) = parse_selector(got["negated"])[0]
            parts.setdefault("negated", []).append(inner)
        elif got["place"]:
            parts["place"] = got["place"]
        else:
            parts.setdefault("contains", []).append(got["has"])
    end_compound()
    return (*chains, tuple(chain))


def attr_of(node: str, name: str) -> str:
    """Attribute value of an element, null when absent."""
    if name == "id":
        return f"{node}.id"
    if name == "class":
        return f"if(size({node}.classes) > 0, array_join({node}.classes, ' '), NULL)"
    return f"try_element_at({node}.attrs, {q(name)})"


def own_pieces(pieces: str, node: str) -> str:
    """The text pieces below an element, in order."""
    return f"slice({pieces}, {node}.piece_from + 1, {node}.piece_to - {node}.piece_from)"


def _attr_test(node: str, name: str, op: str | None, value: str | None) -> str:
    actual = attr_of(node, name)
    if op is None:
        return f"{actual} IS NOT NULL"
    if name == "type":
        actual, value = f"lower({actual})", value.lower()
    test = {
        "=": f"{actual} = {q(value)}",
        "*=": f"contains({actual}, {q(value)})",
        "^=": f"startswith({actual}, {q(value)})",
        "$=": f"endswith({actual}, {q(value)})",
        "~=": f"array_contains(split({actual}, ' '), {q(value)})",
    }[op]
    return f"coalesce({test}, false)"


def compound_test(compound: Compound, node: str, pieces: str) -> str:
    """Boolean expression, never null: does the element meet the compound?"""
    tests = []
    if compound.tag:
        tests.append(f"{node}.tag = {q(compound.tag)}")
    if compound.id:
        tests.append(f"{node}.id <=> {q(compound.id)}")
    tests += [f"array_contains({node}.classes, {q(c)})" for c in compound.classes]
    tests += [_attr_test(node, *a) for a in compound.attrs]
    tests += [f"NOT ({compound_test(n, node, pieces)})" for n in compound.negated]
    if compound.place:
        tests.append(f"{node}.{'nth_of_type' if compound.place == 'first' else 'nth_last_of_type'} = 1")
    for needle in compound.contains:
        visible = keep(own_pieces(pieces, node), lambda p: f"{p}.kind <> {COMMENT}")
        tests.append(f"contains(array_join({each(visible, lambda p: f'{p}.text')}, ''), {q(needle)})")
    return " AND ".join(tests) or "true"


def _chain_test(chain: Chain, node: str, nodes: str, pieces: str) -> str:
    combinator, compound = chain[-1]
    here = compound_test(compound, node, pieces)
    if len(chain) == 1:
        return here
    above = f"array({node}.parent)" if combinator == ">" else f"{node}.path"
    # An ancestor is bound to a variable by a one-item transform.
    met = some(
        above,
        lambda i: f"coalesce({some(f'array(get({nodes}, {i}))', lambda a: _chain_test(chain[:-1], a, nodes, pieces))}, false)",
    )
    return f"{here} AND {met}"


def css(selector: str, nodes: str = "nodes", pieces: str = "pieces") -> Make:
    """Predicate over an element for a selector."""
    chains = parse_selector(selector)
    return lambda node: "(" + ") OR (".join(_chain_test(c, node, nodes, pieces) for c in chains) + ")"
