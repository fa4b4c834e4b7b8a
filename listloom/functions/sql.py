"""Small helpers to write SQL expression text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

_names = count(1)

#: An expression over one lambda variable.
Make = Callable[[str], str]

NO_TEXTS = "cast(array() AS array<string>)"


def q(value: str) -> str:
    """A string literal."""
    for raw, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        value = value.replace(raw, escaped)
    return f"'{value}'"


def texts(values: Iterable[str]) -> str:
    """A constant ARRAY<STRING>, also when empty."""
    listed = ", ".join(q(v) for v in values)
    return f"array({listed})" if listed else NO_TEXTS


def _lambda(function: str, items: str, make: Make) -> str:
    x = f"x{next(_names)}"
    return f"{function}({items}, {x} -> {make(x)})"


def each(items: str, make: Make) -> str:
    return _lambda("transform", items, make)


def keep(items: str, test: Make) -> str:
    return _lambda("filter", items, test)


def some(items: str, test: Make) -> str:
    return _lambda("exists", items, test)


def case(branches: Iterable[tuple[str, str]], otherwise: str = "NULL") -> str:
    """``CASE WHEN`` over (condition, value) pairs."""
    whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {whens} ELSE {otherwise} END" if whens else otherwise


def either(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def head(items: str, n: int = 1) -> str:
    return f"slice({items}, 1, {n})"


def tail(items: str) -> str:
    """All items but the first."""
    return f"slice({items}, 2, greatest(size({items}) - 1, 0))"


def let(value: str, make: Make) -> str:
    """Name a value, so that an expression using it twice evaluates it once."""
    return f"get({each(f'array({value})', make)}, 0)"


def complete(items: str) -> str:
    """The list, or null when one item is missing."""
    return let(items, lambda v: f"if({some(v, lambda x: f'{x} IS NULL')}, NULL, {v})")


def fill(template: str, **parts: str) -> str:
    """Concatenate a template whose ``{name}`` marks are replaced by expressions."""
    out, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [q(text), parts[name]] if text else [parts[name]]
    return f"concat({', '.join(out + ([q(rest)] if rest else []))})"
