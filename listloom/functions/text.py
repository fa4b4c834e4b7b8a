"""String expressions with the semantics of the listing rules."""

from __future__ import annotations

from listloom.functions.sql import Make, each, q

# The characters removed by a plain "strip".  Spark's trim only
# removes U+0020, so the set is spelled out.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: A number as the size tables accept it.  Java would also read ``9D`` or ``9f``
#: as a double, and shoe widths look exactly like that, so the text is tested
#: first.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
NOT_FINITE = r"^(?i)[+-]?(inf|infinity|nan)$"


def strip(text: str) -> str:
    """Remove Unicode whitespace on both sides."""
    return f"btrim({text}, {q(WHITESPACE)})"


def strip_chars(text: str, chars: str) -> str:
    """Remove any of ``chars`` on both sides."""
    return f"btrim({text}, {q(chars)})"


def remove(text: str, needle: str) -> str:
    """Delete every occurrence of an expression; an empty needle changes nothing."""
    return f"replace({text}, {needle}, '')"


def swap(text: str, needle: str, by: str) -> str:
    """Replace every occurrence of a literal."""
    return f"replace({text}, {q(needle)}, {q(by)})"


def escape_regex(literal: str) -> str:
    """Quote a literal for the pattern argument of ``split``."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in literal)


def pieces(text: str, separator: str) -> str:
    """ARRAY of a literal split, empty pieces included."""
    return f"split({text}, {q(escape_regex(separator))}, -1)"


def piece(text: str, separator: str, index: int) -> str:
    """Piece ``index`` (0-based, negative from the end) of a literal split, or null."""
    return f"try_element_at({pieces(text, separator)}, {index + 1 if index >= 0 else index})"


def title_case(text: str) -> str:
    """Upper-case a letter after any non-letter, lower-case the others."""
    runs = f"regexp_extract_all({text}, {q(r'(\p{L}+|[^\p{L}]+)')}, 1)"
    cased = each(runs, lambda r: f"concat(upper(substr({r}, 1, 1)), lower(substr({r}, 2)))")
    return f"array_join({cased}, '')"


def squash(text: str) -> str:
    """Drop single spaces: the Korean brand column and the compact site name."""
    return remove(text, "' '")


def snake(text: str) -> str:
    """Site name for file names: spaces become underscores."""
    return swap(text, " ", "_")


def parses_as_number(text: str) -> str:
    """True when the text is a number for the size tables, including inf and nan."""
    bare = strip(text)
    return f"coalesce({bare} RLIKE {q(NUMBER)} OR {bare} RLIKE {q(NOT_FINITE)}, false)"


def to_number(text: str) -> str:
    """DOUBLE value of a finite number, else null (never an error)."""
    bare = strip(text)
    return f"if({bare} RLIKE {q(NUMBER)}, try_cast(replace({bare}, '_', '') AS double), NULL)"


def full_title(brand_ko: str, name_ko: str, name: str) -> str:
    """Three parts and always two spaces, also when parts are empty."""
    return f"concat(coalesce({brand_ko}, ''), ' ', coalesce({name_ko}, ''), ' ', coalesce({name}, ''))"


def without_currency(price: str) -> str:
    """Listing price text: the dollar sign goes, everything else stays."""
    return remove(price, "'$'")


def korean_price(price: str) -> str:
    """``170,100 원`` to ``170100``."""
    return remove(remove(price, "' 원'"), "','")


# Fixed value: characters per call of the text service.
CHUNK_CHARS = 5000


def chunks(text: str, size: int = CHUNK_CHARS) -> str:
    """Cut the whole text into consecutive pieces; an empty text is one empty piece."""
    last = f"cast(greatest(ceil(length({text}) / {size}), 1) AS int) - 1"
    return each(f"sequence(0, {last})", lambda i: f"substr({text}, {i} * {size} + 1, {size})")


def map_chunks(text: str, make: Make, size: int = CHUNK_CHARS) -> str:
    """Apply an expression to every piece and join the results in order."""
    return f"array_join({each(chunks(text, size), make)}, '')"
