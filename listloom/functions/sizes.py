"""Shoe-size expressions: cleaning, audience detection, conversion, quantity labels."""

from __future__ import annotations

from listloom.functions.sql import case, each, keep, q, some
from listloom.functions.text import parses_as_number, piece, remove, strip, swap, to_number

# Foot length in mm by US shoe size, as number or as text.
SIZES = {
    "mens": {
        3.5: 215,
        4.0: 220,
        4.5: 225,
        5.0: 230,
        5.5: 235,
        6.0: 240,
        6.5: 245,
        7.0: 250,
        7.5: 255,
        8.0: 260,
        8.5: 265,
        9.0: 270,
        9.5: 275,
        10.0: 280,
        10.5: 285,
        11.0: 290,
        11.5: 295,
        12.0: 300,
        12.5: 305,
        13.0: 310,
        13.5: 315,
        14.0: 320,
        15.0: 330,
    },
    "womens": {
        5.0: 220,
        5.5: 225,
        6.0: 230,
        6.5: 235,
        7.0: 240,
        7.5: 245,
        8.0: 250,
        8.5: 255,
        9.0: 260,
        9.5: 265,
        10.0: 270,
        10.5: 275,
        11.0: 280,
        11.5: 285,
        12.0: 290,
        12.5: 295,
        13.0: 300,
        13.5: 305,
        14.0: 310,
        15.0: 320,
        16.0: 330,
    },
    "kids": {
        7.0: 130,
        7.5: 135,
        8.0: 140,
        8.5: 145,
        9.0: 150,
        9.5: 155,
        10.0: 160,
        10.5: 165,
        11.0: 170,
        11.5: 175,
        12.0: 180,
        12.5: 185,
        13.0: 190,
        13.5: 195,
        1.0: 200,
        1.5: 205,
        2.0: 210,
        2.5: 215,
        3.0: 220,
        3.5: 225,
        4.0: 230,
        4.5: 235,
        5.0: 240,
        5.5: 245,
        6.0: 250,
    },
    "kids_with_k": {
        "7K": 130,
        "7.5K": 135,
        "8K": 140,
        "8.5K": 145,
        "9K": 150,
        "9.5K": 155,
        "10K": 160,
        "10.5K": 165,
        "11K": 170,
        "11.5K": 175,
        "12K": 180,
        "12.5K": 185,
        "13K": 190,
        "13.5K": 195,
        "1": 200,
        "1.5": 205,
        "2": 210,
        "2.5": 215,
        "3": 220,
        "3.5": 225,
        "4": 230,
        "4.5": 235,
        "5": 240,
        "5.5": 245,
        "6": 250,
    },
    "kids_with_front_k": {
        "K7": 130,
        "K7.5": 135,
        "K8": 140,
        "K8.5": 145,
        "K9": 150,
        "K9.5": 155,
        "K10": 160,
        "K10.5": 165,
        "K11": 170,
        "K11.5": 175,
        "K12": 180,
        "K12.5": 185,
        "K13": 190,
        "K13.5": 195,
        "1": 200,
        "1.5": 205,
        "2": 210,
        "2.5": 215,
        "3": 220,
        "3.5": 225,
        "4": 230,
        "4.5": 235,
        "5": 240,
        "5.5": 245,
        "6": 250,
    },
    "kids_complete": {
        "1.0K": 70,
        "2.0K": 80,
        "3.0K": 90,
        "4.0K": 100,
        "5.0K": 110,
        "5.5K": 115,
        "6.0K": 120,
        "6.5K": 125,
        "7.0K": 130,
        "7.5K": 135,
        "8.0K": 140,
        "8.5K": 145,
        "9.0K": 150,
        "9.5K": 155,
        "10.0K": 160,
        "10.5K": 165,
        "11.0K": 170,
        "11.5K": 175,
        "12.0K": 180,
        "12.5K": 185,
        "13.0K": 190,
        "13.5K": 195,
        "1.0": 200,
        "1.5": 205,
        "2.0": 210,
        "2.5": 215,
        "3.0": 220,
        "3.5": 225,
        "4.0": 230,
        "4.5": 235,
        "5.0": 240,
        "5.5": 245,
        "6.0": 250,
        "6.5": 255,
        "7.0": 260,
    },
}
# Groups looked up by number; the others are looked up by text.
NUMERIC_GROUPS = ("mens", "womens", "kids")


def size_rows() -> list[tuple[str, str, float, int]]:
    """(group, key text, key number, mm) of every known size."""
    return [
        (group, f"{key:g}" if group in NUMERIC_GROUPS else key, float(str(key).strip("K")), mm)
        for group, sizes in SIZES.items()
        for key, mm in sizes.items()
    ]


def _table(group: str) -> str:
    numeric = group in NUMERIC_GROUPS
    pairs = [f"{f'{us}D' if numeric else q(key)}, '{mm}'" for g, key, us, mm in size_rows() if g == group]
    return f"map({', '.join(pairs)})"


def any_unparsable(sizes: str) -> str:
    return some(sizes, lambda s: f"NOT {parses_as_number(s)}")


def convert_sizes(sizes: str, group: str) -> str:
    """US sizes to mm texts, in order.

    Unknown sizes are dropped.  In a numeric group one size that is no number
    returns the whole list unchanged; text groups never fail.  The table is a
    constant map, so no join and no shuffle are needed.
    """
    numeric = group in NUMERIC_GROUPS
    looked_up = each(sizes, lambda s: f"try_element_at({_table(group)}, {to_number(s) if numeric else s})")
    found = keep(looked_up, lambda mm: f"{mm} IS NOT NULL")
    return f"if({any_unparsable(sizes)}, {sizes}, {found})" if numeric else found


# Numbers of the size types.
MEN, WOMEN, KIDS, UNCHANGED, AUTO = 1, 2, 3, 4, 5


def resolve_size_type(size_type: str, audience: str) -> str:
    """Type 5 becomes 1, 2 or 3 from the page; everything unclear counts as men."""
    found = case([(f"{audience} = 'women'", str(WOMEN)), (f"{audience} = 'kids'", str(KIDS))], str(MEN))
    return f"if({size_type} = {AUTO}, {found}, {size_type})"


def audience_of(text: str) -> str:
    """Audience named in a size chooser; women is tested before men."""

    def names(*words: str) -> str:
        return "(" + " OR ".join(f"contains(lower({text}), {q(w)})" for w in words) + ")"

    return case(
        [
            (names("women", "woman"), "'women'"),
            (names("men", "man"), "'men'"),
            (names("unisex"), "'unisex'"),
            (names("big", "little", "infant", "toddler"), "'kids'"),
        ],
        "''",
    )


def first_of_pair(size: str) -> str:
    """``M 6.5 / W 7.5`` to ``6.5``; other sizes are kept."""
    left = strip(remove(piece(size, "/", 0), "'M'"))
    return f"if(contains({size}, '/'), {left}, {size})"


def without_mm(size: str) -> str:
    return remove(size, "'MM'")


def bracketed_size(size: str) -> str:
    """``085(WS)`` to ``여성S``; other sizes are kept."""
    inner = swap(remove(piece(size, "(", 1), "')'"), "W", "여성")
    return f"if(contains({size}, '('), {inner}, {size})"


def quantity_labels(sizes: str) -> str:
    """11, 22, … 99, then 10, 11, 12 …; one label per size."""
    numbers = f"sequence(1, greatest(size({sizes}), 1))"
    labels = each(numbers, lambda i: f"if({i} <= 9, {i} * 11, {i})")
    return f"if(size({sizes}) > 0, {labels}, cast(array() AS array<int>))"


def without(sizes: str, sold_out: str) -> str:
    """Sizes not in the sold-out list; duplicates are kept."""
    return keep(sizes, lambda s: f"NOT array_contains({sold_out}, {s})")
