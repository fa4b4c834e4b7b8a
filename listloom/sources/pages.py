"""Raw pages to element tables.

Tokenising HTML is the one thing Spark has no expression for, so it runs in an
Arrow-batched Python stage.  A page stays one row: its elements come back as an
array, and everything after that is Column expressions without a shuffle.
"""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from listloom.functions.sql import case, q
from listloom.functions.urls import to_json_url
from listloom.operators.bloom import KeyFilter
from listloom.operators.joins import MAX_BROADCAST, fits, small_side
from listloom.schemas import COMMENT, DOM_FIELDS, NODE, PIECE, RAW, TEXT

# The tokeniser travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, elements whose content is not page
# text, elements that keep blank runs, and the blanks that are folded.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
RAW_TAGS = frozenset(("script", "style", "template", "rt", "rp"))
VERBATIM_TAGS = frozenset(("pre", "textarea"))
BLANKS = " \n\t\x0c\r"

#: Pages and characters handed back to the JVM at once, and element shapes a task
#: remembers.
PAGES_PER_BATCH = 64
CHARS_PER_BATCH = 16_000_000
MAX_SHAPES = 10_000
#: Length of tags that are remembered as they are written.
MAX_TAG = 200

# Well-formed tags, the bulk of a page, are read by one match each; anything else
# goes the tolerant way of the standard library.
_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9-]*)((?:\s+[a-zA-Z_][\w:.-]*(?:="[^"]*")?)*)\s*(/?)>')
_ATTR = re.compile(r'\s([a-zA-Z_][\w:.-]*)(?:="([^"]*)")?(?=\s|$)')
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9-]*)>")

#: A tag, an id and classes; ``None`` and ``()`` match anything.
Shape = tuple[str | None, str | None, tuple[str, ...]]


@dataclass(frozen=True)
class Wanted:
    """What the active rules can look at; the rest of a page is not emitted.

    ``elements`` are kept, everything below ``subtrees`` is kept, text is kept
    inside ``texts``, and only ``attrs`` are carried.  ``None`` keeps all.
    """

    elements: frozenset[Shape] | None = None
    subtrees: frozenset[Shape] = frozenset()
    texts: frozenset[Shape] | None = None
    attrs: frozenset[str] | None = None


EVERYTHING = Wanted()


class _Shapes:
    """Membership test for a set of shapes, indexed by tag."""

    def __init__(self, shapes: Iterable[Shape] | None):
        self.all = shapes is None
        self.by_tag: dict[str | None, list[Shape]] = {}
        for shape in shapes or ():
            self.by_tag.setdefault(shape[0], []).append(shape)

    def __call__(self, tag: str, ident: str | None, classes: list[str]) -> bool:
        if self.all:
            return True
        for key in (tag, None):
            for _, want_id, want_classes in self.by_tag.get(key, ()):
                if want_id in (None, ident) and all(c in classes for c in want_classes):
                    return True
        return False


def _unescaped(value: str) -> str:
    """As :func:`html.unescape`; values with quotes only, such as JSON, take one replacement."""
    plain = value.replace("&quot;", '"')
    return unescape(value) if "&" in plain else plain


class _Tag:
    """A start or end tag as it is written, with what the rules say of it."""

    __slots__ = ("name", "ends", "closed", "attrs", "ident", "classes", "values", "kept", "below", "text")


class _Open:
    """An element that has not ended yet."""

    __slots__ = ("tag", "position", "children", "counts", "contents", "child_single", "below", "text", "raw", "verbatim")


class _PageReader(HTMLParser):
    """Turns one page into parallel lists of elements and text pieces."""

    def __init__(self, wanted: Wanted):
        super().__init__(convert_charrefs=True)
        self.keep = _Shapes(wanted.elements)
        self.keep_below = _Shapes(wanted.subtrees)
        self.keep_text = _Shapes(wanted.texts)
        self.keep_attrs = wanted.attrs
        self.decided: dict[tuple, tuple[bool, bool, bool]] = {}
        self.known: dict[str, _Tag] = {}

    def read(self, html: str) -> tuple[list[list], list[tuple[int, str]], str | None]:
        """Elements, pieces and error; of a broken page, what stands before the fault, with open elements ended there."""
        self.reset()
        self.rows: list[list] = []
        self.siblings: list[dict[str, int]] = []
        self.pieces: list[tuple[int, str]] = []
        self.pending: list[str] = []
        self.seen = 0
        self.path: list[int] = []
        self.stack: list[_Open] = []
        self.open_tags: dict[str, int] = {}
        self._push("", -1, False, self.keep_text.all, False, False)
        error = None
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError, RecursionError) as problem:
            error = f"{type(problem).__name__}: {problem}"
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        for row, counts in zip(self.rows, self.siblings):
            row[8] = counts[row[3]] - row[7] + 1
        return self.rows, self.pieces, error

    # --- element scopes -------------------------------------------------
    def _push(self, tag: str, position: int, below: bool, text: bool, raw: bool, verbatim: bool) -> None:
        scope = _Open()
        scope.tag, scope.position, scope.below, scope.text = tag, position, below, text
        scope.counts, scope.contents, scope.child_single = {}, 0, False
        scope.raw, scope.verbatim = raw or tag in RAW_TAGS, verbatim or tag in VERBATIM_TAGS
        self.stack.append(scope)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if position >= 0:
            self.path.append(position)

    def _pop(self) -> None:
        scope = self.stack.pop()
        self.open_tags[scope.tag] -= 1
        single = scope.contents == 1 and scope.child_single
        self.stack[-1].child_single = single
        if scope.position >= 0:
            self.path.pop()
            row = self.rows[scope.position]
            row[10], row[11] = len(self.pieces), single

    def handle_starttag(self, tag, attrs, closed=False):
        self._open(self._tag(tag, attrs, closed))

    def _tag(self, name: str, attrs: Sequence[tuple[str, str | None]], closed: bool, ends: bool = False) -> _Tag:
        tag = _Tag()
        tag.name, tag.attrs, tag.closed, tag.ends = name, attrs, closed or name in VOID_TAGS, ends
        if ends:
            return tag
        values = {key: value or "" for key, value in attrs} if attrs else {}
        tag.ident = values.pop("id", None)
        named = values.pop("class", "")
        tag.classes = named.split()
        tag.kept, tag.below, tag.text = self._decide(name, tag.ident, named, tag.classes)
        if values and self.keep_attrs is not None:
            values = {k: v for k, v in values.items() if k in self.keep_attrs}
        tag.values = values
        return tag

    def _open(self, tag: _Tag) -> None:
        if self.pending:
            self._flush()
        top = self.stack[-1]
        top.contents += 1
        name = tag.name
        nth = top.counts[name] = top.counts.get(name, 0) + 1
        position = -1
        if tag.kept or top.below:
            position = len(self.rows)
            at = len(self.pieces)
            self.rows.append(
                [self.seen, top.position, self.path.copy(), name, tag.ident, tag.classes, tag.values, nth, 0, at, at, False]
            )
            self.siblings.append(top.counts)
        self.seen += 1
        if tag.closed:
            top.child_single = False
        else:
            self._push(name, position, tag.below or top.below, tag.text or top.text, top.raw, top.verbatim)

    def _decide(self, tag: str, ident: str | None, named: str, classes: list[str]) -> tuple[bool, bool, bool]:
        """Keep the element, all below it, the text in it?  Pages repeat few shapes."""
        shape = (tag, ident, named)
        known = self.decided.get(shape)
        if known is None:
            below = self.keep_below(tag, ident, classes)
            known = (below or self.keep(tag, ident, classes), below, self.keep_text(tag, ident, classes))
            if len(self.decided) < MAX_SHAPES:
                self.decided[shape] = known
        return known

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def goahead(self, end):
        """Tags written as before are known by their text; others are read as the standard library does."""
        raw, i = self.rawdata, 0
        n, find, known = len(raw), raw.find, self.known
        while i < n:
            if self.cdata_elem is not None:
                found = self.interesting.search(raw, i)
                j = k = -1 if found is None else found.start()
                if j >= 0:
                    if i < j:
                        self.handle_data(raw[i:j])
                        i = j
                    k = self.parse_endtag(j)
                if k < 0:
                    break
                i = k
                continue
            j = find("<", i)
            stop = find(">", j) if j >= 0 else -1
            if stop < 0:
                break
            tag = known.get(raw[j : stop + 1]) or self._learn(raw, j, stop + 1)
            if i < j:
                text = raw[i:j]
                self.handle_data(unescape(text) if "&" in text else text)
                i = j
            if tag is not None:
                i = stop + 1
                if tag.ends:
                    self.handle_endtag(tag.name)
                else:
                    self._open(tag)
                    if tag.name in self.CDATA_CONTENT_ELEMENTS and not tag.closed:
                        self.set_cdata_mode(tag.name)
                continue
            k = self._other(raw, j)
            if k < 0:
                break
            i = k
        self.rawdata = raw[i:]
        if i < n:
            super().goahead(end)

    def _learn(self, raw: str, begin: int, end: int) -> _Tag | None:
        """A tag that is well-formed up to the first ``>``; none for anything else."""
        found = _START.match(raw, begin)
        if found is not None:
            if found.end() != end:
                return None
            name, given, slash = found.groups()
            tag = self._tag(name.lower(), self._attrs(given), bool(slash))
        else:
            found = _END.match(raw, begin)
            if found is None or found.end() != end:
                return None
            tag = self._tag(found.group(1).lower(), (), False, ends=True)
        if len(self.known) < MAX_SHAPES and end - begin <= MAX_TAG:
            self.known[raw[begin:end]] = tag
        return tag

    def _other(self, raw: str, i: int) -> int:
        """Where reading goes on after what is no well-formed tag; -1 leaves it to the standard loop."""
        if raw[i + 1 : i + 2].isalpha():
            return self.parse_starttag(i) if raw[i + 1].isascii() else -1
        if raw.startswith("</", i):
            return self.parse_endtag(i)
        if raw.startswith("<!--", i):
            return self.parse_comment(i)
        if raw.startswith("<?", i):
            return self.parse_pi(i)
        return self.parse_html_declaration(i) if raw.startswith("<!", i) else -1

    @staticmethod
    def _attrs(given: str) -> Sequence[tuple[str, str]]:
        if not given:
            return ()
        return [(name.lower(), _unescaped(value) if "&" in value else value) for name, value in _ATTR.findall(given)]

    def parse_starttag(self, i):
        found = _START.match(self.rawdata, i)
        if found is None:
            return super().parse_starttag(i)
        tag, given, slash = found.groups()
        tag, attrs = tag.lower(), self._attrs(given)
        if slash:
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return found.end()

    def parse_endtag(self, i):
        found = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if found is None:
            return super().parse_endtag(i)
        self.handle_endtag(found.group(1).lower())
        return found.end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        if tag in VOID_TAGS:
            return
        self._flush()
        if self.open_tags.get(tag):
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    # --- text -----------------------------------------------------------
    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()
        self._piece(COMMENT, data)

    def unknown_decl(self, data):
        self._flush()
        cdata = data.upper().startswith("CDATA[")
        self._piece(TEXT if cdata else COMMENT, data[6:] if cdata else data)

    def handle_decl(self, decl):
        self._flush()
        self._piece(COMMENT, decl)

    def handle_pi(self, data):
        self._flush()
        self._piece(COMMENT, data)

    def _flush(self) -> None:
        if self.pending:
            scope = self.stack[-1]
            if not scope.text:
                # Nobody reads it; only that it stands there counts.
                self.pending.clear()
                scope.contents += 1
                scope.child_single = True
                return
            text = "".join(self.pending)
            self.pending.clear()
            if not scope.verbatim and not text.strip(BLANKS):
                text = "\n" if "\n" in text else " "
            self._piece(RAW if scope.raw else TEXT, text)

    def _piece(self, kind: int, text: str) -> None:
        scope = self.stack[-1]
        scope.contents += 1
        scope.child_single = True
        if scope.text:
            self.pieces.append((kind, text))


def _list_array(offsets: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _struct(rows: list, schema: T.StructType, kinds: dict[str, pa.DataType]) -> pa.Array:
    """Rows of one struct type to an Arrow struct, built column by column."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    arrays, fields = [], []
    for name, values in zip(schema.names, columns):
        if isinstance(schema[name].dataType, T.MapType):
            values = [list(v.items()) for v in values]
        arrays.append(pa.array(values, kinds[name]))
        fields.append(pa.field(name, kinds[name], schema[name].nullable))
    return pa.StructArray.from_arrays(arrays, fields=fields)


def _arrow_kinds(schema: T.StructType) -> dict[str, pa.DataType]:
    return {f.name: to_arrow_type(f.dataType) for f in schema}


def _slices(html: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(start, pages) of runs that stay below both batch limits; a huge page goes alone."""
    start, run, chars = 0, [], 0
    for i, page in enumerate(html):
        text = page.as_py()
        if run and (len(run) == PAGES_PER_BATCH or chars + len(text or "") > CHARS_PER_BATCH):
            yield start, run
            start, run, chars = i, [], 0
        run.append(text)
        chars += len(text or "")
    if run:
        yield start, run


def _read(reader: _PageReader | None, html: str | None) -> tuple[list[list], list[tuple[int, str]], str | None]:
    """Elements, pieces and error of a page; a broken one does not fail the job."""
    return ([], [], None) if reader is None or not html else reader.read(html)


def _dom_stage(html_column: str, wanted: Wanted | dict[str, Wanted], by: str):
    """The function given to ``mapInArrow``: replaces the HTML column by the DOM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pages become many small lists without cycles; looking for cycles among them takes a fifth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield from read(batches)
        finally:
            if collecting:
                gc.enable()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_site = isinstance(wanted, dict)
        readers = {site: _PageReader(w) for site, w in wanted.items()} if per_site else {None: _PageReader(wanted)}
        node_kinds, piece_kinds = _arrow_kinds(NODE), _arrow_kinds(PIECE)
        for whole in batches:
            kept = [name for name in whole.schema.names if name != html_column]
            sites = whole.column(by).to_pylist() if per_site else [None] * whole.num_rows
            for start, texts in _slices(whole.column(html_column)):
                nodes, pieces, node_ends, piece_ends, errors = [], [], [0], [0], []
                for site, html in zip(sites[start:], texts):
                    page_nodes, page_pieces, error = _read(readers.get(site), html)
                    nodes += page_nodes
                    pieces += page_pieces
                    node_ends.append(len(nodes))
                    piece_ends.append(len(pieces))
                    errors.append(error)
                arrays = [whole.column(name).slice(start, len(texts)) for name in kept] + [
                    _list_array(node_ends, _struct(nodes, NODE, node_kinds)),
                    _list_array(piece_ends, _struct(pieces, PIECE, piece_kinds)),
                    pa.array(errors, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + [f.name for f in DOM_FIELDS])

    return run


def parse_pages(
    pages: DataFrame, html_column: str = "html", wanted: Wanted | dict[str, Wanted] = EVERYTHING, by: str = "site"
) -> DataFrame:
    """Replace the HTML column of a page table by ``nodes``, ``pieces``, ``parse_error``.

    One row in, one row out, no shuffle.  Select the columns you need first: the
    others travel through the Python stage unchanged.  With one ``Wanted`` per
    value of the column ``by``, each page yields what its own shop can look at, and
    a page of another shop stays unread and empty.
    """
    kept = [f for f in pages.schema.fields if f.name != html_column]
    schema = T.StructType(kept + DOM_FIELDS)
    return pages.mapInArrow(_dom_stage(html_column, wanted, by), schema)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan that has fewer splits than the session has cores.

    A large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def explode_nodes(parsed: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per element with the key columns of its page."""
    return parsed.select(*keys, F.inline("nodes"))


#: Shops whose JSON is found under an endpoint of its own.
JSON_URLS = {"Lacoste": to_json_url}


def choose_document(
    urls: DataFrame,
    capabilities: DataFrame,
    json_pages: DataFrame,
    rendered_pages: DataFrame,
    raw_pages: DataFrame,
    json_urls: Mapping[str, Callable[[str], str]] = JSON_URLS,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """Attach to every (site, url) the document its site is read from.

    A site with a JSON endpoint is read as JSON, else rendered HTML if it needs
    rendering, else raw HTML.  ``capabilities(site, json, rendered)`` decides; a
    site without a row is raw.  JSON is looked up by the shop's endpoint, which
    ``json_urls`` makes from the product URL.  The three page tables ``(url, body)``
    form one tagged table, first reduced to what is asked for, so that other bodies
    stay where they are: by a broadcast of the asked keys, or, beyond ``max_broadcast``
    of them, by a filter of a few bytes a key ahead of the shuffle.  Of a page stored several times the longest body counts, of
    equally long ones the greatest: one document for each asked row.
    """
    flags = capabilities.select("site", F.col("json").alias("_json"), F.col("rendered").alias("_rendered"))
    kind = F.when(F.col("_json"), "json").when(F.col("_rendered"), "rendered").otherwise("raw")
    asked = urls.join(small_side(flags), "site", "left").withColumn("kind", kind).drop("_json", "_rendered")
    json_url = case([(f"site = {q(name)}", to_url("url")) for name, to_url in json_urls.items()], "url")
    asked = asked.withColumn("_key", F.expr(f"if(kind = 'json', {json_url}, url)"))
    stored = (
        json_pages.select(F.col("url").alias("_key"), F.lit("json").alias("kind"), "body")
        .unionByName(rendered_pages.select(F.col("url").alias("_key"), F.lit("rendered").alias("kind"), "body"))
        .unionByName(raw_pages.select(F.col("url").alias("_key"), F.lit("raw").alias("kind"), "body"))
    )
    wanted = asked.select("_key", "kind").distinct()
    if fits(wanted, max_broadcast):
        wanted = F.broadcast(wanted)
    else:
        stored = KeyFilter(wanted, "_key", "kind").passing(stored)
    longest = F.max(F.struct(F.length("body").alias("chars"), "body"))
    one = stored.join(wanted, ["_key", "kind"], "left_semi").groupBy("_key", "kind").agg(longest.alias("_page"))
    return asked.join(one.select("_key", "kind", F.col("_page.body").alias("body")), ["_key", "kind"], "left").drop("_key")
