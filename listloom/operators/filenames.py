"""Names for downloaded images that never collide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listloom.functions.sql import q
from listloom.functions.urls import file_extension, file_stem
from listloom.operators.ranking import with_rank

NUMBERED = r"^(.*) \((\d+)\)(\.[^.]*)?$"
#: Numbers covered by one list of intervals.
CHUNK = 4096


def _taken_lists(taken: DataFrame) -> DataFrame:
    """Interval lists of each name: ``_ends``, for a chunk of numbers, by how many free ones lie below it.

    An entry (free numbers below, numbers taken by then) stands for a taken number and
    ends an interval of free ones.  ``_below`` is how many free numbers lie below the
    first entry; a list holds as many entries as a chunk has numbers, at most.
    """
    chunks = taken.groupBy("_name", F.expr(f"_number div {CHUNK}").alias("_chunk")).agg(
        F.array_sort(F.collect_set("_number")).alias("_numbers")
    )
    before = Window.partitionBy("_name").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = chunks.withColumn("_before", F.coalesce(F.sum(F.size("_numbers")).over(before), F.lit(0)))
    ends = "transform(_numbers, (x, i) -> struct(x - _before - i - 1 AS _free, _before + i + 1 AS _used))"
    return counted.selectExpr("_name", "_chunk", f"{ends} AS _ends").withColumn("_below", F.expr("_ends[0]._free"))


def _search(entries: str, field: str, rank: str) -> str:
    """How many of the ordered ``entries`` lie below ``rank``, by halving steps."""
    steps = "transform(sequence(62, 0), i -> shiftleft(1L, i))"
    return (
        f"cast(aggregate(filter({steps}, s -> s <= size({entries})), 0L, (n, step) -> "
        f"if(n + step <= size({entries}) AND get({entries}, cast(n + step - 1 AS int)).{field} < {rank}, n + step, n)) AS int)"
    )


def unique_file_names(images: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``file_name`` = ``stem (k).ext`` with the smallest free ``k``, in order of ``pos``.

    ``images(dir, pos, url)`` and ``existing(dir, file_name)``.  The r-th new file
    of a name takes the r-th number not taken yet, gaps first.  A link without an
    extension gets the one of an optional ``sniffed_extension`` column, else an
    empty name.  Many images may share one name: ranks come from ranges of the
    order, and free numbers from interval lists of bounded length, found and searched
    by halving.
    """
    sniffed = "sniffed_extension" if "sniffed_extension" in images.columns else "CAST(NULL AS STRING)"
    named = images.selectExpr(
        "*",
        f"{file_stem('url')} AS _stem",
        f"if({file_extension('url')} <> '', {file_extension('url')}, concat('.', {sniffed})) AS _found_ext",
    ).selectExpr("*", "coalesce(_found_ext, '') AS _ext").drop("_found_ext")
    # A name is one struct, so files without a folder share one too.
    named = named.withColumn("_name", F.struct("dir", "_stem", "_ext"))
    ranked = with_rank(named, ["_name"], ["pos"], "_rank")
    taken = existing.selectExpr(
        f"struct(dir, regexp_extract(file_name, {q(NUMBERED)}, 1) AS _stem, "
        f"regexp_extract(file_name, {q(NUMBERED)}, 3) AS _ext) AS _name",
        f"try_cast(regexp_extract(file_name, {q(NUMBERED)}, 2) AS bigint) AS _number",
    ).where("_number > 0")
    lists = _taken_lists(taken)
    index = lists.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("_below", "_chunk"))).alias("_index"))
    # The chunk whose entries part the numbers around the r-th free one, then the place in it.
    chunk = f"get(_index, {_search('_index', '_below', '_rank')} - 1)._chunk"
    placed = ranked.join(index, "_name", "left").withColumn("_chunk", F.expr(chunk)).drop("_index")
    found = placed.join(lists.drop("_below"), ["_name", "_chunk"], "left")
    used = f"coalesce(get(_ends, {_search('_ends', '_free', '_rank')} - 1)._used, 0)"
    return found.selectExpr(
        *images.columns, f"if(_ext = '', '', concat(_stem, ' (', _rank + {used}, ')', _ext)) AS file_name"
    )
