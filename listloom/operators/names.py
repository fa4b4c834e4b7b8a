"""Free-text shop names to official names and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.functions.sql import case, keep, let, q
from listloom.operators.joins import small_side
from listloom.session import work_dir
from listloom.sources.dims import alias_array, host_map


def _candidates(aliases: str, name: str) -> str:
    """ARRAY of alias rows a name may mean when it is no exact Korean name.

    Names without lower-case letters (Hangul, digits) match when every character
    occurs in the Korean name, in any order; others when they are part of the
    squashed official name or share a word with it.
    """
    squashed = f"replace(lower({name}), ' ', '')"
    read = (
        f"named_struct('n', {squashed}, 'words', split(lower({name}), ' ', -1), "
        f"'letters', array_distinct(filter(split({squashed}, ''), ch -> ch <> '')))"
    )

    def match(typed: str) -> str:
        korean = keep(aliases, lambda a: f"forall({typed}.letters, ch -> contains({a}.ko_name, ch))")
        english = keep(
            aliases, lambda a: f"contains({a}.squashed, {typed}.n) OR arrays_overlap({typed}.words, {a}.words)"
        )
        return case(
            [
                (f"{typed}.n RLIKE {q(r'\p{IsLowercase}')}", english),
                (f"length({typed}.n) < 2", f"slice({aliases}, 1, 0)"),
            ],
            korean,
        )

    return let(read, match)


def with_site_name(df: DataFrame, name: str, aliases: DataFrame | None = None) -> DataFrame:
    """Add ``site_official`` ('' when unknown or ambiguous) and ``match_count``.

    The built-in alias dimension is a constant of 44 rows inside the expression, so the
    theta match is a narrow filter: no join, no grouping, no shuffle.  Other
    ``aliases(ko_name, site_official)`` may have any size and are searched by postings,
    see :func:`resolved_names`.
    """
    if aliases is not None:
        found = _stored(resolved_names(df.select(F.col(name).alias("_typed")), aliases), "named")
        joined = df.join(small_side(found), df[name] == found["_typed"], "left")
        return joined.select(
            *[df[c] for c in df.columns],
            F.coalesce("site_official", F.lit("")).alias("site_official"),
            F.coalesce("match_count", F.lit(0)).alias("match_count"),
        )
    aliases_ = alias_array()
    exact = keep(aliases_, lambda a: f"{a}.ko_name = {name}")
    found = let(exact, lambda hits: f"if(size({hits}) > 0, {hits}, {_candidates(aliases_, name)})")
    return df.selectExpr("*", f"{found} AS _found").selectExpr(
        *df.columns,
        "if(size(_found) = 1, get(_found, 0).site_official, '') AS site_official",
        "size(_found) AS match_count",
    )


#: Names are indexed by pieces of this length and of its doubles; shorter names are looked up whole.
GRAM = 3


def _piece_size(text: str) -> str:
    """Length of the pieces a text is looked up by: the largest indexed one that fits it."""
    return f"if(length({text}) < {GRAM}, length({text}), {GRAM} * shiftleft(1, length(bin(length({text}) div {GRAM})) - 1))"


def _pieces(text: str, sizes: str) -> str:
    """Hashes of the distinct pieces of a text with one of the lengths (an array expression)."""
    of_size = f"transform(sequence(1, length({text}) - _size + 1), _at -> xxhash64(substring({text}, _at, _size)))"
    none = "cast(array() AS array<bigint>)"
    return f"array_distinct(flatten(transform({sizes}, _size -> if(length({text}) < _size, {none}, {of_size}))))"


LETTERS = "array_sort(array_distinct(filter(split({text}, ''), ch -> ch <> '')))"


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _by_rarest(asked: DataFrame, name: str, keys: str, postings: DataFrame) -> DataFrame:
    """(name, id) of what holds the rarest of the keys a name must have; none if one occurs nowhere."""
    often = postings.groupBy("key").agg(F.count("*").alias("often"))
    each = asked.select(name, F.explode(F.expr(keys)).alias("key")).join(often, "key", "left")
    rarest = each.groupBy(name).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key")).alias("least"))
    return rarest.select(name, "least.key").join(postings, "key").select(name, "id")


def _summed(matches: DataFrame, key: str) -> DataFrame:
    return matches.groupBy(key).agg(F.sum("hits").alias("hits"), F.min("site_official").alias("site_official"))


def _korean_matches(rest: DataFrame, known: DataFrame) -> DataFrame:
    """(_typed, hits, site_official) of names all whose characters occur in a Korean name.

    Only the set of characters counts, so equal sets are compared once, however many
    names and aliases share them.
    """
    held = known.groupBy(F.expr(LETTERS.format(text="ko_name")).alias("held")).agg(
        F.count("*").alias("hits"), F.min("site_official").alias("site_official")
    )
    sets = _stored(held.withColumn("id", F.monotonically_increasing_id()), "letters")
    needing = rest.where("NOT latin AND length(n) >= 2").select("_typed", F.expr(LETTERS.format(text="n")).alias("needed"))
    wanted = needing.select("needed").distinct()
    candidates = _by_rarest(wanted, "needed", "needed", sets.select(F.explode("held").alias("key"), "id"))
    fitting = candidates.join(sets, "id").where("forall(needed, ch -> array_contains(held, ch))")
    return needing.join(_summed(fitting, "needed"), "needed").select("_typed", "hits", "site_official")


def _latin_matches(rest: DataFrame, known: DataFrame) -> DataFrame:
    """(_typed, hits, site_official) of names that are part of an official name or share a word with it."""
    latin = rest.where("latin")
    # At most one length for each doubling.
    sizes = sorted(r["size"] for r in latin.select(F.expr(_piece_size("n")).alias("size")).distinct().collect())
    listed = f"cast(array({', '.join(map(str, sizes))}) AS array<int>)"
    pieces = known.select(F.explode(F.expr(_pieces("squashed", listed))).alias("key"), "id")
    parts = _by_rarest(latin, "_typed", _pieces("n", f"array({_piece_size('n')})"), pieces)
    words = known.select(F.explode(F.array_distinct("own_words")).alias("word"), "id")
    # A single word that is a word of an official name is also part of it.
    asked = latin.where("size(words) > 1").select("_typed", F.explode(F.array_distinct("words")).alias("word"))
    overlap = asked.join(words, "word").select("_typed", "id")
    candidates = parts.union(overlap).distinct().join(known.drop("ko_name"), "id").join(latin, "_typed")
    fitting = candidates.where("contains(squashed, n) OR arrays_overlap(words, own_words)")
    return _summed(fitting.select("_typed", F.lit(1).alias("hits"), "site_official"), "_typed")


def resolved_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(_typed, site_official, match_count) of the distinct ``names(_typed)``, over aliases of any number.

    Aliases are indexed once: by Korean name, by its set of characters, by words, and by
    pieces of the squashed official name, ``GRAM`` letters long, twice that, and so on.
    Where all of several keys must occur, a name takes the postings of its rarest one;
    where it must occur as a part, those of its rarest piece, which is longer than half
    the name.  Only these candidates are checked, so no name meets all aliases, and long
    names meet few others.  Names that match nothing are left out.
    """
    numbered = aliases.where("ko_name IS NOT NULL AND site_official IS NOT NULL").select("ko_name", "site_official")
    known = _stored(
        numbered.withColumn("id", F.monotonically_increasing_id()).selectExpr(
            "*", "replace(lower(site_official), ' ', '') AS squashed", "split(lower(site_official), ' ', -1) AS own_words"
        ),
        "aliases",
    )
    typed = names.where("_typed IS NOT NULL").distinct().selectExpr(
        "_typed", "replace(lower(_typed), ' ', '') AS n", "split(lower(_typed), ' ', -1) AS words",
        f"replace(lower(_typed), ' ', '') RLIKE {q(r'\p{IsLowercase}')} AS latin",
    )
    exact = typed.join(known, F.col("ko_name") == F.col("_typed")).select("_typed", F.lit(1).alias("hits"), "site_official")
    exact = _stored(_summed(exact, "_typed"), "exact")
    rest = _stored(typed.join(exact.select("_typed"), "_typed", "left_anti"), "typed")
    matches = exact.unionByName(_korean_matches(rest, known)).unionByName(_latin_matches(rest, known))
    return matches.selectExpr("_typed", "if(hits = 1, site_official, '') AS site_official", "cast(hits AS int) AS match_count")


def with_site_host(df: DataFrame, site: str) -> DataFrame:
    """Add ``host`` (null when unknown) and ``host_or_name`` (the given text then)."""
    host = f"try_element_at({host_map()}, {site})"
    return df.selectExpr("*", f"{host} AS host", f"coalesce({host}, {site}) AS host_or_name")
