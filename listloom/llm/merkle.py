"""Merkle manifest of a dataset, with proofs made by pointer jumping.

Every row is a leaf.  The leaves of a group stand in order of their key; while more
than one node remains, every ``width`` consecutive ones become their hash (a last run
of fewer, even of one, likewise).  What remains is the group's subroot; subroots in
order of their groups make one more tree, whose top is the root of the dataset.

1. Leaves get their places from ranges of the order (no task sorts a whole group).
2. Digests climb by blocks of up to about a thousand nodes; each node learns the
   siblings of its run, which is its step towards the root.
3. A node's segment is the list of steps up to the ancestor it points at, at first its
   parent.  Each round joins nodes with themselves: a segment is followed by that of
   the ancestor, which doubles the distance, until every leaf points at the root.
   Nodes that no leaf can still point at are left out, so the tables joined with
   shrink quickly; few enough are broadcast, after their size was taken.

Every level and round is written to the shared folder, so a lost executor costs its
tasks.  A hot group is a larger tree, no larger task.

A proof is a list of steps (place among the run, digests of the others), from the leaf
up; :func:`fold` recomputes the root from a leaf and its proof.  ``H`` is the lower-case
hex SHA-256 of its inputs, digests counting as hex text.

Missing values are leaves' fields like others, written ``-``; rows without a group form
one, before all others; rows without a key come first in theirs; equal keys are ordered
by their leaf, and repeated rows are leaves each; empty and very long texts are hashed
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.llm.tables import fits_broadcast, stored
from listloom.operators.ranking import with_rank

WIDTH = 2
#: Nodes of a level hashed by one call.
BLOCK = 1024
#: Tree of the subroots.
TOP = -1
NODES = "tree long, level int, idx long, digest binary, height int"
STEP = "struct<place:int,others:binary>"


def leaf_digest(*values: Column) -> Column:
    """H of the values: ``-`` if missing, else byte count, ``:`` and value."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _height(leaves: Column, width: int) -> Column:
    """Levels above this many leaves."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= width
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < leaves)).cast("int")


def _span(width: int) -> int:
    """Levels a block climbs."""
    levels = 1
    while width ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def _climb_block(width: int) -> Callable:
    span = _span(width)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["idx"].to_pylist(), table["digest"].to_pylist()))
        tree, level, height = (table[c][0].as_py() for c in ("tree", "level", "height"))
        first, digests = rows[0][0], [d for _, d in rows]
        levels, indexes, held, places, others = [], [], [], [], []
        for up in range(min(span, height - level) + 1):
            last = up == min(span, height - level)
            above = []
            for low in range(0, len(digests), width):
                members = digests[low : low + width]
                for i, digest in enumerate(members):
                    levels.append(level + up)
                    indexes.append(first + low + i)
                    held.append(digest)
                    places.append(None if last else i)
                    others.append(None if last else b"".join(members[:i] + members[i + 1 :]))
                above.append(hashlib.sha256(b"".join(members).hex().encode()).digest())
            digests, first = above, first // width
        n = len(levels)
        return pa.table(
            {
                "tree": pa.array([tree] * n, pa.int64()), "level": pa.array(levels, pa.int32()), "idx": pa.array(indexes, pa.int64()),
                "digest": pa.array(held, pa.binary()), "height": pa.array([height] * n, pa.int32()),
                "place": pa.array(places, pa.int32()), "others": pa.array(others, pa.binary()),
            }
        )

    return run


def climb(leaves: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Nodes below the tops of all trees with their step, and the tops; ``leaves`` has the columns of ``NODES``."""
    span, now, found = _span(width), leaves, []
    rounds = -(-(leaves.agg(F.max("height")).first()[0] or 0) // span)
    tops = now.where("level = height")
    for _ in range(rounds):
        blocks = now.where("level < height").withColumn("block", F.expr(f"idx div {width**span}"))
        made = blocks.groupBy("tree", "block").applyInArrow(_climb_block(width), f"{NODES}, place int, others binary")
        made = stored(made, "nodes")
        found.append(made.where("place IS NOT NULL"))
        now = made.where("place IS NULL").drop("place", "others")
        tops = tops.union(now.where("level = height"))
    nodes = found[0] if found else leaves.limit(0).selectExpr("*", "cast(null AS int) AS place", "cast(null AS binary) AS others")
    for more in found[1:]:
        nodes = nodes.union(more)
    return nodes, tops


def _jump(nodes: DataFrame, distance: int) -> DataFrame:
    """One round: nodes point twice as far, those no leaf will point at next are gone."""
    ancestors = nodes.where(f"tree = {TOP} OR level % {2 * distance} = {distance}").select(
        F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"),
        F.struct(F.col("to_tree").alias("tree"), F.col("to_level").alias("level"), F.col("to_idx").alias("idx")).alias("next"),
        F.col("steps").alias("further"),
    )
    # A subroot may stand at any level of its own tree.
    tops = nodes.where(f"is_top AND level % {2 * distance} <> {distance}")
    ancestors = ancestors.union(
        tops.selectExpr("tree", "level", "idx", "struct(to_tree AS tree, to_level AS level, to_idx AS idx)", "steps")
    )
    if fits_broadcast(ancestors.select(F.to_json("further").alias("j"), "to_tree"), "j"):
        ancestors = F.broadcast(ancestors)
    stay = nodes.where(f"tree = {TOP} OR is_top OR level % {2 * distance} = 0")
    far = stay.join(ancestors, ["to_tree", "to_level", "to_idx"], "left")
    arrived = F.col("next").isNull()
    return far.select(
        "tree", "level", "idx", "is_top",
        *[F.when(~arrived, F.col(f"next.{c}")).alias(f"to_{c}") for c in ("tree", "level", "idx")],
        F.when(arrived, F.col("steps")).otherwise(F.concat("steps", "further")).alias("steps"),
    )


def proofs(rows: DataFrame, group: str, key: str, leaf: str = "leaf", width: int = WIDTH) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``proof``: array of (place, others) from the leaf to the root.

    ``leaf`` names the column of hex digests.  All other columns are carried along, so
    keep them narrow.
    """
    ranked = with_rank(rows.withColumn("_group", F.col(group)), ["_group"], [key, leaf], "_rank")
    groups = ranked.groupBy("_group").agg(F.count("*").alias("_n"))
    trees = stored(with_rank(groups, [], ["_group"], "_tree").withColumn("_tree", F.col("_tree") - 1), "trees")
    count = trees.count()
    small = fits_broadcast(trees, "_group")
    side = F.broadcast(trees) if small else trees
    same = F.col("r._group").eqNullSafe(F.col("t._group"))
    placed = ranked.alias("r").join(side.alias("t"), same).select(
        "r.*", F.col("t._tree").alias("tree"), F.expr("_rank - 1").alias("idx"), _height(F.col("t._n"), width).alias("height")
    )
    placed = stored(placed, "leaves")
    base = placed.select("tree", F.lit(0).alias("level"), "idx", F.unhex(leaf).alias("digest"), "height")
    nodes, subroots = climb(base, width)
    subroots = stored(subroots, "subroots")
    over = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "digest",
        _height(F.lit(count), width).alias("height"),
    )
    upper, top = climb(over, width)
    root = top.select("digest").first()

    def pointing(found: DataFrame, is_top: Column, *own: Column) -> DataFrame:
        # The top of a tree of groups is the root; that of a group goes on as leaf of that tree.
        step = F.array(F.struct("place", "others")).cast(f"array<{STEP}>")
        up = F.expr(f"idx div {width}")
        return found.select(
            *own, is_top.alias("is_top"), F.col("tree").alias("to_tree"), (F.col("level") + 1).cast("int").alias("to_level"),
            up.alias("to_idx"), step.alias("steps"), "height",
        )

    ids = [F.col("tree"), F.col("level"), F.col("idx")]
    lower = pointing(nodes, F.lit(False), *ids).drop("height")
    # A subroot keeps its name in its own tree and points into the tree above.
    heads = upper.where("level = 0").join(subroots.select(F.col("tree").alias("idx"), F.col("level").alias("own_level")), "idx")
    heads = pointing(heads, F.lit(True), F.col("idx").alias("tree"), F.col("own_level").alias("level"), F.lit(0).cast("long").alias("idx"))
    inner = pointing(upper.where("level > 0"), F.lit(False), *ids)
    now = stored(lower.union(heads.drop("height")).union(inner.drop("height")), "segments")
    deepest = (subroots.agg(F.max("height")).first()[0] or 0) + (over.agg(F.max("height")).first()[0] or 0)
    distance = 1
    while distance < deepest:
        now = stored(_jump(now, distance), "segments")
        distance *= 2
    done = now.where("level = 0 AND tree >= 0").select("tree", "idx", "steps")
    none = F.array().cast(f"array<{STEP}>")
    named = subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    named = F.broadcast(named) if small else named
    out = placed.join(done, ["tree", "idx"], "left").join(named, "tree")
    return out.select(
        *rows.columns,
        "subroot",
        F.lit(root["digest"].hex() if root else None).cast("string").alias("root"),
        F.coalesce("steps", none).alias("proof"),
    )


def fold(leaf: Column, proof: Column) -> Column:
    """Root that follows from a leaf and its proof."""

    def up(digest: Column, step: Column) -> Column:
        others, place = F.lower(F.hex(step["others"])), step["place"] * 64
        before, after = F.substring(others, F.lit(1), place), F.substring(others, place + 1, F.length(others))
        return F.sha2(F.concat(before, digest, after), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """H of the siblings, from the leaf up and from left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: F.lower(F.hex(step["others"])))), 256)


def manifest_report(docs: DataFrame, tampered: Column, claimed: Column) -> DataFrame:
    """Digest of the manifest of ``documents``: leaves, roots, proofs, and whether claimed leaves verify.

    ``claimed`` is the leaf shown for a row where ``tampered`` holds.
    """
    leaf = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, claimed).alias("claimed"))
    proved = proofs(rows, "lang", "doc_id")
    folded = proved.withColumn("folded_root", fold(F.coalesce("claimed", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
