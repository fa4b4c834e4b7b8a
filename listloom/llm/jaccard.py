"""Exact Jaccard join of documents on word n-grams, as T-occurrence search in blocks.

1. Each text becomes its set of shingle hashes; equal sets are one class, and only one
   text of a class goes on.
2. These texts are dealt into slices of bounded size.  Slices send their distinct
   shingles, packed by range of hash, and get back in how many classes each occurs.
   A shingle of one class cannot match: it counts in the size of its set, but does not
   travel.  A set that is left with fewer shingles than a link needs links with nothing.
3. Of the other sets the prefix is indexed: the rarest shingles, so many that two sets
   similar enough must share one.  Sets that share one and whose sizes are within the
   bound are candidates; their connected components are closed under linking, so whole
   sets meet only within a component.
4. Components are dealt into blocks of bounded size.  One larger than ``BLOCK``
   shingles is cut into chunks.  First every chunk meets the first one, which links the
   copies of one text; then only what is not in the largest group so far meets all.
5. In a block each set searches the smaller ones: of its inverted lists the longest
   T - 1 are set aside, the others merged, and who stands in them is looked up in the
   long ones by binary search (DivideSkip), until it is linked to every component.
   A pair links when its overlap reaches T, checked in whole numbers.

A class has one row in a block whatever its number of copies, and a block returns a
forest, never all pairs.

Missing and empty texts have no shingles, link with nothing and stand for themselves;
shorter texts are one shingle; very long ones make a slice of their own; equal ids and
repeated rows are told apart by row; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.llm.components import components
from listloom.llm.packed import NOTE, NOTES, SENT, answer, distinct, marks, sent
from listloom.llm.tables import numbered, stored
from listloom.llm.words import mix, slices, split_words, starts_window, texts_of, windows

TEXT_BITS = 12
SHIFT = np.uint64(64 - TEXT_BITS)
SLICE_BYTES, SLICE_TEXTS = 4 << 20, 1 << TEXT_BITS
#: Slices that share a bucket of counts, and buckets of small inputs.
COUNT_SHARE, BUCKETS = 16, 32
#: Shingles in a block.
BLOCK = 2_000_000
#: Entries of short lists above which a set first tries a few of the last ones.
FEW = 64
#: Look-ups made at a time.
PROBES = 1 << 20


class Sets:
    """Distinct shingles of each text: those of text i are ``values[ends[i]:ends[i + 1]]``, sorted.

    A shingle is known by ``64 - TEXT_BITS`` bits of its hash, so that one sort of plain
    numbers, with the text in the upper bits, orders a slice.
    """

    def __init__(self, column: pa.Array, n: int):
        hashes, text, texts = shingles(column, n)
        keys = np.sort((text.astype(np.uint64) << SHIFT) | (hashes >> np.uint64(TEXT_BITS)))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        keys = keys[fresh]
        self.text = (keys >> SHIFT).astype(np.int64)
        self.values = keys & ((np.uint64(1) << SHIFT) - np.uint64(1))
        self.sizes = np.bincount(self.text, minlength=texts)
        self.ends = np.concatenate(([0], np.cumsum(self.sizes)))


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and text of every shingle, and the number of texts."""
    words = split_words(texts_of(column), lower=True)
    counts = words.counts
    inside = np.flatnonzero(starts_window(words, n))
    hashes, text = windows(words.hashes, n)[inside], words.text[inside] if len(words) else inside
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = np.array([_whole(words.hashes[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
    return np.concatenate((hashes, whole)), np.concatenate((text, short)), len(counts)


def _whole(hashes: np.ndarray) -> int:
    return int(mix(windows(hashes, len(hashes)) + np.uint64(len(hashes)))[0])


def required(size: np.ndarray | int, percent: int):
    """Least overlap of a set of this size with a similar one."""
    return (percent * size + 99) // 100


def _describe(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES, SLICE_TEXTS):
                part = batch.slice(low, high - low)
                sets = Sets(part.column(1), n)
                keys = []
                for salt in (0x51ED270B, 0x2545F491):
                    total = np.concatenate(([0], np.cumsum(mix(sets.values + np.uint64(salt)), dtype=np.uint64))).astype(np.uint64)
                    keys.append((total[sets.ends[1:]] - total[sets.ends[:-1]]).view(np.int64))
                columns = [part.column(0), part.column(2), pa.array(sets.sizes), *map(pa.array, keys)]
                yield pa.record_batch(columns, ["row", "id", "n", "k0", "k1"])

    return run


# --- Counts of shingles ---------------------------------------------------------------


MARKS, NODES = 0, 1


def _pack_nodes(key: tuple, table: pa.Table) -> pa.Table:
    """The classes' rows that a slice holds, as one note."""
    nodes = np.sort(table["node"].to_numpy())
    return pa.table({"p": [key[0].as_py()], "kind": [NODES], "b": [0], "body": [nodes.tobytes()]}, NOTES)


def _of_classes(docs: pa.Table, notes: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a slice that stand for classes, with their shingles and where these begin."""
    bodies = notes.filter(pc.equal(notes["kind"], NODES))["body"].to_pylist()
    nodes = np.frombuffer(b"".join(bodies), np.int64)
    docs = docs.filter(pa.array(np.isin(docs["row"].to_numpy(), nodes))).sort_by("row").combine_chunks()
    column = docs["text"].combine_chunks() if isinstance(docs["text"], pa.ChunkedArray) else docs["text"]
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in slices(column, SLICE_BYTES, SLICE_TEXTS):
        sets = Sets(column.slice(low, high - low), n)
        values.append(sets.values)
        sizes.append(sets.sizes)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    return docs["row"].to_numpy(), np.concatenate(values), ends


def _send_counts(n: int, buckets: int) -> Callable:
    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        (known,), times, _ = distinct(_of_classes(docs, notes, n)[1])
        return sent(key[0].as_py(), known, times, buckets, TEXT_BITS)

    return run


SURVIVORS = "node long, n long, tokens array<long>, shingles array<long>"


def _survivors(n: int, percent: int, buckets: int) -> Callable:
    """Sets that may link: their size, the prefix by rarity, and all shingles that other classes hold too."""

    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        nodes, values, ends = _of_classes(docs, notes, n)
        (known,), _, which = distinct(values)
        mark = marks(notes, MARKS, known, buckets, TEXT_BITS)[which]
        owner, sizes = np.repeat(np.arange(len(nodes)), np.diff(ends)), np.diff(ends)
        held = np.bincount(owner[mark > 0], minlength=len(nodes))
        need = required(sizes, percent)
        stays = (held >= need) & (sizes > 0)
        entry = np.flatnonzero((mark > 0) & stays[owner])
        order = entry[np.lexsort((values[entry], mark[entry], owner[entry]))]
        counts = held[stays]
        first = np.repeat(np.cumsum(counts) - counts, counts)
        prefix = counts - need[stays] + 1
        token = values[order][np.arange(len(order)) - first < np.repeat(prefix, counts)].view(np.int64)
        lists = [
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(c))), pa.int32()), pa.array(v))
            for c, v in ((prefix, token), (counts, values[entry].view(np.int64)))
        ]
        return pa.table({"node": nodes[stays], "n": sizes[stays], "tokens": lists[0], "shingles": lists[1]})

    return run


def survivors(rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Sets of the classes that may link with another, see ``SURVIVORS``; ``rows`` has (row, text)."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // SLICE_BYTES))
    buckets = max(min(count, BUCKETS), count // COUNT_SHARE)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(count)).alias("p")
    dealt = rows.select("row", "text", part("row")).groupBy("p")
    packed = classes.select("node", part("node")).groupBy("p").applyInArrow(_pack_nodes, NOTE)
    counted = dealt.cogroup(packed.groupBy("p")).applyInArrow(_send_counts(n, buckets), SENT)
    notes = packed.union(counted.groupBy("b").applyInArrow(answer(MARKS), NOTE))
    return dealt.cogroup(notes.groupBy("p")).applyInArrow(_survivors(n, percent, buckets), SURVIVORS)


def search(nodes: np.ndarray, values: np.ndarray, counts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Component label of each set of a block: the place of its first member in order of size.

    Of a set with ``sizes`` shingles, the ``counts`` that other classes may hold are given.
    """
    m = len(nodes)
    label = np.arange(m)
    ends = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(m), counts)
    order = np.argsort(values, kind="stable")
    lists, holders = values[order], owner[order]
    head = np.ones(len(order), bool)
    head[1:] = lists[1:] != lists[:-1]
    starts = np.flatnonzero(head)
    # Of each entry: where its list begins, and how many smaller sets stand in it before.
    begin = np.empty(len(order), np.int64)
    begin[order] = starts[np.cumsum(head) - 1]
    before = np.empty(len(order), np.int64)
    before[order] = np.arange(len(order)) - starts[np.cumsum(head) - 1]
    # Of each list a member, and whether all entries so far were of its component when they came.
    member, alike = np.full(len(order), -1), np.ones(len(order), bool)

    # Entries in order of list and holder, for looking up many at once by binary search.
    entries = starts[np.cumsum(head) - 1] * m + holders

    def overlap(some: np.ndarray, lists_at: np.ndarray) -> np.ndarray:
        """In how many of some lists each of some sets stands, by binary search."""
        out, step = np.zeros(len(some), np.int64), max(1, PROBES // max(1, len(lists_at)))
        for low in range(0, len(some), step):
            asked = lists_at[:, None] * m + some[low : low + step]
            at = np.minimum(np.searchsorted(entries, asked), len(entries) - 1)
            out[low : low + step] = (entries[at] == asked).sum(0)
        return out

    def link(q: int, c: int) -> None:
        if label[q] == q:
            label[q] = label[c]
        else:
            label[label == max(label[q], label[c])] = min(label[q], label[c])

    for q in range(m):
        size, need = int(sizes[q]), int(required(sizes[q], percent))
        all_own = begin[ends[q] : ends[q + 1]]
        length = before[ends[q] : ends[q + 1]]
        used = np.flatnonzero(length)
        if len(used) >= need > 0:
            used = used[np.argsort(length[used], kind="stable")]
            own, length = all_own[used], length[used]
            cut = len(used) - (need - 1)
            similar = lambda c, both: 100 * both >= percent * (size + sizes[c] - both)  # noqa: B023, E731
            if length[:cut].sum() > FEW:
                # Very many may be alike: a few of them usually link, and their component is then left out.
                some = [holders[a + max(0, k - FEW) : a + k] for a, k in zip(own[:8].tolist(), length[:8].tolist())]
                near, often = np.unique(np.concatenate(some), return_counts=True)
                near = near[np.argsort(-often, kind="stable")][:4]
                for c in near[similar(near, overlap(near, own))].tolist():
                    if label[c] != label[q]:
                        link(q, c)
            # Lists of nothing but the own component hold no one to link.
            open_ = np.flatnonzero(~alike[own[:cut]] | (label[member[own[:cut]]] != label[q]))
            parts = [holders[a : a + k] for a, k in zip(own[open_].tolist(), length[open_].tolist())]
            merged = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            merged = np.sort(merged[label[merged] != label[q]], kind="stable")
            turn = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1]))[: len(merged)])
            found, times = merged[turn], np.diff(np.append(turn, len(merged)))
            # Even if it stood in all long lists, a set must reach what a link of these two sizes needs.
            keep = (100 * sizes[found] >= percent * size) & ((100 + percent) * (times + need - 1) >= percent * (size + sizes[found]))
            found, times = found[keep], times[keep]
            # The most frequent first: one link spares all others of its component.
            order_ = np.argsort(-times, kind="stable")
            found, times, take = found[order_], times[order_], 1
            while len(found):
                now, held = found[:take], times[:take]
                for c in now[similar(now, held + overlap(now, own[cut:]))].tolist():
                    if label[c] != label[q]:
                        link(q, c)
                left = label[found[take:]] != label[q]
                found, times, take = found[take:][left], times[take:][left], 16 * take
        first = member[all_own] < 0
        alike[all_own] &= first | (label[member[all_own]] == label[q])
        member[all_own[first]] = q
    return label


def _block(percent: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, sizes = table["node"].to_numpy(), table["n"].to_numpy()
        lists = table["shingles"].combine_chunks()
        order = np.lexsort((nodes, sizes))
        lists = lists.take(pa.array(order))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        nodes, sizes = nodes[order], sizes[order]
        counts = np.diff(lists.offsets.to_numpy())
        label = search(nodes, lists.flatten().to_numpy().view(np.uint64), counts, sizes, percent)
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, label, nodes)
        return pa.table({"node": nodes, "component": least[label]})

    return run


def _links(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, component) by searching in blocks; ``members(node, block)``."""
    dealt = sets.select("node", "n", "shingles").join(members.hint("shuffle_hash"), "node")
    found = dealt.groupBy("block").applyInArrow(_block(percent), "node long, component long")
    return stored(found.where(F.col("node") != F.col("component")), "linked")


def candidate_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(node, least): sets that share a token of their prefixes and are near in size, as stars.

    Sizes are put into bands a little wider than the bound, so two sets near enough
    are in one band or in neighbouring ones; a set stands in its own and the next.
    """
    step = math.log(100 / percent) * 1.000001
    band = F.floor(F.log(F.col("n")) / step) if step else F.col("n")
    near = F.explode(F.array(band, band + 1) if step else F.array(band)).alias("band")
    postings = sets.select("node", "n", F.explode("tokens").alias("token")).select("node", "token", near)
    least = postings.groupBy("token", "band").agg(F.min("node").alias("least"), F.count("*").alias("held")).where("held > 1")
    return postings.join(least, ["token", "band"]).where("node <> least").select("node", "least").distinct()


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of every set that links with another, by blocks of candidates."""
    grouped = components(candidate_pairs(sets, percent), "node", "least")
    grouped = stored(grouped.join(sets.select("node", F.size("shingles").cast("long").alias("weight")), "node"), "candidates")
    weights = grouped.groupBy("component").agg(F.sum("weight").alias("total"))
    total = grouped.agg(F.sum("weight")).first()[0] or 0
    blocks = max(BUCKETS, -(-total // BLOCK))
    small = weights.where(F.col("total") <= BLOCK)
    whole = grouped.join(small, "component").select(
        "node", F.concat_ws(":", F.lit("b"), F.pmod(F.xxhash64("component"), F.lit(blocks))).alias("block")
    )
    large = stored(weights.where(F.col("total") > BLOCK), "large")
    if large.isEmpty():
        return components(_links(sets, whole, percent), "node", "component")
    chunks = F.ceil(F.col("total") * 2 / BLOCK).cast("int")
    cut = grouped.join(large, "component").select("node", "component", "weight", chunks.alias("chunks"))
    cut = stored(cut.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "chunks")
    of = lambda *parts: F.concat_ws(":", F.lit("c"), "component", *parts).alias("block")
    first = cut.select("node", "component", F.explode(F.expr("if(chunk = 0, sequence(0, chunks - 1), array(chunk))")).alias("i"))
    links = _links(sets, whole.union(first.select("node", of("i"))), percent)
    # What is not in the largest group of its component by now meets all of the component.
    labels = cut.join(components(links, "node", "component").withColumnRenamed("component", "label"), "node", "left")
    labels = stored(labels.withColumn("label", F.coalesce("label", "node")), "labels")
    sizes = labels.groupBy("component", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("component").agg(F.max_by("label", F.struct("size", "label")).alias("largest"))
    outside = labels.join(largest, "component").where("label <> largest")
    rest = outside.groupBy("component").agg(F.ceil(F.sum("weight") * 2 / F.lit(BLOCK)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    asking = outside.join(rest, "component").select(
        "node", "component", part.alias("j"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("i")
    )
    asked = cut.join(rest, "component").select(
        "node", "component", F.explode(F.expr("sequence(0, parts - 1)")).alias("j"), F.col("chunk").alias("i")
    )
    meeting = asking.select("node", of(F.lit("u"), "j", "i")).union(asked.select("node", of(F.lit("u"), "j", "i"))).distinct()
    return components(links.union(_links(sets, meeting, percent)), "node", "component")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(row, component, id, n_shingles, component_id) of every document; no component without shingles."""
    return _similar(numbered(docs.select(*{id_col, text_col}), "texts"), id_col, text_col, n, percent)


def _similar(texts: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """The same of rows that were numbered and stored."""
    kept = F.col("kept")
    rows = texts.select("row", kept[text_col].cast("string").alias("text"), kept[id_col].alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    described = rows.mapInArrow(_describe(n), f"row long, id {kind}, n long, k0 long, k1 long")
    described = stored(described, "sets")
    classes = described.where("n > 0").groupBy("k0", "k1").agg(F.min("row").alias("node"), F.min("id").alias("least_id"))
    classes = stored(classes, "classes")
    sets = stored(survivors(rows.select("row", "text"), classes, n, percent), "survivors")
    linked = stored(linked_sets(sets, percent), "linked")

    named = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least_ids, "component").select("k0", "k1", "component", "component_id")
    out = described.select("row", "id", "n", "k0", "k1").join(of_class, ["k0", "k1"], "left")
    return out.select(
        "row",
        "component",
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of similar documents, the row of the least id (nulls last) and its columns as they are."""
    texts = numbered(docs, "texts")
    found = _similar(texts, id_col, text_col, n, percent)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row"))
    kept = found.where(F.col("component").isNotNull()).groupBy("component").agg(first.alias("first")).select("first.row")
    kept = kept.union(found.where(F.col("component").isNull()).select("row"))
    return texts.join(stored(kept, "kept").hint("shuffle_hash"), "row", "left_semi").select("kept.*")
