"""Exact join of documents by Jaccard similarity of word shingles, with count-vector R-trees.

A document is the set of hashes of its five-word shingles. Hashes are dealt into GROUPS groups by value;
the counts of a set in the groups are a point, and the sum of the smaller of two points' coordinates
bounds the overlap of the sets from above. An R-tree holds the points of a block of documents: the upper
corners of two nodes bound all pairs between them. Pairs that survive are verified on the sets.

Blocks for the trees: two sets of the similarity asked for must share one of the first fifth of their
hashes in any one order of all hashes. The order is by value, but hashes met most often come last, so
that passages which many documents share don't make blocks. Three steps, each exact in what it links:

1. Sets that are equal are one class. Classes that share one of their first FIRSTS hashes are joined by R-trees.
2. For each hash of the first fifths that still joins several components: the first class of each
   component is compared with that of the first component.
3. Where a hash joins several components even then, all its pairs across components are compared: those of few
   classes as rows, if they pass the bounds of size, place and counts; those of many by R-trees again, in cells
   of two parts of the block. No pair is left out, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.llm.common import FILTER_BITS, filter_bit, fresh, in_filter, key_filter, slices, staged, text_key

SHINGLE, LEAF = 5, 16
#: Groups of a set: the power of two that leaves two to four hashes in each, within these limits. Points of
#: more groups fold into points of fewer.
FEWEST, MOST = 32, 4096
#: Hashes of a set that name its blocks in step 1.
FIRSTS = 3
#: Classes and bytes of sets of one tree at most; larger blocks are cut, and steps 2 and 3 link across.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Up to so many classes, the pairs of one hash are made as rows.
PAIRED = 64
#: The first hashes that most classes share are dealt over several tasks: so many at most are listed. What
#: is left has a share of the classes below 1 / HOT each.
HOT = 1 << 14
#: So many of the hashes met most often come last in the order: 1 MB, whatever the size of the input.
COMMON = 1 << 17
_BYTES = 5  # of a hash that are kept: the 40 highest bits
#: Two different sets of which one is smaller can't reach 80 %: such sets have their class (64 bits of the whole set), and
#: no link beyond it. Of larger ones at least four hashes must agree.
LINKABLE = 4
_MANY_WORDS = 200_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MANY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, hashes: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text; fewer than SHINGLE words are one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").ravel().view(np.int64)


def needed(a: int | np.ndarray, b: int | np.ndarray):
    """Smallest overlap of sets of these sizes with 100 * overlap >= 80 * union."""
    return (4 * (a + b) + 8) // 9


def prefix_size(n: int) -> int:
    return n - (8 * n + 9) // 10 + 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def groups_of(size: int) -> int:
    return min(MOST, max(FEWEST, 1 << max(0, (size // 2).bit_length() - 1)))


def point(values: np.ndarray) -> np.ndarray:
    """Counts of a set in its groups."""
    groups = groups_of(len(values))
    return np.bincount(values & (groups - 1), minlength=groups)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups: hashes equal modulo the larger number are so modulo the smaller one."""
    return counts.reshape(-1, groups).sum(axis=0)


def tree_join(sets: list[np.ndarray], labels: np.ndarray | None = None) -> np.ndarray:
    """For each set the first set of its component, by an R-tree over the count vectors. Sets of one label are
    in one component from the start. Pairs that are in one component already aren't verified again."""
    n = len(sets)
    root = list(range(n))
    if labels is not None:
        _, first, which = np.unique(labels, return_index=True, return_inverse=True)
        root = first[which].tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    groups = min(256, groups_of(int(np.median(sizes))))
    at = np.array([np.bincount(s & (groups - 1), minlength=groups) for s in sets])
    # Packed by size first, which bounds overlaps best; leaves of one label needn't meet.
    order = np.lexsort((*at.T[:2], sizes, *([] if labels is None else [labels])))
    leaves = [order[i : i + LEAF] for i in range(0, n, LEAF)]
    pure = [len({root[x] for x in leaf}) == 1 for leaf in leaves]
    corners = np.array([at[leaf].max(axis=0) for leaf in leaves])
    least = np.array([sizes[leaf].min() for leaf in leaves])
    for i, here in enumerate(leaves):
        bound = np.minimum(corners[i], corners[i:]).sum(axis=1)
        for j in np.flatnonzero(bound >= needed(least[i], least[i:])) + i:
            there = leaves[j]
            if pure[i] and pure[j] and find(int(here[0])) == find(int(there[0])):
                continue
            tight = np.minimum(at[here][:, None, :], at[there][None, :, :]).sum(axis=2)
            for x, y in np.argwhere(tight >= needed(sizes[here][:, None], sizes[there][None, :])):
                a, b = int(here[x]), int(there[y])
                if (i != j or x < y) and (ra := find(a)) != (rb := find(b)) and overlap(sets[a], sets[b]) >= needed(sizes[a], sizes[b]):
                    root[max(ra, rb)] = min(ra, rb)
    return np.array([find(i) for i in range(n)], np.int64)


def _class(full: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(full.tobytes()) - (1 << 63)


def _short(full: np.ndarray) -> np.ndarray:
    """The kept bits of sorted hashes, sorted and distinct."""
    short = (full >> np.uint64(64 - 8 * _BYTES)).view(np.int64)
    return np.unique(short) if len(short) > 1 and (short[1:] == short[:-1]).any() else short


class _Order:
    """The one order of all hashes: by value, those in ``common`` last."""

    def __init__(self, common: np.ndarray):
        self.common = common

    def first(self, values: np.ndarray, n: int) -> np.ndarray:
        if not len(self.common):
            return values[:n]
        k = np.minimum(np.searchsorted(self.common, values), len(self.common) - 1)
        late = self.common[k] == values
        early = values[~late][:n]
        return np.concatenate([early, values[late][: n - len(early)]]) if len(early) < n else early


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Staged, one row for each row of ``docs``: doc_id, key (of the text), n, cls, and on some rows
    ``common``: hashes found in several documents side by side."""
    given = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    marks = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([given.schema["doc_id"], given.schema["key"], T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("common", marks)])
    arrow_marks = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = _WordHash(), set()
        for batch in slices(batches, "text"):
            n, classes, new = [], [], []
            for t in batch.column("text").to_pylist():
                full = shingles(t or "", hashes)
                key = _class(full) if len(full) else None
                n.append(len(full))
                classes.append(key)
                if key is not None and key not in met:
                    met.add(key)
                    new.append(_short(full))
            common = [None] * len(n)
            if new:
                value, count = np.unique(np.concatenate(new), return_counts=True)
                often = count > 1
                if often.any():
                    common[0] = [{"hash": int(v), "n": int(c)} for v, c in zip(value[often], count[often], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(common, arrow_marks)], names=schema.names)

    return staged(given.mapInArrow(run, schema), "documents")


def _prefixes(docs: DataFrame, text: str, common: Broadcast) -> DataFrame:
    """Staged, for each class (once for each task that meets it): cls, size, prefix, point."""
    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("size", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("point", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, hashes, met = _Order(common.value), _WordHash(), set()
        for batch in slices(batches, "text"):
            classes, sizes, prefixes, points = [], [], [], []
            for t in batch.column("text").to_pylist():
                full = shingles(t or "", hashes)
                if len(full) >= LINKABLE and (key := _class(full)) not in met:
                    met.add(key)
                    short = _short(full)
                    classes.append(key)
                    sizes.append(len(short))
                    prefixes.append(order.first(short, prefix_size(len(short))))
                    points.append(np.minimum(point(short), 255).astype(np.uint8).tobytes())
            flat = pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64())
            offsets = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(points, pa.binary())], names=schema.names)

    return staged(docs.select(F.col(text).alias("text")).mapInArrow(run, schema), "prefixes")


def _low_bits(values: np.ndarray) -> np.ndarray:
    """Place of a shingle's hash in a filter: its bits are spread evenly already."""
    return values & (FILTER_BITS - 1)


def _sets(docs: DataFrame, text: str, table: DataFrame, classes: DataFrame, firsts: Broadcast | None = None) -> DataFrame:
    """cls and blob of these classes (and a few others): their texts are read again, and no set is kept on
    disk or shuffled before it is needed. ``firsts`` (the order, a filter of shared hashes, the tasks of the hot
    ones) asks for a row for each block of the class instead: cls, first, share, blob."""
    keys = table.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("key").alias("key")).join(classes.select("cls").distinct(), "cls", "left_semi")
    wanted_keys = docs.sparkSession.sparkContext.broadcast(key_filter(keys.select(filter_bit(F.col("key")).alias("bit"))))
    names = ["cls", *(["first", "share"] if firsts else []), "blob"]
    schema = T.StructType([T.StructField(n, T.BinaryType() if n == "blob" else T.LongType()) for n in names])
    kinds = [pa.binary() if n == "blob" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = _WordHash(), set()
        common, shared, hot = firsts.value if firsts else (None, None, None)
        order = _Order(common) if firsts else None
        for batch in batches:
            wanted = batch.filter(pa.array(in_filter(wanted_keys.value, batch.column("bit").to_numpy())))
            for part in slices(iter([wanted]), "text"):
                rows = []
                for t in part.column("text").to_pylist():
                    full = shingles(t or "", hashes)
                    if len(full) < LINKABLE or (key := _class(full)) in met:
                        continue
                    met.add(key)
                    short = _short(full)
                    if firsts is None:
                        rows.append((key, _packed(short)))
                        continue
                    some = order.first(short, min(FIRSTS, prefix_size(len(short))))
                    for first in some[in_filter(shared, _low_bits(some))].tolist():
                        rows.append((key, first, (key ^ first * 0x9E3779B1) % hot.get(first, 1), _packed(short)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    given = docs.select(F.col(text).alias("text"), filter_bit(text_key(F.col(text))).alias("bit"))
    return given.mapInArrow(run, schema)


def _block_links(docs: DataFrame, text: str, table: DataFrame, prefixes: DataFrame, common: np.ndarray) -> DataFrame:
    """Step 1, staged: (cls, comp) of the classes in blocks of several; comp is the first class linked."""
    context = docs.sparkSession.sparkContext
    first = prefixes.select("cls", F.explode(F.slice("prefix", 1, FIRSTS)).alias("first")).distinct()
    shared = staged(first.groupBy("first").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "shared-first")
    bits = key_filter(shared.select(F.col("first").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")))
    hot = shared.filter(F.col("n") > BLOCK).orderBy(F.desc("n"), "first").limit(HOT).toArrow()
    parts = dict(zip(hot.column("first").to_pylist(), (-(-n // BLOCK) for n in hot.column("n").to_pylist()), strict=True))
    sets = _sets(docs, text, table, first.join(shared, "first", "left_semi"), context.broadcast((common, bits, parts)))
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(block: dict[int, bytes]) -> pa.RecordBatch:
            classes = np.array(list(block), np.int64)
            first = tree_join([_unpacked(b) for b in block.values()])
            linked = first != np.arange(len(first))
            return pa.RecordBatch.from_arrays([pa.array(classes[linked]), pa.array(classes[first][linked])], names=["u", "v"])

        block: dict[int, bytes] = {}  # a class may come from several tasks
        name, size = None, 0
        for batch in batches:
            for first, share, cls, blob in zip(*(batch.column(c).to_pylist() for c in ("first", "share", "cls", "blob")), strict=True):
                if (first, share) != name or cls not in block and (len(block) == BLOCK or size > BLOCK_BYTES):
                    if len(block) > 1:
                        yield joined(block)
                    block, name, size = {}, (first, share), 0
                block[cls] = blob
                size += len(blob)
        if len(block) > 1:
            yield joined(block)

    blocks = sets.repartition("first", "share").sortWithinPartitions("first", "share", "cls")
    roots = connected(blocks.mapInArrow(run, schema))
    if roots is None:
        return docs.sparkSession.createDataFrame([], "cls LONG, comp LONG")
    return roots.select(F.col("node").alias("cls"), F.col("root").alias("comp"))


def _cell_links(rows: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v) components that link, from (key, cls, comp, n, bytes) rows of large blocks: each block in parts of half a
    tree, each pair of parts in one cell."""
    parts = F.ceil(F.greatest(2 * F.col("n") / BLOCK, 2 * F.col("bytes") / BLOCK_BYTES)).cast("long")
    dealt = rows.select("key", "cls", "comp", parts.alias("m"), F.pmod(F.xxhash64("cls", "key"), parts).alias("i"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    cells = dealt.select("key", "cls", "comp", "m", "i", other.alias("j")).select(
        "key", "cls", "comp", (F.least("i", "j") * F.col("m") + F.greatest("i", "j")).alias("cell")
    )
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(block: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
            labels = np.array([c for c, _ in block.values()], np.int64)
            first = tree_join([_unpacked(b) for _, b in block.values()], labels) if len(set(labels.tolist())) > 1 else np.arange(len(labels))
            linked = np.unique(np.column_stack([labels, labels[first]]), axis=0)
            linked = linked[linked[:, 0] != linked[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(linked[:, 0]), pa.array(linked[:, 1])], names=["u", "v"])

        block: dict[int, tuple[int, bytes]] = {}
        name = None
        for batch in batches:
            for key, cell, cls, comp, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "cls", "comp", "blob")), strict=True):
                if (key, cell) != name:
                    if block:
                        yield joined(block)
                    block, name = {}, (key, cell)
                block[cls] = (comp, blob)
        if block:
            yield joined(block)

    own = staged(sets(rows.select("cls").distinct()).dropDuplicates(["cls"]), "cell-sets")
    dealt = cells.join(own, "cls").repartition("key", "cell").sortWithinPartitions("key", "cell", "cls")
    return staged(dealt.mapInArrow(run, schema).distinct(), "cell-links")


def _verified(pairs: DataFrame, prefixes: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those of the (a, a_comp, b, b_comp) pairs that link: by count vectors first, then by the sets."""

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()

    def kept(pairs: DataFrame, values: DataFrame, test: Callable[[dict], bool], name: str) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(values.select(F.col("cls").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in values.columns if c != "cls")), end)
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "a_comp", "b", "b_comp")])
        used = [c for c in pairs.columns if c not in schema.names]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([test(r) for r in batch.select(used).to_pylist()], pa.bool_())).select(schema.names)

        return staged(pairs.mapInArrow(run, schema), name)

    def bound(r: dict) -> bool:
        u, v = (np.frombuffer(r[f"{e}_point"], np.uint8) for e in "ab")
        if (u == 255).any() or (v == 255).any():
            return True  # the largest count may stand for more
        groups = min(len(u), len(v))
        return int(np.minimum(folded(u.astype(np.int64), groups), folded(v.astype(np.int64), groups)).sum()) >= needed(r["a_size"], r["b_size"])

    def exact(r: dict) -> bool:
        u, v = _unpacked(r["a_blob"]), _unpacked(r["b_blob"])
        return overlap(u, v) >= needed(len(u), len(v))

    points = prefixes.select("cls", "size", "point").join(ends(pairs), "cls", "left_semi").dropDuplicates(["cls"])
    near = kept(pairs, points, bound, "near-pairs")
    of_pairs = ends(near)
    blobs = staged(sets(of_pairs).join(of_pairs, "cls", "left_semi").dropDuplicates(["cls"]), "pair-sets")
    return kept(near, blobs, exact, "links")


def connected(edges: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes of ``edges`` (u, v), root the smallest node reachable; None without edges.

    Smallest labels spread to neighbours, then each label takes the label of the node it names, which
    halves long paths; every round is written, so a lost executor costs one round at most.
    """
    edges = staged(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return None
    labels = staged(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_v")).select("node", F.least("node", "_v").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("_near"))
        spread = labels.join(near, "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        jump = spread.alias("s").join(spread.select(F.col("node").alias("_at"), F.col("root").alias("_next")).alias("t"), F.col("root") == F.col("_at"), "left")
        after = staged(jump.select("node", "_old", F.least("root", F.coalesce("_next", "root")).alias("root")), "labels")
        if after.filter(F.col("root") < F.col("_old")).isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def _relabel(rows: DataFrame, roots: DataFrame | None, comp: str = "comp") -> DataFrame:
    if roots is None:
        return rows
    named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(named, F.col(comp) == F.col("_node"), "left").withColumn(comp, F.coalesce("_root", comp)).drop("_node", "_root")


def _sized(a: Column, b: Column) -> Column:
    return (10 * a >= 8 * b) & (10 * b >= 8 * a)


def _linked(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: the sets; (cls, comp) of each class; (comp, least) with the first document of each component."""
    spark = docs.sparkSession
    table = _documents(docs, doc_id, text)
    often = table.select(F.inline("common")).groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(COMMON).select("hash")
    common = np.sort(often.toArrow().column("hash").to_numpy())
    prefixes = _prefixes(docs, text, spark.sparkContext.broadcast(common))
    blocks = _block_links(docs, text, table, prefixes, common)
    sets = lambda classes: _sets(docs, text, table, classes)
    # Step 2 and 3 work on the hashes that join several components.
    labels = prefixes.select("cls", "size", "prefix").join(blocks.hint("shuffle_hash"), "cls", "left")
    each = labels.select("cls", F.coalesce("comp", "cls").alias("comp"), "size", F.posexplode("prefix").alias("place", "key"))
    same = Window.partitionBy("key")
    centre = F.min(F.struct("comp", "cls", "size")).over(same)
    mixed = staged(each.withColumn("c", centre).withColumn("most", F.max("comp").over(same)).filter("c.comp <> most").drop("most"), "mixed")
    star = mixed.filter((F.col("comp") != F.col("c.comp")) & _sized(F.col("size"), F.col("c.size")))
    pair = F.min(F.struct(F.col("c.cls").alias("a"), F.col("cls").alias("b")))
    star = star.groupBy(F.col("c.comp").alias("a_comp"), F.col("comp").alias("b_comp")).agg(pair.alias("p")).select("p.a", "a_comp", "p.b", "b_comp")
    links = _verified(staged(star, "star-pairs"), prefixes, sets)
    roots = connected(links.select(F.col("a_comp").alias("u"), F.col("b_comp").alias("v")))
    again = _relabel(mixed.drop("c"), roots)
    again = again.withColumn("_s", F.min("comp").over(same) != F.max("comp").over(same))
    again = again.withColumns({"n": F.count("*").over(same), "bytes": F.sum(_BYTES * F.col("size")).over(same)})
    left = staged(again.filter("_s").drop("_s"), "mixed")
    few = left.filter(F.col("n") <= PAIRED)
    end = lambda e: few.select("key", *(F.col(c).alias(f"{e}_{c}") for c in ("cls", "comp", "size", "place")))
    # The first hash two sets share leaves at most so many for their overlap; a pair that links passes there.
    most = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    meets = (F.col("a_comp") < F.col("b_comp")) & _sized(F.col("a_size"), F.col("b_size")) & (9 * most >= 4 * (F.col("a_size") + F.col("b_size")))
    across = end("a").join(end("b"), "key").filter(meets).select(F.col("a_cls").alias("a"), "a_comp", F.col("b_cls").alias("b"), "b_comp")
    found = _verified(staged(across.distinct(), "pairs"), prefixes, sets).select(F.col("a_comp").alias("u"), F.col("b_comp").alias("v"))
    many = left.filter(F.col("n") > PAIRED)
    if not many.isEmpty():
        found = found.unionByName(_cell_links(many, sets))
    last = connected(found)
    # From classes to components, and their first documents: the smallest id that isn't null.
    document = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    classes = table.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(document).alias("least"))
    named = classes.join(blocks.select("cls", "comp").dropDuplicates(["cls"]), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = staged(_relabel(_relabel(named, roots), last), "components")
    return table, named.select("cls", "comp"), staged(named.groupBy("comp").agg(F.min("least").alias("least")), "least")


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``: the size of its set, and the smallest
    doc_id in its component of documents linked by similarity 0.8 or more, itself included.

    Null, empty and blank texts have no set, n_shingles 0 and link with nothing. Fewer than five words are one
    shingle. Equal sets link, so repeated rows do; each row of a repeated id is a document of its own.
    Null ids count only where a component has no other. Other columns are ignored. Equal sets are told by 64 bits
    of all their hashes; different ones link by 40 bits of each, four or more of which must agree. An empty table gives none.
    """
    table, named, least = _linked(docs, doc_id, text)
    of_class = staged(named.join(least, "comp").select("cls", F.col("least.doc_id").alias("component_id")), "class-ids")
    linked = table.filter(F.col("cls").isNotNull()).select("doc_id", "n", "cls").join(of_class, "cls")
    alone = table.filter(F.col("cls").isNull())
    columns = [F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(*columns).unionByName(alone.withColumn("component_id", F.col("doc_id")).select(*columns))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of one document of each component: the one of smallest id (ids that aren't null
    first; of equal ids, the smaller key of the text). Of rows equal in id and text, one stays. Documents without a
    set link with nothing and stay.
    """
    table, _, least = _linked(docs, doc_id, text)
    alone = table.filter(F.col("cls").isNull()).select("doc_id", "key").distinct()
    own, key, other, nth = (fresh(docs.columns) for _ in range(4))
    stay = least.select("least.doc_id", "least.key").unionByName(alone).select(F.col("doc_id").alias(other), F.col("key").alias(key))
    # The join deals rows out by key alone, and the window needs no other order of things.
    same = F.coalesce(F.col(doc_id) == F.col(other), F.col(doc_id).isNull() & F.col(other).isNull())
    met = docs.withColumn(own, text_key(F.col(text))).join(stay.hint("shuffle_hash"), (F.col(own) == F.col(key)) & same)
    return met.withColumn(nth, F.row_number().over(Window.partitionBy(own, doc_id).orderBy(own))).filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
