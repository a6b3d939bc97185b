"""Conversation prefix trie in flat arrays under minimal perfect hashes.

Each conversation is a path of turns; its prefixes are named by chained 128-bit digests. The paths are dealt into
shards, ranges of conversation ids of bounded size (no matter how many conversations share a prefix, so a hot first
turn is split over all shards). A shard

1. enumerates its distinct prefix digests and gives each a slot by a minimal perfect hash. A look-up compares the
   digest kept in the slot; a digest that stands for two different prefixes raises an error;
2. scatters its counts into flat arrays by slot;
3. learns for each of its nodes the count, the smallest member and the owner over all shards (one window over the
   shards that hold the node), and then adds what it owns up through the parent slots, deepest level first.

Each node is owned by one shard, so the sums of the shards add up. A conversation's path stays in one shard, and in the
task that orders its turns; nothing else is kept whole.

Rows without a conversation id take no part. Turns go by ``turn``, null first, and turns of one number by their content's
digest; repeated rows are turns of their own. A null role or text is empty. An empty table has no trie, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stevedore.llm.common import staged

#: Turns of a shard, about.
SHARD_ROWS = 500_000
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys (pairs of 64-bit numbers), with the keys in their slots.

    Level by level each key is tried at one place of a bit array; keys alone at their place stay there, the rest go
    to the next level. A key's slot is the number of set bits before its place.
    """

    def __init__(self, keys: np.ndarray, spread: float = 1.5):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, before = keys, 0
        while len(rest):
            size = max(8, int(spread * len(rest)))
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, before + np.cumsum(alone) - alone))
            before += int(alone.sum())
            rest = rest[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")
        self.keys = np.zeros_like(keys)
        slots = self._slots(keys)
        if len(np.unique(slots)) != len(keys):
            raise ValueError("two keys in one slot")
        self.keys[slots] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys[:, 0] + keys[:, 1] * np.uint64(2 * level + 1) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[rest], level, len(alone))
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the slot's own key differs (no key of this table)."""
        out = self._slots(keys)
        known = out >= 0
        known[known] = (self.keys[out[known]] == keys[known]).all(axis=1)
        return np.where(known, out, -1)


def as_numbers(digests: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def rebuilt_turns(rows: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, pos, digest, n_chars) of each conversation c after its first h = crc32(c) % ``heads`` turns have been
    replaced by those of conversation c - c % ``block``; and a row at -1 without a digest for every conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))
    turns = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.substring(F.sha2(content, 256), 1, 32)).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    placed = staged(
        turns.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(block)))
        .withColumn("h", F.when(F.col("base") == F.col("conv_id"), 0).otherwise(taken).cast("int"))
        .select("conv_id", "base", "h", "pos", "digest", "n_chars"),
        "turns",
    )
    # A block has at most ``block`` conversations, and at most ``heads`` - 1 turns are taken over.
    known = placed.filter("pos = 0").select("conv_id", "base", "h")
    first = placed.filter((F.col("conv_id") == F.col("base")) & (F.col("pos") < heads - 1)).select("base", "pos", "digest", "n_chars")
    shared = known.filter("h > 0").join(first, "base").filter("pos < h").select("conv_id", "pos", "digest", "n_chars")
    own = placed.filter("pos >= h").select("conv_id", "pos", "digest", "n_chars")
    mark = known.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    return shared.unionByName(own).unionByName(mark)


_NODES = pa.schema(
    [("shard", pa.int64()), ("slot", pa.int32()), ("parent_slot", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary())]
    + [("depth", pa.int64()), ("n_chars", pa.int64()), ("n_here", pa.int64()), ("conv_here", pa.int64()), ("inner_here", pa.bool_()), ("ends", pa.string())]
)
_NODES_SQL = (
    "shard bigint, slot int, parent_slot int, digest binary, parent binary, depth bigint, n_chars bigint, "
    "n_here bigint, conv_here bigint, inner_here boolean, ends string"
)


def _paths(batches: Iterator[pa.RecordBatch]):
    """Per conversation (rows sorted by conversation and place): the digests of its prefixes from the root, and the
    code points of each one's last text."""
    conv, digests, chars = None, [], []
    for b in batches:
        for c, digest, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "digest", "n_chars")), strict=True):
            if digest is None:  # the row at -1
                if conv is not None:
                    yield conv, digests, chars
                conv, digests, chars = c, [ROOT], [0]
            else:
                digests.append(hashlib.blake2b(digests[-1] + digest, digest_size=16).digest())
                chars.append(n)
    if conv is not None:
        yield conv, digests, chars


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node table of one shard: its paths enumerated, given slots, and scattered."""
    prefixes, parents, convs, depths, chars, ends, lengths = [], [], [], [], [], [], []
    for conv, digests, n in _paths(batches):
        prefixes += digests
        parents += [ROOT, *digests[:-1]]
        chars += n
        depths.append(np.arange(len(digests)))
        convs.append(conv)
        lengths.append(len(digests))
    if not convs:
        return
    keys, above = as_numbers(prefixes), as_numbers(parents)
    convs, lengths = np.array(convs), np.array(lengths)
    depths, chars, members = np.concatenate(depths), np.array(chars), np.repeat(convs, lengths)
    table = PerfectHash(np.unique(keys, axis=0))
    slot, up = table.slots(keys), table.slots(above)
    if (slot < 0).any() or (up < 0).any():
        raise ValueError("a prefix without a slot")
    size = len(table)
    parent, depth, n_chars = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    parent[slot], depth[slot], n_chars[slot] = up, depths, chars
    if (parent[slot] != up).any() or (depth[slot] != depths).any() or (n_chars[slot] != chars).any():
        raise ValueError("one digest for two prefixes")
    n, smallest = np.bincount(slot, minlength=size), np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(smallest, slot, members)
    inner = np.zeros(size, bool)
    inner[up[depths > 0]] = True
    last = slot[np.cumsum(lengths) - 1]
    ends = [None] * size
    order = np.argsort(last, kind="stable")  # the conversations came in ascending order
    starts = np.flatnonzero(np.r_[True, np.diff(last[order]) != 0]) if len(order) else []
    for ids, s in zip(np.split(convs[order], starts[1:]), last[order][starts], strict=True):
        ends[s] = ",".join(map(str, ids.tolist()))
    raw = table.keys.tobytes()
    names = [raw[16 * i : 16 * i + 16] for i in range(size)]
    for at in range(0, size, 20_000):
        part = slice(at, at + 20_000)
        columns = [
            np.full(len(n[part]), convs[0]), np.arange(size)[part], np.where(depth[part] > 0, parent[part], -1), names[part],
            [names[p] for p in parent[part]], depth[part], n_chars[part], n[part], smallest[part], inner[part], ends[part],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES)


_SUMS = pa.schema(
    [("digest", pa.binary()), ("shard", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string())]
)
_SUMS_SQL = (
    "digest binary, shard bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends string"
)


def accumulate(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> None:
    """Add each slot's values to its parent's, the deepest level first: afterwards they are sums over subtrees."""
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
    for low, high in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
        level = order[low:high]
        for v in values:
            np.add.at(v, parent[level], v[level])


def _sum_up(group: pa.Table) -> pa.Table:
    """One shard's table filled again, with what is known of its nodes over all shards."""
    by_slot = np.argsort(group["slot"].to_numpy())
    column = lambda name: group[name].to_numpy()[by_slot]
    parent, depth, own = column("parent_slot"), column("depth"), column("owner") == column("shard")
    conv, n = column("conv_id"), column("n_convs")
    leaves = (own & ~column("inner")).astype(np.int64)
    saved = np.where(own, (n - 1) * column("n_chars"), 0)
    children = np.zeros(len(n), np.int64)
    np.add.at(children, parent[own & (depth > 0)], 1)
    accumulate(parent, depth, leaves, saved)
    above = pa.array(conv[parent], pa.int64(), mask=depth == 0)
    take = pa.array(by_slot)
    columns = [group["digest"].take(take), column("shard"), conv, depth, above, n, children, leaves, saved, group["ends"].take(take)]
    arrays = [c if isinstance(c, (pa.ChunkedArray, pa.Array)) else pa.array(c, pa.int64()) for c in columns]
    return pa.table(arrays, schema=_SUMS)


_OUT_SQL = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)
_OUT = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string())]
)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and shard: the sums added, the ends (ascending over the shards) hashed as they come by."""
    node, held = None, []

    def close() -> None:
        held.append((*node["row"], *node["sums"], node["ends"].hexdigest()))

    for b in batches:
        c = {name: b.column(name).to_pylist() for name in b.schema.names}
        for i, digest in enumerate(c["digest"]):
            if node is None or node["digest"] != digest:
                if node is not None:
                    close()
                row = tuple(c[x][i] for x in ("conv_id", "depth", "parent_conv_id", "n_convs"))
                node = {"digest": digest, "row": row, "sums": [0, 0, 0], "ends": hashlib.sha256(), "some": False}
            for j, x in enumerate(("n_children", "n_leaves", "saved_tokens")):
                node["sums"][j] += c[x][i]
            if c["ends"][i] is not None:
                node["ends"].update((("," if node["some"] else "") + c["ends"][i]).encode())
                node["some"] = True
        if len(held) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _OUT, strict=True)], schema=_OUT)
            held.clear()
    if node is not None:
        close()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _OUT, strict=True)], schema=_OUT)


def trie_of(turns: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of (conv_id, pos, digest, n_chars) rows, one row per node."""
    turns = staged(turns, "paths")
    shards = -(-turns.count() // shard_rows) or 1
    dealt = turns.repartitionByRange(shards, "conv_id").sortWithinPartitions("conv_id", "pos")
    # A shard is named by its smallest conversation. Written before it is used, so that each pass sees the same shards.
    nodes = staged(dealt.mapInArrow(_shard, _NODES_SQL), "trie-shards")
    everywhere = Window.partitionBy("digest")  # as many rows as shards hold the node
    known = nodes.select(
        "shard", "slot", "parent_slot", "digest", "depth", "n_chars", "ends",
        F.sum("n_here").over(everywhere).alias("n_convs"),
        F.min("conv_here").over(everywhere).alias("conv_id"),
        F.max("inner_here").over(everywhere).alias("inner"),
        F.min("shard").over(everywhere).alias("owner"),
        F.when((F.min("parent").over(everywhere) != F.max("parent").over(everywhere))
            | (F.min("n_chars").over(everywhere) != F.max("n_chars").over(everywhere)),
            F.raise_error(F.lit("one digest for two prefixes"))).otherwise(F.lit(0)).alias("same"),
    )
    checked = known.withColumn("n_convs", F.col("n_convs") + F.col("same").cast("long")).drop("same")
    sums = checked.groupBy("shard").applyInArrow(_sum_up, _SUMS_SQL)
    return sums.repartition("digest").sortWithinPartitions("digest", "shard").mapInArrow(_joined, _OUT_SQL)


def conversation_trie(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), one row per node. Columns other than conv_id, turn, role and text are not read."""
    return trie_of(rebuilt_turns(rows), shard_rows)
