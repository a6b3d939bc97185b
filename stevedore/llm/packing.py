"""Best-fit packing of token sequences by linear grouping.

The plan depends on lengths alone, and a length is at most the capacity, so the histogram of all
pieces has at most ``capacity`` entries however many documents there are. The driver plans on the
histogram; tasks then hand each piece its place by its rank among the pieces of its length.

Plan: lengths over a share of the capacity are dealt, longest first, into groups of equal cardinality,
each rounded up to its longest member. Configurations of these few sizes are chosen by a
knapsack over the sizes still there, each used as often as the counts allow. Actual lengths then
replace the rounded ones, and the short pieces go, longest first, to the sequence whose room is
smallest but enough.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.llm.bpe_trie import encoder
from stevedore.llm.common import slices, staged

CAPACITY, SEPARATOR = 2048, 0
#: Lengths over capacity / share take part in the grouping, into GROUPS groups. Each share is planned;
#: the plan with the fewest sequences wins.
LARGE, GROUPS = (2, 3), 200
#: Pieces of one length are ranked in this many shares, so that a length that many have is no hot group.
SHARES = 256


def _configurations(groups: list[list[int]], sizes: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """(uses of each size, how often) until no piece of any group is left. ``groups``: counts, used up."""
    left = np.array([sum(g) for g in groups], np.int64)
    while left.any():
        first = int(np.argmax(left > 0))  # the largest size still there is in the configuration
        room = capacity - sizes[first]
        # best[c]: largest sum of at most c by sizes still there; fill: the size added last.
        best, fill = np.zeros(room + 1, np.int64), np.full(room + 1, -1)
        for c in range(1, room + 1):
            best[c], fill[c] = best[c - 1], -1
            for k in np.flatnonzero(left):
                if sizes[k] <= c and (total := best[c - sizes[k]] + sizes[k]) > best[c]:
                    best[c], fill[c] = total, k
        uses, c = np.zeros(len(sizes), np.int64), room
        uses[first] = 1
        while c > 0:
            if (k := fill[c]) < 0:
                c -= 1
                continue
            if uses[k] < left[k]:
                uses[k] += 1
            c -= sizes[k]
        often = int(min(left[k] // uses[k] for k in np.flatnonzero(uses)))
        left -= uses * often
        yield uses.tolist(), often


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The runs of the best of the plans by ``grouped``."""
    return min((grouped(histogram, capacity, share) for share in LARGE), key=lambda runs: max((first + -(-n // each) for _, _, n, each, first, _ in runs), default=0))


def grouped(histogram: dict[int, int], capacity: int, part: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, pieces a sequence, first sequence, first offset) for runs of ranks.

    Piece ``first rank + j`` of a run is in sequence ``first sequence + j // each`` at ``first offset +
    (j % each) * length``.
    """
    if bad := [n for n in histogram if not 0 < n <= capacity]:
        raise ValueError(f"lengths must be from 1 to {capacity}: {bad[:5]}")
    runs: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)  # ranks given of each length
    sequences = 0
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences (first, number)

    def put(length: int, each: int, first: int, number: int, offset: int) -> None:
        runs.append((length, used[length], each * number, each, first, offset))
        used[length] += each * number

    large = sorted((n for n in histogram if n > capacity // part and n < capacity), reverse=True)
    if full := histogram.get(capacity, 0):
        put(capacity, 1, 0, full, 0)
        sequences = full
    total = sum(histogram[n] for n in large)
    groups: list[list[list[int]]] = []  # of [length, count], longest first
    share, taken = -(-total // GROUPS), 0
    for n in large:
        left = histogram[n]
        while left:
            if taken % share == 0:
                groups.append([])
            k = min(left, share - taken % share)
            groups[-1].append([n, k])
            left, taken = left - k, taken + k
    sizes = [g[0][0] for g in groups]
    for uses, often in _configurations([[c for _, c in g] for g in groups], sizes, capacity):
        slots = [g for g, n in enumerate(uses) for _ in range(n)]
        taken_by: list[list[tuple[int, int]]] = []
        for g in slots:  # each slot takes the next ``often`` pieces of its group
            need, got = often, []
            while need:
                n, c = groups[g][0]
                k = min(c, need)
                got.append((n, k))
                need -= k
                if k == c:
                    groups[g].pop(0)
                else:
                    groups[g][0][1] -= k
            taken_by.append(got)
        at = 0
        while at < often:  # runs of sequences with the same actual lengths
            step = min(got[0][1] for got in taken_by)
            offset = 0
            for got in taken_by:
                n, c = got[0]
                put(n, 1, sequences + at, step, offset)
                offset += n
                got[0] = (n, c - step)
                if c == step:
                    got.pop(0)
            if offset < capacity:
                rooms[capacity - offset].append((sequences + at, step))
            at += step
        sequences += often
    for n in sorted((n for n in histogram if n <= capacity // part and n < capacity), reverse=True):
        left = histogram[n]
        for room in sorted(r for r in rooms if r >= n):
            each = room // n  # best fit stays with the tightest sequence until it is too full
            while left and rooms[room]:
                first, number = rooms[room].pop()
                whole = min(number, left // each)
                if whole:
                    put(n, each, first, whole, capacity - room)
                    left -= each * whole
                    if rest := room - each * n:
                        rooms[rest].append((first, whole))
                if whole < number and left:  # fewer than ``each`` are left: one more sequence takes them
                    put(n, left, first + whole, 1, capacity - room)
                    if rest := room - left * n:
                        rooms[rest].append((first + whole, 1))
                    left, whole = 0, whole + 1
                if whole < number:
                    rooms[room].append((first + whole, number - whole))
            if not rooms[room]:
                del rooms[room]
            if not left:
                break
        if left:
            each = capacity // n
            if whole := left // each:
                put(n, each, sequences, whole, 0)
                if rest := capacity - each * n:
                    rooms[rest].append((sequences, whole))
                sequences += whole
            if rest := left % each:
                put(n, rest, sequences, 1, 0)
                rooms[capacity - rest * n].append((sequences, 1))
                sequences += 1
    return runs


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ids (by ``bpe_trie``, then the separator) in pieces of ``capacity``: doc_id, piece, start, length, ids_crc32."""
    schema = T.StructType([docs.schema[doc_id], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])
    tail, step = np.array(SEPARATOR, "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, text):
            rows, out = [], ([], [], [], [])
            for i, ids in enumerate(bpe.encode_batch(batch.column(text).to_pylist())):
                ids += tail
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    for column, value in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def pack(lengths: DataFrame, *, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Append ``sequence_id`` and ``offset``: a gapless packing of rows of the given lengths (1 to
    ``capacity``, else ValueError) into few sequences. ``lengths`` must give the same rows each time it
    is read (a staged table). Equal rows are interchangeable. An empty table stays empty.
    """
    share = F.pmod(F.xxhash64(*lengths.columns), F.lit(SHARES)).cast("int")
    # At most capacity x SHARES rows, whatever the size of the table.
    counts = lengths.groupBy(F.col(length).alias("_len"), share.alias("_share")).agg(F.count("*").alias("_n"))
    table = sorted((r["_len"], r["_share"], r["_n"]) for r in counts.collect())
    histogram: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for n, s, c in table:
        before[n, s] = histogram[n]
        histogram[n] += c
    keyed = np.array([n * SHARES + s for n, s in before], np.int64)
    ranks = np.array(list(before.values()), np.int64)
    runs = np.array(sorted(plan(dict(histogram), capacity)), np.int64).reshape(-1, 6)
    widest = max(histogram.values(), default=0) + 1
    starts = runs[:, 0].astype(object) * widest + runs[:, 1] if widest * capacity >= 1 << 63 else runs[:, 0] * widest + runs[:, 1]
    context = lengths.sparkSession.sparkContext.broadcast((keyed, ranks, runs, starts))
    schema = T.StructType([*lengths.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    ranked = lengths.withColumn("_share", share).withColumn("_rank", F.row_number().over(W.partitionBy(length, "_share").orderBy(*lengths.columns)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed, ranks, runs, starts = context.value
        for batch in batches:
            n = np.asarray(batch.column(length), np.int64)
            r = np.asarray(batch.column("_rank"), np.int64) - 1
            r += ranks[np.searchsorted(keyed, n * SHARES + np.asarray(batch.column("_share"), np.int64))]
            run = runs[np.searchsorted(starts, n * widest + r, side="right") - 1]
            j = r - run[:, 1]
            kept = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(run[:, 4] + j // run[:, 3]), pa.array(run[:, 5] + j % run[:, 3] * n)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def best_fit_pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all rows of ``docs``: one row for each piece.

    Null and empty texts are one piece of the separator alone. Texts of any length are cut into pieces
    of ``capacity``. Repeated rows and null ids are packed like any other. An empty table gives none.
    Other columns are ignored.
    """
    return pack(staged(pieces(docs, path, capacity=capacity, doc_id=doc_id, text=text), "pieces"), capacity=capacity)
