"""Line dedup by winnowing over line hashes.

Each document is the sequence of its lines with a word. Of every WINDOW consecutive lines the least line hash is
selected, and a place that several windows select is one fingerprint. A run of WINDOW lines that stands twice has the same
minimum in both places, so both select it: what repeats is sure to hold a fingerprint that occurs twice. Only the windows
around such fingerprints go on. They are joined by the hash of all their lines with the first place those stand at,
and a match reaches over one window after another, on both sides of its fingerprint, as far as they stand earlier; these lines
are deleted. A fingerprint by itself wouldn't do: its first place may be in a document where the run ends sooner.

Fewer lines with PASSAGE words together, and whole documents of fewer than WINDOW lines, are fingerprints of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.llm.common import FILTER_BITS, fresh, in_filter, key_filter, slices, staged, text_key

#: Runs of WINDOW lines are found: the least line hash of each WINDOW lines is a fingerprint.
WINDOW = 3
_SPACES = " \t\n\v\f\r"

#: Lines of so many words together are a passage, found even where they are fewer than WINDOW.
PASSAGE = 50
#: Scripts without spaces between words: two characters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def line_hashes(text: str) -> np.ndarray:
    """Of the lines with a word, without white space around them: 64-bit hashes (first row) and numbers of
    words (second row)."""
    lines = [x for line in text.split("\n") if (x := line.strip(_SPACES))]
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64).view(np.int64)
    words = [len(x.split()) + (0 if x.isascii() else len(_UNSPACED.findall(x)) // 2) for x in lines]
    return np.stack([hashes, np.array(words, np.int64)])


def _grams(lines: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of each ``size`` consecutive lines."""
    n = len(lines) - size + 1
    with np.errstate(over="ignore"):
        grams = np.full(n, salt, np.uint64)
        for i in range(size):
            grams = (grams ^ lines.view(np.uint64)[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
    return grams.view(np.int64)


def passages(lines: np.ndarray) -> list[tuple[int, int, int]]:
    """(hash, place, lines) of the runs of fewer than WINDOW lines that are passages by themselves: from each line
    on and up to each line, the shortest with PASSAGE words; and all lines of a shorter document."""
    hashes, words = lines
    out: set[tuple[int, int, int]] = set()
    for size in range(1, min(WINDOW, len(hashes) + 1)):
        total = np.lib.stride_tricks.sliding_window_view(words, size).sum(axis=1)
        # The shortest one from its first line on, or up to its last.
        whole = (total >= PASSAGE) & ((total - words[size - 1 :] < PASSAGE) | (total - words[: len(total)] < PASSAGE))
        if whole.any():
            grams = _grams(hashes, size, size)
            out.update((int(grams[p]), int(p), size) for p in np.flatnonzero(whole))
    if 0 < len(hashes) < WINDOW:
        out.add((int(_grams(hashes, len(hashes), WINDOW + len(hashes))[0]), 0, len(hashes)))
    return sorted(out, key=lambda x: (x[1:], x[0]))


def winnow(lines: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each window of WINDOW lines: the fingerprint it selects (its least line hash, the last of equals), the hash of
    all its lines, its place, its number of lines, and whether it is the first window to select that place. Then the
    passages of fewer lines, each its own fingerprint."""
    hashes = lines[0]
    alone = passages(lines)
    own, places, sizes = (np.array([x[i] for x in alone], np.int64) for i in range(3))
    if len(hashes) < WINDOW:
        return own, own, places, sizes, np.ones(len(alone), bool)
    around = np.lib.stride_tricks.sliding_window_view(hashes.view(np.uint64), WINDOW)
    at = np.arange(len(around)) + (WINDOW - 1 - around[:, ::-1].argmin(axis=1))
    picked = np.concatenate([[True], at[1:] != at[:-1]])
    return (
        np.concatenate([hashes[at], own]),
        np.concatenate([_grams(hashes, WINDOW), own]),
        np.concatenate([np.arange(len(around)), places]),
        np.concatenate([np.full(len(around), WINDOW), sizes]),
        np.concatenate([picked, np.ones(len(alone), bool)]),
    )


def joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs [from, to) that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def delete_lines(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the lines with a word whose numbers lie in one of the runs."""
    todo = iter(joined_runs(runs))
    low, high = next(todo, (-1, -1))
    out, n = [], 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            if n == high:
                low, high = next(todo, (-1, -1))
            n += 1
            if low < n <= high:
                continue
        out.append(line)
    return "\n".join(out)


def repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, runs) of each document with lines to delete: runs [low, high) of its lines with a word, which may overlap.
    ``key`` is ``text_key`` of its text. Documents are in order of id (null first), then key.

    No more rows are made than the documents have windows and passages, however often a line or a run recurs."""
    given = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    kinds = {"anchor": T.LongType(), "hash": T.LongType(), "place": T.LongType(), "size": T.LongType(), "picked": T.BooleanType()}
    marks = T.StructType([T.StructField(n, t) for n, t in kinds.items()])
    schema = T.StructType([given.schema["id"], given.schema["key"], T.StructField("marks", T.ArrayType(marks))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [winnow(line_hashes(t or "")) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(f[0]) for f in found)])
            flat = [pa.array(np.concatenate([f[i] for f in found])) for i in range(len(kinds))]
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=list(kinds)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), each], names=schema.names)

    # Rows equal in id and text are one document.
    table = staged(given.mapInArrow(run, schema).dropDuplicates(["id", "key"]), "windows")
    # Fingerprints that occur once hold nothing that repeats. The filter never misses one that occurs twice.
    twice = table.select(F.inline("marks")).filter("picked").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(twice.select(F.col("anchor").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit"))))
    single = T.StructType([*schema.fields[:2], *(f for f in marks.fields if f.name in ("hash", "place", "size"))])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("marks")
            flat, row = pc.list_flatten(column), pc.list_parent_indices(column)
            chosen = pa.array(np.flatnonzero(in_filter(bits.value, pc.struct_field(flat, "anchor").to_numpy() & (FILTER_BITS - 1))))
            row, flat = row.take(chosen), flat.take(chosen)
            parts = [pc.struct_field(flat, c) for c in single.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("key").take(row), *parts], names=single.names)

    each = table.mapInArrow(near, single)
    place = F.struct("id", "key", "place")
    first = staged(each.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1).select("hash", "first"), "first-places")
    later = each.join(first, "hash").filter(place > F.col("first"))
    runs = F.collect_list(F.struct(F.col("place").alias("low"), (F.col("place") + F.col("size")).alias("high")))
    return later.groupBy("id", "key").agg(runs.alias("runs"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_deleted: str | None = None) -> DataFrame:
    """The same rows and columns, ``text`` without lines of later repeated runs (and, if named, a column
    with the number of deleted lines).

    Each line goes that is in a run of WINDOW lines or more, or of PASSAGE words or more, that stands
    earlier too (in an earlier document by id, or earlier in the same one), wherever its parts stand
    first; so do the lines of a document of fewer lines that is the same as an earlier one. Other lines stay. Lines are compared without white space around them; lines without a
    word don't count and stay. Null and empty texts stay as they are; null ids come first. Rows equal in
    id and text are one document and get the same result. ``n_chars``, where there is one, follows the new text.
    """
    if n_deleted and n_deleted.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {n_deleted} exists")
    key, other, runs = fresh(docs.columns), fresh(docs.columns), fresh(docs.columns)
    found = repeated_runs(docs, doc_id=doc_id, text=text)
    found = found.select(F.col("id").alias(other), F.col("key").alias(key), F.col("runs").alias(runs)).hint("shuffle_hash")
    own = fresh(docs.columns)
    keyed = docs.withColumn(own, text_key(F.col(text)))
    joined = keyed.join(found, (F.col(own) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(other)), "left").drop(own, key, other)
    schema = T.StructType([*docs.schema.fields, *([T.StructField(n_deleted, T.LongType())] if n_deleted else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            todo = columns.pop(runs).to_pylist()
            before = columns[text].to_pylist()
            after = [t if not r or not t else delete_lines(t, [(x["low"], x["high"]) for x in r]) for t, r in zip(before, todo, strict=True)]
            columns[text] = pa.array(after, columns[text].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if a is b else len(b) for a, b, n in zip(before, after, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            if n_deleted:
                lost = [sum(high - low for low, high in joined_runs([(x["low"], x["high"]) for x in r or ()])) for r in todo]
                columns[n_deleted] = pa.array(lost, pa.int64())
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    return joined.mapInArrow(run, schema)
