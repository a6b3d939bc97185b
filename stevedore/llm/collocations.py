"""Phrase collocations: counts of 1 to 5 words kept as sorted streams, merged in lockstep.

Counting goes over the texts three times, in Arrow batches whose n-grams are counted by sorting integer codes: words;
pairs of frequent words, as numbers of one of 2**32 buckets only; and then all phrases whose pairs lie in buckets that reach
the least count. A phrase is never more frequent than its parts, nor a pair than its bucket, so what is below the least count rules
out the phrases around it, whatever the corpus. What is frequent goes to the tasks as bit filters of 2 MB; a filter too full
only lets more phrases be counted. Every count that is used is keyed by the words themselves.

The phrases that reach the least count are then kept in two orders: by their words from the left (a phrase directly
follows its first words and precedes its extensions to the right) and from the right. One pass over each
order with a stack of five rows gives every left part's count, every right part's count and the highest count of an
extension on that side, and the two streams meet in a merge join. No table of phrases is held in memory.

Null texts are empty, a null language is ``und``. Repeated rows count each time; an empty table gives no
rows; columns besides the text and the language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stevedore.llm.common import FILTER_BITS, in_filter, key_filter, slices, staged

MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000

#: What a byte is: 0 part of a word, 1 between words (space, tab), 2 between pieces (. , ; : ! ? and \x0A to \x0D).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int32()), ("f", pa.int64())])
_COUNTED_SQL = "lang string, phrase string, m int, f bigint"
#: Bytes of text counted at once.
_SLICE = 8 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in order, lower-cased (A-Z), with the number of their piece (no two texts share one)
    and of their text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[raw]
    inside = kind == 0
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1] - offsets[0]] = True  # a text starts here: no word or piece goes on
    first = first[:-1]
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | first))
    letters = _LOWER[raw[inside]]
    begins = np.cumsum(inside, dtype=np.int32)[starts] - 1
    piece = np.cumsum((kind == 2) | first, dtype=np.int32)[starts]
    ends = np.append(begins, len(letters)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    text = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
    return words, piece.astype(np.int64), text


def _word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """As ``xxhash64(concat_ws('\t', lang, word))`` in Spark."""
    pairs = zip(langs.to_pylist(), words.to_pylist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(f"{lang}\t{word}", 42) for lang, word in pairs), np.uint64, len(words))


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _pair_buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One of 2**32 buckets for a pair, from the hashes of its words."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each key's number among them, and their counts."""
    found, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return found, at, n


def _tokens(batch: pa.RecordBatch):
    """Per word of the batch: its piece and a number for (language, word); and what the numbers stand for."""
    words, piece, text = words_of(batch.column(0))
    coded = words.dictionary_encode()
    langs = pc.fill_null(batch.column(1), "und").dictionary_encode()
    lang_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] if len(words) else np.zeros(0, np.int64)
    size = max(1, len(coded.dictionary))
    pairs, token, n = _dense(lang_of * size + coded.indices.to_numpy(zero_copy_only=False))
    return piece, token, n, langs.dictionary.take(pa.array(pairs // size)), coded.dictionary.take(pa.array(pairs % size))


def _rows(langs: pa.Array, phrases: pa.Array, m: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(np.full(len(n), m, np.int32)), pa.array(n.astype(np.int64))], schema=_COUNTED
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", _SLICE):
        _, _, n, langs, words = _tokens(batch)
        yield _rows(langs, words, 1, n)
        total = pa.table({"lang": langs, "n": n}).group_by("lang").aggregate([("n", "sum")])
        yield _rows(total["lang"].combine_chunks(), pa.nulls(len(total), pa.string()), 0, total["n_sum"].to_numpy())


def _pairs(batch: pa.RecordBatch, bitmap: np.ndarray):
    """Where two words that the filter lets pass stand side by side in a piece, with the words' numbers and hashes."""
    piece, token, _, langs, words = _tokens(batch)
    hashes = _word_hashes(langs, words)
    ok = in_filter(bitmap, _bit(hashes))[token] if len(token) else np.zeros(0, bool)
    at = np.flatnonzero(ok[:-1] & ok[1:] & (piece[:-1] == piece[1:])) if len(token) > 1 else np.zeros(0, np.int64)
    return at, token, hashes, langs, words


_BUCKETS = pa.schema([("bucket", pa.int32()), ("f", pa.int64())])
_BUCKETS_SQL = "bucket int, f bigint"


def _count_buckets(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", _SLICE):
        at, token, hashes, _, _ = _pairs(batch, known)
        found, n = np.unique(_pair_buckets(hashes[token[at]], hashes[token[at + 1]]).astype(np.uint32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int32)), pa.array(n.astype(np.int64))], schema=_BUCKETS)


def _count_phrases(batches: Iterator[pa.RecordBatch], known: np.ndarray, known_pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", _SLICE):
        at, token, hashes, langs, words = _pairs(batch, known)
        at = at[in_filter(known_pairs, _bit(_pair_buckets(hashes[token[at]], hashes[token[at + 1]])))]
        goes_on = np.zeros(len(token) + 1, bool)
        goes_on[at] = True  # a pair that may be frequent starts here
        size, number, phrase_langs, phrases = max(1, len(words)), token[at], langs, words
        for m in range(2, MOST_WORDS + 1):
            # A phrase goes on where the pair of its last word and the next one does (in the same piece).
            on = goes_on[at + m - 2]
            at, number = at[on], number[on]
            found, number, n = _dense(number * size + token[at + m - 1])
            if not len(found):
                break
            front = pa.array(found // size)
            phrases = pc.binary_join_element_wise(phrases.take(front), words.take(pa.array(found % size)), " ")
            phrase_langs = phrase_langs.take(front)
            yield _rows(phrase_langs, phrases, m, n)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT) -> DataFrame:
    """(lang, phrase, m, f): every phrase of ``m`` = 1 to 5 words that occurs ``least`` times or more in its
    language, and for each language a row of ``m`` = 0 with its number of words."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    context = rows.sparkSession.sparkContext

    def counted(count, name: str) -> DataFrame:
        found = rows.mapInArrow(count, _COUNTED_SQL).groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f"))
        return staged(found.filter((F.col("f") >= least) | (F.col("m") == 0)), name)

    def filter_of(key: Column) -> Column:
        return F.pmod(key, F.lit(FILTER_BITS)).cast("long").alias("bit")

    words = counted(_count_words, "phrase-words")
    word_bits = key_filter(words.filter("m > 0").select(filter_of(F.xxhash64(F.concat_ws("\t", "lang", "phrase")))))
    known = context.broadcast(word_bits)
    buckets = rows.mapInArrow(lambda batches: _count_buckets(batches, known.value), _BUCKETS_SQL)
    full = buckets.groupBy("bucket").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    known_pairs = context.broadcast(key_filter(full.select(filter_of(F.col("bucket")))))
    return words.unionByName(counted(lambda batches: _count_phrases(batches, known.value, known_pairs.value), "phrase-longer"))


_SIDE_SQL = "lang string, phrase string, a bigint, parts array<bigint>, extended bigint"
_SIDE = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("parts", pa.list_(pa.int64())), ("extended", pa.int64())])


def _walk(rows: Iterator[tuple[str, list[str], str, int]]) -> Iterator[tuple]:
    """Over phrases in the order of ``words``: each with the counts of its own beginnings of 2 words and more, shortest
    first, and the highest count of a phrase that continues it by one word (0: none)."""
    stack: list[list] = []  # [lang, words, phrase, count, highest continuation]
    done = lambda: (top := stack.pop())[:1] + [top[2], top[3], [s[3] for s in stack], top[4]]
    for lang, words, phrase, count in rows:
        while stack and (stack[-1][0] != lang or words[: len(stack[-1][1])] != stack[-1][1]):
            yield done()
        if stack:
            stack[-1][4] = max(stack[-1][4], count)
        stack.append([lang, words, phrase, count, 0])
    while stack:
        yield done()


def _one_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("lang", "words", "phrase", "f")), strict=True))
    held: list = []
    for row in _walk(rows):
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SIDE, strict=True)], schema=_SIDE)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SIDE, strict=True)], schema=_SIDE)


def _stream(phrases: DataFrame, words) -> DataFrame:
    """One order of the phrases of two words and more, annotated in one pass. All that begin with the same two words lie in
    one partition, so a word that begins a third of them is still split."""
    rows = phrases.select("lang", words.alias("words"), "phrase", "f")
    return (
        rows.withColumn("two", F.slice("words", 1, 2))
        .repartition("lang", "two")
        .sortWithinPartitions("lang", "words")
        .drop("two")
        .mapInArrow(_one_side, _SIDE_SQL)
    )


_SCORED_SQL = "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
_SCORED = pa.schema([(c, pa.string() if c in ("lang", "phrase") else pa.int64()) for c in ("lang", "phrase", "a", "l", "r", "n", "score")])


def lowest_cut(a: int, lefts: list[int], rights: list[int], n: int) -> tuple[int, int, int]:
    """(score, l, r) of the cut with the lowest score, the first of equal ones. Python's integers are exact."""
    scores = [1000 * a * n // (left * right) for left, right in zip(lefts, rights, strict=True)]
    k = scores.index(min(scores))
    return scores[k], lefts[k], rights[k]


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = {name: b.column(name).to_pylist() for name in b.schema.names}
        out = []
        for i, a in enumerate(c["a"]):
            lefts = [c["l1"][i], *c["lefts"][i]]
            rights = [c["r1"][i], *c["rights"][i]][::-1]  # by cut: the longest right part first
            score, left, right = lowest_cut(a, lefts, rights, c["n"][i])
            out.append((c["lang"][i], c["phrase"][i], a, left, right, c["n"][i], score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SCORED, strict=True)], schema=_SCORED)


def score_phrases(counts: DataFrame) -> DataFrame:
    """All candidates of ``phrase_counts`` that no longer one contains as often, with their lowest cut."""
    spark = counts.sparkSession
    n = counts.filter("m = 0").select("lang", F.col("f").alias("n"))
    single = counts.filter("m = 1").select("lang", "phrase", "f")
    phrases = counts.filter("m >= 2")
    words = F.split("phrase", " ", -1)
    # A longer phrase as frequent as this one continues it on one side, through phrases of that same count.
    left = _stream(phrases, words).select("lang", "phrase", "a", F.col("parts").alias("lefts"), F.col("extended").alias("to_right"))
    right = _stream(phrases, F.reverse(words)).select("lang", "phrase", F.col("parts").alias("rights"), F.col("extended").alias("to_left"))
    both = left.join(right.hint("merge"), ["lang", "phrase"]).filter((F.col("to_right") < F.col("a")) & (F.col("to_left") < F.col("a")))
    named = both.withColumns({"first": F.substring_index("phrase", " ", 1), "last": F.substring_index("phrase", " ", -1)})
    begin = single.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l1"))
    end = single.select("lang", F.col("phrase").alias("last"), F.col("f").alias("r1"))
    joined = named.join(begin.hint("merge"), ["lang", "first"]).join(end.hint("merge"), ["lang", "last"]).join(n, "lang")
    return joined.select("lang", "phrase", "a", "l1", "lefts", "r1", "rights", "n").mapInArrow(_score, _SCORED_SQL)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, count and bytes."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    scored = staged(score_phrases(phrase_counts(docs, text, lang, least)), "phrase-scores")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
