"""Phrase collocations against plain counting, the SQL, and the awkward rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_util import compare, duck

from stevedore.llm import collocations as c
from stevedore.llm.cases import CASES, ORACLE_SQL
from stevedore.llm.common import FILTER_BITS


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least, top):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for q, b in phrases.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], n[lang], score))
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(found[:top])]
    return sorted(out)


def run(spark, rows, least=3, top=50, parts=3):
    docs = spark.createDataFrame(rows, "text STRING, lang STRING").repartition(parts)
    return sorted(tuple(r) for r in c.collocations(docs, least=least, top=top).collect())


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    import random

    rng = random.Random(seed)
    words = ["a", "B", "ab", "é", "\x01", "😀", "a-b", "und", "x"][: 4 + seed]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r"]) for _ in range(rng.randrange(60)))
    rows = [(text(), rng.choice(["en", "de", None, "und", ""])) for _ in range(40)]
    rows += [(None, "en"), ("", None), (" \n ", "fr")]
    assert run(spark, rows) == brute(rows, 3, 50)
    assert run(spark, rows, least=5, top=3, parts=1) == brute(rows, 5, 3)


def test_sql_and_whole_table(spark):
    ok, msg = compare(CASES["op13_collocations"](spark, SF01), duck(SF01), ORACLE_SQL["op13_collocations"])
    assert ok, msg


def test_repeated_rows_long_text_and_empty_table(spark):
    rows = [("the same words here " * 2000, "en")] * 3 + [("the same words", "en")]
    assert run(spark, rows, least=100) == brute(rows, 100, 50)
    assert run(spark, [], least=1) == []
    extra = spark.createDataFrame([("a b. a b", "en", 1, "x")], "text STRING, lang STRING, m INT, phrase STRING")
    assert [r.phrase for r in c.collocations(extra, least=2).collect()] == ["a b"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB .\t\n\x0b\x01é😀", max_size=12)), max_size=6), st.integers(0, 3))
def test_words_of(texts, skip):
    array = pa.array(["zz zz"] * skip + texts, pa.string()).slice(skip)
    words, piece, text = c.words_of(array)
    got = {}
    for w, p, t in zip(words.to_pylist(), piece, text, strict=True):
        got.setdefault((t, p), []).append(w)
    assert list(got.values()) == [ws for t in texts for ws in pieces(t) if ws]


def test_products_beyond_64_bits():
    assert c.lowest_cut(10**12, [10**13], [10**12 + 1], 10**17) == (1000 * 10**12 * 10**17 // (10**13 * (10**12 + 1)), 10**13, 10**12 + 1)
    assert c.lowest_cut(2, [2, 4], [4, 2], 8) == (2000, 2, 4)


def test_copies_make_phrase_rows_in_proportion_and_at_most_four_a_word():
    texts = ["the same words here, and the same words there", "b a b a b a b a b a", "one two three four five six seven"]
    every = np.full(FILTER_BITS // 64, -1, np.int64)

    def made(*copies):
        batches = (pa.record_batch({"text": texts * n, "lang": ["en"] * len(texts) * n}) for n in copies)
        return sum(len(b) for b in c._count_phrases(batches, every, every))

    words = sum(len(ws) for t in texts for ws in pieces(t))
    assert 0 < made(1) <= 4 * words
    assert made(*[1] * 25) == 25 * made(1)  # a group of 25 copies, spread: 25 times the rows, not 625 times
    assert made(25) == made(1)  # side by side: counted in one batch
