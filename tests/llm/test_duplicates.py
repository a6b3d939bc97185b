"""Line dedup, the Jaccard join and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF01
from llm_inputs import awkward  # noqa: F401  (a fixture)
from pyspark.sql import functions as F

import corpus_pipeline
from stevedore.llm import jaccard, line_dedup, pii
from stevedore.llm.cases import CASES
from stevedore.llm.common import staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\v\f\r"

# --- line dedup ------------------------------------------------------------------------


def brute_lines(docs):
    """{(id, text): text without later repeated runs}, from the definition, over the lines themselves: runs of 3 lines, of
    50 words in fewer lines, and whole documents of fewer lines."""
    keys = dict(docs)
    seen, out = set(), {}
    for d in sorted(keys, key=lambda d: (d[0] is not None, d[0] or 0, keys[d])):
        at = [i for i, line in enumerate((d[1] or "").split("\n")) if line.strip(SPACES)]
        lines = [(d[1] or "").split("\n")[i].strip(SPACES) for i in at]
        words = [len(x.split()) + len(line_dedup._UNSPACED.findall(x)) // 2 for x in lines]
        gone = set()
        if 0 < len(lines) < 3:
            if ("whole", *lines) in seen:
                gone.update(at)
            seen.add(("whole", *lines))
        for p in range(len(lines)):
            for size in (1, 2, 3):
                if p + size <= len(lines) and (size == 3 or sum(words[p : p + size]) >= 50):
                    if tuple(lines[p : p + size]) in seen:
                        gone.update(at[p : p + size])
                    seen.add(tuple(lines[p : p + size]))
        out[d] = "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone) if gone else d[1]
    return out


def keyed(df):
    from stevedore.llm.common import text_key

    return {(r.doc_id, r.text): r.k for r in df.select("doc_id", "text", text_key(F.col("text")).alias("k")).collect()}


def test_line_query(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    expected = {i: t for (i, _), t in brute_lines(keyed(docs)).items()}
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = CASES["op1_lines"](spark, SF01).collect()
    assert len(rows) == len(before)
    for r in rows:
        assert r.text_sha256 == hashlib.sha256(expected[r.doc_id].encode()).hexdigest() and r.n_chars == len(expected[r.doc_id])
        assert r.n_deleted == sum(bool(x.strip(SPACES)) for x in before[r.doc_id].split("\n")) - sum(bool(x.strip(SPACES)) for x in expected[r.doc_id].split("\n"))
    assert any(r.n_deleted for r in rows)


def test_runs_of_the_guaranteed_length_are_found(spark):
    """Wherever a run stands in two documents: WINDOW lines are enough."""
    rng = random.Random(3)
    own = lambda n: [f"line {rng.random()}" for _ in range(n)]
    length = line_dedup.WINDOW
    run = own(length)
    rows = [(i, "\n".join([*own(rng.randrange(6)), *([" "] if i % 2 else []), *run, *own(rng.randrange(6))])) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4), n_deleted="n")
    assert {r.doc_id: r.n for r in got.collect()} == {i: length * (i > 0) for i in range(60)}


def test_fingerprints_are_window_minima():
    rng = np.random.default_rng(5)
    hashes = rng.integers(-(2**63), 2**63 - 1, 3000)
    hashes[100:200] = hashes[100]
    anchor, _, place, size, picked = line_dedup.winnow(np.stack([hashes, np.ones(3000, np.int64)]))
    assert place.tolist() == list(range(2998)) and set(size) == {line_dedup.WINDOW}
    assert anchor.tolist() == [int(min(hashes[p : p + 3].view(np.uint64)).astype(np.int64)) for p in range(2998)]
    assert 0.4 < picked.mean() < 0.65  # two of WINDOW + 1 places, and nearly all of the equal ones


def test_periodic_text_makes_no_more_rows_than_it_has_lines(spark):
    """100,000 equal lines, and two texts of the same period: one run to delete for each line at most."""
    n = 100_000
    rows = [(1, "x\n" * n), (2, "a\nb\n" * 5000), (3, "b\na\n" * 5000)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert {r.id: len(r.runs) <= n for r in line_dedup.repeated_runs(df).collect()} == {1: True, 2: True, 3: True}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, n_deleted="n").collect()}
    assert {i: r.text for i, r in got.items()} == {1: "x\n", 2: "a\nb\n", 3: ""} and got[1].n == n - 1


def test_lines_awkward_rows(spark, awkward):
    poem = "\n".join(f"verse {i} of the poem" for i in range(8))
    extra = [(8, poem, "x", 1, [1]), (9, "head\n" + poem.replace("\n", "\r\n \n") + "\ntail", "x", 1, [1]), (9, poem + "\n" + poem, "x", 1, [1])]
    df = awkward.unionByName(spark.createDataFrame([*extra, extra[2]], awkward.schema))
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    expected = brute_lines(keyed(df))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((r.doc_id, expected[r.doc_id, r.text]) for r in df.collect()), key=repr)
    texts = [r.text for r in got.filter("doc_id = 9").collect()]
    assert "head\n \n \n \n \n \n \n \ntail" in texts and texts.count("") == 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, n_deleted="KEY")


# --- the Jaccard join --------------------------------------------------------------------


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(texts):
    """texts: list of rows' (id, text). [(n_shingles, smallest id reachable)], one for each row."""
    sets = [shingle_set(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    places = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            places[x].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in places[x]:
                if j < i:
                    common[j] += 1
        for j, both in common.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (name, _) in enumerate(texts):
        r = find(i)
        least[r] = min((x for x in (least.get(r), name) if x is not None), default=None)
    return [(len(sets[i]), least[find(i)]) for i in range(len(texts))]


def check_components(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    expected = sorted(((i, *c) for (i, _), c in zip(rows, brute_components(rows), strict=True)), key=repr)
    got = sorted((tuple(r) for r in jaccard.components(df).collect()), key=repr)
    assert got == expected
    return expected


def test_jaccard_query(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted((i, *c) for (i, _), c in zip(rows, brute_components(rows), strict=True))
    assert sorted(tuple(r) for r in CASES["op10_jaccard"](spark, SF01).collect()) == expected


def test_components_of_chains_copies_and_passages(spark):
    """Chains of near copies at the edge of the threshold, a large group of copies, and one passage in all."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, rows = words(60), []
    for group in range(12):
        base = words(rng.choice([30, 80, 200]))
        for _ in range(rng.choice([2, 5, 30])):
            base = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 45))):
                base[rng.randrange(len(base))] = words(1)[0]
            rows.append(" ".join(base))
    rows += [" ".join(words(70) + passage) for _ in range(60)] + [rows[0]] * 40 + [" ".join(passage)] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id LONG, text STRING").repartition(5)
    expected = check_components(df)
    assert 12 < len({c for _, _, c in expected}) < len(expected) - 100


def test_hot_blocks_are_cut_and_linked_across(spark, monkeypatch):
    """Blocks far smaller than a group of near copies: steps 2 and 3 still find each link."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "COMMON", 16)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(120)] = f"x{rng.random()}"
        rows.append(" ".join(copy))
    check_components(spark.createDataFrame(list(enumerate(rows)), "doc_id LONG, text STRING").repartition(3))


def test_jaccard_awkward_rows(spark, awkward):
    check_components(awkward)
    assert jaccard.components(awkward.limit(0)).count() == 0
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted({(r.doc_id, r.text) for r in awkward.collect()}, key=repr)


def test_tree_join_is_exact():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 120)))
        for _ in range(rng.integers(1, 5)):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 1 << 40, len(base)), base)))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert jaccard.tree_join(sets).tolist() == root
    for s in sets:
        assert (jaccard._unpacked(jaccard._packed(s)) == s).all()


def test_connected_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in jaccard.connected(spark.createDataFrame(edges, "u LONG, v LONG")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert jaccard.connected(spark.createDataFrame([], "u LONG, v LONG")) is None


# --- the pipeline --------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark):
    from plain_quality import keeps

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    now = staged(stages["quality rules"](spark, docs, SF01), "t")
    rows = {i: t for i, t in rows.items() if keeps(t)}
    assert {r.doc_id: r.text for r in now.collect()} == rows and now.columns == docs.columns
    expected = {i: t for (i, _), t in brute_lines(keyed(now)).items()}
    now = staged(stages["line dedup"](spark, now, SF01), "t")
    rows = {i: t for i, t in expected.items() if t == rows[i] or WORD.search(t)}
    assert {r.doc_id: r.text for r in now.collect()} == rows and now.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in now.collect())
    texts = sorted(rows.items())
    rows = {i: t for (i, t), (_, c) in zip(texts, brute_components(texts), strict=True) if c == i}
    now = staged(stages["n-gram Jaccard join"](spark, now, SF01), "t")
    assert {r.doc_id: r.text for r in now.collect()} == rows and now.columns == docs.columns
    now = staged(stages["PII"](spark, now, SF01), "t")
    masked = {r.doc_id: r.text for r in now.collect()}
    for i, t in rows.items():
        found = pii.find(t)
        assert (masked[i] == t) == (not found) and masked[i].count("[EMAIL]") == sum(x[1] == 0 for x in found)
    pieces = stages["best-fit packing"](spark, now, SF01)
    assert pieces.select("doc_id").distinct().count() == len(rows)
    run = corpus_pipeline.run(spark, SF01)
    assert run.columns == pieces.columns
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(same).collect())) == sorted(map(tuple, pieces.select(same).collect()))


def test_words_whose_short_hashes_agree_do_not_link(spark):
    """One-word texts that agree in 40 bits of their hash, and a set of four inside one of five."""
    from stevedore.llm import jaccard

    five = "a b c d e f g h i"  # five shingles
    rows = [(1, "w710183"), (2, "w3706449"), (3, "w710183"), (4, five), (5, "a b c d e f g h"), (6, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6}
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 2, 4, 6]
