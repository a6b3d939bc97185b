"""Line dedup of passages of few lines and of whole short documents, from the definition alone."""

from __future__ import annotations

import random

from stevedore.llm import line_dedup


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def deduped(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3))
    return {r.doc_id: r.text for r in got.collect()}


def test_passages_of_one_and_two_lines(spark):
    """A paragraph of 50 words is found between other lines; so are two lines with 50 words together; short ones stay."""
    rng = random.Random(1)
    one, two, short = words(rng, 50), [words(rng, 30), words(rng, 25)], words(rng, 49)
    unspaced = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(100))
    rows = []
    for i in range(4):
        rows.append((i, "\n".join([words(rng, 9), one, words(rng, 8), *two, words(rng, 7), short, words(rng, 6), unspaced, words(rng, 5)])))
    got = deduped(spark, rows)
    assert got[0] == rows[0][1]
    for i in range(1, 4):
        assert got[i] == "\n".join(x for x in rows[i][1].split("\n") if x not in {one, *two, unspaced})


def test_copies_of_documents_of_one_and_two_lines(spark):
    rows = [(1, "short line"), (2, "first\nsecond"), (3, " short line"), (4, "first\n \nsecond"), (5, "a\nshort line"), (6, "first\nsecond\nthird"), (7, "first")]
    assert deduped(spark, rows) == dict(rows) | {3: "", 4: " "}


def every_run(texts):
    """{id: text} without the lines in runs of 3 lines, or of 50 words, that stand earlier (texts of 3 lines or more)."""
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        lines = text.split("\n")
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if b - a >= 3 or sum(len(x.split()) for x in lines[a:b]) >= 50]
        gone, own = set(), set()
        for a, b in runs:  # by place, so that a run earlier in the same text counts
            run = tuple(lines[a:b])
            if run in seen or run in own:
                gone.update(range(a, b))
            own.add(run)
        seen |= own
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines_around_a_passage_that_stands_first_elsewhere(spark):
    """Document 1 has P, documents 2 and 3 have a P b: a and b go from document 3, whichever hash is smallest."""
    texts, n = {}, 0
    for group in range(30):
        p, a, b = ([f"{group} {part} {k}" for k in range(size)] for part, size in (("p", 3), ("a", 1), ("b", 1)))
        for lines in (p, a + p + b, a + p + b):
            texts[n] = "\n".join([f"head {n}", *lines, f"tail {n}"])
            n += 1
    got = deduped(spark, list(texts.items()))
    assert got == every_run(texts) and all(got[i] == f"head {i}\ntail {i}" for i in range(2, n, 3))


def test_every_run_that_stands_earlier(spark):
    rng = random.Random(4)
    pool = [words(rng, rng.choice([2, 5, 20, 30, 60])) for _ in range(12)]
    texts = {i: "\n".join(pool[rng.randrange(12)] if rng.random() < 0.8 else words(rng, 5) for _ in range(rng.randrange(3, 12))) for i in range(80)}
    assert deduped(spark, list(texts.items())) == every_run(texts)
