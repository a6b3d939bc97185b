"""A small input with every awkward case."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))

#: null, empty, blank and very long texts, repeated rows and ids, a null id, characters beyond one unit.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "the same text twice over in two rows of one id and yet one more time"),
    (5, "the same text twice over in two rows of one id and yet one more time"),
    (5, "another text under the same id"),
    (None, "a text without an id"),
    (None, None),
    (6, "naïve 😀 ﬁ Ünï   café​ <|endoftext|> ΑΣ"),
    (7, "one two three four"),
]


@pytest.fixture()
def awkward(spark):
    """doc_id, text, and columns whose names an operator might use itself."""
    rows = [(i, t, "x", 1, [1]) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, key STRING, hash INT, runs ARRAY<INT>").repartition(3)
