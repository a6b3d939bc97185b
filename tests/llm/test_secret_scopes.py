"""Weak parts are linked within their scope, however far apart, and never beyond: against brute force over random blocks."""

from __future__ import annotations

import random
import re

from stevedore.llm import secrets
from stevedore.llm.common import staged

PATTERNS = [(kind, re.compile(pattern, re.ASCII), role) for kind, pattern, role in secrets.PARTS]


def scope_ends(text):
    """Places of line ends before a blank line, a section header or a rule, line by line."""
    at, out = 0, []
    lines = text.split("\n")
    for here, below in zip(lines, lines[1:] + [None], strict=True):
        at += len(here) + 1
        if below is None:
            break
        bare = below.strip(" \t\r")
        header = re.fullmatch(r"\[{1,2}[A-Za-z][^\[\],]*\]{1,2}", bare) and not below.startswith("\r")
        rule = re.fullmatch(r"-{3,}|={3,}", below.rstrip(" \t\r"))
        last = at + len(below) == len(text)
        if (not bare and not last) or header or rule:
            out.append(at)
    return out


def brute(text):
    ends = scope_ends(text)
    parts = []
    for kind, pattern, role in PATTERNS:
        for m in pattern.finditer(text):
            if kind != "assign" or len(m[1]) >= 12:
                parts.append((kind, role, m.start(), m.end(), sum(e <= m.start() for e in ends)))
    late = secrets.LATE

    def meets(w):
        for o in parts:
            apart = o[2] >= w[3] or o[3] <= w[2]
            if o[4] == w[4] and o[1] != w[1] and (apart or (w[0] not in late and o[0] not in late)):
                return True
        return False

    near = [p for p in parts if p[0] in secrets.REPORTED and meets(p)]
    order = lambda kind: 0 if kind in secrets.KINDS else late.get(kind, 1)
    certain = [p for p in parts if p[0] in secrets.KINDS] + [p for p in near if p[0] != "weak_token"]
    weak = [w for w in near if not any(o[2] < w[3] and o[3] > w[2] and order(o[0]) < order(w[0]) for o in certain)]
    rank = secrets.KINDS.index
    spans = {(p[2], rank(p[0]), p[3], True) for p in parts if p[0] in secrets.KINDS}
    spans |= {(p[2], rank(secrets.REPORTED[p[0]]), p[3], False) for p in weak}
    return sorted(spans)


PIECES = [
    "aws_access_key_id = AKIA1234ABCD", "AKIA1234ABCD5678", "ASIAIOSFODNN7EXAMPLE", "aws_secret = aB3dE5gH7jK9mN1pQ3sT", "aB3dE5gH7jK9mN1pQ3sT",
    "secret_key=q7w8z9x0k1m2", "pwd: hunter22x", "JBSWY3DPEHPK3PXPJBSWY3DPEHPK3PXP", "user: bob", "https://api.example.com", "postgres://db.example.com",
    "password = abcdefghijklmnop", "0123456789abcdef0123", "# a comment", "é😀 words in between", "x" * 300, "region = eu",
]
BREAKS = ["\n\n", "\n \t\n", "\r\n\r\n", "\n[default]\n", "\n[profile dev]\n", "\n[[server]]\n", "\n---\n", "\n"]


def random_text(rng):
    lines = [rng.choice(PIECES) for _ in range(rng.randint(1, 9))]
    return "".join(x + rng.choice(BREAKS if rng.random() < 0.4 else ["\n", "\r\n", " "]) for x in lines)


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    return {r.doc_id: [(s.start, s.rank - 1, s.end, s.base) for s in r.spans] for r in secrets.find(df).collect()}


def test_links_in_random_blocks(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(1500)]
    got = spans(spark, texts)
    expected = [brute(t) for t in texts]
    assert sum(any(not s[3] for s in e) for e in expected) > 300
    for i, e in enumerate(expected):
        assert got[i] == e, texts[i]


def test_a_block_holds_its_parts_together_at_any_distance(spark):
    identifier, secret = "aws_access_key_id = AKIA1234ABCD5678", "aws_secret_access_key = aB3dE5gH7jK9mN1pQ3sT"
    comments = "".join(f"# comment number {i} on how the key is used\n" for i in range(2000))
    together = f"[default]\n{identifier}\n{comments}{secret}\n"
    apart = [f"[a]\n{identifier}\n{b}{secret}\n" for b in ("\n", "[b]\n", "---\n", " \t\n")]
    got = spans(spark, [together, *apart])
    assert got[0] == brute(together)
    assert [s[0] for s in got[0]] == [together.index("AKIA"), together.index("aB3dE5gH7jK9mN1pQ3sT")]
    # An identifier or a secret alone in its block says nothing.
    assert all(got[i] == brute(t) == [] for i, t in enumerate(apart, 1))


def test_a_scope_of_many_parts_makes_no_pairs(spark):
    n = 4000
    text = "\n".join(["user: bob", "pwd: hunter22x"] * n)
    df = spark.createDataFrame([(0, text)], "doc_id LONG, text STRING")
    table = secrets.parts(df)
    places = staged(secrets.located(table), "places")
    assert secrets.linked(places, table).count() == 2 * n
    assert secrets.scoped(places, table).count() == places.count() == 2 * n
