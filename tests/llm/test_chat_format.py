"""Chat formatting: round trips, parts in order, places, the SQL, and the awkward rows."""

from __future__ import annotations

import hashlib
import json

import pytest
from conftest import SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_util import compare, duck

from stevedore.llm import chat_format as c
from stevedore.llm.cases import CASES, MARKS, ORACLE_SQL

T = c.Template()
#: Texts made of what marks and escapes are made of.
TRICKY = st.lists(st.sampled_from(["<", "|", "\\", ">", "im_end", T.start, T.end, "<\\|", "\n", "é", "😀", "n", "<|image|>"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_escape_is_reversible(text):
    assert c.unescape(c.escape(text)) == text and "<|" not in c.escape(text)
    assert c.unescape_role(c.escape_role(text)) == text and "\n" not in c.escape_role(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5), st.integers(1, 7))
def test_turns_come_back(turns, cut):
    text = "".join(c.format_turn(role, said, None, T)[0] for role, said in turns)
    assert list(c.read_turns(iter([text]), T)) == turns
    assert list(c.read_turns((text[i : i + cut] for i in range(0, len(text), cut)), T)) == turns


@settings(max_examples=200, deadline=None)
@given(st.lists(TRICKY, min_size=1, max_size=4))
def test_texts_side_by_side_make_no_mark(texts):
    formatted, spans, _ = c.format_turn("assistant", None, json.dumps(texts), T)
    assert formatted.count("<|") == 2
    assert "".join(c.unescape(formatted[a:b]) for a, b in spans) == "".join(texts)


def test_parts_in_order():
    inner = {"type": "document", "ref": "in.pdf", "parts": ["x", {"type": "audio", "seconds": 0.5}]}
    parts = [
        "see <|image|> ",
        {"type": "image", "ref": "a.png", "width": 56, "height": 57},
        {"type": "text", "text": None},
        {"type": "document", "url": "d.pdf", "parts": [{"type": "text", "text": "page"}, {"type": "image"}, inner, None]},
        {"type": "document", "pages": 3},
        {"type": "video", "path": "v"},
        7,
        "end",
    ]
    formatted, spans, found = c.format_turn("assistant", "not used", json.dumps(parts), T)
    marked = "see <\\|image|> <|image|><|document|>page<|image|><|document|>x<|audio|><|/document|><|/document|><|document|><|/document|><|attachment|><|attachment|>end"
    assert formatted == f"{T.start}assistant\n{marked}{T.end}\n"
    assert [formatted[a:b] for a, b in spans] == ["see <\\|image|> ", "page", "x", "end"]
    assert [(a["kind"], a["ref"], a["n_tokens"]) for a in found] == [
        ("image", "a.png", 6), ("document", "d.pdf", 256 + 13), ("image", None, 256), ("document", "in.pdf", 13),
        ("audio", None, 13), ("document", None, 1536), ("other", "v", 0), ("other", None, 0),
    ]
    assert all(formatted[a["at"] :].startswith(("<|image", "<|audio", "<|document", "<|attachment")) for a in found)


@pytest.mark.parametrize(
    ("content", "expected"),
    [("not json", "not json"), ("{}", "{}"), ("[]", ""), ("", ""), ("[" * 100_000, "[" * 100_000), ('["\\ud800é"]', "�é"), ("[1e999, true, NaN]", "<|attachment|>" * 3)],
)
def test_other_contents(content, expected):
    assert c.format_turn("user", "t", content, T)[0] == f"{T.start}user\n{expected}{T.end}\n"


def test_deep_documents_without_recursion():
    part = "x"
    for _ in range(300):
        part = {"type": "document", "parts": [part]}
    formatted, _, found = c.format_turn("user", None, json.dumps([part]), T)
    assert formatted.count("<|document|>") == 300 == len(found) == formatted.count("<|/document|>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


AWKWARD = [
    (1, 1, "assistant", "later"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, 0, "a\nb\\n", ""),
    (None, 0, "assistant", "no id"), (None, 1, "user", MARKS), (3, 0, "assistant", "x" * 200_000), (3, 1, "assistant", "<"), (3, 2, "assistant", "|"),
]


def test_awkward_rows(spark):
    rows = [(*r, "x", [1]) for r in AWKWARD]
    df = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING, formatted STRING, loss ARRAY<INT>").repartition(4)
    got = {r.conv_id: r for r in c.digest(df).collect()}
    assert len(got) == 4
    assert got[1].turns_sha256 == sha("user\nfirst\n" + "\n\n" * 2 + "assistant\nlater\n") and got[1].n_turns == 4
    assert got[2].turns_sha256 == sha("a\nb\\n\n\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert got[None].loss_sha256 == sha("no id") and got[None].turns_sha256 == sha(f"assistant\nno id\nuser\n{MARKS}\n")
    assert got[3].loss_sha256 == sha("x" * 200_000 + "<|") and got[3].loss_chars == 200_002
    assert c.digest(df.limit(0)).collect() == []


def test_parts_and_whole_conversations(spark):
    parts = json.dumps(["look ", {"type": "image", "ref": "i", "width": 28, "height": 28}])
    rows = [(5, 1, "assistant", "it's <|x|>", None), (5, 0, "user", "", parts), (6, 0, "user", "hi", None)]
    df = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING, parts STRING").repartition(3)
    formatted = c.format_chat(df, content="parts")
    five = next(r for r in c.whole(formatted).collect() if r.conv_id == 5)
    assert five.formatted == "<|im_start|>user\nlook <|image|><|im_end|>\n<|im_start|>assistant\nit's <\\|x|><|im_end|>\n"
    assert [five.formatted[s.start : s.end] for s in five.loss] == ["it's <\\|x|>"]
    assert [(a.ref, a.n_tokens, five.formatted[a["at"] :][:9]) for a in five.attachments] == [("i", 1, "<|image|>")]
    assert [(r.place, r.start) for r in formatted.filter("conv_id = 5").orderBy("place").collect()] == [(0, 0), (1, 42)]


def test_sql_and_whole_table(spark):
    ok, msg = compare(CASES["op11_chat"](spark, SF01), duck(SF01), ORACLE_SQL["op11_chat"])
    assert ok, msg
