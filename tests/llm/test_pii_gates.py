"""A disguise is decoded by what it is, not by what else its text holds."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stevedore.llm import pii

PHONE = pii.KINDS.index("phone")


@pytest.mark.parametrize("number", ["+l (555) 123-4567", "+l 555 123 4567 890", "plus one 5 five 5 one 2 three 4 five 6"])
def test_numbers_alone_and_beside_other_disguises(number):
    for before in ("", "l0 and ", "one two three, "):
        text = f"{before}call {number}!"
        at = len(before) + len("call ")
        assert [(s, e) for s, k, e, base in pii.find(text) if k == PHONE and not base] == [(at, at + len(number))], text


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("0123456789OoIl ().-+x"), max_size=24), st.lists(st.sampled_from(["one", "Two", "fünf", "\u017fix", "dot", "12", "plus", "word", ", ", " ", "-", "(", ")"]), max_size=14))
def test_no_run_is_lost_before_its_own_conditions(fakes, names):
    """Nothing added to a text makes a run in it count that doesn't count alone."""
    apart = "\n;;;\n"
    assert pii._letters_for_digits(fakes) == [e for e in pii._letters_for_digits(fakes + apart + "l0l2345") if e[1] <= len(fakes)]
    spelled = "".join(names)
    assert pii._spelled_digits(spelled) == [e for e in pii._spelled_digits(spelled + apart + "one two three four") if e[1] <= len(spelled)]


@pytest.mark.parametrize(
    ("number", "kind"),
    [
        ("plus 49 151 two three 45 678 90", "phone"),
        ("+49 151 two 345 678 90", "phone"),
        ("plus one 555 123 4567", "phone"),
        ("4111 1111 one 111 1111", "card"),
        ("4111 1111 1111 111 one", "card"),
    ],
)
def test_few_spelled_digits_among_real_ones(number, kind):
    for before, after in (("", ""), ("call ", "!"), ("ünï 😀 ", " one two three")):
        text = before + number + (";" + after if after else "")
        found = [(s, e) for s, k, e, base in pii.find(text) if pii.KINDS[k] == kind and not base]
        assert found == [(len(before), len(before) + len(number))], text


@pytest.mark.parametrize(
    "clean",
    ["In 1990 one of 2500 visitors saw two 30 metre boats.", "plus one 5 and more", "1 one 2 3000 two 45", "4111 1111 1111 111 two", "scores: 12, five, 30, 4, 1999 two 77"],
)
def test_few_spelled_digits_in_clean_texts(clean):
    assert pii.find(clean) == []


def test_words_beside_whole_numbers_are_words():
    for text, end in (("+1 (848) 555-1373 Un an", 17), ("call +49 151 2345 6789 one day", 22), ("4111 1111 1111 1111 one", 19)):
        assert [(e, base) for _, _, e, base in pii.find(text)] == [(end, True)], text
