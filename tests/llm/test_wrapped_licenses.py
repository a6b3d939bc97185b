"""License notices wrapped over lines."""

from __future__ import annotations

import textwrap

import pytest

from stevedore.llm import licenses

PROSE = "The harbour opened late that year and nobody could say when the boats would return. " * 12


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "    "])
@pytest.mark.parametrize("width", [40, 72])
def test_each_template_wrapped(prefix, width):
    for name, text, _ in licenses.TEMPLATES:
        notice = textwrap.fill(text, width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False, break_on_hyphens=False)
        whole = f"{PROSE}\n\n{notice}\n{prefix}\n{PROSE}"
        found = licenses.scan(whole)
        assert [x[2] for x in found] == [name], notice
        assert [w.lower() for w in licenses._WORD.findall(whole[found[0][0] : found[0][1]])] == [w.lower() for w in licenses._WORD.findall(text)]


def test_wrapped_notices_one_after_another():
    """All templates in one text, with and without words between: each is found, none is found twice."""
    for between in ("\n", "\n\n" + PROSE + "\n\n"):
        whole = between.join(textwrap.fill(t, 50, break_long_words=False) for _, t, _ in licenses.TEMPLATES)
        found = licenses.scan(whole)
        assert [x[2] for x in found] == [n for n, _, _ in licenses.TEMPLATES]
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_wrapped_clean_texts():
    for clean in ("He has a driver\nlicense since 2020.", "Licensed under the Apache\nLicense, Version 1.1.", "free\nsoftware", "public\n# domain"):
        assert licenses.scan(clean) == []
