"""The default policy, written again without the ledger."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def keeps(text: str) -> bool:
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    letters = sum(unicodedata.category(c)[0] in "LM" for c in text)
    return not (
        n < 50
        or 2 * len(covered) > n
        or 10 * sum(c in "#*$%&|<>" for c in text) > 3 * n
        or 2 * (len(lines) - len(set(lines))) > len(lines)
        or not 2 * n <= chars <= 20 * n
        or 10 * upper > 6 * letters
        or 10 * letters < 6 * chars
    )
