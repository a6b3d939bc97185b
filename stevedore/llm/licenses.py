"""License statements by conditional compression.

Candidate blocks (the words around a mention of a license, over line breaks) are compressed alone and with each template as a raw
zstandard dictionary: the template that saves the largest share of a block's bytes is the best guess.
A guess counts only if the exact wording confirms it: the template's words are aligned with the block's, and
missing or extra words are few and touch none of the words that tell this license from others.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.llm.common import slices

# The usual wordings of license notices, and the words that must be there as they are.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache 2 0"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "This project is licensed under the terms of the MIT license.", "mit"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "permission granted free charge"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "general 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "general 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser 2 1"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0.", "mozilla 2 0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2 0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", "bsd 3"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", "bsd 2"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution permitted conditions"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4 0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd 4 0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution 4 0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "commons attribution sharealike 4 0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "commons attribution noncommercial 4 0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0.", "cc0 1 0"),
    ("CC-BY-3.0", "Licensed under CC BY 3.0.", "cc by 3 0"),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0.", "cc by sa 3 0"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "commons attribution 3 0"),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "commons attribution sharealike 3 0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1 0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2 0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "eclipse v1 0"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "permission anyone alter freely"),
    # Short names.
    ("GPL-3.0", "Licensed under GPLv3.", "gplv3"),
    ("GPL-3.0", "the GPL v3 license", "gpl v3"),
    ("GPL-2.0", "Licensed under GPLv2.", "gplv2"),
    ("GPL-2.0", "the GPL v2 license", "gpl v2"),
    ("LGPL-3.0", "Licensed under LGPLv3.", "lgplv3"),
    ("AGPL-3.0", "Licensed under AGPLv3.", "agplv3"),
    # Headings of the licenses' own texts.
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gnu general 3 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gnu general 2 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gnu lesser 3 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "gnu lesser 2 1 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "gnu affero 3 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "apache 2 0 2004"),
    ("MIT", "The MIT License (MIT) Copyright (c)", "mit copyright"),
    ("MIT", "MIT License Copyright (c)", "mit copyright"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
)
# Tags and fields: these short forms count only as they are, marks included.
_NAMED = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "BSL-1.0", "EPL-2.0", "Unlicense", "Zlib")
_PLAIN = len(TEMPLATES)
TEMPLATES += tuple((name, f"{form}: {name}", " ".join(re.findall(r"[a-z0-9]+", name.lower()))) for form in ("SPDX-License-Identifier", "License") for name in _NAMED)
_MENTION = re.compile(r"licen|permission|redistribut|public[\W_]+domain|free[\W_]+software|cc[\W_]+by|cc0", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
#: Words of a template that may be missing, and words that may stand between, as shares of the template's.
MISSING, EXTRA = 0.3, 0.25
#: So many words on either side of a mention are a candidate, whatever white space and marks stand between.
AROUND = 60


@lru_cache(maxsize=1)
def _prepared():
    words = [[w.lower() for w in _WORD.findall(t)] for _, t, _ in TEMPLATES]
    dictionaries = [zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t, _ in TEMPLATES]
    with_each = [zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False) for d in dictionaries]
    return words, with_each, zstandard.ZstdCompressor(level=9, write_content_size=False)


def confirm(template: int, words: list[str]) -> tuple[int, int, int, int] | None:
    """(first word, end, missing, extra) of the place where the wording fits the template, or None."""
    wanted = _prepared()[0][template]
    blocks = [b for b in SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if b.size]
    while blocks:  # far-off stray matches at either end don't belong to the statement
        first, end = blocks[0].b, blocks[-1].b + blocks[-1].size
        matched = sum(b.size for b in blocks)
        missing, extra = len(wanted) - matched, end - first - matched
        if missing <= MISSING * len(wanted) and extra <= EXTRA * len(wanted):
            found = {w for b in blocks for w in wanted[b.a : b.a + b.size]}
            keys = set(TEMPLATES[template][2].split())
            between = set(words[first:end]) - set(wanted)
            rivals = {w for name, _, key in TEMPLATES if name != TEMPLATES[template][0] for w in key.split()} - keys
            exact = template < _PLAIN or not missing and not extra
            return (first, end, missing, extra) if exact and keys <= found and not between & rivals else None
        if extra > EXTRA * len(wanted) and len(blocks) > 1:
            blocks.pop(0 if blocks[0].size <= blocks[-1].size else -1)
        else:
            return None
    return None


def _marked(statement: str, after: str) -> bool:
    """A tag's or field's colon stands where it should, and its value isn't the beginning of a longer name."""
    return bool(re.match(r"(?:spdx-license-identifier|license)[\"']?[\x20\t]*[:=]", statement, re.IGNORECASE)) and after != "/"


def best(block: str, words: list[str]) -> tuple[int, float, tuple[int, int, int, int]] | None:
    """(template, share of bytes saved, what ``confirm`` gives) of the confirmed template that saves the most."""
    _, with_each, alone = _prepared()
    held = set(words)
    able = [k for k in range(len(TEMPLATES)) if held.issuperset(TEMPLATES[k][2].split())]
    if not able:
        return None
    raw = block.lower().encode("utf-8", "surrogatepass")
    size = len(alone.compress(raw))
    saved = {k: 1 - len(with_each[k].compress(raw)) / size for k in able}
    for k in sorted(able, key=lambda k: (-saved[k], k)):
        if saved[k] <= 0:
            break
        if place := confirm(k, words):
            return k, saved[k], place
    return None


def scan(text: str) -> list[tuple[int, int, str, float, int, int]]:
    """(start, end, license, share of bytes saved, missing, extra) of each confirmed statement, in order."""
    if not (mentions := [m.start() for m in _MENTION.finditer(text)]):
        return []
    found = list(_WORD.finditer(text))
    words = [w[0].lower() for w in found]
    starts = [w.start() for w in found]
    out: list[tuple[int, int, str, float, int, int]] = []
    taken: list[tuple[int, int]] = []  # ranges of words of the statements so far, in order
    for at in mentions:
        here = bisect_right(starts, at) - 1
        k = bisect_right(taken, (here, len(words)))
        if k and taken[k - 1][1] > here:
            continue
        # Nothing beyond statements found before.
        floor, ceiling = taken[k - 1][1] if k else 0, taken[k][0] if k < len(taken) else len(words)
        low, high = max(floor, here - AROUND), min(ceiling, here + AROUND + 1)
        line = text.rfind("\n", 0, starts[here]) + 1, text.find("\n", found[here].end())
        alone = max(low, bisect_left(starts, line[0])), min(high, bisect_left(starts, line[1]) if line[1] >= 0 else len(words))
        edges = (low if low > floor else -1, high if high < ceiling else -1)
        blocks = [alone, (low, high)]  # the mention's line by itself where all the words around give nothing
        while blocks:
            a, b = blocks.pop()
            if a >= b or not (hit := best(text[starts[a] : found[b - 1].end()], words[a:b])):
                continue
            template, saved, (first, stop, missing, extra) = hit
            first, stop = a + first, a + stop
            if template >= _PLAIN and not _marked(text[starts[first] : found[stop - 1].end()], text[found[stop - 1].end() :][:1]):
                blocks += [(a, first), (stop, b)]
                continue
            # A statement without the mention, of which words may be missing because the block ends, has its own.
            reach = missing + EXTRA * len(_prepared()[0][template])
            cut = missing and (edges[0] >= 0 and first - edges[0] <= reach or edges[1] >= 0 and edges[1] - stop <= reach)
            if first <= here < stop or not cut:
                insort(taken, (first, stop))
                out.append((starts[first], found[stop - 1].end(), TEMPLATES[template][0], round(saved, 6), missing, extra))
            if first <= here < stop:
                break
            # The side with the mention may hold another.
            side = (max(a, stop), b) if stop <= here else (a, min(b, first))
            blocks = [(max(x, side[0]), min(y, side[1])) for x, y in blocks] + [side]
    return sorted(out)


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType()), T.StructField("saved", T.DoubleType()), T.StructField("missing", T.LongType()), T.StructField("extra", T.LongType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("missing", pa.int64()), ("extra", pa.int64())]))


def with_licenses(docs: DataFrame, *, text: str = "text", licenses: str = "licenses") -> DataFrame:
    """Append the license statements of each whole text: array of (start, end, license, saved, missing,
    extra), by place; code points, end exclusive.

    Null and empty texts have none. Equal savings go to the earlier template. No shuffle; rows equal in
    text get equal results. A column of that name must not exist (ValueError).
    """
    if licenses.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {licenses} exists")
    names = ("start", "end", "license", "saved", "missing", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [[dict(zip(names, x, strict=True)) for x in scan(t)] if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], names=[*batch.schema.names, licenses])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(licenses, FOUND)]))


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_licenses, the distinct license names in order, and ``license:start:end`` of each statement."""
    found = with_licenses(docs.select(doc_id, text), text=text)
    each = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return found.select(doc_id, F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", names).alias("names"), F.concat_ws(",", each).alias("spans"))
