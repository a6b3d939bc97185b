"""Tags, fields, short names and headings of licenses."""

from __future__ import annotations

import pytest

from stevedore.llm import licenses

PROSE = "The harbour opened late that year and nobody could say when the boats would return. " * 12


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("// SPDX-License-Identifier: Apache-2.0\n#include <stdio.h>", "Apache-2.0"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
        ("License: MIT", "MIT"),
        ('"license": "BSD-3-Clause",', "BSD-3-Clause"),
        ("This code is licensed under GPLv3", "GPL-3.0"),
        ("It has the GPL v3 license.", "GPL-3.0"),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0"),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0"),
        ("The MIT License (MIT)\n\nCopyright (c) 2019 A. Person", "MIT"),
        ("MIT License\n\nCopyright (c) 2019 A. Person", "MIT"),
        ("Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/", "Apache-2.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at", "EPL-2.0"),
        ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
    ],
)
def test_names(text, name):
    for whole in (text, f"{PROSE}\n\n{text}\n\n{PROSE}", f"{PROSE}{text}\n{PROSE}"):
        assert [x[2] for x in licenses.scan(whole)] == [name]


def test_tags_one_after_another():
    tags = [f"SPDX-License-Identifier: {n}" for n in licenses._NAMED]
    assert [x[2] for x in licenses.scan("\n".join(tags))] == list(licenses._NAMED)


@pytest.mark.parametrize(
    "clean",
    [
        "He got his driver license, MIT admitted him.",
        "License MIT",
        "the license of the MIT press",
        "License: proprietary",
        "He compared the MIT license with others.",
        "SPDX-License-Identifier: LicenseRef-Own",
        "MIT: the license office",
    ],
)
def test_clean(clean):
    assert licenses.scan(f"{PROSE}{clean} {PROSE}") == [] and licenses.scan(clean) == []
