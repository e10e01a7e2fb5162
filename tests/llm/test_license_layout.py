"""License scans on the layouts that licences have: wrapped, behind comment signs, as identifiers; and on prose that has none."""

import os
import textwrap

import pytest

from graphloom.llm import license_scan

SF = "/root/testdata/sf0.01"

#: Public licence texts, as they stand in files.
BODIES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "epl": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "boost": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.""",
    "cc0": """To the extent possible under law, the author(s) have waived all copyright and related or neighboring rights to this work worldwide.""",
    "cc-by-sa": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
}
#: Notices that no template and no training notice spells like this.
UNSEEN = {
    "mit": ["Foo is open source, MIT licensed.", "Dual-licensed; the runtime uses the MIT licence.", "Copyright (c) 2020 Ann, license: MIT"],
    "apache": ["The code here may be used under Apache License 2.0 terms.", "Everything in this folder: Apache-2.0 license."],
    "gpl": ["You get this tool as GPLv3 software under its licence.", "Its plugins fall under the GNU General Public License.", "(C) the team, GPL-2.0-or-later, license text in COPYING"],
    "lgpl": ["linked statically under the LGPL-2.1", "The runtime stays under the GNU Lesser General Public License, as before."],
    "bsd": ["Our parts carry a 3-clause BSD licence.", "You may use it on the conditions of the New BSD License."],
    "mpl": ["Files here fall under the Mozilla Public License.", "the core is under MPL 2.0 licence"],
    "agpl": ["server parts are AGPLv3 licensed", "The service is offered under the Affero GPL."],
    "cc-by-sa": ["Pictures: CC BY-SA 4.0, see the licence page."],
    "epl": ["Their tool comes under the Eclipse Public License as well."],
}
PROSE = [
    "He lost his driving licence under the bridge in Boston.", "The MIT students under the bridge asked for permission to sing.", "She is free to go, without any warranty of success, said the publisher.",
    "The Apache warriors rode under the hill, and the public watched.", "A fishing licence costs ten pounds and is sold at the post office.", "The court gave him permission to appeal under the old terms.",
    "We use the software to see the conditions of the river.", "You should have received a letter along with this parcel.", "The notice said that all copies of the key must be returned.",
    "Any person may obtain a copy of the map at the desk.", "The author has waived the fee for students.", "Distribution of food in the camps was limited by the weather.",
    "The zlib of the valley is a bird.", "Their rights to use the well were older than the village.", "This work was done by the masons of the town, either alone or with others.", "He was warranted to search the house and the notice was public.",
]
PREFIXES = ["", "# ", " * ", "// ", ";; ", "-- ", "> ", "    "]


@pytest.fixture(scope="module")
def model():
    import duckdb

    background = ["we walked to the river and came back in the evening", "the price of corn rose again this year", "see the next chapter for a full account of the journey"] * 10
    if os.path.isdir(SF):
        for (text,) in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null order by doc_id limit 150").fetchall():
            background += [p for p in text.split("\n") if p.strip() and not license_scan.TERMS.search(p)][:4]
    return license_scan.train(background)


def laid_out(body, prefix, width):
    lines = [x for part in body.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
    return "some code()\n\n" + "\n".join((prefix + x).rstrip() for x in lines) + "\n\nmore code()\n"


def families(model, text):
    return [x["family"] for x in license_scan.find(model, text.encode()) if x["confirmed"]]


def test_bodies_are_found_in_any_layout(model):
    right = total = wrong = 0
    for family, body in BODIES.items():
        for k, prefix in enumerate(PREFIXES):
            got = families(model, laid_out(body, prefix, (50, 60, 72, 79)[k % 4]))
            right, total, wrong = right + (family in got), total + 1, wrong + len(set(got) - {family})
    assert right / total >= 0.95 and wrong / total <= 0.05


def test_notices_never_trained_on(model):
    got = [(family, families(model, text)) for family, texts in UNSEEN.items() for text in texts]
    assert sum(f in g for f, g in got) / len(got) >= 0.9 and not [g for f, g in got if set(g) - {f}]


def test_single_wrapped_lines_and_identifiers(model):
    lines = {
        '* Permission is hereby granted, free of charge, to any person obtaining a copy': "mit", '// of this software and associated documentation files (the "Software"), to deal': "mit",
        "modification, are permitted provided that the following conditions": "bsd", "Foobar is free software: you can redistribute it and/or modify": None,
        "This Source Code Form is subject to the terms of the Mozilla Public": "mpl", "This is free software under GPLv2 or later.": "gpl", "# SPDX-License-Identifier: MIT": "mit",
        "// SPDX-License-Identifier: Apache-2.0": "apache", "/* SPDX-License-Identifier: GPL-2.0-only */": "gpl", "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: MPL-2.0": "mpl", "License: MIT": "mit",
    }
    got = {x: families(model, x) for x in lines}
    assert all(g == [f] if (f := lines[x]) else len(g) == 1 and g[0].endswith("gpl") for x, g in got.items()), got


def test_prose_has_no_licence(model):
    found = [x for text in PROSE for x in license_scan.find(model, text.encode())]
    assert not [x for x in found if x["confirmed"]] and len(found) <= 1
    assert not families(model, "\n".join(PROSE)) and not families(model, textwrap.fill(" ".join(PROSE), 60))


def test_offsets_of_wrapped_sentences(model):
    text = "é first\n\n# This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0.\n\nend"
    (x,) = [x for x in license_scan.find(model, text.encode()) if x["family"] == "mpl"]
    assert text[x["start"] : x["end"]].startswith(("# This Source", "This Source")) and text[x["start"] : x["end"]].endswith("License, v. 2.0.")


def test_a_line_that_says_it_all_keeps_its_span(model):
    text = "one | two | three\nLicensed under the Apache License, Version 2.0.\nand so on"
    assert [text[x["start"] : x["end"]] for x in license_scan.find(model, text.encode())] == ["Licensed under the Apache License, Version 2.0."]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_finds_every_planted_line_and_nothing_else(spark):
    """The table's licence lines are of few forms, which plain search finds."""
    from graphloom.llm import registry

    forms = {"Licensed under the Apache License, Version 2.0": "apache", "Released under the MIT License": "mit", "licensed under the GNU General Public License, version 3": "gpl", "All rights reserved": "reserved", "Licensed under CC BY-NC 4.0": "cc-by-nc"}
    table = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op9_license_scan"](spark, SF).collect()
    for r in got:
        want = sorted((table[r.doc_id].find(x), f) for x, f in forms.items() if x in table[r.doc_id])
        assert set(r.families.split(",")) - {""} == {f for _, f in want} and r.n_unknown == 0
        for x in r.found:
            assert any(x.start <= at < x.end and x.family == f for at, f in want) or any(form in table[r.doc_id][x.start : x.end] for form in forms)
