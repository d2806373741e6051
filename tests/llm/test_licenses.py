"""Standard headers and whole licence texts, as they stand in files, get their own licences."""

from __future__ import annotations

import re

from bytestrata.llm import licenses

WARRANTY = " * {0} is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n * {1} for more details.\n"
CODE = "\n\nint main(int argc, char **argv)\n{\n\treturn run(argc, argv, NULL);\n}\n" * 3
HEADERS = [
    ("GPL-2.0", "/*\n * Frobnicate - turns knobs\n * Copyright (C) 2009 A. Person\n *\n * Frobnicate is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.\n *\n" + WARRANTY.format("Frobnicate", "General Public License") + " */"),
    ("GPL-2.0", "// This file is part of a kernel; you can redistribute it and/or modify\n// it under the terms of the GNU General Public License version 2 as\n// published by the Free Software Foundation."),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("GPL-3.0", "# Widget is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
    ("LGPL-3.0", "/* Knob is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Lesser General Public License as\n * published by the Free Software Foundation, either version 3 of the\n * License, or (at your option) any later version.\n *\n" + WARRANTY.format("Knob", "Lesser General Public License") + " */"),
    ("LGPL-2.1", "   This library is free software; you can redistribute it and/or\n   modify it under the terms of the GNU Lesser General Public\n   License as published by the Free Software Foundation; either\n   version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "# This server is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as\n# published by the Free Software Foundation, either version 3 of the\n# License, or (at your option) any later version."),
    ("BSD-2-Clause", "// Copyright (c) 2011, A. Person\n// All rights reserved.\n//\n// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are met:\n//\n// * Redistributions of source code must retain the above copyright notice,\n//   this list of conditions and the following disclaimer.\n// * Redistributions in binary form must reproduce the above copyright notice,\n//   this list of conditions and the following disclaimer in the documentation\n//   and/or other materials provided with the distribution.\n//\n" + "// THIS SOFTWARE IS PROVIDED BY THE AUTHOR ``AS IS'' AND ANY EXPRESS OR\n// IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES\n// OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN\n// NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,\n// SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED\n// TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR\n// PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF\n// LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING\n// NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS\n// SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. COPYRIGHT"),
    ("ISC", "/*\n * Copyright (c) 2016 A. Person <a@example.org>\n *\n * Permission to use, copy, modify, and distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies.\n */"),
    ("Apache-2.0", "# Licensed to the Foundation (ASF) under one or more contributor license\n# agreements. The ASF licenses this file to You under the Apache License,\n# Version 2.0 (the \"License\"); you may not use this file except in\n# compliance with the License.  You may obtain a copy of the License at\n#\n#    http://www.apache.org/licenses/LICENSE-2.0\n"),
]


def test_standard_headers(spark):
    rows = [(i, f"/h{i}/a.c", text + CODE) for i, (_, text) in enumerate(HEADERS)] + [(100 + i, f"/n/{i}.c", CODE + str(i)) for i in range(200)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i]["license"] for i in range(len(HEADERS))] == [name for name, _ in HEADERS]
    assert all(got[i]["license"] is None for i in got if i >= 100)


def test_whole_texts(spark):
    """Licence files without a telling name, wrapped and signed, speak for their directories."""
    own = [(name, "Copyright 2018 Some One\n\n" + re.sub(r"(?<=\w) (?=\w)", "\n", text, count=40)) for name, text in licenses.TEXTS]
    rows = [(i, f"/d{i}/terms.txt", text) for i, (_, text) in enumerate(own)] + [(100 + i, f"/d{i}/sub/a.c", CODE) for i in range(len(own))]
    assert all(re.search(licenses.CUE, text) for _, text in licenses.TEXTS)
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, (name, _) in enumerate(own):
        assert (got[i]["license"], got[i]["origin"]) == (name, "header") and got[i]["score"] >= licenses.TEXT_THRESHOLD
        assert (got[100 + i]["license"], got[100 + i]["license_path"]) == (name, f"/d{i}/terms.txt")


def test_every_template_has_a_cue():
    """What is compared at all: each notice and text that is known has a cue, and so have their usual last paragraphs."""
    cue = re.compile(licenses.CUE)
    assert all(cue.search(text) for _, text in licenses.TEMPLATES + licenses.TEXTS)
    for name, text in licenses.TEXTS:
        if name in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Unlicense"):
            assert cue.search(re.split(r"\n\s*\n", text.strip())[-1]), name
