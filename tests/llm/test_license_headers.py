"""Customary headers above code, wrapped as comments, each by its licence and version."""

from pyspark.sql import functions as F

from tessera.llm import licenses

GNU = """{0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2}General Public License as published by
the Free Software Foundation{3} either version {4} of the License, or
(at your option) any later version."""

HEADERS = {
    "GPL-2.0": GNU.format("This program", ";", "", ";", "2"),
    "GPL-3.0": GNU.format("This program", ":", "", ",", "3"),
    "LGPL-2.1": GNU.format("This library", ";", "Lesser ", ";", "2.1"),
    "LGPL-3.0": GNU.format("This program", ":", "Lesser ", ",", "3"),
    "AGPL-3.0": GNU.format("This program", ":", "Affero ", ",", "3"),
    "Apache-2.0": 'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.',
    "BSD-3-Clause": "Copyright The Authors. All rights reserved.\nUse of this source code is governed by a BSD-style license that can be\nfound in the LICENSE file.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file or copy at the site)",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
}
TAGS = {"GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-or-later": "LGPL-2.1", "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSL-1.0": "BSL-1.0"}


def test_headers_above_code(spark):
    code = "\n".join(f"int value_{i} = compute(step_{i}, limit);" for i in range(200))
    rows = [(i, "\n".join(f"// {x}" for x in text.split("\n")) + "\n\n" + code) for i, text in enumerate(HEADERS.values())]
    rows += [(100 + i, f"// SPDX-License-Identifier: {tag}\n\n{code}") for i, tag in enumerate(TAGS)]
    df = spark.createDataFrame(rows + [(900, code)], "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.found) for r in licenses.scan(df, F.concat(F.lit("src/"), F.col("doc_id").cast("string"))).collect()}
    want = {i: (name, "header") for i, name in enumerate(HEADERS)} | {100 + i: (name, "header") for i, name in enumerate(TAGS.values())}
    assert got == want | {900: (None, "none")}
