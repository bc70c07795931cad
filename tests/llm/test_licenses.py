"""Licence scans on small texts."""

from faultline.llm import licenses


def test_rules_follow_known_sentences(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"Some words.\n{apache}"), (2, "RELEASED under the MIT   License."), (3, None), (4, ""), (5, f"{apache} You may not use this file except in compliance with the License."),
            (6, "It was not Licensed under CC BY-NC 4.0. by anyone"), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (None, "x")]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: (r["identifiers"], r["licenses"]) for r in licenses.scan(docs).collect()}
    assert got[1] == (["apache2-notice"], ["Apache-2.0"]) and got[2][1] == ["MIT"] and got[5] == (["apache2-notice", "apache2-use"], ["Apache-2.0"])
    assert got[7][1] == ["MIT", "CC-BY-NC-4.0"] and all(got[k] == ([], []) for k in (3, 4, 6, None))
    assert licenses.scan(docs.limit(0)).count() == 0


def test_texts_notices_and_spdx_lines_of_common_licences(spark):
    mit = ("MIT License\n\nCopyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
           'of this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including '
           "without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, "
           "and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n")
    bsd = ("# Redistributions of source code must retain the above copyright notice,\n#   this list of conditions and the following disclaimer.\n"
           "# 2. Redistributions in binary form must reproduce the above copyright notice, this list\n# of conditions and the following "
           "disclaimer in the documentation and/or other materials provided\n# with the distribution.\n")
    third = ("# 3. Neither the name of Some Firm nor the names of its contributors may be used to\n# endorse or promote products derived from "
             "this software without specific prior written permission.\n")
    rest = ("# THIS SOFTWARE IS PROVIDED BY THE AUTHORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\n"
            "# IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.\n")
    gpl = ("// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU {}General Public License "
           "as published by\n// the Free Software Foundation; either version {} of the License, or\n// (at your option) any later version.")
    cases = [
        (mit, ["MIT"]), ("This project is released under the MIT License", ["MIT"]), ("(c) X, licensed under the MIT license", ["MIT"]),
        (bsd + third + rest, ["BSD-3-Clause"]), (bsd + rest, ["BSD-2-Clause"]),
        (gpl.format("", 2), ["GPL-2.0"]), (gpl.format("", 3), ["GPL-3.0"]), (gpl.format("Affero ", 3), ["AGPL-3.0"]), (gpl.format("Lesser ", "2.1"), ["LGPL-2.1"]),
        ("/* SPDX-License-Identifier: MIT */", ["MIT"]), ("# SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]), ("License: ISC", ["ISC"]), ("The code is BSD-3-Clause licensed.", ["BSD-3-Clause"]),
        ("This is free and unencumbered software released\ninto the public domain.", ["Unlicense"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy", ["MPL-2.0"]),
        ("Texts are available under the Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("Shared under CC BY 3.0", ["CC-BY-3.0"]), ("Published under CC0.", ["CC0-1.0"]), ("Licensed under the Eclipse Public License v2.0", ["EPL-2.0"]),
        ("This is not licensed under the MIT License.", []), ("It was never to be released under the MIT License.", []), ("Go to the mit, then license it.", []),
        ("Dual licensed under either of the MIT license or the\nApache License, Version 2.0", ["Apache-2.0", "MIT"]),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert [(cases[k][0], got[k]) for k in got if got[k] != cases[k][1]] == []


def test_long_lists_sentences_and_blanks(spark):
    """A megabyte each of what repeats in a pattern: no recursion, and time in proportion to the text."""
    import time

    third = "neither the name of x nor the names of y "
    texts = {
        "list": "licensed under mit" + " or mit" * 150_000, "names": "licensed under mit" + " license" * 130_000, "articles": "licensed under " + "the " * 250_000 + "mit.",
        "breaks": "licensed under" + "\n" * 10**6 + "the MIT License.", "sentence": "word " * 200_000, "endorse": third * 25_000, "blanks": " " * 10**6,
        "lines": "neither the name of x nor the names of y\n" * 25_000, "marks": "; " * 500_000, "notices": "licensed under " * 70_000, "spdx": "spdx-license-identifier: " * 40_000,
        "mits": "MIT License\n" * 90_000, "unbroken": "x" * 10**6,
    }
    licenses.scan(spark.createDataFrame([(0, "MIT License")], "doc_id long, text string")).collect()
    slow, got = {}, {}
    for name, text in texts.items():
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        got[name] = licenses.scan(docs).select("licenses", "identifiers").collect()[0]
        slow[name] = round(time.perf_counter() - start, 1)
    assert got["list"]["licenses"] == ["MIT"] and len(got["list"]["identifiers"]) == 150_001
    assert all(got[k]["licenses"] == ["MIT"] for k in ("names", "articles", "breaks", "mits"))
    assert all(got[k]["licenses"] == [] for k in ("sentence", "endorse", "blanks", "marks", "notices", "unbroken", "lines"))
    assert max(slow.values()) < 10, slow


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "MIT License", "a"), (1, "MIT License", "a"), (None, "x", None)], "doc_id long, text string, identifiers string")
    assert [tuple(r) for r in licenses.scan(docs).orderBy("doc_id").select("doc_id", "licenses").collect()] == [(None, []), (1, ["MIT"]), (1, ["MIT"])]
