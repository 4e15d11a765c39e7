"""Licence wordings: real texts with their punctuation, and automata against regular expressions on changed texts."""

import random
import re

import duckdb
import pytest

from lobspark.llm import licenses
from lobspark.llm.queries import SQL, op10_license_scan

AUTOMATA = [licenses.compile_template(*t) for t in licenses.TEMPLATES]

MIT = """Copyright (c) 2019 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "3. Neither the name of Example Ltd. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
LGPL = """ * This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
TEXTS = [
    (MIT, {"mit-text"}),
    (ISC, {"isc-text"}),
    (BSD3 % THIRD, {"bsd-3-text"}),
    (BSD3 % "", {"bsd-2-text"}),
    (APACHE, {"apache", "apache-2.0-notice"}),
    (LGPL, {"lgpl-notice"}),
    (LGPL.replace("Lesser ", "").replace("library", "program"), {"gpl-notice"}),
    (LGPL.replace("Lesser", "Affero").replace("2.1", "3"), {"agpl-notice"}),
    (MPL, {"mpl-2.0-notice"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {"cc-attribution-noncommercial-sharealike"}),
    ("Licensed under the Creative Commons Attribution 3.0 Unported License", {"cc-attribution"}),
    (MIT.replace("free of charge", "for a fee"), set()),
    (MIT[: len(MIT) // 2], set()),
    (APACHE.replace("may not use", "may use"), {"apache"}),
    (LGPL.replace("WITHOUT ANY", "WITH FULL"), set()),
    ((BSD3 % THIRD).replace("nor the names", "or the names"), set()),
    ("A permissive licence was chosen; permission is hereby granted.", set()),
]


def labels(text: str) -> set[str]:
    return {a[0] for a in licenses.scan_text(text.encode(), AUTOMATA)[3]}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_whole_texts(i):
    text, want = TEXTS[i]
    assert labels(text) == want
    assert labels("before it " * 50 + text + " and after" * 50) == want


def test_places_are_those_of_the_text():
    words = len(MIT.translate({ord(c): " " for c in '(),.":/'}).split())
    (place,) = licenses.scan_text(("x " * 7 + MIT + " y").encode(), AUTOMATA)[3]
    assert place == ("mit-text", 7 + 5, 7 + words)  # five words of the copyright line stand before the permission


def expand(rng: random.Random, text: str) -> list[str]:
    out = []
    for i, part in enumerate(re.split(r"\(\((.*?)\)\)", text)):
        if i % 2:
            part = rng.choice([*part.split("|"), ""])
        for w in part.split():
            out += [f"n{rng.randrange(9)}" for _ in range(rng.randrange(int(w[1:-1]) + 1))] if w.startswith("{") else [w]
    return out


def test_automata_agree_with_regular_expressions():
    rng = random.Random(5)
    regexes = [(label, re.compile(licenses.template_regex(t))) for label, t in licenses.TEMPLATES]
    hits = 0
    for label, t in licenses.TEMPLATES:
        for k in range(12):
            words = expand(rng, t)
            if k >= 4:  # strike, double or swap a word somewhere
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [words[at]] * 2, ["other"]])
            text = " ".join(["some"] * rng.randrange(3) + words + ["end"] * rng.randrange(3))
            want = {name for name, r in regexes if r.search(f" {text} ")}
            assert labels(text) == want, text
            assert k >= 4 or label in want
            hits += len(want)
    assert hits > 100


def test_query_against_its_sql(spark, tmp_path):
    rows = [(i, t) for i, (t, _) in enumerate(TEXTS)] + [(90, None), (91, ""), (92, " ".join(t for t, _ in TEXTS)), (93, "CC BY " * 2000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(SQL["op10_license_scan"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
