"""Licence scan by canonical digest: texts are normalised, hashed and hash-joined to digests of known licences.

Normalisation: no copyright lines, lower case, punctuation and white space as one space, equivalent spellings made one.
Entire units are looked up: a document's whole text, each of its lines, each of its blocks (between blank lines) and,
for known texts of several blocks, each run of as many blocks. So a licence is found alone in a file, in a header and
inside a longer text, however its lines are wrapped. DataFrame functions only.

Known are short notices and common licences as texts, and long licences as digests; others are given as a table. Digests
meet it by a hash join, which is broadcast only while the table is a small one; matches are few and are counted by
(document, licence) with partial aggregation.

Cases: null, empty and punctuation-only units match nothing; ties, that is one digest with several names, give each
name; rows with equal doc_id count together; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many known texts are sent to every task; beyond, the join shuffles.
BROADCAST_ROWS = 10_000

# Spellings that licence matching treats as equal, by words of normalised text.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("cancelled", "canceled"), ("centre", "center"), ("colour", "color"), ("defence", "defense"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("honour", "honor"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("modelling", "modeling"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("redistributions", "redistribution"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"),
    ("owner", "holder"), ("owners", "holders"), ("https", "http"), ("v2", "version 2"), ("v3", "version 3"),
)
#: A line that names a holder: copyright with (c), a year, a placeholder or by; or all rights reserved. A wrapped line of a
#: disclaimer that begins with the word isn't one.
COPYRIGHT_LINE = r"(?im)^[ \t#*/;!-]*(?:copyright[ \t]*(?:\(c\)|©|[<\[{]|[12][0-9]{3}|by )|\(c\)[ \t]*(?:copyright|[12][0-9]{3})|©|all rights reserved)[^\n]*$"
#: Everything in ASCII that is no letter, digit or line end.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Short licence notices and texts, by identifier.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", """The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("GPL-2.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("LGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
)

#: Licences too long to stand here, as (identifier, blocks, digest of the whole, digest of the blocks' digests).
KNOWN_DIGESTS: tuple[tuple[str, int, str, str], ...] = (
    ("Apache-2.0", 32, "4225605d4c3647ef2075217a0d52c9ca", "02e7428139091ac997c1a522d1cc26c0"),
    ("Artistic-1.0-Perl", 29, "01297679267ad921516667ccd889865e", "970bf2fecc28128e658af376e68a204d"),
    ("CC0-1.0", 13, "48fee373d5abaf94bbae926793a16535", "c017ae60bb31aa57aecbec592055f2e9"),
    ("GFDL-1.2", 57, "7a0a547ecac612b526676be523eacf80", "babfbf80e7f0f0ac49819c0908911aa6"),
    ("GFDL-1.3", 67, "7132e8380bc59358f27c3129a2136bf1", "ee347a74ae476a0e317634ecdb11a515"),
    ("GPL-1.0", 50, "9a6d41337fa0145d93e534071bfae3f8", "0489a169fafd217bafba39283a8ebf62"),
    ("GPL-2.0", 59, "8e4925da11f68cc625b11b0a628fdcc5", "1a81f9c07fa2786b8830bfb670099a22"),
    ("GPL-3.0", 122, "b79359b5e391fd47146ff34ae3db7ec0", "6f0c6125984318cb9d749f05e4bf7347"),
    ("LGPL-2.0", 83, "74cf7fcef3b29a39165a795b2cad3a3a", "af51c601838330c64d66503c80437aa8"),
    ("LGPL-2.1", 85, "f998bc436710cfece156aaa84fd26dd4", "47740c030ce5b50f5d2f6721ae08380f"),
    ("LGPL-3.0", 37, "b31b7335bc37919e8cdd79154e04d88d", "df759404de92650a1e4a78f0c247060f"),
    ("MPL-1.1", 73, "9fa8ae3e869a929215034d82982372b5", "8e7f9510c0d1a4aa2cb8791e0a9690ff"),
    ("MPL-2.0", 83, "b5b7a0cf4994910cd0204fba4637d6ec", "193eb194b2d18df98be32fc9106dafc9"),
)


def canonical(text: Column) -> Column:
    """The normalised form: words of ASCII letters and digits, and other letters, in one spelling; line ends stay."""
    plain = F.lower(F.regexp_replace(text, F.lit(COPYRIGHT_LINE), F.lit("")))
    words = F.split(F.replace(F.regexp_replace(plain, F.lit(PUNCTUATION), F.lit(" ")), F.lit("\n"), F.lit(" \n ")), " ")
    table = F.create_map(*[F.lit(w) for pair in SPELLINGS for w in pair])
    return F.array_join(F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), lambda w: w != ""), " ")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, F.lit(" ?\n ?"), F.lit(" ")))


def parts(text: Column) -> Column:
    """struct(lines, blocks) of a canonical text: its lines, empty ones too, and the blocks between empty lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    blocks = F.filter(F.transform(F.split(text, " ?\n(?: ?\n)+ ?"), one_line), lambda x: x != "")
    return F.struct(lines.alias("lines"), blocks.alias("blocks"))


def digests(texts: DataFrame) -> DataFrame:
    """(licence, blocks, digest) of known texts (licence, text): of the whole, and of the run of blocks if it has several."""
    rows = texts.select("licence", canonical(F.col("text")).alias("c")).select("licence", parts(F.col("c"))["blocks"].alias("b")).where(F.size("b") > 0)
    return rows.select("licence", F.size("b").alias("blocks"), F.md5(F.array_join("b", " ")).alias("whole"), F.md5(F.array_join(F.transform("b", lambda x: F.md5(x)), "")).alias("run"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(licence, text) of a folder of licence texts, a file each, named by its file."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("name"))
    return files.select(F.regexp_replace("name", r"\.txt$", "").alias("licence"), "text")


def known(spark: SparkSession, texts=KNOWN, more=KNOWN_DIGESTS) -> DataFrame:
    """(licence, blocks, whole, run) of known texts, and of those that are known by their digests only."""
    rows = digests(spark.createDataFrame(list(texts), "licence string, text string"))
    return rows.unionByName(spark.createDataFrame(list(more), "licence string, blocks int, whole string, run string")).distinct()


def units(docs: DataFrame, runs: tuple[int, ...]) -> DataFrame:
    """(doc_id, kind, line, digest): a row for each whole text, for each line and block of texts with several, and for each
    run of as many blocks as a known text has."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", canonical(F.col("text")).alias("c"))
    # made once a text: an exploded array isn't worked out again for each use
    rows = rows.select("doc_id", F.explode(F.array(parts(F.col("c")))).alias("p")).where(F.size("p.blocks") > 0)
    unit = lambda kind, line, digest: F.struct(F.lit(kind).alias("kind"), line.alias("line"), digest.alias("digest"))
    none, nothing = F.lit(-1), F.array().cast("array<struct<kind:string,line:int,digest:string>>")
    whole = F.array(unit("whole", none, F.md5(F.array_join("p.blocks", " "))))
    lines = F.filter(F.transform("p.lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda u: u["x"] != "")
    lines = F.when(F.size("p.lines") > 1, F.transform(lines, lambda u: unit("line", u["i"], F.md5(u["x"])))).otherwise(nothing)
    several = F.size("p.blocks") > 1
    blocks = F.when(several, F.transform("p.blocks", lambda x: unit("block", none, F.md5(x)))).otherwise(nothing)
    rows = rows.select("doc_id", F.concat(whole, lines, blocks).alias("units"), F.when(several, F.transform("p.blocks", lambda x: F.md5(x))).alias("md5s"))
    start = F.sequence(F.lit(0), F.size("md5s"))
    wide = [F.when(F.size("md5s") >= n, F.transform(F.filter(start, lambda i: i + n <= F.size("md5s")), lambda i: unit("run", none, F.md5(F.array_join(F.slice("md5s", i + 1, n), ""))))).otherwise(nothing) for n in runs if n > 1]  # noqa: B023
    return rows.select("doc_id", F.explode(F.concat("units", *wide)).alias("u")).select("doc_id", "u.*")


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, licence, whole, n_units, first_line) of the documents in which a known licence stands: whether one is the
    whole text, how many lines, blocks and runs of blocks are one, and the first such line (null if there is none).

    texts: (licence, text) of known licences instead of the usual ones.
    """
    table = known(docs.sparkSession) if texts is None else digests(texts).distinct()
    # a known text of so many blocks is looked for as runs of as many; the numbers are few
    runs = tuple(sorted(r["blocks"] for r in table.select("blocks").distinct().collect()))
    table = table.select("licence", "whole").union(table.where("blocks > 1").select("licence", "run")).toDF("licence", "digest").distinct()
    if texts is None or table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    hits = units(docs, runs).join(table, "digest")
    some = F.col("kind") != "whole"
    return hits.groupBy("doc_id", "licence").agg(F.max(F.col("kind") == "whole").alias("whole"), F.count_if(some).alias("n_units"), F.min(F.when(F.col("line") >= 0, F.col("line"))).alias("first_line"))
