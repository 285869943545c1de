"""Licence texts by the digest of their canonical form, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Public licence texts, without titles and copyright lines.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
LICENSES["BSD-3-Clause"] = LICENSES["BSD-2-Clause"].replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")

#: Titles that may stand above a text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: SHA-256 of the canonical form of long public texts, as Debian ships them in common-licenses.
DIGESTS = {
    "Apache-2.0": "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}

#: Notices of one line, which name a licence where they are a whole line or a whole text.
NOTICES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
}

#: Spellings that count as the same, applied to lower-cased text one after the other.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"), ("acknowledgement", "acknowledgment"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"), ("merchantibility", "merchantability"), ("https://", "http://"), ("&", " and "))

#: Lines that hold only a copyright claim, alone or behind comment marks.
CLAIM = r"(?:^|\n)[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|:|by )|(?:\(c\)|©)[ \t]*(?:copyright|[0-9])|all rights reserved)[^\n]*"


def variants() -> list[tuple[str, str]]:
    """(name, text) of every listed text: as it is, below each of its titles, and with its conditions not numbered."""
    out = list(NOTICES.items())
    for name, text in LICENSES.items():
        for body in dict.fromkeys((text, re.sub(r"(?m)^\d\. ", "", text))):
            out += [(name, f"{title}\n{body}" if title else body) for title in ("", *TITLES.get(name, ()))]
    return out


def _lines(text: Column) -> Column:
    """Lower case without copyright lines, with one spelling; words and line ends with single spaces between."""
    out = F.regexp_replace(F.lower(text), CLAIM, "\n")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def _one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, with one spelling, letters and digits as words with single spaces between."""
    return _one_line(_lines(text))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def license_scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, digests: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, canonical digest of the whole text, the licence whose text has it, else null, and the names of the
    notices that are a line of the text, with commas between, else null.

    Null texts count as empty. A text of only punctuation or copyright lines has the digest of the empty string and is
    no licence. Licences with one canonical form count as the first by name. Ids may be null or repeat: a row in gives
    a row out. The lists are parameters of fixed length, so their side is broadcast; other columns are ignored.
    """
    texts, digests, notices = variants() if texts is None else texts, DIGESTS if digests is None else digests, NOTICES if notices is None else notices
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("text"), F.lit(None).cast("string").alias("h")) for n, t in texts), *(F.struct(F.lit(n).alias("name"), F.lit("x").alias("text"), F.lit(h).alias("h")) for n, h in digests.items()))
    known = docs.sparkSession.range(1).select(F.explode(listed).alias("k")).select("k.name", "k.h", canonical(F.col("k.text")).alias("c"))
    known = known.filter("c <> ''").select("name", F.coalesce("h", _digest(F.col("c"))).alias("h")).groupBy("h").agg(F.min("name").alias("license"))
    lines = F.array(*(F.struct(F.lit(n).alias("name"), _digest(canonical(F.lit(t))).alias("h")) for n, t in sorted(notices.items())))
    rows = id_and_text(docs).select("doc_id", _lines(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", _digest(_one_line(F.col("lines"))).alias("digest"), F.transform(F.split("lines", "\n"), lambda line: _digest(F.trim(line))).alias("each"))
    found = F.concat_ws(",", F.transform(F.filter(lines, lambda k: F.array_contains(F.col("each"), k["h"])), lambda k: k["name"])) if notices else F.lit("")
    rows = rows.select("doc_id", "digest", F.nullif(found, F.lit("")).alias("notices"))
    return rows.join(F.broadcast(known), F.col("digest") == F.col("h"), "left").select("doc_id", "digest", "license", "notices")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lines_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(CLAIM)}, chr(10), 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _one_line_sql(lines: str) -> str:
    return rf"trim(regexp_replace({lines}, '[ \n]+', ' ', 'g'))"


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in rows)


SQL = f"""
WITH known AS (SELECT h, min(name) AS license FROM (SELECT sha256({_one_line_sql(_lines_sql("t"))}) AS h, name FROM (VALUES {_values(variants())}) v(name, t) UNION ALL SELECT h, name FROM (VALUES {_values(list(DIGESTS.items()))}) v(name, h)) GROUP BY 1),
notice AS (SELECT name, sha256({_one_line_sql(_lines_sql("t"))}) AS h FROM (VALUES {_values(list(NOTICES.items()))}) v(name, t)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_lines_sql("coalesce(text, '')")} AS lines FROM documents),
found AS (SELECT r, string_agg(name, ',' ORDER BY name) AS notices FROM (SELECT DISTINCT r, name FROM (SELECT r, sha256(trim(unnest(string_split(lines, chr(10))))) AS h FROM d) JOIN notice USING (h)) GROUP BY r)
SELECT doc_id, digest, license, notices FROM (SELECT r, doc_id, sha256({_one_line_sql("lines")}) AS digest FROM d) LEFT JOIN known ON digest = h LEFT JOIN found USING (r)
"""
