"""Licence scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings) and its digest is joined to the digests of known licences.
What is looked up are entire texts: the whole document, its blocks between blank
lines, and its lines.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import materialise, row_key

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Texts of licences (SPDX identifier, text).  Fixed values: the public texts themselves.
TEXTS: list[tuple[str, str]] = [
    (
        "MIT",
        f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_TAIL),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("0BSD", f"{_ISC}.\n\n{_ISC_TAIL}"),
    (
        "MIT-0",
        f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n{_WARRANTY}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        f'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n{_WARRANTY}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
]
#: Full texts, as published, in the folder texts: (SPDX identifier, file).  Fixed values.
FILES: list[tuple[str, str]] = [
    ("Apache-2.0", "Apache-2.0.txt"),
    ("MPL-2.0", "MPL-2.0.txt"),
    ("GPL-2.0-only", "GPL-2.0-only.txt"),
    ("GPL-2.0-only", "GPL-2.0-only-spdx.txt"),
    ("GPL-3.0-only", "GPL-3.0-only.txt"),
    ("LGPL-3.0-only", "LGPL-3.0-only.txt"),
    ("CC0-1.0", "CC0-1.0.txt"),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0.txt"),
    ("Unlicense", "Unlicense.txt"),
]
#: Titles that stand above the texts of licences.  Fixed values.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT License (MIT)"),
    "ISC": ("ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
    "Unlicense": ("Unlicense",),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "CC-BY-SA-4.0": ("Creative Commons",),
}
_END = "END OF TERMS AND CONDITIONS"
_OWNER = "Copyright [yyyy] [name of copyright owner]"
#: Names by which one-line declarations refer to licences.  Fixed values.
NAMES: list[tuple[str, str]] = [
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("GPL-2.0-only", "GNU General Public License, version 2"),
    ("GPL-3.0-only", "GNU General Public License, version 3"),
    ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("Unlicense", "Unlicense"),
    ("MIT-0", "MIT No Attribution License"),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License, version 1.0"),
]
SUBJECTS = ("", "this work is ", "this file is ", "this document is ", "this software is ", "the text is ", "this page is ", "this program is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "available under ", "made available under ", "published under ")
#: Replacements in order, on lower-cased text, as (pattern, replacement); both Java and RE2 read the patterns alike.
RULES: list[tuple[str, str]] = [
    (r"(?m)^[^\n]*(\(c\)|©|copyright) *(\(c\)|©)? *[0-9]{4}[^\n]*$", " "),
    (r"(?m)^ *all rights reserved\.? *$", " "),
    (r"[^\p{L}\p{N}]+", " "),
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bauthorised\b", "authorized"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bv(ersion)? ?([0-9])", "version $2"),
    (r"\b(the terms of the|terms of the|the terms of|the) ", ""),
]


#: Every built-in text has one of these, and no rule brings one about: texts without them can't match and aren't normalised.
#: U+0130 is the one letter whose lower case ends in a mark, which counts as punctuation.
STEMS = r"(?i)licen|permission|redistribution|(?<![\p{L}\p{N}])cc|\u0130cc"


def canonical(text: Column) -> Column:
    """Lower case without punctuation, copyright lines and spellings that say the same."""
    out = F.lower(text)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, " +", " "))


def full_texts() -> list[tuple[str, str]]:
    """The texts of FILES, each also without what follows its terms, and with the owner's line filled in, which canonical() removes."""
    folder = resources.files(__package__) / "texts"
    out = []
    for i, name in FILES:
        text = (folder / name).read_text("utf-8")
        out.append((i, text))
        if _END in text:
            out.append((i, text[: text.index(_END) + len(_END)]))
        if _OWNER in text:
            out.append((i, text.replace(_OWNER, "")))
    return out


def known() -> list[tuple[str, str]]:
    """(identifier, text) of all known licences and one-line declarations."""
    lines = [(i, f"{s}{v}the {n}") for i, n in NAMES for s in SUBJECTS for v in VERBS]
    lines += [(i, f"{s}{v}{n}") for i, n in NAMES for s in SUBJECTS for v in VERBS if n.startswith("CC")]
    texts = TEXTS + full_texts()
    return texts + [(i, f"{title}\n\n{t}") for i, t in texts for title in TITLES.get(i, ())] + [(i, n) for i, n in NAMES] + lines + [(i, f"SPDX-License-Identifier: {i}") for i, _ in NAMES]


def scan(docs: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """Licences of documents.

    licence is that of the document as an entire text, null if none; declared
    lists those of its blocks and lines, sorted, joined by commas, empty if
    none; n_declared is how many blocks and lines matched.  Null and empty texts
    match nothing; very long ones are scanned whole.  Repeated rows come back each; extra columns are ignored; an
    empty table gives an empty result.  licences (id, text) replaces the
    built-in ones; it may be of any size.
    """
    spark = docs.sparkSession
    stems = STEMS if licences is None else ""
    licences = spark.createDataFrame(known(), "id string, text string") if licences is None else licences
    table = licences.where("text is not null and id is not null").select("id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    table = materialise(table.groupBy("digest").agg(F.min("id").alias("licence")), "licences")
    small = table.count() <= 100_000
    text = F.coalesce("text", F.lit(""))
    parts = F.array_union(F.split(text, r"\n"), F.split(text, r"\n *\n"))
    # equal parts of one text are counted once for each kind
    keyed = docs.select(*row_key(F.col("doc_id"), text), text.alias("text")).where(F.col("text").rlike(stems))
    units = keyed.select("_r1", "_r2", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), text.alias("part"))), F.transform(F.filter(parts, lambda p: p.rlike(stems)), lambda p: F.struct(F.lit(False).alias("whole"), p.alias("part"))))).alias("u"))
    units = units.select("_r1", "_r2", "u.whole", F.sha2(canonical(F.col("u.part")), 256).alias("digest"))
    found = units.join(F.broadcast(table) if small else table, "digest")
    found = found.groupBy("_r1", "_r2").agg(F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",").alias("declared"), F.countDistinct(F.when(~F.col("whole"), F.col("digest"))).alias("n_declared"))
    found = materialise(found.select(F.col("_r1").alias("_f1"), F.col("_r2").alias("_f2"), "licence", "declared", "n_declared"), "found_licences")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), text))
    return slim.join(found, (F.col("_r1") == F.col("_f1")) & (F.col("_r2") == F.col("_f2")), "left").select("doc_id", "licence", F.coalesce("declared", F.lit("")).alias("declared"), F.coalesce("n_declared", F.lit(0).cast("long")).alias("n_declared"))
