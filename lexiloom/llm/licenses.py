"""Operator 4: license scan by diagonal voting.

Every run of SHINGLE words of every document, hashed, is joined in Spark with the
runs of the license templates. A hit at word p of a document and word t of a template
votes for the diagonal p - t; votes are counted by diagonal, diagonals at most SLACK
apart are merged (an inserted or dropped word moves the rest by one), and a merged
span is verified: its hits must cover at least COVER of the template's words and at
least DENSE of the span's own words.

The templates are a parameter of fixed size; they are broadcast only while they have
at most BROADCAST_ROWS runs, and joined by shuffle beyond that. Only hits are
shuffled, never texts.

Result: (doc_id, license, start, stop, cover), one row for each verified span; start
and stop count words from 0, stop is exclusive.

Defined cases: null doc_id or text, and texts shorter than SHINGLE words: no rows.
Rows that repeat a doc_id are one document: equal rows count once, and the votes of
different texts are counted together, so start and stop hold for one of them. Overlapping
templates each give their own row; a span that fits several templates equally (a tie) is
given for each. Texts of any length are read whole. Templates shorter than SHINGLE words
are an error. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.common import arrow

SHINGLE = 3
SLACK = 3
COVER, DENSE = 0.8, 0.6
BROADCAST_ROWS = 100_000

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so"
)
_MIT_END = (
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met"
)
_BSD_2 = (
    ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Lines, grants and notices, and the short licenses whole. The texts of the long ones (Apache, GPL, MPL) end with the notice to apply, which is found.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": _MIT,
    "mit-warranty": _WARRANTY,
    "mit": f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    f"copies or substantial portions of the Software. {_WARRANTY}{_MIT_END}",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
    "License as published by the Free Software Foundation",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-grant": _BSD,
    "bsd-2-clause": _BSD + _BSD_2 + _BSD_END,
    "bsd-3-clause": _BSD + _BSD_2 + _BSD_3 + _BSD_END,
    "isc-grant": _ISC,
    "isc": f'{_ISC} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this "
    "software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be "
    "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered "
    "from any source distribution.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _template_rows(templates: dict[str, str], k: int) -> list[tuple[int, str, int, int]]:
    """(hash, name, word, words) of every run of every template."""
    rows = []
    for name, text in sorted(templates.items()):
        tokens = K.tokenize([text])
        hashes, _ = K.grams(tokens, k, short=False)
        if not len(hashes):
            raise ValueError(f"template {name} has fewer than {k} words")
        n = len(tokens.hashes)
        rows += [(h, name, t, n) for t, h in enumerate(hashes.view(np.int64).tolist())]
    return rows


def _roller(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, texts in K.chunks(batch.column(1)):
                hashes, offsets = K.grams(K.tokenize(texts), k, short=False)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], names=["doc_id", "h"])

    return run


def license_spans(documents: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = SHINGLE) -> DataFrame:
    rows = _template_rows(templates, k)
    table = documents.sparkSession.createDataFrame(rows, "h bigint, license string, t int, words int")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    runs = arrow(docs, _roller(k), "doc_id bigint, h array<bigint>").select("doc_id", F.posexplode("h").alias("p", "h"))
    hits = runs.join(F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table, "h")
    votes = hits.groupBy("doc_id", "license", "words", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))
    order = Window.partitionBy("doc_id", "license").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    merged = votes.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(order))
    cells = merged.select("doc_id", "license", "words", "group", "diagonal", F.explode("ts").alias("t"))
    cells = cells.select("doc_id", "license", "words", "group", "diagonal", F.explode(F.sequence("t", F.col("t") + k - 1)).alias("t"))
    spans = cells.groupBy("doc_id", "license", "words", "group").agg(
        F.count_distinct("t").alias("known"),
        F.count_distinct(F.col("diagonal") + F.col("t")).alias("own"),
        F.min(F.col("diagonal") + F.col("t")).cast("bigint").alias("start"),
        (F.max(F.col("diagonal") + F.col("t")) + 1).cast("bigint").alias("stop"),
    )
    good = spans.where((F.col("known") >= COVER * F.col("words")) & (F.col("own") >= DENSE * (F.col("stop") - F.col("start"))))
    return good.select("doc_id", "license", "start", "stop", F.round(F.col("known") / F.col("words"), 6).alias("cover"))


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    """The same in DuckDB SQL, on the words themselves."""
    values = ", ".join("('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in sorted(templates.items()))
    words = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: lower(x))"
    return f"""
WITH tpl AS (SELECT license, {words.format("text")} AS w FROM (VALUES {values}) v(license, text)),
tgrams AS (
  SELECT license, len(w) AS words, CAST(t AS BIGINT) AS t, w[t + 1] AS a, w[t + 2] AS b, w[t + 3] AS c
  FROM tpl, unnest(range(0, len(w) - 2)) u(t)
), doc AS (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
hits AS (
  SELECT DISTINCT d.doc_id, g.license, g.words, d.p - g.t AS diagonal, g.t
  FROM (SELECT doc_id, p, w[p + 1] AS a, w[p + 2] AS b, w[p + 3] AS c FROM doc, unnest(range(0, len(w) - 2)) u(p)) d
  JOIN tgrams g USING (a, b, c)
), diagonals AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, license ORDER BY diagonal) > {SLACK}, true) AS new
  FROM (SELECT DISTINCT doc_id, license, words, diagonal FROM hits)
), merged AS (
  SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, license ORDER BY diagonal) AS grp FROM diagonals
), cells AS (
  SELECT m.doc_id, m.license, m.words, m.grp, h.diagonal, h.t + j AS t
  FROM merged m JOIN hits h ON m.doc_id = h.doc_id AND m.license = h.license AND m.diagonal = h.diagonal,
       (VALUES (0), (1), (2)) v(j)
), spans AS (
  SELECT doc_id, license, words, count(DISTINCT t) AS known, count(DISTINCT diagonal + t) AS own,
         min(diagonal + t) AS start, max(diagonal + t) + 1 AS stop
  FROM cells GROUP BY doc_id, license, words, grp
)
SELECT doc_id, license, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, round(known / words, 6) AS cover
FROM spans WHERE known >= {COVER} * words AND own >= {DENSE} * (stop - start)
"""
