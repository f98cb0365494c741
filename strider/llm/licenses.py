"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.llm.tables import if_small, written

WIDTH = 5
CONTAINED = 0.8
#: MinHash values of a window, each a band of its own. A window holds a template it matches whole and
#: at most four times as many shingles, so their similarity is at least 0.8 / 4.2 and one of the bands
#: agrees with a probability of 1 - (1 - 0.19) ** 40 > 0.9997.
BANDS = 40
#: Shingles of all templates up to which the plan holds them, to tell windows that have one.
MOST_SHINGLES = 20_000

# License notices to look for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """A hash of each run of ``width`` words, in order."""
    return F.transform(
        F.sequence(F.lit(1), F.size(w) - width + 1, F.lit(1)),
        lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(width)]),
    )


def _hashes(w: Column, width: int) -> Column:
    return F.when(F.size(w) >= width, shingle_hashes(w, width)).otherwise(F.array().cast("array<bigint>"))


def minhash(hashes: Column, bands: int = BANDS) -> Column:
    """The least of each of ``bands`` rehashings of a set of hashes."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def template_table(docs: DataFrame, templates: dict[str, str], width: int, bands: int) -> DataFrame:
    """(name, window, hashes, bands) of each template: the window in shingles, twice as many as it has, rounded up to a power of 2; its distinct shingle hashes; (band, value) of its MinHash."""
    table = docs.sparkSession.createDataFrame(list(templates.items()), "name string, body string")
    rows = table.select("name", words(F.col("body")).alias("w")).select("name", _hashes(F.col("w"), width).alias("h")).where(F.size("h") > 0)
    window = F.pow(F.lit(2), 1 + F.ceil(F.log2(F.size("h")))).cast("int")
    return rows.select("name", window.alias("window"), F.array_distinct("h").alias("hashes"), _numbered(minhash(F.col("h"), bands)).alias("bands"))


def _numbered(values: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(i.alias("band"), v.alias("value")))


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, width: int = WIDTH,
    contained: float = CONTAINED, bands: int = BANDS,
) -> DataFrame:
    """(doc_id, licenses, n_licenses, containment) of each row of ``docs``.

    licenses: the names of the templates of whose ``width``-word shingles some window holds a share
    of ``contained`` or more, sorted and comma-joined; containment: the largest share. Windows are
    twice as long as the template, in shingles rounded up to a power of 2, and start every half
    window, so each passage as long as the template lies whole in one. The MinHash bands of a window
    meet those of the templates in a join on window, band and value; each template that a window
    retrieves is compared with it shingle by shingle. A window that agrees in a band shares a
    shingle, so where templates have ``MOST_SHINGLES`` at most, windows with none are not hashed,
    which skips no match. Null, empty and short texts have none; repeated rows are reported each; an
    empty table gives no rows.
    """
    table = written(template_table(docs, templates, width, bands), "templates")
    windows = sorted(r["window"] for r in table.select("window").distinct().collect())
    # Words are a column of their own: inside the lambda of the shingles they would be made anew for each.
    rows = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")).select("doc_id", _hashes(F.col("w"), width).alias("h"))
    few = table.agg(F.sum(F.size("hashes"))).first()[0] or 0
    own = F.array().cast("array<bigint>")
    if few <= MOST_SHINGLES:
        own = F.array(*[F.lit(r["h"]).cast("long") for r in table.select(F.explode("hashes").alias("h")).distinct().orderBy("h").collect()])
        rows = rows.withColumn("h", F.when(F.arrays_overlap("h", own), F.col("h")))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shingles")
    parts = F.array().cast("array<struct<window:int,part:array<bigint>>>")
    for window in windows:
        starts = F.sequence(F.lit(1), F.greatest(F.size("h"), F.lit(1)), F.lit(window // 2))
        parts = F.concat(parts, F.transform(starts, lambda at: F.struct(F.lit(window).alias("window"), F.slice("h", at, F.lit(window)).alias("part"))))  # noqa: B023
    cut = rows.where(F.size("h") > 0).select("row", F.explode(parts).alias("x")).select("row", "x.window", "x.part")
    if few <= MOST_SHINGLES:
        cut = cut.where(F.arrays_overlap("part", own))
    cut = written(cut.select("row", "window", "part", F.monotonically_increasing_id().alias("at"), _numbered(minhash(F.col("part"), bands)).alias("bands")), "windows")
    known = if_small(written(table.select("name", "window", F.explode("bands").alias("b")).select("name", "window", "b.*"), "bands"))
    met = cut.select("at", "window", F.explode("bands").alias("b")).select("at", "window", "b.*").join(known, ["window", "band", "value"]).select("at", "name").distinct()
    pairs = met.join(cut.select("at", "row", "part"), "at").join(if_small(table.select("name", "hashes")), "name")
    shares = pairs.select("row", "name", (F.size(F.array_intersect("part", "hashes")) / F.size("hashes")).alias("share")).where(F.col("share") >= contained)
    hits = shares.groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("names"), F.max("share").alias("share"))
    return rows.select("row", "doc_id").join(if_small(written(hits, "hits")), "row", "left").select(
        "doc_id", F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce(F.nullif(F.size("names"), F.lit(-1)), F.lit(0)).alias("n_licenses"),
        F.coalesce("share", F.lit(0.0)).alias("containment"),
    )
