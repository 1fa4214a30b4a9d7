"""License scans by diagonal voting.

Words are lower-cased runs of letters, digits and characters outside ASCII. Every text is turned into the rolling
hashes of its word pairs and of its runs of four words, all of which Spark joins to the positions of the same windows in
the templates: the pairs of short phrases, the fours of notices and licence texts, which may be of any length. A hit
votes for the diagonal text position - template position: votes on one diagonal are an unbroken copy, votes on
neighbouring diagonals a copy with words put in or left out. Short phrases must have all their pairs on one diagonal,
which is the place of the phrase. Notices may be changed: neighbouring diagonals are merged to spans. The spans that the
votes leave are verified word by word along their diagonals; a span counts if it covers enough of the notice without
being stretched.

Defined results: a null or empty text has no words and no labels; very long texts are hashed in slices of batches that
are bounded in bytes; repeated rows get the same result each (votes and spans are sets, so seeing a row twice changes
nothing); templates with one word are no templates; labels and places that tie are counted each; an empty table gives no
rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import hash_words, materialise, rolling, slices, small

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Labels of this module and the wording of their notices and licence texts, of any length.
NOTICES = {
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-notice": "this work is licensed under a creative commons attribution international license to view a copy of this license visit",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-3-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see",
}
#: Words of the windows of phrases (the shortest have two words) and of notices.
PAIR, FOUR = 2, 4
#: Merged diagonals lie this near to the next; a diagonal of a notice needs this many votes; share of a notice's words that must be there; stretch allowed.
NEIGHBOUR, LEAST_VOTES, COVERAGE, STRETCH = 4, 3, 0.6, 1.5

#: Bytes outside words become spaces, capitals become small; bytes of characters outside ASCII stay.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    """A phrase (exact: every word in its place) or a notice (changes are allowed), with its label."""

    label: str
    wording: str
    exact: bool = False

    @property
    def window(self) -> int:
        return PAIR if self.exact else FOUR


TEMPLATES = (*(Template(label, phrase, True) for phrase, label in PHRASES.items()), *(Template(label, notice) for label, notice in NOTICES.items()))


def templates_of(table: DataFrame) -> list[Template]:
    """Templates from a table with label, wording and exact; templates are few (all published licences are some thousand)."""
    return [Template(r["label"], r["wording"], r["exact"]) for r in table.select("label", "wording", "exact").collect()]


def template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """gram, window, at, template, exact, grams: a row for each word window of each template."""
    rows = []
    for k, t in enumerate(templates):
        grams = rolling(hash_words(words_of(t.wording.encode())), t.window).view(np.int64).tolist()
        rows += [(g, t.window, at, k, t.exact, len(grams)) for at, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, window int, at int, template int, exact boolean, grams int")


def word_grams(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the hashes of all windows of the whole text: the pairs in order, then the fours; pairs is the number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=2):
            own = [hash_words(words_of(t.as_py() or b"")) for t in batch.column(2).cast(pa.binary())]
            grams = [np.concatenate([rolling(h, PAIR), rolling(h, FOUR)]) for h in own]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            flat = pa.array(np.concatenate([*grams, np.zeros(0, dtype=np.uint64)]).view(np.int64))
            pairs = pa.array([max(0, len(h) - PAIR + 1) for h in own], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pairs, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "text_hash", "pairs", "grams"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, pairs int, grams array<long>")


def candidate_spans(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """doc_id, text_hash, template, first and last word and diagonals of the spans that the votes leave."""
    grams = word_grams(docs).select("doc_id", "text_hash", "pairs", F.posexplode("grams").alias("at_gram", "gram"))
    hits = grams.join(small(template_grams(docs.sparkSession, templates)), "gram").withColumn("pos", F.col("at_gram") - F.when(F.col("window") == FOUR, F.col("pairs")).otherwise(0))
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("at"))
    key = ["doc_id", "text_hash", "template", "exact", "grams"]
    voted = hits.groupBy(*key, "diagonal").agg(F.size(F.collect_set("at")).alias("votes"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("window") - 1).alias("last"))
    enough = voted.where(F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise(F.col("votes") >= F.least(F.lit(LEAST_VOTES), "grams")))
    along = Window.partitionBy(*key).orderBy("diagonal")
    # places of a phrase stay apart; diagonals of a notice join their neighbours
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOUR, F.lit(True))
    grouped = enough.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    return grouped.groupBy(*key, "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_set("diagonal")).alias("diagonals")).drop("exact", "grams", "span")


def license_spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, text_hash, template, label, exact, first and last word and coverage (share of the template's words) of the verified spans."""
    spans = materialise(candidate_spans(docs, templates), "license-spans")  # read twice: for the texts to verify, and for their spans
    own = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("template", "first", "last", "diagonals")).alias("spans"))  # a document's own spans
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    few = texts.join(small(spans.select("doc_id", "text_hash").distinct()), same, "left_semi")
    wordings = [np.array(words_of(t.wording.encode()), dtype=object) for t in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=2):
            rows = []
            for doc_id, text_hash, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist()):
                words = np.array([*words_of(text.as_py() or b""), b""], dtype=object)
                for s in found:
                    t, want = templates[s["template"]], wordings[s["template"]]
                    at = np.arange(len(want)) + np.array(s["diagonals"])[:, None]
                    at = np.where((at >= 0) & (at < len(words) - 1), at, len(words) - 1)
                    coverage = int((words[at] == want).any(axis=0).sum()) / len(want)
                    if coverage == 1 if t.exact else coverage >= COVERAGE and s["last"] - s["first"] + 1 <= STRETCH * len(want):
                        rows.append((doc_id, text_hash, s["template"], t.label, t.exact, s["first"], s["last"], coverage))
            types = (batch.column(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "text_hash", "template", "label", "exact", "first", "last", "coverage"])

    with_text = few.join(own, same).select("doc_id", "text_hash", "text", "spans")
    return with_text.mapInArrow(verify, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, template int, label string, exact boolean, first int, last int, coverage double")


def scan_digest(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    spans = license_spans(docs, templates)
    base = lambda column: F.when(F.col("exact"), F.col(column))
    joined = lambda column: F.array_join(F.array_sort(F.collect_set(column)), ",")
    places = F.size(F.collect_set(F.when(F.col("exact"), F.struct("template", "first"))))
    found = spans.groupBy("doc_id", "text_hash").agg(
        places.alias("n_base"), F.min(base("first")).alias("first_word"), F.max(base("first")).alias("last_word"), joined(base("label")).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score")
    )
    count = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _NOT_WORD), "")).cast("long")
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), count.alias("n_words")).alias("d")
    both = all_docs.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    place = lambda c: F.col(c).cast("long").alias(c)
    return both.select("d.doc_id", "n_words", zero("n_base"), place("first_word"), place("last_word"), text("base_labels"), text("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
