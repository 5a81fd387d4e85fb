"""Licence scan with a positional index of rare words, in DataFrame operations only.

Templates are a table (label, text, phrases): whole licence texts and notices, each with the key phrases that must stand. All words
of the templates are counted over all texts, and ranked by inverse document frequency. The index
holds the rarest half of each template's words (``least_words`` to ``most_words`` of them) with their places: word -> (template, place).

A file's own highest-ranked index words are looked up, ``rare`` different ones for each stretch of ``span`` words, so that a long file with many
licences has them all looked up. Each look-up gives postings (template, place in the file less place in the template), and
postings are intersected: a template is a candidate at a relative position on which ``need`` look-ups agree (fewer only if its
index entry has fewer). It is reported if every key phrase stands word by word at one of its candidate positions; text that was put in or taken out
between two phrases shifts the second to another position, which is a candidate of its own. The score is the
share of the template's words that stand at a candidate position.

The index, the postings and the templates are made by DataFrame operations and reach the tasks as three constants of the plan, which has the
same operators for any number of templates; no row carries a copy. The template set is a parameter and does not grow with the data; ``max_words`` bounds it (ValueError).

Base phrases are found apart from that, by their one anchor word, then word by word.

Words are runs of a-z, 0-9 and all characters beyond ASCII after A-Z were lower-cased. Everything happens inside the row;
nothing of a text is shuffled.

Defined cases: null text is empty; no word gives zero counts, null places and empty labels; repeated rows each get
their row; overlapping places each count; words of one frequency rank by the word; an empty table gives an empty table; no templates give base labels only; columns of
the input are carried as given, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fenced, let, lower_ascii

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label -> (phrase, its anchor's place)
BASE = {"cc-by": ("cc by", 0), "gpl": ("general public license", 1), "reserved": ("all rights reserved", 2)}

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, {0} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see https://www.gnu.org/licenses/."


def _gnu(label: str, name: str, version: str) -> list[tuple[str, str, list[str]]]:
    """The standard header, and its first sentence, which often stands alone."""
    full = f"GNU {name}General Public License"
    header = _GNU.format(full, version)
    key = [f"under the terms of the {full} as published by the Free Software Foundation either version {version} of the license"]
    return [(label, header, key), (label, header[: header.index(", or (at your option)")], key)]


#: (label, text, key phrases): whole licence texts and the standard headers of the long licences, as their publishers word them.
TEXTS: list[tuple[str, str, list[str]]] = [
    *_gnu("agpl-3.0", "Affero ", "3"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ["licensed under the apache license version 2 0", "except in compliance with the license"]),
    ("bsd", _BSD_OPENING, ["redistribution and use in source and binary forms"]),  # the heading that all BSD licences share
    ("bsd-2-clause", f"{_BSD_OPENING} {_BSD_TWO} {_BSD_END}", ["redistribution and use in source and binary forms", "materials provided with the distribution this software is provided by the"]),
    ("bsd-2-clause", "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE", ["provided with the distribution this software is provided by"]),
    ("bsd-3-clause", f"{_BSD_OPENING} {_BSD_TWO} {_BSD_THREE} {_BSD_END}", ["redistribution and use in source and binary forms", "endorse or promote products derived from this software without specific prior written permission"]),
    ("bsd-3-clause", "contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["used to endorse or promote products derived from this software without specific prior written permission"]),
    ("bsl-1.0", "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", ["permission is hereby granted free of charge to any person or organization obtaining a copy", "covered by this license"]),
    *_gnu("gpl-2.0", "", "2"),
    *_gnu("gpl-3.0", "", "3"),
    *[("isc", f"{_ISC.format(both)} {_ISC_END}", [f"permission to use copy modify {both.replace('/', ' ')} distribute this software for any purpose"]) for both in ("and/or", "and")],
    *_gnu("lgpl-2.1", "Lesser ", "2.1"),
    *_gnu("lgpl-3.0", "Lesser ", "3"),
    ("mit", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ["permission is hereby granted free of charge to any person obtaining a copy of this software"]),
    # opening sentences, which often stand without the rest
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', ["permission is hereby granted free of charge to any person obtaining a copy"]),
    *[("isc", _ISC.format(both)[: _ISC.format(both).index(", provided")], [f"permission to use copy modify {both.replace('/', ' ')} distribute this software for any purpose"]) for both in ("and/or", "and")],
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["subject to the terms of the mozilla public license v 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software released into the public domain"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ["this software is provided as is without any express or implied warranty", "alter it and redistribute it freely"]),
]

#: (label, notice, key phrases): one line each.
NOTICES: list[tuple[str, str, list[str]]] = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("bsd-2-clause", "released under the bsd 2 clause license", ["bsd 2 clause"]),
    ("bsd-3-clause", "released under the bsd 3 clause license", ["bsd 3 clause"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution non commercial 4 0 international license", ["creative commons attribution non commercial 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under the creative commons cc0 1 0 universal license", ["creative commons cc0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "released under the isc license", ["isc license"]),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ["lesser general public license version 2 1"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["lesser general public license version 3"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]


def template_table(spark: SparkSession, rows: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """(label, text, phrases) of the built-in templates or of ``rows``."""
    return spark.createDataFrame(TEXTS + NOTICES if rows is None else rows, "label string, text string, phrases array<string>")


def split_words(col: Column) -> Column:
    return F.filter(F.split(lower_ascii(col), WORD_GAP), lambda w: w != "")


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _stands_at(words: Column, at: Column, phrase: Column) -> Column:
    """Whether the words of an array stand in ``words`` from a place on, which may be negative."""
    return F.when((at >= 0) & (at + F.size(phrase) <= F.size(words)), F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase).otherwise(False)


def _numbered(templates: DataFrame) -> DataFrame:
    """t, label, words and phrases (at, words) of the templates that have words; a key phrase that is not in its text is refused."""
    t = templates.select("label", split_words(F.col("text")).alias("words"), F.transform(F.coalesce("phrases", F.array().cast("array<string>")), split_words).alias("phrases")).where("size(words) > 0")
    place = lambda p: F.array_min(F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: _stands_at(F.col("words"), i, p)))
    t = t.withColumn("phrases", F.transform("phrases", lambda p: F.struct(place(p).alias("at"), p.alias("words"))))
    number = F.row_number().over(Window.orderBy("label", "words", "phrases")) - 1  # the templates are a bounded parameter
    return t.select(number.alias("t"), "label", "words", "phrases")


def _slot(word: Column, slots: int) -> Column:
    return F.pmod(F.hash(word), F.lit(slots))


def _small(df: DataFrame) -> DataFrame:
    """A table of the templates' size (``max_words`` rows at most), held in the plan as one partition, so that nothing made of it is shuffled."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1)


def _constant(one: DataFrame) -> Column:
    """The value of a table of one row and one column, as a constant."""
    (field,) = one.schema
    return F.from_json(F.lit(one.select(F.to_json(F.struct(F.col(field.name).alias("v")))).first()[0]), f"v {field.dataType.simpleString()}")["v"]


def _hash_table(words: DataFrame, slots: int) -> Column:
    """Of (word, k): an array of ``slots`` small maps; a word's map is found by its hash."""
    held = words.groupBy(_slot(F.col("word"), slots).alias("slot")).agg(F.collect_list(F.struct("word", "k")).alias("held"))
    every = words.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("slot")).join(held, "slot", "left")
    rows = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("held", F.array().cast("array<struct<word:string,k:int>>")).alias("held"))))
    return _constant(every.agg(rows.alias("r")).select(F.transform("r", lambda x: F.map_from_entries(x["held"])).alias("table")))


def _look_up(table: Column, word: Column, slots: int) -> Column:
    """k of the word, null if the table lacks it."""
    return F.try_element_at(F.get(table, _slot(word, slots)), word)


def document_frequencies(docs: DataFrame, vocabulary: DataFrame, slots: int) -> DataFrame:
    """word, k and df (rows of ``docs`` that hold the word) of (word, k)."""
    words = docs.select(F.array_distinct(split_words(_text(docs))).alias("words"))
    table = _hash_table(vocabulary, slots)
    held = F.filter(F.transform("words", lambda w: _look_up(table, w, slots)), lambda k: k.isNotNull())
    counts = words.select(F.explode(held).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    return vocabulary.join(counts, "k", "left").select("word", "k", F.coalesce("df", F.lit(0)).alias("df"))


def _index(docs: DataFrame, numbered: DataFrame, least_words: int, most_words: int, need: int) -> tuple[Column, Column, Column, int]:
    """The look-up table of index words (rarest first), their postings, the templates, as constants; and the table's slots."""
    spark = docs.sparkSession
    places = numbered.select("t", F.posexplode("words").alias("p", "word"))
    vocabulary = _small(places.select("word").distinct().withColumn("k", F.row_number().over(Window.orderBy("word")) - 1))
    slots = 1 << max(4, vocabulary.count().bit_length())
    df = _small(document_frequencies(docs, vocabulary, slots))
    ranked = df.select("word", F.row_number().over(Window.orderBy("df", "word")).alias("rank"))
    own = places.select("t", "word").distinct().join(ranked, "word")
    per = Window.partitionBy("t")
    taken = own.withColumns({"n": F.row_number().over(per.orderBy("rank")), "all": F.count(F.lit(1)).over(per)})
    taken = taken.where(F.col("n") <= F.least(F.lit(most_words), F.greatest(F.lit(least_words), F.ceil(F.col("all") / 2))))
    kept = taken.select("word", "rank").distinct().select("word", (F.row_number().over(Window.orderBy("rank")) - 1).cast("int").alias("k"))
    posts = places.join(taken.select("t", "word"), ["t", "word"]).join(kept, "word").select("k", "t", "p")
    lists = posts.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), "p"))).alias("posts"))
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("k", "posts"))).alias("r")).select(F.transform("r", lambda x: x["posts"]).alias("posts"))
    entries = posts.groupBy("t").agg(F.least(F.count(F.lit(1)), F.lit(need)).cast("int").alias("need"))
    temps = numbered.join(entries, "t").agg(F.sort_array(F.collect_list(F.struct("t", "label", "words", "phrases", "need"))).alias("templates"))
    return _hash_table(kept, slots), _constant(lists), _constant(temps), slots


def _votes(ks: Column, posts: Column, rare: int, span: int) -> Column:
    """Postings (t, o) of the ``rare`` rarest words of each stretch, sorted; o is where the template would begin."""
    n = F.size(ks)

    def stretch(lo: Column) -> Column:
        different = F.sort_array(F.array_distinct(F.slice(ks, lo + 1, F.lit(span))))  # null, for words out of the index, comes first
        none = F.array().cast("array<int>")
        inside = F.sequence(lo, F.least(lo + span, n) - 1)
        last = lambda m: F.get(m, F.least(F.size(m), rare + F.get(m, 0).isNull().cast("int")) - 1)
        return let(let(different, last), lambda cut: F.when(cut.isNull(), none).otherwise(F.filter(inside, lambda i: F.get(ks, i) <= cut)))

    at = F.flatten(F.transform(F.sequence(F.lit(0), n - 1, F.lit(span)), stretch))
    return F.sort_array(F.flatten(F.transform(at, lambda i: F.transform(F.get(posts, F.get(ks, i)), lambda q: F.struct(q["t"].alias("t"), (i - q["p"]).alias("o"))))))


def _verified(candidates: Column, templates: Column) -> Column:
    """Array of (label, place, share) of the templates whose key phrases all stand at one of their candidate positions."""
    words = F.col("words")

    def one(t: Column) -> Column:
        return let(F.get(templates, t), lambda tm: let(F.transform(F.filter(candidates, lambda c: c["t"] == t), lambda c: c["o"]), lambda at: judge(tm, at)))

    def judge(tm: Column, at: Column) -> Column:
        sure = F.forall(tm["phrases"], lambda p: F.exists(at, lambda o: _stands_at(words, o + p["at"], p["words"])))
        in_place = F.filter(F.sequence(F.lit(0), F.size(tm["words"]) - 1), lambda j: F.exists(at, lambda o: F.get(words, o + j) == F.get(tm["words"], j)))
        first = F.array_min(F.filter(at, lambda o: F.coalesce(_stands_at(words, o + F.get(tm["phrases"], 0)["at"], F.get(tm["phrases"], 0)["words"]), F.lit(True))))
        return F.when(sure, F.struct(tm["label"].alias("label"), first.cast("long").alias("place"), (F.size(in_place) / F.size(tm["words"])).alias("share")))

    found = F.transform(F.array_distinct(F.transform(candidates, lambda c: c["t"])), one)
    return F.filter(found, lambda x: x.isNotNull())


def _found(index: tuple[Column, Column, Column, int], rare: int, span: int) -> Column:
    """The verified templates of a row with ``words``."""
    table, posts, templates, slots = index
    none = F.array().cast("array<struct<label:string,place:bigint,share:double>>")

    def agreeing(votes: Column, tm: Column) -> Column:
        return F.array_distinct(F.filter(votes, lambda v, j: F.coalesce(F.get(votes, j + F.get(tm, v["t"])["need"] - 1) == v, F.lit(False))))

    return F.when(
        F.size("words") > 0,
        let(F.transform("words", lambda w: _look_up(table, w, slots)), lambda ks: let(_votes(ks, posts, rare, span), lambda votes: let(agreeing(votes, templates), lambda c: _verified(c, templates)))),
    ).otherwise(none)


def _starts(phrase: list[str], anchor: int) -> Column:
    """Where a base phrase begins, from the places of its anchor among ``hits``."""
    words = F.array(*[F.lit(w) for w in phrase])
    return F.filter(F.transform("hits", lambda i: i - anchor), lambda s: _stands_at(F.col("words"), s, words))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, base: dict[str, tuple[str, int]] | None = None, rare: int = 24, span: int = 64, need: int = 2, least_words: int = 3, most_words: int = 16, max_words: int = 2_000_000) -> DataFrame:
    """row, n_words, n_base, first_word, last_word, base_labels, labels, score and places (label, place, share) for every row."""
    base = base or BASE
    numbered = _numbered((template_table(docs.sparkSession) if templates is None else templates).coalesce(1))
    size = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words"), F.count_if(F.exists("phrases", lambda p: p["at"].isNull())).alias("lost")).first()
    if size["lost"] or size["words"] > max_words:
        raise ValueError(f"{size['lost']} templates lack a key phrase in their text; {size['words']} words, {max_words} at most")
    numbered = _small(numbered)
    anchors = sorted({p.split()[k] for p, k in base.values()})
    d = docs.select(F.struct("*").alias("row"), lower_ascii(_text(docs)).alias("low"))
    d = d.withColumn("words", F.filter(F.split("low", WORD_GAP), lambda w: w != ""))
    some = reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in anchors])
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(anchors))
    d = d.withColumn("hits", F.when(some & (F.size("words") > 0), at).otherwise(F.array().cast("array<int>"))).drop("low")
    places = _found(_index(docs, numbered, least_words, most_words, need), rare, span) if size["n"] else F.array().cast("array<struct<label:string,place:bigint,share:double>>")
    d = d.withColumns({"places": places, "starts": F.array(*[_starts(p.split(), k) for p, k in base.values()])})
    every = F.flatten("starts")
    base_labels = F.filter(F.array(*[F.when(F.size(F.get("starts", i)) > 0, F.lit(label)) for i, label in enumerate(base)]), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("places", lambda p: p["label"]))))
    best = F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))
    made = [
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(best).alias("score"),
        F.col("places"),
    ]
    return fenced(d, ["row"], made)
