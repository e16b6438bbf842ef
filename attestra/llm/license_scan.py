"""License scan by diagonal voting, with DataFrame functions only.

Each position of a text's rolling word k-grams (k is 2 and LONG) is joined by hash to the positions of the templates'
k-grams, and compared by a second hash of the words. A joined k-gram votes for the diagonal text position minus template
position; votes are counted by diagonal before the shuffle, and neighbouring diagonals (words inserted or left out) are
merged. A merged span is verified by the distinct places of the template that it covers, which are bits of a mask, so
that a place counts once. A phrase is a template of which every pair must stand on one diagonal, which makes its place
exact.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import dictionary

#: The phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Characteristic sentences of public licenses, and the label that each proves.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "either version 2 of the license or at your option any later version": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: Texts of public licenses as they are published, without names and years, and their labels.
TEXTS = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
    and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
    PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
    PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
    OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
    OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE.""": "isc",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED.""": "bsd",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
    the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
    WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
    governing permissions and limitations under the License.""": "apache",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
    version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
    details. You should have received a copy of the GNU General Public License along with this program.""": "gpl",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""": "mpl",
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
    use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means.""": "unlicense",
}
#: Words of a k-gram of templates that have at least twice as many words; shorter ones, and phrases, use pairs.
LONG = 4
#: The least share of a notice's k-grams in a merged span, the widest step between merged diagonals, and the number of
#: k-grams below which a notice has to stand as a whole.
COVERAGE, STEP, WHOLE = 0.6, 3, 7
_MASK = 62
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words of ASCII letters (folded), digits and non-ASCII characters; a null text has none.

    lower() is much faster than a character map. The two characters that it would turn into ASCII letters are
    put out of its way; how other non-ASCII letters are folded makes no difference to an ASCII template.
    """
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001"))
    return F.split(F.trim(F.regexp_replace(F.lower(safe), _SEPARATORS, " ")), " ")


def template_words(text: str) -> list[str]:
    """Words of a template, as word_list() has them."""
    return re.findall("[0-9a-z]+", text.lower())


def _neighbours(values: Column, apart: int) -> Column:
    """array<struct<hash, check>> of each value with the one so many places on, by two hashes."""
    n = F.size(values) - apart
    both = F.zip_with(F.slice(values, 1, n), F.slice(values, apart + 1, n), lambda a, b: F.struct(F.xxhash64(a, b).alias("hash"), F.hash(a, b).alias("check")))
    return F.when(n > 0, both).otherwise(F.array().cast("array<struct<hash: bigint, check: int>>"))


def pair_hashes(words: Column) -> Column:
    """Hashes of each word with the next one."""
    return _neighbours(words, 1)


def long_hashes(pairs: Column) -> Column:
    """Hashes of LONG words in a row, of the pairs that begin them and end them."""
    return _neighbours(pairs, LONG - 2)


def template_rows(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple[int, str, bool, int, int, list[str]]]:
    """(template, label, is_phrase, k, n_grams, words) of templates of two words or more."""
    rows = [(template_words(text), label, kind) for group, kind in ((phrases, True), (notices, False)) for text, label in group.items()]
    sized = [(w, label, kind, LONG if not kind and len(w) >= 2 * LONG else 2) for w, label, kind in rows]
    return [(i, label, kind, k, len(w) - k + 1, w) for i, (w, label, kind, k) in enumerate(sized) if len(w) > 1]


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(hash, check, template, label, is_phrase, place, k, n_grams) of each k-gram; some hundred rows, given by the caller."""
    rows = [(i, label, kind, k, n, p, w[p : p + k]) for i, label, kind, k, n, w in template_rows(phrases, notices) for p in range(n)]
    t = dictionary(spark, rows, "template int, label string, is_phrase boolean, k int, n_grams int, place int, words array<string>")
    pairs = pair_hashes(F.col("words"))
    gram = F.when(F.col("k") == 2, pairs[0]).otherwise(F.get(long_hashes(pairs), F.lit(0)))
    return t.select("template", "label", "is_phrase", "k", "n_grams", "place", gram["hash"].alias("hash"), gram["check"].alias("check"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, coverage: float = COVERAGE, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans array<struct<label, is_phrase, first_word, last_word, coverage>>) of every document.

    docs: id_col (long) and text_col; further columns are ignored. A null or wordless text has no spans;
    repeated rows and null ids are reported row by row; no rows, no result. Spans are sorted; overlapping ones
    all stay. A template of a single word can't be found, as it has no pair. By default notices are NOTICES and TEXTS.
    coverage: distinct k-grams of a template in a span, over its k-grams or the span's places, if these are more.

    The templates are joined to every k-gram; they are broadcast up to a bound on their k-grams. Text is read once;
    what is shuffled is one count and mask for each document and diagonal that got a vote, and one row for each document.
    """
    spark = docs.sparkSession
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES | TEXTS if notices is None else notices
    t = templates(spark, phrases, notices)
    masks = [f"mask_{i}" for i in range(1 + max([n for *_, n, _ in template_rows(phrases, notices)], default=0) // _MASK)]
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), word_list(F.col(text_col).cast("string")).alias("words"))
    base = words.select("row", "doc_id", F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"), pair_hashes(F.col("words")).alias("pairs"))
    placed = lambda grams: F.transform(grams, lambda x, i: F.struct(i.alias("pos"), x["hash"].alias("hash"), x["check"].alias("check")))
    grams = base.select("row", "doc_id", "n_words", F.explode_outer(F.concat(placed(F.col("pairs")), placed(long_hashes(F.col("pairs"))))).alias("g"))
    votes = grams.select("row", "doc_id", "n_words", "g.*").join(t, ["hash", "check"], "left")
    bit = lambda i: F.expr(f"bit_or(if(place div {_MASK} = {i}, shiftleft(1L, int(place % {_MASK})), 0L))")
    template = ["template", "label", "is_phrase", "k", "n_grams"]
    diagonals = votes.groupBy("row", "doc_id", "n_words", *template, (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), *(bit(i).alias(m) for i, m in enumerate(masks))
    )
    # A phrase's diagonals stay apart; those of a notice are merged where they follow each other closely.
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("is_phrase") | (F.col("diagonal") - F.lag("diagonal").over(w) > step) | (F.abs(F.col("first") - F.lag("last").over(w)) > F.col("n_grams"))
    runs = diagonals.withColumn("run", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("row", "doc_id", "n_words", *template, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), *(F.bit_or(m).alias(m) for m in masks))
    covered = sum((F.bit_count(m) for m in masks), F.lit(0))
    share = covered / F.greatest("n_grams", F.col("last") - F.col("first") + 1)
    good = F.when(F.col("is_phrase"), covered == F.col("n_grams")).otherwise(share >= F.when(F.col("n_grams") < WHOLE, 1.0).otherwise(coverage))
    span = F.struct("label", "is_phrase", F.col("first").cast("long").alias("first_word"), (F.col("last") + F.col("k") - 1).cast("long").alias("last_word"), share.alias("coverage"))
    return spans.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(F.when(F.col("template").isNotNull() & good, span))).alias("spans")).drop("row")
