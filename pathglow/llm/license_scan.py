"""Licence scan: known phrases, and an exact set-similarity join of text blocks with licence templates.

All of it is DataFrame functions. Templates are short notices and whole licence texts. A template has windows of its own size:
half a window, a power of two, holds all its words. A block is a window of a text's words, one beginning every half window, so
that each run of half a window's words lies whole in some block. A template is met by a block of its size that holds at
least ``CONTAINMENT`` of its distinct words. Words are ordered by document frequency over the whole table, rarest first; only
template words count, so a block is the ordered set of those it holds. A pair is a candidate if a word in the template's
prefix equals one in the block's prefix, if the block is long enough (length filter), and if the words that remain after
the first common one can still reach the overlap (positional filter). The overlap of candidates is then counted.

Texts that can meet a template are exploded once into the places of the templates' words, with ranks from a broadcast of some
hundreds of words; blocks are groups of these places, so work and memory grow with a text's words, not with their square.

Defined cases: a null text counts as empty; texts are scanned whole, whatever their length; a text without findings has null first_word and
last_word, empty labels and score 0; repeated rows and null ids are returned as they come; an empty table gives
no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathglow.llm.common import written

#: Phrases of the base scan and the labels they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Customary licence notices as words, and the labels they give.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    # whole texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("public-domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT, LEAST_BLOCK = 0.9, 16


def block_words(template: str) -> int:
    """Words of a template's windows: twice the power of two that holds the template."""
    return max(LEAST_BLOCK, 2 << (len(template.split(" ")) - 1).bit_length())


def templates() -> list[tuple[str, list[str], int]]:
    """Label, distinct words and window of each template."""
    return [(label, list(dict.fromkeys(text.split(" "))), block_words(text)) for label, text in TEMPLATES]


def _needed(words: list[str], containment: float) -> int:
    return math.ceil(containment * len(words) - 1e-9)


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _word_table(docs: DataFrame, id_col: str, text_col: str, known: list[tuple[str, list[str], int]], containment: float) -> DataFrame:
    """One scan: id, n_words, template words present, the words of those texts that can hold a finding at all, and the
    windows that they need.

    A text can meet a template only if it holds the needed number of its words; that is checked before anything is kept.
    """
    vocabulary = sorted({w for _, ws, _ in known for w in ws})
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    phrase = "|".join(p.replace(" ", GAP) for p in PHRASES)
    seen = docs.select(F.col(id_col).alias("id"), lowered.alias("lowered"))
    seen = seen.select("id", F.col("lowered").rlike(phrase).alias("has_phrase"), F.regexp_extract_all("lowered", F.lit(WORD), F.lit(0)).alias("words"))
    seen = seen.select("id", "has_phrase", "words", F.array_intersect("words", _literal(vocabulary)).alias("present"))
    needs = []
    for size in sorted({n for *_, n in known}):
        able = F.lit(False)
        for _, words, own in known:
            if own == size:
                able = able | ((F.size("present") >= _needed(words, containment)) & (F.size(F.array_intersect("present", _literal(words))) >= _needed(words, containment)))
        needs.append(F.when(able, size))
    seen = seen.select("id", "has_phrase", "words", "present", F.array_compact(F.array(*needs)).alias("windows"))
    return seen.select("id", F.size("words").cast("long").alias("n_words"), "present", "windows", F.when(F.col("has_phrase") | (F.size("windows") > 0), F.col("words")).alias("words"))


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")

    def stands(i: Column) -> Column:
        found = F.lit(True)
        for k, part in enumerate(parts):
            found = found & (F.get(words, i + k) == part)
        return found

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)).otherwise(F.array().cast("array<int>"))


def _template_labels(table: DataFrame, known: list[tuple[str, list[str], int]], containment: float) -> DataFrame:
    """row, label, containment for every template that a block of the row's text meets."""
    spark = table.sparkSession
    frequency = table.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = {r["word"]: r["n"] for r in frequency.collect()}  # one row a template word at most
    order = {w: i for i, w in enumerate(sorted({w for _, ws, _ in known for w in ws}, key=lambda w: (counted.get(w, 0), w)))}
    prefixes, least = [], {}
    for number, (label, words, size) in enumerate(known):
        ranks, needed = sorted(order[w] for w in words), _needed(words, containment)
        least[size] = min(needed, least.get(size, needed))
        prefixes += [(number, label, size, ranks, needed, rank, place) for place, rank in enumerate(ranks[: len(ranks) - needed + 1])]
    small = spark.createDataFrame(prefixes, "template int, label string, window int, ranks array<int>, needed int, rank int, template_place int")
    ranked = spark.createDataFrame(list(order.items()), "word string, rank int")  # the templates' words, some hundreds
    fewest = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("window")]

    # a place of a template word for each window size that its text needs; from here on no row holds a text
    places = table.where("size(windows) > 0").select("row", "n_words", "windows", F.posexplode("words").alias("at", "word"))
    places = places.join(F.broadcast(ranked), "word").select("row", "n_words", "at", "rank", F.explode("windows").alias("window"))
    half = F.expr("cast(window div 2 as int)")
    halves = places.groupBy("row", "n_words", "window", F.floor(F.col("at") / half).cast("int").alias("half")).agg(F.collect_set("rank").alias("held"))
    # a block begins every half window as long as half a window is left: it is made of two halves
    last = F.floor(F.greatest(F.col("n_words") - half, F.lit(0)) / half).cast("int")
    halves = halves.select("row", "window", "held", last.alias("last"), F.explode(F.array(F.col("half") - 1, F.col("half"))).alias("start")).where(F.col("start").between(0, F.col("last")))
    block = F.array_sort(F.array_distinct(F.flatten(F.collect_list("held"))))
    blocks = halves.groupBy("row", "window", "start").agg(block.alias("block")).where(F.size("block") >= fewest)
    first = blocks.select("row", "window", "start", "block", F.posexplode(F.slice(F.col("block"), F.lit(1), F.size("block") - fewest + 1)).alias("place", "rank"))
    met = first.join(F.broadcast(small), ["rank", "window"]).where(F.size("block") >= F.col("needed"))
    pairs = met.groupBy("row", "start", "template").agg(
        F.min("place").alias("place"), F.min("template_place").alias("template_place"), F.first("block").alias("block"),
        F.first("ranks").alias("ranks"), F.first("needed").alias("needed"), F.first("label").alias("label"),
    )
    reach = 1 + F.least(F.size("block") - F.col("place"), F.size("ranks") - F.col("template_place")) - 1
    overlap = F.size(F.array_intersect("block", "ranks"))
    whole = pairs.where(reach >= F.col("needed")).where(overlap >= F.col("needed"))
    return whole.groupBy("row", "label").agg(F.max(overlap / F.size("ranks")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels, labels and score, one row per document."""
    known = templates()
    table = written(_word_table(docs, id_col, text_col, known, containment).withColumn("row", F.monotonically_increasing_id()), "licence-words")
    places = {label: _phrase_places(F.col("words"), phrase) for phrase, label in PHRASES.items()}
    found = table.where("words is not null").select("row", *[p.alias(label) for label, p in places.items()])
    every = F.concat(*[F.col(f"`{label}`") for label in places])
    named = F.array_compact(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, F.lit(label)) for label in places]))
    base = found.select("row", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), named.alias("base"))
    extra = _template_labels(table, known, containment).groupBy("row").agg(F.collect_set("label").alias("extra"), F.max("containment").alias("containment"))
    none = F.array().cast("array<string>")
    merged = table.select("row", F.col("id").alias(id_col), "n_words").join(base.join(extra, "row", "left"), "row", "left")
    return merged.select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("extra", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
