"""Licence notices by a positional rare-token index.

Column functions only. Templates are the words of licence texts and notices, each with a mandatory key phrase. The index holds,
for each template, its RAREST words by inverse document frequency over all texts, with their places in the template. A text
looks up those of them it holds; if they are enough, every place of such a word in the text less its places in the template
is a vote for where the template starts, and the template is proposed where at least SHARE of its indexed words agree. Only
then is the key phrase looked for, within the words the template would cover there and SLACK words around. So a text with a
key phrase in another body does not match, and one with some words changed, or a stretch of words put in, does.

Rarity is taken within a template, never over the text: however many notices a text has, each is decided by its own words.

Words are the runs of digits, a to z and characters above 0x7F of the text with A-Z lower-cased. The texts are read twice,
for document frequencies and for the look-up; nothing but these frequencies, one number per licence word, is shuffled or
seen by the driver, and nothing is written in between.

Score: the share of the template's indexed inverse document frequency that agrees, at the best of its places, the best of all
templates, at least BASE_SCORE where a base phrase stands; 0 without any label. NULL texts count as empty; an empty table
gives an empty result; repeated rows give repeated results, rows without an id keep it; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import numbered

#: Words of a template in the index, and the share of them that has to agree on its place.
RAREST, SHARE = 12, 0.5
#: Words around the place of a template that may hold its key phrase.
SLACK = 8
BASE_SCORE = 0.5

# Base phrases with their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Label, words of the notice or licence, mandatory key phrase.
NOTICES = [
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    (
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        "gnu general public license version 3",
    ),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gnu general public license as published by",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2 0",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "for any purpose with or without fee is hereby granted",
    ),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    (
        "cc0",
        "has waived all copyright and related or neighboring rights to this work",
        "copyright and related or neighboring rights",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided "
        "as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "the author disclaims all warranties",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
        "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
        "or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use "
        "of this software even if advised of the possibility of such damage",
        "redistributions of source code must retain",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the "
        "original software if you use this software in a product an acknowledgment in the product documentation would be "
        "appreciated but is not required 2 altered source versions must be plainly marked as such and must not be "
        "misrepresented as being the original software 3 this notice may not be removed or altered from any source "
        "distribution",
        "the origin of this software must not be misrepresented",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain we make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law",
        "dedicate any and all copyright interest",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
        "apache license version 2 0",
    ),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more "
        "details you should have received a copy of the gnu general public license along with this program",
        "gnu general public license",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mozilla public license v 2 0",
    ),
]

NOTICE_WORDS = [words.split(" ") for _, words, _ in NOTICES]
#: Licence words in order.
LEXICON = sorted({w for words in NOTICE_WORDS for w in words})


def _literal(value) -> Column:
    return F.array(*[_literal(v) for v in value]) if isinstance(value, list) else F.lit(value)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, lower))


def _spaces(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    low = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    split = F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    words = df.select(F.col(id_col).alias("doc_id"), F.filter(split, lambda w: w != "").alias("words"))
    return words.withColumn("lexical", F.array_intersect("words", _literal(LEXICON)))


def base_columns(words: DataFrame) -> DataFrame:
    """``words`` with n_words, n_base, first_word, last_word and base_labels."""
    held = F.arrays_overlap("words", _literal(sorted({p.split(" ")[0] for p, _ in BASE})))
    joined = words.withColumn("norm", F.when(held, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    ahead = "|".join(f"{phrase} " for phrase, _ in BASE)
    base = [F.when(F.contains("norm", F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in BASE]
    cut = joined.select(
        *words.columns,
        F.coalesce(F.split("norm", f"(?<= )(?={ahead})", -1), F.array(F.lit(""))).alias("pieces"),
        F.array_compact(F.array(*base)).alias("base_labels"),
    )
    n_base, n_words = F.size("pieces") - 1, F.size("words").cast("long")
    return cut.select(
        *words.columns,
        n_words.alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.when(n_base > 0, _spaces(F.get("pieces", F.lit(0))) - 1).alias("first_word"),
        F.when(n_base > 0, n_words - _spaces(F.get("pieces", n_base))).alias("last_word"),
        "base_labels",
    )


def frequencies(words: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word; as many numbers as LEXICON has words."""
    rows = words.select(F.explode(F.concat("lexical", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in rows}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in LEXICON}


def index(idf: dict[str, float]) -> list[tuple[list[str], list[list[int]], int]]:
    """For each template its rarest words, their places in it, and how many of them have to agree."""
    out = []
    for words in NOTICE_WORDS:
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:RAREST]
        places = [[i for i, x in enumerate(words) if x == w] for w in rare]
        out.append((rare, places, math.ceil(SHARE * len(rare))))
    return out


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = _words(df, id_col, text_col)
    idf = frequencies(words)
    entries = index(idf)
    rare, needed = _literal([e[0] for e in entries]), _literal([e[2] for e in entries])
    places = _literal([e[1] for e in entries])
    weights = _literal([[idf[w] / sum(idf[x] for x in e[0]) for w in e[0]] for e in entries])
    sizes, keys = _literal([len(w) for w in NOTICE_WORDS]), _literal([phrase for _, _, phrase in NOTICES])
    labels = _literal([label for label, _, _ in NOTICES])

    enough = F.filter(
        F.sequence(F.lit(0), F.lit(len(NOTICES) - 1)),
        lambda t: F.size(F.array_intersect("lexical", F.get(rare, t))) >= F.get(needed, t),
    )

    def votes(t: Column) -> Column:
        """start, word and weight of each agreement of a place in the text with one in the template."""
        at = F.filter(
            F.transform("words", lambda w, i: F.struct(F.array_position(F.get(rare, t), w).alias("j"), i.alias("i"))),
            lambda p: p["j"] > 0,
        )

        def starts(p: Column) -> Column:
            j = (p["j"] - 1).cast("int")
            of = F.get(F.get(places, t), j)
            return F.transform(
                of, lambda x: F.struct((p["i"] - x).alias("start"), j.alias("j"), F.get(F.get(weights, t), j).alias("weight"))
            )

        found = F.array_sort(F.array_distinct(F.flatten(F.transform(at, starts))))
        return F.struct(t.alias("t"), found.alias("found"))

    def agreed(v: Column) -> Column:
        """Starts on which enough words agree."""
        last = F.get(needed, v["t"]) - 1
        same = F.filter(
            numbered(v["found"]), lambda i: F.get(v["found"], i)["start"] == F.get(v["found"], i + last)["start"]
        )
        starts = F.array_distinct(F.transform(same, lambda i: F.get(v["found"], i)["start"]))
        return F.struct(v["t"].alias("t"), v["found"].alias("found"), starts.alias("starts"))

    def verified(v: Column) -> Column:
        """The template with the best share of its proposed places that hold the key phrase; NULL if there is none."""

        def around(start: Column) -> Column:
            low = F.greatest(start - SLACK, F.lit(0))
            high = start + F.get(sizes, v["t"]) + SLACK
            piece = F.slice("words", low + 1, F.greatest(high - low, F.lit(0)))
            return F.contains(
                F.concat(F.lit(" "), F.array_join(piece, " "), F.lit(" ")), F.concat(F.lit(" "), F.get(keys, v["t"]), F.lit(" "))
            )

        def share(start: Column) -> Column:
            mine = F.filter(v["found"], lambda f: f["start"] == start)
            return F.aggregate(mine, F.lit(0.0), lambda acc, f: acc + f["weight"])

        best = F.array_max(F.transform(F.filter(v["starts"], around), share))
        return F.struct(v["t"].alias("t"), best.alias("share"))

    proposed = base_columns(words).withColumn("votes", F.transform(enough, votes))
    placed = proposed.withColumn("places", F.transform("votes", agreed)).drop("votes")
    checked = placed.withColumn(
        "notices", F.filter(F.transform("places", verified), lambda n: n["share"].isNotNull())
    ).drop("places")
    best = F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0))
    every = F.array_distinct(F.concat("base_labels", F.transform("notices", lambda n: F.get(labels, n["t"]))))
    return checked.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.round(F.least(F.greatest(best, F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)), F.lit(1.0)), 6).alias("score"),
    )
