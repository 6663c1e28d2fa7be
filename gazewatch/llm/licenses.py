"""License scans by a positional index of rare words.

Templates are the wordings of license notices. From the counts of all rows, the words of each
template are ranked by inverse document frequency, and its rarest ones are posted with their
places: so many that a notice without enough of them cannot reach the share that is asked
for. A document's words are looked up in the postings; those of a template that agree, but
for a few words, on where it would begin make it a candidate. Candidates are then verified:
the words of the key phrase must stand as the template has them, and around them enough of
the whole template. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazewatch.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# The phrases that name a license outright, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A notice's wording. Words of `key` must stand where the wording has them; a common word of
    a key has another word beside it there."""

    label: str
    wording: str
    key: str

    @property
    def words(self) -> list[str]:
        return plain_words(self.wording)


def plain_words(text: str) -> list[str]:
    """The words of a wording, as those of a text are told apart."""
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(SEPARATORS, lowered) if w]


# Customary wordings of license notices.
TEMPLATES = (
    Template("mit", "Released under the MIT License", "mit license"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files""", "associated documentation files"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT.""", "without restriction including without limitation the rights"),
    Template("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""", "unless required by applicable law or agreed to in writing"),
    Template("gpl", "This work is licensed under the GNU General Public License version 3", "gnu general public license"),
    Template("gpl", """you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation""", "gnu general public license as published by the free software foundation"),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""", "gnu general public license as published by the free software foundation"),
    Template("lgpl", "Licensed under the GNU Lesser General Public License", "gnu lesser general public license"),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version. This library is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU Lesser General Public License for more details.""", "gnu lesser general public license as published"),
    Template("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""", "gnu affero general public license"),
    Template("gfdl", """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU
        Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no
        Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.""", "gnu free documentation license"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "creative commons attribution 4 0"),
    Template("cc-by", "Licensed under CC BY 4.0", "licensed under cc by 4 0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "creative commons attribution noncommercial 4 0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "creative commons attribution sharealike 4 0"),
    Template("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "creative commons attribution noderivatives 4 0"),
    Template("cc-by-nc-sa", """This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0
        International License""", "creative commons attribution noncommercial sharealike 4 0"),
    Template("cc-by-nc-nd", """This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0
        International License""", "creative commons attribution noncommercial noderivatives 4 0"),
    Template("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring
        rights to this work""", "waived all copyright and related or neighboring rights"),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""", "source and binary forms"),
    Template("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: 1. Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY""",
        "redistributions in binary form must reproduce the above copyright notice"),
    Template("bsd-3-clause", """Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
        "endorse or promote products derived from this software"),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "any purpose with or without fee is hereby granted"),
    Template("mpl", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "mozilla public license v 2 0"),
    Template("epl", """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""", "eclipse public license"),
    Template("cddl", """The contents of this file are subject to the terms of the Common Development and Distribution
        License (the "License"). You may not use this file except in compliance with the License.""",
        "common development and distribution license"),
    Template("eupl", """Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission -
        subsequent versions of the EUPL (the "Licence")""", "licensed under the eupl"),
    Template("boost", """Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of
        charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license""", "boost software license"),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to
        use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely""", "held liable for any damages arising"),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
        "unencumbered software released into the public domain"),
    Template("wtfpl", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document,
        and changing it is allowed as long as the name is changed.""", "changing it is allowed as long as the name is changed"),
    Template("artistic", """This package is free software; you can redistribute it and/or modify it under the terms of the
        Artistic License 2.0""", "artistic license"),
    Template("ofl", """This Font Software is licensed under the SIL Open Font License, Version 1.1""", "sil open font license"),
)

#: Words too common to look up by themselves; they are posted only inside a key phrase.
COMMON = frozenset("the of to a and or is it in this that are you can any as use with under by for on be".split())
#: The share of a template's weight that must agree.
LEAST_SHARE = 0.7
#: Words that may be put in or left out between the key phrase and another word of the notice.
SLACK = 8


def template_words() -> list[tuple[str, int, str, int, bool]]:
    """(word, template, label, place, mandatory) of every word that counts."""
    rows = []
    for number, t in enumerate(TEMPLATES):
        words, key = t.words, plain_words(t.key)
        start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        for place, word in enumerate(words):
            mandatory = start <= place < start + len(key)
            if mandatory or word not in COMMON:
                rows.append((word, number, t.label, place, mandatory))
    return rows


VOCABULARY = sorted({p[0] for p in template_words()} | {w for phrase in PHRASES for w in phrase.split()})


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def word_hits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_words and hits of every row: its license words as (place, word), in order.

    Common words count as hits only next to another license word, which every phrase and
    key has. The rows are checkpointed, which gives each a number of its own.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), _words(F.col(text)).alias("words"))
    rare = [w for w in VOCABULARY if w not in COMMON]
    common = [w for w in VOCABULARY if w in COMMON]
    whole = F.col("words")

    def hit(w: Column, i: Column) -> Column:
        beside = F.get(whole, i - 1).isin(rare) | F.get(whole, i + 1).isin(rare)
        return F.when(
            w.isin(rare) | (w.isin(common) & F.coalesce(beside, F.lit(False))), F.named_struct(F.lit("i"), i, F.lit("w"), w)
        )

    # A filter of places comes first: only few words make an entry.
    hits = F.filter(F.transform(whole, hit), lambda h: h.isNotNull())
    rows = words.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    return checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))


def _phrase_places(hits: Column, phrase: str) -> Column:
    """Where a phrase's words stand one after the other."""
    words = phrase.split()

    def begins(h: Column, j: Column) -> Column:
        found = h["w"] == words[0]
        for step, word in enumerate(words[1:], 1):
            following = F.get(hits, j + step)
            found = found & (following["w"] == word) & (following["i"] == h["i"] + step)
        return F.coalesce(found, F.lit(False))

    return F.transform(F.filter(hits, begins), lambda h: h["i"])


def base_scan(hits: DataFrame) -> DataFrame:
    """Adds n_base, first_word, last_word and the array `base` of the named licenses."""
    found = {phrase: f"_at{i}" for i, phrase in enumerate(PHRASES)}
    rows = hits.withColumns({c: _phrase_places(F.col("hits"), phrase) for phrase, c in found.items()})
    every = F.flatten(F.array(*found.values()))
    named = F.array(*[F.when(F.size(c) > 0, F.lit(PHRASES[phrase])) for phrase, c in found.items()])
    return rows.withColumns(
        {
            "n_base": F.size(every).cast("long"),
            "first_word": F.array_min(every).cast("long"),
            "last_word": F.array_max(every).cast("long"),
            "base": F.array_compact(named),
        }
    ).drop(*found.values())


def word_weights(hits: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each license word over all rows.

    One sum for each word of the fixed vocabulary reaches the driver, whatever the input.
    """
    words = F.transform("hits", lambda h: h["w"])
    counts = hits.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}
    n = hits.count()
    return {w: math.log(1 + n / (1 + found.get(w, 0))) for w in VOCABULARY}


def rare_postings(weights: dict[str, float]) -> tuple[list[tuple], list[tuple]]:
    """The index, (word, template, place, weight), and of each template (template, label, total, needed).

    Words of a template are posted from the rarest on, until those that are not posted weigh
    less than the share asked for. So a notice that reaches the share holds posted words of
    at least the weight `needed`, whatever else it holds.
    """
    index, limits = [], []
    for number, t in enumerate(TEMPLATES):
        words = [(w, place) for w, n, _, place, _ in template_words() if n == number]
        total = sum(weights[w] for w, _ in words)
        left = total
        for word in sorted({w for w, _ in words}, key=lambda w: (w in COMMON, -weights[w], w)):
            if left < LEAST_SHARE * total:
                break
            own = [(word, number, place, weights[word]) for w, place in words if w == word]
            index += own
            left -= weights[word] * len(own)
        limits.append((number, t.label, total, LEAST_SHARE * total - left))
    return index, limits


def aligned(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """row, label and share of every template found at some place of a row."""
    spark = hits.sparkSession
    index, limits = rare_postings(weights)
    posted = spark.createDataFrame(index, "w string, template int, place int, weight double")
    limits = F.broadcast(spark.createDataFrame(limits, "template int, label string, total double, needed double"))
    wording = spark.createDataFrame(
        [(w, n, place, mandatory, weights[w]) for w, n, _, place, mandatory in template_words()],
        "w string, template int, place int, mandatory boolean, weight double",
    )
    rows = hits.where(F.size("hits") > 0).select("row", "hits")
    rare = sorted({w for w, *_ in index})
    looked_up = rows.select("row", F.explode(F.filter("hits", lambda h: h["w"].isin(rare))).alias("h"))
    # The index and the wordings are fixed tables of some hundred rows. Beginnings that differ
    # by SLACK on either side of a key fall into one stretch of four times as many, or its neighbour.
    met = looked_up.select("row", F.col("h.i").alias("i"), F.col("h.w").alias("w")).join(F.broadcast(posted), "w")
    stretch = F.floor((F.col("i") - F.col("place")) / (4 * SLACK))
    half = F.floor((F.col("i") - F.col("place") + 2 * SLACK) / (4 * SLACK))
    near = F.array(F.struct(F.lit(0).alias("kind"), stretch.alias("at")), F.struct(F.lit(1).alias("kind"), half.alias("at")))
    places = met.select("row", "template", "place", "weight", F.inline(near)).distinct()
    candidates = (
        places.groupBy("row", "template", "kind", "at")
        .agg(F.sum("weight").alias("weight"))
        .join(limits.select("template", "needed"), "template")
        .where(F.round("weight", 9) >= F.round("needed", 9))
        .select("row", "template")
        .distinct()
    )
    # Candidates are few: their words meet the whole wording, first the key, then all of it.
    words = candidates.join(rows, "row").select("row", "template", F.inline("hits"))
    whole = words.join(F.broadcast(wording), ["w", "template"]).withColumn("begin", F.col("i") - F.col("place"))
    keys = F.broadcast(wording.where("mandatory").groupBy("template").agg(F.count(F.lit(1)).alias("keys")))
    anchors = (
        whole.where("mandatory")
        .groupBy("row", "template", "begin")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(keys, "template")
        .where("n = keys")
        .select("row", "template", F.col("begin").alias("anchor"))
    )
    found = (
        whole.join(anchors, ["row", "template"])
        .where(F.abs(F.col("begin") - F.col("anchor")) <= SLACK)
        .select("row", "template", "anchor", "place", "weight")
        .distinct()
        .groupBy("row", "template", "anchor")
        .agg(F.sum("weight").alias("weight"))
    )
    share = F.round(F.least(F.lit(1.0), F.col("weight") / F.col("total")), 9).alias("share")
    return found.join(limits, "template").select("row", "label", share).where(F.col("share") >= LEAST_SHARE)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. n_base
    counts all places of the four phrases, first_word and last_word are the smallest and
    largest of their starts, or null. labels adds those of the templates found to
    base_labels; both are distinct, sorted and joined by commas. The score is 1 with a base
    phrase, else the best template's agreeing share, else 0. Null and empty texts have no
    words. Each input row, repeated or without id, gives one row.
    """
    hits = word_hits(docs, doc_id, text)
    base = base_scan(hits)
    found = aligned(hits, word_weights(hits)).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share")
    )
    joined = base.join(found, "row", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.round(F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))), 6).alias("score"),
    )
