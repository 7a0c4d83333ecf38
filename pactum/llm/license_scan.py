"""License scan: an exact containment join between license notices and text blocks.

A notice is the set of its word pairs (two words in a row), so order counts. A text block
is a window of two steps, cut every step, so any run of up to a step's words lies whole
in some block. A notice of up to STEP + 1 words has steps of STEP words, a longer one
steps of its own length. A block matches a notice when it holds at least THRESHOLD of
the notice's pairs; a notice of fewer than SHORT must stand in it word by word, as there a
single word tells one license from another. Pairs are ordered by their frequency in the
whole corpus, rarest first; a matching block must hold one of a notice's first
n - need + 1 pairs, so only those few rare pairs are joined. Candidates pass a length
filter and a positional one: what a block shares beyond those first pairs is at most what
is left of the notice, and at most what is left of the block in the same order. The rest
is verified on the block. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

BLOCK, STEP, THRESHOLD, SHORT = 64, 32, 0.8, 16
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases that any scan reports, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public license notices, whole and by their paragraphs, as either may stand alone. Notices
#: that differ by one word only would match each other at this threshold, so one of them is listed; those
#: of the GNU licenses differ by version or name alone and carry the label of the family.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to the public domain worldwide"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]


def step_words(notice: str) -> int:
    """Words between the block starts of a notice; its blocks are twice as long."""
    n = len(notice.split())
    return STEP if n <= STEP + 1 else max(n, BLOCK)


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """How many of a notice's ``size`` pairs a block must hold."""
    return size if size < SHORT else math.ceil(threshold * size - 1e-9)


def _hits(docs: DataFrame, words: list[str], pairs: list[str]) -> DataFrame:
    """One slim row a document: its word count, where each phrase stands (s0, s1, ...), and the
    places of the pairs in ``pairs``. ``words`` are the words of pairs and phrases."""
    text = ascii_lower(F.col("text"))
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    place = lambda w, i: F.when(w.isin(words), F.struct(i.alias("at"), w.alias("w")))
    slim = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), found.alias("words"))
    slim = slim.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("words", place), lambda x: x.isNotNull()).alias("hits"))
    after = lambda j: F.get("hits", j + 1)
    pair = lambda h, j: F.when(after(j)["at"] == h["at"] + 1, F.struct(h["at"].alias("at"), F.concat(h["w"], F.lit(" "), after(j)["w"]).alias("w")))
    known = F.filter(F.transform("hits", pair), lambda x: x.isNotNull() & x["w"].isin(pairs))
    return slim.select("doc_id", "key", "n_words", known.alias("pairs"), *[_starts(p).alias(f"s{i}") for i, p in enumerate(PHRASES)])


def _starts(phrase: str) -> Column:
    """Word places at which ``phrase`` stands, from the hits."""
    parts = phrase.split()
    hit = lambda j, k: F.get("hits", j + k)

    def stands(j):
        ok = hit(j, 0)["w"] == parts[0]
        for k in range(1, len(parts)):
            ok = ok & F.coalesce((hit(j, k)["w"] == parts[k]) & (hit(j, k)["at"] == hit(j, 0)["at"] + k), F.lit(False))
        return ok

    index = F.when(F.size("hits") > 0, F.sequence(F.lit(0), F.size("hits") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(index, stands), lambda j: hit(j, 0)["at"].cast("long"))


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks,
    n_verified, n_candidates.

    ``score``: 1 where a phrase stands, else the largest share of a notice in a block
    that matches, else 0. ``n_blocks``: (block, notice) pairs that match, of ``n_verified``
    that pass the positional filter and ``n_candidates`` that pass prefix and length. Null or empty
    text has no words, empty labels and score 0. Each row gives a row; rows that
    repeat id and text get equal results. Extra columns are ignored.
    """
    spark = docs.sparkSession
    notices = notices or NOTICES
    if short := [text for _, text in notices if len(text.split()) < 2]:
        raise ValueError(f"a notice needs two words: {short}")
    sets = [(i, label, sorted(set(pairs_of(text.split())))) for i, (label, text) in enumerate(notices)]
    step = [step_words(text) for _, text in notices]
    words = sorted({w for _, text in notices for w in text.split()} | {w for p in PHRASES for w in p.split()})
    slim = stored(_hits(docs, words, sorted({p for *_, ps in sets for p in ps})), "license-hits")

    # Corpus frequency of the notices' pairs: as many rows as they have pairs.
    counts = dict(slim.select(F.explode("pairs.w").alias("w")).groupBy("w").count().collect())
    order = sorted({w for *_, ps in sets for w in ps}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order, 1)}
    index, whole = [], []
    for i, label, ps in sets:
        ordered = sorted(rank[w] for w in ps)
        need = needed(len(ps), threshold)
        prefix = len(ps) - need + 1
        index += [(order[r - 1], i, step[i]) for r in ordered[:prefix]]
        run = [rank[w] for w in pairs_of(notices[i][1].split())] if len(ps) < SHORT else []
        whole.append((i, label, len(ps), need, prefix, ordered[prefix - 1], ordered, run))
    index = spark.createDataFrame(index, "w string, notice int, step int")
    whole = spark.createDataFrame(whole, "notice int, label string, size int, need int, prefix int, last int, rs array<int>, run array<int>")

    rare = slim.select("key", "n_words", F.explode("pairs").alias("x")).select("key", "n_words", "x.w", "x.at")
    met = rare.join(F.broadcast(index), "w").withColumn("b", F.floor(F.col("at") / F.col("step")))
    met = met.withColumn("block", F.explode(F.filter(F.array("b", F.col("b") - 1), lambda b: b >= 0)))
    met = met.groupBy("key", "n_words", "block", "notice", "step").agg(F.countDistinct("w").alias("c")).join(F.broadcast(whole), "notice")
    length = F.least(2 * F.col("step"), F.col("n_words") - 1 - F.col("block") * F.col("step")) >= F.col("need")
    candidates = met.filter(length).groupBy("key").agg(F.collect_set(F.struct("block", "step", "label", "size", "need", "prefix", "last", "rs", "run", "c")).alias("cs"))

    # Pairs by their rank; a document without candidates looks none up.
    ranks = F.map_from_arrays(F.split(F.lit("\n".join(order)), "\n"), F.sequence(F.lit(1), F.lit(len(order))))
    ranked = F.when(F.col("cs").isNotNull(), F.transform("pairs", lambda h: F.struct(h["at"].alias("at"), ranks[h["w"]].alias("r"))))
    within = lambda c: F.filter("ranked", lambda h: (h["at"] >= c["block"] * c["step"]) & (h["at"] < (c["block"] + 2) * c["step"]))
    held = F.transform(F.coalesce("cs", F.array().cast(candidates.schema["cs"].dataType)), lambda c: F.struct(c.alias("c"), within(c).alias("hs")))
    held = F.transform(held, lambda x: F.struct(x["c"].alias("c"), x["hs"].alias("hs"), F.array_distinct(x["hs"]["r"]).alias("own")))
    rest = lambda x: F.least(x["c"]["size"] - x["c"]["prefix"], F.size(F.filter(x["own"], lambda r: r > x["c"]["last"])))
    passed = F.filter("held", lambda x: x["c"]["c"] + rest(x) >= x["c"]["need"])

    def stands(x):
        """Whether the run of a short notice stands in the block; others have none."""
        hs, n = x["hs"], F.size(x["c"]["run"])
        at = lambda j: (F.slice(hs["r"], j, n) == x["c"]["run"]) & (F.get(hs, j + n - 2)["at"] - F.get(hs, j - 1)["at"] == n - 1)
        return (n == 0) | ((F.size(hs) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hs) - n + 1)), lambda j: F.coalesce(at(j), F.lit(False))))

    shared = F.transform("passed", lambda x: F.struct(x["c"]["label"].alias("label"), F.size(F.array_intersect(x["own"], x["c"]["rs"])).alias("n"), x["c"]["size"].alias("size"), x["c"]["need"].alias("need"), stands(x).alias("stands")))
    rows = slim.join(candidates, "key", "left").withColumn("ranked", ranked).withColumn("held", held).withColumn("passed", passed)
    rows = rows.withColumn("ok", F.filter(shared, lambda c: (c["n"] >= c["need"]) & c["stands"]))
    starts = {p: F.col(f"s{i}") for i, p in enumerate(PHRASES)}
    rows = rows.withColumn("starts", F.flatten(F.array(*starts.values())))
    base = F.array_compact(F.array(*[F.when(F.size(starts[p]) > 0, F.lit(label)) for p, label in PHRASES.items()]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("ok", lambda c: c["n"] / c["size"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("ok", lambda c: c["label"]))).alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(best).alias("score"), F.size("ok").cast("long").alias("n_blocks"),
        F.size("passed").cast("long").alias("n_verified"), F.size("held").cast("long").alias("n_candidates"),
    )
