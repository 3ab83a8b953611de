"""License scans with a positional rare-token index, in DataFrame functions only.

The index lists, for each telling word of the license templates, the templates and the places where it stands.  Words are
weighed by inverse document frequency, counted over all documents first.  For each document and template, the rarest of
the document's license words are looked up, then commoner ones, but only while the words that are left, with one that was
looked up, could still carry an alignment past LEAST_SCORE.  After that, any alignment that passes holds two or more of the
postings looked up, so templates without two that agree on the relative position (place in the document less place in the
template) are out, and none is lost.  Of the others the mandatory key phrases must stand in the text, and then all postings
of all words are aligned: a template is reported if one alignment has enough support, in hits and in weight.  Three plain
phrases are counted beside that.

One pass reads the texts; it also notes which templates' key phrases they hold.  What follows works on license words only,
and up to the few documents with a template left, inside each row.

Defined results: a null or empty text has no words, empty label lists, null first and last places and score 0; texts of
any length are scanned whole; repeated rows are scanned each; templates and alignments that tie are all reported, in order
of their names; an empty table gives an empty one; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words over lower-cased text; on text of any case the letters A-Z belong to them too.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_HITS = 4
LEAST_SCORE = 0.6

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public license notices, and the phrases that must stand in a text that carries them.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "must retain the above copyright notice"]),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ["except in compliance with the license", "unless required by applicable law or agreed to in writing"]),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["under the terms of the gnu general public license", "as published by the free software foundation"]),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["gnu lesser general public license", "as published by the free software foundation"]),
    "agpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu affero general public license", "as published by the free software foundation"]),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["subject to the terms of the mozilla public license"]),
    "boost": ("boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software", ["boost software license"]),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose", "redistribute it freely"]),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software released into the public domain"]),
    "cc": ("this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", ["licensed under a creative commons attribution"]),
}

#: Template words that tell nothing.
PLAIN_WORDS = "this that the and with without for from any all are was not you can one they http www org will either case each other which when what have been form into work copy copies".split()


def _postings() -> dict[str, list[tuple[str, int]]]:
    index: dict[str, list[tuple[str, int]]] = {}
    for label, (text, _) in TEMPLATES.items():
        for at, word in enumerate(re.findall(WORD, text)):
            if len(word) > 3 and word not in PLAIN_WORDS:
                index.setdefault(word, []).append((label, at))
    return index


def _places(lic: Column, ids: dict[str, int]) -> Column:
    """Places of the plain phrases, from the license words' numbers and places."""

    def at(j: Column) -> Column:
        out = F.lit(None).cast("struct<label:string,at:int>")
        for phrase, label in PHRASES.items():
            hit = F.lit(True)
            for k, word in enumerate(phrase.split()):
                here = F.get(lic, j + k)
                hit = hit & F.coalesce((here["w"] == ids[word]) & (here["i"] == F.get(lic, j)["i"] + k), F.lit(False))
            out = F.when(hit, F.struct(F.lit(label).alias("label"), F.get(lic, j)["i"].alias("at"))).otherwise(out)
        return out

    every = F.when(F.size(lic) > 1, F.sequence(F.lit(0), F.size(lic) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(every, at), lambda x: x.isNotNull())


def _listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _literal(value: object, kind: str) -> Column:
    """A constant of fixed size."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: inside a lambda a plain column would be computed at every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rarest(words: Column, weight: dict[str, float], ids: dict[str, int], index: dict[str, list[tuple[str, int]]], labels: list[str]) -> Column:
    """Keys (template * 65536 + word) of what is looked up, from the distinct license words of a document.

    Of each template, words go from rare to common; a word is looked up if those from it on, with the rarest one, could carry
    LEAST_SCORE of the weight of all the document's words that the template holds."""
    held: list[list[dict]] = [[] for _ in ids]
    for w, all_ in index.items():
        for label in sorted({label for label, _ in all_}):
            held[ids[w]].append({"t": labels.index(label), "rare": -weight[w], "w": ids[w], "mass": weight[w] * sum(x == label for x, _ in all_)})
    entries = F.sort_array(F.flatten(F.transform(words, lambda w: F.get(_literal(held, "array<array<struct<t:int,rare:double,w:int,mass:double>>>"), w))))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y["mass"])
    could = lambda mine: F.transform(_literal(list(range(len(labels))), "array<int>"), lambda t: add(F.filter(mine, lambda x: x["t"] == t)))

    def step(s: Column, x: Column) -> Column:
        same = s["now"]["t"] == x["t"]
        before, first = F.when(same, s["before"]).otherwise(0.0), F.when(same, s["first"]).otherwise(-x["rare"])
        of = F.get(s["could"], x["t"])
        needed = of - before + first >= LEAST_SCORE * of - 1e-9
        out = F.when(needed, F.concat(s["out"], F.array(x["t"] * 65536 + x["w"]))).otherwise(s["out"])
        return F.struct(x.alias("now"), (before + x["mass"]).alias("before"), first.alias("first"), s["could"].alias("could"), out.alias("out"))

    none = F.struct(F.lit(-1).alias("t"), F.lit(0.0).alias("rare"), F.lit(-1).alias("w"), F.lit(0.0).alias("mass"))
    start = lambda mine: F.struct(none.alias("now"), F.lit(0.0).alias("before"), F.lit(0.0).alias("first"), could(mine).alias("could"), F.array().cast("array<int>").alias("out"))
    return _once(entries, lambda mine: F.aggregate(mine, start(mine), step, lambda s: s["out"]))


def supported(lic: Column, looked: Column, ids: dict[str, int], index: dict[str, list[tuple[str, int]]], labels: list[str]) -> Column:
    """Templates of which two postings that were looked up agree on the relative position."""
    posted: list[list[dict]] = [[] for _ in ids]
    for w, all_ in index.items():
        posted[ids[w]] = [{"k": labels.index(label) * 65536 + ids[w], "t": labels.index(label), "at": at} for label, at in all_]
    hits = lambda x, keys: F.filter(F.get(_literal(posted, "array<array<struct<k:int,t:int,at:int>>>"), x["w"]), lambda p: F.array_contains(keys, p["k"]))
    # template and shift in one long; the shift is above -65536, as no template is that long
    shift = lambda x, p: p["t"].cast("long") * 2**40 + (x["i"] - p["at"] + 65536)
    shifts = _once(looked, lambda keys: F.sort_array(F.flatten(F.transform(lic, lambda x: F.transform(hits(x, keys), lambda p: shift(x, p))))))
    agreed = _once(shifts, lambda all_: F.zip_with(all_, F.slice(all_, 2, F.greatest(F.size(all_), F.lit(1))), lambda a, b: F.when(a == b, F.floor(a / 2**40).cast("int"))))
    return F.array_distinct(F.filter(agreed, lambda t: t.isNotNull()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = docs.sparkSession
    index, labels = _postings(), sorted(TEMPLATES)
    wanted = sorted(set(index) | {w for p in PHRASES for w in p.split()})
    ids = {w: i for i, w in enumerate(wanted)}

    # lower() maps one sign outside A-Z to an ASCII letter; that sign is put aside first
    text = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"))
    numbers = F.create_map(*(x for w, i in ids.items() for x in (F.lit(w), F.lit(i))))
    found = F.filter(F.transform("words", lambda w, i: F.when(w.isin(wanted), F.struct(F.element_at(numbers, w).alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    one = words.select("doc_id", "words", found.alias("lic"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    every = _literal([{"t": t, "p": [f" {p} " for p in TEMPLATES[label][1]]} for t, label in enumerate(labels)], "array<struct<t:int,p:array<string>>>")
    stated = F.transform(F.filter(every, lambda x: F.forall(x["p"], lambda p: F.contains(joined, p))), lambda x: x["t"])
    no_labels = F.array().cast("array<int>")
    slim = materialize(one.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "lic", F.when(F.size("lic") >= LEAST_HITS, stated).otherwise(no_labels).alias("stated")))

    # document frequency of the index words, a few hundred numbers
    slim_words = slim.withColumn("distinct", F.array_distinct(F.transform("lic", lambda x: x["w"])))
    n = max(1, slim.count())
    seen = {r.w: r.n for r in slim_words.select(F.explode("distinct").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    weight = {w: math.log((n + 2) / (seen.get(ids[w], 0) + 1)) + 1e-6 for w in index}
    looked = slim_words.where(F.size("lic") >= LEAST_HITS).withColumn("looked", rarest(F.col("distinct"), weight, ids, index, labels))
    left = looked.select("row", "lic", F.array_intersect(supported(F.col("lic"), F.col("looked"), ids, index, labels), "stated").alias("left"))
    some = left.where(F.size("left") > 0).select("row", "left", F.explode("lic").alias("x"))
    postings = spark.createDataFrame([(ids[w], labels.index(label), at, weight[w]) for w, all_ in sorted(index.items()) for label, at in all_], "w int, t int, at int, idf double")
    # at most one row per posting: a table of fixed size
    met = some.select("row", "left", F.col("x.w").alias("w"), F.col("x.i").alias("i")).join(F.broadcast(postings), "w").where(F.array_contains("left", F.col("t")))
    aligned = met.groupBy("row", "t", (F.col("i") - F.col("at")).alias("shift")).agg(F.count("*").alias("hits"), F.sum("idf").alias("got"))
    could = met.select("row", "t", "w", "at", "idf").distinct().groupBy("row", "t").agg(F.sum("idf").alias("could"))
    best = aligned.where(F.col("hits") >= LEAST_HITS).groupBy("row", "t").agg(F.max("got").alias("got"))
    named = best.join(could, ["row", "t"]).withColumn("score", F.least(F.lit(1.0), F.col("got") / F.col("could"))).where(F.col("score") >= LEAST_SCORE)
    named = named.groupBy("row").agg(F.collect_set(F.get(_literal(labels, "array<string>"), F.col("t"))).alias("named"), F.max("score").alias("score"))

    base = slim.select("row", "doc_id", "n_words", _places(F.col("lic"), ids).alias("places"))
    base_labels, starts = F.transform("places", lambda x: x["label"]), F.transform("places", lambda x: x["at"].cast("long"))
    all_labels = F.concat(base_labels, F.coalesce("named", F.array().cast("array<string>")))
    return base.join(named, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _listed(base_labels).alias("base_labels"), _listed(all_labels).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce("score", F.lit(0.0)), 6)).alias("score"),
    )


def oracle_sql() -> str:
    """The same rows in SQL."""
    postings = ", ".join(f"('{w}', '{label}', {at})" for w, all_ in sorted(_postings().items()) for label, at in all_)
    mandatory = ", ".join(f"('{label}', ' {p} ')" for label, (_, phrases) in TEMPLATES.items() for p in phrases)
    follows = lambda p: " AND ".join(f"lead(w, {k}) OVER o = '{x}'" if k else f"w = '{x}'" for k, x in enumerate(p.split()))
    plain = " ".join(f"WHEN {follows(p)} THEN '{label}'" for p, label in PHRASES.items())
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
 said AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM docs WHERE len(words) > 0),
 postings AS (SELECT * FROM (VALUES {postings}) v(w, label, place)), mandatory AS (SELECT * FROM (VALUES {mandatory}) v(label, phrase)),
 seen AS (SELECT w, count(DISTINCT r) AS n FROM said SEMI JOIN postings USING (w) GROUP BY 1),
 weights AS (SELECT w, ln(((SELECT count(*) FROM docs) + 2.0) / (coalesce(n, 0) + 1)) + 1e-6 AS idf FROM (SELECT DISTINCT w FROM postings) LEFT JOIN seen USING (w)),
 met AS (SELECT r, label, w, i, place, idf FROM said JOIN postings USING (w) JOIN weights USING (w)),
 aligned AS (SELECT r, label, sum(idf) AS got FROM met GROUP BY r, label, i - place HAVING count(*) >= {LEAST_HITS}),
 proven AS (SELECT r, label, max(got) AS got FROM aligned JOIN docs USING (r) JOIN mandatory USING (label) GROUP BY r, label HAVING bool_and(contains(' ' || array_to_string(words, ' ') || ' ', phrase))),
 could AS (SELECT r, label, sum(idf) AS could FROM (SELECT DISTINCT r, label, w, place, idf FROM met) GROUP BY ALL),
 named AS (SELECT r, list(label) AS labels, max(least(1.0, got / could)) AS score FROM proven JOIN could USING (r, label) WHERE least(1.0, got / could) >= {LEAST_SCORE} GROUP BY 1),
 places AS (SELECT * FROM (SELECT r, i, CASE {plain} END AS label FROM said WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE label IS NOT NULL),
 base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS labels FROM places GROUP BY 1)
 SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(list_distinct(base.labels)), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(named.labels, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(named.score, 0), 6) END::DOUBLE AS score
 FROM docs LEFT JOIN base USING (r) LEFT JOIN named USING (r)"""
