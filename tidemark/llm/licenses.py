"""Licence scan by a positional rare-token index, in DataFrame functions only.

A template is a licence's characteristic wording or its full public header.  The index lists templates under their words
of highest inverse document frequency (counted over all files), with the word's position.  A file looks up its words that are
listed; each posting gives (template, start of the template in the file), and postings of two or more words that agree on
the start are an alignment.  An alignment counts if the template's key phrase is there in full, two content words agree
and enough of the template stands in place.

Nothing is missed, and no file's lookups are capped: a match may lack ``1 - MIN_MATCH`` of the template's words, so of that many
and two more of its rarest content words at least two stand in place; these are what the index lists.  (A template with
fewer content words lists all of them, and two must agree anyway.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import barrier, id_text, let

#: Everything that is no ASCII letter or digit and no character beyond ASCII separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, wording, key phrase): public licence notices, fixed values.
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
             "general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                   "http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", "for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license",
     "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
                   "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable "
                   "law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties "
                   "or conditions of any kind either express or implied see the license for the specific language governing permissions and "
                   "limitations under the license", "unless required by applicable law or agreed to in writing"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
                "as published by the free software foundation either version 3 of the license or at your option any later version this "
                "program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                "merchantability or fitness for a particular purpose see the gnu general public license for more details",
     "either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
                "as published by the free software foundation either version 2 of the license or at your option any later version this "
                "program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                "merchantability or fitness for a particular purpose see the gnu general public license for more details",
     "either version 2 of the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
            "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
            "so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the software", "modify merge publish distribute sublicense"),
    ("bsd-3-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following "
                     "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                     "following disclaimer in the documentation and or other materials provided with the distribution neither the name of the "
                     "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                     "without specific prior written permission", "neither the name of"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following "
                     "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                     "following disclaimer in the documentation and or other materials provided with the distribution",
     "redistributions in binary form must reproduce"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright"),
]
#: Words of templates that are not looked up: they say nothing about licences.
FUNCTION_WORDS = set("a all and any are as at by can code copy file files following for form forms free has http in into is it made met "
                     "of or org person possible program public related rights sa nc nd subject that the this to under use version v "
                     "with work www you your 0 2 3 4 may not author available materials conditions law extent".split())
#: Content words of a template that must stand in place.
AGREE = 2
#: Share of a template's words that must stand in place.
MIN_MATCH = 0.7


def words_of(text: Column) -> Column:
    # lower() also maps letters beyond ASCII; they stay word characters, so words and positions do not change
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != F.lit(""))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _stands(words: Column, at: Column, phrase: str) -> Column:
    """Whether the phrase's words stand from position ``at`` on."""
    parts = phrase.split()
    test = F.get(words, at) == F.lit(parts[0])
    for k, p in enumerate(parts[1:], 1):
        test = test & (F.get(words, at + F.lit(k)) == F.lit(p))
    return F.coalesce(test, F.lit(False))


def template_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, wording, _ in templates for w in wording.split()} - FUNCTION_WORDS)


def words_by_rarity(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' content words, highest inverse document frequency over all ``docs`` first.

    At most one row per template word (a fixed list) reaches the driver."""
    vocabulary = template_words(templates)
    found = (id_text(docs).select(F.explode(F.array_intersect(words_of(F.col("text")), _strings(vocabulary))).alias("w"))
             .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())
    n = {r["w"]: r["n"] for r in found}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _listed(rarest: list[str], templates) -> dict[str, list[tuple[int, int]]]:
    """The index: word -> (template, position in it), for each template's rarest content words, as many as a match may lack
    and :data:`AGREE` more."""
    rank = {w: i for i, w in enumerate(rarest)}
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, wording, _) in enumerate(templates):
        words = wording.split()
        places = sorted((p for p, w in enumerate(words) if w in rank), key=lambda p: (rank[words[p]], p))
        needed = next(k for k in range(len(words) + 1) if k / len(words) >= MIN_MATCH)
        for p in places[:len(words) - needed + AGREE]:
            index.setdefault(words[p], []).append((t, p))
    return index


def _alignments(words: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """All (template, offset) on which postings of at least :data:`AGREE` words of the file agree, as structs t, o."""
    listed = sorted(index)
    postings = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in index[w]]) for w in listed])
    hits = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(_strings(listed), w).alias("k"), i.alias("i"))), lambda x: x["k"] > 0)
    found = F.array_sort(F.flatten(F.transform(hits, lambda x: F.transform(
        F.get(postings, (x["k"] - 1).cast("int")), lambda a: F.struct(a["t"].alias("t"), (x["i"] - a["p"]).alias("o"))))))
    # sorted: postings that agree lie together, so the one AGREE - 1 places on is the same
    return let(found, lambda all_: F.array_distinct(F.filter(all_, lambda x, i: F.coalesce(F.get(all_, i + F.lit(AGREE - 1)) == x, F.lit(False)))))


def license_scan(docs: DataFrame, templates=TEMPLATES, rare_words: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row per input row.

    ``n_base`` counts the places where a base phrase's words stand consecutively; ``first_word`` and
    ``last_word`` are the smallest and largest start (null without one).  ``labels`` adds the labels of matched
    templates; ``score`` is the best matched template's share of words in place (0 without one).  Null or
    empty text: no words, empty label strings.  Repeated rows are scanned each; other columns are ignored;
    an empty table gives an empty result.  One scan counts the words, one labels; no row is shuffled.
    """
    rarest = rare_words if rare_words is not None else words_by_rarity(docs, templates)
    df = id_text(docs).select("doc_id", words_of(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    w, n = F.col("w"), F.size("w")
    starts = F.filter(
        F.transform(w, lambda x, i: F.when(x.isin(*sorted({p.split()[0] for p in BASE})), F.struct(
            i.alias("i"), F.array_compact(F.array(*[F.when(_stands(w, i, p), F.lit(label)) for p, label in BASE.items()])).alias("l")))),
        lambda s: F.size(s["l"]) > 0)
    index = _listed(rarest, templates)
    df = df.select("*", F.when(F.arrays_overlap(w, _strings(sorted({p.split()[0] for p in BASE}))), starts).alias("s"),
                   F.when(F.arrays_overlap(w, _strings(sorted(index))), _alignments(w, index)).alias("a"))
    wordings = F.array(*[_strings(x.split()) for _, x, _ in templates])
    contents = F.array(*[F.array(*[F.lit(x not in FUNCTION_WORDS) for x in wording.split()]) for _, wording, _ in templates])

    def checked(a: Column) -> Column:
        wording = F.get(wordings, a["t"])
        stands = lambda p: F.get(w, a["o"] + p) == F.get(wording, p)
        there = F.size(F.filter(F.transform(wording, lambda _, p: stands(p)), lambda x: x)) / F.size(wording)
        agree = F.size(F.filter(F.transform(F.get(contents, a["t"]), lambda c, p: c & stands(p)), lambda x: x))
        key = F.lit(False)
        for t, (_, text, phrase) in enumerate(templates):
            at = _position(text, phrase)
            key = F.when(a["t"] == t, _stands(w, a["o"] + at, phrase)).otherwise(key)
        label = F.get(_strings([x for x, _, _ in templates]), a["t"])
        return F.when(key & (agree >= AGREE) & (there >= MIN_MATCH), F.struct(label.alias("l"), there.alias("share")))

    df = df.select("*", F.array_compact(F.transform("a", checked)).alias("m"))
    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_distinct(F.flatten(F.transform("s", lambda s: s["l"]))), none)
    own = F.coalesce(F.transform("m", lambda m: m["l"]), none)
    return barrier(df).select(
        "doc_id", n.cast("long").alias("n_words"),
        F.coalesce(F.aggregate("s", F.lit(0), lambda t, s: t + F.size(s["l"])), F.lit(0)).cast("long").alias("n_base"),
        F.get("s", F.lit(0))["i"].cast("long").alias("first_word"),
        F.get("s", F.size("s") - 1)["i"].cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("m", lambda m: m["share"])), F.lit(0.0)).alias("score"))


def _position(wording: str, phrase: str) -> int:
    words, parts = wording.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i:i + len(parts)] == parts)
