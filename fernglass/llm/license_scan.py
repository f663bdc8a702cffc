"""License scans by a positional rare-token index, with DataFrame functions only.

The index holds, for every word of the licence templates, its postings: the
templates and the places where it stands there.  How many documents have each
of these words is counted over all documents, which gives its IDF.  A file's
licence words of the highest IDF are looked up (those as rare as the rarest word
of some mandatory phrase, so that no phrase goes unseen), each posting of each
of their places proposes an alignment of its template, and equal proposals of
several words are one.  An alignment counts only if the template's mandatory
key phrase stands complete there; its score is the share of the template's IDF
weight found at the right relative positions.

A file's text is cut into words once.  What is kept of it (and written to the
shared folder) are the distinct licence words, and the sequence of all words as
small numbers only where one of them is no function word.  Nothing is exploded
or shuffled but the vocabulary's counts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Words after lower-casing A-Z: digits, a-z and everything beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed values of the method, from the published licences: label -> (template, mandatory phrase within it).
TEMPLATES = {
    "gpl-3.0": ("licensed under the GNU General Public License version 3", "version 3"),
    "gpl-2.0": ("under the terms of the GNU General Public License version 2", "version 2"),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "as published by the free software foundation",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "gnu lesser general public license",
    ),
    "agpl-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    "apache-2.0": ("licensed under the Apache License version 2 0", "version 2 0"),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "except in compliance with the license",
    ),
    "cc-by-nc-4.0": ("licensed under CC BY NC 4 0", "by nc 4 0"),
    "cc-by-sa-4.0": ("licensed under CC BY SA 4 0", "by sa 4 0"),
    "mit-release": ("released under the MIT license", "mit license"),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted free of charge"),
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "to deal in the software without restriction",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "for any purpose with or without fee",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "bsd-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "must retain the above copyright notice",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software.",
        "will the authors be held liable",
    ),
    "mpl-2.0": ("subject to the terms of the Mozilla Public License v 2 0", "mozilla public license"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "unencumbered software"),
}
#: Words that no mandatory phrase consists of alone; a file with no other licence word matches nothing.
FUNCTION_WORDS = "a all and any are as at be by can do for from in is it may not of on or that the this to use will with you".split()
NEEDED = 0.75
#: A proposal is one number: an alignment's start (above -2**31) and its template.
SHIFT, SLOTS = 1 << 31, 1 << 10


def words_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def phrases() -> list[tuple[list[str], int, int]]:
    """(words, first and end of the mandatory ones) of the base phrases, all mandatory, then of the templates."""
    out = [(p.split(), 0, len(p.split())) for p in BASE]
    for text, must in TEMPLATES.values():
        ws, ms = words_of(text), must.split()
        at = next(j for j in range(len(ws)) if ws[j : j + len(ms)] == ms)
        out.append((ws, at, at + len(ms)))
    return out


def vocabulary() -> list[str]:
    return sorted({w for ws, _, _ in phrases() for w in ws})


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, terms, sequence): numbers from 1 for licence words, 0 for others; sequence only where needed."""
    vocab = vocabulary()
    number = F.create_map(*[F.lit(x) for k, w in enumerate(vocab) for x in (w, k + 1)])
    content = [k + 1 for k, w in enumerate(vocab) if w not in FUNCTION_WORDS]
    none = F.array().cast("array<int>")
    words = docs.select("doc_id", F.coalesce(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(LICENSE_WORD), F.lit(0)), F.array().cast("array<string>")).alias("__words"))
    own = words.select("doc_id", "__words", F.transform(F.array_intersect("__words", _literals(vocab)), lambda w: F.element_at(number, w)).alias("terms"))
    numbers = F.transform("__words", lambda w: F.when(w.isin(vocab), F.element_at(number, w)).otherwise(F.lit(0)))
    return own.select("doc_id", F.size("__words").cast("long").alias("n_words"), "terms", F.when(F.arrays_overlap("terms", _literals(content)), numbers).otherwise(none).alias("sequence"))


def frequencies(known: DataFrame) -> tuple[dict[int, int], int]:
    """Over all rows: in how many texts each licence word stands (a number for each), and rows."""
    found = known.select(F.explode("terms").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["w"]: r["n"] for r in found}, known.count()


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best share of a template's IDF weight found at the right
    relative positions, 1 where a base phrase stands.

    * null, empty or wordless text: 0 words, no labels, score 0.
    * a very long text is one sequence of numbers; proposals are as many as its rare licence words have postings.
    * of equally good alignments any counts; all places of base phrases count.
    * null doc_id stays null; repeated rows are repeated; no rows give no rows.
    * columns of ``docs`` other than doc_id and text are not looked at.
    """
    known = cut(facts(docs))
    freq, n = frequencies(known)
    number = {w: k + 1 for k, w in enumerate(vocabulary())}
    idf = {w: math.log((n + 1) / (freq.get(k, 0) + 0.5)) for w, k in number.items()}
    index = phrases()
    # as rare as the rarest word of some mandatory phrase: every phrase has such a word
    least = min(max(idf[w] for w in ws[a:b]) for ws, a, b in index)
    rare = sorted(number[w] for w in number if idf[w] >= least)
    postings = {k: [t - j * SLOTS for t, (ws, _, _) in enumerate(index) for j, w in enumerate(ws) if number[w] == k] for k in rare}
    table = F.create_map(*[x for k, v in postings.items() for x in (F.lit(k), _literals([F.lit(p).cast("long") for p in v]))])
    word = lambda j, w, must: F.struct(F.lit(j).alias("j"), F.lit(number[w]).alias("w"), F.lit(idf[w]).alias("idf"), F.lit(must).alias("must"))
    templates = F.array(*[F.array(*[word(j, w, a <= j < b) for j, w in enumerate(ws)]) for ws, a, b in index])
    totals = _literals([sum(idf[w] for w in ws) or 1.0 for ws, _, _ in index])

    places = F.filter(F.transform("sequence", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    proposed = F.transform(places, lambda i: F.transform(F.element_at(table, F.get("sequence", i)), lambda p: (i + F.lit(SHIFT)) * F.lit(SLOTS) + p))
    proposals = F.array_distinct(F.flatten(proposed))

    def judged(p):
        t, start = F.pmod(p, F.lit(SLOTS)).cast("int"), F.floor(p / F.lit(SLOTS)) - F.lit(SHIFT)
        at = lambda x: F.get("sequence", (start + x["j"]).cast("int")).eqNullSafe(x["w"])
        ws = F.get(templates, t)
        complete = F.forall(ws, lambda x: ~x["must"] | at(x))
        share = F.aggregate(ws, F.lit(0.0), lambda acc, x: acc + F.when(at(x), x["idf"]).otherwise(F.lit(0.0))) / F.get(totals, t)
        return F.struct(t.alias("t"), start.alias("start"), F.when(complete, share).otherwise(F.lit(0.0)).alias("share"), complete.alias("complete"))

    empty = F.array().cast("array<bigint>")
    some = known.select("doc_id", "n_words", "sequence", F.when(F.size("sequence") > 0, proposals).otherwise(empty).alias("proposals"))
    met = some.select("doc_id", "n_words", F.transform("proposals", judged).alias("m"))
    based = F.filter("m", lambda x: (x["t"] < len(BASE)) & x["complete"])
    other = F.filter("m", lambda x: (x["t"] >= len(BASE)) & x["complete"])
    met = met.select("doc_id", "n_words", based.alias("base"), other.alias("other"))
    names = _literals([*BASE.values(), *TEMPLATES])
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: F.get(names, x["t"])))), ",")
    enough = F.filter("other", lambda x: x["share"] >= NEEDED)
    starts = F.transform("base", lambda x: x["start"])
    return met.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        label("base").alias("base_labels"),
        label(F.concat("base", enough)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("other", lambda x: x["share"])), F.lit(0.0)))).alias("score"),
    )


def op8(spark, sf_dir):
    from .common import table

    return scan(table(spark, sf_dir, "documents"))
