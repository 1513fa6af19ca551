"""Licence scans by a positional index of rare words; native expressions only.

Every template names key phrases that must stand in a file word for word. The index maps the highest-IDF word of each key phrase,
by document frequencies over all files, to the phrase's postings: templates and the places of the word in them. A file's
rare licence words are looked up, each posting is verified against the words around it, and the postings of a template are intersected by
relative position: all its key phrases have to imply about the same start. Since a phrase cannot stand without
its rarest word, nothing is lost by looking up that word alone.
"""

from __future__ import annotations

import math
import re
import string
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.joins import with_computed

#: Words of a text whose letters A-Z are lower-cased: ASCII letters and digits, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.6


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# Phrases and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices of public licences; the key phrases are words of the text.
TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "sublicense and or sell copies"),
    ),
    Template(
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        ("gnu general public license as published", "either version 2 of the license"),
    ),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu general public license as published", "either version 3 of the license"),
    ),
    Template("gpl-3", "GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template(
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse",
        ("redistribution and use in source and binary forms", "nor the names of its contributors"),
    ),
    Template(
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS",
        ("redistribution and use in source and binary forms", "provided with the distribution this software is provided by"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies",
        ("distribute this software for any purpose with or without fee", "permission notice appear in all copies"),
    ),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
)


def words_of(text: str) -> list[str]:
    """The words of a template, by the rule for files."""
    return re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def word_column(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


class Key(NamedTuple):
    """A phrase with its owner: a plain phrase (``template`` -1), or the ``number``-th key of a template at ``offset`` in it."""

    label: str
    words: list[str]
    template: int
    number: int
    offset: int


def keys_of(phrases, templates: tuple[Template, ...]) -> list[Key]:
    keys = [Key(label, words_of(p), -1, n, 0) for n, (label, p) in enumerate(phrases)]
    for t, template in enumerate(templates):
        own = words_of(template.text)
        for n, phrase in enumerate(template.keys):
            words = words_of(phrase)
            at = next(k for k in range(len(own)) if own[k : k + len(words)] == words)
            keys.append(Key(template.label, words, t, n, at))
    return keys


def slack(words: list[str]) -> int:
    """How far key phrases may stand from their places in the template."""
    return max(8, len(words) // 4)


def document_frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """The number of files, and that of the files with each word of the catalogue (as many rows as it has words, at most)."""
    own = F.array_distinct(F.filter(word_column("text"), lambda w: w.isin(sorted(vocabulary))))
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return found.pop("", 0), found


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, phrases=PHRASES, templates: tuple[Template, ...] = TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``doc_id, n_words, phrases, templates`` for every row of ``docs`` (``doc_id, text``).

    ``phrases``: ``(label, word)``, every place where a phrase's words stand consecutively, words counted from 0. ``templates``:
    ``(label, first, end, share)``, the windows of words ``first`` to ``end`` (exclusive) that hold all key phrases of a
    template about where it has them, and at least ``least_share`` of its distinct words by IDF weight; ``share``
    is that part. Windows of one place overlap, and one is given for each.

    Null texts are empty and have no words; repeated rows get a row each; other columns are ignored; an empty table gives no
    rows. A text is worked through in its own row, whatever its length: nothing is shuffled but the catalogue's
    document frequencies.
    """
    keys = keys_of(phrases, templates)
    bodies = [words_of(t.text) for t in templates]
    vocabulary = {w for k in keys for w in k.words} | {w for b in bodies for w in b}
    n_docs, found = document_frequencies(docs, vocabulary)
    idf = {w: math.log((n_docs + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}
    # the rarest word of each phrase; the first of equally rare ones
    rare = [max(range(len(k.words)), key=lambda i, k=k: (idf[k.words[i]], -i)) for k in keys]
    index = F.array(
        *[
            F.struct(F.lit(n).alias("key"), F.lit(k.words[r]).alias("word"), F.lit(r).alias("at"), texts(k.words).alias("words"), F.lit(len(k.words)).alias("size"))
            for n, (k, r) in enumerate(zip(keys, rare))
        ]
    )
    looked_up = sorted({k.words[r] for k, r in zip(keys, rare)})
    words = F.col("words")
    rows = with_computed(docs.select("doc_id", "text"), words=word_column("text")).drop("text")
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(looked_up), i)))
    rows = with_computed(rows, hits=hits)

    def verified(p: Column) -> Column:
        def stands(c: Column) -> Column:
            start = p - c["at"]
            inside = (c["word"] == words[p]) & (start >= 0) & (start + c["size"] <= F.size("words"))
            return inside & (F.slice("words", F.greatest(start, F.lit(0)) + 1, c["size"]) == c["words"])

        return F.transform(F.filter(index, stands), lambda c: F.struct(c["key"].alias("key"), (p - c["at"]).alias("start")))

    rows = with_computed(rows, places=F.flatten(F.transform("hits", verified))).drop("hits")

    def windows(t: int) -> Column:
        """All windows of a template; a window begins at a multiple of the slack and leaves room for twice as much."""
        body, room = bodies[t], slack(bodies[t])

        def begins(n: int) -> Column:
            own = F.filter("places", lambda p: p["key"] == n)
            step = F.transform(own, lambda p: F.floor((p["start"] - keys[n].offset) / F.lit(room)))
            return F.array_union(step, F.transform(step, lambda b: b - 1))

        common = reduce(F.array_intersect, [begins(n) for n, key in enumerate(keys) if key.template == t])
        distinct = sorted(set(body))
        weights = F.create_map(*[F.lit(x) for w in distinct for x in (w, idf[w])])
        total = sum(idf[w] for w in distinct)

        def window(b: Column) -> Column:
            first = F.greatest(b * room, F.lit(0)).cast("int")
            end = F.least(b * room + 2 * room + len(body), F.size("words")).cast("int")
            seen = F.array_intersect(F.slice("words", first + 1, F.greatest(end - first, F.lit(0))), texts(distinct))
            share = F.aggregate(seen, F.lit(0.0), lambda acc, w: acc + weights[w]) / F.lit(total)
            return F.struct(F.lit(templates[t].label).alias("label"), first.alias("first"), end.alias("end"), F.least(share, F.lit(1.0)).alias("share"))

        return F.transform(F.sort_array(common), window)

    plain = [n for n, k in enumerate(keys) if k.template < 0]
    labels = F.create_map(*[F.lit(x) for n in plain for x in (n, keys[n].label)])
    own = F.filter("places", lambda p: p["key"].isin(plain))
    own = F.transform(own, lambda p: F.struct(labels[p["key"]].alias("label"), p["start"].alias("word")))
    seen = F.filter(F.concat(*[windows(t) for t in range(len(templates))]), lambda w: w["share"] >= least_share)
    some = F.size("places") > 0
    none = F.array()
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(some, own).otherwise(none.cast("array<struct<label:string,word:int>>")).alias("phrases"),
        F.when(some, seen).otherwise(none.cast("array<struct<label:string,first:int,end:int,share:double>>")).alias("templates"),
    )
