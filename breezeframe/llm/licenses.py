"""Licence scan in DataFrame expressions only: a positional index of rare licence words.

Words are runs of digits, a-z and non-ASCII characters after A-Z are lower-cased. Templates
are short notices. How rare a licence word is comes from all documents: one pass counts in
how many of them each template word occurs. Every template is then indexed by its
``anchors`` rarest words and where they stand in it. A document's occurrences of anchor words
vote for ``(template, document position - template position)``; votes that agree put the
template at one place, and the rarity they add up to is their share of the anchors' total.
The place is then verified on the document's words: the mandatory phrase, which holds what
tells the notice from others (the version, the grant), must stand where the template has it,
up to ``SLACK`` words put in before it, and the score is the smaller of the anchors' share and
the share of all the notice's words that stand there. A template counts from ``LEAST`` on.

The index and the word counts have the size of the templates, so they are written into the
plan; a document is judged within its own row, with nothing shuffled but the word counts.

Defined results: null or empty text has no words, labels and score 0; repeated rows are
judged alike; on an empty table all words count as equally rare; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: base phrases and their labels
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_MIT = ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files {}to deal in the software without restriction")
_APACHE = ("licensed under the apache license version 2 0 {}you may not use this file except in compliance with the "
           "license")
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the "
_BY_FSF = "as published by the free software foundation"
_CC = "this work is licensed under a creative commons attribution {} license"


def _gpl(n: int) -> tuple:
    """The notices of one version of the GNU GPL: short, "or any later", and of that version only."""
    name = "gnu general public license"
    return tuple((f"gpl-{n}", before + phrase, phrase) for before, phrase in (
        ("this work is licensed under the ", f"{name} version {n}"),
        (_GPL, f"{name} {_BY_FSF} either version {n}"),
        (_GPL, f"{name} {_BY_FSF} version {n}"),
        (_GPL, f"{name} version {n} {_BY_FSF}"),
    ))


def _cc(label: str, kind: str) -> tuple:
    return tuple((label, _CC.format(kind + v), f"creative commons attribution {kind}{v.rsplit(' ', 1)[0]}")
                 for v in ("4 0 international", "3 0 unported"))


#: public licence notices, their label and the phrase that tells them from any other notice;
#: the words in brackets of the printed notices (the "Software", the "License") may be absent
TEMPLATES = (
    *[("mit", _MIT.format(x), "to deal in the software without restriction") for x in ("", "the software ")],
    *[("apache-2", _APACHE.format(x), "apache license version 2 0") for x in ("", "the license ")],
    *_gpl(3),
    *_gpl(2),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license v 2 0"),
    *_cc("cc-by", ""),
    *_cc("cc-by-nc", "noncommercial "),
    *_cc("cc-by-sa", "sharealike "),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
LEAST = 0.75
#: so many words may be put into a notice between its place and the phrase
SLACK = 6


def normal(text: Column) -> Column:
    """Words with one space before each, and one at the end; empty if there is no word."""
    text = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    padded = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.when(padded == " ", "").otherwise(padded)


def _count_words(spaced: Column) -> Column:
    n = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.greatest(n - 1, F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase begins."""
    size = len(phrase.split())
    pieces = F.split(words, f"(?<= ){phrase}(?= )")
    inner = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    walked = F.aggregate(
        inner,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, p: F.struct(
            (s["at"] + _count_words(p) + size).alias("at"),
            F.concat(s["found"], F.array(s["at"] + _count_words(p))).alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.when(F.contains(words, F.lit(f" {phrase} ")), walked).otherwise(F.array().cast("array<int>"))


def rarity(docs: DataFrame, templates=TEMPLATES, text_column: str = "text") -> dict[str, float]:
    """Inverse document frequency of every template word, over all documents."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    found = F.array_intersect(F.split(normal(F.col(text_column)), " "), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    total = docs.count()
    seen = {r["word"]: r["count"] for r in counts}
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 0.1 for w in vocabulary}


def index(idf: dict[str, float], templates=TEMPLATES, anchors: int = 6) -> list[list[tuple[str, int, float]]]:
    """Per template its rarest words: (word, position, rarity)."""
    out = []
    for _, text, _ in templates:
        placed = sorted(((-idf[w], i, w) for i, w in enumerate(text.split())))[:anchors]
        out.append([(w, i, -r) for r, i, w in placed])
    return out


def _stands_at(words: Column, place: Column, template: str, phrase: str) -> Column:
    """Share of the template's words around ``place`` (of its first word); 0 without the phrase."""
    all_words = template.split()
    before = len(f" {template} ".split(f" {phrase} ")[0].split())

    def part(first, last):
        start = F.greatest(place + first, F.lit(0))
        return F.slice(words, start + 1, F.greatest(place + last - start, F.lit(0)))

    held = F.array_join(part(before, before + len(phrase.split()) + SLACK), " ")
    there = F.contains(F.concat(F.lit(" "), held, F.lit(" ")), F.lit(f" {phrase} "))
    known = sorted(set(all_words))
    shared = F.array_intersect(part(0, len(all_words) + SLACK), F.array(*map(F.lit, known)))
    return F.when(there, F.size(shared) / F.lit(float(len(known)))).otherwise(0.0)


def _template_score(hits: Column, words: Column, postings: list[tuple[str, int, float]], template: str, phrase: str) -> Column:
    """Largest verified share of the anchors' rarity that falls on one relative position."""
    whole = sum(r for _, _, r in postings)
    post = F.array(*[
        F.struct(F.lit(w).alias("w"), F.lit(i).alias("i"), F.lit(r / whole).alias("r")) for w, i, r in postings
    ])
    votes = F.array_sort(F.flatten(F.transform(
        hits,
        lambda h: F.transform(
            F.filter(post, lambda p: p["w"] == h["w"]),
            lambda p: F.struct((h["i"] - p["i"]).alias("place"), p["r"].alias("r")),
        ),
    )))

    # equal places stand together after the sort: add them up in one pass, and look at the
    # words only where the sum would be the best so far
    def step(s, v):
        total = F.when(s["place"] == v["place"], s["sum"] + v["r"]).otherwise(v["r"])
        verified = F.least(total, _stands_at(words, v["place"], template, phrase))
        return F.struct(
            v["place"].alias("place"),
            total.alias("sum"),
            F.when(total > s["best"], F.greatest(s["best"], verified)).otherwise(s["best"]).alias("best"),
        )

    return F.aggregate(
        votes,
        F.struct(F.lit(None).cast("int").alias("place"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")),
        step,
        lambda s: s["best"],
    )


def scan(docs: DataFrame, idf: dict[str, float], templates=TEMPLATES, text_column: str = "text", keep=("doc_id",)) -> DataFrame:
    """Per row: base places, labels of base phrases and templates, and the best score."""
    postings = index(idf, templates)
    anchors = sorted({w for p in postings for w, _, _ in p})
    words = docs.select(*keep, normal(F.col(text_column)).alias("__words"))
    any_phrase = F.lit(False)
    for phrase in sorted({phrase for _, _, phrase in templates}):
        any_phrase = any_phrase | F.contains("__words", F.lit(f" {phrase} "))
    # element 1 of the split is the first word: the text begins with a space
    listed = F.slice(F.split("__words", " "), 2, F.length("__words"))
    found = words.select(
        *keep,
        "__words",
        F.array(*[_places(F.col("__words"), phrase) for phrase, _ in BASE]).alias("__places"),
        F.when(any_phrase, listed).otherwise(F.array().cast("array<string>")).alias("__list"),
    )
    numbered = F.transform("__list", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    found = found.withColumn("__hits", F.filter(numbered, lambda h: h["w"].isin(anchors)))
    scores = F.array(*[
        F.when((F.size("__hits") > 0) & F.contains("__words", F.lit(f" {phrase} ")),
               F.least(_template_score(F.col("__hits"), F.col("__list"), posting, text, phrase), F.lit(1.0))).otherwise(0.0)
        for (_, text, phrase), posting in zip(templates, postings, strict=True)
    ])
    found = found.select(*keep, _count_words(F.col("__words")).alias("__n"), "__places", scores.alias("__scores"))
    places = F.flatten("__places")
    base = F.array(*[F.when(F.size(F.col("__places")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)])
    more = F.array(*[F.when(F.col("__scores")[i] >= LEAST, F.lit(label)) for i, (label, _, _) in enumerate(templates)])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    return found.select(
        *keep,
        F.col("__n").cast("bigint").alias("n_words"),
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.array_max("__scores")).alias("score"),
    )
