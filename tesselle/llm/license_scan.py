"""Licence scans by a positional index of rare words.

A template is the words of a licence notice. Over all files, the inverse document frequency of every
template word is counted; each template is indexed under its rarest words, with their places. A file's
indexed words each point to templates and to the place where the template would start; a start that enough rare
words agree on is a candidate. It counts where the template's mandatory phrases stand at their relative places.
Everything is arrays of one row: no shuffle but the word counts, and no group a common word could swell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: digits, a-z after folding A-Z, and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template that it is indexed under.
RARE = 6
#: Share of those that must agree on a start.
AGREE = 0.6


@dataclass(frozen=True)
class Template:
    """Words of a notice, its label, and the mandatory phrases as [from, to) places in the words."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, int], ...]
    base: bool = False


def _template(label: str, text: str, *phrases: str, base: bool = False) -> Template:
    words = tuple(text.split())
    places = []
    for phrase in phrases or (text,):
        sought = tuple(phrase.split())
        at = next(i for i in range(len(words)) if words[i : i + len(sought)] == sought)
        places.append((at, at + len(sought)))
    return Template(label, words, tuple(places), base)


#: Phrases whose every place counts.
BASE = (
    _template("mit", "mit license", base=True),
    _template("apache", "apache license", base=True),
    _template("gpl", "general public license", base=True),
)
#: Sentences of public licence texts, with the phrases that must be there.
NOTICES = (
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    _template("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    _template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    _template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    _template("lgpl", "gnu lesser general public license", "lesser general public license"),
    _template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    _template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    _template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)


def file_words(text: Column) -> Column:
    """The words of a whole text; null has none. Only A-Z fold to ASCII: the Kelvin sign, whose lower case is k, is kept apart."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), F.lit(WORD), 0)


def rarest(templates: Sequence[Template], frequency: dict[str, int], rare: int = RARE) -> list[dict[str, list[int]]]:
    """For each template its rarest words, the fewest files first and then by spelling, with their places in it."""
    chosen = []
    for t in templates:
        own = sorted(set(t.words), key=lambda w: (frequency.get(w, 0), w))[:rare]
        chosen.append({w: [i for i, x in enumerate(t.words) if x == w] for w in own})
    return chosen


def document_frequency(docs: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """In how many of all files each template word stands: at most one row a word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.select(F.explode(F.array_distinct(F.filter(file_words(F.col("text")), lambda w: w.isin(vocabulary)))).alias("word"))
    return {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, rare: int = RARE, agree: float = AGREE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices for each row of ``docs``.

    Nulls and empty texts have no words, labels '' and score 0; repeated rows are scanned each; of ties nothing
    is dropped, as every place counts; an empty table gives no rows. score is the largest share of a template's
    rare words that agree on one verified start (1 for a base phrase).
    """
    index = rarest(templates, document_frequency(docs, templates), rare)
    by_word: dict[str, list[tuple[int, int]]] = {}
    for number, postings in enumerate(index):
        for word, places in postings.items():
            by_word.setdefault(word, []).extend((number, p) for p in places)
    vocabulary = sorted(by_word)
    struct = "array<struct<t:int,p:int>>"
    postings = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in by_word[w]]).cast(struct))])
    least = F.array(*[F.lit(ceil(agree * sum(map(len, x.values()))) if not t.base else sum(map(len, x.values()))) for t, x in zip(templates, index, strict=True)])
    whole = F.array(*[F.lit(sum(map(len, x.values()))) for x in index])
    phrase_type = "array<array<struct<o:int,w:array<string>>>>"
    phrases = F.array(*[F.array(*[F.struct(F.lit(a).alias("o"), F.array(*map(F.lit, t.words[a:b])).alias("w")) for a, b in t.phrases]) for t in templates]).cast(phrase_type)
    base = F.array(*[F.lit(t.base) for t in templates])
    label = F.array(*[F.lit(t.label) for t in templates])

    rows = docs.select("doc_id", file_words(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    # places of indexed words; most files have none, and go no further
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    rows = rows.withColumn("places", F.when(F.arrays_overlap(F.col("words"), F.array(*map(F.lit, vocabulary))), places).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    pointed = F.flatten(F.transform("places", lambda x: F.transform(F.element_at(postings, x["w"]), lambda y: F.struct(y["t"].alias("t"), (x["i"] - y["p"]).alias("s")))))
    # equal starts stand together once sorted; a run's length is how many rare words agree
    rows = rows.withColumn("starts", F.array_sort(pointed))
    number = F.transform("starts", lambda x, i: F.struct(x["t"].alias("t"), x["s"].alias("s"), i.alias("i")))
    rows = rows.withColumn("first", F.filter(number, lambda x: (x["i"] == 0) | (F.get(F.col("starts"), x["i"] - 1) != F.struct(x["t"], x["s"]))))
    counted = F.transform("first", lambda x, k: F.struct(x["t"].alias("t"), x["s"].alias("s"), (F.coalesce(F.get(F.col("first"), k + 1)["i"], F.size("starts")) - x["i"]).alias("n")))
    verified = F.filter(
        counted,
        lambda c: (c["s"] >= 0) & (c["n"] >= F.get(least, c["t"])) & F.forall(F.get(phrases, c["t"]), lambda p: F.slice(F.col("words"), c["s"] + p["o"] + 1, F.size(p["w"])) == p["w"]),
    )
    rows = rows.withColumn("found", F.when(F.size("places") > 0, verified).otherwise(F.array().cast("array<struct<t:int,s:int,n:int>>")))
    rows = rows.withColumn("in_base", F.filter("found", lambda c: F.get(base, c["t"])))
    named = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda c: F.get(label, c["t"])))), ",")
    starts = F.transform("in_base", lambda c: c["s"].cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("in_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named("in_base").alias("base_labels"),
        named("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda c: c["n"] / F.get(whole, c["t"]))), F.lit(0.0)).alias("score"),
        (F.size("found") - F.size("in_base")).cast("long").alias("n_notices"),
    )
