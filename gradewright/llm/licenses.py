"""License scans by a positional index of rare words. Only DataFrame functions.

Every template holds a mandatory key phrase. The index lists, for the rarest
words of each key phrase by the corpus's own document frequencies, the template
and the word's place in it. A text's words are looked up; postings that agree on
the same start are intersected; a start at which they agree is a candidate, and
the key phrase is then compared word for word. Since the looked-up words are
part of the mandatory phrase, no occurrence is lost, whichever words are rarest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import col, free_names, stage, without

#: Words as they are once A-Z is lower case; upper case is kept here and folded per looked-up word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
VOTERS = 3  # looked-up words per key phrase, two of which have to agree


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str  # mandatory, word for word
    rest: str = ""  # what follows in the full notice; it only raises the score
    base: bool = False

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def words(self) -> list[str]:
        return self.key + self.rest.split()


# The base phrases of the contract, then wordings of public licenses.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             "of this software and associated documentation files the software to deal in the software without restriction"),
    Template("gpl", "gnu general public license"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "with or without fee is hereby granted provided that the above copyright notice"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("epl", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
    Template("apache-2", "licensed under the apache license version 2 0",
             "the license you may not use this file except in compliance with the license"),
)


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and in how many of them each license word occurs.

    The result has one row per word of the fixed vocabulary, whatever the corpus.
    """
    found = F.array_distinct(F.filter(F.transform(col("words"), F.lower), lambda w: w.isin(*vocabulary)))
    counted = words.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counted.collect()}
    return df.pop("", 0), df


def rare_places(template: Template, texts: int, df: dict[str, int]) -> list[int]:
    """Places of the key phrase's highest-IDF words; ties to the earlier place."""
    idf = [math.log((texts + 1) / (df.get(w, 0) + 1)) for w in template.key]
    return sorted(sorted(range(len(idf)), key=lambda i: (-idf[i], i))[:VOTERS])


def _votes(words: Column, places: list[list[int]]) -> Column:
    """Sorted array of (template, start) named by each looked-up word."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(TEMPLATES):
        for i in places[t]:
            postings.setdefault(template.key[i], []).append((t, i))

    def look_up(word: Column, at: Column) -> Column:
        folded, made = F.lower(word), None
        for w, found in sorted(postings.items()):
            arrays = F.array(*[F.struct(F.lit(t).alias("t"), (at - i).alias("at")) for t, i in found])
            made = F.when(folded == w, arrays) if made is None else made.when(folded == w, arrays)
        return F.when(folded.isin(*postings), made)

    return F.array_sort(F.flatten(F.array_compact(F.transform(words, look_up))))


def _aligned(words: Column, template: Template, at: Column) -> Column:
    """How many words of the template stand at their places from `at` on."""
    wanted = F.array(*[F.lit(w) for w in template.words])
    there = F.transform(F.slice(words, at + 1, F.lit(len(template.words))), F.lower)
    return F.aggregate(
        F.zip_with(there, wanted, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x
    )


def _verified(words: Column, at: Column, template: Template) -> Column:
    """Share of the template found at `at`; NULL unless its key phrase is whole."""
    key = F.array(*[F.lit(w) for w in template.key])
    whole = F.transform(F.slice(words, at + 1, F.lit(len(template.key))), F.lower) == key
    return F.when(whole, _aligned(words, template, at) / F.lit(float(len(template.words))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labels and places of licenses in every text.

    Adds n_words, n_base, first_word, last_word, base_labels, labels, score and
    `matches` (array of label, at, base, share). NULL and empty texts: 0 words,
    0 places, NULL places, empty label strings, score 0. Repeated rows and texts
    are judged alike. Input columns called like an added one give way.

    Labels name every license whose key phrase occurs; the score is the largest
    share of a full template found word for word around a key phrase.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    docs = without(docs, *added)
    words, votes, starts = free_names(docs, "_words", "_votes", "_starts")
    whole = F.coalesce(col(text), F.lit(""))
    vocabulary = sorted({w for t in TEMPLATES for w in t.key})
    texts, df = document_frequencies(docs.select(F.regexp_extract_all(whole, F.lit(WORD), 0).alias("words")), vocabulary)
    places = [rare_places(t, texts, df) for t in TEMPLATES]

    out = stage(docs, **{words: F.regexp_extract_all(whole, F.lit(WORD), 0)})
    out = stage(out, **{votes: _votes(col(words), places)})
    # Postings meet where two neighbours of the sorted votes are equal.
    agreed = F.zip_with(
        col(votes), F.slice(col(votes), 2, F.size(col(votes))), lambda a, b: F.when((a == b) & (a["at"] >= 0), a)
    )
    out = stage(out, **{starts: F.when(F.size(col(votes)) > 1, F.array_distinct(F.array_compact(agreed)))})

    def check(x: Column) -> Column:
        share = None
        for t, template in enumerate(TEMPLATES):
            made = _verified(col(words), x["at"], template)
            share = F.when(x["t"] == t, made) if share is None else share.when(x["t"] == t, made)
        label = F.element_at(F.array(*[F.lit(t.label) for t in TEMPLATES]), x["t"] + 1)
        base = F.element_at(F.array(*[F.lit(t.base) for t in TEMPLATES]), x["t"] + 1)
        return F.struct(label.alias("label"), x["at"].cast("long").alias("at"), base.alias("base"), share.alias("share"))

    checked = F.filter(F.transform(F.coalesce(col(starts), F.array()), check), lambda m: m["share"].isNotNull())
    out = stage(out, **{"matches": checked, "n_words": F.size(col(words)).cast("long")})
    base = F.filter(col("matches"), lambda m: m["base"])
    at = F.transform(base, lambda m: m["at"])

    def listed(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return out.select(
        *[col(c) for c in docs.columns],
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(col("matches")).alias("labels"),
        F.coalesce(F.round(F.array_max(F.transform(col("matches"), lambda m: m["share"])), 6), F.lit(0.0)).alias("score"),
        "matches",
    )
