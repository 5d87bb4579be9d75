"""Licence scan by a positional index of rare licence words.

Every template is a short notice with its key phrases. The index files each template word with the
places where it stands, for its rarest words (highest inverse document frequency over the whole
corpus). A text looks up every filed word; each lookup votes for the place where the template would start,
and starts with votes of enough different words are laid beside the text: the share of equal words
is the score, and every key phrase must be there. Only DataFrame functions are used, and all of it
happens within the row, so no text is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words_of


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    phrases: tuple[str, ...]


# Usual notices of public licences and the phrases that make them out.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this program is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution", "international license")),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def document_frequencies(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[str, int]:
    """Documents that hold each template word, over all documents; under "" their number.

    Counts are summed in the tasks; a row per template word comes back, whatever the input's size.
    """
    vocabulary = sorted({w for t in templates for w in t.notice.split()})
    words = words_of(F.col(text))
    counts = docs.select(
        F.explode(F.array_append(F.array_intersect(words, F.lit(vocabulary)), F.lit(""))).alias("word")
    ).groupBy("word")
    return {r["word"]: r["n"] for r in counts.agg(F.count("*").alias("n")).collect()}


def _starts(words: Column, phrase: list[str]) -> Column:
    """Places in ``words`` where the words of the phrase stand one after another."""

    def fits(word, i):
        here = word == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            here = here & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(here, i)

    return F.filter(F.transform(words, fits), lambda i: i.isNotNull())


def scan_licenses(
    docs: DataFrame,
    frequencies: dict[str, int],
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates=TEMPLATES,
    words_per_template: int = 4,
    min_votes: int = 2,
    min_score: float = 0.8,
) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    ``found`` lists the laid-out templates: label, start, score. Base places come from ``phrases``.
    ``score`` is the best template's, 0 if none was laid out. The index files each template under
    its ``words_per_template`` rarest words, or more where ``min_votes`` of these could differ from a
    span that reaches ``min_score``. A text looks up all filed words that it has; every place of
    each counts. So no span that reaches the score is missed.

    Null and empty texts have no words and no labels. Rows are scanned each by itself, so repeated
    rows and keys, null keys and other columns change nothing.
    """
    total = max(frequencies.get("", 0), 1)

    def rarity(word: str) -> tuple[float, str]:
        return -math.log((1 + total) / (1 + frequencies.get(word, 0))), word

    def n_filed(n: int) -> int:
        # Of so many words at least min_votes stand in their places when min_score of all do.
        least_same = next(i for i in range(n + 1) if i / n >= min_score)
        return max(words_per_template, n - least_same + min_votes)

    notice_words = [t.notice.split() for t in templates]
    filed = [sorted(set(words), key=rarity)[: n_filed(len(words))] for words in notice_words]
    ranked = sorted({w for words in filed for w in words}, key=rarity)
    looked_up = ranked + sorted({w for p in phrases for w in p.split()} - set(ranked))
    index = F.create_map(
        *[
            x
            for w in ranked
            for x in (
                F.lit(w),
                F.array(
                    *[
                        F.struct(F.lit(n).alias("template"), F.lit(i).alias("at"))
                        for n, t in enumerate(templates)
                        for i, v in enumerate(t.notice.split())
                        if v == w and w in filed[n]
                    ]
                ),
            )
        ]
    )
    notices = F.array(*[F.array(*[F.lit(w) for w in t.notice.split()]) for t in templates])
    demanded = F.array(*[F.array(*[F.lit(p) for p in t.phrases]) for t in templates])
    names = F.array(*[F.lit(t.label) for t in templates])

    rows = docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    # Licence words of the text.
    rows = rows.withColumn("own", F.array_intersect(F.lit(looked_up), "words"))
    places = {p: _starts(F.col("words"), p.split()) for p in phrases}
    none = F.array().cast("array<int>")
    for n, (phrase, at) in enumerate(places.items()):
        has_all = F.lit(True)
        for w in phrase.split():
            has_all = has_all & F.array_contains("own", w)
        rows = rows.withColumn(f"base{n}", F.when(has_all, at).otherwise(none))
    base = [F.col(f"base{n}") for n in range(len(places))]

    rows = rows.withColumn("rare", F.array_intersect("own", F.lit(ranked)))
    lookups = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))),
        lambda x: F.array_contains("rare", x["word"]),
    )
    votes = F.flatten(
        F.transform(
            lookups,
            lambda x: F.transform(
                index[x["word"]],
                lambda p: F.struct(p["template"].alias("template"), (x["i"] - p["at"]).alias("start"), x["word"].alias("word")),
            ),
        )
    )
    rows = rows.withColumn("votes", F.when(F.size("rare") >= min_votes, F.array_distinct(votes)))
    # Sorted votes: a start has votes of min_votes words if the vote that many places on is its own.
    rows = rows.withColumn("votes", F.array_sort("votes"))

    def enough(vote, i):
        far = F.get(F.col("votes"), i + (min_votes - 1))
        return (far["template"] == vote["template"]) & (far["start"] == vote["start"])

    seats = F.array_distinct(
        F.transform(F.filter("votes", enough), lambda v: F.struct(v["template"].alias("template"), v["start"].alias("start")))
    )
    laid = F.transform(
        seats,
        lambda s: F.struct(
            s["template"].alias("template"),
            s["start"].alias("start"),
            F.slice(F.col("words"), F.greatest(s["start"], F.lit(0)) + 1, F.size(notices[s["template"]])).alias("span"),
            F.size(
                F.filter(
                    notices[s["template"]],
                    lambda w, j: F.coalesce(F.get(F.col("words"), s["start"] + j) == w, F.lit(False)),
                )
            ).alias("same"),
        ),
    )
    found = F.filter(
        F.transform(
            laid,
            lambda s: F.struct(
                names[s["template"]].alias("label"),
                s["start"].alias("start"),
                (s["same"] / F.size(notices[s["template"]])).alias("score"),
                F.forall(
                    demanded[s["template"]],
                    lambda p: F.concat(F.lit(" "), F.array_join(s["span"], " "), F.lit(" ")).contains(
                        F.concat(F.lit(" "), p, F.lit(" "))
                    ),
                ).alias("has_phrases"),
            ),
        ),
        lambda s: s["has_phrases"] & (s["score"] >= min_score),
    )
    rows = rows.withColumn("found", F.coalesce(found, F.array().cast("array<struct<label:string,start:int,score:double,has_phrases:boolean>>")))
    all_base = F.concat(*base)
    base_labels = F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, label in zip(base, phrases.values())]))
    own_labels = F.transform("found", lambda f: f["label"])
    return rows.select(
        F.col("key").alias(key),
        F.size("words").cast("long").alias("n_words"),
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).cast("long").alias("first_word"),
        F.array_max(all_base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own_labels))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
        F.transform("found", lambda f: F.struct(f["label"].alias("label"), f["start"].alias("start"), f["score"].alias("score"))).alias("found"),
    )
