"""License scans through a positional rare-token index (DataFrame functions only).

Templates are short statements that license texts and notices hold. For each word of the templates the corpus is asked in how
many documents it stands; each template is indexed by its rarest words (the highest inverse document frequency), with their
positions. Documents that hold such words look them up; postings are intersected by relative position (document position less
template position), so that words of a template count only where they stand as far apart as in it. A template is found where
enough of its rare words agree and its mandatory key phrase stands in the document.

Fixed phrases ("base") are places where their words stand consecutively; they are found in each row, without a shuffle.

Defined cases: null texts are empty and have no word; a null id is kept; rows that repeat get the same result; texts of any
length are read whole; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: What parts words, once A-Z is in lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str


#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Statements, in words as the scan takes them, and the phrase that must stand in a document.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("cc-by", "licensed under cc by 4 0", "cc by"),
    Template("cc-by", "creative commons attribution 4 0 international license", "commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)


def cleaned(text: Column) -> Column:
    """The words of a text, A-Z in lower case, each pair parted by one space."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.trim(F.regexp_replace(low, BREAKS, " "))


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" ")))).cast("long")


def phrase_places(padded: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(number of places, first, last start) of a phrase among the words of a text, padded by a space on both sides."""
    parts = F.when(F.contains(padded, F.lit(f" {phrase} ")), F.split(padded, f"(?<= ){phrase}(?= )", -1))
    places = F.coalesce(F.size(parts) - 1, F.lit(0)).cast("long")
    places = F.when(parts.isNotNull(), places).otherwise(0).cast("long")
    first = _spaces(F.element_at(parts, 1)) - 1
    last = n_words - (_spaces(F.element_at(parts, -1)) - 1) - len(phrase.split())
    return places, first, last


def rare_words(seen: DataFrame, templates: tuple[Template, ...], per: int) -> dict[int, list[tuple[str, int]]]:
    """For each template its ``per`` rarest words with their positions. ``seen``: (seen: array of a document's template words).

    What comes to the driver is one count for each word of the templates, a fixed number.
    """
    counts = {r.word: r.n for r in seen.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    out = {}
    for i, t in enumerate(templates):
        places: dict[str, int] = {}
        for at, word in enumerate(t.text.split()):
            places.setdefault(word, at)
        out[i] = sorted(places.items(), key=lambda x: (counts.get(x[0], 0), -len(x[0]), x[0]))[:per]
    return out


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: dict[str, str] | None = None,
    per: int = 4,
    agree: float = 0.75,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document; labels as sorted arrays."""
    phrases = PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), cleaned(F.col(text_col)).alias("words"))
    padded = F.concat(F.lit(" "), "words", F.lit(" "))
    n_words = F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long")
    counted = rows.select("doc_id", "key", "words", padded.alias("padded"), n_words.alias("n_words"))
    found = {p: phrase_places(F.col("padded"), F.col("n_words"), p) for p in phrases}
    slim = counted.select(
        "doc_id",
        "key",
        "n_words",
        F.array_intersect(F.split("words", " "), F.array(*map(F.lit, vocabulary))).alias("seen"),
        *[F.struct(n.alias("n"), a.alias("first"), z.alias("last")).alias(f"p{i}") for i, (n, a, z) in enumerate(found.values())],
    )
    slim = materialise(slim, "license-rows")
    index = rare_words(slim, templates, per)
    rare = sorted({w for words in index.values() for w, _ in words})
    postings = [(w, i, at, len(words)) for i, words in index.items() for w, at in words]
    postings = spark.createDataFrame(postings, "word string, template int, at int, indexed int")
    # documents with a rare word look it up, whole; keys of rows that repeat meet here
    asked = rows.where(F.arrays_overlap(F.split("words", " "), F.array(*map(F.lit, rare))))
    padded = F.concat(F.lit(" "), "words", F.lit(" "))
    stands = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {t.phrase} ")), F.lit(i)) for i, t in enumerate(templates)]))
    asked = asked.select("key", stands.alias("stands"), F.split("words", " ").alias("words"))  # before the words part, not once for each
    hits = asked.select("key", "stands", F.posexplode("words").alias("pos", "word")).join(F.broadcast(postings), "word")
    votes = hits.groupBy("key", "template", (F.col("pos") - F.col("at")).alias("shift")).agg(
        F.count_distinct("at").alias("votes"), F.first("indexed").alias("indexed"), F.first(F.array_contains("stands", F.col("template"))).alias("stands")
    )
    named = F.array(*[F.lit(t.label) for t in templates])
    passed = votes.where(F.col("stands") & (F.col("votes") >= F.ceil(F.col("indexed") * agree)))
    passed = passed.groupBy("key").agg(
        F.collect_set(F.element_at(named, F.col("template") + 1)).alias("more"), F.max(F.col("votes") / F.col("indexed")).alias("best")
    )
    n = range(len(phrases))
    total = sum((F.col(f"p{i}.n") for i in n), F.lit(0)).cast("long")
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"p{i}.n") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))))
    every = F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>"))))
    return slim.join(passed, "key", "left").select(
        "doc_id",
        "n_words",
        total.alias("n_base"),
        F.array_min(F.array(*[F.col(f"p{i}.first") for i in n])).alias("first_word"),
        F.array_max(F.array(*[F.col(f"p{i}.last") for i in n])).alias("last_word"),
        labels.alias("base_labels"),
        every.alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(total > 0, 0.75).otherwise(0.0)).alias("score"),
    )
