"""License scans: an exact set-similarity join of text blocks with templates.

Only DataFrame functions are used.  The tokens are pairs of adjacent words, so
that a block has to keep a template's wording and not just its words.  Template
pairs are ordered by how many documents of the corpus hold them, rarest first;
pairs that no template has cannot match and drop out.  A block is 64 pairs of
the whole text, across its lines, one block every 32, so that a notice of up to
32 pairs is whole in one.  It matches a template of n pairs when it has at least
``o = ceil(threshold * n)`` of them, hence

* prefix: it has one of the template's ``n - o + 1`` rarest pairs,
* length: it has ``o`` different pairs at least,
* position: from its first prefix pair on, at least ``o`` of its template pairs
  are left in the global order,

and what passes is verified by the intersection itself.  The template side has a
fixed size and stands in the plan as constants; a document's blocks are arrays
of its own row.  So one count of template pairs is all that is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word rule, base phrases and their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Template texts and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
]
THRESHOLD = 0.8
BLOCK_PAIRS = 64  # longer texts are read as blocks of 64 pairs, one every 32


def normalised(text: Column) -> Column:
    """Words in lower case with one space between them."""
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def template_sets(templates=TEMPLATES) -> list[tuple[list[str], str]]:
    return [(list(dict.fromkeys(pairs_of(text.split()))), label) for text, label in templates]


def adjacent(words: Column) -> Column:
    """Pairs of adjacent words."""
    rest = F.size(words) - 1
    both = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(rest > 0, both).otherwise(F.array().cast("array<string>"))


def constants(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def telling(pairs: list[str]) -> Column:
    """The longer word of each pair: a text without any of them has none of the pairs."""
    return constants(sorted({min(p.split(), key=lambda w: (-len(w), w)) for p in pairs}))


def pairs_if(pairs: list[str]) -> Column:
    """The pairs of a row's ``words``; none where none of ``pairs`` can be among them."""
    possible = F.arrays_overlap(F.col("words"), telling(pairs))
    return F.when(possible, adjacent(F.col("words"))).otherwise(F.array().cast("array<string>"))


def global_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first, by the number of rows whose ``words`` hold
    a pair; ties by the pair.  One row per template pair comes to the driver."""
    held = F.explode(F.array_intersect(pairs_if(vocabulary), constants(vocabulary))).alias("pair")
    counts = {r["pair"]: r["count"] for r in rows.select(held).groupBy("pair").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def overlap(block: Column, words: list[str], order: list[str], threshold: float) -> Column:
    """Shared pairs of a block and a template, 0 where a filter rules out a match."""
    ranked = [w for w in order if w in set(words)]
    least = math.ceil(threshold * len(ranked) - 1e-9)
    prefix = ranked[: len(ranked) - least + 1]
    mine = F.array_intersect(constants(order), block)  # in global order
    first = F.get(F.array_intersect(constants(prefix), block), F.lit(0))
    left = F.size(mine) - F.array_position(mine, first).cast("int") + 1
    shared = F.size(F.array_intersect(constants(ranked), block))
    return F.when(
        (F.size(block) >= least) & F.arrays_overlap(constants(prefix), block) & (left >= least)
        & (shared >= least), shared).otherwise(0)


def windows(pairs: Column, size: int) -> Column:
    """The pairs as one array; more than ``size`` in overlapping pieces, one every half."""
    step = size // 2
    return F.when(F.size(pairs) <= size, F.array(pairs)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(pairs) - step, F.lit(1)), F.lit(step)),
                    lambda at: F.slice(pairs, at, size)))


def places(words: Column, phrase: str) -> Column:
    """Starts of a phrase of two or three words, from 0."""
    n = len(phrase.split())
    rest = lambda k: F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1)))
    runs = words
    for k in range(1, n):
        runs = F.zip_with(runs, rest(k), lambda a, b: F.concat_ws(" ", a, b))
    marked = F.transform(runs, lambda x, i: F.when(x == phrase, i))
    return F.filter(marked, lambda i: i.isNotNull())


def scan(
    docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """One row per document: n_words, places of the base phrases (n_base,
    first_word, last_word), base_labels, labels (base and template labels) and
    score, the largest containment that met the threshold, 1 with a base phrase,
    else 0.

    Null and empty texts have no words, places or labels.  Repeated rows are
    scanned one by one; null ids stay; further columns are dropped."""
    sets = template_sets(templates)
    vocabulary = sorted({w for words, _ in sets for w in words})
    lowered = docs.select(
        "doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("lowered"))
    normal = lowered.withColumn("normal", normalised(F.col("lowered")))
    worded = normal.withColumn("words", F.split("normal", " "))
    order = global_order(worded, vocabulary)
    prefixes = sorted({
        w for words, _ in sets
        for w in [x for x in order if x in set(words)][
            : len(words) - math.ceil(threshold * len(words) - 1e-9) + 1]})
    # only texts that may have a prefix pair are cut into pairs
    worded = worded.withColumn("pairs", pairs_if(prefixes))
    padded = F.concat(F.lit(" "), F.col("normal"), F.lit(" "))
    none = F.array().cast("array<int>")
    found = {p: F.when(padded.contains(f" {p} "), places(F.col("words"), p)).otherwise(none)
             for p in PHRASES}
    zeros = F.array(*[F.lit(0)] * len(sets))
    each = lambda b: F.array(*[overlap(b, words, order, threshold) for words, _ in sets])
    most = F.aggregate(
        windows(F.col("pairs"), block_pairs), zeros,
        lambda best, b: F.zip_with(best, each(b), lambda x, y: F.greatest(x, y)))
    scanned = worded.select(
        "doc_id",
        F.when(F.col("normal") == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        *[c.alias(f"at_{label}") for (p, label), c in zip(PHRASES.items(), found.values())],
        F.when(F.size("pairs") > 0, most).otherwise(zeros).alias("shared"))
    at = F.concat(*[F.col(f"at_{label}") for label in PHRASES.values()])
    base = F.array_compact(F.array(
        *[F.when(F.size(f"at_{label}") > 0, label) for label in PHRASES.values()]))
    more = F.array_compact(F.array(
        *[F.when(F.col("shared")[i] > 0, label) for i, (_, label) in enumerate(sets)]))
    contained = F.greatest(*[F.col("shared")[i] / len(words) for i, (words, _) in enumerate(sets)])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(contained).cast("double").alias("score"))


def twin() -> str:
    """DuckDB SQL for `scan` of the documents table, without any filter."""
    rows = ", ".join(
        f"({i}, '{label}', {len(words)}, {math.ceil(THRESHOLD * len(words) - 1e-9)}, [{', '.join(map(repr, words))}])"
        for i, (words, label) in enumerate(template_sets()))
    cls = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    half = BLOCK_PAIRS // 2
    phrase = " UNION ALL ".join(
        f"SELECT k, i, '{label}' AS label FROM w, unnest(range(n)) t(i) WHERE "
        + " AND ".join(f"words[i + {j + 1}] = '{word}'" for j, word in enumerate(p.split()))
        for p, label in PHRASES.items())
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '{cls}') AS words, len(regexp_extract_all(t, '{cls}')) AS n FROM d
), p AS ({phrase}),
pb AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY k
), l AS (
  SELECT k, list_transform(range(1, n), lambda i: words[i] || ' ' || words[i + 1]) AS words FROM w
), b AS (
  SELECT k, words FROM l WHERE len(words) <= {BLOCK_PAIRS}
  UNION ALL
  SELECT k, words[s + 1 : s + {BLOCK_PAIRS}] FROM l, unnest(range(0, len(words) - {half}, {half})) t(s)
  WHERE len(words) > {BLOCK_PAIRS}
), m(i, label, n, least, words) AS (VALUES {rows}),
h AS (
  SELECT k, label, len(list_intersect(list_distinct(b.words), m.words)) / n AS c
  FROM b, m WHERE len(list_intersect(list_distinct(b.words), m.words)) >= least
), a AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
  (SELECT k, label FROM h UNION ALL SELECT k, label FROM p) GROUP BY k
), c AS (SELECT k, max(c) AS c FROM h GROUP BY k)
SELECT doc_id, n AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM w LEFT JOIN pb USING (k) LEFT JOIN a USING (k) LEFT JOIN c USING (k)
"""
