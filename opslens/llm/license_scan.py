"""License scan: positional rare-token index over licence notices, native.

``index`` cuts every text into words once and keeps the places of the words that
the notices have (with the number of all words); written, as both steps read it.
``fit`` counts, over all documents, in how many each word of the key phrases
occurs. The two rarest words of each mandatory key phrase head its posting
lists. ``scan`` looks those words up in each file, turns every occurrence into
the places where the phrase would start, intersects the places from both words
(relative position), and verifies the whole mandatory key phrase there. Both
lookups are necessary conditions of the phrase, so no place is lost.

Everything is DataFrame functions inside the row: no shuffle but the counts.

Cases: a null or empty text has no words and no places (labels empty, score 0,
first and last null). Repeated rows give one result row each. With an empty
table all counts are zero and the result is empty. A phrase that occurs
several times counts at each place; ties in rarity go by the word.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import id_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    key: str      # mandatory key phrase
    notice: str   # the usual sentence around it, for the score
    base: bool = False


# Licence notices, their key phrases and labels.
TEMPLATES = (
    Template("mit", "under the mit license", "released under the mit license", True),
    Template("apache-2", "apache license version 2", "licensed under the apache license version 2 0", True),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0", True),
    Template("gpl-3", "gnu general public license version 3",
             "licensed under the gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2",
             "licensed under the gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license", "under the gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "under the gnu affero general public license"),
    Template("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistributions of source code must retain the above copyright notice",
             "redistributions of source code must retain the above copyright notice this list of conditions"),
    Template("isc", "permission to use copy modify and or distribute this software",
             "permission to use copy modify and or distribute this software for any purpose"),
    Template("unlicense", "free and unencumbered software released into the public domain",
             "this is free and unencumbered software released into the public domain"),
)


def _words(text: Column) -> Column:
    # lower() also maps the two letters below to ASCII ones; another non-ASCII word
    # character in their place keeps the words and leaves lower-casing to A-Z
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("ö")), F.lit("İ"), F.lit("ö"))
    return F.regexp_extract_all(F.lower(safe), F.lit(WORD), F.lit(0))


INDEX = "array<struct<i:int,w:string>>"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, hits: the place (from 0) of every word that a notice has. Not written yet."""
    vocab = sorted({w for t in templates for w in f"{t.key} {t.notice}".split()})
    rows = id_text(docs, id_col, text_col).select("doc_id", _words(F.col("text")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocab), F.struct(i.alias("i"), w.alias("w")))),
                    lambda h: h.isNotNull())
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.cast(INDEX).alias("hits"))


def _indexed(docs: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...]) -> DataFrame:
    return docs if dict(docs.dtypes).get("hits") == INDEX else index(docs, id_col, text_col, templates)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Document frequency, over all documents (or their ``index``), of each key-phrase word (one row a
    word reaches the driver: as many as the templates have)."""
    vocab = sorted({w for t in templates for w in t.key.split()})
    held = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    rows = (_indexed(docs, id_col, text_col, templates).select(F.explode(held).alias("word"))
            .where(F.col("word").isin(vocab)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect())
    return dict.fromkeys(vocab, 0) | {r["word"]: r["n"] for r in rows}


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, df: dict[str, int], id_col: str = "doc_id", text_col: str = "text",
         templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places array<struct<template, start, label, base, match>> of documents or their ``index``.

    ``match`` is the part of the notice's words that stand at their relative
    positions around the verified key phrase (0 to 1].
    """
    total = len(templates)
    postings: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for t, tpl in enumerate(templates):
        key = tpl.key.split()
        rare = sorted(set(key), key=lambda w: (df.get(w, 0), w))
        for side in (0, 1):
            word = rare[min(side, len(rare) - 1)]
            postings[side].setdefault(word, []).extend((t, q) for q, w in enumerate(key) if w == word)
    rows = _indexed(docs, id_col, text_col, templates).select("doc_id", "n_words", "hits")

    def starts(side: int) -> Column:
        # start * total + template; the first posting word of a file's hit decides the row of the map
        table = F.create_map(*[x for w, places in postings[side].items() for x in
                               (F.lit(w), F.array(*[F.lit(-q * total + t).cast("long") for t, q in places]))])
        own = F.filter(F.col("hits"), lambda h: h["w"].isin(sorted(postings[side])))
        return F.flatten(F.transform(own, lambda h: F.transform(
            F.element_at(table, h["w"]), lambda p: h["i"].cast("long") * total + p)))

    keys = F.array(*[_strings(t.key.split()) for t in templates])
    notices = F.array(*[_strings(t.notice.split()) for t in templates])
    ahead = F.array(*[F.lit((f" {t.notice} ".index(f" {t.key} ") and t.notice[:f" {t.notice} ".index(f" {t.key} ")]
                             .count(" ")) or 0) for t in templates])
    labels, base = _strings(t.label for t in templates), F.array(*[F.lit(t.base) for t in templates])

    rows = rows.withColumn("at", F.array_intersect(starts(0), starts(1)))
    rows = rows.withColumn("at", F.filter("at", lambda c: (c >= 0)))
    rows = rows.withColumn("at", F.transform("at", lambda c: F.struct(
        (c % total).cast("int").alias("t"), F.floor(c / total).cast("int").alias("s"))))
    rows = rows.withColumn("word_at", F.when(F.size("at") > 0, F.map_from_entries("hits")))

    def word(place: Column) -> Column:
        return F.try_element_at("word_at", place.cast("int"))

    def phrase_at(c: Column) -> Column:
        key = F.get(keys, c["t"])
        return F.forall(F.sequence(F.lit(0), F.size(key) - 1), lambda j: F.coalesce(word(c["s"] + j) == F.get(key, j), F.lit(False)))

    rows = rows.withColumn("at", F.filter("at", phrase_at))

    def match(c: Column) -> Column:
        notice = F.get(notices, c["t"])
        same = F.filter(F.sequence(F.lit(0), F.size(notice) - 1),
                        lambda j: word(c["s"] - F.get(ahead, c["t"]) + j) == F.get(notice, j))
        return F.size(same) / F.size(notice)

    places = F.transform("at", lambda c: F.struct(
        c["t"].alias("template"), c["s"].cast("long").alias("start"), F.get(labels, c["t"]).alias("label"),
        F.get(base, c["t"]).alias("base"), match(c).alias("match")))
    return rows.select("doc_id", "n_words", places.alias("places"))


def summary(places: DataFrame) -> DataFrame:
    """One row per document: counts, first and last base place, labels and score."""
    base = F.filter("places", lambda p: p["base"])

    def joined(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"]))), ",")

    return places.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["match"])), F.lit(0.0)).alias("score"))


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``summary``: each phrase tried at every word of every document."""
    parts = []
    for t, tpl in enumerate(templates):
        key, notice = tpl.key.split(), tpl.notice.split()
        ahead = notice.index(key[0]) if notice[:len(key)] != key else 0
        while notice[ahead:ahead + len(key)] != key:
            ahead += 1
        sql_list = "[" + ", ".join(f"'{w}'" for w in key) + "]"
        matched = " + ".join(f"(coalesce(s - {ahead} + {j} >= 0 and w[s - {ahead} + {j} + 1] = '{x}', false))::int"
                             for j, x in enumerate(notice))
        parts.append(f"SELECT d, s, '{tpl.label}' AS label, {str(tpl.base).lower()} AS base, "
                     f"({matched}) / {len(notice)}.0::double AS score FROM pos "
                     f"WHERE w[s + 1] = '{key[0]}' AND w[s + 1:s + {len(key)}] = {sql_list}")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
pos AS (SELECT d, w, unnest(range(len(w))) AS s FROM doc
        WHERE list_has_any(w, ['license', 'cc', 'permission', 'redistributions', 'unencumbered'])),
hit AS ({' UNION ALL '.join(parts)}),
agg AS (SELECT d, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word,
          max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
          string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM hit GROUP BY d)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word,
  last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0) AS score
FROM doc LEFT JOIN agg USING (d)
"""
