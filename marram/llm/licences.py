"""Licence scans by a positional rare-token index, in Spark expressions only.

1. One pass counts, for each word of the templates' key phrases, the files that hold it: its
   inverse document frequency over the whole corpus.
2. The index posts the ``RAREST`` words of highest inverse document frequency of each key
   phrase, with their positions.  Rarity is taken a template, not a file: a file with several
   licences is looked up for every one of them, at all occurrences of its posted words.
3. A word at position i of the file that stands at position p of a template puts the template
   at i - p.  Where all posted words of a template agree, and only there, it is a candidate; as
   the key phrase is mandatory, no alignment that counts is passed over.
4. A candidate counts if the key phrase stands there word for word and at least ``COVER`` of the
   template's words are in place.

The second pass is local to a row: nothing is shuffled.  The driver gets one count a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Opening or granting sentences of public licences; the key phrase is between bars.
TEMPLATES = [
    ("mit", "|permission is hereby granted free of charge to any person obtaining a copy of this software| and associated documentation files"),
    ("apache", "licensed under the |apache license version 2 0| the license you may not use this file except in compliance with the license"),
    ("gpl", "you can |redistribute it and or modify it under the terms of the gnu general public license| as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the |gnu lesser general public license| as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the |gnu affero general public license| as published by the free software foundation"),
    ("bsd", "|redistribution and use in source and binary forms with or without modification are permitted| provided that the following conditions are met"),
    ("mpl", "this source code form is |subject to the terms of the mozilla public license| v 2 0"),
    ("isc", "|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted|"),
    ("boost", "|permission is hereby granted free of charge to any person or organization obtaining a copy of the software| and accompanying documentation covered by this license"),
    ("zlib", "|this software is provided as is without any express or implied warranty| in no event will the authors be held liable"),
    ("unlicense", "|this is free and unencumbered software released into the public domain|"),
    ("epl", "this program and the accompanying materials are |made available under the terms of the eclipse public license|"),
    ("cc-by", "this work is licensed under a |creative commons attribution| license"),
    ("mit", "|released under the mit license|"),
    ("apache", "|released under the apache license|"),
    ("gpl", "|released under the gnu general public license|"),
    ("bsd", "|released under the bsd license|"),
]
#: Base phrases and their labels.
PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
#: Posted words of a template, all of which must agree.
RAREST = AGREE = 2
COVER = 0.75

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP, _SHIFT = 1 << 40, 1 << 20


def _parsed() -> list[tuple[str, list[str], int, int]]:
    """(label, words, first word of the key phrase, words in it) of each template."""
    out = []
    for label, text in TEMPLATES:
        before, key, after = text.split("|")
        out.append((label, (before + " " + key + " " + after).split(), len(before.split()), len(key.split())))
    return out


TEMPLATE_WORDS = _parsed()
#: (template, position) of the words of key phrases.
POSTINGS: dict[str, list[tuple[int, int]]] = {}
for _t, (_, _words, _first, _size) in enumerate(TEMPLATE_WORDS):
    for _p in range(_first, _first + _size):
        POSTINGS.setdefault(_words[_p], []).append((_t, _p))


def _low(c: F.Column) -> F.Column:
    return F.translate(c, _UP, _LOW)


def _words(text: str) -> F.Column:
    return F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def document_frequency(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """The number of texts that hold each word of the key phrases; one row a word reaches the driver."""
    known = sorted(POSTINGS)
    own = F.array_distinct(F.transform(F.filter(_words(text), lambda w: F.lower(w).isin(known)), _low))
    held = docs.select(F.explode(F.filter(own, lambda w: w.isin(known))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return {r["w"]: r["n"] for r in held.collect()}


def rare_index(frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """(template, position) postings of each key phrase's RAREST words of highest inverse document frequency."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, first, size) in enumerate(TEMPLATE_WORDS):
        rare = sorted(range(first, first + size), key=lambda p: (frequency.get(words[p], 0), words[p], p))
        for p in rare[:RAREST]:
            out.setdefault(words[p], []).append((t, p))
    return out


def word_hits(docs: DataFrame, text: str, keep: tuple[str, ...], index: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """The ``_keep`` columns and words of each text, and ``_hits``: (i, w) of those that base phrases or the index hold."""
    vocabulary = sorted({*index, *(w for words, _ in PHRASES for w in words)})
    words = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_keep"), _words(text).alias("_words"))
    at = F.array_compact(F.transform("_words", lambda w, i: F.when(F.lower(w).isin(vocabulary), i)))
    spots = words.withColumn("_at", at)
    # lower() also maps some letters beyond A-Z; only A-Z may count.
    pairs = F.transform("_at", lambda i: F.struct(i.alias("i"), _low(F.get("_words", i)).alias("w")))
    return spots.select("_keep", "_words", F.filter(pairs, lambda h: h["w"].isin(vocabulary)).alias("_hits"))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the scan's result for every row of ``docs``.

    A null or empty text has no words and no labels, and score 0; an empty table gives no
    rows.  Other rows decide only which words are posted, never what is found, so repeated rows
    are judged alike; a text of any length is read whole.  ``keep`` columns may have any names.
    """
    index = rare_index(document_frequency(docs, text))
    hits = word_hits(docs, text, keep, index)
    at = lambda i: _low(F.get("_words", i))

    def phrase(h):
        c = F.lit(None).cast("struct<start:int,label:string>")
        for words, label in PHRASES:
            back = len(words) - 1
            fits = h["w"] == words[-1]
            for k, w in enumerate(words[:-1]):
                fits = fits & (at(h["i"] - (back - k)) == w)
            c = F.when(fits, F.struct((h["i"] - back).alias("start"), F.lit(label).alias("label"))).otherwise(c)
        return c

    found = hits.withColumn("_base", F.array_compact(F.transform("_hits", phrase)))
    votes = F.create_map(*[x for w in sorted(index) for x in (F.lit(w), F.array(*[F.lit(t * _STEP + _SHIFT - p).cast("long") for t, p in index[w]]))])
    own = F.filter("_hits", lambda h: h["w"].isin(sorted(index)))
    found = found.withColumn("_own", F.when(F.size("_hits") >= AGREE, own).otherwise(F.array().cast("array<struct<i:int,w:string>>")))
    voted = F.transform("_own", lambda h: F.transform(F.element_at(votes, h["w"]), lambda v: v + h["i"]))
    found = found.withColumn("_votes", F.sort_array(F.flatten(voted)))
    found = found.withColumn("_places", F.array_distinct(F.filter("_votes", lambda v, k: F.get("_votes", k - (AGREE - 1)) == v)))
    templates = F.array(*[F.array(*map(F.lit, words)) for _, words, _, _ in TEMPLATE_WORDS])
    facts = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(first).alias("first"), F.lit(size).alias("size")) for label, _, first, size in TEMPLATE_WORDS])

    def judged(v):
        t, off = F.floor(v / _STEP).cast("int"), (v % _STEP - _SHIFT).cast("int")
        right = F.transform(F.get(templates, t), lambda w, p: F.coalesce(at(off + p) == w, F.lit(False)))
        fact = F.get(facts, t)
        key = F.forall(F.slice(right, fact["first"] + 1, fact["size"]), lambda x: x)
        share = F.size(F.filter(right, lambda x: x)) / F.size(right)
        return F.when(key & (share >= COVER), F.struct(share.alias("score"), fact["label"].alias("label")))

    return _result(found.withColumn("_good", F.array_compact(F.transform("_places", judged))), keep)


def _result(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    starts = F.transform("_base", lambda b: b["start"].cast("long"))
    own, more = F.transform("_base", lambda b: b["label"]), F.transform("_good", lambda g: g["label"])
    return found.select(
        *[F.col("_keep")[c].alias(c) for c in keep],
        F.size("_words").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, more))), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_good", lambda g: g["score"])), F.lit(0.0))).alias("score"),
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    postings = ", ".join(f"('{w}', {t}, {p})" for w, ps in sorted(POSTINGS.items()) for t, p in ps)
    words = ", ".join(f"({t}, {p}, '{w}', {str(first <= p < first + size).lower()}, '{label}', {len(ws)})" for t, (label, ws, first, size) in enumerate(TEMPLATE_WORDS) for p, w in enumerate(ws))
    last = {w for ws, _ in PHRASES for w in ws}
    return rf"""
WITH post(w, t, p) AS (VALUES {postings}),
tw(t, p, w, iskey, label, n) AS (VALUES {words}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
a AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
v AS (SELECT * FROM a WHERE w IN (SELECT w FROM tw) OR w IN ({", ".join(repr(w) for w in sorted(last))})),
b AS (SELECT c.doc_id, c.i - 1 AS start, x.w AS label FROM v c JOIN v x ON x.doc_id = c.doc_id AND x.i = c.i - 1 WHERE c.w = 'license' AND x.w IN ('mit', 'apache')
      UNION ALL SELECT c.doc_id, c.i - 2, 'gpl' FROM v c JOIN v x ON x.doc_id = c.doc_id AND x.i = c.i - 1 AND x.w = 'public'
        JOIN v y ON y.doc_id = c.doc_id AND y.i = c.i - 2 AND y.w = 'general' WHERE c.w = 'license'),
c AS (SELECT v.doc_id, post.t, v.i - post.p AS off FROM v JOIN post USING (w) GROUP BY ALL HAVING count(*) >= {AGREE}),
g AS (SELECT c.doc_id, any_value(tw.label) AS label, count(v.w) / any_value(tw.n)::DOUBLE AS score
      FROM c JOIN tw USING (t) LEFT JOIN v ON v.doc_id = c.doc_id AND v.i = c.off + tw.p AND v.w = tw.w
      GROUP BY c.doc_id, c.t, c.off HAVING bool_and(NOT tw.iskey OR v.w IS NOT NULL) AND count(v.w) / any_value(tw.n)::DOUBLE >= {COVER}),
bs AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
gs AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM g) GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS score FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(bs.n_base, 0)::BIGINT AS n_base, bs.first_word::BIGINT AS first_word, bs.last_word::BIGINT AS last_word,
  coalesce(bs.base_labels, '') AS base_labels, coalesce(gs.labels, '') AS labels, CASE WHEN bs.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(sc.score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN gs USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


OP1_SQL = _sql()
