"""License scans through a positional index of rare words (DataFrame functions only).

Templates are short licence notices as word lists, each with a mandatory key phrase.  The
index holds, for each template, its rarest words and their positions; rarity is the inverse
document frequency of the licence words over all documents.  A document looks up all
its indexed words, and every occurrence posts (template, position in the text - position in
the template): that is where the template would lie.  Equal postings are checked once, but
one posting is enough; postings are not intersected, as the phrase's anchor is indexed and
the key phrase is verified word by word at every place.  So the frequencies choose which
words are looked up, not the results.  The score is the share of the template's words found
in place.

The frequencies are one small aggregate (at most one row per licence word); everything
else is computed row by row, so texts are never shuffled.

Defined cases: a missing text is an empty text, without words, places or labels and with
score 0; repeated rows are scanned each; extra columns are ignored; ties of frequency are
ordered by word; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import let, lower_ascii, whole

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: First word of the mandatory phrase in ``words``, and how many words it has.
    phrase: int
    phrase_size: int
    base: bool = False


def template(label: str, text: str, phrase: str, base: bool = False) -> Template:
    w, p = text.split(), phrase.split()
    at = next(i for i in range(len(w)) if w[i:i + len(p)] == p)
    return Template(label, tuple(w), at, len(p), base)


#: The base phrases, and licence notices as they are commonly written.
TEMPLATES = (
    template("cc-by", "cc by", "cc by", base=True),
    template("gpl", "general public license", "general public license", base=True),
    template("reserved", "all rights reserved", "all rights reserved", base=True),
    template("mit", "released under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
             "software and associated documentation files", "permission is hereby granted free of charge"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are "
             "permitted provided that the following conditions are met",
             "redistribution and use in source and binary forms"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    template("gpl-2.0", "this work is licensed under the gnu general public license version 2",
             "gnu general public license version 2"),
    template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)
#: Rare words by which a template is indexed, besides the rarest word of its phrase.
INDEXED = 3
#: A label other than a base one needs this share of its template's words in place.
LEAST_SHARE = 0.5


def text_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    clean = F.btrim(F.regexp_replace(lower_ascii(whole(text)), SEPARATORS, " "))
    return let(clean, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def frequencies(docs: DataFrame, text: str, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each licence word occurs (one row per licence word)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    own = F.array_distinct(F.filter(text_words(F.col(text)), lambda w: w.isin(vocabulary)))
    rows = docs.select(F.explode(own).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def index(df: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) by word: of each template its rarest words and the
    rarest word of its phrase."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(templates):
        by_rarity = sorted(set(t.words), key=lambda w: (df[w], w))
        phrase = t.words[t.phrase:t.phrase + t.phrase_size]
        anchor = min(phrase, key=lambda w: (df[w], w))
        for word in {anchor, *([] if t.base else by_rarity[:INDEXED])}:
            for i, w in enumerate(t.words):
                # one place of the anchor is enough: the phrase fixes the others
                if w == word and (word != anchor or i == t.phrase + phrase.index(anchor)):
                    postings.setdefault(word, []).append((n, i))
    return postings


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Words, base places, labels and score of every document."""
    postings = index(frequencies(docs, text, templates), templates)
    names = sorted(postings)
    posted = F.create_map(*[c for w in names for c in (F.lit(w), F.array(*[
        F.struct(F.lit(n).alias("t"), F.lit(i).alias("i")) for n, i in postings[w]]))])

    def placed(w: Column) -> Column:
        """Distinct (template, start) where rare words of the document meet."""
        hits = F.filter(F.transform(w, lambda x, i: F.when(
            x.isin(names), F.struct(x.alias("w"), i.alias("at")))), lambda h: h.isNotNull())
        return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(
            F.element_at(posted, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["i"]).alias("start"))))))

    def share(w: Column, p: Column) -> Column:
        """Share of the template's words in place, or null if its phrase is not there."""
        out = F.lit(None).cast("double")
        for n, t in enumerate(templates):
            there = [(F.get(w, p["start"] + i) == x) for i, x in enumerate(t.words)]
            phrase = there[t.phrase]
            for c in there[t.phrase + 1:t.phrase + t.phrase_size]:
                phrase = phrase & c
            total = F.lit(0)
            for c in there:
                total = total + F.when(c, 1).otherwise(0)
            out = F.when(p["t"] == n, F.when(phrase, total / len(t.words))).otherwise(out)
        return out

    bases = [n for n, t in enumerate(templates) if t.base]
    label_of = F.array(*[F.lit(t.label) for t in templates])
    first = F.array(*[F.lit(t.phrase) for t in templates])

    def facts(w: Column) -> Column:
        found = F.filter(
            F.transform(placed(w), lambda p: F.struct(p["t"].alias("t"), p["start"].alias("start"),
                                                      share(w, p).alias("share"))),
            lambda p: p["share"].isNotNull() & (p["t"].isin(bases) | (p["share"] >= LEAST_SHARE)))

        def result(f: Column) -> Column:
            base = F.filter(f, lambda p: p["t"].isin(bases))
            places = F.transform(base, lambda p: (p["start"] + F.get(first, p["t"])).cast("long"))

            def labels(some: Column) -> Column:
                return F.array_join(F.sort_array(F.array_distinct(
                    F.transform(some, lambda p: F.get(label_of, p["t"])))), ",")

            return F.struct(
                F.size(w).cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
                F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
                labels(base).alias("base_labels"), labels(f).alias("labels"),
                F.coalesce(F.array_max(F.transform(f, lambda p: p["share"])), F.lit(0.0)).alias("score"))

        return let(found, result)

    return docs.select(F.col(key), F.inline(F.array(let(text_words(F.col(text)), facts))))


def _sql() -> str:
    """The same places straight from the phrases: an anchor of every phrase is indexed, so
    the index finds each place of each phrase."""
    rows = ", ".join(f"({n}, '{t.label}', {str(list(t.words))}, {t.phrase}, {t.phrase_size}, {str(t.base).lower()})"
                     for n, t in enumerate(TEMPLATES))
    return rf"""
WITH templates(t, label, tw, phrase, phrase_size, base) AS (VALUES {rows}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS x FROM d),
f AS (
  SELECT doc_id, t, label, base, pos - phrase - 1 AS start, phrase,
         len(list_filter(range(1, len(tw) + 1), lambda k: pos - phrase - 1 + k >= 1
             AND w[greatest(pos - phrase - 1 + k, 1)] = tw[k])) / len(tw) AS share
  FROM p JOIN templates ON x = tw[phrase + 1] JOIN d USING (doc_id)
  WHERE w[pos:pos + phrase_size - 1] = tw[phrase + 1:phrase + phrase_size]),
g AS (SELECT * FROM f WHERE base OR share >= 0.5)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
       min(start + phrase) FILTER (base)::BIGINT AS first_word,
       max(start + phrase) FILTER (base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(share), 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id, w
"""


SQL = _sql()
