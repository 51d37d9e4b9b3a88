"""Licence scans with a positional rare-token index (operator 3); DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower

#: A word: what is left between ASCII characters other than letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice's words, its label, and the words of its mandatory key phrase."""

    label: str
    words: str
    key: str
    base: bool = False


#: The base phrases with their labels.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
#: Notices known to the public, with the labels of the method's own.
NOTICES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit", "released under the mit license", "mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc0", "to the extent possible under law all copyright and related rights are waived cc0", "copyright and related rights"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan(docs: DataFrame, notices: tuple[Template, ...] = NOTICES, rare_words: int = 2, alike: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, base_places (array of word numbers), base_labels and labels (sorted
    arrays), matches (array of struct template, start, same, size) and score.

    The index holds, for each template, its ``rare_words`` rarest words by document frequency over
    all of ``docs`` (the highest IDF; ties to the smaller word) and their places. A document looks up where its words lie,
    and where every rare word of a template points to the same start, the template is a candidate. It counts
    where its key phrase stands at its place and at least alike[0]/alike[1] of its words agree.
    score is the largest share of agreeing words of a counted template, else 0.

    All of this is a projection of each row: nothing is shuffled but the licence words' counts.
    Null and empty texts have no words and no labels. Repeated rows are scanned once each, an
    empty table gives no rows, and other columns are not read.
    """
    templates = [*BASE, *notices]
    split = [t.words.split() for t in templates]
    keys = [t.key.split() for t in templates]
    vocabulary = sorted({w for ws in split for w in ws})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))

    known = F.array_intersect("words", _array(vocabulary))
    frequency = dict(rows.select(F.explode(known).alias("w")).groupBy("w").count().collect())  # at most the vocabulary's size
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, ws in enumerate(split):
        for w in sorted(set(ws), key=lambda w: (frequency.get(w, 0), w))[:rare_words]:
            postings.setdefault(w, []).append((n, ws.index(w)))
    need = [min(rare_words, len(set(ws))) for ws in split]

    posting = F.create_map(*[x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(n).alias("t"), F.lit(p).alias("p")) for n, p in ps]))])
    rare = _array(sorted(postings))
    table = F.array(*[F.struct(_array(ws).alias("words"), F.lit(next(i for i in range(len(ws)) if ws[i : i + len(k)] == k)).alias("key_at"), F.lit(len(k)).alias("key_size"), F.lit(m).alias("need")) for ws, k, m in zip(split, keys, need)])

    # where rare words lie, then which template starts they point to, in order of template and start
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(rare, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    starts = F.array_sort(F.flatten(F.transform("places", lambda x: F.transform(F.element_at(posting, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("start"))))))
    of = lambda x: F.get(table, x["t"])
    agreed = F.filter(F.transform("starts", lambda x, i: F.when((F.get("starts", i + of(x)["need"] - 1) == x) & ((i == 0) | (F.get("starts", i - 1) != x)), x)), lambda x: x.isNotNull())
    same_from = lambda x, a, n: F.size(F.filter(F.sequence(a, a + n - 1), lambda k: F.get("words", x["start"] + k) == F.get(of(x)["words"], k)))
    keyed = F.filter("agreed", lambda x: same_from(x, of(x)["key_at"], of(x)["key_size"]) == of(x)["key_size"])
    counted = F.transform("keyed", lambda x: F.struct(x["t"].alias("template"), x["start"].alias("start"), same_from(x, F.lit(0), F.size(of(x)["words"])).alias("same"), F.size(of(x)["words"]).alias("size")))
    matches = F.filter("counted", lambda x: x["same"] * alike[1] >= x["size"] * alike[0])
    for name, column in (("places", places), ("starts", starts), ("agreed", agreed), ("keyed", keyed), ("counted", counted), ("matches", matches)):
        rows = rows.withColumn(name, column)

    n_base = len(BASE)
    label = F.array(*[F.lit(t.label) for t in templates])
    base = F.filter("matches", lambda x: x["template"] < n_base)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.transform(base, lambda x: x["start"].cast("long")).alias("base_places"),
        F.array_sort(F.array_distinct(F.transform(base, lambda x: F.get(label, x["template"])))).alias("base_labels"),
        F.array_sort(F.array_distinct(F.transform("matches", lambda x: F.get(label, x["template"])))).alias("labels"),
        "matches",
        F.coalesce(F.array_max(F.transform("matches", lambda x: x["same"].cast("double") / x["size"])), F.lit(0.0)).alias("score"),
    )
