"""License scans by diagonal voting of word k-grams. Native: built-in expressions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import materialize, only

K = 5
#: Neighbouring diagonals at most this far apart are one alignment (words put in or left out).
DRIFT = 4
#: Share of a template's k-grams that an alignment must have to be looked at, and of its words to be a match.
VOTES, SHARE = 0.25, 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Well-known licences, their usual notices and openings, as lower-case words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc", "this work is licensed under a creative commons attribution"),
]


def _grams() -> list[tuple[int, str, int, int, list[str]]]:
    """(template, label, place, k-grams of the template, words) of each k-gram."""
    out = []
    for n, (label, text) in enumerate(TEMPLATES):
        words = text.split()
        out += [(n, label, p, len(words) - K + 1, words[p : p + K]) for p in range(len(words) - K + 1)]
    return out


def _telling() -> list[str]:
    """Few words, long ones first, of which each k-gram holds one: a text without them holds no k-gram."""
    grams, out = [set(g) for *_, g in _grams()], []
    while grams:
        often = Counter(w for g in grams for w in g)
        best = max(sorted(often), key=lambda w: often[w] / (1 if len(w) > 5 else 40))  # short words are in any text
        out.append(best)
        grams = [g for g in grams if best not in g]
    return out


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_words, places, hits, low, part`` for each row, in one pass over the texts; written, so that ``row`` stays.

    places are the base phrases. hits are all the text's k-grams of which the hash is one of a template's: their word and hash.
    part holds the words about the hits, from word ``low`` on. The Kelvin sign is the only other letter that :func:`lower` makes
    one of a to z; it is put out of the way, so that A-Z alone are lower-cased as far as any result can tell.
    """
    spark = docs.sparkSession
    text = F.lower(F.replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    worded = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    at = """filter(sequence(0, size(w) - 1), i -> w[i] = 'license' and (coalesce(get(w, i - 1), '') in ('mit', 'apache')
        or coalesce(get(w, i - 1), '') = 'public' and coalesce(get(w, i - 2), '') = 'general'))"""
    places = f"transform(if(array_contains(w, 'license'), {at}, cast(array() as array<int>)), i -> if(w[i - 1] = 'public', named_struct('start', i - 2, 'label', 'gpl'), named_struct('start', i - 1, 'label', w[i - 1])))"
    known = sorted({r[0] for r in _hashed(spark).select("h").collect()})  # of the templates
    gram = f"xxhash64({', '.join(f'w[i + {j}]' for j in range(K))})"
    begins = f"filter(sequence(0, size(w) - {K}), i -> w[i] in ({_listed({g[0] for *_, g in _grams()})}))"
    hits = f"filter(transform({begins}, i -> named_struct('word', i, 'h', {gram})), x -> x.h in ({', '.join(f'{h}L' if h > -(1 << 63) else 'bigint(-9223372036854775808)' for h in known)}))"
    some = f"size(w) >= {K} and arrays_overlap(w, array({_listed(_telling())}))"
    found = worded.select("doc_id", F.size("w").alias("n_words"), F.expr(places).alias("places"), F.expr(f"if({some}, {hits}, cast(array() as array<struct<word:int,h:bigint>>))").alias("hits"), "w")
    longest = max(len(t.split()) for _, t in TEMPLATES) + DRIFT * len(TEMPLATES)
    low = F.when(F.size("hits") > 0, F.greatest(F.lit(0), F.col("hits")[0]["word"] - longest))
    part = F.expr(f"slice(w, greatest(0, hits[0].word - {longest}) + 1, hits[size(hits) - 1].word - hits[0].word + {2 * longest})")
    out = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "places", "hits", low.alias("low"), F.when(F.size("hits") > 0, part).alias("part"))
    return materialize(out, "licenses")[0]


def _hashed(spark: SparkSession) -> DataFrame:
    """The templates' k-grams with their places and hashes."""
    grams = spark.createDataFrame(_grams(), "template int, label string, place int, total int, g array<string>")
    return grams.select("template", "label", "place", "total", "g", F.xxhash64(*[F.col("g")[i] for i in range(K)]).alias("h"))


def _aligned(rows: DataFrame) -> DataFrame:
    """``row, doc_id, label, template, start, end, share`` of the alignments in rows of :func:`scanned`."""
    spark = rows.sparkSession
    met = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.word", "hit.h").join(F.broadcast(_hashed(spark).drop("g")), "h")
    diagonal = met.withColumn("diagonal", F.col("word") - F.col("place")).groupBy("row", "template", "label", "total", "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("word").alias("start"), F.max("word").alias("stop")
    )
    order = W.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1))
    runs = diagonal.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("row", "template", "label", "total", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_list("diagonal").alias("diagonals")
    )
    voted = merged.where(F.col("votes") >= VOTES * F.col("total"))
    texts = spark.createDataFrame([(n, t.split()) for n, (_, t) in enumerate(TEMPLATES)], "template int, t array<string>")
    both = voted.join(F.broadcast(texts), "template").join(rows.where(F.size("hits") > 0).select("row", "doc_id", "low", "part"), "row")
    same = F.expr("size(filter(sequence(0, size(t) - 1), p -> exists(diagonals, d -> coalesce(get(part, p + d - low) = t[p], false))))")
    share = same / F.size("t")
    return both.select("row", "doc_id", "label", "template", "start", (F.col("stop") + K).alias("end"), share.alias("share")).where(F.col("share") >= SHARE)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, label, template, start, end, share``: where a document has a template, words from 0, end exclusive.

    All rolling k-gram hashes of the documents are held against the templates' (a small constant set) in place, and those found
    meet the template positions in a join (the templates are constants, so they are broadcast). They vote for the diagonal word -
    place; diagonals at most DRIFT apart are merged, and a run of them with enough votes is verified word by word: share is that
    of the template's words that stand in the document on one of its diagonals. ``row`` tells rows of one id apart.
    """
    return _aligned(scanned(docs, id_col, text_col))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row.

    Base places are where the words mit license, apache license or general public license stand in a row. score is 1 with a base
    place, else the best alignment's share, else 0. Null texts have no words. Each row is by itself, also where ids repeat or are
    null; other columns are not read; an empty table gives no rows.
    """
    rows = scanned(docs, id_col, text_col)
    own = _aligned(rows).groupBy(F.col("row").alias("_row")).agg(F.collect_set("label").alias("own"), F.max("share").alias("best"))
    labels = F.array_distinct(F.col("places.label"))
    base = rows.select("row", "doc_id", "n_words", "places")
    return base.join(own, base.row == F.col("_row"), "left").select(
        base.doc_id,
        F.col("n_words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _duck() -> str:
    grams = ", ".join(f"({n}, '{label}', {p}, {total}, '{' '.join(g)}')" for n, label, p, total, g in _grams())
    texts = ", ".join(f"({n}, {t.split()!r})" for n, (_, t) in enumerate(TEMPLATES))
    return rf"""
with d as (select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
p as (select row, doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'license' and i > 1 and (w[i - 1] in ('mit', 'apache') or (w[i - 1] = 'public' and i > 2 and w[i - 2] = 'general'))) as found from d),
base as (select row, doc_id, len(w) as n_words, list_transform(found, lambda i: i - 1 - case when w[i - 1] = 'public' then 2 else 1 end) as starts,
         list_sort(list_distinct(list_transform(found, lambda i: case when w[i - 1] = 'public' then 'gpl' else w[i - 1] end))) as labels from p),
grams(template, label, place, total, g) as (values {grams}),
texts(template, t) as (values {texts}),
rolling as (select row, unnest(range(0, len(w) - {K - 1})) as word, unnest(list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) as g from d where len(w) >= {K}),
met as (select row, template, label, total, place, word - place as diagonal from rolling join grams using (g)),
diagonals as (select row, template, diagonal, case when diagonal - lag(diagonal) over (partition by row, template order by diagonal) <= {DRIFT} then 0 else 1 end as new
              from (select distinct row, template, diagonal from met)),
runs as (select *, sum(new) over (partition by row, template order by diagonal) as run from diagonals),
merged as (select row, template, label, run, list(distinct diagonal) as ds from met join runs using (row, template, diagonal) group by row, template, label, total, run having count(distinct place) >= {VOTES} * total),
verified as (select row, label, len(list_filter(range(0, len(t)), lambda p: len(list_filter(ds, lambda x: p + x >= 0 and p + x < len(w) and w[p + x + 1] = t[p + 1])) > 0)) / len(t) as share
             from merged join texts using (template) join d using (row)),
own as (select row, list(distinct label) as own, max(share) as best from verified where share >= {SHARE} group by row)
select doc_id, cast(n_words as bigint) as n_words, cast(len(starts) as bigint) as n_base, cast(list_min(starts) as bigint) as first_word, cast(list_max(starts) as bigint) as last_word,
       array_to_string(labels, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(labels, coalesce(own, [])))), ',') as labels,
       case when len(starts) > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from base left join own using (row)"""


SQL = {"op3_licenses": _duck()}
