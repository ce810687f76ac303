"""License scans by diagonal voting: rolling word pairs joined to template places, summed by offset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from trekmill.llm.common import LOWER, cut, small_batches, splittable
from trekmill.llm.hashing import chunks, joined_words, mixed

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Licence phrases of the method and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution 4 0 international", "cc-by-4.0"),
    ("cc0 1 0 universal", "cc0"),
)
#: Words of a gram; diagonals this close are one match; least share of a template's grams.
GRAM, NEIGHBOURS, COVERED = 2, 2, 0.8

_WORD_BYTES = bytes(LOWER[b] if b >= 128 or chr(LOWER[b]) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of all pairs of neighbouring words of some texts, hashes as signed integers."""
    words, text, firsts = joined_words([(t or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES) for t in texts])
    pair = np.flatnonzero(text[:-1] == text[1:])
    return text[pair], pair - firsts[text[pair]], mixed(words[pair], words[pair + 1]).view(np.int64)


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, docs = batch.text.tolist(), batch.doc.to_numpy()
        for first, upto in chunks(texts):
            text, at, gram = grams(texts[first:upto])
            yield pd.DataFrame({"doc": docs[first + text], "at": at, "gram": gram})


def telling(phrases, exact: int = 0) -> list[set[int]]:
    """Of each template the places of the grams that tell it from templates of other labels.

    A template that another's text would cover (COVERED of its grams stand there) is of that one's family, and what it has of its own must be
    in a text before it is found there: the version of a licence, say.
    """
    own = [grams([phrase])[2].tolist() for phrase, _ in phrases]
    out: list[set[int]] = [set() for _ in own]
    for i, mine in enumerate(own):
        for j, other in enumerate(own):
            if min(i, j) >= exact and phrases[i][1] != phrases[j][1] and sum(g in set(other) for g in mine) >= COVERED * len(mine):
                out[i] |= {place for place, g in enumerate(mine) if g not in other}
    return out


def templates(spark, phrases=(*BASE, *TEMPLATES), exact: int = len(BASE)) -> DataFrame:
    """(gram, template, place, of, must, n_must): the places of every gram in the templates, and whether it is a telling one of `n_must`.

    A template needs two words or more.
    """
    rows, must = [], telling(phrases, exact)
    for i, (phrase, _) in enumerate(phrases):
        g = grams([phrase])[2].tolist()
        if not g:
            raise ValueError(f"a template needs {GRAM} words or more: {phrase!r}")
        rows += [(x, i, place, len(g), place in must[i], len(must[i])) for place, x in enumerate(g)]
    return spark.createDataFrame(rows, "gram long, template int, place int, of int, must boolean, n_must int")


def chain(hits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(hits, first word, last word) of the longest sequence of hits (place, word) in which both numbers rise.

    So each gram of the template counts once, and its words stand in the text in the template's order. Of equal
    ones the shortest span is taken, then the first.
    """
    best: list[tuple[int, int, int]] = []  # (length, -span, start) of the chain that ends at each hit
    hits = sorted(hits)
    for place, at in hits:
        before = [(n + 1, span - (at - hits[k][1]), start) for k, (n, span, start) in enumerate(best) if hits[k][0] < place and hits[k][1] < at]
        best.append(max(before, key=lambda x: (x[0], x[1], -x[2]), default=(1, 0, at)))
    n, span, start = max(best, key=lambda x: (x[0], x[1], -x[2]))
    return n, start, start - span + GRAM - 1


@pandas_udf(StructType([StructField("n", IntegerType()), StructField("first", LongType()), StructField("last", LongType())]))
def _chains(hits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([chain([(h["place"], h["at"]) for h in some]) for some in hits], columns=["n", "first", "last"])


def matches(docs: DataFrame, phrases=(*BASE, *TEMPLATES), exact: int = len(BASE)) -> DataFrame:
    """(doc, template, first, last, share): spans of words of each text that match a template.

    docs: doc (a key that tells texts apart) and text; rows that repeat a key count once. All rolling grams are joined to
    template places; a hit votes for the diagonal `word - place`. Of the first `exact` templates a span is a diagonal
    on which every gram has voted, so that all words stand consecutively. Of the others each diagonal with a vote is merged
    with those NEIGHBOURS words apart or less (words put in or left out), and the span is verified: share is that of the
    template's grams which stand there in the template's order, each counted once, and must be COVERED; the grams that tell a
    template from its family (`telling`) must be there, all of them. Of the spans that
    neighbouring diagonals give the best stays. The templates are a fixed list, so they are broadcast; a diagonal has
    at most a hit for each gram of its template, so no group is large.
    """
    small_batches(docs)
    places = templates(docs.sparkSession, phrases, exact)
    all_grams = docs.select("doc", "text").where("text is not null").mapInPandas(_positions, "doc long, at long, gram long")
    hits = cut(all_grams.join(F.broadcast(places), "gram").select("doc", "template", "at", "place", "of", "must", "n_must").distinct())
    diagonal = F.col("at") - F.col("place")
    whole = hits.where(F.col("template") < exact).groupBy("doc", "template", diagonal.alias("diagonal")).agg(F.count("*").alias("votes"), F.first("of").alias("of"), F.min("at").alias("first"))
    whole = whole.where("votes = of").select("doc", "template", "first", (F.col("first") + F.col("of") + GRAM - 2).alias("last"), F.lit(1.0).alias("share"))
    near = hits.where(F.col("template") >= exact).withColumn("diagonal", F.explode(F.sequence(diagonal - NEIGHBOURS, diagonal + NEIGHBOURS)))
    groups = near.groupBy("doc", "template", "diagonal").agg(F.collect_list(F.struct("place", "at")).alias("hits"), F.first("of").alias("of"), F.max(F.col("at") - F.col("place") == F.col("diagonal")).alias("own"), (F.size(F.collect_set(F.when(F.col("must"), F.col("place")))) == F.first("n_must")).alias("told"))
    spans = groups.where(F.col("own") & F.col("told") & (F.size("hits") >= F.col("of") * COVERED)).withColumn("c", _chains("hits"))
    spans = spans.select("doc", "template", "diagonal", "c.first", "c.last", (F.col("c.n") / F.col("of")).alias("share")).where(F.col("share") >= COVERED)
    around = Window.partitionBy("doc", "template").orderBy("diagonal").rangeBetween(-2 * NEIGHBOURS, 2 * NEIGHBOURS)
    rank = F.struct("share", (-F.col("diagonal")).alias("before"))
    best = spans.withColumn("best", F.max(rank).over(around)).where(F.col("best") == rank)
    return whole.unionByName(best.select("doc", "template", "first", "last", "share"))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    A word is a run of ASCII letters and digits and of all beyond ASCII, A-Z in lower case. first_word and last_word are the
    least and the greatest start of a base phrase, null if there is none; labels are distinct, sorted and joined by
    commas; score is the largest share of a template found, 1 for base phrases, 0 for none. Null text is as empty. Columns
    of docs with these names are replaced; rows are neither dropped nor merged. Texts are told apart by a hash.
    """
    names = F.array(*(F.lit(label) for _, label in (*BASE, *TEMPLATES)))
    base = F.col("template") < len(BASE)
    key = F.xxhash64("doc_id", "text")
    found = matches(docs.select(key.alias("doc"), "text")).withColumn("label", F.get(names, F.col("template")))
    found = found.groupBy(F.col("doc").alias("_doc")).agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    n = F.coalesce(F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    joined = docs.drop(*new).withColumn("n_words", n).withColumn("_key", key).join(splittable(found), F.col("_key") == F.col("_doc"), "left").drop("_doc", "_key")
    return joined.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
