"""Search over text: inverted index, BM25, fusion and packing into a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekmill.functions.metrics import bm25
from trekmill.functions.text import cut_at_sentence, relevant_paragraphs, terms


def inverted_index(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, term, tf, length): one row for each distinct term of each field."""
    parts = None
    for field in fields:
        words = docs.select(key, F.lit(field).alias("field"), terms(F.col(field)).alias("w")).withColumn("length", F.size("w"))
        part = words.select(key, "field", "length", F.explode("w").alias("term")).groupBy(key, "field", "length", "term").agg(F.count("*").alias("tf"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def search(docs: DataFrame, key: str, weights: dict[str, float], queries: DataFrame) -> DataFrame:
    """(query, key, score) of every document with a query's term; all candidates are scored, none is cut off.

    queries: (query, term) rows; a term that ends in * stands for all words with that prefix. The terms go into
    the scan of the texts as a filter on words before anything is shuffled, so that only hits are. Statistics are over
    all documents: rows, mean length and documents with the term of each field.
    """
    wanted = [r.term for r in queries.select("term").distinct().collect()]  # the terms of the questions asked
    exact, prefixes = [t for t in wanted if not t.endswith("*")], [t for t in wanted if t.endswith("*")]
    match = F.when(F.col("w").isin(exact), F.array("w")).otherwise(F.array().cast("array<string>"))
    for p in prefixes:
        match = F.concat(match, F.when(F.col("w").startswith(p[:-1]), F.array(F.lit(p))).otherwise(F.array().cast("array<string>")))
    hits, stats = None, None
    for field, weight in weights.items():
        words = docs.select(key, terms(F.col(field)).alias("ws")).withColumns({"length": F.size("ws"), "field": F.lit(field), "weight": F.lit(weight)})
        h = words.select(key, "field", "weight", "length", F.explode("ws").alias("w")).select(key, "field", "weight", "length", F.explode(match).alias("term"))
        s = words.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))
        hits, stats = (h, s) if hits is None else (hits.unionByName(h), stats.unionByName(s))
    tf = hits.groupBy(key, "field", "weight", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")  # rows: fields x asked terms
    points = F.col("weight") * bm25(F.col("tf"), F.col("df"), F.col("length"), F.col("docs"), F.col("mean_length"))
    return scored.withColumn("points", points).join(F.broadcast(queries), "term").groupBy("query", key).agg(F.sum("points").alias("score"))


def rank_metrics(ranked: DataFrame, truth: DataFrame, query: str, key: str, depth: int = 10) -> DataFrame:
    """One row: hit_1, hit_5, mrr and found over all queries of truth (query, key). ranked: (query, key, rank)."""
    best = truth.join(ranked.where(F.col("rank") <= depth), [query, key], "left").groupBy(query).agg(F.min("rank").alias("r"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return best.agg(share(F.col("r") <= 1).alias("hit_1"), share(F.col("r") <= 5).alias("hit_5"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), share(F.col("r").isNotNull()).alias("found"))


def pack(sections: DataFrame, by: list[str], order: list, size: str, budget: int) -> DataFrame:
    """The leading sections of each group whose sizes (and two for each) stay within a budget, with `used`."""
    run = F.sum(F.col(size) + 2).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("used", run).where(F.col("used") <= budget)


#: Weight of a city's history and climate where the question isn't about them; how far the general guide must lead to come first.
OFF_TOPIC, GENERAL_LEAD = 0.1, 2.0


def rank_sections(scored: DataFrame, questions: DataFrame, query: str = "query", key: str = "id", limit: int = 3) -> DataFrame:
    """(query, key, nth): the sections that a question is answered from, in order.

    scored: query, key, score, kind ('country', 'city' or 'general'), category; questions: query, country_first (null: neither),
    history_or_climate, general_question, language. Of the country's and the cities' sections the `limit` best count, those of the kind that goes
    first before the others, then by score; of equal ones the least key goes first. The best general page stands before them if there are none, or if no city is
    asked for first and its score is above theirs times GENERAL_LEAD (times one in Italian and for general questions).
    """
    asked = scored.join(questions, query)
    off = (F.col("kind") == "city") & ~F.coalesce("history_or_climate", F.lit(True)) & F.col("category").isin("history", "climate")
    asked = asked.withColumn("score", F.when(off, F.col("score") * OFF_TOPIC).otherwise(F.col("score")))
    behind = F.coalesce((F.col("kind") == "country") != F.col("country_first"), F.lit(False))
    group = Window.partitionBy(query, F.col("kind") == "general")
    ranked = asked.withColumn("nth", F.row_number().over(group.orderBy(behind, F.desc("score"), key)))
    ranked = ranked.where(F.col("nth") <= F.when(F.col("kind") == "general", 1).otherwise(limit))  # a few rows a question from here on
    best = F.max(F.when(F.col("kind") != "general", F.col("score"))).over(Window.partitionBy(query))
    lead = F.when((F.col("language") == "it") | F.coalesce("general_question", F.lit(False)), 1.0).otherwise(GENERAL_LEAD)
    first = best.isNull() | (F.coalesce("country_first", F.lit(True)) & (F.col("score") > lead * best))
    kept = ranked.withColumn("goes_first", first).where((F.col("kind") != "general") | F.col("goes_first"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("kind") != "general", "nth"))
    return kept.select(query, key, place.alias("nth"))


#: Room below which another section would be a scrap only; characters of a note; share of a general page before others.
LEAST_ROOM, NOTE_ROOM, GENERAL_SHARE = 50, 500, 0.7


def pack_context(sections: DataFrame, questions: DataFrame, by: list[str], budget: int = 2000) -> DataFrame:
    """(by, context, used): of each question the text of its sections, in order of relevance, within a budget.

    sections: by, position (from the best), body, general (from the general guide) and searched (else computed, and shown first);
    questions: by, stems (array), note (may be null). A note takes up to NOTE_ROOM and stands last. The first general page gets
    GENERAL_SHARE of the sections' room if others follow it. Then every section takes what it needs of the room that is left: all of
    it, or the lines with most stems; each costs two more. It ends where less than LEAST_ROOM is left. The first general page is
    shown after the first searched section that isn't general, other general pages last. used: positions in the order shown.

    A section that counts takes three characters or more, so those beyond a third of the budget can't; they go before a
    question's sections are gathered, which so have a bound. Questions without sections have their note, or ''.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("position"))
    rows = sections.where(F.trim(F.regexp_replace("body", r"\s+", " ")) != "").withColumn("_n", nth).where(F.col("_n") <= budget // 3 + 1)
    row = F.struct("position", "body", F.coalesce("general", F.lit(False)).alias("general"), F.coalesce("searched", F.lit(True)).alias("searched"))
    gathered = rows.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("s"))
    asked = questions.join(gathered, by, "left").withColumn("s", F.coalesce("s", F.array().cast(gathered.schema["s"].dataType)))
    note = cut_at_sentence(F.col("note"), NOTE_ROOM)
    asked = asked.withColumns({"note": F.when(F.trim(note) != "", note), "stems": F.coalesce("stems", F.array().cast("array<string>"))})
    room = F.greatest(F.lit(budget) - F.coalesce(F.length("note") + 2, F.lit(0)), F.lit(0))
    first = F.array_position(F.transform("s", lambda x: x.general), True)
    asked = asked.withColumn("room", room).withColumn("first", F.when((first > 0) & (first < F.size("s")), first))
    shared = F.transform("s", lambda x, i: x.withField("body", F.when(i + 1 == F.col("first"), relevant_paragraphs(x.body, F.col("stems"), F.floor(F.col("room") * GENERAL_SHARE).cast("int"))).otherwise(x.body)))
    asked = asked.withColumn("s", shared)
    none = F.filter("s", lambda x: F.lit(False))
    start = F.struct(F.col("room").alias("left"), none.alias("kept"))

    def step(state: Column, x: Column) -> Column:
        part = x.withField("body", F.when(state.left >= LEAST_ROOM, relevant_paragraphs(x.body, F.col("stems"), state.left)).otherwise(""))

        def taken(p: Column) -> Column:
            full = F.trim(F.regexp_replace(p.body, r"\s+", " ")) != ""
            return F.struct(F.when(full, state.left - F.length(p.body) - 2).otherwise(state.left).alias("left"), F.when(full, F.concat(state.kept, F.array(p))).otherwise(state.kept).alias("kept"))

        return F.get(F.transform(F.array(part), taken), F.lit(0))  # the part is worked out once

    asked = asked.withColumn("kept", F.aggregate("s", start, step, lambda state: state.kept))
    of = lambda test: F.filter("kept", test)
    general, other = of(lambda x: x.searched & x.general), of(lambda x: x.searched & ~x.general)
    moved = F.concat(of(lambda x: ~x.searched), F.slice(other, 1, 1), F.slice(general, 1, 1), F.slice(other, F.lit(2), F.greatest(F.size(other), F.lit(1))), F.slice(general, F.lit(2), F.greatest(F.size(general), F.lit(1))))
    asked = asked.withColumn("kept", F.when((F.size(general) > 0) & (F.size(other) > 0), moved).otherwise(F.col("kept")))
    body = cut_at_sentence(F.array_join(F.transform("kept", lambda x: x.body), "\n\n"), F.col("room"))
    text = F.concat_ws("\n\n", F.when(F.trim(body) != "", body), F.col("note"))
    return asked.select(*by, text.alias("context"), F.transform("kept", lambda x: x.position).alias("used"))
