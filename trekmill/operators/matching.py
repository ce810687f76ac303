"""Matches that depend on an order: greedy pairs within a small key, term links, clusters of equal names."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekmill.functions.geo import planar_m
from trekmill.functions.text import fold, phone_suffix, terms
from trekmill.operators.lineage import cut, written
from trekmill.operators.relational import numbered


#: Kinds of missions in their order; any other is a consulate.
MISSION_KINDS = ("embassy", "consulate_general", "consulate")

#: Places of a group that take their turns in one task. Bears on speed and memory alone.
BLOCK_PLACES = 20_000


def kind_order(kind: Column) -> Column:
    """Place of a mission's kind in MISSION_KINDS; null stays null, an unknown kind counts as the last."""
    at = F.array_position(F.array(*map(F.lit, MISSION_KINDS)), kind)
    return F.when(kind.isNotNull(), F.when(at > 0, at).otherwise(len(MISSION_KINDS)).cast("int"))


def _ready(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    names = F.col("names") if "names" in df.columns else F.array("name")
    words = F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.sort_array(F.array_distinct(F.filter(terms(n), lambda w: F.length(w) > 1))))
    return df.select(*by, F.col(key), kind_order(F.col("kind")).alias("kind"), phone_suffix(F.col("phone")).alias("tel"), F.array_distinct(F.filter(words, lambda w: F.size(w) > 0)).alias("names"))


def _both_ready(pois: DataFrame, missions: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    return _ready(pois, "poi_id", by), _ready(missions, "mission_id", by).withColumn("kind", F.coalesce("kind", F.lit(len(MISSION_KINDS))))


def _by_name(p: DataFrame, m: DataFrame, by: list[str], key: str = "poi_id") -> DataFrame:
    """(by, key, mission_id, kind): pairs of one kind and with names that fit; repeated if several names do."""

    def words_of(df: DataFrame, key: str) -> DataFrame:
        return df.select(*by, key, "kind", F.explode("names").alias("w")).select("*", F.explode("w").alias("word"))

    p_words, m_words = words_of(p, key), words_of(m, "mission_id").withColumnsRenamed({"kind": "kind_m", "w": "w_m"})
    common = p_words.select(*by, "word").unionByName(m_words.select(*by, "word")).groupBy(*by, "word").agg(F.count("*").alias("n"))

    def rarest(words: DataFrame, own: list[str]) -> DataFrame:
        return words.join(common, [*by, "word"]).groupBy(*by, *own).agg(F.min_by("word", F.struct("n", "word")).alias("word"))

    own_p, own_m = [key, "kind", "w"], ["mission_id", "kind_m", "w_m"]
    held_in = (F.size("w") <= F.size("w_m")) & (F.size(F.array_except("w", "w_m")) == 0)
    holds = (F.size("w_m") <= F.size("w")) & (F.size(F.array_except("w_m", "w")) == 0)
    met = rarest(p_words, own_p).join(m_words, [*by, "word"]).where(held_in).unionByName(rarest(m_words, own_m).join(p_words, [*by, "word"]).where(holds))
    least = F.least(F.size("w"), F.size("w_m"))
    fits = (F.col("kind").isNull() | (F.col("kind") == F.col("kind_m"))) & ((F.col("w") == F.col("w_m")) | (least >= 2) | F.col("kind").isNotNull())
    return met.where(fits).select(*by, key, "mission_id", F.col("kind_m").alias("kind"))


def embassy_candidates(pois: DataFrame, missions: DataFrame, by: list[str]) -> DataFrame:
    """(by, poi_id, mission_id, rank, kind): pairs with equal phone suffix (0), or of one kind and with names that fit (1).

    Both sides: by, id, kind, phone, and name or an array of `names`. A place without kind fits any mission. Names fit if their
    word sets are equal, or one holds the other, which has two words or more or belongs to a place whose kind is known; words of one letter
    don't count. kind is the mission's place in MISSION_KINDS.

    Pairs meet by phone, or by a word: all words of the name that is held are shared, so its rarest one is, and only that is
    looked for among the other name's words. How rare a word is within `by` is counted over both sides.
    """
    p, m = _both_ready(pois, missions, by)
    by_tel = p.where("tel is not null").join(m.select(*by, "mission_id", "tel", F.col("kind").alias("kind_m")), [*by, "tel"]).select(*by, "poi_id", "mission_id", F.lit(0).alias("rank"), F.col("kind_m").alias("kind"))
    by_name = _by_name(p, m, by).withColumn("rank", F.lit(1))
    return by_tel.unionByName(by_name).groupBy(*by, "poi_id", "mission_id").agg(F.min("rank").alias("rank"), F.first("kind").alias("kind"))


def embassy_pairs(pois: DataFrame, missions: DataFrame, by: list[str]) -> DataFrame:
    """(by, poi_id, mission_id): greedy_pairs of embassy_candidates, whose pairs are never formed.

    Places of one phone have one list of missions, and so have those of one kind and one set of names: a place takes the first free
    mission of its phone's list, else of its names'. A list of n missions is used up after n places that ask for nothing after it, so
    later ones are left out at once. The others take their turns in blocks of BLOCK_PLACES of each group, one block after another and
    all groups side by side; a task holds one block, and of each list that it asks the first BLOCK_PLACES missions that are free.
    So there are as many rounds as the largest group has blocks, however the lists are interwoven.
    """
    spark = pois.sparkSession
    p, m = _both_ready(pois.dropna(subset=by), missions, by)
    tel, names = (F.to_json(F.struct(*by, *c)) for c in (["tel"], ["kind", "names"]))
    p = p.withColumns({"next": F.when(F.size("names") > 0, names), "list": F.when(F.col("tel").isNotNull(), tel)})
    of_names = _by_name(p.where("next is not null").select(*by, "kind", "names", F.col("next").alias("list")).distinct(), m, by, "list")
    of_tel = m.where("tel is not null").select(*by, tel.alias("list"), "mission_id", "kind")
    lists = written(of_names.unionByName(of_tel).distinct())
    used = lists.select("list").distinct()
    known = used.select(F.col("list").alias("next"), F.lit(True).alias("_n"))
    asking = p.select(*by, "poi_id", "list", "next").join(used.withColumn("_l", F.lit(True)), "list", "left").join(known, "next", "left")
    asking = asking.select(*by, "poi_id", F.when(F.col("_l"), F.col("list")).alias("list"), F.when(F.col("_n"), F.col("next")).alias("next")).where("list is not null or next is not null")
    asking = written(asking.select(*by, "poi_id", F.coalesce("list", "next").alias("list"), F.when(F.col("list").isNotNull(), F.col("next")).alias("next")))
    length = written(lists.groupBy("list").agg(F.count("*").alias("_length")))
    nth = F.row_number().over(Window.partitionBy("list").orderBy("poi_id"))

    def within(asking: DataFrame) -> DataFrame:
        return asking.withColumn("_nth", nth).join(length, "list").withColumn("_within", F.col("_nth") <= F.col("_length")).drop("_nth", "_length")

    early = written(within(asking.where("next is not null")))
    late = early.where("not _within").select(*by, "poi_id", F.col("next").alias("list"), F.lit(None).cast("string").alias("next"))
    last = within(asking.where("next is null").unionByName(late)).where("_within")
    turns = numbered(early.where("_within").unionByName(last).drop("_within"), [*by, "poi_id"], "_nth")
    first = turns.groupBy(*by).agg(F.min("_nth").alias("_first"))
    turns = written(turns.join(first, by).withColumn("_block", F.expr(f"(_nth - _first) div {BLOCK_PLACES}")).drop("_first"))
    id_type = {c: df.schema[c].dataType.simpleString() for c, df in (("poi_id", pois), ("mission_id", missions))}
    schema = ", ".join([f"`{c}` {pois.schema[c].dataType.simpleString()}" for c in by] + [f"{c} {t}" for c, t in id_type.items()])

    def taken(key: tuple, places: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        left = {name: iter(g.mission_id) for name, g in free.sort_values("_n").groupby("list")}
        used, out = set(), []
        for place in places.sort_values("_nth").itertuples(index=False):
            found = next((m for name in (place.list, place.next) for m in left.get(name, ()) if m not in used), None)
            if found is not None:
                used.add(found)
                out.append((*key, place.poi_id, found))
        return pd.DataFrame(out, columns=[*by, *id_type])

    held = written(spark.createDataFrame([], schema))
    for block in range((turns.agg(F.max("_block")).first()[0] or 0) + 1):
        now = turns.where(F.col("_block") == block)
        asked = now.select(F.explode(F.array("list", "next")).alias("list")).distinct()
        free = lists.join(asked, "list", "left_semi").join(held.select(*by, "mission_id"), [*by, "mission_id"], "left_anti")
        free = free.withColumn("_n", F.row_number().over(Window.partitionBy("list").orderBy("kind", "mission_id"))).where(F.col("_n") <= BLOCK_PLACES).drop("kind")
        held = held.unionByName(written(now.groupBy(*by).cogroup(free.groupBy(*by)).applyInPandas(taken, schema)))
    return held.select(*by, "poi_id", "mission_id")


def greedy_pairs(candidates: DataFrame, by: list[str], order: tuple[str, ...] = ("rank", "kind"), taker: str = "poi_id", offer: str = "mission_id") -> DataFrame:
    """(by, taker, offer): one-to-one pairs, as if takers came one by one in order and each took its first offer that is free.

    A taker's first offer is the least by `order`, then by id. No group goes through one task: in rounds every taker asks for its
    first offer that is left, an offer is held for the least taker that asks, and whoever stands behind that one loses it for
    good. As takers have one order for all offers, nobody before the holder can be sent away later, so what is left when nobody
    loses anything is the sequential result. Rounds go on until then, and every round that isn't the last takes candidates away.
    """
    place = F.struct(*order, offer)
    left = written(candidates.select(*by, taker, offer, place.alias("place")))
    n = left.count()
    while True:
        wished = left.groupBy(*by, taker).agg(F.min_by(offer, "place").alias(offer))
        held = wished.groupBy(*by, offer).agg(F.min(taker).alias("holder"))
        kept = written(left.join(held, [*by, offer], "left").where(F.col("holder").isNull() | (F.col(taker) <= F.col("holder"))).select(left.columns))
        if (m := kept.count()) == n:
            return wished
        left, n = kept, m


def merge_embassies(pois: DataFrame, missions: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(by, poi_id, mission_id, name, kind, fields, local, name_key): places with their mission's kind and what they lack of `fields`,
    and the missions that no place took.

    local: true for places; for missions their own column `local`, else false. Sort by kind (nulls first), local first, name_key.
    """
    pairs = embassy_pairs(pois, missions, by)
    flag = F.coalesce("local", F.lit(False)) if "local" in missions.columns else F.lit(False)
    m = missions.select(*by, "mission_id", F.col("name").alias("name_m"), F.coalesce(kind_order(F.col("kind")), F.lit(len(MISSION_KINDS))).alias("kind_m"), flag.alias("local_m"), *[F.col(f).alias(f"{f}_m") for f in fields])
    found = pois.join(pairs, [*by, "poi_id"], "left").join(m, [*by, "mission_id"], "left")
    own = found.select(*by, "poi_id", "mission_id", "name", F.coalesce("kind_m", kind_order(F.col("kind"))).alias("kind"), *[F.coalesce(f, f"{f}_m").alias(f) for f in fields], F.lit(True).alias("local"))
    rest = m.join(pairs, [*by, "mission_id"], "left_anti").select(*by, F.lit(None).cast(pois.schema["poi_id"].dataType).alias("poi_id"), "mission_id", F.col("name_m").alias("name"), F.col("kind_m").alias("kind"), *[F.col(f"{f}_m").alias(f) for f in fields], F.col("local_m").alias("local"))
    return own.unionByName(rest).withColumn("name_key", fold(F.col("name")))


def name_clusters(stops: DataFrame, meters: float = 100.0, rounds: int = 60) -> DataFrame:
    """(stop_id, cluster): stops of one folded name, linked at up to so many meters across networks; cluster is the least id.

    stops: stop_id, network, name, lat, lon. Labels go along links, and from each stop's label to that one's own, until none
    changes; so a long chain takes few rounds. Stops of one name, network and place are one in this, by their least id: if one has a
    link, all have.
    """
    own = ["key", "network", "lat", "lon"]
    every = stops.withColumn("key", fold(F.col("name"))).select("stop_id", *own)
    heads = cut(every.groupBy(*own).agg(F.min("stop_id").alias("stop_id")))
    named = heads.withColumns({"cy": F.floor(F.col("lat") * 500), "cx": F.floor(F.col("lon") * 250)})
    near = named.select("key", F.col("stop_id").alias("other"), F.col("network").alias("network_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"), "cx").withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)))
    links = named.join(near, ["key", "cy", "cx"]).where("network <> network_b").where(planar_m(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) <= meters).select("stop_id", "other")
    links = cut(links)
    labels = cut(heads.select("stop_id", F.col("stop_id").alias("cluster")))
    for _ in range(rounds):
        offered = links.join(labels.withColumnsRenamed({"stop_id": "other", "cluster": "c"}), "other").groupBy("stop_id").agg(F.min("c").alias("c"))
        new = cut(labels.join(offered, "stop_id", "left").select("stop_id", F.least("cluster", "c").alias("cluster"), F.col("cluster").alias("was")))
        above = new.select(F.col("stop_id").alias("cluster"), F.col("cluster").alias("top"))
        new = cut(new.join(above, "cluster").select("stop_id", F.col("top").alias("cluster"), (F.col("top") < F.col("was")).alias("changed")))
        labels = new.drop("changed")
        if new.where("changed").isEmpty():
            met = links.join(labels.withColumnsRenamed({"stop_id": "other", "cluster": "c"}), "other").groupBy("stop_id").agg(F.min("c").alias("c"))
            linked = cut(heads.join(met, "stop_id").select(*own, "c"))
            return every.join(linked, own, "left").select("stop_id", F.least("stop_id", "c").alias("cluster"))
    raise RuntimeError("clusters have not settled")


def place_terms(body: str, automaton, terms: list[str]) -> list[tuple[str, int, int]]:
    """(term, start, end) in a body: longest terms first, without overlap, each at the first place that is free for it."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in body)  # as long as body
    found = []
    for last, n in automaton.iter(low):
        start, end = last + 1 - len(terms[n]), last + 1
        if (start == 0 or not low[start - 1].isalnum()) and (end == len(low) or not low[end].isalnum()):
            found.append((n, start, end))
    used, taken, starts = set(), [], []
    for n, start, end in sorted(found):
        if n in used:
            continue
        at = bisect(starts, start)  # taken spans are kept in order and apart, so only the neighbours can overlap
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            used.add(n)
            starts.insert(at, start)
            taken.insert(at, (start, end, n))
    return [(terms[n], start, end) for start, end, n in sorted(taken, key=lambda t: t[2])]


def term_links(sections: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(section_id, term, start, end): longest terms first, without overlap, each once in a section; a bounded vocabulary.

    Letters' case doesn't count, and a term isn't part of a longer run of letters or digits. All places of all terms are found in
    one pass over a section, whatever the number of terms.
    """
    ordered = sorted({t for t in vocabulary if t}, key=lambda t: (-len(t), t))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for n, term in reversed(list(enumerate(ordered))):  # of terms that differ in case alone the first stays
            automaton.add_word("".join(c.lower() if len(c.lower()) == 1 else c for c in term), n)
        automaton.make_automaton()
        for batch in batches:
            out = [(section, *found) for section, body in zip(batch.section_id, batch.body, strict=True) if body and ordered for found in place_terms(body, automaton, ordered)]
            yield pd.DataFrame(out, columns=["section_id", "term", "start", "end"])

    return sections.select("section_id", "body").mapInPandas(run, "section_id long, term string, start int, end int")
