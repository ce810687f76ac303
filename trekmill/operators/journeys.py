"""Earliest arrival by rounds: each round boards once more, and all stops and trips are met by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekmill.operators.lineage import cut, written
from trekmill.operators.relational import numbered


def earliest_arrivals(calls: DataFrame, footpaths: DataFrame, access: DataFrame, rounds: int = 4, change: int = 1) -> DataFrame:
    """(stop_id, round, arrival): the arrivals that are better than with fewer rides.

    calls: trip_id, seq, stop_id, arrival, departure (minutes); footpaths: from_id, to_id, walk; access: stop_id, arrival.
    Round 0 walks. A round boards wherever a departure isn't before the last round's arrival (and `change` minutes after it, if
    that came by vehicle), rides on to all later calls of the trip, and walks on from stops reached by vehicle. Only
    the first boarding place of a trip counts: later ones reach no more. Rounds are few and fixed; each is checkpointed.
    """
    best = access.groupBy("stop_id").agg(F.min("arrival").alias("arrival")).select("stop_id", "arrival", F.lit(0).alias("round"), F.lit(False).alias("by_vehicle"))
    frontier, all_rows = best, best
    for k in range(1, rounds + 1):
        ready = F.col("f.arrival") + F.when(F.col("f.by_vehicle"), change).otherwise(0)
        boarded = calls.alias("c").join(frontier.alias("f"), F.col("c.stop_id") == F.col("f.stop_id")).where(F.col("c.departure") >= ready)
        boarded = boarded.groupBy(F.col("c.trip_id").alias("trip_id")).agg(F.min("c.seq").alias("from_seq"))
        ridden = calls.join(boarded, "trip_id").where("seq > from_seq").groupBy("stop_id").agg(F.min("arrival").alias("arrival")).withColumn("by_vehicle", F.lit(True))
        walked = ridden.join(footpaths, ridden.stop_id == footpaths.from_id).select(F.col("to_id").alias("stop_id"), (F.col("arrival") + F.col("walk") + change).alias("arrival"), F.lit(False).alias("by_vehicle"))
        reached = ridden.unionByName(walked).groupBy("stop_id").agg(F.min(F.struct("arrival", (~F.col("by_vehicle")).alias("walked"))).alias("a")).select("stop_id", "a.arrival", (~F.col("a.walked")).alias("by_vehicle"))
        known = all_rows.groupBy("stop_id").agg(F.min("arrival").alias("known"))
        better = reached.join(known, "stop_id", "left").where("known is null or arrival < known")
        frontier = cut(better.select("stop_id", "arrival", F.lit(k).alias("round"), "by_vehicle"))
        all_rows = all_rows.unionByName(frontier)
    return all_rows.drop("by_vehicle")


def itineraries(arrivals: DataFrame, target: DataFrame) -> DataFrame:
    """(round, arrival) at the target (stop_id, walk) for each round that is strictly better than all with fewer rides."""
    there = arrivals.join(target, "stop_id").groupBy("round").agg(F.min(F.col("arrival") + F.col("walk")).alias("arrival"))
    before = F.min("arrival").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1))  # a row for each round
    return there.withColumn("before", before).where("before is null or arrival < before").select("round", "arrival")


#: More stops than there can be: arrivals times this plus a stop's number are whole numbers of 63 bits.
_STOPS = 1 << 32
_LABEL = ["query_id", "stop_id", "round", "by_vehicle", "arrival", "from_stop", "from_round", "from_vehicle", "departure", "trip_id", "from_seq", "to_seq"]


def journeys(calls: DataFrame, footpaths: DataFrame, access: DataFrame, egress: DataFrame, rounds: int = 4, change: int = 1) -> DataFrame:
    """(query_id, rides, leg, kind, from_stop, to_stop, departure, arrival, trip_id, from_seq, to_seq): the best journeys, leg by leg.

    calls: trip_id, seq, stop_id, arrival, departure (minutes), perhaps can_board and can_alight; footpaths: from_id, to_id, walk
    (minutes, `change` is added); access: query_id, stop_id, depart, walk; egress: query_id, stop_id, walk. Every query is
    planned, all of them together. For each number of rides there is the journey that arrives first, if that is before all with
    fewer rides. from_stop is null for the first walk and to_stop for the last; the first walk leaves as late as its ride allows.

    A round boards once more where the last one arrived better than before, at the first such call of a trip, then rides and walks.
    What doesn't beat the stop's best arrival, or the target's, goes at once. Every label keeps where it came from, and journeys
    are put together by joins backwards. Of equal arrivals the ride goes before the walk, then the least trip, then its first call.

    What minima are taken of is one number, so they are hash aggregates whose memory is their groups': calls are numbered by arrival,
    trip and place once, stops that were ridden to once a round. The rest of a label is joined to its number.
    """
    for flag in ("can_board", "can_alight"):
        calls = calls.withColumn(flag, F.coalesce(flag, F.lit(True)) if flag in calls.columns else F.lit(True))
    calls = calls.select("trip_id", F.col("seq").cast("long").alias("seq"), "stop_id", F.col("arrival").cast("long").alias("arrival"), F.col("departure").cast("long").alias("departure"), "can_board", "can_alight")
    calls = written(numbered(calls, ["arrival", "trip_id", "seq"], "nth"))
    none = {c: F.lit(None).cast(t) for c, t in (("from_stop", calls.schema["stop_id"].dataType), ("from_round", "int"), ("from_vehicle", "boolean"), ("departure", "long"), ("trip_id", calls.schema["trip_id"].dataType), ("from_seq", "long"), ("to_seq", "long"))}
    start = access.groupBy("query_id", "stop_id").agg(F.min(F.col("depart") + F.col("walk")).cast("long").alias("arrival"))
    frontier = written(start.withColumns({"round": F.lit(0), "by_vehicle": F.lit(False), **none}).select(_LABEL))
    labels, known = [frontier], frontier.select("query_id", "stop_id", "arrival")
    target = written(frontier.select("query_id").distinct().withColumn("by", F.lit(None).cast("long")))
    walk_out = egress.groupBy("query_id", "stop_id").agg(F.min("walk").cast("long").alias("out"))
    ends = []

    def better(found: DataFrame, known: DataFrame) -> DataFrame:
        """Rows of found that beat the stop's best and the target's."""
        best = known.groupBy("query_id", "stop_id").agg(F.min("arrival").alias("best"))
        far = F.lit((1 << 63) - 1)
        both = found.join(best, ["query_id", "stop_id"], "left").join(target, "query_id")
        return both.where(F.col("arrival") < F.least(F.coalesce("best", far), F.coalesce("by", far))).drop("best", "by")

    for k in range(1, rounds + 1):
        ready = F.col("f.arrival") + F.when(F.col("f.by_vehicle"), change).otherwise(0)
        boardable = calls.where("can_board").alias("c").join(frontier.alias("f"), F.col("c.stop_id") == F.col("f.stop_id")).where(F.col("c.departure") >= ready)
        boarded = written(boardable.groupBy("f.query_id", "c.trip_id").agg(F.min("c.seq").alias("from_seq")))
        out = calls.where("can_alight and arrival is not null").select("trip_id", F.col("seq").alias("to_seq"), "stop_id", "arrival", "nth")
        first = out.join(boarded, "trip_id").where("to_seq > from_seq").groupBy("query_id", "stop_id").agg(F.min("nth").alias("nth"))
        first = better(first.join(out.drop("stop_id"), "nth").select("query_id", "stop_id", "arrival", "trip_id", "to_seq"), known).join(boarded, ["query_id", "trip_id"])
        place = F.struct(F.col("c.stop_id").alias("from_stop"), "c.departure", F.col("f.by_vehicle").alias("from_vehicle"))
        places = first.select("query_id", "trip_id", "from_seq").distinct().alias("b").join(calls.where("can_board").alias("c"), (F.col("b.trip_id") == F.col("c.trip_id")) & (F.col("b.from_seq") == F.col("c.seq")))
        places = places.join(frontier.alias("f"), (F.col("c.stop_id") == F.col("f.stop_id")) & (F.col("b.query_id") == F.col("f.query_id"))).where(F.col("c.departure") >= ready)
        places = places.groupBy("b.query_id", "b.trip_id").agg(F.min(place).alias("at"))  # of calls with the same seq
        ridden = first.join(places, ["query_id", "trip_id"]).select("query_id", "stop_id", "arrival", "trip_id", "to_seq", "from_seq", "at.*")
        ridden = written(ridden.withColumns({"round": F.lit(k), "by_vehicle": F.lit(True), "from_round": F.lit(k - 1)}).select(_LABEL))
        numbers = numbered(ridden.select(F.col("stop_id").alias("from_stop")).distinct(), ["from_stop"], "stop_nth")
        ways = written(ridden.select("query_id", F.col("stop_id").alias("from_stop"), F.col("arrival").alias("departure")).join(numbers, "from_stop"))
        met = ways.join(footpaths, F.col("from_stop") == F.col("from_id")).select("query_id", F.col("to_id").alias("stop_id"), ((F.col("departure") + F.col("walk") + change).cast("long") * _STOPS + F.col("stop_nth")).alias("key"))
        walked = met.groupBy("query_id", "stop_id").agg(F.min("key").alias("key")).withColumns({"arrival": F.shiftright("key", 32), "stop_nth": F.pmod("key", F.lit(_STOPS))}).drop("key")
        both = known.unionByName(ridden.select("query_id", "stop_id", "arrival"))
        walked = better(walked, both).join(ways, ["query_id", "stop_nth"]).withColumns({**{c: none[c] for c in ("trip_id", "from_seq", "to_seq")}, "round": F.lit(k), "by_vehicle": F.lit(False), "from_round": F.lit(k), "from_vehicle": F.lit(True)}).select(_LABEL)
        made = written(ridden.unionByName(walked))  # a walk is there only if it beats the ride to its stop
        labels.append(made)
        best_label = F.min(F.struct("arrival", (~F.col("by_vehicle")).alias("walked"))).alias("l")
        frontier = written(made.groupBy("query_id", "stop_id").agg(best_label).select("query_id", "stop_id", "l.arrival", (~F.col("l.walked")).alias("by_vehicle")))
        known = known.unionByName(frontier.select("query_id", "stop_id", "arrival"))
        exits = frontier.join(ridden.select("query_id", "stop_id"), ["query_id", "stop_id"], "left_semi").join(walk_out, ["query_id", "stop_id"]).join(target, "query_id")
        total = F.col("arrival") + F.col("out")
        exits = exits.where("by is null or arrival + out < by").groupBy("query_id").agg(F.min(F.struct(total.alias("total"), "stop_id", "by_vehicle", "arrival")).alias("e"))
        exits = written(exits.select("query_id", F.lit(k).alias("rides"), "e.*"))
        ends.append(exits)
        target = written(target.join(exits.select("query_id", "total"), "query_id", "left").select("query_id", F.coalesce("total", "by").alias("by")))
    all_labels, all_ends = _union(labels), _union(ends)
    at = all_ends.select("query_id", "rides", F.lit(1).alias("back"), "stop_id", F.col("rides").alias("round"), "by_vehicle")
    legs = [all_ends.select("query_id", "rides", F.lit(0).alias("back"), F.lit("walk").alias("kind"), F.col("stop_id").alias("from_stop"), none["from_stop"].alias("to_stop"), F.col("arrival").alias("departure"), F.col("total").alias("arrival"), *[none[c].alias(c) for c in ("trip_id", "from_seq", "to_seq")])]
    for _ in range(2 * rounds):  # a ride and a walk a round at most
        met = written(at.join(all_labels, ["query_id", "stop_id", "round", "by_vehicle"]).where("from_stop is not null"))  # else joins would be nested
        legs.append(met.select("query_id", "rides", "back", F.when(F.col("by_vehicle"), "ride").otherwise("walk").alias("kind"), "from_stop", F.col("stop_id").alias("to_stop"), "departure", "arrival", "trip_id", "from_seq", "to_seq"))
        at = met.select("query_id", "rides", (F.col("back") + 1).alias("back"), F.col("from_stop").alias("stop_id"), F.col("from_round").alias("round"), F.col("from_vehicle").alias("by_vehicle"))
    rode = written(_union(legs))
    first = rode.groupBy("query_id", "rides").agg(F.max("back").alias("last"), F.max_by("from_stop", "back").alias("stop_id"), F.max_by("departure", "back").alias("arrival"))
    out = first.join(access.groupBy("query_id", "stop_id").agg(F.min_by("walk", F.col("depart") + F.col("walk")).cast("long").alias("walk")), ["query_id", "stop_id"])
    out = out.select("query_id", "rides", (F.col("last") + 1).alias("back"), F.lit("walk").alias("kind"), none["from_stop"].alias("from_stop"), F.col("stop_id").alias("to_stop"), (F.col("arrival") - F.col("walk")).alias("departure"), "arrival", *[none[c].alias(c) for c in ("trip_id", "from_seq", "to_seq")])
    nth = F.row_number().over(Window.partitionBy("query_id", "rides").orderBy(F.desc("back")))
    return rode.unionByName(out).withColumn("leg", nth).select("query_id", "rides", "leg", "kind", "from_stop", "to_stop", "departure", "arrival", "trip_id", "from_seq", "to_seq")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
