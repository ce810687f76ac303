"""Departures with live events: runs matched to a feed's trips, the passage at a stop, and delays carried forward.

A feed is two tables. trips: trip_ref (number in the feed's order), trip_id, start_date, cancelled, deleted, delay (seconds), and
route_id, direction_id, start_time (seconds of the service day) for trips that have no trip_id. stops: trip_ref, pos (place in the
trip's list), stop_id, time (epoch seconds), delay (seconds), skipped, no_data, from_arrival (time is an arrival's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekmill.operators.lineage import written
from trekmill.operators.temporal import as_of

#: A delay of so many seconds is an error of the feed.
ABSURD = 86_400
_RUN = ["trip_id", "day", "route_id", "direction_id", "start_time"]


def _key(kind: int, name: Column, direction: Column, day: Column, start: Column) -> Column:
    fill = lambda c, kind, none: F.coalesce(c.cast(kind), F.lit(none).cast(kind))
    return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), fill(direction, "int", -1).alias("direction"), fill(day, "date", "1970-01-01").alias("day"), fill(start, "int", -1).alias("start"))


def match_runs(runs: DataFrame, trips: DataFrame) -> DataFrame:
    """(trip_id, day, route_id, direction_id, start_time, trip_ref): the feed's trip of each distinct run that has one.

    The trip of the same id and day goes first (the first in the feed), then the id's only trip without a date, then the first
    trip without an id that has the run's route, direction, day and start. All candidates are one table with a priority in
    their key, so runs meet them in a single join.
    """
    none = F.lit(None)
    id_, date = F.col("trip_id"), F.col("start_date")
    named, dated = id_.isNotNull(), date.isNotNull()
    keyed = ~named & dated & F.col("route_id").isNotNull() & F.col("start_time").isNotNull()
    key = F.when(named & dated, _key(0, id_, none, date, none)).when(named, _key(1, id_, none, none, none)).when(keyed, _key(2, F.col("route_id"), F.col("direction_id"), date, F.col("start_time")))
    offers = trips.select(key.alias("key"), "trip_ref").where("key is not null").groupBy("key").agg(F.min("trip_ref").alias("trip_ref"), F.count("*").alias("n")).where("key.kind <> 1 or n = 1")
    wanted = F.filter(
        F.array(
            F.when(named, _key(0, id_, none, F.col("day"), none)),
            F.when(named, _key(1, id_, none, none, none)),
            F.when(F.col("route_id").isNotNull() & F.col("start_time").isNotNull(), _key(2, F.col("route_id"), F.col("direction_id"), F.col("day"), F.col("start_time"))),
        ),
        lambda k: k.isNotNull(),
    )
    asked = runs.select(*_RUN).distinct().withColumn("key", F.explode(wanted))
    return asked.join(offers, "key").groupBy(*_RUN).agg(F.min_by("trip_ref", "key.kind").alias("trip_ref"))


def passages(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """calls (trip_ref, stop_id, scheduled, distinct) with `at`: the feed's event at the stop, of several the nearest in planned time.

    Events without a time come after all others; of equal ones the first in the list counts.
    """
    off = F.coalesce(F.abs(F.col("time") - F.coalesce("delay", F.lit(0)) - F.col("scheduled")), F.lit((1 << 63) - 1))
    event = F.struct("time", "delay", "skipped", "no_data", "from_arrival")
    found = calls.join(stops, ["trip_ref", "stop_id"]).groupBy("trip_ref", "stop_id", "scheduled").agg(F.min_by(event, F.struct(off.alias("off"), "pos")).alias("at"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("trip_ref", "stop_id", "scheduled")]
    return calls.alias("c").join(found.alias("f"), same[0] & same[1] & same[2], "left").select("c.*", "f.at")


def carried(calls: DataFrame, stops: DataFrame, trips: DataFrame) -> DataFrame:
    """calls (trip_ref, scheduled, ...) with `carried`: seconds of delay of the last event planned at or before.

    Only events with time and delay that aren't skipped have a place in time; of equal places the first counts. A later event
    of the list without data blocks what comes before it. If a trip has events but none before, nothing is carried; if it has
    none at all, the trip's own delay is.
    """
    own = stops.withColumn("planned", F.when(~F.col("skipped"), F.col("time") - F.col("delay")))
    about = own.groupBy("trip_ref").agg(F.max(F.when(F.col("no_data"), F.col("pos"))).alias("last_barrier"), F.count("planned").alias("n_planned"))
    # a barrier's last place is enough: an event is blocked if any barrier stands after it
    marks = own.where("planned is not null").join(about, "trip_ref").select("trip_ref", F.col("planned").alias("scheduled"), F.struct((-F.col("pos")).alias("first"), F.col("delay"), F.coalesce(F.col("last_barrier") > F.col("pos"), F.lit(False)).alias("blocked")).alias("mark"))
    seen = as_of(calls, marks, ["trip_ref"], "scheduled", "mark")
    seen = seen.join(about.select("trip_ref", "n_planned"), "trip_ref", "left").join(trips.select("trip_ref", F.col("delay").alias("trip_delay")), "trip_ref", "left")
    delay = F.when(F.col("mark").isNotNull(), F.when(~F.col("mark.blocked"), F.col("mark.delay"))).when(F.coalesce("n_planned", F.lit(0)) == 0, F.col("trip_delay"))
    return seen.withColumn("carried", delay).drop("mark", "n_planned", "trip_delay")


def resolve(calls: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """calls with `cancelled` and `delay` (minutes, null without live data); in_minutes moves with the delay.

    calls: trip_id, day, stop_id, scheduled (epoch seconds), in_minutes, estimated, and perhaps route_id, direction_id and
    start_time. Rows of deleted trips go, estimated rows stay as they are. A cancelled trip or skipped stop cancels; a stop
    without data has no delay; else the stop's own delay counts, or its time against the schedule in whole minutes (not an
    arrival's), or what is carried forward. Minutes are rounded half up; delays of a day or more don't count.

    The matched calls and the places asked for are written, since several joins read them; trips and stops are read several times too.
    """
    calls = calls.withColumns({c: F.lit(None).cast(t) for c, t in (("route_id", "string"), ("direction_id", "int"), ("start_time", "int")) if c not in calls.columns})
    calls = calls.withColumns({"trip_id": F.col("trip_id").cast("string"), "route_id": F.col("route_id").cast("string")})
    trips = trips.withColumns({"trip_id": F.col("trip_id").cast("string"), "route_id": F.col("route_id").cast("string")})
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("skipped", "no_data", "from_arrival")}
    stops, added = stops.withColumns(flags), [c for c in calls.columns if c not in ("cancelled", "delay")]
    live = calls.where("not coalesce(estimated, false)")
    found = match_runs(live, trips).join(trips.select("trip_ref", F.coalesce("cancelled", F.lit(False)).alias("off"), F.coalesce("deleted", F.lit(False)).alias("deleted")), "trip_ref")
    same = F.lit(True)
    for k in _RUN:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}"))
    met = written(calls.alias("c").join(found.alias("r"), same & ~F.coalesce(F.col("c.estimated"), F.lit(False)), "left").where("not coalesce(r.deleted, false)").select("c.*", "r.trip_ref", "r.off"))
    keys = ["trip_ref", "stop_id", "scheduled"]
    asked = written(met.where("trip_ref is not null").select(*keys).distinct())
    told = carried(passages(asked, stops), stops, trips)
    late = F.least(F.greatest(F.floor((F.col("at.time") - F.col("scheduled")) / 60) * 60, F.lit(-ABSURD)), F.lit(ABSURD))
    seconds = F.when(F.col("at.no_data"), None).otherwise(F.coalesce(F.col("at.delay"), F.when(~F.col("at.from_arrival"), late), F.col("carried")))
    told = told.select(*keys, F.coalesce("at.skipped", F.lit(False)).alias("skipped"), seconds.alias("seconds"))
    joined = met.alias("m").join(told.alias("t"), (F.col("m.trip_ref") == F.col("t.trip_ref")) & F.col("m.stop_id").eqNullSafe(F.col("t.stop_id")) & (F.col("m.scheduled") == F.col("t.scheduled")), "left")
    off = F.coalesce(F.col("m.off") | F.col("t.skipped"), F.lit(False))
    minutes = F.when(~off & (F.abs(F.col("t.seconds")) < ABSURD), F.floor((F.col("t.seconds") + 30) / 60).cast("int"))
    return joined.select(*[F.col(f"m.{c}") for c in added], off.alias("cancelled"), minutes.alias("delay")).withColumn("in_minutes", F.col("in_minutes") + F.coalesce("delay", F.lit(0)))
