"""Timetables: from feed tables to patterns and service days, and boards with live delays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekmill.functions.clock import runs_on, service_minutes
from trekmill.operators.temporal import as_of, band_join

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def service_days(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, day): weekdays between start and end, exceptions of type 1 added and of type 2 taken away.

    calendar: service_id, seven columns "0"/"1", start_date and end_date as yyyyMMdd; exceptions: service_id, date, exception_type.
    """
    day = lambda c: F.to_date(F.col(c), "yyyyMMdd")
    flags = F.array(*(F.col(d) == "1" for d in DAYS))
    regular = calendar.where(day("end_date") >= day("start_date")).select("service_id", F.explode(runs_on(day("start_date"), day("end_date"), flags)).alias("day"))
    dated = exceptions.select("service_id", day("date").alias("day"), "exception_type")
    all_days = regular.unionByName(dated.where("exception_type = '1'").drop("exception_type")).distinct()
    return all_days.join(dated.where("exception_type = '2'"), ["service_id", "day"], "left_anti")


def boarding_calls(stop_times: DataFrame) -> DataFrame:
    """(trip_id, stop_id, seq, minute): calls at which one may board, the last call of each trip left out."""
    calls = stop_times.select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("seq"), service_minutes(F.col("departure_time")).alias("minute"), "pickup_type")
    last = F.max("seq").over(Window.partitionBy("trip_id"))
    return calls.withColumn("last", last).where("seq < last and coalesce(pickup_type, '') <> '1' and minute is not null").select("trip_id", "stop_id", "seq", "minute")


def patterns(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trips: trip_id, pattern, start; stops: pattern, seq, stop_id, offset). Trips with equal stops and offsets share a pattern.

    A pattern's id is a hash of its stops and offsets, so that no task has to number them all.
    """
    ordered = calls.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "stop_id", "minute"))).alias("c"))
    ordered = ordered.withColumn("start", F.col("c")[0].minute)
    stops = F.transform("c", lambda x: F.struct(x.stop_id.alias("stop_id"), (x.minute - F.col("start")).alias("offset")))
    trips = ordered.select("trip_id", "start", stops.alias("stops")).withColumn("pattern", F.xxhash64("stops"))
    kinds = trips.groupBy("pattern").agg(F.first("stops").alias("stops")).select("pattern", F.posexplode("stops").alias("seq", "s"))
    return trips.select("trip_id", "pattern", "start"), kinds.select("pattern", "seq", "s.stop_id", "s.offset")


def board(trips: DataFrame, stops: DataFrame, days: DataFrame, wanted: DataFrame, today: str, now: int, ahead: int = 180, behind: int = 0, valid_until: str | None = None, grace: int = 3) -> DataFrame:
    """(trip_id, stop_id, day, minute, in_minutes, estimated): departures from `behind` minutes ago to `ahead` minutes on.

    trips: trip_id, service_id, pattern, start; stops: pattern, stop_id, offset; days: service_id, day; wanted: stop_id.
    Yesterday's, today's and tomorrow's service days are met, each with minutes that may pass 24 hours. Up to `grace` days
    past validity the same weekday of the week before stands in and rows are marked as estimated. The window on start + offset
    is a range on start for each wanted stop of a pattern and shift, so trips meet only the stops that they reach in time.
    """
    here = stops.join(wanted, "stop_id", "left_semi")
    base, end = F.lit(today).cast("date"), F.lit(valid_until).cast("date")

    def shifted(n: int):
        day = F.date_add(base, n)
        late = F.coalesce((day > end) & (day <= F.date_add(end, grace)), F.lit(False))
        return F.struct(F.lit(n).alias("shift"), late.alias("estimated"), F.when(late, F.date_sub(day, 7)).otherwise(day).alias("day"))

    asked = here.select("*", F.explode(F.array(*map(shifted, (-1, 0, 1)))).alias("s")).select("pattern", "stop_id", "seq", "offset", "s.*")
    at = F.lit(now) - F.col("shift") * 1440 - F.col("offset")
    spans = asked.withColumns({"from_start": at - behind, "to_start": at + ahead})
    met = band_join(trips, spans, ["pattern"], "start", "from_start", "to_start", ahead + behind + 1)
    calls = met.join(days, ["service_id", "day"]).withColumn("minute", F.col("start") + F.col("offset"))
    calls = calls.withColumn("in_minutes", F.col("minute") + F.col("shift") * 1440 - now)
    return calls.select("trip_id", "stop_id", "day", "minute", "in_minutes", "estimated", "shift", "seq").dropDuplicates(["trip_id", "stop_id", "day", "minute"])


def with_delays(calls: DataFrame, updates: DataFrame, today: str | None = None) -> DataFrame:
    """calls (trip_id, seq, in_minutes, ...) with delay minutes of the last live event at or before their place in the trip.

    updates: trip_id, seq, delay (seconds). With `today` calls have a `day`, and an event is for the run of its own `day` alone, or
    of today if it has none, so that yesterday's and tomorrow's runs of the trip stay as they are. An event without delay stops what came before from going on. Delays of a day or
    more are dropped, others rounded half up to minutes; rows that have left by then go.
    """
    keys = ["trip_id"] if today is None else ["trip_id", "day"]
    if today is not None:
        now = F.lit(today).cast("date")
        updates = updates.withColumn("day", F.coalesce(F.col("day").cast("date"), now) if "day" in updates.columns else now)
    marked = updates.select(*keys, "seq", F.struct(F.col("delay").alias("delay")).alias("live"))
    found = as_of(calls, marked, keys, "seq", "live")
    minutes = F.when(F.abs(F.col("live.delay")) < 86_400, F.floor((F.col("live.delay") + 30) / 60))
    found = found.withColumn("delay", minutes).drop("live")
    return found.withColumn("in_minutes", F.col("in_minutes") + F.coalesce("delay", F.lit(0))).where("in_minutes >= 0")


def merged(board_rows: DataFrame, line: list[str], later: int = 2) -> DataFrame:
    """The next departure of each line, with up to `later` uncancelled ones after it in an array."""
    w = Window.partitionBy(*line).orderBy("in_minutes", "trip_id")
    ranked = board_rows.withColumn("nth", F.row_number().over(w))
    follows = (F.col("nth") > 1) & ~F.col("cancelled")
    ranked = ranked.withColumn("after", F.when(follows, F.sum(follows.cast("int")).over(w))).where(F.col("nth").eqNullSafe(1) | (F.col("after") <= later))
    return ranked.groupBy(*line).agg(F.min("in_minutes").alias("in_minutes"), F.min_by("trip_id", "nth").alias("trip_id"), F.sort_array(F.collect_list(F.when(F.col("after").isNotNull(), F.col("in_minutes")))).alias("later"))


def trip_detail(trip_stops: DataFrame, updates: DataFrame) -> DataFrame:
    """All stops of trips with live delays, whether they have been passed or not."""
    return with_delays(trip_stops.withColumn("in_minutes", F.lit(1 << 20)), updates).drop("in_minutes")
