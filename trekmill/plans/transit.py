"""Timetables: feeds to patterns, boards with live delays, journeys, nearby stops, matches of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trekmill.functions import clock, geo, markup
from trekmill.operators import journeys, live, matching, relational, spatial, timetable
from trekmill.operators.lineage import written
from trekmill.plans.base import HAVERSINE, PLACE, PLANAR, STOP, degrees, places, plan, stops, table

#: Calls of trips: one for each order and line number, at a supplier's stop.
CALL = """call AS (SELECT l_orderkey AS trip_id, l_linenumber AS seq, min(l_suppkey) AS stop_id, (l_orderkey * 13) % 1500 + l_linenumber * 7 AS minute FROM lineitem GROUP BY l_orderkey, l_linenumber),
ended AS (SELECT *, max(seq) OVER (PARTITION BY trip_id) AS final FROM call), riding AS (SELECT trip_id, seq, stop_id, minute, row_number() OVER (PARTITION BY trip_id ORDER BY seq) - 1 AS pos FROM ended WHERE seq < final)"""
#: Days of January on which each of seven services runs.
DAY = "running AS (SELECT s AS service_id, DATE '2024-01-01' + CAST(d AS INTEGER) AS day FROM range(7) a(s), range(31) b(d) WHERE (s + d) % 3 <> 0)"
TODAY, VALID = "2024-01-10", "2024-01-09"
_ASKED = f"""asked AS (SELECT shift, d > DATE '{VALID}' AND d <= DATE '{VALID}' + 3 AS estimated, CASE WHEN d > DATE '{VALID}' AND d <= DATE '{VALID}' + 3 THEN d - 7 ELSE d END AS day FROM (SELECT shift, DATE '{TODAY}' + CAST(shift AS INTEGER) AS d FROM (SELECT unnest([-1, 0, 1]) AS shift)))"""
BOARD = f"""{CALL}, {DAY}, {_ASKED}, board AS (SELECT trip_id, stop_id, pos, day, minute, minute + shift * 1440 - 600 AS in_minutes, estimated FROM riding JOIN running ON trip_id % 7 = service_id JOIN asked USING (day) WHERE stop_id <= 40 AND minute + shift * 1440 - 600 BETWEEN -60 AND 180)"""
LIVE = f"""{BOARD}, news AS (SELECT trip_id, pos, CASE WHEN trip_id % 11 = 0 THEN NULL WHEN trip_id % 13 = 0 THEN 90000 ELSE (trip_id * 31 + pos * 17) % 1200 - 200 END AS delay FROM riding WHERE trip_id % 3 = 0 AND pos % 2 = 0),
known AS (SELECT b.*, n.delay AS seconds FROM board b ASOF LEFT JOIN news n ON b.trip_id = n.trip_id AND b.pos >= n.pos),
live AS (SELECT * EXCLUDE (in_minutes), in_minutes + coalesce(delay, 0) AS in_minutes FROM (SELECT * EXCLUDE (seconds), CASE WHEN abs(seconds) < 86400 THEN CAST(floor((seconds + 30) / 60.0) AS BIGINT) END AS delay FROM known) WHERE in_minutes + coalesce(delay, 0) >= 0)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_suppkey").alias("stop_id"))
    return line.withColumn("minute", F.col("trip_id") * 13 % 1500 + F.col("seq") * 7)


def _stop_times(spark: SparkSession, d: str) -> DataFrame:
    """The calls as a feed writes them: clock texts that may pass 24 hours, and text numbers."""
    at = F.format_string("%02d:%02d:00", F.floor(F.col("minute") / 60).cast("int"), (F.col("minute") % 60).cast("int"))
    return _calls(spark, d).select("trip_id", "stop_id", F.col("seq").cast("string").alias("stop_sequence"), at.alias("departure_time"), F.lit("").alias("pickup_type"))


def _timetable(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    trips, calls = timetable.patterns(timetable.boarding_calls(_stop_times(spark, d)))
    months = spark.range(7).select(F.col("id").alias("service_id"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k")).where("(service_id + k) % 3 <> 0")
    days = months.select("service_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("day"))
    return trips.withColumn("service_id", F.col("trip_id") % 7), calls, days


def _board(spark: SparkSession, d: str) -> DataFrame:
    trips, calls, days = _timetable(spark, d)
    wanted = table(spark, d, "supplier").where("s_suppkey <= 40").select(F.col("s_suppkey").alias("stop_id"))
    return timetable.board(trips, calls, days, wanted, TODAY, 600, ahead=180, behind=60, valid_until=VALID)


def _news(spark: SparkSession, d: str) -> DataFrame:
    """Live events by place in the trip, from 0; some without delay, some with one of more than a day."""
    calls = timetable.boarding_calls(_stop_times(spark, d))
    place = F.row_number().over(Window.partitionBy("trip_id").orderBy("seq")) - 1
    t = F.col("trip_id")
    delay = F.when(t % 11 == 0, None).when(t % 13 == 0, 90_000).otherwise((t * 31 + F.col("seq") * 17) % 1200 - 200)
    return calls.select("trip_id", place.alias("seq")).where("trip_id % 3 = 0 and seq % 2 = 0").select("trip_id", "seq", delay.alias("delay"))


@plan("q13_patterns", f"""WITH {CALL}, p AS (SELECT trip_id, string_agg(stop_id || ':' || minute - start, ',' ORDER BY seq) AS stops FROM (SELECT *, first_value(minute) OVER (PARTITION BY trip_id ORDER BY seq) AS start FROM riding) GROUP BY trip_id)
SELECT stops, count(*) AS trips, min(trip_id) AS first_trip FROM p GROUP BY stops""")
def feed_patterns(spark, d):
    """From a feed's stop times to patterns of stops and offsets, and how many trips share each."""
    trips, calls, _ = _timetable(spark, d)
    text = calls.groupBy("pattern").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "stop_id", "offset"))), lambda x: F.concat_ws(":", x.stop_id, x.offset)), ",").alias("stops"))
    counts = trips.groupBy("pattern").agg(F.count("*").alias("trips"), F.min("trip_id").alias("first_trip"))
    return text.join(counts, "pattern").select("stops", "trips", "first_trip")


@plan("c12_service_days", """WITH s AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 12 AS INTEGER) - 1 AS b, o_custkey FROM orders),
r AS (SELECT id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s WHERE b >= a)
((SELECT id AS service_id, day FROM r WHERE isodow(day) IN (1, 2, 3, 6)) UNION (SELECT id, b + 3 FROM s WHERE o_custkey % 2 = 0)) EXCEPT (SELECT id, a + 1 FROM s WHERE o_custkey % 5 = 0)""")
def feed_service_days(spark, d):
    o = table(spark, d, "orders").withColumns({"a": F.to_date("o_orderdate"), "b": F.expr("date_add(to_date(o_orderdate), cast(o_custkey % 12 - 1 as int))")})
    text = lambda c: F.date_format(c, "yyyyMMdd")
    flags = {day: F.lit("1" if i in (0, 1, 2, 5) else "0") for i, day in enumerate(timetable.DAYS)}
    calendar = o.select(F.col("o_orderkey").alias("service_id"), text("a").alias("start_date"), text("b").alias("end_date")).withColumns(flags)
    added = o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("service_id"), text(F.date_add("b", 3)).alias("date"), F.lit("1").alias("exception_type"))
    removed = o.where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("service_id"), text(F.date_add("a", 1)).alias("date"), F.lit("2").alias("exception_type"))
    return timetable.service_days(calendar, added.unionByName(removed))


@plan("q1_departures", f"WITH {BOARD} SELECT trip_id, stop_id, day, minute, in_minutes, estimated FROM board")
def departures(spark, d):
    """Departures of three service days around now, the last days of a lapsed timetable marked as estimated."""
    return _board(spark, d).select("trip_id", "stop_id", "day", F.col("minute").cast("long"), F.col("in_minutes").cast("long"), "estimated")


@plan("q1_live_board", f"WITH {LIVE} SELECT trip_id, stop_id, day, delay, in_minutes FROM live")
def live_board(spark, d):
    """The board with delays of the last live event at or before each call."""
    return timetable.with_delays(_board(spark, d), _news(spark, d)).select("trip_id", "stop_id", "day", F.col("delay").cast("long"), F.col("in_minutes").cast("long"))


#: A feed over the calls: dated and undated trips, some twice, trips known by route and start alone, events of all kinds.
FEED = f"""{CALL}, run AS (SELECT trip_id, min(minute) * 60 AS start_time FROM call GROUP BY trip_id),
feed AS (SELECT trip_id * 10 + 1 AS trip_ref, trip_id, CASE WHEN trip_id % 3 > 0 THEN DATE '{TODAY}' END AS start_date, NULL AS route_id, NULL AS start_time, trip_id % 17 = 0 AS cancelled, trip_id % 19 = 0 AS deleted, CASE WHEN trip_id % 5 = 0 THEN trip_id % 900 END AS delay, trip_id AS of FROM run WHERE trip_id % 2 = 0
UNION ALL SELECT trip_id * 10 + 2, trip_id, NULL, NULL, NULL, false, false, 120, trip_id FROM run WHERE trip_id % 12 = 0
UNION ALL SELECT trip_id * 10 + 3, NULL, DATE '{TODAY}', trip_id % 50, start_time, trip_id % 13 = 0, false, 300, trip_id FROM run WHERE trip_id % 4 = 1),
fstop AS (SELECT trip_ref, seq AS pos, stop_id, CASE WHEN (of + seq) % 6 > 0 THEN epoch(DATE '{TODAY}') + minute * 60 + (of * 31 + seq * 17) % 1500 - 300 END AS time, CASE WHEN (of + seq) % 4 > 0 THEN (of * 31 + seq * 17) % 1200 - 200 + CASE WHEN of % 29 = 0 THEN 90000 ELSE 0 END END AS delay,
(of + seq) % 23 = 0 AS skipped, (of * 3 + seq) % 13 = 0 AS no_data, (of + seq) % 3 = 0 AS from_arrival FROM feed JOIN call ON call.trip_id = of WHERE (of + seq * 3) % 5 < 3 AND of % 14 > 0)"""


def _feed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    calls = written(_calls(spark, d))
    run = written(calls.groupBy("trip_id").agg((F.min("minute") * 60).cast("int").alias("start_time")))
    t, none, day = F.col("trip_id"), F.lit(None), F.lit(TODAY).cast("date")
    row = lambda n, id_, date, route, start, cancelled, deleted, delay: [(t * 10 + n).alias("trip_ref"), id_.cast("string").alias("trip_id"), date.cast("date").alias("start_date"), route.cast("string").alias("route_id"), none.cast("int").alias("direction_id"), start.cast("int").alias("start_time"), cancelled.alias("cancelled"), deleted.alias("deleted"), delay.cast("long").alias("delay"), t.alias("of")]
    no = F.lit(False)
    trips = run.where(t % 2 == 0).select(*row(1, t, F.when(t % 3 > 0, day), none, none, t % 17 == 0, t % 19 == 0, F.when(t % 5 == 0, t % 900)))
    trips = trips.unionByName(run.where(t % 12 == 0).select(*row(2, t, none, none, none, no, no, F.lit(120))))
    trips = trips.unionByName(run.where(t % 4 == 1).select(*row(3, none, day, t % 50, F.col("start_time"), t % 13 == 0, no, F.lit(300))))
    of, seq = F.col("of"), F.col("seq")
    met = trips.select("trip_ref", "of").join(calls, F.col("of") == calls.trip_id).where(((of + seq * 3) % 5 < 3) & (of % 14 > 0))
    noise = of * 31 + seq * 17
    stops = met.select("trip_ref", seq.alias("pos"), "stop_id", F.when((of + seq) % 6 > 0, F.unix_timestamp(day.cast("timestamp")) + F.col("minute") * 60 + noise % 1500 - 300).alias("time"), F.when((of + seq) % 4 > 0, noise % 1200 - 200 + F.when(of % 29 == 0, 90_000).otherwise(0)).alias("delay"), ((of + seq) % 23 == 0).alias("skipped"), ((of * 3 + seq) % 13 == 0).alias("no_data"), ((of + seq) % 3 == 0).alias("from_arrival"))
    asked = calls.join(run, "trip_id").select("trip_id", "seq", "stop_id", day.alias("day"), (F.unix_timestamp(day.cast("timestamp")) + F.col("minute") * 60).alias("scheduled"), (F.col("minute") - 600).alias("in_minutes"), (t % 31 == 0).alias("estimated"), (t % 50).cast("string").alias("route_id"), "start_time")
    return asked, trips.drop("of"), written(stops)


@plan("q1_realtime", f"""WITH {FEED}, asked AS (SELECT c.*, r.start_time, epoch(DATE '{TODAY}') + minute * 60 AS scheduled, c.trip_id % 31 = 0 AS estimated,
  CASE WHEN c.trip_id % 31 > 0 THEN coalesce((SELECT min(trip_ref) FROM feed f WHERE f.trip_id = c.trip_id AND start_date = DATE '{TODAY}'), (SELECT CASE WHEN count(*) = 1 THEN min(trip_ref) END FROM feed f WHERE f.trip_id = c.trip_id AND start_date IS NULL),
  (SELECT min(trip_ref) FROM feed f WHERE f.trip_id IS NULL AND f.route_id = c.trip_id % 50 AND f.start_time = r.start_time)) END AS trip_ref FROM call c JOIN run r USING (trip_id)),
m AS (SELECT a.*, f.cancelled AS off, f.delay AS trip_delay FROM asked a LEFT JOIN feed f USING (trip_ref) WHERE NOT coalesce(f.deleted, false)),
here AS (SELECT m.trip_id, m.seq, arg_min({{'time': time, 'delay': s.delay, 'skipped': skipped, 'no_data': no_data, 'from_arrival': from_arrival}}, (coalesce(abs(time - coalesce(s.delay, 0) - scheduled), 1e18), pos)) AS p FROM m JOIN fstop s USING (trip_ref, stop_id) GROUP BY ALL),
planned AS (SELECT trip_ref, pos, delay, time - delay AS planned, EXISTS (SELECT 1 FROM fstop b WHERE b.trip_ref = s.trip_ref AND b.pos > s.pos AND b.no_data) AS blocked FROM fstop s WHERE time - delay IS NOT NULL AND NOT skipped),
before AS (SELECT m.trip_id, m.seq, arg_max({{'delay': p.delay, 'blocked': blocked}}, (planned, -pos)) AS b FROM m JOIN planned p ON m.trip_ref = p.trip_ref AND planned <= scheduled GROUP BY ALL),
s AS (SELECT m.*, p, coalesce(off OR p.skipped, false) AS cancelled, CASE WHEN p.no_data THEN NULL ELSE coalesce(p.delay, CASE WHEN NOT p.from_arrival THEN greatest(least(floor((p.time - scheduled) / 60) * 60, 86400), -86400) END,
  CASE WHEN b IS NOT NULL THEN CASE WHEN NOT b.blocked THEN b.delay END WHEN trip_ref NOT IN (SELECT trip_ref FROM planned) THEN trip_delay END) END AS seconds FROM m LEFT JOIN here USING (trip_id, seq) LEFT JOIN before USING (trip_id, seq)),
r AS (SELECT *, CASE WHEN NOT cancelled AND abs(seconds) < 86400 THEN CAST(floor((seconds + 30) / 60) AS BIGINT) END AS minutes FROM s)
SELECT trip_id, seq, stop_id, cancelled, minutes AS delay, minute - 600 + coalesce(minutes, 0) AS in_minutes FROM r""")
def realtime(spark, d):
    """All of a day's calls with live events: matched by id and day, by id alone, by route and start; barriers, skips, arrivals."""
    asked, trips, stops = _feed(spark, d)
    found = live.resolve(asked, trips, stops)
    return found.select(F.col("trip_id").cast("long").alias("trip_id"), "seq", "stop_id", "cancelled", F.col("delay").cast("long").alias("delay"), F.col("in_minutes").cast("long").alias("in_minutes"))


@plan("q1_merged_lines", f"""WITH {LIVE}, l AS (SELECT *, stop_id % 10 AS line, trip_id % 4 = 0 AS cancelled FROM live), n AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY in_minutes, trip_id) AS nth FROM l),
a AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY in_minutes, trip_id) AS k FROM n WHERE nth > 1 AND NOT cancelled)
SELECT line, min(in_minutes) AS in_minutes, coalesce((SELECT string_agg(in_minutes, ',' ORDER BY in_minutes) FROM a WHERE a.line = n.line AND k <= 2), '') AS later FROM n GROUP BY line""")
def merged_lines(spark, d):
    """The next departure of each line and up to two later ones that aren't cancelled."""
    rows = timetable.with_delays(_board(spark, d), _news(spark, d)).withColumns({"line": F.col("stop_id") % 10, "cancelled": F.col("trip_id") % 4 == 0})
    return timetable.merged(rows, ["line"]).select("line", F.col("in_minutes").cast("long"), F.array_join(F.transform("later", lambda m: m.cast("string")), ",").alias("later"))


@plan("q2_nearby_departures", f"""WITH {LIVE}, {STOP}, near AS (SELECT stop_id, nation, {PLANAR.format(lat1=42.0, lon1=9.0, lat2='lat_e6 / 1e6', lon2='lon_e6 / 1e6')} AS meters FROM stop)
SELECT nation, CAST(floor(min(meters)) AS BIGINT) AS meters, min(in_minutes) AS next FROM near LEFT JOIN live USING (stop_id) WHERE meters <= 200000 GROUP BY nation""")
def nearby_departures(spark, d):
    """Stops in reach by station, with the least distance and the next departure of each."""
    far = geo.planar_m(F.lit(42.0), F.lit(9.0), F.col("lat"), F.col("lon"))
    near = degrees(stops(spark, d)).withColumn("meters", far).where("meters <= 200000")
    live = timetable.with_delays(_board(spark, d), _news(spark, d)).groupBy("stop_id").agg(F.min("in_minutes").alias("next"))
    return near.join(live, "stop_id", "left").groupBy("nation").agg(F.floor(F.min("meters")).alias("meters"), F.min("next").cast("long").alias("next"))


@plan("q3_trip_detail", f"""WITH {CALL}, news AS (SELECT trip_id, seq, (trip_id * 31 + seq * 17) % 1200 - 200 AS delay FROM call WHERE seq % 3 = 1)
SELECT c.trip_id, c.seq, c.stop_id, CAST(floor((n.delay + 30) / 60.0) AS BIGINT) AS delay FROM call c ASOF LEFT JOIN news n ON c.trip_id = n.trip_id AND c.seq >= n.seq""")
def trip_stops(spark, d):
    calls = _calls(spark, d)
    news = calls.where("seq % 3 = 1").select("trip_id", "seq", ((F.col("trip_id") * 31 + F.col("seq") * 17) % 1200 - 200).alias("delay"))
    return timetable.trip_detail(calls, news).select("trip_id", "seq", "stop_id", F.col("delay").cast("long"))


_FOOT = f"foot AS (SELECT a.stop_id AS from_id, b.stop_id AS to_id, CAST(ceil({HAVERSINE.format(lat1='a.lat_e6 / 1e6', lon1='a.lon_e6 / 1e6', lat2='b.lat_e6 / 1e6', lon2='b.lon_e6 / 1e6')} / 5000) AS BIGINT) AS walk FROM stop a JOIN stop b ON a.stop_id <> b.stop_id AND {HAVERSINE.format(lat1='a.lat_e6 / 1e6', lon1='a.lon_e6 / 1e6', lat2='b.lat_e6 / 1e6', lon2='b.lon_e6 / 1e6')} <= 30000)"


def _rounds(n: int) -> str:
    """CTEs r0 to rn: boarding, riding and walking once more in each."""
    parts = ["r0 AS (SELECT stop_id, 480 AS arrival, 0 AS round, false AS by_vehicle FROM stop WHERE stop_id IN (3, 17))"]
    for k in range(1, n + 1):
        before = " UNION ALL ".join(f"SELECT stop_id, arrival FROM r{i}" for i in range(k))
        parts.append(f"""b{k} AS (SELECT trip_id, min(seq) AS board FROM call JOIN r{k - 1} USING (stop_id) WHERE minute >= arrival + CASE WHEN by_vehicle THEN 1 ELSE 0 END GROUP BY trip_id),
d{k} AS (SELECT stop_id, min(minute) AS arrival FROM call JOIN b{k} USING (trip_id) WHERE seq > board GROUP BY stop_id),
u{k} AS (SELECT stop_id, arrival, true AS v FROM d{k} UNION ALL SELECT to_id, arrival + walk + 1, false FROM d{k} JOIN foot ON stop_id = from_id),
m{k} AS (SELECT stop_id, min(arrival) AS arrival, arg_min(v, (arrival, NOT v)) AS by_vehicle FROM u{k} GROUP BY stop_id),
r{k} AS (SELECT stop_id, m.arrival, {k} AS round, by_vehicle FROM m{k} m LEFT JOIN (SELECT stop_id, min(arrival) AS known FROM ({before}) GROUP BY stop_id) USING (stop_id) WHERE known IS NULL OR m.arrival < known)""")
    return ",\n".join(parts)


_JOURNEY = f"WITH {CALL}, {STOP}, {_FOOT}, {_rounds(3)}, reached AS (" + " UNION ALL ".join(f"SELECT stop_id, round, arrival FROM r{k}" for k in range(4)) + ")"


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    calls = _calls(spark, d).select("trip_id", "seq", "stop_id", F.col("minute").alias("arrival"), F.col("minute").alias("departure"))
    s = degrees(stops(spark, d))
    near = spatial.within_distance(s.select(F.col("stop_id").alias("from_id"), "lat", "lon"), s.select(F.col("stop_id").alias("to_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")), 30_000)
    return calls, near.where("from_id <> to_id").select("from_id", "to_id", F.ceil(F.col("meters") / 5000).alias("walk")), s


def _reached(spark: SparkSession, d: str) -> DataFrame:
    calls, foot, s = _network(spark, d)
    access = s.where("stop_id in (3, 17)").select("stop_id", F.lit(480).cast("long").alias("arrival"))
    return journeys.earliest_arrivals(calls, foot, access, rounds=3)


@plan("q4_earliest_arrivals", f"{_JOURNEY} SELECT * FROM reached")
def earliest_arrivals(spark, d):
    """Least arrivals by number of rides, from two stops at eight in the morning."""
    return _reached(spark, d).select("stop_id", "round", "arrival")


@plan("q4_itineraries", f"{_JOURNEY}, t AS (SELECT round, min(arrival + stop_id % 4) AS arrival FROM reached WHERE stop_id IN (50, 51, 52) GROUP BY round) SELECT round, arrival FROM (SELECT *, min(arrival) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t) WHERE b IS NULL OR arrival < b")
def itineraries(spark, d):
    """Arrivals at a target that get better with more rides."""
    target = table(spark, d, "supplier").where("s_suppkey in (50, 51, 52)").select(F.col("s_suppkey").alias("stop_id"), (F.col("s_suppkey") % 4).alias("walk"))
    return journeys.itineraries(_reached(spark, d), target)


_ENDS = """access AS (SELECT r_regionkey AS q, s_suppkey AS stop_id, 480 + s_suppkey % 7 AS arrival, s_suppkey % 7 AS walk FROM region JOIN supplier ON s_suppkey % 29 = r_regionkey * 4 + 1),
egress AS (SELECT r_regionkey AS q, s_suppkey AS stop_id, s_suppkey % 4 AS walk FROM region JOIN supplier ON s_suppkey % 31 = r_regionkey * 5 + 2)"""


def _labelled(n: int) -> str:
    """CTEs of n rounds that keep where each label came from, and the exits of each round."""
    far = "9223372036854775807"
    parts = ["f0 AS (SELECT q, stop_id, arrival, false AS v FROM access)", "t0 AS (SELECT DISTINCT q, CAST(NULL AS BIGINT) AS aim FROM access)"]
    for k in range(1, n + 1):
        seen = " UNION ALL ".join(f"SELECT q, stop_id, arrival FROM f{i}" for i in range(k))
        parts.append(f"""k{k} AS (SELECT q, stop_id, min(arrival) AS best FROM ({seen}) GROUP BY ALL),
b{k} AS (SELECT q, trip_id, min(seq) AS from_seq, arg_min(stop_id, seq) AS from_stop, arg_min(minute, seq) AS departure, arg_min(v, seq) AS from_v FROM call JOIN f{k - 1} USING (stop_id) WHERE minute >= arrival + CASE WHEN v THEN 1 ELSE 0 END GROUP BY ALL),
c{k} AS (SELECT q, c.stop_id, minute AS arrival, trip_id, seq AS to_seq, from_seq, from_stop, departure, from_v FROM call c JOIN b{k} USING (trip_id) WHERE seq > from_seq),
d{k} AS (SELECT * FROM c{k} LEFT JOIN k{k} USING (q, stop_id) JOIN t{k - 1} USING (q) WHERE arrival < least(coalesce(best, {far}), coalesce(aim, {far})) QUALIFY row_number() OVER (PARTITION BY q, stop_id ORDER BY arrival, trip_id, to_seq) = 1),
w{k} AS (SELECT d.q, to_id AS stop_id, d.arrival + walk + 1 AS arrival, d.stop_id AS from_stop, d.arrival AS departure FROM d{k} d JOIN foot ON d.stop_id = from_id JOIN t{k - 1} USING (q) LEFT JOIN k{k} kk ON kk.q = d.q AND kk.stop_id = to_id LEFT JOIN d{k} o ON o.q = d.q AND o.stop_id = to_id
  WHERE d.arrival + walk + 1 < least(coalesce(kk.best, {far}), coalesce(o.arrival, {far}), coalesce(t{k - 1}.aim, {far})) QUALIFY row_number() OVER (PARTITION BY d.q, to_id ORDER BY d.arrival + walk + 1, d.stop_id) = 1),
f{k} AS (SELECT q, stop_id, min(arrival) AS arrival, arg_min(v, (arrival, NOT v)) AS v FROM (SELECT q, stop_id, arrival, true AS v FROM d{k} UNION ALL SELECT q, stop_id, arrival, false FROM w{k}) GROUP BY ALL),
e{k} AS (SELECT f.q, {k} AS rides, f.stop_id, f.v, f.arrival, f.arrival + walk AS total FROM f{k} f JOIN egress USING (q, stop_id) JOIN t{k - 1} USING (q) WHERE (f.q, f.stop_id) IN (SELECT (q, stop_id) FROM d{k}) AND (aim IS NULL OR f.arrival + walk < aim) QUALIFY row_number() OVER (PARTITION BY f.q ORDER BY total, f.stop_id) = 1),
t{k} AS (SELECT q, coalesce(total, aim) AS aim FROM t{k - 1} LEFT JOIN e{k} USING (q))""")
    label = " UNION ALL ".join(f"SELECT q, stop_id, {k} AS round, true AS v, arrival, from_stop, {k - 1} AS from_round, from_v, departure, trip_id, from_seq, to_seq FROM d{k} UNION ALL SELECT q, stop_id, {k}, false, arrival, from_stop, {k}, true, departure, NULL, NULL, NULL FROM w{k}" for k in range(1, n + 1))
    ends = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(1, n + 1))
    return ",\n".join(parts) + f""", label AS ({label}), ends AS ({ends}),
chain AS (SELECT q, rides, 1 AS back, stop_id, rides AS round, v FROM ends UNION ALL SELECT c.q, rides, back + 1, from_stop, from_round, from_v FROM chain c JOIN label l ON c.q = l.q AND c.stop_id = l.stop_id AND c.round = l.round AND c.v = l.v),
legs AS (SELECT q, rides, back, CASE WHEN v THEN 'ride' ELSE 'walk' END AS kind, from_stop, stop_id AS to_stop, departure, arrival, trip_id, from_seq, to_seq FROM chain JOIN label USING (q, stop_id, round, v)
UNION ALL SELECT q, rides, 0, 'walk', stop_id, NULL, arrival, total, NULL, NULL, NULL FROM ends),
firsts AS (SELECT q, rides, max(back) + 1 AS back, arg_max(from_stop, back) AS stop_id, arg_max(departure, back) AS departure FROM legs GROUP BY ALL)"""


@plan("q4_journeys", f"""WITH RECURSIVE {CALL}, {STOP}, {_FOOT}, {_ENDS}, {_labelled(4)},
every AS (SELECT * FROM legs UNION ALL SELECT q, rides, back, 'walk', NULL, stop_id, departure - walk, departure, NULL, NULL, NULL FROM firsts JOIN access USING (q, stop_id))
SELECT q AS query_id, rides, row_number() OVER (PARTITION BY q, rides ORDER BY back DESC) AS leg, kind, from_stop, to_stop, departure, arrival, trip_id, from_seq, to_seq FROM every""")
def journey_legs(spark, d):
    """Legs of the best journeys by number of rides, for a question of each region."""
    calls, foot, s = _network(spark, d)
    r, key = table(spark, d, "region").select("r_regionkey"), F.col("s_suppkey")
    sup = table(spark, d, "supplier").select("s_suppkey")
    access = r.join(sup, F.expr("s_suppkey % 29 = r_regionkey * 4 + 1")).select(F.col("r_regionkey").alias("query_id"), key.alias("stop_id"), F.lit(480).alias("depart"), (key % 7).alias("walk"))
    egress = r.join(sup, F.expr("s_suppkey % 31 = r_regionkey * 5 + 2")).select(F.col("r_regionkey").alias("query_id"), key.alias("stop_id"), (key % 4).alias("walk"))
    return journeys.journeys(calls, foot, access, egress)


@plan("x35_usable_stop", f"""WITH {PLACE}, {STOP}, served AS (SELECT * FROM stop WHERE stop_id IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45))
SELECT id, arg_min(stop_id, (round({HAVERSINE.format(lat1='p.lat_e6 / 1e6', lon1='p.lon_e6 / 1e6', lat2='s.lat_e6 / 1e6', lon2='s.lon_e6 / 1e6')}, 3), stop_id)) AS stop_id FROM place p JOIN served s ON {HAVERSINE.format(lat1='p.lat_e6 / 1e6', lon1='p.lon_e6 / 1e6', lat2='s.lat_e6 / 1e6', lon2='s.lon_e6 / 1e6')} <= 60000 GROUP BY id""")
def usable_stop(spark, d):
    """The nearest stop that has one of the modes asked for."""
    served = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_suppkey").alias("stop_id"))
    s = degrees(stops(spark, d)).join(served, "stop_id", "left_semi").select("stop_id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return spatial.nearest(degrees(places(spark, d)), s, "id", "stop_id", 60_000).select("id", "stop_id")


@plan("j22_name_clusters", f"""WITH RECURSIVE s AS (SELECT s_suppkey AS id, s_suppkey % 12 AS name, s_nationkey % 3 AS network, 42 + (s_suppkey * 37) % 100 / 20000.0 AS lat, 9 + (s_suppkey * 53) % 100 / 20000.0 AS lon FROM supplier),
l AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.name = b.name AND a.network <> b.network AND {PLANAR.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')} <= 100),
r AS (SELECT id, id AS other FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a) SELECT id AS stop_id, min(other) AS cluster FROM r GROUP BY id""")
def name_clusters(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("stop_id"), (F.col("s_nationkey") % 3).alias("network"), F.concat(F.lit("Stop "), (k % 12).cast("string")).alias("name"), (42 + k * 37 % 100 / 20_000).alias("lat"), (9 + k * 53 % 100 / 20_000).alias("lon"))
    return matching.name_clusters(s, 100.0)


#: Places and missions of countries, with names, kinds and phones that fit in part; pairs that fit, and the sequential choice.
_MISSIONS = """poi AS (SELECT c_nationkey AS host, c_custkey AS poi_id, CASE c_custkey % 4 WHEN 1 THEN 'consulate' WHEN 2 THEN NULL ELSE 'embassy' END AS kind, CASE WHEN c_custkey % 5 > 0 THEN '+39 06 ' || lpad(CAST(c_custkey * 31 % 997 AS VARCHAR), 7, '0') END AS phone, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS address,
  CASE c_custkey % 3 WHEN 0 THEN 'Embassy of ' || n_name WHEN 1 THEN 'Consulate of ' || n_name || ' in ' || c_mktsegment ELSE n_name END AS name FROM customer JOIN nation ON n_nationkey = c_custkey * 7 % 25),
mission AS (SELECT s_nationkey AS host, s_suppkey AS mission_id, CASE s_suppkey % 3 WHEN 0 THEN 'embassy' WHEN 1 THEN 'consulate_general' END AS kind, '06 ' || lpad(CAST(s_suppkey * 37 % 997 AS VARCHAR), 7, '0') AS phone, s_name AS address, s_suppkey % 7 = 0 AS local,
  CASE s_suppkey % 2 WHEN 0 THEN 'Embassy of ' || n_name ELSE 'Consulate General of ' || n_name END AS name FROM supplier JOIN nation ON n_nationkey = s_suppkey * 11 % 25),
ordered AS (SELECT *, CASE kind WHEN 'embassy' THEN 1 WHEN 'consulate_general' THEN 2 WHEN 'consulate' THEN 3 END AS k, right(regexp_replace(phone, '\\D', '', 'g'), 8) AS tel, list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: len(w) > 1))) AS w FROM poi),
offered AS (SELECT *, CASE kind WHEN 'embassy' THEN 1 WHEN 'consulate_general' THEN 2 ELSE 3 END AS k, right(regexp_replace(phone, '\\D', '', 'g'), 8) AS tel, list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: len(w) > 1))) AS w FROM mission),
fit AS (SELECT p.host, poi_id, mission_id, m.k, CASE WHEN p.tel = m.tel THEN 0 WHEN (p.k IS NULL OR p.k = m.k) AND (p.w = m.w OR ((len(p.w) >= 2 AND len(m.w) >= 2 OR p.k IS NOT NULL) AND (list_has_all(p.w, m.w) OR list_has_all(m.w, p.w)))) THEN 1 END AS rank FROM ordered p JOIN offered m USING (host)),
wish AS (SELECT host, poi_id, list(mission_id ORDER BY rank, k, mission_id) AS wishes, row_number() OVER (PARTITION BY host ORDER BY poi_id) AS nth FROM fit WHERE rank IS NOT NULL GROUP BY host, poi_id),
turn AS (SELECT DISTINCT host, CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS poi_id, CAST(NULL AS BIGINT) AS mission_id FROM wish
UNION ALL SELECT t.host, w.nth, CASE WHEN m IS NULL THEN used ELSE list_append(used, m) END, w.poi_id, m FROM turn t JOIN (SELECT * FROM wish) w ON w.host = t.host AND w.nth = t.nth + 1, LATERAL (SELECT list_filter(w.wishes, lambda x: NOT list_contains(t.used, x))[1] AS m))"""


def _missions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    c, s, name = F.col("c_custkey"), F.col("s_suppkey"), F.col("n_name")
    tel = lambda k: F.lpad((k % 997).cast("string"), 7, "0")
    title = F.when(c % 3 == 0, F.concat(F.lit("Embassy of "), name)).when(c % 3 == 1, F.concat(F.lit("Consulate of "), name, F.lit(" in "), "c_mktsegment")).otherwise(name)
    kind = F.when(c % 4 == 1, "consulate").when(c % 4 == 2, None).otherwise("embassy")
    pois = table(spark, d, "customer").join(n, c * 7 % 25 == F.col("n_nationkey")).select(c.alias("poi_id"), F.col("c_nationkey").alias("host"), kind.alias("kind"), F.when(c % 5 > 0, F.concat(F.lit("+39 06 "), tel(c * 31))).alias("phone"), F.when(c % 2 == 0, F.col("c_name")).alias("address"), title.alias("name"))
    title = F.concat(F.when(s % 2 == 0, "Embassy of ").otherwise("Consulate General of "), name)
    kind = F.when(s % 3 == 0, "embassy").when(s % 3 == 1, "consulate_general")
    missions = table(spark, d, "supplier").join(n, s * 11 % 25 == F.col("n_nationkey")).select(s.alias("mission_id"), F.col("s_nationkey").alias("host"), kind.alias("kind"), F.concat(F.lit("06 "), tel(s * 37)).alias("phone"), F.col("s_name").alias("address"), (s % 7 == 0).alias("local"), title.alias("name"))
    return pois, missions


@plan("j21_embassies", f"WITH RECURSIVE {_MISSIONS} SELECT host, poi_id, mission_id FROM turn WHERE mission_id IS NOT NULL")
def embassies(spark, d):
    """Missions paired one to one with places of their country, by phone, then by name."""
    pois, missions = _missions(spark, d)
    return matching.embassy_pairs(pois, missions, ["host"])


@plan("q12_embassies", f"""WITH RECURSIVE {_MISSIONS}, pair AS (SELECT host, poi_id, mission_id FROM turn WHERE mission_id IS NOT NULL)
SELECT host, poi_id, mission_id, p.name, coalesce(m.k, p.k) AS kind, coalesce(p.phone, m.phone) AS phone, coalesce(p.address, m.address) AS address, true AS local FROM ordered p LEFT JOIN pair USING (host, poi_id) LEFT JOIN offered m USING (host, mission_id)
UNION ALL SELECT host, NULL, mission_id, name, k, phone, address, local FROM offered WHERE mission_id NOT IN (SELECT mission_id FROM pair)""")
def merged_embassies(spark, d):
    """Places completed by their missions, and the missions that no place took."""
    pois, missions = _missions(spark, d)
    return matching.merge_embassies(pois, missions, ["host"], ["phone", "address"]).drop("name_key")


@plan("dt2_service_epoch", "SELECT o_orderkey, CAST(epoch(timezone('Europe/Zurich', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR)) AS BIGINT) - 43200 + (o_orderkey % 1800) * 60 AS epoch FROM orders")
def service_epoch(spark, d):
    """Instants of service minutes, across changes of the clock."""
    at = clock.service_epoch(F.to_date("o_orderdate"), (F.col("o_orderkey") % 1800).cast("int"), "Europe/Zurich")
    return table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(at).alias("epoch"))


@plan("ar1_day_bits", "SELECT o_orderkey, CAST(unnest(list_filter(range(20), lambda i: ((o_custkey * 7919) >> i) & 1 = 1)) AS INTEGER) AS bit FROM orders")
def day_bits(spark, d):
    """Bits of a service mask as rows."""
    mask = F.col("o_custkey") * 7919
    bits = F.filter(F.sequence(F.lit(0), F.lit(19)), lambda i: F.getbit(mask, i) == 1)
    return table(spark, d, "orders").select("o_orderkey", F.explode(bits).alias("bit"))


@plan("ar2_delta_codec", f"WITH {CALL} SELECT trip_id, string_agg(minute, ',' ORDER BY seq) AS minutes FROM call GROUP BY trip_id")
def delta_codec(spark, d):
    """Minutes of each trip packed as zigzag differences and unpacked again."""
    lists = _calls(spark, d).groupBy("trip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "minute"))), lambda x: x.minute.cast("long")).alias("m"))
    return lists.select("trip_id", F.array_join(F.transform(markup.unpack(markup.pack("m")), lambda v: v.cast("string")), ",").alias("minutes"))


@plan("x2_tile_of_id", f"WITH {PLACE} SELECT id, 14 AS z, CAST(floor((lon_e6 / 1e6 + 180) / 360 * 16384) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat_e6 / 1e6)) + 1 / cos(radians(lat_e6 / 1e6))) / pi()) / 2 * 16384) AS BIGINT) AS y FROM place")
def tile_of_id(spark, d):
    """Places to Hilbert tile ids and back to tiles."""
    ids = degrees(places(spark, d)).select("id", geo.tile_id(geo.tile_x(F.col("lon"), 14), geo.tile_y(F.col("lat"), 14), 14).alias("t"))
    tile = geo.tile_of(F.col("t"))
    return ids.select("id", tile.alias("tile")).select("id", "tile.z", "tile.x", "tile.y")


@plan("q14_place_etl", """WITH t AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size < 5 THEN NULL WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'shop' WHEN p_size > 30 THEN 'museum' ELSE 'cafe' END AS category, p_brand AS tag FROM part),
k AS (SELECT * FROM t WHERE category IS NOT NULL), c AS (SELECT category, tag, row_number() OVER (ORDER BY category, tag) AS code FROM (SELECT DISTINCT category, tag FROM k)) SELECT id, name, code FROM k JOIN c USING (category, tag)""")
def place_etl(spark, d):
    """Raw rows classified by ordered rules, those without a category dropped, category and tag as a dictionary's code."""
    category = relational.classify([(F.col("p_size") < 5, None), (F.col("p_type").isin("PROMO", "ECONOMY"), "shop"), (F.col("p_size") > 30, "museum")], "cafe")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), category.alias("category"), F.col("p_brand").alias("tag")).where("category is not null")
    coded, _ = relational.dictionary_encode(rows, ["category", "tag"])
    return coded.select("id", "name", F.col("code").cast("long"))
