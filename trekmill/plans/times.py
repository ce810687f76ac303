"""Events as schedules: joins over time, windows, calendars, boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trekmill.functions import clock
from trekmill.operators import relational, temporal, timetable
from trekmill.plans.base import EVENT, events, plan, table
from trekmill.streaming import navigation


def _kind(spark, d, kind):
    return events(spark, d).where(F.col("event_type") == kind)


@plan("j4_band_join", f"WITH {EVENT} SELECT a.event_id, b.event_id AS other FROM event a JOIN event b ON a.user_id = b.user_id AND a.sec BETWEEN b.sec - 3600 AND b.sec + 600 AND a.event_type = 'click' AND b.event_type = 'error'")
def band_join(spark, d):
    """Departures in the window that opens an hour before and closes ten minutes after each other event."""
    a = _kind(spark, d, "click").select("user_id", "event_id", "sec")
    b = _kind(spark, d, "error").select("user_id", F.col("event_id").alias("other"), (F.col("sec") - 3600).alias("lo"), (F.col("sec") + 600).alias("hi"))
    return temporal.band_join(a, b, ["user_id"], "sec", "lo", "hi", 4200).select("event_id", "other")


@plan("j9_last_stop", "SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last_part FROM lineitem GROUP BY l_orderkey")
def last_stop(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("last_part"))


@plan("j20_time_anti", f"WITH {EVENT} SELECT event_id FROM event a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM event b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND abs(a.sec - b.sec) <= 3600)")
def time_anti(spark, d):
    return temporal.drop_close(_kind(spark, d, "click"), _kind(spark, d, "purchase"), ["user_id"], "sec", 3600).select("event_id")


@plan("j23_as_of", f"WITH {EVENT}, r AS (SELECT user_id, sec, max(event_id) AS seen FROM event WHERE event_type = 'view' GROUP BY ALL) SELECT event_id, seen FROM (SELECT * FROM event WHERE event_type = 'click') a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.sec >= r.sec")
def as_of(spark, d):
    return temporal.as_of(_kind(spark, d, "click").select("event_id", "user_id", "sec"), _kind(spark, d, "view").select("user_id", "sec", F.col("event_id").alias("seen")), ["user_id"], "sec", "seen").select("event_id", "seen")


@plan("j24_nearest_in_time", f"WITH {EVENT} SELECT a.event_id, arg_min(b.event_id, (abs(a.sec - b.sec), b.event_id)) AS nearest FROM event a JOIN event b ON a.user_id = b.user_id AND abs(a.sec - b.sec) <= 7200 WHERE a.event_type = 'click' AND b.event_type = 'error' GROUP BY a.event_id")
def nearest_in_time(spark, d):
    a = _kind(spark, d, "click").select("user_id", "event_id", "sec")
    b = _kind(spark, d, "error").select("user_id", F.col("event_id").alias("other"), F.col("sec").alias("at"), (F.col("sec") - 7200).alias("lo"), (F.col("sec") + 7200).alias("hi"))
    pairs = temporal.band_join(a, b, ["user_id"], "sec", "lo", "hi", 7200)
    return pairs.groupBy("event_id").agg(F.min_by("other", F.struct(F.abs(F.col("sec") - F.col("at")), F.col("other"))).alias("nearest"))


@plan("j25_key_fallback", f"""WITH {EVENT}, r AS (SELECT user_id, event_type, day, value, event_id FROM event WHERE event_id % 2 = 0), k1 AS (SELECT user_id, event_type, day, min(event_id) AS v FROM r GROUP BY ALL HAVING count(*) = 1), k2 AS (SELECT user_id, event_type, min(event_id) AS v FROM r GROUP BY ALL HAVING count(*) = 1), k3 AS (SELECT user_id, day, min(event_id) AS v FROM r GROUP BY ALL HAVING count(*) = 1)
SELECT e.event_id, coalesce(k1.v, k2.v, k3.v) AS trip FROM event e LEFT JOIN k1 ON e.user_id = k1.user_id AND e.event_type = k1.event_type AND e.day = k1.day LEFT JOIN k2 ON e.user_id = k2.user_id AND e.event_type = k2.event_type LEFT JOIN k3 ON e.user_id = k3.user_id AND e.day = k3.day WHERE e.event_id % 2 = 1""")
def key_fallback(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "day")
    right = e.where("event_id % 2 = 0").withColumnRenamed("event_id", "trip")
    return relational.fallback_join(e.where("event_id % 2 = 1"), right, [["user_id", "event_type", "day"], ["user_id", "event_type"], ["user_id", "day"]], "trip").select("event_id", "trip")


@plan("j26_wildcard_selectors", f"""WITH {EVENT}, s AS (SELECT n_nationkey AS alert, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END AS user_id, CASE n_nationkey % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' END AS event_type FROM nation)
SELECT e.event_id, s.alert FROM event e JOIN s ON (s.user_id IS NULL OR s.user_id = e.user_id) AND (s.event_type IS NULL OR s.event_type = e.event_type) AND NOT (s.user_id IS NULL AND s.event_type IS NULL)""")
def wildcard_selectors(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type")
    k = F.col("n_nationkey")
    s = table(spark, d, "nation").select(k.alias("alert"), F.when(k % 3 > 0, k).cast("long").alias("user_id"), F.when(k % 4 == 0, "click").when(k % 4 == 1, "view").when(k % 4 == 2, "purchase").alias("event_type"))
    return relational.wildcard_join(e, s, ["user_id", "event_type"]).select("event_id", "alert")


@plan("w1_board", f"WITH {EVENT}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sec, event_id) AS nth FROM event WHERE day = DATE '2024-01-10' AND sec % 86400 >= 28800) SELECT user_id, event_type, event_id, nth FROM b WHERE nth <= 3")
def board(spark, d):
    """The next departure of each line and up to two later ones."""
    now = events(spark, d).where((F.col("day") == "2024-01-10") & (F.col("sec") % 86400 >= 28800))
    return temporal.next_per_group(now, ["user_id", "event_type"], ["sec", "event_id"], 3).select("user_id", "event_type", "event_id", F.col("nth").cast("long"))


@plan("w2_first_of_group", f"WITH {EVENT} SELECT user_id, day, arg_min(event_id, (sec, event_id)) AS first_event FROM event GROUP BY user_id, day")
def first_of_group(spark, d):
    return events(spark, d).groupBy("user_id", "day").agg(F.min_by("event_id", F.struct("sec", "event_id")).alias("first_event"))


@plan("w3_drop_terminal", "SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber < m")
def drop_terminal(spark, d):
    return table(spark, d, "lineitem").withColumn("m", F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))).where("l_linenumber < m").select("l_orderkey", "l_linenumber")


@plan("w4_deltas", f"WITH {EVENT} SELECT event_id, sec - lag(sec, 1, 0) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS delta FROM event")
def deltas(spark, d):
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    return events(spark, d).select("event_id", (F.col("sec") - F.coalesce(F.lag("sec").over(w), F.lit(0))).alias("delta"))


@plan("w5_prefix_sums", f"WITH {EVENT}, x AS (SELECT event_id, user_id, sec, sec - lag(sec, 1, 0) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS delta FROM event) SELECT event_id, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sec FROM x")
def prefix_sums(spark, d):
    """Deltas summed again: the inverse of w4 in the same partitioning, so with one shuffle for both."""
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    x = events(spark, d).withColumn("delta", F.col("sec") - F.coalesce(F.lag("sec").over(w), F.lit(0)))
    return x.select("event_id", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sec"))


@plan("w6_contiguous_runs", "WITH k AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_totalprice > 60000), g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM k) SELECT min(id) AS first, count(*) AS n FROM g GROUP BY g")
def contiguous_runs(spark, d):
    """Runs of neighbouring ids: within a run an id and its number differ by the same. No task orders all ids."""
    k = table(spark, d, "orders").where("o_totalprice > 60000").select(F.col("o_orderkey").alias("id")).distinct()
    runs = relational.numbered(k, ["id"], "nth").groupBy(F.col("id") - F.col("nth"))
    return runs.agg(F.min("id").alias("first"), F.count("*").alias("n")).select("first", "n")


@plan("w7_equal_day_ranges", f"WITH {EVENT}, c AS (SELECT user_id, day, count(*) AS n FROM event GROUP BY ALL), g AS (SELECT *, CASE WHEN n = lag(n) OVER w AND day = lag(day) OVER w + 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY user_id ORDER BY day)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM g) SELECT user_id, min(day) AS first_day, max(day) AS last_day, any_value(n) AS n FROM r GROUP BY user_id, run")
def equal_day_ranges(spark, d):
    """Consecutive days with equal counts as ranges, as opening hours are shown."""
    c = events(spark, d).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    same = (F.col("n") == F.lag("n").over(w)) & (F.col("day") == F.date_add(F.lag("day").over(w), 1))
    return temporal.islands(c, ["user_id"], "day", same).groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.first("n").alias("n")).drop("island")


@plan("w8_repeat_limit", f"WITH {EVENT} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS n FROM event) WHERE n <= 2")
def repeat_limit(spark, d):
    return temporal.next_per_group(events(spark, d), ["user_id", "props"], ["event_id"], 2).select("event_id")


@plan("w9_nth_equal_key", f"WITH {EVENT} SELECT event_id, user_id || '|' || event_type || '#' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS key FROM event")
def nth_equal_key(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return events(spark, d).select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type", F.lit("#"), n.cast("string")).alias("key"))


@plan("w10_newest_else_superseded", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'selected' ELSE 'superseded' END AS outcome FROM orders")
def newest_else_superseded(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, d, "orders").select("o_orderkey", F.when(n == 1, "selected").otherwise("superseded").alias("outcome"))


@plan("w11_smoothed_speed", f"""WITH RECURSIVE {EVENT}, fix AS (SELECT user_id, sec, event_id, CAST(event_id * 7919 % 90000 AS DOUBLE) AS p, sec - lag(sec) OVER w > 43200 AS fresh FROM event WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
trip AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS trip FROM fix), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, trip ORDER BY sec, event_id) AS k FROM trip),
s AS (SELECT user_id, trip, sec AS started, k, CAST(sec AS DOUBLE) AS last_at, p AS reached, CAST(NULL AS DOUBLE) AS speed, CAST(2000 AS DOUBLE) AS reach FROM n WHERE k = 1
UNION ALL SELECT s.user_id, s.trip, s.started, n.k, n.sec, greatest(s.reached, n.p), CASE WHEN n.sec > s.last_at THEN CASE WHEN s.speed IS NULL THEN least((greatest(s.reached, n.p) - s.reached) / (n.sec - s.last_at), 50) ELSE s.speed + (least((greatest(s.reached, n.p) - s.reached) / (n.sec - s.last_at), 50) - s.speed) * 0.5 END ELSE s.speed END,
  least(coalesce(least(s.speed * 1.5 + 5, 50), 50) * (n.sec - s.last_at) + 30, 2000) FROM s JOIN n ON n.user_id = s.user_id AND n.trip = s.trip AND n.k = s.k + 1)
SELECT user_id, CAST(started AS BIGINT) AS started, k AS fixes, CAST(last_at AS BIGINT) AS last_at, CAST(reached AS BIGINT) AS reached, CAST(round(speed * 1e6) AS BIGINT) AS speed_e6, CAST(round(reach * 1e3) AS BIGINT) AS reach_e3 FROM s QUALIFY row_number() OVER (PARTITION BY user_id, trip ORDER BY k DESC) = 1""")
def smoothed_speed(spark, d):
    """Trips of every user, with the smoothed speed along the route and how far the last fix could have been."""
    fixes = events(spark, d).select("user_id", "sec", "event_id", (F.col("event_id") * 7919 % 90_000).alias("progress"))
    t = navigation.tracked(fixes, idle=43_200, at="sec", tie="event_id")
    whole = lambda c, by=1.0: F.round(F.col(c) * by).cast("long")
    return t.select("user_id", whole("started").alias("started"), "fixes", whole("at").alias("last_at"), whole("reached").alias("reached"), whole("speed", 1e6).alias("speed_e6"), whole("reach", 1e3).alias("reach_e3"))


@plan("w12_best_rank", f"WITH {EVENT} SELECT user_id, arg_max(event_id, (CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END, sec, event_id)) AS best FROM event GROUP BY user_id")
def best_rank(spark, d):
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_id", F.struct(rank, "sec", "event_id")).alias("best"))


@plan("dt1_service_minutes", "SELECT o_orderkey, (o_orderkey % 30) * 60 + o_orderkey % 60 AS minutes FROM orders")
def service_minutes(spark, d):
    text = F.format_string("%d:%02d:00", F.col("o_orderkey") % 30, F.col("o_orderkey") % 60)
    return table(spark, d, "orders").select("o_orderkey", clock.service_minutes(text).cast("long").alias("minutes"))


@plan("dt3_calendar", """WITH s AS (SELECT o_orderkey AS service, CAST(o_orderdate AS DATE) AS first, CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 AS INTEGER) AS last, o_custkey FROM orders),
run AS (SELECT service, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM s), reg AS (SELECT service, day FROM run WHERE isodow(day) < 6), added AS (SELECT service, last + 2 AS day FROM s WHERE o_custkey % 2 = 0), removed AS (SELECT service, first + 1 AS day FROM s WHERE o_custkey % 3 = 0)
(SELECT * FROM reg UNION SELECT * FROM added) EXCEPT SELECT * FROM removed""")
def calendar(spark, d):
    """Days on which services run: weekdays of a range, with days added and taken away."""
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("service"), F.to_date("o_orderdate").alias("first"), "o_custkey")
    s = s.withColumn("last", F.expr("date_add(first, cast(o_custkey % 20 as int))"))
    weekdays = F.array(*(F.lit(i < 5) for i in range(7)))
    regular = s.select("service", F.explode(clock.runs_on(F.col("first"), F.col("last"), weekdays)).alias("day"))
    added = s.where("o_custkey % 2 = 0").select("service", F.date_add("last", 2).alias("day"))
    removed = s.where("o_custkey % 3 = 0").select("service", F.date_add("first", 1).alias("day"))
    return regular.union(added).distinct().join(removed, ["service", "day"], "left_anti")


@plan("dt4_three_day_offsets", f"WITH {EVENT} SELECT event_id, o AS day_offset, sec % 86400 // 60 + o * 1440 AS minute FROM event, (SELECT unnest([-1, 0, 1]) AS o) WHERE sec % 86400 // 60 + o * 1440 BETWEEN -60 AND 1500")
def three_day_offsets(spark, d):
    x = events(spark, d).select("event_id", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("day_offset"), "sec")
    return x.withColumn("minute", F.floor(F.col("sec") % 86400 / 60) + F.col("day_offset") * 1440).where("minute between -60 and 1500").select("event_id", "day_offset", "minute")


@plan("dt5_grace_days", "SELECT o_orderkey, CASE WHEN d <= DATE '1998-06-30' THEN d WHEN d <= DATE '1998-07-03' THEN d - 7 END AS service_day, d > DATE '1998-06-30' AND d <= DATE '1998-07-03' AS estimated FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def grace_days(spark, d):
    """Up to three days past validity a board uses the same weekday of the week before, marked as estimated."""
    day, end = F.to_date("o_orderdate"), F.lit("1998-06-30").cast("date")
    late = (day > end) & (day <= F.date_add(end, 3))
    return table(spark, d, "orders").select("o_orderkey", F.when(day <= end, day).when(late, F.date_sub(day, 7)).alias("service_day"), late.alias("estimated"))


@plan("dt6_staleness", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') > 120 AS stale FROM orders")
def staleness(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate")) > 120).alias("stale"))


@plan("dt7_clock", f"WITH {EVENT} SELECT event_id, lpad(CAST(((sec // 60 - 5000) % 1440 + 1440) % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(((sec // 60 - 5000) % 1440 + 1440) % 60 AS VARCHAR), 2, '0') AS clock FROM event")
def clock_text(spark, d):
    return events(spark, d).select("event_id", clock.clock(F.floor(F.col("sec") / 60) - 5000).alias("clock"))


@plan("x5_gap_interpolation", f"""WITH {EVENT}, e AS (SELECT event_id, user_id, sec, event_id % 9 + 1 AS step, CASE WHEN event_id % 3 = 0 THEN sec END AS t FROM event), r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS dist FROM e),
k AS (SELECT *, last_value(t IGNORE NULLS) OVER p AS t0, last_value(CASE WHEN t IS NOT NULL THEN dist END IGNORE NULLS) OVER p AS d0, first_value(t IGNORE NULLS) OVER n AS t1, first_value(CASE WHEN t IS NOT NULL THEN dist END IGNORE NULLS) OVER n AS d1 FROM r
WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CAST(floor(coalesce(t, t0 + (t1 - t0) * ((dist - d0) / (d1 - d0))) + 0.0001) AS BIGINT) AS sec FROM k""")
def gap_interpolation(spark, d):
    e = events(spark, d).select("event_id", "user_id", (F.col("event_id") % 9 + 1).alias("step"), F.when(F.col("event_id") % 3 == 0, F.col("sec")).alias("sec"))
    return temporal.fill_times(e, ["user_id"], "event_id", "sec", "step").select("event_id", F.floor(F.col("sec") + 0.0001).alias("sec"))


@plan("ar3_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").k.alias("k")).where("k > 50")


@plan("a14_tri_state_or", f"WITH {EVENT}, t AS (SELECT user_id, day, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN NULL ELSE false END AS ok FROM event) SELECT user_id, day, bool_or(ok) AS ok FROM t GROUP BY ALL")
def tri_state_or(spark, d):
    ok = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", None).otherwise(False)
    return events(spark, d).groupBy("user_id", "day").agg(F.max(ok).alias("ok"))


@plan("a13_open_interval_merge", f"""WITH {EVENT}, z AS (SELECT user_id, event_type, sec AS a, CASE WHEN event_id % 13 > 0 THEN sec + 60 END AS b, 'zone ' || event_id % 40 AS name FROM event)
SELECT user_id, event_type, min(a) AS starts, CASE WHEN count(*) = count(b) THEN max(b) END AS ends, left(array_to_string(list_sort(list_distinct(list(name))), ', '), 160) AS zones FROM z GROUP BY ALL""")
def open_interval_merge(spark, d):
    """Copies of an alert for several zones as one: open if any is open, zone names once and shortened."""
    z = events(spark, d).select("user_id", "event_type", F.col("sec").alias("a"), F.when(F.col("event_id") % 13 > 0, F.col("sec") + 60).alias("b"), F.concat(F.lit("zone "), (F.col("event_id") % 40).cast("string")).alias("name"))
    ends = F.when(F.count("*") == F.count("b"), F.max("b"))
    return z.groupBy("user_id", "event_type").agg(F.min("a").alias("starts"), ends.alias("ends"), F.left(F.array_join(F.sort_array(F.collect_set("name")), ", "), F.lit(160)).alias("zones"))


@plan("f15_f16_relevant_alerts", f"WITH {EVENT} SELECT event_id FROM event WHERE (value >= CASE WHEN user_id % 5 = 0 THEN 50 ELSE 45 END OR event_id % 100 < 2 OR event_type = 'purchase') AND sec > 2505600 - 72 * 3600 AND (CASE WHEN event_id % 4 > 0 THEN sec + 86400 END IS NULL OR CASE WHEN event_id % 4 > 0 THEN sec + 86400 END > 2505600)")
def relevant_alerts(spark, d):
    e = events(spark, d).withColumn("ends", F.when(F.col("event_id") % 4 > 0, F.col("sec") + 86400))
    strong = F.col("value") >= F.when(F.col("user_id") % 5 == 0, 50).otherwise(45)
    return e.where((strong | (F.col("event_id") % 100 < 2) | (F.col("event_type") == "purchase")) & (F.col("sec") > 2505600 - 72 * 3600) & (F.col("ends").isNull() | (F.col("ends") > 2505600))).select("event_id")


@plan("t5_t6_ranked_alerts", f"WITH {EVENT} SELECT user_id, event_type, max(sec) AS newest FROM event GROUP BY user_id, event_type ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, newest DESC, user_id, event_type LIMIT 20")
def ranked_alerts(spark, d):
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    found = events(spark, d).groupBy("user_id", "event_type").agg(F.max("sec").alias("newest"))
    return found.orderBy(rank, F.desc("newest"), "user_id", "event_type").limit(20)


@plan("a15_pattern_interning", """WITH c AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_suppkey % 4) AS stop FROM lineitem GROUP BY ALL), p AS (SELECT trip, string_agg(stop || ':' || seq, ',' ORDER BY seq) AS pattern FROM c GROUP BY trip)
SELECT pattern, count(*) AS trips, min(trip) AS first_trip FROM p GROUP BY pattern""")
def pattern_interning(spark, d):
    """Whole trips with equal ordered stop lists and offsets share a pattern."""
    calls = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq")).agg(F.min(F.col("l_suppkey") % 4).alias("stop_id"))
    trips, kinds = timetable.patterns(calls.withColumn("minute", F.col("seq")))
    starts = trips.groupBy("pattern", "start").agg(F.count("*").alias("trips"), F.min("trip_id").alias("first_trip"))
    lists = kinds.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("seq", "stop_id", "offset"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x.stop_id, x.offset + F.col("start"))), ",")
    return starts.join(lists, "pattern").select(text.alias("pattern"), "trips", "first_trip")


@plan("x19_parallel_arrays", f"WITH {EVENT}, a AS (SELECT user_id, list(day ORDER BY event_id) AS days, list(CASE WHEN event_id % 7 > 0 THEN event_id END ORDER BY event_id) AS ids FROM event GROUP BY user_id), z AS (SELECT user_id, unnest(days) AS day, unnest(ids) AS id FROM a) SELECT user_id, day, id FROM z WHERE id IS NOT NULL AND day >= DATE '2024-01-15'")
def parallel_arrays(spark, d):
    """Forecast arrays side by side as rows, without past days and incomplete rows."""
    rows = events(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "day", F.when(F.col("event_id") % 7 > 0, F.col("event_id")).alias("id")))).alias("r"))
    arrays = rows.select("user_id", F.col("r.day").alias("days"), F.col("r.id").alias("ids"))
    z = arrays.select("user_id", F.explode(F.arrays_zip("days", "ids")).alias("z")).select("user_id", F.col("z.days").alias("day"), F.col("z.ids").alias("id"))
    return z.where((F.col("id").isNotNull()) & (F.col("day") >= "2024-01-15"))
