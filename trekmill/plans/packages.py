"""Feeds, alerts, catalogs and reference data: parsing, validating, merging, carrying over."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trekmill.functions import text
from trekmill.operators import alerts, catalog, relational, regions, spatial
from trekmill.plans.base import EVENT, PLACE, PLANAR, STOP, degrees, events, places, plan, stops, table
from trekmill.sources import feeds


@plan("src6_group_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def group_counts(spark, d):
    """Rows of all files by group, in one job."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@plan("src5_open_places", f"WITH {PLACE} SELECT id FROM place WHERE lat_e6 BETWEEN 41000000 AND 43000000 AND lon_e6 BETWEEN 6000000 AND 11000000 AND ((category = 'BUILDING' AND nation = 3) OR (category = 'MACHINERY' AND nation = 7))")
def open_places(spark, d):
    """Places in a box from allowed pairs of data set and licence (here: category and nation)."""
    allowed = feeds.allowed(F.col("category"), F.col("nation"), [("BUILDING", 3), ("MACHINERY", 7)])
    return places(spark, d).where(F.col("lat_e6").between(41_000_000, 43_000_000) & F.col("lon_e6").between(6_000_000, 11_000_000) & allowed).select("id")


@plan("src12_quake_feed", f"WITH {EVENT} SELECT 'e' || event_id AS id, CASE WHEN v >= 7 THEN 3 WHEN v >= 6 THEN 2 WHEN v >= 5 THEN 1 ELSE 0 END AS level, 'near ' || user_id AS title FROM (SELECT *, (event_id % 90) / 10.0 AS v FROM event) WHERE event_id % 17 > 0")
def quake_feed(spark, d):
    """GeoJSON collections, one for each user, to alerts; an entry without magnitude is left out."""
    e = events(spark, d)
    mag = F.when(F.col("event_id") % 17 > 0, F.col("event_id") % 90 / 10)
    feature = F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.struct(mag.alias("mag"), F.concat(F.lit("near "), F.col("user_id").cast("string")).alias("place"), (F.col("sec") * 1000).alias("time")).alias("properties"), F.struct(F.array(F.lit(9.0), F.lit(45.0)).alias("coordinates")).alias("geometry"))
    bodies = e.groupBy("user_id").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("body"))
    return feeds.quake_alerts(bodies).select("id", "level", "title")


@plan("src13_cap_messages", "SELECT 'm' || o_orderkey AS id, o_orderpriority AS severity FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0")
def cap_messages(spark, d):
    """Warning messages in XML: actual ones that cancel nothing."""
    k = F.col("o_orderkey")
    body = F.format_string(
        '<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>m%d</identifier><status>%s</status><msgType>%s</msgType><sent>2024-01-01T00:00:00Z</sent><info><event>wind</event><severity>%s</severity></info></alert>',
        k, F.when(k % 5 > 0, "Actual").otherwise("Test"), F.when(k % 7 > 0, "Alert").otherwise("Cancel"), "o_orderpriority",
    )
    return feeds.cap_alerts(table(spark, d, "orders").select(body.alias("body"))).select("id", "severity")


@plan("src14_weather_service", f"""WITH {EVENT}, e AS (SELECT *, (['Tsunami Advisory', 'Flood Warning', 'Gale Warning', 'Red Flag Warning', 'Heat Advisory'])[event_id % 5 + 1] AS name, (['Minor', 'Moderate', 'Severe', 'Extreme', 'Unknown'])[event_id % 7 % 5 + 1] AS severity FROM event)
SELECT 'n' || event_id AS id, (['tsunami', 'flood', 'weather', 'fire', 'weather'])[event_id % 5 + 1] AS kind, CAST(CASE severity WHEN 'Minor' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Severe' THEN 2 ELSE 3 END AS INTEGER) AS level, CAST(event_id % 90 AS DOUBLE) AS west, CAST(event_id % 90 + 2 AS DOUBLE) AS east
FROM e WHERE event_id % 11 > 0 AND event_id % 13 > 1 AND severity <> 'Unknown' AND (severity <> 'Minor' OR event_id % 5 = 0) AND name <> 'Gale Warning'""")
def weather_service(spark, d):
    """Collections of the weather service, one for each user, to alerts."""
    k = F.col("event_id")
    pick = lambda names, at: F.get(F.array(*(F.lit(n) for n in names)), at)
    properties = F.struct(
        F.concat(F.lit("n"), k.cast("string")).alias("id"), pick(("Tsunami Advisory", "Flood Warning", "Gale Warning", "Red Flag Warning", "Heat Advisory"), (k % 5).cast("int")).alias("event"),
        pick(("Minor", "Moderate", "Severe", "Extreme", "Unknown"), (k % 7 % 5).cast("int")).alias("severity"), F.when(k % 11 > 0, "Actual").otherwise("Test").alias("status"), pick(("Cancel", "Ack", "Update", "Alert"), F.least(k % 13, F.lit(3)).cast("int")).alias("messageType"),
    )
    corner = lambda dx, dy: F.array((k % 90 + dx).cast("double"), F.lit(40.0 + dy))
    feature = F.struct(properties.alias("properties"), F.struct(F.array(F.array(corner(0, 0), corner(2, 1), corner(1, 3))).alias("coordinates")).alias("geometry"))
    bodies = events(spark, d).groupBy("user_id").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")).alias("body"))
    return feeds.weather_service_alerts(bodies).select("id", "kind", "level", "west", "east")


@plan("src14_volcanoes", "SELECT 'VAL-v' || s_suppkey AS id, CAST(least(s_suppkey % 6 - 2, 3) AS INTEGER) AS level, CAST(s_suppkey % 180 AS DOUBLE) AS west FROM supplier WHERE s_suppkey % 6 >= 2")
def volcanoes(spark, d):
    k = F.col("s_suppkey")
    feature = F.struct(F.struct(F.concat(F.lit("v"), k.cast("string")).alias("volcanoID"), F.col("s_name").alias("volcanoTitle"), (k % 6).alias("level")).alias("properties"), F.struct(F.array((k % 180).cast("double"), F.lit(-40.0)).alias("coordinates")).alias("geometry"))
    bodies = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")).alias("body"))
    return feeds.volcano_alerts(bodies).select("id", "level", "west")


@plan("src14_provinces", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS INTEGER) AS level, 'Wind ' || o_custkey AS title, CAST(epoch(TIMESTAMP '2024-05-01 00:00:00') AS BIGINT) + o_orderkey % 24 * 3600 AS starts FROM orders WHERE o_orderkey % 3 <> 1")
def provinces(spark, d):
    k = F.col("o_orderkey")
    pick = lambda names, at: F.get(F.array(*(F.lit(n) for n in names)), at.cast("int"))
    starts = F.format_string("2024-05-01T%02d:00:00Z", k % 24)
    properties = F.struct(pick(("active", "Ended", "continued"), k % 3).alias("status_en"), F.concat(F.lit("wind "), F.col("o_custkey").cast("string")).alias("alert_name_en"), pick(("grey", "Yellow", "orange", "red"), k % 4).alias("risk_colour_en"), starts.alias("validity_datetime"))
    feature = F.struct(k.cast("string").alias("id"), properties.alias("properties"))
    bodies = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")).alias("body"))
    return feeds.province_alerts(bodies).select("id", "level", "title", F.unix_timestamp("starts").alias("starts"))


@plan("src15_office_warnings", f"WITH {EVENT} SELECT 'o' || user_id % 30 AS office, event_type AS hazard, string_agg(DISTINCT 'z' || event_id % 25, ',' ORDER BY 'z' || event_id % 25) AS zones FROM event WHERE event_id % 4 > 0 GROUP BY ALL")
def office_warnings(spark, d):
    """Nested warnings: areas by warnings, zones gathered for each office and hazard."""
    e = events(spark, d).select(F.concat(F.lit("o"), (F.col("user_id") % 30).cast("string")).alias("office"), F.concat(F.lit("z"), (F.col("event_id") % 25).cast("string")).alias("code"), F.struct(F.col("event_type").alias("code"), F.when(F.col("event_id") % 4 > 0, "issued").otherwise("released").alias("status")).alias("w"))
    areas = e.groupBy("office", "code").agg(F.collect_list("w").alias("warnings")).groupBy("office").agg(F.collect_list(F.struct("code", "warnings")).alias("areas"))
    return feeds.office_warnings(areas.select(F.to_json(F.struct("office", "areas")).alias("body"))).select("office", "hazard", F.array_join("zones", ",").alias("zones"))


_ALERT = f"""{EVENT}, al AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'b' ELSE 'a' END AS source, CASE WHEN event_type = 'click' THEN 'quake' ELSE event_type END AS kind, event_id % 4 AS level, sec, sec AS starts, CASE WHEN event_id % 5 > 0 THEN sec + 90000 END AS ends,
CASE WHEN event_id % 6 > 0 THEN user_id % 40 END AS west, (event_id % 90) / 10.0 AS magnitude, event_id % 150 AS felt, 'z' || event_id % 20 AS zone FROM event),
kept AS (SELECT * FROM al a WHERE (ends IS NULL OR ends > 2000000) AND (west IS NULL OR (west <= 20 AND west + 3 >= 10)) AND (kind <> 'quake' OR magnitude >= 4.5 OR felt >= 100)
AND NOT (source = 'b' AND kind = 'quake' AND EXISTS (SELECT 1 FROM al b WHERE b.source = 'a' AND b.kind = 'quake' AND abs(a.sec - b.sec) <= 60 AND (b.ends IS NULL OR b.ends > 2000000) AND (b.west IS NULL OR (b.west <= 20 AND b.west + 3 >= 10)) AND (b.magnitude >= 4.5 OR b.felt >= 100))))"""


@plan("q11_alerts", f"WITH {_ALERT} SELECT source, kind, level, min(starts) AS starts, CASE WHEN count(*) = count(ends) THEN max(ends) END AS ends, left(string_agg(DISTINCT zone, ', ' ORDER BY zone), 160) AS zones FROM kept GROUP BY source, kind, level")
def selected_alerts(spark, d):
    """Active, relevant alerts of an area, doubles of a weaker source left out and copies for zones merged."""
    k = F.col("event_id")
    e = events(spark, d).select(
        k.alias("id"), F.when(k % 3 == 0, "b").otherwise("a").alias("source"), F.when(F.col("event_type") == "click", "quake").otherwise(F.col("event_type")).alias("kind"), (k % 4).alias("level"), "sec", F.col("sec").alias("starts"), F.when(k % 5 > 0, F.col("sec") + 90_000).alias("ends"),
        F.when(k % 6 > 0, F.col("user_id") % 40).cast("double").alias("west"), (k % 90 / 10).alias("magnitude"), (k % 150).alias("felt"), F.concat(F.lit("z"), (k % 20).cast("string")).alias("zone"),
    )
    e = e.withColumns({"east": F.col("west") + 3, "south": F.lit(40.0), "north": F.lit(41.0)})
    near = alerts.in_area(alerts.active(e, F.lit(2_000_000)), (10.0, 30.0, 20.0, 50.0))
    strong = near.where((F.col("kind") != "quake") | alerts.relevant_quake(F.col("magnitude"), F.col("felt"), F.lit(None), F.lit(False)))
    return alerts.merge_zones(alerts.drop_doubles(strong, "b", "a", "quake", 60), ["source", "kind", "level"], "zone")


@plan("u5_cell_merge", """WITH o AS (SELECT DISTINCT 6 AS z, (p_partkey * 37) % 64 AS x, (p_partkey * 91) % 64 AS y FROM part), n AS (SELECT DISTINCT 8 AS z, (s_suppkey * 11) % 256 AS x, (s_suppkey * 29) % 256 AS y FROM supplier UNION SELECT DISTINCT 4, (s_suppkey * 5) % 16, (s_suppkey * 7) % 16 FROM supplier WHERE s_suppkey % 9 = 0),
u AS (SELECT z, x, y, 'old' AS version FROM o WHERE (z, x, y) NOT IN (SELECT (z, x, y) FROM n) UNION ALL SELECT z, x, y, 'new' FROM n) SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.z > a.z AND b.x >> (b.z - a.z) = a.x AND b.y >> (b.z - a.z) = a.y)""")
def cell_merge(spark, d):
    """New cells in place of old, and none that holds another."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    k, m = F.col("p_partkey"), F.col("s_suppkey")
    old = p.select(F.lit(6).alias("z"), (k * 37 % 64).alias("x"), (k * 91 % 64).alias("y")).distinct().withColumn("version", F.lit("old"))
    new = s.select(F.lit(8).alias("z"), (m * 11 % 256).alias("x"), (m * 29 % 256).alias("y")).union(s.where("s_suppkey % 9 = 0").select(F.lit(4), m * 5 % 16, m * 7 % 16)).distinct().withColumn("version", F.lit("new"))
    return catalog.merge_cells(old, new)


@plan("x32_uncovered_cells", """WITH s AS (SELECT DISTINCT 6 AS z, (p_partkey * 37) % 64 AS x, (p_partkey * 91) % 64 AS y FROM part), p AS (SELECT DISTINCT 8 AS z, (s_suppkey * 11) % 256 AS x, (s_suppkey * 29) % 256 AS y FROM supplier UNION SELECT DISTINCT 4, (s_suppkey * 5) % 16, (s_suppkey * 7) % 16 FROM supplier WHERE s_suppkey % 9 = 0)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE (p.z >= s.z AND p.x >> greatest(p.z - s.z, 0) = s.x AND p.y >> greatest(p.z - s.z, 0) = s.y) OR (p.z < s.z AND s.x >> greatest(s.z - p.z, 0) = p.x AND s.y >> greatest(s.z - p.z, 0) = p.y))""")
def uncovered_cells(spark, d):
    """Seed cells that no published cell equals, holds or lies in."""
    k, m = F.col("p_partkey"), F.col("s_suppkey")
    seeds = table(spark, d, "part").select(F.lit(6).alias("z"), (k * 37 % 64).alias("x"), (k * 91 % 64).alias("y")).distinct()
    s = table(spark, d, "supplier")
    published = s.select(F.lit(8).alias("z"), (m * 11 % 256).alias("x"), (m * 29 % 256).alias("y")).union(s.where("s_suppkey % 9 = 0").select(F.lit(4), m * 5 % 16, m * 7 % 16)).distinct()
    return catalog.uncovered(seeds, published)


@plan("x3_spread_over_cells", """WITH b AS (SELECT s_suppkey AS id, s_suppkey % 20 AS x0, s_suppkey % 20 + s_suppkey % 4 AS x1, s_suppkey % 15 AS y0, s_suppkey % 15 + s_suppkey % 3 AS y1, s_suppkey * 12 AS n FROM supplier),
c AS (SELECT id, n, x1, x0, y1, y0, unnest(range(x0, x1 + 1)) AS x FROM b), e AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM c) SELECT x, y, CAST(round(sum(n * 1.0 / ((x1 - x0 + 1) * (y1 - y0 + 1))) * 1000) AS BIGINT) AS share FROM e GROUP BY x, y""")
def spread_over_cells(spark, d):
    """A count spread in equal parts over the cells that its box covers, then summed by cell."""
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select((k % 20).alias("x0"), (k % 20 + k % 4).alias("x1"), (k % 15).alias("y0"), (k % 15 + k % 3).alias("y1"), (k * 12).alias("n"))
    return spatial.spread(b, "n").groupBy("x", "y").agg(F.round(F.sum("share") * 1000).cast("long").alias("share"))


@plan("q24_carry_over", """WITH o AS (SELECT o_custkey AS page, max(CAST(o_orderdate AS DATE)) AS fetched FROM orders WHERE o_orderkey % 8 <> 1 GROUP BY 1), n AS (SELECT o_custkey AS page, max(CAST(o_orderdate AS DATE)) AS fetched FROM orders WHERE o_orderkey % 8 = 1 GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE page NOT IN (SELECT page FROM n) AND date_diff('day', fetched, DATE '1998-08-02') <= 300""")
def carry_over(spark, d):
    """New pages, and old ones that are missing if they are fresh enough."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = lambda rows: rows.groupBy(F.col("o_custkey").alias("page")).agg(F.max("day").alias("fetched"))
    return catalog.carry_over(last(o.where("o_orderkey % 8 <> 1")), last(o.where("o_orderkey % 8 = 1")), "page", "1998-08-02", 300)


@plan("x33_level_changes", """WITH a AS (SELECT o_custkey AS c, max(o_orderkey % 4) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS c, max(o_orderkey % 4) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT c, a.v AS before, b.v AS after, CASE WHEN b.v > a.v THEN 'raised' ELSE 'lowered' END AS change FROM a JOIN b USING (c) WHERE a.v <> b.v""")
def level_changes(spark, d):
    """Levels of advice that have changed between two editions; both come from one aggregate."""
    level = lambda r: F.max(F.when(F.col("o_orderkey") % 2 == r, F.col("o_orderkey") % 4))
    both = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(level(0).alias("before"), level(1).alias("after")).where("before <> after")
    return both.withColumn("change", F.when(F.col("after") > F.col("before"), "raised").otherwise("lowered"))


@plan("q28_overlay", """WITH k AS (SELECT c_custkey // 8 AS grp, c_custkey AS position, c_custkey % 40 AS c40, 'testo ' || c_custkey % 40 || ' di ' || c_custkey % 7 AS other FROM customer)
SELECT grp, position, CASE WHEN bool_and(c40 NOT IN (6, 18)) OVER (PARTITION BY grp) THEN other END AS translated FROM k""")
def translation_overlay(spark, d):
    """Translations by the hash of a paragraph, for whole groups or not at all; one whose numbers differ counts as missing."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    phrase = lambda a, b: F.concat(F.lit(a), (k % 40).cast("string"), F.lit(b), (k % 7).cast("string"))
    sections = c.select(F.floor(k / 8).alias("grp"), k.alias("position"), phrase("text ", " of ").alias("text"))
    wrong = F.when(k % 40 == 6, F.lit("testo 99 di 99")).otherwise(phrase("testo ", " di "))
    known = c.where("c_custkey % 40 <> 18").select(F.sha1(phrase("text ", " of ")).alias("key"), wrong.alias("text")).distinct()
    return catalog.overlay(sections, known, ["grp"]).select("grp", "position", "translated")


@plan("q16_address_merge", """WITH a AS (SELECT c_custkey % 90 AS street, nullif(c_mktsegment, 'BUILDING') AS city, c_custkey AS num FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey % 130 AS street, nullif(c_mktsegment, 'BUILDING') AS city, c_custkey AS num FROM customer WHERE c_custkey % 2 = 1),
u AS (SELECT DISTINCT street, city FROM a UNION SELECT DISTINCT street, city FROM b), n AS (SELECT *, row_number() OVER (ORDER BY street NULLS FIRST, city NULLS FIRST) AS id FROM u)
SELECT id AS street_id, num FROM (SELECT * FROM a UNION ALL SELECT * FROM b) r JOIN n ON r.street = n.street AND r.city IS NOT DISTINCT FROM n.city""")
def address_merge(spark, d):
    """Two regions' addresses under one numbering of streets; a street without a city is a street of its own."""
    part = lambda r, m: table(spark, d, "customer").where(f"c_custkey % 2 = {r}").select((F.col("c_custkey") % m).alias("street"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("city"), F.col("c_custkey").alias("num"))
    coded, _ = relational.dictionary_encode(part(0, 90).unionByName(part(1, 130)), ["street", "city"], "street_id")
    return coded.select(F.col("street_id").cast("long"), "num")


@plan("q15_address_dedup", f"""WITH {PLACE}, {STOP}, a AS (SELECT DISTINCT ON (lat_e6 // 1000, lon_e6 // 1000, nation) id, lat_e6, lon_e6, nation FROM place ORDER BY lat_e6 // 1000, lon_e6 // 1000, nation, id)
SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.nation = a.nation AND {PLANAR.format(lat1='a.lat_e6 / 1e6', lon1='a.lon_e6 / 1e6', lat2='s.lat_e6 / 1e6', lon2='s.lon_e6 / 1e6')} <= 40000)""")
def address_dedup(spark, d):
    """One row of each coarse point and number, without those that a better source has close by under the same number."""
    p = places(spark, d).withColumns({"cy": F.floor(F.col("lat_e6") / 1000), "cx": F.floor(F.col("lon_e6") / 1000)})
    once = relational.first_wins(p, ["cy", "cx", "nation"], ["id"])
    s = degrees(stops(spark, d)).select("nation", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return spatial.drop_near(degrees(once), s, 40_000, ["nation"]).select("id")


@plan("q18_city_facts", """WITH f AS (SELECT o_custkey, arg_max(o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END, o_orderdate, o_orderkey)) AS population FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey, coalesce(population, CASE WHEN c_acctbal > 0 THEN c_custkey * 10 END) AS population, c_nationkey = 4 AND c_custkey % 5 = 0 AS capital FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def city_facts(spark, d):
    """The best ranked, latest value of a fact, else the one that was known."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    rank = F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0), "o_orderdate", "o_orderkey")
    f = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", rank).alias("population"))
    known = F.when(F.col("c_acctbal") > 0, F.col("c_custkey") * 10)
    return table(spark, d, "customer").join(f, "c_custkey", "left").select("c_custkey", F.coalesce("population", known).alias("population"), ((F.col("c_nationkey") == 4) & (F.col("c_custkey") % 5 == 0)).alias("capital"))


@plan("x22_curated_first", "SELECT name, arg_min(price, (src, price)) AS price FROM (SELECT 0 AS src, p_name AS name, p_size AS price FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 1, p_name, p_size * 2 FROM part WHERE p_partkey % 4 > 0) GROUP BY name")
def curated_first(spark, d):
    """Prices by name, those of the curated source before others."""
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1).alias("src"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")).otherwise(F.col("p_size") * 2).alias("price"))
    return p.groupBy("name").agg(F.min_by("price", F.struct("src", "price")).alias("price"))


@plan("x23_rates", """WITH r AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 0 THEN 'eur' ELSE upper(left(n_name, 3)) END AS code, CASE WHEN n_nationkey % 5 = 0 THEN 'NaN' WHEN n_nationkey % 7 = 0 THEN '-1' ELSE CAST(n_nationkey * 3 AS VARCHAR) || '.5' END AS rate FROM nation)
SELECT k, code, CAST(round(CASE WHEN k = 11 THEN 4.25 ELSE CAST(rate AS DOUBLE) END * 100) AS BIGINT) AS cents FROM r WHERE regexp_full_match(code, '[A-Z]{3}') AND code <> 'EUR' AND ((k = 11) OR (rate <> 'NaN' AND CAST(rate AS DOUBLE) > 0))""")
def rates(spark, d):
    """Rates with an upper-case code and a finite positive value; one code comes from a second source."""
    k = F.col("n_nationkey")
    r = table(spark, d, "nation").select(k.alias("k"), F.when(k % 6 == 0, "eur").otherwise(F.upper(F.left("n_name", F.lit(3)))).alias("code"), F.when(k % 5 == 0, "NaN").when(k % 7 == 0, "-1").otherwise(F.concat((k * 3).cast("string"), F.lit(".5"))).alias("rate"))
    value = F.when(F.col("k") == 11, 4.25).otherwise(F.col("rate").try_cast("double"))
    return r.withColumn("value", value).where(F.col("code").rlike("^[A-Z]{3}$") & (F.col("code") != "EUR") & ~F.isnan("value") & (F.col("value") > 0)).select("k", "code", F.round(F.col("value") * 100).cast("long").alias("cents"))


@plan("x29_reference_merge", """WITH v AS (SELECT o_custkey AS code, o_orderkey AS id, 0 AS prio FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 1) SELECT code, arg_min(id, (prio, id)) AS id FROM v GROUP BY code""")
def reference_merge(spark, d):
    """Valid rows of the first source, and of the second those whose code it lacks."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("id"), "o_orderdate")
    first = relational.first_wins(o.where("o_orderdate >= timestamp '1996-01-01' and id % 2 = 0").drop("o_orderdate"), ["code"], ["id"])
    second = relational.first_wins(o.where("id % 2 = 1").drop("o_orderdate"), ["code"], ["id"])
    return relational.insert_absent(first, second, ["code"])


@plan("x30_best_values", """WITH v AS (SELECT c_custkey % 60 AS country, c_nationkey AS value, CASE c_custkey % 4 WHEN 0 THEN 'preferred' WHEN 1 THEN 'deprecated' ELSE 'normal' END AS rank FROM customer), b AS (SELECT *, bool_or(rank = 'preferred') OVER (PARTITION BY country) AS p FROM v WHERE rank <> 'deprecated')
SELECT country, string_agg(DISTINCT value, ',' ORDER BY value) AS vals FROM b WHERE rank = 'preferred' OR NOT p GROUP BY country""")
def best_values(spark, d):
    """Distinct values of a fact in order: preferred ones if there are any, never deprecated ones."""
    k = F.col("c_custkey")
    v = table(spark, d, "customer").where("c_custkey % 4 <> 1").select((k % 60).alias("country"), F.col("c_nationkey").alias("value"), (k % 4 == 0).alias("preferred"))
    sets = v.groupBy("country").agg(F.collect_set(F.when(F.col("preferred"), F.col("value"))).alias("p"), F.collect_set("value").alias("all"))
    return sets.select("country", F.array_join(F.transform(F.sort_array(F.when(F.size("p") > 0, F.col("p")).otherwise(F.col("all"))), lambda x: x.cast("string")), ",").alias("vals"))


@plan("x31_tolerant_codes", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS code FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def tolerant_codes(spark, d):
    """An unknown code drops only its own row."""
    code = relational.classify([(F.col("o_orderpriority") == p, str(i)) for i, p in ((1, "1-URGENT"), (2, "2-HIGH"), (3, "3-MEDIUM"))]).cast("int")
    return table(spark, d, "orders").select("o_orderkey", code.alias("code")).where("code is not null")


@plan("x34_version_ranges", """WITH h AS (SELECT s_suppkey AS cell, 4 AS z, (s_suppkey * 5) % 16 AS x, (s_suppkey * 7) % 16 AS y FROM supplier), r AS (SELECT n_nationkey AS pack, 4 AS z, n_nationkey % 12 AS x0, n_nationkey % 12 + 3 AS x1, n_nationkey % 10 AS y0, n_nationkey % 10 + 2 AS y1 FROM nation) SELECT cell, max(pack) AS pack FROM h JOIN r ON h.z = r.z AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY cell""")
def version_ranges(spark, d):
    """The newest package whose range of tiles holds a cell; ranges are dealt to tiles, so that cells meet them by equality."""
    m, k = F.col("s_suppkey"), F.col("n_nationkey")
    cells = table(spark, d, "supplier").select(m.alias("cell"), F.lit(4).alias("z"), (m * 5 % 16).alias("x"), (m * 7 % 16).alias("y"))
    ranges = table(spark, d, "nation").select(k.cast("long").alias("pack"), F.lit(4).alias("z"), F.explode(F.sequence((k % 12).cast("long"), (k % 12 + 3).cast("long"))).alias("x"), (k % 10).cast("long").alias("y0")).withColumn("y", F.explode(F.sequence("y0", F.col("y0") + 2)))
    return cells.join(ranges, ["z", "x", "y"]).groupBy("cell").agg(F.max("pack").cast("int").alias("pack"))


@plan("x20_retention", "SELECT conv_id, max(turn) AS last_turn, count(*) AS turns FROM conversations GROUP BY conv_id HAVING max(turn) >= 3")
def retention(spark, d):
    """Conversations that are kept: those with enough turns."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns")).where("last_turn >= 3")


@plan("t4_enum_order", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS r, o_orderpriority AS p FROM orders) ORDER BY r, p, o_orderkey LIMIT 200")
def enum_order(spark, d):
    """The first rows by the ordinal of an enumeration, then by name."""
    rank = F.array_position(F.array(*(F.lit(x) for x in ("P", "O", "F"))), F.col("o_orderstatus"))
    return table(spark, d, "orders").orderBy(rank, "o_orderpriority", "o_orderkey").limit(200).select("o_orderkey")


@plan("f17_f18_audience_names", """SELECT page_id, coalesce(nullif(regexp_extract(url, '/([a-z]+)[/.]', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'page') AS name FROM pages""")
def audience_names(spark, d):
    """A name by a chain of fallbacks: part of the address, else the title, else a fixed word."""
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", "/([a-z]+)[/.]", 1), F.lit("")), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), F.lit("page")).alias("name"))


@plan("ar4_ar5_translations", """WITH t AS (SELECT n_nationkey, [{'lang': 'en', 'text': n_name}, {'lang': CASE WHEN n_nationkey % 2 = 0 THEN 'it' ELSE 'fr' END, 'text': lower(n_name)}] AS names FROM nation) SELECT n_nationkey, coalesce(list_filter(names, lambda x: x.lang = 'it')[1].text, list_filter(names, lambda x: x.lang = 'en')[1].text) AS name FROM t""")
def translations(spark, d):
    """The text in the language asked for, else in English."""
    n = table(spark, d, "nation")
    pair = lambda lang, name: F.struct(lang.alias("lang"), name.alias("text"))
    names = F.array(pair(F.lit("en"), F.col("n_name")), pair(F.when(F.col("n_nationkey") % 2 == 0, "it").otherwise("fr"), F.lower("n_name")))
    return n.select("n_nationkey", text.in_language(names, "it").alias("name"))


@plan("q26_climate_fallback", f"WITH {EVENT}, c AS (SELECT user_id, CAST(month(day) AS INTEGER) AS month, avg(value) AS v FROM event WHERE event_type = 'purchase' GROUP BY ALL), a AS (SELECT CAST(month(day) AS INTEGER) AS month, avg(value) AS v FROM event GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM event) SELECT u.user_id, a.month, CAST(round(coalesce(c.v, a.v) * 100) AS BIGINT) AS value, c.v IS NULL AS fallback FROM u CROSS JOIN a LEFT JOIN c ON c.user_id = u.user_id AND c.month = a.month")
def climate_fallback(spark, d):
    """A city's monthly mean, else the mean of all; months are twelve at most, so they are dealt to each city as an array."""
    e = events(spark, d).select("user_id", F.month("day").alias("month"), "value", "event_type")
    every = e.groupBy("month").agg(F.avg("value").alias("all"))
    months = [r.month for r in every.select("month").collect()]  # twelve at most
    asked = e.select("user_id").distinct().withColumn("month", F.explode(F.array(*(F.lit(m) for m in months))))
    own = e.where("event_type = 'purchase'").groupBy("user_id", "month").agg(F.avg("value").alias("own"))
    found = asked.join(own, ["user_id", "month"], "left").join(every, "month")
    return found.select("user_id", "month", F.round(F.coalesce("own", "all") * 100).cast("long").alias("value"), F.col("own").isNull().alias("fallback"))


@plan("x15_zone_scopes", "WITH m AS (SELECT n_nationkey AS region, left(n_name, 2) AS prefix FROM nation) SELECT DISTINCT c_custkey, region FROM customer JOIN m ON left(c_mktsegment, 2) = prefix OR c_nationkey = region")
def zone_scopes(spark, d):
    """Zones to regions by prefix or by listed code: two equi-joins in place of one on either."""
    c, m = table(spark, d, "customer"), table(spark, d, "nation").select(F.col("n_nationkey").alias("region"), F.left("n_name", F.lit(2)).alias("prefix"))
    by_prefix = c.withColumn("prefix", F.left("c_mktsegment", F.lit(2))).join(m, "prefix").select("c_custkey", "region")
    by_code = c.join(m, F.col("c_nationkey") == F.col("region")).select("c_custkey", "region")
    return by_prefix.union(by_code).distinct()


@plan("x16_alert_wording", "SELECT o_orderkey, o_orderkey % 9 || '.' || o_orderkey % 10 AS magnitude, CAST(o_orderkey % 400 AS INTEGER) AS km, CASE o_orderkey % 3 WHEN 0 THEN 'NW' WHEN 1 THEN 'S' ELSE 'ESE' END AS bearing, 'Town ' || o_custkey AS place FROM orders")
def alert_wording(spark, d):
    """Parts of a quake's title."""
    k = F.col("o_orderkey")
    title = F.format_string("M %d.%d - %d km %s of Town %d", k % 9, k % 10, k % 400, F.when(k % 3 == 0, "NW").when(k % 3 == 1, "S").otherwise("ESE"), "o_custkey")
    parts = text.quake_title(title)
    return table(spark, d, "orders").select("o_orderkey", parts.alias("p")).select("o_orderkey", "p.magnitude", "p.km", "p.bearing", "p.place")


@plan("q6_summary", """WITH trip AS (SELECT c_custkey AS id, c_nationkey AS dest FROM customer), item AS (SELECT id, 'routine' AS v, 1 AS r, 'recommended' AS level FROM trip UNION ALL SELECT id, 'fever', 0, 'required' FROM trip WHERE dest % 3 = 0 UNION ALL SELECT id, 'polio', 1, 'recommended' FROM trip WHERE dest % 5 = 1 UNION ALL SELECT id, 'rabies', 2, 'consider' FROM trip WHERE id % 2 = 0),
g AS (SELECT id, r, level || ': ' || string_agg(v, ', ' ORDER BY v) AS line FROM item GROUP BY id, r, level) SELECT id, string_agg(line, '; ' ORDER BY r) AS text FROM g GROUP BY id""")
def summary(spark, d):
    """Requirements of each trip as a text."""
    from trekmill.operators.rules import summary as said

    item = lambda test, vaccine, level: F.when(test, F.struct(F.lit(vaccine).alias("vaccine"), F.lit(level).alias("level")))
    dest, k = F.col("c_nationkey"), F.col("c_custkey")
    items = F.array_compact(F.array(item(F.lit(True), "routine", "recommended"), item(dest % 3 == 0, "fever", "required"), item(dest % 5 == 1, "polio", "recommended"), item(k % 2 == 0, "rabies", "consider")))
    return said(table(spark, d, "customer").select(k.alias("id"), F.explode(items).alias("i")).select("id", "i.*"), ["id"])


@plan("q19_promotion", f"""WITH {PLACE}, {STOP}, e AS (SELECT stop_id, lon_e6 / 1e6 AS x, lat_e6 / 1e6 AS y FROM stop), edge AS (
SELECT stop_id, x - 0.4 AS x1, y - 0.3 AS y1, x + 0.5 AS x2, y - 0.1 AS y2 FROM e UNION ALL SELECT stop_id, x + 0.5, y - 0.1, x, y + 0.35 FROM e UNION ALL SELECT stop_id, x, y + 0.35, x - 0.4, y - 0.3 FROM e),
hit AS (SELECT DISTINCT id FROM (SELECT id, stop_id FROM (SELECT id, lat_e6 / 1e6 AS lat, lon_e6 / 1e6 AS lon FROM place) p JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, stop_id HAVING count(*) % 2 = 1))
SELECT id, id % 3 + CASE WHEN id IN (SELECT id FROM hit) THEN 2 ELSE 0 END AS fame FROM place""")
def promotion(spark, d):
    """Places inside a protected perimeter rise in rank; the others keep theirs."""
    corner = lambda dx, dy: F.struct((F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon"))
    rings = degrees(stops(spark, d)).select("stop_id", F.array(corner(-0.4, -0.3), corner(0.5, -0.1), corner(0, 0.35)).alias("ring"))
    p = degrees(places(spark, d))
    hit = regions.points_in_any(p, spatial.ring_edges(rings, "stop_id"), "id", "stop_id", 0.1).withColumn("hit", F.lit(2))
    return p.join(hit, "id", "left").select("id", (F.col("id") % 3 + F.coalesce("hit", F.lit(0))).alias("fame"))


@plan("c18_site_limits", """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, regexp_replace(url, '[0-9]+', '#', 'g') AS skeleton FROM pages), a AS (SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY page_id) AS ns FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS nw FROM a WHERE ns <= 2) SELECT page_id FROM b WHERE nw <= 10""")
def site_limits(spark, d):
    """Up to two rows of a skeleton, then up to ten of a site, in one order."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("site"), F.regexp_replace("url", "[0-9]+", "#").alias("skeleton"))
    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("page_id"))
    return p.withColumn("ns", nth("skeleton")).where("ns <= 2").withColumn("nw", nth("site")).where("nw <= 10").select("page_id")
