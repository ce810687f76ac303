"""Merges, differences, versions and package outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trekmill.operators import relational
from trekmill.plans.base import PLACE, places, plan, table


@plan("a1_counts_reclassified", "SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'cheap' ELSE 'other' END AS category, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def counts_reclassified(spark, d):
    by_tag = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    category = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "cheap").otherwise("other")
    return by_tag.groupBy(category.alias("category")).agg(F.sum("n").alias("n"), F.countDistinct("p_brand").alias("brands"))


@plan("a2_city_summary", "SELECT o_custkey, max(nullif(o_orderkey % 50, 0)) AS population, max(o_orderpriority = '1-URGENT') AS capital, CAST(sum(length(o_orderpriority)) AS BIGINT) AS body FROM orders GROUP BY o_custkey ORDER BY population DESC NULLS LAST, o_custkey")
def city_summary(spark, d):
    found = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.nullif(F.col("o_orderkey") % 50, F.lit(0))).alias("population"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("capital"), F.sum(F.length("o_orderpriority")).alias("body"))
    return found.orderBy(F.desc_nulls_last("population"), "o_custkey")


@plan("a3_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@plan("a5_exists", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS has_none FROM nation")
def exists(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("yes")).distinct()
    return n.join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("yes", F.lit(False)).alias("has_none"))


@plan("a6_distinct_counts", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY o_orderstatus")
def distinct_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 200_000).alias("large"))


@plan("a9_first_wins", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def first_wins(spark, d):
    return relational.first_wins(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@plan("a10_histogram", "SELECT p_type, p_brand, count(*) FILTER (p_size > 10) AS kept, count(*) FILTER (p_size <= 10) AS dropped FROM part GROUP BY ALL ORDER BY dropped DESC, p_type, p_brand LIMIT 80")
def histogram(spark, d):
    counts = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count_if(F.col("p_size") > 10).alias("kept"), F.count_if(F.col("p_size") <= 10).alias("dropped"))
    return counts.orderBy(F.desc("dropped"), "p_type", "p_brand").limit(80)


@plan("a16_valid_until", "SELECT l_suppkey, max(CAST(l_shipdate AS DATE)) AS valid_until FROM lineitem GROUP BY l_suppkey")
def valid_until(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.to_date("l_shipdate")).alias("valid_until"))


@plan("a23_size_estimate", f"WITH {PLACE} SELECT nation, CAST(sum(90 + strlen(name) + strlen(category)) AS BIGINT) AS bytes FROM place GROUP BY nation")
def size_estimate(spark, d):
    return places(spark, d).groupBy("nation").agg(F.sum(90 + F.octet_length("name") + F.octet_length("category")).alias("bytes"))


@plan("a24_content_version", """WITH l AS (SELECT DISTINCT o_custkey % 25 AS k, o_orderkey || ' ' || o_orderstatus AS line FROM orders), b AS (SELECT *, CAST('0x' || left(sha256(line), 4) AS INTEGER) % 64 AS bucket FROM l),
p AS (SELECT k, bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS part FROM b GROUP BY k, bucket) SELECT k, left(sha256(string_agg(bucket || ':' || part, chr(10) ORDER BY bucket || ':' || part)), 12) AS version FROM p GROUP BY k""")
def content_version(spark, d):
    return relational.content_version(table(spark, d, "orders").withColumn("k", F.col("o_custkey") % 25), ["k"], F.concat_ws(" ", "o_orderkey", "o_orderstatus"))


@plan("a25_stream_digest", """WITH l AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 256 AS b, p_partkey, p_partkey || ':' || length(p_name) AS line FROM part), o AS (SELECT b, sha256(string_agg(line, chr(10) ORDER BY p_partkey)) AS part FROM l GROUP BY b) SELECT sha256(string_agg(part, chr(10) ORDER BY b)) AS digest FROM o""")
def stream_digest(spark, d):
    """A digest of all (id, length) in order."""
    return relational.stream_digest(table(spark, d, "part"), ["p_partkey"], F.concat_ws(":", "p_partkey", F.length("p_name")))


@plan("snk2_dictionary", "WITH e AS (SELECT p_type, p_brand, row_number() OVER (ORDER BY p_type, p_brand) AS code FROM (SELECT DISTINCT p_type, p_brand FROM part)) SELECT p_partkey, code FROM part JOIN e USING (p_type, p_brand)")
def dictionary(spark, d):
    coded, _ = relational.dictionary_encode(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"])
    return coded.select("p_partkey", F.col("code").cast("long"))


@plan("snk4_address_rows", "SELECT DISTINCT ON (s, num, dx) dense_rank() OVER (ORDER BY s) AS street_id, num, dx FROM (SELECT p_name AS s, lower(p_brand) AS num, p_size - 1 AS dx FROM part)")
def address_rows(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias("s"), F.lower("p_brand").alias("num"), (F.col("p_size") - 1).alias("dx"))
    coded, _ = relational.dictionary_encode(part, ["s"], "street_id")
    return coded.dropDuplicates(["street_id", "num", "dx"]).select(F.col("street_id").cast("long"), "num", "dx")


@plan("snk10_insert_absent", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def insert_absent(spark, d):
    o = table(spark, d, "orders")
    keys = lambda r: o.where(f"o_orderkey % 2 = {r}").select("o_custkey").distinct()
    return relational.insert_absent(keys(0), keys(1), ["o_custkey"])


@plan("snk11_upsert", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def upsert(spark, d):
    return relational.latest_by(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@plan("u1_union", "SELECT 'c' AS source, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_suppkey, s_nationkey FROM supplier")
def union(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("source"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("s").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


@plan("u2_first_source_wins", "WITH u AS (SELECT 0 AS src, p_partkey AS id, p_name AS street, lower(p_brand) AS num FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 1, p_partkey, p_name, lower(p_brand) FROM part WHERE p_partkey % 2 = 1) SELECT street, num, arg_min(id, (src, id)) AS id FROM u GROUP BY street, num")
def first_source_wins(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 2).alias("src"), F.col("p_partkey").alias("id"), F.col("p_name").alias("street"), F.lower("p_brand").alias("num"))
    return p.groupBy("street", "num").agg(F.min_by("id", F.struct("src", "id")).alias("id"))


@plan("u3_difference", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R'")
def difference(spark, d):
    line = table(spark, d, "lineitem")
    return line.where("l_returnflag = 'R'").select("l_orderkey").distinct().join(line.where("l_returnflag <> 'R'").select("l_orderkey"), "l_orderkey", "left_anti")


@plan("u4_manifest_merge", """WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS map, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS poi FROM orders)
SELECT o_custkey, arg_max(map, o_orderkey) FILTER (map IS NOT NULL) AS map, arg_max(poi, o_orderkey) FILTER (poi IS NOT NULL) AS poi FROM f GROUP BY o_custkey""")
def manifest_merge(spark, d):
    """The latest value of each field by region; a fragment that lacks a field leaves the one before."""
    f = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("map"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("poi"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("o_orderkey", c)))[c].alias(c)
    return f.groupBy("o_custkey").agg(last("map"), last("poi"))


@plan("u6_group_replacement", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice > 300000) UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice > 300000")
def group_replacement(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1 and o_totalprice > 300000"), ["o_custkey"]).select("o_orderkey")


@plan("u7_two_way_diff", """WITH a AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1)
SELECT 'missing' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'new', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def two_way_diff(spark, d):
    p = table(spark, d, "part")
    a, b = (p.where(f"p_partkey % 2 = {r}").select("p_brand", "p_type", "p_size").distinct() for r in (0, 1))
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "*").union(b.exceptAll(a).select(F.lit("new").alias("side"), "*"))


@plan("u8_same_contents", "SELECT n_nationkey, n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 0) AS same FROM nation")
def same_contents(spark, d):
    """Whether two editions of each nation's suppliers hold the same rows as often: signed counts that all cancel out."""
    s = table(spark, d, "supplier")
    other = s.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    counts = s.withColumn("w", F.lit(1)).union(other.withColumn("w", F.lit(-1))).groupBy(*s.columns).agg(F.sum("w").alias("w"))
    odd = counts.where("w <> 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(False).alias("bad")).distinct()
    return table(spark, d, "nation").join(odd, "n_nationkey", "left").select("n_nationkey", F.coalesce("bad", F.lit(True)).alias("same"))


@plan("u10_rank_fusion", """WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS b, o_orderstatus FROM orders)
SELECT o_orderkey, CAST(round((CASE WHEN a <= 50 THEN 1.0 / (60 + a) ELSE 0 END + CASE WHEN b <= 50 THEN 2.0 / (60 + b) ELSE 0 END) * 1000000) AS BIGINT) AS score FROM r WHERE a <= 50 OR b <= 50""")
def rank_fusion(spark, d):
    """Two rankings of fifty in one: the sum of weight / (60 + rank)."""
    o = table(spark, d, "orders")
    def ranking(by, weight):
        n = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc(by), "o_orderkey"))
        return o.withColumn("n", n).where("n <= 50").select("o_orderkey", (weight / (60 + F.col("n"))).alias("s"))

    return ranking("o_totalprice", 1.0).union(ranking("o_orderdate", 2.0)).groupBy("o_orderkey").agg(F.round(F.sum("s") * 1e6).cast("long").alias("score"))


@plan("x4_overlap_max_rollup", "WITH m AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey, CAST(sum(q) AS BIGINT) AS quantity FROM m GROUP BY l_suppkey")
def overlap_max_rollup(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q")).groupBy("l_suppkey").agg(F.sum("q").cast("long").alias("quantity"))


@plan("x17_drift", """WITH a AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.v <> b.v""")
def drift(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(f"o_orderkey % 2 = {r}").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("v")) for r in (0, 1))
    return relational.differences(a, b, ["o_custkey"], "v")


@plan("x21_modes", "SELECT p_partkey, CASE WHEN t IN (0, 5) OR t // 100 = 9 THEN 'tram' WHEN t IN (1, 12) OR t // 100 IN (4, 5, 6) THEN 'metro' WHEN t = 2 OR t // 100 = 1 THEN 'train' WHEN t = 4 OR t // 100 IN (10, 12) THEN 'ferry' WHEN t = 3 OR t = 11 OR t // 100 IN (2, 7, 8) THEN 'bus' ELSE 'other' END AS mode FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size % 13 ELSE p_size * 33 END AS t FROM part)")
def modes(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") % 13).otherwise(F.col("p_size") * 33)
    hundreds = F.floor(t / 100)
    rules = [(t.isin(0, 5) | (hundreds == 9), "tram"), (t.isin(1, 12) | hundreds.isin(4, 5, 6), "metro"), ((t == 2) | (hundreds == 1), "train"), ((t == 4) | hundreds.isin(10, 12), "ferry"), (t.isin(3, 11) | hundreds.isin(2, 7, 8), "bus")]
    return table(spark, d, "part").select("p_partkey", relational.classify(rules, "other").alias("mode"))


@plan("x24_pivot_bounds", "SELECT l_suppkey, CAST(min(l_quantity) FILTER (l_returnflag = 'A') AS BIGINT) AS a_min, CAST(max(l_quantity) FILTER (l_returnflag = 'A') AS BIGINT) AS a_max, CAST(min(l_quantity) FILTER (l_returnflag = 'N') AS BIGINT) AS n_min, CAST(max(l_quantity) FILTER (l_returnflag = 'N') AS BIGINT) AS n_max FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'N') > 0")
def pivot_bounds(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N"]).agg(F.min("l_quantity").cast("long").alias("min"), F.max("l_quantity").cast("long").alias("max"))
    return p.select("l_suppkey", F.col("A_min").alias("a_min"), F.col("A_max").alias("a_max"), F.col("N_min").alias("n_min"), F.col("N_max").alias("n_max")).dropna()


@plan("q17_enrichment", "SELECT c_custkey, greatest(coalesce(c_custkey % 4, 0), coalesce(s_suppkey % 6, 0)) AS fame FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 3 AND c_nationkey <> s_nationkey")
def enrichment(spark, d):
    """Fame from a lookup, never below what was known, and only from a plausible match."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier").withColumn("key", F.col("s_suppkey") * 3)
    found = c.join(s, (c.c_custkey == s.key) & (c.c_nationkey != s.s_nationkey), "left")
    return found.select("c_custkey", F.greatest(F.coalesce(F.col("c_custkey") % 4, F.lit(0)), F.coalesce(F.col("s_suppkey") % 6, F.lit(0))).alias("fame"))


@plan("q20_fragment_outcomes", """WITH f AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'invalid' WHEN o_totalprice < 30000 THEN 'too_small' END AS bad FROM orders)
SELECT coalesce(bad, CASE WHEN n = 1 THEN 'selected' ELSE 'superseded' END) AS outcome, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, bad IS NULL ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM f) GROUP BY 1""")
def fragment_outcomes(spark, d):
    bad = F.when(F.col("o_orderstatus") == "P", "invalid").when(F.col("o_totalprice") < 30000, "too_small")
    f = table(spark, d, "orders").withColumn("bad", bad)
    n = F.row_number().over(Window.partitionBy("o_custkey", F.col("bad").isNull()).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return f.withColumn("n", n).groupBy(F.coalesce("bad", F.when(F.col("n") == 1, "selected").otherwise("superseded")).alias("outcome")).agg(F.count("*").alias("n"))


@plan("q25_catalog_violations", """SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey > 20 THEN 'host' END, CASE WHEN c_custkey % 50 = 0 THEN 'version' END], lambda x: x IS NOT NULL)) AS rule FROM customer""")
def catalog_violations(spark, d):
    rules = [(F.col("c_acctbal") < 0, "negative"), ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") > 20), "host"), (F.col("c_custkey") % 50 == 0, "version")]
    found = F.filter(F.array(*(F.when(test, name) for test, name in rules)), lambda x: x.isNotNull())
    return table(spark, d, "customer").select("c_custkey", F.explode(found).alias("rule"))


@plan("q30_stale_packages", "SELECT c_custkey, coalesce(v, 0) AS installed, m.published FROM (SELECT o_custkey, count(*) AS published FROM orders GROUP BY 1) m JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) i ON k = c_custkey WHERE coalesce(v, 0) < m.published")
def stale_packages(spark, d):
    """Packages whose published version is above the installed one; one aggregate gives both."""
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("published"), F.count_if(F.col("o_orderstatus") == "F").alias("installed"))
    return table(spark, d, "customer").join(v, "c_custkey").where("installed < published").select("c_custkey", "installed", "published")


#: Source tables of requirements made from nations, and trips with their routes made from orders.
_HEALTH = """n AS (SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS country FROM nation),
yf_risk AS (SELECT k AS place, country, k % 8 = 0 AS partial, 'area ' || country AS areas FROM n WHERE k % 4 = 0),
yf_entry AS (SELECT k AS place, country, CASE k % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'all' WHEN 3 THEN 'from_list' ELSE 'from_risk' END AS rule, CASE WHEN k % 2 = 0 THEN 9 + k % 4 END AS min_age, CASE k % 6 WHEN 0 THEN 'none' WHEN 2 THEN '4h' WHEN 3 THEN '12h' WHEN 4 THEN '24h' ELSE 'any' END AS stopover, k % 6 = 1 AS exit_required, 'yf ' || country AS note FROM n WHERE k % 3 < 2),
yf_from AS (SELECT e.country, m.country AS origin FROM yf_entry e JOIN n m ON (m.k * 3 + e.place) % 7 = 0 WHERE rule = 'from_list' UNION SELECT e.country, r.country FROM yf_entry e JOIN yf_risk r ON rule = 'from_risk'),
polio_status AS (SELECT k AS place, country, CASE k % 5 WHEN 1 THEN 'severe' WHEN 2 THEN 'cvdpv2' ELSE 'previous' END AS category FROM n WHERE k % 5 IN (1, 2, 3) UNION ALL SELECT k + 100, country, 'cvdpv2' FROM n WHERE k % 10 = 1),
polio_entry AS (SELECT k + 100 * i AS place, country, k % 7 = 0 AND i = 0 AS unlisted, CASE WHEN (k + i) % 2 = 0 THEN 'severe' END AS category, CASE WHEN k % 4 = 3 THEN 'hajj_umrah' ELSE 'all' END AS applies, 'polio ' || country AS note, k FROM n, (SELECT unnest([0, 1]) AS i) WHERE k % 3 = 0),
polio_from AS (SELECT p.place, m.country AS origin FROM polio_entry p JOIN n m ON (m.k + p.k) % 9 = 0 UNION SELECT p.place, s.country FROM polio_entry p JOIN polio_status s USING (category)),
special AS (SELECT country, 'menacwy' AS vaccine, 12 AS min_age, 'special ' || country AS note FROM n WHERE k % 6 = 0 UNION ALL SELECT country, 'polio', NULL, 'dose ' || country FROM n WHERE k % 12 = 0),
recommended AS (SELECT country, v AS vaccine, (k + len(v)) % 3 > 0 AS most, v || ' ' || country AS note FROM n, (SELECT unnest(['hepa', 'typhoid', 'yellow_fever', 'menacwy', 'polio', 'rabies']) AS v) WHERE (k * 7 + len(v)) % 4 > 0),
trip AS (SELECT o_orderkey AS trip_id, CAST(o_custkey * 7 % 25 AS VARCHAR) AS departure, CAST(o_orderkey % 25 AS VARCHAR) AS destination, o_orderkey % 40 IN (3, 17) AS exempt, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 60 END AS age, o_orderkey % 2 = 0 AS long_stay, o_orderkey % 3 = 0 AS hajj, departure <> destination AS travels FROM orders),
stop AS (SELECT o_orderkey AS trip_id, 1 AS pos, CAST(o_orderkey * 11 % 25 AS VARCHAR) AS country, 'stay' AS kind, NULL AS hours, NULL AS left_airport FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 2, CAST((o_custkey * 13 + o_orderkey) % 25 AS VARCHAR), 'stopover', CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 30 END, o_orderkey % 7 = 0 FROM orders UNION ALL SELECT o_orderkey, 3, CAST(o_orderkey * 17 % 25 AS VARCHAR), 'stopover', o_custkey % 26, NULL FROM orders WHERE o_orderkey % 5 = 2)"""


def _health(spark, d):
    """The same tables as DataFrames, and the rules made from them."""
    from trekmill.operators import requirements

    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_nationkey").cast("string").alias("country"))
    k, none = F.col("k"), F.lit(None)
    text = lambda word: F.concat(F.lit(f"{word} "), "country")
    pick = lambda by, cases, other: F.coalesce(*(F.when(by == v, F.lit(w)) for v, w in cases.items()), F.lit(other))
    among = lambda of, test: of.join(n.select(F.col("k").alias("m"), F.col("country").alias("origin")), F.expr(test), "left").groupBy(of.columns).agg(F.collect_list("origin").alias("o"))
    risk = n.where("k % 4 = 0").select(k.alias("place"), "country", (k % 8 == 0).alias("partial"), text("area").alias("areas"))
    entry = among(n.where("k % 3 < 2"), "(m * 3 + k) % 7 = 0").select(k.alias("place"), "country", pick(k % 5, {0: "none", 1: "all", 3: "from_list"}, "from_risk").alias("rule"), F.when(k % 2 == 0, 9 + k % 4).alias("min_age"), pick(k % 6, {0: "none", 2: "4h", 3: "12h", 4: "24h"}, "any").alias("stopover"), F.col("o").alias("from_list"), (k % 6 == 1).alias("exit_required"), text("yf").alias("note"))
    status = n.where("k % 5 in (1, 2, 3)").select(k.alias("place"), "country", pick(k % 5, {1: "severe", 2: "cvdpv2"}, "previous").alias("category")).unionByName(n.where("k % 10 = 1").select((k + 100).alias("place"), "country", F.lit("cvdpv2").alias("category")))
    doses = among(n.where("k % 3 = 0"), "(m + k) % 9 = 0").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    polio = doses.select((k + 100 * F.col("i")).alias("place"), "country", ((k % 7 == 0) & (F.col("i") == 0)).alias("unlisted"), F.when((k + F.col("i")) % 2 == 0, "severe").alias("origin_category"), F.col("o").alias("origin_countries"), F.lit("ipv").alias("dose"), F.lit("any").alias("window"), F.when(k % 4 == 3, "hajj_umrah").otherwise("all").alias("applies"), text("polio").alias("note"))
    special = n.where("k % 6 = 0").select(k.alias("place"), "country", F.lit("hajj_umrah").alias("purpose"), F.lit("menacwy").alias("vaccine"), F.lit(12).alias("min_age"), text("special").alias("note")).unionByName(n.where("k % 12 = 0").select((k + 100).alias("place"), "country", F.lit("hajj_umrah").alias("purpose"), F.lit("polio").alias("vaccine"), none.cast("int").alias("min_age"), text("dose").alias("note")))
    some = n.withColumn("vaccine", F.explode(F.array(*map(F.lit, ("hepa", "typhoid", "yellow_fever", "menacwy", "polio", "rabies"))))).where((k * 7 + F.length("vaccine")) % 4 > 0)
    recommended = some.select(k.alias("place"), "country", "vaccine", ((k + F.length("vaccine")) % 3 > 0).alias("most"), F.concat("vaccine", F.lit(" "), "country").alias("condition"))
    rules = requirements.compile_rules(entry, risk, status, polio, special, recommended, ("r3", "r17"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    key, cust, s = F.col("o_orderkey"), F.col("o_custkey"), "string"
    trips = o.select(key.alias("trip_id"), (cust * 7 % 25).cast(s).alias("departure"), (key % 25).cast(s).alias("destination"), F.concat(F.lit("r"), (key % 40).cast(s)).alias("region"), F.when(key % 5 > 0, cust % 60).alias("age"), (key % 2 == 0).alias("long_stay"), F.when(key % 3 == 0, "hajj_umrah").alias("purpose"))
    stop = lambda rows, pos, country, kind, hours, left: rows.select(key.alias("trip_id"), F.lit(pos).alias("pos"), country.cast(s).alias("country"), F.lit(kind).alias("kind"), hours.cast("int").alias("hours"), left.cast("boolean").alias("left_airport"))
    stops = stop(o.where("o_orderkey % 4 = 1"), 1, key * 11 % 25, "stay", none, none).unionByName(stop(o, 2, (cust * 13 + key) % 25, "stopover", F.when(key % 6 > 0, key % 30), key % 7 == 0)).unionByName(stop(o.where("o_orderkey % 5 = 2"), 3, key * 17 % 25, "stopover", cust % 26, none))
    return requirements.requirements(trips, stops, rules)


@plan("q5_requirements", f"""WITH {_HEALTH}, home AS (SELECT trip_id, 0 AS g, 0 AS pos, departure AS country, NULL AS hours, false AS passing, destination FROM trip
UNION ALL SELECT s.trip_id, CASE WHEN kind = 'stay' THEN 1 WHEN left_airport THEN 2 ELSE 3 END, pos, country, CASE WHEN kind = 'stopover' AND NOT coalesce(left_airport, false) THEN hours END, kind = 'stopover' AND NOT coalesce(left_airport, false), destination FROM stop s JOIN trip USING (trip_id)),
origin AS (SELECT * FROM home WHERE country <> destination),
e AS (SELECT t.*, y.rule, y.min_age, y.note, o.country AS via, o.hours, o.passing, row_number() OVER (PARTITION BY t.trip_id ORDER BY g, pos) AS nth FROM trip t JOIN yf_entry y ON y.country = destination LEFT JOIN origin o ON o.trip_id = t.trip_id AND rule <> 'all'
  WHERE travels AND rule <> 'none' AND (rule = 'all' OR ((y.country, o.country) IN (SELECT (country, origin) FROM yf_from) AND (NOT passing OR stopover = 'any' OR (stopover = '4h' AND (hours IS NULL OR hours > 4)) OR (stopover = '12h' AND (hours IS NULL OR hours > 12)) OR (stopover = '24h' AND (hours IS NULL OR hours > 24)))))),
i1 AS (SELECT trip_id, 'yellow_fever' AS vaccine, CASE WHEN age < min_age THEN 'consider' ELSE 'required' END AS level, 'yf_entry_' || rule AS reason, via AS country, hours, coalesce(passing, false) AS stopover, CASE WHEN min_age IS NULL THEN 'none' WHEN age IS NULL THEN 'from_age' WHEN age < min_age THEN 'below_age' ELSE 'none' END AS age_note, note FROM e WHERE nth = 1),
i2 AS (SELECT trip_id, 'yellow_fever', CASE WHEN age < min_age THEN 'consider' ELSE 'required_exit' END, 'yf_exit', departure, NULL, false, CASE WHEN min_age IS NULL THEN 'none' WHEN age IS NULL THEN 'from_age' WHEN age < min_age THEN 'below_age' ELSE 'none' END, note FROM trip JOIN yf_entry y ON y.country = departure WHERE travels AND exit_required),
yf AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2),
i3 AS (SELECT trip_id, 'yellow_fever', CASE WHEN age < 9 THEN 'consider' ELSE 'recommended' END, 'yf_destination_risk', destination, NULL, false, CASE WHEN age < 9 THEN 'below_age' ELSE 'none' END, CASE WHEN partial THEN areas END FROM trip JOIN yf_risk r ON r.country = destination WHERE NOT exempt AND trip_id NOT IN (SELECT trip_id FROM yf WHERE age_note <> 'below_age')),
i4 AS (SELECT trip_id, 'polio', 'required_exit', 'polio_exit', departure, NULL, false, 'none', NULL FROM trip JOIN polio_status s ON s.country = departure AND category = 'severe' WHERE travels AND long_stay),
i5 AS (SELECT trip_id, 'polio', 'encouraged', 'polio_encouraged', departure, NULL, false, 'none', NULL FROM trip JOIN polio_status s ON s.country = departure AND category = 'cvdpv2' WHERE travels AND trip_id NOT IN (SELECT trip_id FROM i4)),
i6 AS (SELECT trip_id, 'polio', 'consider', 'polio_entry_unlisted', destination, NULL, false, 'none', note FROM trip JOIN polio_entry p ON p.country = destination WHERE travels AND unlisted AND (applies = 'all' OR hajj)),
i7 AS (SELECT trip_id, 'polio', 'required', 'polio_entry', via, NULL, false, 'none', note FROM (SELECT t.trip_id, p.note, o.country AS via, row_number() OVER (PARTITION BY t.trip_id, p.note, applies ORDER BY p.place, g, pos) AS nth FROM trip t JOIN polio_entry p ON p.country = destination JOIN origin o ON o.trip_id = t.trip_id AND NOT passing WHERE travels AND NOT unlisted AND (applies = 'all' OR hajj) AND (p.place, o.country) IN (SELECT (place, origin) FROM polio_from)) WHERE nth = 1),
i8 AS (SELECT trip_id, s.vaccine, CASE WHEN age < min_age THEN 'consider' ELSE 'required' END, 'hajj_umrah', destination, NULL, false, CASE WHEN min_age IS NULL THEN 'none' WHEN age IS NULL THEN 'from_age' WHEN age < min_age THEN 'below_age' ELSE 'none' END, note FROM trip JOIN special s ON s.country = destination WHERE hajj),
had AS (SELECT * FROM yf UNION ALL SELECT * FROM i3 UNION ALL SELECT * FROM i4 UNION ALL SELECT * FROM i5 UNION ALL SELECT * FROM i6 UNION ALL SELECT * FROM i7 UNION ALL SELECT * FROM i8),
i9 AS (SELECT trip_id, r.vaccine, CASE WHEN most THEN 'recommended' ELSE 'consider' END, CASE WHEN most THEN 'destination_most' ELSE 'destination_some' END, destination, NULL, false, 'none', note FROM trip JOIN recommended r ON r.country = destination
  WHERE NOT (exempt AND r.vaccine = 'yellow_fever') AND (trip_id, r.vaccine) NOT IN (SELECT (trip_id, vaccine) FROM had WHERE age_note <> 'below_age' OR vaccine = 'yellow_fever'))
SELECT * FROM had UNION ALL SELECT * FROM i9 UNION ALL SELECT trip_id, 'routine', 'recommended', 'routine', departure, NULL, false, 'none', NULL FROM trip""")
def trip_requirements(spark, d):
    """What each order's trip needs by all kinds of rules: entry, exit, risk, polio, purpose, recommendations."""
    return _health(spark, d).drop("level_rank", "vaccine_rank")


@plan("q5_rule_engine", """WITH trip AS (SELECT c_custkey AS id, c_nationkey AS dest, (c_nationkey * 7 + c_custkey) % 25 AS origin, c_custkey % 80 AS age FROM customer),
item AS (SELECT id, 'fever' AS vaccine, CASE WHEN age < 9 THEN 'consider' ELSE 'required' END AS level FROM trip WHERE dest % 3 = 0 AND origin % 4 = 0
UNION ALL SELECT id, 'polio', 'recommended' FROM trip WHERE dest % 5 = 1
UNION ALL SELECT id, 'fever', 'consider' FROM trip WHERE dest % 2 = 0 AND NOT (dest % 3 = 0 AND origin % 4 = 0 AND age >= 9)
UNION ALL SELECT id, 'routine', 'recommended' FROM trip)
SELECT id, vaccine, arg_min(level, CASE level WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END) AS level FROM item GROUP BY id, vaccine""")
def rule_engine(spark, d):
    """Rules as joins that give (level, reason) rows, unioned; the strongest level of a vaccine wins."""
    from trekmill.operators.rules import strongest

    trip = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dest"), ((F.col("c_nationkey") * 7 + F.col("c_custkey")) % 25).alias("origin"), (F.col("c_custkey") % 80).alias("age"))
    entry = (F.col("dest") % 3 == 0) & (F.col("origin") % 4 == 0)
    item = lambda test, vaccine, level: F.when(test, F.struct(F.lit(vaccine).alias("vaccine"), level.alias("level")))
    items = F.array(
        item(entry, "fever", F.when(F.col("age") < 9, F.lit("consider")).otherwise(F.lit("required"))), item(F.col("dest") % 5 == 1, "polio", F.lit("recommended")),
        item((F.col("dest") % 2 == 0) & ~(entry & (F.col("age") >= 9)), "fever", F.lit("consider")), item(F.lit(True), "routine", F.lit("recommended")),
    )
    return strongest(trip.select("id", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i")).select("id", "i.*"), ["id"])
