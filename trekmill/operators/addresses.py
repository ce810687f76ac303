"""Search for addresses: streets by the start of their name or of a word in it, then a house number or the street's middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekmill.functions.text import house_number, search_key
from trekmill.operators.spatial import upper_median_point

#: Streets that are looked at for a house number, as not all of them have it.
CANDIDATES = 500


def search(streets: DataFrame, addresses: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(place, street_id, name, city, number, lat, lon): up to `limit` results for one text, one for each street, in order of `place`.

    streets: street_id, name, city; addresses: address_id, street_id, number, lat, lon (whole microdegrees or degrees). A house number
    stands at the text's start or end. Streets whose key starts with the text's come first, then those with a word that does,
    either by key and id. With a number the first address of a street with it, letters' case aside, is the result, among
    the first CANDIDATES streets; without, the address nearest the street's median in both axes, and number is null.
    Streets without such an address give no result. The streets are a top-k of the scan, and their ids alone are sent to the addresses.
    """
    asked = streets.sparkSession.range(1).select(F.lit(text).alias("t"), house_number(F.lit(text)).alias("number"))
    asked = asked.select(F.when(F.col("number") != "", F.col("number")).alias("number"), search_key(F.when(F.col("number") != "", F.replace("t", "number", F.lit(""))).otherwise(F.col("t"))).alias("key")).first()  # one row
    none = "place int, street_id long, name string, city string, number string, lat double, lon double"
    if not asked.key:
        return streets.sparkSession.createDataFrame([], none)
    key, wanted = search_key(F.col("name")), F.lit(asked.key)
    kind = F.when(key.startswith(wanted), 0).when(F.contains(key, F.concat(F.lit(" "), wanted)), 1)
    most = limit if asked.number is None else max(CANDIDATES, limit)
    found = streets.select("street_id", "name", "city", key.alias("key"), kind.alias("kind")).where("kind is not null").orderBy("kind", "key", "street_id").limit(most)
    places = F.row_number().over(Window.orderBy("kind", "key", "street_id"))  # CANDIDATES rows at most
    found = found.withColumn("place", places)
    there = addresses.join(F.broadcast(found.select("street_id")), "street_id")
    if asked.number is None:
        middle = upper_median_point(there, ["street_id"], "address_id")
        hits = there.join(F.broadcast(middle), ["street_id", "address_id"]).withColumn("number", F.lit(None).cast("string"))  # a row for each street
    else:
        first = F.min(F.struct("address_id", "number", "lat", "lon")).alias("a")
        hits = there.where(F.lower("number") == asked.number.lower()).groupBy("street_id").agg(first).select("street_id", "a.number", "a.lat", "a.lon")
    return found.join(hits.select("street_id", "number", "lat", "lon"), "street_id").orderBy("place").limit(limit).select("place", "street_id", "name", "city", "number", "lat", "lon")
