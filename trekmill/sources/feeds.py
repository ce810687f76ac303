"""Readers of public feed formats as DataFrames with explicit schemas."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A feed table in CSV: quoted fields may hold line ends, a byte-order mark is dropped, missing columns are empty."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    raw = raw.toDF(*(c.removeprefix("﻿").strip() for c in raw.columns))
    return raw.select(*(F.coalesce(F.trim(raw[c]), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns))


def zip_entries(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, content): the entry of each archive whose last path part is name; a feed may sit in a sub-folder."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, data in zip(batch.path, batch.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows += [(p, z.read(n).decode("utf-8-sig")) for n in z.namelist() if n.rsplit("/", 1)[-1] == name][:1]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, content string")


def tsv_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small table by tabs, with # before comments."""
    return spark.read.options(sep="\t", comment="#", header=False).schema(schema).csv(path)


def points(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """(lat, lon, number, dataset, street, city) rows of a TSV inside a box; the last three may be missing."""
    rows = spark.read.options(sep="\t").schema("lat double, lon double, number string, dataset string, street string, city string").csv(path)
    return rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; a line that isn't JSON is dropped."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


def allowed(dataset: Column, licence: Column, pairs: list[tuple]) -> Column:
    """Whether (dataset, licence) is one of some pairs; the test reaches the scan."""
    test = F.lit(False)
    for d, v in pairs:
        test |= (dataset == d) & (licence == v)
    return test


def open_places(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, licences: list[tuple[str, str]]) -> DataFrame:
    """Parquet addresses inside a box whose (dataset, licence) is allowed; both filters reach the scan."""
    return spark.read.parquet(path).where(F.col("lat").between(south, north) & F.col("lon").between(west, east) & allowed(F.col("dataset"), F.col("licence"), licences))


_TAGS = "tag array<struct<_k:string,_v:string>>"


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, lat, lon, tags): tagged nodes, and ways and relations by their centre, once each over several files."""
    parts = []
    for kind in ("node", "way", "relation"):
        place = "_lat double, _lon double" if kind == "node" else "center struct<_lat:double,_lon:double>"
        rows = spark.read.format("xml").options(rowTag=kind).schema(f"_id long, {place}, {_TAGS}").load(path)
        at = [F.col(c if kind == "node" else f"center.{c}").alias(c[1:]) for c in ("_lat", "_lon")]
        tags = F.map_from_entries(F.transform("tag", lambda t: F.struct(t._k, t._v)))
        parts.append(rows.where("tag is not null and size(tag) > 0").select(F.lit(kind).alias("type"), F.col("_id").alias("id"), *at, tags.alias("tags")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("lat is not null").dropDuplicates(["type", "id"])


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(properties, lon, lat) of point features, one feature a line; a record separator before it is dropped."""
    feature = F.from_json(F.regexp_replace("value", "^\x1e", ""), "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>")
    rows = spark.read.text(path).select(feature.alias("f")).where("f.geometry.type = 'Point'")
    return rows.select("f.properties", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


ALERT = ["id", "source", "kind", "level", "title", "starts", "ends", "lon", "lat"]


def _level(magnitude: Column) -> Column:
    return F.when(magnitude >= 7, 3).when(magnitude >= 6, 2).when(magnitude >= 5, 1).otherwise(0)


def quake_alerts(raw: DataFrame, column: str = "body") -> DataFrame:
    """Alerts of earthquake GeoJSON collections, one a row; a bad entry is left out, a body that isn't a collection is an error."""
    schema = "type string, features array<struct<id:string,properties:struct<mag:double,place:string,time:long>,geometry:struct<coordinates:array<double>>>>"
    parsed = raw.select(F.from_json(column, schema).alias("c"))
    checked = parsed.select(F.when(F.col("c.type") != "FeatureCollection", F.raise_error(F.lit("not a feature collection"))).when(F.col("c.type").isNull(), F.raise_error(F.lit("not a feature collection"))).otherwise(F.col("c.features")).alias("features"))
    f = checked.select(F.explode("features").alias("f")).where("f.id is not null and f.properties.mag is not null and size(f.geometry.coordinates) >= 2")
    return f.select(
        F.col("f.id").alias("id"), F.lit("quakes").alias("source"), F.lit("earthquake").alias("kind"), _level(F.col("f.properties.mag")).alias("level"), F.col("f.properties.place").alias("title"),
        F.timestamp_millis("f.properties.time").alias("starts"), F.lit(None).cast("timestamp").alias("ends"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"),
    )


def cap_alerts(raw: DataFrame, column: str = "body") -> DataFrame:
    """(id, event, severity, starts, ends) of CAP messages, one a row: actual ones that don't cancel another.

    The start is the onset, else the effective, else the sent time.
    """
    names = ["status", "msgType", "identifier", "event", "severity", "onset", "effective", "sent", "expires"]
    apart = "\x01"  # no XML has it
    every = "concat(" + f", '{apart}', ".join(f"string(//*[local-name()='{n}'])" for n in names) + ")"
    # a generator's result, so that each message is parsed once whatever is asked of it
    rows = raw.select(F.explode(F.array(F.split(F.xpath_string(column, F.lit(every)), apart))).alias("parts"))
    part = lambda name: F.nullif(F.get("parts", F.lit(names.index(name))), F.lit(""))
    rows = rows.where(part("status").eqNullSafe("Actual") & ~part("msgType").eqNullSafe("Cancel"))
    return rows.select(part("identifier").alias("id"), part("event").alias("event"), part("severity").alias("severity"), F.coalesce(part("onset"), part("effective"), part("sent")).cast("timestamp").alias("starts"), part("expires").cast("timestamp").alias("ends"))


def office_warnings(raw: DataFrame, column: str = "body") -> DataFrame:
    """(office, hazard, zones) of nested warnings: areas by warnings, zones gathered for each office and hazard."""
    schema = "office string, areas array<struct<code:string,warnings:array<struct<code:string,status:string>>>>"
    areas = raw.select(F.from_json(column, schema).alias("j")).select("j.office", F.explode("j.areas").alias("a"))
    zones = areas.select("office", F.col("a.code").alias("zone"), F.explode("a.warnings").alias("w")).where("w.status <> 'released'")
    return zones.groupBy("office", F.col("w.code").alias("hazard")).agg(F.sort_array(F.collect_set("zone")).alias("zones"))


def wiki_pages(spark: SparkSession, path: str, titles: DataFrame) -> DataFrame:
    """(title, text) of the pages of a dump whose title is wanted; titles: one column `title`."""
    pages = spark.read.format("xml").options(rowTag="page").schema("title string, ns int, revision struct<text:struct<_VALUE:string>>").load(path)
    return pages.where("ns = 0").select("title", F.col("revision.text._VALUE").alias("text")).join(titles, "title", "left_semi")


#: The feed's severities and message types; of the product, events that it takes as for ships alone and words that tell a kind.
SEVERITIES = {"Minor": 0, "Moderate": 1, "Severe": 2, "Extreme": 3}
MESSAGES = ("Alert", "Update")
MARINE = (
    "Gale Warning", "Gale Watch", "Storm Warning", "Storm Watch", "Hurricane Force Wind Warning", "Hurricane Force Wind Watch", "Hazardous Seas Warning", "Hazardous Seas Watch",
    "Special Marine Warning", "Marine Weather Statement", "Small Craft Advisory", "Heavy Freezing Spray Warning", "Heavy Freezing Spray Watch", "Freezing Spray Advisory", "Low Water Advisory", "Brisk Wind Advisory",
)
KIND_WORDS = (
    ("tsunami", ("tsunami",)), ("volcano", ("volcano", "ashfall")), ("earthquake", ("earthquake",)), ("fire", ("fire", "red flag")), ("flood", ("flood", "storm surge")),
    ("cyclone", ("hurricane warning", "hurricane watch", "tropical storm", "tropical cyclone", "typhoon")),
)
ALWAYS_SHOWN = ("tsunami", "volcano")
#: Colours of the provinces' feed, its states of ended alerts, and least level of a volcano that is told.
COLOURS = {"yellow": 1, "orange": 2, "red": 3}
ENDED = ("ended", "cancelled")
VOLCANO_LEVEL = 2


def _features(raw: DataFrame, column: str, properties: str) -> DataFrame:
    """One row for each feature of GeoJSON collections (id, p, g); a body without a list of features is an error."""
    feature = f"struct<id:string,properties:struct<{properties}>,geometry:string>"
    parsed = F.from_json(column, f"features array<{feature}>").features
    checked = F.when(parsed.isNull(), F.raise_error(F.lit("not a feature collection"))).otherwise(parsed)
    return raw.select(F.explode(checked).alias("f")).where("f.properties is not null").select("f.id", F.col("f.properties").alias("p"), F.col("f.geometry").alias("g"))


def _ranked(values: dict[str, int], of: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[of]


def _box(geometry: Column) -> dict[str, Column]:
    """west, south, east, north of the [lon, lat] pairs of a geometry however deep its arrays are; null without any."""
    pairs = F.regexp_extract_all(geometry, F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(0))
    numbers = lambda i: F.transform(pairs, lambda x: F.split(F.translate(x, "[ ", ""), ",")[i].cast("double"))
    return {"west": F.array_min(numbers(0)), "south": F.array_min(numbers(1)), "east": F.array_max(numbers(0)), "north": F.array_max(numbers(1))}


def weather_service_alerts(raw: DataFrame, column: str = "body") -> DataFrame:
    """Alerts of the weather service's collections, one a row: actual new or updated ones above the lowest level.

    Tsunamis and volcanoes are told at any level, events for ships alone never. A bad entry is left out.
    """
    f = _features(raw, column, "id string, event string, severity string, status string, messageType string, onset string, effective string, sent string, ends string, expires string, areaDesc string".replace(" string", ":string"))
    name = F.lower("p.event")
    kind = F.coalesce(*(F.when(reduce(or_, (name.contains(w) for w in words)), kind) for kind, words in KIND_WORDS), F.lit("weather"))
    rows = f.select("*", F.coalesce("p.id", "id").alias("key"), kind.alias("kind"), _ranked(SEVERITIES, F.col("p.severity")).alias("level"))
    told = F.col("p.status").eqNullSafe("Actual") & F.col("p.messageType").isin(*MESSAGES) & ((F.col("level") > 0) | F.col("kind").isin(*ALWAYS_SHOWN)) & ~F.col("p.event").isin(*MARINE)
    return rows.where(told & F.col("key").isNotNull() & F.col("level").isNotNull()).select(
        F.col("key").alias("id"), F.lit("weather service").alias("source"), "kind", "level", F.col("p.event").alias("title"),
        F.try_to_timestamp(F.coalesce("p.onset", "p.effective", "p.sent")).alias("starts"), F.try_to_timestamp(F.coalesce("p.ends", "p.expires")).alias("ends"), *(e.alias(c) for c, e in _box(F.col("g")).items()),
    )


def province_alerts(raw: DataFrame, column: str = "body") -> DataFrame:
    """Alerts of the provinces' collections, one a row, without ended ones; a colour that isn't known is the lowest level."""
    f = _features(raw, column, "status_en:string,alert_name_en:string,risk_colour_en:string,validity_datetime:string,event_end_datetime:string,expiration_datetime:string")
    name = F.col("p.alert_name_en")
    rows = f.where(F.col("id").isNotNull() & name.isNotNull() & ~F.coalesce(F.lower("p.status_en").isin(*ENDED), F.lit(False)))
    return rows.select(
        "id", F.lit("provinces").alias("source"), F.lit("weather").alias("kind"), F.coalesce(_ranked(COLOURS, F.lower("p.risk_colour_en")), F.lit(0)).alias("level"), F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 1 << 20)).alias("title"),
        F.try_to_timestamp("p.validity_datetime").alias("starts"), F.try_to_timestamp(F.coalesce("p.event_end_datetime", "p.expiration_datetime")).alias("ends"), *(e.alias(c) for c, e in _box(F.col("g")).items()),
    )


def volcano_alerts(raw: DataFrame, column: str = "body") -> DataFrame:
    """Volcanoes of level 2 or more, one a row: 2 the lowest level, 5 the highest; their place is a point."""
    f = _features(raw, column, "volcanoID:string,volcanoTitle:string,level:int")
    rows = f.where(F.col("p.volcanoID").isNotNull() & F.col("p.volcanoTitle").isNotNull() & (F.col("p.level") >= VOLCANO_LEVEL))
    none = F.lit(None).cast("timestamp")
    return rows.select(F.concat(F.lit("VAL-"), "p.volcanoID").alias("id"), F.lit("volcanoes").alias("source"), F.lit("volcano").alias("kind"), F.least(F.col("p.level") - VOLCANO_LEVEL, F.lit(3)).alias("level"), F.col("p.volcanoTitle").alias("title"), none.alias("starts"), none.alias("ends"), *(e.alias(c) for c, e in _box(F.col("g")).items()))
