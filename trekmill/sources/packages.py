"""Writers of packages: whole tables, partitions, and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """The table in place of the one before; Spark's commit makes it whole or not at all."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """The partitions that df has in place of those before; others stay. Rows are dealt by partition first, to few files."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_addresses(points: DataFrame, path: str) -> None:
    """Streets by number and addresses as whole microdegrees from the least corner, duplicates once, in three tables."""
    from trekmill.operators.relational import dictionary_encode

    coded, streets = dictionary_encode(points.withColumns({"lat_e6": F.round(F.col("lat") * 1e6).cast("long"), "lon_e6": F.round(F.col("lon") * 1e6).cast("long")}), ["street", "city"], "street_id")
    origin = coded.agg(F.min("lat_e6").alias("origin_lat_e6"), F.min("lon_e6").alias("origin_lon_e6"))
    o = origin.first()  # one row
    rows = coded.select("street_id", F.col("number"), F.lower("number").alias("_n"), (F.col("lat_e6") - F.lit(o[0])).alias("dlat"), (F.col("lon_e6") - F.lit(o[1])).alias("dlon"))
    write_table(streets, f"{path}/street", ["street_id"])
    write_table(rows.dropDuplicates(["street_id", "_n", "dlat", "dlon"]).drop("_n"), f"{path}/address", ["street_id", "number"])
    write_table(origin, f"{path}/meta")


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """(street, city, number, lat, lon), the origin added again."""
    o = spark.read.parquet(f"{path}/meta").first()
    rows = spark.read.parquet(f"{path}/address").join(spark.read.parquet(f"{path}/street"), "street_id")
    return rows.select("street", "city", "number", ((F.col("dlat") + F.lit(o.origin_lat_e6)) / 1e6).alias("lat"), ((F.col("dlon") + F.lit(o.origin_lon_e6)) / 1e6).alias("lon"))
