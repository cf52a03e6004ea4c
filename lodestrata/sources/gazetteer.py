"""Tables of places: name, country, lat, lon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = "name string, country string, lat double, lon double"
# The columns of the tab-separated tables of places, and of countries, that are published for download.
COLUMNS = ("id", "name", "ascii_name", "other_names", "lat", "lon", "class", "code", "country", "other_countries", "admin1", "admin2", "admin3", "admin4", "population", "elevation", "model", "zone", "changed")
COUNTRY_COLUMNS = ("iso", "iso3", "number", "fips", "country")


def _tabs(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Lines of fields between tabs, without quotes, by column; lines that begin with # are comments."""
    line = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t", -1).alias("f"))
    return line.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read(spark: SparkSession, path: str, countries: str | None = None, populated: bool = True) -> DataFrame:
    """The places of a tab-separated table; of populated places alone unless told otherwise.

    A line whose coordinates are no numbers is left out. The country is its code, or its name where a table of ``countries`` has it.
    """
    rows = _tabs(spark, path, COLUMNS).where((F.col("class") == "P") | (not populated))
    rows = rows.select("name", "country", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")).where("lat is not null and lon is not null")
    if countries:
        named = _tabs(spark, countries, COUNTRY_COLUMNS).groupBy(F.col("iso").alias("country")).agg(F.min("country").alias("_name"))
        rows = rows.join(named, "country", "left").select("name", F.coalesce("_name", "country").alias("country"), "lat", "lon")
    return rows


def load(spark: SparkSession, path: str, countries: str | None = None) -> DataFrame:
    """Places by a file's ending: Parquet, CSV with a header, or a tab-separated table."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".txt", ".tsv")):
        return read(spark, path, countries)
    return spark.read.schema(PLACES).option("header", True).csv(path)
