"""Keep-first dedup of indicator rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iocweave.functions.norm import accepted, canonical

KEY = ["value", "ioc_type"]


def normalise_rows(iocs: DataFrame) -> DataFrame:
    """Canonical values; refused rows go. Runs in the scan stage, before any shuffle."""
    value, ioc_type = F.col("value"), F.col("ioc_type")
    return iocs.filter(accepted(value, ioc_type)).withColumn("value", canonical(value, ioc_type))


def rejected_rows(iocs: DataFrame) -> DataFrame:
    """How many rows of each feed and type the normaliser refuses."""
    refused = iocs.filter(~accepted(F.col("value"), F.col("ioc_type")))
    return refused.groupBy("source_feed", "ioc_type").agg(F.count("*").alias("n"))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key.

    The rank filter is planned as a group limit on both sides of the exchange: each task sends at most one row
    per key, so a key that holds a large part of the input costs no more than any other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedup_keep_first(iocs: DataFrame) -> DataFrame:
    """First row per (value, type) in arrival order."""
    return keep_first(iocs, KEY, ["ord"])


def dedup_per_feed(iocs: DataFrame) -> DataFrame:
    """First row per (feed, value, type): each feed is normalised and de-duplicated on its own."""
    return keep_first(iocs.withColumn("_feed", F.col("ord.feed_rank")), ["_feed", *KEY], ["ord"]).drop("_feed")


def flag_first_feed(per_feed: DataFrame) -> DataFrame:
    """Mark the row of the feed that ran first as new (``first_feed``), later feeds' rows as duplicates.

    The input has one row per (feed, value, type), so a group is at most as large as the number of feeds.
    """
    w = Window.partitionBy(*KEY)
    return per_feed.withColumn(
        "first_feed", F.col("ord.feed_rank") == F.min("ord.feed_rank").over(w)
    )
