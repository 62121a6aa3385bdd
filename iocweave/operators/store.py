"""Indicator store tables: events, attributes and event tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import choose

# Defaults of the parameters below.
COMMENT_LENGTH = 255
TAGS_PER_IOC = 10


def with_event(iocs: DataFrame, run_date: Column) -> DataFrame:
    """Add the event of each row: one per feed and day, its id a digest of the title."""
    title = F.concat("source_feed", F.lit(K.EVENT_SEPARATOR), F.date_format(run_date, "yyyy-MM-dd"))
    return iocs.withColumns({"event_info": title, "run_date": run_date}).withColumn(
        "event_id", F.sha2(F.col("event_info"), 256)
    )


# What an attribute keeps of its indicator, so that a lookup can answer with it.
STORED_FIELDS = ("threat_level", "confidence", "first_seen", "last_seen", "attack_techniques")


def store_attributes(iocs: DataFrame, run_date: Column) -> DataFrame:
    """Rows to store. ``seq`` is the order of arrival: the day of the run, then ``ord``; lookups prefer the first."""
    stored = with_event(iocs, run_date)
    return stored.select(
        F.sha2(F.concat_ws("|", "event_id", "ioc_type", "value"), 256).alias("attribute_id"),
        "event_id",
        "event_info",
        F.col("ioc_type").alias("type"),
        "value",
        F.substring(F.coalesce("description", F.lit("")), 1, COMMENT_LENGTH).alias("comment"),
        F.lit(True).alias("to_ids"),
        "tags",
        F.struct(F.col("run_date").alias("day"), F.col("ord").alias("ord")).alias("seq"),
        *[c for c in STORED_FIELDS if c in iocs.columns],
        "source_feed",
        "run_date",
    )


def store_events(iocs: DataFrame, run_date: Column, existing: DataFrame | None = None) -> DataFrame:
    """Events to create: the level is that of the first row of the event. Existing ones are left alone."""
    events = (
        with_event(iocs, run_date)
        .groupBy("event_id", "event_info", "source_feed", "run_date")
        .agg(F.min_by("threat_level", "ord").alias("threat_level"), F.count("*").alias("attribute_count"))
        .select(
            "event_id",
            F.col("event_info").alias("title"),
            choose(F.col("threat_level"), K.THREAT_LEVEL_ID, "4").alias("threat_level_id"),
            "source_feed",
            "run_date",
            "attribute_count",
        )
    )
    return events if existing is None else events.join(existing.select("event_id"), "event_id", "left_anti")


def store_event_tags(iocs: DataFrame, run_date: Column) -> DataFrame:
    """Distinct (event, tag) rows: each indicator brings its first ten tags."""
    return (
        with_event(iocs, run_date)
        .select("event_id", "event_info", F.explode(F.slice("tags", 1, TAGS_PER_IOC)).alias("tag"))
        .distinct()
    )


def write_by_feed(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write partitioned by feed and day. The rebalance splits a large feed over several tasks and files."""
    rows.hint("rebalance", "source_feed", "run_date").write.partitionBy("source_feed", "run_date").mode(mode).parquet(path)


def batch_by_feed(iocs: DataFrame) -> DataFrame:
    """Rows stored per feed."""
    return iocs.groupBy("source_feed").agg(F.count("*").alias("stored"))
