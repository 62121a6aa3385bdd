"""Alerts as they land: clustered by source and day, with the header fields and the searched values beside the text.

An alert is parsed once, when it lands. Scans then filter on folders and on columns of the files, and read the text of
the rows that they return only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave import tables
from iocweave.operators import extract
from iocweave.operators.match import skew_join
from iocweave.sources import alerts as A

LANDED = (
    "alert_key string, alert_id string, alert_name string, severity string, triggered_at timestamp_ntz, "
    "searched array<string>, reason string, raw string, source_siem string, event_day date"
)
NOT_JSON = "not JSON"


def land_alerts(alerts: DataFrame, path: str, batch: str, now: Column) -> dict[str, int]:
    """Land one batch of ``alerts`` (alert_key, source_siem, raw) under ``path``; a repeated batch replaces itself.

    One pass over the texts. A text that is no JSON lands with a ``reason`` and an empty header, at the time ``now``, so
    it can be found. Returns how many came, and how many of them are refused. ``batch`` is a name without slashes. Rows
    of a day and source are spread over as many files as their size asks for, in order of time within each.
    """
    parsed = A.alert_header(A.parse_alerts(alerts), now)
    values = F.array_distinct(extract.elastic_path_values(F.col("v"), K.SEARCH_PATHS))
    counts = Observation()
    rows = parsed.select(
        "alert_key", "alert_id", "alert_name", "severity", "triggered_at", values.alias("searched"),
        F.when(F.try_parse_json("raw").isNull(), F.lit(NOT_JSON)).alias("reason"), "raw", "source_siem",
        F.to_date("triggered_at").alias("event_day"),
    ).observe(counts, F.count("*").alias("rows"), F.count_if(F.col("reason").isNotNull()).alias("refused"))
    target = f"{path.rstrip('/')}/batch={batch}"
    tables.remove(alerts.sparkSession, target)
    spread = rows.hint("rebalance", "source_siem", "event_day").sortWithinPartitions("source_siem", "event_day", "triggered_at")
    spread.write.partitionBy("source_siem", "event_day").parquet(target)
    return counts.get


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED + ", batch string").parquet(path)


def latest_landed(landed: DataFrame, source_siem: str, since: Column, size: int = 50) -> DataFrame:
    """Newest alerts of a source since a time, as ``alerts.latest_alerts`` gives them. Source and day are folders, the
    time is a column of the files: both filters reach the scan. Texts are not parsed; ``alerts.parse_alerts`` on the
    result parses those few."""
    recent = landed.filter(F.col("event_day") >= F.to_date(since))
    return A.latest_alerts(recent, source_siem, since, size).drop("searched", "event_day", "batch")


def search_landed(landed: DataFrame, values: DataFrame, per_value: int = 10) -> DataFrame:
    """Alerts that hold a value in one of the searched fields, as ``alerts.reverse_search`` gives them, without texts."""
    found = landed.select("alert_key", "triggered_at", F.explode("searched").alias("value")).filter("value IS NOT NULL")
    found = skew_join(found, values.select("value").distinct(), ["value"])
    newest = Window.partitionBy("value").orderBy(F.desc("triggered_at"), "alert_key")
    return found.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= per_value)
