"""Alert enrichment from raw alerts to outbox rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave.operators import enrich, outbox
from iocweave.operators.keptindex import KeptIndex
from iocweave.sources import alerts as A


def prepare(alerts: DataFrame, now: Column) -> DataFrame:
    """Header and candidates of raw alerts; the text and its VARIANT are dropped before any exchange."""
    return A.extract_candidates(A.alert_header(A.parse_alerts(alerts), now)).drop("raw", "v")


def enrich_cycle(
    alerts: DataFrame, attributes: DataFrame, now: Column, results: DataFrame | None = None, **options
) -> dict[str, DataFrame]:
    """All tables of a cycle against the attributes of the store, not computed yet."""
    return outputs(enrich.enriched_alerts(prepare(alerts, now), attributes, now, results, **options), now)


def outputs(enriched: DataFrame, now: Column) -> dict[str, DataFrame]:
    return {
        "enriched_alerts": enriched.withColumn("enriched_at", now),
        "tag_outbox": outbox.tag_writeback(enriched, now),
        "tag_rejects": outbox.tag_rejects(enriched),
        "notify_outbox": outbox.notify_outbox(enriched, now),
        "summary": enrich.cycle_summary(enriched),
    }


def enrich_staged(
    alerts: DataFrame, index: KeptIndex, now: Column, stage: str, results: DataFrame | None = None, **options
) -> DataFrame:
    """Enriched alerts against a kept index. Header and candidates are written to ``stage`` first, so that alerts are
    parsed once; their distinct values are looked up in the index, which stays where it lies. Headers go to their alert at once."""
    prepare(alerts, now).write.mode("overwrite").parquet(stage)
    ready = alerts.sparkSession.read.parquet(stage)
    hits = index.hits(ready.select(F.explode("extracted_iocs").alias("value")))
    return enrich.enriched_alerts(ready, None, now, results, index=hits, at_hand=True, **options).withColumn("enriched_at", now)
