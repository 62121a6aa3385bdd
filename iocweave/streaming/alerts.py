"""Alert streams: enrichment against a store snapshot, and windowed counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from iocweave import tables
from iocweave.operators.keptindex import KeptIndex
from iocweave.plans import enrichment


def stream_alert_enrich(
    alerts: DataFrame,
    snapshot: Callable[[], tuple[DataFrame | KeptIndex, DataFrame | None]],
    out_path: str,
    checkpoint: str,
    now: Column | None = None,
    **options,
) -> StreamingQuery:
    """Enrich each micro-batch against the store as it is then: ``snapshot`` gives (store, results).

    The store is a kept index, of which a batch reads the rows of its values and nothing is aggregated, or the attributes,
    which are aggregated for every batch. The output folder of a batch is written whole, so a repeated batch replaces it.
    """
    clock = F.current_timestamp().cast("timestamp_ntz") if now is None else now

    def each(batch: DataFrame, batch_id: int) -> None:
        known, results = snapshot()
        if isinstance(known, KeptIndex):
            # Candidates and header are used twice, so they are put down once; the alert's text is not.
            stage = f"{out_path.rstrip('/')}_stage/batch_id={batch_id}"
            enriched = enrichment.enrich_staged(batch, known, clock, stage, results, **options)
        else:
            enriched = enrichment.enrich_cycle(batch, known, clock, results, **options)["enriched_alerts"]
        enriched.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        if isinstance(known, KeptIndex):
            tables.remove(batch.sparkSession, stage)

    return (
        alerts.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_hourly_metrics(enriched: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Enriched, matched and notified alerts per hour of ``enriched_at`` (TIMESTAMP); later rows than ``delay`` are dropped.

    In append mode an hour comes out once it is closed; ``write_hourly`` keeps open hours up to date too.
    """
    return (
        enriched.withWatermark("enriched_at", delay)
        .groupBy(F.window("enriched_at", "1 hour"))
        .agg(
            F.count("*").alias("enriched"),
            F.count_if(F.col("matched")).alias("matched"),
            F.count_if(F.col("notified")).alias("notified"),
        )
        .select(F.col("window.start").alias("hour"), "enriched", "matched", "notified")
    )


HOURLY = "hour timestamp, enriched bigint, matched bigint, notified bigint"


def write_hourly(enriched: DataFrame, out_path: str, checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """Every hour that a micro-batch changed, in the folder of the batch; ``read_hourly`` gives the latest counts."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return (
        stream_hourly_metrics(enriched, delay)
        .writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_hourly(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest counts of each hour, open ones included."""
    log = spark.read.schema(HOURLY + ", batch_id bigint").parquet(out_path)
    latest = F.max_by(F.struct("enriched", "matched", "notified"), "batch_id")
    return log.groupBy("hour").agg(latest.alias("c")).select("hour", "c.*")
