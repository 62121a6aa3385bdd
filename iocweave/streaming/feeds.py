"""Continuous feed ingest and event-time dedup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from iocweave import tables
from iocweave.operators import dedup, seen
from iocweave.operators.match import skew_join
from iocweave.operators.seenlog import SeenLog
from iocweave.session import ensure_checkpoint_dir


def ingest_batch(
    rows: DataFrame, log: SeenLog, out_path: str, batch_id: int, now: Column, ttl_days: int = seen.TTL_DAYS
) -> None:
    """One micro-batch: keep first, drop live keys, store the new rows, mark them as seen.

    A batch that is repeated after a failure replaces what it wrote: the folder of its rows, and its generation of the
    log, which it does not look at itself. The rows go first: the mark must never exist without them.
    """
    gen = f"b{batch_id}"
    batch = dedup.dedup_keep_first(dedup.normalise_rows(rows))
    flagged = log.flag(batch, now, without=gen)
    flagged.filter("NOT is_seen").drop("is_seen").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    accepted = rows.sparkSession.read.schema(batch.schema).parquet(f"{out_path}/batch_id={batch_id}")
    log.append(gen, seen.seen_entries(accepted, now, ttl_days))


def stream_feed_ingest(
    rows: DataFrame, seen_path: str, out_path: str, checkpoint: str, now: Column | None = None, ttl_days: int = seen.TTL_DAYS,
    buckets: int = tables.BUCKETS,
) -> StreamingQuery:
    """Continuous ingest with exactly the time-to-live rule of the batch operators.

    The seen log at ``seen_path`` is compacted when days gather many generations, and its ended days are dropped, after a
    batch is done; so a batch reads the live keys, however many batches there were before.
    """
    clock = F.current_timestamp().cast("timestamp_ntz") if now is None else now

    def each(batch: DataFrame, batch_id: int) -> None:
        log = SeenLog(batch.sparkSession, seen_path, buckets)
        ingest_batch(batch, log, out_path, batch_id, clock, ttl_days)
        # Not the generation of this batch, which a repetition must be able to replace.
        log.compact(spare=f"b{batch_id}")
        log.drop_days(clock)

    return (
        rows.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _Watermark:
    """The greatest event time of the batches before, less the delay; kept beside the state of a stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.manifest = tables.Manifest(spark, path)

    def before(self, batch_id: int) -> dt.datetime | None:
        marks = [dt.datetime.fromisoformat(t) for b, t in self.manifest.latest()[1].get("marks", []) if b < batch_id]
        return max(marks, default=None)

    def advance(self, batch_id: int, to: dt.datetime) -> None:
        number, state = self.manifest.latest()
        marks = [m for m in state.get("marks", []) if m[0] != batch_id]
        # Of batches long over only the greatest mark matters.
        old, recent = marks[:-8], marks[-8:]
        best = [max(old, key=lambda m: m[1])] if old else []
        self.manifest.commit({"marks": [*best, *recent, [batch_id, to.isoformat()]]}, number)
        self.manifest.forget()


def dedup_batch(
    sightings: DataFrame, log: SeenLog, out_path: str, batch_id: int, ttl_days: int = seen.TTL_DAYS, delay_days: int | None = None
) -> None:
    """Write the sightings of one micro-batch that count as new, given those of earlier batches.

    The state is the seen log: the accepted times, each until one TTL later. An entry that has ended by the least time
    of the batch holds nothing back, so only days from there on are read, and of these only keys of the batch move. With
    ``delay_days`` sightings older than the watermark (the greatest time of the batches before, less the delay) are
    dropped, and so are days of the log that ended before it.
    """
    spark, gen = sightings.sparkSession, f"b{batch_id}"
    ensure_checkpoint_dir(spark)
    rows = sightings.select(*dedup.KEY, F.col("ts").cast("timestamp_ntz").alias("ts")).filter("ts IS NOT NULL")
    mark = _Watermark(spark, f"{log.root}/_watermark")
    wm = mark.before(batch_id) if delay_days is not None else None
    if wm is not None:
        rows = rows.filter(F.col("ts") >= F.lit(wm).cast("timestamp_ntz"))
    rows = rows.distinct().checkpoint()
    least, most = rows.agg(F.min("ts"), F.max("ts")).first()
    if least is not None:
        known = log.read(F.lit(least).cast("timestamp_ntz"), without=gen)
        ends = known.join(rows.select(*dedup.KEY).distinct(), dedup.KEY, "left_semi").groupBy(*dedup.KEY).agg(F.max("expires").alias("_ends"))
        free = skew_join(rows, ends, dedup.KEY, "left").filter("_ends IS NULL OR ts >= _ends").drop("_ends")
        accepted = seen.ttl_accept_sequence(free, ttl_days)
    else:
        accepted = rows
    accepted.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    if least is None:
        return
    accepted = spark.read.schema(ACCEPTED).parquet(f"{out_path}/batch_id={batch_id}")
    expires = F.col("ts") + F.expr(f"INTERVAL {int(ttl_days)} DAYS")
    log.append(gen, accepted.select(*dedup.KEY, F.col("ts").alias("first_seen"), expires.alias("expires")))
    log.compact(spare=gen)
    if delay_days is not None:
        reached = max(filter(None, [wm, most - dt.timedelta(days=delay_days)]))
        mark.advance(batch_id, reached)
        if wm is not None:
            log.drop_days(F.lit(wm).cast("timestamp_ntz"))


ACCEPTED = "value string, ioc_type string, ts timestamp_ntz"


def stream_dedup_ttl(
    sightings: DataFrame, out_path: str, checkpoint: str, ttl_days: int = seen.TTL_DAYS, state_path: str | None = None,
    delay_days: int | None = None, buckets: int = tables.BUCKETS,
) -> StreamingQuery:
    """Event-time dedup of a stream of (value, ioc_type, ts): accepted sightings land in ``out_path``.

    The rule is that of ``seen.ttl_accept_sequence``. Within a batch the order of arrival does not matter; a sighting
    that arrives in a later batch than an accepted one is new only from one TTL after it. ``delay_days`` bounds the state
    by a watermark; without it, rows may be late by any time and the state keeps every day.
    """
    state_path = state_path or f"{out_path.rstrip('/')}_state"

    def each(batch: DataFrame, batch_id: int) -> None:
        dedup_batch(batch, SeenLog(batch.sparkSession, state_path, buckets), out_path, batch_id, ttl_days, delay_days)

    return (
        sightings.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
