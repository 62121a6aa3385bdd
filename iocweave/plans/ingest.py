"""Feed ingest: normalise, keep first, split against the seen set, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave.operators import dedup, metrics, seen, store
from iocweave.operators.seenlog import SeenLog
from iocweave.sources.feeds import FEED_RANK


def feed_name(rank: Column) -> Column:
    out = None
    for name, i in FEED_RANK.items():
        out = F.when(rank == i, name) if out is None else out.when(rank == i, name)
    return out


def flag_rows(rows: DataFrame, seen_table: DataFrame | SeenLog, now: Column) -> DataFrame:
    """Rows that are normalised and unique per feed, with ``feed_name`` and ``is_new``.

    Feeds run in order and each marks its keys as seen, so a key shared by two feeds is new for the first only.
    """
    first = dedup.flag_first_feed(rows).select("*", feed_name(F.col("ord.feed_rank")).alias("feed_name"))
    is_new = ~F.col("is_seen") & F.col("first_feed")
    flagged = seen_table.flag(first, now) if isinstance(seen_table, SeenLog) else seen.flag_seen(first, seen_table, now)
    return flagged.withColumn("is_new", is_new).drop("is_seen", "first_feed")


def flag_batch(iocs: DataFrame, seen_table: DataFrame | SeenLog, now: Column) -> DataFrame:
    """``flag_rows`` after normalising and keep-first."""
    return flag_rows(dedup.dedup_per_feed(dedup.normalise_rows(iocs)), seen_table, now)


def run_feeds(
    iocs: DataFrame, seen_table: DataFrame | SeenLog, now: Column, ttl_days: int = seen.TTL_DAYS,
    started_at: Column | None = None, finished_at: Column | None = None, errors: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of one ingest run, not computed yet: each write computes its table from the feeds. ``run.run`` writes a
    run once, with the times and errors that it has; here these are given (the time of the run if not)."""
    flagged = flag_batch(iocs, seen_table, now)
    new = flagged.filter("is_new")
    run_date = now.cast("date")
    started_at, finished_at = (now if t is None else t for t in (started_at, finished_at))
    return {
        "new_iocs": new,
        "attributes": store.store_attributes(new, run_date),
        "events": store.store_events(new, run_date),
        "event_tags": store.store_event_tags(new, run_date),
        "seen_entries": seen.seen_entries(new, now, ttl_days),
        "results": metrics.run_times(metrics.feed_run_result(flagged), started_at, finished_at, errors),
    }
