"""An ingest run that writes once and counts only when it is whole.

A run has an id. It goes through these steps; a repetition after a failure starts again and replaces what was written:

1. each feed is normalised, de-duplicated and staged on its own, so a feed that fails loses no other and is counted;
2. the staged rows are flagged against the seen log and staged once; every table of the run is written from that stage,
   into a folder of the run;
3. the marker of the run is written. Until then readers do not see its rows, from then on they see all of them;
4. the seen log and the match index take the run in, both in one step of their own and without harm if repeated. A
   later run does that first for a marked run that did not get there.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iocweave import schemas, tables
from iocweave.operators import dedup, metrics, seen, store
from iocweave.operators.keptindex import KeptIndex
from iocweave.operators.seenlog import SeenLog
from iocweave.plans.ingest import flag_rows
from iocweave.sources import registry
from iocweave.sources.feeds import split_judged

TABLES = ("attributes", "events", "event_tags", "rejects", "results")
#: What no table of a run keeps; a staged row goes without it, so that it is neither sorted, moved nor written.
UNKEPT = ("raw", "pulse_id")
REJECTS = "feed string, reason string, value string, ioc_type string, raw string"
Feed = DataFrame | Callable[[], DataFrame | None] | None


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Store:
    """The tables under ``root``: those of committed runs, the seen log and the match index."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = tables.BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.seen = SeenLog(spark, f"{self.root}/seen", buckets)
        self.index = KeptIndex(spark, f"{self.root}/index", buckets)

    def _runs(self, kind: str) -> set[str]:
        return {n.removesuffix(kind) for n in tables.names(self.spark, f"{self.root}/_runs") if n.endswith(kind)}

    def committed(self) -> set[str]:
        return self._runs(".json")

    def _mark(self, run_id: str, kind: str, content: dict) -> None:
        fs, where = tables._fs(self.spark, f"{self.root}/_runs/{run_id}{kind}")
        stream = fs.create(where, True)
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()

    def folder(self, table: str, run_id: str) -> str:
        return f"{self.root}/{table}/run_id={run_id}"

    def read(self, table: str) -> DataFrame | None:
        """Rows of the committed runs, with ``run_id``; None before the first. Folders of runs that did not get that far
        are left out by a partition filter."""
        folders = [n.split("=", 1)[1] for n in tables.names(self.spark, f"{self.root}/{table}") if n.startswith("run_id=")]
        done = self.committed()
        if not done.intersection(folders):
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        open_runs = sorted(set(folders) - done)
        run_id = F.col("run_id").cast("string")
        return rows.filter(~run_id.isin(open_runs)) if open_runs else rows

    def recover(self) -> list[str]:
        """Take in runs that were committed but did not reach the seen log and the index; their ids."""
        late = sorted(self.committed() - self._runs(".done"))
        for run_id in late:
            self._take_in(run_id)
        return late

    def _take_in(self, run_id: str) -> None:
        entries = self.spark.read.parquet(self.folder("seen_entries", run_id))
        self.seen.append(run_id, entries)
        self.index.update(self.spark.read.parquet(self.folder("attributes", run_id)), run_id)
        self._mark(run_id, ".done", {})

    def roll_back(self, run_id: str) -> None:
        """Delete what a run that is not committed has written."""
        if run_id in self.committed():
            raise ValueError(f"run {run_id} is committed")
        for table in ("_stage", "seen_entries", *TABLES):
            tables.remove(self.spark, self.folder(table, run_id))


def _stage_feed(feed: Feed, path: str) -> None:
    rows = feed() if callable(feed) else feed
    if rows is None:
        return
    if "reason" in rows.columns:  # judged: the refused rows are kept, with their reasons
        good, _, _ = split_judged(rows, f"{path}_judged")
    else:
        good = dedup.normalise_rows(rows)
    dedup.dedup_per_feed(good.drop(*UNKEPT)).write.mode("overwrite").parquet(path)


def _rejects(spark: SparkSession, stage: str, feeds: Mapping[str, Feed]) -> DataFrame:
    """Refused rows of the feeds that were judged, with their reasons."""
    out = spark.createDataFrame([], REJECTS)
    for name in feeds:
        path = f"{stage}/{name}_judged/rejected=true"
        if tables.exists(spark, path):
            out = out.unionByName(spark.read.parquet(path).select(F.lit(name).alias("feed"), "reason", "value", "ioc_type", "raw"))
    return out


def run(
    store_: Store, run_id: str, feeds: Mapping[str, Feed], now: Column, ttl_days: int = seen.TTL_DAYS,
    clock: Callable[[], dt.datetime] = utc_now, after: Callable[[str], None] = lambda step: None,
) -> DataFrame:
    """Ingest landed ``feeds`` (registered name to rows, or to a function that reads them; None: nothing landed) as run
    ``run_id``; of judged rows the refused ones become its table ``rejects``. Returns its results, one row of ``schemas.FEED_RUNS`` per feed group, failed and empty ones included.

    A committed run is not done again. ``now`` decides what is live and the day of the events; ``clock`` gives the
    times of the results; ``after`` is told each step that ended.
    """
    spark = store_.spark
    store_.recover()
    if run_id in store_.committed():
        return spark.read.schema(schemas.FEED_RUNS).parquet(store_.folder("results", run_id))
    store_.roll_back(run_id)
    stage = store_.folder("_stage", run_id)
    started: dict[str, dt.datetime] = {}
    errors: list[tuple[str, str]] = []
    staged = None
    for name, feed in feeds.items():
        group = registry.FEEDS[name].group
        if group not in started:
            started[group] = clock()
        try:
            _stage_feed(feed, f"{stage}/{name}")
        except Exception as error:  # whatever a source or its files do wrong
            errors.append((group, f"{name}: {str(error).strip().splitlines()[0]}"))
            continue
        if tables.exists(spark, f"{stage}/{name}"):
            rows = spark.read.schema(schemas.IOCS).parquet(f"{stage}/{name}").drop(*UNKEPT)
            staged = rows if staged is None else staged.unionByName(rows)
    after("feeds")
    if staged is None:
        staged = spark.createDataFrame([], schemas.IOCS).drop(*UNKEPT)
    # Sub-feeds were staged one by one; a key that several of a feed have is kept once.
    flag_rows(dedup.dedup_per_feed(staged), store_.seen, now).write.mode("overwrite").parquet(f"{stage}/_flagged")
    after("flagged")
    flagged = spark.read.parquet(f"{stage}/_flagged")
    new, run_date = flagged.filter("is_new"), now.cast("date")
    known_events = store_.read("events")
    made = {
        "attributes": store.store_attributes(new, run_date),
        "events": store.store_events(new, run_date, known_events),
        "event_tags": store.store_event_tags(new, run_date),
        "rejects": _rejects(spark, stage, feeds),
        "seen_entries": seen.seen_entries(new, now, ttl_days),
    }
    for table, rows in made.items():
        rows.write.mode("overwrite").parquet(store_.folder(table, run_id))
        after(table)
    finished = clock()
    times = spark.createDataFrame([(g, t) for g, t in started.items()], "feed_name string, started_at timestamp_ntz")
    failed = spark.createDataFrame(errors, "feed_name string, error string")
    results = metrics.run_results(metrics.feed_run_result(flagged), times, F.lit(finished).cast("timestamp_ntz"), failed)
    results.write.mode("overwrite").parquet(store_.folder("results", run_id))
    after("results")
    store_._mark(run_id, ".json", {"finished_at": finished.isoformat()})
    after("committed")
    store_._take_in(run_id)
    tables.remove(spark, stage)
    return spark.read.schema(schemas.FEED_RUNS).parquet(store_.folder("results", run_id))
