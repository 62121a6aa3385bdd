"""The seen set kept on disk, by generations.

Layout: ``data/expires_day=<day>/gen=<writer>/`` with files bucketed by key. The manifest lists the generations that are
live for each day. So

* a probe reads only the days that can still be live and joins them where they lie: no exchange of the log;
* an append adds one generation, and a repeated one replaces itself;
* a purge drops whole days and rewrites at most the day that is ending;
* a compaction joins the generations of a day into one, so what a probe reads depends on the live keys, not on the
  number of batches before it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iocweave import tables
from iocweave.operators.dedup import KEY

SCHEMA = "value string, ioc_type string, first_seen timestamp_ntz, expires timestamp_ntz, expires_day date, gen string"
ENTRY = ["value", "ioc_type", "first_seen", "expires"]
#: A day with more generations than this is compacted by ``compact``.
MANY = 8


class SeenLog:
    def __init__(self, spark: SparkSession, root: str, buckets: int = tables.BUCKETS):
        """Open the log at ``root``, or begin one with ``buckets`` buckets."""
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = tables.Manifest(spark, self.root)
        number, state = self.manifest.latest()
        if not number:
            state = {"buckets": int(buckets), "days": {}}
            self.manifest.commit(state, 0)
        self.table = tables.Bucketed(
            spark, f"{self.root}/data", SCHEMA, KEY, state["buckets"], ("expires_day", "gen")
        )

    def days(self) -> dict[str, list[str]]:
        """Live generations by day of expiry."""
        return self.manifest.latest()[1]["days"]

    def _rows(self, days: dict[str, list[str]]) -> DataFrame:
        """Rows of the given generations: a filter on partition columns only."""
        wanted = F.lit(False)
        for day, gens in sorted(days.items()):
            wanted = wanted | ((F.col("expires_day") == F.lit(dt.date.fromisoformat(day))) & F.col("gen").isin(gens))
        return self.table.read().filter(wanted)

    def read(self, now: Column | None = None, without: str | None = None) -> DataFrame:
        """Entries, live ones only if ``now`` is given. ``without`` leaves out a generation, so that a repeated batch
        does not meet its own rows. A key may have several entries; a live one decides."""
        days = {d: [g for g in gens if g != without] for d, gens in self.days().items()}
        rows = self._rows({d: gens for d, gens in days.items() if gens})
        if now is None:
            return rows.select(*ENTRY)
        return rows.filter((F.col("expires_day") >= F.to_date(now)) & (F.col("expires") > now)).select(*ENTRY)

    def flag(self, batch: DataFrame, now: Column, without: str | None = None) -> DataFrame:
        """``batch`` with ``is_seen``. Keys of the batch must be unique or rare. Only the batch moves: it is dealt like the
        buckets, else a batch that is already dealt by its key, more finely, would have the log follow it."""
        return flag_known(batch.repartition(self.table.buckets, *KEY), self.read(now, without))

    def _write(self, gen: str, rows: DataFrame, dealt: bool = False) -> list[str]:
        """Write one generation; the days that it has rows for."""
        self._delete({day: [gen] for day in self._written(gen)})
        self.table.append(rows.select(*ENTRY, F.to_date("expires").alias("expires_day"), F.lit(gen).alias("gen")), dealt)
        return self._written(gen)

    def _written(self, gen: str) -> list[str]:
        """Days whose folder has the generation, whatever the manifest says."""
        data = f"{self.root}/data"
        days = [n.split("=", 1)[1] for n in tables.names(self.spark, data) if n.startswith("expires_day=")]
        return [d for d in days if tables.exists(self.spark, f"{data}/expires_day={d}/gen={gen}")]

    def _delete(self, gone: dict[str, list[str]]) -> None:
        for day, gens in gone.items():
            for gen in gens:
                tables.remove(self.spark, f"{self.root}/data/expires_day={day}/gen={gen}")
            folder = f"{self.root}/data/expires_day={day}"
            if not any(n.startswith("gen=") for n in tables.names(self.spark, folder)):
                tables.remove(self.spark, folder)

    def append(self, gen: str, entries: DataFrame) -> None:
        """Add ``entries`` (value, ioc_type, first_seen, expires; no nulls) as generation ``gen``, replacing it if it exists."""
        number, state = self.manifest.latest()
        days = {d: [g for g in gens if g != gen] for d, gens in state["days"].items()}
        for day in self._write(gen, entries):
            days.setdefault(day, []).append(gen)
        state["days"] = {d: gens for d, gens in days.items() if gens}
        self.manifest.commit(state, number)

    def _replace(self, days: dict[str, list[str]], rows: DataFrame | None, number: int, state: dict) -> None:
        """Swap generations of some days for one that holds ``rows`` (None: for nothing), in one step; then delete them."""
        gen = f"c{number + 1:012d}"
        written = [] if rows is None else self._write(gen, rows, dealt=True)
        live = {d: [g for g in gens if g not in days.get(d, ())] for d, gens in state["days"].items()}
        for day in written:
            live.setdefault(day, []).append(gen)
        self.manifest.commit(state | {"days": {d: gens for d, gens in live.items() if gens}}, number)
        self._delete(days)

    def compact(self, many: int = MANY, spare: str | None = None) -> int:
        """Join the generations of every day that has more than ``many``; of a key's entries of a day the latest stays.
        ``spare`` is left as it is. The rows are aggregated within their buckets. Returns the number of days rewritten."""
        number, state = self.manifest.latest()
        days = {d: [g for g in gens if g != spare] for d, gens in state["days"].items() if len(gens) > many}
        if days:
            last = F.max(F.struct("expires", "first_seen")).alias("e")
            rows = self._rows(days).groupBy(*KEY, "expires_day").agg(last).select(*KEY, "e.first_seen", "e.expires")
            self._replace(days, rows, number, state)
            self.manifest.forget()
        return len(days)

    def purge(self, now: Column) -> tuple[int, int]:
        """Drop expired entries (``expires <= now``): days that are over go as folders, the current one is rewritten if
        it has expired entries. Returns how many entries went and how many are left on disk."""
        today = self.spark.range(1).select(F.to_date(now).alias("d")).first()["d"].isoformat()
        number, state = self.manifest.latest()
        over = {d: gens for d, gens in state["days"].items() if d < today}
        removed = self._rows(over).count() if over else 0
        current = {today: state["days"][today]} if today in state["days"] else {}
        rows = self._rows(current)
        ended = rows.filter(F.col("expires") <= now).count() if current else 0
        gone = over | (current if ended else {})
        if gone:
            left = rows.filter(F.col("expires") > now).select(*ENTRY) if ended else None
            self._replace(gone, left, number, state)
        return removed + ended, self.read().count()

    def drop_days(self, now: Column) -> int:
        """Drop the days that are over at ``now``, folder by folder, without reading them; their number."""
        today = self.spark.range(1).select(F.to_date(now).alias("d")).first()["d"].isoformat()
        number, state = self.manifest.latest()
        over = {d: gens for d, gens in state["days"].items() if d < today}
        if over:
            self._replace(over, None, number, state)
        return len(over)

    def remove(self, keys: DataFrame) -> None:
        """Delete all entries of ``keys`` (value, ioc_type): every day is rewritten within its buckets."""
        number, state = self.manifest.latest()
        rows = self._rows(state["days"]).join(keys.select(*KEY), KEY, "left_anti")
        self._replace(state["days"], rows.select(*ENTRY), number, state)


def flag_known(batch: DataFrame, known: DataFrame) -> DataFrame:
    """``batch`` with ``is_seen``: whether ``known`` has its key. An existence test: ``known`` need not be distinct, is not
    aggregated, and a bucketed one is not exchanged."""
    hit = known.filter((F.col("value") == F.col("_b.value").outer()) & (F.col("ioc_type") == F.col("_b.ioc_type").outer()))
    return batch.alias("_b").select("*", hit.exists().alias("is_seen"))
