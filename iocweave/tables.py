"""Tables in a shared folder that change in whole steps.

A *manifest* is a folder of numbered files, each written once: the state of a table after a step. The step that writes
the next number first wins, so two writers cannot both go on from one state, and a reader sees a state whole or not at all.
Data that no manifest names does not exist for readers; what a failed step left behind is replaced by its repetition.

Data files are bucketed by key, so a join or an aggregate on the key reads a table where it lies, without an exchange
of its rows. Bucketing needs a catalog entry; it is made on demand and holds nothing but the place and the layout.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

#: Buckets of a kept table: about the number of tasks that should read it. A table keeps the number it was made with.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the next step."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder; false if there was none."""
    fs, where = _fs(spark, path)
    return bool(fs.delete(where, True))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return bool(fs.exists(where))


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, sorted; nothing if there is none."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


class Manifest:
    """The numbered states under ``root``. States are small: they name folders, not files or rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/_manifest"

    def _read(self, name: str) -> dict | None:
        fs, where = _fs(self.spark, f"{self.path}/{name}")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None  # being written
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and content of the last whole state; 0 and nothing before the first."""
        for name in reversed(names(self.spark, self.path)):
            if name.endswith(".json") and (state := self._read(name)) is not None:
                return int(name[:-5]), state
        return 0, {}

    def commit(self, state: dict, after: int) -> int:
        """Make ``state`` the one after number ``after``; ``Conflict`` if that place is taken."""
        fs, where = _fs(self.spark, f"{self.path}/{after + 1:012d}.json")
        try:
            stream = fs.create(where, False)
        except Exception as error:
            raise Conflict(f"state {after + 1} of {self.path} exists") from error
        try:
            stream.write(json.dumps(state, sort_keys=True).encode())
        finally:
            stream.close()
        return after + 1

    def forget(self, keep: int = 20) -> None:
        """Delete all but the last states."""
        for name in names(self.spark, self.path)[:-keep]:
            remove(self.spark, f"{self.path}/{name}")


class Bucketed:
    """A bucketed table at a place. ``partitions`` are the leading folder levels."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int, partitions: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.buckets, self.partitions = spark, path, keys, buckets, partitions
        self.name = "kept_" + hashlib.md5(f"{path}|{schema}|{buckets}".encode()).hexdigest()
        if not spark.catalog.tableExists(self.name):
            by = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
            place = path.replace("\\", "\\\\").replace("'", "\\'")
            # Folders are listed when read, so the entry need not know partitions.
            known = spark.conf.get("spark.sql.hive.manageFilesourcePartitions")
            spark.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")
            try:
                spark.sql(
                    f"CREATE TABLE {self.name} ({schema}) USING parquet {by} CLUSTERED BY ({', '.join(keys)}) "
                    f"SORTED BY ({', '.join(keys)}) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
                )
            finally:
                spark.conf.set("spark.sql.hive.manageFilesourcePartitions", known)

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, dealt: bool = False) -> None:
        """Add rows. They are dealt to the buckets first, so that each task writes few files; ``dealt`` says they are."""
        rows = rows if dealt else rows.repartition(self.buckets, *self.keys)
        rows.select(*self.spark.table(self.name).columns).write.insertInto(self.name)

    def drop(self) -> None:
        """Forget the catalog entry; files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
