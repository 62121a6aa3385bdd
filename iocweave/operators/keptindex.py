"""The match index, kept: one row per value of the store, maintained as attributes arrive.

A row is a partial state of its value that merges with others of the same value: the first attribute of a known type with
the place that makes it first, and the tags. Arriving attributes are aggregated on their own, merged with the rows of their
values, and written with the untouched rows as a new version; the manifest swaps versions whole. The old version is read
where it lies, bucketed by value: no exchange and no aggregate of the store or of the index, in an update or in a lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from iocweave import tables
from iocweave.functions.base import empty_strings
from iocweave.operators import match

#: Runs that an index remembers, so that a repeated update changes nothing.
REMEMBERED = 1000


def _merge(old: str, new: str) -> list[Column]:
    """The state of a value from two of them; either may be absent."""
    a, b = F.col(f"{old}.place"), F.col(f"{new}.place")
    later = a.isNull() | (b < a)
    pick = lambda c: F.when(later & b.isNotNull(), F.col(f"{new}.{c}")).otherwise(F.col(f"{old}.{c}")).alias(c)
    tags = [F.coalesce(F.col(f"{side}.tags"), empty_strings()) for side in (old, new)]
    return [F.col(f"{new}.value").alias("value"), pick("place"), pick("first"), F.sort_array(F.array_union(*tags)).alias("tags")]


class KeptIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = tables.BUCKETS):
        """Open the index at ``root``, or begin one with ``buckets`` buckets."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.manifest = tables.Manifest(spark, self.root)

    def _table(self, state: dict) -> tables.Bucketed:
        return tables.Bucketed(self.spark, f"{self.root}/{state['version']}", state["schema"], ["value"], state["buckets"])

    def update(self, attributes: DataFrame, run_id: str) -> bool:
        """Take in the attributes of a run; false if that run was taken in before.

        ``attributes`` are new rows of the store (``match.ATTRIBUTE_COLUMNS`` and stored fields). Rows of a null value are
        not indexed. All updates of an index have the same columns.
        """
        number, state = self.manifest.latest()
        if run_id in state.get("runs", []):
            return False
        new = match.index_states(attributes.filter("value IS NOT NULL"))
        # Field by field, because a type as one string is not cut apart by every reader of the catalog.
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType(new.schema.fields))
        version = f"v{number + 1:012d}"
        after = {"version": version, "schema": state.get("schema", schema), "buckets": state.get("buckets", int(self.buckets))}
        tables.remove(self.spark, f"{self.root}/{version}")  # of a step that failed
        target = self._table(after)
        if not state:
            target.append(new)
        else:
            # Both parts are written from it, and it is small: what one run brought.
            staged = f"{self.root}/_delta"
            new.write.mode("overwrite").parquet(staged)
            new = self.spark.read.schema(new.schema).parquet(staged).repartition(state["buckets"], "value")
            old = self._table(state).read()
            changed = new.alias("n").join(old.alias("o"), F.col("o.value") == F.col("n.value"), "left").select(*_merge("o", "n"))
            kept = old.join(new.select("value"), "value", "left_anti")
            target.append(changed, dealt=True)
            target.append(kept, dealt=True)
        # Ids of runs, newest last.
        after["runs"] = [*state.get("runs", []), run_id][-REMEMBERED:]
        after["before"] = state.get("version")
        self.manifest.commit(after, number)
        self.manifest.forget()
        if state.get("before"):  # the version before stays for those who read it now
            old_state = state | {"version": state["before"]}
            self._table(old_state).drop()
            tables.remove(self.spark, f"{self.root}/{state['before']}")
        return True

    def states(self) -> DataFrame:
        """(value, place, first, tags): all rows, bucketed by value."""
        _, state = self.manifest.latest()
        if not state:
            raise ValueError(f"nothing was indexed at {self.root}")
        return self._table(state).read()

    def read(self) -> DataFrame:
        """(value, first, tags) as ``match.match_index`` computes it from the store."""
        return self.states().filter("first IS NOT NULL").select("value", "first", "tags")

    def hits(self, values: DataFrame) -> DataFrame:
        """Index rows of the asked values. A value that is asked for very often is one row before it moves, and the
        index is joined where it lies: the values are dealt like its buckets."""
        _, state = self.manifest.latest()
        asked = values.select("value").distinct().repartition(state.get("buckets", self.buckets), "value")
        return self.read().join(asked, "value", "left_semi")
