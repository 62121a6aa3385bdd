"""What a run stages, how landed lines are written, and how much a task takes."""

import datetime as dt
import glob
import json

from pyspark.sql import functions as F

from iocweave.plans import run
from iocweave.session import bound_tasks, tune
from iocweave.sources import registry
from workloads import catalog
from workloads.catalog_more import LANDED

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
URLS = {"urls": [{"id": "1", "url": "http://a.evil.org/x", "host": "8.8.4.4", "threat": "t", "tags": [], "date_added": "2024-01-15 10:00:00 UTC"}]}


def landed(spark, path, n=1, **options):
    rows = [json.dumps({"urls": [{**URLS["urls"][0], "id": str(i), "url": f"http://a{i}.evil.org/x"}]}) for i in range(n)]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.options(**options).text(path)
    return path


def test_stage_holds_what_tables_keep(spark, tmp_path):
    path = landed(spark, f"{tmp_path}/urls")
    store, names, found = run.Store(spark, f"{tmp_path}/store", 2), {}, {}

    def after(step):
        if step == "flagged":
            for name in ("abusech_url", "_flagged"):
                found[name] = spark.read.parquet(f"{store.folder('_stage', 'r1')}/{name}").columns

    feeds = {"abusech_url": lambda: registry.read_feed(spark, "abusech_url", path, NOW, judged=True)}
    run.run(store, "r1", feeds, NOW, clock=lambda: dt.datetime(2024, 1, 31), after=after)
    for name, columns in found.items():
        assert not {"raw", "pulse_id"} & set(columns), name
        assert {"value", "tags", "ord"} <= set(columns)
    assert sorted(r["value"] for r in store.read("attributes").collect()) == ["8.8.4.4", "http://a0.evil.org/x"]


def test_landed_lines_are_compressed_in_files_of_a_bounded_size(spark, tmp_path):
    plain = registry.read_feed(spark, "abusech_url", landed(spark, f"{tmp_path}/plain", 7), NOW)
    path = landed(spark, f"{tmp_path}/packed", 7, **{**LANDED, "maxRecordsPerFile": 3})
    packed = registry.read_feed(spark, "abusech_url", path, NOW)
    assert len(glob.glob(f"{path}/*.gz")) == 3
    values = lambda df: [r["value"] for r in df.orderBy("ord").collect()]
    assert values(packed) == values(plain) and len(values(plain)) == 14
    assert packed.select("ord").distinct().count() == 14


def test_tasks_are_bounded_and_files_packed(spark, tmp_path):
    own = bound_tasks(tune(spark.newSession()))
    own.range(10).write.parquet(f"{tmp_path}/t")
    assert glob.glob(f"{tmp_path}/t/*.zstd.parquet")
    assert own.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    own.range(3_000_000).select(F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1).write.option(
        "parquet.block.size", 1 << 20
    ).parquet(f"{tmp_path}/big")
    size = sum(len(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/big/*.parquet"))
    read = own.read.schema("v string").parquet(f"{tmp_path}/big")
    assert read.rdd.getNumPartitions() >= size // (16 << 20)
    rows = own.range(4000).withColumn("k", F.col("id") % 1000)
    plan = rows.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and ", 480)" in plan


def test_store_events_computes_its_rows_once(spark, monkeypatch):
    spark = spark.newSession()
    rows = [("threatfox", "high", 3), ("otx", "low", 2), ("otx", "high", 1), ("abusech_url", None, 4)]
    new = spark.createDataFrame(rows, "source_feed string, threat_level string, ord int")
    read = spark.sparkContext.accumulator(0)

    def counted(part):
        for r in part:
            read.add(1)
            yield r

    new = spark.createDataFrame(new.rdd.mapPartitions(counted), new.schema).withColumn("value", F.lit("v"))
    monkeypatch.setattr(catalog, "run", lambda spark, d: {"new_iocs": new})
    got = catalog.QUERIES["store_events"](spark, "").collect()
    assert sorted((r["source_feed"], r["threat_level_id"], r["attribute_count"]) for r in got) == [("abusech_url", "4", 1), ("otx", "1", 2)]
    assert read.value == len(rows)
