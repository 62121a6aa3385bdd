"""What is kept from run to run: manifests, the seen log, the match index, staged runs, and the streams on them."""

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from iocweave import schemas, tables
from iocweave.operators import dedup, match, seen
from iocweave.operators.keptindex import KeptIndex
from iocweave.operators.seenlog import SeenLog
from iocweave.plans import enrichment, run
from iocweave.session import work_dir
from iocweave.streaming import feeds as stream_feeds

T0 = datetime(2024, 1, 31)


def at(t=T0):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def entries(spark, keys, expires, first=T0):
    return spark.createDataFrame([(k, "ip-dst" if k % 2 else "domain", first, expires) for k in keys], "k long, ioc_type string, first_seen timestamp_ntz, expires timestamp_ntz").select(
        F.concat(F.lit("v"), "k").alias("value"), "ioc_type", "first_seen", "expires")


def keys_of(df):
    return sorted(r["value"] for r in df.select("value").collect())


def names(numbers):
    return sorted(f"v{k}" for k in numbers)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved_before_join(df, table):
    """Whether the rows of a table go through an exchange before they are joined."""
    lines = plan(df).split("\n")
    found = [i for i, line in enumerate(lines) if table in line and "FileScan" in line]
    assert found
    for i in found:
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-*("))
        for up in reversed(lines[:i]):
            d = len(up) - len(up.lstrip(" :+-*("))
            if d < depth:
                depth = d
                if "Exchange" in up:
                    return True
                if "Join" in up:
                    break
    return False


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


# --- manifest ------------------------------------------------------------------------------------------------

def test_of_two_writers_one_goes_on(spark):
    a, b = (tables.Manifest(spark, work_dir(spark, "m")) for _ in range(2))
    b.path = a.path
    assert a.latest() == (0, {})
    assert a.commit({"x": 1}, 0) == 1
    with pytest.raises(tables.Conflict):
        b.commit({"x": 2}, 0)
    assert b.latest() == (1, {"x": 1})


# --- seen log ------------------------------------------------------------------------------------------------

def test_log_appends_replaces_and_purges(spark):
    log = SeenLog(spark, work_dir(spark, "log"), 3)
    day = timedelta(days=1)
    log.append("a", entries(spark, range(0, 10), T0 - day))
    log.append("b", entries(spark, range(10, 20), T0).unionByName(entries(spark, range(20, 30), T0 + timedelta(hours=1))))
    for keys in (range(30, 50), range(30, 40)):  # a repeated writer replaces what it wrote
        log.append("c", entries(spark, keys, T0 + 3 * day))
    assert keys_of(log.read(at())) == names([*range(20, 40)])
    assert keys_of(log.read(at(), without="c")) == names(range(20, 30))
    # Opened again, with another number of buckets asked for: it keeps its own.
    again = SeenLog(spark, log.root, 17)
    assert again.table.buckets == 3 and keys_of(again.read()) == names(range(40))
    assert again.purge(at()) == (20, 20)
    assert again.purge(at()) == (0, 20)
    on_disk = spark.read.parquet(f"{log.root}/data")
    assert keys_of(on_disk) == names(range(20, 40))
    assert again.drop_days(at(T0 + 2 * day)) == 1
    assert keys_of(spark.read.parquet(f"{log.root}/data")) == names(range(30, 40))
    again.remove(entries(spark, range(35, 60), T0))
    assert keys_of(again.read()) == names(range(30, 35))


def test_log_compacts(spark):
    log = SeenLog(spark, work_dir(spark, "log"), 2)
    for k in range(6):
        log.append(f"g{k}", entries(spark, range(3 * k, 3 * k + 6), T0 + timedelta(hours=1 + k)))
    before = keys_of(log.read(at()).distinct())
    assert log.compact(many=3, spare="g5") == 1
    gens = log.days()["2024-01-31"]
    assert len(gens) == 2 and "g5" in gens
    rows = log.read(at()).groupBy("value").agg(F.max("expires").alias("e"), F.count("*").alias("n")).collect()
    assert len(rows) == len(set(before)) and max(r["n"] for r in rows) <= 2
    assert {r["value"]: r["e"] for r in rows}["v6"] == T0 + timedelta(hours=3)
    assert log.compact(many=3) == 0


def test_probe_reads_live_days_and_does_not_move_the_log(spark, no_broadcast):
    log = SeenLog(spark, work_dir(spark, "log"), 3)
    for k in range(4):
        log.append(f"g{k}", entries(spark, range(k, 40, 4), T0 + timedelta(days=k - 1, hours=1)))
    batch = dedup.keep_first(entries(spark, range(0, 60, 3), T0), dedup.KEY, ["expires"]).select("value", "ioc_type")
    flagged = log.flag(batch, at())
    text = plan(flagged)
    assert "ExistenceJoin" in text and not moved_before_join(flagged, log.table.name) and "Aggregate" not in text
    assert "expires_day" in text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    got = {r["value"]: r["is_seen"] for r in flagged.collect()}
    assert got == {f"v{k}": k < 40 and k % 4 != 0 for k in range(0, 60, 3)}


# --- match index ---------------------------------------------------------------------------------------------

def attributes(spark, rng, n, start=0):
    data = []
    for i in range(start, start + n):
        v = rng.randrange(40)
        kind = rng.choice(["ip-dst", "domain", "comment", "other"])
        data.append((f"a{i}", f"e{i % 5}", rng.choice(["otx — 2024-01-01", "Manual"]), kind, None if v == 0 else f"v{v}", rng.choice([None, "c"]), rng.sample(["x", "y", "z", "w"], rng.randrange(3)), rng.randrange(1000)))
    return spark.createDataFrame(data, "attribute_id string, event_id string, event_info string, type string, value string, comment string, tags array<string>, seq bigint")


def test_index_after_updates_is_the_index_of_all(spark, no_broadcast):
    rng = Random(9)
    index, store_ = KeptIndex(spark, work_dir(spark, "index"), 3), None
    for k in range(4):
        part = attributes(spark, rng, 150 if k else 30, 1000 * k)
        store_ = part if store_ is None else store_.unionByName(part)
        assert index.update(part, f"r{k}")
        assert not index.update(part, f"r{k}")
        want = {r["value"]: (r["first"].asDict(), r["tags"]) for r in match.match_index(store_.filter("value IS NOT NULL")).collect()}
        rows = index.read().collect()
        assert len(rows) == len(want) and {r["value"]: (r["first"].asDict(), r["tags"]) for r in rows} == want
    # Two versions are there: the one that is read, and the one before.
    assert len([n for n in tables.names(spark, index.root) if n.startswith("v0")]) == 2
    asked = spark.createDataFrame([("v3",), ("v3",), ("none",)], "value string")
    hits = index.hits(asked)
    name = index._table(index.manifest.latest()[1]).name
    assert not moved_before_join(hits, name)
    assert keys_of(hits) == ["v3"]


def test_enrichment_by_index_is_that_by_the_store(spark, no_broadcast):
    rng = Random(3)
    store_ = attributes(spark, rng, 400).withColumn("value", F.concat("value", F.lit(".evil.org")))
    index = KeptIndex(spark, work_dir(spark, "index"), 3)
    for k in range(3):
        index.update(store_.filter(F.col("seq") % 3 == k), f"r{k}")
    raw = [(f"k{i}", "syslog", '{"id":"%d","a":"%s","b":"v%d.evil.org"}' % (i, "v7.evil.org" if i % 3 else "nothing", i % 50)) for i in range(200)]
    alerts = spark.createDataFrame([*raw, ("none", "syslog", "{}"), ("bad", "elastic", "{{")], schemas.ALERTS)
    want = enrichment.enrich_cycle(alerts, store_, at())["enriched_alerts"]
    got = enrichment.enrich_staged(alerts, index, at(), work_dir(spark, "stage"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got.select(*want.columns)) == rows(want)
    text = plan(got)
    assert not moved_before_join(got, index._table(index.manifest.latest()[1]).name)
    assert "collect_set" not in text and "min_by" not in text  # the store is not aggregated


# --- runs ----------------------------------------------------------------------------------------------------

def iocs(spark, items):
    data = [(v, t, f, "high", ["t"], "d", T0, T0, 50, "p", [], None, (0 if f == "otx" else 1, 0, f"{i:05d}", 0, 0, 0)) for i, (f, v, t) in enumerate(items)]
    return spark.createDataFrame(data, schemas.IOCS)


def feeds(spark):
    def broken():
        raise OSError("no such host\nwith details")

    return {
        "otx": iocs(spark, [("otx", "8.8.8.8", "ip-dst"), ("otx", "9.9.9.9", "ip-dst"), ("otx", "1.1.1.1", "ip-dst")]),
        "abusech_url": lambda: iocs(spark, [("abusech", "8.8.8.8", "ip-dst"), ("abusech", "evil.com", "domain")]),
        "abusech_malware": broken,
        "threatfox": iocs(spark, [("abusech", "evil.com", "domain"), ("abusech", "other.com", "domain")]),
        "csv": None,
    }


def contents(store_):
    out = {}
    for name in run.TABLES:
        df = store_.read(name)
        drop = [c for c in ("started_at", "finished_at") if df is not None and c in df.columns]
        out[name] = None if df is None else sorted(map(str, df.drop(*drop).collect()))
    out["seen"] = keys_of(store_.seen.read())
    out["index"] = keys_of(store_.index.states()) if store_.index.manifest.latest()[0] else []
    return out


def new_store(spark):
    store_ = run.Store(spark, work_dir(spark, "store"), 2)
    store_.seen.append("before", spark.createDataFrame([("9.9.9.9", "ip-dst", T0, T0 + timedelta(days=2))], schemas.SEEN))
    return store_


def test_run_counts_every_feed(spark):
    store_ = new_store(spark)
    started = datetime.now()
    rows = {r["feed_name"]: r for r in run.run(store_, "r1", feeds(spark), at()).collect()}
    assert {n: (r["total_fetched"], r["new_iocs"], r["duplicate_iocs"], r["stored"], r["errors"]) for n, r in rows.items()} == {
        "otx": (3, 2, 1, 2, 0), "abusech": (3, 2, 1, 2, 1), "csv": (0, 0, 0, 0, 0)}
    assert rows["abusech"]["error_details"] == ["abusech_malware: no such host"]
    for r in rows.values():
        assert timedelta(0) < r["finished_at"] - r["started_at"] < datetime.now() - started
    assert keys_of(store_.read("attributes")) == ["1.1.1.1", "8.8.8.8", "evil.com", "other.com"]
    # The same run again changes nothing; a later one finds nothing new.
    before = contents(store_)
    run.run(store_, "r1", feeds(spark), at())
    assert contents(store_) == before
    later = {r["feed_name"]: r["new_iocs"] for r in run.run(store_, "r2", feeds(spark), at()).collect()}
    assert later == {"otx": 0, "abusech": 0, "csv": 0}
    assert {n: v for n, v in contents(store_).items() if n != "results"} == {n: v for n, v in before.items() if n != "results"}


STEPS = ["feeds", "flagged", "attributes", "events", "event_tags", "rejects", "seen_entries", "results", "committed"]


def test_a_run_that_fails_leaves_nothing_and_can_be_repeated(spark):
    whole = new_store(spark)
    run.run(whole, "r1", feeds(spark), at())
    want = contents(whole)
    for step in STEPS:
        store_ = new_store(spark)

        def fail(done, step=step):
            if done == step:
                raise RuntimeError(step)

        with pytest.raises(RuntimeError):
            run.run(store_, "r1", feeds(spark), at(), after=fail)
        if step != "committed":
            assert all(store_.read(t) is None for t in run.TABLES) and keys_of(store_.seen.read()) == ["9.9.9.9"]
            if step == "events":  # given up: another run takes its place
                store_.roll_back("r1")
                assert store_.read("attributes") is None
            run.run(store_, "r1", feeds(spark), at())
            assert contents(store_) == want, step
        else:  # whole, but not taken in: the next run does that, and so finds nothing new
            got = run.run(run.Store(spark, store_.root), "r2", feeds(spark), at())
            assert got.agg(F.sum("new_iocs")).first()[0] == 0
            assert contents(store_)["attributes"] == want["attributes"] and contents(store_)["seen"] == want["seen"]


# --- streams -------------------------------------------------------------------------------------------------

def loop(rows, ttl):
    last, out = {}, []
    for v, t, ts in sorted(rows, key=lambda r: r[2]):
        if v not in last or ts >= last[v] + ttl:
            last[v] = ts
            out.append((v, t, ts))
    return out


def test_stream_state_is_bounded_and_survives_a_restart(spark, tmp_path):
    rng, src = Random(2), str(tmp_path / "in")
    root, rows = work_dir(spark, "ttl-stream"), []
    kind = "value string, ioc_type string, ts timestamp_ntz"
    sizes = []
    for k in range(7):
        part = [(f"k{rng.randrange(8)}", "x", T0 + timedelta(days=3 * k, hours=rng.randrange(72))) for _ in range(60)]
        rows += part
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2 if k == 3 else 1):  # a run without new files, too
            landed = spark.readStream.schema(kind).parquet(src)
            q = stream_feeds.stream_dedup_ttl(landed, f"{root}/out", f"{root}/cp", 5, delay_days=3, buckets=2)
            q.awaitTermination()
            assert q.exception() is None
        sizes.append(len(SeenLog(spark, f"{root}/out_state").days()))
    got = sorted(tuple(r) for r in spark.read.schema(stream_feeds.ACCEPTED).parquet(f"{root}/out").select("value", "ioc_type", "ts").collect())
    assert got == sorted(loop(rows, timedelta(days=5)))
    assert max(sizes[3:]) <= 5 + 3 + 2 * 3 + 1  # days of a TTL, the delay and two batches
    # The last batch again gives what it gave.
    log = SeenLog(spark, f"{root}/out_state")
    last = spark.createDataFrame(part, kind)
    stream_feeds.dedup_batch(last, log, f"{root}/out", 6, 5, 3)
    again = sorted(tuple(r) for r in spark.read.schema(stream_feeds.ACCEPTED).parquet(f"{root}/out").select("value", "ioc_type", "ts").collect())
    assert again == got
    # Behind the watermark rows are dropped.
    stream_feeds.dedup_batch(spark.createDataFrame([("late", "x", T0)], kind), log, f"{root}/out", 7, 5, 3)
    assert spark.read.parquet(f"{root}/out/batch_id=7").count() == 0


def test_seen_flag_needs_no_distinct_log(spark):
    known = entries(spark, [1, 1, 2], T0 + timedelta(days=1)).unionByName(entries(spark, [3], T0))
    got = {r["value"]: r["is_seen"] for r in seen.flag_seen(entries(spark, [1, 2, 3, 4], T0).select("value", "ioc_type"), known, at()).collect()}
    assert got == {"v1": True, "v2": True, "v3": False, "v4": False}
