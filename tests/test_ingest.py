import json
from collections import Counter
from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from iocweave import schemas
from iocweave.operators.seenlog import SeenLog
from iocweave.operators import dedup, metrics, outbox, seen, store
from iocweave.plans import ingest
from iocweave.session import work_dir
from iocweave.sources import registry
from iocweave.streaming import feeds as stream_feeds

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
T0 = datetime(2024, 1, 31)

OTX = {"results": [{
    "id": "p1", "name": "P", "TLP": "RED", "tags": ["x", ""], "adversary": "APT28", "created": "2024-01-15T09:00:00Z",
    "modified": "2024-01-15T10:00:00+02:00", "attack_ids": ["T1059", "T1071"],
    "references": ["https://r", {"external_id": "T1071"}, {"external_id": "CVE-1"}], "pulse_source": {"indicator_count": 250},
    "indicators": [
        {"type": "IPv4", "indicator": "5.5.5.5", "description": ""}, {"type": "domain", "indicator": "evil.org", "description": "d"},
        {"type": "hostname", "indicator": "h.evil.org"}, {"type": "URL", "indicator": "http://evil.org/x"},
        {"type": "FileHash-MD5", "indicator": "a" * 32}, {"type": "FileHash-SHA256", "indicator": "b" * 64},
        {"type": "FileHash-SHA1", "indicator": "c" * 40}, {"type": "email", "indicator": "bad@evil.org"},
        {"type": "CIDR", "indicator": "10.0.0.0/8"}, {"type": "BitcoinAddress", "indicator": "1x"}, {"type": "IPv4", "indicator": " "}]}]}
MALWARE = {"query_status": "ok", "data": [{
    "sha256_hash": "a" * 64, "md5_hash": "b" * 32, "file_name": "setup_7.exe", "signature": "Qakbot", "file_type": "exe",
    "tags": ["loader", "macro"], "first_seen": "2024-01-15 10:00:00", "last_seen": None}]}
URLS = {"urls": [{"id": 7, "url": "http://drop.zonefile.org/a/b", "host": "", "threat": "malware_download", "tags": None,
                  "date_added": "2024-01-15 10:00:00 UTC"}]}
FOX = {"query_status": "ok", "data": [
    {"id": str(i), "ioc": v, "ioc_type": t, "malware": "M", "malware_alias": "", "confidence_level": c, "tags": None, "first_seen": "2024-01-15"}
    for i, (v, t, c) in enumerate([("192.168.1.100:4444", "ip:port", 80), ("1.2.3.4:443", "ip:port", 55), ("1.2.3.5:80", "ip:port", 30),
                                   ("AB" * 16, "md5_hash", 75), ("c" * 40, "sha1_hash", 75), ("x.org", "domain", 49), ("y.org", "domain", 50)])]}


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    paths = {}
    for name, envelope in (("otx", OTX), ("abusech_malware", MALWARE), ("abusech_url", URLS), ("threatfox", FOX)):
        (root / name).mkdir()
        (root / name / "0001.json").write_text(json.dumps(envelope) + "\n")
        paths[name] = str(root / name)
    (root / "csv").mkdir()
    (root / "csv" / "1.csv").write_text('value,type,threat_level,description,tags\n1.2.3.9,ip,high,C2,"apt28,c2"\nevil.com,domain,odd,P,"phishing"\nq,cidr,low,,\n')
    paths["csv"] = str(root / "csv")
    return paths


def rows(df):
    return {(r.value, r.ioc_type): r for r in df.collect()}


def test_otx(spark, landed):
    got = rows(registry.read_feed(spark, "otx", landed["otx"], NOW))
    assert Counter(t for _, t in got) == {"ip-dst": 1, "domain": 2, "url": 1, "md5": 1, "sha256": 1, "sha1": 1, "email-src": 1}
    first = got[("5.5.5.5", "ip-dst")]
    assert first.tags == ["x", "APT28"] and first.attack_techniques == ["T1071", "T1059"]
    assert first.description == "OTX pulse: P" and first.confidence == 100 and first.threat_level == "high"
    assert first.last_seen == datetime(2024, 1, 15, 10) and first.first_seen == datetime(2024, 1, 15, 9)


def test_abusech(spark, landed):
    got = rows(registry.read_feed(spark, "abusech_malware", landed["abusech_malware"], NOW))
    assert [(r.confidence, r.threat_level) for _, r in sorted(got.items(), key=lambda x: x[1].ord.emit_rank)] == [(90, "high"), (85, "high"), (70, "medium")]
    assert got[("setup_7.exe", "filename")].tags == ["loader", "macro", "Qakbot"]
    got = rows(registry.read_feed(spark, "abusech_url", landed["abusech_url"], NOW))
    assert got[("drop.zonefile.org", "domain")].confidence == 75 and got[("drop.zonefile.org", "domain")].first_seen == T0
    got = rows(registry.read_feed(spark, "threatfox", landed["threatfox"], NOW))
    levels = {k[0]: r.threat_level for k, r in got.items()}
    assert levels == {"192.168.1.100": "high", "1.2.3.4": "medium", "1.2.3.5": "low", "ab" * 16: "high", "x.org": "low", "y.org": "medium"}


def test_csv_and_missing_feed(spark, landed, tmp_path):
    got = rows(registry.read_feed(spark, "csv", landed["csv"], NOW))
    assert got[("1.2.3.9", "ip-dst")].tags == ["apt28", "c2"] and got[("evil.com", "domain")].threat_level == "unknown" and len(got) == 2
    both = registry.read_feeds(spark, {"csv": landed["csv"], "otx": str(tmp_path / "none")}, NOW)
    assert both.count() == 2


def test_query_status_and_null_fields(spark):
    df = spark.createDataFrame([("f", "no_results", [("a" * 64, None, None, None, None, None, None, None)]),
                                ("g", "ok", [("b" * 64, None, None, None, None, None, None, None)])], "fetch_id string, " + schemas.MALWARE)
    got = registry.FEEDS["abusech_malware"].flatten(df, NOW).collect()
    assert [(r.value, r.tags) for r in got] == [("b" * 64, ["Unknown"])]


def iocs(spark, items):
    """Rows (feed, value, type) in arrival order."""
    data = [(v, t, f, "high", ["t"], "d", T0, T0, 50, "p", [], None, (0 if f == "otx" else 1, 0, f"{i:05d}", 0, 0, 0)) for i, (f, v, t) in enumerate(items)]
    return spark.createDataFrame(data, schemas.IOCS)


def seen_rows(spark, items):
    return spark.createDataFrame([(v, t, T0 - timedelta(days=30), e) for v, t, e in items], schemas.SEEN)


def test_run_feeds(spark):
    batch = iocs(spark, [("otx", "8.8.8.8", "ip-dst"), ("otx", "8.8.8.8", "ip-dst"), ("otx", "192.168.1.1", "ip-dst"), ("otx", "evil.com", "url"),
                         ("abusech", "8.8.8.8", "ip-dst"), ("abusech", "WWW.evil.com", "domain"), ("abusech", "1.1.1.1", "ip-dst"), ("otx", "9.9.9.9", "ip-dst")])
    known = seen_rows(spark, [("evil.com", "url", T0 + timedelta(days=1)), ("1.1.1.1", "ip-dst", T0 + timedelta(seconds=1)), ("9.9.9.9", "ip-dst", T0)])
    out = ingest.run_feeds(batch, known, NOW)
    got = {r.feed_name: r for r in out["results"].collect()}
    assert (got["otx"].total_fetched, got["otx"].new_iocs, got["otx"].duplicate_iocs) == (2, 2, 0)
    assert (got["abusech"].total_fetched, got["abusech"].new_iocs, got["abusech"].duplicate_iocs) == (3, 1, 2)
    assert {r.value for r in out["attributes"].collect()} == {"8.8.8.8", "9.9.9.9", "evil.com"}
    assert out["events"].count() == 2


def test_keep_first_with_a_hot_key(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("value"), F.lit("x").alias("ioc_type"), (-F.col("id")).alias("ord"))
    plan = dedup.dedup_keep_first(df)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
    got = {r.value: r.ord for r in plan.collect()}
    expect = {}
    for i in range(20000):
        k = "hot" if i % 3 == 0 else f"k{i % 50}"
        expect[k] = min(expect.get(k, 1), -i)
    assert got == expect


def test_seen_set(spark):
    known = seen_rows(spark, [("a", "ip-dst", T0 + timedelta(days=1)), ("b", "ip-dst", T0 + timedelta(days=2)), ("c", "domain", T0 + timedelta(days=1)), ("d", "domain", T0)])
    stats = seen.seen_stats(known, NOW).first()
    assert stats.total_entries == 3 and stats.by_type == {"ip-dst": 2, "domain": 1}
    assert seen.purge_counts(known, NOW).first() == (1, 3)
    after = {r.value: r for r in seen.seen_upsert(known, known.filter("value = 'd'"), NOW).collect()}
    assert after["d"].expires == T0 + timedelta(days=30) and after["a"].expires == T0 + timedelta(days=1)
    assert seen.seen_remove(known, known.filter("value = 'a'")).count() == 3


@pytest.mark.parametrize("parts", [64, 3])
def test_ttl_accept_sequence_against_a_loop(spark, parts, monkeypatch):
    monkeypatch.setattr(seen.successors, "__defaults__", (parts,))
    rnd = Random(4)
    data = [(f"k{rnd.randrange(6)}", "x", T0 + timedelta(hours=rnd.randrange(24 * 200))) for _ in range(300)] + [
        ("s", "x", T0), ("s", "x", T0 + timedelta(days=19)), ("s", "x", T0 + timedelta(days=35)),
        # Exactly one TTL later counts, a microsecond less does not; a null time and a repeated row change nothing.
        ("e", "x", T0), ("e", "x", T0 + timedelta(days=30)), ("e", "x", T0 + timedelta(days=60, microseconds=-1)), ("e", "x", T0),
        ("old", "x", T0 - timedelta(days=30000)), ("old", "x", T0)]
    expect, last = set(), {}
    for v, t, ts in sorted(data, key=lambda r: r[2]):
        if v not in last or ts >= last[v] + timedelta(days=30):
            last[v] = ts
            expect.add((v, t, ts))
    df = spark.createDataFrame([*data, ("n", "x", None)], "value string, ioc_type string, ts timestamp_ntz")
    rows_ = [tuple(r) for r in seen.ttl_accept_sequence(df, 30).collect()]
    assert len(rows_) == len(set(rows_)) and set(rows_) == expect


def test_relationships_stay_inside_one_record(spark, landed):
    rel = metrics.ioc_relationships(registry.read_feeds(spark, landed, NOW)).collect()
    assert {(r.source_feed, r.relationship_type) for r in rel} == {
        ("abusech_malware", "same-file-as"), ("abusech_malware", "named"), ("abusech_url", "hosted-on")}
    assert len(rel) == 4


def test_feed_summary(spark):
    runs = spark.createDataFrame(
        [("a", T0, T0 + timedelta(seconds=2), 5, 5, 0, 2, 3, ["e" * 200, "x", "y", "z"]), ("b", T0, T0, 50, 50, 0, 50, 0, []), ("c", T0, T0, 100, 100, 0, 100, 0, [])],
        schemas.FEED_RUNS)
    got = {r.feed_name: json.loads(r.payload) for r in outbox.notify_feed_outbox(metrics.feed_run_rates(runs)).collect()}
    assert set(got) == {"a", "c"}
    lines = got["a"]["blocks"][0]["text"]["text"].split("\n")
    assert len(lines) == 7 and lines[4] == "  • " + "e" * 100 and "Success rate: 40.0%" in lines[2]


def test_store_write(spark, tmp_path):
    rows_ = store.store_attributes(iocs(spark, [("otx", "8.8.8.8", "ip-dst"), ("abusech", "1.1.1.1", "ip-dst")]), NOW.cast("date"))
    store.write_by_feed(rows_, str(tmp_path / "attrs"))
    assert sorted(p.name for p in (tmp_path / "attrs").iterdir() if p.is_dir()) == ["source_feed=abusech", "source_feed=otx"]


def test_stream_ingest_in_several_batches(spark, tmp_path):
    root = work_dir(spark, "test-stream")
    src = tmp_path / "in"
    src.mkdir()
    for i, values in enumerate([["8.8.8.8:1", "1.1.1.1:2"], ["8.8.8.8:9", "9.9.9.9:1"], ["1.1.1.1:1"]]):
        env = {"query_status": "ok", "data": [{"id": "1", "ioc": v, "ioc_type": "ip:port", "confidence_level": 50} for v in values]}
        (src / f"{i}.json").write_text(json.dumps(env) + "\n")
    log = SeenLog(spark, f"{root}/seen", 2)
    log.append("before", seen_rows(spark, [("9.9.9.9", "ip-dst", T0 + timedelta(days=3))]))
    for _ in range(2):
        rows_ = registry.stream_feed(spark, "threatfox", str(src), NOW, files_per_batch=1)
        q = stream_feeds.stream_feed_ingest(rows_, f"{root}/seen", f"{root}/out", f"{root}/cp", NOW)
        q.awaitTermination()
        assert q.exception() is None
    got = [r.value for r in spark.read.parquet(f"{root}/out").collect()]
    assert sorted(got) == ["1.1.1.1", "8.8.8.8"]
    assert log.read().count() == 3
    # A batch that runs again replaces what it wrote.
    again = iocs(spark, [("otx", "8.8.8.8", "ip-dst")])
    stream_feeds.ingest_batch(again, log, f"{root}/out", 9, NOW)
    new = iocs(spark, [("otx", "7.7.7.7", "ip-dst")])
    for _ in range(2):
        stream_feeds.ingest_batch(new, log, f"{root}/out", 10, NOW)
    assert spark.read.parquet(f"{root}/out/batch_id=10").count() == 1
