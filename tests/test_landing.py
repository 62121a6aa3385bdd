"""Landed files: rejects by reason, alerts by day, CSV; functions in SQL text; extension points."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from iocweave import schemas
from iocweave.functions import ip, norm, sql
from iocweave.operators import external, score
from iocweave.plans import enrichment, run
from iocweave.session import tune, work_dir
from iocweave.sources import alerts as A
from iocweave.sources import feeds, landing, registry

T0 = datetime(2024, 1, 31)
NOW = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


# --- rejects -------------------------------------------------------------------------------------------------

def tf(ioc, kind="domain", **more):
    return {"id": "1", "ioc": ioc, "ioc_type": kind, "confidence_level": 50} | more


LINES = [
    json.dumps({"query_status": "ok", "data": [tf("evil.com"), tf("  "), tf("x" * 40, "sha1_hash"), tf("10.0.0.1:80", "ip:port"), tf("8.8.8.8:80", "ip:port")]}),
    json.dumps({"query_status": "no_result", "data": [tf("a.com"), tf("b.com")]}),
    json.dumps({"query_status": "ok", "data": []}),
    '{"query_status": "ok", "data": [{"ioc"',
    json.dumps({"query_status": "ok", "data": [tf("good.org") | {"confidence_level": "much"}]}),
]
WANT = {"good": 3, feeds.BLANK: 1, feeds.UNMAPPED: 1, feeds.REFUSED: 1, feeds.STATUS: 2, feeds.EMPTY: 1, feeds.CORRUPT: 1}


def landed_lines(spark, tmp_path):
    (tmp_path / "tf").mkdir()
    (tmp_path / "tf" / "1.json").write_text("\n".join(LINES) + "\n")
    return registry.read_feed(spark, "threatfox", str(tmp_path / "tf"), NOW, judged=True)


def test_rejects_have_reasons_and_add_up(spark, tmp_path):
    good, rejects, counts = feeds.split_judged(landed_lines(spark, tmp_path), work_dir(spark, "judged"))
    assert counts == WANT | {"rows": 10}
    assert sorted(r["value"] for r in good.collect()) == ["8.8.8.8", "evil.com", "good.org"]
    assert {r["reason"]: r["count"] for r in rejects.groupBy("reason").count().collect()} == {k: n for k, n in WANT.items() if k != "good"}
    # The good rows are those of the plain flattener after normalising.
    plain = registry.read_feed(spark, "threatfox", str(tmp_path / "tf"), NOW)
    assert plain.count() == 4 and set(good.columns) == set(plain.columns)


def test_a_run_keeps_its_rejects(spark, tmp_path):
    store_ = run.Store(spark, work_dir(spark, "store"), 2)
    judged = landed_lines(spark, tmp_path)
    for run_id in ("r1", "r1"):
        rows = run.run(store_, run_id, {"threatfox": judged}, NOW).collect()
    assert [(r["feed_name"], r["new_iocs"]) for r in rows] == [("abusech", 3)]
    rejects = store_.read("rejects").groupBy("feed", "reason").count().collect()
    assert {(r["feed"], r["reason"]): r["count"] for r in rejects} == {("threatfox", k): n for k, n in WANT.items() if k != "good"}


@pytest.mark.parametrize("name", ["otx", "abusech_malware", "abusech_url", "csv"])
def test_every_feed_gives_reasons(spark, tmp_path, name):
    (tmp_path / "x").mkdir()
    text = "value,type,threat_level,description,tags\n1.2.3.9,ip,high,C2,a\nq,cidr,low,,\n ,ip,low,,\n" if name == "csv" else "{}\n{broken\n"
    (tmp_path / "x" / "1.txt").write_text(text)
    _, _, counts = feeds.split_judged(registry.read_feed(spark, name, str(tmp_path / "x"), NOW, judged=True), work_dir(spark, "judged"))
    some = {k: n for k, n in counts.items() if n}
    if name == "csv":
        assert some == {"rows": 3, "good": 1, feeds.UNMAPPED: 1, feeds.BLANK: 1}
    elif name == "abusech_malware":
        assert some == {"rows": 2, feeds.STATUS: 1, feeds.CORRUPT: 1}
    else:
        assert some == {"rows": 2, feeds.EMPTY: 1, feeds.CORRUPT: 1}


# --- alerts --------------------------------------------------------------------------------------------------

def elastic(i, at, ip_="8.8.8.8", extra=""):
    return f'{{"_id":"a{i}","_source":{{"source.ip":"{ip_}","kibana.alert.severity":"HIGH","@timestamp":"{at:%Y-%m-%dT%H:%M:%S}Z"{extra}}}}}'


def raw_alerts(spark):
    rows = [(f"k{i:03d}", "elastic", elastic(i, T0 - timedelta(hours=i))) for i in range(100)]
    rows += [("s1", "sentinel", '{"name":"n","properties":{"createdTimeUtc":"2024-01-30T01:00:00Z"}}'), ("bad", "elastic", "{no"), ("null", "elastic", None)]
    # A key that occurs twice has its last value.
    rows += [("twice", "elastic", elastic(7, T0 + timedelta(hours=1), "1.1.1.1", ',"source.ip":"9.9.9.9"'))]
    return spark.createDataFrame(rows, schemas.ALERTS)


def test_scan_of_landed_alerts_reads_what_it_returns(spark):
    tune(spark)
    path, alerts = work_dir(spark, "alerts"), raw_alerts(spark)
    for _ in range(2):
        assert landing.land_alerts(alerts, path, "b1", NOW) == {"rows": 104, "refused": 2}
    landed = landing.read_landed(spark, path)
    assert landed.count() == 104
    since = F.lit("2024-01-30 10:00:00").cast("timestamp_ntz")
    got = landing.latest_landed(landed, "elastic", since, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "source_siem" in folders and "event_day" in folders and "GreaterThanOrEqual(triggered_at" in plan
    want = A.latest_alerts(A.alert_header(A.parse_alerts(alerts), NOW), "elastic", since, 5)
    columns = ["alert_key", "alert_id", "alert_name", "severity", "triggered_at"]
    assert [tuple(r) for r in got.select(*columns).collect()] == [tuple(r) for r in want.select(*columns).collect()]
    # Only what the scan returns is parsed.
    counts = F.count("*").alias("n")
    from pyspark.sql import Observation

    seen = Observation()
    prepared = enrichment.prepare(got.observe(seen, counts), NOW)
    assert len(prepared.collect()) == 5 and seen.get == {"n": 5}


def test_values_of_landed_alerts(spark):
    tune(spark)
    path, alerts = work_dir(spark, "alerts"), raw_alerts(spark)
    landing.land_alerts(alerts, path, "b1", NOW)
    asked = spark.createDataFrame([("8.8.8.8",), ("9.9.9.9",), ("1.1.1.1",), ("8.8.8.8",)], "value string")
    rows = lambda df: sorted((r["value"], r["alert_key"], r["rank"]) for r in df.collect())
    got = rows(landing.search_landed(landing.read_landed(spark, path), asked))
    assert got == rows(A.reverse_search(A.alert_header(A.parse_alerts(alerts), NOW), asked))
    assert ("9.9.9.9", "twice", 1) in got and len(got) == 11 and not any(v == "1.1.1.1" for v, _, _ in got)


# --- SQL text ------------------------------------------------------------------------------------------------

VALUES = [" 8.8.8.8 ", "10.0.0.1", "2001:4860:4860::8888", "fe80::1%eth0", "::ffff:8.8.8.8", "http://a.b/c'd\\e", "WWW.Evil.Com.", "localhost", "A" * 64, "a@b.cd",
          "d41d8cd98f00b204e9800998ecf8427e", "", None, "x", "CamelCase.exe", "1.2.3.4:80", "　evil.org ", "and(x) in(y) '=('"]


def test_functions_in_sql_are_the_column_functions(spark):
    names = sql.register(spark, "t_")
    sql.register(spark, "t_")
    assert len(names) == 18
    kinds = ["ip-dst", "domain", "url", "sha256", "md5", "email-src", "filename", "other"]
    df = spark.createDataFrame([(v, k) for v in VALUES for k in kinds], "value string, ioc_type string")
    df.createOrReplaceTempView("sql_values")
    v, t = F.col("value"), F.col("ioc_type")
    want = df.select("value", "ioc_type", norm.normalise(v, t), norm.accepted(v, t), norm.infer_ioc_type(v), ip.valid_candidate(v), norm.host_from_url(v), external.vt_object_id(v, t))
    got = spark.sql("SELECT value, ioc_type, t_ioc_normalise(value, ioc_type), t_ioc_accepted(value, ioc_type), t_ioc_infer_type(value), t_ioc_valid_candidate(value), "
                    "t_host_from_url(value), t_vt_object_id(value, ioc_type) FROM sql_values")
    assert sorted(map(str, got.collect())) == sorted(map(lambda r: str(r).replace("Row", "Row"), want.toDF(*got.columns).collect()))
    row = spark.sql("SELECT t_norm_ip('2001:4860:4860:0:0:0:0:8888') a, t_is_private_ip('fe80::1') b, t_score_recency(timestamp_ntz'2024-01-30', timestamp_ntz'2024-01-31') c, "
                    "t_score_tag_signal(array('APT28', 'x')) d, t_is_malicious(50) e, t_map_tlp_level('RED') f").first()
    assert tuple(row) == ("2001:4860:4860::8888", True, 100.0, 7.0, True, "high")
    one = spark.createDataFrame([("otx", "url", "high", 80, T0, ["emotet"])], "source_feed string, ioc_type string, threat_level string, confidence int, last_seen timestamp_ntz, tags array<string>")
    one.createOrReplaceTempView("sql_one")
    by_sql = spark.sql("SELECT t_score_ioc(source_feed, ioc_type, threat_level, confidence, last_seen, tags, timestamp_ntz'2024-01-31') s FROM sql_one").first()["s"]
    assert by_sql == score.score_iocs(one, NOW).first()["threat_score"]


# --- extension points ----------------------------------------------------------------------------------------

@pytest.fixture
def registered():
    known = {name: dict(getattr(registry, name)) for name in ("FEEDS", "PROVIDERS", "ALERT_SOURCES")}
    ranks = dict(feeds.FEED_RANK)
    yield
    for name, content in known.items():
        getattr(registry, name).clear()
        getattr(registry, name).update(content)
    feeds.FEED_RANK.clear()
    feeds.FEED_RANK.update(ranks)


def test_a_new_feed_goes_through_a_run(spark, tmp_path, registered):
    def flatten(rows, now):
        return rows.select(
            F.col("host").alias("value"), F.lit("domain").alias("ioc_type"), F.lit("mine").alias("source_feed"), F.lit("low").alias("threat_level"),
            F.array(F.lit("own")).alias("tags"), F.lit("d").alias("description"), now.alias("first_seen"), now.alias("last_seen"), F.lit(30).alias("confidence"),
            F.lit("p").alias("pulse_id"), F.array().cast("array<string>").alias("attack_techniques"), F.lit(None).cast("string").alias("raw"),
            feeds.ord_struct("mine", None, F.lit(0), F.lit(0), F.lit(0)).alias("ord"))

    registry.register_feed(registry.Feed("mine", "mine", "host string", flatten))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text('{"host":"New.Example.org"}\n{"host":"nodot"}\n')
    rows = registry.read_feeds(spark, {"mine": str(tmp_path / "m")}, NOW)
    assert sorted(r["value"] for r in rows.collect()) == ["New.Example.org", "nodot"]
    store_ = run.Store(spark, work_dir(spark, "store"), 2)
    result = run.run(store_, "r", {"mine": rows}, NOW).collect()
    assert [(r["feed_name"], r["total_fetched"], r["new_iocs"]) for r in result] == [("mine", 1, 1)]
    assert [r["value"] for r in store_.read("attributes").collect()] == ["new.example.org"]
    with pytest.raises(ValueError):
        registry.read_feed(spark, "mine", str(tmp_path / "m"), NOW, judged=True)


def test_a_new_provider_answers(spark, registered):
    def parse(landed):
        found = F.col("hits") > 0
        return landed.select(
            F.lit("mine").alias("source"), "ioc_value", F.lit("domain").alias("ioc_type"), found.alias("found"),
            F.least(F.lit(100), F.col("hits")).cast("int").alias("malicious_score"), F.lit("s").alias("summary"), F.lit(None).cast("string").alias("details"), F.lit("l").alias("link"))

    registry.register_provider(registry.Provider("mine", ("domain",), parse))
    landed = spark.createDataFrame([("evil.com", 70), ("good.com", 0)], "ioc_value string, hits int")
    results = external.landed_results({"mine": landed})
    iocs = spark.createDataFrame([("evil.com", "domain"), ("evil.com", "url"), ("good.com", "domain"), ("none.com", "domain")], "value string, ioc_type string")
    got = {(r["value"], r["source"], r["malicious_score"]) for r in external.external_join(iocs, results).collect()}
    assert got == {("evil.com", "mine", 70), ("good.com", "mine", 0)}


def test_a_new_alert_source_is_read(spark, registered):
    get = lambda v, path: F.try_variant_get(v, path, "string")
    registry.register_alert_source(registry.AlertSource(
        "mine", lambda v: get(v, "$.key"), lambda v: get(v, "$.title"), lambda v: F.lit("critical"), lambda v: F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"),
        lambda v, raw: F.array(get(v, "$.host"), F.lit("localhost"))))
    alerts = spark.createDataFrame([("k", "mine", '{"key":"x1","title":"T","host":"evil.com"}'), ("g", "syslog", '{"id":"g1","a":"other.com"}')], schemas.ALERTS)
    rows = {r["alert_key"]: r for r in enrichment.prepare(alerts, NOW).collect()}
    assert (rows["k"]["alert_id"], rows["k"]["alert_name"], rows["k"]["severity"], rows["k"]["extracted_iocs"]) == ("x1", "T", "critical", ["evil.com"])
    assert rows["g"]["alert_id"] == "g1"
