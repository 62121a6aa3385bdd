"""Plans and results of the steps that cost most on large inputs."""

import datetime as dt

from pyspark.sql import functions as F

from iocweave.functions import base, norm
from iocweave.operators import enrich, match
from iocweave.session import bound_tasks, tune
from iocweave.sources import alerts as A
from workloads import catalog

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_domain_and_hash_tests_are_not_interpreted(spark):
    df = spark.createDataFrame(
        [("www.a.com", "domain"), ("www.b", "domain"), ("A" * 32, "md5"), ("d41d8cd98f00b204e9800998ecf8427e", "md5"),
         ("x.local", "domain"), ("example.com", "domain"), ("a" * 33, "md5"), (" e.de.\n", "domain"), (None, "domain"), ("a.bc", None)],
        "value string, ioc_type string",
    )
    for test in (norm._domain_ok(F.col("value")), norm._hash_ok(F.col("value"), F.col("ioc_type"))):
        assert "lambda" not in plan(df.select(test))
    got = [r[0] for r in df.select(norm.normalise(F.col("value"), F.col("ioc_type"))).collect()]
    assert got == ["a.com", None, "a" * 32, None, None, None, None, "e.de", None, None]


def test_strip_lets_visible_ends_through(spark):
    texts = ["", " ", "a", "a b", " a　", "\x85é", "é\t", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(base.strip(F.col("t")))
    assert "CASE WHEN" in plan(df)
    assert [r[0] for r in df.collect()] == ["", "", "a", "a b", "a", "é", "é", None]


def test_rounding_is_interpreted_on_ties_only(spark):
    df = spark.createDataFrame([(15.075,), (0.125,), (0.375,), (2.5,), (-0.001,), (None,)], "x double")
    got = df.select(base.round_exact(F.col("x"), 2))
    assert "CASE WHEN" in plan(got).split("transform")[0]
    assert [r[0] for r in got.collect()] == [15.07, 0.12, 0.38, 2.5, 0.0, None]


def test_candidates_are_made_of_columns(spark):
    raw = '{"_source":{"source.ip":" 8.8.8.8 ","url":{"full":"http://a.test/x"},"host":{"ip":["1.1.1.1","10.0.0.1"]}}}'
    other = '{"a":"evil.example.org","b":{"c":["x.example.net",{"d":" sp "},["not this"]]}}'
    df = spark.createDataFrame([("1", "elastic", raw), ("2", "other", other), ("3", None, other)], "alert_key string, source_siem string, raw string")
    got = A.extract_candidates(A.parse_alerts(df))
    assert "_part_0_2" in plan(got)
    assert got.columns == ["alert_key", "source_siem", "raw", "v", "extracted_iocs"]
    values = {r["alert_key"]: r["extracted_iocs"] for r in got.collect()}
    assert values["1"] == ["1.1.1.1", "8.8.8.8", "http://a.test/x"]
    assert values["2"] == values["3"] == [" sp ", "evil.example.org", "x.example.net"]


def test_slim_store_gives_the_same_matches(spark):
    store = spark.createDataFrame(
        [("a2", "e", "f — 1", "url", "v", "text", ["t"], 1, ["T2"], 9), ("a1", "e", "f — 1", "url", "v", "text", ["s"], 1, ["T1"], 8)],
        "attribute_id string, event_id string, event_info string, type string, value string, comment string, tags array<string>, "
        "seq bigint, attack_techniques array<string>, confidence int",
    )
    asked = spark.createDataFrame([("k", "v")], "alert_key string, value string")
    slim = match.slim(store, "attack_techniques")
    assert "confidence" not in slim.columns and "comment" in slim.columns
    read = ["alert_key", "value", "ioc_type", "attribute_id", "attack_techniques"]
    full = match.match_candidates(asked, store, NOW, match_mode="stored").select(*read).collect()
    assert match.match_candidates(asked, slim, NOW, match_mode="stored").select(*read).collect() == full
    assert full[0]["attack_techniques"] == ["T1"]


def moved_columns(df, key="alert_key"):
    """Names of the columns that each exchange by a key takes in, and whether an aggregate makes them."""
    node = df._jdf.queryExecution().sparkPlan()
    found, todo = [], [node]
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange" and key in node.outputPartitioning().toString():
            out = node.output()
            found.append(({out.apply(i).name() for i in range(out.size())}, "Aggregate" in children[0].nodeName()))
        todo += children
    return found


def test_enrichment_moves_what_is_read(spark):
    store = spark.createDataFrame(
        [("a1", "e", "f — 1", "url", "v.evil.org", "text", ["s", "threat-actor:APT28"], 1), ("a2", "e", "f — 1", "domain", "w.evil.org", None, [], 2)],
        "attribute_id string, event_id string, event_info string, type string, value string, comment string, tags array<string>, seq bigint",
    )
    alerts = spark.createDataFrame(
        [("k1", "1", "elastic", None, "high", None, ["v.evil.org", "none", "w.evil.org"]), ("k2", None, None, "n", "low", None, []),
         ("k3", "3", "elastic", "n", None, None, None), (None, "4", "elastic", "n", "high", None, ["v.evil.org", None])],
        "alert_key string, alert_id string, source_siem string, alert_name string, severity string, triggered_at timestamp_ntz, extracted_iocs array<string>",
    )
    enriched = enrich.enriched_alerts(alerts, store, NOW)
    rows = lambda df: sorted(map(str, df.collect()))
    staged = enrich.enriched_alerts(alerts, store, NOW, at_hand=True)
    assert rows(staged) == rows(enriched) and rows(staged.drop("extracted_iocs")) == rows(enriched.drop("extracted_iocs"))
    by_value = [columns for columns, _ in moved_columns(staged, "value#") if "alert_key" in columns]
    assert all(columns <= {"alert_key", "value", "_digest"} for columns in by_value)
    gates = enriched.select("alert_key", "should_notify")
    [(columns, gathered)] = moved_columns(gates)
    assert not columns & {"alert_id", "alert_name", "triggered_at", "extracted_iocs", "first_seen"} and "severity" in columns
    assert not gathered
    got = {r["alert_key"]: r for r in enriched.collect()}
    assert [m["value"] for m in got["k1"]["matched_iocs"]] == ["w.evil.org", "v.evil.org"]
    first = got["k1"]["matched_iocs"][1].asDict()
    assert (first["description"], first["threat_level"], first["confidence"], first["attack_techniques"]) == ("text", "unknown", 75, [])
    assert first["tags"] == ["s", "threat-actor:APT28"] and first["first_seen"] == first["last_seen"] == dt.datetime(2024, 1, 31)
    assert got["k1"]["alert_name"] is None and got["k1"]["extracted_iocs"] == ["v.evil.org", "none", "w.evil.org"]
    assert got["k2"]["extracted_iocs"] == [] and got["k3"]["extracted_iocs"] is None and got["k2"]["alert_id"] is None
    assert got[None]["extracted_iocs"] == ["v.evil.org", None] and len(got[None]["matched_iocs"]) == 1 and got[None]["should_notify"]
    assert {r["alert_key"]: r["should_notify"] for r in gates.collect()} == {"k1": True, "k2": False, "k3": False, None: True}


def test_whole_headers_are_staged(spark, monkeypatch):
    spark = bound_tasks(tune(spark.newSession()))
    raw = '{"id":"%s","name":"n","a":"v.evil.org","b":"other.example.org"}'
    alerts = spark.createDataFrame([(f"k{i}", "syslog", raw % i) for i in range(5)] + [("k9", "syslog", "{}")], "alert_key string, source_siem string, raw string")
    store = spark.createDataFrame(
        [("a1", "e", "f — 1", "domain", "v.evil.org", "text", ["s"], 1)],
        "attribute_id string, event_id string, event_info string, type string, value string, comment string, tags array<string>, seq bigint",
    )
    monkeypatch.setattr(catalog.D, "raw_alerts", lambda spark, d: alerts)
    monkeypatch.setattr(catalog.D, "attributes", lambda spark, d: store)
    monkeypatch.setattr(catalog, "results", lambda spark, d: None)
    whole = catalog.enriched_whole(spark, "")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(whole) == rows(catalog.enriched(spark, "")) and whole.count() == 6
    assert "parse_json" not in plan(whole).lower() and "parsejson" not in plan(whole).lower()
    got = {r["alert_key"]: r for r in catalog.enriched_whole(spark, "").collect()}
    assert got["k0"]["alert_id"] == "0" and got["k0"]["extracted_iocs"] == ["other.example.org", "v.evil.org"] and got["k9"]["matched_iocs"] == []
