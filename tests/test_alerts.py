import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from iocweave import schemas
from iocweave.operators import enrich, external, extract, match, outbox
from iocweave.plans import enrichment
from iocweave.sources import alerts as A

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
T0 = datetime(2024, 1, 31)

ELASTIC = {"_id": "al-77f", "_source": {"source.ip": "13.84.7.21", "destination": {"ip": "81.2.69.142"}, "dns.question.name": " edge-cdn.net ",
           "url": {"full": "http://edge-cdn.net/payload"}, "process.hash.sha256": "A" * 64, "process.pid": 7, "dns.x": "extra.example",
           "host": {"ip": ["9.9.9.9", "10.0.0.5"]}, "@timestamp": "2024-01-15T10:00:00Z", "kibana.alert.rule.name": "Beacon rule",
           "severity": "HIGH", "message": f"seen {'C' * 32} at 198.18.0.1 and 300.1.1.1, 192.168.1.1"}}
SENTINEL = {"name": "inc-1", "properties": {"title": "Odd outbound session", "severity": "High", "createdTimeUtc": "2024-01-15T10:00:00+03:00",
            "entities": [{"address": "10.44.0.7"}, {"address": "185.31.9.77"}, {"domainName": "drop.zonefile.org"},
                         {"fileHashes": [{"hashValue": "b" * 64}, "c" * 32]}, {"url": "http://panel.zonefile.org/tick"}, {"sha1": "d" * 40}, "text"]}}
DEEP = {"id": "g", "name": "Generic", "a": {"b": {"c": {"d": {"e": {"f": "level-5", "g": {"h": "level-6"}}}}}}, "l": ["in-list", {"x": "in-dict"}, ["in-list-of-lists"]], "n": 5}


def alerts(spark, *items):
    rows = [(f"k{i}", siem, raw if isinstance(raw, str) else json.dumps(raw)) for i, (siem, raw) in enumerate(items)]
    return spark.createDataFrame(rows, schemas.ALERTS)


def prepared(spark, *items):
    return sorted(enrichment.prepare(alerts(spark, *items), NOW).collect(), key=lambda r: r.alert_key)


def test_candidates(spark):
    e, s, g, bad = prepared(spark, ("elastic", ELASTIC), ("sentinel", SENTINEL), ("syslog", DEEP), ("elastic", "{broken"))
    assert set(e.extracted_iocs) == {"13.84.7.21", "81.2.69.142", "edge-cdn.net", "http://edge-cdn.net/payload", "A" * 64, "a" * 64, "extra.example",
                                     "9.9.9.9", "c" * 32, "198.18.0.1", "300.1.1.1"}
    assert set(s.extracted_iocs) == {"185.31.9.77", "drop.zonefile.org", "b" * 64, "c" * 32, "http://panel.zonefile.org/tick", "d" * 40}
    assert set(g.extracted_iocs) == {"Generic", "level-5", "in-list", "in-dict"}
    assert bad.extracted_iocs == [] and bad.alert_id == "unknown"


def test_headers(spark):
    e, s, g, n, r = prepared(
        spark, ("elastic", ELASTIC), ("sentinel", SENTINEL), ("syslog", DEEP), ("elastic", {"_id": "x", "severity": None}),
        ("elastic", {"kibana.alert.uuid": "u", "rule": {"name": "R"}, "kibana.alert.rule.name": "", "kibana.alert.start": "2024-01-02"}))
    assert (e.alert_id, e.alert_name, e.severity, e.triggered_at) == ("al-77f", "Beacon rule", "high", datetime(2024, 1, 15, 10))
    assert (s.alert_id, s.alert_name, s.severity, s.triggered_at) == ("inc-1", "Odd outbound session", "high", datetime(2024, 1, 15, 10))
    assert (g.alert_id, g.alert_name, g.severity, g.triggered_at) == ("g", "Generic", "medium", T0)
    assert (n.severity, n.alert_name) == ("none", "Unknown Alert")
    assert (r.alert_id, r.alert_name, r.triggered_at) == ("u", "R", datetime(2024, 1, 2))


def test_tokens_have_unicode_bounds(spark):
    df = spark.createDataFrame([(f"é13.84.7.21 1.2.3.5é (1.2.3.6) {'F' * 64}é {'e' * 32}.",)], "t string")
    assert df.select(extract.regex_tokens(F.col("t"))).first()[0] == ["1.2.3.6", "e" * 32]


STORE = [
    ("9", "10", "otx — 2024-01-09", "comment", "13.84.7.21", "", True, ["early"], 0), ("1", "10", "otx — 2024-01-09", "ip-dst", "13.84.7.21", "panel host", True, ["threat-actor:APT28", 'misp-galaxy:threat-actor="Fancy"'], 1),
    ("2", "20", "Manual", "domain", "edge-cdn.net", "x" * 80, True, ["Threat-Actor:Lazarus", "captcha"], 2), ("3", "30", "threatfox — d", "ip-dst", "13.84.7.21", "later", True, ["zz"], 3),
    ("4", "30", "threatfox — d", "ip-dst", "185.31.9.77", "", True, [], 4)]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(STORE, schemas.IOC_ATTRIBUTES)


VT = [("13.84.7.21", "ip-dst", 200, 90, 0, 10, 0, 5, "trojan", ["a"] * 7), ("edge-cdn.net", "domain", 404, 0, 0, 0, 0, None, None, None),
      ("81.2.69.142", "ip-dst", 200, 5, 1, 60, 4, None, "", None), ("9.9.9.9", "ip-dst", 401, 9, 0, 0, 0, None, None, None), ("8.8.4.4", "ip-dst", 200, 0, 0, 0, 0, None, None, None)]
SHODAN = [("13.84.7.21", 200, [443, 22, 80, 22], ["CVE-2", "CVE-1"], ["h"], "Org", None, "NL", None, ["malware"]), ("81.2.69.142", 200, [], ["CVE-1"], None, None, "isp", None, None, None),
          ("evil.com", 404, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def results(spark):
    return external.landed_results({"virustotal": spark.createDataFrame(VT, schemas.VT), "shodan": spark.createDataFrame(SHODAN, schemas.SHODAN)})


def test_reputation(spark, results):
    got = {(r.source, r.ioc_value): r for r in results.collect()}
    assert got[("virustotal", "81.2.69.142")].malicious_score == 8 and got[("virustotal", "81.2.69.142")].summary == "5/70 engines flagged malicious"
    assert got[("virustotal", "13.84.7.21")].summary == "90/100 engines flagged malicious · label=trojan · reputation=5"
    assert json.loads(got[("virustotal", "13.84.7.21")].details)["names"] == ["a"] * 5
    assert got[("virustotal", "edge-cdn.net")].found is False and ("virustotal", "9.9.9.9") not in got
    assert got[("virustotal", "8.8.4.4")].malicious_score is None
    assert got[("shodan", "13.84.7.21")].malicious_score == 80 and got[("shodan", "81.2.69.142")].malicious_score == 50
    assert got[("shodan", "13.84.7.21")].summary == "3 open ports · 2 CVEs · Org · NL"
    url = spark.range(1).select(external.vt_object_id(F.lit("http://x.y/?a>>>" + "z" * 100), F.lit("url"))).first()[0]
    import base64
    assert url == base64.urlsafe_b64encode(("http://x.y/?a>>>" + "z" * 100).encode()).decode().strip("=")


def test_lookup(spark, store):
    asked = spark.createDataFrame([("13.84.7.21",), ("none.org",), ("edge-cdn.net",)], "value string")
    got = {r.value: r for r in match.lookup_one(asked, store, NOW).collect()}
    ip = got["13.84.7.21"]
    assert ip.matched and ip.feeds == ["otx", "threatfox"] and ip.threat_actors == ["APT28"] and ip.campaigns == ['misp-galaxy:threat-actor="Fancy"']
    assert ip.attribute_count == 3 and ip.ioc is None
    assert not got["none.org"].matched and got["none.org"].tags == [] and got["none.org"].attribute_count == 0
    assert got["edge-cdn.net"].ioc.source_feed == "misp" and got["edge-cdn.net"].threat_actors == []


def test_enrichment(spark, store, results):
    df = alerts(spark, ("elastic", ELASTIC), ("sentinel", SENTINEL), ("elastic", {"_id": "ext", "_source": {"source.ip": "81.2.69.142", "severity": "critical"}}), ("syslog", {"id": "none"}))
    tables = enrichment.enrich_cycle(df, store, NOW, results, enrich_unmatched=True)
    got = {r.alert_id: r for r in tables["enriched_alerts"].collect()}
    e = got["al-77f"]
    assert [m.value for m in e.matched_iocs] == ["13.84.7.21", "edge-cdn.net"]
    assert e.matched_iocs[0].description == "panel host" and e.matched_iocs[0].tags == ["early", 'misp-galaxy:threat-actor="Fancy"', "threat-actor:APT28", "zz"]
    assert e.threat_actors == ["APT28", "Threat-Actor:Lazarus"] and e.campaigns == ["Fancy"]
    assert e.enrichment_tags == ["tip:matched", "tip:feed:misp", "tip:feed:otx", "tip:actor:APT28", "tip:actor:Threat-Actor:Lazarus", "tip:actor:captcha",
                                 "tip:ioc-type:domain", "tip:ioc-type:ip-dst", "tip:virustotal:malicious", "tip:shodan:malicious", "tip:virustotal:seen", "tip:shodan:malicious"]
    assert e.risk_score == 90.0 and e.should_notify
    x = got["ext"]
    assert (x.gate_enricher, x.gate_notifier, x.should_notify, x.risk_score) == (True, False, False, 50.0)
    assert got["none"].enrichment_tags == [] and got["none"].risk_score == 0.0
    assert tables["summary"].first() == (2, 1, 4, 2, 2)
    message = {r.alert_id: json.loads(r.payload) for r in tables["notify_outbox"].collect()}
    blocks = message["al-77f"]["blocks"]
    assert [b["type"] for b in blocks] == ["header", "section", "divider", "section", "section", "section", "section", "section", "divider", "context"]
    assert "x" * 60 + "..." in blocks[3]["text"]["text"] and "`█████████░` 90/100" in blocks[6]["text"]["text"]
    docs = {r.alert_id: json.loads(r.document) for r in tables["tag_outbox"].collect()}
    assert docs["inc-1"]["properties"]["labels"][0] == {"labelName": "tip:matched"} and docs["al-77f"]["doc"]["tip.enriched"] is True
    plain = enrichment.enrich_cycle(df, store, NOW)["enriched_alerts"].collect()
    assert len(plain) == 4 and all(r.external == [] for r in plain)
    routes = {r.alert_id: r.route for r in outbox.tag_route(tables["enriched_alerts"]).collect()}
    assert routes["inc-1"] == "sentinel" and routes["none"] == "skipped"


def test_hot_value_join_is_split(spark, store):
    """A value that a large part of the alerts holds is split at run time, and nothing is lost."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 6000
        hot = F.when(F.col("id") % 3 == 0, "13.84.7.21").otherwise(F.concat(F.lit("h"), "id", F.lit(".org")))
        c = spark.range(0, n, 1, 8).select(F.col("id").cast("string").alias("alert_key"), hot.alias("value"))
        joined = match.match_candidates(c, store, NOW)
        assert joined.count() == n // 3
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_entities_in_their_own_table(spark):
    incidents = alerts(spark, ("sentinel", {}), ("sentinel", {}))
    entities = spark.createDataFrame([("k0", json.dumps(e)) for e in SENTINEL["properties"]["entities"]], "alert_key string, t string").select("alert_key", F.parse_json("t").alias("entity"))
    got = extract.entity_candidates(incidents.select("alert_key"), entities).collect()
    assert sum(r.alert_key == "k0" for r in got) == 6 and [r.value for r in got if r.alert_key == "k1"] == [None]


def test_reverse_search_keeps_ten(spark):
    items = [("elastic", {"_id": str(i), "_source": {"source.ip": "13.84.7.21", "@timestamp": f"2024-01-01T00:{i:02d}:00Z"}}) for i in range(15)]
    parsed = A.alert_header(A.parse_alerts(alerts(spark, *items)), NOW)
    got = A.reverse_search(parsed, spark.createDataFrame([("13.84.7.21",), ("x.org",)], "value string")).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 11)) and {r.alert_key for r in got} == {f"k{i}" for i in range(5, 15)}


def test_top_ioc_takes_the_first_on_ties(spark):
    m = spark.createDataFrame([([("a", 70), ("b", 90), ("c", 90)],)], "m array<struct<value:string,confidence:int>>")
    assert m.select(enrich.top_ioc(F.col("m"))).first()[0].value == "b"
