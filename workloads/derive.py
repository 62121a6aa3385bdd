"""Feed, alert and store inputs derived from the given tables.

The tables hold no indicators, so each input row is computed from a table row by plain expressions. The value
expressions below are SQL text that Spark and DuckDB read alike; whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iocweave.session import spread
from iocweave.sources import feeds

NOW_TEXT = "2024-01-31 00:00:00"
NOW_SQL = f"CAST('{NOW_TEXT}' AS TIMESTAMP)"


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


# Tables whose rows get heavy work. Each is one small file here, so a run may ask for more tasks than its one split.
SPREAD = {"events", "lineitem", "orders", "documents", "pages", "customer"}
PARTS = "spark.iocweave.parts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(PARTS, None)
    return spread(df, df.columns[0], int(parts)) if parts and name in SPREAD else df


def ip(k: str) -> str:
    return f"concat_ws('.', ({k}*7919+11)%223+1, ({k}*104729+3)%256, ({k}*31)%256, {k}%256)"


def dom(k: str) -> str:
    return f"concat('Host', {k}, '.zone', {k}%7, '.threatnet.org')"


def url(k: str) -> str:
    return f"concat('http://host', {k}, '.zone', {k}%7, '.threatnet.org/p/', {k})"


def md5(k: str) -> str:
    return f"md5(concat('sample-', {k}))"


def sha1(k: str) -> str:
    return f"sha1(concat('sample-', {k}))"


def sha256(k: str, d: str) -> str:
    x = f"concat('sample-', {k})"
    return f"sha2({x}, 256)" if d == "spark" else f"sha256({x})"


def iso(ts: str, d: str) -> str:
    return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")" if d == "spark" else f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def spaced(ts: str, d: str) -> str:
    return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')" if d == "spark" else f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def day(ts: str, d: str) -> str:
    return f"date_format({ts}, 'yyyy-MM-dd')" if d == "spark" else f"strftime({ts}, '%Y-%m-%d')"


def pad(k: str) -> str:
    return f"lpad(CAST({k} AS STRING), 12, '0')"


# --- feed record fields, shared by both engines -------------------------------------------------------------

def otx_fields(d: str) -> dict[str, str]:
    return {
        "fetch_id": pad("event_id"),
        "id": "concat('pulse-', event_id)",
        "name": "concat('Campaign ', event_type)",
        "TLP": "CASE event_type WHEN 'error' THEN 'RED' WHEN 'purchase' THEN 'amber' WHEN 'signup' THEN 'green' "
        "WHEN 'view' THEN 'purple' END",
        "adversary": "CASE WHEN value > 100 THEN 'APT28' WHEN value > 50 THEN 'threat-actor:FIN7' ELSE '' END",
        "created": f"concat({iso('ts', d)}, '+02:00')",
        "modified": f"CASE WHEN event_type <> 'view' THEN concat({iso('ts + INTERVAL 1 DAY', d)}, 'Z') END",
    }


def malware_fields(d: str) -> dict[str, str]:
    return {
        "fetch_id": pad("o_orderkey"),
        "query_status": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'no_results' ELSE 'ok' END",
        "sha256_hash": f"upper({sha256('o_custkey', d)})",
        "md5_hash": f"CASE WHEN o_orderstatus = 'O' THEN ' ' ELSE {md5('o_custkey')} END",
        "file_name": "CASE WHEN o_orderstatus <> 'P' THEN concat('invoice_', o_custkey, '.exe') END",
        "signature": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Emotet' WHEN '2-HIGH' THEN '' "
        "WHEN '5-LOW' THEN 'TrickBot' END",
        "file_type": "CASE WHEN o_orderstatus = 'F' THEN 'exe' ELSE '' END",
        "first_seen": spaced("o_orderdate", d),
        "last_seen": f"CASE WHEN o_orderstatus = 'F' THEN {day('o_orderdate + INTERVAL 3 DAY', d)} ELSE '' END",
    }


def url_fields(d: str) -> dict[str, str]:
    return {
        "fetch_id": pad("page_id"),
        "id": "CAST(page_id AS STRING)",
        "url": "concat(url, ' ')",
        "host": f"CASE WHEN url LIKE 'https%' THEN '' ELSE {ip('page_id')} END",
        "threat": "CASE WHEN url LIKE '%.example.com%' THEN 'Malware_download' "
        "WHEN url LIKE '%.example.net%' THEN 'phishing' END",
        "date_added": "CASE WHEN url LIKE 'https%' THEN '2024-01-15 10:00:00 UTC' "
        "ELSE concat('2024-01-', 10 + page_id % 20, 'T10:00:00') END",
    }


def threatfox_fields(d: str) -> dict[str, str]:
    return {
        "fetch_id": f"concat_ws('-', {pad('l_orderkey')}, {pad('l_partkey')}, {pad('l_suppkey')}, l_linenumber, "
        "CAST(l_quantity AS INT), CAST(floor(l_extendedprice) AS BIGINT))",
        "id": "concat(l_orderkey, '-', l_linenumber)",
        "ioc": f"CASE l_linenumber WHEN 1 THEN concat({ip('l_suppkey')}, ':4444') "
        f"WHEN 2 THEN concat('WWW.', {dom('l_suppkey')}, '.') WHEN 3 THEN {url('l_partkey')} "
        f"WHEN 4 THEN upper({md5('l_suppkey')}) WHEN 5 THEN {sha256('l_partkey', d)} "
        f"WHEN 6 THEN {sha1('l_partkey')} ELSE {ip('l_partkey')} END",
        "ioc_type": "CASE l_linenumber WHEN 2 THEN 'domain' WHEN 3 THEN 'url' WHEN 4 THEN 'md5_hash' "
        "WHEN 5 THEN 'sha256_hash' WHEN 6 THEN 'sha1_hash' ELSE 'ip:port' END",
        "malware": "CASE l_returnflag WHEN 'A' THEN 'Cobalt Strike' WHEN 'R' THEN '' END",
        "malware_alias": "CASE WHEN l_linestatus = 'F' THEN 'Conti' ELSE 'Cobalt Strike' END",
        "confidence_level": "CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity * 2 AS INT) END",
        "first_seen": spaced("l_shipdate", d),
    }


# --- Spark inputs --------------------------------------------------------------------------------------------

def _struct(fields: dict[str, str], names: list[str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {fields[n]}" for n in names) + ")"


def otx_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = otx_fields("spark") | {
        "tags": "array(event_type, '', concat('user-', user_id % 50))",
        "attack_ids": "array('T1059', concat('T1', 100 + user_id % 30))",
        "references": "array(parse_json(concat('{\"external_id\":\"T1', 100 + user_id % 20, '\"}')), "
        "parse_json('\"https://ref.test\"'), parse_json('{\"external_id\":\"CVE-1\"}'))",
        "pulse_source": "CASE event_type WHEN 'error' THEN parse_json(concat('{\"indicator_count\":', "
        "CAST(floor(value) AS BIGINT), '}')) WHEN 'view' THEN parse_json('\"feed\"') END",
    }
    indicator = lambda t, v, s: f"named_struct('type', '{t}', 'indicator', {v}, 'description', {s})"
    f["indicators"] = "array(" + ", ".join(
        [
            indicator("IPv4", f"concat(' ', {ip('user_id')})", "''"),
            indicator("hostname", dom("user_id"), "'C2 host'"),
            indicator("FileHash-SHA256", sha256("user_id", "spark"), "CAST(NULL AS STRING)"),
            indicator("CIDR", "'10.0.0.0/8'", "''"),
            indicator("email", "'  '", "''"),
        ]
    ) + ")"
    names = ["id", "name", "TLP", "tags", "adversary", "created", "modified", "attack_ids", "references",
             "pulse_source", "indicators"]
    return table(spark, sf_dir, "events").selectExpr(f"{f['fetch_id']} AS fetch_id", f"array({_struct(f, names)}) AS results")


def malware_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = malware_fields("spark") | {
        "tags": "CASE o_orderpriority WHEN '1-URGENT' THEN array('Emotet', 'banking') "
        "WHEN '2-HIGH' THEN array('loader') END"
    }
    names = ["sha256_hash", "md5_hash", "file_name", "signature", "file_type", "tags", "first_seen", "last_seen"]
    return table(spark, sf_dir, "orders").selectExpr(
        f"{f['fetch_id']} AS fetch_id", f"{f['query_status']} AS query_status", f"array({_struct(f, names)}) AS data"
    )


def url_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = url_fields("spark") | {"tags": "CASE WHEN url LIKE '%.example.org%' THEN array('org', 'exe') END"}
    names = ["id", "url", "host", "threat", "tags", "date_added"]
    return table(spark, sf_dir, "pages").selectExpr(f"{f['fetch_id']} AS fetch_id", f"array({_struct(f, names)}) AS urls")


def threatfox_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = threatfox_fields("spark") | {
        "tags": "CASE WHEN l_returnflag = 'A' THEN array('Cobalt Strike', '') ELSE array('c2') END",
        "last_seen": "CAST(NULL AS STRING)",
    }
    names = ["id", "ioc", "ioc_type", "malware", "malware_alias", "confidence_level", "tags", "first_seen", "last_seen"]
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{f['fetch_id']} AS fetch_id", "'ok' AS query_status", f"array({_struct(f, names)}) AS data"
    )


def feed_rows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "otx": feeds.flatten_otx(otx_envelopes(spark, sf_dir), now()),
        "abusech_malware": feeds.flatten_malware(malware_envelopes(spark, sf_dir), now()),
        "abusech_url": feeds.flatten_urls(url_envelopes(spark, sf_dir), now()),
        "threatfox": feeds.flatten_threatfox(threatfox_envelopes(spark, sf_dir), now()),
    }


def all_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.union_feeds(list(feed_rows(spark, sf_dir).values()), spark)


# Keys of customers and orders that feeds and alerts meet, or else keys beyond all that they hold.
SEEN_KEY = "(CASE WHEN c_acctbal > 0 THEN c_custkey ELSE c_custkey + 700000000 END)"
STORE_KEY = "(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN c_custkey ELSE c_custkey + 700000000 END)"
ORDER_KEY = "(CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_custkey + 700000000 END)"


def seen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen keys of customers, first seen up to 44 days ago; without a positive balance, of values that no feed has."""
    return (
        table(spark, sf_dir, "customer")
        .selectExpr(
            f"inline(array(named_struct('value', {ip(SEEN_KEY)}, 'ioc_type', 'ip-dst'), "
            f"named_struct('value', {sha256(SEEN_KEY, 'spark')}, 'ioc_type', 'sha256')))",
            "c_custkey",
        )
        .select(
            "value",
            "ioc_type",
            (now() - F.expr("make_dt_interval(CAST(c_custkey % 45 AS INT))")).alias("first_seen"),
            (now() - F.expr("make_dt_interval(CAST(c_custkey % 45 AS INT))") + F.expr("INTERVAL 30 DAYS")).alias("expires"),
        )
    )


# --- alerts --------------------------------------------------------------------------------------------------

def alert_raw(d: str) -> str:
    """JSON text of the alert that an event stands for."""
    q = lambda *parts: "concat(" + ", ".join(parts) + ")"
    ts = iso("ts", d)
    severity = "CASE WHEN value > 100 THEN 'Critical' WHEN value > 20 THEN 'HIGH' ELSE 'low' END"
    elastic_flat = q(
        "'{\"_id\":\"al-'", "event_id", "'\",\"_source\":{\"source.ip\":\"'", ip("user_id"),
        "'\",\"destination\":{\"ip\":\"'", ip("event_id % 997"), "'\"},\"dns.question.name\":\" '", f"lower({dom('user_id')})",
        "' \",\"url\":{\"full\":\"'", url("user_id"), "'\"},\"host\":{\"ip\":[\"'", ip("user_id + 1"), "'\",\"10.0.0.5\"]},"
        "\"process.hash.sha256\":\"'", sha256("user_id", d), "'\",\"process.pid\":7,\"process.name\":\"p'", "user_id",
        "'.exe\",\"kibana.alert.rule.name\":\"Rule '", "event_type", "'\",\"kibana.alert.severity\":\"'", severity,
        "'\",\"@timestamp\":\"'", ts, "'Z\",\"message\":\"saw '", f"upper({md5('user_id')})", "' from 172.16.0.9 and 300.1.1.1\"}}'",
    )
    elastic_nested = q(
        "'{\"_id\":\"al-'", "event_id", "'\",\"_source\":{\"rule\":{\"name\":\"Buy '", "user_id % 5", "'\"},\"severity\":null,"
        "\"client\":{\"ip\":\"'", ip("user_id"), "'\"},\"url\":{\"domain\":\"'", f"lower({dom('user_id')})",
        "'\"},\"file\":{\"hash\":{\"md5\":\"'", md5("user_id"), "'\"}},\"kibana.alert.start\":\"'", ts, "'+03:00\"}}'",
    )
    sentinel = q(
        "'{\"name\":\"inc-'", "event_id", "'\",\"properties\":{\"title\":\"Incident '", "event_type", "'\",\"severity\":\"'", severity,
        "'\",\"createdTimeUtc\":\"'", ts, "'Z\",\"entities\":[{\"address\":\"'", ip("user_id"), "'\"},{\"domainName\":\"'",
        f"lower({dom('user_id')})", "'\"},{\"fileHashes\":[{\"hashValue\":\"'", sha256("user_id", d), "'\"},\"'", md5("user_id"),
        "'\"]},{\"url\":\"'", url("event_id % 997"), "'\"},{\"sha1\":\"'", sha1("user_id"), "'\"},\"text\"]}}'",
    )
    generic = q(
        "'{\"id\":\"gen-'", "event_id", "'\",\"name\":\"Signup '", "user_id", "'\",\"n\":5,\"a\":\"'", ip("user_id"),
        "'\",\"b\":{\"c\":\"'", f"lower({dom('user_id')})", "'\",\"d\":[{\"e\":\"'", url("user_id"), "'\"},\"'", sha256("user_id", d),
        "'\",[\"in a list of lists\"]],\"f\":{\"g\":{\"h\":{\"i\":{\"j\":\"'", md5("user_id"),
        "'\",\"k\":{\"l\":\"too deep\"}}}}}}}'",
    )
    return (
        f"CASE event_type WHEN 'error' THEN {elastic_flat} WHEN 'purchase' THEN {elastic_nested} "
        f"WHEN 'signup' THEN {generic} ELSE {sentinel} END"
    )


ALERT_SIEM = "CASE event_type WHEN 'error' THEN 'elastic' WHEN 'purchase' THEN 'elastic' WHEN 'signup' THEN 'syslog' ELSE 'sentinel' END"


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{pad('event_id')} AS alert_key", f"{ALERT_SIEM} AS source_siem", f"{alert_raw('spark')} AS raw"
    )


# --- indicator store and reputation --------------------------------------------------------------------------

STORE_FEED = "CASE c_nationkey % 4 WHEN 0 THEN 'otx' WHEN 1 THEN 'threatfox' WHEN 2 THEN 'abusech_url' ELSE 'abusech_malware' END"


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of customers, and of orders (events without a feed title)."""
    entry = lambda t, v: f"named_struct('type', '{t}', 'value', {v})"
    entries = ", ".join(
        [
            entry("comment", ip(STORE_KEY)),
            entry("ip-dst", ip(STORE_KEY)),
            entry("domain", f"lower({dom(STORE_KEY)})"),
            entry("url", url(STORE_KEY)),
            entry("sha256", sha256(STORE_KEY, "spark")),
            entry("md5", md5(STORE_KEY)),
        ]
    )
    own = (
        table(spark, sf_dir, "customer")
        .selectExpr("*", f"posexplode(array({entries})) AS (pos, e)")
        .selectExpr(
            "concat('c', c_custkey, '-', pos) AS attribute_id",
            f"concat('ev-', {STORE_FEED}) AS event_id",
            f"concat({STORE_FEED}, ' — 2024-01-', 10 + c_nationkey) AS event_info",
            "e.type AS type",
            "e.value AS value",
            "concat('Seen with ', c_name) AS comment",
            "true AS to_ids",
            "CASE c_mktsegment WHEN 'BUILDING' THEN array('threat-actor:APT28', 'Emotet') "
            "WHEN 'MACHINERY' THEN array('misp-galaxy:threat-actor=\"Lazarus Group\"', 'captcha') "
            "ELSE array('Threat-Actor:Mixed', 'tlp:red') END AS tags",
            "c_custkey * 10 + pos AS seq",
        )
    )
    orders = (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "concat('o', o_orderkey) AS attribute_id",
            "'ev-manual' AS event_id",
            "'Manual import' AS event_info",
            "'url' AS type",
            f"{url(ORDER_KEY)} AS value",
            "CAST(NULL AS STRING) AS comment",
            "true AS to_ids",
            "array(concat('prio:', o_orderpriority), 'lazarus-group') AS tags",
            "1000000000000 + o_orderkey AS seq",
        )
    )
    return own.unionByName(orders)


def vt_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = (
        "CASE c_custkey % 10 WHEN 0 THEN 404 WHEN 1 THEN 429 ELSE 200 END AS status",
        "CAST(c_custkey % 60 AS INT) AS malicious", "CAST(c_custkey % 7 AS INT) AS suspicious",
        "CAST(c_custkey % 90 AS INT) AS harmless", "CAST(c_custkey % 5 AS INT) AS undetected",
        "CASE WHEN c_nationkey > 5 THEN c_nationkey END AS reputation",
        "CASE WHEN c_acctbal > 0 THEN concat('trojan.', lower(c_mktsegment)) ELSE '' END AS threat_label",
        "array('a', 'b', 'c', 'd', 'e', c_name) AS names",
    )
    return table(spark, sf_dir, "customer").selectExpr(
        f"inline(array(named_struct('ioc_value', {ip('c_custkey')}, 'ioc_type', 'ip-dst'), "
        f"named_struct('ioc_value', {url('c_custkey')}, 'ioc_type', 'url')))",
        "*",
    ).selectExpr("ioc_value", "ioc_type", *cols)


def shodan_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        f"{ip('s_suppkey')} AS ioc_value",
        "CASE WHEN s_acctbal < 500 THEN 404 ELSE 200 END AS status",
        "array(443, 22, CAST(s_suppkey % 100 AS INT), 22) AS ports",
        "CASE s_nationkey % 3 WHEN 0 THEN array('CVE-2024-2', 'CVE-2024-1') WHEN 1 THEN array('CVE-2023-9') END AS vulns",
        "array(concat('h', s_suppkey)) AS hostnames",
        "CASE WHEN s_nationkey > 12 THEN s_name ELSE '' END AS org",
        "'isp-x' AS isp",
        "CASE WHEN s_nationkey < 20 THEN concat('Nation ', s_nationkey) END AS country_name",
        "CAST(NULL AS STRING) AS os",
        "CASE WHEN s_nationkey % 4 = 0 THEN array('malware') ELSE array('cloud') END AS tags",
    )


