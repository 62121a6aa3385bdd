"""Every query by name: the Spark plan, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iocweave.functions import base, feedmap, ip, norm
from iocweave.operators import dedup, enrich, external, extract, match, metrics, outbox, score, seen, store
from iocweave.plans import enrichment, ingest
from iocweave.session import bound_tasks, tune, work_dir
from iocweave.sources import alerts as A
from iocweave.sources import feeds
from workloads import derive as D
from workloads import sqlbase as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = S.NOW


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(bound_tasks(tune(spark)), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def csv(items: str | Column) -> Column:
    return F.array_join(items, ",")


# --- feeds ---------------------------------------------------------------------------------------------------

FEED_SELECT = (
    f"SELECT value, ioc_type, source_feed, threat_level, {S.joined('tags')} AS tags, description, first_seen, last_seen, confidence, "
    f"pulse_id, {S.joined('attack_techniques')} AS attack_techniques, fetch_id, emit_rank"
)


def feed_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "value", "ioc_type", "source_feed", "threat_level", csv("tags").alias("tags"), "description", "first_seen",
        "last_seen", "confidence", "pulse_id", csv("attack_techniques").alias("attack_techniques"),
        F.col("ord.fetch_id").alias("fetch_id"), F.col("ord.emit_rank").alias("emit_rank"),
    )


def _feed(name: str) -> Query:
    return lambda spark, d: feed_columns(D.feed_rows(spark, d)[name])


query("feed_otx_flatten", S.with_(S.OTX, f"{FEED_SELECT} FROM otx").replace("SELECT value,", "SELECT trim(value) AS value,"))(_feed("otx"))
query("feed_malware_flatten", S.with_(S.MALWARE, f"{FEED_SELECT} FROM malware"))(_feed("abusech_malware"))
query("feed_url_flatten", S.with_(S.URLS, f"{FEED_SELECT} FROM urls"))(_feed("abusech_url"))
query("feed_threatfox_flatten", S.with_(S.THREATFOX, f"{FEED_SELECT} FROM threatfox"))(_feed("threatfox"))


@query(
    "feed_union",
    S.with_(
        S.IOCS,
        "SELECT source_feed, ioc_type, CAST(sub_rank AS INTEGER) AS subfeed_rank, count(*) AS n, count(DISTINCT value) AS n_values, "
        "min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM iocs GROUP BY ALL",
    ),
)
def feed_union(spark, d):
    rows = D.feed_rows(spark, d)
    missing = {"csv": None}
    union = feeds.union_feeds([*rows.values(), *missing.values()], spark)
    return union.groupBy("source_feed", "ioc_type", F.col("ord.subfeed_rank").alias("subfeed_rank")).agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


CSV_INPUT = {
    "fetch_id": D.pad("p_partkey"),
    "value": f"CASE WHEN p_size > 40 THEN ' ' ELSE concat(' ', {D.ip('p_partkey')}) END",
    "type": "CASE WHEN p_type = 'ECONOMY' THEN 'IP ' WHEN p_type = 'PROMO' THEN 'cidr' ELSE 'Domain' END",
    "threat_level": "CASE WHEN p_size < 10 THEN 'HIGH' WHEN p_size < 20 THEN 'medium' ELSE p_brand END",
    "description": "p_name",
    "tags": "concat(p_brand, ', ', p_type, ',,')",
}


@query(
    "feed_csv",
    f"""SELECT trim({CSV_INPUT['value']}) AS value,
  CASE WHEN p_type = 'ECONOMY' THEN 'ip-dst' ELSE 'domain' END AS ioc_type,
  CASE WHEN p_size < 10 THEN 'high' WHEN p_size < 20 THEN 'medium' ELSE 'unknown' END AS threat_level,
  concat(p_brand, ',', p_type) AS tags, p_name AS description, {NOW} AS first_seen, CAST(70 AS INTEGER) AS confidence,
  concat('csv:', trim({CSV_INPUT['value']})) AS pulse_id
FROM part WHERE p_size <= 40 AND p_type <> 'PROMO'""",
)
def feed_csv(spark, d):
    rows = D.table(spark, d, "part").selectExpr(*[f"{e} AS {n}" for n, e in CSV_INPUT.items()])
    return feeds.flatten_csv(rows, D.now()).select(
        "value", "ioc_type", "threat_level", csv("tags").alias("tags"), "description", "first_seen", "confidence", "pulse_id"
    )


@query("feed_lookback", f"SELECT event_id, ts, event_type FROM events WHERE ts >= {NOW} - INTERVAL 7 DAY")
def feed_lookback(spark, d):
    return feeds.modified_since(D.table(spark, d, "events"), "ts", D.now(), 7).select("event_id", "ts", "event_type")


# --- alert scans ---------------------------------------------------------------------------------------------

def parsed(spark, d) -> DataFrame:
    return A.alert_header(A.parse_alerts(D.raw_alerts(spark, d)), D.now())


def candidates(spark, d) -> DataFrame:
    return A.extract_candidates(A.parse_alerts(D.raw_alerts(spark, d)))


HEADER = ["alert_key", "source_siem", "alert_id", "alert_name", "severity", "triggered_at"]
HEADER_SQL = ", ".join(HEADER)


def _scan(siem: str) -> tuple[str, Query]:
    sql = S.with_(
        S.ALERTS,
        f"SELECT {HEADER_SQL} FROM header WHERE source_siem = '{siem}' AND triggered_at >= {NOW} - INTERVAL 10 DAY "
        "ORDER BY triggered_at DESC, alert_key LIMIT 50",
    )
    since = lambda: D.now() - F.expr("INTERVAL 10 DAYS")
    return sql, lambda spark, d: A.latest_alerts(parsed(spark, d), siem, since()).select(*HEADER)


for _name, _siem in (("alerts_elastic_scan", "elastic"), ("alerts_sentinel_scan", "sentinel")):
    _sql, _fn = _scan(_siem)
    query(_name, _sql)(_fn)


@query(
    "alerts_sentinel_entities",
    S.with_(
        S.ALERTS,
        f"""SELECT DISTINCT h.alert_key, p.value FROM header h LEFT JOIN (
  SELECT alert_key, value FROM (SELECT alert_key, unnest([{D.ip('user_id')}, lower({D.dom('user_id')}), {D.md5('user_id')}]) AS value FROM alerts
    ) WHERE {S.valid('value')}) p ON p.alert_key = h.alert_key WHERE h.source_siem = 'sentinel'""",
    ),
)
def alerts_sentinel_entities(spark, d):
    incidents = D.raw_alerts(spark, d).filter("source_siem = 'sentinel'").select("alert_key")
    entities = (
        D.table(spark, d, "events")
        .selectExpr(
            f"{D.pad('event_id')} AS alert_key",
            f"explode(array(concat('{{\"address\":\"', {D.ip('user_id')}, '\"}}'), concat('{{\"domainName\":\"', lower({D.dom('user_id')}), '\"}}'), "
            f"concat('{{\"fileHashes\":[{{\"hashValue\":\"', {D.md5('user_id')}, '\"}}]}}'))) AS text",
        )
        .select("alert_key", F.parse_json("text").alias("entity"))
    )
    return extract.entity_candidates(incidents, entities)


# --- store and outbox tables ---------------------------------------------------------------------------------

def run(spark, d) -> dict[str, DataFrame]:
    return ingest.run_feeds(D.all_iocs(spark, d), D.seen_table(spark, d), D.now())


RUN_TITLE = "source_feed || ' — 2024-01-31'"


@query(
    "store_attributes",
    S.with_(
        S.FLAGGED,
        f"""SELECT sha256({RUN_TITLE}) AS event_id, {RUN_TITLE} AS event_info, ioc_type AS type, value, left(description, 255) AS comment,
  TRUE AS to_ids, {S.joined('tags')} AS tags FROM flagged WHERE is_new""",
    ),
)
def store_attributes(spark, d):
    return run(spark, d)["attributes"].select(
        "event_id", "event_info", "type", "value", "comment", "to_ids", csv("tags").alias("tags")
    )


@query("store_batch_by_feed", S.with_(S.FLAGGED, "SELECT source_feed, count(*) AS stored FROM flagged WHERE is_new GROUP BY ALL"))
def store_batch_by_feed(spark, d):
    return store.batch_by_feed(run(spark, d)["new_iocs"])


@query(
    "store_event_tags",
    S.with_(
        S.FLAGGED,
        f"SELECT DISTINCT {RUN_TITLE} AS event_info, tag FROM (SELECT source_feed, unnest(tags[1:10]) AS tag FROM flagged WHERE is_new)",
    ),
)
def store_event_tags(spark, d):
    return run(spark, d)["event_tags"].select("event_info", "tag")


@query(
    "store_events",
    S.with_(
        S.FLAGGED,
        f"""SELECT sha256({RUN_TITLE}) AS event_id, {RUN_TITLE} AS title,
  CASE arg_min(threat_level, (feed_rank, sub_rank, fetch_id, pos, emit_rank)) WHEN 'high' THEN '1' WHEN 'medium' THEN '2' WHEN 'low' THEN '3' ELSE '4' END AS threat_level_id,
  source_feed, count(*) AS attribute_count FROM flagged WHERE is_new AND source_feed <> 'threatfox' GROUP BY source_feed""",
    ),
)
def store_events(spark, d):
    """The new rows are computed once and written: both tables of events are made of them."""
    root = work_dir(spark, "new-iocs")
    run(spark, d)["new_iocs"].select("source_feed", "threat_level", "ord").write.parquet(root)
    new = spark.read.parquet(root)
    day = D.now().cast("date")
    # The event of one feed exists already.
    existing = store.store_events(new.filter("source_feed = 'threatfox'"), day)
    return store.store_events(new, day, existing).select("event_id", "title", "threat_level_id", "source_feed", "attribute_count")


def results(spark, d) -> DataFrame:
    return external.landed_results({"virustotal": D.vt_answers(spark, d), "shodan": D.shodan_answers(spark, d)})


def enriched(spark, d, **options) -> DataFrame:
    return enrich.enriched_alerts(
        enrichment.prepare(D.raw_alerts(spark, d), D.now()), D.attributes(spark, d), D.now(), results(spark, d), **options
    )


def enriched_whole(spark, d) -> DataFrame:
    """``enriched`` for callers that read the whole header: alerts are written once, so that it moves only to its alert."""
    stage = work_dir(spark, "prepared")
    enrichment.prepare(D.raw_alerts(spark, d), D.now()).write.parquet(stage)
    return enrich.enriched_alerts(spark.read.parquet(stage), D.attributes(spark, d), D.now(), results(spark, d), at_hand=True)


def tagged(spark, d) -> DataFrame:
    """Enriched alerts for their tags: the texts of attributes, results and headers, of which no tag is made, stay behind."""
    none = F.lit(None).cast("string")
    return enrich.enriched_alerts(
        enrichment.prepare(D.raw_alerts(spark, d), D.now()), match.slim(D.attributes(spark, d), "tags"), D.now(),
        results(spark, d).withColumns({"summary": none, "link": none}),
        header=("alert_id", "source_siem", "severity", "triggered_at"),
    )


# Per-alert aggregates in SQL.
EXT = f"""{S.MATCHED},{S.RESULTS},{S.ALERTS.split('header AS')[0].strip().rstrip(',').replace('alerts AS', 'alerts2 AS')},
ext AS (SELECT m.alert_key, m.value, m.threat_score, r.*, CASE r.source WHEN 'virustotal' THEN 0 ELSE 1 END AS prank
  FROM matched m JOIN results r ON r.ioc_value = m.value AND r.ioc_type = m.ioc_type),
mtags AS (SELECT alert_key, threat_score, value, unnest(tags) AS tag, unnest(range(len(tags))) AS tpos FROM matched),
actors AS (SELECT alert_key, list(name ORDER BY r) AS names FROM (SELECT alert_key, name, min(rnk) AS r FROM (
    SELECT alert_key, trim(replace(tag, 'threat-actor:', '')) AS name, (-threat_score, value, tpos) AS rnk FROM mtags WHERE contains(lower(tag), 'threat-actor:'))
    GROUP BY ALL) GROUP BY alert_key),
campaigns AS (SELECT alert_key, list(name ORDER BY r) AS names FROM (SELECT alert_key, name, min(rnk) AS r FROM (
    SELECT alert_key, trim(split_part(tag, '=', -1), '"') AS name, (-threat_score, value, tpos) AS rnk FROM mtags
    WHERE NOT contains(lower(tag), 'threat-actor:') AND contains(lower(tag), 'misp-galaxy:threat-actor')) GROUP BY ALL) GROUP BY alert_key),
tag_actor AS (SELECT alert_key, list_sort(list(DISTINCT 'tip:actor:' || name)) AS names FROM (SELECT alert_key,
    CASE WHEN starts_with(lower(tag), 'threat-actor:') THEN trim(replace(tag, 'threat-actor:', '')) ELSE trim(tag) END AS name FROM mtags
    WHERE starts_with(lower(tag), 'threat-actor:') OR regexp_matches(lower(tag), 'apt|lazarus|carbanak|fin7|ta505')) GROUP BY alert_key),
per_alert AS (SELECT alert_key, count(*) AS n_matched, max(threat_score) AS best, string_agg(value, ',' ORDER BY threat_score DESC, value) AS matched_values,
    list_sort(list(DISTINCT 'tip:feed:' || source_feed)) AS feeds, list_sort(list(DISTINCT 'tip:ioc-type:' || ioc_type)) AS kinds
  FROM matched GROUP BY alert_key),
per_ext AS (SELECT alert_key, max(coalesce(malicious_score, 0)) AS worst, bool_or(coalesce(malicious_score, 0) >= 50) AS malicious, count(*) AS n_external,
    list('tip:' || source || CASE WHEN coalesce(malicious_score, 0) >= 50 THEN ':malicious' ELSE ':seen' END ORDER BY -threat_score, value, prank) FILTER (found) AS tags,
    string_agg(source || '=' || coalesce(CAST(malicious_score AS VARCHAR), ''), ',' ORDER BY -threat_score, value, prank) AS ext_list
  FROM ext GROUP BY alert_key),
extracted AS (SELECT alert_key, string_agg(value, ',' ORDER BY value) AS vals, count(*) AS n_extracted FROM cand GROUP BY alert_key),
enriched AS (SELECT h.alert_key, h.alert_id, h.source_siem, h.alert_name, h.severity, h.triggered_at,
    coalesce(x.vals, '') AS extracted_iocs, CAST(coalesce(x.n_extracted, 0) AS INTEGER) AS n_extracted,
    CAST(coalesce(p.n_matched, 0) AS INTEGER) AS n_matched, coalesce(p.matched_values, '') AS matched_iocs,
    {S.joined('a.names')} AS threat_actors, {S.joined('c.names')} AS campaigns,
    CASE WHEN p.alert_key IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_concat(list_concat(list_concat(['tip:matched'], p.feeds), coalesce(t.names, [])), p.kinds) END AS own_tags,
    coalesce(e.tags, []) AS ext_tags, coalesce(e.ext_list, '') AS external,
    greatest(coalesce(p.best, 0.0::DOUBLE), coalesce(e.worst, 0)::DOUBLE) AS risk_score,
    (p.alert_key IS NOT NULL OR coalesce(e.malicious, FALSE)) AND h.severity IN ('high', 'critical') AS gate_enricher,
    p.alert_key IS NOT NULL AND h.severity IN ('high', 'critical') AS gate_notifier
  FROM header h LEFT JOIN per_alert p ON p.alert_key = h.alert_key LEFT JOIN per_ext e ON e.alert_key = h.alert_key
  LEFT JOIN actors a ON a.alert_key = h.alert_key LEFT JOIN campaigns c ON c.alert_key = h.alert_key
  LEFT JOIN tag_actor t ON t.alert_key = h.alert_key LEFT JOIN extracted x ON x.alert_key = h.alert_key)"""
EXT = EXT.replace(f",{S.ALERTS.split('header AS')[0].strip().rstrip(',').replace('alerts AS', 'alerts2 AS')}", "")
ALL_TAGS = "list_concat(own_tags, ext_tags)"


@query(
    "tag_writeback_elastic",
    S.with_(EXT, f"SELECT alert_id, {S.joined(ALL_TAGS)} AS tags, TRUE AS enriched, '2024-01-31T00:00:00.000000' AS enriched_at "
            f"FROM enriched WHERE source_siem = 'elastic' AND len({ALL_TAGS}) > 0"),
)
def tag_writeback_elastic(spark, d):
    rows = outbox.tag_writeback(tagged(spark, d), D.now()).filter("source_siem = 'elastic'")
    get = lambda p, t: F.variant_get(F.parse_json("document"), p, t)
    return rows.select(
        "alert_id", csv(get('$.doc["tip.tags"]', "array<string>")).alias("tags"),
        get('$.doc["tip.enriched"]', "boolean").alias("enriched"), get('$.doc["tip.enriched_at"]', "string").alias("enriched_at"),
    )


@query(
    "tag_writeback_sentinel",
    S.with_(EXT, f"SELECT alert_id, {S.joined(ALL_TAGS)} AS labels FROM enriched WHERE source_siem = 'sentinel' AND len({ALL_TAGS}) > 0"),
)
def tag_writeback_sentinel(spark, d):
    rows = outbox.tag_writeback(tagged(spark, d), D.now()).filter("source_siem = 'sentinel'")
    labels = F.variant_get(F.parse_json("document"), "$.properties.labels", "array<struct<labelName:string>>")
    return rows.select("alert_id", csv(F.transform(labels, lambda x: x["labelName"])).alias("labels"))


@query(
    "tag_writeback_route",
    S.with_(EXT, f"SELECT CASE WHEN len({ALL_TAGS}) = 0 OR alert_id = '' THEN 'skipped' WHEN source_siem IN ('elastic', 'sentinel') THEN source_siem "
            "ELSE 'rejected' END AS route, source_siem, count(*) AS n FROM enriched GROUP BY ALL"),
)
def tag_writeback_route(spark, d):
    return outbox.tag_route(enriched(spark, d)).groupBy("route", "source_siem").agg(F.count("*").alias("n"))


@query(
    "notify_outbox",
    S.with_(EXT, f"""SELECT alert_id, '🚨 TIP Alert: ' || alert_name || ' [' || upper(severity) || '] — ' || n_matched || ' IOC matches' AS text,
  '🚨 ALERT: ' || left(alert_name, 150) AS header,
  '*🎯 Risk Score:* `' || repeat('█', CAST(floor(risk_score / 10) AS INTEGER)) || repeat('░', 10 - CAST(floor(risk_score / 10) AS INTEGER)) || '` '
    || CAST(CAST(round_even(risk_score, 0) AS INTEGER) AS VARCHAR) || '/100' AS risk,
  '*🏷️ Tags Written to SIEM:*' || chr(10) || array_to_string(list_transform(({ALL_TAGS})[1:8], lambda t: '`' || t || '`'), ' ') AS tags,
  '*🕵️ Threat Actors:*' || chr(10) || CASE WHEN threat_actors = '' THEN 'Unknown' ELSE replace(threat_actors, ',', ', ') END AS actors,
  '🤖 indicator analytics | Enriched at 2024-01-31 00:00 UTC | ' || n_extracted || ' IOCs extracted, ' || n_matched || ' matched' AS footer,
  CAST(least(n_matched, 5) + CASE WHEN n_matched > 5 THEN 1 ELSE 0 END AS INTEGER) AS n_lines
FROM enriched WHERE gate_enricher AND gate_notifier"""),
)
def notify_outbox(spark, d):
    sent = outbox.notify_outbox(enriched_whole(spark, d), D.now()).withColumn("v", F.parse_json("payload"))
    blocks = F.variant_get(
        "v", F.lit("$.blocks"),
        "array<struct<type:string,text:struct<type:string,text:string>,fields:array<struct<text:string>>,elements:array<struct<text:string>>>>",
    )
    sent = sent.select("alert_id", "text", blocks.alias("b"))
    pick = lambda start: F.get(F.filter(F.transform("b", lambda x: x["text"]["text"]), lambda t: t.startswith(start)), F.lit(0))
    return sent.select(
        "alert_id", "text", pick("🚨").alias("header"), pick("*🎯 Risk").alias("risk"), pick("*🏷️").alias("tags"),
        F.get(F.col("b")[4]["fields"], F.lit(0))["text"].alias("actors"),
        F.get(F.element_at("b", -1)["elements"], F.lit(0))["text"].alias("footer"),
        (F.size(F.split(pick("*🎯 IOC"), "\n")) - 1).alias("n_lines"),
    )


# Feed runs: one run per feed and order day.
RUNS = """
runs AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'otx' ELSE 'abusech' END AS feed_name,
    o_orderdate AS started_at, o_orderdate + to_seconds(90 + count(*)) AS finished_at, count(*) AS total_fetched,
    count(*) FILTER (o_orderstatus <> 'O') AS new_iocs, count(*) FILTER (o_orderstatus = 'O') AS duplicate_iocs,
    count(*) FILTER (o_orderstatus = 'F') AS stored, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') AS errors
  FROM orders GROUP BY 1, 2),
rated AS (SELECT *, datediff('microsecond', started_at, finished_at)::DOUBLE / 1000000.0::DOUBLE AS duration_seconds,
    CASE WHEN new_iocs = 0 THEN 0.0::DOUBLE ELSE CAST(printf('%.1f', stored::DOUBLE / new_iocs::DOUBLE * 100.0::DOUBLE) AS DOUBLE) END AS success_rate FROM runs)"""


def feed_runs(spark, d) -> DataFrame:
    """Run history: one run per feed and day, counted from the orders of that day."""
    orders = D.table(spark, d, "orders")
    feed = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "otx").otherwise("abusech")
    bad = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return (
        orders.groupBy(feed.alias("feed_name"), F.col("o_orderdate").alias("started_at"))
        .agg(
            F.count("*").alias("total_fetched"),
            F.count_if(F.col("o_orderstatus") != "O").alias("new_iocs"),
            F.count_if(F.col("o_orderstatus") == "O").alias("duplicate_iocs"),
            F.count_if(F.col("o_orderstatus") == "F").alias("stored"),
            F.count_if(bad).alias("errors"),
        )
        .withColumn("finished_at", F.expr("started_at + make_dt_interval(0, 0, 0, 90 + total_fetched)"))
        .withColumn("error_details", F.expr("transform(sequence(1, greatest(1, CAST(errors AS INT))), i -> concat('failed ', i))"))
    )


RUN_COLUMNS = ["feed_name", "started_at", "finished_at", "total_fetched", "new_iocs", "duplicate_iocs", "stored", "errors"]


@query(
    "notify_feed_outbox",
    S.with_(RUNS, """SELECT feed_name, started_at, '📥 Feed: ' || feed_name || ' — ' || new_iocs || ' new IOCs, ' || errors || ' errors' AS text,
  CASE WHEN errors > 0 THEN '⚠️' ELSE '✅' END || ' *Feed Ingestion Complete: ' || feed_name || '*' || chr(10) || 'New IOCs: *' || new_iocs
  || '* | Dupes skipped: ' || duplicate_iocs || ' | Stored in MISP: ' || stored || chr(10) || 'Duration: ' || printf('%.1f', duration_seconds)
  || 's | Success rate: ' || printf('%.1f', success_rate) || '%' || CASE WHEN errors > 0 THEN chr(10) || '⚠️ *Errors: ' || errors || '*' || chr(10)
  || array_to_string(list_transform(range(1, least(errors, 3) + 1), lambda i: '  • failed ' || i), chr(10)) ELSE '' END AS body
FROM rated WHERE errors > 0 OR new_iocs >= 100"""),
)
def notify_feed_outbox(spark, d):
    return outbox.feed_message(metrics.feed_run_rates(feed_runs(spark, d))).select("feed_name", "started_at", "text", "body")


# --- scalar functions ----------------------------------------------------------------------------------------

@query("norm_dispatch", S.with_(S.IOCS, f"SELECT source_feed, ioc_type, fetch_id, emit_rank, value, {S.normalise('value', 'ioc_type')} AS normalised "
                                "FROM (SELECT * REPLACE (trim(value) AS value) FROM iocs)"))
def norm_dispatch(spark, d):
    return D.all_iocs(spark, d).select(
        "source_feed", "ioc_type", F.col("ord.fetch_id").alias("fetch_id"), F.col("ord.emit_rank").alias("emit_rank"), "value",
        norm.normalise(F.col("value"), F.col("ioc_type")).alias("normalised"),
    )


QUADS = (
    "concat_ws('.', CASE l_linenumber WHEN 1 THEN 192 WHEN 2 THEN 172 WHEN 3 THEN 169 ELSE l_orderkey % 256 END, "
    "CASE l_linenumber WHEN 1 THEN CASE WHEN l_quantity > 25 THEN 168 ELSE 0 END WHEN 3 THEN 254 ELSE l_partkey % 300 END, "
    "l_suppkey % 256, l_orderkey % 64)"
)


def quads(spark, d) -> DataFrame:
    return D.table(spark, d, "lineitem").selectExpr(f"{QUADS} AS value").distinct()


QUADS_SQL = f"(SELECT DISTINCT {QUADS} AS value FROM lineitem)"


@query("norm_ip", f"SELECT value, {S.norm_ip('value')} AS normalised FROM {QUADS_SQL}")
def norm_ip(spark, d):
    return quads(spark, d).withColumn("normalised", ip.normalise_ip(F.col("value")))


@query("is_private_ip", f"SELECT value, coalesce({S.refused('value')}, FALSE) AS private FROM {QUADS_SQL}")
def is_private_ip(spark, d):
    return quads(spark, d).withColumn("private", ip.is_private_ip(F.col("value")))


@query("valid_candidate", f"SELECT value, {S.valid('value')} AS valid FROM {QUADS_SQL}")
def valid_candidate(spark, d):
    return quads(spark, d).withColumn("valid", ip.valid_candidate(F.col("value")))


DOMAINS = f"[{D.dom('c_custkey')}, concat('www.', c_mktsegment, '.', c_nationkey, '.com..'), lower(c_mktsegment), concat(c_name, '.LOCAL'), concat('www.a', c_nationkey), 'www.example.com']"


@query("norm_domain", f"SELECT DISTINCT value, {S.norm_domain('value')} AS normalised FROM (SELECT unnest({DOMAINS}) AS value FROM customer UNION ALL SELECT {S.HOST} FROM pages)")
def norm_domain(spark, d):
    named = D.table(spark, d, "customer").selectExpr(f"explode(array({DOMAINS[1:-1]})) AS value")
    hosts = D.table(spark, d, "pages").select(norm.url_hostname(F.col("url")).alias("value"))
    return named.unionByName(hosts).distinct().withColumn("normalised", norm.norm_domain(F.col("value")))


URL_FORMS = "[url, replace(url, 'http', 'ftp'), upper(url), concat('http:///', page_id), concat('https://u@', url), 'http://']"


@query("norm_url", f"SELECT page_id, value, {S.norm_url('value')} AS normalised FROM (SELECT page_id, unnest({URL_FORMS}) AS value FROM pages)")
def norm_url(spark, d):
    forms = D.table(spark, d, "pages").selectExpr("page_id", f"explode(array({URL_FORMS[1:-1]})) AS value")
    return forms.withColumn("normalised", norm.norm_url(F.col("value")))


HASH_FORMS = [
    ("md5", f"upper({D.md5('c_custkey')})"), ("md5", f"substr({D.md5('c_custkey')}, 2)"), ("md5", f"concat('z', substr({D.md5('c_custkey')}, 2))"),
    ("sha1", D.sha1("c_custkey")), ("sha1", D.md5("c_custkey")), ("md5", "md5('')"), ("sha1", "upper(sha1(''))"),
]


@query(
    "norm_hash",
    "SELECT c_custkey, kind, value, CASE kind WHEN 'md5' THEN " + S.norm_hash("value", "32") + " ELSE " + S.norm_hash("value", "40")
    + " END AS normalised FROM (SELECT c_custkey, f.kind AS kind, f.value AS value FROM (SELECT c_custkey, unnest(["
    + ", ".join(f"{{'kind': '{k}', 'value': {v}}}" for k, v in HASH_FORMS) + "]) AS f FROM customer))",
)
def norm_hash(spark, d):
    forms = ", ".join(f"named_struct('kind', '{k}', 'value', {v})" for k, v in HASH_FORMS)
    rows = D.table(spark, d, "customer").selectExpr("c_custkey", f"inline(array({forms}))")
    return rows.withColumn("normalised", norm.norm_hash(F.col("value"), F.col("kind")))


EMAILS = "[concat(c_name, '@Mail.', lower(c_mktsegment), '.com'), c_name, 'a@b.c', concat('x@', c_nationkey)]"


@query("norm_email", f"SELECT c_custkey, value, {S.norm_email('value')} AS normalised FROM (SELECT c_custkey, unnest({EMAILS}) AS value FROM customer)")
def norm_email(spark, d):
    rows = D.table(spark, d, "customer").selectExpr("c_custkey", f"explode(array({EMAILS[1:-1]})) AS value")
    return rows.withColumn("normalised", norm.norm_email(F.col("value")))


NAMES = "[p_name, concat('  ', p_name, '.EXE '), concat(' ', p_size % 10, ' ')]"


@query("norm_filename", f"SELECT p_partkey, value, CASE WHEN length(trim(value)) >= 2 THEN value END AS normalised FROM (SELECT p_partkey, unnest({NAMES}) AS value FROM part)")
def norm_filename(spark, d):
    rows = D.table(spark, d, "part").selectExpr("p_partkey", f"explode(array({NAMES[1:-1]})) AS value")
    value = F.col("value")
    return rows.withColumn("normalised", norm.norm_filename(base.strip(value), value))


@query(
    "map_threatfox_type",
    f"""SELECT raw_type, ioc, CASE raw_type WHEN 'ip:port' THEN 'ip-dst' WHEN 'md5_hash' THEN 'md5' WHEN 'sha256_hash' THEN 'sha256' WHEN 'sha1_hash' THEN NULL ELSE raw_type END AS ioc_type,
  CASE raw_type WHEN 'ip:port' THEN split_part(ioc, ':', 1) WHEN 'md5_hash' THEN lower(ioc) WHEN 'sha256_hash' THEN lower(ioc) ELSE ioc END AS value
FROM (SELECT DISTINCT {S._TF['ioc_type']} AS raw_type, {S._TF['ioc']} AS ioc FROM lineitem)""",
)
def map_threatfox_type(spark, d):
    f = D.threatfox_fields("spark")
    rows = D.table(spark, d, "lineitem").selectExpr(f"{f['ioc_type']} AS raw_type", f"{f['ioc']} AS ioc").distinct()
    t = F.col("raw_type")
    return rows.withColumns({"ioc_type": feedmap.map_threatfox_type(t), "value": feedmap.map_threatfox_value(t, F.col("ioc"))})


OTX_KINDS = ["IPv4", "IPv6", "domain", "hostname", "URL", "FileHash-MD5", "FileHash-SHA256", "FileHash-SHA1", "email", "CIDR", "Mutex"]
OTX_KIND = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(OTX_KINDS)) + " END"


@query(
    "map_otx_type",
    f"""SELECT raw_type, CASE raw_type WHEN 'IPv4' THEN 'ip-dst' WHEN 'IPv6' THEN 'ip-dst' WHEN 'hostname' THEN 'domain' WHEN 'domain' THEN 'domain' WHEN 'URL' THEN 'url'
  WHEN 'FileHash-MD5' THEN 'md5' WHEN 'FileHash-SHA256' THEN 'sha256' WHEN 'FileHash-SHA1' THEN 'sha1' WHEN 'email' THEN 'email-src' END AS ioc_type, count(*) AS n
FROM (SELECT {OTX_KIND} AS raw_type FROM events) GROUP BY ALL""",
)
def map_otx_type(spark, d):
    rows = D.table(spark, d, "events").selectExpr(f"{OTX_KIND} AS raw_type")
    return rows.withColumn("ioc_type", feedmap.map_otx_type(F.col("raw_type"))).groupBy("raw_type", "ioc_type").agg(F.count("*").alias("n"))


@query(
    "map_tlp_level",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'view' THEN 'unknown' ELSE 'low' END AS threat_level FROM events""",
)
def map_tlp_level(spark, d):
    tlp = F.expr(D.otx_fields("spark")["TLP"])
    return D.table(spark, d, "events").select("event_id", feedmap.map_tlp_level(tlp).alias("threat_level"))


@query(
    "otx_confidence",
    """SELECT event_id, CAST(CASE event_type WHEN 'error' THEN least(100, CAST(props->>'$.k' AS INTEGER) * 3) WHEN 'view' THEN 50 WHEN 'signup' THEN 70 WHEN 'click' THEN 0 ELSE 50 END AS INTEGER) AS confidence FROM events""",
)
def otx_confidence(spark, d):
    source = F.expr(
        "CASE event_type WHEN 'error' THEN parse_json(concat('{\"indicator_count\":', 3 * CAST(get_json_object(props, '$.k') AS INT), '}')) "
        "WHEN 'view' THEN parse_json(props) WHEN 'signup' THEN parse_json('\"feed\"') WHEN 'click' THEN parse_json('{\"indicator_count\":-4}') END"
    )
    return D.table(spark, d, "events").select("event_id", feedmap.otx_confidence(source).alias("confidence"))


TIME_FORM = {
    "spark": "CASE event_type WHEN 'error' THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 'view' THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") "
    "WHEN 'click' THEN date_format(ts, 'yyyy-MM-dd') WHEN 'signup' THEN concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' UTC') ELSE '' END",
}


@query(
    "parse_feed_datetime",
    f"""SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN date_trunc('second', ts) WHEN event_type = 'click' THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
  ELSE {NOW} END AS parsed FROM events""",
)
def parse_feed_datetime(spark, d):
    return D.table(spark, d, "events").select("event_id", feedmap.parse_feed_datetime(F.expr(TIME_FORM["spark"]), D.now()).alias("parsed"))


@query(
    "parse_iso_drop_tz",
    "SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'click') THEN date_trunc('second', ts) WHEN event_type = 'signup' THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS parsed FROM events",
)
def parse_iso_drop_tz(spark, d):
    text = F.expr(
        "CASE event_type WHEN 'error' THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 'view' THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+05:30'\") "
        "WHEN 'click' THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 'signup' THEN date_format(ts, 'yyyy-MM-dd') ELSE date_format(ts, 'dd/MM/yyyy') END"
    )
    return D.table(spark, d, "events").select("event_id", feedmap.parse_iso_drop_tz(text).alias("parsed"))


HOST_FORMS = "[url, concat('https://user:pw@', replace(url, '://', '.'), ':8443/x'), upper(url), 'http://localhost/a', replace(url, '://', '')]"


@query(
    "host_from_url",
    f"""SELECT page_id, url, CASE WHEN contains(host, '.') THEN host END AS host FROM (SELECT page_id, url,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#]*@)?([^/?#:@]*)', 1)) AS host FROM (SELECT page_id, unnest({HOST_FORMS}) AS url FROM pages))""",
)
def host_from_url(spark, d):
    rows = D.table(spark, d, "pages").selectExpr("page_id", f"explode(array({HOST_FORMS[1:-1]})) AS url")
    return rows.withColumn("host", norm.host_from_url(F.col("url")))


@query("classify_host", f"SELECT value, CASE WHEN {S.is_ipv4('value')} THEN 'ip-dst' ELSE 'domain' END AS kind FROM (SELECT * FROM {QUADS_SQL} UNION SELECT {S.HOST} FROM pages)")
def classify_host(spark, d):
    hosts = D.table(spark, d, "pages").select(norm.url_hostname(F.col("url")).alias("value"))
    return quads(spark, d).union(hosts).distinct().withColumn("kind", norm.classify_host(F.col("value")))


@query(
    "infer_ioc_type",
    S.with_(
        S.IOCS,
        f"""SELECT value, CASE WHEN {S.is_ipv4('value')} THEN 'ip-dst' WHEN regexp_full_match(value, '[0-9a-fA-F]{{64}}') THEN 'sha256'
  WHEN regexp_full_match(value, '[0-9a-fA-F]{{32}}') THEN 'md5' WHEN regexp_matches(value, '^https?://') THEN 'url'
  WHEN contains(value, '.') AND NOT contains(value, ' ') THEN 'domain' END AS ioc_type
FROM (SELECT trim(value) AS value FROM iocs UNION SELECT c_name || ' ' || c_mktsegment FROM customer UNION SELECT {D.sha1('c_custkey')} FROM customer)""",
    ),
)
def infer_ioc_type(spark, d):
    c = D.table(spark, d, "customer")
    extra = c.selectExpr("explode(array(concat(c_name, ' ', c_mktsegment), " + D.sha1("c_custkey") + ")) AS value")
    rows = D.all_iocs(spark, d).select("value").union(extra).distinct()
    return rows.withColumn("ioc_type", norm.infer_ioc_type(F.col("value")))


@query("alert_header", S.with_(S.ALERTS, f"SELECT {HEADER_SQL} FROM header"))
def alert_header(spark, d):
    return parsed(spark, d).select(*HEADER)


@query("vt_object_id", "SELECT page_id, url, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS url_id, url AS other_id FROM pages")
def vt_object_id(spark, d):
    u = F.col("url")
    return D.table(spark, d, "pages").select(
        "page_id", "url", external.vt_object_id(u, F.lit("url")).alias("url_id"), external.vt_object_id(u, F.lit("domain")).alias("other_id")
    )


@query(
    "ioc_flags",
    S.with_(S.IOCS, f"SELECT source_feed, fetch_id, emit_rank, ioc_type, confidence >= 75 AS is_high_confidence, "
            f"CAST(floor(datediff('microsecond', first_seen, {NOW})::DOUBLE / 1000000.0::DOUBLE / 86400.0::DOUBLE) AS INTEGER) AS age_days FROM iocs"),
)
def ioc_flags(spark, d):
    flagged = score.ioc_flags(D.all_iocs(spark, d), D.now())
    return flagged.select("source_feed", "ord.fetch_id", "ord.emit_rank", "ioc_type", "is_high_confidence", "age_days")


@query("is_malicious", S.with_(S.RESULTS, "SELECT source, ioc_value, ioc_type, malicious_score, coalesce(malicious_score >= 50, FALSE) AS malicious FROM results"))
def is_malicious(spark, d):
    return results(spark, d).select(
        "source", "ioc_value", "ioc_type", "malicious_score", external.is_malicious(F.col("malicious_score")).alias("malicious")
    )
