"""Queries on dedup, extraction, matching, scoring, aggregates and streams."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import functions as F

from iocweave.functions import base, norm, sql
from iocweave.operators import dedup, enrich, external, extract, keptindex, match, metrics, score, seen, seenlog, store
from iocweave.plans import enrichment, ingest, run
from iocweave.session import work_dir
from iocweave.sources import alerts as A
from iocweave.sources import feeds, landing, registry
from iocweave.streaming import alerts as stream_alerts
from iocweave.streaming import feeds as stream_feeds
from workloads import derive as D
from workloads import sqlbase as S
from workloads.catalog import (
    ALL_TAGS, CSV_INPUT, ORACLES, EXT, HEADER, NOW, RUN_COLUMNS, RUNS, candidates, csv, enriched, enriched_whole, feed_runs, parsed, query, results,
)

# --- dedup and the seen set ----------------------------------------------------------------------------------

@query(
    "page_iocs",
    f"""WITH u AS (SELECT url AS value, 'url' AS ioc_type FROM pages WHERE regexp_matches(url, '^https?://[^/?#]') UNION
  SELECT value, 'domain' FROM (SELECT {S.norm_domain('host')} AS value FROM (SELECT {S.HOST} AS host FROM pages)) WHERE value IS NOT NULL)
SELECT ioc_type, count(*) AS n FROM u GROUP BY ioc_type""",
)
def page_iocs(spark, d):
    pages = D.table(spark, d, "pages")
    both = pages.select(
        F.col("page_id").alias("ord"),
        F.inline(
            F.array(
                F.struct(F.col("url").alias("value"), F.lit("url").alias("ioc_type")),
                F.struct(norm.host_from_url(F.col("url")).alias("value"), F.lit("domain").alias("ioc_type")),
            )
        ),
    )
    first = dedup.keep_first(dedup.normalise_rows(both), dedup.KEY, ["ord"])
    return first.groupBy("ioc_type").agg(F.count("*").alias("n"))


IOC_KEYS = f"value, ioc_type, source_feed, threat_level, confidence, {S.joined('tags')} AS tags, fetch_id"


def ioc_keys(df):
    return df.select(
        "value", "ioc_type", "source_feed", "threat_level", "confidence", csv("tags").alias("tags"), F.col("ord.fetch_id").alias("fetch_id")
    )


@query("dedup_keep_first", S.with_(S.IOCS, f"SELECT {IOC_KEYS} FROM firsts"))
def dedup_keep_first(spark, d):
    return ioc_keys(dedup.dedup_keep_first(dedup.normalise_rows(D.all_iocs(spark, d))))


@query("norm_rejects", S.with_(S.IOCS, f"SELECT source_feed, ioc_type, count(*) AS n FROM iocs WHERE {S.normalise('value', 'ioc_type')} IS NULL GROUP BY ALL"))
def norm_rejects(spark, d):
    return dedup.rejected_rows(D.all_iocs(spark, d))


def batch(spark, d):
    return dedup.dedup_keep_first(dedup.normalise_rows(D.all_iocs(spark, d)))


@query(
    "seen_anti_join",
    S.with_(f"{S.IOCS},{S.SEEN}", f"SELECT value, ioc_type, EXISTS (SELECT 1 FROM seen s WHERE s.value = f.value AND s.ioc_type = f.ioc_type AND s.expires > {NOW}) AS is_seen FROM firsts f"),
)
def seen_anti_join(spark, d):
    return seen.flag_seen(batch(spark, d), D.seen_table(spark, d), D.now()).select("value", "ioc_type", "is_seen")


@query(
    "seen_upsert",
    S.with_(f"{S.IOCS},{S.SEEN}", f"""SELECT value, ioc_type, {NOW} AS first_seen, {NOW} + INTERVAL 30 DAY AS expires FROM firsts f
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.value = f.value AND s.ioc_type = f.ioc_type AND s.expires > {NOW})
UNION ALL SELECT s.* FROM seen s WHERE s.expires > {NOW} OR NOT EXISTS (SELECT 1 FROM firsts f WHERE s.value = f.value AND s.ioc_type = f.ioc_type)"""),
)
def seen_upsert(spark, d):
    known = D.seen_table(spark, d)
    return seen.seen_upsert(known, seen.new_rows(batch(spark, d), known, D.now()), D.now())


@query("seen_remove", S.with_(S.SEEN, f"SELECT * FROM seen WHERE value NOT IN (SELECT {D.ip('s_suppkey')} FROM supplier) OR ioc_type <> 'ip-dst'"))
def seen_remove(spark, d):
    keys = D.table(spark, d, "supplier").selectExpr(f"{D.ip('s_suppkey')} AS value", "'ip-dst' AS ioc_type")
    return seen.seen_remove(D.seen_table(spark, d), keys)


def kept_log(spark, d, gens=3):
    """The seen keys as a log on disk, written by several runs."""
    log = seenlog.SeenLog(spark, work_dir(spark, "seen-log"), 8)
    rows = D.seen_table(spark, d)
    for k in range(gens):
        log.append(f"run-{k}", rows.filter(F.pmod(F.xxhash64("value"), F.lit(gens)) == k))
    return log


@query("seen_purge", S.with_(S.SEEN, f"SELECT count(*) FILTER (expires <= {NOW}) AS removed, count(*) FILTER (expires > {NOW}) AS kept FROM seen"))
def seen_purge(spark, d):
    """``kept`` counts the rows left on disk."""
    log = kept_log(spark, d)
    removed, _ = log.purge(D.now())
    return spark.read.parquet(f"{log.root}/data").agg(F.lit(removed).cast("bigint").alias("removed"), F.count("*").alias("kept"))


@query("seen_log_probe", ORACLES["seen_anti_join"])
def seen_log_probe(spark, d):
    """The batch against the log on disk, after some keys were written again and the days compacted."""
    log = kept_log(spark, d, 2)
    log.append("again", D.seen_table(spark, d))
    log.compact(many=1)
    return log.flag(batch(spark, d), D.now()).select("value", "ioc_type", "is_seen")


@query("seen_log_remove", ORACLES["seen_remove"])
def seen_log_remove(spark, d):
    log = kept_log(spark, d)
    log.remove(D.table(spark, d, "supplier").selectExpr(f"{D.ip('s_suppkey')} AS value", "'ip-dst' AS ioc_type"))
    return spark.read.parquet(f"{log.root}/data").select("value", "ioc_type", "first_seen", "expires")


@query(
    "seen_stats",
    S.with_(S.SEEN, f"""SELECT CAST(sum(n) AS BIGINT) AS total_entries, CAST(30 AS INTEGER) AS ttl_days, string_agg(ioc_type || '=' || n, ',' ORDER BY ioc_type) AS by_type
  FROM (SELECT ioc_type, count(*) AS n FROM seen WHERE expires > {NOW} GROUP BY ioc_type)"""),
)
def seen_stats(spark, d):
    entries = F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return seen.seen_stats(D.seen_table(spark, d), D.now()).withColumn("by_type", csv(entries))


def sightings(spark, d):
    return D.table(spark, d, "events").selectExpr(f"{D.ip('user_id')} AS value", "'ip-dst' AS ioc_type", "ts")


ACCEPTED = f"""s AS (SELECT {D.ip('user_id')} AS value, 'ip-dst' AS ioc_type, ts FROM events),
acc AS (SELECT value, ioc_type, min(ts) AS ts FROM s GROUP BY ALL
  UNION ALL SELECT a.value, a.ioc_type, n.ts FROM acc a, LATERAL (SELECT min(ts) AS ts FROM s WHERE s.value = a.value AND s.ioc_type = a.ioc_type AND s.ts >= a.ts + INTERVAL 4 DAY) n WHERE n.ts IS NOT NULL)"""


@query("ttl_accept_sequence", S.with_(ACCEPTED, "SELECT * FROM acc", recursive=True))
def ttl_accept_sequence(spark, d):
    return seen.ttl_accept_sequence(sightings(spark, d), 4)


@query("ttl_accept_sequence_heavy", S.with_(ACCEPTED.replace(D.ip("user_id"), D.ip("user_id % 2")), "SELECT * FROM acc", recursive=True))
def ttl_accept_sequence_heavy(spark, d):
    """The same with two keys, each of which has half of all sightings."""
    rows = D.table(spark, d, "events").selectExpr(f"{D.ip('user_id % 2')} AS value", "'ip-dst' AS ioc_type", "ts")
    return seen.ttl_accept_sequence(rows, 4)


@query(
    "cross_feed_first_wins",
    S.with_(S.IOCS, """SELECT value, ioc_type, CASE WHEN feed_rank = 0 THEN 'otx' ELSE 'abusech' END AS feed_name,
  feed_rank = min(feed_rank) OVER (PARTITION BY value, ioc_type) AS first_feed FROM per_feed"""),
)
def cross_feed_first_wins(spark, d):
    rows = dedup.flag_first_feed(dedup.dedup_per_feed(dedup.normalise_rows(D.all_iocs(spark, d))))
    return rows.select("value", "ioc_type", ingest.feed_name(F.col("ord.feed_rank")).alias("feed_name"), "first_feed")


@query(
    "ordered_distinct",
    """SELECT doc_id, string_agg(w, ',' ORDER BY p) AS words, count(*) AS n FROM (
  SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents) GROUP BY ALL)
GROUP BY doc_id""",
)
def ordered_distinct(spark, d):
    words = base.ordered_distinct(F.split("text", " "))
    return D.table(spark, d, "documents").select("doc_id", csv(words).alias("words"), F.size(words).cast("bigint").alias("n"))


# --- extraction ----------------------------------------------------------------------------------------------

def _sorted_csv(values):
    return csv(F.array_sort(F.array_distinct(values)))


def _sorted_sql(values: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({values})), ','), '')"


def _branch(name, siem, fn, sql):
    @query(name, S.with_(S.ALERTS, f"SELECT alert_key, {_sorted_sql(sql)} AS vals FROM header WHERE source_siem = '{siem}'"))
    def run(spark, d):
        alerts = A.parse_alerts(D.raw_alerts(spark, d).filter(F.col("source_siem") == siem))
        return alerts.select("alert_key", _sorted_csv(fn(F.col("v"))).alias("vals"))

    return run


_branch("extract_elastic_paths", "elastic", extract.elastic_path_values, S.PATH_LIST)
_branch("extract_elastic_prefix", "elastic", extract.elastic_prefix_values, S.PREFIX_LIST)
_branch("extract_sentinel_entities", "sentinel", extract.sentinel_candidates, S.ENTITY_LIST)
_branch("extract_generic", "syslog", extract.generic_values, S.GENERIC_LIST)


@query(
    "extract_regex_scan",
    S.with_(S.ALERTS, f"""SELECT 'alert' AS kind, alert_key AS id, {_sorted_sql(S.tokens('raw'))} AS vals FROM alerts
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), {_sorted_sql(S.tokens('text'))} FROM documents"""),
)
def extract_regex_scan(spark, d):
    alerts = D.raw_alerts(spark, d).selectExpr("'alert' AS kind", "alert_key AS id", "raw AS text")
    docs = D.table(spark, d, "documents").selectExpr("'document' AS kind", "CAST(doc_id AS STRING) AS id", "text")
    return alerts.union(docs).select("kind", "id", _sorted_csv(extract.regex_tokens(F.col("text"))).alias("vals"))


@query("extract_candidates", S.with_(S.CANDIDATES, "SELECT alert_key, source_siem, value FROM cand"))
def extract_candidates(spark, d):
    return extract.candidate_rows(candidates(spark, d))


# --- lookups -------------------------------------------------------------------------------------------------

@query("lookup_bulk", S.with_(f"{S.CANDIDATES},{S.STORE}", "SELECT a.value, a.attribute_id, a.type, a.event_id FROM attrs a JOIN (SELECT DISTINCT value FROM cand) c ON c.value = a.value"))
def lookup_bulk(spark, d):
    rows = match.lookup_bulk(extract.candidate_rows(candidates(spark, d)), D.attributes(spark, d))
    return rows.select("value", "attribute_id", "type", "event_id")


@query(
    "match_first_per_value",
    S.with_(S.MATCHED, f"SELECT alert_key, value, ioc_type, source_feed, {S.joined('tags')} AS tags, description, event_id, attribute_id, 'unknown' AS threat_level, CAST(75 AS INTEGER) AS confidence FROM matched"),
)
def match_first_per_value(spark, d):
    rows = match.match_candidates(extract.candidate_rows(candidates(spark, d)), D.attributes(spark, d), D.now())
    return rows.select("alert_key", "value", "ioc_type", "source_feed", csv("tags").alias("tags"), "description", "event_id", "attribute_id", "threat_level", "confidence")


CONTEXT = """
ctx_tags AS (SELECT value, tag, min((seq, pos)) AS first_at FROM (SELECT value, seq, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM attrs) GROUP BY ALL),
ctx AS (SELECT a.value, count(*) AS attribute_count, count(DISTINCT (event_id, event_info)) AS event_count,
    coalesce(array_to_string(list_sort(list(DISTINCT split_part(event_info, ' — ', 1)) FILTER (contains(event_info, ' — '))), ','), '') AS feeds FROM attrs a GROUP BY a.value),
ctx2 AS (SELECT value, string_agg(tag, ',' ORDER BY tag) AS tags,
    coalesce(string_agg(trim(replace(tag, 'threat-actor:', '')), ',' ORDER BY first_at) FILTER (starts_with(tag, 'threat-actor:')), '') AS threat_actors,
    coalesce(string_agg(tag, ',' ORDER BY first_at) FILTER (NOT starts_with(tag, 'threat-actor:') AND contains(lower(tag), 'threat-actor')), '') AS campaigns
  FROM ctx_tags GROUP BY value)"""


@query("ioc_context", S.with_(f"{S.STORE},{CONTEXT}", "SELECT c.*, t.tags, t.threat_actors, t.campaigns FROM ctx c JOIN ctx2 t ON c.value = t.value"))
def ioc_context(spark, d):
    c = match.ioc_context(D.attributes(spark, d))
    lists = ["feeds", "tags", "threat_actors", "campaigns"]
    return c.select("value", "attribute_count", "event_count", *[csv(x).alias(x) for x in lists])


@query(
    "lookup_one",
    S.with_(f"{S.STORE},{CONTEXT},asked AS (SELECT DISTINCT {D.url('s_suppkey')} AS value FROM supplier UNION SELECT DISTINCT {D.ip('s_suppkey')} FROM supplier),"
            "first AS (SELECT * FROM attrs QUALIFY row_number() OVER (PARTITION BY value ORDER BY seq) = 1)",
            """SELECT q.value, c.value IS NOT NULL AS matched, coalesce(c.feeds, '') AS feeds, coalesce(t.tags, '') AS tags, coalesce(c.attribute_count, 0) AS attribute_count,
  CASE WHEN f.type <> 'comment' THEN f.type END AS ioc_type FROM asked q LEFT JOIN ctx c ON c.value = q.value LEFT JOIN ctx2 t ON t.value = q.value LEFT JOIN first f ON f.value = q.value"""),
)
def lookup_one(spark, d):
    s = D.table(spark, d, "supplier")
    asked = s.selectExpr(f"explode(array({D.url('s_suppkey')}, {D.ip('s_suppkey')})) AS value")
    rows = match.lookup_one(asked, D.attributes(spark, d), D.now())
    return rows.select("value", "matched", csv("feeds").alias("feeds"), csv("tags").alias("tags"), "attribute_count", F.col("ioc.ioc_type").alias("ioc_type"))


SEARCHED = ["source.ip", "destination.ip", "dns.question.name", "url.domain", "url.full", "process.hash.sha256", "file.hash.sha256", "file.hash.md5"]


@query(
    "reverse_search",
    S.with_(f"{S.ALERTS},found AS (SELECT alert_key, triggered_at, unnest(list_distinct({S.path_list(SEARCHED)})) AS value FROM header),"
            f"asked AS (SELECT {D.ip('s_suppkey')} AS value FROM supplier UNION SELECT lower({D.dom('s_suppkey')}) FROM supplier)",
            "SELECT f.value, f.alert_key, CAST(row_number() OVER (PARTITION BY f.value ORDER BY triggered_at DESC, alert_key) AS INTEGER) AS rank FROM found f JOIN asked a ON a.value = f.value QUALIFY rank <= 10"),
)
def reverse_search(spark, d):
    asked = D.table(spark, d, "supplier").selectExpr(f"explode(array({D.ip('s_suppkey')}, lower({D.dom('s_suppkey')}))) AS value")
    return A.reverse_search(parsed(spark, d), asked).select("value", "alert_key", "rank")


# --- reputation ----------------------------------------------------------------------------------------------

RESULT_COLUMNS = ["source", "ioc_value", "ioc_type", "found", "malicious_score", "summary", "link"]
RESULT_SQL = ", ".join(RESULT_COLUMNS)


@query("vt_parse", S.with_(S.RESULTS, f"SELECT DISTINCT {RESULT_SQL} FROM vt"))
def vt_parse(spark, d):
    return external.parse_vt(D.vt_answers(spark, d)).select(*RESULT_COLUMNS).distinct()


@query("shodan_parse", S.with_(S.RESULTS, f"SELECT DISTINCT {RESULT_SQL} FROM sh"))
def shodan_parse(spark, d):
    return external.parse_shodan(D.shodan_answers(spark, d)).select(*RESULT_COLUMNS).distinct()


@query("external_status", S.with_(S.RESULTS, "SELECT status, count(*) AS answers, count(*) FILTER (status IN (200, 404)) AS results, count(*) FILTER (status = 200) AS found FROM vt_land GROUP BY status"))
def external_status(spark, d):
    landed = D.vt_answers(spark, d)
    rows = external.parse_vt(landed).groupBy("found").agg(F.count("*").alias("results"))
    status = F.when(F.col("found"), 200).otherwise(404).alias("status")
    parsed_rows = rows.select(status, "results", F.when(F.col("found"), F.col("results")).otherwise(0).alias("found"))
    answers = landed.groupBy("status").agg(F.count("*").alias("answers"))
    return answers.join(parsed_rows, "status", "left").na.fill(0, ["results", "found"])


@query("external_join", S.with_(f"{S.STORE},{S.RESULTS}", "SELECT h.value, h.ioc_type, r.source, r.found, r.malicious_score FROM (SELECT DISTINCT value, ioc_type FROM hits) h JOIN results r ON r.ioc_value = h.value AND r.ioc_type = h.ioc_type"))
def external_join(spark, d):
    iocs = match.index_as_iocs(match.match_index(D.attributes(spark, d)), D.now())
    return external.external_join(iocs, results(spark, d)).select("value", "ioc_type", "source", "found", "malicious_score")


@query(
    "external_unmatched",
    S.with_(f"{S.MATCHED},{S.RESULTS}", f"""SELECT c.alert_key, c.value, r.ioc_type, r.source, r.malicious_score FROM cand c JOIN results r ON r.ioc_value = c.value
  AND r.ioc_type = CASE WHEN {S.is_ipv4('c.value')} THEN 'ip-dst' WHEN regexp_full_match(c.value, '[0-9a-fA-F]{{64}}') THEN 'sha256' WHEN regexp_full_match(c.value, '[0-9a-fA-F]{{32}}') THEN 'md5'
    WHEN regexp_matches(c.value, '^https?://') THEN 'url' WHEN contains(c.value, '.') AND NOT contains(c.value, ' ') THEN 'domain' END
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.alert_key = c.alert_key AND m.value = c.value)"""),
)
def external_unmatched(spark, d):
    c = extract.candidate_rows(candidates(spark, d))
    rows = external.external_unmatched(c, match.match_candidates(c, D.attributes(spark, d), D.now()), results(spark, d))
    return rows.select("alert_key", "value", "ioc_type", "source", "malicious_score")


# --- scores --------------------------------------------------------------------------------------------------

@query("score_recency", f"SELECT event_id, round({S.recency('ts')}, 6) AS recency FROM events")
def score_recency(spark, d):
    return D.table(spark, d, "events").select("event_id", F.round(score.recency_score(F.col("ts"), D.now()), 6).alias("recency"))


SIGNAL_TAGS = "[c_mktsegment, 'APT28', CASE WHEN c_nationkey > 5 THEN 'Emotet' ELSE 'apt28' END, CASE WHEN c_nationkey > 10 THEN 'conti' ELSE 'x' END, CASE WHEN c_nationkey > 20 THEN 'FIN7' ELSE 'y' END]"


@query("score_tag_signal", f"SELECT c_custkey, {S.signal(SIGNAL_TAGS)} AS signal FROM customer")
def score_tag_signal(spark, d):
    tags = F.expr(f"array({SIGNAL_TAGS[1:-1]})")
    return D.table(spark, d, "customer").select("c_custkey", score.tag_signal(tags).alias("signal"))


SCORE_SQL = S.score("source_feed", "ioc_type", "threat_level", "confidence", "last_seen", "tags")


@query("score_ioc", S.with_(S.IOCS, f"SELECT value, ioc_type, source_feed, {SCORE_SQL} AS threat_score FROM firsts"))
def score_ioc(spark, d):
    return score.score_iocs(batch(spark, d), D.now()).select("value", "ioc_type", "source_feed", "threat_score")


@query("score_rank", S.with_(S.IOCS, f"SELECT value, ioc_type, {SCORE_SQL} AS threat_score FROM firsts ORDER BY threat_score DESC, value, ioc_type"))
def score_rank(spark, d):
    return score.rank_iocs(score.score_iocs(batch(spark, d), D.now())).select("value", "ioc_type", "threat_score")


# --- per-alert aggregates ------------------------------------------------------------------------------------

@query("alert_actors_campaigns", S.with_(EXT, "SELECT alert_key, threat_actors, campaigns FROM enriched WHERE n_matched > 0"))
def alert_actors_campaigns(spark, d):
    rows = enriched(spark, d).filter(F.size("matched_iocs") > 0)
    return rows.select("alert_key", csv("threat_actors").alias("threat_actors"), csv("campaigns").alias("campaigns"))


@query(
    "alert_techniques",
    S.with_(f"{S.CANDIDATES},{S.IOCS}", """SELECT alert_key, string_agg(t, ',' ORDER BY t) AS attack_techniques FROM (
  SELECT DISTINCT c.alert_key, unnest(f.attack_techniques) AS t FROM cand c JOIN firsts f ON f.value = c.value) GROUP BY alert_key"""),
)
def alert_techniques(spark, d):
    """Techniques of the stored indicators (mode ``stored``), with the ingested feeds as the store."""
    iocs = batch(spark, d)
    attributes = iocs.select(
        F.concat_ws("-", "source_feed", "value").alias("attribute_id"), F.lit("e").alias("event_id"), F.lit("x").alias("event_info"),
        F.col("ioc_type").alias("type"), "value", F.col("description").alias("comment"), "tags", F.lit(1).cast("bigint").alias("seq"),
        "threat_level", "confidence", "first_seen", "last_seen", "attack_techniques",
    )
    c = extract.candidate_rows(candidates(spark, d))
    m = match.match_candidates(c, match.slim(attributes, "attack_techniques"), D.now(), match_mode="stored")
    per_alert = m.groupBy("alert_key").agg(F.collect_list(F.struct("value", "attack_techniques")).alias("m"))
    out = per_alert.select("alert_key", csv(enrich.alert_techniques(F.col("m"))).alias("attack_techniques"))
    return out.filter("attack_techniques <> ''")


@query("enrichment_tags", S.with_(EXT, f"SELECT alert_key, {S.joined('own_tags')} AS tags FROM enriched"))
def enrichment_tags(spark, d):
    return enriched(spark, d).select("alert_key", csv(enrich.enrichment_tags(F.col("matched_iocs"))).alias("tags"))


@query("external_tags", S.with_(EXT, f"SELECT alert_key, {S.joined('ext_tags')} AS tags FROM enriched"))
def external_tags(spark, d):
    return enriched(spark, d).select("alert_key", csv(enrich.external_tags(F.col("external"))).alias("tags"))


@query("risk_score", S.with_(EXT, "SELECT alert_key, risk_score FROM enriched"))
def risk_score(spark, d):
    return enriched(spark, d).select("alert_key", "risk_score")


ENRICHED_SQL = f"""SELECT alert_key, alert_id, source_siem, alert_name, severity, triggered_at, extracted_iocs, matched_iocs, threat_actors, campaigns, external,
  {S.joined(ALL_TAGS)} AS enrichment_tags, risk_score, gate_enricher, gate_notifier, gate_enricher AND gate_notifier AS should_notify FROM enriched"""


def enriched_columns(e):
    return e.select(
        *HEADER,
        csv("extracted_iocs").alias("extracted_iocs"),
        csv(F.transform("matched_iocs", lambda m: m["value"])).alias("matched_iocs"),
        csv("threat_actors").alias("threat_actors"),
        csv("campaigns").alias("campaigns"),
        csv(F.transform("external", lambda r: F.concat(r["source"], F.lit("="), F.coalesce(r["malicious_score"].cast("string"), F.lit(""))))).alias("external"),
        csv("enrichment_tags").alias("enrichment_tags"),
        "risk_score",
        "gate_enricher",
        "gate_notifier",
        "should_notify",
    )


@query("enriched_alert", S.with_(EXT, ENRICHED_SQL))
def enriched_alert(spark, d):
    return enriched_columns(enriched_whole(spark, d))


@query("notify_gate", S.with_(EXT, "SELECT gate_enricher, gate_notifier, severity, count(*) AS n FROM enriched GROUP BY ALL"))
def notify_gate(spark, d):
    return enriched(spark, d).groupBy("gate_enricher", "gate_notifier", "severity").agg(F.count("*").alias("n"))


@query(
    "cycle_summary",
    S.with_(EXT, """SELECT count(*) FILTER (source_siem = 'elastic') AS elastic, count(*) FILTER (source_siem = 'sentinel') AS sentinel, count(*) AS total,
  count(*) FILTER (n_matched > 0) AS matched, count(*) FILTER (gate_enricher AND gate_notifier) AS notified FROM enriched"""),
)
def cycle_summary(spark, d):
    return enrich.cycle_summary(enriched(spark, d))


@query("top_ioc_per_alert", S.with_(S.MATCHED, "SELECT alert_key, value, ioc_type, threat_score FROM matched QUALIFY row_number() OVER (PARTITION BY alert_key ORDER BY threat_score DESC, value) = 1"))
def top_ioc_per_alert(spark, d):
    top = enriched(spark, d).select("alert_key", enrich.top_ioc(F.col("matched_iocs")).alias("t")).filter("t IS NOT NULL")
    return top.select("alert_key", "t.value", "t.ioc_type", "t.threat_score")


# --- run results and metrics ---------------------------------------------------------------------------------

RUN_RESULT = f"""SELECT feed_name, {NOW} + to_seconds(CASE feed_name WHEN 'otx' THEN 60 ELSE 120 END) AS started_at, {NOW} + INTERVAL 300 SECOND AS finished_at,
  count(*) AS total_fetched, count(*) FILTER (is_new) AS new_iocs, count(*) FILTER (NOT is_new) AS duplicate_iocs, count(*) FILTER (is_new) AS stored, 0::BIGINT AS errors, '' AS error_details
FROM flagged GROUP BY feed_name"""


@query(
    "feed_run_result",
    S.with_(S.FLAGGED, f"SELECT * REPLACE ({NOW} AS started_at, {NOW} + INTERVAL 300 SECOND AS finished_at) FROM ({RUN_RESULT}) "
            f"UNION ALL SELECT 'csv', {NOW}, {NOW} + INTERVAL 300 SECOND, 0, 0, 0, 0, 2, 'no header,not found'"),
)
def feed_run_result(spark, d):
    """Times and errors are given; a feed that failed has a row."""
    failed = D.table(spark, d, "region").selectExpr("'csv' AS feed_name", "CASE r_regionkey WHEN 0 THEN 'not found' WHEN 1 THEN 'no header' END AS error").filter("error IS NOT NULL")
    end = D.now() + F.expr("INTERVAL 300 SECONDS")
    out = ingest.run_feeds(D.all_iocs(spark, d), D.seen_table(spark, d), D.now(), started_at=D.now(), finished_at=end, errors=failed)["results"]
    return out.withColumn("error_details", csv("error_details"))


def ticking():
    """A clock that goes on by a minute each time it is read."""
    at = [dt.datetime.fromisoformat(D.NOW_TEXT)]

    def clock():
        at[0] += dt.timedelta(minutes=1)
        return at[0]

    return clock


def feed_sources(spark, d):
    """The four feeds, and one whose files cannot be read."""

    def broken():
        return spark.read.schema("value string").csv("/nowhere/feed.csv")

    return D.feed_rows(spark, d) | {"csv": broken}


def kept_store(spark, d):
    store_ = run.Store(spark, work_dir(spark, "store"), 8)
    store_.seen.append("before", D.seen_table(spark, d))
    return store_


@query(
    "run_results",
    S.with_(S.FLAGGED, f"{RUN_RESULT} UNION ALL SELECT 'csv', {NOW} + INTERVAL 180 SECOND, {NOW} + INTERVAL 240 SECOND, 0, 0, 0, 0, 1, 'csv: failed'")
    .replace("INTERVAL 300 SECOND", "INTERVAL 240 SECOND"),
)
def run_results(spark, d):
    """Of a whole run, with the times of its clock and the error of the feed that failed."""
    out = run.run(kept_store(spark, d), "r1", feed_sources(spark, d), D.now(), clock=ticking())
    short = F.transform("error_details", lambda e: F.concat(F.substring_index(e, ":", 1), F.lit(": failed")))
    return out.withColumn("error_details", csv(short))


@query(
    "run_twice",
    S.with_(f"{S.FLAGGED},new AS (SELECT * FROM flagged WHERE is_new),e AS (SELECT source_feed, min((feed_rank, sub_rank, fetch_id, pos, emit_rank)) AS o, count(*) AS n FROM new GROUP BY source_feed)", f"""
SELECT 'attributes' AS name, count(*) AS n, count(DISTINCT (value, ioc_type)) AS n_keys, sum(confidence)::BIGINT AS total FROM new
UNION ALL SELECT 'events', count(*), count(DISTINCT source_feed), sum(n)::BIGINT FROM e
UNION ALL SELECT 'event_tags', count(*), count(DISTINCT tag), sum(length(tag))::BIGINT FROM (SELECT DISTINCT source_feed, unnest(tags[1:10]) AS tag FROM new)
UNION ALL SELECT 'results', count(*), 2, sum(new_iocs + duplicate_iocs + stored)::BIGINT FROM (
  SELECT feed_name, count(*) FILTER (is_new) AS new_iocs, count(*) FILTER (NOT is_new) AS duplicate_iocs, count(*) FILTER (is_new) AS stored FROM flagged GROUP BY feed_name
  UNION ALL SELECT feed_name, 0, count(*), 0 FROM flagged GROUP BY feed_name)
UNION ALL SELECT 'seen', count(*), count(DISTINCT (value, ioc_type)), 0 FROM (SELECT value, ioc_type FROM new UNION ALL SELECT value, ioc_type FROM seen)"""),
)
def run_twice(spark, d):
    """A run, the same run again, and a later run of the same feeds, which finds nothing new."""
    store_, feeds = kept_store(spark, d), D.feed_rows(spark, d)
    for run_id in ("r1", "r1", "r2"):
        run.run(store_, run_id, feeds, D.now())
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total")
    kept = {
        "attributes": (F.struct("value", "type"), "confidence"), "events": (F.col("source_feed"), "attribute_count"),
        "event_tags": (F.col("tag"), F.length("tag")), "results": (F.col("feed_name"), F.col("new_iocs") + F.col("duplicate_iocs") + F.col("stored")),
    }
    parts = [
        store_.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), number(total))
        for name, (key, total) in kept.items()
    ]
    parts.append(store_.seen.read().agg(F.lit("seen").alias("name"), F.count("*").alias("n"), F.countDistinct("value", "ioc_type").alias("n_keys"), F.lit(0).cast("bigint").alias("total")))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("kept_index", S.with_(S.STORE, f"SELECT value, ioc_type, source_feed, {S.joined('tags')} AS tags, description, event_id, attribute_id FROM hits"))
def kept_index(spark, d):
    """The index after four updates, one of them repeated, that each bring a part of the store."""
    index, rows = keptindex.KeptIndex(spark, work_dir(spark, "index"), 8), D.attributes(spark, d)
    for k in (2, 0, 1, 1, 3):
        index.update(rows.filter(F.pmod(F.xxhash64("attribute_id"), F.lit(4)) == k), f"run-{k}")
    iocs = match.index_as_iocs(index.read(), D.now())
    return iocs.select("value", "ioc_type", "source_feed", csv("tags").alias("tags"), "description", "event_id", "attribute_id")


@query("feed_run_rates", S.with_(RUNS, "SELECT feed_name, started_at, duration_seconds, success_rate FROM rated"))
def feed_run_rates(spark, d):
    return metrics.feed_run_rates(feed_runs(spark, d)).select("feed_name", "started_at", "duration_seconds", "success_rate")


@query("feed_last_result", S.with_(RUNS, f"SELECT {', '.join(RUN_COLUMNS)} FROM runs QUALIFY row_number() OVER (PARTITION BY feed_name ORDER BY finished_at DESC, started_at DESC) = 1"))
def feed_last_result(spark, d):
    return metrics.feed_last_result(feed_runs(spark, d)).select(*RUN_COLUMNS)


METRICS_NOW = "CAST('2024-01-20 00:00:00' AS TIMESTAMP)"


@query(
    "pipeline_metrics",
    S.with_(f"{S.IOCS},{RUNS},alerts_m AS (SELECT ts, event_type IN ('error', 'view') AS matched, event_type = 'error' AS notified FROM events)", f"""SELECT
  (SELECT count(*) FROM firsts) AS total_iocs_cached,
  (SELECT string_agg(source_feed || '=' || n, ',' ORDER BY source_feed) FROM (SELECT source_feed, count(*) AS n FROM firsts GROUP BY ALL)) AS iocs_by_feed,
  (SELECT string_agg(ioc_type || '=' || n, ',' ORDER BY ioc_type) FROM (SELECT ioc_type, count(*) AS n FROM firsts GROUP BY ALL)) AS iocs_by_type,
  count(*) FILTER (ts > {METRICS_NOW} - INTERVAL 1 HOUR AND ts <= {METRICS_NOW}) AS alerts_enriched_last_hour,
  count(*) FILTER (ts > {METRICS_NOW} - INTERVAL 1 HOUR AND ts <= {METRICS_NOW} AND matched) AS alerts_matched_last_hour,
  count(*) FILTER (ts > {METRICS_NOW} - INTERVAL 1 HOUR AND ts <= {METRICS_NOW} AND notified) AS notifications_sent_last_hour,
  max(ts) AS last_enrichment_run,
  (SELECT string_agg(feed_name || '=' || (errors = 0), ',' ORDER BY feed_name) FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY feed_name ORDER BY finished_at DESC, started_at DESC) = 1)) AS feed_health
FROM alerts_m"""),
)
def pipeline_metrics(spark, d):
    alerts = D.table(spark, d, "events").select(
        F.col("ts").alias("enriched_at"),
        F.when(F.col("event_type").isin("error", "view"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("matched_iocs"),
        (F.col("event_type") == "error").alias("should_notify"),
    )
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    m = metrics.pipeline_metrics(batch(spark, d), alerts, feed_runs(spark, d), now)
    text = lambda c: csv(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias(c)
    return m.select(
        "total_iocs_cached", text("iocs_by_feed"), text("iocs_by_type"), "alerts_enriched_last_hour", "alerts_matched_last_hour",
        "notifications_sent_last_hour", "last_enrichment_run", text("feed_health"),
    )


@query(
    "actor_profile",
    S.with_(f"{S.IOCS},t AS (SELECT *, unnest(tags) AS tag FROM norm),a AS (SELECT *, trim(replace(tag, 'threat-actor:', '')) AS actor FROM t WHERE contains(lower(tag), 'threat-actor:'))",
            """SELECT actor, count(DISTINCT (value, ioc_type)) AS ioc_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  array_to_string(list_sort(list(DISTINCT source_feed)), ',') AS source_feeds, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(b.attack_techniques) AS x FROM a b WHERE b.actor = a.actor)) AS attack_techniques
FROM a GROUP BY actor"""),
)
def actor_profile(spark, d):
    p = metrics.actor_profile(dedup.normalise_rows(D.all_iocs(spark, d)))
    return p.select("actor", "ioc_count", "first_seen", "last_seen", csv("source_feeds").alias("source_feeds"), csv("attack_techniques").alias("attack_techniques"))


@query(
    "ioc_relationships",
    S.with_(S.IOCS, """SELECT a.source_feed, a.value AS source_ioc, b.value AS target_ioc,
  CASE WHEN a.ioc_type = 'sha256' AND b.ioc_type = 'md5' THEN 'same-file-as' WHEN b.ioc_type = 'filename' THEN 'named' ELSE 'hosted-on' END AS relationship_type,
  max(least(a.confidence, b.confidence)) AS confidence, min(a.first_seen) AS first_seen
FROM norm a JOIN norm b ON a.sub_rank = b.sub_rank AND a.feed_rank = b.feed_rank AND a.fetch_id = b.fetch_id AND a.pos = b.pos AND a.emit_rank < b.emit_rank WHERE a.feed_rank = 1 GROUP BY ALL"""),
)
def ioc_relationships(spark, d):
    return metrics.ioc_relationships(dedup.normalise_rows(D.all_iocs(spark, d)))


# --- streams -------------------------------------------------------------------------------------------------

def event_stream(spark, d, columns="event_id, ts, user_id, event_type, value, props"):
    schema = D.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


STREAM_IOCS = f"CASE WHEN event_type = 'view' THEN {D.dom('user_id')} ELSE {D.ip('user_id')} END"


@query(
    "stream_feed_ingest",
    S.with_(S.SEEN, f"""SELECT value, ioc_type FROM (SELECT DISTINCT ioc_type, {S.normalise('raw_value', 'ioc_type')} AS value FROM (
  SELECT {STREAM_IOCS} AS raw_value, CASE WHEN event_type = 'view' THEN 'domain' ELSE 'ip-dst' END AS ioc_type FROM events)) f
WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.value = f.value AND s.ioc_type = f.ioc_type AND s.expires > {NOW})"""),
)
def stream_feed_ingest(spark, d):
    root = work_dir(spark, "stream-feed")
    seenlog.SeenLog(spark, f"{root}/seen", 8).append("before", D.seen_table(spark, d))
    rows = event_stream(spark, d).select(
        F.expr(STREAM_IOCS).alias("value"), F.expr("CASE WHEN event_type = 'view' THEN 'domain' ELSE 'ip-dst' END").alias("ioc_type"), F.col("event_id").alias("ord")
    )
    finish(stream_feeds.stream_feed_ingest(rows, f"{root}/seen", f"{root}/out", f"{root}/checkpoint", D.now(), buckets=8))
    return spark.read.parquet(f"{root}/out").select("value", "ioc_type")


@query("stream_dedup_ttl", S.with_(ACCEPTED, "SELECT * FROM acc", recursive=True))
def stream_dedup_ttl(spark, d):
    """The history is several times as long as the TTL."""
    root = work_dir(spark, "stream-dedup")
    rows = event_stream(spark, d).select(F.expr(D.ip("user_id")).alias("value"), F.lit("ip-dst").alias("ioc_type"), "ts")
    finish(stream_feeds.stream_dedup_ttl(rows, f"{root}/out", f"{root}/checkpoint", 4, buckets=8))
    return spark.read.schema(stream_feeds.ACCEPTED).parquet(f"{root}/out").select("value", "ioc_type", "ts")


@query("stream_dedup_ttl_batches", S.with_(ACCEPTED.replace("INTERVAL 4 DAY", "INTERVAL 9 DAY"), "SELECT * FROM acc", recursive=True))
def stream_dedup_ttl_batches(spark, d):
    """Six files, a micro-batch each, in order of time; the state is dropped behind the watermark."""
    root = work_dir(spark, "stream-batches")
    rows = sightings(spark, d)
    for k in range(6):
        rows.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    landed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    finish(stream_feeds.stream_dedup_ttl(landed, f"{root}/out", f"{root}/checkpoint", 9, delay_days=1, buckets=8))
    return spark.read.schema(stream_feeds.ACCEPTED).parquet(f"{root}/out").select("value", "ioc_type", "ts")


@query("stream_alert_enrich", S.with_(EXT, ENRICHED_SQL))
def stream_alert_enrich(spark, d):
    root = work_dir(spark, "stream-alerts")
    alerts = event_stream(spark, d).selectExpr(f"{D.pad('event_id')} AS alert_key", f"{D.ALERT_SIEM} AS source_siem", f"{D.alert_raw('spark')} AS raw")
    index = keptindex.KeptIndex(spark, f"{root}/index", 8)
    index.update(D.attributes(spark, d), "store")
    snapshot = lambda: (index, results(spark, d))
    finish(stream_alerts.stream_alert_enrich(alerts, snapshot, f"{root}/out", f"{root}/checkpoint", D.now()))
    return enriched_columns(spark.read.parquet(f"{root}/out"))


@query(
    "stream_hourly_metrics",
    "SELECT date_trunc('hour', ts) AS hour, count(*) AS enriched, count(*) FILTER (event_type IN ('error', 'view')) AS matched, count(*) FILTER (event_type = 'error') AS notified "
    "FROM events GROUP BY 1",
)
def stream_hourly_metrics(spark, d):
    """Every hour, those that the watermark has not closed included."""
    root = work_dir(spark, "stream-hourly")
    rows = event_stream(spark, d).select(
        F.col("ts").cast("timestamp").alias("enriched_at"), F.col("event_type").isin("error", "view").alias("matched"), (F.col("event_type") == "error").alias("notified")
    )
    finish(stream_alerts.write_hourly(rows, f"{root}/out", f"{root}/checkpoint"))
    return stream_alerts.read_hourly(spark, f"{root}/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


# --- landed files --------------------------------------------------------------------------------------------

# Compressed text cannot be split, so a file has as many lines as a task should read.
LANDED = {"compression": "gzip", "maxRecordsPerFile": 200_000}


def landed_iocs(spark, d):
    """The derived envelopes as JSON lines, many to a file, read back by the registry."""
    root = work_dir(spark, "landed")
    made = {
        "otx": D.otx_envelopes(spark, d), "abusech_malware": D.malware_envelopes(spark, d),
        "abusech_url": D.url_envelopes(spark, d), "threatfox": D.threatfox_envelopes(spark, d),
    }
    for name, envelopes in made.items():
        envelopes.drop("fetch_id").write.options(**LANDED).json(f"{root}/{name}")
    return registry.read_feeds(spark, {name: f"{root}/{name}" for name in made}, D.now())


@query(
    "landed_json_ingest",
    S.with_(S.IOCS, "SELECT source_feed, ioc_type, count(*) AS n, count(DISTINCT value) AS n_values, sum(confidence)::BIGINT AS confidence, min(first_seen) AS first_seen, count(*) AS n_places FROM iocs GROUP BY ALL"),
)
def landed_json_ingest(spark, d):
    """``n_places`` counts distinct places: every row of every landed line has its own."""
    return landed_iocs(spark, d).groupBy("source_feed", "ioc_type").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.sum("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"), F.countDistinct("ord").alias("n_places"),
    )


@query("landed_relationships", ORACLES["ioc_relationships"])
def landed_relationships(spark, d):
    return metrics.ioc_relationships(dedup.normalise_rows(landed_iocs(spark, d)))


@query(
    "pipeline_end_to_end",
    S.with_(f"{S.FLAGGED},{S.CANDIDATES}", """SELECT c.value, any_value(f.ioc_type) AS ioc_type, any_value(f.source_feed) AS source_feed, any_value(f.threat_level) AS threat_level,
  any_value(f.confidence) AS confidence, count(DISTINCT c.alert_key) AS n_alerts
FROM (SELECT DISTINCT alert_key, value FROM cand) c
JOIN (SELECT * FROM flagged WHERE is_new QUALIFY row_number() OVER (PARTITION BY value ORDER BY feed_rank, sub_rank, fetch_id, pos, emit_rank) = 1) f ON f.value = c.value
GROUP BY c.value"""),
)
def pipeline_end_to_end(spark, d):
    """Feeds to the store that the library writes, then alerts against that store, with the values that it keeps."""
    root = work_dir(spark, "store")
    stored = ingest.run_feeds(D.all_iocs(spark, d), D.seen_table(spark, d), D.now())["attributes"]
    store.write_by_feed(stored, root)
    attributes = spark.read.parquet(root)
    enriched = enrichment.enrich_cycle(D.raw_alerts(spark, d), attributes, D.now(), match_mode="stored")["enriched_alerts"]
    matched = enriched.select("alert_key", F.explode("matched_iocs").alias("m")).select("alert_key", "m.*")
    return matched.groupBy("value").agg(
        F.first("ioc_type").alias("ioc_type"), F.first("source_feed").alias("source_feed"), F.first("threat_level").alias("threat_level"),
        F.first("confidence").alias("confidence"), F.countDistinct("alert_key").alias("n_alerts"),
    )


BROKEN = "CAST(substr(fetch_id, 1, 12) AS BIGINT) % 7 = 3"
_KEPT = "NOT (CAST(substr(fetch_id, 1, 12) AS BIGINT) % 7 = 3)"


@query(
    "rejects_by_reason",
    S.with_(S.IOCS, f"""SELECT source_feed, reason, count(*) AS n FROM (
  SELECT source_feed, CASE WHEN {S.normalise('value', 'ioc_type')} IS NULL THEN 'refused value' ELSE 'good' END AS reason FROM iocs WHERE {_KEPT}
  UNION ALL SELECT 'otx', unnest(CASE WHEN event_id % 7 = 3 THEN ['corrupt envelope'] ELSE ['unmapped type', 'no value'] END) FROM events
  UNION ALL SELECT 'abusech_url', 'corrupt envelope' FROM pages WHERE page_id % 7 = 3
  UNION ALL SELECT 'threatfox', CASE WHEN l_orderkey % 7 = 3 THEN 'corrupt envelope' ELSE 'unmapped type' END FROM lineitem WHERE l_orderkey % 7 = 3 OR l_linenumber = 6
  UNION ALL SELECT 'abusech_malware', CASE WHEN o_orderkey % 7 = 3 THEN 'corrupt envelope' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'query status' ELSE 'no value' END
    FROM orders WHERE o_orderkey % 7 = 3 OR o_orderpriority = '4-NOT SPECIFIED' OR o_orderstatus IN ('O', 'P')
) GROUP BY ALL"""),
)
def rejects_by_reason(spark, d):
    """Landed lines, every seventh of them broken: good rows and refused ones, written in one pass, counted again here."""
    root = work_dir(spark, "judged")
    made = {
        "otx": D.otx_envelopes(spark, d), "abusech_malware": D.malware_envelopes(spark, d),
        "abusech_url": D.url_envelopes(spark, d), "threatfox": D.threatfox_envelopes(spark, d),
    }
    parts = []
    for name, envelopes in made.items():
        line = F.to_json(F.struct(*[c for c in envelopes.columns if c != "fetch_id"]))
        envelopes.select(F.when(F.expr(BROKEN), F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.options(**LANDED).text(f"{root}/{name}")
        judged = registry.read_feed(spark, name, f"{root}/{name}", D.now(), judged=True)
        good, rejects, counts = feeds.split_judged(judged, f"{root}/{name}_judged")
        if counts["rows"] != counts["good"] + sum(n for k, n in counts.items() if k not in ("rows", "good")):
            raise ValueError(f"counts of {name} do not add up: {counts}")
        parts.append(good.select("source_feed", F.lit("good").alias("reason")).unionByName(rejects.select("source_feed", "reason")))
    rows = functools.reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("source_feed", "reason").agg(F.count("*").alias("n"))


def landed_alerts(spark, d):
    """The derived alerts, landed in two batches, one of them twice."""
    path, rows = work_dir(spark, "landed-alerts"), D.raw_alerts(spark, d)
    for name, part in (("a", 0), ("b", 1), ("a", 0)):
        landing.land_alerts(rows.filter(F.pmod(F.xxhash64("alert_key"), F.lit(2)) == part), path, name, D.now())
    return landing.read_landed(spark, path)


def _landed_scan(siem):
    @query(f"landed_{siem}_scan", ORACLES[f"alerts_{siem}_scan"])
    def scan(spark, d):
        since = D.now() - F.expr("INTERVAL 10 DAYS")
        return landing.latest_landed(landed_alerts(spark, d), siem, since).select(*HEADER)

    return scan


_landed_scan("elastic")
_landed_scan("sentinel")


@query("landed_reverse_search", ORACLES["reverse_search"])
def landed_reverse_search(spark, d):
    asked = D.table(spark, d, "supplier").selectExpr(f"explode(array({D.ip('s_suppkey')}, lower({D.dom('s_suppkey')}))) AS value")
    return landing.search_landed(landed_alerts(spark, d), asked).select("value", "alert_key", "rank")


@query("landed_csv_ingest", ORACLES["feed_csv"].replace("p_name AS description", "p_name || ' \"' || p_brand || '\", line ' || p_size AS description"))
def landed_csv_ingest(spark, d):
    """CSV files with quoted and doubled marks, read in many splits by the registry."""
    root = work_dir(spark, "landed-csv")
    fields = CSV_INPUT | {"description": "concat(p_name, ' \"', p_brand, '\", line ', p_size)"}
    rows = D.table(spark, d, "part").selectExpr(*[f"{e} AS {n}" for n, e in fields.items()])
    rows.select("value", "type", "threat_level", "description", "tags").write.option("header", True).option("escape", '"').csv(root)
    known = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        read = registry.read_feed(spark, "csv", root, D.now())
        read.schema, read._jdf.queryExecution().executedPlan()  # the splits are fixed with the plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", known)
    return read.select(
        "value", "ioc_type", "threat_level", csv("tags").alias("tags"), "description", "first_seen", "confidence", "pulse_id"
    )


# --- SQL text ------------------------------------------------------------------------------------------------

@query("sql_functions", S.with_(S.IOCS, f"SELECT value, ioc_type, source_feed, {SCORE_SQL} AS threat_score, {S.recency('last_seen')} AS recency FROM norm"))
def sql_functions(spark, d):
    """Normalising and scoring in SQL text alone."""
    sql.register(spark)
    D.all_iocs(spark, d).createOrReplaceTempView("landed_iocs")
    return spark.sql(f"""
        SELECT ioc_normalise(value, ioc_type) AS value, ioc_type, source_feed,
            score_ioc(source_feed, ioc_type, threat_level, confidence, last_seen, tags, timestamp_ntz'{D.NOW_TEXT}') AS threat_score,
            score_recency(last_seen, timestamp_ntz'{D.NOW_TEXT}') AS recency
        FROM landed_iocs WHERE ioc_accepted(value, ioc_type)""")
