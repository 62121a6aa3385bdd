"""DuckDB SQL of the derived inputs and of the canonical forms, as common table expressions."""

from __future__ import annotations

import ipaddress

from workloads import derive as D

NOW = D.NOW_SQL
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"({OCTET}\\.){{3}}{OCTET}"

REFUSED = (
    "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 "
    "198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()
CANDIDATE_REFUSED = (
    "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 127.0.0.0/8 169.254.0.0/16 224.0.0.0/4 240.0.0.0/4 0.0.0.0/32"
).split()


def num(v: str) -> str:
    parts = [f"TRY_CAST(split_part({v}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)]
    return "(" + " + ".join(parts) + ")"


def in_blocks(v: str, blocks: list[str]) -> str:
    nets = [ipaddress.ip_network(b) for b in blocks]
    return "(" + " OR ".join(f"{num(v)} BETWEEN {int(n[0])} AND {int(n[-1])}" for n in nets) + ")"


def is_ipv4(v: str) -> str:
    return f"regexp_full_match({v}, '{IPV4}')"


def refused(v: str) -> str:
    """Refused IPv4; 192.0.0.9 and .10 are public."""
    return f"({is_ipv4(v)} AND {in_blocks(v, REFUSED)} AND {v} NOT IN ('192.0.0.9', '192.0.0.10'))"


def norm_domain(v: str) -> str:
    name = f"regexp_replace(trim(lower({v}), '.'), '^www\\.', '')"
    internal = (
        "('localhost', 'local', 'internal', 'corp', 'lan', 'home', 'example.com', 'example.org', 'example.net', 'test', 'invalid')"
    )
    return (
        f"CASE WHEN contains({name}, '.') AND split_part({name}, '.', -1) NOT IN {internal} AND {name} NOT IN {internal} "
        f"AND length({name}) BETWEEN 4 AND 253 THEN {name} END"
    )


def norm_ip(v: str) -> str:
    return f"CASE WHEN {is_ipv4(v)} AND NOT {refused(v)} THEN {v} END"


def norm_url(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '^https?://[^/?#]') THEN {v} END"


def norm_hash(v: str, n: str) -> str:
    empty = (
        "('d41d8cd98f00b204e9800998ecf8427e', 'da39a3ee5e6b4b0d3255bfef95601890afd80709', "
        "'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855')"
    )
    return f"CASE WHEN length({v}) = {n} AND regexp_full_match(lower({v}), '[0-9a-f]+') AND lower({v}) NOT IN {empty} THEN lower({v}) END"


def norm_email(v: str) -> str:
    return f"CASE WHEN contains({v}, '@') AND length({v}) >= 6 THEN lower({v}) END"


def normalise(value: str, kind: str) -> str:
    v = f"trim({value}, ' ' || chr(9) || chr(10) || chr(13))"
    return (
        f"CASE WHEN {v} = '' THEN NULL WHEN {kind} = 'ip-dst' THEN {norm_ip(v)} WHEN {kind} = 'domain' THEN {norm_domain(v)} "
        f"WHEN {kind} = 'url' THEN {norm_url(v)} WHEN {kind} = 'md5' THEN {norm_hash(v, '32')} "
        f"WHEN {kind} = 'sha1' THEN {norm_hash(v, '40')} WHEN {kind} = 'sha256' THEN {norm_hash(v, '64')} "
        f"WHEN {kind} = 'email-src' THEN {norm_email(v)} "
        f"WHEN {kind} = 'filename' AND length({v}) >= 2 THEN {value} END"
    )


def valid(v: str) -> str:
    return (
        f"(length({v}) >= 4 AND {v} NOT IN ('0.0.0.0', '255.255.255.255', 'localhost') "
        f"AND NOT ({is_ipv4(v)} AND {in_blocks(v, CANDIDATE_REFUSED)}))"
    )


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#]*@)?([^/?#:@]*)', 1))"


def joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, ','), '')"


def _cols(fields: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in fields.items())


OTX = f"""
otx_p AS (SELECT *, {_cols({f"f_{k}": v for k, v in D.otx_fields("duck").items()})} FROM events),
otx AS (
  SELECT i.value AS value, i.kind AS ioc_type, 'otx' AS source_feed,
    CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'view' THEN 'unknown' ELSE 'low' END AS threat_level,
    list_concat([event_type, concat('user-', user_id % 50)], CASE WHEN f_adversary <> '' THEN [f_adversary] ELSE [] END) AS tags,
    i.description AS description,
    date_trunc('second', ts) AS first_seen,
    CASE WHEN event_type = 'view' THEN date_trunc('second', ts) ELSE date_trunc('second', ts + INTERVAL 1 DAY) END AS last_seen,
    CAST(CASE event_type WHEN 'error' THEN least(100, floor(value_)) WHEN 'view' THEN 70 ELSE 50 END AS INTEGER) AS confidence,
    f_id AS pulse_id,
    CASE WHEN user_id % 20 = user_id % 30 THEN [concat('T1', 100 + user_id % 20), 'T1059']
      ELSE [concat('T1', 100 + user_id % 20), 'T1059', concat('T1', 100 + user_id % 30)] END AS attack_techniques,
    0 AS feed_rank, 0 AS sub_rank, f_fetch_id AS fetch_id, i.pos AS pos, 0 AS emit_rank
  FROM (SELECT * RENAME (value AS value_), unnest([
      {{'value': {D.ip("user_id")}, 'kind': 'ip-dst', 'pos': 0, 'description': concat('OTX pulse: Campaign ', event_type)}},
      {{'value': {D.dom("user_id")}, 'kind': 'domain', 'pos': 1, 'description': 'C2 host'}},
      {{'value': {D.sha256("user_id", "duck")}, 'kind': 'sha256', 'pos': 2, 'description': concat('OTX pulse: Campaign ', event_type)}}
    ]) AS i FROM otx_p)
)"""

MALWARE = f"""
mal_p AS (SELECT *, {D.pad("o_orderkey")} AS fetch_id, upper({D.sha256("o_custkey", "duck")}) AS sha,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Emotet' WHEN '5-LOW' THEN 'TrickBot' ELSE 'Unknown' END AS sig
  FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
malware AS (
  SELECT i.value AS value, i.kind AS ioc_type, 'abusech_malware' AS source_feed, i.lvl AS threat_level,
    CASE o_orderpriority WHEN '1-URGENT' THEN ['Emotet', 'banking'] WHEN '2-HIGH' THEN ['loader', 'Unknown'] ELSE [sig] END AS tags,
    sig || ' malware sample — ' || CASE WHEN o_orderstatus = 'F' THEN 'exe' ELSE 'unknown' END AS description,
    o_orderdate AS first_seen,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY ELSE o_orderdate END AS last_seen,
    CAST(i.conf AS INTEGER) AS confidence, sha AS pulse_id, CAST([] AS VARCHAR[]) AS attack_techniques,
    1 AS feed_rank, 0 AS sub_rank, fetch_id, 0 AS pos, i.emit AS emit_rank
  FROM (SELECT *, unnest([
      {{'value': sha, 'kind': 'sha256', 'lvl': 'high', 'conf': 90, 'emit': 0}},
      {{'value': CASE WHEN o_orderstatus <> 'O' THEN {D.md5("o_custkey")} END, 'kind': 'md5', 'lvl': 'high', 'conf': 85, 'emit': 1}},
      {{'value': CASE WHEN o_orderstatus <> 'P' THEN concat('invoice_', o_custkey, '.exe') END, 'kind': 'filename', 'lvl': 'medium', 'conf': 70, 'emit': 2}}
    ]) AS i FROM mal_p)
  WHERE i.value IS NOT NULL
)"""

URLS = f"""
url_p AS (SELECT *, {D.pad("page_id")} AS fetch_id,
  CASE WHEN url LIKE '%.example.com%' THEN 'Malware_download' WHEN url LIKE '%.example.net%' THEN 'phishing' ELSE '' END AS threat,
  CASE WHEN url LIKE 'https%' THEN {HOST} ELSE {D.ip("page_id")} END AS host,
  CASE WHEN url LIKE 'https%' THEN {NOW} ELSE strptime(concat('2024-01-', 10 + page_id % 20, 'T10:00:00'), '%Y-%m-%dT%H:%M:%S') END AS added
  FROM pages),
urls AS (
  SELECT i.value AS value, i.kind AS ioc_type, 'abusech_url' AS source_feed,
    CASE WHEN threat = 'Malware_download' THEN 'high' ELSE 'medium' END AS threat_level,
    CASE WHEN url LIKE '%.example.org%' THEN ['org', 'exe'] ELSE CAST([] AS VARCHAR[]) END AS tags,
    i.label || threat AS description, added AS first_seen, added AS last_seen, CAST(i.conf AS INTEGER) AS confidence,
    CAST(page_id AS VARCHAR) AS pulse_id, CAST([] AS VARCHAR[]) AS attack_techniques,
    1 AS feed_rank, 1 AS sub_rank, fetch_id, 0 AS pos, i.emit AS emit_rank
  FROM (SELECT *, unnest([
      {{'value': url, 'kind': 'url', 'label': 'URLhaus — ', 'conf': 80, 'emit': 0}},
      {{'value': host, 'kind': CASE WHEN {is_ipv4("host")} THEN 'ip-dst' ELSE 'domain' END, 'label': 'URLhaus host — ', 'conf': 75, 'emit': 1}}
    ]) AS i FROM url_p)
)"""

_TF = D.threatfox_fields("duck")
THREATFOX = f"""
tf_p AS (SELECT *, {_TF["fetch_id"]} AS fetch_id,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity * 2 AS INTEGER) ELSE 50 END AS conf FROM lineitem WHERE l_linenumber <> 6),
threatfox AS (
  SELECT CASE l_linenumber WHEN 1 THEN {D.ip("l_suppkey")} WHEN 2 THEN concat('WWW.', {D.dom("l_suppkey")}, '.')
      WHEN 3 THEN {D.url("l_partkey")} WHEN 4 THEN {D.md5("l_suppkey")} WHEN 5 THEN {D.sha256("l_partkey", "duck")}
      ELSE {D.ip("l_partkey")} END AS value,
    CASE l_linenumber WHEN 2 THEN 'domain' WHEN 3 THEN 'url' WHEN 4 THEN 'md5' WHEN 5 THEN 'sha256' ELSE 'ip-dst' END AS ioc_type,
    'threatfox' AS source_feed,
    CASE WHEN conf >= 75 THEN 'high' WHEN conf >= 50 THEN 'medium' ELSE 'low' END AS threat_level,
    CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN ['Cobalt Strike', 'Conti'] ELSE ['Cobalt Strike'] END
      ELSE ['c2', CASE WHEN l_linestatus = 'F' THEN 'Conti' ELSE 'Cobalt Strike' END] END AS tags,
    'ThreatFox — ' || CASE WHEN l_returnflag = 'A' THEN 'Cobalt Strike' ELSE '' END AS description,
    l_shipdate AS first_seen, l_shipdate AS last_seen, conf AS confidence,
    concat(l_orderkey, '-', l_linenumber) AS pulse_id, CAST([] AS VARCHAR[]) AS attack_techniques,
    1 AS feed_rank, 2 AS sub_rank, fetch_id, 0 AS pos, 0 AS emit_rank
  FROM tf_p
)"""

IOCS = f"""{OTX},{MALWARE},{URLS},{THREATFOX},
iocs AS (SELECT * FROM otx UNION ALL SELECT * FROM malware UNION ALL SELECT * FROM urls UNION ALL SELECT * FROM threatfox),
norm AS (SELECT * REPLACE (nv AS value) FROM (SELECT *, {normalise("value", "ioc_type")} AS nv FROM iocs) WHERE nv IS NOT NULL),
firsts AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY value, ioc_type
  ORDER BY feed_rank, sub_rank, fetch_id, pos, emit_rank) = 1),
per_feed AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY feed_rank, value, ioc_type
  ORDER BY feed_rank, sub_rank, fetch_id, pos, emit_rank) = 1)"""

SEEN = f"""
seen AS (
  SELECT i.value AS value, i.kind AS ioc_type, {NOW} - to_days(CAST(c_custkey % 45 AS INTEGER)) AS first_seen,
    {NOW} - to_days(CAST(c_custkey % 45 AS INTEGER)) + INTERVAL 30 DAY AS expires
  FROM (SELECT *, unnest([{{'value': {D.ip(D.SEEN_KEY)}, 'kind': 'ip-dst'}},
    {{'value': {D.sha256(D.SEEN_KEY, "duck")}, 'kind': 'sha256'}}]) AS i FROM customer)
)"""

FLAGGED = f"""{IOCS},{SEEN},
flagged AS (
  SELECT p.*, CASE WHEN feed_rank = 0 THEN 'otx' ELSE 'abusech' END AS feed_name,
    NOT EXISTS (SELECT 1 FROM seen s WHERE s.value = p.value AND s.ioc_type = p.ioc_type AND s.expires > {NOW})
    AND feed_rank = min(feed_rank) OVER (PARTITION BY value, ioc_type) AS is_new
  FROM per_feed p
)"""

ALERTS = f"""
alerts AS (SELECT event_id, user_id, ts, event_type, {D.pad("event_id")} AS alert_key, {D.ALERT_SIEM} AS source_siem,
  {D.alert_raw("duck")} AS raw FROM events),
header AS (SELECT alert_key, source_siem, raw,
  CASE source_siem WHEN 'elastic' THEN raw->>'$._id' WHEN 'sentinel' THEN raw->>'$.name' ELSE raw->>'$.id' END AS alert_id,
  CASE source_siem WHEN 'elastic' THEN coalesce(raw->>'$._source."kibana.alert.rule.name"', raw->>'$._source.rule.name')
    WHEN 'sentinel' THEN raw->>'$.properties.title' ELSE raw->>'$.name' END AS alert_name,
  CASE source_siem WHEN 'elastic' THEN coalesce(lower(raw->>'$._source."kibana.alert.severity"'), 'none')
    WHEN 'sentinel' THEN lower(raw->>'$.properties.severity') ELSE 'medium' END AS severity,
  CASE WHEN source_siem = 'syslog' THEN {NOW} ELSE date_trunc('second', ts) END AS triggered_at
  FROM alerts)"""

_PATHS = [
    "source.ip", "destination.ip", "network.destination.ip", "dns.question.name", "url.domain", "url.full",
    "process.hash.sha256", "file.hash.sha256", "file.hash.md5", "host.ip", "client.ip", "server.ip",
]


def _path(p: str) -> str:
    flat, nested = f"""raw->>'$._source."{p}"'""", f"$._source.{p}"
    return (
        f"CASE WHEN coalesce({flat}, '') <> '' THEN [{flat}] "
        f"WHEN json_type(raw, '{nested}') = 'ARRAY' THEN json_extract_string(raw, '{nested}[*]') "
        f"WHEN json_extract_string(raw, '{nested}') IS NOT NULL THEN [json_extract_string(raw, '{nested}')] ELSE [] END"
    )


def path_list(paths: list[str]) -> str:
    return "list_transform(flatten([" + ", ".join(_path(p) for p in paths) + "]), lambda x: trim(x))"


PATH_LIST = path_list(_PATHS)
PREFIX_LIST = (
    "list_transform(list_filter(json_keys(raw, '$._source'), lambda k: regexp_matches(k, '^(source|destination|dns|url|file|process)\\.') "
    "AND json_type(raw, '$._source.\"' || k || '\"') = 'VARCHAR'), lambda k: trim(json_extract_string(raw, '$._source.\"' || k || '\"')))"
)


def tokens(text: str) -> str:
    """IPv4-shaped, sha256 and md5 tokens. Letters and digits beyond ASCII are word characters, as in Unicode."""
    t = f"regexp_replace(regexp_replace({text}, '[^\\x00-\\x7F\\p{{L}}\\p{{M}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
    return (
        f"list_concat(list_concat(regexp_extract_all({t}, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b'), "
        f"list_transform(regexp_extract_all({t}, '\\b[0-9a-fA-F]{{64}}\\b'), lambda x: lower(x))), "
        f"list_transform(regexp_extract_all({t}, '\\b[0-9a-fA-F]{{32}}\\b'), lambda x: lower(x)))"
    )


ENTITY_LIST = (
    "list_filter(flatten([json_extract_string(raw, '$.properties.entities[*].address'), "
    "json_extract_string(raw, '$.properties.entities[*].domainName'), json_extract_string(raw, '$.properties.entities[*].url'), "
    "json_extract_string(raw, '$.properties.entities[*].md5'), json_extract_string(raw, '$.properties.entities[*].sha1'), "
    "json_extract_string(raw, '$.properties.entities[*].sha256'), "
    "json_extract_string(raw, '$.properties.entities[*].fileHashes[*].hashValue'), "
    "list_filter(json_extract_string(raw, '$.properties.entities[*].fileHashes[*]'), lambda x: x NOT LIKE '{%')]), "
    "lambda x: x IS NOT NULL)"
)
GENERIC_LIST = (
    "[raw->>'$.id', raw->>'$.name', raw->>'$.a', raw->>'$.b.c', raw->>'$.b.d[0].e', raw->>'$.b.d[1]', raw->>'$.b.f.g.h.i.j']"
)
CANDIDATES = f"""{ALERTS},
found AS (SELECT header.*, CASE source_siem
    WHEN 'elastic' THEN list_concat(list_concat({PATH_LIST}, {PREFIX_LIST}), {tokens("raw")})
    WHEN 'sentinel' THEN {ENTITY_LIST} ELSE {GENERIC_LIST} END AS vals FROM header),
cand AS (SELECT DISTINCT alert_key, source_siem, value FROM (SELECT alert_key, source_siem, unnest(vals) AS value FROM found)
  WHERE {valid("value")})"""

STORE = f"""
attrs AS (
  SELECT concat('c', c_custkey, '-', e.pos) AS attribute_id, concat('ev-', {D.STORE_FEED}) AS event_id,
    concat({D.STORE_FEED}, ' — 2024-01-', 10 + c_nationkey) AS event_info, e.kind AS type, e.value AS value,
    concat('Seen with ', c_name) AS comment,
    CASE c_mktsegment WHEN 'BUILDING' THEN ['threat-actor:APT28', 'Emotet']
      WHEN 'MACHINERY' THEN ['misp-galaxy:threat-actor="Lazarus Group"', 'captcha']
      ELSE ['Threat-Actor:Mixed', 'tlp:red'] END AS tags, c_custkey * 10 + e.pos AS seq
  FROM (SELECT *, unnest([
      {{'kind': 'comment', 'value': {D.ip(D.STORE_KEY)}, 'pos': 0}}, {{'kind': 'ip-dst', 'value': {D.ip(D.STORE_KEY)}, 'pos': 1}},
      {{'kind': 'domain', 'value': lower({D.dom(D.STORE_KEY)}), 'pos': 2}}, {{'kind': 'url', 'value': {D.url(D.STORE_KEY)}, 'pos': 3}},
      {{'kind': 'sha256', 'value': {D.sha256(D.STORE_KEY, "duck")}, 'pos': 4}}, {{'kind': 'md5', 'value': {D.md5(D.STORE_KEY)}, 'pos': 5}}
    ]) AS e FROM customer)
  UNION ALL
  SELECT concat('o', o_orderkey), 'ev-manual', 'Manual import', 'url', {D.url(D.ORDER_KEY)}, NULL,
    [concat('prio:', o_orderpriority), 'lazarus-group'], 1000000000000 + o_orderkey
  FROM orders
),
known AS (SELECT * FROM attrs WHERE type IN ('ip-dst', 'domain', 'url', 'md5', 'sha256', 'sha1', 'email-src', 'filename')
  QUALIFY row_number() OVER (PARTITION BY value ORDER BY seq, attribute_id) = 1),
all_tags AS (SELECT value, list_sort(list(DISTINCT tag)) AS tags FROM (SELECT value, unnest(tags) AS tag FROM attrs) GROUP BY value),
hits AS (SELECT k.value, k.type AS ioc_type,
    CASE WHEN contains(event_info, ' — ') THEN split_part(event_info, ' — ', 1) ELSE 'misp' END AS source_feed,
    t.tags AS tags, coalesce(comment, '') AS description, attribute_id, event_id
  FROM known k JOIN all_tags t ON k.value = t.value)"""

RESULTS = f"""
vt_land AS (SELECT i.value AS ioc_value, i.kind AS ioc_type,
    CASE c_custkey % 10 WHEN 0 THEN 404 WHEN 1 THEN 429 ELSE 200 END AS status, c_custkey % 60 AS mal, c_custkey % 7 AS sus,
    c_custkey % 90 AS harm, c_custkey % 5 AS und, CASE WHEN c_nationkey > 5 THEN c_nationkey END AS rep,
    CASE WHEN c_acctbal > 0 THEN concat('trojan.', lower(c_mktsegment)) END AS label
  FROM (SELECT *, unnest([{{'value': {D.ip("c_custkey")}, 'kind': 'ip-dst'}}, {{'value': {D.url("c_custkey")}, 'kind': 'url'}}]) AS i FROM customer)),
vt AS (SELECT 'virustotal' AS source, ioc_value, ioc_type, status = 200 AS found,
    CAST(CASE WHEN status = 200 AND mal + sus + harm + und > 0 THEN
      round_even((mal::DOUBLE + sus::DOUBLE * 0.5::DOUBLE) / (mal + sus + harm + und) * 100.0::DOUBLE, 0) END AS INTEGER) AS malicious_score,
    CASE WHEN status = 404 THEN 'Not found in VirusTotal' ELSE concat_ws(' · ', concat(mal, '/', mal + sus + harm + und, ' engines flagged malicious'),
      'label=' || label, 'reputation=' || rep) END AS summary,
    CASE WHEN status = 200 THEN concat('https://www.virustotal.com/gui/', CASE ioc_type WHEN 'url' THEN
      concat('url/', rtrim(translate(base64(encode(ioc_value)), '+/', '-_'), '=')) ELSE concat('ip-address/', ioc_value) END) END AS link
  FROM vt_land WHERE status IN (200, 404)),
sh_land AS (SELECT {D.ip("s_suppkey")} AS ioc_value, CASE WHEN s_acctbal < 500 THEN 404 ELSE 200 END AS status,
    len(list_distinct([443, 22, s_suppkey % 100, 22])) AS ports,
    CASE s_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS vulns,
    CASE WHEN s_nationkey > 12 THEN s_name ELSE 'isp-x' END AS org,
    CASE WHEN s_nationkey < 20 THEN concat('Nation ', s_nationkey) END AS country, s_nationkey % 4 = 0 AS risky FROM supplier),
sh AS (SELECT 'shodan' AS source, ioc_value, 'ip-dst' AS ioc_type, status = 200 AS found,
    CAST(CASE WHEN status = 200 THEN nullif(greatest(CASE WHEN vulns > 0 THEN 40 + vulns * 10 ELSE 0 END, CASE WHEN risky THEN 80 ELSE 0 END), 0) END AS INTEGER) AS malicious_score,
    CASE WHEN status = 404 THEN 'No Shodan data for this host' ELSE concat_ws(' · ', concat(ports, ' open ports'),
      CASE WHEN vulns > 0 THEN concat(vulns, ' CVEs') END, org, country) END AS summary,
    CASE WHEN status = 200 THEN 'https://www.shodan.io/host/' || ioc_value END AS link
  FROM sh_land),
results AS (SELECT * FROM (SELECT * FROM vt UNION ALL SELECT * FROM sh)
  QUALIFY row_number() OVER (PARTITION BY source, ioc_value, ioc_type ORDER BY found DESC, malicious_score DESC NULLS LAST, summary, link) = 1)"""


def recency(last: str, now: str = NOW) -> str:
    h = f"(datediff('microsecond', {last}, {now})::DOUBLE / 1000000.0::DOUBLE / 3600.0::DOUBLE)"
    return (
        f"CASE WHEN {h} <= 24 THEN 100.0::DOUBLE WHEN {h} <= 72 THEN 90.0::DOUBLE WHEN {h} <= 168 THEN 75.0::DOUBLE "
        f"WHEN {h} <= 720 THEN greatest(0.0::DOUBLE, 75.0::DOUBLE - ({h} - 168.0::DOUBLE) / 552.0::DOUBLE * 75.0::DOUBLE) ELSE 0.0::DOUBLE END"
    )


SIGNALS = (
    "['apt', 'apt28', 'apt29', 'apt30', 'apt32', 'apt33', 'apt34', 'apt38', 'lazarus', 'cozy bear', 'fancy bear', 'carbanak', "
    "'fin7', 'ta505', 'emotet', 'trickbot', 'ryuk', 'darkside', 'revil', 'conti']"
)


def signal(tags: str) -> str:
    n = f"len(list_intersect(list_transform({tags}, lambda x: lower(x)), {SIGNALS}))"
    return f"least(20.0::DOUBLE, {n}::DOUBLE * 7.0::DOUBLE)"


def score(feed: str, kind: str, level: str, conf: str, last: str, tags: str) -> str:
    cred = (
        f"CASE {feed} WHEN 'abusech_malware' THEN 95.0::DOUBLE WHEN 'threatfox' THEN 85.0::DOUBLE WHEN 'abusech_url' THEN 75.0::DOUBLE "
        f"WHEN 'otx' THEN 65.0::DOUBLE ELSE 60.0::DOUBLE END"
    )
    weight = (
        f"CASE {kind} WHEN 'sha256' THEN 1.0::DOUBLE WHEN 'md5' THEN 0.95::DOUBLE WHEN 'sha1' THEN 0.95::DOUBLE WHEN 'ip-dst' THEN 0.8::DOUBLE "
        f"WHEN 'domain' THEN 0.75::DOUBLE WHEN 'url' THEN 0.7::DOUBLE WHEN 'filename' THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END"
    )
    mult = f"CASE {level} WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.75::DOUBLE WHEN 'low' THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END"
    base = f"(0.3::DOUBLE * ({recency(last)}) + 0.4::DOUBLE * {conf}::DOUBLE + 0.3::DOUBLE * {cred})"
    return f"CAST(printf('%.2f', least(100.0::DOUBLE, greatest(0.0::DOUBLE, {base} * {weight} * {mult} + {signal(tags)}))) AS DOUBLE)"


MATCHED = f"""{CANDIDATES},{STORE},
matched AS (SELECT c.alert_key, c.source_siem, h.*, {score("h.source_feed", "h.ioc_type", "'unknown'", "75", NOW, "h.tags")} AS threat_score
  FROM cand c JOIN hits h ON c.value = h.value)"""


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"
