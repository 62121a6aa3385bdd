"""Schemas of the landed feeds and of the tables the library reads and writes."""

ORD = (
    "struct<feed_rank:int,subfeed_rank:int,fetch_id:string,record_pos:bigint,element_pos:int,emit_rank:int>"
)

IOCS = (
    "value string, ioc_type string, source_feed string, threat_level string, tags array<string>, "
    "description string, first_seen timestamp_ntz, last_seen timestamp_ntz, confidence int, "
    f"pulse_id string, attack_techniques array<string>, raw string, ord {ORD}"
)

SEEN = "value string, ioc_type string, first_seen timestamp_ntz, expires timestamp_ntz"

IOC_ATTRIBUTES = (
    "attribute_id string, event_id string, event_info string, type string, value string, comment string, "
    "to_ids boolean, tags array<string>, seq bigint"
)

ALERTS = "alert_key string, source_siem string, raw string"

EXTERNAL = (
    "source string, ioc_value string, ioc_type string, found boolean, malicious_score int, "
    "summary string, details string, link string"
)

FEED_RUNS = (
    "feed_name string, started_at timestamp_ntz, finished_at timestamp_ntz, total_fetched bigint, "
    "new_iocs bigint, duplicate_iocs bigint, stored bigint, errors bigint, error_details array<string>"
)

OTX = (
    "results array<struct<id:string,name:string,TLP:string,tags:array<string>,adversary:string,"
    "created:string,modified:string,attack_ids:array<string>,references:array<variant>,"
    "pulse_source:variant,"
    "indicators:array<struct<type:string,indicator:string,description:string>>>>"
)

MALWARE = (
    "query_status string, data array<struct<sha256_hash:string,md5_hash:string,file_name:string,"
    "signature:string,file_type:string,tags:array<string>,first_seen:string,last_seen:string>>"
)

URLS = (
    "urls array<struct<id:string,url:string,host:string,threat:string,tags:array<string>,date_added:string>>"
)

THREATFOX = (
    "query_status string, data array<struct<id:string,ioc:string,ioc_type:string,malware:string,"
    "malware_alias:string,confidence_level:int,tags:array<string>,first_seen:string,last_seen:string>>"
)

CSV = "value string, type string, threat_level string, description string, tags string"

VT = (
    "ioc_value string, ioc_type string, status int, malicious int, suspicious int, harmless int, "
    "undetected int, reputation int, threat_label string, names array<string>"
)

SHODAN = (
    "ioc_value string, status int, ports array<int>, vulns array<string>, hostnames array<string>, "
    "org string, isp string, country_name string, os string, tags array<string>"
)
