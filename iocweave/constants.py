"""Vocabularies, weights and word lists that decide the results."""

# Indicator types.
IP, DOMAIN, URL = "ip-dst", "domain", "url"
MD5, SHA1, SHA256 = "md5", "sha1", "sha256"
EMAIL, FILENAME = "email-src", "filename"
IOC_TYPES = [IP, DOMAIN, URL, MD5, SHA256, SHA1, EMAIL, FILENAME]

# Threat levels and the event-level id written for each.
THREAT_LEVELS = ["high", "medium", "low", "unknown"]
THREAT_LEVEL_ID = {"high": "1", "medium": "2", "low": "3", "unknown": "4"}

# Source credibility, type weight and level multiplier used by the score.
SOURCE_CREDIBILITY = {"abusech_malware": 95.0, "threatfox": 85.0, "abusech_url": 75.0, "otx": 65.0}
DEFAULT_CREDIBILITY = 60.0
TYPE_WEIGHT = {
    SHA256: 1.0, MD5: 0.95, SHA1: 0.95, IP: 0.8,
    DOMAIN: 0.75, URL: 0.7, EMAIL: 0.6, FILENAME: 0.5,
}
DEFAULT_TYPE_WEIGHT = 0.6
LEVEL_MULTIPLIER = {"high": 1.0, "medium": 0.75, "low": 0.5, "unknown": 0.6}
DEFAULT_LEVEL_MULTIPLIER = 0.6
DEFAULT_WEIGHTS = {"recency": 0.3, "confidence": 0.4, "source": 0.3}

# Tag names that raise the score.
SIGNAL_TAGS = [
    "apt", "apt28", "apt29", "apt30", "apt32", "apt33", "apt34", "apt38",
    "lazarus", "cozy bear", "fancy bear", "carbanak", "fin7", "ta505",
    "emotet", "trickbot", "ryuk", "darkside", "revil", "conti",
]

# Substrings that make a tag an actor when tags are written back.
ACTOR_SUBSTRINGS = ["apt", "lazarus", "carbanak", "fin7", "ta505"]

# Names refused as a domain or as its last label.
INTERNAL_DOMAINS = [
    "localhost", "local", "internal", "corp", "lan", "home",
    "example.com", "example.org", "example.net", "test", "invalid",
]

# Hash lengths and the digests of empty input.
HASH_LENGTH = {MD5: 32, SHA1: 40, SHA256: 64}
EMPTY_DIGESTS = [
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
]

# Feed vocabularies.
OTX_TYPES = {
    "IPv4": IP, "IPv6": IP, "domain": DOMAIN, "hostname": DOMAIN, "URL": URL,
    "FileHash-MD5": MD5, "FileHash-SHA256": SHA256, "FileHash-SHA1": SHA1, "email": EMAIL,
}
TLP_LEVELS = {"red": "high", "amber": "medium", "green": "low", "white": "low"}
CSV_TYPES = {"ip": IP, "domain": DOMAIN, "url": URL, "md5": MD5, "sha256": SHA256, "sha1": SHA1}

# Address blocks refused for an indicator (IANA special-purpose registries), and the exceptions inside them.
# IPv4, as a pattern on a valid dotted quad: 0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.0.0/24 without .9 and
# .10, 192.0.2/24, 192.168/16, 198.18/15, 198.51.100/24, 203.0.113/24, 224/4 and 240/4.
V4_REFUSED = (
    r"(?:(?:0|10|127)\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.0\.0\.(?!(?:9|10)\z)|192\.0\.2\."
    r"|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\.)"
)
V6_REFUSED = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32",
    "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3",
    "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
]
V6_REFUSED_EXCEPT = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]

# Address blocks refused for a candidate found in an alert (a shorter list than the one above): 10/8, 172.16/12,
# 192.168/16, 127/8, 169.254/16, 224/4, 240/4 and 0.0.0.0.
V4_CANDIDATE_REFUSED = (
    r"(?:(?:10|127)\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\."
    r"|(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|0\.0\.0\.0\z)"
)
CANDIDATE_REFUSED = ["0.0.0.0", "255.255.255.255", "localhost"]

# Alert fields read by name, in order, and the flat-key prefixes always read.
ALERT_PATHS = [
    "source.ip", "destination.ip", "network.destination.ip", "dns.question.name", "url.domain", "url.full",
    "process.hash.sha256", "file.hash.sha256", "file.hash.md5", "host.ip", "client.ip", "server.ip",
]
ALERT_PREFIXES = ["source.", "destination.", "dns.", "url.", "file.", "process."]
SEARCH_PATHS = [
    "source.ip", "destination.ip", "dns.question.name", "url.domain", "url.full",
    "process.hash.sha256", "file.hash.sha256", "file.hash.md5",
]
ENTITY_FIELDS = ["address", "domainName", "url", "md5", "sha1", "sha256"]
GENERIC_LEVELS = 6

# Reputation providers: the types each one answers for, and report-link parts.
PROVIDER_TYPES = {"virustotal": [IP, DOMAIN, URL, MD5, SHA1, SHA256], "shodan": [IP]}
PROVIDER_ORDER = ["virustotal", "shodan"]
VT_LINK_KIND = {IP: "ip-address", DOMAIN: "domain", URL: "url", MD5: "file", SHA1: "file", SHA256: "file"}
VT_LINK = "https://www.virustotal.com/gui/"
SHODAN_LINK = "https://www.shodan.io/host/"
RISKY_HOST_TAGS = ["malware", "compromised", "honeypot"]
MALICIOUS_FROM = 50

# Text written into tags, events and documents.
TAG_NAMESPACE = "tip"
EVENT_SEPARATOR = " — "
ACTOR_PREFIX = "threat-actor:"
GALAXY_ACTOR = "misp-galaxy:threat-actor"
DEFAULT_FEED = "misp"
NOTIFY_ON = ["high", "critical"]

# Icons of the notification text.
SEVERITY_ICON = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}
SIEM_ICON = {"sentinel": "☁️", "elastic": "🔍"}
PROVIDER_ICON = {"virustotal": "🧬", "shodan": "📡"}

# Characters removed by a whitespace strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
