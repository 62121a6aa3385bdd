"""Alert enrichment: everything computed per alert from its matches and reputation results.

The per-alert functions are column expressions over two arrays of the alert row, ``matched_iocs`` (highest score
first) and ``external``. Both are bounded by the alert document.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import empty_strings, strip
from iocweave.functions.norm import infer_ioc_type
from iocweave.operators import external as X
from iocweave.operators import match
from iocweave.operators.score import threat_score

NS = K.TAG_NAMESPACE
MATCH_TYPE = (
    "array<struct<value:string,ioc_type:string,source_feed:string,threat_level:string,tags:array<string>,"
    "description:string,first_seen:timestamp_ntz,last_seen:timestamp_ntz,confidence:int,event_id:string,"
    "attribute_id:string,attack_techniques:array<string>,threat_score:double>>"
)
EXTERNAL_TYPE = (
    "array<struct<source:string,ioc_value:string,found:boolean,malicious_score:int,summary:string,link:string>>"
)


def _tags_of(matches: Column) -> Column:
    return F.flatten(F.transform(matches, lambda m: m["tags"]))


def _without_prefix(tag: Column) -> Column:
    # The prefix is removed only in lower case, although it is found in any case.
    return strip(F.replace(tag, F.lit(K.ACTOR_PREFIX), F.lit("")))


def alert_actors(matches: Column) -> Column:
    tags = F.filter(_tags_of(matches), lambda t: F.lower(t).contains(K.ACTOR_PREFIX))
    return F.array_distinct(F.transform(tags, _without_prefix))


def alert_campaigns(matches: Column) -> Column:
    tags = F.filter(
        _tags_of(matches),
        lambda t: ~F.lower(t).contains(K.ACTOR_PREFIX) & F.lower(t).contains(K.GALAXY_ACTOR),
    )
    name = lambda t: F.trim(F.substring_index(t, "=", -1), F.lit('"'))
    return F.array_distinct(F.transform(tags, name))


def alert_techniques(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(matches, lambda m: m["attack_techniques"]))))


def _prefixed(kind: str, values: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(values)), lambda x: F.concat(F.lit(f"{NS}:{kind}:"), x))


def tag_actors(matches: Column) -> Column:
    """Actor names for write-back: prefixed tags, and tags that contain a known group name."""
    tag = F.lower
    known = lambda t: reduce(lambda a, b: a | b, [tag(t).contains(k) for k in K.ACTOR_SUBSTRINGS])
    named = F.transform(
        _tags_of(matches),
        lambda t: F.when(tag(t).startswith(K.ACTOR_PREFIX), _without_prefix(t)).when(known(t), strip(t)),
    )
    return F.filter(named, lambda t: t.isNotNull())


def enrichment_tags(matches: Column) -> Column:
    field = lambda name: F.transform(matches, lambda m: m[name])
    tags = F.concat(
        F.array(F.lit(f"{NS}:matched")),
        _prefixed("feed", field("source_feed")),
        _prefixed("actor", tag_actors(matches)),
        _prefixed("ioc-type", field("ioc_type")),
        _prefixed("attack", alert_techniques(matches)),
    )
    return F.when(F.size(matches) > 0, tags).otherwise(empty_strings())


def external_tags(results: Column) -> Column:
    found = F.filter(results, lambda r: r["found"])
    verdict = lambda r: F.when(X.is_malicious(r["malicious_score"]), "malicious").otherwise("seen")
    return F.transform(found, lambda r: F.concat(F.lit(f"{NS}:"), r["source"], F.lit(":"), verdict(r)))


def risk_score(matches: Column, results: Column) -> Column:
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["threat_score"])), F.lit(0.0))
    worst = F.coalesce(F.array_max(F.transform(results, lambda r: r["malicious_score"])), F.lit(0))
    return F.greatest(best, worst.cast("double"))


def top_ioc(matches: Column) -> Column:
    """The match with the highest confidence, the first one on ties."""
    best = F.array_max(F.transform(matches, lambda m: m["confidence"]))
    return F.get(F.filter(matches, lambda m: m["confidence"] == best), F.lit(0))


def notify_gates(matches: Column, results: Column, severity: Column, notify_on: list[str]) -> dict[str, Column]:
    """Both gates of a notification. The second one also asks for a match, so it decides."""
    qualifies = F.lower(severity).isin([s.lower() for s in notify_on])
    malicious = F.exists(results, lambda r: X.is_malicious(r["malicious_score"]))
    has_match = F.size(matches) > 0
    enricher, notifier = (has_match | malicious) & qualifies, has_match & qualifies
    return {"gate_enricher": enricher, "gate_notifier": notifier, "should_notify": enricher & notifier}


HEADER = ("alert_id", "source_siem", "alert_name", "severity", "triggered_at", "extracted_iocs")


# What a match and a result move through the exchanges: all fields but the value, which stands beside them once.
MATCH_FIELDS = (
    "ioc_type", "source_feed", "threat_level", "tags", "description", "first_seen", "last_seen", "confidence", "event_id",
    "attribute_id", "attack_techniques", "threat_score",
)
RESULT_FIELDS = ("source", "found", "malicious_score", "summary", "link")


def _scored_index(
    index: DataFrame, results: DataFrame | None, now: Column, match_mode: str, weights: Mapping[str, float], unmatched: bool
) -> DataFrame:
    """Per value: the scored match without its constants, and the results of its type. Built once, whatever the number of alerts."""
    iocs = match.index_as_iocs(index, now, match_mode)
    names = ["source_feed", "ioc_type", "threat_level", "confidence", "last_seen", "tags"]
    score = threat_score(*[F.col(n) for n in names], now, weights)
    carried = [f for f in MATCH_FIELDS[:-1] if f not in match.constants(now, match_mode)]
    index = iocs.select("value", F.struct(*carried, score.alias("threat_score")).alias("hit"))
    if results is None:
        return index.withColumn("ext", F.lit(None).cast("array<struct<source:string>>"))
    index = index.join(X.results_per_value(results), "value", "full" if unmatched else "left")
    kind = F.coalesce(F.col("hit.ioc_type"), infer_ioc_type(F.col("value"))) if unmatched else F.col("hit.ioc_type")
    index = index.withColumn("results", F.filter("results", lambda r: r["ioc_type"] == kind))
    ext = F.transform("results", lambda r: F.struct(*[r[f].alias(f) for f in RESULT_FIELDS]))
    return index.select("value", "hit", F.when(F.size("results") > 0, ext).alias("ext"))


def _found(alerts: DataFrame, index: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """A row with the header for each alert, and what its candidates hit, in that row or in rows beside it."""
    fanned = alerts.select("alert_key", *header, F.posexplode_outer(F.col("extracted_iocs")).alias("_pos", "value"))
    first = F.coalesce("_pos", F.lit(0)) == 0
    pairs = fanned.select(
        "alert_key",
        first.alias("_first"),
        *[F.when(first, F.col(c)).alias(c) for c in header],
        # An alert without candidates joins to nothing, but must not share one key with all others of its kind.
        F.coalesce("value", F.concat(F.lit("\u0000"), "alert_key")).alias("value"),
    )
    joined = match.skew_join(pairs, index, ["value"], "left", parts=251)
    found = F.col("hit").isNotNull() | F.col("ext").isNotNull()
    return joined.filter(F.col("_first") | found).select(
        "alert_key", "_first", *header, F.when(found, F.col("value")).alias("value"), "hit", "ext"
    )


def _found_twice(alerts: DataFrame, index: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """The same of alerts that are read twice, the header in rows of its own."""
    pairs = alerts.select("alert_key", F.explode("extracted_iocs").alias("value"))
    found = F.col("hit").isNotNull() | F.col("ext").isNotNull()
    hits = match.skew_join(pairs, index, ["value"], parts=251).filter(found).select("alert_key", F.lit(False).alias("_first"), "value", "hit", "ext")
    heads = alerts.select("alert_key", F.lit(True).alias("_first"), *header)
    return heads.unionByName(hits, allowMissingColumns=True)


def enriched_alerts(
    alerts: DataFrame,
    attributes: DataFrame | None,
    now: Column,
    results: DataFrame | None = None,
    notify_on: list[str] = K.NOTIFY_ON,
    match_mode: str = "reference",
    weights: Mapping[str, float] = K.DEFAULT_WEIGHTS,
    enrich_unmatched: bool = False,
    index: DataFrame | None = None,
    header: tuple[str, ...] = HEADER,
    at_hand: bool = False,
) -> DataFrame:
    """The full enriched row of every alert.

    ``alerts`` has the header and ``extracted_iocs``. The store is given by its ``attributes``, or by rows of a kept
    ``index``, of which the values of these alerts are enough. Alerts are read once. Each is fanned out to its candidates,
    with the header on the first candidate only; after the join on the value, candidates that hit nothing go,
    and one aggregate puts the alert together. ``header`` names what is carried of it; the gates read the severity. So there
    are two exchanges, on narrow rows, and no second scan. The second one moves rows, not lists of them, as few rows of an
    alert meet before it. Header fields are columns of their own: those that no caller reads move through neither.
    Alerts ``at_hand`` (a table, whose scan costs little) are read twice instead, and no header moves through the first one.
    """
    index = _scored_index(match.match_index(attributes) if index is None else index, results, now, match_mode, weights, enrich_unmatched)
    kept = _found_twice(alerts, index, header) if at_hand else _found(alerts, index, header)
    # Sorted by falling score, then value; unmatched values follow the matched ones in external results.
    hit = F.col("hit")
    neg = (-hit["threat_score"]).alias("neg")
    by_score = F.struct(neg, "value", hit)
    by_match = F.struct(hit.isNull().alias("late"), neg, "value", "ext")
    gathered = kept.repartition("alert_key").groupBy("alert_key").agg(
        # A struct, because the first of an alert's rows counts even where its field is null.
        *[F.first(F.when(F.col("_first"), F.struct(c)), ignorenulls=True).alias(c) for c in header],
        F.sort_array(F.collect_list(F.when(hit.isNotNull(), by_score))).alias("_m"),
        F.sort_array(F.collect_list(F.when(F.col("ext").isNotNull(), by_match))).alias("_x"),
    )
    constant = match.constants(now, match_mode)
    field = lambda m, f: (constant[f] if f in constant else m["hit"][f]).alias(f)
    matched = lambda m: F.struct(m["value"].alias("value"), *[field(m, f) for f in MATCH_FIELDS])
    if results is None:
        external = F.array().cast(EXTERNAL_TYPE)
    else:
        result = lambda x, r: F.struct(
            r["source"].alias("source"), x["value"].alias("ioc_value"), *[r[f].alias(f) for f in RESULT_FIELDS[1:]]
        )
        external = F.flatten(F.transform("_x", lambda x: F.transform(x["ext"], lambda r: result(x, r))))
    arrays = gathered.select(
        "alert_key",
        *[F.col(c)[c].alias(c) for c in header],
        F.transform("_m", matched).cast(MATCH_TYPE).alias("matched_iocs"),
        external.alias("external"),
    )
    return finish_alerts(arrays, notify_on)


def finish_alerts(arrays: DataFrame, notify_on: list[str] = K.NOTIFY_ON) -> DataFrame:
    """Add every derived column to alerts with ``matched_iocs`` and ``external``."""
    m, x = F.col("matched_iocs"), F.col("external")
    return arrays.withColumns(
        {
            "threat_actors": alert_actors(m),
            "campaigns": alert_campaigns(m),
            "attack_techniques": alert_techniques(m),
            "enrichment_tags": F.concat(enrichment_tags(m), external_tags(x)),
            "risk_score": risk_score(m, x),
            **notify_gates(m, x, F.col("severity"), notify_on),
        }
    )


def cycle_summary(enriched: DataFrame) -> DataFrame:
    """Counts of one enrichment cycle."""
    siem = F.col("source_siem")
    return enriched.agg(
        F.count_if(siem == "elastic").alias("elastic"),
        F.count_if(siem == "sentinel").alias("sentinel"),
        F.count("*").alias("total"),
        F.count_if(F.size("matched_iocs") > 0).alias("matched"),
        F.count_if(F.col("should_notify")).alias("notified"),
    )
