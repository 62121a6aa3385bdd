"""Lookups in the indicator store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import empty_strings, strip
from iocweave.operators.dedup import keep_first

ATTRIBUTE_COLUMNS = ["attribute_id", "event_id", "event_info", "type", "value", "comment", "tags", "seq"]


def skew_join(rows: DataFrame, index: DataFrame, keys: list[str], how: str = "inner", parts: int | None = None) -> DataFrame:
    """Join rows, in which a key may be very frequent, to an index with unique keys.

    The engine splits a skewed partition at run time only if both sides of the join come straight from an exchange.
    An index is an aggregate on the same keys and would be joined without one, so a digest of the keys is joined
    too: it changes no result, but the aggregate is not partitioned by it, and gets its own exchange. A side small
    enough to broadcast is still broadcast. With ``parts`` the digest is less than that, and packs better.
    """
    digest = F.xxhash64(*keys) if parts is None else F.pmod(F.xxhash64(*keys), F.lit(parts))
    return (
        rows.withColumn("_digest", digest).join(index.withColumn("_digest", digest), [*keys, "_digest"], how).drop("_digest")
    )


def feed_of_event(event_info: Column) -> Column:
    """Feed name in an event title, or the store itself."""
    return F.when(
        event_info.contains(K.EVENT_SEPARATOR), F.substring_index(event_info, K.EVENT_SEPARATOR, 1)
    ).otherwise(K.DEFAULT_FEED)


def known_attributes(attributes: DataFrame) -> DataFrame:
    return attributes.filter(F.col("type").isin(K.IOC_TYPES) & (F.col("value") != ""))


def lookup_bulk(values: DataFrame, attributes: DataFrame) -> DataFrame:
    """All attributes of many values in one equi-join; a value with very many attributes is split over tasks."""
    return skew_join(attributes, values.select("value").distinct(), ["value"]).select("value", *[c for c in attributes.columns if c != "value"])


def index_states(attributes: DataFrame) -> DataFrame:
    """(value, place, first, tags) per value: its first attribute of a known type and where that stands (null if there is
    none), and all tags of the value, sorted. Two states of a value merge into one.

    One aggregate on the value. Both parts combine before the exchange, so a value with very many attributes
    sends at most one row per task.
    """
    known = F.col("type").isin(K.IOC_TYPES) & (F.col("value") != "")
    stored = [c for c in STORED if c in attributes.columns]
    first = F.struct(*[c for c in ATTRIBUTE_COLUMNS if c not in ("tags", "seq", "value")], *stored)
    place = F.when(known, F.struct("seq", "attribute_id"))
    return (
        attributes.select("*", F.explode_outer("tags").alias("tag"))
        .groupBy("value")
        .agg(F.min(place).alias("place"), F.min_by(first, place).alias("first"), F.sort_array(F.collect_set("tag")).alias("tags"))
    )


STORED = ("threat_level", "confidence", "first_seen", "last_seen", "attack_techniques")


def slim(attributes: DataFrame, *keep: str) -> DataFrame:
    """The store for a caller that reads ``keep`` of a match only, so that other texts move through no exchange.

    What orders and names the attributes of a value stays, so the matches are the same ones.
    """
    none = F.lit(None).cast("string")
    blank = {"event_id": none, "comment": none, "tags": empty_strings()}
    rows = attributes.drop(*[c for c in STORED if c not in keep])
    return rows.withColumns({c: value for c, value in blank.items() if c not in keep})


def match_index(attributes: DataFrame) -> DataFrame:
    """One row per value with an attribute of a known type: the first of these, and all tags of the value, sorted.

    Computed from the whole store; ``keptindex.KeptIndex`` keeps the same rows from run to run.
    """
    return index_states(attributes).filter("first IS NOT NULL").select("value", "first", "tags")


def constants(now: Column, match_mode: str = "reference") -> dict[str, Column]:
    """What every match has alike in this mode."""
    if match_mode == "stored":
        return {}
    return {
        "threat_level": F.lit("unknown"),
        "confidence": F.lit(75),
        "first_seen": now,
        "last_seen": now,
        "attack_techniques": empty_strings(),
    }


def index_as_iocs(index: DataFrame, now: Column, match_mode: str = "reference") -> DataFrame:
    """Indicator rows of the match index.

    ``reference``: a match gets level unknown, confidence 75 and the current time.
    ``stored``: the values of the attribute itself, where the store keeps them.
    """
    f = F.col("first")
    values = constants(now)
    if match_mode == "stored":
        fields = index.schema["first"].dataType.names
        values = {k: F.coalesce(f[k], c) if k in fields else c for k, c in values.items()}
    return index.select(
        "value",
        f["type"].alias("ioc_type"),
        feed_of_event(f["event_info"]).alias("source_feed"),
        values["threat_level"].alias("threat_level"),
        "tags",
        F.coalesce(f["comment"], F.lit("")).alias("description"),
        values["first_seen"].alias("first_seen"),
        values["last_seen"].alias("last_seen"),
        values["confidence"].cast("int").alias("confidence"),
        f["event_id"].alias("event_id"),
        f["attribute_id"].alias("attribute_id"),
        values["attack_techniques"].alias("attack_techniques"),
    )


def match_candidates(
    candidates: DataFrame, attributes: DataFrame, now: Column, match_mode: str = "reference", index: DataFrame | None = None
) -> DataFrame:
    """At most one match per (alert, value). ``index`` (of a kept index) takes the place of the store."""
    iocs = index_as_iocs(match_index(attributes) if index is None else index, now, match_mode)
    return skew_join(candidates, iocs, ["value"])


def _tag_order(attributes: DataFrame) -> DataFrame:
    """One row per (value, tag) with its first position; a hot value is spread over its tags."""
    tags = attributes.select("value", "seq", F.posexplode("tags").alias("pos", "tag"))
    return tags.groupBy("value", "tag").agg(F.min(F.struct("seq", "pos")).alias("at"))


def ioc_context(attributes: DataFrame) -> DataFrame:
    """Per value: attribute count, events, tags, actors, campaigns and feeds.

    Tags and events are made distinct per value before they are gathered. The attributes themselves stay rows
    (``lookup_bulk``): their number per value has no bound.
    """
    tag, ordered = F.col("tag"), F.sort_array(F.collect_list(F.struct("at", "tag")))
    is_actor = tag.startswith(K.ACTOR_PREFIX)
    is_campaign = ~is_actor & F.lower(tag).contains("threat-actor")
    names = lambda items: F.transform(items, lambda x: x["tag"])
    by_tag = (
        _tag_order(attributes)
        .groupBy("value")
        .agg(
            F.sort_array(F.collect_list("tag")).alias("tags"),
            F.sort_array(F.collect_list(F.when(is_actor, F.struct("at", "tag")))).alias("_actors"),
            F.sort_array(F.collect_list(F.when(is_campaign, F.struct("at", "tag")))).alias("_campaigns"),
        )
        .select(
            "value",
            "tags",
            F.array_distinct(
                F.transform(names(F.col("_actors")), lambda t: strip(F.replace(t, F.lit(K.ACTOR_PREFIX), F.lit(""))))
            ).alias("threat_actors"),
            names(F.col("_campaigns")).alias("campaigns"),
        )
    )
    feed = F.when(
        F.col("event_info").contains(K.EVENT_SEPARATOR),
        strip(F.substring_index("event_info", K.EVENT_SEPARATOR, 1)),
    )
    by_event = (
        attributes.groupBy("value", "event_id", "event_info")
        .agg(F.count("*").alias("n"))
        .groupBy("value")
        .agg(
            F.sum("n").alias("attribute_count"),
            F.count("*").alias("event_count"),
            F.sort_array(F.collect_set(feed)).alias("feeds"),
        )
    )
    empty = lambda c: F.coalesce(F.col(c), empty_strings()).alias(c)
    return by_event.join(by_tag, "value", "left").select(
        "value", "attribute_count", "event_count", "feeds", empty("tags"), empty("threat_actors"), empty("campaigns")
    )


def lookup_one(values: DataFrame, attributes: DataFrame, now: Column) -> DataFrame:
    """Context and first attribute of each asked value; a value that is not stored gives ``matched = false``.

    The first attribute counts only if its type is known.
    """
    asked = values.select("value").distinct()
    stored = attributes.join(asked, "value", "left_semi")
    first = keep_first(stored, ["value"], ["seq"]).filter(F.col("type").isin(K.IOC_TYPES))
    first = first.select(
        "value",
        F.struct(
            F.col("type").alias("ioc_type"),
            feed_of_event(F.col("event_info")).alias("source_feed"),
            F.lit("unknown").alias("threat_level"),
            F.lit(75).alias("confidence"),
            now.alias("last_seen"),
            F.coalesce("comment", F.lit("")).alias("description"),
            "event_id",
            "attribute_id",
        ).alias("ioc"),
    )
    context = ioc_context(stored).join(first, "value", "left").withColumn("_hit", F.lit(True))
    lists = {c: F.coalesce(F.col(c), empty_strings()) for c in ("feeds", "tags", "threat_actors", "campaigns")}
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("attribute_count", "event_count")}
    return (
        asked.join(context, "value", "left")
        .withColumns({"matched": F.coalesce("_hit", F.lit(False)), **lists, **counts})
        .drop("_hit")
    )
