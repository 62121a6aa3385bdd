"""Mappings from feed vocabularies, and feed time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import choose

_FEED_TIME_RE = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{1,2}:\d{1,2})?\z"
_ISO_TIME_RE = (
    r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?\z"
)


def map_threatfox_type(raw_type: Column) -> Column:
    table = {"ip:port": K.IP, "domain": K.DOMAIN, "url": K.URL, "md5_hash": K.MD5, "sha256_hash": K.SHA256}
    return choose(raw_type, table)


def map_threatfox_value(raw_type: Column, value: Column) -> Column:
    return (
        F.when(raw_type == "ip:port", F.substring_index(value, ":", 1))
        .when(raw_type.isin("md5_hash", "sha256_hash"), F.lower(value))
        .otherwise(value)
    )


def map_otx_type(raw_type: Column) -> Column:
    return choose(raw_type, K.OTX_TYPES)


def map_tlp_level(tlp: Column) -> Column:
    return choose(F.lower(F.coalesce(tlp, F.lit("white"))), K.TLP_LEVELS, "unknown")


def level_from_confidence(confidence: Column) -> Column:
    return F.when(confidence >= 75, "high").when(confidence >= 50, "medium").otherwise("low")


def clamp_confidence(confidence: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), confidence)).cast("int")


def otx_confidence(pulse_source: Column) -> Column:
    """Indicator count of an object, clamped; 50 if it has none; 70 if the source is no object."""
    is_object = F.schema_of_variant(pulse_source).startswith("OBJECT")
    count = F.coalesce(F.try_variant_get(pulse_source, "$.indicator_count", "double"), F.lit(50.0))
    whole = F.least(F.lit(100.0), F.greatest(F.lit(0.0), count)).cast("int")
    return F.when(pulse_source.isNull(), 50).when(is_object, whole).otherwise(70)


def parse_feed_datetime(text: Column, now: Column) -> Column:
    """One of three date forms, else ``now``."""
    parsed = F.when(text.rlike(_FEED_TIME_RE), text.try_cast("timestamp_ntz"))
    return F.coalesce(parsed, now)


def parse_iso_drop_tz(text: Column) -> Column:
    """ISO text to a naive timestamp: an offset is dropped, not applied. NULL if not ISO."""
    return F.when(text.rlike(_ISO_TIME_RE), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp_ntz"))


def parse_level(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(lowered.isin(K.THREAT_LEVELS), lowered).otherwise("unknown")
