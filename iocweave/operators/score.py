"""Threat score of indicators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import choose, round_exact, seconds_between


def recency_score(last_seen: Column, now: Column) -> Column:
    hours = seconds_between(now, last_seen) / F.lit(3600.0)
    faded = F.lit(75.0) - (hours - F.lit(168.0)) / F.lit(552.0) * F.lit(75.0)
    return (
        F.when(hours <= 24, 100.0)
        .when(hours <= 72, 90.0)
        .when(hours <= 168, 75.0)
        .when(hours <= 720, F.greatest(F.lit(0.0), faded))
        .otherwise(0.0)
    )


def tag_signal(tags: Column) -> Column:
    names = F.array(*[F.lit(t) for t in K.SIGNAL_TAGS])
    hits = F.size(F.array_intersect(F.transform(tags, F.lower), names))
    return F.when(hits > 0, F.least(F.lit(20.0), hits.cast("double") * F.lit(7.0))).otherwise(0.0)


def threat_score(
    source_feed: Column,
    ioc_type: Column,
    level: Column,
    confidence: Column,
    last_seen: Column,
    tags: Column,
    now: Column,
    weights: Mapping[str, float] = K.DEFAULT_WEIGHTS,
) -> Column:
    base = (
        F.lit(float(weights["recency"])) * recency_score(last_seen, now)
        + F.lit(float(weights["confidence"])) * confidence.cast("double")
        + F.lit(float(weights["source"])) * choose(source_feed, K.SOURCE_CREDIBILITY, K.DEFAULT_CREDIBILITY)
    )
    weighted = (
        base
        * choose(ioc_type, K.TYPE_WEIGHT, K.DEFAULT_TYPE_WEIGHT)
        * choose(level, K.LEVEL_MULTIPLIER, K.DEFAULT_LEVEL_MULTIPLIER)
    )
    return round_exact(F.least(F.lit(100.0), F.greatest(F.lit(0.0), weighted + tag_signal(tags))), 2)


def score_iocs(iocs: DataFrame, now: Column, weights: Mapping[str, float] = K.DEFAULT_WEIGHTS) -> DataFrame:
    """Add ``threat_score``."""
    names = ["source_feed", "ioc_type", "threat_level", "confidence", "last_seen", "tags"]
    return iocs.withColumn("threat_score", threat_score(*[F.col(n) for n in names], now, weights))


def rank_iocs(scored: DataFrame) -> DataFrame:
    """Highest score first (a range-partitioned sort); key columns break ties."""
    return scored.orderBy(F.desc("threat_score"), "value", "ioc_type")


def ioc_flags(iocs: DataFrame, now: Column) -> DataFrame:
    days = F.floor(seconds_between(now, F.col("first_seen")) / F.lit(86400.0))
    return iocs.withColumns({"is_high_confidence": F.col("confidence") >= 75, "age_days": days.cast("int")})
