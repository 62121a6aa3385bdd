"""Feed run results, pipeline counters, actor profiles and indicator relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import round_exact, seconds_between, strip

# Link names between the indicators that one feed record gives, by type pair.
RELATIONSHIPS = {
    (K.SHA256, K.MD5): "same-file-as",
    (K.SHA256, K.FILENAME): "named",
    (K.MD5, K.FILENAME): "named",
    (K.URL, K.DOMAIN): "hosted-on",
    (K.URL, K.IP): "hosted-on",
}


def feed_run_result(flagged: DataFrame) -> DataFrame:
    """Counts per feed after normalising: total, new, duplicate, stored.

    ``flagged`` has ``feed_name`` and ``is_new``; every new row of a table write is stored.
    """
    new = F.count_if(F.col("is_new"))
    return flagged.groupBy("feed_name").agg(
        F.count("*").alias("total_fetched"),
        new.alias("new_iocs"),
        F.count_if(~F.col("is_new")).alias("duplicate_iocs"),
        new.alias("stored"),
    )


#: Error texts that a result row keeps of a run, the least ones; ``errors`` counts all of them.
ERROR_DETAILS = 50


def _failures(errors: DataFrame) -> DataFrame:
    """(feed_name, errors, error_details). The rank is a group limit, so no task gathers all failures of a feed."""
    counted = errors.groupBy("feed_name").agg(F.count("*").alias("errors"))
    order = Window.partitionBy("feed_name").orderBy("error")
    least = errors.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= ERROR_DETAILS)
    kept = least.groupBy("feed_name").agg(F.array_sort(F.collect_list("error")).alias("error_details"))
    return counted.join(kept, "feed_name")


def run_times(results: DataFrame, started_at: Column, finished_at: Column, errors: DataFrame | None = None) -> DataFrame:
    """Run results with their times and errors: rows of ``schemas.FEED_RUNS``. ``errors`` has (feed_name, error), a row
    for each failure of the run."""
    timed = results.withColumns({"started_at": started_at, "finished_at": finished_at})
    if errors is None:
        none = {"errors": F.lit(0).cast("bigint"), "error_details": F.array().cast("array<string>")}
        return timed.withColumns(none)
    failed = _failures(errors)
    joined = timed.join(failed, "feed_name", "full")
    counts = ["total_fetched", "new_iocs", "duplicate_iocs", "stored", "errors"]
    filled = {c: F.coalesce(c, F.lit(0)) for c in counts} | {
        "error_details": F.coalesce("error_details", F.array().cast("array<string>")),
        "started_at": started_at, "finished_at": finished_at,
    }
    return joined.withColumns(filled)


def run_results(counts: DataFrame, started: DataFrame, finished_at: Column, errors: DataFrame) -> DataFrame:
    """Rows of ``schemas.FEED_RUNS``: one for each feed that ``started`` (feed_name, started_at), whether it gave rows,
    nothing, or failed. ``errors`` has (feed_name, error), a row for each failure."""
    failed = _failures(errors)
    joined = started.join(counts, "feed_name", "left").join(failed, "feed_name", "left")
    numbers = ["total_fetched", "new_iocs", "duplicate_iocs", "stored"]
    return joined.select(
        "feed_name", "started_at", finished_at.alias("finished_at"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"),
        F.coalesce("error_details", F.array().cast("array<string>")).alias("error_details"),
    )


def feed_run_rates(runs: DataFrame) -> DataFrame:
    rate = round_exact(F.try_divide("stored", "new_iocs") * 100.0, 1)
    return runs.withColumns(
        {
            "duration_seconds": seconds_between(F.col("finished_at"), F.col("started_at")),
            "success_rate": F.when(F.col("new_iocs") == 0, 0.0).otherwise(rate),
        }
    )


def feed_last_result(runs: DataFrame) -> DataFrame:
    """Latest run of each feed."""
    rest = [c for c in runs.columns if c != "feed_name"]
    latest = F.max_by(F.struct(*rest), F.struct("finished_at", "started_at"))
    return runs.groupBy("feed_name").agg(latest.alias("r")).select("feed_name", "r.*")


def _summed(pairs: Column) -> Column:
    """Map from (name, n) entries, n summed by name."""
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"])))
    total = lambda name: F.aggregate(
        F.filter(pairs, lambda p: p["name"] == name), F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"]
    )
    return F.map_from_entries(F.transform(names, lambda name: F.struct(name, total(name))))


def pipeline_metrics(iocs: DataFrame, enriched: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """One row of counters. Every input is read once and reduced to one row; the rows are then laid over each other."""
    recent = (F.col("enriched_at") > now - F.expr("INTERVAL 1 HOUR")) & (F.col("enriched_at") <= now)
    alerts = enriched.agg(
        F.count_if(recent).alias("alerts_enriched_last_hour"),
        F.count_if(recent & (F.size("matched_iocs") > 0)).alias("alerts_matched_last_hour"),
        F.count_if(recent & F.col("should_notify")).alias("notifications_sent_last_hour"),
        F.max("enriched_at").alias("last_enrichment_run"),
    )
    # A row for each feed and type, however many indicators there are.
    counts = iocs.groupBy("source_feed", "ioc_type").agg(F.count("*").alias("n"))
    pairs = lambda key: F.collect_list(F.struct(F.col(key).alias("name"), "n"))
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_iocs_cached"),
        pairs("source_feed").alias("by_feed"),
        pairs("ioc_type").alias("by_type"),
    ).select("total_iocs_cached", _summed(F.col("by_feed")).alias("iocs_by_feed"), _summed(F.col("by_type")).alias("iocs_by_type"))
    last = feed_last_result(runs)
    entry = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("feed_name", value))))
    feeds = last.agg(
        entry((F.col("errors") == 0).alias("ok")).alias("feed_health"),
        entry(F.col("finished_at")).alias("last_feed_run"),
    )
    parts = [totals, alerts, feeds]
    laid = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return laid.agg(*[F.first(c, ignorenulls=True).alias(c) for c in laid.columns]).withColumn("timestamp", now)


def tag_actor(tag: Column) -> Column:
    """Actor named by a tag: prefixed, or a galaxy value."""
    lowered = F.lower(tag)
    return (
        F.when(lowered.contains(K.ACTOR_PREFIX), strip(F.replace(tag, F.lit(K.ACTOR_PREFIX), F.lit(""))))
        .when(lowered.contains(K.GALAXY_ACTOR), F.trim(F.substring_index(tag, "=", -1), F.lit('"')))
    )


def actor_profile(iocs: DataFrame) -> DataFrame:
    """Per actor: distinct indicators, time range, feeds and techniques.

    Rows are reduced to (actor, value, type) first, so an actor that is named everywhere is spread over its
    indicators; feeds and techniques are made distinct the same way.
    """
    tagged = iocs.select("*", F.explode("tags").alias("tag")).withColumn("actor", tag_actor(F.col("tag")))
    tagged = tagged.filter("actor IS NOT NULL AND actor <> ''")
    per_ioc = tagged.groupBy("actor", "value", "ioc_type").agg(
        F.min("first_seen").alias("lo"),
        F.max("last_seen").alias("hi"),
        F.collect_set("source_feed").alias("feeds"),
        F.array_distinct(F.flatten(F.collect_set("attack_techniques"))).alias("techniques"),
    )
    # One row for the indicator itself and one for each feed and technique, so that one aggregate serves all of them.
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    entries = F.concat(
        F.array(entry("ioc", F.lit(None).cast("string"))),
        F.transform("feeds", lambda f: entry("feed", f)),
        F.transform("techniques", lambda t: entry("technique", t)),
    )
    listed = (
        per_ioc.select("actor", "lo", "hi", F.explode(entries).alias("e"))
        .groupBy("actor", F.col("e.kind").alias("kind"), F.col("e.name").alias("name"))
        .agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name"))))
    return listed.groupBy("actor").agg(
        F.max(F.when(F.col("kind") == "ioc", F.col("n"))).alias("ioc_count"),
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
        names("feed").alias("source_feeds"),
        names("technique").alias("attack_techniques"),
    )


# Feeds whose records emit several indicators.
RECORD_FEEDS = ("abusech_malware", "abusech_url")


def ioc_relationships(iocs: DataFrame, feeds: tuple[str, ...] = RECORD_FEEDS) -> DataFrame:
    """Edges between the indicators that one feed record emitted together.

    A record is the ``ord`` without its last part. It is one line's record, so a group holds what its flattener emits
    for one record, however often a sample was reported; every pair of them is an edge. Repeated edges then combine
    before the exchange. Other feeds give one indicator per record, so they are left out.
    """
    record = ["source_feed", "ord.feed_rank", "ord.subfeed_rank", "ord.fetch_id", "ord.record_pos", "ord.element_pos"]
    member = F.struct(F.col("ord.emit_rank").alias("emit"), "value", "ioc_type", "confidence")
    records = (
        iocs.filter(F.col("source_feed").isin(list(feeds)))
        .groupBy(*record)
        .agg(F.array_sort(F.collect_list(member)).alias("m"), F.min("first_seen").alias("first_seen"))
        .filter(F.size("m") > 1)
    )
    later = lambda i: F.slice("m", i + 2, F.size("m"))
    pairs = F.flatten(F.transform("m", lambda s, i: F.transform(later(i), lambda t: F.struct(s.alias("s"), t.alias("t")))))
    edges = records.select("source_feed", "first_seen", F.explode(pairs).alias("e"))
    kind = None
    for (a, b), name in RELATIONSHIPS.items():
        cond = (F.col("e.s.ioc_type") == a) & (F.col("e.t.ioc_type") == b)
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
    return (
        edges.groupBy(
            "source_feed",
            F.col("e.s.value").alias("source_ioc"),
            F.col("e.t.value").alias("target_ioc"),
            kind.otherwise("related-to").alias("relationship_type"),
        )
        .agg(
            F.max(F.least("e.s.confidence", "e.t.confidence")).alias("confidence"),
            F.min("first_seen").alias("first_seen"),
        )
    )
