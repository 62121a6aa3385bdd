"""Flatteners: landed feed envelopes to indicator rows.

Each flattener takes a DataFrame with the envelope columns of ``schemas`` plus ``fetch_id``, a string that
sorts in the order the envelopes were fetched, and gives rows of ``schemas.IOCS``. They are narrow
transformations (explodes and projections), so they run in the scan stage and work on streams too. The explodes are
outer ones: an inner explode makes the optimizer add a filter on the array, which computes the array once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from iocweave import constants as K
from iocweave import schemas
from iocweave.functions import feedmap as M
from iocweave.functions.base import choose, drop_blank, empty_strings, nonempty, ordered_distinct, strip
from iocweave.functions.norm import accepted, canonical, classify_host, url_hostname

# Rank of each feed and of each sub-feed inside it: the arrival order that keep-first follows.
FEED_RANK = {"otx": 0, "abusech": 1, "csv": 2}
SUBFEED_RANK = {"abusech_malware": 0, "abusech_url": 1, "threatfox": 2}


def ord_struct(feed: str, subfeed: str | None, record: Column, element: Column, emit: Column) -> Column:
    return F.struct(
        F.lit(FEED_RANK[feed]).alias("feed_rank"),
        F.lit(SUBFEED_RANK.get(subfeed, 0)).alias("subfeed_rank"),
        F.col("fetch_id").cast("string").alias("fetch_id"),
        record.cast("bigint").alias("record_pos"),
        element.cast("int").alias("element_pos"),
        emit.cast("int").alias("emit_rank"),
    )


# Why a row of a feed is refused.
CORRUPT, EMPTY, STATUS, BLANK, UNMAPPED, REFUSED = (
    "corrupt envelope", "empty envelope", "query status", "no value", "unmapped type", "refused value"
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _begin(envelopes: DataFrame, judged: bool) -> DataFrame:
    """With ``judged`` every row carries a ``reason``, null while nothing is wrong, and no row is dropped."""
    if not judged:
        return envelopes
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in envelopes.columns else F.lit(False)
    return envelopes.withColumns({"reason": F.lit(None).cast("string"), "_bad": bad})


def _keep(rows: DataFrame, test: Column, reason: str | Column, judged: bool) -> DataFrame:
    """Rows that pass a test; with ``judged`` all rows, the first failed test as their reason."""
    if not judged:
        return rows.filter(test)
    why = F.lit(reason) if isinstance(reason, str) else reason
    return rows.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(test, F.lit(False)), why)))


def _records(envelopes: DataFrame, array: str, record: str, judged: bool) -> DataFrame:
    """One row per record of an envelope. One without records, which is one row too, is refused as a whole."""
    extra = ["reason", "_bad"] if judged else []
    rows = envelopes.select("fetch_id", *extra, F.posexplode_outer(array).alias("record_pos", record))
    if not judged:
        return rows
    return _keep(rows, F.col(record).isNotNull(), F.when(F.col("_bad"), CORRUPT).otherwise(EMPTY), judged).drop("_bad")


def _extra(judged: bool) -> list[str]:
    return ["reason"] if judged else []


def flatten_otx(envelopes: DataFrame, now: Column, judged: bool = False) -> DataFrame:
    """One row per indicator of a known type."""
    p = F.col("pulse")
    techniques = F.concat(
        F.transform(
            F.filter(
                F.coalesce(p["references"], F.array().cast("array<variant>")),
                lambda r: F.schema_of_variant(r).startswith("OBJECT")
                & _text(F.try_variant_get(r, "$.external_id", "string")).contains("T"),
            ),
            lambda r: F.try_variant_get(r, "$.external_id", "string"),
        ),
        F.coalesce(p["attack_ids"], empty_strings()),
    )
    created = M.parse_iso_drop_tz(p["created"])
    modified = M.parse_iso_drop_tz(F.coalesce(p["modified"], p["created"]))
    # Absent created means "now"; a bad date in either field makes both "now".
    bad = (p["created"].isNotNull() & created.isNull()) | (
        F.coalesce(p["modified"], p["created"]).isNotNull() & modified.isNull()
    )
    pulses = _records(_begin(envelopes, judged), "results", "pulse", judged).select(
        "fetch_id",
        "record_pos",
        *_extra(judged),
        _text(p["id"]).alias("pulse_id"),
        _text(p["name"]).alias("pulse_name"),
        M.map_tlp_level(p["TLP"]).alias("threat_level"),
        F.concat(
            drop_blank(p["tags"]),
            F.when(_text(p["adversary"]) != "", F.array(p["adversary"])).otherwise(empty_strings()),
        ).alias("tags"),
        ordered_distinct(techniques).alias("attack_techniques"),
        F.when(bad, now).otherwise(F.coalesce(created, now)).alias("first_seen"),
        F.when(bad, now).otherwise(F.coalesce(modified, created, now)).alias("last_seen"),
        M.otx_confidence(p["pulse_source"]).alias("confidence"),
        p["indicators"].alias("indicators"),
    )
    i = F.col("indicator")
    rows = pulses.select("*", F.posexplode_outer("indicators").alias("element_pos", "indicator")).withColumns(
        {"value": strip(i["indicator"]), "ioc_type": M.map_otx_type(i["type"])}
    )
    rows = _keep(rows, i.isNotNull(), EMPTY, judged) if judged else rows
    rows = _keep(_keep(rows, F.col("ioc_type").isNotNull(), UNMAPPED, judged), F.col("value") != "", BLANK, judged)
    return rows.select(
        "value",
        "ioc_type",
        *_extra(judged),
        F.lit("otx").alias("source_feed"),
        "threat_level",
        "tags",
        F.coalesce(nonempty(i["description"]), F.concat(F.lit("OTX pulse: "), "pulse_name")).alias("description"),
        "first_seen",
        "last_seen",
        "confidence",
        "pulse_id",
        "attack_techniques",
        F.to_json(F.struct("pulse_id", "pulse_name", "indicator")).alias("raw"),
        ord_struct("otx", None, F.col("record_pos"), F.col("element_pos"), F.lit(0)).alias("ord"),
    )


def _emitted(value: Column, ioc_type: Column, level: Column, description: Column, confidence: Column) -> list[Column]:
    return [
        value.alias("value"),
        ioc_type.alias("ioc_type"),
        level.alias("threat_level"),
        description.alias("description"),
        confidence.cast("int").alias("confidence"),
    ]


def _emit(records: DataFrame, subfeed: str, emitted: list[list[Column]], judged: bool = False) -> DataFrame:
    """Fan each record out to its emitted indicators, numbered in order, and drop the blank ones. A refused record is
    one row."""
    # The generator reads plain columns only: fields of a struct inside it are pruned wrongly by the optimizer.
    ranked = [F.struct(F.lit(i).alias("emit_rank"), *fields) for i, fields in enumerate(emitted)]
    kept = ["fetch_id", "record_pos", "tags", "first_seen", "last_seen", "pulse_id", "raw", *_extra(judged)]
    rows = records.select(*kept, F.inline_outer(F.array(*ranked)))
    if judged:
        rows = rows.filter("reason IS NULL OR emit_rank = 0")
    rows = _keep(_keep(rows, F.col("ioc_type").isNotNull(), UNMAPPED, judged), F.col("value") != "", BLANK, judged)
    return (
        rows.select(
            "value",
            "ioc_type",
            *_extra(judged),
            F.lit(subfeed).alias("source_feed"),
            "threat_level",
            "tags",
            "description",
            "first_seen",
            "last_seen",
            "confidence",
            "pulse_id",
            empty_strings().alias("attack_techniques"),
            "raw",
            ord_struct("abusech", subfeed, F.col("record_pos"), F.lit(0), F.col("emit_rank")).alias("ord"),
        )
    )


def _append_missing(tags: Column, extra: Column) -> Column:
    """Append a non-empty text unless the list has it already."""
    add = (_text(extra) != "") & ~F.array_contains(tags, _text(extra))
    return F.when(add, F.concat(tags, F.array(extra))).otherwise(tags)


def _answered(envelopes: DataFrame, judged: bool) -> DataFrame:
    """Envelopes of a query that went well; a corrupt one has no status."""
    rows = _begin(envelopes, judged)
    ok = F.col("query_status") == "ok"
    return _keep(rows, ok | F.col("_bad") if judged else ok, STATUS, judged)


def flatten_malware(envelopes: DataFrame, now: Column, judged: bool = False) -> DataFrame:
    """Up to three rows per sample: sha256, md5 and file name."""
    s = F.col("s")
    raw_tags = F.coalesce(s["tags"], empty_strings())
    signature = F.coalesce(nonempty(s["signature"]), F.lit("Unknown"))
    file_type = F.coalesce(nonempty(s["file_type"]), F.lit("unknown"))
    answered = _answered(envelopes, judged)
    samples = _records(answered, "data", "s", judged).withColumn("sha", strip(_text(s["sha256_hash"])))
    records = (
        _keep(samples, F.col("sha") != "", BLANK, judged)
        .select(
            "fetch_id",
            "record_pos",
            *_extra(judged),
            "sha",
            strip(_text(s["md5_hash"])).alias("md5"),
            strip(_text(s["file_name"])).alias("file_name"),
            F.col("sha").alias("pulse_id"),
            _append_missing(raw_tags, signature).alias("tags"),
            F.concat(signature, F.lit(" malware sample — "), file_type).alias("description"),
            M.parse_feed_datetime(_text(s["first_seen"]), now).alias("first_seen"),
            M.parse_feed_datetime(F.coalesce(nonempty(s["last_seen"]), s["first_seen"], F.lit("")), now).alias(
                "last_seen"
            ),
            F.to_json("s").alias("raw"),
        )
    )
    d = F.col("description")
    return _emit(
        records,
        "abusech_malware",
        [
            _emitted(F.col("sha"), F.lit(K.SHA256), F.lit("high"), d, F.lit(90)),
            _emitted(F.col("md5"), F.lit(K.MD5), F.lit("high"), d, F.lit(85)),
            _emitted(F.col("file_name"), F.lit(K.FILENAME), F.lit("medium"), d, F.lit(70)),
        ],
        judged,
    )


def flatten_urls(envelopes: DataFrame, now: Column, judged: bool = False) -> DataFrame:
    """A URL row and a host row per entry."""
    u = F.col("u")
    threat = _text(u["threat"])
    level = F.when(F.lower(threat).contains("malware"), "high").otherwise("medium")
    entries = _records(_begin(envelopes, judged), "urls", "u", judged).withColumn("url", strip(_text(u["url"])))
    records = (
        _keep(entries, F.col("url") != "", BLANK, judged)
        .select(
            "fetch_id",
            "record_pos",
            *_extra(judged),
            "url",
            F.coalesce(nonempty(strip(_text(u["host"]))), url_hostname(F.col("url"))).alias("host"),
            threat.alias("threat"),
            level.alias("level"),
            F.coalesce(u["tags"], empty_strings()).alias("tags"),
            M.parse_feed_datetime(_text(u["date_added"]), now).alias("first_seen"),
            M.parse_feed_datetime(_text(u["date_added"]), now).alias("last_seen"),
            _text(u["id"]).alias("pulse_id"),
            F.to_json("u").alias("raw"),
        )
    )
    url_text = F.concat(F.lit("URLhaus — "), "threat")
    host_text = F.concat(F.lit("URLhaus host — "), "threat")
    return _emit(
        records,
        "abusech_url",
        [
            _emitted(F.col("url"), F.lit(K.URL), F.col("level"), url_text, F.lit(80)),
            _emitted(F.col("host"), classify_host(F.col("host")), F.col("level"), host_text, F.lit(75)),
        ],
        judged,
    )


def flatten_threatfox(envelopes: DataFrame, now: Column, judged: bool = False) -> DataFrame:
    """At most one row per entry."""
    t = F.col("t")
    confidence = F.coalesce(t["confidence_level"], F.lit(50))
    tags = drop_blank(
        _append_missing(
            _append_missing(F.coalesce(t["tags"], empty_strings()), t["malware"]), t["malware_alias"]
        )
    )
    value = strip(_text(t["ioc"]))
    records = (
        _keep(_records(_answered(envelopes, judged), "data", "t", judged), value != "", BLANK, judged)
        .select(
            "fetch_id",
            "record_pos",
            *_extra(judged),
            M.map_threatfox_value(t["ioc_type"], value).alias("value"),
            M.map_threatfox_type(t["ioc_type"]).alias("type"),
            confidence.alias("confidence"),
            _text(t["malware"]).alias("malware"),
            tags.alias("tags"),
            M.parse_feed_datetime(_text(t["first_seen"]), now).alias("first_seen"),
            M.parse_feed_datetime(F.coalesce(nonempty(t["last_seen"]), t["first_seen"], F.lit("")), now).alias(
                "last_seen"
            ),
            _text(t["id"]).alias("pulse_id"),
            F.to_json("t").alias("raw"),
        )
    )
    emitted = _emitted(
        F.col("value"),
        F.col("type"),
        M.level_from_confidence(F.col("confidence")),
        F.concat(F.lit("ThreatFox — "), "malware"),
        M.clamp_confidence(F.col("confidence")),
    )
    return _emit(records, "threatfox", [emitted], judged)


def flatten_csv(rows: DataFrame, now: Column, judged: bool = False) -> DataFrame:
    """One row per CSV line of a known type; ``fetch_id`` orders the lines."""
    rows = _begin(rows, judged)
    value, ioc_type = strip(_text(F.col("value"))), strip(F.lower(_text(F.col("type"))))
    tags = F.filter(F.transform(F.split(_text(F.col("tags")), ","), strip), lambda t: t != "")
    fields = ["value", "type", "threat_level", "description", "tags"]
    lines = rows.select(
        value.alias("value"),
        choose(ioc_type, K.CSV_TYPES).alias("ioc_type"),
        *_extra(judged),
        F.lit("csv").alias("source_feed"),
        M.parse_level(_text(F.col("threat_level"))).alias("threat_level"),
        tags.alias("tags"),
        _text(F.col("description")).alias("description"),
        now.alias("first_seen"),
        now.alias("last_seen"),
        F.lit(70).alias("confidence"),
        F.concat(F.lit("csv:"), value).alias("pulse_id"),
        empty_strings().alias("attack_techniques"),
        F.to_json(F.struct(*fields)).alias("raw"),
        ord_struct("csv", None, F.lit(0), F.lit(0), F.lit(0)).alias("ord"),
    )
    return _keep(_keep(lines, F.col("ioc_type").isNotNull(), UNMAPPED, judged), F.col("value") != "", BLANK, judged)


def union_feeds(feeds: list[DataFrame | None], spark: SparkSession) -> DataFrame:
    """Concatenate flattened feeds; a feed that is missing gives no rows."""
    out = spark.createDataFrame([], schemas.IOCS)
    for feed in feeds:
        if feed is not None:
            out = out.unionByName(feed, allowMissingColumns=True)
    return out


def judge_values(judged: DataFrame) -> DataFrame:
    """Judged rows with canonical values; one that the normaliser refuses gets that as its reason."""
    value, ioc_type = F.col("value"), F.col("ioc_type")
    rows = _keep(judged, accepted(value, ioc_type), REFUSED, True)
    return rows.withColumn("value", F.when(F.col("reason").isNull(), canonical(value, ioc_type)).otherwise(value))


def split_judged(judged: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write judged rows in one pass, the good ones and the refused ones apart: (good rows, rejects, counts by reason).

    The counts are observed while the rows are written, so they need no pass of their own. They add up to ``rows``, all
    rows that came; ``good`` counts those without a reason.
    """
    reasons = (CORRUPT, EMPTY, STATUS, BLANK, UNMAPPED, REFUSED)
    seen = Observation()
    counted = judged.observe(
        seen, F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("good"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in reasons],
    )
    counted.withColumn("rejected", F.col("reason").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(path)
    schema = StructType([*judged.schema.fields, StructField("rejected", BooleanType())])
    rows = judged.sparkSession.read.schema(schema).parquet(path)
    return rows.filter("NOT rejected").drop("rejected", "reason"), rows.filter("rejected").drop("rejected"), seen.get


def modified_since(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows changed in the last ``days`` days; the bound is a literal, so it reaches the scan."""
    return df.filter(F.col(column) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
