"""Alert tables: parsing, header fields and bounded scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import nonempty
from iocweave.functions.feedmap import parse_iso_drop_tz
from iocweave.operators import extract
from iocweave.operators.match import skew_join
from iocweave.sources.registry import ALERT_SOURCES, AlertSource, register_alert_source


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _present(v: Column, path: str) -> Column:
    """Text of a key that is there: JSON null reads as ``none``; an absent key is NULL."""
    node = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(node) == "VOID", F.lit("none")).otherwise(_get(v, path))


def _elastic_name(v: Column) -> Column:
    src = extract.body(v)
    flat = _get(src, '$["kibana.alert.rule.name"]')
    is_object = F.schema_of_variant(F.try_variant_get(src, "$.rule", "variant")).startswith("OBJECT")
    from_rule = F.coalesce(nonempty(flat), _get(src, "$.rule.name"), F.lit("Unknown Alert"))
    return F.when(is_object, from_rule).otherwise(F.coalesce(flat, F.lit("Unknown Alert")))


def _elastic_time(v: Column) -> Column:
    src = extract.body(v)
    return parse_iso_drop_tz(
        F.coalesce(nonempty(_get(src, '$["@timestamp"]')), _get(src, '$["kibana.alert.start"]'))
    )


register_alert_source(
    AlertSource(
        "elastic",
        lambda v: F.coalesce(_get(v, "$._id"), _get(v, '$["kibana.alert.uuid"]'), F.lit("unknown")),
        _elastic_name,
        lambda v: F.lower(
            F.coalesce(
                _present(extract.body(v), '$["kibana.alert.severity"]'),
                _present(extract.body(v), "$.severity"),
                F.lit("medium"),
            )
        ),
        _elastic_time,
        extract.elastic_candidates,
        extract.ELASTIC_PARTS,
    )
)
register_alert_source(
    AlertSource(
        "sentinel",
        lambda v: F.coalesce(_get(v, "$.name"), _get(v, "$.id"), F.lit("unknown")),
        lambda v: F.coalesce(_get(v, "$.properties.title"), _get(v, "$.name"), F.lit("Unknown Incident")),
        lambda v: F.lower(F.coalesce(_present(v, "$.properties.severity"), F.lit("medium"))),
        lambda v: parse_iso_drop_tz(_get(v, "$.properties.createdTimeUtc")),
        extract.sentinel_candidates,
    )
)


def parse_alerts(alerts: DataFrame) -> DataFrame:
    """Add ``v``, the VARIANT of the alert; text that is no JSON gives an empty alert."""
    return alerts.withColumn("v", F.coalesce(F.try_parse_json("raw"), F.parse_json(F.lit("{}"))))


def alert_header(parsed: DataFrame, now: Column) -> DataFrame:
    """Add id, name, severity and time by the rules of each source."""
    v = F.col("v")
    default = {
        "alert_id": F.coalesce(_get(v, "$.id"), F.lit("unknown")),
        "alert_name": F.coalesce(_get(v, "$.name"), F.lit("Unknown")),
        "severity": F.lit("medium"),
        "triggered_at": now,
    }
    out = {}
    for field, fallback in default.items():
        branch = None
        for name, source in ALERT_SOURCES.items():
            cond, value = F.col("source_siem") == name, getattr(source, field)(v)
            branch = F.when(cond, value) if branch is None else branch.when(cond, value)
        out[field] = branch.otherwise(fallback)
    out["triggered_at"] = F.coalesce(out["triggered_at"], now)
    return parsed.withColumns(out)


def extract_candidates(parsed: DataFrame) -> DataFrame:
    """Add ``extracted_iocs``: the valid candidates of the alert by the rules of its source, distinct and sorted."""
    v, raw, siem, columns = F.col("v"), F.col("raw"), F.col("source_siem"), parsed.columns
    known = F.coalesce(siem.isin(list(ALERT_SOURCES)), F.lit(False))
    rules = [(siem == name, source.candidates, source.parts) for name, source in ALERT_SOURCES.items()]
    branches = []
    for i, (cond, candidates, parts) in enumerate([*rules, (~known, extract.generic_candidates, extract.GENERIC_PARTS)]):
        at_hand = []
        for k, part in enumerate(parts):
            parsed = parsed.withColumn(f"_part_{i}_{k}", F.when(cond, part(v, *at_hand)))
            at_hand.append(F.col(f"_part_{i}_{k}"))
        branches.append((cond, candidates(v, raw, *at_hand)))
    found = F.coalesce(*[F.when(cond, values) for cond, values in branches])
    found_rows = parsed.withColumn("_found", found)
    return found_rows.select(*columns, extract.clean_candidates(F.col("_found")).alias("extracted_iocs"))


def latest_alerts(alerts: DataFrame, source_siem: str, since: Column, size: int = 50) -> DataFrame:
    """Newest alerts of a source since a time. The id breaks ties, so the result is the same on every run."""
    return (
        alerts.filter((F.col("source_siem") == source_siem) & (F.col("triggered_at") >= since))
        .orderBy(F.desc("triggered_at"), "alert_key")
        .limit(size)
    )


def reverse_search(parsed: DataFrame, values: DataFrame, per_value: int = 10) -> DataFrame:
    """Alerts that hold a value in one of the searched fields: the newest ten per value.

    The rank limit applies before the exchange too, so a value found in very many alerts stays cheap.
    """
    found = parsed.select(
        "alert_key",
        "triggered_at",
        F.explode_outer(F.array_distinct(extract.elastic_path_values(F.col("v"), K.SEARCH_PATHS))).alias("value"),
    ).filter("value IS NOT NULL")
    found = skew_join(found, values.select("value").distinct(), ["value"])
    w = Window.partitionBy("value").orderBy(F.desc("triggered_at"), "alert_key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_value)
