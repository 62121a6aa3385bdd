"""Reputation data: landed provider answers to result rows, and their join to indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import choose, empty_strings, nonempty
from iocweave.functions.norm import infer_ioc_type
from iocweave.operators.dedup import keep_first
from iocweave.operators.match import skew_join
from iocweave.sources.registry import PROVIDERS, Provider, register_provider

RESULT_COLUMNS = ["source", "ioc_value", "ioc_type", "found", "malicious_score", "summary", "details", "link"]
DOT = " · "


def vt_object_id(value: Column, ioc_type: Column) -> Column:
    """Unpadded URL-safe base64 of a URL, else the value."""
    encoded = F.translate(F.base64(F.encode(value, "UTF-8")), "+/\r\n", "-_")
    return F.when(ioc_type == K.URL, F.rtrim(encoded, F.lit("="))).otherwise(value)


def is_malicious(score: Column) -> Column:
    return F.coalesce(score >= K.MALICIOUS_FROM, F.lit(False))


def _by_status(answers: DataFrame, missing: str, found: dict[str, Column]) -> DataFrame:
    """200 gives the parsed answer and 404 a not-found row; other answers give none."""
    ok = F.col("status") == 200
    return answers.filter(F.col("status").isin(200, 404)).select(
        found["source"].alias("source"),
        "ioc_value",
        found["ioc_type"].alias("ioc_type"),
        ok.alias("found"),
        F.when(ok, found["malicious_score"]).cast("int").alias("malicious_score"),
        F.when(ok, found["summary"]).otherwise(missing).alias("summary"),
        F.when(ok, found["details"]).alias("details"),
        F.when(ok, found["link"]).alias("link"),
    )


def parse_vt(answers: DataFrame) -> DataFrame:
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("malicious", "suspicious", "harmless", "undetected")}
    total = n["malicious"] + n["suspicious"] + n["harmless"] + n["undetected"]
    ratio = (n["malicious"].cast("double") + n["suspicious"].cast("double") * 0.5) / F.nullif(total, F.lit(0))
    kind = choose(F.col("ioc_type"), K.VT_LINK_KIND, "search")
    return _by_status(
        answers,
        "Not found in VirusTotal",
        {
            "source": F.lit("virustotal"),
            "ioc_type": F.col("ioc_type"),
            "malicious_score": F.bround(ratio * 100.0, 0),
            "summary": F.concat_ws(
                DOT,
                F.concat(n["malicious"].cast("string"), F.lit("/"), total.cast("string"), F.lit(" engines flagged malicious")),
                F.concat(F.lit("label="), nonempty(F.col("threat_label"))),
                F.concat(F.lit("reputation="), F.col("reputation").cast("string")),
            ),
            "details": F.to_json(
                F.struct(
                    *[c.alias(k) for k, c in n.items()],
                    total.alias("total_engines"),
                    "reputation",
                    "threat_label",
                    F.slice(F.coalesce("names", empty_strings()), 1, 5).alias("names"),
                )
            ),
            "link": F.concat(F.lit(K.VT_LINK), kind, F.lit("/"), vt_object_id(F.col("ioc_value"), F.col("ioc_type"))),
        },
    )


def parse_shodan(answers: DataFrame) -> DataFrame:
    ports = F.array_sort(F.array_distinct(F.filter(F.coalesce("ports", F.array().cast("array<int>")), lambda p: p.isNotNull())))
    vulns = F.array_sort(F.coalesce("vulns", empty_strings()))
    tags = F.coalesce("tags", empty_strings())
    by_cve = F.when(F.size(vulns) > 0, F.least(F.lit(100), 40 + F.size(vulns) * 10)).otherwise(0)
    risky = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in K.RISKY_HOST_TAGS]))
    score = F.when(risky, F.greatest(by_cve, F.lit(80))).otherwise(by_cve)
    org = F.coalesce(nonempty(F.col("org")), F.col("isp"), F.lit(""))
    country = F.coalesce("country_name", F.lit(""))
    return _by_status(
        answers,
        "No Shodan data for this host",
        {
            "source": F.lit("shodan"),
            "ioc_type": F.lit(K.IP),
            "malicious_score": F.nullif(score, F.lit(0)),
            "summary": F.concat_ws(
                DOT,
                F.concat(F.size(ports).cast("string"), F.lit(" open ports")),
                F.when(F.size(vulns) > 0, F.concat(F.size(vulns).cast("string"), F.lit(" CVEs"))),
                nonempty(org),
                nonempty(country),
            ),
            "details": F.to_json(
                F.struct(
                    ports.alias("ports"),
                    F.slice(vulns, 1, 10).alias("vulns"),
                    F.slice(F.coalesce("hostnames", empty_strings()), 1, 5).alias("hostnames"),
                    org.alias("org"),
                    country.alias("country"),
                    F.coalesce("os", F.lit("")).alias("os"),
                    tags.alias("tags"),
                )
            ),
            "link": F.concat(F.lit(K.SHODAN_LINK), "ioc_value"),
        },
    )


register_provider(Provider("virustotal", tuple(K.PROVIDER_TYPES["virustotal"]), parse_vt))
register_provider(Provider("shodan", tuple(K.PROVIDER_TYPES["shodan"]), parse_shodan))


def provider_rank(source: Column) -> Column:
    return choose(source, {name: i for i, name in enumerate(PROVIDERS)}, len(PROVIDERS))


def landed_results(landed: dict[str, DataFrame]) -> DataFrame:
    """Result rows of all landed providers, one per provider, value and type."""
    parts = [PROVIDERS[name].parse(df).select(*RESULT_COLUMNS) for name, df in landed.items()]
    rows = reduce(DataFrame.unionByName, parts)
    # Several landed answers: one that found the value wins, then the higher score.
    order = [F.desc("found"), F.desc_nulls_last("malicious_score"), "summary", "link"]
    return keep_first(rows, ["source", "ioc_value", "ioc_type"], order)


def supports(source: Column, ioc_type: Column) -> Column:
    tests = [(source == p.name) & ioc_type.isin(list(p.supported_types)) for p in PROVIDERS.values()]
    return reduce(lambda a, b: a | b, tests)


def external_join(iocs: DataFrame, results: DataFrame) -> DataFrame:
    """Results of every provider that supports the type, for each distinct (value, type). No answer, no row."""
    keys = iocs.select("value", "ioc_type").distinct()
    usable = results.filter(supports(F.col("source"), F.col("ioc_type"))).withColumnRenamed("ioc_value", "value")
    return keys.join(usable, ["value", "ioc_type"])


def external_unmatched(candidates: DataFrame, matches: DataFrame, results: DataFrame) -> DataFrame:
    """Results for candidate values of an alert that the store did not match, with the type inferred."""
    unmatched = (
        candidates.select("alert_key", "value")
        .join(matches.select("alert_key", "value"), ["alert_key", "value"], "left_anti")
        .withColumn("ioc_type", infer_ioc_type(F.col("value")))
        .filter("ioc_type IS NOT NULL")
    )
    usable = results.filter(supports(F.col("source"), F.col("ioc_type"))).withColumnRenamed("ioc_value", "value")
    return skew_join(unmatched, usable, ["value", "ioc_type"])


def results_per_value(results: DataFrame) -> DataFrame:
    """All results of a value in provider order: at most one per provider and type, so the array is small."""
    usable = results.filter(supports(F.col("source"), F.col("ioc_type")))
    entry = F.struct(
        provider_rank(F.col("source")).alias("rank"),
        "ioc_type",
        "source",
        F.col("ioc_value"),
        "found",
        "malicious_score",
        "summary",
        "link",
    )
    return (
        usable.groupBy(F.col("ioc_value").alias("value"))
        .agg(F.sort_array(F.collect_list(entry)).alias("results"))
    )
