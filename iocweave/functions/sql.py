"""The scalar functions under names that SQL text can call.

Each is a temporary SQL function whose body is the expression of the column function, so both give the same plan and
nothing leaves the JVM. Bodies are printed once per registration from the columns; parameters are the column names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from iocweave.functions import base, feedmap, ip, norm
from iocweave.operators import external, score

# Calls of operators by name, outside of texts: SQL takes these names in back quotes. A unit of time is no text in SQL.
_CALL = re.compile(
    r"(?P<unit>\btimestamp(?:diff|add)\()'(\w+)'|'(?:[^'\\]|\\.)*'|(?<![\w`])(and|or|not|in)\(|([=<>!+\-*/%&|^~]+)\(", re.DOTALL
)


def sql_text(expression: Column) -> str:
    """SQL text of a column expression over plain column names."""
    def quoted(found: re.Match) -> str:
        if found["unit"]:
            return found["unit"] + found[2]
        name = found[3] or found[4]
        return f"`{name}`(" if name else found[0]

    return _CALL.sub(quoted, expression._jc.node().sql())


def _functions() -> dict[str, tuple[str, str, Callable[..., Column]]]:
    """Name: parameters with types, type of the result, and the column function of them."""
    text, kind = "value STRING", "value STRING, ioc_type STRING"
    return {
        "ioc_normalise": (kind, "STRING", norm.normalise),
        "ioc_accepted": (kind, "BOOLEAN", norm.accepted),
        "ioc_infer_type": (text, "STRING", norm.infer_ioc_type),
        "ioc_valid_candidate": (text, "BOOLEAN", ip.valid_candidate),
        "norm_ip": (text, "STRING", lambda v: ip.normalise_ip(base.strip(v))),
        "is_private_ip": (text, "BOOLEAN", lambda v: ip.is_private_ip(base.strip(v))),
        "host_from_url": (text, "STRING", norm.host_from_url),
        "classify_host": (text, "STRING", norm.classify_host),
        "map_otx_type": (text, "STRING", feedmap.map_otx_type),
        "map_threatfox_type": (text, "STRING", feedmap.map_threatfox_type),
        "map_tlp_level": (text, "STRING", feedmap.map_tlp_level),
        "parse_iso_drop_tz": (text, "TIMESTAMP_NTZ", feedmap.parse_iso_drop_tz),
        "parse_feed_datetime": ("value STRING, run_at TIMESTAMP_NTZ", "TIMESTAMP_NTZ", feedmap.parse_feed_datetime),
        "vt_object_id": (kind, "STRING", external.vt_object_id),
        "is_malicious": ("score INT", "BOOLEAN", external.is_malicious),
        "score_recency": ("last_seen TIMESTAMP_NTZ, run_at TIMESTAMP_NTZ", "DOUBLE", score.recency_score),
        "score_tag_signal": ("tags ARRAY<STRING>", "DOUBLE", score.tag_signal),
        "score_ioc": (
            "source_feed STRING, ioc_type STRING, threat_level STRING, confidence INT, last_seen TIMESTAMP_NTZ, "
            "tags ARRAY<STRING>, run_at TIMESTAMP_NTZ",
            "DOUBLE", score.threat_score,
        ),
    }


def register(spark: SparkSession, prefix: str = "") -> Mapping[str, str]:
    """Register all functions in the session, their names after ``prefix``; name to signature. To call again is harmless."""
    out = {}
    for name, (parameters, result, function) in _functions().items():
        columns = [F.col(p.split()[0]) for p in re.split(r", (?=\w+ )", parameters)]
        body = sql_text(function(*columns))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
        out[prefix + name] = f"{prefix}{name}({parameters}) -> {result}"
    return out
