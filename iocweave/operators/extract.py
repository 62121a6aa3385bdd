"""Candidate indicators of semi-structured alerts.

An alert is JSON text plus its VARIANT. All candidates of an alert are built as one array inside its row, so
extraction needs no shuffle, and whole alerts are read: no depth is sampled and no text is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import empty_strings, let, nonempty, strip
from iocweave.functions.ip import valid_candidate

# Tokens are bounded by non-word characters in the Unicode sense.
IPV4_TOKEN = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
SHA256_TOKEN = r"(?U)\b[0-9a-fA-F]{64}\b"
MD5_TOKEN = r"(?U)\b[0-9a-fA-F]{32}\b"


def _array(c: Column) -> Column:
    return F.coalesce(c, empty_strings())


def _variants(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<variant>"))


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _children(v: Column) -> Column:
    """Values of an object, in an array; empty for anything else."""
    return _variants(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))


def _elements(v: Column) -> Column:
    return _variants(F.try_variant_get(v, "$", "array<variant>"))


def body(v: Column) -> Column:
    """The ``_source`` of a hit, or the alert itself."""
    return F.coalesce(F.try_variant_get(v, "$._source", "variant"), v)


def string_fields(v: Column) -> Column:
    """The string-valued entries of an object as MAP<STRING,STRING>."""
    fields = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: _is(x, "STRING"))
    return F.transform_values(fields, lambda _, x: _text(x))


def _nested(source: Column, path: str) -> Column:
    """Texts at a nested path: a scalar gives one, an array gives its scalar elements."""
    at = F.try_variant_get(source, "$." + path, "variant")

    def texts(x: Column) -> Column:
        scalars = F.filter(
            F.when(_is(x, "ARRAY"), _elements(x)).otherwise(F.array(x)),
            lambda e: ~_is(e, "OBJECT") & ~_is(e, "ARRAY"),
        )
        return F.transform(scalars, _text)

    return F.when(at.isNotNull(), let(at, texts)).otherwise(empty_strings())


def _path_texts(source: Column, fields: Column, paths: list[str]) -> Column:
    """Per path: the flat dotted key if it holds a non-empty string, else the nested value."""
    parts = []
    for path in paths:
        flat = nonempty(F.try_element_at(fields, F.lit(path)))
        parts.append(F.when(flat.isNotNull(), F.array(flat)).otherwise(_nested(source, path)))
    return F.concat(*parts)


def _path_values(source: Column, fields: Column, paths: list[str]) -> Column:
    return F.transform(_drop_empty(_path_texts(source, fields, paths)), strip)


def _drop_empty(texts: Column) -> Column:
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def elastic_path_values(v: Column, paths: list[str] = K.ALERT_PATHS) -> Column:
    return let(body(v), lambda src: let(fields_of(src), lambda f: _path_values(src, f, paths)))


def fields_of(source: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(string_fields(source), empty)


def _prefix_texts(fields: Column) -> Column:
    wanted = lambda k, _: reduce(lambda a, b: a | b, [k.startswith(p) for p in K.ALERT_PREFIXES])
    return F.map_values(F.map_filter(fields, wanted))


def elastic_prefix_values(v: Column) -> Column:
    return F.transform(_prefix_texts(fields_of(body(v))), strip)


def regex_tokens(text: Column) -> Column:
    """IPv4-shaped, sha256 and md5 tokens of a text; digests in lower case."""
    lower = lambda t: F.lower(t)
    return F.concat(
        F.regexp_extract_all(text, F.lit(IPV4_TOKEN), F.lit(0)),
        F.transform(F.regexp_extract_all(text, F.lit(SHA256_TOKEN), F.lit(0)), lower),
        F.transform(F.regexp_extract_all(text, F.lit(MD5_TOKEN), F.lit(0)), lower),
    )


def named_texts(source: Column, fields: Column) -> Column:
    """Texts of the named paths and of the keys with a known prefix, as they came."""
    return F.concat(_path_texts(source, fields, K.ALERT_PATHS), _prefix_texts(fields))


# What ``elastic_candidates`` reads, each a column of its own: inside of a lambda all of it would be interpreted.
ELASTIC_PARTS = (body, lambda v, source: fields_of(source), lambda v, source, fields: named_texts(source, fields))


def elastic_candidates(v: Column, raw: Column, source: Column, fields: Column, texts: Column) -> Column:
    return F.concat(_apart(texts, lambda t: F.transform(_drop_empty(t), strip)), _array(regex_tokens(raw)))


def _apart(column: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a column, empty if that is null. A column read twice is not merged into its only reader, where the
    expression behind it would be interpreted as the argument of a lambda."""
    return F.when(column.isNotNull(), body(column)).otherwise(empty_strings())


def entity_values(entity: Column) -> Column:
    """Values of one entity: address, domain, URL, file hashes (objects or strings) and nested digests."""
    named = F.array(*[F.try_variant_get(entity, f"$.{f}", "string") for f in K.ENTITY_FIELDS])
    hashes = F.transform(
        _variants(F.try_variant_get(entity, "$.fileHashes", "array<variant>")),
        lambda h: F.when(_is(h, "OBJECT"), F.try_variant_get(h, "$.hashValue", "string")).when(
            _is(h, "STRING"), _text(h)
        ),
    )
    return F.transform(_drop_empty(F.concat(named, hashes)), strip)


def sentinel_candidates(v: Column, raw: Column | None = None) -> Column:
    entities = _variants(F.try_variant_get(v, "$.properties.entities", "array<variant>"))
    return F.flatten(F.transform(entities, entity_values))


def generic_items(nodes: Column) -> Column:
    """Strings and objects among the values of objects, and in the lists among these; lists of lists are not entered."""
    wanted = lambda x: F.schema_of_variant(x).rlike("^(?:STRING|OBJECT)")

    def read(values: Column) -> Column:
        lists = F.filter(values, lambda x: _is(x, "ARRAY"))
        return F.concat(F.filter(values, wanted), F.flatten(F.transform(lists, lambda x: F.filter(_elements(x), wanted))))

    return let(F.flatten(F.transform(nodes, _children)), read)


def generic_objects(items: Column) -> Column:
    return F.filter(items, lambda x: _is(x, "OBJECT"))


# The items of each level, six levels deep, each a column: nested in each other they would be interpreted as one.
GENERIC_PARTS = (
    lambda v: generic_items(F.array(v)),
    *[lambda v, *above: generic_items(generic_objects(above[-1]))] * (K.GENERIC_LEVELS - 1),
)


def generic_candidates(v: Column, raw: Column, *levels: Column) -> Column:
    """Every string value through objects and lists of objects, upper levels first."""
    return F.concat(*[F.transform(F.filter(items, lambda x: _is(x, "STRING")), _text) for items in levels])


def generic_values(v: Column) -> Column:
    """``generic_candidates`` in one expression."""

    def level(items: Column, depth: int) -> Column:
        texts = generic_candidates(v, v, items)
        if depth == 1:
            return texts
        inner = generic_objects(items)
        return F.when(F.size(inner) == 0, texts).otherwise(
            F.concat(texts, let(generic_items(inner), lambda below: level(below, depth - 1)))
        )

    return let(generic_items(F.array(v)), lambda items: level(items, K.GENERIC_LEVELS))


def clean_candidates(values: Column) -> Column:
    """Valid candidates, distinct and sorted."""
    return _apart(values, lambda found: F.sort_array(F.array_distinct(F.filter(found, valid_candidate))))


def candidate_rows(alerts: DataFrame) -> DataFrame:
    """Long form: one row per alert and candidate.

    The outer explode keeps the optimizer from adding a filter on the array, which would extract twice.
    """
    return alerts.select("alert_key", "source_siem", F.explode_outer("extracted_iocs").alias("value")).filter(
        "value IS NOT NULL"
    )


def entity_candidates(incidents: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates of entities kept in their own table (``alert_key``, ``entity`` VARIANT), in long form.

    Incidents without entities stay, with a NULL value. Distinct pairs are formed before the join, so entities
    of one incident are never gathered in one row.
    """
    pairs = (
        entities.select("alert_key", F.explode_outer(entity_values(F.col("entity"))).alias("value"))
        .filter(valid_candidate(F.col("value")))
        .distinct()
    )
    return incidents.join(pairs, "alert_key", "left")
