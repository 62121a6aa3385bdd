"""Small column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from iocweave.constants import WHITESPACE


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends.

    A search among all blanks costs several times as much as two comparisons, and most texts begin and end with a
    visible ASCII character, so those are let through.
    """
    seen = lambda at: F.substring(text, at, 1).between("!", "~")
    return F.when(seen(1) & seen(-1), text).otherwise(F.trim(text, F.lit(WHITESPACE)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name ``value`` inside ``body`` so that it is written (and computed) once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def choose(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """``table[key]`` as a CASE expression, which stays inside generated code."""
    out = None
    for k, v in table.items():
        cond = key == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def ordered_distinct(items: Column) -> Column:
    """Distinct elements in order of first occurrence."""
    return F.array_distinct(items)


def drop_blank(items: Column) -> Column:
    """The non-empty elements of an array; an absent array gives an empty one."""
    empty = F.array().cast("array<string>")
    return F.filter(F.coalesce(items, empty), lambda t: t.isNotNull() & (t != ""))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def nonempty(text: Column) -> Column:
    """NULL where the text is empty, so that ``coalesce`` acts like a truth test."""
    return F.nullif(text, F.lit(""))


def seconds_between(end: Column, start: Column) -> Column:
    """Exact difference of two timestamps in seconds, as DOUBLE."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros.cast("double") / F.lit(1e6)


def round_exact(value: Column, digits: int) -> Column:
    """Round the binary value of a DOUBLE, ties to even.

    ``round`` works on the shortest decimal text, which turns 15.075 (binary 15.07499...) into 15.08. Here the
    product with 10**digits is split into the rounded product and its exact error, which decides near a tie.
    """
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        spread = x * 134217729.0
        high = spread - (spread - x)
        product = x * scale
        error = (high * scale - product) + (x - high) * scale
        floor = F.floor(product).cast("double")
        rest = (product - floor) - 0.5
        up = (rest > 0) | ((rest == 0) & ((error > 0) | ((error == 0) & (floor % 2 == 1))))
        return F.when(up, floor + 1.0).otherwise(floor) / scale

    # A rounded product that is no tie lies on the same side of it as the exact one, so its error matters on ties only.
    # ``let`` is interpreted; the common case is not.
    product = value * scale
    floor = F.floor(product).cast("double")
    rest = (product - floor) - 0.5
    return F.when(rest == 0, let(value, rounded)).when(rest > 0, (floor + 1.0) / scale).otherwise(floor / scale)
