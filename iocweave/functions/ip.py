"""IP address tests and canonical text as native column expressions.

An IPv4 test is one regular expression on the text. An IPv6 address becomes 32 lower-case hex digits, on which a
network test is a string ``BETWEEN``; that work runs only for text with a colon. Nothing leaves the JVM.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"(?:{_OCTET}\.){{3}}{_OCTET}\z"
IPV4_RE = rf"^{_QUAD}"
_PUBLIC_V4_RE = rf"^(?!{K.V4_REFUSED}){_QUAD}"
_REFUSED_V4_RE = rf"^(?={K.V4_REFUSED}){_QUAD}"
_REFUSED_CANDIDATE_RE = rf"^(?={K.V4_CANDIDATE_REFUSED}){_QUAD}"
_V6_SHAPE_RE = r"^[0-9A-Fa-f:.]{2,45}(?:%[^%]+)?\z"
_V6_EDGE_RE = r"^:(?!:)|(?<!:):\z|:::"
_GROUP_RE = r"^[0-9a-f]{1,4}\z"


def is_ipv4(text: Column) -> Column:
    return text.rlike(IPV4_RE)


def _quad_groups(quad: Column) -> Column:
    """The two hex groups that a dotted quad stands for."""

    def groups(o: Column) -> Column:
        two = lambda i: F.hex(F.get(o, F.lit(i)).try_cast("bigint") * 256 + F.get(o, F.lit(i + 1)).try_cast("bigint"))
        return F.lower(F.concat(two(0), F.lit(":"), two(2)))

    return let(F.split(quad, r"\."), groups)


def ipv6_hex(text: Column) -> Column:
    """32 hex digits of a valid IPv6 address (zone id ignored), NULL otherwise."""
    addr = F.lower(F.substring_index(text, "%", 1))

    def plain(a: Column) -> Column:
        tail = F.substring_index(a, ":", -1)
        head = F.substring(a, F.lit(1), F.length(a) - F.length(tail))
        mixed = F.when(is_ipv4(tail), F.concat(head, _quad_groups(tail)))
        return F.when(a.rlike(_V6_EDGE_RE), None).when(tail.contains("."), mixed).otherwise(a)

    def groups(a: Column) -> Column:
        def halves(h: Column) -> Column:
            def pack(p: Column) -> Column:
                left, right = F.get(p, F.lit(0)), F.get(p, F.lit(1))
                fill = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
                return F.when(F.size(left) + F.size(right) <= 7, F.concat(left, fill, right))

            parts = F.transform(h, lambda x: F.filter(F.split(x, ":"), lambda g: g != ""))
            return F.when(F.size(h) == 1, F.split(a, ":")).when(F.size(h) == 2, let(parts, pack))

        return let(F.split(a, "::"), halves)

    def digits(g: Column) -> Column:
        ok = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike(_GROUP_RE))
        return F.when(ok, F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))

    shaped = text.contains(":") & text.rlike(_V6_SHAPE_RE)
    return F.when(shaped, let(let(let(addr, plain), groups), digits))


def is_ipv6(text: Column) -> Column:
    return F.when(text.contains(":"), ipv6_hex(text).isNotNull()).otherwise(False)


def _v6_in(hex32: Column, blocks: list[str]) -> Column:
    nets = [ipaddress.ip_network(b) for b in blocks]
    return reduce(lambda a, b: a | b, [hex32.between(f"{int(n[0]):032x}", f"{int(n[-1]):032x}") for n in nets])


def v6_refused(hex32: Column) -> Column:
    return _v6_in(hex32, K.V6_REFUSED) & ~_v6_in(hex32, K.V6_REFUSED_EXCEPT)


def ipv6_text(hex32: Column, text: Column) -> Column:
    """Canonical text of a parsed IPv6 address, with the zone id of the input."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.regexp_replace(F.substring(hex32, i * 4 + 1, F.lit(4)), "^0{1,3}", ""),
    )

    def compress(bounded: Column) -> Column:
        """Replace the longest (leftmost) run of two or more zero groups by ``::``."""
        out = None
        for run in range(8, 1, -1):
            zeros = ":" + "0:" * run
            at = F.instr(bounded, zeros)
            head = F.substring(bounded, F.lit(2), F.greatest(at - 2, F.lit(0)))
            rest = F.substring(bounded, at + len(zeros), F.length(bounded))
            short = F.concat(head, F.lit("::"), F.rtrim(rest, F.lit(":")))
            out = F.when(at > 0, short) if out is None else out.when(at > 0, short)
        return out.otherwise(F.trim(bounded, F.lit(":")))

    zone = F.when(text.contains("%"), F.concat(F.lit("%"), F.substring_index(text, "%", -1))).otherwise("")
    return F.concat(let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), compress), zone)


def is_private_ip(text: Column) -> Column:
    """Private, loopback, link-local, multicast, reserved or unspecified; false for what is no address."""
    v6 = let(ipv6_hex(text), lambda h: F.coalesce(v6_refused(h), F.lit(False)))
    return F.when(text.contains(":"), v6).otherwise(text.rlike(_REFUSED_V4_RE))


def is_ip(text: Column) -> Column:
    return F.when(text.contains(":"), ipv6_hex(text).isNotNull()).otherwise(is_ipv4(text))


def is_public_ip(text: Column) -> Column:
    v6 = let(ipv6_hex(text), lambda h: F.coalesce(~v6_refused(h), F.lit(False)))
    return F.when(text.contains(":"), v6).otherwise(text.rlike(_PUBLIC_V4_RE))


def canonical_ip(text: Column) -> Column:
    """Canonical text of an address: an IPv4 address has only one form."""
    return F.when(text.contains(":"), let(ipv6_hex(text), lambda h: ipv6_text(h, text))).otherwise(text)


def normalise_ip(text: Column) -> Column:
    """Canonical text of a public address, NULL otherwise."""
    return F.when(is_public_ip(text), canonical_ip(text))


def valid_candidate(text: Column) -> Column:
    """Keep rule for values found in alerts; a dotted quad that is no address is kept."""
    return (F.length(text) >= 4) & ~text.isin(K.CANDIDATE_REFUSED) & ~text.rlike(_REFUSED_CANDIDATE_RE)
