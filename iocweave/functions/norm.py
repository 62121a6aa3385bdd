"""Validation and canonical form of indicator values (NULL means refused)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from iocweave import constants as K
from iocweave.functions.base import strip
from iocweave.functions.ip import canonical_ip, is_ip, is_ipv4, is_ipv6, is_public_ip

_HOST_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:@\[\]]*))"


# Each rule has two parts: a test on the stripped text, which a plan can use as a filter, and the canonical text
# of what passes. A filter on the canonical text itself would be copied below the projection, and compute it twice.


def canonical_domain(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text), F.lit(".")), r"^www\.", "")


# One expression each, on the text as it came: a name for the canonical text (``let``) would make the test interpreted.
# Of the name after ``www.``: 4 to 253 characters, a dot in it, and neither the whole of it nor its last label internal.
_DOMAIN_RE = (
    r"(?s)^(?:www\.)?+(?=.{4,253}\z)(?=[^.]*\.)"
    rf"(?!(?:{'|'.join(n.replace('.', chr(92) + '.') for n in K.INTERNAL_DOMAINS)})\z)"
    rf"(?!.*\.(?:{'|'.join(n for n in K.INTERNAL_DOMAINS if '.' not in n)})\z)"
)
_HASH_RE = {
    kind: rf"^(?!(?i:{'|'.join(K.EMPTY_DIGESTS)})\z)[0-9a-fA-F]{{{n}}}\z" for kind, n in K.HASH_LENGTH.items()
}


def _domain_ok(text: Column) -> Column:
    return F.trim(F.lower(text), F.lit(".")).rlike(_DOMAIN_RE)


def _hash_ok(text: Column, ioc_type: Column) -> Column:
    out = None
    for kind, shape in _HASH_RE.items():
        cond, test = ioc_type == kind, text.rlike(shape)
        out = F.when(cond, test) if out is None else out.when(cond, test)
    return out


def _url_ok(text: Column) -> Column:
    return text.rlike(r"^https?://[^/?#]")


def _email_ok(text: Column) -> Column:
    return text.contains("@") & (F.length(text) >= 6)


def norm_domain(text: Column) -> Column:
    return F.when(_domain_ok(text), canonical_domain(text))


def norm_url(text: Column) -> Column:
    return F.when(_url_ok(text), text)


def norm_hash(text: Column, ioc_type: Column) -> Column:
    return F.when(_hash_ok(text, ioc_type), F.lower(text))


def norm_email(text: Column) -> Column:
    return F.when(_email_ok(text), F.lower(text))


def norm_filename(text: Column, original: Column) -> Column:
    """A file name is kept as it came, not stripped."""
    return F.when(F.length(text) >= 2, original)


def canonical(value: Column, ioc_type: Column) -> Column:
    """Canonical text of a value that passes the test of its type."""
    text = strip(value)
    return (
        F.when(ioc_type == K.IP, canonical_ip(text))
        .when(ioc_type == K.DOMAIN, canonical_domain(text))
        .when(ioc_type == K.URL, text)
        .when(ioc_type.isin([*K.HASH_LENGTH, K.EMAIL]), F.lower(text))
        .when(ioc_type == K.FILENAME, value)
    )


def accepted(value: Column, ioc_type: Column) -> Column:
    """Whether a value passes the test of its type; blank input, which no test accepts, and unknown types do not."""
    text = strip(value)
    test = (
        F.when(ioc_type == K.IP, is_public_ip(text))
        .when(ioc_type == K.DOMAIN, _domain_ok(text))
        .when(ioc_type == K.URL, _url_ok(text))
        .when(ioc_type.isin(list(K.HASH_LENGTH)), _hash_ok(text, ioc_type))
        .when(ioc_type == K.EMAIL, _email_ok(text))
        .when(ioc_type == K.FILENAME, F.length(text) >= 2)
    )
    return F.coalesce(test, F.lit(False))


def normalise(value: Column, ioc_type: Column) -> Column:
    """Canonical value by type; NULL for blank, invalid or unknown input."""
    return F.when(accepted(value, ioc_type), canonical(value, ioc_type))


def url_hostname(url: Column) -> Column:
    """Lower-case host part of a URL, empty where there is none."""
    clean = F.translate(strip(url), "\t\r\n", "")
    bracketed = F.regexp_extract(clean, _HOST_RE, 1)
    return F.lower(F.when(bracketed != "", bracketed).otherwise(F.regexp_extract(clean, _HOST_RE, 2)))


def host_from_url(url: Column) -> Column:
    """Host of a URL if it contains a dot."""
    host = url_hostname(url)
    return F.when(host.contains("."), host)


def classify_host(host: Column) -> Column:
    return F.when(is_ip(host), K.IP).otherwise(K.DOMAIN)


def infer_ioc_type(value: Column) -> Column:
    """Best guess of the type of a bare value, NULL if none fits."""
    return (
        F.when(is_ipv4(value) | (value.contains(":") & is_ipv6(value)), K.IP)
        .when(value.rlike(r"^[0-9a-fA-F]{64}\z"), K.SHA256)
        .when(value.rlike(r"^[0-9a-fA-F]{32}\z"), K.MD5)
        .when(value.startswith("http://") | value.startswith("https://"), K.URL)
        .when(value.contains(".") & ~value.contains(" "), K.DOMAIN)
    )
