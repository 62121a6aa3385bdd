"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value found in a text is checked (Luhn and IBAN check digits, octets, real dates), read as an integer below the number
of values of its format, and permuted by a keyed Feistel network with cycle walking. The result is written in the same
format with valid check digits. Equal values get equal pseudonyms in every document, however they are written.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iocweave.llm.common import same_columns

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1
KINDS = ("email", "secret", "iban", "card", "phone", "ssn", "ip", "date")

#: Runs before an ``@`` that a domain follows. A run is entered at its start only, so a text without them is read once.
MAILS = re.compile(r"(?<![\w.%+-])(?P<run>[\w.%+-]++)@(?=(?P<domain>(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}))")
#: The other kinds; their lengths are bounded.
PATTERN = re.compile(
    r"(?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![0-9.,-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
    r"|(?P<phone>(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4})(?![0-9]|[./-][0-9]))",
)


def permute(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(n): a balanced Feistel network, walked until the result is below n."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    size = -(-half // 8)
    while True:
        a, b = x >> half, x & low
        for r in range(ROUNDS):
            mixed = hashlib.blake2b(
                bytes([r]) + n.to_bytes(-(-n.bit_length() // 8), "big") + tweak + b.to_bytes(size, "big"),
                key=key, digest_size=min(64, size + 8),
            ).digest()
            a, b = b, a ^ (int.from_bytes(mixed, "big") & low)
        x = a << half | b
        if x < n:
            return x


def restore(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """The inverse of ``permute``."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    size = -(-half // 8)
    while True:
        a, b = x >> half, x & low
        for r in range(ROUNDS - 1, -1, -1):
            mixed = hashlib.blake2b(
                bytes([r]) + n.to_bytes(-(-n.bit_length() // 8), "big") + tweak + a.to_bytes(size, "big"),
                key=key, digest_size=min(64, size + 8),
            ).digest()
            a, b = b ^ (int.from_bytes(mixed, "big") & low), a
        x = a << half | b
        if x < n:
            return x


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _refill(shape: str, letters: Callable[[str], bool], new: str) -> str:
    """``shape`` with its characters that count replaced in order."""
    fresh = iter(new)
    return "".join(next(fresh) if letters(c) else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_digit(c: str) -> bool:
    return "0" <= c <= "9"


def _mixed(text: str, move: Callable[[int, int, bytes, bytes], int], key: bytes, tweak: bytes) -> str:
    """Permutes ASCII digits among digits and letters among letters of their case, all together as one number."""
    spots = [(i, c) for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    n, x = 1, 0
    for _, c in spots:
        base, first = (10, "0") if c.isdigit() else (26, "A" if c.isupper() else "a")
        x, n = x * base + ord(c) - ord(first), n * base
    x = move(x, n, key, tweak)
    out = list(text)
    for i, c in reversed(spots):
        base, first = (10, "0") if c.isdigit() else (26, "A" if c.isupper() else "a")
        x, r = divmod(x, base)
        out[i] = chr(ord(first) + r)
    return "".join(out)


def _email(text: str, move, key: bytes) -> str | None:
    local, _, host = text.rpartition("@")
    shape = "".join("9" if c.isdigit() else "a" if c.islower() else "A" for c in local if c.isascii() and c.isalnum())
    return f"{_mixed(local, move, key, b'email' + shape.encode())}@{host}"


def _secret(text: str, move, key: bytes) -> str | None:
    upper = text.upper() == text and text.lower() != text
    x = move(int(text, 16), 16 ** len(text), key, b"secret")
    new = f"{x:0{len(text)}x}"
    return new.upper() if upper else new


def _iban_value(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(text: str, move, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_value(plain[4:] + plain[:4]) % 97 != 1:
        return None
    shape = "".join("9" if c.isdigit() else "A" for c in plain[4:])
    body = _mixed(plain[4:], move, key, b"iban" + plain[:2].encode() + shape.encode())
    new = f"{plain[:2]}{98 - _iban_value(body + plain[:2] + '00') % 97:02d}{body}"
    return _refill(text, lambda c: c != " ", new)


def _card(text: str, move, key: bytes) -> str | None:
    digits = _digits(text)
    if not luhn_ok(digits):
        # Separate numbers may stand side by side.
        runs = re.split(r"([ -])", text)
        if len(runs) == 1:
            return None
        new = [_card(r, move, key) if 13 <= len(r) <= 19 else None for r in runs]
        return "".join(n or r for n, r in zip(new, runs, strict=True)) if any(new) else None
    body = f"{move(int(digits[:-1]), 10 ** (len(digits) - 1), key, b'card'):0{len(digits) - 1}d}"
    check = next(c for c in "0123456789" if luhn_ok(body + c))
    return _refill(text, _is_digit, body + check)


def _phone(text: str, move, key: bytes) -> str | None:
    digits = _digits(text)
    head, own = digits[:-10], digits[-10:]
    return _refill(text, _is_digit, head + f"{move(int(own), 10**10, key, b'phone'):010d}")


def _ssn(text: str, move, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    # 898 areas, 99 groups and 9999 serials are valid.
    index = area - 1 - (area > 666)
    x = move((index * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn")
    x, serial = divmod(x, 9999)
    index, group = divmod(x, 99)
    return f"{index + 1 + (index >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, move, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    x = move(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip")
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def _date(text: str, move, key: bytes) -> str | None:
    sep = "-" if text[4:5] == "-" else "." if "." in text else "/"
    a, b, c = (int(x) for x in text.split(sep))
    # Year first; day first with dots; month first with slashes unless only the day can stand there.
    year, month, day = (a, b, c) if sep == "-" else (c, b, a) if sep == "." or a > 12 else (c, a, b)
    try:
        when = datetime.date(year, month, day)
    except ValueError:
        return None
    if not FIRST_DAY <= when <= LAST_DAY:
        return None
    new = FIRST_DAY + datetime.timedelta(days=move((when - FIRST_DAY).days, DAYS, key, b"date"))
    if sep == "-":
        return new.isoformat()
    day_first = sep == "." or a > 12
    one, two = (new.day, new.month) if day_first else (new.month, new.day)
    padded = len(text) == 10
    return f"{one:02d}{sep}{two:02d}{sep}{new.year}" if padded else f"{one}{sep}{two}{sep}{new.year}"


HANDLERS = dict(zip(KINDS, (_email, _secret, _iban, _card, _phone, _ssn, _ip, _date), strict=True))


def found_values(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of everything that looks like a value, from the left; of two that begin together the address
    comes first. An address begins with the first letter or digit of its run that no value before it has taken."""
    mails = MAILS.finditer(text)
    mail, other, at = next(mails, None), PATTERN.search(text), 0
    while mail or other:
        if other and other.start() < at:
            other = PATTERN.search(text, at)
            continue
        start = None
        if mail and not (other and other.start() < max(mail.start(), at)):
            start = next((i for i in range(max(mail.start(), at), mail.end("run")) if text[i].isalnum()), None)
            if start is None:
                mail = next(mails, None)
                continue
        if start is not None and (not other or start <= other.start()):
            at = mail.end("domain")
            yield start, at, "email"
            mail = next(mails, None)
        else:
            at = other.end()
            yield other.start(), at, next(k for k in KINDS if k != "email" and other[k] is not None)
            other = PATTERN.search(text, at)


def pseudonymise(text: str, key: bytes, move=permute) -> tuple[str, Counter]:
    """The text with its personal values replaced, and how many of each kind there were. The time grows with the length
    of the text, whatever it holds."""
    counts: Counter = Counter()
    out, done = [], 0
    for start, end, kind in found_values(text):
        new = HANDLERS[kind](text[start:end], move, key)
        if new is not None:
            counts[kind] += 1
            out += [text[done:start], new]
            done = end
    out.append(text[done:])
    return "".join(out), counts


def _result(key: bytes):
    fields = "".join(f", n_{k}: long" for k in KINDS)

    @F.arrow_udf(f"struct<text: string{fields}>")
    def run(texts: pa.Array) -> pa.Array:
        out, counts = [], {k: [] for k in KINDS}
        for text in texts.to_pylist():
            # Every kind but the address has a digit.
            if text and ("@" in text or any(d in text for d in "0123456789")):
                text, found = pseudonymise(text, key)
            else:
                found = {}
            out.append(text)
            for k in KINDS:
                counts[k].append(found.get(k, 0))
        arrays = [pa.array(out, pa.string()), *[pa.array(counts[k], pa.int64()) for k in KINDS]]
        return pa.StructArray.from_arrays(arrays, ["text", *[f"n_{k}" for k in KINDS]])

    return run


def pseudonyms(text: Column, key: bytes) -> Column:
    """A struct of the new text and the number of values of each kind; a null text stays null, with no values."""
    return _result(key)(text.cast("string"))


def replace_private(documents: DataFrame, key: bytes) -> DataFrame:
    """``documents`` with pseudonyms in text; all columns and rows stay, and null ids and texts stay null.

    Every row is judged alone: repeated rows change alike, an empty text stays empty, an empty table gives no rows. A text
    is read whole, by one task, in time proportional to its length.
    """
    new = pseudonyms(F.col("text"), key)["text"]
    return documents.select(*same_columns(documents, text=new))
