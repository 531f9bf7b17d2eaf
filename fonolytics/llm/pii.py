"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Found and validated: payment cards (Luhn), IBANs (mod 97), dates (calendar),
IPv4 addresses (octets), phone numbers (length; North American ranges), US
social security numbers (ranges) and e-mail addresses (local part). A value is
read as a number within its format's domain, permuted there under the key, and
written back in the same format: separators, letter case, lengths, check digits
and validity stay. The permutation depends on the kind and the format's domain
only, so equal values have equal pseudonyms in all documents, different values
never collide within a format, and `restore` undoes it with the key.

The network is balanced over the smallest even number of bits that holds the
domain; numbers that leave the domain are permuted on until they are back in it
(cycle walking).

Results in special cases:
- a null text stays null with no findings; an empty text stays empty.
- what fails validation (a 16-digit number without a Luhn check, 2024-02-30)
  stays as it is. Of overlapping candidates the first valid one from the left
  counts, and at one place the kind that comes first in `KINDS`.
- cards and IBANs may run into what follows them (expiry date, security code,
  currency): a candidate is read in several ways that end at its separators, see
  `_readings`. The order depends on the format alone, and every reading contains
  the ones before it, so a card has the same pseudonym whatever follows, and the
  pseudonym is read as the value was. Where a candidate that failed overlaps a
  later one, that one's number is permuted on until it fails again; only then may
  a value have another pseudonym than elsewhere. A card of 13 to 15 digits in
  groups other than the usual ones isn't told from digits that follow it.
- the domain part of an e-mail address, country codes, IBAN country and length
  stay. Dates stay within their span of 200 years (1900-2099, 1700-1899, ...).
- repeated rows get equal results; rows are independent, so nothing is shuffled,
  and an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "date", "ip", "phone", "ssn", "card")

_PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]+(?=@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}([-/.])[0-9]{2}\4[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\5[0-9]{4})(?!\w|[-/.]\w))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.\w))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)"
    r"|(?<![\w+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\w)|(?<![\w+.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?!\w|-\w))"
    r"|(?P<ssn>(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w|-\w))"
    r"|(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?!\w|-\w))"
)
_MAY_HOLD = re.compile("[0-9@]")


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed bijection of 0 .. size - 1 (`back`: its inverse)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    digest_size = min(64, width + 8)

    def mixed(i: int, x: int) -> int:
        out, block = 0, 0
        while True:
            h = hashlib.blake2b(f"{tweak}|{size}|{i}|{block}|".encode() + x.to_bytes(width, "big"), key=key, digest_size=digest_size).digest()
            out = out << (8 * digest_size) | int.from_bytes(h, "big")
            block += 1
            if block * digest_size >= width:
                return out & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ mixed(i, left), left
            else:
                left, right = right, left ^ mixed(i, right)
        value = left << half | right
        if value < size:
            return value


def _mixed_radix(digits: Sequence[int], radices: Sequence[int], key: bytes, tweak: str, back: bool) -> list[int]:
    value = 0
    for d, r in zip(digits, radices):
        value = value * r + d
    value = permute(value, prod(radices), key, tweak, back)
    out = []
    for r in reversed(radices):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def _refill(form: str, chars: Sequence[str]) -> str:
    """The digits of `form` replaced in turn."""
    it = iter(chars)
    return "".join(next(it) if c.isdigit() else c for c in form)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _classes(text: str, key: bytes, tweak: str, back: bool) -> str:
    """ASCII letters and digits permuted, each within its class; other characters stay."""
    at = [(i, a) for i, c in enumerate(text) for a in _ALPHABETS if c in a]
    if not at:
        return text
    new = _mixed_radix([a.index(text[i]) for i, a in at], [len(a) for _, a in at], key, tweak, back)
    out = list(text)
    for (i, a), d in zip(at, new):
        out[i] = a[d]
    return "".join(out)


def luhn_digit(digits: Sequence[int]) -> int:
    """Check digit of a card number without it."""
    doubled = [d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return -sum(doubled) % 10


def _card(value: str, key: bytes, back: bool) -> str | None:
    digits = [int(c) for c in value if c.isdigit()]
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    new = _mixed_radix(digits[:-1], [10] * (len(digits) - 1), key, "card", back)
    return _refill(value, [str(d) for d in [*new, luhn_digit(new)]])


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _iban(value: str, key: bytes, back: bool) -> str | None:
    flat = value.replace(" ", "")
    if not 15 <= len(flat) <= 34 or int(flat[2:4]) != 98 - _iban_rest(flat[:2], flat[4:]):
        return None
    body = _classes(flat[4:], key, f"iban{flat[:2]}", back)
    it = iter(f"{flat[:2]}{98 - _iban_rest(flat[:2], body):02d}{body}")
    return "".join(c if c == " " else next(it) for c in value)


def _date(value: str, key: bytes, back: bool) -> str | None:
    first = value[4] in "-/."
    sep = value[4] if first else value[2]
    parts = [int(p) for p in value.split(sep)]
    year, (a, b) = (parts[0], parts[1:]) if first else (parts[2], parts[:2])
    for month, day, order in ((a, b, "md"), (b, a, "dm")):
        if first and order == "dm":
            return None  # year first: the month follows
        try:
            date = datetime.date(year, month, day)
        except ValueError:
            continue
        start = max(1, (year - 100) // 200 * 200 + 100)
        end = min(9999, (year - 100) // 200 * 200 + 299)
        low, high = datetime.date(start, 1, 1).toordinal(), datetime.date(end, 12, 31).toordinal()
        if not first:
            return _short_date(date, sep, low, high, order, key, back)
        new = datetime.date.fromordinal(low + permute(date.toordinal() - low, high - low + 1, key, f"date{start}", back))
        return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
    return None


def _short_date(date: datetime.date, sep: str, low: int, high: int, order: str, key: bytes, back: bool) -> str:
    """Day and month first: which is which must be readable from the pseudonym as from the value.

    A day above 12 tells; so those dates are permuted among themselves, and the others among themselves.
    """
    tells = date.day > 12
    new = date
    while True:
        new = datetime.date.fromordinal(low + permute(new.toordinal() - low, high - low + 1, key, f"date{low}{order if tells else ''}", back))
        if (new.day > 12) == tells:
            break
    x, y = (new.month, new.day) if order == "md" else (new.day, new.month)
    return f"{x:02d}{sep}{y:02d}{sep}{new.year:04d}"


def _ip(value: str, key: bytes, back: bool) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    return ".".join(map(str, _mixed_radix(octets, [256] * 4, key, "ip", back)))


def _phone(value: str, key: bytes, back: bool) -> str | None:
    digits = [int(c) for c in value if c.isdigit()]
    plus = value[0] == "+"
    if plus and not 8 <= len(digits) <= 15:
        return None
    code = len(re.match(r"\+[0-9]*", value).group()) - 1 if plus else 0
    if code > 3:  # no separator after the country code: +1, or two digits
        code = 1 if digits[0] == 1 else 2
    own = digits[code:]
    if (not plus or digits[:code] == [1]) and len(own) == 10:  # North American: area and exchange begin with 2 to 9
        if own[0] < 2 or own[3] < 2:
            return None
        shift = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
        new = _mixed_radix([d - s for d, s in zip(own, shift)], [10 - s for s in shift], key, "phone1", back)
        new = [d + s for d, s in zip(new, shift)]
    else:
        new = _mixed_radix(own, [10] * len(own), key, f"phone{''.join(map(str, digits[:code]))}", back)
    return _refill(value, [str(d) for d in [*digits[:code], *new]])


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    new = _mixed_radix([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn", back)
    return f"{new[0] + 1 + (new[0] >= 665):03d}-{new[1] + 1:02d}-{new[2] + 1:04d}"


def _email(value: str, key: bytes, back: bool) -> str:
    form = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in value)
    return _classes(value, key, f"email{form}", back)


_CHANGE: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email,
    "iban": _iban,
    "date": _date,
    "ip": _ip,
    "phone": _phone,
    "ssn": _ssn,
    "card": _card,
}


# Usual groups of card numbers; digits without separators are a group of 13 to 19.
_CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))

# Lengths of IBANs by country.
_IBAN_SIZE = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _readings(kind: str, value: str) -> list[tuple[int, int]]:
    """Spans of a candidate to validate in turn, by its format alone; each contains the ones before it.

    First what has the usual form (a card's groups, a country's IBAN length), else the first of 16 digits or more
    (a card), or the shortest (an IBAN); then the candidate's beginnings that contain it, up to the whole.
    """
    if kind not in ("card", "iban"):
        return [(0, len(value))]
    ends = [m.end() for m in re.finditer(r"[^ -]+", value)]
    sizes = [len(g) for g in re.split("[ -]", value)]
    starts = [e - n for e, n in zip(ends, sizes)]
    until = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    if kind == "iban":
        usual = [e for e, n in zip(ends, until) if n == _IBAN_SIZE.get(value[:2])]
        first = (0, usual[0] if usual else next((e for e, n in zip(ends, until) if n >= 15), len(value)))
    else:
        usual = [
            (starts[i], ends[i + len(form) - 1])
            for i in range(len(sizes))
            for form in (*_CARD_GROUPS, (sizes[i],) if sizes[i] >= 13 else ())
            if form and tuple(sizes[i : i + len(form)]) == form
        ]
        first = usual[0] if usual else (0, next((e for e, n in zip(ends, until) if n >= 16), len(value)))
    return list(dict.fromkeys([first, *((0, e) for e in ends if e >= first[1])]))


def _changed(text: str, kind: str, start: int, end: int, failed: list[tuple[str, int, int]], key: bytes, back: bool) -> str | None:
    """The new value of a valid `text[start:end]`, with which what failed before still fails; else null."""
    new = _CHANGE[kind](text[start:end], key, back)
    if new is None or len(new) != end - start:
        return new
    over = [f for f in failed if f[1] < end and f[2] > start]
    while any(_CHANGE[k]((text[:start] + new + text[end:])[a:b] if b > end or a < start else new[a - start : b - start], key, back) is not None for k, a, b in over):
        new = _CHANGE[kind](new, key, back)
    return new


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text. `back` restores a text from its pseudonyms."""
    if not _MAY_HOLD.search(text):
        return text, []
    out, found, done, size = [], [], 0, 0
    failed: list[tuple[str, int, int]] = []
    m = _PATTERN.search(text)
    while m:
        kind, at = m.lastgroup, m.start()
        failed = [f for f in failed if f[2] > at]
        for a, b in _readings(kind, m.group()):
            a, b = at + a, at + b
            new = _changed(text, kind, a, b, failed, key, back)
            if new is not None:
                out += [text[done:a], new]
                size += a - done
                found.append((kind, size, size + len(new)))
                size += len(new)
                done = b
                break
            failed.append((kind, a, b))
        # behind a candidate that failed, the next may begin within it
        m = _PATTERN.search(text, done if new is not None else at + 1)
    return "".join([*out, text[done:]]), found


def restore(text: str, key: bytes) -> str:
    return replace(text, key, back=True)[0]


def pseudonymised(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text (with pseudonyms), found: array of (kind, first, after) in code points of the new text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("after", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else replace(t, key) for t in batch.column("text").to_pylist()]
            spans = [[{"kind": k, "first": a, "after": b} for k, a, b in f] for _, f in done]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], ["id", "text", "found"])

    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, text string, found array<struct<kind: string, first: long, after: long>>"
    return own.mapInArrow(run, schema).withColumnRenamed("id", doc_id)
