"""PII pseudonyms: validated numbers, dates and addresses, permuted within their format by a keyed Feistel network.

Equal values have equal pseudonyms in every document, a pseudonym is a valid value of the
same format, and the holder of the key can undo it. No table of values is kept and
nothing is shuffled.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordscan import stretches

ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1


class Feistel:
    """A keyed permutation of 0 .. size - 1: a Feistel network on two near-equal moduli, walked until it lands inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, k: int, half: int, modulus: int) -> int:
        data = b"%b|%d|%d" % (tweak, k, half)
        width = (modulus.bit_length() + 71) // 8
        out = b"".join(hashlib.blake2b(data + b"|%d" % i, key=self.key).digest() for i in range((width + 63) // 64))
        return int.from_bytes(out[:width], "big") % modulus

    def permuted(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        if size < 2:
            return value
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if k % 2:
                    move = self._round(tweak, k, left, b)
                    right = (right - move if back else right + move) % b
                else:
                    move = self._round(tweak, k, right, a)
                    left = (left - move if back else left + move) % a
            value = left * b + right
            if value < size:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit to append to ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refilled(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in template)


def _only_digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _digits(f: Feistel, s: str, kind: bytes, back: bool, keep: int = 0) -> str:
    """All digits after the first ``keep`` permuted; the rest of ``s`` stays."""
    d = _only_digits(s)
    body = d[keep:]
    return _refilled(s, d[:keep] + str(f.permuted(int(body), 10 ** len(body), b"%b%d%b" % (kind, len(d), d[:keep].encode()), back)).zfill(len(body)))


def _in_classes(f: Feistel, s: str, tweak: bytes, back: bool) -> str:
    """Lower-case letters, capitals and digits of ``s`` permuted as one number, each within its class; the rest stays."""
    bases = [(ord("a"), 26) if "a" <= c <= "z" else (ord("A"), 26) if "A" <= c <= "Z" else (ord("0"), 10) if "0" <= c <= "9" else None for c in s]
    value, size = 0, 1
    for c, b in zip(s, bases, strict=True):
        if b:
            value, size = value * b[1] + ord(c) - b[0], size * b[1]
    value = f.permuted(value, size, tweak, back)
    out = []
    for c, b in zip(reversed(s), reversed(bases), strict=True):
        if b:
            value, d = divmod(value, b[1])
            c = chr(b[0] + d)
        out.append(c)
    return "".join(reversed(out))


def _card(f: Feistel, s: str, back: bool) -> str | None:
    d = _only_digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = str(f.permuted(int(d[:-1]), 10 ** (len(d) - 1), b"card%d" % len(d), back)).zfill(len(d) - 1)
    return _refilled(s, body + luhn_digit(body))


def _account(f: Feistel, s: str, back: bool) -> str | None:
    """A run of 13 to 19 digits that is no valid card number; walked so that it never becomes one."""
    d = _only_digits(s)
    if luhn_digit(d[:-1]) == d[-1]:
        return None
    while True:
        s = _digits(f, s, b"account", back)
        d = _only_digits(s)
        if luhn_digit(d[:-1]) != d[-1]:
            return s


def _iban(f: Feistel, s: str, back: bool) -> str | None:
    """Letters and digits of the account part, within their classes; check digits are made anew, and only those that can be made (02 to 98) are valid."""
    plain = s.replace(" ", "").upper()
    as_number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(plain) <= 34 or not 2 <= int(plain[2:4]) <= 98 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _in_classes(f, plain[4:], b"iban" + plain[:2].encode(), back)
    check = 98 - as_number(body + plain[:2] + "00") % 97
    it = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in s)


def _ssn(f: Feistel, s: str, back: bool) -> str | None:
    area, group, serial = (int(x) for x in s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [*range(1, 666), *range(667, 900)]
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(f.permuted(value, len(areas) * 99 * 9999, b"ssn", back), 9999)
    area, group = divmod(rest, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _ipv4(f: Feistel, s: str, back: bool) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    value = f.permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ipv4", back)
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def _phone(f: Feistel, s: str, back: bool) -> str | None:
    d = _only_digits(s)
    code = len(_only_digits(re.match(r"\+[0-9]{1,3}", s)[0])) if s[0] == "+" else 0
    return _digits(f, s, b"phone", back, code) if 8 <= len(d) <= 15 and len(d) - code >= 7 else None


def _date(order: str) -> Callable[[Feistel, str, bool], str | None]:
    def change(f: Feistel, s: str, back: bool) -> str | None:
        parts = dict(zip(order, re.findall("[0-9]+", s), strict=True))
        try:
            day = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"])).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + f.permuted(day, DAYS, b"date", back))
        fields = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        it = iter(order)
        return re.sub("[0-9]+", lambda _: fields[next(it)], s)

    return change


def _email(f: Feistel, s: str, back: bool) -> str | None:
    """Letters and digits of the local part, within their classes; the domain stays, and is part of the key."""
    local, _, domain = s.partition("@")
    return _in_classes(f, local, b"email" + domain.lower().encode(), back) + "@" + domain


# Kind, pattern. An earlier kind wins where two begin at one place.
KINDS: list[tuple[str, str, Callable[[Feistel, str, bool], str | None]]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}\b", _email),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", _iban),
    ("date_iso", r"(?<![0-9.-])[12][0-9]{3}-[0-9]{2}-[0-9]{2}(?![0-9-])", _date("ymd")),
    ("date_dmy", r"(?<![0-9./-])[0-9]{2}[./][0-9]{2}[./][12][0-9]{3}(?![0-9])", _date("dmy")),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    ("ipv4", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ipv4),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])", _phone),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
    ("account", r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])", _account),
]
PATTERN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS))
EACH = {kind: (re.compile(pattern), change) for kind, pattern, change in KINDS}


#: Lengths of IBANs by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 "
    "LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}  # fmt: skip
SEPARATORS = re.compile("[ -]")
#: What stands behind a match whose last digits may belong to a value of their own.
GOES_ON = re.compile("[ -]?[0-9]|[A-Za-z@]|[._%+/:-][A-Za-z0-9@]")


def _ends(kind: str, here: re.Match[str]) -> list[int]:
    """Where the value of this match may end, in the order of trial: cards and IBANs before any separator, too.

    The whole match is first, unless its end may belong to what follows; then the shortest
    is, so that the choice never depends on digits that get a pseudonym of their own. An
    IBAN of its country's length is before all others.
    """
    text, start, end = here.string, here.start(), here.end()
    if kind not in ("card", "iban"):
        return [end]
    ends = [m.start() for m in SEPARATORS.finditer(text, start, end)]
    if not GOES_ON.match(text, end):
        ends = [end, *reversed(ends)]
    elif kind == "iban" or not ends or ends[0] - start < 13:
        ends = [*ends, end]
    if kind == "iban":
        ends.sort(key=lambda e: len(text[start:e].replace(" ", "")) != IBAN_LENGTHS.get(text[start : start + 2]))
    return ends


def _value_at(f: Feistel, text: str, start: int, back: bool) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the first valid value at ``start``: kinds in order, each at all its lengths."""
    for kind, (pattern, change) in EACH.items():
        if here := pattern.match(text, start):
            for end in _ends(kind, here):
                if (new := change(f, text[start:end], back)) is not None:
                    return kind, end, new
    return None


def _kept_apart(f: Feistel, text: str, start: int, end: int, kind: str, new: str, back: bool) -> str:
    """``new``, walked until it is found in its place as this kind at this length, which makes it reversible."""
    before, after = text[max(start - 1, 0) : start], text[end : end + 80]
    while (found := _value_at(f, before + new + after, len(before), back)) is None or found[:2] != (kind, len(before) + len(new)):
        new = EACH[kind][1](f, new, back)
    return new


def pseudonymised(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every valid value replaced, and (kind, start, end) of each in the text as given."""
    out, found, at, begin = [], [], 0, 0
    while m := PATTERN.search(text, begin):
        if value := _value_at(f, text, m.start(), back):
            kind, end, new = value
            if kind in ("card", "iban", "account"):
                new = _kept_apart(f, text, m.start(), end, kind, new, back)
            out += text[at : m.start()], new
            found.append((kind, m.start(), end))
            at = begin = end
        else:
            begin = m.start() + 1
    return "".join([*out, text[at:]]), found


def _replace(key: bytes, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in (x for whole in batches for x in stretches(whole, 1)):
            texts, spans = [], []
            for text in batch.column(1).to_pylist():
                new, found = (text, []) if not text else pseudonymised(text, f, back)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "text", "spans"]
            )

    return run


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, spans``; ``back`` undoes it with the same key.

    ``spans`` are ``struct<kind, start, end>`` in code points of the text as given. Values
    that fail their check (Luhn, modulo 97, calendar, octets) are not of that kind. Values
    that run into each other without a separator may be cut otherwise once they have changed,
    and then do not come back; all others do. A null text stays null, an empty one empty. Ids may be null or repeated. Other columns are
    ignored.
    """
    doc = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return doc.mapInArrow(_replace(key, back), f"doc_id {doc.schema['doc_id'].dataType.simpleString()}, text string, spans array<struct<kind:string,start:bigint,end:bigint>>")
