"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses.

Found values are checked (Luhn for cards, mod 97 for IBANs, octet and calendar ranges,
number plans), ranked inside the set of all valid values of their format, permuted
there by a keyed Feistel network with cycle walking, and written back in the same
format.  A pseudonym is therefore valid too, and equal values get equal pseudonyms in
every document.  Invalid look-alikes stay as they are.

The permutation is one cycle through all values of a format (a secret order, moved on by
one place), so no value is its own pseudonym unless its format has a single value.  Of
e-mail addresses the local part is permuted and the domain stays, of phones the country
code, of IBANs the country: they are part of the format.

Values are ranked, not their notations: ten digits of the North American plan have one
pseudonym with or without separators, brackets or +1, and a date has one as year-month-day,
day/month/year and month/day/year.  Other phones are linked within one country code as
written, other kinds within one length (cards) or country (IBANs).  Digits are 0 to 9;
digits of other scripts make no value.

Null texts stay null; empty texts stay empty.  Whole texts are read, in slices of about
1 MB, a longer text alone.  Where two kinds could be read, the first of ``KINDS`` in the
pattern's order wins.  Repeated rows get equal results; an empty table gives an empty
result.  Further columns are not returned, and clash with none here.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import lean, slices

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<date>\b(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})\b)"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+[1-9](?:(?:[ ./-]| ?\(|\)[ ./-]?)?[0-9]){6,15}(?!\w|[.-]\w)"
    r"|(?<![\w])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\w-])"
    r"|(?<![\w+.,-])[2-9][0-9]{2}[2-9][0-9]{6}(?![\w-]|[.,][0-9]))"
)
#: ITU country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
#: Fewest and most digits after the country code where they are not 4 to 12; all numbers have 7 to 15 with it.
_DIGITS = {"+1": (10, 10), "+7": (10, 10), "+31": (9, 9), "+32": (8, 9), "+33": (9, 9), "+34": (9, 9), "+39": (6, 11), "+41": (9, 9), "+43": (4, 13), "+44": (9, 10), "+49": (5, 13)}
_AMERICAN = re.compile(r"[2-9]\d{2}[2-9]\d{6}")
_MAYBE = re.compile(r"[0-9@]")
_DAY0 = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _DAY0
#: Dates whose day is no month: one way to read them, also with the month first.  They are permuted among themselves, and so are all others.
_LATE = [d for d in range(_DAYS) if datetime.date.fromordinal(d + _DAY0).day > 12]
_EARLY = [d for d in range(_DAYS) if datetime.date.fromordinal(d + _DAY0).day <= 12]


class Feistel:
    """A keyed permutation of range(n) for any n, by cycle walking."""

    def __init__(self, key: bytes, rounds: int = 10):
        self.key, self.rounds = key, rounds

    def _f(self, tweak: bytes, i: int, value: int, below: int) -> int:
        said = hashlib.blake2b(b"%d|%d|" % (i, value) + tweak, key=self.key, digest_size=16 + below.bit_length() // 8)
        return int.from_bytes(said.digest(), "big") % below

    def once(self, x: int, n: int, tweak: bytes) -> int:
        a = 1
        while a * a < n:
            a *= 2
        b = -(-n // a)
        left, right = divmod(x, b)  # left < a, right < b
        for i in range(self.rounds):
            if i % 2:
                right = (right + self._f(tweak, i, left, b)) % b
            else:
                left = (left + self._f(tweak, i, right, a)) % a
        return left * b + right

    def back(self, y: int, n: int, tweak: bytes) -> int:
        """The inverse of :meth:`once`."""
        a = 1
        while a * a < n:
            a *= 2
        b = -(-n // a)
        left, right = divmod(y, b)
        for i in reversed(range(self.rounds)):
            if i % 2:
                right = (right - self._f(tweak, i, left, b)) % b
            else:
                left = (left - self._f(tweak, i, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: bytes) -> int:
        """The value after ``x`` in the secret order: permuted, moved on by one, permuted back."""
        y = self.once(x, n, tweak)
        while y >= n:
            y = self.once(y, n, tweak)
        y = self.back((y + 1) % n, n, tweak)
        while y >= n:
            y = self.back(y, n, tweak)
        return y


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn_ok(body + c))


def _fill(shape: str, chars: str) -> str:
    """Puts new letters and digits into the places of the old ones."""
    fresh = iter(chars)
    return "".join(next(fresh) if c.isalnum() else c for c in shape)


def _mixed(value: str, permute, tweak: bytes) -> str:
    """Permutes a string within the class (digit, lower, upper) of each character."""
    x, n = 0, 1
    for c in value:
        r, at = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - 97) if c.islower() else (26, ord(c) - 65)
        x, n = x * r + at, n * r
    y, out = permute(x, n, tweak), []
    for c in reversed(value):
        r, base = (10, 48) if c.isdigit() else (26, 97) if c.islower() else (26, 65)
        y, at = divmod(y, r)
        out.append(chr(base + at))
    return "".join(reversed(out))


def _plain(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isalnum())


class Pseudonyms:
    """Pseudonyms under one key; the memo is bounded."""

    def __init__(self, key: bytes, memo: int = 100_000):
        self.feistel, self.memo, self.most = Feistel(key), {}, memo

    def _permute(self, x: int, n: int, tweak: bytes) -> int:
        return self.feistel.permute(x, n, tweak)

    def of(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None where the value is not valid for its kind."""
        if (kind, value) not in self.memo:
            if len(self.memo) >= self.most:
                self.memo.clear()
            self.memo[kind, value] = getattr(self, "_" + kind)(value)
        return self.memo[kind, value]

    def _email(self, value: str) -> str | None:
        local, domain = value.split("@", 1)
        return _fill_ascii(local, _mixed(_plain(local), self._permute, b"email")) + "@" + domain

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 13 <= len(digits) <= 19 or not luhn_ok(digits) or len(set(digits)) == 1:
            return None
        new = digits
        while new == digits or len(set(new)) == 1:  # numbers of one digit are none, so the walk goes past them
            body = _mixed(new[:-1], self._permute, b"card%d" % len(digits))
            new = body + luhn_digit(body)
        return _fill(value, new)

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        country, body = plain[:2], _mixed(plain[4:], self._permute, plain[:2].encode())
        return _fill(value, f"{country}{98 - number(body + country + '00') % 97:02d}{body}")

    def _ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rank, serial = divmod(self._permute(rank, 898 * 99 * 9999, b"ssn"), 9999)
        area, group = divmod(rank, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, value: str) -> str | None:
        if re.fullmatch(r"\d{10}", value):
            return self._american(value)
        plain = re.fullmatch(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}", value)
        country = re.match(r"\+\d{1,3}(?=[ .(-])", value) if plain else _COUNTRY.match(value)
        head = country.group(0) if country else ""
        if not plain and (not head or value.count("(") != value.count(")")):
            return None
        trunk = re.match(r" ?\(0\)", value[len(head):])
        shown = head + (trunk.group(0) if trunk else "")
        rest = value[len(shown):]
        digits = re.sub(r"\D", "", rest)
        if plain:
            fits = 8 <= len(digits) <= 14
        else:
            least, most = _DIGITS.get(head, (4, 12))
            fits = least <= len(digits) <= most and 7 <= len(head) - 1 + len(digits) <= 15
        if not fits:
            return None
        if head in ("", "+1") and len(digits) == 10 and not trunk:
            return shown + _fill(rest, self._american(digits))
        return shown + _fill(rest, _mixed(digits, self._permute, b"phone" + head.encode()))

    def _american(self, digits: str) -> str:
        """Ten digits, in any notation; where area and exchange begin with 2 to 9 so do the new ones, and other numbers stay others."""
        if not _AMERICAN.fullmatch(digits):
            new = _mixed(digits, self._permute, b"phone")
            while _AMERICAN.fullmatch(new):
                new = _mixed(new, self._permute, b"phone")
            return new
        rank = (int(digits[0]) - 2) * 8 * 10**8 + int(digits[1:3]) * 8 * 10**6 + (int(digits[3]) - 2) * 10**6 + int(digits[4:])
        rank, low = divmod(self._permute(rank, 64 * 10**8, b"phone10"), 10**6)
        rank, exchange = divmod(rank, 8)
        return f"{rank // 100 + 2}{rank % 100:02d}{exchange + 2}{low:06d}"

    def _ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        y = self._permute(int.from_bytes(bytes(octets), "big"), 2**32, b"ip")
        return ".".join(map(str, y.to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        iso, marks = "-" in value, re.findall(r"\D", value)
        said = re.split(r"\D", value)
        parts = [int(x) for x in said]
        year, month, day = parts if iso else parts[::-1]
        us = not iso and month > 12 >= day  # no day/month, so month/day
        if us:
            month, day = day, month
        try:
            at = datetime.date(year, month, day).toordinal() - _DAY0
        except ValueError:
            return None
        if not 0 <= at < _DAYS:
            return None
        own = _LATE if day > 12 else _EARLY
        at = own[self._permute(bisect.bisect_left(own, at), len(own), b"late date" if day > 12 else b"date")]
        new = datetime.date.fromordinal(at + _DAY0)
        width = 1 if any(len(x) == 1 for x in said) else 2
        day, month = f"{new.day:0{width}d}", f"{new.month:0{width}d}"
        a, b, c = (str(new.year), month, day) if iso else (month, day, str(new.year)) if us else (day, month, str(new.year))
        return a + marks[0] + b + marks[1] + c

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """(text with pseudonyms, [(kind, start, end) in the old text])."""
        if not _MAYBE.search(text):
            return text, []
        out, at, spans, look = [], 0, [], 0
        while m := _PATTERN.search(text, look):
            value, look = m.group(), m.end()
            new = self.of(m.lastgroup, value)
            while new is None and value[0] == "+" and (short := re.match(r"(.*\d)\)?[ ./-]", value)):  # other digits may follow a number
                value = short.group(1)
                new = self.of(m.lastgroup, value)
            if new is not None:
                look = m.start() + len(value)
                out += [text[at : m.start()], new]
                at = look
                spans.append((m.lastgroup, m.start(), look))
        return ("".join(out) + text[at:], spans) if spans else (text, [])


def _fill_ascii(shape: str, chars: str) -> str:
    fresh = iter(chars)
    return "".join(next(fresh) if c.isascii() and c.isalnum() else c for c in shape)


_OUT = pa.schema([("text", pa.string()), ("n_values", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))])


def pseudonymise(df: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text with pseudonyms, n_values, spans in the old text) of every row; no shuffle."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(hashlib.sha256(secret.encode()).digest())
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for value in part.column("text").to_pylist():
                    new, spans = names.replace(value) if value else (value, [])
                    rows.append({"text": new, "n_values": len(spans), "spans": [{"kind": k, "start": a, "stop": b} for k, a, b in spans]})
                out = pa.RecordBatch.from_pylist(rows, schema=_OUT)
                yield pa.RecordBatch.from_arrays([part.column("key"), *out.columns], names=[key, *_OUT.names])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"`{key}` {kind}, text string, n_values long, spans array<struct<kind:string,start:int,stop:int>>")
