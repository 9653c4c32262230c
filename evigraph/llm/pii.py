"""Personal data: keyed format-preserving pseudonyms by Feistel permutations.

Found values (e-mail, phone, card, IPv4, social security number, IBAN, date, secret) are checked (Luhn, mod 97, octets,
calendar, area numbers) and permuted within their own format: digits stay digits, letters keep their case, check digits
are made anew, dates stay dates. Equal values get equal pseudonyms in all documents, different ones different
pseudonyms, and none stays as it is. What fails its check is left alone.

Every pattern is tried at a trigger character and reads a bounded stretch, so time is linear in the text's length.

Defined results: null stays null, empty stays empty, repeated and equal rows change alike, no rows in, no rows out;
all other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "date", "secret")
ROUNDS = 8
#: Characters of a secret that are permuted together.
SECRET_BLOCK = 512
#: Days that dates are permuted within: each year block keeps its number of digits.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_HEX = "0123456789abcdef"

_TRIGGER = re.compile(r"[@=:+(]|\d+|AKIA")
_LOCAL = re.compile(r"[\w%+-][\w.%+-]{0,63}$")
_DOMAIN = re.compile(r"[\w-]{1,63}(?:\.[\w-]{1,63}){0,8}\.[A-Za-z]{2,24}(?!\w)")
_SECRET_NAME = re.compile(r"(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}$", re.IGNORECASE)
_SECRET_VALUE = re.compile(r"\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{6,})")
_ACCESS = re.compile(r"AKIA([0-9A-Z]{16})(?!\w)")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\w|\.\d)")
#: A time may follow a date with its year first.
_DATE = re.compile(r"(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:(?=T\d\d:?\d\d)|(?!\w|[-/.]\d))|(\d{1,2})([-/.])(\d{1,2})\6(\d{4})(?!\w|[-/.]\d))")
_SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})(?!\w|-\d)")
#: North American numbers have ten digits; others two to five groups after the country code; without a code only the first form counts.
_PHONE = re.compile(
    r"(?:\+(?P<c1>1)[ .-]?(?P<b1>\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4})|\+(?P<c2>[2-9]\d{0,2})[ .-]?(?P<b2>\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4})|(?P<b3>\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}))(?!\w|[-.]\d)"
)
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?!\w|-\d)")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")


class Permutation:
    """A keyed bijection of 0..n-1 without fixed points: a rotation between a Feistel permutation and its inverse."""

    def __init__(self, key: bytes, n: int, tweak: bytes):
        self.n, self.key = n, hashlib.blake2b(tweak, key=key, digest_size=32).digest()
        self.a = 1 << ((n - 1).bit_length() + 1) // 2
        self.b = -(-n // self.a)
        self.size = max(8, ((max(self.a, self.b)).bit_length() + 7) // 8 + 8)
        self.shift = 1 + int.from_bytes(self._digest(b"shift"), "little") % (n - 1) if n > 1 else 0

    def _digest(self, data: bytes) -> bytes:
        return hashlib.blake2b(data, key=self.key, digest_size=min(64, self.size)).digest()

    def _round(self, i: int, x: int) -> int:
        return int.from_bytes(self._digest(bytes([i]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "little")), "little")

    def _once(self, x: int, back: bool) -> int:
        left, right = x % self.a, x // self.a  # below a and below b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(i, left)) % self.b
            else:
                left = (left + sign * self._round(i, right)) % self.a
        return right * self.a + left

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x

    def __call__(self, x: int) -> int:
        return self._walk((self._walk(x, False) + self.shift) % self.n, True) if self.n > 1 else x


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permutation = functools.lru_cache(1024)(lambda n, tweak: Permutation(self.key, n, tweak))
        self.chars = functools.lru_cache(50_000)(self._chars)

    def _chars(self, value: str, kind: str, alphabet: str = "") -> str:
        """Letters and digits permuted together, each within its own alphabet; all else stays."""
        places = [(alphabet, alphabet.index(c)) if c in alphabet and alphabet else _PLACE.get(c) for c in value]
        n, x, shape = 1, 0, []
        for p in places:
            if p:
                x, n = x * len(p[0]) + p[1], n * len(p[0])
                shape.append(str(len(p[0])))
        if n == 1:
            return value
        x = self.permutation(n, f"{kind} {' '.join(shape)}".encode())(x)
        out = []
        for c, p in zip(reversed(value), reversed(places), strict=True):
            if p:
                x, k = divmod(x, len(p[0]))
                c = p[0][k]
            out.append(c)
        return "".join(reversed(out))

    def _refill(self, shape: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def email(self, local: str, domain: str) -> str:
        return f"{self.chars(local, 'email ' + domain.lower())}@{domain}"

    def card(self, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        body = self.chars(digits[:-1], "card")
        return self._refill(value, body + str(-_luhn_sum(body + "0") % 10))

    def ip(self, octets: tuple[str, ...]) -> str:
        x = self.permutation(1 << 32, b"ip")(sum(int(o) << 8 * (3 - i) for i, o in enumerate(octets)))
        return ".".join(str(x >> 8 * (3 - i) & 255) for i in range(4))

    def ssn(self, area: str, group: str, serial: str) -> str:
        """Over areas 1 to 899 but 666, groups 1 to 99, serials 1 to 9999."""
        place = int(area) - 1 - (int(area) > 666)
        x = self.permutation(898 * 99 * 9999, b"ssn")((place * 99 + int(group) - 1) * 9999 + int(serial) - 1)
        x, serial_ = divmod(x, 9999)
        place, group_ = divmod(x, 99)
        return f"{place + 1 + (place >= 665):03}-{group_ + 1:02}-{serial_ + 1:04}"

    def iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        body = self.chars(plain[4:], "iban " + plain[:2])
        made = plain[:2] + f"{98 - _mod97(plain[:2] + '00' + body):02}" + body
        it = iter(made)
        return "".join(c if c == " " else next(it) for c in value)

    def date(self, day: int) -> datetime.date:
        return datetime.date.fromordinal(FIRST_DAY + self.permutation(LAST_DAY - FIRST_DAY + 1, b"date")(day - FIRST_DAY))

    def secret(self, value: str) -> str:
        """Of long values, a block at a time: each block's permutation depends on what the one before became."""
        alphabet = _HEX if len(value) >= 16 and all(c in _HEX for c in value) else ""
        made = self.chars(value[:SECRET_BLOCK], "secret", alphabet)
        for at in range(SECRET_BLOCK, len(value), SECRET_BLOCK):
            made += self._chars(value[at : at + SECRET_BLOCK], f"secret {made[-SECRET_BLOCK:]}", alphabet)
        return made

    def _number(self, text: str, at: int, last: int) -> tuple[int, int, str, str] | None:
        before = text[at - 1] if at else " "
        if before.isalnum() or before == "_":
            if at - 2 >= last and before.isupper() and (m := _IBAN.match(text, at - 2)) and not (at > 2 and (text[at - 3].isalnum())):
                plain = m[0].replace(" ", "")
                if 15 <= len(plain) <= 34 and _mod97(plain) == 1:
                    return at - 2, m.end(), "iban", self.iban(m[0])
            return None
        if before in "-." and at > 1 and text[at - 2].isdigit():
            return None
        if (m := _IP.match(text, at)) and all(int(o) < 256 for o in m.groups()):
            return at, m.end(), "ip", self.ip(m.groups())
        if (m := _DATE.match(text, at)) and (found := self._date(m)):
            return at, m.end(), "date", found
        if (m := _SSN.match(text, at)) and 0 < int(m[1]) < 900 and m[1] != "666" and int(m[2]) and int(m[3]):
            return at, m.end(), "ssn", self.ssn(*m.groups())
        value = m[0] if (m := _CARD.match(text, at)) else ""
        while len(digits := re.sub(r"\D", "", value)) >= 13:
            if luhn(digits) and len(set(digits)) > 1:
                return at, at + len(value), "card", self.card(value)
            value = value[: max(value.rfind(" "), value.rfind("-"), 0)]  # the last group may be another number
        return self._phone(text, at)

    def _phone(self, text: str, at: int) -> tuple[int, int, str, str] | None:
        if not (m := _PHONE.match(text, at)):
            return None
        body, code = m["b1"] or m["b2"] or m["b3"], m["c1"] or m["c2"] or ""
        digits = re.sub(r"\D", "", body)
        if not 7 <= len(digits) + len(code) <= 15 or body.count("(") != body.count(")"):
            return None
        made = self._refill(body, self.chars(digits, f"phone {code}"))
        return at, m.end(), "phone", text[at : m.end() - len(body)] + made

    def _date(self, m: re.Match) -> str | None:
        if m[1]:
            year, mark, month, day = m[1], m[2], m[3], m[4]
        else:
            day, mark, month, year = m[5], m[6], m[7], m[8]
        swapped = int(month) > 12 and not m[1]  # month first
        if swapped:
            day, month = month, day
        try:
            ordinal = datetime.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= ordinal <= LAST_DAY:
            return None
        made = self.date(ordinal)
        if m[1]:
            return f"{made.year}{mark}{made.month:02}{mark}{made.day:02}"
        first, second = (made.month, made.day) if swapped else (made.day, made.month)
        return f"{first:02}{mark}{second:02}{mark}{made.year}"

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with its values permuted, and the kinds of what was found, in order."""
        out, kinds, last = [], [], 0
        for trigger in _TRIGGER.finditer(text):
            at = trigger.start()
            if at < last:
                continue
            found, char = None, text[at]
            if char == "@":
                if (a := _LOCAL.search(text[max(last, at - 64) : at])) and (b := _DOMAIN.match(text, at + 1)):
                    found = at - len(a[0]), b.end(), "email", self.email(a[0], b[0])
            elif char in "=:":
                if _SECRET_NAME.search(text[max(last, at - 24) : at]) and (m := _SECRET_VALUE.match(text, at + 1)):
                    found = m.start(1), m.end(1), "secret", self.secret(m[1])
            elif char in "+(":
                found = self._phone(text, at)
            elif char == "A":
                if (m := _ACCESS.match(text, at)) and not (at and text[at - 1].isalnum()):
                    found = m.start(1), m.end(1), "secret", self.chars(m[1], "secret", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
            else:
                found = self._number(text, at, last)
            if found:
                begin, end, kind, made = found
                out += (text[last:begin], made)
                kinds.append(kind)
                last = end
        if not kinds:
            return text, kinds
        out.append(text[last:])
        return "".join(out), kinds


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in ``text`` permuted under the key."""
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key)
        for batch in batches:
            new = [t if t is None else made.replace(t)[0] for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(run, schema)


def pseudonyms_and_counts(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_email, n_phone, ...): the changed texts and how many values of each kind they held."""
    fields = [*docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).schema.fields, *(StructField(f"n_{k}", LongType()) for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key)
        for batch in batches:
            found = [(None, []) if t is None else made.replace(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([kinds.count(k) for _, kinds in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), *counts], names=[f.name for f in fields])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, StructType(fields))
