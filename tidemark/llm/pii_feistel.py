"""Format-preserving pseudonyms for personal data.

A value that passes its validation (checksum, ranges, calendar) is permuted within its own format by a
keyed Feistel network, so equal values get equal pseudonyms in every document, different values get
different ones, and the pseudonym passes the same validation. What does not validate stays.

Kinds, in the order in which overlapping finds are settled:

* EMAIL: each character of the local part within its class (letter, digit, script block), case kept, so the
  same address in other case is linked; the domain stays.
* SECRET: the value after token, key, secret or password and = or :, after "Bearer", behind the customary
  prefixes of service keys (which stay), and the body of a private key block; each character within its class.
* IBAN: the account part; country stays, check digits are computed anew.
* CARD: 13 to 19 digits that pass Luhn; first digit stays, check digit is computed anew.
* SSN: ddd-dd-dddd in issued ranges.
* PHONE: the national digits; a country code (with + or 00), a trunk 0 and all punctuation stay, and the first
  digit stays within 0, 1 to 5 or 6 to 9. Only these digits enter, so one number is linked however it is written: +1 555 123 4567, +15551234567, (555) 123-4567. Bare
  runs of digits count after a word such as phone, Tel., móvil.
* IPV4: all four bytes. IPV6: all eight groups, written in the shortest form.
* DATE: calendar dates of the years 1000 to 9999, also with month names, permuted by day number within their 200
  years (1900 to 2099, ...), same layout. Two-digit years stay.

Network: a value is a sequence of digits, each with its radix, cut into two halves; a round adds a keyed stream
(SHAKE-256 of key, kind, radixes, round and other half) to one half, digit by digit. P, that bijection, gives the
pseudonym P^-1(P(x) + 1): all values of a format lie on one keyed cycle, so none is its own pseudonym, at any size
of the format and any length of the value. A lone digit is written as two, and values outside a format (or its
valid part) are walked on along the cycle. Time grows with the length of value and text.

Null texts stay null; empty texts stay empty; an empty table gives an empty one. Rows are kept as they are,
repeated ones too, and results do not hang on their order. Columns other than the text are passed on by name; the
names of the text and of the spans are parameters, so a table with columns of any name can be handled.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_batches, small_batches, table

ROUNDS = 8
#: The key of the registered queries; a real deployment passes its own.
DEMO_KEY = b"tidemark demonstration key"
KINDS = ("EMAIL", "SECRET", "IBAN", "CARD", "SSN", "PHONE", "IPV4", "IPV6", "DATE")
#: Month names, then abbreviations, of the corpus languages; a name in several lists counts for the first.
MONTHS = [
    x.split()
    for x in (
        "january february march april may june july august september october november december",
        "januar februar märz april mai juni juli august september oktober november dezember",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
        "jan feb mar apr may jun jul aug sep oct nov dec",
        "jan feb mär apr mai jun jul aug sep okt nov dez",
        "janv févr mars avr mai juin juil août sept oct nov déc",
        "ene feb mar abr may jun jul ago sep oct nov dic",
    )
]
MONTH_OF = {name: (names, i) for names in reversed(MONTHS) for i, name in enumerate(names)}
A_MONTH = "|".join(sorted(MONTH_OF, key=lambda name: (-len(name), name)))
FIRST_YEAR, SPAN = 1900, 200

EMAIL_LOCAL = re.compile(r"[\w.+%-]")
EMAIL_DOMAIN = re.compile(r"(?:[\w-]+\.)+[^\W\d_]{2,}")
SECRET = re.compile(r"""\b(?:(?:token|api[ _-]?key|access[ _-]?key|secret|password|passwd|pwd)["']?\s*[=:]\s*|bearer\s+(?=[\w.~+/-]{16}))(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"'|,;]{6,}))""", re.I)
#: Prefixes by which services mark their keys: fixed values. They stay.
SERVICE_KEY = re.compile(r"(?<![\w-])(AKIA|ASIA|AIza|eyJ|gh[opsu]_|ghr_|github_pat_|glpat-|xox[abeprs]-|[prs]k[_-](?:(?:ant|live|proj|test)[_-])*)([A-Za-z0-9_.-]{16,})")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
RUN = re.compile(r"[+(]?\d[\d ().:/-]{4,}\d")
#: In one run, in fours, or in four, six and five digits; another group may follow that is no part of the number.
CARD = re.compile(r"(?<![\d.-])(?=((\d{13,19})(?!\d|-\d|\.\d)|(\d{4}([ -])\d{4}\4\d{4}\4\d{1,4}(?!\d))(\4\d{1,3}(?![\d-]))?|(\d{4}([ -])\d{6}\7\d{5}(?!\d))))\d")
SSN = re.compile(r"(?<![\d-])(\d{3})([- ])(\d{2})\2(\d{4})(?![\d-])")
PHONE_ABROAD = re.compile(r"(?<![\w.+-])(\+|(?<!\d[ .-])00)(?=[ .-]?[1-9])((?:[ .\-/]?\(?\d\)?){7,15})(?!\w|-\d)")
PHONE_AT_HOME = (
    re.compile(r"(?<![\w.])(?:\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w|-\d)"),
    re.compile(r"(?<![\w.+-])(?<!\d[ .-])(?:0\d([ .-])\d\d(?:\1\d\d){3}|[6-9]\d\d([ .-])\d\d(?:\2\d\d){2})(?!\w|[ .-]\d)"),
    re.compile(r"(?<![\w.+-])(?<!\d[ .-])0[1-9]\d{1,4}[ /-]\d{3,4}(?: ?\d{3,5})(?!\w|[.,-]\d)"),
    re.compile(r"\b(?:t[ée]l|t[ée]l[ée]phone|telefono|teléfono|telefon|phone|mobile|mobil|móvil|cell|handy|fax|whatsapp|portable)\b[^\w\n(+]{0,4}(?:(?:nr|no|number|numéro|número|nummer)\b[^\w\n(+]{0,4})?(\(?\d(?:[ .\-/()]{0,2}\d){6,14})(?!\w)", re.I),
)
#: Country codes of one and of two digits (the others have three), and digits of the national numbers where their number is fixed.
CODES_1, CODES_2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
FIXED = {"1": 10, "7": 10, "33": 9, "34": 9, "41": 9, "44": 10, "52": 10}
IPV4 = re.compile(r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\w|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
ISO_DATE = re.compile(r"(?<![\d-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?![\d/-])")
DAY_DATE = re.compile(r"(?<![\d./-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?![\d/-])")
ORDINAL = "(st|nd|rd|th|er)?"
NAMED_DATE = re.compile(rf"(?<!\w)(?:(\d{{1,2}}){ORDINAL}(\.? (?:de |of )?)({A_MONTH})(\.?,? (?:de )?)(\d{{4}})|({A_MONTH})(\.? )(\d{{1,2}}){ORDINAL}(,? )(\d{{4}}))(?!\w)", re.I)


class Feistel:
    """Keyed permutations of sequences of digits with given radixes."""

    def __init__(self, key: bytes):
        self.keyed = hashlib.shake_256(len(key).to_bytes(8, "big") + key)

    def _network(self, x: np.ndarray, radixes: np.ndarray, kind: bytes, back: bool = False) -> np.ndarray:
        """A bijection of the sequences, or its inverse."""
        middle = (len(x) + 1) // 2
        half, size = [x[:middle], x[middle:]], [radixes[:middle], radixes[middle:]]
        tweaked = self.keyed.copy()
        tweaked.update(kind + len(x).to_bytes(8, "big") + hashlib.sha256(radixes.tobytes()).digest())
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            k = i % 2
            stream = tweaked.copy()
            stream.update(bytes([i]) + half[1 - k].astype("<u4").tobytes())
            added = np.frombuffer(stream.digest(4 * len(half[k])), "<u4").astype(np.int64)
            half[k] = (half[k] - added if back else half[k] + added) % size[k]
        return np.concatenate(half)

    def _step(self, x: np.ndarray, radixes: np.ndarray, kind: bytes, by: int) -> np.ndarray:
        y = self._network(x, radixes, kind)
        for i in range(len(y) - 1, -1, -1):  # plus or minus one, with carry
            y[i] += by
            if 0 <= y[i] < radixes[i]:
                break
            y[i] %= radixes[i]
        return self._network(y, radixes, kind, back=True)

    def digits(self, values: list[int], radixes: list[int], kind: str, valid=None, back: bool = False) -> list[int]:
        """The next sequence on the cycle of all (``valid``) ones; ``back`` gives the one before."""
        if len(values) == 1:
            side = 1 + int(radixes[0] ** 0.5)
            pair = self.digits(list(divmod(values[0], side)), [side, side], f"{kind}|{radixes[0]}", lambda p: p[0] * side + p[1] < radixes[0] and (valid is None or valid([p[0] * side + p[1]])), back)
            return [pair[0] * side + pair[1]]
        if not values:
            return []
        x, sizes = np.array(values, np.int64), np.array(radixes, np.int64)
        while True:
            x = self._step(x, sizes, kind.encode(), -1 if back else 1)
            if valid is None or valid(x.tolist()):
                return x.tolist()


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The characters that may stand for c: its class. A character outside every class stands for itself."""
    for known in ("0123456789", LOWER, UPPER):
        if c in known:
            return known
    if not c.isalnum():
        return c
    block, category = ord(c) & ~63, unicodedata.category(c)
    return "".join(x for x in map(chr, range(block, block + 64)) if unicodedata.category(x) == category)


def luhn_total(digits: list[int]) -> int:
    """Luhn sum of digits whose last is the check digit."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def issued(d: list[int]) -> bool:
    """Whether nine digits are in the ranges of social security numbers."""
    return d[0] < 9 and d[:3] not in ([0, 0, 0], [6, 6, 6]) and any(d[3:5]) and any(d[5:])


def ordinal(old: str | None, day: int) -> str:
    if not old:
        return ""
    if old.lower() == "er":
        return old if day == 1 else ""
    new = "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")
    return new.upper() if old.isupper() else new


class Pseudonymiser:
    """Finds and replaces; ``text`` gives the new text and the replaced spans.

    Each kind's method yields (start, end, new text, span that no other find may touch). With ``back`` pseudonyms
    are turned into the values they stand for.
    """

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False):
        self.feistel, self.kinds, self.back = Feistel(key), kinds, back

    def _digits(self, values: list[int], radixes: list[int], kind: str, valid=None) -> list[int]:
        return self.feistel.digits(values, radixes, kind, valid, self.back)

    def _in_class(self, text: str, kind: str) -> str:
        """Every character within its class; case stays and plays no part."""
        classes = [alphabet(c) for c in text]
        at = [i for i, c in enumerate(classes) if len(c) > 1]
        if not at:
            return text
        new = self._digits([classes[i].index(text[i]) for i in at], [len(classes[i]) for i in at], kind)
        out = list(text)
        for i, v in zip(at, new, strict=True):
            out[i] = classes[i][v]
        return "".join(out)

    def _secret_value(self, text: str) -> str:
        """The same for a value wherever it was found: a prefix of a service stays, hexadecimal digits stay such."""
        if m := SERVICE_KEY.fullmatch(text):
            return m[1] + self._in_class(m[2], "SECRET" + m[1])
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", text) and not text.isdecimal():
            digits = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
            has_letter = lambda new: max(new) > 9
            return "".join(digits[v] for v in self._digits([digits.index(c) for c in text], [16] * len(text), "HEX", has_letter))
        return self._in_class(text, "SECRET")

    @staticmethod
    def _put_digits(text: str, digits: list[int]) -> str:
        new = iter(digits)
        return "".join(str(next(new)) if c.isdecimal() else c for c in text)

    def email(self, text: str):
        at = text.find("@")
        while at >= 0:
            start, domain = at, EMAIL_DOMAIN.match(text, at + 1)
            while domain and start and EMAIL_LOCAL.match(text, start - 1):
                start -= 1
            start += len(text[start:at]) - len(text[start:at].lstrip(".+%-"))
            if domain and start < at and text[at - 1] != ".":
                yield start, at, self._in_class(text[start:at], "EMAIL"), (start, domain.end())
            at = text.find("@", at + 1)

    def secret(self, text: str):
        if "=" in text or ":" in text or "earer" in text:
            for m in SECRET.finditer(text):
                g = m.lastindex
                value = m[g]
                if g == 3 and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                    continue
                yield m.start(g), m.end(g), self._secret_value(value), m.span(g)
        for m in SERVICE_KEY.finditer(text):
            end = m.end() - (len(m[2]) - len(m[2].rstrip("._-")))
            if any(c.isdigit() for c in m[2]):
                yield m.start(), end, self._secret_value(text[m.start() : end]), (m.start(), end)
        if "-----BEGIN" in text:
            for m in KEY_BLOCK.finditer(text):
                yield m.start(1), m.end(1), self._in_class(m[1], "KEY"), m.span(1)

    def iban(self, text: str):
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and iban_rest(plain) == 1:
                account = self._in_class(plain[4:], "IBAN" + plain[:2])
                new = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + account):02d}" + account)
                yield m.start(), m.end(), "".join(c if c == " " else next(new) for c in m[0]), m.span()

    def card(self, text: str):
        for m in CARD.finditer(text):
            for shown in dict.fromkeys((m[1], m[3] or m[1])):
                digits = [int(c) for c in shown if c.isdecimal()]
                if len(digits) >= 13 and luhn_total(digits) % 10 == 0 and any(digits):
                    new = [digits[0], *self._digits(digits[1:-1], [10] * (len(digits) - 2), f"CARD{digits[0]}")]
                    new.append(-luhn_total([*new, 0]) % 10)
                    end = m.start() + len(shown)
                    yield m.start(), end, self._put_digits(shown, new), (m.start(), end)
                    break

    def ssn(self, text: str):
        for m in SSN.finditer(text):
            digits = [int(c) for c in m[0] if c.isdecimal()]
            if issued(digits):
                yield m.start(), m.end(), self._put_digits(m[0], self._digits(digits, [10] * 9, "SSN", issued)), m.span()

    def _phone(self, text: str, start: int, end: int, skip: int, most: int | None = None):
        """The find of a number whose first ``skip`` digits stay; digits beyond ``most`` belong to something else."""
        at = [i for i in range(start, end) if text[i].isdecimal()][skip:]
        if most is not None and len(at) > most and at[most] - at[most - 1] > 1:
            at, end = at[:most], at[most - 1] + 1
        if not 6 <= len(at) <= 14:
            return None
        # the first digit stays within 0, 1 to 5 or 6 to 9: by it national forms are told apart
        digits = [int(text[i]) for i in at]
        low, radix = (0, 1) if not digits[0] else (1, 5) if digits[0] < 6 else (6, 4)
        new = self._digits([digits[0] - low, *digits[1:]], [radix] + [10] * (len(at) - 1), "PHONE")
        out = list(text[start:end])
        for i, v in zip(at, [new[0] + low, *new[1:]], strict=True):
            out[i - start] = str(v)
        return start, end, "".join(out), (start, end)

    def phone(self, text: str):
        for m in PHONE_ABROAD.finditer(text):
            digits = "".join(c for c in m[2] if c.isdecimal())
            code = next((digits[:n] for n, known in ((1, CODES_1), (2, CODES_2)) if digits[:n] in known), digits[:3])
            fixed, rest = FIXED.get(code), digits[len(code) :]
            trunk = rest.startswith("0") and len(rest) != fixed and len(rest) > 6
            if (m[1] == "+" or fixed and len(rest) - trunk >= fixed) and (found := self._phone(text, m.start(2), m.end(2), len(code) + trunk, fixed)):
                yield found
        for k, pattern in enumerate(PHONE_AT_HOME):
            for m in pattern.finditer(text):
                start, end = m.span(1) if k == 3 else m.span()
                digits = "".join(c for c in text[start:end] if c.isdecimal())
                skip = int(digits[0] == "0" and k > 0 or len(digits) == 11 and digits[0] == "1")
                if len(digits) >= 7 and (found := self._phone(text, start, end, skip)):
                    yield found

    def ipv4(self, text: str):
        for m in IPV4.finditer(text):
            parts = [int(m[i]) for i in range(1, 5)]
            if max(parts) < 256 and all(str(p) == m[i + 1] for i, p in enumerate(parts)):
                yield m.start(), m.end(), ".".join(map(str, self._digits(parts, [256] * 4, "IPV4"))), m.span()

    def ipv6(self, text: str):
        for m in IPV6.finditer(text):
            if sum(map(bool, m[0].split(":"))) < 3:
                continue
            try:
                packed = ipaddress.IPv6Address(m[0]).packed
            except ValueError:
                continue
            new = self._digits(np.frombuffer(packed, ">u2").tolist(), [1 << 16] * 8, "IPV6")
            shown = str(ipaddress.IPv6Address(np.array(new, ">u2").tobytes()))
            yield m.start(), m.end(), shown.upper() if m[0].upper() == m[0] else shown, m.span()

    def _day(self, year: int, month: int, day: int) -> dt.date | None:
        """The day that stands for this one within the same 200 years."""
        if not (1000 <= year and 1 <= month <= 12 and 1 <= day <= 31):
            return None
        span = (year - FIRST_YEAR) // SPAN
        first, after = FIRST_YEAR + SPAN * span, FIRST_YEAR + SPAN * (span + 1)
        low = dt.date(max(1000, first), 1, 1).toordinal()
        n = (dt.date(after, 1, 1) if after <= 9999 else dt.date.max).toordinal() - low + (after > 9999)
        try:
            x = dt.date(year, month, day).toordinal() - low
        except ValueError:
            return None
        return dt.date.fromordinal(low + self._digits([x], [n], f"DATE{span}")[0])

    def date(self, text: str):
        for m in ISO_DATE.finditer(text):
            if new := self._day(int(m[1]), int(m[3]), int(m[4])):
                yield m.start(), m.end(), f"{new.year}{m[2]}{new.month:0{len(m[3])}d}{m[2]}{new.day:0{len(m[4])}d}", m.span()
        for m in DAY_DATE.finditer(text):
            # day first; month first only where day first is no date
            for day, month in ((1, 3), (3, 1)):
                if new := self._day(int(m[4]), int(m[month]), int(m[day])):
                    put = {day: new.day, month: new.month}
                    yield m.start(), m.end(), f"{put[1]:0{len(m[1])}d}{m[2]}{put[3]:0{len(m[3])}d}{m[2]}{new.year}", m.span()
                    break
        for m in NAMED_DATE.finditer(text):
            name = m[4] or m[7]
            names, place = MONTH_OF[name.lower()]
            if new := self._day(int(m[6] or m[12]), place + 1, int(m[1] or m[9])):
                month = names[new.month - 1]
                month = month.upper() if name.isupper() else month.title() if name[0].isupper() else month
                if m[1]:
                    shown = f"{new.day}{ordinal(m[2], new.day)}{m[3]}{month}{m[5]}{new.year}"
                else:
                    shown = f"{month}{m[8]}{new.day}{ordinal(m[10], new.day)}{m[11]}{new.year}"
                yield m.start(), m.end(), shown, m.span()

    def text(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The new text, and (kind, start, end) of each replaced value in the given text."""
        if not text:
            return text, []
        found = []
        digits = RUN.search(text) is not None
        wanted = {
            "EMAIL": "@" in text, "SECRET": True, "IBAN": digits, "CARD": digits, "SSN": digits, "PHONE": digits, "IPV4": digits,
            "IPV6": "::" in text or text.count(":") > 6, "DATE": digits or re.search(r"\d{4}", text) is not None,
        }
        for kind in self.kinds:
            if wanted[kind]:
                found += [(kind, *f) for f in getattr(self, kind.lower())(text)]
        if not found:
            return text, []
        # by kind, then place, then length: a find that overlaps an earlier one falls; those taken lie in order
        starts, taken, kept = [], [], []
        for kind, start, end, new, (lo, hi) in sorted(found, key=lambda f: (KINDS.index(f[0]), f[4][0], -f[4][1])):
            i = bisect_left(starts, lo)
            if (i == 0 or taken[i - 1][1] <= lo) and (i == len(taken) or taken[i][0] >= hi):
                starts.insert(i, lo)
                taken.insert(i, (lo, hi))
                kept.append((start, end, new, kind))
        out, at = [], 0
        for start, end, new, _ in sorted(kept):
            out += [text[at:start], new]
            at = end
        return "".join(out) + text[at:], sorted((kind, start, end) for start, end, _, kind in kept)


_made: dict = {}


def pseudonymise(df: DataFrame, keep: list[str], text: str = "text", key: bytes = DEMO_KEY, kinds: tuple[str, ...] = KINDS, spans: str = "spans") -> DataFrame:
    """``keep`` columns (without ``text``), then ``text`` with pseudonyms and ``spans``, an array of (kind, start, end in the given text)."""
    small_batches(df.sparkSession)

    def work(batch):
        p = _made.get((key, kinds)) or _made.setdefault((key, kinds), Pseudonymiser(key, kinds))
        found = [p.text(x) for x in batch.column(text).to_pylist()]
        return {text: [f[0] for f in found], spans: [[{"kind": k, "start": a, "end": b} for k, a, b in f[1]] for f in found]}

    schema = T.StructType([T.StructField(text, T.StringType()), T.StructField(spans, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return map_batches(df, [c for c in keep if c != text], work, schema, [text])


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms, and the number of replaced values."""
    from pyspark.sql import functions as F

    out = pseudonymise(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"))
