"""Personal data replaced by pseudonyms of the same format.

Numbers and dates that pass their check (Luhn, mod 97, octets, calendar, ...) are read as an element of a finite set, and
a keyed Feistel network permutes the set: the pseudonym passes the same check, looks the same, and equal values get
equal pseudonyms in every document, different values different ones, and no value stays itself. With the key the network runs backwards.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, in_slices, table

ROUNDS = 8


class Feistel:
    """Keyed permutations of range(n) for each n and kind. Of two halves, one in turn is shifted by a digest of the other."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _shift(self, kind: str, n: int, i: int, half: int) -> int:
        data = f"{kind}:{n}:{i}:{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _walk(self, x: int, n: int, kind: str, back: bool) -> int:
        a = math.isqrt(n - 1) + 1  # a * a is n at least
        while True:
            left, right = divmod(x, a)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if i % 2:
                    move = self._shift(kind, n, i, left)
                    right = (right + (-move if back else move)) % a
                else:
                    move = self._shift(kind, n, i, right)
                    left = (left + (-move if back else move)) % a
            x = left * a + right
            if x < n:  # values outside the set are permuted on until one lies in it
                return x

    def permute(self, x: int, n: int, kind: str) -> int:
        """A permutation without fixed points: one step along a cycle through all of range(n) in an order of the key's own."""
        return self._walk((self._walk(x, n, kind, False) + 1) % n, n, kind, True) if n > 1 else x

    def restore(self, x: int, n: int, kind: str) -> int:
        return self._walk((self._walk(x, n, kind, False) - 1) % n, n, kind, True) if n > 1 else x


#: (permute or restore) of an element of range(n) of a kind.
Step = Callable[[int, int, str], int]


def luhn(digits: str) -> int:
    """The digit that completes a number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def _refill(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in form)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _decimal(digits: str, step: Step, kind: str) -> str:
    n = len(digits)
    return f"{step(int(digits), 10**n, f'{kind}{n}'):0{n}d}"


def _card(m: re.Match, step: Step) -> str | None:
    digits = _digits(m.group())
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = _decimal(digits[:-1], step, "card")
    return _refill(m.group(), body + str(luhn(body)))


def _mixed(text: str, step: Step, kind: str) -> str:
    """Letters stay letters of their case and digits digits; all else stays."""
    sets = {c: s for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in s}
    form = "".join(sets[c][0] if c in sets else c for c in text)
    value, size = 0, 1
    for c in text:
        if c in sets:
            value, size = value * len(sets[c]) + sets[c].index(c), size * len(sets[c])
    value, out = step(value, size, f"{kind}:{form}"), []
    for c in reversed(text):
        if c in sets:
            value, k = divmod(value, len(sets[c]))
            c = sets[c][k]
        out.append(c)
    return "".join(reversed(out))


def _iban(m: re.Match, step: Step) -> str | None:
    plain = m.group().replace(" ", "")
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = _mixed(plain[4:], step, "iban" + plain[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    left = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(left) for c in m.group())


def _address(m: re.Match, step: Step) -> str | None:
    octets = [int(x) for x in m.group().split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.group().split(".")):
        return None
    x = step(int.from_bytes(bytes(octets), "big"), 1 << 32, "address")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _phone(m: re.Match, step: Step) -> str | None:
    digits, country = _digits(m.group()), len(m.group("country"))
    if not 10 <= len(digits) <= 15 or len(digits) - country < 7:
        return None
    return _refill(m.group(), digits[:country] + _decimal(digits[country:], step, "phone"))


def _social(m: re.Match, step: Step) -> str | None:
    area, group, serial = (int(x) for x in m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(step(x, 898 * 99 * 9999, "social"), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(m: re.Match, step: Step) -> str | None:
    """Year first, or day and month by the separator: 31.12.1999, 12/31/1999. Both give the same day the same pseudonym."""
    a, separator, b, c = m.group("a"), m.group("s"), m.group("b"), m.group("c")
    if len(a) == 4 and len(c) == 2:
        order = (0, 1, 2)
    elif len(a) == 2 and len(c) == 4 and separator != "-":
        order = (2, 1, 0) if separator == "." else (2, 0, 1)
    else:
        return None
    parts = (a, b, c)
    try:
        day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    date = datetime.date.fromordinal(step(day - _FIRST, _LAST - _FIRST + 1, "date") + _FIRST)
    out = ["", "", ""]
    for i, x in zip(order, (f"{date.year:04d}", f"{date.month:02d}", f"{date.day:02d}"), strict=True):
        out[i] = x
    return separator.join(out)


def _email(m: re.Match, step: Step) -> str | None:
    name, domain = m.group().split("@")
    return f"{_mixed(name, step, 'email@' + domain.lower())}@{domain}"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    replace: Callable[[re.Match, Step], str | None]
    #: A character that a text needs for a match.
    needs: str


#: Fixed values. Where matches overlap, the kind listed first is taken.
KINDS = (
    Kind("email", re.compile(r"(?<![\w.%+-])\w[\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email, "@"),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban, ""),
    Kind("card", re.compile(r"(?<![0-9A-Za-z])(?<![0-9][.-])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[\x20-])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}(?:(?P=s)[0-9]{3})?|[0-9]{4}(?P<t>[\x20-])[0-9]{6}(?P=t)[0-9]{5})(?![0-9A-Za-z]|[.-][0-9])"), _card, ""),
    Kind("address", re.compile(r"(?<![0-9A-Za-z])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"), _address, "."),
    Kind("date", re.compile(r"(?<![0-9A-Za-z])(?<![0-9][./-])(?P<a>[0-9]{2}|[0-9]{4})(?P<s>[./-])(?P<b>[0-9]{2})(?P=s)(?P<c>[0-9]{4}|[0-9]{2})(?![0-9]|[./-][0-9])"), _date, ""),
    Kind("social", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"), _social, "-"),
    Kind("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\+(?P<country>[0-9]{1,3})[\x20.-]?)\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"), _phone, "+"),
    Kind("phone", re.compile(r"(?<![0-9A-Za-z+])(?P<country>)\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"), _phone, "("),
)
NAMES = tuple(dict.fromkeys(k.name for k in KINDS))
_ANY = re.compile("[0-9@]")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def _rewritten(self, text: str, step: Step) -> tuple[str, Counter]:
        counts: Counter = Counter()
        if not _ANY.search(text):
            return text, counts
        taken: list[tuple[int, int, str]] = []
        for kind in KINDS:
            if kind.needs not in text:
                continue
            for m in kind.pattern.finditer(text):
                a, b = m.span()
                k = bisect.bisect(taken, (a, b, ""))  # taken spans don't overlap, so only its neighbours can
                if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                    continue
                if (new := kind.replace(m, step)) is not None:
                    taken.insert(k, (a, b, new))
                    counts[kind.name] += 1
        out, at = [], 0
        for a, b, new in taken:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), counts

    def rewrite(self, text: str) -> tuple[str, Counter]:
        """The text with pseudonyms, and how many of each kind."""
        return self._rewritten(text, self.feistel.permute)

    def restore(self, text: str) -> str:
        """What rewrite() was given."""
        return self._rewritten(text, self.feistel.restore)[0]


def _rewrite(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in in_slices(batches):
            texts, counts = [], []
            for t in batch.column("text"):
                new, n = (None, Counter()) if (old := t.as_py()) is None else own.rewrite(old)
                texts.append(new)
                counts.append(n)
            columns = [batch.column("doc_id"), pa.array(texts, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in NAMES)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", *(f"n_{k}" for k in NAMES)])

    return run


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text and n_<kind> for each of NAMES: one row for each row of docs (doc_id, text; others are not looked at).

    Numbers that fail their check (a card that isn't by Luhn, an address with an octet over 255, a day that isn't in
    the calendar) stay as they are, as does all other text. A null text stays null, an empty one empty, each with
    counts of 0; a null doc_id stays null; repeated rows are all returned; an empty table gives an empty result.
    key: kept outside the data; whoever has it can reverse the pseudonyms.
    """
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in NAMES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow(_rewrite(key), schema))


#: A key for tests and for the query, which have nothing to hide.
OPEN_KEY = b"open key: not for data that matter"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_pii."""
    return pseudonymised(table(spark, sf_dir, "documents"), OPEN_KEY)
