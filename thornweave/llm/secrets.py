"""Secret scans: known forms first, then strings whose windows are too random to be words.

A candidate is a run of characters of one class. A window of fixed length slides along it; the counts of its characters
and the sum that Shannon's entropy needs are updated by the character that enters and the one that leaves, so a run costs
time in proportion to its length. Windows that reach the class's threshold are joined to spans. Runs that an allow-list
entry covers (identifiers, examples, digests that are named as such) are left out, and so is what a known form has already.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "entropy")
#: Known forms. re.ASCII keeps letters of other alphabets from matching in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_LOG = [0.0, *(c * math.log2(c) for c in range(1, 257))]


@dataclass(frozen=True)
class CharacterClass:
    pattern: str
    window: int
    #: Bits a character.
    entropy: float


#: Fixed values. A run belongs to the first class whose pattern it matches whole.
CLASSES = (
    CharacterClass("[0-9a-fA-F]+", 24, 3.0),
    CharacterClass("[A-Za-z0-9]+", 24, 3.9),
    CharacterClass("[A-Za-z0-9+/_=-]+", 28, 4.1),
)
#: Fixed values. A run of candidate characters that one of these matches is no secret.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r".*(?:EXAMPLE|example|XXXX|xxxx|0123456789|abcdefgh|ABCDEFGH).*",
    r"(?:sha1|sha256|sha384|sha512|md5)[-_=].*",
    r"(?:(?:[A-Z]?[a-z]{0,19}|[0-9]{1,4})[-_/])+(?:[A-Z]?[a-z]{0,19}|[0-9]{1,4})",
    r"[0-9_/+=-]+",
)


@dataclass(frozen=True)
class Rules:
    classes: tuple[CharacterClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    least: int = field(init=False, default=0)

    def __post_init__(self):
        object.__setattr__(self, "least", min(c.window for c in self.classes))


def windows(run: str, length: int, threshold: float) -> list[tuple[int, int]]:
    """Spans of run that windows of so many characters cover whose entropy reaches the threshold."""
    if len(run) < length:
        return []
    counts: dict[str, int] = {}
    total, whole, spans = 0.0, math.log2(length), []

    for i, c in enumerate(run):
        n = counts[c] = counts.get(c, 0) + 1
        total += _LOG[n] - _LOG[n - 1]
        if i >= length:
            n = counts[out := run[i - length]]
            counts[out] = n - 1
            total += _LOG[n - 1] - _LOG[n]
        if i >= length - 1 and whole - total / length >= threshold - 1e-9:
            if spans and spans[-1][1] >= i + 1 - length:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i + 1 - length, i + 1))
    return spans


class Scanner:
    def __init__(self, rules: Rules):
        self.classes = [(re.compile(c.pattern, re.ASCII), c) for c in rules.classes]
        self.allowed = re.compile("|".join(f"(?:{a})" for a in rules.allowed), re.ASCII) if rules.allowed else None
        letters = "A-Za-z0-9+/_=-"
        self.runs = re.compile(rf"(?<![{letters}])[{letters}]{{{rules.least},}}")

    def known(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        return found

    def random(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.runs.finditer(text):
            run = m.group()
            if self.allowed and self.allowed.fullmatch(run):
                continue
            mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
            if not mixed:  # letters alone are a word, however long
                continue
            of = next((c for pattern, c in self.classes if pattern.fullmatch(run)), None)
            for a, b in windows(run, of.window, of.entropy) if of else ():
                if any(c.isdigit() for c in run[a:b]) and any(c.isalpha() for c in run[a:b]):
                    yield m.start() + a, m.start() + b

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end), ordered by start and kind."""
        found = self.known(text)
        known = sorted((s, e) for s, _, e in found)
        starts, ends = [s for s, _ in known], list(itertools.accumulate((e for _, e in known), max))
        for a, b in self.random(text):
            before = bisect.bisect_right(starts, a)  # of those that start no later, one reaches as far as ends says
            if not before or ends[before - 1] < b:
                found.append((a, 3, b))
        return sorted(found)


def _scan(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.scan(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return run


def secrets(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start and then kind as in KINDS: one row for each row of docs.

    Offsets count code points, the end is exclusive. Only doc_id and text are looked at; a null text is empty and has no
    spans, a null doc_id stays null, repeated rows are all returned, an empty table gives an empty result. Each text is
    scanned whole, by itself, in time that grows with its length (and the logarithm of its spans).
    """
    schema = "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow(_scan(rules), schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_secrets."""
    found = secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
