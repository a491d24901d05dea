"""Pseudonyms: permutations, formats, links, exact restoration."""

import random
import re

import pytest

from thornweave.llm import pii

own = pii.Pseudonyms(b"a key")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_permutation(n):
    f = pii.Feistel(b"k")
    image = [f.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and [f.restore(y, n, "t") for y in image] == list(range(n))
    assert n == 1 or all(x != y for x, y in enumerate(image))


def test_key_and_kind_matter():
    a, b = pii.Feistel(b"k"), pii.Feistel(b"l")
    xs = range(50)
    assert len({tuple(f.permute(x, 10**9, k) for x in xs) for f in (a, b) for k in ("s", "t")}) == 4


CASES = {
    "email": ["joe.34@mail7.example.com", "é.65@mail1.example.com", "A_b+1@x-y.co.uk"],
    "card": ["4845168114407329", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005"],
    "address": ["97.51.17.173", "255.255.255.255", "0.0.0.0"],
    "phone": ["+1 (017) 555-7713", "+44 20 7946 0958", "(212) 555-0147"],
    "date": ["1999-12-31", "31.12.1999", "12/31/1999", "2000-02-29"],
    "social": ["123-45-6789"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in CASES.items() for v in vs])
def test_formats(kind, value):
    text = f"See {value}, thst {value}."
    new, n = own.rewrite(text)
    assert dict(n) == {kind: 2} and value not in new
    first, second = re.fullmatch(r"See (.*), thst (.*)\.", new).groups()
    assert first == second and len(first) == len(value) if kind != "address" else first == second
    if kind not in ("email", "address"):
        assert re.sub("[0-9]", "9", first) == re.sub("[0-9]", "9", value) or kind == "iban"
    again, m = own.rewrite(new)
    assert m == n  # the pseudonym passes the same check
    assert own.restore(new) == text


def test_equal_values_stay_linked():
    new = own.rewrite("4111 1111 1111 1111 x 4111111111111111 y 31.12.1999 z 12/31/1999 w 1999-12-31")[0]
    a, b = re.match(r"([0-9 ]+) x ([0-9]+) y", new).groups()
    assert a.replace(" ", "") == b
    d, m, y = re.search(r"y ([0-9]+)\.([0-9]+)\.([0-9]+) z", new).groups()
    assert f"z {m}/{d}/{y} w {y}-{m}-{d}" in new


CLEAN = [
    "Version 2.0. CC BY-NC 4.0 costs 1,000.50 in 1999, at 10:30.",
    "9807915762804490 is no card by Luhn; 0000000000000000 isn't one either",
    "256.1.1.1 and 1.2.3 and 1.2.3.4.5 and 01.2.3.4",
    "2001-02-29 and 31.04.1999 and 13/13/1999 and 1999-1-1",
    "000-12-3456 666-12-3456 900-12-3456 123-00-4567",
    "a@b and @home and GB00 WEST 1234 5698 7654 32",
    "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 abc4845168114407329def",
    "",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert own.rewrite(text)[0] == text


def test_restores_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for r in rows:
        new, _ = own.rewrite(r.text)
        assert own.restore(new) == r.text
    long = " ".join(random.Random(1).choice(["4845168114407329", "word", "97.51.17.173", "x@y.org"]) for _ in range(20_000))
    assert own.restore(own.rewrite(long)[0]) == long


def test_rows(spark):
    rows = [(1, "x 4845168114407329", 5), (None, "joe@example.org", 6), (2, None, None), (3, "", 1), (1, "x 4845168114407329", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_card int")
    got = sorted(((r.doc_id, r.text, r.n_card, r.n_email) for r in pii.pseudonymised(docs, b"a key").collect()), key=str)
    want = [(d, t and own.rewrite(t)[0], int("4845" in (t or "")), int("@" in (t or ""))) for d, t, _ in rows]
    assert got == sorted(want, key=str)
    assert pii.pseudonymised(docs.limit(0), b"a key").collect() == []


def luhn_holds(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


CARD = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{16}(?![0-9A-Za-z]|[.-][0-9])")
ADDRESS = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])")
MAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def test_what_documents_become(spark, sf):
    """Against the documents themselves, without the code's own search: what changes is personal data, each value becomes one other
    value that passes the same check, and no two values become the same."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    links = {"card": {}, "address": {}, "mail": {}}
    for r in pii.query(spark, sf).collect():
        old, new = texts[r.doc_id], r.text
        for kind, pattern, ok in (("card", CARD, luhn_holds), ("address", ADDRESS, lambda x: all(int(o) < 256 and str(int(o)) == o for o in x.split("."))), ("mail", MAIL, lambda x: True)):
            a, b = ([x for x in pattern.findall(t) if ok(x)] for t in (old, new))
            assert len(a) == len(b), (r.doc_id, kind)
            for x, y in zip(a, b, strict=True):
                assert links[kind].setdefault(x, y) == y != x
        rest = [re.sub("[0-9]", "9", ADDRESS.sub("A", MAIL.sub("M", t))) for t in (old, new)]
        assert rest[0] == rest[1] or r.n_iban, r.doc_id  # all else keeps its words, and its digits their places
        if not any(r[f"n_{k}"] for k in pii.NAMES):
            assert old == new
    for found in links.values():
        assert found and len(set(found.values())) == len(found)


def test_many_values():
    """Time doesn't grow with the square of the values."""
    import time

    rng = random.Random(2)
    text = " ".join(f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} u{i}@mail.example.com" for i in range(20_000))
    began = time.time()
    assert own.rewrite(text)[1] == {"email": 20_000, "address": 20_000} and time.time() - began < 60


def test_query(spark, sf):
    open_ = pii.Pseudonyms(pii.OPEN_KEY)
    want = sorted((r.doc_id, open_.rewrite(r.text)[0]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted((r.doc_id, r.text) for r in pii.query(spark, sf).collect()) == want
