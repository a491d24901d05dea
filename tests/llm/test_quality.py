"""Quality rules against plain Python."""

import random
import re

import pytest

from thornweave.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = W.findall(t)
    seen, lines = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            lines += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(again), failed)


def line_goes(line, r=quality.Rules()):
    n = len(W.findall(line))
    if not n:
        return False
    ink = sum(map(len, W.findall(line)))
    separators = len(re.findall(quality.SEPARATORS, line))
    return (
        (n > r.unended_words and not re.search(quality.ENDS, line))
        or (line == line.upper() and line != line.lower() and sum(c.isalpha() for c in line) >= r.upper_letters)
        or (separators >= r.separators and separators * 100 >= n * r.separator_share)
        or len(re.findall(quality.SYMBOLS, line)) * 100 > ink * r.symbol_share
        or (n <= r.boilerplate_words and any(re.search(r"\b" + p, line.lower()) for p in quality.BOILERPLATE))
    )


def brute(text, r=quality.Rules()):
    found = base(text)
    cleaned = "\n".join(x for x in (text or "").split("\n") if not line_goes(x))
    enough = sum(map(len, W.findall(cleaned))) * 100 >= found[1] * r.kept_share
    return (*found, not found[5] and enough, cleaned if text is not None else None)


SENTENCE = "The cat of the house sat on a mat near the door and slept until noon came by. "
TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    " ".join("abcdefg"),
    SENTENCE * 3,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z. " + "q r s t u v w x",
    "a " * 500,
    "Home | News | Sport | Contact\n" + SENTENCE + "It was warm there, for once.",
    "THE WHOLE LINE IS WRITTEN IN CAPITALS!\n" + SENTENCE + "It was warm there.",
    SENTENCE + "\nWe use cookies.\nAll rights reserved.\n\n" + SENTENCE,
    "### *** $$$ text &&& here\n" * 12 + SENTENCE,
    "x\xa0y é\x1cz " * 12 + "\r\nÉtat. " + SENTENCE,
    "no end of a sentence in this line of rather many words that goes on and on\n" + SENTENCE + "Ça va bien, merci. Et toi?",
]


def test_odd_texts(spark):
    rng = random.Random(1)
    made = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + rng.choice(["", ".", "\n"]) + " ".join(rng.choice("abc") for _ in range(40)) for _ in range(200)]
    long = "\n".join(f"Line {i % 997} says {i} and {i * 7 % 1009} of {i * 13 % 10007}." for i in range(8000))
    texts = TEXTS + made + [long]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, TEXTS[8], None), (3, TEXTS[8], "x"), (3, TEXTS[8], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, judged string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")
    got = sorted([(r.doc_id, *(r.judged[n] for n in names)) for r in quality.judged(docs).select("doc_id", "judged").collect()], key=str)
    assert got == sorted([(d, *brute(t)) for d, t, _ in rows], key=str)
    assert quality.judged(docs.limit(0)).collect() == []


@pytest.mark.parametrize("length", [2, 3, 8])
def test_repeated_words(spark, length):
    from pyspark.sql import functions as F

    rng = random.Random(length)
    rows = [(i, [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(40))]) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, w array<string>").select("i", quality.repeated_words(F.col("w"), length).alias("n")).collect()
    for r in got:
        w, at = rows[r.i][1], {}
        for i in range(len(w) - length + 1):
            at.setdefault(tuple(w[i : i + length]), []).append(i)
        assert r.n == len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + length)})


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.query(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {d: brute(t)[:7] for d, t in texts.items()}


def test_what_goes_and_what_stays(spark, sf):
    rows = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    prose = [r for r in rows if r.judged.n_words >= 40 and not r.judged.base_failed and r.judged.n_symbols * 50 < r.judged.word_chars and not r.text.isupper()]
    assert len(prose) > 100 and all(r.judged.kept for r in prose)
    assert not any(r.judged.kept for r in rows if r.text.isupper() or r.judged.n_symbols * 5 > r.judged.word_chars)
