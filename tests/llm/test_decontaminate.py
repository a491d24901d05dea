"""Benchmark items in documents against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

from thornweave.llm import decontaminate as dc


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def shingles(w, k=5):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def brute(docs, items, least=0.8, k=5):
    """(doc_id, item_id) with the highest similarity over all windows of the item's size."""
    out = {}
    for d, t in docs:
        w = split(t)
        for i, x in items:
            v = split(x)
            if not v:
                continue
            b = shingles(v, k)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = shingles(w[s : s + len(v)], k)
                if shared := sum((a & b).values()):
                    j = shared / sum((a | b).values())
                    if j >= least:
                        out[d, i] = max(out.get((d, i), 0), round(j, 9))
    return out


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(14, 60)))) for i in range(25)] + [(100, "just three words"), (101, "one"), (102, ""), (103, None), (104, " ".join(["again and"] * 12))]
    docs = []
    for d in range(160):
        w = say(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            v = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if v:
                    at = rng.choice([0, len(v) - 1, rng.randrange(len(v))])
                    v[at : at + 1] = rng.choice([[], ["edit"], ["x", "y"]])
            w[rng.randrange(len(w) + 1) : 0] = v
        docs.append((d, rng.choice([" ", "\n", "  "]).join(w).replace("w1", rng.choice(["w1", "W1"]))))
    return docs + [(200, None), (201, ""), (202, items[0][1].upper()), (None, "say " + items[1][1]), (203, " ".join(items[2][1].split()[:-2]))], items


@pytest.mark.parametrize("seed,broadcast", [(1, 500_000), (2, 40)])
def test_against_brute_force(spark, seed, broadcast):
    docs, items = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(*r, 1) for r in items + items[:3]], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.matches(df, it, dc.Matching(broadcast_rows=broadcast)).collect()}
    want = brute(docs, items)
    assert len(want) > 40 and got == want
    held = {d for d, _ in want}
    left = dc.clean(df, it, dc.Matching(broadcast_rows=broadcast)).collect()
    assert sorted((r.doc_id for r in left), key=str) == sorted((d for d, _ in docs if d not in held), key=str) and left[0].__fields__ == ["doc_id", "text", "item_id"]


def test_moved_blocks(spark):
    """Windows that hold an item's halves, or thirds, in another order share most shingles, though none of them lies where it does in the item."""
    rng = random.Random(6)
    say = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    items, docs = [], []
    for i in range(12):
        w = say(rng.choice([100, 101, 160, 90]))
        cut = sorted(rng.sample(range(30, len(w) - 30), 1)) if i % 2 else [len(w) // 3, 2 * len(w) // 3]
        parts = [w[a:b] for a, b in zip([0, *cut], [*cut, len(w)], strict=True)]
        rng.shuffle(parts)
        if parts[0] == w[: len(parts[0])]:
            parts.reverse()
        items.append((i, " ".join(w)))
        docs.append((i, " ".join(say(rng.choice([0, 30, 200])) + [x for p in parts for x in p] + say(rng.choice([0, 30])))))
    a, b = say(50), say(50)
    items.append((50, " ".join(a + b)))
    docs.append((50, " ".join(b + a)))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and got[50, 50] == round(92 / 100, 9) and len(got) >= 10


def test_long_texts(spark):
    """An item in a text of 200,000 words, one that stands there hundreds of times, and one of repeated words."""
    rng = random.Random(9)
    say = lambda n, k: [f"t{rng.randrange(k)}" for _ in range(n)]
    items = [(1, say(40, 10**6)), (2, say(25, 10**6)), (3, ["again", "and"] * 15)]
    long = say(200_000, 10**6)
    long[150_000:150_040] = items[0][1]
    often = [x for _ in range(300) for x in items[1][1] + say(3, 50)]
    docs = [(1, " ".join(long)), (2, " ".join(often)), (3, " ".join(["again and"] * 3000))]
    found = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.start, round(r.similarity, 6)) for r in found.collect()) == [(1, 1, 150_000, 1.0), (2, 2, 0, 1.0), (3, 3, 0, 1.0)]


def test_rows_that_share_an_id(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    item = items.first().text
    docs = spark.createDataFrame([(5, item), (5, "clean text"), (6, item), (6, item), (None, item), (None, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.matches(docs, items).fillna(-1).collect()) == [(-1, 1), (5, 1), (6, 1)]
    assert sorted(r.text for r in dc.clean(docs, items).collect()) == ["clean text", "other"]
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        assert dc.matches(a, b).collect() == []
    assert dc.clean(docs, items.limit(0)).count() == 6


def test_simhash(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [([rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))],) for _ in range(100)]
    import xxhash

    df = spark.createDataFrame(rows, "s array<string>")
    for r in df.select("s", dc.simhash(F.col("s")).alias("fp")).collect():
        h = [xxhash.xxh64_intdigest(x, 42) for x in r.s]
        assert r.fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id): r.similarity for r in dc.query(spark, sf).collect()} == {k: round(v, 6) for k, v in brute(docs, items).items()}
