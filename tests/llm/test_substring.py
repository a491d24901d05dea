"""Repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from thornweave.llm import substring


def brute(rows, window):
    """rows: (doc_id, text). Copies of a row are one document."""
    split = {r: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows}
    order = lambda r: (r[0] is not None, r[0] or 0)
    first = {}
    for r, w in split.items():
        for i in range(len(w) - window + 1):
            k, at = tuple(w[i : i + window]), (order(r), i)
            first[k] = min(first.get(k, at), at)
    out = []
    for r in rows:
        w = split[r]
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (order(r), i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, window, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, d string")
    return sorted([tuple(r) for r in substring.without_repeats(docs, window, **more).collect()], key=str)


def corpus(seed, n=60, vocabulary=400):
    """Passages that repeat within and across documents, with and without edits."""
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    passages = [say(rng.randrange(3, 60)) for _ in range(6)]
    out = []
    for i in range(n):
        w = say(rng.randrange(0, 40))
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited"
            w += p + say(rng.randrange(0, 15))
        out.append((i * 3, rng.choice([" ", "\n", "  \t"]).join(w)))
    return out + [(1000 + i, out[7][1]) for i in range(4)]


@pytest.mark.parametrize("window", [4, 6, 10, 20])
def test_against_brute_force(spark, window):
    rows = corpus(window)
    assert run(spark, rows, window) == brute(rows, window)


def test_small_vocabulary(spark):
    """Every short window is repeated somewhere."""
    rows = corpus(9, 40, vocabulary=3)
    assert run(spark, rows, 10) == brute(rows, 10)


def test_crowded_keys(spark, monkeypatch):
    """The stream and the tasks' own settling give the same, however little a task settles."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join([f"a{rng.randrange(40)}" for _ in range(15)] + common + [f"b{rng.randrange(40)}" for _ in range(15)])) for i in range(150)]
    assert run(spark, rows, 10) == brute(rows, 10)


@pytest.mark.parametrize("partitions", [1, 2, 3])
def test_crowded_keys_lose_no_repeat(spark, monkeypatch, partitions):
    """A passage in more contexts than a task lets meet at level one, alone in one task or met again in another."""
    monkeypatch.setattr(substring, "CROWDED", 2)
    rng = random.Random(7)
    rows = []
    for c in range(40):
        common = [f"c{c}_{i}" for i in range(12)]
        alike = None
        for i in range(6):
            around = [[f"{x}{rng.randrange(10**6)}" for _ in range(15)] for x in "ab"]
            alike = alike or around
            rows.append((i * 100 + c, " ".join(around[0] + common + around[1])))
        rows.append((600 + c, " ".join(alike[0] + common + alike[1])))
    rows.sort(key=lambda r: (r[0] * 7919) % 701)  # equal texts in different tasks
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "doc_id long, text string")
    got = sorted([tuple(r) for r in substring.without_repeats(docs, 10).collect()], key=str)
    assert got == brute(rows, 10)


@pytest.mark.parametrize("extend", [True, False])
def test_stream_over_batches(extend):
    """Batches of any size give what one batch gives."""
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, m, 4000) for m in (60, 4, 30, 40)]
    order = np.lexsort(rows[::-1])
    key, seg, d, at = (x[order] for x in rows)
    columns = (key, seg, d, at << 20, np.zeros(4000, np.int64))

    def taken(size):
        stream, out = substring._Stream(extend), []
        for i in range(0, 4000, size):
            out += list(zip(*(x.tolist() for x in stream.take(*(c[i : i + size] for c in columns))), strict=True))
        return sorted(out)

    assert taken(1) == taken(7) == taken(333) == taken(4000)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 700}" for i in range(60_000))
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(None, p), (None, None), (1, None), (2, ""), (3, " \n"), (4, p), (4, p), (5, "q " + p), (5, "r s " + p), (6, "short"), (7, long), (8, "Ä\xa0b " + p + "\x1c"), (-5, p + " " + p)]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert [r[:4] for r in run(spark, rows, 20, texts=False)] == [r[:4] for r in brute(rows, 20)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.without_repeats(docs).collect() == []


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in substring.query(spark, sf).collect()], key=str)
    assert got == [r[:4] for r in brute(rows, 20)]


@pytest.mark.parametrize("seed", range(4))
def test_many_contexts_of_one_phrase_in_one_task(spark, seed):
    """Ten contexts before and ten after a phrase of half the window, all combinations, with the limits as they are."""
    rng = random.Random(seed)
    phrase = [f"p{i}" for i in range(10)]
    left, right = ([[f"{x}{i}_{k}" for k in range(12)] for i in range(10)] for x in "lr")
    rows = [(10 * i + j, " ".join(left[i] + phrase + right[j])) for i in range(10) for j in range(10)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string")
    assert sorted([tuple(r) for r in substring.without_repeats(docs).collect()], key=str) == brute(rows, 20)
