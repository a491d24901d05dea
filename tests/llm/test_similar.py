"""Groups of near copies against brute force over all pairs of texts, which knows nothing of fingerprints."""

import random
from collections import defaultdict

import numpy as np
import pytest

from thornweave.llm import similar


def brute_shingles(text, k):
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_one_of_each(rows, shingle, similarity):
    """rows: (doc_id, text). The first (doc_id, text) of each group of linked texts; a null doc_id comes last."""
    order = lambda r: (r[0] is None, r[0] or 0)
    texts = {}
    for d, t in sorted(rows, key=order):
        texts.setdefault(t or "", d)
    names, sets = list(texts), [set(brute_shingles(t, shingle)) for t in texts]
    group = list(range(len(names)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]) >= similarity:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    return sorted([(texts[t], t) for i, t in enumerate(names) if top(i) == i], key=str)


def family(rng, words, members, edits):
    """A text and others, each with some words of it changed."""
    w = [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(members):
        v = list(w)
        for _ in range(rng.randrange(0, edits)):
            v[rng.randrange(len(v))] = f"new{rng.randrange(1000)}"
        out.append(" ".join(v))
    return out


def corpus(seed, families=8):
    rng = random.Random(seed)
    texts = [t for _ in range(families) for t in family(rng, rng.choice([12, 150, 400]), 9, 6)]
    rows = [(i, t) for i, t in zip(rng.sample(range(10_000), len(texts)), texts, strict=True)]
    rows += [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "a b"), (10_005, "A b"), (20_000, texts[0]), (-3, texts[12]), (None, texts[30]), (None, "only null"), (10_077, "twice the same row"), (10_077, "twice the same row")]
    return rows


@pytest.mark.parametrize("block,few", [(400, 200_000), (4, 200_000), (3, 0)])
def test_one_of_each(spark, monkeypatch, block, few):
    """However small the blocks are, and whether keys are broadcast or not."""
    monkeypatch.setattr(similar, "BLOCK_TEXTS", block)
    monkeypatch.setattr(similar, "FEW_KEYS", few)
    rows = corpus(11)
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, digest string, component int")
    got = similar.one_of_each(docs)
    assert got.columns == docs.columns
    found = sorted([(r.doc_id, r.text or "") for r in got.collect()], key=str)
    assert found == brute_one_of_each(rows, 5, 0.8) and len(found) < len(rows) - 20
    assert similar.one_of_each(docs.limit(0)).collect() == []


def chained(rng, length, step):
    """Sets of 40 numbers, each of which shares most with the one before: a chain whose ends have nothing in common."""
    return [np.unique(np.arange(i * step, i * step + 40, dtype=np.int64) * 7919 + rng.randrange(1)) for i in range(length)]


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_groups_that_fill_many_blocks(spark, monkeypatch, block):
    """A chain, a dense group and strangers in one component: the links of all pairs decide, wherever the blocks are cut."""
    monkeypatch.setattr(similar, "BLOCK_TEXTS", block)
    rng = random.Random(5)
    sets = chained(rng, 30, 4) + [np.unique(np.append(np.arange(10_000, 10_050), 50_000 + i)).astype(np.int64) for i in range(25)]
    sets += [np.unique(np.array([rng.randrange(10**9) for _ in range(30)], np.int64)) for _ in range(12)]
    rows = [(i % 2, rng.randrange(10**12), i, s.tolist()) for i, s in enumerate(sets * 2)]
    rows = [(c, t + 1, p, s) for n, (c, t, p, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "component long, t long, place long, shingles array<long>")
    label = {r.t: r.label for r in similar.groups_within(df, 0.8).collect()}
    found, want = defaultdict(set), {}
    for _, t, _, _ in rows:
        found[label.get(t, t)].add(t)
    group = {t: t for _, t, _, _ in rows}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (c, t, _, s) in enumerate(rows):
        for d, u, _, v in rows[:i]:
            if c == d and alike(set(s), set(v)) >= 0.8:
                group[top(t)] = top(u)
    want = defaultdict(set)
    for _, t, _, _ in rows:
        want[top(t)].add(t)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and max(map(len, want.values())) >= 25


def test_block():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-50, 50, n)) for n in rng.integers(0, 60, 40)]
    block = similar.Block(sets)
    for own in [*sets, np.array([1000, -1000]), np.zeros(0, np.int64)]:
        assert block.alike(own, 0.4).tolist() == [alike(set(own.tolist()), set(s.tolist())) >= 0.4 for s in sets]
    assert similar.Block([]).groups(0.8).tolist() == []


def test_near_in_buckets():
    """Small and large buckets hold together what lies within the distance, and nothing else."""
    rng = np.random.default_rng(4)
    keys = np.sort(np.concatenate([np.full(n, k) for k, n in enumerate([1, 2, 15, 16, 17, 120])]))
    centres = rng.integers(0, 2**63, (len(set(keys.tolist())), 3), dtype=np.uint64)
    prints = centres[keys] ^ (np.uint64(1) << rng.integers(0, 64, (len(keys), 3), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (len(keys), 3), dtype=np.uint64))
    far = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum()) > 8
    group = list(range(len(keys)))
    want = list(range(len(keys)))

    def joined(of, i, j):
        return [of[i] if g == of[j] else g for g in of]

    for a, b in similar.near_in_buckets(keys, prints, 8):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            assert keys[i] == keys[j] and not far(i, j)
            group = joined(group, i, j)
    for i in range(len(keys)):
        for j in range(i):
            if keys[i] == keys[j] and not far(i, j):
                want = joined(want, i, j)
    same = lambda of: [of.index(g) for g in of]
    assert same(group) == same(want) and len(set(want)) > 6


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_whole_keys(size):
    import pyarrow as pa

    keys = np.repeat(np.arange(20), [1, 5, 3, 20, 1, 1, 9, 2, 30, 1] * 2)
    table = pa.table({"key": keys, "x": np.arange(len(keys))})
    parts = list(similar.whole_keys(iter(table.to_batches(max_chunksize=size)), ["key", "x"]))
    assert np.concatenate([x for _, x in parts]).tolist() == list(range(len(keys)))
    ends = [k[-1] for k, _ in parts if len(k)]
    assert len(ends) == len(set(ends))


@pytest.mark.parametrize("low,high,changed", [(0.80, 0.82, [9]), (0.82, 0.85, [7, 8]), (0.85, 0.90, [5, 6]), (0.90, 0.97, [2, 3, 4])])
def test_recall(spark, low, high, changed):
    """Of pairs made with a known similarity, at least 95 in 100 are found."""
    rng = random.Random(8)
    rows = []
    while len(rows) < 400:
        w = [f"v{rng.randrange(20_000)}" for _ in range(400)]
        v = list(w)
        for i in rng.sample(range(400), rng.choice(changed)):
            v[i] = f"other{rng.randrange(1000)}"
        a, b = set(brute_shingles(" ".join(w), 5)), set(brute_shingles(" ".join(v), 5))
        if low <= alike(a, b) <= high:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    stay = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = sum(i in stay and i + 1 in stay for i in range(0, 400, 2))
    print(low, "missed", missed, "of 200")
    assert stay >= set(range(0, 400, 2)) and missed <= 10
