"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from thornweave.llm import simhash


def brute_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, radius):
    """rows: (doc_id, fp as unsigned)."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted(((d, f, least.get(g)) for (d, f), g in zip(rows, group, strict=True)), key=str)


TEXTS = [None, "", " \n", "one", "ONE", "two words", "a b c d", "A B c d", "x\xa0y z\x1cq r s t", "É é À à ñ Ñ", "the cat sat on the mat " * 40, "the cat sat on the mat " * 39 + "dog"]


@pytest.mark.parametrize("k", [1, 4, 5])
def test_fingerprint(spark, sf, k):
    for t in TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]:
        assert simhash.fingerprint(t, k) == brute_fingerprint(t, k)


def test_very_long_text():
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "cde", "f", "ghij"]) + str(rng.randrange(50)) for _ in range(400_000))
    assert simhash.fingerprint(text, 4) == brute_fingerprint(text, 4)


@pytest.mark.parametrize("radius", range(0, 9))
def test_one_segment_differs_by_one_bit_at_most(radius):
    cut = simhash.segments(radius)
    assert sum(n for _, n in cut) == 64 and radius // len(cut) <= 1


def clustered(rng, n_centres, n):
    """Fingerprints in dense clusters and alone."""
    out = set()
    for _ in range(n_centres):
        centre = rng.getrandbits(64)
        for _ in range(n):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("radius", [2, 4, 7])
def test_links_hold_together_what_is_linked(spark, radius):
    rng = random.Random(radius)
    fps = clustered(rng, 12, 40) + [rng.getrandbits(64) for _ in range(50)]
    rows = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    group = {f: f for f in fps}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for r in simhash.links(df, radius).collect():
        a, b = r.src % 2**64, r.dst % 2**64
        assert (a ^ b).bit_count() <= radius
        group[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, f in rows:
        least.setdefault(top(f), i)
    assert sorted(((i, f, least[top(f)]) for i, f in rows), key=str) == brute_components(rows, radius)


def test_crowded_bucket(monkeypatch):
    """Cut by other bits, a bucket holds together the same fingerprints."""
    rng = random.Random(5)
    fps = np.array(sorted({(x >> 21 << 21) | 5 for x in clustered(rng, 8, 60)}), dtype=np.uint64)
    linker = simhash._Linker(4)

    def parts():
        group = list(range(len(fps)))
        for x, y in zip(*map(np.concatenate, linker.forest(fps, 0)), strict=True):
            i, j = group[np.searchsorted(fps, x)], group[np.searchsorted(fps, y)]
            group = [i if g == j else g for g in group]
        return [group.index(g) for g in group]

    whole = parts()
    monkeypatch.setattr(simhash, "LARGE", 20)
    assert parts() == whole


def test_components(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(300)) for _ in range(6)]
    texts = []
    for b in base:
        w = b.split()
        for _ in range(8):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    rows = [(100 + i, t, "x", 1) for i, t in enumerate(texts + TEXTS)] + [(7, texts[0], None, None)] * 2 + [(None, "only null has this text", "", 2), (None, texts[1], "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp long")
    want = brute_components([(r[0], brute_fingerprint(r[1], 4)) for r in rows], 4)
    got = sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_query(spark, sf):
    got = sorted([tuple(r) for r in simhash.query(spark, sf).select("doc_id", "fingerprint", "component_id").collect()], key=str)
    rows = [(r.doc_id, brute_fingerprint(r.text, 4)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == sorted([(d, f"{f:016x}", c) for d, f, c in brute_components(rows, 4)], key=str)
