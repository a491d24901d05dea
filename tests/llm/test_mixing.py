"""Replication against a Poisson distribution of its own."""

import hashlib
import math
from collections import Counter

import pytest

from thornweave.llm import mixing


def uniform(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def quantile(mean, u):
    p = total = math.exp(-mean)
    k = 0
    while total <= u and k < 400:
        k += 1
        p *= mean / k
        total += p
    return k


def brute(rows, weights, total, power, seed):
    """rows: (doc_id, text, source)."""
    n = Counter(r[2] for r in rows)
    w = {s: n[s] ** power for s in n} if weights is None else {s: weights.get(s, 0.0) for s in n}
    total = len(rows) if total is None else total
    out = Counter()
    for d, t, s in rows:
        key = str(d) if d is not None else "text:" + (t or "")
        rate = total * w[s] / sum(w.values()) / n[s] if sum(w.values()) else 0.0
        parts = max(1, math.ceil(rate / mixing.PART))
        times = sum(quantile(rate / parts, uniform(str(seed), "draw", str(i + 1), key)) for i in range(parts))
        for copy in range(1, times + 1):
            out[d, t, s, copy, hashlib.md5(f"{seed}:place:{copy}:{key}".encode()).hexdigest()[:16]] += 1
    return out


ROWS = [(i, f"t{i}", f"s{int(i**0.5) % 5}") for i in range(300)] + [(None, "a", None), (None, None, "s1"), (1000, "", "alone"), (7, "t7", "s2"), (7, "t7", "s2")]


@pytest.mark.parametrize("weights,total,power,seed", [(None, None, 0.5, 7), (None, 2000, 0.0, 1), ({"s0": 2, "s1": 1, "alone": 1}, 900, 0.5, 3), ({"nobody": 1.0}, None, 0.5, 1), ({None: 1.0, "s2": 3.0}, 100, 0.5, 5)])
@pytest.mark.parametrize("few", [0, 2000])
def test_against_brute_force(spark, monkeypatch, weights, total, power, seed, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    docs = spark.createDataFrame([(*r, 5, "x") for r in ROWS], "doc_id long, text string, source string, copy int, rate string")
    rows = mixing.replicated(docs, weights, total, power, seed).select("doc_id", "text", "source", "copy", "mix_key").collect()
    assert Counter(tuple(r) for r in rows) == brute(ROWS, weights, total, power, seed)
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.replicated(docs).collect() == []


def test_shares(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = mixing.replicated(docs, {"src0": 1, "src1": 1}, total=20_000).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in rows}
    assert set(n) == {"src0", "src1"} and all(abs(x - 10_000) < 600 for x in n.values())
